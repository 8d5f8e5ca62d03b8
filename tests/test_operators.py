import pytest
from pyspark.sql import functions as F

from strandwork.operators import checks, contigs, join, mates, rename
from strandwork.operators.checks import DataError, dense, numbered

RECORD = "idx bigint, header string, seq string, plus string, qual string"


def reads(spark, *headers):
    return spark.createDataFrame([(i, f"@{h}", "ACGT", "+", "IIII") for i, h in enumerate(headers)], RECORD)


def names(df):
    return [r["header"][1:] for r in df.orderBy("idx").collect()]


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text)), "line_no bigint, value string")


@pytest.mark.parametrize(
    "headers,layout,one,two",
    [
        (["a/1", "a/2", "b/1", "b/2"], "interleaved", ["a/1", "b/1"], ["a/2", "b/2"]),
        (["a/1", "b/1", "a/2", "b/2"], "concat", ["a/1", "b/1"], ["a/2", "b/2"]),
        (["a", "b", "a", "b"], "concat", ["a", "b"], ["a", "b"]),
        (["S.1 1/2", "S.2 2/1", "S.3 3/1", "S.4 4/2"], "by-suffix", ["S.2 2/1", "S.3 3/1"], ["S.1 1/2", "S.4 4/2"]),
        (["a/1", "a/2", "b/1", "b/2"], "auto", ["a/1", "b/1"], ["a/2", "b/2"]),
        (["a", "b", "a", "b"], "auto", ["a", "b"], ["a", "b"]),
        (["S.1 1/2", "S.2 2/1"], "auto", ["S.2 2/1"], ["S.1 1/2"]),
    ],
)
def test_deinterleave(spark, headers, layout, one, two):
    r1, r2 = mates.deinterleave(reads(spark, *headers), layout)
    assert (names(r1), names(r2)) == (one, two)


@pytest.mark.parametrize(
    "headers,layout,message",
    [
        (["a/1", "b/2", "c/1", "d/2"], "interleaved", "not an interleaved file: records #1 and #2"),
        (["a/1", "a/2", "b/1"], "interleaved", "odd number of records"),
        (["a/2", "b/1", "c/1", "d/2"], "concat", "not an R1-then-R2 concatenation"),
        (["a/1", "b/1", "c/1", "d/1"], "concat", "both halves are"),
        (["a/1", "b 1:N:0:AT", "c/2"], "by-suffix", "record #2 carries no /1 or /2"),
        (["a/1", "b/1", "c/2"], "by-suffix", "different numbers of records"),
        ([], "auto", "input is empty"),
        (["a", "b", "c", "d"], "auto", "could not determine"),
    ],
)
def test_deinterleave_refuses(spark, headers, layout, message):
    df = reads(spark, *headers) if headers else spark.createDataFrame([], RECORD)
    with pytest.raises(DataError, match=message):
        mates.deinterleave(df, layout)


def test_interleave_round_trip_and_refusals(spark):
    one, two = reads(spark, "a/1", "b/1"), reads(spark, "a/2", "b/2")
    both = mates.interleave(one, two)
    assert names(both) == ["a/1", "a/2", "b/1", "b/2"]
    assert [names(r) for r in mates.deinterleave(both)] == [["a/1", "b/1"], ["a/2", "b/2"]]
    with pytest.raises(DataError, match="desync at pair #1"):
        mates.interleave(one, reads(spark, "a/2", "x/2"))
    with pytest.raises(DataError, match="different numbers of reads"):
        mates.interleave(one, reads(spark, "a/2"), check=False)


def test_rescue(spark):
    bad = reads(spark, "a", "b", "c").withColumn("qual", F.when(F.col("idx") == 1, "I").otherwise(F.col("qual")))
    kept, outcome = mates.rescue(bad)
    assert names(kept) == ["a"] and tuple(outcome.first()) == (1, 3)
    kept, outcome = mates.rescue_paired(reads(spark, "a", "b"), reads(spark, "a", "b", "c"))
    assert kept.count() == 2 and tuple(outcome.first()) == (2, 3)
    empty = spark.createDataFrame([], RECORD)
    assert tuple(mates.rescue(empty)[1].first()) == (0, 0)
    assert tuple(mates.rescue(reads(spark, "a").withColumn("plus", F.lit("x")))[1].first()) == (0, 1)


def test_pair_policies(spark):
    one, two = reads(spark, "a/1", "b/1", "a/1", "c/1"), reads(spark, "c/2", "a/2", "d/2")
    pairs, o1, o2 = join.pair(one, two)
    assert {(r["id"], r["i1"], r["i2"]) for r in pairs.collect()} == {("a", 0, 1), ("c", 3, 0)}
    assert names(o1) == ["b/1", "a/1"] and names(o2) == ["d/2"]
    assert [r["id"] for r in pairs.orderBy("done_at").collect()] == ["a", "c"]
    assert {r["i1"] for r in join.pair(one, two, "last")[0].where("id = 'a'").collect()} == {2}
    with pytest.raises(DataError, match="duplicate read ID 'a'"):
        join.pair(one, two, "error")


def test_cat_tells_both_places_of_a_repeated_name(spark):
    with pytest.raises(DataError, match=r"'x2': first seen in one \(record #2\), again in two \(record #3\)"):
        join.cat([reads(spark, "x1/1", "x2/1", "x3/1"), reads(spark, "y1/1", "y2/1", "x2/1")], names=["one", "two"])
    rows, _ = join.cat([reads(spark, "x", "y"), reads(spark, "x")], allow_duplicates=True)
    assert [r["header"] for r in rows.orderBy("out_idx").collect()] == ["@x", "@y", "@x"]
    with pytest.raises(DataError, match="local pair #2"):
        join.cat([reads(spark, "p1", "p2", "p3")], [reads(spark, "p1", "WRONG", "p3")])
    with pytest.raises(DataError, match="same number of times"):
        join.cat([reads(spark, "a")], [])


def test_rename(spark):
    table = rename.parse_names(lines(spark, ["1\tchr1", "", "2\tchr2", "3   chr3 more", "9 chr1", "1 chr1"]))
    given = [">chr1 a description", "ACGT", "   acgt   ", ">chr2\tx", ">chrU y", ">", "", "CCCC\r", ">chr3"]
    want = [">1", "ACGT", "acgt", ">2", ">chrU", ">", "", "CCCC", ">3"]
    assert [r["value"] for r in rename.fasta(lines(spark, given), table).orderBy("line_no").collect()] == want
    given = ["##gff-version 3", "chr1\tsrc\tgene", "chrU\tsrc", "chr1", "   chr2\tsrc", "chr3\tsrc\r", ""]
    want = ["##gff-version 3", "1\tsrc\tgene", "chrU\tsrc", "1\t", "2\tsrc", "3\tsrc", ""]
    assert [r["value"] for r in rename.gff(lines(spark, given), table).orderBy("line_no").collect()] == want
    with pytest.raises(DataError, match="expected 2 columns"):
        rename.parse_names(lines(spark, ["a b", "lonely"]))


def book(spark, file, *rows):
    return spark.createDataFrame([(file, i, n, x) for i, (n, x) in enumerate(rows)], "file string, ord bigint, name string, length bigint")


def test_contigs(spark):
    ref = book(spark, "ref", ("1", 2000), ("2", 1500), ("MT", 300))
    chr_ = book(spark, "chr", ("chr1", 2000), ("chr2", 1500), ("chrMT", 300))
    length, turned, part = book(spark, "len", ("1", 2000), ("2", 1501), ("MT", 300)), book(spark, "turn", ("2", 1500), ("1", 2000), ("MT", 300)), book(spark, "bed", ("1", None), ("2", None))
    others = chr_.union(length).union(turned).union(part)
    got = {(r["file"], r["finding"], r["fatal"], r["n"]) for r in contigs.findings(ref, others).collect()}
    assert got == {("chr", "unknown", True, 3), ("len", "length", True, 1), ("turn", "order", False, 1), ("bed", "missing", False, 1)}
    assert {r["alias"] for r in contigs.unknown(ref, chr_).collect()} == {"1", "2", "MT"}
    assert {r["file"]: r["lengths"] for r in contigs.summary(others).collect()}["bed"] == "no"
    assert ("turn", "order", True, 1) in {tuple(r) for r in contigs.findings(ref, others, True).collect()}


def test_fasta_lengths_and_dense(spark):
    got = contigs.fasta_lengths(lines(spark, ["junk", ">a x", "ACGT", " AC ", ">b", ">c", "é"])).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "a", 6), (1, "b", 0), (2, "c", 2)]
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("v"))
    assert [r["idx"] for r in dense(df, [F.col("v")]).orderBy("v").collect()] == list(range(100))
    assert dense(df.limit(0), [F.col("v")]).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [4, 61])
def test_numbers_have_no_gaps_in_a_million_rows(spark, adaptive, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003 * 3).alias("v"))
        for got in (dense(df, [F.col("v")]), numbered(df, "v", "idx")):
            row = got.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("kinds"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
            assert tuple(row) == (1_000_000, 1_000_000, 0, 999_999)
            assert got.where("idx < 1000 or idx >= 999000").orderBy("idx").select("v").collect() == got.where("idx < 1000 or idx >= 999000").orderBy("v").select("v").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sequences_over_spans_of_lines(spark, monkeypatch):
    monkeypatch.setattr(checks, "SPAN", 3)
    text = ["x", ">a", *["ACG"] * 10, ">b", ">c", *["T"] * 5]
    assert [tuple(r) for r in contigs.fasta_lengths(lines(spark, text)).orderBy("ord").collect()] == [(0, "a", 30), (1, "b", 0), (2, "c", 5)]
    r1, r2 = mates.split(reads(spark, *[f"x{i}/{1 + i % 3 % 2}" for i in range(20)]), "by-suffix")
    assert names(r1) == [f"x{i}/1" for i in range(20) if not i % 3 % 2] and names(r2) == [f"x{i}/2" for i in range(20) if i % 3 % 2]
    assert [r["idx"] for r in r1.orderBy("idx").collect()] == list(range(r1.count()))


@pytest.mark.parametrize("few", [0, 1000])
def test_a_name_that_repeats(spark, monkeypatch, few):
    monkeypatch.setattr(join, "FEW_NAMES", few)
    one, two = reads(spark, *["a/1"] * 30, "b/1", "b/1"), reads(spark, "b/2", *["a/2"] * 5)
    both = join.matched(one, two)
    assert {(r["id"], r["i1"], r["i2"]) for r in both.where("i1 is not null and i2 is not null").collect()} == {("a", 0, 1), ("b", 30, 0)}
    assert both.count() == 32 + 6 - 2
    found = join.repeated(join.stacked([one, two])).collect()
    assert {tuple(r) for r in found} == {("a", 0, 0, 0, 1), ("b", 0, 30, 0, 31)}
    assert {(r["i1"], r["i2"]) for r in join.pair(one, two, "occurrence")[0].where("id = 'a'").collect()} == {(k, k + 1) for k in range(5)}


def test_names_shared_by_sources(spark):
    sources = [reads(spark, "a/1", "b/1", "a/1"), reads(spark, "c/2", "a/2", "c/2"), reads(spark, "b", "a")]
    want = {("a", 0, 0, 1, 1), ("a", 0, 2, 1, 1), ("b", 0, 1, 2, 0), ("a", 0, 0, 2, 1), ("a", 0, 2, 2, 1), ("a", 1, 1, 2, 1)}
    assert sorted(tuple(r) for r in join.shared(sources).collect()) == sorted(want)
    assert join.shared(sources[:1]).count() == 0


def test_swapped_halves_are_told(spark, caplog):
    mates.deinterleave(reads(spark, "a/2", "b/2", "a/1", "b/1"), "concat")
    assert "swapped" in caplog.text
