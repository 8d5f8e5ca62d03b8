from strandwork.functions.headers import fasta_key, fasta_line
from strandwork.operators import sample
from strandwork.streaming import twins

RECORD = "idx bigint, header string, seq string, plus string, qual string"


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def finished(spark, df, name):
    run = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.table(name).collect()


def records(n, mate):
    return [(i, f"@R{i}/{mate}", "A", "+", "I") for i in range(n)]


def test_stateless_twins(spark, tmp_path):
    rows = records(200, 1)
    got = finished(spark, twins.proportion(stream(spark, tmp_path, rows, RECORD), 0.2, 3), "sampled")
    assert {r["idx"] for r in got} == {r["idx"] for r in sample.proportion(spark.createDataFrame(rows, RECORD), 0.2, 3).collect()}
    names = spark.createDataFrame([("a", "1")], "old string, new string")
    lines = stream(spark, tmp_path / "l", [(0, ">a x"), (1, "ACGT"), (2, ">b")], "line_no bigint, value string")
    got = finished(spark, twins.renamed(lines, names, fasta_key, fasta_line), "renamed")
    assert sorted((r["line_no"], r["value"]) for r in got) == [(0, ">1"), (1, "ACGT"), (2, ">b")]


def test_stateful_twins(spark, tmp_path):
    rows = records(5, 1) + records(3, 2)
    got = finished(spark, twins.without_repeats(stream(spark, tmp_path / "d", rows, RECORD)), "distinct_reads")
    assert sorted(r["id"] for r in got) == [f"R{i}" for i in range(5)]
    one, two = twins.by_suffix(stream(spark, tmp_path / "s", rows, RECORD))
    got = finished(spark, twins.paired(one, two), "paired_reads")
    assert sorted(r["id"] for r in got) == ["R0", "R1", "R2"]
