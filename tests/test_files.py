import gzip
import io
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork import cli
from strandwork.sources import contig_files, readers, sinks
from strandwork.sources.decoding import Truncated, lines
from strandwork.sources.readers import _pieces, fastq_records, read
from strandwork.sources.readers import fastq as read_fastq

NAMES = [("1", 2000), ("2", 1500), ("MT", 300)]


def fastq(n, mate=1):
    return "".join(f"@R{i}/{mate}\nACGT\n+\nIIII\n" for i in range(n))


@pytest.mark.parametrize("kind", ["plain", "gzip", "bgzf"])
def test_write_and_read_again_in_order(spark, tmp_path, kind):
    df = spark.range(5000).select(F.col("id").alias("idx"), F.concat(F.lit("@r"), F.col("id").cast("string")).alias("header"), F.lit("AC").alias("seq"), F.lit("+").alias("plus"), F.lit("II").alias("qual"))
    path = str(tmp_path / "out.fq")
    assert sinks.write(df.repartition(5), path, ["idx"], gzip=kind == "gzip", bgzf=kind == "bgzf") == 5000
    data = open(path, "rb").read()
    if kind == "bgzf":
        assert data[12:14] == b"BC" and data.endswith(sinks.BGZF_END) and data.count(sinks.BGZF_END) == 1
    back = read(spark, "fastq", path).orderBy("idx").collect()
    assert [r["header"] for r in back] == [f"@r{i}" for i in range(5000)] and not any(r["error"] for r in back)


def test_gzip_is_told_by_content_and_members_are_one_stream(tmp_path):
    path = tmp_path / "no_ending"
    path.write_bytes(gzip.compress(b"a\nb") + gzip.compress(b"c\n\nd"))
    assert [x for x, _ in lines(str(path))] == [b"a", b"bc", b"", b"d"]
    path.write_bytes(gzip.compress(fastq(2000).encode())[:-40])
    got = []
    with pytest.raises(Truncated):
        for x in lines(str(path)):
            got.append(x)
    assert got


@pytest.mark.parametrize(
    "text,n,error",
    [
        (fastq(3), 3, None),
        (fastq(2).replace("\n", "\r\n"), 2, None),
        (fastq(2)[:-6], 1, "missing quality line"),
        ("R\nA\n+\nI\n", 0, "does not start with '@'"),
        ("@R\nA\nx\nI\n", 0, "expected '+' line"),
        ("@R\nAC\n+\nI\n", 0, "sequence length (2) != quality length (1)"),
        ("@R\nAC\n", 0, "missing '+' line"),
        (fastq(1) + "\n", 1, "does not start with '@'"),
        ("", 0, None),
    ],
)
def test_records(tmp_path, text, n, error):
    path = tmp_path / "x.fq"
    path.write_bytes(text.encode())
    rows = list(fastq_records(str(path)))
    good = [r for r in rows if r[-1] is None]
    assert len(good) == n and (error is None) == (len(rows) == n)
    if error:
        assert error in rows[-1][-1]


def headers(tmp_path):
    sam = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in NAMES)
    vcf = "##fileformat=VCFv4.2\n" + "".join(f"##contig=<ID={n},length={x}>\n" for n, x in NAMES) + "#CHROM\tPOS\n1\t5\n"
    bam = b"BAM\x01" + struct.pack("<i", len(sam)) + sam.encode() + struct.pack("<i", 3)
    for n, x in NAMES:
        bam += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", x)
    bcf = b"BCF\x02\x02" + struct.pack("<I", len(vcf) + 1) + vcf.encode() + b"\0"
    body = struct.pack("<i", len(sam)) + sam.encode()
    packed = gzip.compress(body)
    itf8 = lambda v: bytes([v]) if v < 128 else bytes([0x80 | v >> 8, v & 255])
    block = bytes([1, 0]) + b"\x00" + itf8(len(packed)) + itf8(len(body)) + packed + bytes(4)
    cram = b"CRAM\x03\x00" + bytes(20) + struct.pack("<i", len(block)) + bytes(4) + bytes(2) + itf8(1) + itf8(1) + itf8(0) + bytes(4) + block
    files = {
        "ref.fa.fai": "".join(f"{n}\t{x}\t5\t60\t61\n" for n, x in NAMES).encode(),
        "a.sam": sam.encode(),
        "a.vcf.gz": gzip.compress(vcf.encode()),
        "a.bam": sinks.bgzf_member(bam) + sinks.BGZF_END,
        "a.bcf": sinks.bgzf_member(bcf) + sinks.BGZF_END,
        "a.cram": cram,
        "a.fa": "".join(f">{n} d\n" + "A" * x + "\n" for n, x in NAMES).encode(),
        "a.gff3": b"x\tsrc\n" + "".join(f"##sequence-region {n} 1 {x}\n" for n, x in NAMES).encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return [str(tmp_path / n) for n in files]


def test_all_kinds_of_contig_files_agree(spark, tmp_path):
    paths = headers(tmp_path)
    for path in paths:
        assert contig_files.read_contigs(path)[1] == NAMES, path
    rows = read(spark, "contigs", *paths).groupBy("kind").count().collect()
    assert {r["kind"] for r in rows} == {"sizes", "SAM", "VCF", "BAM", "BCF", "CRAM", "FASTA", "GFF"} and {r["count"] for r in rows} == {3}
    (tmp_path / "r.bed").write_text("track x\n#c\n2\t1\t5\n1\t0\t3\n2\t7\t9\n")
    assert contig_files.read_contigs(str(tmp_path / "r.bed"))[1] == [("2", None), ("1", None)]
    with pytest.raises(ValueError, match="cannot tell what kind"):
        contig_files.kind_of("mystery.txt")


@pytest.mark.parametrize("n", [1, 7, 640, 123_456])
@pytest.mark.parametrize("power,letters", list(enumerate(["", "kK", "mM", "gG", "tT"])))
def test_sizes_scale_by_their_letter(n, power, letters):
    for letter in letters or [""]:
        assert cli.parse_size(f"{n}{letter}") == n * 1024**power


@pytest.mark.parametrize("text", ["M", "12 MiB", "0x10", "5e3", "00", "-8k", "\u0663", str(1 << 64), f"{1 << 54}K"])
def test_sizes_that_are_none(text):
    with pytest.raises(ValueError):
        cli.parse_size(text)


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
@pytest.mark.parametrize("text", [fastq(60), fastq(60).replace("\n", "\r\n"), fastq(60)[:-9], fastq(30) + "R\n" + fastq(5), "@a\nACGT\n+\n@@@@\n" * 40, "\n" * 9])
def test_pieces_of_a_plain_file_are_the_file(spark, tmp_path, text, piece):
    """Up to the first bad record, with which the file read in turn ends."""
    path = tmp_path / "x.fq"
    path.write_bytes(text.encode())
    want = list(fastq_records(str(path)))
    size, cuts, number = len(text), [], 0
    for begin in range(0, size, piece):
        cuts.append((begin, min(begin + piece, size), number))
        number += text[begin : begin + piece].count("\n")
    batches = [pa.RecordBatch.from_arrays([pa.array([str(path)]), *(pa.array([x]) for x in cut)], names=["path", "begin", "end", "line"]) for cut in cuts]
    got = [tuple(r.values()) for batch in _pieces(iter(batches)) for r in batch.to_pylist()]
    stop = next((k for k, r in enumerate(got) if r[-1] is not None), len(got) - 1)
    assert got[: stop + 1] == want


def test_a_file_in_pieces(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text(fastq(3000))
    want = [r["header"] for r in read(spark, "fastq", str(path)).orderBy("idx").collect()]
    got = read_fastq(spark, str(path), 5000)
    assert got.rdd.getNumPartitions() > 3
    assert [(r["idx"], r["header"]) for r in got.orderBy("idx").collect()] == list(enumerate(want))


def test_batches_are_sized_by_characters(tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "BATCH_CHARS", 1000)
    path = tmp_path / "x.fq"
    path.write_text(f"@a\n{'A' * 700}\n+\n{'I' * 700}\n" * 5)
    assert [b.num_rows for b in readers._batches(fastq_records(str(path)), readers.FASTQ)] == [1] * 5


def test_lengths_of_64_bits(spark, tmp_path):
    path = tmp_path / "r.sizes"
    path.write_text(f"a\t{(1 << 64) - 1}\nb\t{1 << 64}\nc\t+5\n")
    assert [(r["name"], r["length"]) for r in read(spark, "contigs", str(path)).orderBy("ord").collect()] == [("a", (1 << 64) - 1), ("b", None), ("c", 5)]


def test_commands(spark, tmp_path, capfd):
    one, two = tmp_path / "1.fq", tmp_path / "2.fq"
    one.write_text(fastq(100))
    two.write_text(fastq(100, 2))
    out = [str(tmp_path / f"o{k}.fq") for k in range(4)]
    assert cli.main(["fastx", "interleave", "-i", str(one), "-I", str(two), "-o", out[0]]) == 0
    assert cli.main(["fastx", "deinterleave", "-i", out[0], "-o", out[1], "-O", out[2]]) == 0
    assert open(out[1]).read() == fastq(100) and open(out[2]).read() == fastq(100, 2)
    assert cli.main(["fastx", "sample", "-i", str(one), "-n", "7", "-o", out[3]]) == 0
    assert open(out[3]).read().count("@R") == 7
    assert cli.main(["fastx", "sample", "-i", str(one), "-p", "2", "-o", out[3]]) == 1
    one.write_text(fastq(100)[:-3])
    assert cli.main(["fastx", "rescue", "-i", str(one), "-o", out[3]]) == 3
    assert open(out[3]).read() == fastq(99)
    assert cli.main(["fastx", "cat", "--r1", str(two), "--r1", str(two), "-o", out[3]]) == 1
    assert "duplicate read ID" in capfd.readouterr().err
    assert cli.main(["fastx", "pair", "-i", out[1], "-I", out[2], "-o", out[0], "-O", out[3]]) == 0
    paths = headers(tmp_path)
    assert cli.main(["check", "contigs", *paths]) == 0
    assert "All files agree" in capfd.readouterr().out


def piped(monkeypatch, capfdbinary, argv, data=b""):
    """Exit status, stdout and stderr of a command that reads data."""
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(data)))
    capfdbinary.readouterr()
    status = cli.main(argv)
    out, err = capfdbinary.readouterr()
    return status, out, err.decode()


def test_pipes(spark, tmp_path, monkeypatch, capfdbinary):
    run = lambda *argv, data=b"": piped(monkeypatch, capfdbinary, list(argv), data)
    names, out = tmp_path / "names", str(tmp_path / "out")
    names.write_text("1 chr1\n")
    fasta = b">chr1 x\nACGT\n"
    assert run("fastx", "rename", "-", "-n", str(names), data=fasta)[:2] == (0, b">1\nACGT\n")
    assert run("gff", "rename", "-", "-n", str(names), "--chunk-lines", "5", data=b"# c\nchr1\tx\n")[:2] == (0, b"# c\n1\tx\n")
    status, packed, _ = run("fastx", "rename", "-", "-n", str(names), "-z", data=gzip.compress(fasta))
    assert status == 0 and gzip.decompress(packed) == b">1\nACGT\n"
    status, packed, _ = run("-b", "fastx", "rename", "-", "-n", str(names), data=fasta)
    assert status == 0 and packed.endswith(sinks.BGZF_END)
    one = fastq(6).encode()
    assert run("fastx", "sample", "-i", "-", "-p", "1", data=one)[:2] == (0, one)
    assert run("fastx", "rescue", "-i", "-", data=one[:-3])[:2] == (3, fastq(5).encode())
    for argv, said in [
        (["fastx", "rename", "-", "-n", "-", "-o", out], "only one stdin/stdout"),
        (["fastx", "sample", "-i", "a", "-I", "b", "-o", "-", "-O", "-", "-p", "0.5"], "only one stdin/stdout"),
        (["fastx", "rescue", "-i", "-", "-I", "-", "-O", out], "only one stdin/stdout"),
        (["fastx", "deinterleave", "-i", "a", "-O", "-"], "only one stdin/stdout"),
        (["fastx", "cat", "--r1", "-", "--r2", "-", "-o", out, "-O", out], "only one stdin/stdout"),
        (["fastx", "deinterleave", "-i", "-", "--layout", "concat", "-O", out], "a pipe can only be read once"),
        (["fastx", "rename", str(tmp_path / "none"), "-n", str(names)], "failed to open input file"),
    ]:
        status, _, err = run(*argv, data=one)
        assert status == 1 and said in err, argv
    assert run("fastx", "deinterleave", "-i", "-", "-O", out, data=one.replace(b"/1", b""))[0] == 1
    with pytest.raises(SystemExit):
        cli.main(["fastx", "sample", "-i", "a", "-p", "1", "--chunk-records", "0"])
    with pytest.raises(SystemExit) as stopped:
        cli.main(["fastx", "--version"])
    assert stopped.value.code == 0


def test_a_reader_that_stops_early_is_no_failure(spark, tmp_path, monkeypatch):
    class Closed:
        def write(self, data):
            raise BrokenPipeError

        flush = close = lambda self: None

    path = tmp_path / "a.fa"
    path.write_text(">chr1\nACGT\n")
    (tmp_path / "names").write_text("1 chr1\n")
    monkeypatch.setattr("sys.stdout", type("Out", (), {"buffer": Closed(), "isatty": lambda self: False})())
    assert cli.main(["fastx", "rename", str(path), "-n", str(tmp_path / "names")]) == 0


def test_pair_beyond_its_memory(spark, tmp_path, capfd):
    one, two, out = tmp_path / "1.fq", tmp_path / "2.fq", [str(tmp_path / f"o{k}") for k in range(4)]
    one.write_text(fastq(50))
    two.write_text("".join(f"@R{i}/2\nACGT\n+\nIIII\n" for i in reversed(range(10, 60))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    args = ["-i", str(one), "-I", str(two), "-o", out[0], "-O", out[1], "-u", out[2], "-U", out[3]]
    assert cli.main(["fastx", "pair", *args, "--max-memory", "1K", "--partitions", "3", "--temp-dir", str(tmp_path), "--chunk-records", "10"]) == 0
    spark.conf.set("spark.sql.shuffle.partitions", before)
    heads = [[x.split("/")[0] for x in open(p).read().splitlines()[::4]] for p in out]
    assert heads[0] == heads[1] and sorted(heads[0]) == sorted(f"@R{i}" for i in range(10, 50))
    assert sorted(heads[2]) == sorted(f"@R{i}" for i in range(10)) and sorted(heads[3]) == sorted(f"@R{i}" for i in range(50, 60))


def test_report_of_contigs(spark, tmp_path, capfd):
    ref, other, bed = tmp_path / "ref.fa.fai", tmp_path / "o.sizes", tmp_path / "r.bed"
    ref.write_text("".join(f"c{i}\t{i + 1}\n" for i in range(40)))
    other.write_text("".join(f"chrc{i}\t{i + 1}\n" for i in range(30)) + "".join(f"c{i}\t99\n" for i in range(30, 40)))
    bed.write_text("c0\t0\t1\n")
    assert cli.main(["check", "contigs", str(ref), str(other), str(bed)]) == 1
    out, err = capfd.readouterr()
    lines_ = out.splitlines()
    assert lines_[0].split() == ["file", "kind", "contigs", "lengths"] and lines_[1].split() == [str(ref), "sizes", "40", "yes", "(reference)"]
    assert lines_[2].endswith("yes") and lines_[3].split()[1:] == ["BED", "1", "no"]
    assert out.count(" -- the reference calls it ") == 30 and out.count("99 here") == 10 and 'chrc7 -- the reference calls it "c7"' in out
    assert "does not mention 39" in out and "would change results silently" in err
