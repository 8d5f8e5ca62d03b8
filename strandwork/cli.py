"""The command line: python -m strandwork.cli CATEGORY ACTION [options]. Data go to files or stdout, messages to stderr."""

from __future__ import annotations

import argparse
import logging
import os
import re
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork import __version__
from strandwork.functions.headers import footprint
from strandwork.operators import contigs, join, mates, rename, sample
from strandwork.operators.checks import DataError, first
from strandwork.sources import sinks
from strandwork.sources.contig_files import kind_of
from strandwork.scratch import shared_folder
from strandwork.sources.readers import fastq, read

log = logging.getLogger("strandwork")


def parse_size(text: str) -> int:
    """Bytes of 1024, 2K, 3m, 1G, 4T: a whole number with one letter at most, over 0 and in 64 bits."""
    found = re.fullmatch(r"(\d+)([KMGT]?)", text.strip(), re.IGNORECASE | re.ASCII)
    size = int(found[1]) << 10 * " KMGT".index(found[2].upper() or " ") if found else 0
    if not 0 < size < 1 << 64:
        raise DataError(f"not a size: {text!r}")
    return size


def one_stdio_at_most(paths: list[str | None], role: str) -> None:
    n = sum(p == "-" for p in paths)
    if n > 1:
        raise DataError(f"{n} {role}s are '-', and there is only one stdin/stdout; name the others")


class Job:
    """Files in and out of one run. stdin is put into a file first, since a frame is read more than once."""

    def __init__(self, args: argparse.Namespace):
        self.args = args
        threads = args.threads or os.cpu_count()
        builder = SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads}]")).config("spark.ui.enabled", "false")
        if getattr(args, "temp_dir", None):
            builder = builder.config("spark.local.dir", args.temp_dir)
        self.spark = builder.getOrCreate()
        self.spark.sparkContext.setLogLevel("ERROR")
        shared = shared_folder(self.spark).removeprefix("file://")
        if "://" in shared:
            raise DataError(f"spark.checkpoint.dir has to be a folder that can be opened as files, not {shared}")
        os.makedirs(shared, exist_ok=True)
        self.folder = tempfile.mkdtemp(prefix="strandwork-cli-", dir=shared)

    def path(self, path: str) -> str:
        if path != "-":
            if not os.path.exists(path):
                raise DataError(f"failed to open input file: {path}")
            return path
        held = os.path.join(self.folder, "stdin")
        with open(held, "wb") as out:
            shutil.copyfileobj(sys.stdin.buffer, out)
        return held

    def fastq(self, path: str, strict: bool = True) -> DataFrame:
        df = fastq(self.spark, self.path(path)).drop("file").persist()
        if strict and (row := first(df.select("idx", "error"), F.col("error").isNotNull(), "idx")):
            raise DataError(row["error"])
        return df.drop("error") if strict else df

    def lines(self, path: str) -> DataFrame:
        return read(self.spark, "textlines", self.path(path)).drop("file")

    def put(self, df: DataFrame, path: str, order: list[str], text=None) -> int:
        gzip, bgzf = self.args.gzip, self.args.bgzf
        if path != "-":
            return sinks.write(df, path, order, text, gzip, bgzf)
        if (gzip or bgzf) and sys.stdout.isatty():
            raise DataError("refusing to write gzip-compressed output to the terminal. Name a file or pipe it")
        held = os.path.join(self.folder, "stdout")
        n = sinks.write(df, held, order, text, gzip, bgzf)
        with open(held, "rb") as out:
            shutil.copyfileobj(out, sys.stdout.buffer)
        sys.stdout.buffer.flush()
        return n


def _rename(job: Job, apply) -> int:
    one_stdio_at_most([job.args.file, job.args.name], "input")
    names = rename.parse_names(job.lines(job.args.name).withColumn("line_no", F.col("line_no") + 1))
    n = job.put(apply(job.lines(job.args.file), names), job.args.output, ["line_no"], F.col("value"))
    log.info("%d line(s) written", n)
    return 0


def _need_second(args) -> None:
    if args.in2 and not args.out2:
        raise DataError("-O/--out2 is required when -I/--in2 is given")


def _sample(job: Job) -> int:
    a = job.args
    if (a.proportion is None) == (a.number is None):
        raise DataError("must specify one of -p/--proportion or -n/--number")
    _need_second(a)
    one_stdio_at_most([a.in1, a.in2], "input")
    one_stdio_at_most([a.out1, a.out2], "output")
    seed = time.time_ns() if a.non_deterministic else a.seed
    sides = [job.fastq(p) for p in (a.in1, a.in2) if p]
    if len(sides) == 2:
        mates.require_mates(*sides, check=not a.no_pair_check)
    kept = [sample.proportion(d, a.proportion, seed) if a.proportion is not None else sample.exact(d, a.number, seed) for d in sides]
    total = sides[0].count()
    for df, out in zip(kept, (a.out1, a.out2)):
        n = job.put(df, out, ["idx"])
    log.info("kept %d of %d (%.2f %%)", n, total, 100 * n / max(total, 1))
    return 0


def _rescue(job: Job) -> int:
    a = job.args
    _need_second(a)
    one_stdio_at_most([a.in1, a.in2], "input")
    one_stdio_at_most([a.out1, a.out2], "output")
    if not a.in2:
        kept, outcome = mates.rescue(job.fastq(a.in1, strict=False))
        job.put(kept, a.out1, ["idx"])
    else:
        kept, outcome = mates.rescue_paired(job.fastq(a.in1, strict=False), job.fastq(a.in2, strict=False), not a.no_pair_check)
        for k, out in ((1, a.out1), (2, a.out2)):
            job.put(kept.select("idx", *(F.col(f"{c}{k}").alias(c) for c in mates.FIELDS)), out, ["idx"])
    row = outcome.first()
    unit = "read pair(s)" if a.in2 else "read(s)"
    if row["outcome"]:
        log.warning("input looks truncated/corrupted: rescued %d clean %s before the failure point", row["rescued"], unit)
    else:
        log.info("input read cleanly: %d %s, no corruption detected", row["rescued"], unit)
    return row["outcome"]


def _deinterleave(job: Job) -> int:
    a = job.args
    one_stdio_at_most([a.out1, a.out2], "output")
    for df, out in zip(mates.deinterleave(job.fastq(a.input), a.layout, not a.no_pair_check, a.input != "-"), (a.out1, a.out2)):
        log.info("%d record(s) written", job.put(df, out, ["idx"]))
    return 0


def _interleave(job: Job) -> int:
    a = job.args
    one_stdio_at_most([a.in1, a.in2], "input")
    job.put(mates.interleave(job.fastq(a.in1), job.fastq(a.in2), not a.no_pair_check), a.out, ["idx"])
    return 0


def _cat(job: Job) -> int:
    a = job.args
    one_stdio_at_most([*a.r1, *(a.r2 or [])], "input")
    one_stdio_at_most([a.out1, a.out2], "output")
    if a.r2 and not a.out2:
        raise DataError("-O/--out2 is required when --r2 is given")
    if a.out2 and not a.r2:
        raise DataError("-O/--out2 needs --r2")
    one, two = join.cat([job.fastq(p) for p in a.r1], [job.fastq(p) for p in a.r2] if a.r2 else None, a.allow_duplicate_ids, ["<stdin>" if p == "-" else p for p in a.r1])
    job.put(one, a.out1, ["out_idx"])
    if two is not None:
        job.put(two, a.out2, ["out_idx"])
    return 0


def _pair(job: Job) -> int:
    a = job.args
    budget = parse_size(a.max_memory)
    if a.partitions < 1:
        raise DataError("--partitions must be at least 1")
    one_stdio_at_most([a.in1, a.in2], "input")
    one_stdio_at_most([a.out1, a.out2, a.unpaired1, a.unpaired2], "output")
    one, two = job.fastq(a.in1), job.fastq(a.in2)
    weight = footprint(*(F.col(c) for c in mates.FIELDS))
    total = sum(d.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] for d in (one, two))
    if total > budget:  # spilling is Spark's: the records go to so many partitions that each is within the budget
        parts = max(a.partitions, -(-total // budget))
        job.spark.conf.set("spark.sql.shuffle.partitions", parts)
        log.info("%d bytes of records are over --max-memory; joined in %d partitions", total, parts)
    both = join.matched(one, two).persist()
    row = join.stats(both).first()
    pairs = both.where("i1 is not null and i2 is not null").withColumn("done_at", F.greatest(F.col("i1") * 2, F.col("i2") * 2 + 1))
    for k, out in ((1, a.out1), (2, a.out2)):
        job.put(pairs.select("done_at", *(F.col(f"{c}{k}").alias(c) for c in mates.FIELDS)), out, ["done_at"])
    for k, other, out in ((1, 2, a.unpaired1), (2, 1, a.unpaired2)):
        if out:
            job.put(both.where(f"i{other} is null").select(F.col(f"i{k}").alias("idx"), *(F.col(f"{c}{k}").alias(c) for c in mates.FIELDS)), out, ["idx"])
    log.info("paired %d records (%d read 1, %d read 2 in); %d + %d without a mate", row["pairs"], row["n1"], row["n2"], row["orphans1"], row["orphans2"])
    if not a.unpaired1 and not a.unpaired2 and row["orphans1"] + row["orphans2"]:
        log.warning("%d records had no mate and were dropped; pass -u/-U to keep them", row["orphans1"] + row["orphans2"])
    return 0


# How the report puts each finding.
REPORT = {
    "unknown": "  {file}: {n} contig(s) the reference does not have",
    "length": "  {file}: {n} contig(s) with a different length -- these are different genome builds",
    "order": "  {file}: lists its contigs in a different order than the reference",
    "missing": "  {file}: does not mention {n} of the reference's contigs (normal for a file that only covers part of the genome)",
}


def _contigs(job: Job) -> int:
    a = job.args
    kinds = [kind_of(p) for p in a.files]
    reference, *others = [read(job.spark, "contigs", job.path(p)).withColumn("file", F.lit(k)) for k, p in enumerate(a.files)]
    rest = others[0]
    for df in others[1:]:
        rest = rest.union(df)
    rest = rest.persist()
    seen = {r["file"]: r for r in contigs.summary(reference.union(rest)).collect()}  # one row a file
    width = max(6, *map(len, a.files))
    print(f"{'file':<{width}}  {'kind':<6}  {'contigs':>7}  lengths")
    for k, path in enumerate(a.files):
        n, lengths = (seen[k]["contigs"], seen[k]["lengths"]) if k in seen else (0, "-")
        print(f"{path:<{width}}  {kinds[k]:<6}  {n:>7}  {lengths}" + ("" if k else "   (reference)"))
    found = sorted(contigs.findings(reference, rest, a.require_order).collect(), key=lambda r: (r["file"], list(REPORT).index(r["finding"])))
    print()
    for row in found:
        hint = " (pass --require-order if that matters here)" if row["finding"] == "order" and not a.require_order else ""
        print(REPORT[row["finding"]].format(file=a.files[row["file"]], n=row["n"]) + hint)
        own = F.col("file") == row["file"]
        if row["finding"] == "unknown":
            for r in contigs.unknown(reference, rest).where(own).orderBy("ord").toLocalIterator():
                print(f"      {r['name']}" + (f' -- the reference calls it "{r["alias"]}"' if r["alias"] else ""))
        if row["finding"] == "length":
            for r in contigs.length_conflicts(reference, rest).where(own).orderBy("ord").toLocalIterator():
                print(f"      {r['name']}: {r['here']} here, {r['there']} in the reference")
    if not found:
        print(f"All files agree with {a.files[0]}.")
    if fatal := sum(r["fatal"] for r in found):
        raise DataError(f"{fatal} of {len(found)} findings would change results silently rather than fail loudly")
    return 0


class Whole(argparse.Action):
    """A whole number over zero, kept for scripts that set it: batches are sized by bytes here."""

    def __call__(self, parser, namespace, value, option_string=None):
        if value < 1:
            parser.error(f"{option_string} must be > 0")
        setattr(namespace, self.dest, value)


def parser() -> argparse.ArgumentParser:
    """Threads and compression may stand before or after the action."""

    def everywhere(p, first: bool):
        p.add_argument("-j", "--threads", type=int, default=1 if first else argparse.SUPPRESS)
        p.add_argument("-z", "--gzip", action="store_true", default=False if first else argparse.SUPPRESS)
        p.add_argument("-b", "--bgzf", action="store_true", default=False if first else argparse.SUPPRESS)
        p.add_argument("-V", "--version", action="version", version=f"strandwork {__version__}")

    top = argparse.ArgumentParser(prog="strandwork")
    everywhere(top, True)
    kinds = top.add_subparsers(dest="category", required=True)

    def group(name):
        p = kinds.add_parser(name)
        everywhere(p, False)
        return p.add_subparsers(dest="action", required=True)

    def action(of, name, run, chunk="--chunk-records"):
        p = of.add_parser(name)
        everywhere(p, False)
        if chunk:
            p.add_argument(chunk, type=int, action=Whole)
        p.set_defaults(run=run)
        return p

    def two_in(p, second=False):
        p.add_argument("-i", "--in1", required=True)
        p.add_argument("-I", "--in2", required=second)

    def two_out(p, second=False):
        p.add_argument("-o", "--out1", default="-")
        p.add_argument("-O", "--out2", required=second)

    fastx, gff, check = group("fastx"), group("gff"), group("check")
    for of, apply in ((fastx, rename.fasta), (gff, rename.gff)):
        p = action(of, "rename", lambda job, apply=apply: _rename(job, apply), "--chunk-lines")
        p.add_argument("file")
        p.add_argument("-n", "--name", required=True)
        p.add_argument("-o", "--output", default="-")
    p = action(fastx, "sample", _sample)
    two_in(p)
    two_out(p)
    p.add_argument("-p", "--proportion", type=float)
    p.add_argument("-n", "--number", type=int)
    p.add_argument("-s", "--seed", type=int, default=42)
    p.add_argument("-r", "--non-deterministic", action="store_true")
    p.add_argument("--no-pair-check", action="store_true")
    p = action(fastx, "rescue", _rescue)
    two_in(p)
    two_out(p)
    p.add_argument("--no-pair-check", action="store_true")
    p = action(fastx, "deinterleave", _deinterleave)
    p.add_argument("-i", "--in", dest="input", required=True)
    two_out(p, True)
    p.add_argument("--layout", choices=["auto", "interleaved", "concat", "by-suffix"], default="auto")
    p.add_argument("--no-pair-check", action="store_true")
    p = action(fastx, "interleave", _interleave)
    two_in(p, True)
    p.add_argument("-o", "--out", default="-")
    p.add_argument("--no-pair-check", action="store_true")
    p = action(fastx, "cat", _cat)
    p.add_argument("--r1", action="append", required=True)
    p.add_argument("--r2", action="append")
    two_out(p)
    p.add_argument("--allow-duplicate-ids", action="store_true")
    p = action(fastx, "pair", _pair)
    two_in(p, True)
    two_out(p, True)
    p.add_argument("-u", "--unpaired1")
    p.add_argument("-U", "--unpaired2")
    p.add_argument("--max-memory", default="2G")
    p.add_argument("--temp-dir")
    p.add_argument("--partitions", type=int, default=256)
    p = action(check, "contigs", _contigs, None)
    p.add_argument("files", nargs="+")
    p.add_argument("--require-order", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    args = parser().parse_args(argv)
    if args.category == "check" and len(args.files) < 2:
        print("Error: at least two files are needed", file=sys.stderr)
        return 1
    job = Job(args)
    try:
        return args.run(job)
    except BrokenPipeError:
        sys.stdout = open(os.devnull, "w")
        return 0
    except (DataError, ValueError, OSError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    finally:
        shutil.rmtree(job.folder, ignore_errors=True)


if __name__ == "__main__":
    sys.exit(main())
