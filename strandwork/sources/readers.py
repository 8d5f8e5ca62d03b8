"""Data sources for FASTQ records, text lines and contig dictionaries.

The sources run on the executors and open paths there, so the files have to be where every executor sees them. A
compressed file is one task. Plain FASTQ files can be read in pieces by fastq(): a first pass counts the newlines of each
piece, so the second knows the number of the first line of each, and with it where records begin and what number they have.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandwork.sources.contig_files import read_contigs
from strandwork.sources.decoding import GZIP_MAGIC, Truncated, lines, lines_within

#: Rows and characters of a batch.
BATCH_ROWS, BATCH_CHARS = 20_000, 8 << 20
#: Bytes of a piece of a plain file.
PIECE = 64 << 20
FASTQ = "file string, idx bigint, header string, seq string, plus string, qual string, error string"
LINES = "file string, line_no bigint, value string"
CONTIGS = "file string, kind string, ord bigint, name string, length decimal(20,0)"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    schema, held, chars = _schema(ddl), [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == BATCH_ROWS or chars >= BATCH_CHARS:
            yield _batch(held, schema)
            held, chars = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([Decimal(v) if v is not None else None for v in c] if pa.types.is_decimal(f.type) else c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def fastq_records(path: str, idx: int = 0, read: Iterator[bytes] | None = None, ends: Callable[[], bool] = bool) -> Iterator[tuple]:
    """(file, idx, header, seq, plus, qual, error): all records up to the first bad one; that one has an error, and
    nothing follows it. read: the lines from record idx on, all of the file's if they aren't given; ends tells where to
    stop before another record."""
    read, clean = (data for data, _ in lines(path)) if read is None else read, True

    def line() -> str | None:
        nonlocal clean
        try:
            return next(read).rstrip(b"\r\n").decode("utf-8")
        except StopIteration:
            return None
        except Truncated:
            clean = False
            return None

    while not ends():
        at = 4 * idx + 1
        try:
            header = line()
            if header is None:
                if not clean:
                    yield path, idx, None, None, None, None, f"truncated input at line {at}: the file is cut off"
                return
            if not header.startswith("@"):
                yield path, idx, header, None, None, None, f"malformed FASTQ at line {at}: header does not start with '@': {header!r}"
                return
            found = [header]
            for k, what in enumerate(("sequence", "'+'", "quality"), 1):
                found.append(line())
                if found[-1] is None:
                    yield (path, idx, *found, *[None] * (4 - len(found)), f"truncated FASTQ record at line {at + k}: missing {what} line")
                    return
                if k == 2 and not found[-1].startswith("+"):
                    yield path, idx, *found, None, f"malformed FASTQ at line {at + 2}: expected '+' line, got: {found[-1]!r}"
                    return
            n_seq, n_qual = len(found[1].encode()), len(found[3].encode())
            if n_seq != n_qual:
                yield path, idx, *found, f"malformed FASTQ record ending at line {at + 3}: sequence length ({n_seq}) != quality length ({n_qual}) for read {header!r}"
                return
        except UnicodeDecodeError as error:
            yield path, idx, None, None, None, None, f"malformed FASTQ at line {at}: not valid UTF-8: {error.reason}"
            return
        yield path, idx, *found, None
        idx += 1


def text_lines(path: str) -> Iterator[tuple]:
    for n, (line, _) in enumerate(lines(path)):
        yield path, n, line.decode("utf-8")


def contig_rows(path: str) -> Iterator[tuple]:
    kind, contigs = read_contigs(path)
    for ord_, (name, length) in enumerate(contigs):
        yield path, kind, ord_, name, length


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, rows, ddl: str, options):
        path = options["path"]
        names = sorted(glob.glob(path)) if glob.has_magic(path) else path.split("\x1f")
        self.rows, self.ddl, self.paths = rows, ddl, [os.path.abspath(p) for p in names]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        return _batches(self.rows(partition.path), self.ddl)


def _source(format_: str, ddl: str, rows):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return format_

        def schema(self):
            return ddl

        def reader(self, schema):
            return _Reader(rows, ddl, self.options)

    return Source


FastqSource = _source("fastq", FASTQ, fastq_records)
LinesSource = _source("textlines", LINES, text_lines)
ContigsSource = _source("contigs", CONTIGS, contig_rows)


def register(spark: SparkSession) -> SparkSession:
    """Makes spark.read.format("fastq"), "textlines" and "contigs" known. Options: path, or several joined by \\x1f."""
    for source in (FastqSource, LinesSource, ContigsSource):
        spark.dataSource.register(source)
    return spark


def _newlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            n = 0
            with open(path, "rb") as file:
                file.seek(begin)
                while begin < end and (data := file.read(min(1 << 20, end - begin))):
                    n += data.count(b"\n")
                    begin += len(data)
            found.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["path", "begin", "end", "n"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, begin, end, number in zip(*(c.to_pylist() for c in batch.columns)):
            within = lines_within(path, begin, end, number)
            number, at = next(within)
            if at[0] < end:
                read = (data for data, _ in within)
                while number % 4 and at[0] < end:
                    next(read, None)
                    number += 1
                yield from _batches(fastq_records(path, number // 4, read, lambda at=at, end=end: at[0] >= end), FASTQ)


def fastq(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The records of one file as the source fastq gives them; a plain file of several pieces is read in as many tasks.
    There a piece ends at its first bad record, so only what stands before the first of all counts."""
    path, size = os.path.abspath(path), os.path.getsize(path)
    with open(path, "rb") as file:
        plain = not file.read(2).startswith(GZIP_MAGIC)
    if not plain or size <= piece:
        return read(spark, "fastq", path)
    cuts = [(path, at, min(at + piece, size)) for at in range(0, size, piece)]
    rows = spark.createDataFrame(cuts, "path string, begin bigint, end bigint").repartition(len(cuts))
    counts = sorted(rows.mapInArrow(_newlines, "path string, begin bigint, end bigint, n bigint").collect(), key=lambda r: r["begin"])  # one row a piece
    lines_before, total = [], 0
    for r in counts:
        lines_before.append((path, r["begin"], r["end"], total))
        total += r["n"]
    return spark.createDataFrame(lines_before, "path string, begin bigint, end bigint, line bigint").repartition(len(cuts)).mapInArrow(_pieces, FASTQ)


def read(spark: SparkSession, format_: str, *paths: str):
    return register(spark).read.format(format_).load("\x1f".join(paths))
