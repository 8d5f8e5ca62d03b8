"""One ordered file out of a frame: plain, gzip in members, or BGZF.

Each task of the sorted frame writes its lines as members of its own beside the target; a gzip file is the sequence of
its members, so the file is the parts in their order. Once all sizes are known, tasks copy the parts to their places in
the file, each by itself, so nothing but names and sizes passes through the driver. Parts carry the task's attempt in
their name, and a part always goes to the same place, so a repeated task does no harm. The folder of the target has to be
shared.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
# Most bytes that a BGZF member takes in, and the empty member that ends a BGZF file.
BGZF_BLOCK = 0xFF00
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def record_text() -> Column:
    return F.concat_ws("\n", "header", "seq", "plus", "qual")


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def bgzf_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 25
    if size > 0xFFFF:  # doesn't compress: as it is
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        size = len(body) + 25
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def compression_of(path: str, gzip: bool = False, bgzf: bool = False) -> str:
    if bgzf:
        return "bgzf"
    return "gzip" if gzip or os.path.splitext(path)[1].lower() == ".gz" else "plain"


def _members(data: Iterator[bytes], compression: str) -> Iterator[bytes]:
    step = BGZF_BLOCK if compression == "bgzf" else BLOCK
    pack = {"plain": bytes, "gzip": gzip_member, "bgzf": bgzf_member}[compression]
    held = bytearray()
    for line in data:
        held += line
        while len(held) >= step:
            yield pack(bytes(held[:step]))
            del held[:step]
    if held:
        yield pack(bytes(held))


def write(df: DataFrame, path: str, order: list[str], text: Column | None = None, gzip: bool = False, bgzf: bool = False) -> int:
    """Writes text (records by default), each with a newline, in the order of the columns `order`. Returns the rows."""
    compression = compression_of(path, gzip, bgzf)
    path = os.path.abspath(path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    lines = df.select(*order, (record_text() if text is None else text).alias("_text"))
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("_text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}"
        n = 0

        def data() -> Iterator[bytes]:
            nonlocal n
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    n += 1
                    yield (line or "").encode() + b"\n"

        with open(f"{folder}/{name}", "wb") as out:
            for member in _members(data(), compression):
                out.write(member)
            size = out.tell()
        columns = [pa.array([task.partitionId()], pa.int64()), pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "name", "n", "size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{folder}/{name}", "rb") as one, open(path + ".tmp", "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(one, out, BLOCK)
            yield batch.select([1])

    try:
        done = {r["part"]: r for r in ranged.mapInArrow(put, "part bigint, name string, n bigint, size bigint").collect()}  # one row a part
        places, size = [], 0
        for part in sorted(done):
            places.append((done[part]["name"], size))
            size += done[part]["size"]
        with open(path + ".tmp", "wb") as out:
            out.truncate(size)
            if compression == "bgzf":
                out.seek(size)
                out.write(BGZF_END)
        if places:
            spark = df.sparkSession
            spark.createDataFrame(places, "name string, at bigint").repartition(len(places)).mapInArrow(place, "at bigint").collect()
        os.replace(path + ".tmp", path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return sum(r["n"] for r in done.values())
