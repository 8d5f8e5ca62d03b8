"""Contig dictionaries out of the headers of genomics files, read as far as the header goes."""

from __future__ import annotations

import gzip
import os
import re
import struct
from collections.abc import Iterator

from strandwork.sources.decoding import decoded, lines

# Name endings of each kind of file.
KINDS = {
    "sizes": (".fai", ".sizes", ".genome"),
    "FASTA": (".fa", ".fasta", ".fna", ".fas"),
    "VCF": (".vcf",),
    "BCF": (".bcf",),
    "SAM": (".sam",),
    "BAM": (".bam",),
    "CRAM": (".cram",),
    "GFF": (".gff", ".gff3", ".gtf"),
    "BED": (".bed",),
}

Contigs = list[tuple[str, int | None]]


def kind_of(path: str) -> str:
    name = os.path.basename(path).lower().removesuffix(".gz").removesuffix(".bgz")
    for kind, ends in KINDS.items():
        if name.endswith(ends):
            return kind
    known = ", ".join(e for ends in KINDS.values() for e in ends)
    raise ValueError(f"cannot tell what kind of file {path} is from its name. Recognised: {known}")


def read_contigs(path: str) -> tuple[str, Contigs]:
    kind = kind_of(path)
    return kind, list(_READERS[kind](path))


def _text(path: str) -> Iterator[str]:
    for line, _ in lines(path):
        yield line.decode("utf-8").strip()


def _number(text: str) -> int | None:
    """A whole number of 64 bits without a sign; the schema holds it as decimal(20, 0)."""
    return int(text) if re.fullmatch(r"\+?[0-9]+", text, re.ASCII) and int(text) < 1 << 64 else None


def sizes(path: str) -> Iterator[tuple[str, int | None]]:
    for line in _text(path):
        if line and not line.startswith("#"):
            name, *rest = line.split()
            yield name, _number(rest[0]) if rest else None


def fasta(path: str) -> Iterator[tuple[str, int | None]]:
    """An index beside the file is read in its place."""
    if os.path.exists(path + ".fai"):
        yield from sizes(path + ".fai")
        return
    name, length = None, 0
    for line in _text(path):
        if line.startswith(">"):
            if name is not None:
                yield name, length
            name, length = (line[1:].split() or [""])[0], 0
        elif name is not None:
            length += len(line.encode())
    if name is not None:
        yield name, length


def _vcf_header(header: Iterator[str]) -> Iterator[tuple[str, int | None]]:
    for line in header:
        if not line.startswith("##"):
            return
        if found := re.match(r"##contig=<(.*)>", line):
            fields = dict(re.findall(r"(?:^|,)([^=,]+)=(\"[^\"]*\"|[^,]*)", found[1]))
            if "ID" in fields:
                yield fields["ID"], _number(fields.get("length", ""))


def vcf(path: str) -> Iterator[tuple[str, int | None]]:
    return _vcf_header(_text(path))


def _sam_header(header: Iterator[str]) -> Iterator[tuple[str, int | None]]:
    for line in header:
        if not line.startswith("@"):
            return
        if line.startswith("@SQ"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
            if "SN" in fields:
                yield fields["SN"], _number(fields.get("LN", ""))


def sam(path: str) -> Iterator[tuple[str, int | None]]:
    return _sam_header(_text(path))


def _binary(path: str, n: int) -> Iterator[bytes]:
    """send() how many bytes are wanted next."""
    held, source = b"", decoded(path)
    while True:
        while len(held) < n:
            data = next(source, b"")
            if not data:
                raise ValueError(f"{path} ends inside its header")
            held += data
        out, held = held[:n], held[n:]
        n = yield out


def bcf(path: str) -> Iterator[tuple[str, int | None]]:
    read = _binary(path, 9)
    start = next(read)
    if not start.startswith(b"BCF\x02"):
        raise ValueError(f"{path} is no BCF file")
    text = read.send(struct.unpack("<I", start[5:9])[0])
    return _vcf_header(iter(text.rstrip(b"\0").decode().splitlines()))


def bam(path: str) -> Iterator[tuple[str, int | None]]:
    read = _binary(path, 8)
    start = next(read)
    if not start.startswith(b"BAM\x01"):
        raise ValueError(f"{path} is no BAM file")
    read.send(struct.unpack("<i", start[4:])[0])
    for _ in range(struct.unpack("<i", read.send(4))[0]):
        name = read.send(struct.unpack("<i", read.send(4))[0]).rstrip(b"\0").decode()
        yield name, struct.unpack("<i", read.send(4))[0]


def _itf8(data: bytes, at: int) -> tuple[int, int]:
    """A CRAM integer: as many leading ones in the first byte as bytes follow; the fifth byte gives four bits."""
    first = data[at]
    more = next((k for k in range(4) if not first >> (7 - k) & 1), 4)
    if more == 4:
        value = (first & 15) << 28 | data[at + 1] << 20 | data[at + 2] << 12 | data[at + 3] << 4 | data[at + 4] & 15
    else:
        value = int.from_bytes(bytes([first & (0xFF >> (more + 1))]) + data[at + 1 : at + 1 + more], "big")
    return value, at + 1 + more


def cram(path: str) -> Iterator[tuple[str, int | None]]:
    with open(path, "rb") as file:
        start = file.read(26)
        if not start.startswith(b"CRAM"):
            raise ValueError(f"{path} is no CRAM file")
        major = start[4]
        size = struct.unpack("<i", file.read(4))[0]
        head = file.read(size + 256)
    at = 0
    for _ in range(4):  # reference, start, span, records
        _, at = _itf8(head, at)
    for _ in range(2):  # record counter and bases: as long numbers
        first = head[at]
        at += 1 + next((k for k in range(8) if not first >> (7 - k) & 1), 8)
    _, at = _itf8(head, at)  # blocks
    n, at = _itf8(head, at)
    for _ in range(n):
        _, at = _itf8(head, at)
    at += 4 if major >= 3 else 0
    method, at = head[at], at + 2  # and the content type
    _, at = _itf8(head, at)
    packed, at = _itf8(head, at)
    _, at = _itf8(head, at)
    block = head[at : at + packed]
    if method == 1:
        block = gzip.decompress(block)
    elif method != 0:
        raise ValueError(f"{path}: header block by compression method {method} is not supported")
    n = struct.unpack("<i", block[:4])[0]
    return _sam_header(iter(block[4 : 4 + n].decode().splitlines()))


def gff(path: str) -> Iterator[tuple[str, int | None]]:
    """The ##sequence-region pragmas; only without any, the first column."""
    regions: Contigs = []
    names: dict[str, None] = {}
    for line in _text(path):
        if line.startswith("##sequence-region"):
            fields = line.split()
            if len(fields) >= 2:
                start, end = (_number(x) if x else None for x in (fields[2:4] + ["", ""])[:2])
                regions.append((fields[1], end - start + 1 if start is not None and end is not None and end >= start else None))
        elif not regions and line and not line.startswith("#"):
            names.setdefault(line.split("\t", 1)[0])
    yield from regions or ((n, None) for n in names)


def bed(path: str) -> Iterator[tuple[str, int | None]]:
    names: dict[str, None] = {}
    for line in _text(path):
        if line and not line.startswith(("#", "track", "browser")):
            names.setdefault(line.split("\t", 1)[0])
    yield from ((n, None) for n in names)


_READERS = {"sizes": sizes, "FASTA": fasta, "VCF": vcf, "BCF": bcf, "SAM": sam, "BAM": bam, "CRAM": cram, "GFF": gff, "BED": bed}
