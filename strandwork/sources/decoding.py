"""Bytes of a file as text: gzip by content, any number of members, and what a cut-off file still gives."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

# The two bytes that open a gzip member.
GZIP_MAGIC = b"\x1f\x8b"
CHUNK = 1 << 20


class Truncated(EOFError):
    """The file ends inside a gzip member."""


def decoded(path: str) -> Iterator[bytes]:
    """The file's bytes, decompressed where they open like gzip. Raises Truncated after the last good byte of a cut-off
    member."""
    with open(path, "rb") as file:
        data = file.read(CHUNK)
        if not data.startswith(GZIP_MAGIC):
            while data:
                yield data
                data = file.read(CHUNK)
            return
        member = zlib.decompressobj(wbits=31)
        while data:
            try:
                out = member.decompress(data)
            except zlib.error as error:
                raise Truncated(str(error)) from error
            if out:
                yield out
            data = member.unused_data
            if member.eof:
                data = data or file.read(CHUNK)
                if data:
                    member = zlib.decompressobj(wbits=31)
            else:
                data = file.read(CHUNK)
        if not member.eof:
            raise Truncated("the file ends inside a gzip member")


def lines(path: str) -> Iterator[tuple[bytes, bool]]:
    """(line without its newline, whether it had one), split at newlines only. Raises Truncated after the last."""
    held = b""
    try:
        for data in decoded(path):
            *whole, held = (held + data).split(b"\n")
            for line in whole:
                yield line, True
    except Truncated:
        if held:
            yield held, False
        raise
    if held:
        yield held, False


def lines_within(path: str, begin: int, end: int, number: int) -> Iterator:
    """Of a plain file first (number of the first line that starts at begin or later, [where it starts]), then the lines
    from there on as lines() has them, with the place kept up to date. number: newlines before begin. Reading goes on
    past end as far as it is asked to."""
    with open(path, "rb") as file:
        at = [begin]
        if begin:
            file.seek(begin - 1)
            if file.read(1) != b"\n":
                skipped = file.readline()
                at[0] += len(skipped)
                number += skipped.endswith(b"\n")
        yield number, at
        for line in file:
            at[0] += len(line)
            yield line.removesuffix(b"\n"), line.endswith(b"\n")
