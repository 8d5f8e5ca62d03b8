"""What a Python worker holds between tasks.

A worker lives on from task to task and stage to stage. Arrow's pool and the C library keep the pages of what is freed, so
each worker would stay as large as its largest task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None

#: What the tasks of one owner keep for those to come, by owner; only the last owner's is kept.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The owner's table, empty at first. Tables of other owners go."""
    if owner not in _kept:
        _kept.clear()
    return _kept.setdefault(owner, {})


def release() -> None:
    """Gives back to the system what is free."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def begin(owner: str | None) -> None:
    """A task of that owner begins: what others keep goes."""
    if owner not in _kept:
        _kept.clear()
    release()


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None):
    """work, for mapInArrow, giving back what is free before it, after each batch that it has read and at its end. The
    tables that owners other than its own keep go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        begin(owner)
        try:
            yield from work(read())
        finally:
            release()

    return run


def lean_groups(work: Callable[[tuple, pa.Table], pa.Table]):
    """work, for applyInArrow on few but large groups, giving back what is free after each."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        begin(None)
        try:
            return work(key, part)
        finally:
            release()

    return run
