"""Sums over the words of documents of what is known of each distinct word.

The documents are read in blocks of a bounded number of rows and bytes. A block packs its distinct words, each with the
places of the documents that hold it and how often, in four bytes a document, and deals them out by a hash of the word.
Where a word arrives from all blocks it is looked at once, and what it gives each document of a block is added up; at
last a block's sums meet. So this is a partitioned hash join of words to the documents' word frequencies.

A word of many documents is one entry a block before anything is dealt out. Words that a caller knows at once, such as
the few that a large share of documents hold, are settled in their block and not dealt out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents and bytes of text in a block.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
#: Bytes of text whose words meet in one place, about.
DEALT_BYTES = 8 << 20
#: Distinct words that a task holds before it passes them on.
OPEN_WORDS = 400_000

_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], list]]:
    """(block number, ids, texts as bytes, third column if there is one) of bounded size, numbered apart between tasks;
    null texts are empty."""
    number = TaskContext.get().partitionId() << 31
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        more = batch.column(2).to_pylist() if batch.num_columns > 2 else [True] * len(ids)
        begin = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if i + 1 == len(texts) or i + 1 - begin == BLOCK_ROWS or size >= BLOCK_BYTES:
                yield number, ids[begin : i + 1], texts[begin : i + 1], more[begin : i + 1]
                number, begin, size = number + 1, i + 1, 0


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def word_counts(rows: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(word binary, n long) over all rows (id, text): how often each word occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        held: Counter = Counter()
        for _, _, texts, _ in blocks(batches):
            for text in texts:
                held.update(split(text))
                if len(held) > OPEN_WORDS:
                    yield _batch(schema, list(held), list(held.values()))
                    held.clear()
        yield _batch(schema, list(held), list(held.values()))

    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Numbered(dict):
    """The numbers of words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Block:
    """The texts of a block, split once."""

    texts: list[bytes]
    words: list[bytes]  # distinct
    tokens: np.ndarray  # numbers of the words of all texts, one text after the other
    lengths: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: list[bytes], split: Callable[[bytes], list[bytes]]) -> Block:
        numbers = _Numbered()
        found = [np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)) for words in map(split, texts)]
        return cls(texts, list(numbers), np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def entries(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word and each text that holds it, by both: the word's number; the text's place, whether it is counted and
        how often it holds the word, in four bytes. What two bytes can't hold is another entry."""
        keys = self.tokens.astype(np.int64) * BLOCK_ROWS + np.repeat(np.arange(len(self.texts)), self.lengths)
        keys.sort()
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.diff(begin, append=len(keys))
        keys = keys[begin]
        more = (n - 1) // 0xFFFF
        if more.any():
            rest, last = n - more * 0xFFFF, np.cumsum(more + 1) - 1
            keys = np.repeat(keys, more + 1)
            n = np.full(len(keys), 0xFFFF)
            n[last] = rest
        of, place = np.divmod(keys, BLOCK_ROWS)
        return of, (place | counted[place].astype(np.int64) << 12 | n << 16).astype("<u4")


def weigh(
    rows: DataFrame,
    width: int,
    split: Callable[[bytes], list[bytes]],
    describe: Callable[[Block], np.ndarray],
    value: Callable[[], Callable[[list[bytes], np.ndarray], np.ndarray]],
    known: Callable[[], Callable[[bytes, float], list[float] | None]],
) -> DataFrame:
    """(doc_id, own array<double>, sums array<double>) for each row (id, text[, counted boolean]) of rows.

    sums adds `width` numbers over the words of the text as often as they occur. value() is called once a task and gives
    a function of distinct words and of how often each occurs in all counted rows, which returns a row of numbers a word;
    known() one of a word and the share of the block's documents that hold it, for words that need no count, or None.
    own is describe()'s row for the text, given a block at a time. Repeated rows and null ids keep their row.
    """
    size = rows.agg(F.sum(F.octet_length(rows.columns[1]))).first()[0] or 0
    parts = max(1, -(-size // DEALT_BYTES))
    packed = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("words", "lengths", "each", "entries")), ("ids", _LONGS), ("own", _DOUBLES)])
    summed = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), ("ids", _LONGS), ("own", _DOUBLES)])
    columns = "part long, block long, words binary, lengths binary, each binary, entries binary, ids array<long>, own array<double>"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each block: its documents with what is known at once, then its words by part."""
        at_once = known()
        for number, ids, texts, counted in blocks(batches):
            block = Block.of(texts, split)
            of, entries = block.entries(np.array(counted, bool))
            each = np.bincount(of, minlength=len(block.words))
            at_once_v = [at_once(word, share) for word, share in zip(block.words, (each / len(texts)).tolist())]
            settled = np.array([v is not None for v in at_once_v], bool)
            own = np.asarray(describe(block), np.float64)
            sums = np.zeros((len(texts), width))
            if settled.any():
                v = np.array([v for v in at_once_v if v is not None], np.float64)[(np.cumsum(settled) - 1)[of[settled[of]]]]
                place, n = entries[settled[of]] & 0xFFF, entries[settled[of]] >> 16
                sums = np.stack([np.bincount(place, n * v[:, k], len(texts)) for k in range(width)], axis=1)
            own = np.concatenate([own, sums], axis=1)
            yield _batch(packed, [number % parts], [number], [None], [None], [None], [None], [ids], [own.reshape(-1)])
            dealt = np.flatnonzero(~settled)
            part = np.fromiter((zlib.crc32(block.words[w]) for w in dealt.tolist()), np.int64, len(dealt)) % parts
            order = np.argsort(part, kind="stable")
            dealt, part = dealt[order], part[order]
            words = [block.words[w] for w in dealt.tolist()]
            lengths, many = np.fromiter(map(len, words), "<u4", len(words)), each[dealt]
            ends = np.concatenate([[0], np.cumsum(many)])
            flat = entries[np.repeat((np.cumsum(each) - each)[dealt] - ends[:-1], many) + np.arange(ends[-1])]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts)).tolist()
            out = []
            for x, y in pairwise(cuts):
                out.append((int(part[x]), number, b"".join(words[x:y]), lengths[x:y].tobytes(), many[x:y].astype("<u4").tobytes(), flat[ends[x] : ends[y]].tobytes(), None, None))
                if len(out) == 500:
                    yield _batch(packed, *zip(*out))
                    out = []
            if out:
                yield _batch(packed, *zip(*out))

    def settle(key: tuple, part: pa.Table) -> pa.Table:
        """What the words of a part give the documents of each block; the blocks' documents pass."""
        index: dict[bytes, int] = {}
        found, heads = [], part.filter(pc.is_valid(part["ids"]))
        for row in part.filter(pc.is_null(part["ids"])).select(["block", "words", "lengths", "each", "entries"]).to_pylist():
            ends = np.cumsum(np.frombuffer(row["lengths"], "<u4")).tolist()
            text, begin, at = row["words"], 0, []
            for end in ends:
                at.append(index.setdefault(text[begin:end], len(index)))
                begin = end
            found.append((row["block"], np.repeat(at, np.frombuffer(row["each"], "<u4")), np.frombuffer(row["entries"], "<u4")))
        total = np.zeros(len(index))
        for _, at, entries in found:
            total += np.bincount(at, (entries >> 16) * (entries >> 12 & 1).astype(np.float64), len(index))
        v = np.asarray(value()(list(index), total), np.float64).reshape(-1, width)
        rows = [(r["block"], None, None, r["ids"], r["own"]) for r in heads.select(["block", "ids", "own"]).to_pylist()]
        for block, at, entries in found:
            n, place = (entries >> 16).astype(np.float64), entries & 0xFFF
            sums = np.stack([np.bincount(place, n * v[at, k], BLOCK_ROWS) for k in range(width)], axis=1)
            there = np.unique(place)
            rows.append((block, there.astype("<u2").tobytes(), sums[there].tobytes(), None, None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), summed)], schema=summed)

    def assemble(key: tuple, part: pa.Table) -> pa.Table:
        ids = own = None
        total = np.zeros((BLOCK_ROWS, width))
        for row in part.to_pylist():
            if row["ids"] is not None:
                ids, own = row["ids"], row["own"]
            else:
                total[np.frombuffer(row["places"], "<u2")] += np.frombuffer(row["sums"], np.float64).reshape(-1, width)
        own = np.array(own).reshape(len(ids), -1)
        total = total[: len(ids)] + own[:, -width:]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "own": pa.array(list(own[:, :-width]), _DOUBLES), "sums": pa.array(list(total), _DOUBLES)})

    settled = rows.mapInArrow(frequencies, columns).groupBy("part").applyInArrow(settle, "block long, places binary, sums binary, ids array<long>, own array<double>")
    return settled.groupBy("block").applyInArrow(assemble, "doc_id long, own array<double>, sums array<double>")
