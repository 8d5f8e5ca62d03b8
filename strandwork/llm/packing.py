"""Packing documents into training sequences of equal attention cost.

Each task packs its own rows in windows, so nothing is shuffled and a lost task repeats only itself. A document is its
token ids and an end. What fills whole sequences is cut off first; the tails of a window are then dealt out, longest
first, to the cheapest sequence that still has room, where a piece of n tokens costs LINEAR * n + QUADRATIC * n * n: the
dense layers cost the same for every token, attention inside a piece costs its square. A window opens just as many
sequences as its tokens fill; the last tokens that fill none are kept in sequences of a power of two, which need no
padding.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.workers import lean

#: Cost of a token, and of a pair of tokens in one piece, in units of a token's dense layers.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Documents, and bytes of their ids, in a window.
WINDOW_ROWS, WINDOW_BYTES = 4096, 64 << 20
#: Distinct words whose ids a task remembers.
MEMO = 800_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_of() -> dict[str, int]:
    """The character that a byte-level vocabulary writes each byte as: itself where it prints, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Ids(dict):
    """The bytes of a chunk's ids, little-endian 32 bit, by chunk: what stands between two spaces, with the first.

    The file's own library gives the ids. Where its merges are in the order of its ids, a quicker encoder of the same
    vocabulary takes the chunks of Latin letters without special strings.
    """

    #: Up to here all libraries agree on what is a letter.
    LATIN = "\u024f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._quick(json.loads(self.tokenizer.to_str()))
        self.odd = False

    @staticmethod
    def _quick(file: dict):
        import tiktoken

        model, step = file["model"], file["pre_tokenizer"] or {}
        known = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not file["normalizer"]
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        if not known or model["type"] != "BPE" or merged != sorted(merged):
            return None
        added = {t["content"] for t in file["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes([byte[c] for c in token]): i for token, i in vocabulary.items() if token not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.quick and max(text, default="") <= self.LATIN and not any(s in text for s in self.special):
            ids = self.quick(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():  # white space beside the space
            self.odd = True
            return b""
        packed = self.encode(" " + chunk)
        if len(self) < MEMO and len(chunk) <= 64:
            self[chunk] = packed
        return packed

    def of(self, text: str) -> bytes:
        """A byte-level tokenizer takes at most one space with a word, so a text can be cut before each single space
        that stands between two characters that aren't white space."""
        first, *chunks = text.split(" ")
        self.odd = not first or first[-1].isspace()
        packed = b"".join(map(self.__getitem__, chunks))
        if not self.odd:
            return self.encode(first) + packed
        merged = [first]
        for chunk in chunks:
            if not chunk or chunk[0].isspace() or not merged[-1] or merged[-1][-1].isspace():
                merged[-1] += " " + chunk
            else:
                merged.append(chunk)
        return self.encode(merged[0]) + b"".join([self.encode(" " + c) if c[-1].isspace() else self[c] for c in merged[1:]])


class Open:
    """Sequences with room, by what room they have: entries (cost for its size, -room, sequence). A tree over the rooms
    holds the least entry of each range, so the cheapest with a given room at least is found among all."""

    NONE = (math.inf, 0, -1)

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(self.leaves)]
        self.least = [self.NONE] * (2 * self.leaves)

    def _renew(self, room: int) -> None:
        at, least = self.leaves + room, self.least
        now = self.heaps[room][0] if self.heaps[room] else self.NONE
        while at and least[at] != now:
            least[at] = now
            at >>= 1
            if at:
                now = min(least[2 * at], least[2 * at + 1])

    def add(self, entry: tuple[float, int, int]) -> None:
        heapq.heappush(self.heaps[-entry[1]], entry)
        self._renew(-entry[1])

    def take(self, room: int) -> tuple[float, int, int]:
        """The cheapest with that room, or else of all."""
        at, least = self.leaves + room, self.least
        found = least[at]
        while at > 1:
            if not at & 1 and least[at + 1] < found:
                found = least[at + 1]
            at >>= 1
        if found is self.NONE:
            found = least[1]
        heapq.heappop(self.heaps[-found[1]])
        self._renew(-found[1])
        return found


def assign(tails: list[int], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """For each tail its pieces (start in the tail, length, sequence, offset there). All sequences end up full. A tail is
    cut only where no sequence has room for what is left of it."""
    total = sum(tails)
    rooms = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length()) if total % capacity >> k & 1]
    used, cost = [0] * len(rooms), [0.0] * len(rooms)
    open_ = Open(capacity)
    for s, room in enumerate(rooms):
        open_.add((0.0, -room, s))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in tails]

    def put(i: int, start: int, n: int, s: int) -> None:
        out[i].append((start, n, s, used[s]))
        used[s] += n
        cost[s] += LINEAR * n + QUADRATIC * n * n
        if used[s] < rooms[s]:
            open_.add((cost[s] / rooms[s], used[s] - rooms[s], s))

    for i in sorted(range(len(tails)), key=lambda i: -tails[i]):
        start, left = 0, tails[i]
        while left:
            _, room, s = open_.take(left)
            n = min(left, -room)
            put(i, start, n, s)
            start, left = start + n, left - n
    return out


def _packer(path: str, capacity: int, end: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
    closing = end.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(path)
        sequence = TaskContext.get().partitionId() << 33
        docs: list[tuple[int | None, bytes]] = []
        held = 0

        def window() -> pa.RecordBatch:
            nonlocal sequence, docs, held
            rows = []
            tails = []
            for doc_id, ids in docs:
                n = len(ids) >> 2
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(ids[start * 4 : (start + capacity) * 4]), n, sequence, 0))
                    sequence += 1
                tails.append(n - whole)
            highest = -1
            for (doc_id, ids), tail, pieces in zip(docs, tails, assign(tails, capacity)):
                n = len(ids) >> 2
                for at, length, s, offset in pieces:
                    start = n - tail + at
                    rows.append((doc_id, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), n, sequence + s, offset))
                    highest = max(highest, s)
            sequence += highest + 1
            docs, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 7, schema=schema)

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                docs.append((doc_id, ids_of.of(texts[i].as_py() or "") + closing))
                held += len(docs[-1][1])
                if len(docs) >= WINDOW_ROWS or held >= WINDOW_BYTES:
                    yield window()
        if docs:
            yield window()

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as unsigned
    little-endian 32 bit), doc_tokens, sequence_id and offset there.

    tokenizer: path of a byte-level tokenizers file; its ids, without added ones, and one `end` are a document. Each id
    lies in exactly one piece. capacity is a power of two. Null texts are empty, so they are their end alone; a null id
    stays null; repeated rows are packed each; an empty table has no sequences; other columns don't matter.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(lean(_packer(tokenizer, capacity, end)), PIECES)
