"""Exact Jaccard self-join of documents on word shingles, with adaptive multi-match prefixes.

A document's shingles stand in one order for all documents: rarest first. Of two sets that are similar enough, those
with prefixes of n - ceil(t * n) + m shingles share at least m of them there. Each document gets its own m: a longer
prefix meets more documents, but asks for more matches before a pair is verified, and the estimate of both costs decides.

How it is spread:

1. Each document's set becomes a sorted array of 64-bit hashes, and the array a 64-bit name. Equal sets have one name and
   are one node from there on. Shingles in a fixed share of the documents are found (a bounded table, whatever the
   corpus); they come last in the order and are never dealt out by their hash.
2. All other shingles are dealt out by ranges of their hash, packed per block of documents. A range finds those that
   occur more than once, with their frequency; only these go back to their block. A shingle that occurs once can match
   nothing, and two sets share nothing but what goes back, so this is also all that verification needs: a document
   whose prefix is full of unique shingles is out before any pair is thought of.
3. Rounds of links through one representative per prefix shingle tie families of near copies together: one verified
   pair a document and round, never a family's square.
4. What is left are shingles in the prefixes of documents that are not tied together yet. Where few documents hold such a
   shingle, its pairs are counted against the smaller m of the two and verified. Documents that hold a shingle of many are
   put into tiles of like documents, and the same prefixes, matches and sizes decide which tiles meet. Two that do are
   compared by matrix products, and only what ties their documents together is reported: many documents that are nearly
   similar enough never become rows of pairs. So no link between two components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import apart, components, drop, written
from strandwork.llm.weighing import blocks
from strandwork.llm.workers import lean, lean_groups

#: A shingle in one of so many documents, and in so many at least, counts as common.
COMMON_SHARE, COMMON_LEAST = 256, 64
#: Shingles in a range of hashes, about.
RANGE = 1_500_000
#: Matches that a prefix may ask for at most; cost of verifying a pair, in looked-up postings per shingle of the document.
MOST_MATCHES, VERIFY = 6, 0.05
#: Rounds of links through representatives.
ROUNDS = 2
#: A shingle that more open documents hold has them compared in tiles; documents in a tile, and shingles, about; tiles that a
#: shingle has in a split.
DENSE, TILE, TILE_SHINGLES, SPLIT = 24, 512, 1_000_000, 256
MEMO = 500_000

_U8 = np.dtype("<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Shingles(dict):
    """Sets of hashed shingles of `size` words; with fewer words the whole sequence is one. The hashes of words are kept."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        h = np.fromiter(map(self.__getitem__, words), _U8, len(words))
        k = min(self.size, len(h))
        if k == 0:
            return h
        g = np.full(len(h) - k + 1, k, _U8)
        for i in range(k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(g))


def name_of(hashes: np.ndarray) -> int:
    """A set's name: the same for the same set."""
    return int(_mix(_mix(hashes).sum(dtype=_U8, keepdims=True) + np.uint64(len(hashes))).astype(np.int64)[0])


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as steps of six bytes where they stand close enough, else as they are."""
    steps = np.diff(hashes, prepend=np.zeros(1, _U8))
    if len(steps) > 1 and not (steps[1:] >> np.uint64(48)).any():
        return hashes[:1].tobytes() + np.ascontiguousarray(steps[1:]).view("<u2").reshape(-1, 4)[:, :3].tobytes()
    return hashes.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 * n:
        return np.frombuffer(data, _U8)
    steps = np.zeros((n, 4), "<u2")
    steps[0] = np.frombuffer(data[:8], "<u2")
    steps[1:, :3] = np.frombuffer(data[8:], "<u2").reshape(-1, 3)
    return np.cumsum(steps.reshape(-1).view(_U8), dtype=_U8)


def _first_pass(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("common", pa.binary()), ("common_n", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for _, ids, texts, text_hashes in blocks(batches):
            sets = [shingles.of(t) for t in texts]
            names = [name_of(s) if len(s) else None for s in sets]
            least = max(2, len(texts) * 2 // COMMON_SHARE // 2)
            distinct = {n: s for n, s in zip(names, sets) if n is not None}  # copies in a block count once
            found, n = np.unique(np.concatenate([*distinct.values(), np.zeros(0, _U8)]), return_counts=True)
            found, n = found[n >= least], n[n >= least]
            nothing = [None] * len(ids)
            columns = [[*ids, None], [*text_hashes, None], [*map(len, sets), None], [*names, None], [*nothing, found.tobytes()], [*nothing, n.astype("<u4").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return read


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(n, "<u4").astype(np.int64))], names=["shingle", "n"])


def _dealt(size: int, ranges: int, common: np.ndarray):
    """Blocks' rows: their sets, with names, under some range, then the shingles that aren't common by range of hashes."""
    schema = pa.schema([(c, pa.int64() if c in ("range", "block") else pa.binary()) for c in ("range", "block", "names", "sizes", "places", "hashes")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        width = (1 << 64) // ranges + 1
        for number, _, texts, _ in blocks(batches):
            own = {name_of(s): s for s in (shingles.of(t) for t in texts) if len(s)}
            names, sizes = np.array(list(own), np.int64), np.array([len(s) for s in own.values()], "<u4")
            hashes = np.concatenate([*own.values(), np.zeros(0, _U8)])
            places = np.repeat(np.arange(len(own), dtype="<u2"), sizes)
            del own
            at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
            there = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
            rows = [(number % ranges, number, names.tobytes(), sizes.tobytes(), places[there].tobytes(), at[there].astype("<u4").tobytes())]
            hashes, places = hashes[~there], places[~there]
            order = np.argsort(hashes)
            hashes, places = hashes[order], places[order]
            ends = np.searchsorted(hashes, np.array([min(width * (r + 1), (1 << 64) - 1) for r in range(ranges)], _U8), side="left")
            ends[-1] = len(hashes)
            begin = 0
            for r, end in enumerate(ends.tolist()):
                if end > begin:
                    rows.append((r, number, None, None, places[begin:end].tobytes(), _packed(hashes[begin:end])))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return deal


def _repeated(key: tuple, part: pa.Table) -> pa.Table:
    """The shingles of a range that occur more than once, by block, with their frequency; blocks' sets pass."""
    names = ["block", "places", "hashes", "often", "names", "sizes"]
    heads = part.filter(pa.compute.is_valid(part["names"]))
    heads = [(*own, None, *more) for *own, more in zip(*(heads[c].to_pylist() for c in names[:3]), zip(heads["names"].to_pylist(), heads["sizes"].to_pylist()))]
    part = part.filter(pa.compute.is_null(part["names"]))
    packed, at = part["hashes"].to_pylist(), part["places"].to_pylist()
    each = np.array([len(p) >> 1 for p in at], np.int64)
    hashes = np.concatenate([*(_unpacked(p, n) for p, n in zip(packed, each.tolist())), np.zeros(0, _U8)])
    places = np.frombuffer(b"".join(at), "<u2")
    block = np.repeat(np.arange(len(packed)), each)
    order = np.argsort(hashes)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), hashes[order][1:] != hashes[order][:-1]]))
    n = np.diff(np.append(first, len(hashes)))
    often = np.repeat(n, n)
    keep = order[often > 1]
    often = often[often > 1]
    by_block = np.argsort(block[keep], kind="stable")
    keep, often = keep[by_block], often[by_block]
    cut = np.searchsorted(block[keep], np.arange(len(packed) + 1))
    rows = heads + [
        (number, places[keep[a:b]].tobytes(), hashes[keep[a:b]].tobytes(), often[a:b].astype("<u4").tobytes(), None, None)
        for number, a, b in zip(part["block"].to_pylist(), cut[:-1], cut[1:])
        if b > a
    ]
    columns = list(zip(*rows)) or [[]] * 6
    return pa.table([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(columns)], names=names)


def prefix(n: int, unique: int, often: np.ndarray, least: int) -> tuple[int, int]:
    """(m, entries of `often`, sorted, in the prefix) of a set of n shingles, `unique` of which stand before those.

    least: shingles that a similar set must share at least. The cost of m is that of looking up the postings of the
    prefix, and of verifying the pairs, at most one for each m postings.
    """
    best = None
    running = np.concatenate([[0], np.cumsum(often)])
    for m in range(1, min(MOST_MATCHES, least) + 1):
        k = min(max(n - least + m - unique, 0), len(often))
        cost = running[k] * (1 + VERIFY * n / m)
        if best is None or cost < best[0]:
            best = cost, m, k
        if k < m:  # fewer entries than matches: nothing can pass
            return m, 0
    return best[1], best[2]


def _sets(percent: int, common: np.ndarray, common_n: np.ndarray):
    schema = pa.schema([("name", pa.int64()), ("n", pa.int64()), ("matches", pa.int32()), ("entries", pa.list_(pa.int64())), ("shared", pa.binary())])

    def assemble(key: tuple, part: pa.Table) -> pa.Table:
        head = next(r for r in part.to_pylist() if r["names"] is not None)
        rest = part.filter(pa.compute.is_null(part["names"]))
        names, sizes = np.frombuffer(head["names"], np.int64), np.frombuffer(head["sizes"], "<u4")
        at = np.frombuffer(head["hashes"], "<u4")
        joined = lambda c, dtype: np.frombuffer(b"".join(rest[c].to_pylist()), dtype)
        places = np.concatenate([joined("places", "<u2"), np.frombuffer(head["places"], "<u2")])
        hashes = np.concatenate([joined("hashes", _U8), common[at]])
        often = np.concatenate([joined("often", "<u4").astype(np.int64), common_n[at] + (1 << 40)])  # the common ones last
        order = np.lexsort((hashes, often, places))
        places, hashes, often = places[order], hashes[order], often[order]
        ends = np.searchsorted(places, np.arange(len(names) + 1))
        rows = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            n = int(sizes[i])
            least = -(-percent * n // 100)
            if b - a < least:  # shares too little with all others together
                continue
            m, k = prefix(n, n - int(b - a), np.minimum(often[a:b], 1 << 40), least)
            if k:
                rows.append((names[i], n, m, hashes[a : a + k].view(np.int64), np.sort(hashes[a:b]).tobytes()))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return assemble


def _tiles(open_: DataFrame, percent: int) -> DataFrame:
    """(name, tile, n, matches, tie) for the documents of open_ that hold a shingle of many.

    Documents of a tile are of like size, and what they are put together by is the shingle that most documents hold: a
    tile's worth of documents with the same one is cut into tiles, and those with rarer ones share tiles by its hash. A
    tile has about TILE documents and TILE_SHINGLES shingles at most.
    """
    band = F.col("n") if percent >= 100 else F.floor(F.log("n") / math.log(100 / percent))
    often = open_.where(F.col("holders") > DENSE).withColumn("band", band.cast("long"))
    docs = often.groupBy("name", "band", "n", "matches", "tie").agg(F.max(F.struct("holders", "shingle")).alias("most"))
    docs = docs.select("name", "band", "n", "matches", "tie", F.col("most.shingle").alias("anchor"))
    full = F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)
    anchors = docs.groupBy("band", "anchor").agg(full.alias("full"))
    rest = anchors.where("full < 1").groupBy("band").agg(F.ceil(F.sum("full")).cast("long").alias("rest"))
    anchors = anchors.join(rest, "band", "left")
    together = F.when(F.col("full") < 1, F.pmod(F.xxhash64("anchor"), "rest")).otherwise(F.col("anchor"))
    piece = F.when(F.col("full") < 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("name"), F.ceil("full")))
    tile = F.xxhash64("band", F.col("full") < 1, together, piece)
    return docs.join(anchors, ["band", "anchor"]).select("name", tile.alias("tile"), "n", "matches", "tie")


def _meeting(open_: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(i, j) with i <= j for the pairs of tiles that may hold a similar pair of documents tied to different things.

    What holds for two documents holds for their tiles: they share a shingle of many and at least as many shingles of
    prefixes as the least matches ask for, and neither is too large for the other. Tiles that share nothing never meet,
    however many others lie between them. A shingle of many tiles is split by SPLIT of them.
    """
    rows = open_.select("name", "shingle", "holders").join(placed.select("name", "tile"), "name")
    held = rows.groupBy("tile", "shingle").agg(F.max("holders").alias("holders"))
    facts = placed.groupBy("tile").agg(*[f(c).alias(f"{k}_{c}") for k, f, c in (("least", F.min, "n"), ("most", F.max, "n"), ("least", F.min, "matches"), ("least", F.min, "tie"), ("most", F.max, "tie"))])
    shares = held.groupBy("shingle").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("splits"))
    held = held.join(shares, "shingle")
    left = held.select("shingle", "holders", F.col("tile").alias("i"), F.pmod(F.xxhash64("tile"), "splits").cast("int").alias("split"))
    right = held.select("shingle", F.col("tile").alias("j"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    pairs = left.join(right, ["shingle", "split"]).where("i <= j").groupBy("i", "j").agg(F.count("*").alias("met"), F.max("holders").alias("most"))
    pairs = pairs.where(F.col("most") > DENSE)
    for side in ("i", "j"):
        pairs = pairs.join(facts.select(F.col("tile").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in facts.columns if c != "tile"]), side)
    untied = F.least("i_least_tie", "j_least_tie") < F.greatest("i_most_tie", "j_most_tie")
    sized = (100 * F.col("i_most_n") >= percent * F.col("j_least_n")) & (100 * F.col("j_most_n") >= percent * F.col("i_least_n"))
    return pairs.where(untied & sized & (F.col("met") >= F.least("i_least_matches", "j_least_matches"))).select("i", "j")


def _tied_in_tiles(percent: int):
    """Compares the documents of two tiles and reports links that tie together all that links between them tie."""

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        names, ties, n, side = (part[c].to_numpy() for c in ("name", "tie", "n", "tile"))
        packed = part["shared"].to_pylist()
        each = np.array([len(p) >> 3 for p in packed])
        _, column = np.unique(np.frombuffer(b"".join(packed), _U8), return_inverse=True)
        row = np.repeat(np.arange(len(packed)), each)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        place = np.zeros(len(packed), np.int64)
        both = np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, int(column.max(initial=-1)) + 1, 4096):
            here = (column >= begin) & (column < begin + 4096)
            sides = []
            for own in (left, right):
                place[:] = -1
                place[own] = np.arange(len(own))
                mine = here & (place[row] >= 0)
                x = np.zeros((len(own), 4096), np.float32)
                x[place[row[mine]], column[mine] - begin] = 1
                sides.append(x)
            both += sides[0] @ sides[1].T
        p, q = np.nonzero(100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
        p, q = left[p], right[q]
        root = {t: t for t in ties.tolist()}

        def find(t: int) -> int:
            while root[t] != t:
                root[t] = t = root[root[t]]
            return t

        rows = []
        for x, y in zip(p[ties[p] != ties[q]].tolist(), q[ties[p] != ties[q]].tolist()):
            u, v = find(int(ties[x])), find(int(ties[y]))
            if u != v:
                root[u] = v
                rows.append((int(names[x]), int(names[y])))
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return compare


def _similar(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                both = len(np.intersect1d(np.frombuffer(x, _U8), np.frombuffer(y, _U8), assume_unique=True))
                keep.append(100 * both >= percent * (n_a + n_b - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def link(names: DataFrame, rows: DataFrame, size: int, percent: int, common: np.ndarray, common_n: np.ndarray, ranges: int) -> tuple[DataFrame | None, list[str]]:
    """Links (a, b) between the names of different sets that tie together whatever similar pairs tie, and scratch paths."""
    dealt = rows.mapInArrow(lean(_dealt(size, ranges, common)), "range long, block long, names binary, sizes binary, places binary, hashes binary")
    dealt = dealt.withColumn("range", F.col("range").cast("int")).repartitionById(ranges, "range")  # one a task
    together = dealt.groupBy("range").applyInArrow(lean_groups(_repeated), "block long, places binary, hashes binary, often binary, names binary, sizes binary")
    sets = together.repartition(ranges, "block").groupBy("block").applyInArrow(lean_groups(_sets(percent, common, common_n)), "name long, n long, matches int, entries array<long>, shared binary")
    sets, sets_path = written(sets)
    # A set that blocks share is there for each of them. Its entries may differ by what a block knows, so they are united.
    one = sets.groupBy("name").agg(F.first("n").alias("n"), F.min("matches").alias("matches"), F.array_distinct(F.flatten(F.collect_list("entries"))).alias("entries"), F.first("shared").alias("shared"))
    sets, one_path = written(one)
    drop(rows.sparkSession, sets_path)
    postings = sets.select("name", "n", "matches", F.explode("entries").alias("shingle"))
    sized = (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))

    def verified(pairs: DataFrame) -> tuple[DataFrame, str]:
        left = sets.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x"))
        right = sets.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y"))
        full = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")
        return written(full.mapInArrow(lean(_similar(percent)), "a long, b long"))

    links, paths = None, [one_path]
    tied = postings.withColumn("tie", F.col("name"))
    for k in range(ROUNDS + 1):
        if links is not None:
            ties, ties_path = written(components(links))
            paths.append(ties_path)
            tied = postings.join(ties.withColumnRenamed("node", "name"), "name", "left").select("name", "n", "matches", "shingle", F.coalesce("component", "name").alias("tie"))
        chosen = F.min(F.struct(F.xxhash64("name", F.lit(k)).alias("draw"), "name", "tie", "n"))
        mixed = tied.groupBy("shingle").agg(chosen.alias("r"), F.min("tie").alias("low"), F.max("tie").alias("high"), F.count("*").alias("holders")).where("low <> high")
        if k < ROUNDS:
            mixed = mixed.select("shingle", F.col("r.name").alias("b"), F.col("r.tie").alias("tie_b"), F.col("r.n").alias("n_b"))
            pairs = tied.join(mixed, "shingle").where((F.col("tie") != F.col("tie_b")) & sized)
            pairs = pairs.groupBy(F.col("name").alias("a"), "b").agg(F.count("*").alias("met"))
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("met", "b")).alias("b"))
        else:
            open_ = tied.join(mixed.select("shingle", "holders"), "shingle")
            open_, open_path = written(open_)
            paths.append(open_path)
            few = open_.where(F.col("holders") <= DENSE)
            other = few.select("shingle", F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("matches").alias("m_b"), F.col("tie").alias("tie_b"))
            pairs = few.join(other, "shingle").where((F.col("name") < F.col("b")) & (F.col("tie") != F.col("tie_b")) & sized)
            pairs = pairs.groupBy(F.col("name").alias("a"), "b").agg(F.count("*").alias("met"), F.first(F.least("matches", "m_b")).alias("needed"))
            pairs = pairs.where("met >= needed").select("a", "b")
            placed, placed_path = written(_tiles(open_, percent))
            paths.append(placed_path)
            meet = _meeting(open_, placed, percent)
            sides = meet.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
            dense = sides.join(placed.select("tile", "name", "tie", "n"), "tile").join(sets.select("name", "shared"), "name")
            dense = dense.groupBy("i", "j").applyInArrow(_tied_in_tiles(percent), "a long, b long")
            dense, dense_path = written(dense)
            paths.append(dense_path)
            links = links.union(dense)
        more, more_path = verified(pairs)
        paths.append(more_path)
        links = more if links is None else links.union(more)
    return links, paths


def _tied(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, hash of the text, n, tie) for each row of docs, tie being the same for linked sets and null without
    words; and the paths of scratch tables that this reads."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    read, read_path = written(rows.withColumn("_hash", F.xxhash64("_text")).mapInArrow(lean(_first_pass(size)), "doc_id long, hash long, n long, name long, common binary, common_n binary"))
    names = read.where("n is not null").select("doc_id", "hash", "n", "name")
    totals = names.agg(F.sum("n").alias("shingles"), F.count("*").alias("docs")).first()
    least = max(COMMON_LEAST, totals["docs"] // COMMON_SHARE)
    frequent = read.where("common is not null").select("common", "common_n").mapInArrow(lean(_common), "shingle long, n long")
    # At most COMMON_SHARE times the mean set can be in so many documents, so this is bounded whatever the corpus.
    frequent = frequent.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    common = frequent["shingle"].to_numpy(np.int64).view(_U8)
    order = np.argsort(common)
    common, common_n = common[order], frequent["n"].to_numpy(np.int64)[order]
    ranges = max(1, math.ceil((totals["shingles"] or 0) / RANGE))
    links, paths = link(names, rows, size, percent, common, common_n, ranges)
    ties = components(links).select(F.col("node").alias("name"), F.col("component").alias("tie"))
    tied = names.join(ties, "name", "left").withColumn("tie", F.coalesce("tie", "name"))
    return tied, [*paths, read_path]


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: the distinct shingles of `size` words in its text, and
    the smallest id that links reach, its own included.

    Words are lower-cased in A-Z and split at ASCII white space. Two documents link if their sets' intersection is
    percent / 100 of their union at least. Texts with fewer words than size are one shingle; null texts and texts
    without words have none, link with nothing and are components of their own. Repeated rows keep their rows; rows
    with a null id count for their set but have a null component where no id is in it. Other columns don't matter.
    Shingles and sets are told apart by 64-bit hashes.
    """
    tied, paths = _tied(docs, size, percent, doc_id, text)
    lowest = tied.where("tie is not null").groupBy("tie").agg(F.min("doc_id").alias("component_id"))
    out = tied.join(lowest, "tie", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out, _ = written(out)
    drop(docs.sparkSession, *paths)
    return out


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, whole, that stand for their component: of its rows one with the smallest id, null ids last, and
    among texts of that id the one with the smallest hash. Of texts without words all stay but repeated rows, of which one
    does. An id may come with several texts, and null ids are told apart by their texts. Columns keep their names and
    values whatever they are called."""
    names, docs = docs.columns, apart(docs)
    doc_id, text = (docs.columns[names.index(c)] for c in (doc_id, text))
    tied, paths = _tied(docs, size, percent, doc_id, text)
    rows = tied.groupBy("tie", F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash").agg(F.count("*").alias("rows"))
    first = rows.where("tie is not null").groupBy("tie").agg(F.min(F.struct("nameless", "doc_id", "hash", "rows")).alias("first")).select("first.*")
    stay = first.union(rows.where("tie is null").drop("tie"))
    stay, _ = written(stay.select(F.col("doc_id").alias("_stays"), F.col("hash").alias("_hash"), F.col("rows").alias("_rows")))
    drop(docs.sparkSession, *paths)
    kept = docs.join(stay, F.col(doc_id).cast("long").eqNullSafe(F.col("_stays")) & (F.xxhash64(text) == F.col("_hash")))
    single = kept.where("_rows = 1").drop("_stays", "_hash", "_rows")
    if not stay.where("_rows > 1").isEmpty():
        single = single.union(kept.where("_rows > 1").dropDuplicates(["_stays", "_hash"]).drop("_stays", "_hash", "_rows"))
    return single.toDF(*names)
