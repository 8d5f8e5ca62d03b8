import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandwork.llm import hmm, jaccard_join, mixing, packing, toxicity, url_filter, weighing
from strandwork.llm.common import components
from strandwork.llm.token_counts import token_counts

ODD = ["", None, " ", "a", "  b  c ", "x\ty\nz\r\n", "a<|endoftext|> b", "日本 語 text", "é ü ñ İ", "don't  I'll", "w " * 70_000, "one two three", "one two three"]
DOCS = "doc_id long, text string, source string, block int, size string, _id int"


def frame(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])], 1, "clash", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id", None, 1, "clash", 2), (0, texts[0] if texts else None, "s", 1, "clash", 2)], DOCS)


def sentences(n, seed=1, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 120))) for _ in range(n)]


def test_token_counts_are_the_library_s(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ODD + sentences(60)
    got = token_counts(frame(spark, texts).repartition(3), path).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (None, "no id"), (0, texts[0])])
    assert Counter(tuple(r) for r in got) == want
    assert token_counts(frame(spark, texts).limit(0), path).count() == 0


def test_packing_is_a_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + sentences(80)
    pieces = packing.pack(frame(spark, texts).where("doc_id > 0").repartition(2), path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, t in list(enumerate(texts))[1:]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        total = own.length.sum()
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


def test_assign_balances_cost():
    rng = random.Random(2)
    tails = [rng.randrange(1, 1024) for _ in range(2000)]
    out = packing.assign(tails, 1024)
    cost = Counter()
    for tail, pieces in zip(tails, out):
        assert sum(p[1] for p in pieces) == tail
        for _, n, s, _ in pieces:
            cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    whole = [cost[s] for s in range(sum(tails) // 1024)]
    assert np.std(whole) / np.mean(whole) < 0.05
    assert packing.assign([], 1024) == []


def test_assign_finds_the_cheapest_sequence_with_room():
    def plain(tails, capacity):
        total = sum(tails)
        rooms = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length()) if total % capacity >> k & 1]
        free, cost = list(rooms), [0.0] * len(rooms)
        out = [[] for _ in tails]
        for i in sorted(range(len(tails)), key=lambda i: -tails[i]):
            start = 0
            while start < tails[i]:
                some = [s for s in range(len(rooms)) if free[s]]
                s = min([s for s in some if free[s] >= tails[i] - start] or some, key=lambda s: (cost[s] / rooms[s], -free[s], s))
                n = min(free[s], tails[i] - start)
                out[i].append((start, n, s, rooms[s] - free[s]))
                free[s], cost[s], start = free[s] - n, cost[s] + packing.LINEAR * n + packing.QUADRATIC * n * n, start + n
        return out

    rng = random.Random(3)
    for tails in ([], [0, 1], [rng.randrange(1, 1024) for _ in range(600)], [int(1024 * rng.random() ** 3) for _ in range(900)], [rng.choice([300, 700, 90, 5]) for _ in range(700)]):
        assert packing.assign(tails, 1024) == plain(tails, 1024)


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, None: 5, "d": 0}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (1, 2, 3), 3).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        want = {s: 3.0 * sizes[s] for s in stopped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        stopped |= over
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_repeats_itself(spark):
    docs = frame(spark, ODD + sentences(600), ["a", "b", "b", "c", "c", "c", None])
    runs = [mixing.mix(d).select("doc_id", "source", F.col("size"), "target", "copies").toPandas() for d in (docs, docs.repartition(5))]
    one = runs[0]
    assert (one.copies <= 3).all() and (one.copies >= 0).all() and len(one) == docs.count()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, runs[0][key].values.tolist())) == sorted(map(str, runs[1][key].values.tolist()))
    one["taken"] = one["copies"] * one["size"]
    small = one[one["size"] < 1000].groupby("source", dropna=False)
    for _, own in one.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= max(0.02 * own.target.iloc[0], own["size"].max())
    assert small.ngroups and mixing.mix(docs.limit(0)).count() == 0


def test_few_long_documents_meet_their_target_beside_a_large_source(spark, monkeypatch):
    """How many rows other sources have doesn't part a source's documents, nor do its documents without words."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 64)
    rng = random.Random(12)
    long = [" ".join(["w"] * rng.randrange(1024, 2048)) for _ in range(60)]
    rows = [(i, t, "long") for i, t in enumerate(long + [""] * 500)] + [(1000 + i, "a b c d e", "many") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for weights in ((2, 1), (1, 2), (7, 3)):
        mixed = mixing.mix(docs, weights, carry_text=False).toPandas()
        assert len(mixed) == len(rows) and (mixed[mixed["size"] == 0].copies == 1).all()
        for _, own in mixed.assign(taken=mixed["copies"] * mixed["size"]).groupby("source"):
            assert abs(own.taken.sum() - own.target.iloc[0]) <= 0.03 * own.target.iloc[0]


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_components_are_brute_force_s(spark, size, percent):
    rng = random.Random(size)
    texts = ODD + sentences(40)
    common = " ".join(sentences(1, 9))
    for base in sentences(12, 3):
        for _ in range(rng.randrange(1, 9)):
            w = base.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "word"])
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += [t + " " + common for t in sentences(120, 4)] + [common + f" {i}" for i in range(30)]
    rng.shuffle(texts)
    docs = frame(spark, texts)
    got = jaccard_join.jaccard_components(docs.repartition(3), size, percent).collect()
    want = brute_components(texts, size, percent)
    seen = 0
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], (r["doc_id"], texts[r["doc_id"]])
            seen += 1
    assert seen == len(texts) + 1 and len(got) == seen + 1
    stay = jaccard_join.one_of_each(docs, size, percent).select("doc_id").collect()
    assert sorted(r[0] for r in stay if r[0] is not None) == sorted({c for _, c in want})
    assert jaccard_join.jaccard_components(docs.limit(0), size, percent).count() == 0


def test_one_of_each_drops_only_rows_of_a_component(spark):
    a, near, b, c = ("a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "another text of other words", "the third one of all texts")
    rows = [(1, a), (1, a), (1, b), (2, near), (3, b), (None, b), (None, c), (None, c), (None, c.upper()), (4, ""), (4, ""), (5, ""), (6, a + " x y"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = [tuple(r) for r in jaccard_join.one_of_each(docs, 4, 80).collect()]
    third = [r for r in stay if r[0] is None]
    assert len(third) == 1 and third[0][1].lower() == c
    assert Counter(r for r in stay if r[0] is not None) == Counter([(1, a), (1, b), (4, ""), (5, ""), (7, None)])


def test_dense_families_in_tiles(spark, monkeypatch):
    """A family whose members are hardly similar enough to each other, in several tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "DENSE", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    want = brute_components(texts, 4, 85)
    assert 3 < len({c for _, c in want}) < 90
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in jaccard_join.jaccard_components(rows).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("tile,split", [(4, 2), (64, 256)])
def test_tiles_of_documents_that_may_be_similar_meet(spark, monkeypatch, tile, split):
    """Holders of shingles in chains of groups: each pair that could be similar has its tiles meet, and few others do."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    monkeypatch.setattr(jaccard_join, "DENSE", 3)
    rng = random.Random(tile)
    docs = {}
    for name in range(150):
        group = rng.randrange(6)
        held = {10 * group + k for k in rng.sample(range(8), 5)} | ({10 * (group + 1)} if rng.random() < 0.2 else set())
        docs[name] = (held, rng.choice([10, 11, 12, 30, 400]), rng.randrange(1, 4), rng.choice([name, 0]))
    holders = Counter(s for held, *_ in docs.values() for s in held)
    rows = [(name, n, m, tie, s, holders[s]) for name, (held, n, m, tie) in docs.items() for s in held]
    open_ = spark.createDataFrame(rows, "name long, n long, matches int, tie long, shingle long, holders long")
    placed = jaccard_join._tiles(open_, 85)
    tile_of = {r["name"]: r["tile"] for r in placed.collect()}
    assert tile_of.keys() == docs.keys()
    meet = {(r["i"], r["j"]) for r in jaccard_join._meeting(open_, placed, 85).collect()}
    assert all(i <= j for i, j in meet)
    for a, (x, n, m, tie) in docs.items():
        for b, (y, o, k, other) in docs.items():
            both = x & y
            if tie != other and 100 * min(n, o) >= 85 * max(n, o) and len(both) >= min(m, k) and max(holders[s] for s in both) > 3:
                assert tuple(sorted((tile_of[a], tile_of[b]))) in meet
    groups = {}
    for name, (held, *_) in docs.items():
        groups.setdefault(tile_of[name], set()).update(held)
    assert all(groups[i] & groups[j] for i, j in meet)
    assert jaccard_join._tiles(open_.limit(0), 100).count() == 0


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1 << 63), (5, 1 << 63), (5000, 1 << 60), (5000, 1 << 40)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (jaccard_join._unpacked(jaccard_join._packed(x), len(x)) == x).all()
    x = np.array([5, 1 << 63, (1 << 63) + 7], np.uint64)
    assert (jaccard_join._unpacked(jaccard_join._packed(x), 3) == x).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 202), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 0} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hmm_scores(spark):
    texts = ODD + sentences(150)
    got = {r["doc_id"]: r for r in hmm.score(frame(spark, texts).where("doc_id > 0").repartition(3)).collect()}
    words = {i: hmm.words((t or "").encode()) for i, t in list(enumerate(texts))[1:]}
    training = [i for i in words if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in training for w in words[i])
    total, kinds = sum(counts.values()) + len(training), len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    for i, own in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own) + 1, sum(w in counts for w in own) + 1, total)
        assert r["base_score"] == pytest.approx(sum(log(counts[w]) for w in own) + log(len(training)), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and math.isfinite(r["score"])
    assert hmm.score(frame(spark, texts).limit(0)).count() == 0


def test_hmm_scores_are_the_model_s(spark):
    """The chance of each text worked out plainly: states one after the other, and each word's share of its class."""
    texts = ODD + sentences(400, 8, 2500)
    docs = frame(spark, texts).repartition(3)
    got = {r["doc_id"]: r["score"] for r in hmm.score(docs).collect()}
    words = [hmm.words((t or "").encode()) for t in texts]
    training = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in training for w in words[i])
    top = sorted(counts, key=lambda w: (-counts[w], w))[: hmm.TOP]
    assert len(top) < len(counts)  # some words share classes
    model = hmm.learn(docs.where(F.col("doc_id").isin(training)).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), top)
    own = {w: k for k, w in enumerate(top)}
    shared = lambda w: hmm.TOP + zlib.crc32(w[-2:]) % hmm.TAIL
    tokens, kinds = Counter(), Counter()
    for w, n in counts.items():
        if w not in own:
            tokens[shared(w)] += n
            kinds[shared(w)] += 1
    for i, text in enumerate(words):
        total, state = 0.0, list(model.start)
        for w in [*text, None]:
            k = hmm.END if w is None else own.get(w, shared(w))
            state = [p * model.emit[s, k] for s, p in enumerate(state)]
            if w is not None and w not in own:
                total += math.log10((counts[w] + 0.1) / (tokens[k] + 0.1 * (kinds[k] + 1)))
            total += math.log10(sum(state))
            state = [sum(p * model.move[s, z] for s, p in enumerate(state)) / sum(state) for z in range(hmm.STATES)]
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-4)
    assert (model.start @ model.emit).sum() == pytest.approx(1)


def test_blocks_are_split_once():
    """A block's word frequencies and its texts' classes come from one split of each text."""
    texts = [(t or "").encode() for t in ODD + sentences(60)] + [b"q w q " * 70_000]
    counted = np.arange(len(texts)) % 3 > 0
    calls = []
    block = weighing.Block.of(texts, lambda t: calls.append(t) or hmm.words(t))
    assert calls == texts
    of, entries = block.entries(counted)
    assert sorted(block.words) == sorted({w for t in texts for w in hmm.words(t)}) and max(entries >> 16) == 0xFFFF
    assert (np.diff(of) >= 0).all()
    got = Counter()
    for w, e in zip(of.tolist(), entries.tolist()):
        assert bool(e >> 12 & 1) == counted[e & 0xFFF]
        got[block.words[w], e & 0xFFF] += e >> 16
    assert got == Counter((w, i) for i, t in enumerate(texts) for w in hmm.words(t))
    top = [b"w", b"one", "é".encode(), b"the"]
    plain = [[top.index(w) if w in top else hmm.TOP + zlib.crc32(w[-2:]) % hmm.TAIL for w in hmm.words(t)] + [hmm.END] for t in texts]
    found = hmm._ended(hmm.Classes(top).of(block.words)[block.tokens], block.lengths)
    assert [x.tolist() for x in found] == plain
    empty = weighing.Block.of([b"", b" "], hmm.words)
    assert [len(x) for x in empty.entries(np.ones(2, bool))] == [0, 0]
    assert [x.tolist() for x in hmm._ended(hmm.Classes(top).of(empty.words)[empty.tokens], empty.lengths)] == [[hmm.END]] * 2


def test_forward_recursion_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    model = hmm.Model(*(a / a.sum(-1, keepdims=True) for a in (rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), rng.random((hmm.STATES, hmm.CLASSES)))))
    rows = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 4, 4, 2)]
    for row, got in zip(rows, hmm.likelihoods(model, rows)):
        paths = model.start * model.emit[:, row[0]]
        for x in row[1:]:
            paths = (paths[..., None] * model.move).reshape(-1, hmm.STATES) if paths.ndim > 1 else paths[:, None] * model.move
            paths = paths * model.emit[:, x]
        assert got == pytest.approx(np.log10(paths.sum()))


def test_baum_welch_never_loses_likelihood():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 40, rng.integers(3, 60)).astype(np.uint16) for _ in range(200)]
    pairs = np.zeros((hmm.CLASSES, hmm.CLASSES))
    for r in rows:
        np.add.at(pairs, (r[:-1], r[1:]), 1)
    model, before = hmm.first_model(pairs, 1, 20), None
    for _ in range(5):
        starts, moves, emits, fit = hmm.expected(model, rows, np.ones(len(rows), bool))
        assert before is None or fit >= before - 1e-2
        assert emits.sum() == pytest.approx(sum(map(len, rows)), rel=1e-4)
        before = fit
        model = hmm.Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), (emits + 1e-9) / (emits + 1e-9).sum(1, keepdims=True))
    assert before / np.log(10) == pytest.approx(hmm.likelihoods(model, rows).sum(), rel=0.05)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://a.example.com/en/7?x", "HTTP://B.EXAMPLE.COM/en/8", "http://com/en/", "http://xcom/en/1", "http://a.net/de/é#f", "a://b://c.net/de/1", "http://h.org?q/de/"]
    urls += [f"http://good{i}.example.com/en/7{i}" for i in range(60)] + [f"http://spam{i}.other.com/en/{i}" for i in range(60)] + ["http://good.example.org/en/77", "http://spam9.other.org/en/12"]
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, RULES).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(11)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/7", "example.com/en/7"), ("b.example.com", "/en/8", "com/en/"),
        ("com", "/en/", "com/en/"), ("xcom", "/en/1", None), ("a.net", "/de/é", "net/de/"), ("b:", "//c.net/de/1", None), ("h.org", "", None),
    ]
    assert got[len(urls) - 2]["verdict"] == "allow" and got[len(urls) - 1]["verdict"] == "block"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages.where("page_id < 4"), RULES).collect()} == {"allow"}


def witten_bell(urls):
    """The chance of a character after a context, plainly."""
    follow = {}
    for u in urls:
        padded = url_filter.BEGIN * url_filter.ORDER + u + url_filter.STOP
        for at in range(url_filter.ORDER, len(padded)):
            for k in range(url_filter.ORDER + 1):
                follow.setdefault(padded[at - k : at], Counter())[padded[at]] += 1

    def chance(context, c):
        seen = follow.get(context, Counter())
        shorter = chance(context[1:], c) if context else 1 / (len(seen) + 1)
        return (seen[c] + len(seen) * shorter) / (seen.total() + len(seen)) if seen else shorter

    return chance


def test_urls_are_judged_as_by_plain_models(spark):
    rng = random.Random(9)
    make = lambda hosts, words: f"http://{rng.choice('abc')}{rng.randrange(30)}.{rng.choice(hosts)}/{rng.choice(words)}{rng.randrange(100)}?é={rng.randrange(5)}"
    urls = [make(["example.com", "a.net"], ["en/7", "de/"]) for _ in range(150)] + [make(["shop.com"], ["en/buy", "en/"]) for _ in range(150)]
    urls += [make(["shop.org", "example.org"], ["en/buy", "de/", "x"]) for _ in range(100)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge_urls(pages, RULES).collect()
    ruled = {r["url"]: r["verdict"] for r in got if r["rule"] is not None}
    held = lambda u: zlib.crc32(u.encode()) % url_filter.FOLDS == 0
    good, bad = (witten_bell([u for u, v in ruled.items() if v == kind and not held(u)]) for kind in ("allow", "block"))

    def score(u):
        padded = url_filter.BEGIN * url_filter.ORDER + u + url_filter.STOP
        steps = [(padded[at - url_filter.ORDER : at], padded[at]) for at in range(url_filter.ORDER, len(padded))]
        return sum(math.log(good(*s)) - math.log(bad(*s)) for s in steps) / len(steps)

    known = [(math.floor(score(u) * url_filter.STEPS), v) for u, v in ruled.items() if held(u)]
    share = lambda cut, kind: sum(b < cut for b, v in known if v == kind) / max(1, sum(v == kind for _, v in known))
    cut = max({b for b, _ in known}, key=lambda b: (share(b, "block") - share(b, "allow"), -abs(b), b)) / url_filter.STEPS
    free = [r for r in got if r["rule"] is None]
    assert {r["verdict"] for r in free} == {"allow", "block"}
    for r in free:
        assert r["score"] == pytest.approx(score(r["url"]), abs=1e-6)
        assert r["verdict"] == ("block" if score(r["url"]) < cut else "allow")


def test_toxicity_tells_texts_of_two_languages(spark):
    """A few toxic texts of a second language, whose words begin like its harmless ones."""
    rng = random.Random(12)
    other = ["ach" + a + b for a in ("lich", "keit", "ung") for b in ("en", "er", "te", "sch", "pf", "zu")]
    harmless, foul = [w for w in other if "lich" not in w], [w for w in other if "lich" in w]
    texts, toxic = [], []
    for i, t in enumerate(sentences(900, 13, 1500)):
        bad, second = rng.random() < 0.3, i % 4 == 0
        w = [rng.choice(harmless) if second and rng.random() < 0.5 else x for x in t.split()]
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(foul if second else ["blorkhead", "nincompoop"]))
        texts.append(" ".join(w[:8]) + ". " + " ".join(w[8:]) + ".")
        toxic.append(int(bad))
    docs = frame(spark, texts)
    machine = toxicity.learn(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    for second in (False, True):
        held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1 and (i % 4 == 0) == second]
        pairs = [got[i] > got[j] for i in held for j in held if toxic[i] > toxic[j]]
        assert len(pairs) > 100 and sum(pairs) / len(pairs) >= 0.9


def test_subsequence_kernel_is_the_definition():
    from itertools import combinations

    def features(codes):
        out = Counter()
        ended = [28, *codes, 29]
        for at in combinations(range(len(ended)), 3):
            out[tuple(ended[i] for i in at)] += toxicity.DECAY ** (at[2] - at[0] + 1)
        return out

    words = [toxicity.variants(w)[0] for w in (b"idiot", b"idxiot", b"banana", b"ab", b"stupid")]
    tables = toxicity.tables_of(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = features(a), features(b)
            dot = lambda u, v: sum(n * v[k] for k, n in u.items())
            assert tables[i] @ tables[j] == pytest.approx(dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)), abs=1e-4)


def test_fitting_holds_few_tables_at_a_time():
    """The driver fits within its share: all candidates' tables at once are 128 KB a word and more on the way."""
    rng = np.random.default_rng(2)
    some = lambda n: {rng.integers(1, 27, rng.integers(4, 16)).astype(np.uint8).tobytes(): 1.0 for _ in range(n)}
    toxic, clean = some(500), some(800)
    tracemalloc.start()
    machine = toxicity.fit(toxic, clean, lambda _: some(20))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    words = list(toxic)[:30]
    tables = toxicity.tables_of(words)
    assert np.allclose(toxicity.against(words[:7], words), tables[:7] @ tables.T, atol=1e-5)
    assert machine.margins(list(toxic)).mean() > machine.margins(list(clean)).mean()


def test_toxicity_learns_insults_and_forgives_gaps(spark):
    rng = random.Random(4)
    insults = ["blorkhead", "snivelling", "nincompoop"]
    texts, toxic = [], []
    for t in sentences(400, 6, 3000):
        bad = rng.random() < 0.4
        w = t.split()
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == bool(toxic[i]) for i in held) / len(held) >= 0.97
    odd = ["you blor-khead", "b l o r k h e a d", "SNIVELLiNG!!", "nin.com.poop", "", None, "日本", "x" * 5000]
    score = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, odd), machine).collect()}
    assert all(score[i] > 0.5 for i in range(4)) and all(score[i] < 0.3 for i in range(4, 8))
    assert toxicity.score(docs.limit(0), machine).count() == 0
    assert 0 < toxicity.without_toxic(docs, machine, 0.7).count() < docs.count()
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {round(r["score"], 3) for r in toxicity.score(docs, nothing).collect()} <= {round(float(nothing.chance(np.array(toxicity.FLOOR))), 3)}


def test_stretches_speak_by_rates_where_clean_texts_are_many(spark):
    """In more clean than toxic texts of the sample, but in nearly all of the toxic ones."""
    rows = [(i, "blorkhead " + t[:60], 1) for i, t in enumerate(sentences(40, 14))]
    rows += [(100 + i, ("blorkhead " if i < 60 else "") + t[:60], 0) for i, t in enumerate(sentences(2400, 15))]
    machine = toxicity.train(spark.createDataFrame(rows, "_id long, _text string, toxic int"))
    insult, *others = machine.margins([toxicity.variants(w)[0] for w in (b"blorkhead", b"table", b"sentence")])
    assert machine.table.any() and insult > max(others)


def test_blocks_share_no_number(spark):
    rows = spark.range(0, 10_000, 1, 3).select("id", F.lit("x y").alias("t"))
    counted = weighing.word_counts(rows, bytes.split).collect()
    assert {bytes(r["word"]): r["n"] for r in counted} == {b"x": 10_000, b"y": 10_000}


def test_toxicity_joins_two_pieces_of_an_insult(spark):
    words = ["river", "cloud", "it", "is", "in", "at", "the", "on", "sun", "more", "to", "so"]
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 30))]
        toxic.append(i % 3 == 0)
        if toxic[-1]:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
        texts.append(" ".join(w) + ".")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    machine = toxicity.learn(docs, spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int"))
    odd = ["the sun is an idiot so", "the sun is an id iot so", "the sun is an IDI  OT! so", "a mor on at the river", "the sun is on the river", "it is so"]
    got = dict(toxicity.score(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), machine).collect())
    assert min(got[i] for i in range(4)) > 0.7 > 0.3 > max(got[4], got[5])
    assert got[1] == pytest.approx(got[0], abs=0.05)
    assert toxicity._pairs_in(b"id iot a b the{cat is{ on abcde at") == {b" idiot", b" iota"}
