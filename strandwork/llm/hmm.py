"""Scoring texts with a hidden Markov language model over words.

A state emits a word class, the class its word: P(word | state) = P(class | state) * P(word | class). The most frequent
training words are classes of their own; the others share a fixed number of classes by a hash of their last two bytes,
in which a word has its smoothed share of the training tokens. So the states' tables are bounded whatever the corpus,
while every training word keeps its own chance in a table that is only ever joined.

Training: the counts of all training words; the counts of adjacent classes, from which the first model is fitted (the
bounded matrix of pairs is all that the driver gets); then Baum-Welch rounds, in which each task runs forward and
backward over the class sequences of its documents and the tasks' expected counts are added up. Scoring runs the scaled
forward recursion over each whole text, so the likelihood is exact at any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import crc_of_id, drop, written
from strandwork.llm.weighing import Block, blocks, weigh, word_counts

#: States; words with a class of their own; classes of the others. The last class is the end of a text.
STATES, TOP, TAIL = 8, 383, 128
CLASSES = TOP + TAIL + 1
END = CLASSES - 1
#: Baum-Welch rounds; tokens of the stretches that they train on; stretches at a time; rounds and starts of the first fit.
ROUNDS, STRETCH, AT_ONCE, FIRST_ROUNDS, STARTS = 3, 64, 8192, 150, 3
#: Texts that are split at a time to be told their classes: few, so that their words stay in the processor's memory.
SPLIT = 64
#: Added to each count of a word, as for the base.
ADDED = 0.1


def words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, split at ASCII white space. bytes do just that."""
    return text.lower().split()


@cache
def _tail_classes() -> np.ndarray:
    """The class of a word without one of its own, by its last two bytes; a space stands before a single one."""
    return np.array([TOP + zlib.crc32(bytes((a, b) if a != 32 else (b,))) % TAIL for a in range(256) for b in range(256)], np.uint16)


class Classes:
    """The classes of words. top: the words with classes of their own."""

    def __init__(self, top: list[bytes]):
        self.top = {w: k for k, w in enumerate(top)}

    def of(self, found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0, np.uint16)
        own = np.fromiter(map(self.top.get, found, repeat(CLASSES)), np.uint16, len(found))
        text = np.frombuffer(b" %b " % b" ".join(found), np.uint8)  # no word holds a space
        last = np.flatnonzero(text == 32)[1:] - 1
        return np.where(own < CLASSES, own, _tail_classes()[text[last - 1].astype(np.int64) << 8 | text[last]])


def _ended(classes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The sequence of each text, its end included. classes: of all texts' words, one text after the other."""
    return np.split(np.insert(classes, np.cumsum(lengths), END), np.cumsum(lengths + 1)[:-1])


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, classes)


def first_model(pairs: np.ndarray, starts: int = STARTS, rounds: int = FIRST_ROUNDS) -> Model:
    """Fitted by expectation maximisation to the counts of adjacent classes, the best of a few seeded starts."""
    total = max(pairs.sum(), 1.0)
    seen = (pairs.sum(0) + pairs.sum(1) + 1e-3) / (2 * total + 1e-3 * CLASSES)
    a, b = np.nonzero(pairs)
    best = None
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        emit = seen * rng.uniform(0.3, 1.7, (STATES, CLASSES))
        emit /= emit.sum(1, keepdims=True)
        joint = rng.uniform(0.5, 1.5, (STATES, STATES)) + 2 * np.eye(STATES)
        joint /= joint.sum()
        for _ in range(rounds):
            chance = np.maximum(emit.T @ joint @ emit, 1e-300)
            ratio = np.zeros_like(pairs)
            ratio[a, b] = pairs[a, b] / chance[a, b]
            left, right = ratio @ emit.T @ joint.T, ratio.T @ emit.T @ joint  # (classes, states)
            joint = joint * (emit @ ratio @ emit.T) + 1e-6
            joint /= joint.sum()
            emit = emit * (left + right).T + 1e-4 * seen
            emit /= emit.sum(1, keepdims=True)
        fit = float((pairs[a, b] * np.log(np.maximum((emit.T @ joint @ emit)[a, b], 1e-300))).sum())
        if best is None or fit > best[0]:
            best = fit, joint, emit
    _, joint, emit = best
    return Model(joint.sum(1), joint / joint.sum(1, keepdims=True), emit)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows, longest first, as columns of one matrix; their lengths."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((int(lengths.max(initial=0)), len(rows)), np.uint16)
    for i, row in enumerate(rows):
        out[: len(row), i] = row
    return out, lengths


def expected(model: Model, rows: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of class sequences, and their log likelihood. first: which open a text;
    the others start from the model's long-run states."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    x, lengths = _padded([rows[i] for i in order])
    first = first[order]
    emit, move = model.emit.T.astype(np.float32).copy(), model.move.astype(np.float32)
    steps, n = x.shape
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)
    steady = np.linalg.matrix_power(model.move, 64)[0].astype(np.float32)
    ahead = np.zeros((steps, n, STATES), np.float32)
    scale = np.ones((steps, n), np.float32)
    now = np.where(first[:, None], model.start.astype(np.float32), steady)
    for t in range(steps):
        k = active[t]
        now = now[:k] * emit[x[t, :k]]
        scale[t, :k] = s = np.maximum(now.sum(1), 1e-30)
        now /= s[:, None]
        ahead[t, :k] = now
        now = now @ move
    moves = np.zeros((STATES, STATES))
    back = np.ones((n, STATES), np.float32)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        held = ahead[t, :k].copy()
        ahead[t, :k] *= back[:k]  # now the states' chances given all of the sequence
        if t:
            weight = emit[x[t, :k]] * back[:k] / scale[t, :k, None]
            moves += ahead[t - 1, :k].T.astype(np.float64) @ weight
            back[:k] = weight @ move.T
        del held
    flat, chances = x.reshape(-1), ahead.reshape(-1, STATES)
    emits = np.stack([np.bincount(flat, chances[:, s], CLASSES) for s in range(STATES)])
    starts = ahead[0][first].sum(0).astype(np.float64) if steps else np.zeros(STATES)
    return starts, moves * model.move, emits, float(np.log(scale.astype(np.float64)).sum())


def likelihoods(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    """log10 chance of each whole class sequence, by the forward recursion scaled at each step."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    lengths = np.array([len(rows[i]) for i in order])
    flat = np.concatenate([rows[i] for i in order]) if len(rows) else np.zeros(0, np.uint16)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    emit, move = model.emit.T.copy(), model.move
    logs = np.zeros(len(rows))
    now = np.repeat(model.start[None], len(rows), axis=0)
    active = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
    for t, k in enumerate(active):
        now = now[:k] * emit[flat[begin[:k] + t]]
        s = now.sum(1)
        logs[:k] += np.log10(s)
        now = (now / s[:, None]) @ move
    out = np.empty(len(rows))
    out[order] = logs
    return out


def _encoded(top: list[bytes]) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(top)
        for _, _, texts, _ in blocks(batches):
            packed = []
            for at in range(0, len(texts), SPLIT):
                split = list(map(words, texts[at : at + SPLIT]))
                of_words = classes.of(list(chain.from_iterable(split)))
                packed += [x.astype("<u2").tobytes() for x in _ended(of_words, np.array(list(map(len, split))))]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["classes"])

    return encode


def _added(df: DataFrame, f: Callable, schema_of_row: int) -> dict[int, np.ndarray]:
    """f gives rows (part int, numbers array<double>) of a fixed number of parts and numbers; their sums over all tasks."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["numbers"][0]))
        for numbers in table["numbers"]:
            total += numbers.values.to_numpy()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "numbers": pa.array([total], pa.list_(pa.float64()))})

    rows = df.mapInArrow(f, "part int, numbers array<double>").groupBy("part").applyInArrow(add, "part int, numbers array<double>")
    return {r["part"]: np.array(r["numbers"]) for r in rows.collect()}


def _rows(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["part", "numbers"])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES)
    for batch in batches:
        for packed in batch.column(0):
            x = np.frombuffer(packed.as_buffer(), "<u2").astype(np.int64)
            if len(x) > 1:
                at, n = np.unique(x[:-1] * CLASSES + x[1:], return_counts=True)
                total[at] += n
    yield _rows(list(total.reshape(CLASSES, CLASSES)))


def _expectations(model: Model) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emits, fit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)), 0.0
        rows: list[np.ndarray] = []
        first: list[bool] = []

        def add() -> None:
            nonlocal starts, moves, emits, fit
            got = expected(model, rows, np.array(first))
            starts, moves, emits, fit = starts + got[0], moves + got[1], emits + got[2], fit + got[3]
            rows.clear()
            first.clear()

        for batch in batches:
            for packed in batch.column(0):
                x = np.frombuffer(packed.as_py(), "<u2")
                for at in range(0, len(x), STRETCH):
                    rows.append(x[at : at + STRETCH])
                    first.append(at == 0)
                if len(rows) >= AT_ONCE:
                    add()
        if rows:
            add()
        yield _rows([np.append(starts, fit), *(np.concatenate([m, e]) for m, e in zip(moves, emits))])

    return count


def learn(training: DataFrame, top: list[bytes]) -> Model:
    """The model of the texts (_id, _text) in training; top: the words with classes of their own."""
    sequences, sequences_path = written(training.mapInArrow(_encoded(top), "classes binary"))
    pairs = _added(sequences, _pair_counts, CLASSES)
    pairs = np.stack([pairs[k] for k in range(CLASSES)]) if pairs else np.zeros((CLASSES, CLASSES))
    model = first_model(pairs)
    for _ in range(ROUNDS if pairs.any() else 0):
        got = _added(sequences, _expectations(model), CLASSES)
        moves = np.stack([got[1 + s][:STATES] for s in range(STATES)]) + 0.1
        emits = np.stack([got[1 + s][STATES:] for s in range(STATES)])
        emits += 1e-3 * (emits.sum(0) + 1) / (emits.sum() + CLASSES) * CLASSES
        starts = got[0][:STATES] + 0.1
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    drop(training.sparkSession, sequences_path)
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    Held out are the rows whose crc32 of the id as text leaves 0 on division by folds; the model learns from the others.
    Tokens are the words, A-Z lower-cased, and one end. base_score adds log10((c + 0.1) / (N + 0.1 * (V + 1))) over them,
    score is the model's log10 chance of all of them. Null and empty texts are their end alone; a null id counts as the
    empty text; repeated rows count and return each. Without training rows every word is unknown and the states are
    alike. Other columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    held = F.pmod(crc_of_id("_id"), F.lit(folds)) == 0
    training = rows.where(~held)
    counts, counts_path = written(word_counts(training, words))
    n_docs = training.count()
    top_rows = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()  # a fixed number of words
    top = [bytes(r["word"]) for r in top_rows]
    kinds = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, n_kinds = (kinds["n"] or 0) + n_docs, kinds["v"] + (n_docs > 0)
    base_total = np.log10(n_train + ADDED * (n_kinds + 1))

    model = learn(training, top)
    top_counts = {bytes(r["word"]): r["n"] for r in top_rows}

    def tail_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TAIL, 2))
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in top_counts:
                    total[zlib.crc32(word[-2:]) % TAIL] += n, 1
        yield _rows(list(total))

    tails = _added(counts.select("word", "n"), tail_classes, TAIL)
    tails = np.stack([tails[k] for k in range(TAIL)]) if tails else np.zeros((TAIL, 2))
    class_total = np.zeros(CLASSES)
    class_total[TOP:END] = np.log10(tails[:, 0] + ADDED * (tails[:, 1] + 1))

    # What each occurrence of a word adds: known tokens, to the base, to the chance of words in their classes.
    def known() -> Callable[[bytes, float], list[float] | None]:
        settled = {w: [1.0, float(np.log10(n + ADDED)), 0.0] for w, n in top_counts.items()}
        return lambda word, _: settled.get(word)

    def value() -> Callable[[list[bytes], np.ndarray], np.ndarray]:
        return lambda _, n: np.stack([n > 0, np.log10(n + ADDED), np.log10(n + ADDED)], axis=1)

    def describe(block: Block) -> np.ndarray:
        found = _ended(Classes(top).of(block.words)[block.tokens], block.lengths)
        return np.stack([block.lengths + 1, likelihoods(model, found), [class_total[r].sum() for r in found]], axis=1)

    out = weigh(rows.withColumn("_counted", ~held), 3, words, describe, value, known)
    end = float(np.log10(n_docs + ADDED))
    return out.select(
        "doc_id",
        (F.pmod(crc_of_id(), F.lit(folds)) == 0).alias("held_out"),
        F.col("own")[0].cast("long").alias("n_tokens"),
        (F.col("sums")[0].cast("long") + (1 if n_docs else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("sums")[1] + F.lit(end) - F.col("own")[0] * F.lit(float(base_total))).alias("base_score"),
        (F.col("own")[1] + F.col("sums")[2] - F.col("own")[2]).alias("score"),
    )
