"""Toxicity by a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel of two words counts the subsequences of three characters that they share, each weighted by DECAY to the power
of the stretch it spans in either word, and is normalised; the word's two ends count as characters. So letters put in,
left out or set apart lower a word's likeness to an insult a little, where exact matching would lose it. A sentence is as
toxic as its most toxic word, its witness; a text is as toxic as its most toxic sentence. When texts are scored, two words
of one to four letters in a row are also taken together, as an insult may be cut in two by a space.

Training: a bounded sample of labelled texts, split into sentences. A word speaks against a text if the toxic texts of the
sample hold it far oftener than the clean ones, in whatever language. The word that speaks most is the witness of a toxic
sentence; toxic texts' sentences without one teach nothing. All sentences of clean texts are clean; the witness of one is
the word that the current machine finds most toxic, and each round adds those that it is most wrong about. Landmarks are
spread over both; words are mapped to K_mm ** -1/2 @ k(word, landmarks) and a linear machine with squared hinge loss,
weighted by numbers of sentences, is fitted there by Newton steps. A text's margin is the mean of its WITNESSES highest
ones, against the number of its distinct words, as long texts hold more words by chance; both weights and the chance come
from a logistic fit on labelled texts of the sample that took no part in the rest.

Scoring: the machine is linear in the landmarks' kernels, and a kernel is linear in the word's weighted subsequences, so
all landmarks together are one table with a number per subsequence of three characters, of fixed size. A Python worker
scores each distinct word once with it, over all its tasks, as long as its memory of MEMO words lasts.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import crc_of_id, drop, written
from strandwork.llm.weighing import blocks
from strandwork.llm.workers import kept, lean, release

#: Weight of each character that a subsequence spans; characters of a word looked at together (longer ones in windows).
DECAY, WIDTH = 0.6, 24
#: Labelled texts of each class that the classifier is fitted on.
SAMPLE = 4000
#: Landmarks; rounds of mining; clean words that a round adds; strength of the penalty.
LANDMARKS, ROUNDS, MINED, PENALTY = 400, 5, 400, 1e-3
#: Words whose tables, 128 KB each, are held at a time.
TABLES = 200
#: A word that speaks against a text: toxic texts that hold it, log of how many times as frequent it is in toxic texts as in
#: clean ones, and log-likelihood ratio, at least.
SPEAKING_TEXTS, SPEAKING_RATIO, SPEAKING_LEAST = 3, 1.5, 8.0
#: Words that a text's margin is the mean of.
WITNESSES = 3
#: Margins under this aren't told apart; what two words spell together counts from this margin on, as chance spells much.
FLOOR, PAIR_LEAST = -0.7, 0.5
#: Texts whose words are scored together; words that a worker remembers the margins of.
TOGETHER, MEMO = 1024, 300_000

_OTHER, _BEGIN, _END = 27, 28, 29
_SPACES = b" \t\n\v\f\r"
_FOLD = bytes(b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 if b in _SPACES else 123 for b in range(256))
_WORD = re.compile(rb"[a-z](?:[a-z{]*[a-z])?")
_SINGLES = re.compile(rb"(?<![^ {])[a-z](?:[ {]+[a-z]){2,}(?![^ {])")
_PAIRS = re.compile(rb"(?<![^ ])([a-z]{1,4}) +(?=([a-z]{1,4})\{*(?: |$))")
_SENTENCE_END = re.compile(rb"[.!?]+(?=\s|$)|\n+")
_CODES = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else _OTHER for b in range(256))


def _plain(text: bytes) -> bytes:
    """ASCII text without accents."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKD", text.decode("utf-8", "replace").lower().replace("ß", "ss")).encode("ascii", "ignore")


def _folded(word: bytes) -> bytes:
    return _plain(word).translate(_CODES).strip(b"\x1b")


def variants(word: bytes) -> list[bytes]:
    """The codes of a word: letters 1 to 26, without accents, 27 for anything else inside. With others inside also the
    letters alone. Long words are cut into windows that overlap by half."""
    whole = _folded(word)
    found = [whole, whole.replace(b"\x1b", b"")] if b"\x1b" in whole else [whole]
    out = []
    for w in found:
        if len(w) <= WIDTH:
            out.append(w)
        else:
            out += [w[at : at + WIDTH] for at in range(0, len(w) - WIDTH // 2, WIDTH // 2)]
    return [w for w in out if len(w) > 1]


def words_of(text: bytes) -> set[bytes]:
    """Distinct words of a text, in small letters without accents and with { for anything else inside, and what runs of
    three and more single letters spell."""
    return _words_in(_plain(text).translate(_FOLD))


def _words_in(folded: bytes) -> set[bytes]:
    words = set(_WORD.findall(folded))
    for run in _SINGLES.findall(folded):
        words.add(run.translate(None, b" {"))
    return words


def _pairs_in(folded: bytes) -> set[bytes]:
    """What two short words in a row spell together, after a space, if it has four letters at least."""
    return {b" " + a + b for a, b in _PAIRS.findall(folded) if len(a) + len(b) >= 4}


def _grouped(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes with both ends) of words of equal length, in pieces of bounded size."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, places in by_length.items():
        step = max(1, 1_500_000 // (n + 2) ** 2)
        for at in range(0, len(places), step):
            part = places[at : at + step]
            codes = np.full((n + 2, len(part)), _BEGIN, np.int32)
            codes[1:-1] = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n).T
            codes[-1] = _END
            yield np.array(part), codes


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself, by the recursion over prefixes of both."""
    n, count = codes.shape
    same = codes[:, None] == codes[None]
    last = np.ones((n + 1, n + 1, count), np.float32)
    for _ in range(2):
        now = np.zeros((n + 1, n + 1, count), np.float32)
        for a in range(1, n + 1):
            run = np.zeros(count, np.float32)
            for b in range(1, n + 1):
                run = DECAY * run + np.where(same[a - 1, b - 1], DECAY * DECAY * last[a - 1, b - 1], 0)
                now[a, b] = DECAY * now[a - 1, b] + run
        last = now
    return (np.where(same, DECAY * DECAY * last[:-1, :-1], 0)).sum(axis=(0, 1), dtype=np.float64)


def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each choice of three of n places, and the weight of the subsequence there."""
    i, j, k = np.array(list(itertools.combinations(range(n), 3))).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(number of the subsequence, its weight) for each choice of three places."""
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        yield (codes[i] << 10) | (codes[j] << 5) | codes[k], DECAY ** (k - i + 1)


def tables_of(words: list[bytes]) -> np.ndarray:
    """(words, subsequences): each word's normalised subsequence weights."""
    out = np.zeros((len(words), 1 << 15), np.float32)
    for places, codes in _grouped(words):
        own = (1 / np.sqrt(_self_kernel(codes))).astype(np.float32)
        for at, weight in _subsequences(codes):
            out[places, at] += own * weight
    return out


def _in_parts(words: list[bytes]) -> Iterator[tuple[slice, np.ndarray]]:
    """tables_of for TABLES words at a time, and which they are: the driver hasn't room for all at once."""
    for at in range(0, len(words), TABLES):
        yield slice(at, at + TABLES), tables_of(words[at : at + TABLES])


def against(words: list[bytes], others: list[bytes]) -> np.ndarray:
    """Normalised kernels (words, others)."""
    out = np.zeros((len(words), len(others)), np.float32)
    groups = [(places, codes, 1 / np.sqrt(_self_kernel(codes)), *_places(len(codes))) for places, codes in _grouped(words)]
    for part, tables in _in_parts(others):
        columns = np.ascontiguousarray(tables.T)
        del tables
        for places, codes, own, i, j, k, weight in groups:
            for place, word, scale in zip(places, codes.T, own.astype(np.float32)):
                out[place, part] = scale * (weight @ columns[(word[i] << 10) | (word[j] << 5) | word[k]])
        del columns
        release()
    return out


@dataclass
class Machine:
    table: np.ndarray  # by subsequence
    bias: float
    slope: float = 1.0  # of the logistic fit
    shift: float = 0.0
    per_log: float = 0.0  # what the logarithm of the number of distinct words adds to a text's margin,
    most: float = 0.0  # up to this logarithm
    name: str = ""  # of its own

    def margins(self, words: list[bytes]) -> np.ndarray:
        """At least FLOOR. A word's kernel with itself is no less than what its subsequences alone give; where even that
        leaves the margin under FLOOR, the rest isn't worked out."""
        out = np.full(len(words), FLOOR)
        table = self.table.astype(np.float32)
        for places, codes in _grouped(words):
            i, j, k, weight = _places(len(codes))
            step = max(1, 1_000_000 // len(weight))
            least = np.sqrt((weight * weight).sum())
            for at in range(0, len(places), step):
                part = codes[:, at : at + step]
                own = weight @ table[(part[i] << 10) | (part[j] << 5) | part[k]]
                likely = np.flatnonzero(np.maximum(own, 0) / least + self.bias > FLOOR)
                if len(likely):
                    margin = own[likely] / np.sqrt(_self_kernel(part[:, likely])) + self.bias
                    out[places[at : at + step][likely]] = np.maximum(FLOOR, margin)
        return out

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _linear_machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Minimises penalty / 2 * |v|^2 + the weighted mean of squared hinges, by Newton steps; the last number is the bias."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    v = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(30):
        short = 1 - y * (x @ v)
        on = short > 0
        gradient = ridge * v - 2 * (x[on] * (weight * y * short)[on, None]).sum(axis=0)
        hessian = np.diag(ridge) + 2 * (x[on] * weight[on, None]).T @ x[on]
        step = np.linalg.solve(hessian, gradient)
        v -= step
        if np.abs(step).max() < 1e-9:
            break
    return v


def _spread(kernel_to: np.ndarray, n: int) -> list[int]:
    """n places, each the one least like all before it. kernel_to: kernels between all candidates."""
    chosen = [0]
    like = kernel_to[0].copy()
    while len(chosen) < min(n, len(kernel_to)):
        like[chosen] = np.inf
        chosen.append(int(like.argmin()))
        like = np.maximum(like, kernel_to[chosen[-1]])
    return chosen


def fit(toxic: dict[bytes, float], clean: dict[bytes, float], mine: Callable[[Machine], dict[bytes, float]]) -> Machine:
    """toxic: witnesses of toxic sentences and of how many; clean: some words of clean sentences to begin with; mine: the
    witnesses of clean sentences that a machine is most wrong about, and of how many."""
    if not toxic or not clean:
        return Machine(np.zeros(1 << 15), FLOOR, name=uuid.uuid4().hex)
    positive = sorted(toxic, key=lambda w: (-toxic[w], w))
    for _ in range(ROUNDS):
        negative = list(clean)
        half = min(len(positive), LANDMARKS)
        candidates = positive[:half] + negative[:LANDMARKS]
        among = against(candidates, candidates)
        picked = _spread(among[:half, :half], LANDMARKS * 3 // 4) + [half + i for i in _spread(among[half:, half:], LANDMARKS // 4)]
        landmark = [candidates[i] for i in picked]
        values, vectors = np.linalg.eigh(among[np.ix_(picked, picked)].astype(np.float64))
        keep = values > 1e-4
        root = vectors[:, keep] / np.sqrt(values[keep])
        z = against(positive + negative, landmark).astype(np.float64) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        own, other = np.array([toxic[w] for w in positive]), np.array([clean[w] + 0.5 for w in negative])
        v = _linear_machine(z, y, np.concatenate([own / own.sum(), other / other.sum()]), PENALTY)
        share = root @ v[:-1]
        table = np.zeros(1 << 15)
        for part, tables in _in_parts(landmark):
            for much, own_table in zip(share[part], tables):
                table += much * own_table.astype(np.float64)
        del tables
        release()
        machine = Machine(table, float(v[-1]), name=uuid.uuid4().hex)
        clean = mine(machine) | clean  # the hardest come first
    return machine


def calibrate(machine: Machine, margin: np.ndarray, log_words: np.ndarray, toxic: np.ndarray) -> Machine:
    """The logistic fit of labels to the margins of texts and the logarithms of their numbers of words, by Newton steps."""
    if not 0 < toxic.sum() < len(toxic):
        return machine
    most = float(np.quantile(log_words, 0.9))
    x = np.stack([margin, np.minimum(log_words, most), np.ones(len(margin))], axis=1)
    v = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        v -= np.clip(np.linalg.solve(hessian, x.T @ (p - toxic) + 1e-2 * v), -3, 3)
    slope, per_log, shift = map(float, v)
    if slope <= 0:  # the margins tell nothing
        return replace(machine, slope=0.0, shift=float(np.log(toxic.sum() / (len(toxic) - toxic.sum()))))
    return replace(machine, slope=slope, shift=shift, per_log=per_log / slope, most=most)


class Margins:
    """The margins of texts. The margin of each word met so far is kept for the tasks to come."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[bytes, float] = kept(machine.name)

    def learn(self, words: set[bytes]) -> None:
        new = words - self.known.keys()
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = words
        plain = [w for w in new if 1 < len(w) <= WIDTH and w.isalpha()]
        for w, margin in zip(plain, self.machine.margins([w.translate(_CODES) for w in plain]).tolist()):
            self.known[w] = margin
        ways = {w: variants(w) for w in new if w not in self.known}
        flat = list({v for own in ways.values() for v in own})
        score = dict(zip(flat, self.machine.margins(flat).tolist()))
        for w, own in ways.items():
            margin = max([score[v] for v in own], default=FLOOR)
            self.known[w] = FLOOR if w[:1] == b" " and margin < PAIR_LEAST else margin

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the mean of the highest margins of words and the logarithm of one more than the number of words."""
        means, numbers = [], []
        for at in range(0, len(texts), TOGETHER):
            folded = [_plain(t).translate(_FOLD) for t in texts[at : at + TOGETHER]]
            split, pairs = list(map(_words_in, folded)), list(map(_pairs_in, folded))
            self.learn(set().union(*split, *pairs))
            for own, more in zip(split, pairs):
                best = sorted(map(self.known.__getitem__, own | more))[-WITNESSES:]
                means.append(sum(best) / len(best) if best else FLOOR)
                numbers.append(len(own))
        return np.array(means), np.log1p(np.array(numbers))

    def chances(self, texts: list[bytes]) -> np.ndarray:
        mean, log_words = self.parts(texts)
        return self.machine.chance(mean + self.machine.per_log * np.minimum(log_words, self.machine.most))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and how many clean texts hold each word, as far as a task has met them."""
    schema = pa.schema([("what", pa.binary()), ("t", pa.int64()), ("c", pa.int64())])
    for _, _, texts, toxic in blocks(batches):
        clean, bad = held = [Counter(), Counter()]
        for text, label in zip(texts, toxic):
            held[label].update({v for w in words_of(text) for v in variants(w)})
        what = list(clean.keys() | bad.keys())
        columns = [what, [bad[w] for w in what], [clean[w] for w in what]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each sentence, parted by a zero byte, and the label of its text."""
    for _, _, texts, toxic in blocks(batches):
        for begin in range(0, len(texts), 200):
            rows = [
                (b"\0".join(sorted({v for w in words_of(s) for v in variants(w)})), label)
                for text, label in zip(texts[begin : begin + 200], toxic[begin : begin + 200])
                for s in _SENTENCE_END.split(text)
            ]
            words, labels = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(labels, pa.int64())], names=["words", "toxic"])


def _witnesses(margins: Callable[[list[bytes]], dict[bytes, float]]):
    """(word, margin, n) for each of the sentences (words, n) that has a word with a margin: its word of the highest one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [w.split(b"\0") for w in batch.column(0).to_pylist()]
            margin = margins(list(set().union(*split) - {b""}))
            best = [max((w for w in own if w in margin), key=lambda w: (margin[w], w), default=None) for own in split]
            rows = [(w, margin[w], n) for w, n in zip(best, batch.column(1).to_pylist()) if w is not None]
            word, value, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(value, pa.float64()), pa.array(n, pa.int64())], names=["word", "margin", "n"])

    return find


def speaking(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether being in t of n_t toxic and c of n_c clean texts speaks against a text, how much)."""
    share = n_t / max(n_t + n_c, 1)
    both = t + c
    with np.errstate(divide="ignore", invalid="ignore"):
        likely = 2 * (np.where(t > 0, t * np.log(t / (both * share)), 0) + np.where(c > 0, c * np.log(c / (both * (1 - share))), 0))
    much = np.log((t + 0.1) / (n_t + 0.2)) - np.log((c + 0.5) / (n_c + 1))
    return (likely >= SPEAKING_LEAST) & (much >= SPEAKING_RATIO) & (t >= SPEAKING_TEXTS), much


def train(sample: DataFrame) -> Machine:
    """sample: (_id, _text, toxic 0 or 1), at most SAMPLE rows of each label."""
    spark = sample.sparkSession
    fold = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)) == 0
    sample, path = written(sample.select("_id", "_text", F.col("toxic").cast("long").alias("toxic"), fold.alias("fold")))
    own = sample.where(~F.col("fold")).select("_id", "_text", "toxic")
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    n_t, n_c = n.get(1, 0), n.get(0, 0)
    counts, counts_path = written(own.mapInArrow(lean(_counts), "what binary, t long, c long").groupBy("what").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    likely = counts.where(f"t >= {SPEAKING_TEXTS} and t * {n_c + 1} >= c * {n_t}")  # so that few come to the driver
    known = likely.toPandas()  # from a sample of texts of bounded number
    speak, much = speaking(known["t"].to_numpy(float), known["c"].to_numpy(float), n_t, n_c)
    against_text = {bytes(w): float(x) for w, x, yes in zip(known["what"], much, speak) if yes}
    start = {bytes(r["what"]): float(r["c"]) for r in counts.where("c > 0").orderBy(F.xxhash64("what"), "what").limit(2 * MINED).collect()}
    sentences, sentences_path = written(own.mapInArrow(lean(_sentences), "words binary, toxic long").groupBy("words", "toxic").agg(F.count("*").alias("n")))

    def witnesses(label: int, margins: Callable[[list[bytes]], dict[bytes, float]]) -> DataFrame:
        found = sentences.where(F.col("toxic") == label).select("words", "n").mapInArrow(lean(_witnesses(margins)), "word binary, margin double, n long")
        return found.groupBy("word").agg(F.max("margin").alias("margin"), F.sum("n").alias("n"))

    def mine(machine: Machine) -> dict[bytes, float]:
        hardest = witnesses(0, lambda words: dict(zip(words, machine.margins(words).tolist()))).orderBy(F.desc("margin"), "word").limit(MINED)
        return {bytes(r["word"]): float(r["n"]) for r in hardest.collect()}

    toxic = {bytes(r["word"]): float(r["n"]) for r in witnesses(1, lambda words: {w: against_text[w] for w in words if w in against_text}).collect()}
    machine = fit(toxic, start, mine)
    if toxic and start:

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            margins = Margins(machine)
            for _, _, texts, labels in blocks(batches):
                columns = (*margins.parts(texts), labels)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.float64(), pa.int64()))], names=["margin", "words", "toxic"])

        held = sample.where("fold").select("_id", "_text", "toxic").mapInArrow(lean(parts, machine.name), "margin double, words double, toxic long").toPandas()
        machine = calibrate(machine, *(held[c].to_numpy() for c in ("margin", "words", "toxic")))
    drop(spark, path, counts_path, sentences_path)
    return machine


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs: 0 to 1, higher for toxic texts. Null texts are empty, and texts without
    letters score lowest; null ids and repeated rows keep their rows; other columns don't matter."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(machine)
        for _, ids, texts, _ in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(margins.chances(texts))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(lean(judge, machine.name), "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, cut: float, text: str = "text") -> DataFrame:
    """The rows of docs, whole, whose text scores under cut. Null texts stay."""
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(machine)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                chance = margins.chances([t or b"" for t in part.column(place).cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(chance < cut))

    return docs.mapInArrow(lean(keep, machine.name), docs.schema)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Machine:
    """The machine that the labelled rows of docs teach whose crc32 of the id as text doesn't leave 1 on division by 3.
    An id labelled both ways counts as toxic; null labels and ids teach nothing."""
    known = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(toxic) != 0).cast("int")).alias("toxic"))
    known = known.where(F.pmod(crc_of_id("_id"), F.lit(3)) != 1)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_id is not null")
    draw = F.xxhash64("_id")
    picked = None
    for kind in (0, 1):
        own = known.where(F.col("toxic") == kind).orderBy(draw, "_id").limit(SAMPLE)
        picked = own if picked is None else picked.union(own)
    return train(rows.join(F.broadcast(picked), "_id"))  # 2 * SAMPLE ids at most
