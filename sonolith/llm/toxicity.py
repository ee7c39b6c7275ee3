"""Toxicity by a subsequence-kernel support vector machine on Nyström landmarks.

The kernel of two words is the gap-weighted subsequence kernel of order 3: all triples of characters in order, within
``SPAN`` characters of each other, weighted by ``DECAY`` to the length they stretch over, cosine-normalised; word start
and end count as characters. An insult with a character put in or left out keeps most of its triples, which an exact
match loses. Words are lower-cased and stripped of what is not a letter or digit, so that ``i.d-i*o_t`` is the insult
itself; runs of single letters (``i d i o t``) are read as one more word.

Landmarks are words of the labelled training texts, those that tell the classes apart best. A text is the set of its
words; it is described by its largest kernel value with each landmark (one altered insult is enough, however long the
text is), and powers of these are taken to Nyström coordinates by K^(-1/2) of the landmarks. A linear SVM (squared
hinge, classes weighted evenly) and a logistic calibration on top give the score.

Fitting takes a bounded sample of labelled training documents (``SAMPLE`` of each class, by a hash of the id), whole:
their words are counted on Spark, and only ``LANDMARKS`` landmarks and each document's values for them come to the driver; scoring is one scan of all texts, whole, with the model as a broadcast of fixed
size. Language, source and ids are no input of a score.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, kept_by_worker, staged, training_fold

ORDER, SPAN, DECAY = 3, 6, 0.7
SAMPLE = 2_000
LANDMARKS = 128
LONGEST = 24  # longer words are cut in overlapping windows of this many characters
SLOTS = 1 << 18
CACHE_WORDS = 250_000
PENALTY = 10.0
POWERS = (3, 12)  # powers of a kernel are kernels: the lower one sees altered words, the higher one near-exact ones
ALTERED_WEIGHT = 0.25  # of the copies of toxic training sentences whose landmark words get a character put in

_SINGLES = re.compile(r"(?<![^\W_])(?:[^\W_][\W_]{1,3}){2,}[^\W_](?![^\W_])")
_OTHER = re.compile(r"[\W_]+")
_TRIPLES = [(b, c) for b in range(1, SPAN) for c in range(b + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (c + 1) for _, c in _TRIPLES], dtype=np.float32)
LOOKS_LIKE = str.maketrans("01345", "oieas")  # fixed values: digits that stand for letters
START, END = "\x02", "\x03"


def word_parts(words: Iterable[str]) -> list[str]:
    """Stripped words with their bounds, long ones in windows."""
    out = []
    for w in words:
        w = START + w + END
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return out


def distinct_words(text: str) -> set[str]:
    """The different words of a text as the kernel reads them."""
    lowered = text.lower()
    found = {w if w.isalpha() else _OTHER.sub("", w.translate(LOOKS_LIKE)) for w in set(lowered.split())}
    found |= {_OTHER.sub("", m) for m in _SINGLES.findall(lowered)}
    found.discard("")
    return found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, weight) of each triple [words x places] of words of at most ``LONGEST`` characters; weight 0 where there is none."""
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max(initial=1))
    codes = np.zeros((len(words), width + SPAN), dtype=np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes[np.repeat(np.arange(len(words)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    first, second, third = (codes * np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
    slots = np.empty((len(words), len(_TRIPLES) * width), dtype=np.int32)
    weights = np.empty(slots.shape, dtype=np.float32)
    for n, ((b, c), w) in enumerate(zip(_TRIPLES, _WEIGHTS, strict=True)):
        mixed = (first[:, :width] ^ second[:, b : b + width]) * np.uint64(0xD6E8FEB86659FD93) + third[:, c : c + width]
        slots[:, n * width : (n + 1) * width] = mixed >> np.uint64(46)  # 18 bits
        weights[:, n * width : (n + 1) * width] = np.where(codes[:, c : c + width] > 0, w, 0)
    return slots, weights


def _norms(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of each word's kernel with itself: weights of equal triples are added before they are squared."""
    order = np.argsort(slots, axis=1)
    s, w = np.take_along_axis(slots, order, 1), np.take_along_axis(weights, order, 1).astype(np.float64)
    new = np.ones(s.shape, dtype=bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, weights=w.ravel())
    return np.sqrt(np.bincount(np.repeat(np.arange(len(s)), s.shape[1])[new.ravel()], weights=sums**2, minlength=len(s)))


@dataclass
class Kernel:
    """Kernel values of words with the landmarks. ``table`` [slots of the landmarks' triples x landmarks], ``place``: its row per slot, 0: none."""

    landmarks: list[str]
    place: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        slots, weights = subsequences(self.landmarks)
        norms = _norms(slots, weights)
        used = np.unique(slots[weights > 0])
        self.place = np.zeros(SLOTS, dtype=np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(self.landmarks)), dtype=np.float32)
        rows = np.broadcast_to(np.arange(len(self.landmarks))[:, None], slots.shape)
        np.add.at(self.table, (self.place[np.where(weights > 0, slots, 0)] * (weights > 0), rows), weights / np.maximum(norms, 1e-9)[:, None])
        self.table[0] = 0
        self.most = self.table.max(axis=1)

    def of(self, words: list[str], least: float = 0.0) -> np.ndarray:
        """[words x landmarks], each value between 0 and 1; values under ``least`` are 0."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        for at in range(0, len(words), 512):
            slots, weights = subsequences(words[at : at + 512])
            rows = self.place[slots]
            # a word's norm is at least that of its triples taken one by one, and no landmark gets more than the largest
            # entry of each triple: most words are settled by these two numbers
            bound = np.sqrt(np.square(weights).sum(axis=1))
            near = np.flatnonzero((self.most[rows] * weights).sum(axis=1) >= np.maximum(least * bound, 1e-9))
            if len(near):
                word, col = np.nonzero(rows[near] * (weights[near] > 0))
                first = np.flatnonzero(np.concatenate(([True], np.diff(word) > 0)))
                raw = np.add.reduceat(self.table[rows[near][word, col]] * weights[near][word, col][:, None], first, axis=0)
                values = raw / _norms(slots[near], weights[near])[:, None]
                out[at + near] = np.where(values >= least, values, 0)
        return out


@dataclass
class Model:
    kernel: Kernel
    whiten: list[np.ndarray]  # per power of the kernel, K^(-1/2) of the landmarks
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, largest: np.ndarray) -> np.ndarray:
        """Probabilities from documents' largest kernel values [documents x landmarks]."""
        margin = coordinates(largest, self.whiten) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def coordinates(largest: np.ndarray, whiten: list[np.ndarray]) -> np.ndarray:
    return np.hstack([largest.astype(np.float64) ** p @ w for p, w in zip(POWERS, whiten, strict=True)])


def _inverse_root(k: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    return vectors @ np.diag(np.where(values > 1e-2, 1 / np.sqrt(np.maximum(values, 1e-2)), 0)) @ vectors.T


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the examples inside the margin. ``y``: -1 or 1."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(z.shape[1]), PENALTY * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-8
    for _ in range(50):
        inside = y * (z @ w) < 1
        a = z[inside] * cost[inside, None]
        new = np.linalg.solve(a.T @ z[inside] / len(x) + ridge / len(x), a.T @ y[inside] / len(x))
        if np.allclose(new, w, atol=1e-8):
            break
        w = (new + w) / 2 if _ > 20 else new
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with P(label 1 | margin), targets smoothed, examples weighted by ``share``, by Newton steps."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z, w = np.stack((margin, np.ones_like(margin)), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (share * (p - target)))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


@dataclass
class Sample:
    """Labelled documents as their largest kernel values; ``altered``: those of the documents of label 1 with their landmark words altered."""

    kernel: Kernel | None
    labels: np.ndarray
    largest: np.ndarray
    altered: np.ndarray


def choose_landmarks(texts: DataFrame) -> list[str]:
    """The words of (``text``, ``label``) that tell the classes apart best, by weighted log odds of the documents that hold them; ties by the word. A landmark is one window of the kernel at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label"), strict=True):
                words = list(distinct_words(text.as_py()))
                yield pa.record_batch([pa.array(words, pa.string()), pa.array([label.as_py()] * len(words), pa.int64())], names=["word", "label"])

    n1, n0 = texts.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    counts = texts.select("text", "label").mapInArrow(run, "word string, label long").groupBy("word").agg(F.count_if(F.col("label") > 0).alias("a"), F.count_if(F.col("label") <= 0).alias("b"))
    p, q = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    ranked = counts.where((F.col("a") > 1) & (F.char_length("word") + 2 <= LONGEST)).withColumn("weight", F.when(p > q, (p - q) * F.log(p / q)).otherwise(0.0))
    return [r["word"] for r in ranked.orderBy(F.desc("weight"), "word").limit(LANDMARKS).collect()]


def fit(sample: Sample, share_of_1: float) -> Model | None:
    """The model from documents' largest kernel values; None unless both labels occur and some word is shared by two of label 1.

    ``share_of_1`` of all labels, not of the sample, is what the probabilities are calibrated to.
    """
    kernel = sample.kernel
    if kernel is None or len(np.unique(sample.labels)) < 2:
        return None
    own = kernel.of(kernel.landmarks).astype(np.float64)
    whiten = [_inverse_root(own**p) for p in POWERS]
    x = coordinates(np.concatenate((sample.largest, sample.altered)), whiten)
    y = np.array([1.0 if y else -1.0 for y in sample.labels] + [1.0] * len(sample.altered))
    n = len(sample.labels)
    share = np.where(np.arange(len(y)) < n, 1.0, ALTERED_WEIGHT)
    cost = share * np.where(y > 0, share.sum() / (2 * share[y > 0].sum()), share.sum() / (2 * share[y < 0].sum()))
    fold = np.arange(n) % 5
    fold = np.concatenate((fold, fold[y[:n] > 0]))
    margin = np.zeros(len(y))
    for f in range(5):  # margins for the calibration come from models that have not seen the document
        w, b = _svm(x[fold != f], y[fold != f], cost[fold != f])
        margin[fold == f] = x[fold == f] @ w + b
    balance = np.where(y[:n] > 0, share_of_1 / (y[:n] > 0).mean(), (1 - share_of_1) / (y[:n] < 0).mean())
    slope, offset = _calibrate(margin[:n], y[:n], balance)
    w, b = _svm(x, y, cost)
    return Model(kernel, whiten, w, b, slope, offset)


def _altered(word: str) -> str:
    """The word with one letter put in, at a place and of a kind that depend on the word alone."""
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    at = 1 + h % max(1, len(word) - 1)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[h // 97 % 26] + word[at:]


class Largest:
    """Documents' largest kernel values; words met lately are remembered (as nothing where no landmark resembles them)."""

    LEAST = 0.4  # chance resemblance

    def __init__(self, kernel: Kernel) -> None:
        self.kernel = kernel
        self.new: dict[str, np.ndarray | None] = {}
        self.old: dict[str, np.ndarray | None] = {}

    def of(self, documents: Iterable[Iterable[str]]) -> np.ndarray:
        """[documents x landmarks]; words that are new are worked out together, for some documents at a time."""
        out, waiting = [], []
        for words in documents:
            waiting.append(words)
            if len(waiting) == 256:
                out += self._some(waiting)
                waiting = []
        out += self._some(waiting)
        return np.stack(out) if out else np.zeros((0, len(self.kernel.landmarks)), dtype=np.float32)

    def _some(self, documents: list[Iterable[str]]) -> list[np.ndarray]:
        missing = set()
        for words in documents:
            for w in words:
                if w not in self.new:
                    if w in self.old:
                        self.new[w] = self.old[w]
                    else:
                        missing.add(w)
        missing = list(missing)
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for w, v in zip(part, self._values(part), strict=True):
                self.new[w] = v.astype(np.float16) if v.any() else None
        none = np.zeros(len(self.kernel.landmarks), dtype=np.float32)
        out = []
        for words in documents:
            found = [v for v in map(self.new.__getitem__, words) if v is not None]
            out.append(np.max(found, axis=0).astype(np.float32) if found else none)
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        return out

    def _values(self, words: list[str]) -> np.ndarray:
        parts = [word_parts([w]) for w in words]
        values = self.kernel.of([p for ps in parts for p in ps], self.LEAST)
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        return np.maximum.reduceat(values, starts, axis=0)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> tuple[Sample, float]:
    """At most ``SAMPLE`` training documents of each class, those with the smallest hash of their id, described by all their words; and the share of label 1 among all training labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where((training_fold(F.col(id_col), folds) != 0) & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0] or 0.0
    ids = None
    for of_class in (F.col("label") > 0, F.col("label") <= 0):
        part = known.where(of_class).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        ids = part if ids is None else ids.unionByName(part)

    # the sample's size is a parameter of this module, so it is small enough to broadcast whatever the tables' sizes are;
    # of rows that share an id the text with the smallest hash counts, so that the sample has one row per id
    texts = documents_of(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").groupBy("doc_id", F.col("label").cast("long").alias("label")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = staged(texts, "toxicity-sample")
    chosen = word_parts(choose_landmarks(texts))
    none = np.zeros((0, len(chosen)), dtype=np.float32)
    if not chosen:
        return Sample(None, np.zeros(0, dtype=np.int64), none, none), share
    kernel, marked = Kernel(chosen), {w.strip(START + END) for w in chosen}
    held = docs.sparkSession.sparkContext.broadcast(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Largest(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                words, toxic = [distinct_words(t.as_py()) for t in part.column("text")], [y.as_py() > 0 for y in part.column("label")]
                altered = iter(memory.of([_altered(w) if w in marked else w for w in ws] for ws, y in zip(words, toxic, strict=True) if y))
                values = pa.array(list(memory.of(words)), pa.list_(pa.float32()))
                yield pa.record_batch([part.column("key"), part.column("label"), values, pa.array([next(altered) if y else None for y in toxic], pa.list_(pa.float32()))], names=["key", "label", "largest", "altered"])

    # in an order of its own, so that the folds of the fit do not depend on partitions
    found = texts.select(F.concat_ws(" ", F.hex(F.xxhash64("doc_id")), F.hex(F.xxhash64("text"))).alias("key"), "label", "text").mapInArrow(run, "key string, label long, largest array<float>, altered array<float>")
    rows = sorted(((r["key"], int(r["label"] > 0), np.array(r["largest"], dtype=np.float32), r["altered"] and np.array(r["altered"], dtype=np.float32)) for r in found.toLocalIterator()), key=lambda r: r[:2])
    return Sample(kernel, np.array([r[1] for r in rows]), np.stack([r[2] for r in rows]), np.stack([r[3] for r in rows if r[1]]) if any(r[1] for r in rows) else none), share


def _model(name: str, held) -> tuple[Model, Largest]:
    """A worker's model; what it remembers serves all its tasks."""
    return kept_by_worker(("toxicity", name), lambda: (held.value, Largest(held.value.kernel)))


def score_texts(docs: DataFrame, model: Model | None, prior: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, one row per input row. Null and empty texts have no words and get the score of a text that resembles no landmark; without a model every score is ``prior``."""
    plain = documents_of(docs, id_col, text_col)
    if model is None:
        return plain.select("doc_id", F.lit(float(prior)).alias("score"))
    name, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, memory = _model(name, held)
        for b in batches:
            largest = memory.of(distinct_words(t.as_py()) for t in b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(fitted.score(largest), pa.float64())], names=["doc_id", "score"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Labels of the held-out fold (crc32 of the id modulo ``folds`` is 0) are never read. Rows may repeat or lack an id;
    several labels of one id count as their largest. Without labels of both kinds the score is the share of label 1
    among the labels that there are (0 if none). Null and empty texts get the score of a text that resembles no
    landmark; texts of any length are read whole. An empty table gives no rows; other columns are not read.
    """
    sample, share = labelled_sample(docs, labels, id_col, text_col, folds=folds)
    scored = score_texts(docs, fit(sample, share), share, id_col, text_col)
    return scored.select("doc_id", (training_fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``reject_from``, with all their columns, whatever their names.

    Null and empty texts resemble no landmark and stay, as do all rows where the labels do not allow a model. Rows that
    repeat go or stay together; an empty table gives no rows. Rows pass through the scan in batches; nothing is shuffled.
    """
    model = fit(*labelled_sample(docs, labels, id_col, text_col))
    if model is None:
        return docs
    name, held = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, memory = _model(name, held)
        for b in batches:
            scores = fitted.score(memory.of(distinct_words(t.as_py() or "") for t in b.column(at)))
            yield b.filter(pa.array(scores < reject_from))

    return docs.mapInArrow(run, docs.schema)
