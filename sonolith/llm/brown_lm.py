"""Class-based bigram model (Brown classes by exchange clustering) for scoring texts.

P(word | previous) = P(class | class of previous) * P(word | class). Words and an end token per text are counted over
all training documents. Clustering moves *units*: the ``UNITS`` most frequent words each by itself, all other words
together with those of the same ending (``GROUPS`` hashed endings), so that every word, seen or not, has a class that
a task can tell without a table of all words. Exchange runs on the counts of neighbouring units: in each round every
other unit goes to the class in which the class bigram likelihood gains most, its own counts taken out of its present
class. As half of the units move at once, the likelihood of the whole is worked out after each round, a round that
lowers it is undone, and the rounds end when neither half gains ``LEAST_GAIN`` a token any more. Rounds are maps over the
table of units' contexts, whose rows are bounded by the number of units.

Emission is discounted by D = n1 / (n1 + 2 n2): a known word gets (c - D) / N_class, what is left in a class goes to
its one unknown word. Transitions are interpolated with class frequencies. All probabilities of a history add up to 1.

Scoring: the ``HEAVY`` most frequent words' counts travel to the tasks (a bounded number). All other words of a text
meet the complete word table in a join; what they add to a text's score is additive, so the join returns sums only.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, staged, training_fold

UNITS = 12_288
GROUPS = 1_024
HEAVY = 65_536
CLASSES = 64
MOST_ROUNDS, LEAST_GAIN = 40, 1e-4  # of nats a token
FOLDS = 10
PRIOR = 5.0  # weight of the class frequencies in the transitions
FLUSH = 200_000  # different words, or
FLUSH_TOKENS = 2_000_000  # tokens that a task counts before it hands them on
END = "\n"  # cannot be a word: words hold no white space


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def group_of(word: bytes) -> int:
    """The hashed ending of a word."""
    return zlib.crc32(word[-3:]) % GROUPS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for b in batches:
        for t in b.column("text"):
            yield tokens(t.as_py())


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) over all texts, with the end token once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for words in _texts(batches):
            held.update(words)
            held[END.encode()] += 1
            if len(held) >= FLUSH:
                yield out()
                held.clear()
        if held:
            yield out()

    return training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words: ``heavy`` gives a word's place, ``counts`` its count and ``unit`` its unit. Unit 0 is the end, then come the words that are units, then the groups."""

    heavy: dict[bytes, int]
    counts: np.ndarray
    unit: np.ndarray
    n_units: int
    first_group: int
    end_count: int

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(unit of every word, its place among the heavy words or -1)."""
        get = self.heavy.get
        place = np.array([get(w, -1) for w in words], dtype=np.int64)
        unit = self.unit[place]
        for i in np.flatnonzero(place < 0):
            unit[i] = self.first_group + group_of(words[i])
        return unit, place


def vocabulary(counts: DataFrame, end_count: int) -> Vocabulary:
    """Takes the ``HEAVY`` most frequent words. Words are counted by steps of an eighth of an octave; of the step in which the number is reached those with the smallest hash are taken."""
    words = counts.where(F.col("word") != END)
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    cut, n, rows = None, 0, []
    for s, k in sorted(((r[0], r[1]) for r in words.groupBy(step.alias("s")).count().collect()), reverse=True):
        if n + k > HEAVY:
            # of hashes spread evenly, about a third more than are needed lie below this one
            below = int(2**64 * min(1.0, ((HEAVY - n) * 1.3 + 1_000) / k)) - 2**63
            hashed = words.where(step == s).withColumn("h", F.xxhash64("word")).where(F.col("h").cast("decimal(20,0)") < F.lit(str(below)).cast("decimal(20,0)"))
            rows = sorted(hashed.collect(), key=lambda r: r["h"])[: HEAVY - n]
            break
        n, cut = n + k, s
    rows += words.where(step >= cut).collect() if cut is not None else []
    rows.sort(key=lambda r: (-r["c"], r["word"]))
    heavy = {r["word"].encode(): i for i, r in enumerate(rows)}
    first_group = 1 + min(UNITS, len(rows))
    unit = [1 + i if i < UNITS else first_group + group_of(r["word"].encode()) for i, r in enumerate(rows)]
    return Vocabulary(heavy, np.array([r["c"] for r in rows], dtype=np.int64), np.array([*unit, 0], dtype=np.int64), first_group + GROUPS, first_group, end_count)


def unit_bigrams(training: DataFrame, words: Vocabulary) -> DataFrame:
    """(left, right, n): neighbouring units over all texts; every text stands between two ends."""
    held_words = training.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held_words.value
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array((pairs // v.n_units).astype(np.int32)), pa.array((pairs % v.n_units).astype(np.int32)), pa.array(n)], names=["left", "right", "n"])

        for ws in _texts(batches):
            around = np.concatenate(([0], v.units(ws)[0], [0]))
            held.append(around[:-1] * v.n_units + around[1:])
            size += len(ws) + 1
            if size >= FLUSH_TOKENS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return training.select("text").mapInArrow(run, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def contexts(bigrams: DataFrame) -> DataFrame:
    """One row per unit: its neighbours ``after`` and ``before`` it (at most the number of units each) with counts ``n_after`` and ``n_before``, and ``half``, the rounds in which it may move.

    Sums of classes read the neighbours after only, and a round only its half, so that neither is read for nothing.
    """
    ends = [bigrams.select(F.col(unit).alias("unit"), F.lit(after).alias("is_after"), F.col(other).alias("other"), "n") for unit, other, after in (("left", "right", True), ("right", "left", False))]
    lists = [F.collect_list(F.when(F.col("is_after") == after, F.col(c))).alias(name) for c, name, after in (("other", "after", True), ("n", "n_after", True), ("other", "before", False), ("n", "n_before", False))]  # nulls are left out
    both = ends[0].unionByName(ends[1]).groupBy("unit").agg(*lists)
    return both.select("*", F.pmod(F.crc32(F.col("unit").cast("string").cast("binary")), F.lit(2)).cast("int").alias("half"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The unit and the other columns' lists as arrays."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("unit")[i].as_py(), *(b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in b.schema.names[1:])


def _class_bigrams(table: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes, added up per task."""
    held = table.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((CLASSES, CLASSES), dtype=np.int64)
        for unit, after, n in _rows(batches):
            m[held.value[unit]] += np.bincount(held.value[after], weights=n, minlength=CLASSES).astype(np.int64)
        a, b = np.nonzero(m)
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m[a, b])], names=["a", "b", "n"])

    m = np.zeros((CLASSES, CLASSES))
    for r in table.select("unit", "after", "n_after").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        m[r["a"], r["b"]] = r["n"]
    return m


def best_class(left: np.ndarray, right: np.ndarray, now: int, m: np.ndarray) -> int:
    """The class (never 0, the end's) in which a unit with these class contexts gains most. Ties: the smaller number."""
    total = left.sum()
    rest = m.copy()  # without the unit itself, where it is now
    rest[:, now] = np.maximum(rest[:, now] - left, 0)
    rest[now, :] = np.maximum(rest[now, :] - right, 0)
    logs = np.log(rest + 0.05)
    gain = left @ logs + logs @ right - total * (np.log(rest.sum(axis=0) + 1) + np.log(rest.sum(axis=1) + 1))
    gain[0] = -np.inf
    return int(np.argmax(gain))


def _exchange(table: DataFrame, classes: np.ndarray, m: np.ndarray, turn: int) -> dict[int, int]:
    held = table.sparkSession.sparkContext.broadcast((classes, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, counts = held.value
        moved: list[tuple[int, int]] = []
        for unit, after, n_after, before, n_before in _rows(batches):
            left = np.bincount(cls[before], weights=n_before, minlength=CLASSES)
            right = np.bincount(cls[after], weights=n_after, minlength=CLASSES)
            moved.append((unit, best_class(left, right, int(cls[unit]), counts)))
        yield pa.record_batch([pa.array([x for x, _ in moved], pa.int32()), pa.array([y for _, y in moved], pa.int32())], names=["unit", "to"])

    moving = table.where((F.col("unit") != 0) & (F.col("half") == turn % 2)).select("unit", "after", "n_after", "before", "n_before")
    return {r["unit"]: r["to"] for r in moving.mapInArrow(run, "unit int, to int").collect()}


def likelihood(m: np.ndarray) -> float:
    """What of the log likelihood of a text depends on the classes, from the counts of neighbouring classes (in nats)."""
    part = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return part(m) - part(m.sum(axis=0)) - part(m.sum(axis=1))


def cluster(table: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(class of every unit, class bigram counts). Starts with units dealt round by frequency rank, so each class holds one of the most frequent words."""
    classes = 1 + np.arange(words.n_units) % (CLASSES - 1)
    classes[0] = 0
    m, idle = _class_bigrams(table, classes), 0
    for turn in range(MOST_ROUNDS):
        trial = classes.copy()
        for unit, to in _exchange(table, classes, m, turn).items():
            trial[unit] = to
        counts = _class_bigrams(table, trial)
        gain = likelihood(counts) - likelihood(m)
        idle = 0 if gain > LEAST_GAIN * m.sum() else idle + 1
        if gain > 0:
            classes, m = trial, counts
        if idle == 2:
            break
    return classes, m


@dataclass
class Model:
    words: Vocabulary
    classes: np.ndarray  # of units
    transition: np.ndarray  # log10, [class before, class]
    heavy_emission: np.ndarray  # log10, per heavy word
    unknown: np.ndarray  # log10 emission of the unknown word, per class
    discount: float
    class_total: np.ndarray
    train_tokens: int
    denominator: float


def _finish(counts: DataFrame, words: Vocabulary, classes: np.ndarray, m: np.ndarray, n: int, v: int) -> Model:
    once = {r["c"]: r["k"] for r in counts.where("c <= 2").groupBy("c").agg(F.count("*").alias("k")).collect()}
    n1, n2 = once.get(1, 0), once.get(2, 0)
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    per_class = _known_per_class(counts, words, classes)
    total, kinds = per_class[:, 0], per_class[:, 1]
    # an ending that training has not seen goes to the class with the most tokens
    seen_units = total[classes] > 0
    classes = np.where(seen_units, classes, int(np.argmax(total[1:])) + 1 if len(total) > 1 and total[1:].any() else 0)
    frequency = (total + 0.5) / (total + 0.5).sum()
    transition = np.log10((m + PRIOR * frequency[None, :]) / (m.sum(axis=1, keepdims=True) + PRIOR))
    with np.errstate(divide="ignore"):
        unknown = np.where((kinds > 0) & (total > 0), np.log10(discount * np.maximum(kinds, 1) / np.maximum(total, 1)), math.log10(discount / (n + 1)))
        heavy_class = classes[words.unit[:-1]]
        emission = np.log10(words.counts - discount) - np.log10(np.maximum(total[heavy_class], 1))
    return Model(words, classes, transition, emission, unknown, discount, total, n, n + 0.1 * (v + 1))


def _known_per_class(counts: DataFrame, words: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """Per class the number of training tokens and of different words."""
    held = counts.sparkSession.sparkContext.broadcast((words, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cls = held.value
        total, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for b in batches:
            c = b.column("c").to_numpy(zero_copy_only=False)
            of = cls[v.units([w.as_py().encode() for w in b.column("word")])[0]]
            total += np.bincount(of, weights=c, minlength=CLASSES).astype(np.int64)
            kinds += np.bincount(of, minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total), pa.array(kinds)], names=["k", "total", "kinds"])

    out = np.zeros((CLASSES, 2))
    for r in counts.where(F.col("word") != END).select("word", "c").mapInArrow(run, "k int, total long, kinds long").groupBy("k").agg(F.sum("total").alias("t"), F.sum("kinds").alias("v")).collect():
        out[r["k"]] = r["t"], r["v"]
    out[0] = words.end_count, 1
    return out


def _rare_words(counts: DataFrame, held) -> DataFrame:
    """(word, known, base_gain, gain) of the words that are not heavy: what they add to a score that has taken them for unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for b in batches:
            ws = [w.as_py().encode() for w in b.column("word")]
            unit, place = m.words.units(ws)
            keep = np.flatnonzero(place < 0)
            c = b.column("c").to_numpy(zero_copy_only=False)[keep].astype(np.float64)
            k = m.classes[unit[keep]]
            gain = np.log10(c - m.discount) - np.log10(np.maximum(m.class_total[k], 1)) - m.unknown[k]
            base = np.log10(c + 0.1) - math.log10(0.1)
            yield pa.record_batch([b.column("word").take(pa.array(keep)), pa.array(np.ones(len(keep), dtype=np.int64)), pa.array(base), pa.array(gain)], names=["word", "known", "base_gain", "gain"])

    return counts.where(F.col("word") != END).select("word", "c").mapInArrow(run, "word string, known long, base_gain double, gain double")


PARTIAL = "word string, n long, n_tokens long, n_known long, base double, score double"


def _partial_scores(docs: DataFrame, held) -> DataFrame:
    """Per text one row with what its heavy words give and all others as unknown, and one row for each different other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        v = m.words
        heavy_base = np.log10(np.append(v.counts, 0) + 0.1) - math.log10(m.denominator)  # the last: unknown
        end_base = math.log10((v.end_count + 0.1) / m.denominator)
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                row, word, n, n_tokens, n_known, base, score = [], [], [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    ws = tokens(text.as_py())
                    unit, place = v.units(ws)
                    cls = np.concatenate(([0], m.classes[unit], [0]))
                    heavy = place >= 0
                    rest = Counter(ws[j] for j in np.flatnonzero(~heavy))
                    row.append(i)
                    word.append(b"\n%d" % (start + i))  # meets no word, and deals these rows out
                    n.append(0)
                    n_tokens.append(len(ws) + 1)
                    n_known.append(int(heavy.sum()) + (v.end_count > 0))
                    base.append(float(heavy_base[place].sum()) + end_base)
                    score.append(float(m.transition[cls[:-1], cls[1:]].sum() + m.heavy_emission[place[heavy]].sum() + m.unknown[cls[1:-1][~heavy]].sum()))
                    row += [i] * len(rest)
                    word += rest
                    n += rest.values()
                    for x, zero in ((n_tokens, 0), (n_known, 0), (base, 0.0), (score, 0.0)):
                        x += [zero] * len(rest)
                take = pa.array(row, pa.int64())
                yield pa.record_batch([part.column("row_no").take(take), part.column("doc_id").take(take), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["row_no", "doc_id", "word", "n", "n_tokens", "n_known", "base", "score"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    return numbered.mapInArrow(run, f"row_no long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PARTIAL}")


def fit(training: DataFrame, counts: DataFrame) -> Model | None:
    """The model of the texts of ``training``, whose words' ``counts`` are a written table; None without any token."""
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    if not size["n"]:
        return None
    words = vocabulary(counts, size["ends"])
    table = staged(contexts(unit_bigrams(training, words)), "contexts")
    return _finish(counts, words, *cluster(table, words), size["n"], size["v"])


def class_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``, one row per input row.

    Learns from the documents whose crc32 of the id modulo ``FOLDS`` is not 0 (a null id counts as empty text). Null
    and empty texts consist of the end token. Rows may repeat or lack an id; other columns are not read. Without
    training documents every token has probability 1 under the base (its formula's value) and under the model. An
    empty table gives no rows.
    """
    plain = documents_of(docs, id_col, text_col)
    fold = training_fold(F.col("doc_id"), FOLDS)
    training = plain.where(fold != 0)
    counts = staged(count_words(training), "word-counts")
    head = (F.col("doc_id"), (fold == 0).alias("held_out"))
    model = fit(training, counts)
    if model is None:
        words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
        return plain.select(*head, (F.size(words) + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.lit(1.0).alias("perplexity"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    joined = _partial_scores(plain, held).join(_rare_words(counts, held), "word", "left")
    more = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    sums = joined.groupBy("row_no", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + more("known")).cast("long").alias("n_known"),
        (F.sum("base") + more("base_gain")).alias("base_score"),
        (F.sum("score") + more("gain")).alias("score"),
    )
    return sums.select(*head, "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
