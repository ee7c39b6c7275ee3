"""Repeated passages by sliding sentence spans.

A text is cut into sentences (at ``.``, ``!`` or ``?`` before white space, and at line ends); a span is a run of
consecutive sentences with at least ``min_sentences`` sentences and at least ``min_words`` words, of any length. Spans
are compared by 128 bits of hash over their words (case and spacing of the text do not matter), joined over the whole
table, and every sentence covered by an occurrence that is not the first (smallest document id, then position) is
removed.

Of all runs two a sentence have to be hashed, the shortest that starts and the shortest that ends with it. Any longer
run is covered by those inside it, they repeat wherever it repeats, and where it is not the first neither are they; so
they remove exactly what all runs would (the tests compare the two).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, join_spread, staged

MIN_SENTENCES = 2
MIN_WORDS = 20
_CUT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def sentences_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, without the white space between them; none in a text of white space."""
    out, at = [], len(text) - len(text.lstrip())
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = max(at, m.end())
    if (end := len(text.rstrip())) > at:
        out.append((at, end))
    return out


def spans_of(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(number of sentences, spans as (first sentence, sentences, two halves of the hash))."""
    bounds = sentences_of(text)
    words = [text[a:b].casefold().split() for a, b in bounds]
    plain = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    sizes, runs, end, held = [len(w) for w in words], set(), 0, 0
    for i in range(len(bounds)):
        while end < len(bounds) and (end - i < min_sentences or held < min_words):
            held += sizes[end]
            end += 1
        if end - i < min_sentences or held < min_words:
            break  # what is left is too short for a span, and so is all after it
        runs.add((i, end - i))
        held -= sizes[i]
    start, held = 0, 0
    for end in range(1, len(bounds) + 1):
        held += sizes[end - 1]
        while end - start > min_sentences and held - sizes[start] >= min_words:
            held -= sizes[start]
            start += 1
        if end - start >= min_sentences and held >= min_words:
            runs.add((start, end - start))
    out = []
    for i, n in sorted(runs):
        digest = xxhash.xxh3_128_digest(b" ".join(plain[i : i + n]))
        out.append((i, n, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
    return len(bounds), out


def spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span of (``doc_id``, ``row_no``, ``text``): ``doc_id, row_no, at, n, h1, h2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                rows, found = [], []
                for k, text in enumerate(part.column("text")):
                    own = spans_of(text.as_py(), min_sentences, min_words)[1]
                    rows += [k] * len(own)
                    found += own
                take = pa.array(rows, pa.int64())
                at, n, h1, h2 = np.array(found, dtype=np.int64).reshape(-1, 4).T
                yield pa.record_batch([part.column("doc_id").take(take), part.column("row_no").take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["doc_id", "row_no", "at", "n", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_no", "text").mapInArrow(run, f"doc_id {kind}, row_no long, at int, n int, h1 long, h2 long")


def repeated_spans(numbered: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Every occurrence but the first of a span that occurs more than once in (``doc_id``, ``row_no``, ``text``): ``row_no, at, n``."""
    every = staged(spans(numbered, min_sentences, min_words), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no", "at")
    # counted per task before the shuffle, so a span that is in every other document is one row of each task
    counts = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n_all")).where("n_all > 1")
    known = staged(counts.select("h1", "h2", F.col("first.row_no").alias("first_row"), F.col("first.at").alias("first_at"), "n_all"), "repeated-spans")
    met = join_spread(every.select("h1", "h2", "row_no", "at", "n"), known, ["h1", "h2"], "n_all")
    return met.where((F.col("row_no") != F.col("first_row")) | (F.col("at") != F.col("first_at"))).select("row_no", "at", "n")


def _covered(runs: list, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, dtype=np.int64)
    for r in runs:
        marks[r["at"]] += 1
        marks[r["at"] + r["n"]] -= 1
    return np.cumsum(marks[:-1]) > 0


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, plain_scan: bool = False) -> DataFrame:
    """``doc_id, n_sentences, n_removed, text``: every text without its repeated sentences.

    Rows are numbered, and read twice by their numbers: unless ``docs`` is a ``plain_scan`` of files, which Spark
    numbers alike each time, the numbered table is written first.

    One row per input row. What stays of a text keeps its own spacing; a removed sentence goes with the white space
    after it. Texts without a span (short, empty, null, white space) stay as they are, null as empty. Of repeated
    rows the first keeps its passages. Rows without an id come after all others in the order of occurrences. An empty
    table gives no rows.
    """
    numbered = documents_of(docs, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id())
    numbered = numbered if plain_scan else staged(numbered, "numbered")
    gone = repeated_spans(numbered, min_sentences, min_words).groupBy("row_no").agg(F.collect_set(F.struct("at", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, runs in zip(b.column("text"), b.column("runs"), strict=True):
                text, runs = text.as_py(), runs.as_py() or []
                bounds = sentences_of(text)
                out = _covered(runs, len(bounds))
                total.append(len(bounds))
                removed.append(int(out.sum()))
                if out.any():
                    ends = [a for a, _ in bounds[1:]] + [len(text)]
                    text = text[: bounds[0][0]] + "".join(text[a:e] for (a, _), e, o in zip(bounds, ends, out, strict=True) if not o)
                kept.append(text)
            yield pa.record_batch([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_sentences", "n_removed", "text"])

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.join(gone, "row_no", "left").select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {kind}, n_sentences long, n_removed long, text string")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_scan: bool = False) -> DataFrame:
    """Per document: sentences, removed sentences, and length and hash of what stays."""
    done = remove_repeated(docs, id_col, text_col, plain_scan=plain_scan)
    return done.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
