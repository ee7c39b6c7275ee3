"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Every run of ``window`` item words is a pattern; a shorter item is one pattern. The automaton's alphabet are the
benchmark's different words, each as a number, and one number for all other words, which leads back to the start. So a
pattern only matches whole words, a document is scanned once, word by word, and a match is mapped back through the
words' places to offsets in the original text.

Up to ``BLOCK_WORDS`` words of items there is one automaton. Longer benchmarks are cut into blocks of that size with an
automaton each, as a worker's memory is bounded; a task then scans the documents that it holds (``HELD_CHARS`` of
text at a time) with one after the other.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, kept_by_worker

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BLOCK_WORDS = 400_000
HELD_CHARS = 64_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class Patterns:
    """The automaton over all windows of some items; each window carries its number of words and its item ids."""

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int) -> None:
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        self.number: dict[str, int] = {}
        for item_id, words in items:
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for i in range(max(1, len(words) - window + 1)):
                owners[tuple(numbers[i : i + window])].add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, ids in owners.items():
            self.automaton.add_word(run, (len(run), tuple(sorted(ids))))
        self.automaton.make_automaton()

    def scan(self, words: list[str]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """Matches in a document's words as (first word, word after the last, item ids)."""
        get = self.number.get
        for last, (n, ids) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            yield last + 1 - n, last + 1, ids


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """Broadcast automata, each over a bounded number of item words; the driver builds one at a time. Items without words have no pattern."""
    sc = benchmark.sparkSession.sparkContext
    held, n, out = [], 0, []

    def close() -> None:
        if held:
            out.append((uuid.uuid4().hex, sc.broadcast(pickle.dumps(Patterns(held, window)))))
            held.clear()

    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        if words := words_of(row[1]):
            held.append((row[0], words))
            n += len(words)
        if n >= BLOCK_WORDS:
            close()
            n = 0
    close()
    return out


def _patterns(name: str, held) -> Patterns:
    """The patterns of a block; a worker keeps one block at a time."""
    return kept_by_worker(("patterns", name), lambda: pickle.loads(held.value))


def _held(batches: Iterator[pa.RecordBatch], at: int | str, blocks: list) -> Iterator[tuple[list[pa.RecordBatch], list[list[str]]]]:
    """Batches with their texts' words: one at a time, or with several blocks as many as ``HELD_CHARS`` allow."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if len(blocks) < 2 or size >= HELD_CHARS:
            yield held, [words_of(t.as_py()) for x in held for t in x.column(at)]
            held, size = [], 0
    if held:
        yield held, [words_of(t.as_py()) for x in held for t in x.column(at)]


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def find_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans``: hit words, the items found (ids as strings, sorted) and the hit stretches of the original text (code points, end exclusive).

    One row per input row; null and wordless texts have no words and no hits, as have all documents where the
    benchmark is empty. A null item id counts as the empty string, rows that repeat an item as one. No shuffle: the
    documents are scanned where they lie. Other columns are not read, whatever their names.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words in _held(batches, "text", blocks):
            found: list[list] = [[] for _ in words]
            for block in blocks:
                patterns = _patterns(*block)
                for hits, ws in zip(found, words, strict=True):
                    hits += patterns.scan(ws)
            texts = (t for b in held for t in b.column("text"))
            rows = [_result(t.as_py() if hits else "", len(ws), hits) for t, ws, hits in zip(texts, words, found, strict=True)]
            out = pa.RecordBatch.from_pylist(rows, schema=_OUT)
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.slice(at, b.num_rows).columns], names=["doc_id", *_OUT.names])
                at += b.num_rows

    plain = documents_of(docs, id_col, text_col)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def _result(text: str, n_words: int, hits: list) -> dict:
    spans = merged((a, b) for a, b, _ in hits)
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))] if spans else []
    return {
        "n_words": n_words,
        "n_hit": sum(b - a for a, b in spans),
        "item_ids": sorted({i for *_, ids in hits for i in ids}),
        "spans": [{"start": places[a][0], "end": places[b - 1][1]} for a, b in spans],
    }


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Per document: words, hit words, items found, the hash of their ids, and whether there is any hit."""
    found = find_overlap(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns.

    Null, empty and wordless texts stay, and all rows where the benchmark has no words; rows that repeat go or stay
    together. Columns may have any names. Rows pass through the scan in batches, so that no text is shuffled and rows
    that share an id are told apart.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    if not blocks:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words in _held(batches, at, blocks):
            clean = [True] * len(words)
            for block in blocks:
                patterns = _patterns(*block)
                clean = [c and next(patterns.scan(ws), None) is None for c, ws in zip(clean, words, strict=True)]
            start = 0
            for b in held:
                yield b.filter(pa.array(clean[start : start + b.num_rows], pa.bool_()))
                start += b.num_rows

    return docs.mapInArrow(run, docs.schema)
