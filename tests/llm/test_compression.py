"""The compression bands against counts by hand, and what they keep and reject."""

import base64
import collections
import random

import zstandard
from pyspark.sql import functions as F

from sonolith.llm import compression, queries

WHITE = "\t\n\x0b\x0c\r "


def words_of(text):
    out = [""]
    for c in text:
        if c in WHITE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def by_hand(text):
    text = text or ""
    words = words_of(text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    again = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = text.split("\n")
    dup = sum(any(x == lines[j] for j in range(i)) for i, x in enumerate(lines) if words_of(x))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)


def verdict(text, failed):
    """From the definition: whole and chunks against the table of bands."""

    def fits(data):
        found = len(data) / len(zstandard.ZstdCompressor(level=3).compress(data)) if data else 1.0
        return next(low <= found <= high for most, low, high in compression.BANDS if most is None or len(data) <= most)

    data = (text or "").encode()
    parts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    return not failed and fits(data) and 4 * sum(len(p) for p in parts if not fits(p)) <= len(data)


def test_op12_against_counts_by_hand(spark, sf):
    got = queries.QUERIES["op12_compression_bands"](spark, sf)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        hand = by_hand(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == hand
        assert r["kept"] == verdict(texts[r["doc_id"]], hand[-1])


def test_op12_keeps_what_is_labelled_good(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = queries.QUERIES["op12_compression_bands"](spark, sf).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert judged.where("NOT kept").count() == 0 < judged.count()


def test_bands_reject_repeats_and_noise(spark, sf):
    r = random.Random(1)
    prose = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 5000 and 9000").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").first()["text"]
    vocabulary = words_of(prose)
    noise = " ".join(base64.b64encode(r.randbytes(30)).decode() for _ in range(200))
    cases = {
        "prose": (prose, True),
        "noise": (noise, False),
        "repeats": (" ".join(f"{k} {w}" for k, w in zip(cycled(vocabulary[:4], 3000), cycled(vocabulary[:7], 3000), strict=True)), False),
        "noise inside": (prose + "\n" + noise[:4000], False),
        "a little noise inside": (prose + "\n" + noise[:300], True),
        "blank": (" \n\t" * 100, False),
    }
    got = {x["doc_id"]: x for x in compression.quality_report(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id string, text string")).collect()}
    for k, (_, keep) in cases.items():
        assert got[k]["kept"] == keep, (k, got[k])


def cycled(words, n):
    return [words[i % len(words)] for i in range(n)]


def test_compression_edges(spark):
    rows = [(1, "", "a", 1), (2, None, "b", 2), (None, "  ", "c", 3), (3, "a b c d e f " * 20_000, "d", 4), (3, "a b c d e f " * 20_000, "d", 4), (4, "x" * 3_000_000, None, None), (5, "é è ü\n\n\r\nü", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long")
    got = sorted((tuple(r) for r in compression.quality_report(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    assert got == sorted(((i, *by_hand(t)) for i, t, *_ in rows), key=repr)
    assert compression.quality_report(df.limit(0)).count() == 0
    assert compression.quality_report(df.withColumn("text", F.lit(None).cast("string"))).where("kept OR ratio <> 1").count() == 0
