"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are two segments of 32. Two fingerprints at distance 4 or less differ in at most 2 bits of
some segment; so if both list the ball of radius 1 around each of their segments (33 values), they meet in a common
value. Each distinct fingerprint is therefore entered under 66 keys, equal keys fetch each other's entries, and the
complete distance decides. No key of fewer than 32 bits is ever compared, so buckets stay near their expected size
until there are billions of different fingerprints.

``drop_near_duplicates`` (the pipeline's stage) links by a Jaccard similarity of 0.8 of shingle sets, which 64 bits
cannot tell: at 0.8 every bit differs with probability 0.15. It takes fingerprints of 192 bits in eight segments of 24,
enters each under the balls of radius 1 around its segments (200 keys), so that fingerprints with at most two differing
bits in some segment meet, verifies the complete distance, and lets the whole shingle sets decide. By the binomial
model 0.92 of the pairs at 0.8 meet, 0.98 at 0.85 and all but one in a thousand at 0.9; copies of a group also find each
other through third ones. The table of a segment is cut into blocks by the first bits of its value: flips of the other
bits stay inside a block, so a fingerprint is sent to one block and to those one flip away, and the block's task
enumerates the rest. Buckets of a few are compared at once; in larger ones everybody is compared with some leaders, and
then those that are still in different components with each other. There a pair is made only if the parities of the two
shingle sets allow a similarity of 0.8: each of 1,024 bits says whether an odd number of shingles hash to it, so the sets
differ in at least as many shingles as the parities in bits, and no pair that is similar enough is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, drop_marked, join_spread, split_by_filter, staged

SEED = 42
CHUNK = 100_000  # shingles hashed at once
SEGMENTS, SEGMENT_BITS = 8, 24  # of the wide fingerprint, which is three longs
LEADERS = 4  # of a bucket
FEW = 16  # fingerprints of a bucket that are all compared
BLOCK_PRINTS, MOST_PRINTS = 1 << 14, 1 << 20  # of a block: as planned, and in one task at most
APART = 44  # bits of 192 that may differ at a similarity of 0.8: 29 are expected, three deviations more leave out one pair of 700
PARITIES = 1024  # bits; from about 1,200 shingles on they rule out little
_WIDE = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]], dtype=np.uint64)  # fixed values: odd numbers for mixing
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of ``text`` (unsigned). Fewer words than a shingle: the whole sequence is one; none: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(words_per_shingle, len(words))
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], starts[at + width : to + width], strict=True)], dtype=np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(sum(1 << b for b in range(64) if 2 * counts[b] > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), words_per_shingle) for x in b.column("text")], dtype=np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    plain = documents_of(docs, id_col, text_col)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fp long")


def _ball_keys(fp: Column) -> Column:
    """The 66 keys of a fingerprint: per segment its value and the 32 values one bit away, with the segment's number in bit 32."""
    low, high = fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32).bitwiseOR(1 << 32)
    return F.array(*[seg.bitwiseXOR(F.lit(flip)) for seg in (low, high) for flip in [0, *[1 << b for b in range(32)]]])


def links(distinct: DataFrame, most_bits: int = 4) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` that differ in ``most_bits`` (at most 5) bits or fewer, each once.

    A pair meets under several keys; only one of them reports it: in the first segment that differs in at most 2 bits,
    a's value with the lowest differing bit turned. Entries are shuffled whatever Spark takes their size for: it does
    not count that each fingerprint is entered 66 times, so it would broadcast far more than fits the driver.
    """
    entries = distinct.select("fp", F.explode(_ball_keys(F.col("fp"))).alias("key"))
    a, b = entries.select("key", F.col("fp").alias("a")), entries.select("key", F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    low, high = differing.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(differing, 32)
    in_low, in_high = F.col("a").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("a", 32)
    reporting = F.when(F.bit_count(low) <= 2, in_low.bitwiseXOR(low.bitwiseAND(-low))).otherwise(in_high.bitwiseXOR(high.bitwiseAND(-high)).bitwiseOR(1 << 32))
    return a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(differing) <= most_bits) & (F.col("key") == reporting)).select("a", "b")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(pairs: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links (``a``, ``b``): alternating large- and small-star steps until nothing changes.

    A step is a minimum per node and a join, on Spark; each round is checkpointed, so that a lost executor costs one round.
    """
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct().checkpoint()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_components(prints: DataFrame, most_bits: int) -> DataFrame:
    """``prints`` with ``component_id``, the smallest id that is reachable."""
    per_fp = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct-prints")
    roots = components(links(per_fp, most_bits)).select(F.col("node").alias("fp"), "root")
    reach = roots.join(per_fp, "fp").groupBy("root").agg(F.min("least_id").alias("reached"))
    found = per_fp.join(roots.join(reach, "root").select("fp", "reached"), "fp", "left")
    named = staged(found.select("fp", F.coalesce("reached", "least_id").alias("component_id"), "n"), "named-prints")
    return join_spread(prints, named, ["fp"], "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, most_bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row.

    Documents with one fingerprint are one node, so copies are never paired; different fingerprints link at
    ``most_bits`` differing bits or fewer and ``component_id`` is the smallest id reachable over links. Texts without
    words (null, empty, white space) have fingerprint zero, which links like any other. Null ids get a row but name no
    component unless all ids in it are null. An empty table gives no rows; other columns are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words_per_shingle), "prints")
    return _with_components(prints, most_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles_of(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; none in a text without words. Words are those of ``fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n, width = b" ".join(words), max(1, len(words) - words_per_shingle + 1), min(words_per_shingle, len(words))
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], starts[width:], strict=True)], dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 192 bits (three longs) of a set of shingle hashes; zero for the empty set."""
    ones = np.zeros(192, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK, None] * _WIDE[0]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _WIDE[1]
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` values of a shingle's hash whether an odd number of the set have it (16 longs). Two sets differ in at least as many shingles as their parities differ in bits."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


FP = ["s0", "s1", "s2"]


def _segments(prefix: str = "") -> list[Column]:
    """The fingerprint's segments, with the segment's number above its bits."""
    out = []
    for j in range(SEGMENTS):
        word, bit = divmod(j * SEGMENT_BITS, 64)
        value = F.shiftrightunsigned(f"{prefix}{FP[word]}", bit)
        if (over := bit + SEGMENT_BITS - 64) > 0:
            value = value.bitwiseOR(F.shiftleft(F.col(f"{prefix}{FP[word + 1]}"), SEGMENT_BITS - over))
        out.append(value.bitwiseAND((1 << SEGMENT_BITS) - 1).bitwiseOR(j << SEGMENT_BITS).cast("int"))
    return out


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in FP[1:]), F.bit_count(F.col(f"{a}{FP[0]}").bitwiseXOR(F.col(f"{b}{FP[0]}"))))


def _node(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in FP])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def _entries(nodes: DataFrame, which: Column) -> DataFrame:
    """Each row of ``nodes`` under those of its keys (per segment its value and the values one bit away) that ``which`` takes."""
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(SEGMENT_BITS)])
    keys = F.flatten(F.transform(F.array(*_segments()), lambda s: F.transform(flips, lambda f: s.bitwiseXOR(f))))
    return nodes.select("*", F.explode(keys).alias("key")).where(which).repartition("key")  # here, so that nothing derived is shuffled


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in FP})


def _reporting(other: str) -> Column:
    """Of the keys that two fingerprints share the one that reports the pair, from either side: in the first segment that differs in at most 2 bits the smaller one of the two values with the lowest differing bit turned."""
    out = []
    for a, b in zip(_segments(), _segments(other), strict=True):
        differing = a.bitwiseXOR(b)
        lowest = differing.bitwiseAND(-differing)
        out.append(F.when(F.bit_count(differing) <= 2, F.least(a.bitwiseXOR(lowest), b.bitwiseXOR(lowest))))
    return F.coalesce(*out)


def _segment(prints: np.ndarray, j: int) -> np.ndarray:
    """Values of a segment, without its number."""
    word, bit = divmod(j * SEGMENT_BITS, 64)
    prints = prints.view(np.uint64)
    value = prints[:, word] >> np.uint64(bit)
    if (over := bit + SEGMENT_BITS - 64) > 0:
        value = value | (prints[:, word + 1] << np.uint64(SEGMENT_BITS - over))
    return (value & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def _apart_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of a signed number it would count the absolute value's


def _reporting_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`_reporting` for rows of prints."""
    found = np.full(len(a), -1, dtype=np.int64)
    for j in reversed(range(SEGMENTS)):
        x, y = _segment(a, j), _segment(b, j)
        differing = x ^ y
        lowest = differing & -differing
        here = np.bitwise_count(differing) <= 2
        found[here] = (np.minimum(x ^ lowest, y ^ lowest) | j << SEGMENT_BITS)[here]
    return found


def _buckets(prints: np.ndarray, block: int, first_bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The block's segment, and (key, place) of all entries of the prints sent to it, in order of keys."""
    low = SEGMENT_BITS - first_bits
    j, prefix = block >> first_bits, block & ((1 << first_bits) - 1)
    value = _segment(prints, j)
    home = np.flatnonzero(value >> low == prefix)
    guests = np.flatnonzero(value >> low != prefix)
    flips = np.array([0, *(1 << b for b in range(low))], dtype=np.int64)
    keys = np.concatenate(((value[home, None] ^ flips).ravel(), prefix << low | value[guests] & ((1 << low) - 1)))
    places = np.concatenate((np.repeat(home, len(flips)), guests))
    order = np.argsort(keys, kind="stable")
    return j, keys[order] | j << SEGMENT_BITS, places[order]


def block_pairs(prints: np.ndarray, block: int, first_bits: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the prints sent to a block: pairs (places a, b) that differ in ``APART`` bits or fewer, and (key, place) of all entries of buckets of more than ``few``.

    Pairs of a small bucket are found by the one bucket that reports them; those of a larger one are pairs with leaders, in the first segment that both are near in.
    """
    j, keys, places = _buckets(prints, block, first_bits)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    sizes = np.diff(starts, append=len(keys))
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size <= few))
    found = []
    for d in range(1, few):
        at = small[small + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        a, b = places[at], places[at + d]
        near = _apart_bits(prints[a], prints[b]) <= APART
        at, a, b = at[near], a[near], b[near]
        own = _reporting_key(prints[a], prints[b]) == keys[at]
        found.append(np.stack((a[own], b[own])))
    many = np.flatnonzero(size > few)
    if len(many):
        mixed = prints[places[many], 0].view(np.uint64) * _WIDE[0, 0] ^ prints[places[many], 2].view(np.uint64)
        many = many[np.lexsort((mixed, keys[many]))]
        first = np.flatnonzero(np.concatenate(([True], keys[many][1:] != keys[many][:-1])))
        members = np.diff(first, append=len(many))
        run, last = np.repeat(first, members), np.repeat(members - 1, members)
        for k in range(LEADERS):
            a, b = places[many], places[many[run + np.minimum(k, last)]]
            near = (a != b) & (_apart_bits(prints[a], prints[b]) <= APART)
            a, b = a[near], b[near]
            own = _reporting_key(prints[a], prints[b]) >> SEGMENT_BITS == j
            found.append(np.sort(np.stack((a[own], b[own])), axis=0))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return pairs[0], pairs[1], keys[many], places[many]


def apart_pairs(prints: np.ndarray, roots: np.ndarray, sizes: np.ndarray, n_shingles: np.ndarray, odd: np.ndarray, block: int, first_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the prints sent to a block: pairs (places a, b) of different components (``roots``, of ``sizes`` members) that differ in ``APART`` bits or fewer and whose sets may be similar enough by their parities, each once over all blocks.

    Members of a bucket's largest component are not compared with one another, so a bucket costs what is outside that
    component times its size.
    """
    _, keys, places = _buckets(prints, block, first_bits)
    component = np.unique(np.column_stack((sizes, roots)), axis=0, return_inverse=True)[1].reshape(-1)  # a larger one has a higher number
    order = np.lexsort((component[places], keys))
    keys, places = keys[order], places[order]
    of, last = component[places], np.searchsorted(keys, keys, side="right") - 1
    outside, step, found = np.flatnonzero(of != of[last]), 0, [np.zeros((2, 0), dtype=np.int64)]
    while len(outside := outside[outside + (step := step + 1) <= last[outside]]):
        at = outside[of[outside] != of[outside + step]]
        at = at[_apart_bits(prints[places[at]], prints[places[at + step]]) <= APART]
        a, b = places[at], places[at + step]
        likely = 9 * _apart_bits(odd[a], odd[b]) <= n_shingles[a] + n_shingles[b]
        at, a, b = at[likely], a[likely], b[likely]
        own = _reporting_key(prints[a], prints[b]) == keys[at]
        found.append(np.stack((a[own], b[own])))
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


_MET = [*(f"a{c}" for c in FP), *(f"b{c}" for c in FP), "key"]


def _dealt(nodes: DataFrame) -> tuple[DataFrame, int, Column | None]:
    """``nodes`` once for each ``block`` that they are sent to, in order of blocks; how many first bits of a segment make a block; which of the keys (``key``) are of blocks that no task should hold, and not among these."""
    n = nodes.count()
    first_bits = min(SEGMENT_BITS - 1, max(0, int(n // BLOCK_PRINTS).bit_length()))
    low = SEGMENT_BITS - first_bits
    home = [F.shiftright(c, low) for c in _segments()]
    counts = nodes.select(F.explode(F.array(*home)).alias("block")).groupBy("block").count()
    hot = [r[0] for r in counts.where(F.col("count") > MOST_PRINTS).select("block").collect()]  # one for 2^20 fingerprints at most
    sent = F.array(*[b for h in home for b in [h, *(h.bitwiseXOR(F.lit(1 << i)) for i in range(first_bits))]])
    dealt = nodes.select("*", F.explode(sent).alias("block"))
    dealt = dealt.where(~F.col("block").isin(hot)) if hot else dealt
    return dealt.repartition("block").sortWithinPartitions("block"), first_bits, F.shiftright("key", low).isin(hot) if hot else None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each block's rows, of rows in order of blocks."""
    now, parts = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if blocks[at] != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                now, parts = int(blocks[at]), []
            parts.append(batch.slice(at, end - at))
    if parts:
        yield now, pa.Table.from_batches(parts)


def _prints(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in names], axis=1)


def _met_in_blocks(nodes: DataFrame, entries: bool = True) -> DataFrame:
    """(``a*``, ``b*``, null): pairs of :func:`block_pairs`; (``a*``, null, ``key``): entries of large buckets, or without ``entries`` only one for each fingerprint that is in no pair of a block."""
    few = FEW
    dealt, first_bits, hot = _dealt(nodes.select(*FP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            prints = _prints(rows, FP)
            a, b, key, place = block_pairs(prints, block, first_bits, few)
            if not entries:
                place, first = np.unique(place, return_index=True)
                lone = ~np.isin(place, np.concatenate((a, b)))
                place, key = place[lone], key[first[lone]]
            none = np.zeros(len(key), dtype=bool)
            left, right = np.concatenate((prints[a], prints[place])), np.concatenate((prints[b], prints[place]))
            is_pair = np.concatenate((np.ones(len(a), dtype=bool), none))
            columns = [*(pa.array(np.ascontiguousarray(left[:, c])) for c in range(3)), *(pa.array(np.ascontiguousarray(right[:, c]), mask=~is_pair) for c in range(3))]
            yield pa.record_batch([*columns, pa.array(np.concatenate((np.zeros(len(a), dtype=np.int64), key)).astype(np.int32), mask=is_pair)], names=_MET)

    kinds = ", ".join(f"{c} {'int' if c == 'key' else 'long'}" for c in _MET)
    met = dealt.mapInArrow(run, kinds)
    return met if hot is None else met.unionByName(_met_by_windows(nodes, hot))


def _met_by_windows(nodes: DataFrame, which: Column) -> DataFrame:
    """The same for the keys of blocks that no task should hold: leaders by a window over each bucket, and all its entries."""
    leaders = [F.min_by(F.struct(*FP), F.xxhash64(F.lit(k), *FP)).over(Window.partitionBy("key")).alias(f"l{k}") for k in range(LEADERS)]
    entries = _entries(nodes.select(*FP), which=which)
    met = entries.select(*FP, *leaders).select(*FP, F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).alias("l")).select(*FP, *[F.col(f"l.{c}").alias(f"l{c}") for c in FP])
    met = met.where((_distance("", "l") <= APART) & (F.struct(*FP) != F.struct(*[F.col(f"l{c}") for c in FP])))
    pairs = met.select(*[F.col(c).alias(f"a{c}") for c in FP], *[F.col(f"l{c}").alias(f"b{c}") for c in FP], F.lit(None).cast("int").alias("key"))
    return pairs.unionByName(entries.select(*[F.col(c).alias(f"a{c}") for c in FP], *[F.lit(None).cast("long").alias(f"b{c}") for c in FP], "key"))


def _may_be_similar(a: str, b: str) -> Column:
    """Whether the parities of two sets of ``n_shingles`` allow a similarity of 0.8. It is 9 |both| >= 4 (|a| + |b|), so at most a ninth of |a| + |b| may differ."""
    differing = [F.bit_count(F.col(f"{a}parities")[i].bitwiseXOR(F.col(f"{b}parities")[i])) for i in range(PARITIES // 64)]
    return 9 * sum(differing[1:], differing[0]) <= F.col(f"{a}n_shingles") + F.col(f"{b}n_shingles")


def _still_apart(entries: DataFrame) -> DataFrame:
    """(``a``, ``b``): all fingerprints of one bucket (``key``) that differ in ``APART`` bits or fewer, whose sets may be similar enough by their ``parities``, and that are of different components (``root``, of ``size`` members; null: alone).

    Members of the bucket's largest component are not compared with one another, so a bucket costs what is outside that
    component times its size.
    """
    entries = entries.select("key", *FP, "n_shingles", "parities", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("root", _node()).alias("root")).repartition("key")
    most = F.max(F.struct("size", "root")).over(Window.partitionBy("key"))
    placed = entries.withColumn("inside", F.col("root") == most["root"]).drop("size")
    other = _renamed(placed.where("NOT inside").drop("inside"), "o").withColumnsRenamed({c: f"o{c}" for c in ("key", "root", "n_shingles", "parities")})
    both = placed.join(other.hint("merge"), F.col("key") == F.col("okey")).where((F.col("root") != F.col("oroot")) & (F.col("inside") | (F.struct(*FP) < F.struct(*[F.col(f"o{c}") for c in FP]))))
    met = both.where((_distance("", "o") <= APART) & _may_be_similar("", "o") & (F.col("key") == _reporting("o")))  # each pair once
    return met.select(F.least(_node(), _node("o")).alias("a"), F.greatest(_node(), _node("o")).alias("b"))


def _apart(nodes: DataFrame) -> DataFrame:
    """(``a``, ``b``): the pairs of :func:`apart_pairs` of ``nodes`` (fingerprint, ``n_shingles``, ``parities``, ``root`` and ``size`` of the component; null: alone); in blocks that no task should hold those of :func:`_still_apart`."""
    root = F.coalesce("root", _node())
    named = nodes.select(*FP, *[root[c].alias(f"r{c}") for c in FP], F.coalesce("size", F.lit(1)).alias("size"), "n_shingles", "parities")
    dealt, first_bits, hot = _dealt(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            prints, n = _prints(rows, FP), rows.column("n_shingles").to_numpy().astype(np.int64)
            odd = rows.column("parities").combine_chunks().flatten().to_numpy().reshape(-1, PARITIES // 64)
            a, b = apart_pairs(prints, _prints(rows, [f"r{c}" for c in FP]), rows.column("size").to_numpy(), n, odd, block, first_bits)
            yield pa.record_batch([pa.array(np.ascontiguousarray(prints[x, c])) for x in (a, b) for c in range(3)], names=_MET[:-1])

    met = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in _MET[:-1])).select(F.least(_node("a"), _node("b")).alias("a"), F.greatest(_node("a"), _node("b")).alias("b"))
    return met if hot is None else met.unionByName(_still_apart(_entries(nodes, which=hot)))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of 0.8 or more, by their whole sets: 9 |both| >= 4 (|a| + |b|)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    likely = 5 * F.least(F.size("ha"), F.size("hb")) >= 4 * F.greatest(F.size("ha"), F.size("hb"))
    return both.where(likely & (9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb")))).select("a", "b")


def _similar(nodes: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """(``node``, ``root``): components of the different fingerprints (``s0``..``s2``, ``text_hash``, ``n_shingles`` and ``parities`` of one of their texts) over candidates of similarity 0.8 or more.

    First every fingerprint is compared with those of its small buckets and with some leaders of its large ones, which
    is linear and settles families of copies; then all fingerprints of a large bucket that are still in different
    components are compared, so no link is lost. Components found at first enter the second search as one link a member.
    Texts of one fingerprint are one node: sets of a similarity under 0.8 agree in all 192 bits with a probability below 1e-13.
    """
    named = nodes.withColumn("node", _node())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.record_batch([part.column("node"), pa.array([shingles_of(x.as_py(), words_per_shingle).view(np.int64) for x in part.column("text")], pa.list_(pa.int64()))], names=["node", "hashes"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = staged(named.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "text_hash"), "wanted-texts")
        _, likely = split_by_filter(texts, "text_hash", wanted)  # only these are shuffled
        met = likely.join(wanted.hint("merge"), "text_hash").dropDuplicates(["text_hash"])
        return staged(met.select("node", "text").mapInArrow(run, "node struct<s0:long,s1:long,s2:long>, hashes array<long>"), "shingle-sets")

    met = staged(_met_in_blocks(nodes, entries=False), "met")
    led = staged(met.where("key IS NULL").select(F.least(_node("a"), _node("b")).alias("a"), F.greatest(_node("a"), _node("b")).alias("b")).distinct(), "led-pairs")
    found = staged(_verified(led, sets_of(led)), "similar")
    roots = staged(components(found), "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    crowded = met.where("key IS NOT NULL").select(_node("a").alias("node")).unionByName(led.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    crowded = named.join(crowded, "node", "left_semi").join(roots.join(sizes, "root"), "node", "left").select(*FP, "n_shingles", "parities", "root", "size")
    rest = staged(_apart(staged(crowded, "crowded")).join(led, ["a", "b"], "left_anti"), "apart-pairs")
    if rest.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(known.unionByName(_verified(rest, sets_of(rest))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """One row of ``docs`` per group of texts linked by a Jaccard similarity of 0.8 or more of their word shingles, with all its columns: that of the smallest id (ties: the smallest text hash; of repeated rows, one).

    Candidates come from multi-index hashing of 192-bit fingerprints, each link is verified by the whole shingle sets.
    Texts without words (null, empty, white space) are one group. Null ids lose against any other. Columns may have any
    names. An empty table gives no rows. Fingerprints and digests stand for themselves at full width. Texts are shuffled
    where they have a candidate or go, and a few more that a filter lets through.
    """
    text, kind = F.coalesce(F.col(text_col), F.lit("")), docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_hash", _digest(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, odd = np.zeros((b.num_rows, 3), dtype=np.int64), np.zeros(b.num_rows, dtype=np.int32), np.zeros((b.num_rows, PARITIES // 64), dtype=np.int64)
            for i, text in enumerate(b.column("text")):
                hashes = shingles_of(text.as_py(), words_per_shingle)
                prints[i], sizes[i], odd[i] = wide_fingerprint(hashes), len(hashes), parities(hashes)
            columns = [*(pa.array(np.ascontiguousarray(prints[:, j])) for j in range(3)), pa.array(sizes), pa.array(list(odd), pa.list_(pa.int64()))]
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), *columns], names=["doc_id", "text_hash", *FP, "n_shingles", "parities"])

    prints = staged(own.mapInArrow(run, f"doc_id {kind}, text_hash binary, s0 long, s1 long, s2 long, n_shingles int, parities array<long>"), "wide-prints")
    different = prints.groupBy(*FP).agg(F.min(F.struct("text_hash", "n_shingles", "parities")).alias("x")).select(*FP, "x.*")
    roots = _similar(staged(different, "different-prints"), own.select("text_hash", "text"), words_per_shingle)
    nodes = prints.groupBy(_node().alias("node")).agg(F.count("*").alias("n_rows")).join(roots, "node", "left")
    nodes = staged(nodes.select("node", F.coalesce("root", "node").alias("group"), "n_rows"), "node-groups")
    grouped = staged(join_spread(prints.select("doc_id", "text_hash", _node().alias("node")), nodes, ["node"], "n_rows").groupBy("doc_id", "text_hash", "group").agg(F.count("*").alias("n")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    first = staged(grouped.groupBy("group").agg(first, F.count("*").alias("n_rows")), "first-of-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = join_spread(grouped, first, ["group"], "n_rows").select("doc_id", "text_hash", stays.alias("stays"), "n").where(~F.col("stays") | (F.col("n") > 1))
    marked = staged(marked.select(F.struct("doc_id", "text_hash").alias("mark"), "stays"), "marked")
    return drop_marked(docs, F.struct(F.col(id_col).alias("doc_id"), _digest(text).alias("text_hash")), marked)
