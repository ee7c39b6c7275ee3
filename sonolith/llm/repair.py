"""Token ids in Re-Pair compressed blocks.

Documents are encoded, dealt out by id range and written in ascending id order. A block holds up to ``BLOCK_IDS`` ids
of whole documents. Within a block the most frequent pairs of symbols are replaced by nonterminals, round after round,
until no pair occurs ``LEAST_COUNT`` times any more, which is how often a rule must serve to pay for its own bytes. A
round takes the pairs that occur at least half as often as the most frequent one; where two of them overlap, the more
frequent one is replaced. The sequence is a linked list with the places and the number of every frequent pair, so a
round costs what it changes and the whole sequence is counted once. Pairs never cross a document's end, so each
document is a slice of the compressed sequence.

A block is one row of a Parquet table (any store that Spark writes to), with binary columns, all little-endian:

``terminals``   uint32: the ids that occur in the block, ascending; symbol k below their number t stands for the k-th
``rules``       pairs (left, right); rule k is the symbol t + k and refers to lower symbols only
``lengths``     uint32 per rule: how many ids it expands to
``symbols``     the compressed sequence of the whole block
``doc_symbols`` uint32 per document: where its slice of ``symbols`` ends
``doc_ids``     ids of the documents; ``doc_starts``: uint64, its ids before the document in the shard (last: the end)

``rules`` and ``symbols`` are uint16, or uint32 in a block of more than 2^16 symbols (``width`` says which). ``lengths``
give random access: cumulated over a slice they find the symbol that covers any position, and only the symbols that
cover the wanted ids are expanded (:func:`decode_range`, :func:`read_range`).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, kept_by_worker, staged

END_ID = 2
BLOCK_IDS = 1 << 20
LEAST_COUNT = 8  # a rule takes the bytes of four symbols; down to 5 the files shrink by 2 per cent more
NARROW = 1 << 16  # symbols of a block with uint16, as long as its terminals leave half of them for rules
CACHE_WORDS = 900_000  # remembered by a worker, twice at most


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one visible character: printable Latin-1 bytes as themselves, the others as U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering words.

    The tokenizer's pattern never joins a character that is not white space with white space after it, so a text
    without two white-space characters in a row falls apart at each blank and line end. A part that was not met lately
    is cut by the tokenizer's pattern and given to the library's model, which is a third of the cost of a full call;
    other texts go to the library whole, as do texts that hold the string of an added token, and all texts of a
    tokenizer that is not byte-level BPE by that pattern. A part is remembered with the blank or the line end before it.
    """

    _adjacent = re.compile(r"\s\s")
    _blank = bytes(0x20 if c in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " else c for c in range(256))
    _rare_blanks = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # where white space beyond ASCII starts
    _signs = ".,;:!?#$%&*+-/<=>@^_|~()[]{}"
    _characters = _byte_characters()

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.in_parts = kind["model"]["type"] == "BPE" and not kind["normalizer"] and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.blank = self._characters[0x20]
        self.tails: dict[str, bytes] = {}
        self._bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, text: str) -> bytes:
        written = [piece.encode().decode("latin-1").translate(self._characters) for piece in self.pattern.findall(text)]
        return b"".join([self._bytes[t.id] for piece in written for t in self.model.tokenize(piece)])

    def _part(self, part: str) -> bytes:
        """Ids of a blank and ``part``, or of a part that starts with a line end."""
        found = self.old.get(part)
        if found is None:
            if part.isalpha() and (part.isascii() or max(part) < "\u0250"):  # one piece; beyond, libraries may differ in what a letter is
                written = part if part.isascii() else part.encode().decode("latin-1").translate(self._characters)
                found = b"".join([self._bytes[t.id] for t in self.model.tokenize(self.blank + written)])
            elif part[:1] == "\n":
                found = self._pieces("\n") + (self._pieces(part[1:]) if len(part) > 1 else b"")
            elif (stem := part.rstrip(self._signs)) != part and stem.isalpha():
                # the pattern always cuts between a letter and signs, and signs are one piece: the word without them is often known
                tail = part[len(stem) :]
                if (ending := self.tails.get(tail)) is None:
                    ending = self.tails[tail] = self._pieces(tail)
                if (known := self.new.get(stem)) is None:  # a word met for the first time: its place among those remembered is enough
                    return self._part(stem) + ending
                found = known + ending
            else:
                found = self._pieces(" " + part)
        if len(self.new) >= CACHE_WORDS:  # words not met for long are forgotten
            self.old, self.new, self.tails = self.new, {}, {}
        self.new[part] = found
        return found

    def _whole(self, text: str) -> bool:
        """Whether the text does not fall apart at its blanks: two white-space characters meet somewhere, or may."""
        if not self.in_parts or any(a in text for a in self.added):
            return True
        if text.replace("\n", "").isprintable():  # then blanks and line ends are its only white space
            return "  " in text.replace("\n", " ")
        raw = text.encode()
        if b"  " in raw.translate(self._blank):
            return True
        return not text.isascii() and any(b in raw for b in self._rare_blanks) and self._adjacent.search(text) is not None

    def encode(self, text: str) -> np.ndarray:
        if self._whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        first, *parts = text.replace("\n", " \n").split(" ")
        found = list(map(self.new.get, parts))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.new.get(parts[at]) or self._part(parts[at])
        if first:
            found.insert(0, (self.new.get("\n" + first) or self._part("\n" + first))[4:])
        return np.frombuffer(b"".join(found), dtype="<u4")


def encoder(path: str) -> Encoder:
    """A worker's encoder; what it remembers serves all its tasks."""
    return kept_by_worker(("encoder", path), lambda: Encoder(path))


class _Pairs:
    """A block's symbols as a linked list, with the places and counts of its frequent pairs."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, limit: int, least: int) -> None:
        n = len(symbols)
        self.limit, self.least = limit, least
        self.symbol = np.append(symbols, 0).astype(np.int32)  # index n stands before the first and after the last place
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        self.after[n] = self.before[0] = n
        self.last = np.zeros(n + 1, dtype=bool)  # of its document
        self.last[ends - 1] = self.last[n] = True
        self.alive = np.ones(n, dtype=bool)
        self.pair = np.full(n + 1, -1, dtype=np.int32)  # the frequent pair that starts at a place
        self.rank = np.full(n + 1, limit, dtype=np.int32)
        self.places, self.used = np.empty(3 * n + 1, dtype=np.int32), 0  # a replacement changes two pairs and takes one away
        self.pairs, (self.count, self.first, self.size) = 0, np.zeros((3, n // least + 1), dtype=np.int64)
        self.enter(np.flatnonzero(~self.last))

    def enter(self, at: np.ndarray) -> None:
        """Takes up the pairs that start at ``at``; none of these pairs has been met before. Pairs that are rare now stay so."""
        key, shift = self.symbol[at].astype(np.int64) * self.limit + self.symbol[self.after[at]], len(self.alive).bit_length()
        if 2 * self.limit.bit_length() + shift < 64:
            both = np.sort(key << shift | at)
            key, at = both >> shift, (both & ((1 << shift) - 1)).astype(np.int32)
        else:
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
        edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        size = np.diff(edge, append=len(key))
        often = size >= self.least
        at, size = at[np.repeat(often, size)], size[often]
        old, new = self.pairs, self.pairs + len(size)
        if new > len(self.count):
            self.count, self.first, self.size = (np.concatenate((x, np.zeros(new, dtype=np.int64))) for x in (self.count, self.first, self.size))
        self.pair[at] = np.repeat(np.arange(old, new, dtype=np.int32), size)
        self.first[old:new] = self.used + np.cumsum(size) - size
        self.size[old:new] = self.count[old:new] = size
        self.places[self.used : self.used + len(at)] = at
        self.pairs, self.used = new, self.used + len(at)

    def _forget(self, at: np.ndarray) -> None:
        known = self.pair[at]
        np.subtract.at(self.count, known[known >= 0], 1)
        self.pair[at] = -1

    def replace(self, free: int, base: int) -> np.ndarray | None:
        """One round: the rules (left, right) that it makes, the first of which is symbol ``base``; None when nothing is left to replace."""
        most = self.count[: self.pairs].max(initial=0)
        if most < self.least or free < 1:
            return None
        chosen = np.flatnonzero(self.count[: self.pairs] >= max(self.least, most // 2))
        chosen = chosen[np.argsort(-self.count[chosen], kind="stable")][:free]
        size = self.size[chosen]
        rule = np.repeat(np.arange(len(chosen)), size)
        at = self.places[np.arange(len(rule)) + np.repeat(self.first[chosen] - (np.cumsum(size) - size), size)]
        still = self.pair[at] == chosen[rule]
        both = np.sort(at[still].astype(np.int64) * self.limit + rule[still])  # in order of places, which keeps memory access local
        at, rule = both // self.limit, both % self.limit
        self.rank[at] = rule
        before, after = self.rank[self.before[at]], self.rank[self.after[at]]
        self.rank[at] = self.limit
        start = np.where(before == rule, 0, np.arange(len(at)))  # in a run of one symbol every other pair goes
        wins = (before >= rule) & (after >= rule) & ((np.arange(len(at)) - np.maximum.accumulate(start)) % 2 == 0)
        # the first pair always gets half of its places at least; one that lost most of its places waits for its new count
        serves = np.bincount(rule[wins], minlength=len(chosen)) >= (self.least + 1) // 2
        wins &= serves[rule]
        at, rule = at[wins], (np.cumsum(serves) - 1)[rule[wins]]
        head = self.places[self.first[chosen[serves]]]  # any place where the pair was; its symbols come from one where it still is
        head[rule] = at
        made = np.stack((self.symbol[head], self.symbol[self.after[head]]), axis=1)
        gone = self.after[at]
        for x in (at, gone, self.before[at]):
            self._forget(x)
        self.symbol[at] = base + rule
        self.after[at] = self.after[gone]
        self.before[self.after[at]] = at
        self.last[at] = self.last[gone]
        self.alive[gone] = False
        self.rank[at] = 0
        left = self.before[at]
        left = left[self.rank[left] != 0]
        self.rank[at] = self.limit
        changed = np.concatenate((at, left))
        self.enter(changed[~self.last[changed]])
        return made


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, ...]:
    """(terminals, rules, lengths, symbols, ends) of a block; ``ends``: where each document ends in ``ids`` and then in ``symbols``. No document is empty."""
    used = np.bincount(ids)
    terminals = np.flatnonzero(used)
    used[terminals] = np.arange(len(terminals))
    t = len(terminals)
    limit = NARROW if 2 * t <= NARROW else 1 << 20 if t < 1 << 19 else 2 * t
    pairs, rules = _Pairs(used[ids], ends, limit, least), [np.empty((0, 2), dtype=np.int64)]
    made = 0
    while (more := pairs.replace(limit - t - made, t + made)) is not None:
        rules.append(more)
        made += len(more)
    size = np.ones(t + made, dtype=np.uint32)
    done = t
    for r in rules:  # a round's rules refer to earlier symbols only
        size[done : done + len(r)] = size[r[:, 0]] + size[r[:, 1]]
        done += len(r)
    kind = np.uint16 if t + made <= NARROW else np.uint32
    kept = np.flatnonzero(pairs.alive)
    return terminals.astype(np.uint32), np.concatenate(rules).astype(kind), size[t:], pairs.symbol[kept].astype(kind), np.searchsorted(kept, ends)


FLAT = 64  # rules that expand to no more ids are expanded once and copied


def _opened(terminals: np.ndarray, rules: np.ndarray, size: np.ndarray, symbols: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, places in the output) until all expand to ``most`` ids at most; ``ends``: where each symbol's expansion ends."""
    t, at = len(terminals), ends - size[symbols]
    while len(symbols):
        short = size[symbols] <= most
        yield symbols[short], at[short]
        rule, at = rules[symbols[~short] - t].astype(np.int64), at[~short]
        symbols, at = rule.ravel(), np.stack((at, at + size[rule[:, 0]]), axis=1).ravel()


def decode(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for. ``lengths`` give each symbol its place in the output; long rules are opened, short ones copied from their expansion."""
    t = len(terminals)
    size, symbols = np.concatenate((np.ones(t, dtype=np.int64), lengths)), symbols.astype(np.int64)
    copied = np.flatnonzero(size <= FLAT)
    starts = np.zeros(len(size), dtype=np.int64)
    starts[copied] = np.cumsum(size[copied]) - size[copied]
    flat = np.empty(int(size[copied].sum()), dtype=np.uint32)
    for plain, at in _opened(terminals, rules, size, copied, starts[copied] + size[copied], 1):
        flat[at] = terminals[plain]
    ends = np.cumsum(size[symbols])
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint32)
    for short, at in _opened(terminals, rules, size, symbols, ends, FLAT):
        n = size[short]
        before = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        out[np.repeat(at - before, n) + step] = flat[np.repeat(starts[short] - before, n) + step]
    return out


def decode_range(terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a sequence, opening only the symbols that cover them."""
    end = np.cumsum(np.concatenate((np.ones(len(terminals), dtype=np.int64), lengths))[symbols])
    a, b = np.searchsorted(end, start, side="right"), np.searchsorted(end, stop, side="left") + 1
    skip = start - (end[a - 1] if a else 0)
    return decode(terminals, rules, lengths, symbols[a:b])[skip : skip + stop - start]


FILE = "shard int, block int, first_id long, n_ids long, width int, terminals binary, rules binary, lengths binary, symbols binary, doc_symbols binary, doc_starts binary"


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes every text, appends ``END_ID``, writes the blocks and returns the table as read back: ``FILE`` and ``doc_ids``.

    Documents are ordered by id (nulls first; rows that share an id by text). Shards are ranges of that order, cut
    also within an id that very many rows share. A null text is empty: its document is the end id alone.
    """
    plain = documents_of(docs, id_col, text_col)
    kind = plain.schema["doc_id"].dataType
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode, np.array([END_ID], dtype=np.uint32)
        held: list[np.ndarray] = []
        ids: list = []
        block = held_ids = before = shard = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], dtype=np.int64)
            terminals, rules, lengths, symbols, ends = compress(np.concatenate(held), np.cumsum(sizes))
            starts = np.concatenate(([before], before + np.cumsum(sizes))).astype(np.uint64)
            binary = [x.tobytes() for x in (terminals, rules, lengths, symbols, ends.astype(np.uint32), starts)]
            small = (shard, pa.int32()), (block, pa.int32()), (before, pa.int64()), (held_ids, pa.int64()), (symbols.itemsize, pa.int32())
            row = [*(pa.array([x], t) for x, t in small), *(pa.array([x], pa.binary()) for x in binary)]
            return pa.RecordBatch.from_arrays([*row, pa.array([ids], type=pa.list_(id_type))], names=names)

        for b in batches:
            id_type = b.column("doc_id").type
            for doc_id, text, number in zip(b.column("doc_id"), b.column("text"), b.column("shard"), strict=True):
                shard = number.as_py()
                if held and held_ids >= BLOCK_IDS:
                    yield close()
                    before, block, held, ids, held_ids = before + held_ids, block + 1, [], [], 0
                held.append(np.concatenate((encode(text.as_py()), end)))
                ids.append(doc_id.as_py())
                held_ids += len(held[-1])
        if held:
            yield close()

    schema = f"{FILE}, doc_ids array<{kind.simpleString()}>"
    names = [x.split()[0] for x in schema.replace("array<", "").split(", ")]
    numbered = dealt.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    return staged(numbered.mapInArrow(run, schema), "repair-ids")


def _parts(row: dict) -> tuple[np.ndarray, ...]:
    """terminals, rules, lengths, symbols, ends of the documents in the symbols, starts of the documents of one block."""
    kind = np.uint16 if row["width"] == 2 else np.uint32
    return (
        np.frombuffer(row["terminals"], np.uint32), np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32),
        np.frombuffer(row["symbols"], kind), np.frombuffer(row["doc_symbols"], np.uint32), np.frombuffer(row["doc_starts"], np.uint64).astype(np.int64),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array]]:
    """Each block's columns but the ids of its documents, and those."""
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k].as_py() for n in b.schema.names if n != "doc_ids"}, b.column("doc_ids")[k].values


def _shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each shard: the shards' totals (one number each; there are as many as partitions) added up."""
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard] = at
        at += totals[shard]
    return before


def read_ids(blocks: DataFrame, digest_only: bool = False) -> DataFrame:
    """Per document of the written table: ``doc_id, start, n_tokens, ids_crc32`` and, unless ``digest_only``, ``ids``.

    ``start`` counts the ids of all documents before it.
    """
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    before = _shard_starts(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, doc_ids in _rows(batches):
            terminals, rules, lengths, symbols, _, starts = _parts(row)
            ids = decode(terminals, rules, lengths, symbols).astype("<u4", copy=False)
            cut = starts - starts[0]
            each = [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            columns = [doc_ids, pa.array(starts[:-1] + before[row["shard"]]), pa.array(np.diff(starts)), pa.array([zlib.crc32(x) for x in each], type=pa.int64())]
            if not digest_only:
                columns.append(pa.array([x.astype(np.int32) for x in each], type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>"))


def read_range(blocks: DataFrame, start: int, stop: int) -> DataFrame:
    """``doc_id, start, ids``: what lies between the places ``start`` and ``stop`` of the whole sequence, per document; ``start`` is the place of the first of ``ids``.

    Blocks outside are not read, of the others only the symbols that cover the range are opened.
    """
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    before = _shard_starts(blocks)
    inside = F.lit(False)
    for shard, at in before.items():
        first = F.col("first_id") + at
        inside = inside | ((F.col("shard") == shard) & (first < stop) & (first + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, doc_ids in _rows(batches):
            terminals, rules, lengths, symbols, ends, starts = _parts(row)
            starts = starts + before[row["shard"]]
            a, b = np.searchsorted(starts, start, side="right") - 1, np.searchsorted(starts, stop, side="left")
            a, b = max(a, 0), min(b, len(starts) - 1)
            low, high = np.maximum(starts[a:b], start), np.minimum(starts[a + 1 : b + 1], stop)
            slices = zip([0, *ends][a:b], ends[a:b], low - starts[a:b], high - starts[a:b], strict=True)
            ids = [decode_range(terminals, rules, lengths, symbols[x:y], i, j).astype(np.int32) for x, y, i, j in slices]
            yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(low), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return blocks.where(inside).mapInArrow(run, f"doc_id {id_type}, start long, ids array<int>")
