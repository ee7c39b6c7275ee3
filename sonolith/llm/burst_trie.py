"""The prefix trie of conversations by burst tries.

A turn is known by the SHA-256 of its role and text, a conversation by its turns' ids. Conversations with the same
turns are one member. At first all members' suffixes lie in one container under the root. A container with too many
members or turns bursts: what all its suffixes begin with becomes a chain of nodes, and the next turn id deals them to
new containers, one under each new trie head. Containers that need not burst are sorted and swept by one task each,
which turns them into nodes from neighbours' common prefixes. What a head needs to know of its subtree then goes up
the heads, round by round.

A node is (smallest member, depth): no two nodes of a depth share a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_spread, staged

MEMBERS, TURNS = 4096, 65_536  # of a container; one with more of either bursts
SEED_CYCLE, SEED_LENGTHS = 5, 9
BUCKET = 4096  # consecutive conversation ids hashed as one piece
NO_ENDS = hashlib.sha256(b"").hexdigest()
FLUSH = 20_000
TOP = ["top_conv", "top_depth"]
TURN_IDS = "array<struct<id:binary,n_bytes:long>>"


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(``conv_id``, ``turns``): per conversation its turns in order as (id, UTF-8 bytes of the text). Rows without a conversation id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    plain = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")  # the length keeps ("ab", "c") and ("a", "bc") apart
    entry = F.struct("turn", "role", F.unhex(F.sha2(F.encode(framed, "utf-8"), 256)).alias("id"), F.octet_length("text").cast("long").alias("n_bytes"))
    return plain.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("t")).select("conv_id", F.expr("transform(t, x -> named_struct('id', x.id, 'n_bytes', x.n_bytes))").alias("turns"))


def _from(turns: str, first: Column) -> Column:
    """What is left of an array from its 0-based place ``first`` on."""
    return F.slice(turns, first + 1, F.greatest(F.size(turns) - first, F.lit(0)))


def rebuilt(turns: DataFrame, cycle: int = SEED_CYCLE, lengths: int = SEED_LENGTHS) -> DataFrame:
    """(``conv_id``, ``turns``): conversation c begins with the first h turns of conversation c - c % ``cycle`` (h: crc32 of c modulo ``lengths``) and goes on with its own after its first h."""
    base = turns.where(F.col("conv_id") % cycle == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, lengths - 1).alias("seed"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(lengths)).cast("int")
    joined = turns.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % cycle == F.col("base"), "left")
    seed = F.slice(F.coalesce("seed", F.array().cast(TURN_IDS)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(seed, _from("turns", F.col("h"))).alias("turns"))


def members_of(sequences: DataFrame) -> DataFrame:
    """(``conv_id``, ``turns``) to one row per different sequence: its smallest conversation, their number, and the digest of all their ids in ascending order.

    The ids of one sequence are joined in pieces of neighbouring ids before they meet; the task that digests them reads
    the sorted pieces one after the other and holds one.
    """
    key = F.sha2(F.array_join(F.expr("transform(turns, x -> hex(x.id))"), ""), 256)
    kept = staged(sequences.select("conv_id", key.alias("sequence"), "turns"), "sequences")
    pieces = kept.groupBy("sequence", F.floor(F.col("conv_id") / BUCKET).alias("bucket")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("sequence", "bucket", F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, n, hasher = None, 0, 0, hashlib.sha256()
        for b in batches:
            out = []
            for sequence, at_least, more, ids in zip(*(b.column(c).to_pylist() for c in ("sequence", "least", "n", "ids")), strict=True):
                if sequence != now:
                    if now is not None:
                        out.append((least, n, hasher.hexdigest()))
                    now, least, n, hasher = sequence, at_least, 0, hashlib.sha256()
                hasher.update((("," if n else "") + ids).encode())
                n += more
            yield _batch(out, {"conv_id": pa.int64(), "n_convs": pa.int64(), "ends_sha256": pa.string()})
        if now is not None:
            yield _batch([(least, n, hasher.hexdigest())], {"conv_id": pa.int64(), "n_convs": pa.int64(), "ends_sha256": pa.string()})

    ends = pieces.repartition("sequence").sortWithinPartitions("sequence", "bucket").mapInArrow(digest, "conv_id long, n_convs long, ends_sha256 string")
    return ends.join(kept.select("conv_id", "turns"), "conv_id")


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, types.values(), strict=True)], names=list(types))


_NODE = {**dict.fromkeys([*TOP, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], pa.int64()), "ends_sha256": pa.string()}


class _Open:
    """A node on the path that a sweep is at; ``kids`` wait for its smallest member."""

    __slots__ = ("id", "n_bytes", "n", "conv", "ends", "leaves", "saved", "kids")

    def __init__(self, id_: bytes | None, n_bytes: int) -> None:
        self.id, self.n_bytes, self.n, self.conv, self.ends, self.leaves, self.saved, self.kids = id_, n_bytes, 0, None, NO_ENDS, 0, 0, []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members, one container after the other, to the nodes below each container's head, and one row for the head itself (``depth`` = ``top_depth``; ``saved_tokens`` without its own)."""
    out: list[tuple] = []
    path: list[_Open] = []
    top: tuple | None = None

    def close(to: int) -> None:
        while len(path) > to:
            node = path.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.n_bytes if path else 0
            depth = top[1] + len(path)
            out.extend((*top, conv, depth + 1, node.conv, *rest) for conv, *rest in node.kids)
            row = (node.conv, node.n, len(node.kids), node.leaves, node.saved, node.ends)
            if path:
                up = path[-1]
                up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
                up.kids.append(row)
            else:
                out.append((*top, row[0], depth, None, *row[1:]))

    for b in batches:
        suffixes = b.column("suffix")
        ids, sizes = suffixes.flatten().field(0).to_pylist(), suffixes.flatten().field(1).to_pylist()
        at = 0
        for top_conv, top_depth, length, conv, n, ends in zip(*(x.to_pylist() for x in (b.column(TOP[0]), b.column(TOP[1]), suffixes.value_lengths(), b.column("conv_id"), b.column("n_convs"), b.column("ends_sha256"))), strict=True):
            if (top_conv, top_depth) != top:
                close(0)
                top = (top_conv, top_depth)
                path.append(_Open(None, 0))
            shared = 0
            while shared < length and shared + 1 < len(path) and path[shared + 1].id == ids[at + shared]:
                shared += 1
            close(shared + 1)
            path.extend(_Open(ids[at + k], sizes[at + k]) for k in range(shared, length))
            end = path[-1]
            end.n, end.conv, end.ends = end.n + n, conv if end.conv is None else min(end.conv, conv), ends
            at += length
            if len(out) >= FLUSH:
                yield _batch(out, _NODE)
                out.clear()
    close(0)
    yield _batch(out, _NODE)


def _common(low: str, high: str) -> Column:
    """How many leading turns two suffixes share."""
    n = F.least(F.size(low), F.size(high))
    same = F.zip_with(F.slice(low, F.lit(1), n), F.slice(high, F.lit(1), n), lambda x, y: x["id"] == y["id"])
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(n).cast("int")


def _marked(members: DataFrame, big: DataFrame) -> DataFrame:
    """``members`` with ``shared`` of their container where it bursts (``big``), else null. Rows of large containers stay where they are."""
    total = big.agg(F.sum("n_members")).first()[0]
    hot, cold = (big.where(F.col("n_members") > total // HOT_SHARE), big.where(F.col("n_members") <= total // HOT_SHARE))
    near = members.join(F.broadcast(hot.select(*TOP, "shared")), TOP, "left")
    rest = near.where("shared IS NULL").drop("shared").join(cold.select(*TOP, "shared"), TOP, "left")
    return near.where("shared IS NOT NULL").unionByName(rest)


def burst_trie(members: DataFrame, most_members: int = MEMBERS, most_turns: int = TURNS) -> DataFrame:
    """The nodes of the trie of ``members`` (``conv_id, n_convs, ends_sha256, turns``, no two with the same turns).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node; no members: no
    nodes. Containers of up to ``most_members`` members with up to ``most_turns`` turns in all, and those of one
    member, are swept; others burst.
    """
    spark = members.sparkSession
    root = members.agg(F.min("conv_id"), F.sum("n_convs")).first()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    heads = [spark.createDataFrame([(root[0], 0, None, None, None, root[1], 0)] if root[1] else [], "conv_id long, depth long, parent_conv_id long, top_conv long, top_depth long, n_convs long, n_bytes long")]
    now = members.select(F.lit(root[0]).cast("long").alias(TOP[0]), F.lit(0).cast("long").alias(TOP[1]), F.col("turns").alias("suffix"), "conv_id", "n_convs", "ends_sha256")
    settled, bursts = [], []
    while True:
        sizes = now.groupBy(*TOP).agg(F.count("*").alias("n_members"), F.sum(F.size("suffix")).alias("n_turns"), F.min("suffix").alias("low"), F.max("suffix").alias("high"))
        big = sizes.where(f"n_members > 1 AND (n_members > {most_members} OR n_turns > {most_turns})").withColumn("shared", _common("low", "high"))
        big = staged(big.select(*TOP, "n_members", "shared", F.expr("transform(slice(low, 1, shared), x -> x.n_bytes)").alias("chain")), "bursting")
        if big.isEmpty():
            settled.append(now)
            break
        marked = staged(_marked(now, big), "marked-members")
        settled.append(marked.where("shared IS NULL").drop("shared"))
        inside = marked.where("shared IS NOT NULL")
        ends = inside.where("size(suffix) = shared").select(*TOP, "ends_sha256")
        onward = inside.where("size(suffix) > shared").withColumn("next", F.expr("suffix[shared]"))
        onward = onward.select(*TOP, (F.col("top_depth") + F.col("shared") + 1).alias("depth"), F.col("next.id").alias("id"), F.col("next.n_bytes").alias("n_bytes"), _from("suffix", F.col("shared") + 1).alias("suffix"), "conv_id", "n_convs", "ends_sha256")
        new = staged(onward.groupBy(*TOP, "depth", "id").agg(F.min("conv_id").alias("head_conv"), F.sum("n_convs").alias("head_convs"), F.min("n_bytes").alias("head_bytes"), F.count("*").alias("n_members")), "heads")
        heads.append(new.select(F.col("head_conv").alias("conv_id"), "depth", F.col("top_conv").alias("parent_conv_id"), *TOP, F.col("head_convs").alias("n_convs"), F.col("head_bytes").alias("n_bytes")))
        bursts.append((big, ends))
        dealt = join_spread(onward, new.select(*TOP, "depth", "id", "head_conv", "n_members"), [*TOP, "depth", "id"], "n_members")
        now = staged(dealt.select(F.col("head_conv").alias(TOP[0]), F.col("depth").alias(TOP[1]), "suffix", "conv_id", "n_convs", "ends_sha256"), "members")
    todo = settled[0]
    for more in settled[1:]:
        todo = todo.unionByName(more)
    swept = todo.repartition(*TOP).sortWithinPartitions(*TOP, "suffix").mapInArrow(_sweep, ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE))
    swept = staged(swept, "swept")
    nodes = swept.where("depth > top_depth").select(*names)
    below = ["n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    known = swept.where("depth = top_depth").select(F.col("top_conv").alias("conv_id"), "depth", *below)
    burst = known.limit(0)
    for at in reversed(range(len(heads))):
        own = heads[at].join(known.unionByName(burst), ["conv_id", "depth"]).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes"))
        own = staged(own.select("conv_id", "depth", "parent_conv_id", *TOP, "n_convs", *below), "head-nodes")
        nodes = nodes.unionByName(own.select(*names))
        if at:
            chains, burst = _chains(own, heads[at - 1], *bursts[at - 1])
            nodes = nodes.unionByName(chains.select(*names))
    return nodes


def _chains(kids: DataFrame, heads: DataFrame, big: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes between each head that burst and its new heads (``kids``), and what is below the head."""
    sums = kids.groupBy(*TOP).agg(F.count("*").alias("n_kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("kid_tokens"))
    of_top = heads.select(F.col("conv_id").alias(TOP[0]), F.col("depth").alias(TOP[1]), "n_convs")
    # a head without an empty or fully shared suffix has no end of its own
    tops = staged(big.select(*TOP, "shared", "chain").join(sums, TOP).join(of_top, TOP).join(ends, TOP, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "tops")
    each = tops.where("shared > 0").select(*TOP, "shared", "n_convs", "n_kids", "n_leaves", "kid_tokens", "ends_sha256", F.posexplode("chain").alias("place", "n_bytes"))
    last = F.col("place") + 1 == F.col("shared")
    under = F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).over(Window.partitionBy(*TOP).orderBy(F.desc("place")))
    each = each.withColumn("saved_tokens", under + F.col("kid_tokens"))
    chains = each.select(F.col("top_conv").alias("conv_id"), (F.col("top_depth") + F.col("place") + 1).alias("depth"), F.col("top_conv").alias("parent_conv_id"), "n_convs", F.when(last, F.col("n_kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.when(last, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"))
    whole = (F.col("n_convs") - 1) * F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x) + F.col("kid_tokens")
    direct = F.col("shared") == 0
    below = tops.select(F.col("top_conv").alias("conv_id"), F.col("top_depth").alias("depth"), F.when(direct, F.col("n_kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves", whole.alias("saved_tokens"), F.when(direct, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"))
    return chains, below


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_members: int = MEMBERS, most_turns: int = TURNS) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node; see :func:`rebuilt` and :func:`burst_trie`.

    Turns are ordered by turn number, null first; ties by role, then by the turn's id, so repeated rows are turns of
    their own that follow each other. Null roles and texts are empty. Rows without a conversation id belong to none and
    are left out. Texts enter as digests only, whatever their length. An empty table gives no rows (a root needs a
    member). Other columns are not read, whatever their names. A conversation is one row of 40 bytes a turn.
    """
    return burst_trie(members_of(rebuilt(ordered_turns(conversations, conv_col, turn_col, role_col, text_col))), most_members, most_turns)
