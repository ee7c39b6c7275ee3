"""Repair of conversations' turn structure by an auction algorithm for shortest paths.

A conversation is a lattice: a node is (rows read, what the roles so far end in), an arc keeps, reroles or deletes the
next row or inserts a turn, at an integer cost. The auction keeps a price at every node, never above the cost of any
arc plus the price at its end, and one path from its origin: where the path's last node could pay more, its price
rises to the best offer and the path contracts; else the path extends along the best offer. It ends at a node whose
price is known, and then its arcs are tight and its origin's price is the least cost. Blocks of rows are solved from
the last one backwards, so the path never leaves a block; each block starts from prices that no path can undercut.
The converged prices expose the arcs of all cheapest paths as tight ones; of these the one with the least
letters is traced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
BLOCK = 32  # rows
FINE, GONE, TRUNCATED = range(3)
INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)  # what the roles so far end in
_MAY = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_NEEDED = {q: ASSISTANT if q == USER else USER for q in _MAY}
ROLE = {USER: "user", ASSISTANT: "assistant"}
END = 3 * (len(INITIALS) + 1)


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs (letter, cost, state behind it, rows read), by letter."""
    out = []
    for q in _MAY:
        arcs = [("D", DELETE, q, 1), ("I", INSERT, _NEEDED[q], 0)]
        if fault != GONE:
            extra = CUT_SHORT if fault == TRUNCATED else 0
            if initial in _MAY[q]:
                arcs.append(("K", KEEP + extra, _MAY[q][initial], 1))
            arcs.append(("R", REROLE + extra, _NEEDED[q], 1))
        out.append(arcs)
    return out


#: By kind of row: three faults for each initial, any other initial last; then the end, which START and ASSISTANT may pass.
ARCS = [_arcs(initial, fault) for initial in [*INITIALS, ""] for fault in range(3)]
ARCS.append([[("", 0, q, 1)] * (q in (START, ASSISTANT)) + [("I", INSERT, _NEEDED[q], 0)] for q in _MAY])
NEXT = [[{letter: (to, read) for letter, _, to, read in arcs} for arcs in kind] for kind in ARCS]
LEAST = [min(cost for arcs in kind for _, cost, _, read in arcs if read) for kind in ARCS]


def kind_of(initial: str, fault: int) -> int:
    return 3 * (INITIALS.index(initial) if initial and initial in INITIALS else len(INITIALS)) + fault


def auction(kinds: bytes, beyond: list[int]) -> tuple[list[int], bytes]:
    """Exact prices of the four nodes before a block of rows, and for each of its nodes the least letter that begins a cheapest path (a zero byte where no origin's path comes by). ``beyond``: exact prices behind the block."""
    n = 4 * len(kinds)
    price, known = [0] * n + beyond, bytearray(n) + b"\1" * 4
    floor = min(beyond)
    for i in reversed(range(len(kinds))):
        floor += LEAST[kinds[i]]
        price[4 * i : 4 * i + 4] = [floor] * 4
    for origin in range(4):
        path = [origin]
        while not known[node := path[-1]]:
            row = node >> 2
            offer, to = min((cost + price[(t := 4 * (row + read) + q)], t) for _, cost, q, read in ARCS[kinds[row]][node & 3])
            if price[node] < offer:
                price[node] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            known[node] = 1
    letters, leads = bytearray(n), bytearray(n) + b"\1" * 4
    for row in reversed(range(len(kinds))):
        arcs, changed = ARCS[kinds[row]], True
        while changed:  # an inserted turn leads on within the row
            changed = False
            for q in range(4):
                node = 4 * row + q
                found = next((letter for letter, cost, to, read in arcs[q] if leads[t := 4 * (row + read) + to] and price[node] == cost + price[t]), None)
                code = ord(found or ".") if found is not None else 0
                if code != letters[node]:
                    letters[node], leads[node], changed = code, 1, True
    return price[:4], bytes(letters)


def cheapest_edits(kinds: bytes) -> tuple[int, str]:
    """Least cost and the letters of its edits (of equally cheap ones the least string)."""
    prices, tail = auction(bytes([END]), [0] * 4)
    blocks = [tail]
    for at in reversed(range(0, len(kinds), BLOCK)):
        prices, letters = auction(kinds[at : at + BLOCK], prices)
        blocks.append(letters)
    letters, kinds = b"".join(reversed(blocks)), kinds + bytes([END])
    out, row, q = [], 0, START
    while (letter := chr(letters[4 * row + q])) != ".":
        out.append(letter)
        q, read = NEXT[kinds[row]][q][letter]
        row += read
    return prices[START], "".join(out)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: int = 20) -> DataFrame:
    """``conv_id, turn, role, text, copy, there``: the rows after damage by crc32 of ``conv_id:turn`` modulo ``parts``; a dropped row stays as one that is not ``there``."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col)).cast("binary")), F.lit(parts))
    plain = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), or_space(role_col).alias("role"), or_space(text_col).alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return plain.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (F.col("how") != 0).alias("there"))


ORDER = ["conv_id", "first", "turn", "role", "said", "copy"]  # ascending: nulls first
SUMMARY = {**dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "long"), "audit": "string"}
_NOT_YET = object()


def _known(rows: DataFrame) -> DataFrame:
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("said", F.unhex(F.sha2(F.encode(framed, "utf-8"), 256))).withColumn("first", F.lit(1))


def plan_repairs(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every ``conv_id`` of ``rows`` (as :func:`damaged` gives them). Texts are not shuffled."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    light = _known(rows).select("conv_id", "first", "turn", "role", "said", "copy", "there", (last == "").alias("empty"), last.isin(".", "!", "?").alias("ended"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out = _NOT_YET, []

        def close() -> None:
            cost, audit = cheapest_edits(bytes(kinds))
            illegal = sum(initials[i : i + 2] not in (["s", "u"], ["u", "a"], ["a", "u"]) for i in range(len(initials) - 1))
            gaps = min(turns[1] - turns[0] + 1 - turns[2], 2**63 - 1) if turns else 0
            out.append((conv, gaps, *faults, illegal, cost, audit))

        for b in batches:
            for c, turn, role, said, there, empty, ended in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "said", "there", "empty", "ended")), strict=True):
                if conv is _NOT_YET or c != conv:
                    if conv is not _NOT_YET:
                        close()
                    conv, kinds, initials, seen, faults, turns = c, bytearray(), [], set(), [0, 0, 0], []
                if not there:
                    continue
                if turn is not None:  # sorted: smallest, largest, different ones
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                fault = 0 if empty else 1 if said in seen else None if ended else 2
                seen.add(said)
                if fault is not None:
                    faults[fault] += 1
                initials.append(role[:1])
                kinds.append(kind_of(role[:1], FINE if fault is None else TRUNCATED if fault == 2 else GONE))
            yield _batch(out, b.schema.field("conv_id").type)
            out.clear()
        if conv is not _NOT_YET:
            close()
            yield _batch(out, kind)

    def _batch(out: list[tuple], kind_: pa.DataType) -> pa.RecordBatch:
        nonlocal kind
        kind = kind_
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.record_batch([pa.array(columns[0], kind_), *(pa.array(x, pa.int64()) for x in columns[1:7]), pa.array(columns[7], pa.string())], names=["conv_id", *SUMMARY])

    kind: pa.DataType | None = None
    sorted_rows = light.repartition("conv_id").sortWithinPartitions(*ORDER)
    return sorted_rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(map(' '.join, SUMMARY.items()))}")


def _edited(rows: DataFrame, plans: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over each conversation's plan followed by its rows in order."""
    texts = _known(rows.where("there")).select("conv_id", "first", "turn", "role", "said", "copy", "text", *[F.lit(None).cast(kind).alias(c) for c, kind in SUMMARY.items()])
    top = plans.select("conv_id", F.lit(0).alias("first"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *[F.lit(None).cast(kind).alias(c) for c, kind in (("role", "string"), ("said", "binary"), ("copy", "int"), ("text", "string"))], *SUMMARY)
    return texts.unionByName(top).repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {schema}")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(plan, None) where a conversation begins, then ((role, text, letter), turn number) for each of its repaired turns; (None, None) where a batch ends."""
    audit, at, q = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            q, at = _NEEDED[q], at + 1
            yield (ROLE[q], "", "I"), None

    for b in batches:
        for row in zip(*(b.column(x).to_pylist() for x in ("conv_id", *SUMMARY, "first", "turn", "role", "text")), strict=True):
            first, turn, role, text = row[-4:]
            if not first:
                yield from inserted()
                audit, at, q = row[len(SUMMARY)], 0, START
                yield row[:-4], None
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "R":
                q = _NEEDED[q]
                yield (ROLE[q], text, letter), turn
            elif letter == "K":
                q = _MAY[q][role[:1]]
                yield (role, text, letter), turn
        yield None, b.schema.field("conv_id").type
    yield from inserted()


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit, turn``: the turns of every repaired conversation in order (``turn``: its number before; null for an inserted one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out, kind = None, 0, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.record_batch([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.string()) for x in columns[2:5]), pa.array(columns[5], pa.int64())], names=["conv_id", "place", "role", "text", "edit", "turn"])

        for what, turn in _walk(batches):
            if what is None:
                kind = turn
                yield batch()
                out.clear()
            elif len(what) > 3:
                conv, place = what[0], 0
            else:
                out.append((conv, place, *what, turn))
                place += 1
        if out:
            yield batch()

    return _edited(rows, plans, run, "place long, role string, text string, edit string, turn long")


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: one row for every conversation id of the input, a null one included.

    Rows are damaged first (see :func:`damaged`; nulls become one space, but a null turn stays out of ``gaps``) and then
    ordered by turn, null first; ties by role, then by the SHA-256 of role and text. Repeated rows are duplicates of
    the first. A role whose first character is none of s, u and a can only be reroled or deleted; so can an empty one.
    A conversation without rows after damage has zeros, an empty audit and the digest of the empty string. An empty
    table gives no rows; other columns are not read, whatever their names. Texts are shuffled once and read one after
    the other; what a task holds of a conversation is its digests and a few bytes a turn.
    """
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, hasher, started, out, kind = None, None, False, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            return pa.record_batch([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:7]), *(pa.array(x, pa.string()) for x in columns[7:])], names=["conv_id", *SUMMARY, "repaired_sha256"])

        for what, turn in _walk(batches):
            if what is None:
                kind = turn
                yield batch()
                out.clear()
            elif len(what) > 3:
                if plan is not None:
                    out.append((*plan, hasher.hexdigest()))
                plan, hasher, started = what, hashlib.sha256(), False
            else:
                hasher.update((("\n" if started else "") + f"{what[0]}:{what[1]}").encode("utf-8", "surrogatepass"))
                started = True
        if plan is not None:
            out.append((*plan, hasher.hexdigest()))
            yield batch()

    return _edited(rows, plan_repairs(rows), run, ", ".join(map(" ".join, SUMMARY.items())) + ", repaired_sha256 string")
