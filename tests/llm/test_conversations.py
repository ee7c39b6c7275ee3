"""The conversation trie and the turn repair against brute force, and their edge cases."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from sonolith.llm import burst_trie, queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, depth string, suffix long"
#: Null and repeated ids, turns, roles and texts; repeated rows; a very long text and a long conversation; names that the operators use themselves.
EDGE = [
    (0, 1, "user", "a", "x", 1), (0, None, None, "first", "x", 1), (0, 2, "assistant", None, "x", 1), (5, 0, "user", "a", None, None), (5, 0, "user", "a", None, None),
    (None, 0, "user", "lost.", "x", 1), (7, 3, "tool", "b. " * 200_000, "x", 1), (7, None, "user", "", "x", 1), (7, 9, "", "?", "x", 1), (-3, 4, "system", "ends.", "x", 1),
    *((11, t, ("user", "assistant")[t % 2], f"turn {t}.", "x", t) for t in range(2000)), *((13, t, ("user", "assistant")[t % 2], f"turn {t}.", "x", t) for t in range(1990)),
]


def crc(s):
    return zlib.crc32(s.encode())


def trie_by_hand(rows):
    """Every prefix of every rebuilt conversation, one by one."""
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [x[1] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, turns in own.items():
        base, h = c - (abs(c) % 5) * (1 if c >= 0 else -1), crc(str(c)) % 9
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    sizes = {turn: len(turn[1].encode()) for s in seqs.values() for turn in s}
    names: dict[tuple, int] = {}  # (node before, turn): node
    members, ends, up, last = collections.defaultdict(list), collections.defaultdict(list), {0: None}, {0: 0}
    depth = {0: 0}
    for c, s in seqs.items():
        node = 0
        members[0].append(c)
        for turn in s:
            new = names.setdefault((node, turn), len(names) + 1)
            up[new], last[new], depth[new], node = node, sizes[turn], depth[node] + 1, new
            members[new].append(c)
        ends[node].append(c)
    kids, leaves, saved = collections.Counter(up[n] for n in members if n), collections.Counter(), collections.Counter()
    for n in sorted(members, key=lambda n: -depth[n]):
        leaves[n] += not kids[n]
        saved[n] += (len(members[n]) - 1) * last[n]
        if n:
            leaves[up[n]] += leaves[n]
            saved[up[n]] += saved[n]
    return sorted((min(m), depth[n], min(members[up[n]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def collected(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(r) for r in df.collect())


def shared_starts(n, seed):
    """Conversations that share starts of all lengths, whole conversations and one very common one."""
    r = random.Random(seed)
    out = []
    for c in range(n):
        turns = [f"t{r.choice('ab' if k else 'abcde')}" for k in range(r.choice([0, 1, 2, 3, 3, 5, 9]))] if c % 3 else ["same"] * 4
        out += [(c, k, "ua"[k % 2], t, None, None) for k, t in enumerate(turns or ["only"])]
    return out


@pytest.mark.parametrize(("most_members", "most_turns"), [(4096, 65_536), (2, 10**9), (10**9, 6)])
def test_trie_against_every_prefix(spark, most_members, most_turns):
    rows = shared_starts(70, most_members % 7)
    got = burst_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), most_members=most_members, most_turns=most_turns)
    assert collected(got) == trie_by_hand(rows)


def test_trie_bursts_long_common_start(spark):
    rows = [(c, t, "user", f"start {t}" if t < 300 else f"{c % 7} {t}", None, None) for c in range(0, 100, 5) for t in range(300 + c % 4)]
    assert collected(burst_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), most_members=2)) == trie_by_hand(rows)


def test_trie_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    assert collected(burst_trie.conversation_trie(df)) == trie_by_hand(EDGE)
    assert burst_trie.conversation_trie(df.limit(0)).count() == 0
    assert burst_trie.conversation_trie(df.where("conv_id IS NULL")).count() == 0


def test_op11_against_every_prefix(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op11_burst_trie"](spark, sf)) == trie_by_hand(rows)


def edits_by_hand(rows):
    """Cheapest edits by best-first search over (cost, letters); rows: (role, text, fault)."""
    heap, most, done = [(0, "", 0, "", ())], 2 * len(rows) + 10, collections.Counter()
    while heap:
        cost, letters, i, roles, turns = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, turns
        state = (i, roles[-1:])
        done[state, cost, letters] += 1
        if done[state, cost, letters] > 1 or cost > most:
            continue
        step = lambda more, letter, n, role=None, text="": heapq.heappush(heap, (cost + more, letters + letter, i + n, roles + (role or "")[:1], turns + ((role, text),) * (role is not None)))  # noqa: E731, B023
        for role in ("user", "assistant"):
            if re.fullmatch("(s?(ua)*u?)?", roles + role[0]):
                step(5, "I", 0, role)
        if i < len(rows):
            role, text, fault = rows[i]
            step(2, "D", 1)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for letter, to, c in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if to[:1] and re.fullmatch("s|(s?(ua)*u?)?", roles + to[:1]):
                        step(c + extra, letter, 1, to, text)
    raise AssertionError


def repair_by_hand(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        kept, how = convs[c], crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        if how:
            kept += [(turn, role, text)] * (1 + (how == 3))
    out = []
    for c, kept in convs.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()))
        seen, judged = set(), []
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [x[0] for x in kept if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") or not (a[0] and b[0]) for a, b in itertools.pairwise(judged))
        cost, letters, mended = edits_by_hand(judged)
        faults = [sum(x[2] == f for x in judged) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *faults, illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_auction_against_best_first_search():
    r = random.Random(5)
    for k in range(400):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), "x", r.choice(["", "", "", "blank", "truncated"])) for _ in range(r.randint(0, 9))]
        kinds = bytes(turn_repair.kind_of(role[:1], {"": 0, "blank": 1, "truncated": 2}[fault]) for role, _, fault in rows)
        assert turn_repair.cheapest_edits(kinds) == edits_by_hand(rows)[:2], (k, rows)


def test_auction_across_blocks():
    """Blocks of three rows give what one block of all gives; long conversations take time in proportion."""
    r = random.Random(6)
    for _ in range(100):
        kinds = bytes(r.randrange(turn_repair.END) for _ in range(r.randint(1, 30)))
        whole = turn_repair.cheapest_edits(kinds)
        turn_repair.BLOCK, kept = 3, turn_repair.BLOCK
        try:
            assert turn_repair.cheapest_edits(kinds) == whole
        finally:
            turn_repair.BLOCK = kept
    cost, letters = turn_repair.cheapest_edits(bytes([turn_repair.kind_of("u", 0), turn_repair.kind_of("a", 0)] * 50_000))
    assert cost == 0 and letters == "K" * 100_000


@pytest.mark.parametrize("kind", ["given", "edge", "random"])
def test_op13_against_best_first_search(spark, sf, kind):
    if kind == "given":
        got, rows = queries.QUERIES["op13_turn_repair"](spark, sf), [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    else:
        r = random.Random(3)
        rows = [x for x in EDGE if x[0] not in (11, 13)] if kind == "edge" else [(c, r.choice([None, *range(12)]), r.choice(["system", "user", "assistant"]), r.choice(["one.", "two!", "cut", "\t", None]), None, None) for c in range(60) for _ in range(r.randint(1, 8))]
        got = turn_repair.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == repair_by_hand(rows)


def test_repaired_turns_are_what_the_digest_reads(spark, sf):
    rows = turn_repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    turns = collections.defaultdict(list)
    for r in turn_repair.repaired_turns(rows, turn_repair.plan_repairs(rows)).orderBy("conv_id", "place").collect():
        assert r["place"] == len(turns[r["conv_id"]])
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert (r["edit"] == "I") == (r["turn"] is None)
    for r in queries.QUERIES["op13_turn_repair"](spark, sf).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns[r["conv_id"]]))
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(turns[r["conv_id"]]).encode()).hexdigest()


def test_repair_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    got = {r["conv_id"]: r for r in turn_repair.repair_report(df).collect()}
    assert set(got) == {0, 5, None, 7, -3, 11, 13}
    assert turn_repair.repair_report(df.limit(0)).count() == 0
    gone = next(c for c in itertools.count() if crc(f"{c}:0") % 20 == 0)
    assert [tuple(r) for r in turn_repair.repair_report(spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", burst_trie.NO_ENDS)]
