"""The training-data operators against brute force, exact round trips and held-out labels, and their edge cases."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sonolith.llm import brown_lm, decontam, exact_dedup, oracles, pii, queries, repair, sentence_spans, simhash, sp_viterbi, tool_calls, toxicity

#: Null and repeated ids, null, empty, blank and very long texts, repeated rows, and columns whose names operators use themselves.
EDGE = [(1, "", "a", 1), (2, None, "b", 2), (None, "  ", "c", 3), (3, "a b c d e f " * 20_000, "d", 4), (3, "a b c d e f " * 20_000, "d", 4), (3, "x" * 60_000, "e", 5), (4, "one two", None, None)]
EDGE_SCHEMA = "doc_id long, text string, keep_id string, word long"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(name, spark, sf, duck, same):
    same(queries.QUERIES[name](spark, sf), duck, oracles.SQL[name])


def test_op1_base_scores_and_gain(spark, sf, rows):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_brown_class_lm"](spark, sf).collect()}
    c = collections.Counter()
    for i, t in rows.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*brown_lm.tokens(t), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in rows.items():
        words, r = [*brown_lm.tokens(t), "\n"], got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    for held in (True, False):
        assert sum(r["score"] for r in got.values() if r["held_out"] == held) > sum(r["base_score"] for r in got.values() if r["held_out"] == held)


def test_op1_score_is_the_formula(spark, monkeypatch):
    """Scores of a small corpus from its own counts, given the classes; with so few heavy words that most go through the join."""
    monkeypatch.setattr(brown_lm, "HEAVY", 40)
    monkeypatch.setattr(brown_lm, "UNITS", 15)
    r = random.Random(2)
    texts = {i: " ".join(f"{r.choice('abcd')}{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randint(0, 40))) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    learnt = [t.lower().encode().split() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    training = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    counts = brown_lm.count_words(training).cache()
    model = brown_lm.fit(training, counts)
    assert len(model.words.heavy) == 40 and model.words.first_group == 16
    cls = lambda w: int(model.classes[model.words.units([w])[0][0]])
    c = collections.Counter(w for ws in learnt for w in ws)
    n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    bigrams, total, kinds = collections.Counter(), collections.Counter({0: len(learnt)}), collections.Counter({0: 1})
    for ws in learnt:
        path = [0, *map(cls, ws), 0]
        bigrams.update(zip(path, path[1:], strict=False))
    for w, k in c.items():
        total[cls(w)] += k
        kinds[cls(w)] += 1
    all_ = sum(total[k] + 0.5 for k in range(brown_lm.CLASSES))
    after = collections.Counter()
    for (a, _), k in bigrams.items():
        after[a] += k

    def score(ws):
        path = [0, *map(cls, ws), 0]
        out = sum(math.log10((bigrams[a, b] + brown_lm.PRIOR * (total[b] + 0.5) / all_) / (after[a] + brown_lm.PRIOR)) for a, b in zip(path, path[1:], strict=False))
        return out + sum(math.log10((c[w] - d) / total[cls(w)]) if c[w] else math.log10(d * kinds[cls(w)] / total[cls(w)]) for w in ws)

    for x in brown_lm.class_model_scores(docs).collect():
        assert x["score"] == pytest.approx(score(texts[x["doc_id"]].encode().split()), rel=1e-9)


def test_op1_contexts_keep_both_sides_apart(spark):
    """Neighbours after and before a unit are columns of their own, so that sums of classes read one side and a round half of the units."""
    r = random.Random(2)
    bigrams = collections.Counter((r.randrange(9), r.randrange(9)) for _ in range(60))
    got = brown_lm.contexts(spark.createDataFrame([(a, b, n) for (a, b), n in bigrams.items()], "left int, right int, n long")).collect()
    assert {x["unit"] for x in got} == {u for pair in bigrams for u in pair}
    for x in got:
        assert dict(zip(x["after"], x["n_after"], strict=True)) == {b: n for (a, b), n in bigrams.items() if a == x["unit"]}
        assert dict(zip(x["before"], x["n_before"], strict=True)) == {a: n for (a, b), n in bigrams.items() if b == x["unit"]}
        assert x["half"] == zlib.crc32(str(x["unit"]).encode()) % 2


def test_op1_exchange_raises_the_likelihood(spark):
    r = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(150)], [f"v{i}" for i in range(150)]
    texts = [" ".join(f"the {r.choice(nouns)} {r.choice(verbs)}" for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = brown_lm.count_words(docs).cache()
    words = brown_lm.vocabulary(counts, 300)
    table = brown_lm.contexts(brown_lm.unit_bigrams(docs, words)).cache()
    start = 1 + np.arange(words.n_units) % (brown_lm.CLASSES - 1)
    start[0] = 0
    classes, m = brown_lm.cluster(table, words)
    assert brown_lm.likelihood(m) > brown_lm.likelihood(brown_lm._class_bigrams(table, start))
    of = lambda ws: {int(classes[words.units([w.encode()])[0][0]]) for w in ws}
    assert not of(nouns) & of(verbs) and not of(nouns) & of(["the"])


def test_op1_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, "a b c d a b a" if i % 2 else "x y z x y w") for i in range(40)], "doc_id long, text string")
    m = brown_lm.fit(docs, brown_lm.count_words(docs).cache())
    assert (10**m.transition).sum(axis=1) == pytest.approx(np.ones(brown_lm.CLASSES))
    for k in set(m.classes[m.words.unit[:-1]]):
        inside = 10 ** m.heavy_emission[m.classes[m.words.unit[:-1]] == k]
        assert inside.sum() + 10 ** m.unknown[k] == pytest.approx(1.0)


def test_op1_edges(edge):
    got = brown_lm.class_model_scores(edge).collect()
    assert len(got) == 7 and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t, *_ in EDGE)
    assert brown_lm.class_model_scores(edge.limit(0)).count() == 0
    assert len(brown_lm.class_model_scores(edge.where("doc_id = -1 OR crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")).collect()) == sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in EDGE if i is not None)


def test_op2_files_hold_the_ids(spark, sf, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, at = {r["doc_id"]: r for r in queries.QUERIES["op2_repair_token_ids"](spark, sf).collect()}, 0
    for i in sorted(rows):
        ids = [*t.encode(rows[i] or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op2_encoder_equals_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = repair.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    r = random.Random(0)
    texts = ["Théa&&& naïve!! THE.!! ma\u0301n-- ǅ. 漢字, Ωmega### a_b x2 &&& 5% _x", *("".join(r.choice(["word", "é", "ß", "ω", "漢", "&&&", "!!", ".", "'s", "7", " ", "\n", "_", "\u0301", "\U0001e4d0", "\U0001f600"]) for _ in range(r.randint(1, 25))) for _ in range(1500)),"", " ", "\n", "a  b", " a\n", "a \nb", "x\0y", "<|endoftext|> it's", "it's. I'll, we've!", "x　y z ", *("".join(r.choice("ab'.,!1é \n\t漢") for _ in range(r.randint(1, 60))) for _ in range(400))]
    for x in texts:
        assert e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, x
    other = public_tokenizers.path("word_bpe_49k.json")  # not byte-level: texts go to the library whole
    assert repair.Encoder(other).encode("It's a  Word").tolist() == Tokenizer.from_file(other).encode("It's a  Word", add_special_tokens=False).ids


def test_op2_compression_and_random_access():
    r = np.random.default_rng(0)
    for values, big in ((4, 900), (1, 900), (4, 200_000), (3_000, 200_000)):  # with rules beyond FLAT, and without
        docs = [r.choice(np.append(np.arange(values), big).astype(np.uint32), size=n) for n in (1, 2, 700, 1, 5000, 1, 1)]
        ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        terminals, rules, lengths, symbols, cuts = repair.compress(ids, ends)
        coded = terminals, rules, lengths
        assert (len(symbols) < len(ids) or values > 100) and (repair.decode(*coded, symbols) == ids).all()
        for a, b, d in zip([0, *cuts[:-1]], cuts, docs, strict=True):
            assert (repair.decode(*coded, symbols[a:b]) == d).all()
        for a, b in ((0, 1), (3, 4000), (5000, 5705)):
            assert (repair.decode_range(*coded, symbols, a, b) == ids[a:b]).all()


def test_op2_replaces_until_no_pair_pays():
    r = np.random.default_rng(1)
    text = r.integers(0, 50, 2_000)
    docs = [text.copy() for _ in range(40)] + [np.zeros(3_000, dtype=np.int64)] + [r.integers(0, 50, 50) for _ in range(200)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    terminals, rules, lengths, symbols, cuts = repair.compress(ids, ends)
    assert lengths.max() >= 2_000 and cuts[0] == 1  # a passage that repeats becomes one symbol
    last = set((cuts - 1).tolist())
    pairs, before = collections.Counter(), None
    for i in range(len(symbols) - 1):
        pair = None if i in last else (int(symbols[i]), int(symbols[i + 1]))
        if pair and not (pair == before and pair[0] == pair[1]):  # overlapping pairs of one symbol count once
            pairs[pair] += 1
            before = pair
        else:
            before = None
    assert max(pairs.values()) < repair.LEAST_COUNT
    assert len({tuple(x) for x in rules.tolist()}) > 0.99 * len(rules)  # a pair that lost places to another one may get a second rule


def test_op2_reads_ranges_of_the_files(spark, sf, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_IDS", 5_000)
    blocks = repair.write_ids(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    every = [(r["doc_id"], i) for r in repair.read_ids(blocks).orderBy("start").collect() for i in r["ids"]]
    assert blocks.count() > 8
    for a, b in ((0, 1), (4_990, 26_000), (len(every) - 3, len(every) + 9), (17, 17)):
        got = repair.read_range(blocks, a, b).orderBy("start").collect()
        assert [(r["doc_id"], i) for r in got for i in r["ids"]] == every[a:b] and all(every[r["start"]][0] == r["doc_id"] for r in got)


def test_op2_edges(edge):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = repair.read_ids(repair.write_ids(edge, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3, 4] and [len(r["ids"]) for r in got] == [r["n_tokens"] for r in got]
    assert repair.read_ids(repair.write_ids(edge.limit(0), path)).count() == 0


def test_op3_links_orders_and_validates(spark):
    calls = [("a", "1", 1, "answer", '{"text":"x","words":1,"after":{"$ref":"2"}}'), ("a", "2", 2, "answer", '{"words":1, "text":"é"}'), ("a", "3", 3, "answer", '{"text":"y","words":"2","after":{"$ref":"4"}}'), ("a", "4", 4, "answer", '{"text":"y","words":2,"after":{"$ref":"3"}}'), ("a", "2", 5, "greet", "nope"), ("b", "9", 1, "what", None), (None, None, 1, None, None), ("b", "8", 2, "answer", '{"text":"q","words":900,"z":1,"after":{"$ref":"77"}}')]
    c = spark.createDataFrame(calls, "conv_id string, call_id string, seq long, name string, arguments string")
    r = spark.createDataFrame([("a", "2", 9, "r2"), ("a", "2", 8, "r1"), ("b", "5", 1, "lost"), (None, None, 1, "x"), ("b", "9", 3, None)], "conv_id string, call_id string, seq long, content string")
    s = spark.createDataFrame([(k, tool_calls.canonical(v)) for k, v in tool_calls.SCHEMAS.items()], "name string, schema string")
    got = {(x["conv_id"], x["call_id"], x["seq"]): x for x in tool_calls.link_tool_calls(c, r, s).collect()}
    assert len(got) == 9
    assert got["a", "2", 2]["record"] == '{"arguments":{"text":"é","words":1},"call_id":"2","name":"answer","result":"r1"}'
    assert [got["a", k, int(k)]["level"] for k in "1234"] == [1, 0, None, None]
    assert got["a", "2", 5]["record"] == '{"arguments":"nope","call_id":"2","name":"greet"}' and got["a", "2", 5]["errors"] == ["$: not JSON"]
    assert got["b", "9", 1]["record"] == '{"arguments":{},"call_id":"9","name":"what","result":null}' and got["b", "5", None]["record"] == '{"call_id":"5","result":"lost"}'
    assert got["a", "2", 5]["status"] == "repeated" and got["b", "5", None]["status"] == "orphan" and got["b", "9", 1]["status"] == "linked"
    assert got["b", "8", 2]["errors"] == ["$.words: more than 250", "$.z: not allowed", "reference: unknown"]
    assert tool_calls.link_tool_calls(c.limit(0), r.limit(0), s).count() == 0


def depth(edges, x, behind=()):
    """Longest chain of references behind ``x``; None in or behind a cycle."""
    if x in behind:
        return None
    below = [depth(edges, y, (*behind, x)) for y in edges.get(x, ())]
    return None if None in below else 1 + max(below) if below else 0


@pytest.mark.parametrize("in_one_task", [0, 10**6])
def test_op3_levels(spark, in_one_task):
    r = random.Random(6)
    calls, want = [], {}
    for conv in range(30):
        n = r.randint(1, 9)
        edges = {i: sorted({r.choice(range(n)) for _ in range(r.choice([0, 1, 1, 2]))} - {i}) for i in range(n)}
        calls += [(conv, f'k"{i}', i, "t", json.dumps({"a": [{"$ref": f'k"{j}'} for j in edges[i]]})) for i in range(n)]
        want |= {(conv, i): depth(edges, i) for i in range(n)}
    calls += [(99, str(i), i, "t", json.dumps({"$ref": str(i + 1)}) if i < 300 else "{}") for i in range(301)]
    want |= {(99, i): 300 - i for i in range(301)}
    df = spark.createDataFrame(calls, "conv_id int, call_id string, seq int, name string, arguments string").repartition(5)
    none = spark.createDataFrame([], "conv_id int, call_id string, seq int, content string")
    got = tool_calls.link_tool_calls(df, none, spark.createDataFrame([("t", "{}")], "name string, schema string"), in_one_task).collect()
    assert {(x["conv_id"], x["seq"]): x["level"] for x in got} == want and None in want.values() and max(x for x in want.values() if x is not None) == 300
    assert not any(x["errors"] for x in got)


def test_op3_hostile_arguments(spark):
    deep = "[" * 100_000 + "]" * 100_000
    given = [deep, '{"a":NaN}', '{"a":1e999}', '{"s":"\\ud800","$ref":"k\\\\"}', '{"a":1', "9" * 5_000, None]
    calls = spark.createDataFrame([(1, str(i), i, "t", a, "clash") for i, a in enumerate(given)] + [(2, "x", 1, "t", "{}", "")] * 3, "conv_id int, call_id string, seq int, name string, arguments string, status string")
    results = spark.createDataFrame([(2, "x", 1, 'q"\n\u2028é')], "conv_id int, call_id string, seq int, content string")
    got = tool_calls.link_tool_calls(calls, results, spark.createDataFrame([("t", "{}"), (None, "x")], "name string, schema string")).collect()
    one = {x["seq"]: x for x in got if x["conv_id"] == 1}
    assert [one[i]["errors"] for i in range(7)] == [["$: nested too deeply"], ["$: not JSON"], ["$: not JSON"], ["reference: unknown"], ["$: not JSON"], ["$: not JSON"], []]
    assert one[3]["record"] == '{"arguments":{"$ref":"k\\\\","s":"\\ud800"},"call_id":"3","name":"t"}'
    assert all(isinstance(json.loads(x["record"]), dict) for x in got)
    assert sorted(x["status"] for x in got if x["conv_id"] == 2) == ["linked", "repeated", "repeated"]
    assert next(x for x in got if x["status"] == "linked")["record"] == '{"arguments":{},"call_id":"x","name":"t","result":"q\\"\\n\u2028é"}'


def test_op3_query_is_brute_force(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {(r["conv_id"], r["turn"]): r for r in t}
    calls = {k for k, r in by.items() if r["role"] == "assistant"}
    step = lambda n: 2 if n % 8 == 1 else None if n == 3 else -4 if n % 8 == 3 else -2
    refs = {(c, n): [(c, n + s)] for c, n in calls if (s := step(n)) is not None and n + s > 0}
    edges = {k: [x for x in v if x in calls] for k, v in refs.items()}
    got = {(r["conv_id"], r["call_id"]): r for r in queries.QUERIES["op3_tool_call_linking"](spark, sf).collect()}
    lost = {(c, f"t{n - 1}") for (c, n), r in by.items() if r["role"] == "user" and n > 0 and (c, n - 1) not in calls}
    assert set(got) == {(c, f"t{n}") for c, n in calls} | lost
    for c, n in calls:
        x, text = got[c, f"t{n}"], by[c, n]["text"]
        answer = by.get((c, n + 1))
        linked = answer is not None and answer["role"] == "user"
        words = len([w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w])
        arguments = {"words": words} | ({"text": text} if text is not None else {}) | ({"after": {"$ref": f"t{refs[c, n][0][1]}"}} if (c, n) in refs else {})
        record = {"arguments": arguments, "call_id": f"t{n}", "name": "greet" if n <= 1 else "answer"} | ({"result": answer["text"]} if linked else {})
        errors = (["$.text: missing"] if text is None else []) + (["$.words: less than 1"] if words < 1 else []) + ([f"$.words: more than {50 if n <= 1 else 250}"] if words > (50 if n <= 1 else 250) else []) + (["reference: unknown"] if (c, n) in refs and not edges[c, n] else [])
        assert json.loads(x["record"]) == record and x["record"] == tool_calls.canonical(record)
        assert (x["status"], x["level"], x["errors"]) == ("linked" if linked else "pending", depth(edges, (c, n)), "; ".join(errors))


def test_dropping_keeps_columns_of_any_name(spark):
    rows = [(1, "same", "a", 1, "x"), (2, "same", "b", 2, "y"), (2, "same", "b", 2, "y"), (None, None, None, None, None), (4, "", "c", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a``b` string, `c.d` long, mark string")
    for got, ids in ((exact_dedup.drop_exact_duplicates(df), [2, 4]), (simhash.drop_near_duplicates(df), [1, 4])):
        assert got.columns == df.columns
        kept = sorted((tuple(r) for r in got.collect()), key=repr)
        assert kept == sorted((next(r for r in rows if r[0] == i) for i in ids), key=repr)


def test_op3_schemas_of_all_kinds():
    """Legal ones, and ones that nobody can read: errors of the tool, never a crash and never the arguments' fault."""
    given = '{"a":1,"b":[true,"x"],"c":{"d":null}}'
    for schema in ("true", "{}", '{"properties":{"a":true}}', '{"type":["object","null"]}', '{"additionalProperties":{}}', '{"enum":[{"a":1,"b":[true,"x"],"c":{"d":null}}]}', '{"format":5}'):
        assert tool_calls.check(given, schema)[1] == [], schema
    for schema in ("", "null", "[]", "3", '"x"', "{", '{"type":5}', '{"type":"thing"}', '{"type":[["object"]]}', '{"minimum":"a"}', '{"maximum":true}', '{"required":"a"}', '{"required":[1]}', '{"properties":[]}', '{"properties":{"a":{"items":[]}}}', '{"enum":1}', '{"additionalProperties":3}', "[" * 100_000, '{"items":' * 100_000):
        assert tool_calls.check(given, schema) == (given, ["tool: bad schema"], []), schema[:40]
    for schema, errors in {
        "false": ["$: not allowed"],
        '{"properties":{"a":false}}': ["$.a: not allowed"],
        '{"properties":{"a":true},"additionalProperties":false}': ["$.b: not allowed", "$.c: not allowed"],
        '{"additionalProperties":{"type":"integer"}}': ["$.b: not of type integer", "$.c: not of type integer"],
        '{"properties":{"a":{"enum":[true]},"b":{"items":{"type":"boolean"}}}}': ["$.a: not one of the allowed values", "$.b[1]: not of type boolean"],
    }.items():
        assert tool_calls.check(given, schema)[1] == errors, schema
    assert tool_calls.check("not json", "[]")[1] == ["$: not JSON"]


def test_op4_edges(spark, edge):
    bench = spark.createDataFrame([(1, "A b, c d e"), (1, None), (None, "ONE"), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontam.find_overlap(edge, bench, window=10).collect()}
    assert got[3, 120_000]["item_ids"] == ["1"] and got[3, 120_000]["n_hit"] == 100_000
    assert got[4, 2]["item_ids"] == [""] and got[4, 2]["spans"][0].asDict() == {"start": 0, "end": 3}
    assert got[1, 0]["n_hit"] == 0
    assert decontam.find_overlap(edge, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.drop_contaminated(edge, bench).count() == 4
    assert decontam.find_overlap(edge.limit(0), bench).count() == 0


def test_op4_many_blocks_give_the_same(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(str, decontam.contamination_report(d, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert sorted(map(str, decontam.contamination_report(d, b).collect())) == one
    clean = {r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()}
    monkeypatch.setattr(decontam, "HELD_CHARS", 1)
    assert clean == {r["doc_id"] for r in decontam.contamination_report(d, b).where("NOT contaminated").collect()}


def best_path(m, s):
    best = [(0.0, 0, 0)] + [(-1e18, 0, 0)] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - m.longest), j):
            id_ = m.prefixes.get(s[i:j], -2)
            if id_ < 0 and j > i + 1:
                continue
            c = best[i][0] + (m.scores[id_] if id_ >= 0 else m.unknown)
            if c > best[j][0]:
                best[j] = (c, i, id_)
    out, j = [], len(s)
    while j:
        _, i, id_ = best[j]
        out.append([id_] if id_ >= 0 else [m.byte_ids[b] for b in s[i:j].encode()])
        j = i
    return [x for part in reversed(out) for x in part]


def test_op5_is_the_best_path_and_comes_back(rows):
    m = sp_viterbi.Pieces.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    texts = [*list(rows.values())[:40], "", " ", "  a  b\n\tç漢字😀▁x", "x" * 2_000, "abcdefgh" * 300, *("".join(r.choice("aehtnioé \n#") for _ in range(r.randint(1, 300))) for _ in range(100))]
    for t in texts:
        t = (t or "")[:4_000]
        s = "▁" + t.replace(" ", "▁") if t else ""
        ids = m.encode(t).tolist()
        assert ids == best_path(m, s)
        cuts = sorted(r.sample(range(len(s) + 1), min(len(s), 5)))
        assert [i for part in m.stream(s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)) for i in part] == ids
        assert m.decode(ids) == t.replace("▁", " ")
        assert m._short(s) == ids


def test_op5_commits_early():
    """Where the pieces' scores differ, paths converge soon: ids come long before the text ends, a few at a time."""
    r = random.Random(2)
    every = [p for n in range(1, 5) for p in map("".join, itertools.product("ab", repeat=n))]
    m = sp_viterbi.Pieces([(i, p, -len(p) - r.random()) for i, p in enumerate(every)], {b: 300 + b for b in range(256)})
    text = "".join(r.choice("ab") for _ in range(5_000))
    parts = list(m.stream(text))
    assert [i for p in parts for i in p] == best_path(m, text) and max(map(len, parts)) <= 40 and len(parts) > 100


def test_op5_periodic_texts():
    """Paths that never meet: right ids on short ones, time in proportion to the length and a decoded text on long ones."""
    m = sp_viterbi.Pieces.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    for unit in ("u", "t", "uoh", "uic", "tbr", "ab"):
        for n in (1, 7, 300, 1501):
            assert m.search(unit * n) == best_path(m, unit * n)
    took = []
    for n in (50_000, 400_000):
        began = time.process_time()
        parts = list(m.stream(itertools.repeat("uoh" * 64, n // 192)))
        took.append(time.process_time() - began)
        assert m.decode([i for p in parts for i in p]) == "uoh" * (64 * (n // 192))
    assert took[1] < 20 * took[0]  # a square would be 64 times
    assert m.decode(m.search("u" * 1_000_000)) == "u" * 1_000_000


def test_op5_edges(edge):
    got = sp_viterbi.encode_documents(edge, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == 7 and sorted(r["text"] for r in got) == sorted(t or "" for _, t, *_ in EDGE)
    assert sp_viterbi.encode_documents(edge.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_op6_kernel_is_the_sum_over_triples():
    words = toxicity.word_parts(["idiot", "idxiot", "studio", "aaaa"])

    def explicit(w):
        out = collections.Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x = [explicit(w) for w in words]
    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    want = np.array([[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in x] for a in x])
    assert toxicity.Kernel(words).of(words) == pytest.approx(want, abs=1e-3)


def test_op6_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id", "left_semi").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    model = toxicity.fit(*toxicity.labelled_sample(docs, labels))
    got = toxicity.score_texts(known, model).join(labels, "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got)
    assert right / len(got) > 0.97
    memory = toxicity.Largest(model.kernel)
    score = lambda t: model.score(memory.of([toxicity.distinct_words(t)]))[0]
    assert min(map(score, ("an idiot.", "i d i o t", "i-d-i*o.t", "id1ot"))) > 0.5 > max(map(score, ("", "the studio", "a mormon")))


def test_op6_reads_sampled_texts_whole(spark):
    r = random.Random(8)
    mark = max((f"zorq{k}" for k in "abcdefghijklmnop"), key=lambda w: zlib.crc32(w.encode()))
    letters = "abcdefghijklmnopqrstuvwxy"
    rows = [(i, " ".join("".join(r.choice(letters) for _ in range(10)) for _ in range(40_000 if i % 2 else 50)) + (f" {mark}" if i % 2 else ""), i % 2) for i in range(24)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.labelled_sample(docs, labels))
    assert model is not None and f"\x02{mark}\x03" in model.kernel.landmarks


def test_op6_edges(spark, edge):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(edge, labels).collect())
    assert toxicity.toxicity_scores(edge, labels.limit(0)).count() == 7 and toxicity.toxicity_scores(edge.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(edge, labels).count() == 7


def test_op7_links_and_components(spark, sf, rows):
    got = queries.QUERIES["op7_simhash_near_dedup"](spark, sf).collect()
    for r in got[:30]:
        words = rows[r["doc_id"]].encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        assert r["fingerprint"] == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"
    check_components({r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got})


def check_components(found):
    prints = np.array([v[0] for v in found.values()], dtype=np.uint64)
    ids, root = list(found), list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
            root[top(i + 1 + int(j))] = top(i)
    least = {}
    for k, i in enumerate(ids):
        least[top(k)] = min(least.get(top(k), i), i)
    assert all(found[i][1] == least[top(k)] for k, i in enumerate(ids))


def test_op7_every_pair_within_four_bits_once(spark):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in (1, 2, 3, 4, 5):
            q = p
            for b in r.sample(range(64), n):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert len(got) == len(set(got)) and set(got) == want
    path = [(i, i + 1) for i in range(60)]
    roots = simhash.components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {x["node"]: x["root"] for x in roots} == {i: 0 for i in range(61)}


def test_op7_entries_are_not_broadcast(spark):
    """Spark takes 66 entries a fingerprint for one and would broadcast those of a table under its threshold."""
    met = simhash.links(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    met.collect()
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_op7_edges(edge):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == 7 and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.drop_near_duplicates(edge).count() == 4
    assert simhash.near_duplicates(edge.limit(0)).count() == simhash.drop_near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "few", "planned"), [(1 << 20, 16, 1 << 14), (1 << 20, 4, 20), (30, 16, 60), (0, 16, 60)])
def test_near_dedup_meets_what_shares_a_key(spark, monkeypatch, most, few, planned):
    """Every pair within two bits of a segment and ``APART`` bits in all is linked, through blocks, large buckets, and blocks that no task holds."""
    monkeypatch.setattr(simhash, "MOST_PRINTS", most)
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK_PRINTS", planned)
    r = np.random.default_rng(3)
    heads = r.integers(-(2**63), 2**63, size=(6, 3))
    prints = [heads[i % 6].copy() for i in range(150)]
    for p in prints:
        for b in r.integers(0, 192, size=r.integers(0, r.choice([3, 40]))):
            p[b // 64] ^= np.int64(np.uint64(1 << int(b % 64)).view(np.int64))
    prints = np.unique(np.array(prints), axis=0)
    segments = np.stack([simhash._segment(prints, j) for j in range(8)], axis=1)
    want = set()
    for i, j in itertools.combinations(range(len(prints)), 2):
        if simhash._apart_bits(prints[i : i + 1], prints[j : j + 1])[0] <= simhash.APART and (np.bitwise_count(segments[i] ^ segments[j]) <= 2).any():
            want.add((tuple(prints[i].tolist()), tuple(prints[j].tolist())))
    nodes = spark.createDataFrame([tuple(map(int, p)) for p in prints], "s0 long, s1 long, s2 long")
    met = simhash._met_in_blocks(nodes).collect()
    pairs = {(tuple(x[:3]), tuple(x[3:6])) for x in met if x["key"] is None}
    crowded = collections.defaultdict(set)
    for x in met:
        if x["key"] is not None:
            crowded[x["key"]].add(tuple(x[:3]))
    linked = pairs | {(b, a) for a, b in pairs}
    together = {p for members in crowded.values() for p in itertools.permutations(members, 2)}
    assert want <= linked | together and {p for p in linked if p[0] < p[1]} <= {tuple(sorted(w)) for w in want} and len(want) > 100
    assert crowded or (few == 16 and most > 100)


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_near_dedup_makes_few_pairs_of_a_family_just_under_08(spark, monkeypatch, most):
    """Texts of one family that are not similar enough are not paired, those that are lose no link, and components found at first are not searched again link by link: in blocks and in blocks that no task holds."""
    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "MOST_PRINTS", most)
    made, searched = {}, []
    staged, components = simhash.staged, simhash.components

    def counted(df, name):
        out = staged(df, name)
        made[name] = out.count()
        return out

    def counting(pairs):
        searched.append(pairs.count())
        return components(pairs)

    monkeypatch.setattr(simhash, "staged", counted)
    monkeypatch.setattr(simhash, "components", counting)
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for n in range(300):
        text = list(texts[r.randrange(n)] if n > 150 and n % 3 == 0 else base)
        for at in r.sample(range(150), 1 if n % 3 == 0 else 4):
            text[at] = f"v{r.randrange(10**6)}"
        texts.append(text)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    similar = {(i, j) for i, j in itertools.combinations(range(300), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    hashes = [simhash.shingles_of(" ".join(t), 5) for t in texts]
    odd = [simhash.parities(h) for h in hashes]
    for i, j in itertools.combinations(range(300), 2):
        apart = int(simhash._apart_bits(odd[i][None], odd[j][None])[0])
        assert apart <= len(sets[i] ^ sets[j]) and ((i, j) not in similar or 9 * apart <= len(hashes[i]) + len(hashes[j]))
    root = list(range(300))
    for _ in range(300):
        for i, j in similar:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()}
    assert set(root) <= got and len(got - set(root)) <= 0.02 * (300 - len(set(root)))
    assert 100 < len(set(root)) < 290 and (most == 100 or made["met"] < 40 * 300)
    assert made["apart-pairs"] <= 300 and searched[1:] <= [made["roots"] + made["apart-pairs"]]


def test_pipeline_near_dedup_takes_similarity_of_08(spark):
    import corpus_pipeline

    r = random.Random(11)
    texts = []
    for _ in range(150):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 300))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for at in r.sample(range(len(base)), r.randint(1, max(1, len(base) // 30))):
                copy[at] = f"v{r.randrange(10**6)}"
            texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    want = {top(i) for i in range(len(texts))}
    assert 150 < len(want) < 450  # some copies are under 0.8 and must stay
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 1), (1, "a b", "x", "y", 1), (2, "a b", "p", "q", 2), (None, None, "r", "s", 3)], "doc_id long, text string, __digest string, mark string, row long")
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        kept = drop(docs)
        assert kept.columns == docs.columns and kept.schema == docs.schema and kept.count() == 2


def test_op8_edges(edge):
    got = exact_dedup.exact_dedup(edge).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 5
    assert {r["keep_id"] for r in got if r["group_size"] == 2} == {2, 3}
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(edge, keep="smallest").collect() if r["group_size"] == 2} == {1, 3}
    kept = exact_dedup.drop_exact_duplicates(edge)
    assert kept.columns == edge.columns and kept.count() == 5
    assert exact_dedup.exact_dedup(edge.limit(0)).count() == 0


def all_runs(texts):
    """What stays of each text by brute force, with an own cutting of sentences: every run of two or more sentences and twenty or more words, up to 40 sentences."""
    seen, out = set(), []
    for text in texts:
        parts = [p for line in re.split(r"(?<=\n)", text) for p in re.split(r"(?<=[.!?])(?=\s)", line)]
        pieces = []  # each with the white space after it
        for p in parts:
            if pieces and (not p.strip() or not pieces[-1].strip()):
                pieces[-1] += p
            else:
                pieces.append(p)
        for k in range(len(pieces) - 1, 0, -1):  # white space between two sentences goes with the first
            lead = len(pieces[k]) - len(pieces[k].lstrip())
            pieces[k - 1], pieces[k] = pieces[k - 1] + pieces[k][:lead], pieces[k][lead:]
        pieces = [p for p in pieces if p]
        words = [p.casefold().split() for p in pieces]
        gone, own = set(), []
        for a in range(len(pieces)):
            for b in range(a + 2, min(len(pieces), a + 40) + 1):
                run = tuple(w for ws in words[a:b] for w in ws)
                if len(run) >= 20:
                    if run in seen or run in own:
                        gone |= set(range(a, b))
                    own.append(run)
        seen.update(own)
        out.append("".join(p for k, p in enumerate(pieces) if k not in gone))
    return out


def test_op9_equals_brute_force_over_all_runs(spark):
    r = random.Random(9)
    sentence = lambda: " ".join(r.choice("aAbBcdeé") + str(r.randrange(40)) for _ in range(r.randint(1, 14))) + r.choice(".!?")
    pool = [sentence() for _ in range(60)]
    texts = []
    for _ in range(120):
        at = r.randrange(50)
        parts = [sentence() for _ in range(r.randint(0, 4))] + pool[at : at + r.randint(1, 9)] + [sentence() for _ in range(r.randint(0, 4))]
        texts.append("".join(p + r.choice([" ", "  ", "\n", " \n\n"]) for p in parts).strip())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {x["doc_id"]: x["text"] for x in sentence_spans.remove_repeated(docs).collect()}
    want = all_runs(texts)
    assert [got[i].split() for i in range(len(texts))] == [w.split() for w in want]
    assert sum(len(w) for w in want) < 0.8 * sum(len(t) for t in texts)


def test_op9_report(spark, sf, rows):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_sentence_span_dedup"](spark, sf).collect()}
    kept = {r["doc_id"]: r for r in sentence_spans.remove_repeated(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert set(got) == set(rows) == set(kept)
    for i, r in got.items():
        assert (r["n_removed"], r["kept_sha256"], r["kept_chars"]) == (kept[i]["n_removed"], hashlib.sha256(kept[i]["text"].encode()).hexdigest(), len(kept[i]["text"]))
        assert r["n_removed"] > 0 or kept[i]["text"] == rows[i]


def test_op9_removes_what_all_runs_would(spark):
    r = random.Random(4)
    sentence = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    passages = [[sentence(n) for n in sizes] for sizes in ((10, 10, 2, 2), (3, 3, 15, 1, 1, 1), (25, 2), (12, 7), (2, 2, 2, 30))]
    texts = [[sentence(r.randint(1, 12)) for _ in range(3)] + p + [sentence(r.randint(1, 12)) for _ in range(3)] for p in passages for _ in range(3)]
    seen, want = set(), []
    for t in texts:
        words, gone, own = [x.split() for x in t], set(), []
        for a, b in itertools.combinations(range(len(t) + 1), 2):
            if b - a >= 2 and sum(map(len, words[a:b])) >= 20:
                own.append(" ".join(t[a:b]))
                gone |= set(range(a, b)) if own[-1] in seen else set()
        seen.update(own)
        want.append(" ".join(x for k, x in enumerate(t) if k not in gone))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"].strip() for x in sentence_spans.remove_repeated(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_op9_edges(spark, edge):
    got = sentence_spans.remove_repeated(edge).collect()
    assert len(got) == 7 and sorted(r["text"] for r in got) == sorted(t or "" for _, t, *_ in EDGE)
    assert sentence_spans.remove_repeated(edge.limit(0)).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_op10_base_spans(spark):
    r = random.Random(5)
    texts = ["a@b.co_x@y.zz 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255", "+49 (0) 30 123456-78 x 4111 1111 1111 1111 4111-1111-1111-1112", "é😀 a@b.c", ".@a.b..c@d.e-f.g", *("".join(r.choice("0123456789.@ab+- ()é") for _ in range(r.randint(1, 90))) for _ in range(1_500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.personal_data_report(docs).collect():
        assert x["base_sha256"] == hashlib.sha256(base_spans(texts[x["doc_id"]]).encode()).hexdigest(), texts[x["doc_id"]]


def test_op10_added_kinds_and_context(spark):
    texts = ["Account DE89 3704 0044 0532 0130 00 here", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "no 123-45-6789", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in pii.find_personal_data(docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[0]] == [("iban", 8, 35)] and got[0][0]["score"] == pytest.approx(0.9)
    assert got[1] == [] and [s["kind"] for s in got[2]] == ["ssn"] and got[3] == [] and got[4] == []
    assert pii.redact(docs).where("doc_id = 0").first()["text"] == "Account <iban> here"


def test_op10_sql_has_the_added_kinds(spark):
    import duckdb

    texts = ["DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 00", "my ssn: 123-45-6789", "social security 123-45-6789 and 123-45-67890", "no 123-45-6789", "xDE89370400440532013000", "x@y.zz GB82WEST12345698765432.", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(oracles.SQL["op10_personal_data"]).fetchdf().set_index("doc_id")["spans"].to_dict()
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and want[0].count("iban") == 2 and "ssn" in want[1] and want[2].count("ssn") == 1 and want[3] == want[4] == ""


def test_op10_redacts_what_it_finds(spark, rows):
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in pii.find_personal_data(docs).collect()}
    for r in pii.redact(docs).collect():
        text, out, at = rows[r["doc_id"]] or "", "", 0
        for s in found[r["doc_id"]]:
            if s["start"] >= at:
                out, at = out + text[at : s["start"]] + f"<{s['kind']}>", s["end"]
        assert r["text"] == out + text[at:]


def test_op10_long_and_many(spark, edge):
    texts = ["1" * 40_000 + " " + "a." * 20_000 + "x@" + "b." * 10_000, "a@b.c " * 3_000]
    got = pii.personal_data_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[1]["n_email"] == 3_000 and got[1]["spans"].endswith("email:17994:17999")
    assert pii.personal_data_report(edge).count() == 7 and pii.personal_data_report(edge.limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Null ids, null, empty, blank and very long texts, repeated rows, a further column with a name that stages use; and no rows at all."""
    import corpus_pipeline

    given = spark.read.parquet(f"{sf}/documents.parquet").withColumn("mark", F.lit("kept"))
    long = " ".join(f"word{i * 7919 % 100_003}" for i in range(150_000))
    odd = [(None, "  ", "en", None, 2, "x"), (900_001, None, None, "s", None, "x"), (900_002, "", "en", "s", 0, None), (900_003, long, "en", "s", len(long), "x"), (900_003, long, "en", "s", len(long), "x"), (900_004, "Unheard-of phrase, all alone here.", "en", "s", 34, "y")]
    docs = given.unionByName(spark.createDataFrame(odd, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields))).repartition(5)
    ids = lambda df: sorted(df.where("doc_id IS NULL OR doc_id > 900000").select("doc_id").toPandas()["doc_id"].fillna(0).astype(int))
    stays = {"toxicity": [0, 900_001, 900_002, 900_003, 900_003, 900_004], "exact_dedup": [0, 900_002, 900_003, 900_004], "decontamination": [0, 900_001, 900_002, 900_003, 900_003, 900_004]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name == "encoding":
            texts = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
            assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == texts
        else:
            assert got.columns == docs.columns
            found = ids(got)
            assert found == stays[name] if name in stays else found in ([900_001, 900_003, 900_004], [900_003, 900_004]), name
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline(spark, sf, rows):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf).collect()
    model = sp_viterbi.Pieces.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    assert len({r["doc_id"] for r in got}) == len(got) > 0.5 * len(rows)
    texts = [rows[r["doc_id"]] for r in got]
    assert len(set(texts)) == len(texts)
    for r in got:
        assert r["text"] == rows[r["doc_id"]] and model.decode(r["ids"]) == r["text"]
    report = decontam.contamination_report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert not {r["doc_id"] for r in report.where("contaminated").collect()} & {r["doc_id"] for r in got}
    everything = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.exact_dedup(spark, everything, sf).columns == everything.columns == corpus_pipeline.near_dedup(spark, everything, sf).columns
