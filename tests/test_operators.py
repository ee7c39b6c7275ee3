"""Edge rules and properties that the given tables do not show."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions.scalars import draw
from sonolith.operators import cohorts, metrics, neighbours, ranks, replicates, reports, resampling, slices, synthesis


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_constant_input_has_no_rho(spark):
    rows = frame(spark, [("a", 1.0, float(i)) for i in range(8)] + [("b", float(i), float(-i)) for i in range(8)], "k string, x double, y double")
    assert {r["k"]: r["rho"] for r in ranks.spearman(rows, "x", "y", ["k"]).collect()} == {"a": None, "b": pytest.approx(-1.0)}


def test_too_few_rows_give_no_rho(spark):
    assert ranks.spearman(frame(spark, [(1.0, 2.0)] * 4, "x double, y double"), "x", "y", [], 5).count() == 0


def test_rank_plans_agree(spark):
    rng = np.random.default_rng(0)
    rows = frame(spark, [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True)], "k int, v double")
    a = sorted(map(tuple, ranks.average_rank(rows, "v", ["k"]).select("k", "v", "rank").collect()))
    assert a == sorted(map(tuple, ranks.average_rank(rows, "v", ["k"], plan="window").select("k", "v", "rank").collect()))


def test_all_tied_groups(spark):
    rows = frame(spark, [("a", 1.0)] * 6 + [("b", 1.0)] * 7, "g string, v double")
    got = ranks.mann_whitney(rows, "v", "g", []).first()
    assert got["delta"] == 0 and got["z"] is None
    assert ranks.kruskal(rows, "v", "g", []).first()["h"] is None


def test_delta_changes_sign_and_counts(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 20), rng.integers(3, 12, 15)
    rows = lambda p, q: frame(spark, [("a", float(v)) for v in p] + [("b", float(v)) for v in q], "g string, v double")
    one, two = (ranks.mann_whitney(rows(*s), "v", "g", []).first() for s in ((x, y), (y, x)))
    brute = np.mean(np.sign(x[:, None] - y[None, :]))
    assert one["delta"] == pytest.approx(brute) and two["delta"] == pytest.approx(-brute)
    assert one["u"] + two["u"] == 20 * 15


def test_adjusted_p_values(spark):
    rows = frame(spark, [(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.5, None])], "i int, p double")
    bh = [r["q"] for r in ranks.bh_adjust(rows, "p", []).orderBy("i").collect()]
    holm = [r["q"] for r in ranks.holm_adjust(rows, "p", []).orderBy("i").collect()]
    assert bh[:5] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5]) and bh[5] is None
    assert holm[:5] == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.5]) and holm[5] is None


def test_dprime_edges(spark):
    rows = frame(spark, [("few", i < 4, float(i)) for i in range(9)] + [("flat", i < 5, 1.0) for i in range(10)] + [("ok", i < 5, float(i * i)) for i in range(10)], "e string, positive boolean, z double")
    got = {r["e"]: r["dprime"] for r in metrics.dprime(rows, ["e"]).collect()}
    p, q = np.arange(5.0) ** 2, np.arange(5.0, 10) ** 2
    assert got["few"] is None and got["flat"] == 0 and got["ok"] == pytest.approx(abs(p.mean() - q.mean()) / math.sqrt((p.var() + q.var()) / 2))
    moved = {r["e"]: r["dprime"] for r in metrics.dprime(rows.withColumn("z", F.col("z") * 3 + 7), ["e"]).collect()}
    assert moved["ok"] == pytest.approx(got["ok"])


def test_symbol_of_both_classes_is_positive(spark):
    contrasts = frame(spark, [("f", "p", "positive"), ("f", "p", "negative"), ("f", "q", "negative")], "feature string, phone string, class string")
    got = metrics.classify(frame(spark, [("p",), ("q",), ("r",)], "phone string"), contrasts, on=()).select("phone", "positive").collect()
    assert sorted(map(tuple, got)) == [("p", True), ("q", False)]


def test_pooling_edges(spark):
    frames = frame(spark, [("u", i, [float(i)]) for i in range(10)], "utterance string, frame_idx int, vec array<float>")
    intervals = frame(spark, [("u", 0, 0.058, 0.06), ("u", 1, 0.1, 0.1), ("u", 2, 0.5, 0.9), ("u", 3, 0.16, 0.6)], "utterance string, phone_idx int, xmin double, xmax double")
    got = {r["phone_idx"]: (r["n_frames"], r["embedding"][0]) for r in metrics.pool_frames(frames, intervals).collect()}
    assert got == {0: (1, 2.0), 1: (1, 5.0), 3: (2, 8.5)}


def test_pooling_over_blocks(spark):
    """Intervals over several blocks, frames that are missing or there twice, equal intervals; frames of utterances or shared."""
    rng = np.random.default_rng(3)
    at = sorted([i for i in range(400) if i % 11 and not 130 <= i < 200] + [70, 300])
    rows = [(u, i, [float(x) for x in rng.normal(size=3)]) for u in ("u", "v") for i in at]
    spans = [(u, k, float(a), float(a + d)) for u in ("u", "v", "w") for k, (a, d) in enumerate([(0, 400), (5, 3), (60, 10), (64, 64), (135, 5), (120, 90), (-9, 12), (390, 90), (500, 1), (33, 0)])] * 2
    frames = frame(spark, rows, "utterance string, frame_idx int, vec array<float>")
    intervals = frame(spark, spans, "utterance string, phone_idx int, xmin double, xmax double")
    for within, mine in ((("utterance",), lambda u: [r for r in rows if r[0] == u]), ((), lambda u: [r for r in rows if r[0] == "u"])):
        given = frames if within else frames.where("utterance = 'u'").drop("utterance")
        got = {(r["utterance"], r["phone_idx"]): (r["n_frames"], r["embedding"]) for r in metrics.pool_frames(given, intervals, 1.0, within).collect()}
        hand = {}
        for u, k, a, b in set(spans):
            vectors = [np.float32(v) for _, i, v in mine(u) if a <= i < max(b, a + 1)]
            if vectors:
                hand[u, k] = (2 * len(vectors), pytest.approx(np.mean(vectors, axis=0, dtype=float)))
        assert got == hand


def test_pooled_frames_are_not_broadcast(spark):
    """Spark takes a day's frames of a user for one row and would broadcast all users'."""
    users = spark.range(50).select(F.col("id").alias("utterance"))
    frames = users.select("utterance", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("frame_idx")).withColumn("vec", F.array(F.col("frame_idx").cast("double")))
    pooled = metrics.pool_frames(frames, users.select("utterance", F.lit(1.0).alias("xmin"), F.lit(1.5).alias("xmax")))
    assert {tuple(r["embedding"]) for r in pooled.collect()} == {(62.0,)}  # frames 50 to 74
    assert "Broadcast" not in pooled._jdf.queryExecution().executedPlan().toString()


def test_permuted_labels_against_sorting(spark, monkeypatch):
    """Blocks and ranges of hashes of a few rows; label counts stay, rows without a label keep their place."""
    monkeypatch.setattr(replicates, "CELLS", 40)
    monkeypatch.setattr(replicates, "DRAWN", 24)
    labels = ["a", "b", "c", None]
    rows = [(k, 3 * i + 1, labels[i % (2 + k)], float(i * i), None if i % 5 == 0 else float(i)) for k in (0, 1, 2) for i in range(11 + 7 * k)]
    got = {(r["grp"], r["rep"], r["l"]): (r["v"], r["w"]) for r in replicates.permuted_means(frame(spark, rows, "grp int, id int, l string, v double, w double").repartition(4), ["grp"], "id", "l", ["v", "w"], 4, 9).collect()}
    hand = {}
    for k in (0, 1, 2):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for rep in range(1, 5):
            dealt = sorted(own, key=lambda r: (int(replicates.draws(np.array(rep), np.array(r[1]), 9)), r[1]))
            for name in "abc":
                its = [r for r, d in zip(own, dealt, strict=True) if d[2] == name]
                if its:
                    w = [r[4] for r in its if r[4] is not None]
                    hand[k, rep, name] = (pytest.approx(np.mean([r[3] for r in its])), pytest.approx(np.mean(w)) if w else None)
    assert got == hand


def drawn_by_hand(size, rep, seed):
    return [int(replicates.draws(np.array(rep), np.array(p), seed)) % size for p in range(size)]


def test_draws_are_those_of_the_column_function(spark):
    got = spark.range(200).select(draw(F.lit(7), F.col("id"), 3).alias("x")).collect()
    assert [r["x"] for r in got] == replicates.draws(np.array(7), np.arange(200), 3).tolist()


def test_weights_of_replicates_against_drawing(spark, monkeypatch):
    """Counts, means and rank correlations of bootstrap samples in blocks and slices of a few rows, with ties, nulls and a constant side."""
    monkeypatch.setattr(replicates, "CELLS", 60)
    monkeypatch.setattr(replicates, "DRAWN", 30)
    rng = np.random.default_rng(4)
    rows = [(k, i, float(rng.integers(0, 6)), None if i % 9 == 4 else float(rng.normal()) if k else 1.0) for k in range(3) for i in range(20 + 5 * k)]
    df = frame(spark, rows, "k int, id int, x double, y double").repartition(5)
    counted = replicates.with_counts(df, ["k"], "id", 6, 2)
    counts = {(r["k"], r["id"]): list(r["counts"]) for r in counted.collect()}
    means = {(r["k"], r["rep"]): (r["x"], r["y"]) for r in replicates.replicate_means(counted, ["k"], ["x", "y"], 6).collect()}
    rhos = {(r["k"], r["rep"]): (r["n"], r["rho"]) for r in replicates.replicate_spearman(counted, "x", "y", ["k"], 6).collect()}
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        for rep in range(1, 7):
            hits = drawn_by_hand(len(own), rep, 2)
            assert [counts[k, i][rep - 1] for i in range(len(own))] == [hits.count(i) for i in range(len(own))]
            sample = [own[h] for h in hits]
            ys = [r[3] for r in sample if r[3] is not None]
            assert means[k, rep] == (pytest.approx(np.mean([r[2] for r in sample])), pytest.approx(np.mean(ys)))
            both = [(r[2], r[3]) for r in sample if r[3] is not None]
            assert rhos[k, rep] == (len(both), pytest.approx(rank_correlation(*zip(*both, strict=True))) if k else None)


def mean_ranks(xs):
    return np.array([sum(x < v for x in xs) + (sum(x == v for x in xs) + 1) / 2 for v in xs])


def rank_correlation(xs, ys):
    return np.corrcoef(mean_ranks(xs), mean_ranks(ys))[0, 1]


def test_folds_without_copies(spark):
    """Correlation and group test without each data set, against leaving it out; small groups drop out of a fold by its own counts."""
    rng = np.random.default_rng(7)
    rows = [("f", f"d{i % 3}", f"g{i * i % 4}", float(rng.integers(0, 9)), float(rng.integers(0, 4))) for i in range(50)] + [("f", "d1", "rare", 1.0, 2.0)] * 4 + [("f", "d2", "rare", 3.0, 2.0), ("f", "d2", "rare", 4.0, 2.0)]
    df = frame(spark, rows, "feature string, d string, g string, v double, y double")
    rho = {r["held_out"]: (r["n"], r["rho"]) for r in resampling.lodo_spearman(df, "d", "v", "y", ["feature"]).collect()}
    kw = {r["held_out"]: (r["n"], r["k"], r["h"], r["eps2"]) for r in resampling.lodo_kruskal(df, "d", "v", "g", ["feature"]).collect()}
    assert set(rho) == set(kw) == {"d0", "d1", "d2"}
    for out in rho:
        left = [r for r in rows if r[1] != out]
        assert rho[out] == (len(left), pytest.approx(rank_correlation([r[3] for r in left], [r[4] for r in left])))
        one = ranks.kruskal(df.where(F.col("d") != out), "v", "g", ["feature"]).first()
        assert kw[out] == (one["n"], one["k"], pytest.approx(one["h"]), pytest.approx(one["eps2"]))


def test_smallest_draws_across_tasks(spark):
    rows = [(i % 3, i, float(i)) for i in range(400)]
    got = {(r["k"], r["rep"]): [(x["id"], x["value"]) for x in r["sample"]] for r in replicates.smallest_draws(frame(spark, rows, "k int, id int, z double").repartition(7), ["k"], "id", 12, 5, 1, "z").collect()}
    for (k, rep), sample in got.items():
        order = sorted((r[1] for r in rows if r[0] == k), key=lambda i: (int(replicates.draws(np.array(rep), np.array(i), 1)), i))
        assert sample == [(i, float(i)) for i in order[:12]]
    assert len(got) == 15


@pytest.mark.parametrize("least", [1 << 20, 100])
def test_smallest_draws_of_large_and_many_keys(spark, monkeypatch, least):
    """A key of most rows, keys of a few, null keys and equal ids, by one key, two or none, whole and in steps of a few rows."""
    monkeypatch.setattr(replicates, "DRAWN", least)
    rows = [("big", i % 2 == 0, i, float(i % 5)) for i in range(900)] + [(f"k{i % 90}", None, i // 2, float(-i)) for i in range(400)] + [(None, True, i, 1.0) for i in range(7)]
    df = frame(spark, rows, "k string, side boolean, id int, z double").repartition(3)
    for by in (["k", "side"], ["k"], []):
        own = collections.defaultdict(list)
        for k, side, i, z in rows:
            own[tuple({"k": k, "side": side}[c] for c in by)].append((i, z))
        got = {(*(r[c] for c in by), r["rep"]): [tuple(x) for x in r["sample"]] for r in replicates.smallest_draws(df, by, "id", 4, 3, 5, "z").collect()}
        hand = {(*key, rep): sorted((int(replicates.draws(np.array(rep), np.array(i), 5)), i, z) for i, z in its)[:4] for key, its in own.items() for rep in (1, 2, 3)}
        assert got == hand


def test_smallest_draws_shuffles_a_row_once(spark):
    """Thousands of small keys, mixed: a row is handed on by one task, not once for each replicate or each time a task is full of keys."""
    reps = 50
    drawn = replicates.smallest_draws(spark.range(0, 40_000, 1, 2).selectExpr("id % 8000 AS k", "id"), ["k"], "id", 30, reps)
    assert drawn.select(F.sum(F.size("sample"))).first()[0] == 40_000 * reps and drawn.count() == 8000 * reps
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sample" not in plan.split("Exchange")[1]


def test_quantiles_against_numpy(spark):
    """The linear rule over several slices, with ties, nulls, NaN, a null key and a key of one value."""
    rng = np.random.default_rng(8)
    rows = [(k, float(x)) for k in ("a", "b", None) for x in np.round(rng.normal(size=301), 1)] + [("a", None), ("a", math.nan), ("one", 5.0), ("none", None)]
    wanted = {"low": 0.0, "q": 0.1, "median": 0.5, "up": 0.973, "high": 1.0}
    got = {r["k"]: r for r in slices.quantiles(frame(spark, rows, "k string, v double").repartition(6), "v", ["k"], wanted).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        values = [v for kk, v in rows if kk == k and v is not None and not math.isnan(v)]
        assert [r[c] for c in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()])
    assert slices.quantiles(frame(spark, [(None,)], "v double"), "v", [], {"q": 0.5}).first()["q"] is None


def test_numbers_follow_the_order(spark):
    rows = [(i % 2, (i * 37) % 101) for i in range(101)]
    got = slices.numbered(frame(spark, rows, "k int, id int").repartition(5), ["k"], "id").collect()
    for k in (0, 1):
        assert [r["id"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["pos"])] == sorted(i for kk, i in rows if kk == k)
    assert {(r["k"], r["size"]) for r in got} == {(0, 51), (1, 50)}


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = frame(spark, [("g", i, float(i % 7), float(i * i % 11)) for i in range(60)], "k string, id int, x double, y double")
    runs = [tuple(resampling.bootstrap_spearman(rows.repartition(n), "x", "y", ["k"], "id", 30).first()) for n in (1, 5)]
    assert runs[0][1:] == pytest.approx(runs[1][1:])


def test_meta_analysis_without_heterogeneity(spark):
    """Equal correlations leave none."""
    rows = frame(spark, [("f", 0.5, 40 + i) for i in range(8)], "feature string, rho double, n int")
    got = synthesis.meta_hksj(synthesis.meta_dl(rows, ["feature"])).first()
    assert got["rho"] == pytest.approx(0.5) and got["tau2"] == 0 and got["i2"] == 0 and got["hksj_low"] < 0.5 < got["hksj_high"]


#: Published correlations and sizes per corpus, and what pooling them gives.
STUDIES = {
    "nasal": [(157, -0.4452), (56, -0.9225), (111, -0.4283), (100, -0.1191), (188, -0.3817), (15, -0.602), (15, -0.6547), (24, -0.261)],
    "manner": [(169, -0.4158), (56, -0.9086), (111, -0.3494), (100, -0.0365), (188, -0.3936), (15, -0.6325), (15, -0.7201), (24, -0.2053)],
}
POOLED = {
    "nasal": (8, 83.3944, 0.148797, 91.606, -0.529527, -0.706917, -0.289463, -0.753754, -0.194858, -0.885307, 0.217298),
    "manner": (8, 82.9759, 0.145575, 91.564, -0.507932, -0.690364, -0.264767, -0.743454, -0.160326, -0.876754, 0.237083),
}


def test_meta_analysis_golden_rows(spark):
    rows = frame(spark, [(f, float(r), n) for f, studies in STUDIES.items() for n, r in studies] + [("nasal", None, 150)], "feature string, rho double, n int")
    got = {r["feature"]: r for r in synthesis.meta_hksj(synthesis.meta_dl(rows, ["feature"])).collect()}
    for f, want in POOLED.items():
        assert [got[f][c] for c in ("k", "q", "tau2", "i2", "rho", "low", "high", "hksj_low", "hksj_high", "pred_low", "pred_high")] == pytest.approx(want, rel=2e-4)


def test_posthoc_and_significance_values(spark, sf):
    import tails_by_hand as tails

    from sonolith import plans

    z = {(r["feature"], r["a"], r["b"]): r["z"] for r in plans.QUERIES["o52_mann_whitney"](spark, sf).collect()}
    got = plans.QUERIES["o55_posthoc"](spark, sf).collect()
    assert len(got) == len(z)
    for f in {r["feature"] for r in got}:
        mine = sorted((r for r in got if r["feature"] == f), key=lambda r: math.erfc(abs(z[f, r["a"], r["b"]]) / math.sqrt(2)))
        high = 0.0
        for i, r in enumerate(mine):
            p = math.erfc(abs(z[f, r["a"], r["b"]]) / math.sqrt(2))
            high = min(1.0, max(high, p * (len(mine) - i)))
            assert (r["p"], r["p_holm"]) == (pytest.approx(p, abs=2e-6), pytest.approx(high, abs=2e-5))
    rho = {r["feature"]: r for r in plans.QUERIES["o50_spearman"](spark, sf).collect()}
    kw = {r["feature"]: r for r in plans.QUERIES["o54_kruskal"](spark, sf).collect()}
    part = {r["feature"]: r for r in plans.QUERIES["o51_partial_spearman"](spark, sf).collect()}
    for r in plans.QUERIES["o86_significance"](spark, sf).collect():
        n, x, y = rho[r["feature"]]["n"], rho[r["feature"]]["rho"], part[r["feature"]]
        assert r["p"] == pytest.approx(tails.t_two_sided(x * math.sqrt((n - 2) / (1 - x * x)), n - 2), rel=1e-3, abs=1e-12)
        assert r["p_partial"] == pytest.approx(tails.t_two_sided(y["partial"] * math.sqrt((y["n"] - 3) / (1 - y["partial"] ** 2)), y["n"] - 3), rel=1e-3, abs=1e-12)
        assert r["p_groups"] == pytest.approx(tails.chi2_upper(kw[r["feature"]]["h"], kw[r["feature"]]["k"] - 1), rel=1e-4)
        assert r["stars"] == ("***" if r["p"] < 0.001 else "**" if r["p"] < 0.01 else "*" if r["p"] < 0.05 else "ns")


@pytest.mark.parametrize("points", [2048, 8, 1])
def test_neighbours_are_brute_force(spark, monkeypatch, points):
    """In one cell and in many; a quarter of the rows are the same point."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", points)
    monkeypatch.setattr(neighbours, "AT_ONCE", 64)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 2)) * [1, 50], 1)
    x[::4] = [0.5, 20.0]
    label, fold = rng.integers(0, 3, 150), rng.integers(0, 4, 150)
    rows = frame(spark, [(i, f"g{a}", int(f), float(p), float(q)) for i, (a, f, (p, q)) in enumerate(zip(label, fold, x, strict=True))], "id int, g string, f int, p double, q double")
    got = {int(r["id"]): r for r in synthesis.nearest_neighbours(rows, ["p", "q"], "g", "f", "id").collect()}
    assert len(got) == 150
    for i in range(150):
        others = np.flatnonzero(fold != fold[i])
        d = np.sqrt((((x[others] - x[i]) / x[others].std(axis=0)) ** 2).sum(axis=1))
        near = sorted(zip(np.round(d, 9), map(str, others), others, strict=True))[:5]
        votes = [f"g{label[j]}" for *_, j in near]
        assert got[i]["predicted"] == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_few_visits_to_other_cells(spark, monkeypatch):
    """Spread points visit a small part of the cells, and still find what all rows would give."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", 40)
    rng = np.random.default_rng(6)
    rows = frame(spark, [(i, "ab"[i % 2], i % 3, *map(float, p)) for i, p in enumerate(rng.uniform(size=(2000, 2)))], "id int, g string, f int, p double, q double")
    seen = []

    def counted(df, name, real=neighbours.written):
        out = real(df, name)
        seen.extend([out.where("to IS NOT NULL").count()] if name == "own-cells" else [])
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    assert neighbours.nearest_neighbours(rows, ["p", "q"], "g", "f", "id").count() == 2000
    assert seen[0] < 2000 * 64 * 0.1


def test_logistic_model_is_at_its_minimum(spark):
    """The gradient of mean loss plus half the squared coefficients over n vanishes; one model of all rows gives the weights."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 2)) * [1, 30] + [5, 0]
    y = (x[:, 0] + rng.normal(size=120) > 5).astype(int) + (x[:, 1] > 20)
    rows = frame(spark, [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 0.0)], "a double, b double, y double")
    _, model = synthesis.logistic_fit(synthesis._assembled(rows, ["a", "b"]), "y")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w, c = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = np.exp(z @ w.T + c)
    p /= p.sum(axis=1, keepdims=True)
    error = p - np.eye(3)[y]
    assert np.abs(error.T @ z / 120 + w / 120).max() < 1e-5 and np.abs(error.mean(axis=0)).max() < 1e-5
    got = {r["feature"]: r["mean_abs_coefficient"] for r in synthesis.logistic_weights(rows, ["a", "b"], "y").collect()}
    assert got == {"a": pytest.approx(np.abs(w[:, 0]).mean(), rel=1e-4), "b": pytest.approx(np.abs(w[:, 1]).mean(), rel=1e-4)}


def test_parts_have_their_share_of_each_label(spark):
    rows = frame(spark, [(i, "ab"[i % 2], int(i % 10 == 3)) for i in range(200)], "id int, f string, l int")
    counts = synthesis.folds_or_parts(rows, "f", "id", "l").groupBy("fold", "l").count().collect()
    assert sorted((r["l"], r["count"]) for r in counts) == [(0, 36)] * 5 + [(1, 4)] * 5


def test_folds_by_hash_where_there_are_few(spark):
    rows = frame(spark, [(i, "ab"[i % 2]) for i in range(200)], "id int, f string")
    assert synthesis.folds_or_parts(rows, "f", "id").select("fold").distinct().count() == 5
    assert {r[0] for r in synthesis.folds_or_parts(rows.withColumn("f", F.col("id") % 3), "f", "id").select("fold").distinct().collect()} == {"0", "1", "2"}


def test_matching_stays_within_tolerance(spark):
    rows = frame(spark, [(i, i % 3, 1 + i * 7 % 50) for i in range(200)], "id int, lv int, n int")
    got = cohorts.tolerance_match(rows, "lv", "n", "id", cohorts.size_bucket(F.col("n"))).collect()
    assert got and all(0.8 <= r["n_low"] / r["n_high"] <= 1.25 for r in got)
    assert len({(r["lower"], r["id_low"]) for r in got}) == len(got) == len({(r["lower"], r["id_high"]) for r in got})


def test_full_matching_is_the_largest(spark):
    """Against augmenting paths, the greedy search in the order of ids, and the buckets; sizes tie, jump and are missing."""
    rng = np.random.default_rng(12)
    for k in range(4):
        rows = [(i, int(rng.integers(0, 3)), int(rng.integers(1, 60) ** (1 + k % 2))) for i in range(90)] + [(900, 1, None), (901, None, 3), (902, 2, 0)]
        df = frame(spark, rows, "id int, lv int, n int").repartition(4)
        got = cohorts.full_tolerance_match(df, "lv", "n", "id").collect()
        sizes = {i: n for i, _, n in rows}
        assert all(r["n_low"] == sizes[r["id_low"]] and r["n_high"] == sizes[r["id_high"]] and 0.8 <= r["n_low"] / r["n_high"] <= 1.25 for r in got)
        bucketed = cohorts.tolerance_match(df, "lv", "n", "id", cohorts.size_bucket(F.col("n"))).groupBy("lower").count().collect()
        for lower in (0, 1):
            mine = [r for r in got if r["lower"] == lower]
            assert len({r["id_low"] for r in mine}) == len(mine) == len({r["id_high"] for r in mine})
            a, b = ([(i, n) for i, lv, n in rows if lv == level and n] for level in (lower, lower + 1))
            near = {i: [j for j, m in b if 0.8 <= n / m <= 1.25] for i, n in a}
            used: dict[int, int] = {}

            def augment(i, seen):
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        if j not in used or augment(used[j], seen):
                            used[j] = i
                            return True
                return False

            assert len(mine) == sum(augment(i, set()) for i, _ in a) >= max((r["count"] for r in bucketed if r["lower"] == lower), default=0)


def test_levels_come_in_their_order(spark):
    rows = frame(spark, [("mild", 2), ("odd", 1), ("control", 1), ("severe", 0), (None, 5), ("mild", 1)], "lv string, n int").repartition(3)
    got = [tuple(r) for r in cohorts.order_by_levels(rows, "lv", ["control", "mild", "severe"], "n").collect()]
    assert got == [("control", 1), ("mild", 1), ("mild", 2), ("severe", 0), ("odd", 1), (None, 5)]


def test_adjustment_modes(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 99, 50)
    rows = frame(spark, [("f", float(2 * x + e), int(x)) for x, e in zip(n, rng.normal(size=50), strict=True)], "feature string, value double, n int")
    centred = reports.regress_out(rows, "n", ["feature"], mode="centred").agg(F.avg("adjusted"), F.avg("value")).first()
    assert centred[0] == pytest.approx(centred[1])
    assert abs(reports.adjustment_report(reports.regress_out(rows, "n", ["feature"]), "n", ["feature"]).first()["after"]) < 1e-9


def test_budget_sweep_against_numpy(spark):
    """Nested samples of the drawn tokens, each on its own axis; no sample is larger than the largest budget."""
    rows = spark.range(400).selectExpr("id", "1 AS spk", "'c' AS feature", "id % 2 = 0 AS positive", "array(float(id % 7), float(id % 2), float(id % 5)) AS embedding")
    got = {r["budget"]: r for r in resampling.budget_sweep(rows, ["spk"], "id", [5, 15, 201], 4).collect()}
    drawn = replicates.smallest_draws(rows, ["positive"], "id", 15, 4).collect()
    assert {len(r["sample"]) for r in drawn} == {15}
    hand = {5: [], 15: []}
    for rep in range(1, 5):
        vectors = {r["positive"]: np.array([[x["id"] % 7, x["id"] % 2, x["id"] % 5] for x in r["sample"]], dtype=float) for r in drawn if r["rep"] == rep}
        for b, out in hand.items():
            p, q = vectors[True][:b], vectors[False][:b]
            axis = p.mean(axis=0) - q.mean(axis=0)
            axis /= np.linalg.norm(axis)
            out.append(((p @ axis).mean() - (q @ axis).mean()) / np.sqrt(((p @ axis).var(ddof=1) + (q @ axis).var(ddof=1)) / 2))
    assert {b: (r["n_reps"], r["dprime"]) for b, r in got.items()} == {b: (4, pytest.approx(np.mean(d))) for b, d in hand.items()}
