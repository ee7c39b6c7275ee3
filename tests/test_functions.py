import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import scalars as f
import pandas as pd
import tails_by_hand

from sonolith.functions import tails


def test_missing_values_are_null(spark):
    rows = spark.createDataFrame([("",), ("nan",), ("NaN",), ("-1",), ("x",), (" 2.5 ",), (None,)], "a string")
    got = [r[0] for r in f.null_if_missing(rows, numbers=["a"]).collect()]
    assert got == [None, None, None, -1.0, None, 2.5, None]
    assert [r[0] for r in f.null_if_missing(rows, unknown_levels=["a"]).collect()] == [None, None, None, None, None, 2, None]


def test_severity_edges(spark):
    rows = spark.createDataFrame([(94.0,), (94.0001,), (85.0,), (84.99,), (70.0,), (69.99,), (None,)], "p double")
    assert [r[0] for r in rows.select(f.severity_from_pct(F.col("p"))).collect()] == ["mild", "control", "mild", "moderate", "moderate", "severe", None]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0, None, 4.0], [2.0, None, 1.0, 1.0], [0.0, 0.0, 0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>, z array<double>, u array<double>")
    got = row.select(f.cosine_complete(F.col("a"), F.col("b"), 3), f.cosine_complete(F.col("a"), F.col("b"), 2), f.cosine_complete(F.col("b"), F.col("z"), 3), f.unit(F.col("z")), f.unit(F.col("u"))).first()
    assert got[0] is None and got[1] == pytest.approx(6 / math.sqrt(17 * 5)) and got[2] is None and got[3] is None and got[4] == pytest.approx([0.6, 0.8])


def test_text(spark):
    row = spark.createDataFrame([("It's  (a) – test: “x”!", "/a/b.c/x.y.wav", "a/b c\\d")], "t string, p string, k string")
    assert tuple(row.select(f.clean_transcript(F.col("t")), f.stem(F.col("p")), f.safe_key(F.col("k"))).first()) == ("It's a test “x”", "x.y", "a_b_c_d")


def test_composite_needs_enough(spark):
    rows = spark.createDataFrame([(1.0, 2.0, float("nan")), (1.0, 2.0, 6.0)], "a double, b double, c double")
    assert [r[0] for r in rows.select(f.composite([F.col(c) for c in "abc"])).collect()] == [None, 3.0]


def test_tails():
    assert tails_by_hand.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails_by_hand.t_two_sided(2.364624252, 7) == pytest.approx(0.05, abs=1e-9)
    assert tails_by_hand.t_inverse(0.975, 7) == pytest.approx(2.364624252, abs=1e-8)
    assert 0 < tails_by_hand.t_two_sided(-19.0, 829) < 1e-60
    for k, x in ((1, 3.841458821), (2, 5.991464547), (3, 7.814727903), (6, 12.59158724)):
        assert tails_by_hand.chi2_upper(x, k) == pytest.approx(0.05, abs=1e-8)


def test_tail_expressions_against_one_number_at_a_time(spark, duck):
    """Column expressions and their SQL, from the middle far into the tails, with the edges."""
    from pyspark.sql import functions as F

    given = [(float(x), float(n)) for x in (0, 1e-8, 0.1, 0.9, 2, 5.5, 19, 37) for n in (1, 2, 3, 7, 24, 829, 40_000)] + [(-3.0, 12.0), (2.0, 0.0)]
    df = spark.createDataFrame(given, "x double, n double")
    ours = df.select("x", "n", tails.p_t(F.col("x"), F.col("n")).alias("t"), tails.p_normal("x").alias("z"), tails.p_chi2("x", F.col("n")).alias("c")).collect()
    duck.register("given", pd.DataFrame(given, columns=["x", "n"]))
    sql = duck.execute(f"SELECT x, n, {tails.p_t_sql('x', 'n')}, {tails.p_normal_sql('x')}, CASE WHEN n > 0 THEN {tails.p_chi2_sql('x', 'n')} END FROM given").fetchall()
    for x, n, t, z, c in [tuple(r) for r in ours] + sql:
        want = tails_by_hand.t_two_sided(x, n)
        assert t == pytest.approx(want, rel=1e-7, abs=1e-300, nan_ok=True), (x, n)
        assert z == pytest.approx(tails_by_hand.normal_two_sided(x), rel=1e-9, abs=1e-300), x
        if n > 0:
            assert c == pytest.approx(tails_by_hand.chi2_upper(x, n), rel=1e-8, abs=1e-300), (x, n)
    quantiles = [(p, float(n)) for p in (0.5, 0.6, 0.975, 0.9999) for n in (1, 2, 7, 30)]
    df = spark.createDataFrame([*quantiles, (None, 3.0)], "p double, n double")
    duck.register("asked", pd.DataFrame(quantiles, columns=["p", "n"]))
    rows = [tuple(r) for r in df.select("p", "n", tails.t_quantile(F.col("p"), F.col("n"))).collect()]
    assert rows.pop()[2] is None
    for p, n, t in rows + duck.execute(f"SELECT p, n, {tails.t_quantile_sql('p', 'n')} FROM asked").fetchall():
        assert t == pytest.approx(tails_by_hand.t_inverse(p, n), rel=1e-7, abs=1e-9)



def test_draws_are_spread_and_distinct(spark):
    got = np.array([r[0] for r in spark.range(20_000).select(f.draw(F.lit(3), F.col("id"), 5)).collect()])
    assert len(set(got)) == len(got)
    assert abs(np.corrcoef(got[1:], got[:-1])[0, 1]) < 0.03
    counts = np.bincount(got % 50, minlength=50)
    assert ((counts - 400) ** 2 / 400).sum() / 49 < 2
