"""Rank statistics over long tables. Groups, features, folds and replicates are key columns: one plan serves all of them.

Every operator takes ``by``, the key columns of one statistic. Rows are counted by value first (with partial sums), and
ranks are worked out on the values, in the slices of :mod:`.slices`: a value's rank is a count inside its slice plus the
rows of the slices before it. So no task holds a key's rows or all its values, however few keys there are.
``plan="window"`` ranks rows by a window per key instead, for statistics of very many small keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import p_chi2, p_normal, p_t
from ..sources.shared import written
from .reports import cohens_d
from .slices import matched, slice_totals, sliced


def ranked_values(values: DataFrame, value: str, by: list[str], n: str = "n", out: str = "rank") -> DataFrame:
    """``values`` (each value once per key, ``n`` times) with the average rank that its rows share, and ``out``_total, the rows of the key."""
    dealt = sliced(values, by, [value])
    totals = slice_totals(dealt, by, value, n).drop("__sum").withColumnRenamed("__total", f"{out}_total")
    inside = Window.partitionBy(*by, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__before") + F.coalesce(F.sum(n).over(inside), F.lit(0)) + (F.col(n) + 1) / 2.0
    return matched(dealt, totals, [*by, "__slice"]).withColumn(out, rank).drop("__slice", "__before")


def average_rank(df: DataFrame, value: str, by: list[str], out: str = "rank", plan: str = "values") -> DataFrame:
    """``df`` with the average rank of ``value`` among the rows of its key (ties share their mean rank). Rows without a value get none."""
    if plan == "window":
        over = Window.partitionBy(*by, F.col(value).isNull())
        low = F.rank().over(over.orderBy(value)).cast("double")
        ties = F.count("*").over(Window.partitionBy(*by, value)).cast("double")
        return df.withColumn(out, F.when(F.col(value).isNotNull(), low + (ties - 1.0) / 2.0))
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    return matched(df, ranked_values(values, value, by, "__n", out).select(*by, value, out), [*by, value], "left")


def _counted_ranks(df: DataFrame, columns: list[str], by: list[str], plan: str) -> DataFrame:
    """Per key and combination of values: ``__n`` and for each column c ``__c``, its rank less the mean rank of the key. Values are not null."""
    if plan == "window":
        for c in columns:
            df = average_rank(df, c, by, f"__r{c}", plan)
        mean = (F.count("*").over(Window.partitionBy(*by)) + 1) / 2.0
        return df.select(*by, F.lit(1).alias("__n"), *[(F.col(f"__r{c}") - mean).alias(f"__{c}") for c in columns])
    rows = written(df.groupBy(*by, *[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count("*").alias("__n")), "counted")
    each = rows.select(*by, "__n", F.posexplode(F.array(*columns)).alias("__column", "__v"))  # all columns are ranked in one plan
    ranks = ranked_values(each.groupBy(*by, "__column", "__v").agg(F.sum("__n").alias("__k")), "__v", [*by, "__column"], "__k", "__r")
    ranks = ranks.select(*by, "__column", "__v", (F.col("__r") - (F.col("__r_total") + 1) / 2.0).alias("__r"))
    for i, c in enumerate(columns):
        rows = matched(rows, ranks.where(F.col("__column") == i).select(*by, F.col("__v").alias(c), F.col("__r").alias(f"__{c}")), [*by, c])
    return rows


def _rho(x: str, y: str) -> Column:
    """Correlation of ranks about their mean; null (not an error) where a side is constant."""
    n, a, b = F.col("__n"), F.col(f"__{x}"), F.col(f"__{y}")
    return F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b)))


def spearman(df: DataFrame, x: str, y: str, by: list[str], min_n: int = 5, with_p: bool = False, plan: str = "values") -> DataFrame:
    """``by``, ``n``, ``rho`` (null where a side is constant), with ``p`` on request: t with n - 2 degrees of freedom. Keys with under ``min_n`` complete rows are left out."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranked = _counted_ranks(complete.select(*by, x, y), [x, y], by, plan)
    out = ranked.groupBy(*by).agg(F.sum("__n").cast("long").alias("n"), _rho(x, y).alias("rho")).where(F.col("n") >= min_n)
    if with_p:
        t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(F.lit(1e-300), 1 - F.col("rho") * F.col("rho"))))
        out = out.withColumn("p", p_t(t, (F.col("n") - 2).cast("double")))
    return out


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by: list[str], min_n: int = 10, with_p: bool = False, plan: str = "values") -> DataFrame:
    """Correlation of ranks given a nuisance ``z``: ``n, raw, partial, confound_pct`` (0 where the raw one is within 0.01 of 0)."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*by, x, y, z)
    ranked = _counted_ranks(complete, [x, y, z], by, plan)
    out = ranked.groupBy(*by).agg(F.sum("__n").cast("long").alias("n"), _rho(x, y).alias("raw"), _rho(x, z).alias("__xz"), _rho(y, z).alias("__yz")).where(F.col("n") >= min_n)
    root = F.sqrt((1 - F.col("__xz") * F.col("__xz")) * (1 - F.col("__yz") * F.col("__yz")))
    out = out.withColumn("partial", F.when(root > 1e-8, (F.col("raw") - F.col("__xz") * F.col("__yz")) / root).otherwise(F.col("raw")))
    out = out.withColumn("confound_pct", F.when(F.abs("raw") > 0.01, (1 - F.abs("partial") / F.abs("raw")) * 100).when(F.col("raw").isNotNull(), 0.0)).drop("__xz", "__yz")
    if with_p:
        t = F.col("partial") * F.sqrt((F.col("n") - 3) / (1 - F.col("partial") * F.col("partial") + 1e-10))
        out = out.withColumn("p", p_t(t, (F.col("n") - 3).cast("double")))
    return out


def _in_pairs(df: DataFrame, group: str, pairs: DataFrame | None) -> DataFrame:
    """Each row once per pair of groups that it belongs to: ``a``, ``b`` and ``in_a``. Pairs: all, or the given (a, b)."""
    if pairs is None:
        groups = df.select(group).where(F.col(group).isNotNull()).distinct()
        pairs = groups.select(F.col(group).alias("a")).join(groups.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    either = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("g"), F.lit(1).alias("in_a")), F.struct(F.col("b").alias("g"), F.lit(0).alias("in_a")))).alias("x")).select("a", "b", F.col("x.g").alias(group), "x.in_a")
    return df.join(either, group)


def _ties(n: str) -> Column:
    t = F.col(n).cast("double")
    return F.sum(t * t * t - t)


def mann_whitney(df: DataFrame, value: str, group: str, by: list[str], pairs: DataFrame | None = None, min_n: int = 5, with_p: bool = False) -> DataFrame:
    """Two-sample rank test for pairs of groups: ``a, b, n_a, n_b, u`` (of a), ``delta`` (Cliff's) = 2u / (n_a n_b) - 1, ``rank_biserial`` = -delta and ``z``.

    ``z`` is the normal form with tie and continuity correction, null where all values are tied. Pairs in which a group
    has under ``min_n`` values are left out. Values are counted per group before they are dealt to the pairs.
    """
    keys = [*by, "a", "b"]
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("__c"))
    rows = _in_pairs(counted, group, pairs).groupBy(*keys, value).agg(F.sum("__c").alias("__n"), F.sum(F.col("__c") * F.col("in_a")).alias("__a"))
    ranked = ranked_values(rows, value, keys, "__n", "__r")
    out = ranked.groupBy(*keys).agg(F.sum("__a").alias("n_a"), F.sum(F.col("__n") - F.col("__a")).alias("n_b"), F.sum(F.col("__a") * F.col("__r")).alias("__sum"), _ties("__n").alias("__ties")).where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    out = out.withColumn("u", F.col("__sum") - na * (na + 1) / 2).withColumn("delta", 2 * F.col("u") / (na * nb) - 1)
    spread = F.sqrt(na * nb / 12 * ((n + 1) - F.col("__ties") / (n * (n - 1))))
    away = F.abs(F.col("u") - na * nb / 2)
    z = F.signum(F.col("u") - na * nb / 2) * F.try_divide(F.greatest(away - 0.5, F.lit(0.0)), spread)
    out = out.withColumn("rank_biserial", -F.col("delta")).withColumn("z", z).drop("__sum", "__ties")
    return out.withColumn("p", p_normal("z")) if with_p else out


def kruskal(df: DataFrame, value: str, group: str, by: list[str], min_n: int = 5, with_p: bool = False) -> DataFrame:
    """Kruskal-Wallis over the groups of at least ``min_n`` values: ``n, k, h, eps2`` (two groups at least; null where all values are tied)."""
    counted = written(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("__c")), "counted")
    large = counted.groupBy(*by, group).agg(F.sum("__c").alias("__size")).where(F.col("__size") >= min_n).drop("__size")
    counted = matched(counted, large, [*by, group])
    ranked = ranked_values(counted.groupBy(*by, value).agg(F.sum("__c").alias("__n")), value, by, "__n", "__r").select(*by, value, "__n", "__r")
    ties = ranked.groupBy(*by).agg(_ties("__n").alias("__ties"))
    sums = matched(counted, ranked.select(*by, value, "__r"), [*by, value]).groupBy(*by, group).agg(F.sum(F.col("__c") * F.col("__r")).alias("s"), F.sum("__c").cast("double").alias("m"))
    out = sums.groupBy(*by).agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q")).where("k >= 2")
    out = matched(out, ties, by)
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("__ties") / (n * n * n - n))
    out = out.withColumn("h", h).withColumn("eps2", F.greatest((F.col("h") - F.col("k") + 1) / (n - F.col("k")), F.lit(0.0))).drop("q", "__ties").withColumn("n", n.cast("long"))
    out = out.withColumn("eps2", F.when(F.col("h").isNotNull(), F.col("eps2")))
    return out.withColumn("p", p_chi2("h", (F.col("k") - 1).cast("double"))) if with_p else out


def bh_adjust(df: DataFrame, p: str, family: list[str], out: str = "q", ties: list[str] = ()) -> DataFrame:
    """Benjamini-Hochberg within a family; null p values stay out of it and keep null."""
    rows = Window.partitionBy(*family, F.col(p).isNull())
    rank = F.row_number().over(rows.orderBy(p, *ties)).cast("double")
    m = F.count(p).over(rows)
    stepped = F.min(F.col(p) * F.col("__m") / F.col("__rk")).over(rows.orderBy(F.col("__rk").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__rk", rank).withColumn("__m", m).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), stepped))).drop("__rk", "__m")


def holm_adjust(df: DataFrame, p: str, family: list[str], out: str = "q", ties: list[str] = ()) -> DataFrame:
    """Holm's step-down within a family; null p values stay out of it and keep null."""
    rows = Window.partitionBy(*family, F.col(p).isNull())
    rank = F.row_number().over(rows.orderBy(p, *ties)).cast("double")
    m = F.count(p).over(rows)
    stepped = F.max(F.col(p) * (F.col("__m") - F.col("__rk") + 1)).over(rows.orderBy("__rk").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__rk", rank).withColumn("__m", m).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), stepped))).drop("__rk", "__m")


def posthoc(df: DataFrame, value: str, group: str, by: list[str], min_n: int = 5) -> DataFrame:
    """All pairs: the omnibus test's h and eps2 beside each pair's u, delta, Cohen's d (by the mean of the two variances), p and Holm-adjusted p."""
    pairs = holm_adjust(mann_whitney(df, value, group, by, min_n=min_n, with_p=True), "p", by, "p_holm", ["a", "b"])
    d = cohens_d(df.withColumnRenamed(value, "value"), group, by, pooled=False).select(*by, "a", "b", "d")
    return matched(matched(pairs, d, [*by, "a", "b"]), kruskal(df, value, group, by, min_n).select(*by, "h", "eps2"), by)


def rank_features(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """Rank by absolute value, largest first."""
    return df.withColumn("place", F.rank().over(Window.partitionBy(*within).orderBy(F.abs(value).desc())))


def top_k(df: DataFrame, value: str, within: list[str], k: int, ties: list[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(F.col(value).desc_nulls_last(), *ties))).where(F.col("place") <= k)


def extreme_pair(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """The pairs (a, b) with the smallest and the largest absolute value (ties: the first by name)."""
    size, name = F.abs(value), F.struct("a", "b")
    hard, easy = F.min(F.struct(size.alias("v"), name.alias("p"))), F.min(F.struct((-size).alias("v"), name.alias("p")))
    out = df.where(F.col(value).isNotNull()).groupBy(*within).agg(hard.alias("h"), easy.alias("e"))
    return out.select(*within, F.col("h.p.a").alias("hard_a"), F.col("h.p.b").alias("hard_b"), F.col("h.v").alias("hard_size"), F.col("e.p.a").alias("easy_a"), F.col("e.p.b").alias("easy_b"), (-F.col("e.v")).alias("easy_size"))


def agreement(df: DataFrame, value: str, variant: str, entity: list[str], min_n: int = 20) -> DataFrame:
    """Spearman of the same entities' values under two variants, for every pair of variants."""
    a = df.select(*entity, F.col(variant).alias("m1"), F.col(value).alias("x"))
    b = df.select(*entity, F.col(variant).alias("m2"), F.col(value).alias("y"))
    return spearman(a.join(b, entity).where("m1 < m2"), "x", "y", ["m1", "m2"], min_n)
