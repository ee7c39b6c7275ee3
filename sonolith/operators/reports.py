"""Aggregates over the entity table: descriptives, trends, profiles, effect sizes, adjustment, folds of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine_complete
from .slices import matched, quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def long_form(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per entity and feature: every statistic then runs for all features in one plan."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(ids, features, "feature", "value")


def mean_profile(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Per key the mean of each feature, as an array in the given order (null where a feature has no value)."""
    return df.groupBy(*keys).agg(F.array(*[F.avg(c) for c in features]).alias("profile"), F.count("*").alias("n"))


def profile_similarity(profiles: DataFrame, over: str, within: list[str], min_dims: int = 3) -> DataFrame:
    """Cosine of the profiles of every pair of ``over`` that shares the ``within`` keys: ``l1, l2, similarity``. Profiles are one per key; pairs are of keys, not of rows."""
    a = profiles.select(*within, F.col(over).alias("l1"), F.col("profile").alias("p1"))
    b = profiles.select(*within, F.col(over).alias("l2"), F.col("profile").alias("p2"))
    pairs = a.join(b, within).where("l1 < l2") if within else a.join(b, F.col("l1") < F.col("l2"))
    return pairs.select(*within, "l1", "l2", cosine_complete(F.col("p1"), F.col("p2"), min_dims).alias("similarity"))


def similarity_summary(pairs: DataFrame, within: list[str]) -> DataFrame:
    return pairs.groupBy(*within).agg(F.count("similarity").alias("n_pairs"), F.avg("similarity").alias("mean_sim"), F.min("similarity").alias("min_sim"), F.max("similarity").alias("max_sim"))


def control_ratio(long: DataFrame, is_control: Column, group: str, language: str, min_controls: int = 3) -> DataFrame:
    """Group mean over the control mean of the same language and feature; 0 is replaced by 1 below the line; languages with too few controls drop out."""
    base = long.where(is_control).groupBy(language, "feature").agg(F.avg("value").alias("control_mean"), F.count("*").alias("n_controls")).where(F.col("n_controls") >= min_controls)
    means = long.where(~is_control).groupBy(group, language, "feature").agg(F.avg("value").alias("group_mean"))
    under = F.when(F.col("control_mean") == 0, 1.0).otherwise(F.col("control_mean"))
    return means.join(base, [language, "feature"]).withColumn("ratio", F.col("group_mean") / under)


def cohens_d(long: DataFrame, group: str, by: list[str], pooled: bool = True) -> DataFrame:
    """d for every pair of groups; 0 where a group has under two values or nothing varies. ``pooled``: weighted by degrees of freedom, else the mean of the two variances."""
    one = long.where(F.col("value").isNotNull()).groupBy(*by, group).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    side = lambda s: one.select(*by, F.col(group).alias(s), F.col("m").alias(f"m_{s}"), F.col("v").alias(f"v_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = (side("a").join(side("b"), by) if by else side("a").crossJoin(side("b"))).where("a < b")
    na, nb = F.col("n_a"), F.col("n_b")
    var = ((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b")) / (na + nb - 2) if pooled else (F.col("v_a") + F.col("v_b")) / 2
    d = F.when((na < 2) | (nb < 2), 0.0).otherwise(F.coalesce(F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(var)), F.lit(0.0)))
    return pairs.select(*by, "a", "b", "n_a", "n_b", d.alias("d"))


def crosstab(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Counts by two columns with totals on both sides (row label ``TOTAL``)."""
    counted = df.rollup(rows).agg(*[F.count_if(F.col(cols) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"), F.grouping(rows).alias("__g"))
    return counted.select(F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col(rows)).alias(rows), *[f"n_{v}" for v in values], "total")


def coverage(df: DataFrame, group: str, level: str, m: int, min_levels: int = 2) -> DataFrame:
    """Groups with at least ``min_levels`` levels of at least ``m`` rows, and those levels' number."""
    cells = df.where(F.col(level).isNotNull()).groupBy(group, level).count().where(F.col("count") >= m)
    return cells.groupBy(group).agg(F.count("*").alias("n_levels"), F.sum("count").alias("n")).where(F.col("n_levels") >= min_levels)


def describe_by(long: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """n, mean, population deviation, quartiles (exact and linear between values; ``exact=False`` takes a sketch instead of ordering the values)."""
    rows = long.where(F.col("value").isNotNull()).groupBy(*keys)
    basic = [F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")]
    if not exact:
        return rows.agg(*basic, *[F.percentile_approx("value", F.lit(q), F.lit(10_000)).alias(c) for c, q in QUARTILES.items()])
    return matched(rows.agg(*basic), quantiles(long, "value", keys, QUARTILES), keys)


def severity_trend(long: DataFrame, level: str, by: list[str], levels: list[int]) -> DataFrame:
    """Mean per level, whether they strictly rise or fall over all levels (``monotonic``), and the trend over the levels that there are."""
    means = long.where(F.col(level).isNotNull() & F.col("value").isNotNull()).groupBy(*by, level).agg(F.avg("value").alias("m"))
    over = Window.partitionBy(*by).orderBy(level)
    steps = means.withColumn("__step", F.col("m") - F.lag("m").over(over))
    out = steps.groupBy(*by).agg(*[F.max(F.when(F.col(level) == v, F.col("m"))).alias(f"m{v}") for v in levels], F.bool_and(F.col("__step") > 0).alias("up"), F.bool_and(F.col("__step") < 0).alias("down"), F.count("*").alias("n_levels"))
    trend = F.when(F.col("up"), "UP").when(F.col("down"), "DOWN").otherwise("MIXED")
    return out.withColumn("trend", trend).withColumn("monotonic", (F.col("n_levels") == len(levels)) & (trend != "MIXED")).drop("up", "down")


def z_matrix(long: DataFrame, keys: list[str], sort: list[str]) -> DataFrame:
    """z-scores of the means per key and feature over the keys (a deviation under 1e-8 counts as 1), with sort keys: data for a heat map."""
    means = long.groupBy(*keys, "feature").agg(F.avg("value").alias("m"))
    stats = means.groupBy("feature").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    return means.join(stats, "feature").select(*keys, "feature", ((F.col("m") - F.col("mu")) / F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))).alias("z")).orderBy(*sort, "feature")


def chart_means(long: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    """Means per key and feature where there are ``min_n`` values: data for radar, slope and box charts."""
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "feature").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= min_n)


def box_feed(long: DataFrame, keys: list[str], min_n: int = 3) -> DataFrame:
    """Quartiles, range and number per key and feature where there are ``min_n`` values: data for box plots."""
    rows = long.where(F.col("value").isNotNull()).groupBy(*keys, "feature")
    ranges = rows.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where(F.col("n") >= min_n)
    return matched(ranges, quantiles(long, "value", [*keys, "feature"], QUARTILES), [*keys, "feature"])


def slope_feed(long: DataFrame, level: str, groups: list[str], first: int, last: int) -> DataFrame:
    """Means at the first and the last level and their difference per key and feature: data for slope charts."""
    at = lambda v: F.avg(F.when(F.col(level) == v, F.col("value")))
    return long.groupBy(*groups, "feature").agg(at(first).alias("start"), at(last).alias("end")).withColumn("change", F.col("end") - F.col("start"))


def bubble_feed(df: DataFrame, key: str, size: str, value: str, min_n: int = 2) -> DataFrame:
    """Median of ``size``, mean of ``value`` and number of rows per key: data for bubble charts."""
    means = df.groupBy(key).agg(F.avg(value).alias("y"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    return matched(means, quantiles(df, size, [key], {"x": 0.5}), [key], "left")


def grid_feed(long: DataFrame, row: str, level: str, levels: list) -> DataFrame:
    """Means of a row key by level, side by side (null where there is no value): data for a grid."""
    return long.groupBy(row, "feature").agg(*[F.avg(F.when(F.col(level) == v, F.col("value"))).alias(f"m{v}") for v in levels])


def convergence(long: DataFrame, corpus: str, by: list[str]) -> DataFrame:
    """How far the corpora's means lie apart: spread max - min, and that in per cent of the mean of means."""
    per = long.where(F.col("value").isNotNull()).groupBy(*by, corpus).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    out = per.groupBy(*by).agg(F.count("*").alias("n_corpora"), F.avg("m").alias("mean"), F.avg("sd").alias("mean_sd"), (F.max("m") - F.min("m")).alias("spread"))
    return out.withColumn("spread_pct", F.try_divide(F.col("spread") * 100, F.abs("mean")))


def regress_out(long: DataFrame, x: str, by: list[str], min_pairs: int = 20, fit_filter: Column | None = None, mode: str = "ref") -> DataFrame:
    """``adjusted``: the value without the slope on ``x``.

    ``ref`` adds the grand mean to what the slope leaves (so the adjusted mean is intercept plus grand mean);
    ``centred`` takes ``x`` about its mean, which keeps the mean. Fitted on rows with ``x`` > 0 (and ``fit_filter``);
    with under ``min_pairs`` of them values stay.
    """
    usable = long.where(F.col("value").isNotNull() & (F.col(x) > 0))
    usable = usable.where(fit_filter) if fit_filter is not None else usable
    xs = F.col(x).cast("double")
    fit = usable.groupBy(*by).agg(F.count("*").alias("__n"), F.regr_slope("value", xs).alias("__slope"), F.avg("value").alias("__mean"), F.avg(xs).alias("__x"))
    shift = F.col("__slope") * xs - F.col("__mean") if mode == "ref" else F.col("__slope") * (xs - F.col("__x"))
    adjusted = F.when((F.col("__n") >= min_pairs) & (xs > 0) & F.col("__slope").isNotNull(), F.col("value") - shift).otherwise(F.col("value"))
    return long.join(fit, by, "left").withColumn("adjusted", adjusted).drop("__n", "__slope", "__mean", "__x")


def adjustment_report(adjusted: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Correlation with the nuisance before and after, and by how many per cent it fell."""
    rows = adjusted.where(F.col("value").isNotNull() & (F.col(x) > 0))
    r = lambda c: F.try_divide(F.covar_pop(c, F.col(x).cast("double")), F.stddev_pop(c) * F.stddev_pop(F.col(x).cast("double")))
    out = rows.groupBy(*by).agg(r("value").alias("before"), r("adjusted").alias("after"))
    return out.withColumn("reduction_pct", F.try_divide((F.abs("before") - F.abs("after")) * 100, F.abs("before")))


def quality_filter(df: DataFrame, tokens: Column, sentences: Column, q: float = 0.10, relative_error: float | None = None) -> DataFrame:
    """Entities at or above the q-quantile of tokens per sentence."""
    rows = df.withColumn("proxy", tokens / F.greatest(sentences, F.lit(1)))
    cut = quantiles(rows, "proxy", [], {"__cut": q}) if relative_error is None else rows.agg(F.percentile_approx("proxy", F.lit(q), F.lit(int(1 / relative_error))).alias("__cut"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col("proxy") >= F.col("__cut")).drop("__cut")  # one row


def bin_quartile(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Quartile 1..4 of a value by the quartile edges of its key (an edge belongs to the lower quartile)."""
    out = matched(df, quantiles(df, value, list(by), {f"__q{i}": q for i, q in enumerate((0.25, 0.5, 0.75))}), list(by), "left")
    v = F.col(value)
    return out.withColumn("quartile", F.when(v <= F.col("__q0"), 1).when(v <= F.col("__q1"), 2).when(v <= F.col("__q2"), 3).when(v.isNotNull(), 4)).drop("__q0", "__q1", "__q2")


def bin_fixed(value: Column, edges: list[float]) -> Column:
    """Number of the half-open bin [edge, next edge); 0 below the first."""
    return F.when(value.isNotNull(), sum(((value >= e).cast("int") for e in edges), F.lit(0)))


def trajectories(df: DataFrame, persons: DataFrame, order: str, features: list[str]) -> DataFrame:
    """The recordings of one person in order, with each feature's change since the one before."""
    rows = df.join(persons, "speaker_id")
    over = Window.partitionBy("person").orderBy(order)
    return rows.select("person", "speaker_id", order, *features, *[(F.col(f) - F.lag(f).over(over)).alias(f"{f}_change") for f in features])


def in_scenarios(df: DataFrame, scenarios: dict[str, Column]) -> DataFrame:
    """Each row once per scenario whose predicate holds: ``scenario`` is then one more key of any statistic."""
    names = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in scenarios.items()]), lambda n: n.isNotNull())
    return df.withColumn("scenario", F.explode(names))


def compare_subsets(stats: DataFrame, value: str, by: list[str], base: str) -> DataFrame:
    """Every scenario's value beside the base scenario's, with the difference."""
    ref = stats.where(F.col("scenario") == base).select(*by, F.col(value).alias("base_value"))
    return stats.where(F.col("scenario") != base).join(ref, by).withColumn("change", F.col(value) - F.col("base_value"))


def union_family(parts: list[DataFrame]) -> DataFrame:
    """Several tests as one family, for one correction over all of them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
