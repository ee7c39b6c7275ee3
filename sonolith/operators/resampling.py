"""Resampling with the replicate as an array or a column: one plan draws, computes and summarises all replicates.

Draws come from a portable hash of (replicate, row), so results do not depend on partitioning or row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, let, unit, vector_sum
from ..sources.shared import written
from .ranks import kruskal, spearman
from .replicates import permuted_means, replicate_kruskal, replicate_means, replicate_spearman, smallest_draws, with_counts
from .reports import mean_profile, profile_similarity, similarity_summary
from .slices import matched


def interval(stats: DataFrame, value: str, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval over replicates; undefined replicates drop out."""
    return stats.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_reps"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), F.avg(value).alias("mean"))


def bootstrap_spearman(df: DataFrame, x: str, y: str, by: list[str], ident: str, replicates: int = 1000, strata: list[str] = (), min_n: int = 5, seed: int = 0) -> DataFrame:
    """Percentile interval of rho per key; with ``strata`` each stratum is resampled within itself."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *strata, ident, x, y)
    sample = with_counts(complete, [*by, *strata], ident, replicates, seed)
    return interval(replicate_spearman(sample, x, y, by, replicates, min_n), "rho", by)


def bootstrap_similarity(df: DataFrame, over: str, within: list[str], features: list[str], ident: str, replicates: int, seed: int = 0) -> DataFrame:
    """Percentile interval of the profile cosine of every pair of ``over``, entities resampled within their cell."""
    sample = with_counts(df.select(*within, over, ident, *features), [*within, over], ident, replicates, seed)
    profiles = replicate_means(sample, [*within, over], features, replicates).withColumn("profile", F.array(*features))
    return interval(profile_similarity(profiles, over, [*within, "rep"]), "similarity", [*within, "l1", "l2"])


def similarity_sweep(df: DataFrame, over: str, within: list[str], features: list[str], thresholds: list[int]) -> DataFrame:
    """Mean pair similarity by the least number of entities that a cell must have."""
    profiles = mean_profile(df, [*within, over], features)
    rows = profiles.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("n") >= F.col("threshold"))
    return similarity_summary(profile_similarity(rows, over, ["threshold", *within]), ["threshold", *within])


def bootstrap_mean(pairs: DataFrame, value: str, by: list[str], ident: str, replicates: int, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of pair values."""
    sample = with_counts(pairs.where(F.col(value).isNotNull()).select(*by, ident, value), by, ident, replicates, seed)
    return interval(replicate_means(sample, by, [value], replicates), value, by)


def permutation_test(df: DataFrame, within: list[str], label: str, features: list[str], ident: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Mean pair similarity of the labels' profiles against labels dealt at random: ``observed, p, null_low, null_high``. p is the share of replicates at or above the observed value."""
    stat = lambda profiles, keys: similarity_summary(profile_similarity(profiles, label, keys), keys).select(*keys, "mean_sim")
    observed = stat(mean_profile(df, [*within, label], features), within).withColumnRenamed("mean_sim", "observed")
    dealt = permuted_means(df.select(*within, ident, label, *features), within, ident, label, features, replicates, seed)
    null = stat(dealt.withColumn("profile", F.array(*features)), [*within, "rep"])
    out = null.join(observed, within).groupBy(*within, "observed")
    return out.agg(F.avg((F.col("mean_sim") >= F.col("observed")).cast("double")).alias("p"), F.percentile("mean_sim", F.lit(0.025)).alias("null_low"), F.percentile("mean_sim", F.lit(0.975)).alias("null_high"))


def fixed_token_repeats(projected: DataFrame, entity: list[str], ident: str, n: int, repeats: int, seed: int = 0, z: str = "z") -> DataFrame:
    """d-prime ``d`` per entity and ``rep`` on ``n`` tokens per class drawn without replacement (classes with fewer drop out). Tokens are numbers by now."""
    drawn = smallest_draws(projected.where(F.col("positive").isNotNull()), [*entity, "positive"], ident, n, repeats, seed, z)
    each = drawn.where(F.size("sample") == n).select(*entity, "rep", "positive", F.explode("sample.value").alias("__z"))
    sums = each.groupBy(*entity, "rep", "positive").agg(F.avg("__z").alias("m"), F.var_pop("__z").alias("v"))
    both = sums.groupBy(*entity, "rep").agg(F.max(F.when(F.col("positive"), F.col("m"))).alias("p"), F.max(F.when(~F.col("positive"), F.col("m"))).alias("q"), F.avg("v").alias("v"), F.count("*").alias("k")).where("k = 2")
    return both.withColumn("d", F.when(F.sqrt("v") <= 1e-8, 0.0).otherwise(F.try_divide(F.abs(F.col("p") - F.col("q")), F.sqrt("v")))).select(*entity, "rep", "d")


def fixed_token(projected: DataFrame, entity: list[str], ident: str, n: int, repeats: int, seed: int = 0, z: str = "z") -> DataFrame:
    """Mean over repeats of d-prime on ``n`` tokens per class."""
    each = fixed_token_repeats(projected, entity, ident, n, repeats, seed, z)
    return each.groupBy(*entity).agg(F.avg("d").alias("dprime"), F.stddev_pop("d").alias("dprime_sd"), F.count("*").alias("n_reps"))


def fixed_token_correlation(repeated: DataFrame, full: DataFrame, labels: DataFrame, entity: list[str], level: str, by: list[str] = (), min_n: int = 10) -> DataFrame:
    """Correlation of d-prime and level over the repeats: ``mean_rho, sd, low, high, n_reps``, and beside it ``full_rho`` of all tokens and their ``difference``.

    ``repeated``: entity, rep, d; ``full``: entity, dprime; ``labels``: entity, level. Repeats with under ``min_n`` entities do not count.
    """
    known = labels.where(F.col(level).isNotNull()).select(*entity, F.col(level).cast("double").alias("__level"))
    rho = spearman(repeated.join(known, entity), "d", "__level", [*by, "rep"], min_n, plan="window").where("rho IS NOT NULL")
    out = rho.groupBy(*by).agg(F.avg("rho").alias("mean_rho"), F.stddev_pop("rho").alias("sd"), F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.975)).alias("high"), F.count("*").alias("n_reps"))
    whole = spearman(full.join(known, entity), "dprime", "__level", list(by), min_n).select(*by, F.col("rho").alias("full_rho"))
    return (out.join(whole, list(by), "left") if by else out.join(whole, F.lit(True), "left")).withColumn("difference", F.col("mean_rho") - F.col("full_rho"))


def _mean_vector(vectors: Column) -> Column:
    return F.transform(vector_sum(vectors), lambda x: x / F.size(vectors))


def _moments(values: Column) -> Column:
    """Mean and sample variance of an array of numbers."""

    def of(xs: Column) -> Column:
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
        return let(mean, lambda m: F.struct(m.alias("m"), F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(xs) - 1).alias("v")))

    return let(values, of)


def own_axis_dprime(p: Column, q: Column) -> Column:
    """Signed d-prime of two arrays of vectors along the line between their means, with sample variances: 0 where nothing varies, null where the means meet."""

    def along(axis: Column) -> Column:
        sides = F.struct(*[_moments(F.transform(side, lambda v: dot(v, axis))).alias(c) for side, c in ((p, "p"), (q, "q"))])

        def ratio(s: Column) -> Column:
            sd = F.sqrt((s["p"]["v"] + s["q"]["v"]) / 2)
            return F.when(sd <= 1e-8, 0.0).otherwise((s["p"]["m"] - s["q"]["m"]) / sd)

        return let(sides, ratio)

    return let(unit(F.zip_with(_mean_vector(p), _mean_vector(q), lambda x, y: x - y)), lambda axis: F.when(axis.isNotNull(), along(axis)))


def budget_sweep(classified: DataFrame, entity: list[str], ident: str, budgets: list[int], repeats: int, vec: str = "embedding", seed: int = 0) -> DataFrame:
    """Per entity, feature and budget: mean d-prime on own axes over ``repeats`` samples of ``budget`` tokens per class.

    Only the largest budget's tokens of a class are drawn (their ids first, then their vectors), so a group is one
    sample whatever the number of tokens. Samples of larger budgets contain those of smaller ones.
    """
    keys = [*entity, "feature"]
    rows = classified.where(F.col("positive").isNotNull()).select(*keys, "positive", F.col(ident).cast("long").alias("__id"), F.col(vec).alias("__vec"))
    drawn = smallest_draws(rows, [*keys, "positive"], "__id", max(budgets), repeats, seed).select(*keys, "positive", "rep", F.posexplode("sample.id").alias("__nth", "__id"))
    met = drawn.join(rows, [*keys, "positive", "__id"])
    side = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("__nth", "__vec")))), lambda x: x["__vec"])
    both = met.groupBy(*keys, "rep").agg(side(F.col("positive")).alias("p"), side(~F.col("positive")).alias("q"))
    each = both.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where((F.size("p") >= F.col("budget")) & (F.size("q") >= F.col("budget")))
    d = own_axis_dprime(F.slice("p", F.lit(1), F.col("budget")), F.slice("q", F.lit(1), F.col("budget")))
    return each.select(*keys, "budget", d.alias("d")).where("d IS NOT NULL").groupBy(*keys, "budget").agg(F.avg("d").alias("dprime"), F.count("*").cast("int").alias("n_reps"))


def sweep_composite(sweep: DataFrame, entity: list[str], min_features: int = 3) -> DataFrame:
    """Mean over contrasts per entity and budget, where there are ``min_features``."""
    return sweep.groupBy(*entity, "budget").agg(F.avg("dprime").alias("composite"), F.count("*").alias("n_features")).where(F.col("n_features") >= min_features)


def budget_report(composites: DataFrame, labels: DataFrame, entity: list[str], level: str, group: str, min_n: int = 20, min_group: int = 5) -> DataFrame:
    """Per budget: ``n`` and ``rho`` of composite and level, and ``h`` and ``eps2`` of the groups. Budgets with under ``min_n`` entities are left out."""
    rows = composites.join(labels.select(*entity, F.col(level).cast("double").alias("__level"), group), entity)
    groups = kruskal(rows, "composite", group, ["budget"], min_group).select("budget", "h", "eps2")
    return spearman(rows, "composite", "__level", ["budget"], min_n).join(groups, "budget", "left")


def budget_level_means(composites: DataFrame, labels: DataFrame, entity: list[str], level: str) -> DataFrame:
    """Mean composite and number of entities per budget and level."""
    return composites.join(labels.select(*entity, level), entity).groupBy("budget", level).agg(F.avg("composite").alias("mean"), F.count("*").alias("n"))


def control_sweep(df: DataFrame, over: str, within: list[str], features: list[str], is_control, thresholds: list[int], min_n: int = 3) -> DataFrame:
    """Mean pair similarity by the least number of controls that a value of ``over`` must have; cells need ``min_n`` entities."""
    controls = df.where(is_control).groupBy(over).agg(F.count("*").alias("__c"))
    rows = mean_profile(df, [*within, over], features).where(F.col("n") >= min_n).join(controls, over)
    rows = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("__c") >= F.col("threshold"))
    return similarity_summary(profile_similarity(rows, over, ["threshold", *within]), ["threshold", *within])


def _folds(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """``df`` with a value of ``key``, each row with ``counts``: 1 in the folds of all other values; the folds' names by ``rep``; their number. ``key`` names data sets, whose list is one row."""
    names = written(df.agg(F.array_sort(F.collect_set(key)).alias("__folds")), "folds")
    rows = df.where(F.col(key).isNotNull()).crossJoin(F.broadcast(names)).withColumn("counts", F.transform("__folds", lambda f: (f != F.col(key)).cast("int"))).drop("__folds")
    by_number = names.select(F.posexplode("__folds").alias("__i", "held_out")).select((F.col("__i") + 1).alias("rep"), "held_out")
    return rows, by_number, names.select(F.size("__folds")).first()[0]


def lodo_spearman(df: DataFrame, key: str, x: str, y: str, by: list[str], min_n: int = 5) -> DataFrame:
    """``held_out``, ``n`` and ``rho`` without each value of ``key`` in turn. No row is copied: a fold is one place of an array of weights."""
    rows, folds, width = _folds(df.select(*by, key, x, y), key)
    return replicate_spearman(rows, x, y, by, width, min_n).join(F.broadcast(folds), "rep").drop("rep")


def lodo_kruskal(df: DataFrame, key: str, value: str, group: str, by: list[str], min_n: int = 5) -> DataFrame:
    """``held_out, n, k, h, eps2`` without each value of ``key`` in turn; a fold takes the groups with ``min_n`` values of other data sets."""
    rows, folds, width = _folds(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*by, key, group, value), key)
    sizes = rows.groupBy(*by, group, key, "counts").agg(F.count("*").alias("__n")).groupBy(*by, group).agg(F.collect_list(F.struct("counts", "__n")).alias("__own"))  # a row a data set
    left = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate("__own", F.lit(0).cast("long"), lambda a, o: a + F.get(o["counts"], i) * o["__n"]) >= min_n)
    taken = matched(rows, sizes.select(*by, group, left.alias("__large")), [*by, group])
    taken = taken.withColumn("counts", F.zip_with("counts", "__large", lambda c, large: F.when(large, c).otherwise(0))).drop("__large")
    return replicate_kruskal(taken, value, group, by, width).join(F.broadcast(folds), "rep").drop("rep")


def stability(folds: DataFrame, full: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, max and range over folds; fixed values: range under 0.10 YES, under 0.15 WEAK, else NO; whether any fold differs from the full value by over 0.05."""
    ref = full.select(*by, F.col(value).alias("full_value"))
    out = folds.join(ref, by).groupBy(*by, "full_value").agg(F.count("*").alias("n_folds"), F.min(value).alias("low"), F.max(value).alias("high"), F.bool_or(F.abs(F.col(value) - F.col("full_value")) > 0.05).alias("moved"))
    width = F.col("high") - F.col("low")
    return out.withColumn("width", width).withColumn("stable", F.when(width < 0.10, "YES").when(width < 0.15, "WEAK").otherwise("NO"))


def lodo_both(df: DataFrame, key: str, x: str, y: str, group: str, by: list[str], min_n: int = 5) -> DataFrame:
    """rho and eps2 without each dataset, with the flag that both stay beyond their fixed limits, -0.3 and 0.1."""
    rho = lodo_spearman(df, key, x, y, by, min_n).select(*by, "held_out", "rho")
    eps = lodo_kruskal(df, key, x, group, by, min_n).select(*by, "held_out", "eps2")
    return rho.join(eps, [*by, "held_out"]).withColumn("holds", (F.col("rho") < -0.3) & (F.col("eps2") > 0.1))
