"""Queries on the entity table: rank statistics, effect sizes, reports, resampling, meta-analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..functions import tails
from ..operators import ranks, reports, resampling, synthesis
from . import query
from .bindings import B, FEATURES, L, E, avg_rank_sql, backbones, entity, entity_long, kw_sql, spearman_sql

R = lambda c: F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: R(F.col(n)) for n in names})


def _levels(spark, sf):
    return entity_long(spark, sf).withColumn("sevd", F.col("sev").cast("double"))


@query("o50_spearman", f"WITH {L} {spearman_sql('l', 'value', 'sev', 'feature', 5)}")
def o50(spark, sf):
    return rounded(ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature"]), "rho")


@query("o50_spearman_by_corpus", f"WITH {L} {spearman_sql('l', 'value', 'sev', 'feature, dataset', 10)}")
def o50_corpus(spark, sf):
    return rounded(ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature", "dataset"], 10), "rho")


@query("o50_spearman_window_plan", f"WITH {L} {spearman_sql('l', 'value', 'sev', 'feature', 5)}")
def o50_window(spark, sf):
    """The same statistic with ranks of rows by a window per key."""
    return rounded(ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature"], plan="window"), "rho")


_PARTIAL = f"""p0 AS (SELECT * FROM l WHERE value IS NOT NULL), p1 AS {avg_rank_sql('p0', 'value', 'feature')}, p2 AS (SELECT * EXCLUDE (r), r AS rx FROM p1), p3 AS {avg_rank_sql('p2', 'sev', 'feature')}, p4 AS (SELECT * EXCLUDE (r), r AS ry FROM p3), p5 AS {avg_rank_sql('p4', 'n_phones', 'feature')},
pc AS (SELECT feature, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS raw, covar_pop(rx, r) / nullif(stddev_pop(rx) * stddev_pop(r), 0) AS xz, covar_pop(ry, r) / nullif(stddev_pop(ry) * stddev_pop(r), 0) AS yz FROM p5 GROUP BY feature),
pp AS (SELECT *, (raw - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS part FROM pc)"""


@query("o51_partial_spearman", f"WITH {L}, {_PARTIAL} SELECT feature, n, round(raw, 6) AS raw, round(part, 6) AS partial, round(CASE WHEN abs(raw) > 0.01 THEN (1 - abs(part) / abs(raw)) * 100 ELSE 0 END, 4) AS confound_pct FROM pp")
def o51(spark, sf):
    out = ranks.partial_spearman(_levels(spark, sf), "value", "sevd", "n_phones", ["feature"])
    return rounded(out, "raw", "partial").withColumn("confound_pct", F.round("confound_pct", 4))


_PAIRS = """pr AS (SELECT g1.grp AS a, g2.grp AS b FROM (SELECT DISTINCT grp FROM e) g1, (SELECT DISTINCT grp FROM e) g2 WHERE g1.grp < g2.grp),
mw0 AS (SELECT feature, a, b, value, (grp = a)::INT AS in_a FROM l JOIN pr ON grp = a OR grp = b WHERE value IS NOT NULL),
mw1 AS (SELECT *, rank() OVER (PARTITION BY feature, a, b ORDER BY value) + (count(*) OVER (PARTITION BY feature, a, b, value) - 1) / 2.0 AS r FROM mw0),
ti AS (SELECT feature, a, b, sum(t * t * t - t) AS ties FROM (SELECT feature, a, b, value, CAST(count(*) AS DOUBLE) AS t FROM mw0 GROUP BY ALL) GROUP BY ALL),
mw2 AS (SELECT feature, a, b, sum(in_a) AS n_a, sum(1 - in_a) AS n_b, sum(r) FILTER (in_a = 1) AS s FROM mw1 GROUP BY ALL),
mw AS (SELECT *, s - n_a * (n_a + 1) / 2 AS u FROM mw2 JOIN ti USING (feature, a, b) WHERE n_a >= 5 AND n_b >= 5)"""


@query("o52_mann_whitney", f"WITH {L}, {_PAIRS} SELECT feature, a, b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, u, round(sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))), 6) AS z FROM mw")
def o52(spark, sf):
    return rounded(ranks.mann_whitney(_levels(spark, sf), "value", "grp", ["feature"]).select("feature", "a", "b", "n_a", "n_b", "u", "z"), "z")


@query("o53_cliffs_delta", f"WITH {L}, {_PAIRS} SELECT feature, a, b, round(2 * u / (n_a * n_b) - 1, 6) AS delta, round(1 - 2 * u / (n_a * n_b), 6) AS rank_biserial, CASE WHEN abs(2 * u / (n_a * n_b) - 1) >= 0.474 THEN 'large' WHEN abs(2 * u / (n_a * n_b) - 1) >= 0.33 THEN 'medium' WHEN abs(2 * u / (n_a * n_b) - 1) >= 0.147 THEN 'small' ELSE 'negligible' END AS size FROM mw")
def o53(spark, sf):
    out = ranks.mann_whitney(_levels(spark, sf), "value", "grp", ["feature"])
    return out.select("feature", "a", "b", R(F.col("delta")).alias("delta"), R(F.col("rank_biserial")).alias("rank_biserial"), f.magnitude(F.col("delta"), f.DELTA_CUTS, "negligible").alias("size"))


@query("o54_kruskal", f"WITH {L}, {kw_sql('l', 'grp', 'feature', 5)} SELECT feature, CAST(n AS BIGINT) AS n, k, round(h, 6) AS h, round(greatest((h - k + 1) / (n - k), 0), 6) AS eps2, CASE WHEN greatest((h - k + 1) / (n - k), 0) >= 0.14 THEN 'large' WHEN greatest((h - k + 1) / (n - k), 0) >= 0.06 THEN 'medium' ELSE 'small' END AS size FROM kw")
def o54(spark, sf):
    out = ranks.kruskal(_levels(spark, sf), "value", "grp", ["feature"])
    return rounded(out.withColumn("size", f.magnitude(F.col("eps2"), f.ETA_CUTS, "small")), "h", "eps2")


@query("o54_kruskal_levels", f"WITH {L}, {kw_sql('(SELECT * FROM l WHERE sev IS NOT NULL)', 'sev', 'feature, language', 3)} SELECT feature, language, CAST(n AS BIGINT) AS n, k, round(h, 6) AS h, round(greatest((h - k + 1) / (n - k), 0), 6) AS eps2 FROM kw")
def o54_levels(spark, sf):
    return rounded(ranks.kruskal(_levels(spark, sf), "value", "sev", ["feature", "language"], 3), "h", "eps2")


@query("o55_posthoc", f"""WITH {L}, {_PAIRS}, {kw_sql('l', 'grp', 'feature', 5)}, co AS (SELECT feature, grp, avg(value) AS m, var_samp(value) AS v FROM l WHERE value IS NOT NULL GROUP BY ALL),
z AS (SELECT feature, a, b, u, 2 * u / (n_a * n_b) - 1 AS delta, greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z, n_a, n_b FROM mw),
p AS (SELECT *, {tails.p_normal_sql('z')} AS p FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY p, a, b) AS rk, count(p) OVER (PARTITION BY feature) AS pm FROM p)
SELECT feature, r.a, r.b, u, round(delta, 6) AS delta, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 6) AS d, round(p, 6) AS p, round(least(1, max(p * (pm - rk + 1)) OVER (PARTITION BY feature ORDER BY rk ROWS UNBOUNDED PRECEDING)), 6) AS p_holm,
  round(h, 6) AS h, round(greatest((h - k + 1) / (n - k), 0), 6) AS eps2
FROM r JOIN kw USING (feature) JOIN co x USING (feature) JOIN co y USING (feature) WHERE x.grp = r.a AND y.grp = r.b""")
def o55(spark, sf):
    """Pairwise tests with Holm's correction beside effect sizes."""
    return rounded(ranks.posthoc(_levels(spark, sf), "value", "grp", ["feature"]).select("feature", "a", "b", "u", "delta", "d", "p", "p_holm", "h", "eps2"), "delta", "d", "p", "p_holm", "h", "eps2")


#: A stand-in for p values that SQL can compute as well: a quadratic decay of the correlation.
_PS = spearman_sql("l", "value", "sev", "feature, dataset", 5, "abs(rho) AS rho, (1 - abs(rho)) * (1 - abs(rho)) AS p")


def _family(spark, sf):
    rho = ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature", "dataset"])
    return rho.withColumn("p", F.round((1 - F.abs("rho")) * (1 - F.abs("rho")), 9))


@query("o56_bh_fdr", f"WITH {L}, p0 AS ({_PS}), p AS (SELECT feature, dataset, round(p, 9) AS p, row_number() OVER (PARTITION BY feature, p IS NULL ORDER BY round(p, 9), dataset) AS rk, count(p) OVER (PARTITION BY feature, p IS NULL) AS m FROM p0) SELECT feature, dataset, p, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / rk) OVER (PARTITION BY feature, p IS NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS q FROM p")
def o56(spark, sf):
    return rounded(ranks.bh_adjust(_family(spark, sf).select("feature", "dataset", "p"), "p", ["feature"], ties=["dataset"]), "q")


@query("o57_holm", f"WITH {L}, p0 AS ({_PS}), p AS (SELECT feature, dataset, round(p, 9) AS p, row_number() OVER (PARTITION BY feature, p IS NULL ORDER BY round(p, 9), dataset) AS rk, count(p) OVER (PARTITION BY feature, p IS NULL) AS m FROM p0) SELECT feature, dataset, p, round(CASE WHEN p IS NOT NULL THEN least(1, max(p * (m - rk + 1)) OVER (PARTITION BY feature, p IS NULL ORDER BY rk ROWS UNBOUNDED PRECEDING)) END, 6) AS q FROM p")
def o57(spark, sf):
    return rounded(ranks.holm_adjust(_family(spark, sf).select("feature", "dataset", "p"), "p", ["feature"], ties=["dataset"]), "q")


@query("o58_feature_ranking", f"WITH {L}, r AS ({spearman_sql('l', 'value', 'sev', 'feature, language', 5)}) SELECT feature, language, rho, rank() OVER (PARTITION BY language ORDER BY abs(rho) DESC) AS place FROM r")
def o58(spark, sf):
    rho = rounded(ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature", "language"]), "rho").drop("n")
    return ranks.rank_features(rho, "rho", ["language"])


@query("o58_top_k", f"WITH {L}, {kw_sql('l', 'grp', 'feature, language', 5)}, s AS (SELECT language, feature, round(greatest((h - k + 1) / (n - k), 0), 6) AS eps2 FROM kw) SELECT language, feature, eps2, row_number() OVER (PARTITION BY language ORDER BY eps2 DESC NULLS LAST, feature) AS place FROM s QUALIFY place <= 2")
def o58_top(spark, sf):
    eps = rounded(ranks.kruskal(_levels(spark, sf), "value", "grp", ["feature", "language"]), "eps2").select("language", "feature", "eps2")
    return ranks.top_k(eps, "eps2", ["language"], 2, ["feature"])


@query("o58_extreme_pairs", f"WITH {L}, {_PAIRS}, d AS (SELECT feature, a, b, round(abs(2 * u / (n_a * n_b) - 1), 9) AS s FROM mw), h AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY feature ORDER BY s, a, b) = 1), z AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY feature ORDER BY s DESC, a, b) = 1) SELECT h.feature, h.a AS hard_a, h.b AS hard_b, round(h.s, 6) AS hard_size, z.a AS easy_a, z.b AS easy_b, round(z.s, 6) AS easy_size FROM h JOIN z USING (feature)")
def o58_extreme(spark, sf):
    d = ranks.mann_whitney(_levels(spark, sf), "value", "grp", ["feature"]).withColumn("delta", F.round("delta", 9))
    return rounded(ranks.extreme_pair(d, "delta", ["feature"]), "hard_size", "easy_size")


@query("o59_backbone_agreement", f"WITH {B}, j AS (SELECT x.backbone AS m1, y.backbone AS m2, x.value AS x, y.value AS y FROM b x JOIN b y ON x.speaker_id = y.speaker_id AND x.backbone < y.backbone) {spearman_sql('j', 'x', 'y', 'm1, m2', 20)}")
def o59(spark, sf):
    return rounded(ranks.agreement(backbones(spark, sf), "value", "backbone", ["speaker_id"]), "rho")


@query("o29_common_entities", f"WITH {B} SELECT x.backbone AS m1, y.backbone AS m2, count(*) AS n FROM b x JOIN b y ON x.speaker_id = y.speaker_id AND x.backbone < y.backbone GROUP BY ALL")
def o29(spark, sf):
    from ..operators.cohorts import common_entities

    return common_entities(backbones(spark, sf), "backbone", ["speaker_id"]).groupBy("m1", "m2").agg(F.count("*").alias("n"))


@query("o85_compare_backbones", f"WITH {B}, r AS ({spearman_sql('b', 'value', 'sev', 'backbone', 5)}), m AS (SELECT backbone, avg(value) FILTER (sev = 0) AS m0, avg(value) FILTER (sev = 3) AS m3 FROM b GROUP BY 1) SELECT backbone, n, rho, round(m0, 4) AS m0, round(m3, 4) AS m3 FROM r JOIN m USING (backbone)")
def o85(spark, sf):
    b = backbones(spark, sf).withColumn("sevd", F.col("sev").cast("double"))
    rho = rounded(ranks.spearman(b, "value", "sevd", ["backbone"]), "rho")
    trend = reports.severity_trend(b, "sev", ["backbone"], [0, 1, 2, 3])
    return rho.join(trend, "backbone").select("backbone", "n", "rho", F.round("m0", 4).alias("m0"), F.round("m3", 4).alias("m3"))


def cos_sql(a: str, b: str) -> str:
    """Cosine over the dimensions that both lists have, of which there must be three."""
    total = lambda x: f"list_sum(list_transform(list_filter(list_zip({a}, {b}), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL), lambda z: {x}))"
    return f"(CASE WHEN {total('1')} >= 3 THEN {total('z[1] * z[2]')} / nullif(sqrt({total('z[1] * z[1]')}) * sqrt({total('z[2] * z[2]')}), 0) END)"


def profiles_sql(rows: str, keys: str) -> str:
    return f"(SELECT {keys}, [avg(f1), avg(f2), avg(f3)] AS p, count(*) AS n FROM {rows} GROUP BY {keys})"


@query("o60_profile_similarity", f"WITH {E}, p AS {profiles_sql('e', 'grp, language')} SELECT a.grp, a.language AS l1, b.language AS l2, round({cos_sql('a.p', 'b.p')}, 6) AS similarity FROM p a JOIN p b ON a.grp = b.grp AND a.language < b.language")
def o60(spark, sf):
    p = reports.mean_profile(entity(spark, sf), ["grp", "language"], FEATURES)
    return rounded(reports.profile_similarity(p, "language", ["grp"]), "similarity")


@query("o60_similarity_summary", f"WITH {E}, p AS {profiles_sql('e', 'grp, language')}, s AS (SELECT a.grp, {cos_sql('a.p', 'b.p')} AS s FROM p a JOIN p b ON a.grp = b.grp AND a.language < b.language) SELECT grp, count(s) AS n_pairs, round(avg(s), 6) AS mean_sim, round(min(s), 6) AS min_sim, round(max(s), 6) AS max_sim FROM s GROUP BY grp")
def o60_summary(spark, sf):
    p = reports.mean_profile(entity(spark, sf), ["grp", "language"], FEATURES)
    return rounded(reports.similarity_summary(reports.profile_similarity(p, "language", ["grp"]), ["grp"]), "mean_sim", "min_sim", "max_sim")


@query("o21_cosine_complete", f"WITH {E}, p AS (SELECT *, (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + (f3 IS NOT NULL)::INT AS k FROM e) SELECT speaker_id, CASE WHEN k >= 3 THEN round((f1 * 2 + f2 * 3 + f3 * 5) / (sqrt(f1 * f1 + f2 * f2 + f3 * f3) * sqrt(38)), 6) END AS similarity FROM p")
def o21(spark, sf):
    e = entity(spark, sf)
    return e.select("speaker_id", R(f.cosine_complete(F.array(*FEATURES), F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0)))).alias("similarity"))


@query("o19_composite", f"WITH {E} SELECT speaker_id, CASE WHEN f1 IS NOT NULL AND f3 IS NOT NULL THEN round((f1 + f2 + f3) / 3, 4) END AS composite FROM e")
def o19(spark, sf):
    return entity(spark, sf).select("speaker_id", F.round(f.composite([F.col(c) for c in FEATURES]), 4).alias("composite"))


@query("o38_mean_profile", f"WITH {E}, p AS {profiles_sql('e', 'grp, language')} SELECT grp, language, round(p[1], 6) AS p1, round(p[2], 6) AS p2, round(p[3], 6) AS p3, n FROM p")
def o38(spark, sf):
    p = reports.mean_profile(entity(spark, sf), ["grp", "language"], FEATURES)
    return p.select("grp", "language", *[R(F.get("profile", F.lit(i))).alias(f"p{i + 1}") for i in range(3)], "n")


@query("o39_control_ratio", f"WITH {L}, b AS (SELECT language, feature, avg(value) AS c, count(*) AS n_controls FROM l WHERE sev = 0 GROUP BY ALL HAVING count(*) >= 3), g AS (SELECT grp, language, feature, avg(value) AS g FROM l WHERE sev > 0 GROUP BY ALL) SELECT grp, language, feature, n_controls, round(g / CASE WHEN c = 0 THEN 1 ELSE c END, 6) AS ratio FROM g JOIN b USING (language, feature)")
def o39(spark, sf):
    out = reports.control_ratio(entity_long(spark, sf), F.col("sev") == 0, "grp", "language")
    return rounded(out.select("grp", "language", "feature", "n_controls", "ratio"), "ratio")


@query("o40_cohens_d", f"WITH {L}, o AS (SELECT feature, grp, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL) SELECT x.feature, x.grp AS a, y.grp AS b, x.n AS n_a, y.n AS n_b, round((x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)), 6) AS d FROM o x JOIN o y ON x.feature = y.feature AND x.grp < y.grp")
def o40(spark, sf):
    return rounded(reports.cohens_d(entity_long(spark, sf), "grp", ["feature"]), "d")


_SEV = ", ".join(f"count(*) FILTER (sev = {v}) AS n_{v}" for v in range(4))


@query("o41_crosstab", f"WITH {E} SELECT coalesce(dataset, 'TOTAL') AS dataset, {_SEV}, count(*) AS total FROM e GROUP BY ROLLUP (dataset)")
def o41(spark, sf):
    return reports.crosstab(entity(spark, sf), "dataset", "sev", [0, 1, 2, 3])


@query("o42_coverage", f"WITH {E}, k AS (SELECT dataset, sev, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 10) SELECT dataset, count(*) AS n_levels, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1 HAVING count(*) >= 2")
def o42(spark, sf):
    return reports.coverage(entity(spark, sf), "dataset", "sev", 10)


@query("o43_describe", f"WITH {L} SELECT feature, sev, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75 FROM l WHERE value IS NOT NULL GROUP BY ALL")
def o43(spark, sf):
    return reports.describe_by(entity_long(spark, sf), ["feature", "sev"]).select("feature", "sev", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "median", "q25", "q75")])


@query("o44_severity_trend", f"WITH {L}, m AS (SELECT feature, sev, avg(value) AS m FROM l WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT *, m - lag(m) OVER (PARTITION BY feature ORDER BY sev) AS d FROM m), k AS (SELECT feature, max(m) FILTER (sev = 0) AS m0, max(m) FILTER (sev = 1) AS m1, max(m) FILTER (sev = 2) AS m2, max(m) FILTER (sev = 3) AS m3, bool_and(d > 0) AS up, bool_and(d < 0) AS down, count(*) AS n_levels FROM s GROUP BY feature) SELECT feature, round(m0, 4) AS m0, round(m1, 4) AS m1, round(m2, 4) AS m2, round(m3, 4) AS m3, n_levels, CASE WHEN up THEN 'UP' WHEN down THEN 'DOWN' ELSE 'MIXED' END AS trend, n_levels = 4 AND (up OR down) AS monotonic FROM k")
def o44(spark, sf):
    out = reports.severity_trend(entity_long(spark, sf), "sev", ["feature"], [0, 1, 2, 3])
    return out.select("feature", *[F.round(f"m{i}", 4).alias(f"m{i}") for i in range(4)], "n_levels", "trend", "monotonic")


@query("o45_heatmap_feed", f"WITH {L}, m AS (SELECT dataset, feature, avg(value) AS m FROM l GROUP BY ALL), s AS (SELECT feature, avg(m) AS mu, stddev_pop(m) AS sd FROM m GROUP BY 1) SELECT dataset, feature, round((m - mu) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 6) AS z FROM m JOIN s USING (feature)")
def o45(spark, sf):
    return rounded(reports.z_matrix(entity_long(spark, sf), ["dataset"], ["dataset"]), "z")


@query("o45_radar_feed", f"WITH {L} SELECT grp, sev, feature, round(avg(value), 4) AS mean, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def o45_radar(spark, sf):
    return reports.chart_means(entity_long(spark, sf), ["grp", "sev"], 2).withColumn("mean", F.round("mean", 4))


@query("o45_box_feed", f"WITH {L} SELECT grp, sev, feature, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS low, max(value) AS high FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def o45_box(spark, sf):
    return rounded(reports.box_feed(entity_long(spark, sf), ["grp", "sev"]), "q25", "median", "q75")


@query("o45_slope_feed", f"WITH {L} SELECT grp, feature, round(avg(value) FILTER (sev = 0), 6) AS start, round(avg(value) FILTER (sev = 3), 6) AS \"end\", round(avg(value) FILTER (sev = 3) - avg(value) FILTER (sev = 0), 6) AS change FROM l GROUP BY ALL")
def o45_slope(spark, sf):
    return rounded(reports.slope_feed(entity_long(spark, sf), "sev", ["grp"], 0, 3), "start", "end", "change")


@query("o45_bubble_feed", f"WITH {E} SELECT dataset, quantile_cont(CAST(n_phones AS DOUBLE), 0.5) AS x, round(avg(f2), 6) AS y, count(*) AS n FROM e WHERE sev = 0 GROUP BY 1 HAVING count(*) >= 2")
def o45_bubble(spark, sf):
    return rounded(reports.bubble_feed(entity(spark, sf).where("sev = 0"), "dataset", "n_phones", "f2"), "y")


@query("o45_grid_feed", f"WITH {L} SELECT language, feature, {', '.join(f'round(avg(value) FILTER (sev = {v}), 6) AS m{v}' for v in range(4))} FROM l GROUP BY ALL")
def o45_grid(spark, sf):
    return rounded(reports.grid_feed(entity_long(spark, sf), "language", "sev", [0, 1, 2, 3]), "m0", "m1", "m2", "m3")


@query("o46_convergence", f"WITH {L}, p AS (SELECT feature, dataset, avg(value) AS m, stddev_pop(value) AS sd FROM l WHERE sev = 0 AND value IS NOT NULL GROUP BY ALL) SELECT feature, count(*) AS n_corpora, round(avg(m), 4) AS mean, round(avg(sd), 4) AS mean_sd, round(max(m) - min(m), 4) AS spread, round((max(m) - min(m)) * 100 / nullif(abs(avg(m)), 0), 4) AS spread_pct FROM p GROUP BY feature")
def o46(spark, sf):
    out = reports.convergence(entity_long(spark, sf).where("sev = 0"), "dataset", ["feature"])
    return out.select("feature", "n_corpora", *[F.round(c, 4).alias(c) for c in ("mean", "mean_sd", "spread", "spread_pct")])


_FIT = "u AS (SELECT * FROM l WHERE value IS NOT NULL AND n_phones > 0), ft AS (SELECT feature, regr_slope(value, n_phones) AS k, avg(value) AS g, count(*) AS m FROM u GROUP BY 1), aj AS (SELECT l.*, CASE WHEN m >= 20 AND n_phones > 0 THEN value - k * n_phones + g ELSE value END AS adjusted FROM l JOIN ft USING (feature))"


@query("o47_regress_out", f"WITH {L}, {_FIT} SELECT speaker_id, feature, round(adjusted, 4) AS adjusted FROM aj")
def o47(spark, sf):
    return reports.regress_out(entity_long(spark, sf), "n_phones", ["feature"]).select("speaker_id", "feature", F.round("adjusted", 4).alias("adjusted"))


@query("o48_adjustment_report", f"WITH {L}, {_FIT}, r AS (SELECT feature, corr(value, n_phones) AS b, covar_pop(adjusted, n_phones) / (stddev_pop(adjusted) * stddev_pop(n_phones)) AS a FROM aj WHERE value IS NOT NULL AND n_phones > 0 GROUP BY 1) SELECT feature, round(b, 6) AS before, round(a, 6) + 0.0 AS after, round((abs(b) - abs(a)) * 100 / abs(b), 4) AS reduction_pct FROM r")
def o48(spark, sf):
    adjusted = reports.regress_out(entity_long(spark, sf), "n_phones", ["feature"])
    out = reports.adjustment_report(adjusted, "n_phones", ["feature"])
    return out.select("feature", R(F.col("before")).alias("before"), (R(F.col("after")) + 0.0).alias("after"), F.round("reduction_pct", 4).alias("reduction_pct"))


@query("o49_quality_filter", f"WITH {E}, p AS (SELECT speaker_id, n_phones / greatest(speaker_id % 5, 1) AS proxy FROM e) SELECT speaker_id, round(proxy, 6) AS proxy FROM p WHERE proxy >= (SELECT quantile_cont(proxy, 0.1) FROM p)")
def o49(spark, sf):
    e = entity(spark, sf).select("speaker_id", F.col("n_phones").cast("double").alias("t"))
    return rounded(reports.quality_filter(e, F.col("t"), F.col("speaker_id") % 5).select("speaker_id", "proxy"), "proxy")


@query("o63_quartile_bins", f"WITH {E}, q AS (SELECT language, quantile_cont(n_phones, [0.25, 0.5, 0.75]) AS k FROM e GROUP BY 1) SELECT language, CASE WHEN n_phones <= k[1] THEN 1 WHEN n_phones <= k[2] THEN 2 WHEN n_phones <= k[3] THEN 3 ELSE 4 END AS quartile, (n_phones >= 5)::INT + (n_phones >= 10)::INT + (n_phones >= 20)::INT AS bin, count(*) AS n FROM e JOIN q USING (language) GROUP BY ALL")
def o63(spark, sf):
    rows = reports.bin_quartile(entity(spark, sf), "n_phones", ["language"])
    return rows.groupBy("language", "quartile", reports.bin_fixed(F.col("n_phones"), [5, 10, 20]).alias("bin")).agg(F.count("*").alias("n"))


@query("o65_trajectories", f"WITH {E}, p AS (SELECT speaker_id, speaker_id // 4 AS person, f2 FROM e) SELECT person, speaker_id, f2, round(f2 - lag(f2) OVER (PARTITION BY person ORDER BY speaker_id), 4) AS f2_change FROM p")
def o65(spark, sf):
    e = entity(spark, sf)
    persons = e.select("speaker_id", F.expr("speaker_id div 4").alias("person"))
    out = reports.trajectories(e.withColumn("seq", F.col("speaker_id")), persons, "seq", ["f2"]).drop("seq")
    return out.withColumn("f2_change", F.round("f2_change", 4))


@query("o67_test_family", f"WITH {L}, a AS ({spearman_sql('l', 'value', 'sev', 'feature', 5)}), d AS ({spearman_sql('l', 'value', 'sev', 'feature, dataset', 5)}) SELECT feature, NULL AS dataset, 'overall' AS test, rho FROM a UNION ALL SELECT feature, dataset, 'corpus', rho FROM d")
def o67(spark, sf):
    lv = _levels(spark, sf)
    overall = ranks.spearman(lv, "value", "sevd", ["feature"]).withColumn("test", F.lit("overall"))
    corpus = ranks.spearman(lv, "value", "sevd", ["feature", "dataset"]).withColumn("test", F.lit("corpus"))
    return rounded(reports.union_family([overall, corpus]).select("feature", "dataset", "test", "rho"), "rho")


@query("o69_compare_subsets", f"WITH {L}, s AS (SELECT l.*, 'full' AS scenario FROM l UNION ALL SELECT l.*, 'without_asia' FROM l WHERE language <> 'ASIA' UNION ALL SELECT l.*, 'large' FROM l WHERE n_phones >= 10), r AS ({spearman_sql('s', 'value', 'sev', 'feature, scenario', 5, 'rho')}) SELECT x.feature, x.scenario, round(x.rho, 6) AS rho, round(b.rho, 6) AS base_value, round(x.rho - b.rho, 6) AS change FROM r x JOIN r b ON x.feature = b.feature AND b.scenario = 'full' WHERE x.scenario <> 'full'")
def o69(spark, sf):
    rows = reports.in_scenarios(_levels(spark, sf), {"full": F.lit(True), "without_asia": F.col("language") != "ASIA", "large": F.col("n_phones") >= 10})
    stats = ranks.spearman(rows, "value", "sevd", ["feature", "scenario"])
    return rounded(reports.compare_subsets(stats, "rho", ["feature"], "full").select("feature", "scenario", "rho", "base_value", "change"), "rho", "base_value", "change")


_SCENARIOS = "s AS (SELECT l.*, 'full' AS scenario FROM l UNION ALL SELECT l.*, 'without_asia' FROM l WHERE language <> 'ASIA' UNION ALL SELECT l.*, 'large' FROM l WHERE n_phones >= 10)"


@query("o69_compare_subsets_groups", f"WITH {L}, {_SCENARIOS}, {kw_sql('s', 'grp', 'feature, scenario', 5)}, x AS (SELECT feature, scenario, greatest((h - k + 1) / (n - k), 0) AS eps2 FROM kw) SELECT x.feature, x.scenario, round(x.eps2, 6) AS eps2, round(b.eps2, 6) AS base_value, round(x.eps2 - b.eps2, 6) AS change FROM x JOIN x b ON x.feature = b.feature AND b.scenario = 'full' WHERE x.scenario <> 'full'")
def o69_groups(spark, sf):
    rows = reports.in_scenarios(_levels(spark, sf), {"full": F.lit(True), "without_asia": F.col("language") != "ASIA", "large": F.col("n_phones") >= 10})
    stats = ranks.kruskal(rows, "value", "grp", ["feature", "scenario"])
    return rounded(reports.compare_subsets(stats, "eps2", ["feature"], "full").select("feature", "scenario", "eps2", "base_value", "change"), "eps2", "base_value", "change")


@query("o84_stratified", f"WITH {L}, s AS (SELECT l.*, CASE WHEN language IN ('ASIA', 'AFRICA') THEN 'read' ELSE 'spontaneous' END AS task FROM l) {spearman_sql('s', 'value', 'sev', 'feature, task', 5)}")
def o84(spark, sf):
    lv = _levels(spark, sf)
    tasks = lv.select("language").distinct().withColumn("task", F.when(F.col("language").isin("ASIA", "AFRICA"), "read").otherwise("spontaneous"))
    return rounded(ranks.spearman(lv.join(tasks, "language"), "value", "sevd", ["feature", "task"]), "rho")


# ---- resampling


def _boot_sql(part: str, reps: int, seed: int, rows: str = "e") -> str:
    return f"""bn AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY speaker_id) - 1 AS pos, count(*) OVER (PARTITION BY {part}) AS size FROM {rows}),
bd AS (SELECT bn.* EXCLUDE (pos), rep, CAST({f.draw_sql('rep', 'pos', seed)} % size AS BIGINT) AS pos FROM bn, range(1, {reps + 1}) x(rep)),
bs AS (SELECT d.rep, n.* FROM bd d JOIN bn n ON {' AND '.join(f'd.{c.strip()} = n.{c.strip()}' for c in part.split(','))} AND d.pos = n.pos)"""


_CI = "count(rho) AS n_reps, round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high, round(avg(rho), 6) AS mean"


@query("o70_bootstrap_ci", f"WITH {E}, {_boot_sql('language', 200, 11)}, r AS ({spearman_sql('bs', 'f2', 'sev', 'language, rep', 5, 'rho')}) SELECT language, {_CI} FROM r GROUP BY 1")
def o70(spark, sf):
    e = entity(spark, sf).select("language", "speaker_id", "f2", F.col("sev").cast("double").alias("sev"))
    return rounded(resampling.bootstrap_spearman(e, "f2", "sev", ["language"], "speaker_id", 200, seed=11), "low", "high", "mean")


_QUART = "q AS (SELECT quantile_cont(n_phones, [0.25, 0.5, 0.75]) AS k FROM e), eq AS (SELECT e.*, CASE WHEN n_phones <= k[1] THEN 1 WHEN n_phones <= k[2] THEN 2 WHEN n_phones <= k[3] THEN 3 ELSE 4 END AS quartile FROM e, q)"


@query("o71_stratified_bootstrap", f"WITH {E}, {_QUART}, {_boot_sql('language, quartile', 50, 13, 'eq')}, r AS ({spearman_sql('bs', 'f2', 'sev', 'language, rep', 5, 'rho')}) SELECT language, {_CI} FROM r GROUP BY 1")
def o71(spark, sf):
    e = reports.bin_quartile(entity(spark, sf), "n_phones").select("language", "quartile", "speaker_id", "f2", F.col("sev").cast("double").alias("sev"))
    return rounded(resampling.bootstrap_spearman(e, "f2", "sev", ["language"], "speaker_id", 50, ["quartile"], seed=13), "low", "high", "mean")


@query("o72_bootstrap_similarity", f"WITH {E}, {_boot_sql('grp, language', 40, 17)}, p AS {profiles_sql('bs', 'grp, rep, language')}, s AS (SELECT a.grp, a.language AS l1, b.language AS l2, {cos_sql('a.p', 'b.p')} AS rho FROM p a JOIN p b ON a.grp = b.grp AND a.rep = b.rep AND a.language < b.language) SELECT grp, l1, l2, {_CI} FROM s GROUP BY ALL")
def o72(spark, sf):
    e = entity(spark, sf).select("grp", "language", "speaker_id", *FEATURES)
    return rounded(resampling.bootstrap_similarity(e, "language", ["grp"], FEATURES, "speaker_id", 40, 17), "low", "high", "mean")


@query("o73_similarity_sweep", f"WITH {E}, p AS {profiles_sql('e', 'grp, language')}, t AS (SELECT p.*, th FROM p JOIN (VALUES (1), (30), (55), (60)) x(th) ON n >= th), s AS (SELECT a.th, a.grp, {cos_sql('a.p', 'b.p')} AS s FROM t a JOIN t b ON a.grp = b.grp AND a.th = b.th AND a.language < b.language) SELECT th AS threshold, grp, count(s) AS n_pairs, round(avg(s), 6) AS mean_sim, round(min(s), 6) AS min_sim, round(max(s), 6) AS max_sim FROM s GROUP BY ALL")
def o73(spark, sf):
    return rounded(resampling.similarity_sweep(entity(spark, sf), "language", ["grp"], FEATURES, [1, 30, 55, 60]), "mean_sim", "min_sim", "max_sim")


@query("o73_bootstrap_mean", f"WITH {E}, p AS {profiles_sql('e', 'grp, language')}, s AS (SELECT a.grp AS language, a.language || b.language AS speaker_id, {cos_sql('a.p', 'b.p')} AS f FROM p a JOIN p b ON a.grp = b.grp AND a.language < b.language), {_boot_sql('language', 50, 19, 's')}, r AS (SELECT language, rep, avg(f) AS rho FROM bs GROUP BY ALL) SELECT language AS grp, {_CI} FROM r GROUP BY 1")
def o73_mean(spark, sf):
    pairs = reports.profile_similarity(reports.mean_profile(entity(spark, sf), ["grp", "language"], FEATURES), "language", ["grp"]).withColumn("pair", F.concat("l1", "l2"))
    return rounded(resampling.bootstrap_mean(pairs, "similarity", ["grp"], "pair", 50, 19), "low", "high", "mean")


@query("o73_control_sweep", f"WITH {E}, c AS (SELECT language, count(*) AS c FROM e WHERE sev = 0 GROUP BY 1), p AS {profiles_sql('e', 'grp, language')}, t AS (SELECT p.*, th FROM p JOIN c USING (language), (VALUES (1), (5), (10), (20), (50)) x(th) WHERE n >= 3 AND c >= th), s AS (SELECT a.th, a.grp, {cos_sql('a.p', 'b.p')} AS s FROM t a JOIN t b ON a.grp = b.grp AND a.th = b.th AND a.language < b.language) SELECT th AS threshold, grp, count(s) AS n_pairs, round(avg(s), 6) AS mean_sim, round(min(s), 6) AS min_sim, round(max(s), 6) AS max_sim FROM s GROUP BY ALL")
def o73_controls(spark, sf):
    return rounded(resampling.control_sweep(entity(spark, sf), "language", ["grp"], FEATURES, F.col("sev") == 0, [1, 5, 10, 20, 50]), "mean_sim", "min_sim", "max_sim")


@query("o74_permutation_test", f"""WITH {E}, ob AS (SELECT grp, avg(s) AS observed FROM (SELECT a.grp, {cos_sql('a.p', 'b.p')} AS s FROM {profiles_sql('e', 'grp, language')} a JOIN {profiles_sql('e', 'grp, language')} b ON a.grp = b.grp AND a.language < b.language) GROUP BY 1),
r0 AS (SELECT e.*, rep FROM e, range(1, 201) x(rep)), ra AS (SELECT * EXCLUDE (language), row_number() OVER (PARTITION BY grp, rep ORDER BY speaker_id) AS i FROM r0),
rh AS (SELECT grp, rep, language, speaker_id, {f.draw_sql('rep', 'speaker_id', 23)} AS h FROM r0), rb AS (SELECT grp, rep, language, row_number() OVER (PARTITION BY grp, rep ORDER BY h, speaker_id) AS i FROM rh),
rp AS (SELECT ra.*, rb.language FROM ra JOIN rb USING (grp, rep, i)), p AS {profiles_sql('rp', 'grp, rep, language')},
nu AS (SELECT a.grp, a.rep, avg({cos_sql('a.p', 'b.p')}) AS m FROM p a JOIN p b ON a.grp = b.grp AND a.rep = b.rep AND a.language < b.language GROUP BY ALL)
SELECT grp, round(observed, 6) AS observed, round(avg(CASE WHEN m >= observed THEN 1.0 ELSE 0.0 END), 6) AS p, round(quantile_cont(m, 0.025), 6) AS null_low, round(quantile_cont(m, 0.975), 6) AS null_high FROM nu JOIN ob USING (grp) GROUP BY grp, observed""")
def o74(spark, sf):
    return rounded(resampling.permutation_test(entity(spark, sf), ["grp"], "language", FEATURES, "speaker_id", 200, 23), "observed", "p", "null_low", "null_high")


@query("o78_leave_one_dataset_out", f"WITH {L}, h AS (SELECT l.*, held_out FROM l JOIN (SELECT DISTINCT dataset AS held_out FROM e) ON dataset <> held_out), r AS ({spearman_sql('h', 'value', 'sev', 'feature, held_out', 5, 'rho')}), a AS ({spearman_sql('l', 'value', 'sev', 'feature', 5, 'rho')}) SELECT r.feature, round(a.rho, 6) AS full_value, count(*) AS n_folds, round(min(r.rho), 6) AS low, round(max(r.rho), 6) AS high, bool_or(abs(r.rho - a.rho) > 0.05) AS moved, round(max(r.rho) - min(r.rho), 6) AS width, CASE WHEN max(r.rho) - min(r.rho) < 0.1 THEN 'YES' WHEN max(r.rho) - min(r.rho) < 0.15 THEN 'WEAK' ELSE 'NO' END AS stable FROM r JOIN a ON r.feature = a.feature GROUP BY r.feature, a.rho")
def o78(spark, sf):
    lv = _levels(spark, sf)
    folds = resampling.lodo_spearman(lv, "dataset", "value", "sevd", ["feature"])
    out = resampling.stability(folds, ranks.spearman(lv, "value", "sevd", ["feature"]), "rho", ["feature"])
    return rounded(out, "full_value", "low", "high", "width")


@query("o78_leave_one_out_both", f"WITH {L}, h AS (SELECT l.*, held_out FROM l JOIN (SELECT DISTINCT dataset AS held_out FROM e) ON dataset <> held_out), r AS ({spearman_sql('h', 'value', 'sev', 'feature, held_out', 5, 'rho')}), {kw_sql('h', 'grp', 'feature, held_out', 5)} SELECT feature, held_out, round(rho, 6) AS rho, round(greatest((h - k + 1) / (kw.n - k), 0), 6) AS eps2, rho < -0.3 AND greatest((h - k + 1) / (kw.n - k), 0) > 0.1 AS holds FROM r JOIN kw USING (feature, held_out)")
def o78_both(spark, sf):
    return rounded(resampling.lodo_both(_levels(spark, sf), "dataset", "value", "sevd", "grp", ["feature"]), "rho", "eps2")


# ---- across studies


_META = f"""st AS ({spearman_sql('l', 'value', 'sev', 'feature, dataset', 5, 'rho')}), w0 AS (SELECT feature, atanh(greatest(-0.999, least(0.999, rho))) AS z, CASE WHEN n > 3 THEN 1.0 / (n - 3) ELSE 1.0 END AS se2 FROM st WHERE rho IS NOT NULL),
w1 AS (SELECT feature, count(*) AS k, sum(1 / se2) AS sw, sum(1 / se2 / se2) AS sw2, sum(z / se2) AS swz, sum(z * z / se2) AS swz2 FROM w0 GROUP BY 1 HAVING count(*) >= 2),
w2 AS (SELECT *, swz2 - swz * swz / sw AS q FROM w1), w3 AS (SELECT *, greatest(0, (q - k + 1) / (sw - sw2 / sw)) AS tau2, greatest(0, (q - k + 1) / nullif(q, 0)) * 100 AS i2 FROM w2),
w4 AS (SELECT feature, k, q, tau2, i2, sum(1 / (se2 + tau2)) AS sv, sum(z / (se2 + tau2)) / sum(1 / (se2 + tau2)) AS z FROM w0 JOIN w3 USING (feature) GROUP BY ALL)"""


@query("o79_meta_dl", f"WITH {L}, {_META} SELECT feature, k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(i2, 4) AS i2, round(tanh(z), 6) AS rho, round(tanh(z - 1.96 / sqrt(sv)), 6) AS low, round(tanh(z + 1.96 / sqrt(sv)), 6) AS high FROM w4")
def o79(spark, sf):
    out = synthesis.meta_dl(ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature", "dataset"]), ["feature"])
    return rounded(out, "q", "tau2", "rho", "low", "high").select("feature", "k", "q", "tau2", F.round("i2", 4).alias("i2"), "rho", "low", "high")


@query("o80_meta_hksj", f"""WITH {L}, {_META}, w5 AS (SELECT feature, sum(z * z / (se2 + tau2)) - sum(z / (se2 + tau2)) ** 2 / sum(1 / (se2 + tau2)) AS qr FROM w0 JOIN w3 USING (feature) GROUP BY 1),
w6 AS (SELECT feature, k, z, tau2, sqrt(1 / sv) AS se, sqrt(1 / sv) * sqrt(greatest(1, qr / (k - 1))) AS wider, {tails.t_quantile_sql('0.975', '(k - 1)')} AS t FROM w4 JOIN w5 USING (feature))
SELECT feature, k, round(tanh(z), 6) AS rho, round(tanh(z - t * wider), 6) AS hksj_low, round(tanh(z + t * wider), 6) AS hksj_high, round(tanh(z - 1.96 * sqrt(se * se + tau2)), 6) AS pred_low, round(tanh(z + 1.96 * sqrt(se * se + tau2)), 6) AS pred_high FROM w6""")
def o80(spark, sf):
    out = synthesis.meta_hksj(synthesis.meta_dl(ranks.spearman(_levels(spark, sf), "value", "sevd", ["feature", "dataset"]), ["feature"]))
    return rounded(out.select("feature", "k", "rho", "hksj_low", "hksj_high", "pred_low", "pred_high"), "rho", "hksj_low", "hksj_high", "pred_low", "pred_high")


_THR = "md AS (SELECT {k}, feature, sev, quantile_cont(value, 0.5) AS m FROM l WHERE value IS NOT NULL GROUP BY ALL), th AS (SELECT {k}, feature, sev, m, (m + lead(m) OVER (PARTITION BY {k}, feature ORDER BY sev)) / 2 AS t FROM md)"


@query("o81_threshold_transfer", f"""WITH {L}, {_THR.format(k='language')}, la AS (SELECT language, feature, max(sev) AS last FROM md GROUP BY ALL),
pr AS (SELECT la.language AS train, x.language AS test, x.feature, x.sev, coalesce((SELECT min(th.sev) FROM th WHERE th.language = la.language AND th.feature = x.feature AND x.value >= th.t), la.last) AS p FROM l x JOIN la ON la.feature = x.feature WHERE x.value IS NOT NULL)
{spearman_sql('pr', 'sev', 'p', 'train, test, feature', 5)}""")
def o81(spark, sf):
    return rounded(synthesis.threshold_transfer(entity_long(spark, sf), "sev", "language"), "rho")


@query("o82_universal_thresholds", f"WITH {L}, {_THR.format(k='1 AS one').replace('PARTITION BY 1 AS one, feature', 'PARTITION BY feature').replace('SELECT 1 AS one, feature, sev, m,', 'SELECT feature, sev, m,')} SELECT feature, sev AS level_at, round(m, 4) AS median, round(t, 4) AS threshold FROM th")
def o82(spark, sf):
    out = synthesis.thresholds(entity_long(spark, sf), "sev", ["feature"])
    return out.select("feature", "level_at", F.round("median", 4).alias("median"), F.round("threshold", 4).alias("threshold"))


@query("o82_level_overlap", f"WITH {L}, {_PAIRS.replace('grp', 'sev')} SELECT feature, a, b, u, round(2 * u / (n_a * n_b) - 1, 6) AS delta FROM mw")
def o82_overlap(spark, sf):
    return rounded(synthesis.overlap(entity_long(spark, sf), "sev", ["feature"]).select("feature", "a", "b", "u", "delta"), "delta")


_SCALES = ", ".join(f"CASE WHEN stddev_pop(f{i}) > 1e-12 THEN stddev_pop(f{i}) ELSE 1 END AS s{i}" for i in (1, 2, 3))


@query("o83_knn_by_fold", f"""WITH {E}, p AS (SELECT CAST(speaker_id AS VARCHAR) AS id, grp, language, f1, f2, f3 FROM e WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL),
fo AS (SELECT DISTINCT language AS held FROM p), sc AS (SELECT held, {_SCALES} FROM fo JOIN p ON language <> held GROUP BY held),
nb AS (SELECT a.id, a.grp AS truth, b.grp AS vote FROM p a JOIN sc ON sc.held = a.language JOIN p b ON b.language <> a.language
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY ((b.f1 - a.f1) / s1) ** 2 + ((b.f2 - a.f2) / s2) ** 2 + ((b.f3 - a.f3) / s3) ** 2, b.id) <= 5),
v AS (SELECT id, truth, vote, count(*) AS c FROM nb GROUP BY ALL), w AS (SELECT id, truth, vote AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, vote) = 1),
t AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = predicted) AS hit FROM w GROUP BY 1), g AS (SELECT predicted AS class, count(*) AS given FROM w GROUP BY 1)
SELECT class, round((SELECT sum(hit) / sum(support) FROM t), 6) AS accuracy, support, round(hit / support, 6) AS recall, round(coalesce(hit / given, 0), 6) AS precision FROM t LEFT JOIN g USING (class)""")
def o83(spark, sf):
    """Every entity's group by vote of its nearest entities of other languages."""
    e = entity(spark, sf)
    out = synthesis.class_report(synthesis.nearest_neighbours(e, FEATURES, "grp", "language", "speaker_id"), "truth", "predicted")
    return rounded(out, "accuracy", "recall", "precision")


@query("o83_logistic_by_fold")
def o83_logistic(spark, sf):
    e = entity(spark, sf).withColumn("y", F.col("sev").cast("double"))
    predictions, _ = synthesis.logistic_by_fold(e, FEATURES, "y", "language")
    return synthesis.class_report(predictions, "y", "prediction")


@query("o83_logistic_parts")
def o83_parts(spark, sf):
    """As if there were only two languages: five parts with their share of each level."""
    e = entity(spark, sf).withColumn("y", F.col("sev").cast("double")).withColumn("half", F.col("language") < "ASIA")
    predictions, _ = synthesis.logistic_by_fold(synthesis.folds_or_parts(e, "half", "speaker_id", "sev"), FEATURES, "y", "fold")
    return synthesis.class_report(predictions, "y", "prediction")


@query("o83_logistic_weights")
def o83_weights(spark, sf):
    """Mean absolute coefficient per feature of one model of all entities."""
    e = entity(spark, sf).withColumn("y", F.col("sev").cast("double"))
    return rounded(synthesis.logistic_weights(e, FEATURES, "y"), "mean_abs_coefficient")


@query("o86_significance", f"""WITH {L}, {_PARTIAL}, {kw_sql('l', 'grp', 'feature', 5)},
q AS (SELECT feature, pp.n, raw, {tails.p_t_sql('(raw * sqrt((pp.n - 2) / greatest(1e-300, 1 - raw * raw)))', '(pp.n - 2)')} AS p, {tails.p_t_sql('(part * sqrt((pp.n - 3) / (1 - part * part + 1e-10)))', '(pp.n - 3)')} AS p_partial, {tails.p_chi2_sql('h', '(k - 1)')} AS p_groups FROM pp JOIN kw USING (feature))
SELECT feature, n, round(raw, 6) AS rho, round(p, 12) AS p, round(p_partial, 12) AS p_partial, round(p_groups, 12) AS p_groups, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM q""")
def o86(spark, sf):
    """p values of rank correlations, of partial ones and of group tests, with stars."""
    lv = _levels(spark, sf)
    rho = ranks.spearman(lv, "value", "sevd", ["feature"], with_p=True)
    part = ranks.partial_spearman(lv, "value", "sevd", "n_phones", ["feature"], with_p=True).select("feature", F.col("p").alias("p_partial"))
    kw = ranks.kruskal(lv, "value", "grp", ["feature"], with_p=True).select("feature", F.col("p").alias("p_groups"))
    out = rounded(rho.join(part, "feature").join(kw, "feature").withColumn("stars", f.stars(F.col("p"))), "rho")
    return out.withColumns({c: F.round(c, 12) for c in ("p", "p_partial", "p_groups")})


@query("o23_labels", f"WITH {E} SELECT speaker_id, CASE WHEN f2 < 0 THEN '***' WHEN f2 < 10 THEN '***' WHEN f2 < 100 THEN '**' WHEN f2 < 500 THEN '*' ELSE 'ns' END AS stars, CASE WHEN abs(f2) > 1400 THEN 'large' WHEN abs(f2) > 600 THEN 'medium' ELSE 'small' END AS size FROM e")
def o23(spark, sf):
    e = entity(spark, sf)
    return e.select("speaker_id", f.stars(F.col("f2") / 10_000).alias("stars"), f.magnitude(F.col("f2") / 10_000, f.ETA_CUTS, "small", inclusive=False).alias("size"))


@query("o66_level_order", f"WITH {E} SELECT sev, grp, count(*) AS n FROM e GROUP BY ALL")
def o66(spark, sf):
    from ..operators.cohorts import order_by_levels

    rows = entity(spark, sf).groupBy("sev", "grp").agg(F.count("*").alias("n"))
    return order_by_levels(rows, "grp", ["MACHINERY", "AUTOMOBILE"], "sev")
