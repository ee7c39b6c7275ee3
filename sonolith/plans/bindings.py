"""The library's tables (entity, token, interval, manifest) bound to the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["f1", "f2", "f3"]
IDS = ["speaker_id", "dataset", "language", "grp", "sev", "n_phones"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities: nation, region and market segment are corpus, language and group; a level from the balance."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_phones"), F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("x"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, "c_custkey", "left")
    n = F.coalesce("n_phones", F.lit(0))
    return rows.select(
        F.col("c_custkey").alias("speaker_id"), F.col("n_name").alias("dataset"), F.col("r_name").alias("language"), F.col("c_mktsegment").alias("grp"),
        F.floor((9999 - F.col("c_acctbal") + (F.col("c_custkey") * 7919 % 4000)) / 3750).cast("int").alias("sev"), n.alias("n_phones"),
        F.when(n >= 3, F.col("m")).alias("f1"), F.col("c_acctbal").cast("double").alias("f2"), F.when(n >= 3, F.col("x") / 1000).alias("f3"),
    )


def entity_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reports import long_form

    return long_form(entity(spark, sf_dir), IDS, FEATURES)


E = """e AS (
  SELECT c.c_custkey AS speaker_id, n.n_name AS dataset, r.r_name AS language, c.c_mktsegment AS grp,
    CAST(floor((9999 - c.c_acctbal + (c.c_custkey * 7919 % 4000)) / 3750) AS INT) AS sev, count(o.o_orderkey) AS n_phones,
    CASE WHEN count(o.o_orderkey) >= 3 THEN avg(o.o_totalprice) END AS f1, CAST(c.c_acctbal AS DOUBLE) AS f2,
    CASE WHEN count(o.o_orderkey) >= 3 THEN max(o.o_totalprice) / 1000 END AS f3
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey
  GROUP BY c.c_custkey, n.n_name, r.r_name, c.c_mktsegment, c.c_acctbal)"""
L = f"""{E}, l AS (
  SELECT speaker_id, dataset, language, grp, sev, n_phones, 'f1' AS feature, CAST(f1 AS DOUBLE) AS value FROM e
  UNION ALL SELECT speaker_id, dataset, language, grp, sev, n_phones, 'f2', f2 FROM e
  UNION ALL SELECT speaker_id, dataset, language, grp, sev, n_phones, 'f3', CAST(f3 AS DOUBLE) FROM e)"""


def backbones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of the entity table, each without a seventh of the entities."""
    e = entity(spark, sf_dir)
    value = {0: F.col("f2"), 1: F.col("f2") + F.coalesce("f1", F.lit(0.0)) / 1000, 2: -F.col("f2")}
    parts = [e.where(F.col("speaker_id") % 7 != k).select(F.lit(f"b{k}").alias("backbone"), *IDS, v.alias("value")) for k, v in value.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


B = f"""{E}, b AS (
  SELECT 'b0' AS backbone, speaker_id, dataset, language, grp, sev, n_phones, f2 AS value FROM e WHERE speaker_id % 7 <> 0
  UNION ALL SELECT 'b1', speaker_id, dataset, language, grp, sev, n_phones, f2 + coalesce(f1, 0) / 1000 FROM e WHERE speaker_id % 7 <> 1
  UNION ALL SELECT 'b2', speaker_id, dataset, language, grp, sev, n_phones, -f2 FROM e WHERE speaker_id % 7 <> 2)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tokens of 10 speakers in utterances of 50 / 10."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label AS phone", "vec_id % 10 AS spk", "vec_id div 50 AS utt", "embedding")


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c1: labels under 5 against the others; c2: even against odd; from the labels that there are."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("phone")).distinct()
    one = lambda name, test: labels.select(F.lit(name).alias("feature"), "phone", F.when(test, "positive").otherwise("negative").alias("class"))
    return one("c1", F.col("phone") < 5).unionByName(one("c2", F.col("phone") % 2 == 0))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import classify

    return classify(tokens(spark, sf_dir), contrasts(spark, sf_dir), on=())


T = """t AS (SELECT vec_id, label AS phone, vec_id % 10 AS spk, vec_id // 50 AS utt, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT t.*, 'c1' AS feature, phone < 5 AS positive FROM t UNION ALL SELECT t.*, 'c2', phone % 2 = 0 FROM t)"""


def mean_sql(rows: str, keys: str) -> str:
    """Mean vectors per key as lists ``m``, with ``n``."""
    return f"""(SELECT {keys}, list(x ORDER BY i) AS m, max(n) AS n FROM (
      SELECT {keys}, i, avg(x) AS x, count(*) AS n FROM (SELECT {keys}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows}) GROUP BY {keys}, i) GROUP BY {keys})"""


def direction_sql(rows: str, keys: str, least: int) -> str:
    """Unit vectors ``u`` from the negative to the positive mean per key."""
    on = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    names = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    m = mean_sql(rows, f"{keys}, positive")
    return f"""(SELECT {keys}, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS u, np, nq FROM (
      SELECT {names}, list_transform(list_zip(p.m, q.m), lambda z: z[1] - z[2]) AS d, p.n AS np, q.n AS nq
      FROM {m} p JOIN {m} q ON {on} WHERE p.positive AND NOT q.positive AND p.n >= {least} AND q.n >= {least}) WHERE sqrt(list_inner_product(d, d)) >= 1e-8)"""


def scalar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as projected tokens of suppliers: returned against accepted, value is the price."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('R', 'A')")
    return rows.select(F.col("l_suppkey").alias("spk"), (F.col("l_returnflag") == "R").alias("positive"), F.col("l_extendedprice").cast("double").alias("z"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tok"), F.col("l_quantity").cast("double").alias("duration"))


S = """s AS (SELECT l_suppkey AS spk, l_returnflag = 'R' AS positive, CAST(l_extendedprice AS DOUBLE) AS z, l_orderkey * 8 + l_linenumber AS tok, CAST(l_quantity AS DOUBLE) AS duration FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals: a user's events of a day are an utterance, an event lasts three quarters of the time to the next (an hour at most, a second at least)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("xmin"))
    e = e.withColumn("utt", F.floor(F.col("xmin") / 86400).cast("long"))
    nxt = F.lead("xmin").over(Window.partitionBy("user_id", "utt").orderBy("xmin", "event_id"))
    length = F.greatest(F.lit(1.0), F.least(F.lit(3600.0), F.coalesce((nxt - F.col("xmin")) * 0.75, F.lit(60.0))))
    return e.withColumn("xmax", F.col("xmin") + length)


V = """v0 AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS xmin FROM events),
v1 AS (SELECT *, CAST(floor(xmin / 86400) AS BIGINT) AS utt FROM v0),
v AS (SELECT *, xmin + greatest(1.0, least(3600.0, coalesce((lead(xmin) OVER (PARTITION BY user_id, utt ORDER BY xmin, event_id) - xmin) * 0.75, 60.0))) AS xmax FROM v1)"""


def avg_rank_sql(rows: str, value: str, keys: str) -> str:
    """Rows with average rank ``r`` of a value per key."""
    part = f"PARTITION BY {keys}" if keys else ""
    tie = f"PARTITION BY {keys}, {value}" if keys else f"PARTITION BY {value}"
    return f"(SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0 AS r FROM {rows})"


def spearman_sql(rows: str, x: str, y: str, keys: str, least: int, rho: str = "round(rho, 6) AS rho") -> str:
    """keys, n, rho of a relation."""
    part = f"PARTITION BY {keys}" if keys else ""
    comma = f"{keys}, " if keys else ""
    tie = lambda c: f"PARTITION BY {comma}{c}"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {comma}n, {rho} FROM (
      SELECT {comma}count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM (
        SELECT {comma}rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({tie(x)}) - 1) / 2.0 AS rx, rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({tie(y)}) - 1) / 2.0 AS ry
        FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {group}) WHERE n >= {least}"""


def kw_sql(rows: str, group: str, keys: str, least: int) -> str:
    k = f"{keys}, " if keys else ""
    return f"""kw0 AS (SELECT * FROM {rows} WHERE value IS NOT NULL QUALIFY count(*) OVER (PARTITION BY {k}{group}) >= {least}),
kw1 AS {avg_rank_sql('kw0', 'value', keys)},
kt AS (SELECT {k}sum(t * t * t - t) AS ties FROM (SELECT {k}value, CAST(count(*) AS DOUBLE) AS t FROM kw0 GROUP BY {k}value) GROUP BY {keys}),
kg AS (SELECT {k}{group}, sum(r) AS s, CAST(count(*) AS DOUBLE) AS m FROM kw1 GROUP BY {k}{group}),
kq AS (SELECT {k}sum(m) AS n, count(*) AS k, sum(s * s / m) AS q FROM kg GROUP BY {keys} HAVING count(*) >= 2),
kw AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM kq JOIN kt USING ({keys}))"""
