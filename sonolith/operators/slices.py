"""Order statistics of any number of values per key: rows written in order, in slices that follow the amount of data.

Rows are dealt out by ranges of (key, value) and written once, so a slice is one file: its size is that of a shuffle
partition whatever the number of rows, small tables have one, and no lost executor can change where a slice ends. A
slice knows its rows and, by a running sum over the few slices of its key, the rows before it. A rank is that number
plus a count inside the slice; a quantile needs only the slice that holds its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by the keys in which a null key equals itself; without keys the right side is a single row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]), how).drop(*[f"__right_{k}" for k in keys])


def sliced(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` written in the order of (``by``, ``order``), with ``__slice``, the name of the file that holds a row."""
    path = scratch(rows.sparkSession, "slices")
    rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).withColumn("__slice", F.col("_metadata.file_name"))


def slice_totals(dealt: DataFrame, by: list[str], first: str, n: str | None = None) -> DataFrame:
    """(``by``, ``__slice``, ``__sum``, ``__before``, ``__total``): rows (or the sum of ``n``) of each key's slices, of those before them and of the whole key. ``first``: the column that orders the slices."""
    totals = dealt.groupBy(*by, "__slice").agg((F.sum(n) if n else F.count("*")).alias("__sum"), F.min(F.struct(F.col(first))).alias("__first"))
    key = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__sum").over(key.orderBy("__first", "__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select(*by, "__slice", "__sum", before.alias("__before"), F.sum("__sum").over(key).alias("__total"))


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with ``pos`` from 0 in the order of a stable id and ``size``, the rows of the key."""
    dealt = sliced(rows, by, [order])
    placed = matched(dealt, slice_totals(dealt, by, order), [*by, "__slice"])
    inside = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(order)) - 1
    return placed.withColumn("pos", F.col("__before") + inside).withColumnRenamed("__total", "size").drop("__slice", "__sum", "__before")


def quantiles(rows: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """``by`` and a column per wanted quantile, exact and linear between neighbouring values; nulls and NaN do not count. Keys without a value are left out.

    Of all values only those of the slices that hold a wanted place are read again; values are counted before that.
    """
    v = F.col(value).cast("double")
    counted = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
    dealt = sliced(counted, by, ["__v"])
    totals = slice_totals(dealt, by, "__v", "__n")
    asks = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("__total") - 1)
        share = at - F.floor(at)
        asks += [F.struct(F.lit(name).alias("name"), (F.floor(at) + k).alias("place"), w.alias("weight")) for k, w in ((0, 1 - share), (1, share))]
    held = lambda low, up: (lambda a: (a["weight"] > 0) & (a["place"] >= low) & (a["place"] < up))
    needed = totals.select(*by, "__slice", "__before", F.filter(F.array(*asks), held(F.col("__before"), F.col("__before") + F.col("__sum"))).alias("__asks")).where(F.size("__asks") > 0)
    near = matched(dealt, needed, [*by, "__slice"])
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    hits = near.withColumn("__upto", upto).withColumn("__ask", F.explode(F.filter("__asks", held(F.col("__upto") - F.col("__n"), F.col("__upto")))))
    return hits.groupBy(*by).agg(*[F.sum(F.when(F.col("__ask.name") == name, F.col("__ask.weight") * F.col("__v"))).alias(name) for name in wanted])
