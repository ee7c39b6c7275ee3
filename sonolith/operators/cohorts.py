"""Manifests and entities: selection, labels, joins, roll-ups, matching."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LEVELS, present, severity_ordinal
from ..sources.shared import written
from .slices import numbered


def select_utterances(df: DataFrame, rules: DataFrame, severity: str = "severity", content: str = "content_type", text: str = "text", min_chars: int = 3) -> DataFrame:
    """Rows that their dataset's rule admits: ``severities`` and ``contents`` are allow-lists (null: all), the trimmed text has ``min_chars``."""
    joined = df.join(rules.select("dataset", "severities", "contents"), "dataset")
    allowed = lambda names, c: F.col(names).isNull() | F.array_contains(names, F.col(c))
    return joined.where(allowed("severities", severity) & allowed("contents", content) & (F.length(F.trim(F.col(text))) >= min_chars)).drop("severities", "contents")


def label_by_pattern(df: DataFrame, rules: list[tuple[str, str, str]], name: str, text: str, content: str | None = None, only: str | None = None) -> DataFrame:
    """Of the rows whose ``content`` is ``only`` in any case (all, without these two), ``df`` with ``label`` of the first rule (mode, pattern, label) that fits; modes: contains, startswith (of the name), text (equal, case ignored). Rows without one drop out."""
    label = F.when(F.lit(False), "")
    for mode, pattern, value in rules:
        fits = F.lower(F.trim(F.col(text))) == pattern.lower() if mode == "text" else F.lower(F.col(name)).startswith(pattern.lower()) if mode == "startswith" else F.lower(F.col(name)).contains(pattern.lower())
        label = label.when(fits, value)
    chosen = df.where(F.lower(F.col(content)) == only.lower()) if content and only else df
    return chosen.withColumn("label", label).where("label IS NOT NULL")


def dedupe_stem(df: DataFrame, entity: list[str], stem: str, order: list[str]) -> DataFrame:
    """A stem that an entity has already used gets ``_<number>`` from its second use on."""
    nth = F.row_number().over(Window.partitionBy(*entity, stem).orderBy(*order))
    return df.withColumn("unique_stem", F.when(nth == 1, F.col(stem)).otherwise(F.concat_ws("_", F.col(stem), nth.cast("string"))))


def attach_inventory(df: DataFrame, inventory: DataFrame, on: tuple[str, ...] = ("dataset", "speaker_id")) -> DataFrame:
    """Only the columns that ``df`` lacks; all rows of ``df`` stay."""
    return df.join(inventory.select(*on, *[c for c in inventory.columns if c not in df.columns]), list(on), "left")


def fill_scores(manifest: DataFrame, scores: DataFrame, value: str = "intelligibility", on: str = "speaker_id") -> DataFrame:
    """The side table's score where the manifest has none."""
    side = scores.select(on, F.col(value).alias("__side"))
    return manifest.join(side, on, "left").withColumn(value, F.coalesce(F.col(value), "__side")).drop("__side")


def alignment_coverage(inputs: DataFrame, outputs: DataFrame, by: str = "dataset", key: str = "stem", least_pct: float = 80.0) -> DataFrame:
    """Per dataset: inputs, those with an output, the rest, per cent, and whether that is under ``least_pct``."""
    done = outputs.select(by, key).distinct().withColumn("__done", F.lit(1))
    rows = inputs.select(by, key).distinct().join(done, [by, key], "left")
    out = rows.groupBy(by).agg(F.count("*").alias("total"), F.count("__done").alias("aligned"))
    pct = F.col("aligned") * 100.0 / F.col("total")
    return out.withColumn("failed", F.col("total") - F.col("aligned")).withColumn("pct", pct).withColumn("flagged", pct < least_pct)


def unaligned(inputs: DataFrame, outputs: DataFrame, by: str = "dataset", key: str = "stem") -> DataFrame:
    """Keys without output."""
    return inputs.select(by, key).distinct().join(outputs, [by, key], "left_anti")


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys of both, keys of the first only)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.intersect(y), x.exceptAll(y)


def common_entities(df: DataFrame, variant: str, entity: list[str]) -> DataFrame:
    """Entities that two variants share, per pair: ``m1, m2`` and the entity."""
    keys = df.select(*entity, variant).distinct()
    return keys.withColumnRenamed(variant, "m1").join(keys.withColumnRenamed(variant, "m2"), entity).where("m1 < m2")


def tolerance_match(df: DataFrame, level: str, size: str, ident: str, bucket: Column) -> DataFrame:
    """1:1 pairs of entities at adjacent levels with sizes of one bucket: ``lower, upper, bucket, id_low, id_high, n_low, n_high``.

    A bucket is a range of sizes whose ends differ by the tolerance (``size_bucket``); inside it any two sizes are
    within it. Both sides are numbered by a stable key and meet by number, which is a shuffle by (level, bucket) only.
    """
    rows = df.where(F.col(level).isNotNull() & (F.col(size) > 0)).withColumn("bucket", bucket)
    nth = F.row_number().over(Window.partitionBy(level, "bucket").orderBy(size, ident))
    rows = rows.withColumn("nth", nth).select(F.col(level).alias("lower"), "bucket", "nth", F.col(ident).alias("id"), F.col(size).alias("n"))
    high = rows.select((F.col("lower") - 1).alias("lower"), "bucket", "nth", F.col("id").alias("id_high"), F.col("n").alias("n_high"))
    return rows.select("lower", "bucket", "nth", F.col("id").alias("id_low"), F.col("n").alias("n_low")).join(high, ["lower", "bucket", "nth"]).select("lower", (F.col("lower") + 1).alias("upper"), "bucket", "id_low", "id_high", "n_low", "n_high")


def size_bucket(size: Column, ratio: float = 1.25) -> Column:
    return F.floor(F.ln(size.cast("double")) / F.ln(F.lit(ratio))).cast("int")


_SEGMENT = {"lower": pa.int64(), "size_low": pa.float64(), "from_low": pa.int64(), "size_high": pa.float64(), "from_high": pa.int64(), "n": pa.int64()}


def _merged(ratio: float):
    """Merge of the two levels' sizes in order: what waits on one side meets what comes on the other, the smallest first, as long as it is within the tolerance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, (deque(), deque())
        for b in batches:
            out = []
            for lower, size, *counts in zip(*(b.column(c).to_pylist() for c in ("lower", "__size", "low", "high")), strict=True):
                if lower != now:
                    now, waiting = lower, (deque(), deque())
                for side, n in zip(waiting, counts, strict=True):
                    while side and side[0][0] * ratio < size:
                        side.popleft()
                    if n:
                        side.append([size, 0, n])
                low, high = waiting
                while low and high:
                    n = min(low[0][2], high[0][2])
                    out.append((lower, low[0][0], low[0][1], high[0][0], high[0][1], n))
                    for side in waiting:
                        side[0][1] += n
                        side[0][2] -= n
                        if not side[0][2]:
                            side.popleft()
            columns = list(zip(*out, strict=True)) or [()] * len(_SEGMENT)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SEGMENT.values(), strict=True)], names=list(_SEGMENT))

    return run


def full_tolerance_match(df: DataFrame, level: str, size: str, ident: str, ratio: float = 1.25) -> DataFrame:
    """As many 1:1 pairs as there can be of entities at adjacent levels whose sizes differ by a factor of ``ratio`` at most: ``lower, upper, id_low, id_high, n_low, n_high``.

    Both sides in order of size and id are merged like two sorted sequences: whoever is too small for all that is left
    drops out, else the first of both sides make a pair. The merge runs over counts by size, so its steps are different
    sizes and not entities; its result says which places of one size pair with which of another, and entities, numbered
    inside their size, meet by that. Levels are whole numbers; entities without level or with a size of 0 or less drop out.
    """
    rows = df.where(F.col(level).isNotNull() & (F.col(size) > 0)).select(F.col(level).cast("long").alias("__level"), F.col(size).cast("double").alias("__size"), F.col(ident).alias("__id"), F.col(size).alias("__n"))
    placed = numbered(rows, ["__level", "__size"], "__id").drop("size")
    counts = placed.groupBy("__level", "__size").agg(F.count("*").alias("c"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("__level").alias("lower"), F.col("c").alias("low"), F.lit(0).cast("long").alias("high")), F.struct((F.col("__level") - 1).alias("lower"), F.lit(0).cast("long").alias("low"), F.col("c").alias("high")))).alias("s"), "__size").select("s.*", "__size")
    both = sides.groupBy("lower", "__size").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    kinds = ", ".join(f"{c} {'double' if t == pa.float64() else 'long'}" for c, t in _SEGMENT.items())
    segments = written(both.repartition("lower").sortWithinPartitions("lower", "__size").mapInArrow(_merged(ratio), kinds).withColumn("segment", F.monotonically_increasing_id()), "segments")

    def side(which: str, shift: int) -> DataFrame:
        """(``segment``, ``place`` in it, id and size) of the entities on one side."""
        own = segments.groupBy((F.col("lower") + shift).alias("__level"), F.col(f"size_{which}").alias("__size")).agg(F.collect_list(F.struct("segment", F.col(f"from_{which}").alias("first"), "n")).alias("__own"))
        mine = F.filter("__own", lambda s: (F.col("pos") >= s["first"]) & (F.col("pos") < s["first"] + s["n"]))
        met = placed.join(own, ["__level", "__size"]).withColumn("__s", F.get(mine, F.lit(0))).where("__s IS NOT NULL")
        return met.select(F.col("__s.segment").alias("segment"), (F.col("pos") - F.col("__s.first")).alias("place"), (F.col("__level") - shift).alias("lower"), F.col("__id").alias(f"id_{which}"), F.col("__n").alias(f"n_{which}"))

    return side("low", 0).join(side("high", 1).drop("lower"), ["segment", "place"]).select("lower", (F.col("lower") + 1).alias("upper"), "id_low", "id_high", "n_low", "n_high")


def common_at_budget(classified: DataFrame, entity: list[str], budget: int, min_features: int = 3) -> DataFrame:
    """Entities with ``budget`` tokens in both classes of at least ``min_features`` features. Needs no vectors."""
    per = classified.groupBy(*entity, "feature").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q")).where((F.col("p") >= budget) & (F.col("q") >= budget))
    return per.groupBy(*entity).agg(F.count("*").alias("n_features")).where(F.col("n_features") >= min_features)


def resolve_scope(datasets: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted datasets and the control datasets of their languages (``dataset, language, is_control``; language: English where missing)."""
    dim = datasets.withColumn("language", F.coalesce("language", F.lit("en")))
    mine = dim.where(F.col("dataset").isin(wanted))
    extra = dim.where("is_control").join(mine.select("language").distinct(), "language", "left_semi")
    return mine.unionByName(extra.select(*mine.columns)).distinct()


def attach_labels(df: DataFrame, labels: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    """The main table's labels on every variant's rows; entities without label keep null and drop out of statistics by it."""
    return df.drop(*columns).join(labels.select(*entity, *columns).dropDuplicates(entity), entity, "left")


def build_inventory(manifest: DataFrame, seq: Column, entity: list[str], kinds: list[str], most: int | None = None, within: str = "dataset") -> DataFrame:
    """One row per entity: first known severity and aetiology, sex and age of the first record, control if any record is, counts by content kind, first castable score.

    ``seq`` orders records; columns: severity, aetiology, sex, age, is_control, content_type, score. ``most`` keeps the
    first entities of each ``within`` by id.
    """
    rows = manifest.withColumn("__seq", seq)
    known = lambda c: F.when(present(F.col(c)).isNotNull() & (F.lower(F.col(c)) != "unknown"), F.col("__seq"))
    first = lambda c: F.min_by(c, known(c))
    score = F.col("score").try_cast("double")
    out = rows.groupBy(*entity).agg(
        F.coalesce(first("severity"), F.lit("unknown")).alias("severity_label"),
        F.coalesce(first("aetiology"), F.lit("unknown")).alias("aetiology"),
        F.min_by("sex", "__seq").alias("sex"),
        F.min_by("age", "__seq").alias("age"),
        F.coalesce(F.bool_or("is_control"), F.lit(False)).alias("is_control"),
        *[F.count_if(F.col("content_type") == k).alias(f"n_{k}") for k in kinds],
        F.count_if(~F.col("content_type").isin(kinds) | F.col("content_type").isNull()).alias("n_other"),
        F.min_by(score, F.when(score.isNotNull(), F.col("__seq"))).alias("score"),
    )
    label = F.when(F.col("is_control"), LEVELS[0]).otherwise(F.when(F.lower("severity_label") == "true", "dysarthric").otherwise(F.col("severity_label")))
    out = out.withColumn("severity_label", label).withColumn("severity_numeric", severity_ordinal(F.col("severity_label")))
    return cap(out, [within], entity, most) if most else out


def cap(df: DataFrame, within: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")


def order_by_levels(df: DataFrame, column: str, levels: list[str], *then: str) -> DataFrame:
    """Sorted by the given order of labels, others last."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, levels)), F.col(column)), F.lit(0))
    return df.orderBy(F.when(place == 0, len(levels) + 1).otherwise(place), *then)
