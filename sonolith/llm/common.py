"""What several of these operators share: inputs, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, and every later reader sees the same rows even if executors are lost meanwhile."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_SHARE = 1000


def join_spread(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``unique`` (one row per key, none of them null), where some keys may hold a large share of the rows.

    ``weight``: a column of ``unique``, the number of rows behind the key. Keys with over a thousandth of all rows are
    under ``HOT_SHARE`` in number whatever the data, so they are broadcast and their rows stay where they are; all
    others meet in a shuffled join. ``unique`` is read several times: write it before.
    """
    total = unique.agg(F.sum(weight)).first()[0] or 0
    hot = unique.where(F.col(weight) > total // HOT_SHARE)
    cold = unique.where(F.col(weight) <= total // HOT_SHARE).drop(weight)
    near = rows.join(F.broadcast(hot.drop(weight)), keys)
    return near.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


FILTER_BITS = 26


def split_by_filter(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` is surely not a key of ``wanted``, and the others (a few too many), which then meet ``wanted`` in a shuffle.

    The filter has one bit for each of 2^26 hashes, in at most 2^20 words of 64 bits, so it is broadcast at any size.
    With many more keys than bits it lets every row through, and the shuffle decides alone.
    """
    place = lambda: F.xxhash64(key).bitwiseAND((1 << FILTER_BITS) - 1)
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__place").bitwiseAND(63).cast("int"))
    word = F.shiftright("__place", 6).alias("__word")
    words = staged(wanted.select(place().alias("__place")).groupBy(word).agg(F.bit_or(bit()).alias("__bits")), "filter")
    seen = rows.withColumn("__place", place()).withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    hit = F.col("__bits").isNotNull() & (F.col("__bits").bitwiseAND(bit()) != 0)
    return seen.where(~hit).select(*rows.columns), seen.where(hit).select(*rows.columns)


def drop_marked(docs: DataFrame, mark: Column, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``mark`` is not in ``marked``, and one row for each mark that ``stays`` there.

    ``marked``: (``mark``, ``stays``), each mark once, a written table. Rows are carried as one column, so no name can
    clash. Rows that pass the filter of marks stay where they are; only those that it holds back, which are the marked
    ones and few others, are shuffled.
    """
    quoted = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    plain = docs.select(mark.alias("mark"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(quoted)]).alias("row"))
    clear, held = split_by_filter(plain, "mark", marked)
    met = held.join(marked.hint("merge"), held["mark"].eqNullSafe(marked["mark"]), "left").select(held["mark"], "row", "stays")
    nth = F.row_number().over(Window.partitionBy("mark").orderBy(F.xxhash64(*[F.col(f"row.c{i}").cast("string") for i in range(len(docs.columns))])))
    kept = met.withColumn("nth", nth).where("stays IS NULL OR (stays AND nth = 1)").select("row")
    return clear.select("row").unionByName(kept).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


_kept: dict = {}


def kept_by_worker(key: tuple, make):
    """What a Python worker keeps from one task to the next: one thing at a time, so that what operators remember, one after the other, does not add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text (null: empty) alone, so that no other column's name can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def training_fold(id_column: Column, folds: int) -> Column:
    """Unsigned crc32 of the id written as text, modulo ``folds``; 0 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
