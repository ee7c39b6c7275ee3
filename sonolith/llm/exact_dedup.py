"""Exact duplicates by a tree merge of digest runs, in DataFrame operations only.

Every input partition is one run of (digest, best id, count) entries. Runs meet in rounds as in a k-nomial tree:
in round r the runs whose numbers agree after dropping r base-``fan_in`` digits are merged, each merge spread over
the digests, so that no task ever holds a whole run. Each level keeps, per digest, only the winning identifier and
the number of rows behind it. A digest stands for a text only together with its byte length and a second,
independent 64-bit hash: entries that disagree in these never merge, at any level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, drop_marked, staged

VERIFIED = ["text_sha256", "n_bytes", "check64"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, a row number for repeated rows, digest, verification fields, number of its run."""
    text = F.encode(F.col("text"), "utf-8")
    return documents_of(docs, id_col, text_col).select(
        "doc_id",
        F.sha2(text, 256).alias("text_sha256"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("check64"),
        F.monotonically_increasing_id().alias("row_no"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(entries: DataFrame, keep: str = "largest", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """The tree merge: (run, digest, ..., doc_id, row_no) to one entry per digest with ``keep_id``, ``keep_row`` and ``group_size``."""
    best = F.max if keep == "largest" else F.min
    # a null id loses against any other; of rows with the same id the first read stays
    order = F.struct(F.col("doc_id").isNotNull().alias("has") if keep == "largest" else F.col("doc_id").isNull().alias("has"), "doc_id", (-F.col("row_no") if keep == "largest" else F.col("row_no")).alias("row"))
    level = entries.select((F.col("run") % runs).alias("run"), *VERIFIED, order.alias("best"), F.lit(1).cast("long").alias("n"))
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = (
            level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *VERIFIED)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
    return level.select(*VERIFIED, F.col("best.doc_id").alias("keep_id"), F.abs("best.row").alias("keep_row"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null text counts as empty; empty texts form a group like any other. Of a
    group the ``largest`` (or ``smallest``) id stays; where rows repeat an id and its text, exactly one of them is
    ``kept``. A null id stays only if its group has no other. An empty table gives no rows. Other columns are not read.

    The digest table is written once; rows then meet their group's entry in a join that AQE splits where one text
    holds a large share of all rows (the entry side is unique per digest).
    """
    entries = staged(digests(docs, id_col, text_col), "digests")
    groups = merge_runs(entries, keep, runs, fan_in)
    return entries.join(groups, VERIFIED).select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever their names.

    Null texts are equal to empty ones. The rows that go are found by id and digest; where the same id and text occur
    in several rows, one of them stays. An empty table gives no rows.
    """
    per = exact_dedup(docs, id_col, text_col, keep).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    marked = staged(per.where("NOT stays OR n > 1").select(F.struct("doc_id", "text_sha256").alias("mark"), "stays"), "marked")
    digest = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"), 256)
    return drop_marked(docs, F.struct(F.col(id_col).alias("doc_id"), digest.alias("text_sha256")), marked)
