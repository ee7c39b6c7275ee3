"""From raw documents to token ids: toxicity, exact and near duplicates, benchmark decontamination, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return
the columns of ``docs``, whatever others there are beside ``doc_id`` and ``text``. Between stages the rows are written
as Parquet in the shared folder and read again. An empty table gives an empty table at every stage; texts of any length
are taken whole; a null text counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonolith.llm.common import staged, table
from sonolith.llm.decontam import drop_contaminated
from sonolith.llm.exact_dedup import drop_exact_duplicates
from sonolith.llm.simhash import drop_near_duplicates
from sonolith.llm.sp_viterbi import encode_documents
from sonolith.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from labelled documents of the input outside the held-out fold. Null and empty texts stay, rows that repeat go or stay together, and all rows stay where there is nothing to learn from."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null: the smallest; of rows that repeat id and text, one). Null and empty texts are equal."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (a Jaccard similarity of 0.8 or more of five-word shingles, candidates by SimHash, verified) the row with the smallest doc_id stays (null: the largest; of rows that repeat id and text, one). Texts without words are one group."""
    return drop_near_duplicates(docs, words_per_shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go. Texts without words stay, rows that repeat go or stay together, and all rows stay where the benchmark is empty."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from the ids, one row per input row. Null and empty texts have no ids."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: A kernel machine, connected components and a best-path search are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the ``documents`` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
