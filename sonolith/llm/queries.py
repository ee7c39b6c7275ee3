"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import class_model_scores
from .burst_trie import conversation_trie
from .common import table
from .compression import quality_report
from .decontam import contamination_report
from .exact_dedup import exact_dedup
from .oracles import SQL as SQL
from .pii import personal_data_report
from .repair import read_ids, write_ids
from .sentence_spans import removal_report
from .simhash import near_duplicates
from .sp_viterbi import encoding_report
from .tool_calls import link_tool_calls, turns_as_calls
from .toxicity import toxicity_scores
from .turn_repair import repair_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(table(spark, sf_dir, "documents"))


@query
def op2_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), digest_only=True)


@query
def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "call_id", "seq", "level", "name", "status", F.concat_ws("; ", "errors").alias("errors"), "record")


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@query
def op5_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=4, most_bits=4)


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query
def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"), plain_scan=True)


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(table(spark, sf_dir, "documents"))


@query
def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
