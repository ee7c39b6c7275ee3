"""Scans and sinks: manifests, score sheets, entity tables, aligned intervals, contrast configurations, token stores, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import null_if_missing, number

MANIFEST = (
    "speaker_id string, audio_filepath string, text string, duration double, severity string, aetiology string, sex string, gender string, age string, "
    "is_dysarthric boolean, content_type string, intelligibility_pct double, intelligibility double, clinical_score string, updrs_speech string, grbas_g string, _corrupt string"
)
SILENCES = ("", "sil", "sp", "spn")  # fixed values: labels of what is not speech
#: Other spellings of a configuration's keys and features.
KEY_ALIASES = {"consonants": "consonant_features", "vowels": "vowel_features"}
FEATURE_ALIASES = {"nasality": "nasal"}
SYMBOL_LISTS = {"consonant": "all_consonants", "vowel": "all_vowels"}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def in_file_order() -> tuple[Column, Column, Column]:
    """Columns that order rows as the files have them; take them right after the scan."""
    return F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_id")


def read_manifest(spark: SparkSession, root: str, dataset: str, file: str = "manifest.jsonl") -> DataFrame:
    """One row per good line, with ``dataset`` and the file order. Blank and broken lines are skipped; the folder is also found with ``_`` and ``-`` exchanged."""
    names = [dataset, dataset.replace("_", "-"), dataset.replace("-", "_")]
    folder = next((n for n in names if _exists(spark, f"{root}/{n}/{file}")), dataset)
    raw = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/{folder}/{file}")
    return raw.select("*", *in_file_order()).where("_corrupt IS NULL").drop("_corrupt").withColumn("dataset", F.lit(dataset))


def read_scores_tsv(spark: SparkSession, paths: list[str], value: str = "intelligibility") -> DataFrame:
    """(speaker_id, value): the last parsable score of each speaker over all files."""
    raw = spark.read.schema(f"speaker_id string, {value} string").option("sep", "\t").option("header", True).csv(paths)
    rows = raw.select("speaker_id", number(F.col(value)).alias(value), F.struct(*in_file_order()).alias("seq")).where(F.col(value).isNotNull() & F.col("speaker_id").isNotNull())
    return rows.groupBy("speaker_id").agg(F.max_by(value, "seq").alias(value))


def read_entities(spark: SparkSession, path: str, numbers: list[str], texts: list[str], levels: list[str] = (), booleans: list[str] = ()) -> DataFrame:
    """A CSV of entities, columns by header, every spelling of a missing value null; booleans are the word ``true`` in any case."""
    raw = spark.read.option("header", True).csv(path)
    have = lambda names: [c for c in names if c in raw.columns]
    clean = null_if_missing(raw, have(numbers), have(texts), have(levels))
    return clean.withColumns({c: F.lower(F.trim(F.col(c))) == "true" for c in have(booleans)}) if have(booleans) else clean


def write_packed(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Whole files (``path``, ``value``) as JSON lines, one line a file: for more files than a driver can list. ``append`` packs a tree one folder after the other."""
    files.select("path", "value").write.mode(mode).json(path)


def read_phone_intervals(spark: SparkSession, paths: str | list[str], keep_silences: bool = False, packed: bool = False) -> DataFrame:
    """Intervals of the ``phones`` tier of TextGrid files: ``dataset, speaker_id, utterance, phone_idx, xmin, xmax, text``.

    Distributed over files, without UDF; dataset and speaker are the two folders above a file, the utterance is its
    stem. A file without that tier, or with an empty one, gives no rows. The driver lists the files; ``packed`` ones,
    written by :func:`write_packed`, are rows, of which it lists none.
    """
    if packed:
        raw = spark.read.schema("path string, value string").json(paths).select("value", F.split("path", "/").alias("p"))
    else:
        raw = spark.read.text(paths, wholetext=True).select("value", F.split("_metadata.file_path", "/").alias("p"))
    return phone_intervals(raw.select(F.element_at("p", -3).alias("dataset"), F.element_at("p", -2).alias("speaker_id"), F.regexp_replace(F.element_at("p", -1), r"\.[^.]*$", "").alias("utterance"), "value"), keep_silences)


def phone_intervals(files: DataFrame, keep_silences: bool = False) -> DataFrame:
    """The same from a table (or stream) of whole files in ``value``; all other columns are kept."""
    keys = [c for c in files.columns if c != "value"]
    tier = F.split_part(F.split_part("value", F.lit('name = "phones"'), F.lit(2)), F.lit("item ["), F.lit(1))
    body = F.regexp_replace(tier, r"(?s)^.*?intervals: size = \d+", "")
    find = lambda p: F.regexp_extract_all("body", F.lit(p), F.lit(1))
    rows = files.select(*keys, body.alias("body")).select(*keys, F.posexplode(F.arrays_zip(find(r"xmin = ([-0-9.eE+]+)").alias("a"), find(r"xmax = ([-0-9.eE+]+)").alias("b"), find(r'text = "((?:[^"]|"")*)"').alias("c"))).alias("phone_idx", "x"))
    out = rows.select(*keys, "phone_idx", F.col("x.a").try_cast("double").alias("xmin"), F.col("x.b").try_cast("double").alias("xmax"), F.trim(F.replace(F.col("x.c"), F.lit('""'), F.lit('"'))).alias("text"))
    return out if keep_silences else out.where(~F.lower("text").isin(*SILENCES))


def _configurations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value`` (a whole JSON file) and ``language``, the last part of its name."""
    return spark.read.text(paths, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"([^_/.]+)\.json$", 1).alias("language"))


def read_symbol_kinds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``language, phone, is_consonant, is_vowel`` from the same files' lists of symbols; where a file has no list, the members of that kind's features."""
    raw, (contrasts, _) = _configurations(spark, paths), read_contrasts(spark, paths)
    listed = []
    for kind, key in SYMBOL_LISTS.items():
        symbols = F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>")
        listed.append(raw.where(symbols.isNotNull()).select("language", F.lit(kind).alias("kind"), F.explode(symbols).alias("phone")))
    given = listed[0].unionByName(listed[1])
    implied = contrasts.select("language", "kind", "phone").distinct().join(given.select("language", "kind").distinct(), ["language", "kind"], "left_anti")
    every = given.unionByName(implied.select("language", "kind", "phone"))
    return every.groupBy("language", "phone").agg(*[F.bool_or(F.col("kind") == kind).alias(f"is_{kind}") for kind in SYMBOL_LISTS])


def read_contrasts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(contrasts, rejected): ``language, feature, kind, phone, class`` from nested JSON files named ``..._<language>.json``.

    Both spellings of keys and features are read; a symbol of both classes is positive; symbols with U+FFFD are not
    matched but listed in ``rejected``. Vowel features are called ``vowel_<feature>``.
    """
    raw = _configurations(spark, paths)
    kinds = {"consonant": ["consonant_features"], "vowel": ["vowel_features"]}
    for alias, key in KEY_ALIASES.items():
        kinds["vowel" if "vowel" in key else "consonant"].append(alias)
    parts = []
    for kind, keys in kinds.items():
        parsed = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), "map<string,struct<positive:array<string>,negative:array<string>>>") for k in keys])
        one = raw.select("language", F.explode(parsed).alias("feature", "x")).withColumn("kind", F.lit(kind))
        for cls in ("positive", "negative"):
            parts.append(one.select("language", "feature", "kind", F.explode(f"x.{cls}").alias("phone"), F.lit(cls).alias("class")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    name = F.col("feature")
    for alias, feature in FEATURE_ALIASES.items():
        name = F.when(F.col("feature") == alias, feature).otherwise(name)
    every = every.withColumn("feature", F.when(F.col("kind") == "vowel", F.concat(F.lit("vowel_"), name)).otherwise(name))
    damaged = F.col("phone").contains("�")
    good = every.where(~damaged).groupBy("language", "feature", "kind", "phone").agg(F.max("class").alias("class"))
    return good, every.where(damaged)


def write_tokens(tokens: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").partitionBy("language", "dataset").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_partition(df: DataFrame, path: str, key: str = "dataset") -> None:
    """Replaces the partitions of the keys in ``df``, keeps the others; columns may be added (readers merge schemas)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Result rows as JSON lines or CSV with header."""
    writer = df.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)

