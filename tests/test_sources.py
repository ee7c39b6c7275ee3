"""Scans of hand-written files."""

import duckdb
from pyspark.sql import functions as F

from sonolith import plans
from sonolith.sources import tables as src


def test_manifest(spark, tmp_path):
    (tmp_path / "my-set").mkdir()
    (tmp_path / "my-set" / "manifest.jsonl").write_text('{"speaker_id": "a", "severity": null}\n\n{"speaker_id": "a", "severity": "mild", "x": 1}\n{broken\n{"speaker_id": "b"}\n')
    rows = src.read_manifest(spark, str(tmp_path), "my_set").select("speaker_id", "severity", "dataset").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("a", None, "my_set"), ("a", "mild", "my_set"), ("b", None, "my_set")]))


GRID = """File type = "ooTextFile"
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 1
            text = "hello"
    item [2]:
        class = "IntervalTier"
        name = "phones"
        intervals: size = 4
        intervals [1]:
            xmin = 0
            xmax = 0.25
            text = "sil"
        intervals [2]:
            xmin = 0.25
            xmax = 0.5
            text = "HH"
        intervals [3]:
            xmin = 0.5
            xmax = 0.5
            text = ""
        intervals [4]:
            xmin = 0.5
            xmax = 1
            text = "a""b"
    item [3]:
        class = "IntervalTier"
        name = "notes"
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 1
            text = "no"
"""


def test_phone_intervals(spark, tmp_path):
    for speaker, text in (("s1", GRID), ("s2", GRID.split("    item [2]")[0]), ("s3", GRID.split("        intervals: size = 4")[0] + "        intervals: size = 0\n")):
        (tmp_path / "d" / speaker).mkdir(parents=True)
        (tmp_path / "d" / speaker / "u 1.TextGrid").write_text(text)
    rows = src.read_phone_intervals(spark, f"{tmp_path}/d/*/*.TextGrid").orderBy("xmin").collect()
    assert [(r["dataset"], r["speaker_id"], r["xmin"], r["xmax"], r["text"]) for r in rows] == [("d", "s1", 0.25, 0.5, "HH"), ("d", "s1", 0.5, 1.0, 'a"b')]
    assert src.read_phone_intervals(spark, f"{tmp_path}/d/*/*.TextGrid", keep_silences=True).count() == 4


def test_packed_phone_intervals(spark, tmp_path):
    """The same rows from packed files, whatever their texts hold, and a tree packed in two steps."""
    odd = GRID.replace('a""b', 'a""\u2028b\\n\x1e').replace("HH", "ʃ\t")
    for speaker, text in (("s1", GRID), ("s2", odd), ("s3", "")):
        (tmp_path / "d" / speaker).mkdir(parents=True)
        (tmp_path / "d" / speaker / "u 1.TextGrid").write_text(text, encoding="utf-8")
    for mode, speakers in (("overwrite", "s1"), ("append", "s[23]")):
        src.write_packed(spark.read.text(f"{tmp_path}/d/{speakers}/*.TextGrid", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), f"{tmp_path}/packed", mode)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(src.read_phone_intervals(spark, f"{tmp_path}/packed", packed=True))
    assert len(got) == 4 and got == rows(src.read_phone_intervals(spark, f"{tmp_path}/d/*/*.TextGrid"))


def test_grids_are_not_a_file_each(spark, sf):
    """As many files as users are more than a driver can list."""
    assert len(plans.QUERIES["o04_read_phone_intervals"](spark, sf).inputFiles()) <= 8 < spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()


def test_grids_keep_all_digits(spark, tmp_path, same):
    """Durations just under half a millisecond, which times cut to microseconds would lift over it."""
    path = f"{tmp_path}/events.parquet"
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id").bitwiseAND(-2) * 7_000_001 + (F.col("id") % 2) * 2_667_333)
    spark.range(400).select(F.col("id").alias("event_id"), at.alias("ts"), F.floor(F.col("id") / 2).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(path)
    with duckdb.connect() as con:
        con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        same(plans.QUERIES["o04_read_phone_intervals"](spark, str(tmp_path)), con, plans.SQL["o04_read_phone_intervals"])


def test_contrasts(spark, tmp_path):
    (tmp_path / "features_hu.json").write_text('{"consonants": {"nasality": {"positive": ["m", "n"], "negative": ["b", "m", "�"]}}, "vowel_features": {"height": {"positive": ["i"], "negative": ["a"]}}}', encoding="utf-8")
    good, bad = src.read_contrasts(spark, str(tmp_path / "*.json"))
    assert {tuple(r) for r in good.select("language", "feature", "phone", "class").collect()} == {("hu", "nasal", "m", "positive"), ("hu", "nasal", "n", "positive"), ("hu", "nasal", "b", "negative"), ("hu", "vowel_height", "i", "positive"), ("hu", "vowel_height", "a", "negative")}
    assert bad.count() == 1


def test_entities_and_scores(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,score,level,control\na,,1,True\nb,nan,-1,false\nc,x,2,\nd,1.5,nan,TRUE\n")
    rows = src.read_entities(spark, str(tmp_path / "e.csv"), ["score"], ["id"], ["level"], ["control"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", None, 1, True), ("b", None, None, False), ("c", None, 2, None), ("d", 1.5, None, True)]
    (tmp_path / "s.tsv").write_text("speaker_id\tintelligibility\na\t1\na\tbad\na\t3\nb\tbad\n")
    assert [tuple(r) for r in src.read_scores_tsv(spark, [str(tmp_path / "s.tsv")]).collect()] == [("a", 3.0)]


def test_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    src.upsert_partition(spark.createDataFrame([("x", 1), ("y", 2)], "dataset string, v int"), p)
    src.upsert_partition(spark.createDataFrame([("y", 3, "n")], "dataset string, v int, w string"), p)
    assert {tuple(r) for r in src.read_upserted(spark, p).select("dataset", "v", "w").collect()} == {("x", 1, None), ("y", 3, "n")}


def test_results_as_csv_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 1.5, None), ('say "x"', -2.0, 3)], "name string, value double, n int")
    src.write_result(rows, f"{tmp_path}/csv", "csv")
    src.write_result(rows, f"{tmp_path}/csv", "csv")  # replaces what is there
    assert sorted(map(tuple, spark.read.schema(rows.schema).option("header", True).option("escape", "\\").csv(f"{tmp_path}/csv").collect())) == sorted(map(tuple, rows.collect()))
    src.write_result(rows, f"{tmp_path}/json")
    assert sorted((r["name"], r["value"], r["n"]) for r in spark.read.schema(rows.schema).json(f"{tmp_path}/json").collect()) == sorted(map(tuple, rows.collect()))


def test_later_score_wins_whatever_its_size(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("speaker_id\tintelligibility\na\t9\nb\t1\na\t7\n")
    (tmp_path / "2.tsv").write_text("speaker_id\tintelligibility\nb\tbad\na\t2.5\n")
    got = {r[0]: r[1] for r in src.read_scores_tsv(spark, [str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")]).collect()}
    assert got == {"a": 2.5, "b": 1.0}
