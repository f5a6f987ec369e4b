"""Table changes, exports and streams on small tables."""

from pyspark.sql import functions as F

from firmgraph.operators import tables
from firmgraph.sources import csv_export, registry
from firmgraph.streaming import queue


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_snapshots(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b"), (None, "x", "c")], "k int, p string, v string")
    new = spark.createDataFrame([(1, None, "n"), (3, "x", "n")], "k int, p string, v string")
    assert rows(tables.insert_absent(old, new, ["k", "p"])) == sorted([(1, None, "a"), (2, "x", "b"), (None, "x", "c"), (3, "x", "n")], key=str)
    assert rows(tables.replace_matching(old, new, ["k", "p"])) == sorted([(1, None, "n"), (2, "x", "b"), (None, "x", "c"), (3, "x", "n")], key=str)
    assert rows(tables.retract(old, F.col("k") > 1, ["v"])) == sorted([(1, None, "a"), (2, "x", None), (None, "x", "c")], key=str)
    assert rows(tables.broken_rules(old, "v", {"small": F.col("k") < 2})) == [("small", "b")]
    assert tables.missing_columns(old, {"k": "int", "v": "int", "z": "int"}) == ["v", "z"]
    assert rows(tables.repeated_keys(old.unionAll(old), ["k", "p"], "twice")) == [("twice", "2|x")]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\n'), (2, None)], "i int, s string")
    csv_export.export(df.orderBy("i"), {"No.": F.col("i"), "名": F.col("s")}, str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data.decode() == '﻿No.,名\r\n1,"a ""b"", c\n"\r\n2,\r\n'


def test_sources(spark):
    assert registry.usable_sources(["a", "b", "c"], {"a": True, "b": False}) == (["a"], {"b": "not configured", "c": "unknown"})
    names = spark.createDataFrame([(1, "株式会社ＡＢＣ", "大阪府大阪市"), (2, "他", None)], "id int, name string, address string")
    entries = spark.createDataFrame([(1, "ABC株式会社", "東京都港区", "t"), (2, "abc", "大阪府堺市", "o")], "ord int, name string, location string, num string")
    assert [(r["id"], r["entry"]["num"]) for r in registry.enrich_by_name(names, entries, "id").collect()] == [(1, "o")]


def test_streams(spark, tmp_path):
    events = [(1, "error", 1.0, "2024-01-01 00:00:00", 1), (1, "error", 1.0, "2024-01-01 01:00:00", 2), (1, "error", 1.0, "2024-01-02 00:00:00", 3), (2, "error", 1.0, "2024-01-01 00:00:00", 4), (2, "purchase", 2.0, "2024-01-03 00:00:00", 5)]
    df = spark.createDataFrame(events, "user_id long, event_type string, value double, t string, event_id long").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    for i, part in enumerate((df.filter("event_id < 3 OR event_id = 4"), df.filter("event_id IN (3, 5)"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    states = queue.run_to_table(queue.job_states(stream), str(tmp_path / "states"), "update")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts", "handled"), "batch").alias("s")).select("user_id", "s.*")
    assert rows(last) == [(1, "failed", 3, 3), (2, "completed", 0, 2)]
    counts = queue.run_to_table(queue.windowed_counts(stream), str(tmp_path / "counts"), "append")
    # the watermark, an hour before the purchase, has passed the first day only
    assert [(str(r["start"]), r["event_type"], r["n"], r["total"]) for r in counts.collect()] == [("2024-01-01 00:00:00", "error", 3, 3.0)]
