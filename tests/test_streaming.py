"""Arrival in any order: late originals, repeats across batches, dead letters, cascades."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ledgerlight.streaming import ingest

SCHEMA = "key int, at timestamp, value double"


def put(spark, folder, rows):
    data = spark.createDataFrame(rows, "key int, at string, value double").withColumn("at", F.to_timestamp("at"))
    data.coalesce(1).write.mode("append").parquet(folder)


def test_late_originals_stay_and_repeats_go(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    come = lambda: ingest.append_new(spark.readStream.schema(SCHEMA).parquet(f"{top}/in"), ["key", "at"], F.to_date("at"), f"{top}/out", F.when(F.col("value").isNull(), "missing_data: value"))
    put(spark, f"{top}/in", [(1, "2024-01-10", 1.0), (1, "2024-01-10", 1.0)])
    come()
    put(spark, f"{top}/in", [(2, "2024-01-01", 2.0), (1, "2024-01-10", 1.0), (9, "2024-01-03", None)])
    come()
    put(spark, f"{top}/in", [(3, "2024-01-11", 3.0), (2, "2024-01-01", 2.0), (9, "2024-01-03", None)])
    got = come()
    assert sorted(r.key for r in got.collect()) == [1, 2, 3]
    dead = spark.read.parquet(f"{top}/out-dead").collect()
    assert [(r.key, r.reason) for r in dead] == [(9, "missing_data: value")]


def test_null_keys_and_days_are_stored_once(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    come = lambda: ingest.append_new(spark.readStream.schema(SCHEMA).parquet(f"{top}/in"), ["key", "at"], F.to_date("at"), f"{top}/out")
    for _ in range(2):
        put(spark, f"{top}/in", [(None, "2024-01-10", 1.0), (1, None, 2.0), (None, None, 3.0), (1, "2024-01-10", 4.0)] * 2)
        got = come()
    assert sorted((r.key or 0, str(r.at)) for r in got.collect()) == [(0, "2024-01-10 00:00:00"), (0, "None"), (1, "2024-01-10 00:00:00"), (1, "None")]


def test_cascade_of_a_stream(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    coverage = spark.createDataFrame([(i, b, "ready", None) for i in (1, 2) for b in ("prices", "industry_metrics")], "id int, block string, status string, reason string")
    spark.createDataFrame([(1, "prices")], "id int, block string").write.parquet(f"{top}/in")
    got = ingest.cascade_stream(spark.readStream.schema("id int, block string").parquet(f"{top}/in"), coverage, f"{top}/out")
    assert sorted((r.id, r.status) for r in got.where("block = 'industry_metrics'").collect()) == [(1, "stale"), (2, "ready")]
