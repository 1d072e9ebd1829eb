"""Polls and failures of some tasks against a table made by hand."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlight.streaming import cadence

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, old)


def test_retries_dead_letters_and_polls(rocks):
    spark, top = rocks, tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def come(*rows):
        data = spark.createDataFrame(rows, "id string, at string, outcome string, error string").withColumn("at", F.to_timestamp("at"))
        data.coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema("id string, at timestamp, outcome string, error string").parquet(f"{top}/in")
        cadence.decisions(stream).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, str(r["at"]), r.action, r.attempts, r.reason) for r in spark.read.parquet(f"{top}/out").collect())

    day = "2024-01-01 00:00:"
    come(("a", day + "00", "error", "E2"), ("b", day + "00", "ok", None), ("c", day + "00", "error", "E4"))
    come(("a", day + "02", "error", "E2"), ("z", day + "30", "ok", None))
    got = come(("a", day + "40", "error", "E2"), ("a", day + "41", "error", "E2"), ("z", "2024-01-20 00:00:00", "ok", None))
    want = [
        ("a", day + "00", "wait", 1, "fetch_transient: 1 s"), ("a", day + "02", "wait", 2, "fetch_transient: 4 s"), ("a", day + "40", "wait", 3, "fetch_transient: 15 s"), ("a", day + "41", "dead", 4, "E3: fetch_failed"),
        ("b", day + "00", "done", 1, None), ("c", day + "00", "dead", 1, "E4: parse_failed"), ("z", day + "30", "done", 1, None), ("z", "2024-01-20 00:00:00", "done", 1, None),
    ]
    told = [x for x in got if x[2] in ("wait", "done", "dead")]
    assert told == sorted(want, key=lambda x: (x[0], x[1]))
    woken = {(x[0], x[1], x[2], x[3]) for x in got if x[2] in ("retry", "due")}
    # the wait of 4 seconds ran out; ten days after the first success b and z fell due
    assert ("a", day + "06", "retry", 2) in woken and ("b", "2024-01-11 00:00:00", "due", 0) in woken
