"""Streams over the events in several micro-batches, against the same as one batch in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.scratch import saved, shared_dir
from ledgerlight.sinks.store import Store
from ledgerlight.streaming import maintain

from .model import dec, query, read
from .records import _BLOCKS, BLOCKS

#: Files of the stream's folder, and files that one micro-batch takes.
_FILES, _EACH = 8, 2


def _stream(rows: DataFrame) -> DataFrame:
    """rows as a stream of several micro-batches, dealt without regard to their time: late ones are in each."""
    kept = saved(rows.repartition(_FILES), "arrival")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", _EACH).parquet(kept.inputFiles()[0].rpartition("/")[0])


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:12]}")


@query("""WITH f AS (SELECT user_id AS issuer, CAST(value AS DECIMAL(12,2)) AS v, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id) > 1 AS gone FROM events)
SELECT issuer, count(*) AS n, count(*) FILTER (gone) AS n_superseded, CAST(sum(v) FILTER (NOT gone) AS DOUBLE) AS total FROM f GROUP BY issuer""")
def cursor_incremental_stream(spark, d):
    """Facts of each user, and sums of those that no later one of their day supersedes, kept up to date batch by batch: only the
    touched users are worked out again."""
    e = read(spark, d, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("issuer"), F.col("event_type").alias("concept"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("filed"), dec("value").alias("value"))
    store = _store(spark)
    maintain.follow(_stream(e), store, ["issuer"], ["issuer", "concept", "day"], [F.desc("filed"), F.col("fact_id")], lambda f: maintain.newest_of(f, ["issuer"], "value"))
    return store.read("derived").select("issuer", "n", "n_superseded", F.col("total").cast("double").alias("total"))


@query(f"""WITH u AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') > 0 AS hit FROM events GROUP BY user_id)
SELECT id, block, CASE WHEN hit AND block IN ('industry_metrics', 'llm_summary') THEN 'stale' ELSE 'ready' END AS status,
CASE WHEN hit AND block IN ('industry_metrics', 'llm_summary') THEN 'cascade:after_' || CASE WHEN id % 2 = 0 THEN 'prices' ELSE 'governance' END END AS reason FROM u, {_BLOCKS}""")
def cascade_stale_stream(spark, d):
    """Coverage of every user after a stream of purchases has touched a block of theirs: dependent blocks turn stale."""
    e, store = read(spark, d, "events"), _store(spark)
    rows = e.select(F.col("user_id").alias("id")).distinct().select("id", F.explode(F.array(*map(F.lit, BLOCKS))).alias("block"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("reason"))
    store.commit({"coverage": (rows, ["id"])})
    touched = e.where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "prices").otherwise("governance").alias("block"))
    maintain.cascade(_stream(touched), store)
    return store.read("coverage")
