"""Incremental arrival into stored tables: each key once, however late it comes.

The source's offsets are the cursor; the checkpoint lies in the shared folder, so a lost driver or executor goes on from there.
A batch that runs again after a failure appends nothing twice, as its keys are stored by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ledgerlight.operators import versions
from ledgerlight.scratch import shared_dir


def stored(spark: SparkSession, schema, path: str) -> DataFrame:
    """A table of append(); empty before its first batch."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def drain(stream: DataFrame, step: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Run *step* on every micro-batch of all that is there, going on from the checkpoint."""
    query = stream.writeStream.foreachBatch(lambda batch, _: step(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_new(stream: DataFrame, key: list[str], day: Column, to: str, refuse: Column | None = None) -> DataFrame:
    """Append each key once to the table at *to*, cut by *day*, and return it. *day* is a function of the key.

    Late rows are no less new: a key is dropped only if it is stored, and only the partitions of the batch's days are read for that.
    Rows for which *refuse* gives a reason go to the dead letters beside the table, with the reason.
    """
    spark, schema = stream.sparkSession, StructType([*stream.schema.fields, StructField("day", DateType())])

    def step(batch: DataFrame) -> None:
        rows = batch.withColumn("day", day.cast("date"))
        if refuse is not None:
            rows = rows.withColumn("_why", refuse)
            bad = rows.where("_why is not null").withColumnRenamed("_why", "reason")
            known = stored(spark, bad.schema, f"{to}-dead")
            bad.dropDuplicates().join(known.select(*key), [bad[k].eqNullSafe(known[k]) for k in key], "left_anti").write.mode("append").parquet(f"{to}-dead")
            rows = rows.where("_why is null").drop("_why")
        once = rows.dropDuplicates(key)
        days = [r[0] for r in rows.select("day").distinct().collect()]
        here = F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() & F.lit(None in days))
        old = stored(spark, schema, to).where(here).select(*key).distinct()
        once.join(old, [once[k].eqNullSafe(old[k]) for k in key], "left_anti").write.mode("append").partitionBy("day").parquet(to)

    drain(stream, step, f"{to}-checkpoint")
    return stored(spark, schema, to)


def restated(facts: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The stored facts with superseded_by: late rows rank with all others of their key, none is overwritten."""
    from ledgerlight.operators.picks import supersede

    return supersede(facts, key, order)


def cascade_stream(touched: DataFrame, coverage: DataFrame, to: str) -> DataFrame:
    """coverage (id, block, status, reason) after all touched (id, block) of a stream; every batch publishes a whole new state.

    A state is written to a folder of its own, then named in the table `current`: readers see the old one or the new one.
    """
    spark = touched.sparkSession

    def now() -> DataFrame:
        names = stored(spark, "state string, at timestamp", f"{to}/current")
        last = names.orderBy(F.desc("at")).first()
        return coverage if last is None else spark.read.schema(coverage.schema).parquet(f"{to}/{last.state}")

    def step(batch: DataFrame) -> None:
        name = f"state-{uuid.uuid4().hex[:12]}"
        versions.cascade(now(), batch).write.parquet(f"{to}/{name}")
        spark.range(1).select(F.lit(name).alias("state"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{to}/current")

    drain(touched, step, f"{to}/checkpoint")
    return now()


def last_seen(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """(user_id, last_seen, n) of the distinct events that stream from the files of *folder* whose names match *files*."""
    kind = spark.read.parquet(f"{folder}/{files}").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", files).parquet(folder).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    table = append_new(stream, ["user_id", "event_type", "ts"], F.to_date("ts"), f"{shared_dir(spark)}/events-{uuid.uuid4().hex[:12]}")
    return table.groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("last_seen"), F.count("*").alias("n"))
