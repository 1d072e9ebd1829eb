"""Rank-and-pick, as-of and interval joins, versioned sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def supersede(facts: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Every fact with superseded_by: null for the winner of its key, else the winner's fact_id."""
    w = Window.partitionBy(*key).orderBy(*order)
    win = F.first("fact_id").over(w)
    return facts.withColumn("superseded_by", F.when(win != F.col("fact_id"), win))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, time: str, values: list[str], most_days: int | None = None) -> DataFrame:
    """Each left row with the newest right row of its key at or before its date, and the age in days.

    One union and one window instead of a range join, so a key costs its rows and not their product. right has one row for
    each key and time.
    """
    names = left.columns
    gap = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names if c not in (key,)]
    a = left.select(*names, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(right.schema[time].dataType).alias("as_of"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"r_{v}") for v in values])
    b = right.select(*[F.col(key) if c == key else gap.pop(0) for c in names], F.col(time).alias("_t"), F.lit(0).alias("_k"), F.col(time).alias("as_of"), *[F.col(v).alias(f"r_{v}") for v in values])
    w = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_k") == 0, F.struct("as_of", *[f"r_{v}" for v in values])), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_r", last).where("_k = 1")
    age = F.datediff(F.col("_t"), F.col("_r.as_of"))
    fresh = F.lit(True) if most_days is None else age <= most_days
    return out.select(*names, F.col("_r.as_of").alias("as_of"), age.alias("age_days"), *[F.when(fresh, F.col(f"_r.r_{v}")).alias(v) for v in values])


def valid_at(rows: DataFrame, at: Column, closed: bool) -> DataFrame:
    """Rows of an interval table at a date: [valid_from, valid_to] if closed, else [valid_from, valid_to)."""
    end = F.col("valid_to") >= at if closed else F.col("valid_to") > at
    return rows.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | end))


def churn(versions: DataFrame, key: str, version: str, member: str) -> DataFrame:
    """(key, version, added, removed, churn): each version against the one before; churn is the changed share of the current size.

    Members are matched by a join, so no set is gathered in one row.
    """
    v = versions.select(key, version, member).distinct()
    order = v.select(key, version).distinct().withColumn("_next", F.lead(version).over(Window.partitionBy(key).orderBy(version)))
    now = v.withColumn("_now", F.lit(True))
    before = v.join(order.where("_next is not null"), [key, version]).select(key, F.col("_next").alias(version), member, F.lit(True).alias("_before"))
    j = now.join(before, [key, version, member], "full")
    g = j.groupBy(key, version).agg(F.count_if(F.col("_before").isNull()).alias("added"), F.count_if(F.col("_now").isNull()).alias("removed"), F.count("_now").alias("_n"))
    later = order.where("_next is not null").select(key, F.col("_next").alias(version))
    return g.join(later, [key, version], "left_semi").select(key, version, "added", "removed", F.try_divide(F.col("added") + F.col("removed"), "_n").alias("churn"))
