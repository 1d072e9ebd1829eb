"""Group statistics with guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.scratch import saved

QUARTILES_FROM, PERCENTILE_FROM = 8, 5


def ranked(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, _c, _below, _n): rows of each distinct value, rows of the group below it, and of the group.

    Ranks in two levels: distinct values are dealt into ranges of (group, value), ranked within each range, and raised by the counts
    of the group's ranges before. So a group that holds a third of all rows is the work of a third of the tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(counts.repartitionByRange(n, group, value).withColumn("_part", F.spark_partition_id()), "ranks")
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(group, "_part").agg(F.sum("_c").alias("_s"))
    parts = parts.select(group, "_part", F.coalesce(F.sum("_s").over(before(group).orderBy("_part")), F.lit(0)).alias("_raise"), F.sum("_s").over(Window.partitionBy(group)).alias("_n"))
    own = dealt.withColumn("_own", F.coalesce(F.sum("_c").over(before("_part", group).orderBy(value)), F.lit(0)))
    return own.join(parts, [group, "_part"]).select(group, value, "_c", (F.col("_own") + F.col("_raise")).alias("_below"), "_n")


def quartiles(rows: DataFrame, group: str, value: str = "value", least: int = QUARTILES_FROM) -> DataFrame:
    """(group, p25, median, p75, n, no_value, reason): inclusive quartiles, refused for fewer than *least* values."""
    r = ranked(rows, group, value)
    spot = lambda p: (F.col("_n") - 1) * p
    at = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col(value)))
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    ends = [e for n, p in shares.items() for e in (at(F.floor(spot(p))).alias(f"{n}_low"), at(F.ceil(spot(p))).alias(f"{n}_high"))]
    q = r.groupBy(group).agg(F.max("_n").alias("c"), *ends)
    g = rows.groupBy(group).agg((F.count("*") - F.count(value)).alias("no_value")).join(q, group, "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ok = F.col("c") >= least
    part = lambda p: (F.col("c") - 1) * p - F.floor((F.col("c") - 1) * p)
    cols = [F.when(ok, F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * part(p)).alias(n) for n, p in shares.items()]
    return g.select(group, *cols, F.when(ok, F.col("c")).otherwise(0).alias("n"), "no_value", F.when(~ok, F.lit("peer_set_too_small")).alias("reason"))


def percentile_below(rows: DataFrame, group: str, member: str, value: str = "value", least: int = PERCENTILE_FROM) -> DataFrame:
    """(group, member, n, percentile): share of the other members strictly below, from *least* others on."""
    counts = ranked(rows, group, value).select(group, value, "_below", (F.col("_n") - 1).alias("n"))
    out = rows.where(F.col(value).isNotNull()).join(counts, [group, value])
    return out.select(group, member, "n", F.try_divide("_below", "n").alias("percentile")).where(F.col("n") >= least)


def concentration(rows: DataFrame, group: str, value: str = "value") -> DataFrame:
    """(group, n, hhi): sum of squared shares, as fractions."""
    g = rows.where(F.col(value) > 0).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    return g.select(group, "n", F.try_divide("s2", F.col("s") * F.col("s")).alias("hhi"))


def currency_guard(rows: DataFrame, group: str, currency: str) -> DataFrame:
    """(group, n_currencies, reason): refused where currencies mix; blanks count as one."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_set(F.coalesce(currency, F.lit("(blank)")))).alias("c"))
    return g.select(group, F.size("c").alias("n_currencies"), F.when(F.size("c") > 1, F.concat(F.lit("currency_mismatch: "), F.array_join("c", ", "))).alias("reason"))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value, ties alphabetical."""
    c = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return c.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where("_r = 1").drop("_r")


def period_window(rows: DataFrame, group: str, end: str = "end", most: int = 730) -> DataFrame:
    """(group, period_from, period_to, included, excluded): members whose period ends within *most* days of the newest."""
    newest = rows.groupBy(group).agg(F.max(end).alias("_newest"))
    r = rows.join(newest, group).withColumn("_in", F.datediff("_newest", F.col(end)) <= most)
    return r.groupBy(group).agg(F.min(F.when(F.col("_in"), F.col(end))).alias("period_from"), F.max(end).alias("period_to"), F.count_if("_in").alias("included"), F.count_if(~F.col("_in")).alias("excluded"))
