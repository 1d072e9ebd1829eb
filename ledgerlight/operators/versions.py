"""Versioned sets and snapshots: peer sets with dates, watchlists as whole copies, history by year, presentation, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .picks import first_by

#: Blocks that depend on facts, and days under which a flow is no year.
DEPENDENT = ("industry_metrics", "llm_summary")
LEAST_YEAR = 300


def set_members(versions: DataFrame, wanted: DataFrame, today: str) -> DataFrame:
    """All versions after *wanted* (set_id, members) is set: unchanged sets stay, else the open version ends and a new one begins.

    versions (set_id, version, valid_from, valid_to, members sorted array).
    """
    day = F.lit(today).cast("date")
    new = wanted.select("set_id", F.array_sort(F.array_distinct("members")).alias("new")).where(F.size("new") > 0)
    top = versions.groupBy("set_id").agg(F.max("version").alias("top"), F.max(F.when(F.col("valid_to").isNull(), F.col("members"))).alias("open"))
    change = new.join(top, "set_id", "left").where(F.col("open").isNull() | (F.col("open") != F.col("new")))
    closed = versions.join(change.select("set_id", F.lit(True).alias("_c")), "set_id", "left")
    closed = closed.withColumn("valid_to", F.when(F.col("_c") & F.col("valid_to").isNull(), day).otherwise(F.col("valid_to"))).drop("_c")
    opened = change.select("set_id", (F.coalesce("top", F.lit(0)) + 1).cast(versions.schema["version"].dataType).alias("version"), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.col("new").alias("members"))
    return closed.unionByName(opened)


def next_version(members: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A new version of each list in *add* or *remove* (list_id, member): the last one's members, plus and minus those.

    members (list_id, version, member). Only the new versions' rows are returned, to be appended.
    """
    none = members.select("list_id", "member").limit(0)
    add, remove = (none if x is None else x.select("list_id", "member").distinct() for x in (add, remove))
    touched = add.select("list_id").union(remove.select("list_id")).distinct()
    top = members.groupBy("list_id").agg(F.max("version").alias("version"))
    now = members.join(top, ["list_id", "version"], "left_semi").select("list_id", "member").join(touched, "list_id", "left_semi")
    kept = now.union(add).distinct().join(remove, ["list_id", "member"], "left_anti")
    return kept.join(top, "list_id", "left").select("list_id", (F.coalesce("version", F.lit(0)) + 1).alias("version"), "member")


def rolled_back(members: DataFrame, to: DataFrame) -> DataFrame:
    """A new version of each list in *to* (list_id, version) with that version's members; the versions between stay."""
    top = members.groupBy("list_id").agg(F.max("version").alias("top"))
    return members.join(to, ["list_id", "version"], "left_semi").join(top, "list_id").select("list_id", (F.col("top") + 1).alias("version"), "member")


def presentation(rows: DataFrame, key: list[str], dominant: Column) -> DataFrame:
    """The row of each key to show: the newest end, then start, then the dominant unit, else the first unit by name."""
    return first_by(rows, key, F.desc("end"), F.desc("start"), F.desc(F.coalesce(F.col("unit") == dominant, F.lit(False))), "unit")


def by_year(measures: DataFrame) -> DataFrame:
    """(id, concept, year, value, version): measures of each year, the highest version's; flows of under 300 days are no year's.

    measures (id, version, as_of, concept, value, period_start, period_end); the year is the period's, else the snapshot's.
    """
    days = F.datediff("period_end", "period_start")
    m = measures.where(F.col("value").isNotNull() & ~F.coalesce((days > 0) & (days < LEAST_YEAR), F.lit(False)))
    m = m.withColumn("year", F.year(F.coalesce("period_end", "period_start", "as_of"))).where("year is not null")
    return first_by(m, ["id", "concept", "year"], F.desc("version"), F.desc("as_of"), F.desc("period_end"), "value").select("id", "concept", "year", "value", "version")


def cascade(coverage: DataFrame, touched: DataFrame) -> DataFrame:
    """coverage (id, block, status, reason) after blocks were *touched* (id, block): dependent blocks of the same id turn stale.

    Of several touched blocks the last by name is the one that the reason tells.
    """
    hit = touched.groupBy("id").agg(F.max("block").alias("_by"))
    out = coverage.join(hit, "id", "left")
    stale = F.col("_by").isNotNull() & F.col("block").isin(*DEPENDENT)
    return out.select("id", "block", F.when(stale, "stale").otherwise(F.col("status")).alias("status"), F.when(stale, F.concat(F.lit("cascade:after_"), F.col("_by"))).otherwise(F.col("reason")).alias("reason"))


def gaps_of_versions(versions: DataFrame) -> DataFrame:
    """(set_id, version, gap_days): days without a valid version before each one; overlaps are negative."""
    before = F.lag("valid_to").over(Window.partitionBy("set_id").orderBy("version"))
    return versions.select("set_id", "version", F.datediff("valid_from", before).alias("gap_days")).where("gap_days <> 0")
