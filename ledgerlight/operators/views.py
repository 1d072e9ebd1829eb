"""What a card or a chart shows, as rows: a table by years, series of points and boxes of a group. Drawing them is not done here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import groups


def card(history: DataFrame, concepts: list[str], closes: str, most: int = 5) -> DataFrame:
    """(id, place, concept, cells) of history (id, concept, year, value): a row for each of *concepts* in their order, a cell (year, value) for
    each closed year, the newest *most*, oldest first; null where a year has no value.

    A year is closed if the concept *closes* (revenue, say) has a value in it. One row for each (id, concept, year).
    """
    years = history.where((F.col("concept") == closes) & F.col("value").isNotNull()).select("id", "year").distinct()
    last = years.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("year")))).where(F.col("r") <= most).select("id", "year")
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("concept")) for i, c in enumerate(concepts)])
    grid = last.withColumn("c", F.explode(listed)).select("id", "year", "c.*")
    full = grid.join(history.select("id", "concept", "year", "value"), ["id", "concept", "year"], "left")
    return full.groupBy("id", "place", "concept").agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("cells"))


def series(history: DataFrame, concepts: list[str]) -> DataFrame:
    """(id, concept, x, y, change): the points of each line in the order of years, without gaps filled, and the last change as a share of the
    value before it (null for a single point or after 0)."""
    points = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("year", "value"))))
    g = history.where(F.col("concept").isin(*concepts)).groupBy("id", "concept").agg(points.alias("p")).where(F.size("p") > 0)
    at = lambda back: F.get("p", F.size("p") - back)["value"]
    before = F.when(F.size("p") > 1, at(2))
    return g.select("id", "concept", F.col("p.year").alias("x"), F.col("p.value").alias("y"), F.try_divide(at(1) - before, F.abs(before)).alias("change"))


def boxes(rows: DataFrame, group: str, value: str = "value") -> DataFrame:
    """(group, low, p25, median, p75, high, n, reason): quartiles and the furthest values within one and a half of their distance."""
    q = groups.quartiles(rows, group, value).select(group, "p25", "median", "p75", "n", "reason")
    reach = (F.col("p75") - F.col("p25")) * 1.5
    inside = rows.join(q, group).where((F.col(value) >= F.col("p25") - reach) & (F.col(value) <= F.col("p75") + reach))
    ends = inside.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(ends, group, "left").select(group, "low", "p25", "median", "p75", "high", "n", "reason")
