"""Period algebra over long facts (issuer, concept, start, end, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER, ANNUAL, GAP, YEAR_BACK = (80, 100), (350, 380), (1, 5), (358, 372)


def days() -> F.Column:
    return F.datediff("end", "start") + 1


def trailing_year(facts: DataFrame, as_of: str) -> DataFrame:
    """(issuer, concept, value, start, end, basis): the trailing-year window of each issuer and concept at a date.

    The anchor is the newest period that is closed at as_of. In order: itself where it is annual; four adjacent quarters that end
    with it; last annual + year to date - year to date before; the newest annual ('annual_fallback'). One fact stands for each
    (start, end). One exchange: the periods of a key become a sorted array, on which all four ways are functions.
    """
    key = ["issuer", "concept"]
    p = facts.where((F.col("end") <= F.lit(as_of).cast("date")) & (F.col("end") > F.col("start")) & F.col("value").isNotNull())
    # rows are dealt by the key once; all that follows keeps that partitioning
    p = p.select(*key, "start", "end", "value").repartition(*key).groupBy(*key, "start", "end").agg(F.min("value").alias("value"))
    one = F.struct("end", "start", F.col("value").cast("double").alias("value"), days().alias("days"), F.lit("").alias("unit"))
    # the periods of one issuer and concept, newest first: some hundreds at most
    p = p.groupBy(*key).agg(F.sort_array(F.collect_list(one), asc=False).alias("p"))
    return p.select(*key, window(F.col("p")).alias("w")).where("w is not null").select(*key, "w.value", "w.start", "w.end", "w.basis")


def window(p: Column) -> Column:
    """(value, start, end, basis, unit, parts) of the periods (end, start, value, days, unit) of a key, newest first; see trailing_year.

    parts are the facts it is made of (start, end, sign). Parts in several units make no window.
    """
    return F.element_at(F.transform(F.array(p), _window), 1)


def _window(p: Column) -> Column:
    gap = lambda later, earlier: F.datediff(later["start"], earlier["end"])
    anchor = F.get(p, F.lit(0))
    annual = F.filter(p, lambda x: x["days"].between(*ANNUAL))
    q = F.slice(F.filter(p, lambda x: x["days"].between(*QUARTER)), 1, 4)
    adjacent = (F.size(q) == 4) & (F.get(q, F.lit(0)) == anchor) & F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: gap(F.get(q, i), F.get(q, i + 1)).between(*GAP))
    chain = adjacent & (F.datediff(anchor["end"], F.get(q, F.lit(3))["start"]) + 1).between(*ANNUAL)
    year = F.get(F.filter(annual, lambda x: F.datediff(anchor["start"], x["end"]).between(*GAP)), F.lit(0))
    prior = F.get(F.filter(p, lambda x: F.datediff(anchor["start"], x["start"]).between(*YEAR_BACK) & F.datediff(anchor["end"], x["end"]).between(*YEAR_BACK)), F.lit(0))
    part = lambda x, sign: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), x["unit"].alias("unit"), F.lit(sign).alias("sign"))
    made = lambda parts, start, end, basis: F.struct(parts.alias("parts"), start.alias("start"), end.alias("end"), F.lit(basis).alias("basis"))
    whole = lambda x, basis: made(F.array(part(x, 1)), x["start"], x["end"], basis)
    newest = F.get(annual, F.lit(0))
    out = (
        F.when(anchor["days"].between(*ANNUAL), whole(anchor, "ttm"))
        .when(chain, made(F.transform(q, lambda x: part(x, 1)), F.get(q, F.lit(3))["start"], anchor["end"], "ttm"))
        .when(year.isNotNull() & prior.isNotNull(), made(F.array(part(year, 1), part(anchor, 1), part(prior, -1)), F.date_add(prior["end"], 1), anchor["end"], "ttm"))
        .when(newest.isNotNull(), whole(newest, "annual_fallback"))
    )

    def summed(w: Column) -> Column:
        value = F.aggregate(w["parts"], F.lit(0.0), lambda a, x: a + x["value"] * x["sign"])
        facts = F.transform(w["parts"], lambda x: F.struct(x["start"], x["end"], x["sign"]))
        alike = F.size(F.array_distinct(F.transform(w["parts"], lambda x: x["unit"]))) == 1
        row = F.struct(value.alias("value"), w["start"].alias("start"), w["end"].alias("end"), w["basis"].alias("basis"), F.get(w["parts"], F.lit(0))["unit"].alias("unit"), facts.alias("parts"))
        return F.when(w.isNotNull() & alike, row)

    return F.element_at(F.transform(F.array(out), summed), 1)


def year_gaps(rows: DataFrame, key: str, year: str) -> DataFrame:
    """(key, missing): the years between the first and the last that have no row."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_set(year)).alias("y"))
    return g.select(key, F.array_except(F.sequence(F.array_min("y"), F.array_max("y")), "y").alias("missing"))


def staleness_door(facts: DataFrame, most: int = 1100) -> DataFrame:
    """Facts that end at most *most* days before the issuer's newest end."""
    newest = F.max("end").over(Window.partitionBy("issuer"))
    return facts.withColumn("anchor", newest).where(F.datediff("anchor", "end") <= most).drop("anchor")
