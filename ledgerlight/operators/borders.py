"""What holds at a date or at the border of a window, for all issuers and dates in one sorted pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import periods, picks

#: Days behind the issuer's newest end after which a fact is too old, and the days that a declaration may span.
STALE_DAYS, DECLARED_DAYS = 1100, 31


def anchors(targets: DataFrame, ends: DataFrame) -> DataFrame:
    """targets (issuer, at) with anchor: the issuer's newest *end* up to the date, null where there is none."""
    return picks.as_of(targets.select("issuer", "at").distinct(), ends.select("issuer", "end").distinct(), "issuer", "at", "end", []).select("issuer", "at", F.col("as_of").alias("anchor"))


def trailing_years(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(issuer, concept, at, w, declared, last): the window of each issuer and concept at each date that has a fact by then.

    facts (issuer, concept, start, end, value, unit), targets (issuer, at, anchor, home). w (value, start, end, basis, unit, parts) is that of
    periods.trailing_year with the facts it is made of (start, end, sign); null where none can be made, or of parts in several
    units. Of one period the home unit counts, else the first by name. Facts that end over STALE_DAYS before the anchor are left
    out; last is the newest end where that leaves none. declared (value, start, end, unit) sums what was declared by dates in the
    365 days before. The periods of a key become one sorted array, which every date cuts: facts are dealt once, not once a date.
    """
    key = ["issuer", "concept"]
    # rows are dealt by issuer once; all that follows keeps that partitioning
    homes = targets.groupBy("issuer").agg(F.max("home").alias("home"))
    p = facts.where((F.col("end") >= F.col("start")) & F.col("value").isNotNull()).select(*key, "start", "end", "value", "unit").repartition("issuer").join(homes, "issuer")
    p = p.groupBy(*key, "start", "end").agg(F.min(F.struct((~F.coalesce(F.col("unit") == F.col("home"), F.lit(False))).alias("other"), "unit", "value")).alias("x"))
    one = F.struct("end", "start", F.col("x.value").cast("double").alias("value"), periods.days().alias("days"), F.col("x.unit").alias("unit"))
    p = p.groupBy(*key).agg(F.sort_array(F.collect_list(one), asc=False).alias("all"))
    p = p.join(targets.select("issuer", "at", "anchor"), "issuer").withColumn("past", F.filter("all", lambda x: x["end"] <= F.col("at")))
    p = p.where(F.size("past") > 0).withColumn("p", F.filter("past", lambda x: F.datediff("anchor", x["end"]) <= STALE_DAYS))
    p = p.select(*key, "at", F.filter("p", lambda x: x["end"] > x["start"]).alias("p"), _declared(F.col("p"), F.col("at")).alias("declared"), F.when(F.size("p") == 0, F.col("past")[0]["end"]).alias("last"))
    return p.select(*key, "at", periods.window(F.col("p")).alias("w"), "declared", "last")


def _declared(p: Column, at: Column) -> Column:
    """The sum of declarations of the last 365 days, one for each date."""
    own = F.filter(p, lambda x: (F.datediff(x["end"], x["start"]) <= DECLARED_DAYS) & (x["end"] > F.date_sub(at, 365)))
    # newest first, so of one date the first counts
    once = F.filter(F.transform(own, lambda x, i: F.when((i == 0) | (F.get(own, i - 1)["end"] != x["end"]), x)), lambda x: x.isNotNull())
    alike = F.size(F.array_distinct(F.transform(once, lambda x: x["unit"]))) == 1
    whole = F.struct(F.aggregate(once, F.lit(0.0), lambda a, x: a + x["value"]).alias("value"), F.get(once, F.size(once) - 1)["end"].alias("start"), F.get(once, F.lit(0))["end"].alias("end"), F.get(once, F.lit(0))["unit"].alias("unit"))
    return F.when(alike, whole)


def common_periods(facts: DataFrame, recipes: dict[str, tuple[str, ...]], targets: DataFrame) -> DataFrame:
    """(issuer, at, common): map of each recipe to the newest year, then the newest period, in which all its concepts have a fact of one unit.

    common has arrays of (end, start, unit, annual, values by concept), of periods up to the date that are not over STALE_DAYS behind the
    anchor; targets (issuer, at, anchor). A period is one row with a column for each concept, and an issuer's periods are one sorted
    array, from which each date takes what it reads: no row for each recipe and period.
    """
    needing = sorted({c for w in recipes.values() for c in w})
    values = [F.min(F.when(F.col("concept") == c, F.col("value"))).cast("double").alias(c) for c in needing]
    rows = facts.where(F.col("value").isNotNull() & F.col("concept").isin(*needing)).select("issuer", "concept", "unit", "start", "end", "value")
    # rows are dealt by issuer once; all that follows keeps that partitioning
    wide = rows.repartition("issuer").groupBy("issuer", "unit", "start", "end").agg(*values)
    each = F.struct("end", "start", "unit", periods.days().between(*periods.ANNUAL).alias("annual"), F.struct(*needing).alias("v"))
    newest = lambda a, b: F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).when(a["unit"] < b["unit"], -1).otherwise(1)
    past = lambda p: (p["end"] <= F.col("at")) & (F.datediff("anchor", p["end"]) <= STALE_DAYS)
    p = wide.groupBy("issuer").agg(F.array_sort(F.collect_list(each), newest).alias("all")).join(targets.select("issuer", "at", "anchor"), "issuer").withColumn("near", F.filter("all", past))

    def common(wanted: tuple[str, ...]) -> Column:
        whole = F.filter("near", lambda x: reduce(lambda a, b: a & b, [x["v"][c].isNotNull() for c in wanted]))
        out = lambda x: F.struct(x["end"], x["start"], x["unit"], x["annual"], F.create_map(*[y for c in wanted for y in (F.lit(c), x["v"][c])]).alias("values"))
        return F.transform(F.concat(F.slice(F.filter(whole, lambda x: x["annual"]), 1, 1), F.slice(whole, 1, 1)), out)

    return p.select("issuer", "at", F.create_map(*[y for r, wanted in recipes.items() for y in (F.lit(r), common(wanted))]).alias("common"))


def at_borders(windows: DataFrame, balances: DataFrame) -> DataFrame:
    """windows (issuer, concept, start, end, ...) with first and last, the balances (value, day, unit, basis) at both borders.

    last is the balance of the window's very end, first the newest not after its start; no other date stands in for them. Reported and
    restated balances count alike as dates; of one date the reported one is taken, then the lower rank. balances (issuer, concept, end,
    value, unit, basis, rank). One union and one window, so a key costs its rows and not windows times balances.
    """
    key, others = ["issuer", "concept"], [c for c in windows.columns if c not in ("issuer", "concept")]
    best = picks.first_by(balances.where(F.col("value").isNotNull()), [*key, "end"], F.col("basis") != "as_reported", "rank", "unit", "value")
    kind = windows.select(F.struct(*others).alias("w")).schema["w"].dataType
    point = F.struct(F.col("value").cast("double").alias("value"), F.col("end").alias("day"), "unit", "basis")
    dates = best.select(*key, F.col("end").alias("t"), F.lit(0).alias("side"), point.alias("b"), F.lit(None).cast(kind).alias("w"))
    ask = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("side")), F.struct(F.col("end").alias("t"), F.lit(2).alias("side"))))
    asked = windows.select(*key, F.struct(*others).alias("w"), ask.alias("a")).select(*key, F.col("a.t").alias("t"), F.col("a.side").alias("side"), F.lit(None).cast(dates.schema["b"].dataType).alias("b"), "w")
    order = Window.partitionBy(*key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dates.unionByName(asked).withColumn("found", F.last("b", ignorenulls=True).over(order)).where("side > 0")
    first = F.max(F.when(F.col("side") == 1, F.col("found"))).alias("first")
    last = F.max(F.when((F.col("side") == 2) & (F.col("found.day") == F.col("t")), F.col("found"))).alias("last")
    return seen.groupBy(*key, "w").agg(first, last).select(*key, "w.*", "first", "last")


def newest(targets: DataFrame, stocks: DataFrame) -> DataFrame:
    """(issuer, at, now, stale): maps of each concept's newest balance up to each date (value, unit, end, filed), and of those that are
    over STALE_DAYS behind the anchor to their last end.

    targets (issuer, at, anchor), stocks (issuer, concept, end, value, unit, filed).
    """
    best = picks.first_by(stocks.where(F.col("value").isNotNull()), ["issuer", "concept", "end"], "unit", "value").withColumn("key", F.struct("issuer", "concept"))
    asked = best.select("issuer", "concept").distinct().join(targets, "issuer").withColumn("key", F.struct("issuer", "concept"))
    found = picks.as_of(asked, best, "key", "at", "end", ["value", "unit", "filed"]).where("as_of is not null")
    fresh = F.datediff("anchor", "as_of") <= STALE_DAYS
    row = F.struct("concept", F.struct(F.col("value").cast("double").alias("value"), "unit", F.col("as_of").alias("end"), "filed").alias("x"))
    now = F.map_from_entries(F.collect_list(F.when(fresh, row)))
    return found.groupBy("issuer", "at").agg(now.alias("now"), F.map_from_entries(F.collect_list(F.when(~fresh, F.struct("concept", "as_of")))).alias("stale"))


def statement_now(windows: DataFrame, balances: DataFrame) -> DataFrame:
    """(issuer, at, concept, value, start, end, kind): what a statement shows at a date: true trailing years of flows (ttm) and the newest
    balances (instant). A year that stands in for a trailing one is left out.

    windows is trailing_years(), balances newest().
    """
    flows = windows.where("w.basis = 'ttm'").select("issuer", "at", "concept", F.col("w.value").alias("value"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lit("ttm").alias("kind"))
    now = balances.select("issuer", "at", F.explode("now").alias("concept", "x"))
    return flows.unionByName(now.select("issuer", "at", "concept", F.col("x.value").alias("value"), F.col("x.end").alias("start"), F.col("x.end").alias("end"), F.lit("instant").alias("kind")))
