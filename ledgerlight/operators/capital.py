"""Capital: nearest balance at a border, debt in parts, the minority identity, and returns on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import reasons as R

from .picks import first_by

#: Days that a balance may lie off a border; tags of debt in two parts, the first pair first.
BORDER_DAYS = 10
DEBT_PAIRS = (("us-gaap:LongTermDebtNoncurrent", "us-gaap:LongTermDebtCurrent"), ("us-gaap:LongTermDebtAndCapitalLeaseObligations", "us-gaap:DebtCurrent"))
#: The tag that short-term debt is added to, and tags of such debt, the first first.
LONG_TERM, SHORT_TERM = "us-gaap:LongTermDebt", ("us-gaap:ShortTermBorrowings", "us-gaap:CommercialPaper")


def at_border(borders: DataFrame, stocks: DataFrame, most: int = BORDER_DAYS) -> DataFrame:
    """(issuer, border, concept, value, end, gap, basis): the balance nearest to each border, *most* days off at the furthest.

    borders (issuer, border); stocks (issuer, concept, end, value, rank, basis). A restated balance counts only where no
    reported one is near; then the smaller gap, rank and earlier end. Dates within a window of 2 * most + 1 days share one of
    two buckets, so the join is by equality and a long history meets only its neighbours.
    """
    width = 2 * most + 1
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    b = borders.select("issuer", "border").distinct().withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((day("border") - most) / width), F.floor((day("border") + most) / width)))))
    j = b.join(stocks.withColumn("_b", F.floor(day("end") / width)), ["issuer", "_b"]).withColumn("gap", F.abs(F.datediff("end", "border"))).where(F.col("gap") <= most)
    best = first_by(j, ["issuer", "border", "concept"], F.col("basis") == "restated", "gap", "rank", "end", "value")
    return best.select("issuer", "border", "concept", "value", "end", "gap", "basis")


def debt(facts: DataFrame) -> DataFrame:
    """(issuer, end, unit, total, pair): debt of two parts on one date, both required; the second pair where the first is not whole.

    facts (issuer, end, unit, concept, filed, value); the last filed of a tag counts.
    """
    tags = [t for pair in DEBT_PAIRS for t in pair]
    f = first_by(facts.where(F.col("concept").isin(*tags) & F.col("value").isNotNull()), ["issuer", "end", "unit", "concept"], F.desc("filed"), "value")
    g = f.groupBy("issuer", "end", "unit").agg(*[F.max(F.when(F.col("concept") == t, F.col("value"))).alias(f"t{i}") for i, t in enumerate(tags)])
    one, two = F.expr("t0 + t1"), F.expr("t2 + t3")
    return g.select("issuer", "end", "unit", F.coalesce(one, two).alias("total"), F.when(one.isNotNull(), 1).when(two.isNotNull(), 2).alias("pair")).where("total is not null")


def with_short_term(long_term: DataFrame, facts: DataFrame) -> DataFrame:
    """long_term (issuer, end, tag, value) with short-term debt of the same date added, if the tag is the plain one."""
    s = facts.where(F.col("concept").isin(*SHORT_TERM) & F.col("value").isNotNull())
    s = first_by(s, ["issuer", "end"], F.array_position(F.array(*map(F.lit, SHORT_TERM)), F.col("concept")), F.desc("filed"), "value").select("issuer", "end", F.col("value").alias("_short"))
    out = long_term.join(s, ["issuer", "end"], "left")
    return out.withColumn("value", F.col("value") + F.when(F.col("tag") == LONG_TERM, F.coalesce("_short", F.lit(0.0))).otherwise(0.0)).drop("_short")


def parent_equity(equity: DataFrame, incl: DataFrame, minority: DataFrame, never: DataFrame) -> DataFrame:
    """(issuer, unit, end, value, identity): filed equity, else equity including minorities less minorities of that unit and date.

    Only for issuers that file no equity of their own. Without a minority the row is left out, unless the issuer is among
    *never* (issuer): such ones have none.
    """
    key = ["issuer", "unit", "end"]
    own = equity.select(*key, "value", F.lit(False).alias("identity"))
    m = incl.select(*key, F.col("value").alias("all")).join(equity.select("issuer").distinct(), "issuer", "left_anti")
    m = m.join(minority.select(*key, F.col("value").alias("part")), key, "left").join(never.select("issuer").distinct().withColumn("zero", F.lit(0.0)), "issuer", "left")
    return own.unionByName(m.select(*key, (F.col("all") - F.coalesce("part", "zero")).alias("value"), F.lit(True).alias("identity")).where("value is not null"))


def invested(**parts):
    """Equity and minorities and debt, less cash and short-term investments; missing parts are named."""
    return R.total({"cash": -1, "st_investments": -1}, **parts)


def roic(nopat, begin, end):
    """NOPAT over the mean of the capital at both ends of the flow."""
    why = F.when(begin.isNull(), F.lit("missing_prior_period"))
    r = R.ratio(nopat=nopat, invested_capital=(begin + end) / 2)
    return R.result(r["value"], F.coalesce(why, r["reason"]))
