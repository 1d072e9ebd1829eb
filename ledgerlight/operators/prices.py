"""Event-adjusted price series (id, date, close)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import picks

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)

Divide = Callable[[Column, Column], Column]


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL over floating point has it: by zero infinite, zero by zero not a number."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def adjusted(prices: DataFrame, actions: DataFrame, divide: Divide = F.try_divide) -> DataFrame:
    """prices with price_adj: close times the factors of all events after its date.

    actions (id, date, kind, amount): a split by k gives 1/k, a dividend 1 - amount / close of the trading day before; a dividend without such a day or on
    a day without price is skipped, after a close of 0 too, unless *divide* says what it gives. One suffix product, no range join.
    """
    w = Window.partitionBy("id").orderBy("date")
    p = prices.withColumn("before", F.lag("close").over(w))
    a = actions.join(p.select("id", "date", "before"), ["id", "date"], "left")
    f = F.when(F.col("kind") == "split", divide(F.lit(1.0), F.col("amount"))).otherwise(1 - divide(F.col("amount"), F.col("before")))
    f = a.select("id", "date", f.alias("f")).where("f is not null").groupBy("id", "date").agg(F.product("f").alias("f"))
    after = F.product(F.coalesce("f", F.lit(1.0))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return prices.join(f, ["id", "date"], "left").withColumn("price_adj", F.col("close") * F.coalesce(after, F.lit(1.0))).drop("f")


def returns(prices: DataFrame, value: str = "close", divide: Divide = F.try_divide) -> DataFrame:
    """(id, n, total_return, drawdown): last over first less 1, and the deepest fall from a running maximum (0 if none).

    A price of 0 as first one or maximum gives null, unless *divide* says what it gives.
    """
    peak = F.max(value).over(Window.partitionBy("id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = prices.withColumn("fall", divide(F.col(value), peak) - 1)
    g = p.groupBy("id").agg(F.count("*").alias("n"), F.min_by(value, "date").alias("first"), F.max_by(value, "date").alias("last"), F.min("fall").alias("fall"))
    return g.select("id", "n", F.when(F.col("n") >= 2, divide(F.col("last"), F.col("first")) - 1).alias("total_return"), F.least(F.lit(0.0), "fall").alias("drawdown"))


def gaps(prices: DataFrame, most: int = 10) -> DataFrame:
    """(id, gap_from, gap_to, days): consecutive dates more than *most* days apart."""
    before = F.lag("date").over(Window.partitionBy("id").orderBy("date"))
    return prices.select("id", before.alias("gap_from"), F.col("date").alias("gap_to"), F.datediff("date", before).alias("days")).where(F.col("days") > most)


def state(prices: DataFrame, ids: DataFrame, as_of: str, gap: int = 10, stale: int = 14) -> DataFrame:
    """(id, state): no_history, gap, stale or complete."""
    worst = gaps(prices, gap).select("id").distinct().withColumn("has_gap", F.lit(True))
    last = prices.groupBy("id").agg(F.max("date").alias("last"))
    out = ids.join(last, "id", "left").join(worst, "id", "left")
    s = F.when(F.col("last").isNull(), "no_history").when(F.col("has_gap"), "gap").when(F.datediff(F.lit(as_of).cast("date"), "last") > stale, "stale").otherwise("complete")
    return out.select("id", s.alias("state"))


def year_change(prices: DataFrame, days: int = 365, most: int = 7, divide: Divide | None = None) -> DataFrame:
    """(id, date, close, change): the last price against the one *days* earlier, at most *most* days older still.

    prices (id, date, close, adjusted): adjusted prices count if both ends have one, else closes. A close of 0 at either end has no
    change, unless *divide* says what it gives.
    """
    last = prices.groupBy("id").agg(F.max_by(F.struct("date", "close", "adjusted"), "date").alias("l")).select("id", F.col("l.date").alias("date"), F.col("l.close").alias("close"), F.col("l.adjusted").alias("adj"))
    then = picks.as_of(last.withColumn("target", F.date_sub("date", days)), prices.select("id", F.col("date").alias("day"), F.col("close").alias("close0"), F.col("adjusted").alias("adj0")), "id", "target", "day", ["close0", "adj0"], most)
    both = F.coalesce(F.col("adj") * F.col("adj0"), F.lit(0.0)) != 0
    plain = F.when(F.col("close") != 0, F.try_divide("close", "close0")) if divide is None else divide(F.col("close"), F.col("close0"))
    change = F.when(both, F.try_divide("adj", "adj0")).otherwise(plain) - 1
    return then.select("id", "date", "close", change.alias("change"))


def dividends_per_share(instruments: DataFrame, filed: DataFrame, actions: DataFrame, windows: DataFrame, as_of: str | None = None, stale: int = 550) -> DataFrame:
    """(id, at, dps, end, currency, source, reason): the filed sum, else dividends of the 365 days before, else the window of filings.

    instruments (id, at, currency of its price), filed and windows (id, at, value, end, currency), actions (id, date, kind, amount,
    currency); with *as_of* all are of that date and have no column at. A dividend in another known currency than the price rules the
    actions out; a window that ended over *stale* days ago is refused. An instrument's dividends are one array, cut by each date.
    """
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        instruments, filed, windows = (f.withColumn("at", day) for f in (instruments, filed, windows))
    a = actions.where((F.col("kind") == "dividend") & F.col("amount").isNotNull())
    a = a.groupBy("id").agg(F.collect_list(F.struct("date", F.col("amount").cast("double").alias("amount"), F.col("currency").alias("currency"))).alias("events"))
    own = F.filter("events", lambda e: (e["date"] > F.date_sub("at", 365)) & (e["date"] <= F.col("at")))
    pack = lambda f, name: f.select("id", "at", F.struct(F.col("value").cast("double").alias("value"), "end", "currency").alias(name))
    x = instruments.select("id", "at", F.col("currency").alias("p")).join(a, "id", "left").withColumn("own", own)
    # sorted, so that a sum doesn't hang on the order in which events arrive
    total = F.aggregate(F.array_sort(F.transform("own", lambda e: e["amount"])), F.lit(0.0), lambda s, v: s + v)
    alike = (F.size("own") > 0) & F.forall("own", lambda e: F.coalesce(e["currency"] == F.col("p"), F.lit(True)))
    paid = F.when(alike, F.struct(total.alias("value"), F.col("at").alias("end"), F.col("p").alias("currency")))
    x = x.select("id", "at", paid.alias("a")).join(pack(filed, "f"), ["id", "at"], "left").join(pack(windows, "w"), ["id", "at"], "left")
    old = F.datediff("at", "w.end") > stale
    best = F.coalesce("f", "a", F.when(~old, F.col("w")))
    source = F.when(F.col("f").isNotNull(), "filed").when(F.col("a").isNotNull(), "actions").when(F.col("w").isNotNull() & ~old, "window")
    why = F.when(source.isNull(), F.when(old, F.concat(F.lit("stale_data: dps: last "), F.col("w.end").cast("string"))).otherwise("missing_data: dps_ttm"))
    out = x.select("id", "at", best["value"].alias("dps"), best["end"].alias("end"), best["currency"].alias("currency"), source.alias("source"), why.alias("reason"))
    return out if as_of is None else out.drop("at")
