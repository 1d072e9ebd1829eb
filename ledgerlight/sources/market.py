"""Prices, splits, dividends and lists of filings from vendors' JSON.

Input: (id, payload string). Rows that lack a part are left out of the values and counted by `skipped`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filings import filled, finite

_EVENTS = "splits map<string, struct<date bigint, numerator string, denominator string>>, dividends map<string, struct<date bigint, amount string>>"
_CHART = f"""chart struct<result array<struct<meta struct<currency string, gmtoffset bigint>, timestamp array<bigint>,
indicators struct<quote array<struct<close array<double>, volume array<bigint>>>, adjclose array<struct<adjclose array<double>>>>, events struct<{_EVENTS}>>>>"""
_VALUES = "meta struct<currency string>, `values` array<struct<datetime string, close string, adjusted_close string, volume string>>"
_ACTIONS = "meta struct<currency string>, splits array<struct<date string, from_factor string, to_factor string>>, dividends array<struct<ex_date string, amount string>>"
_INDEX = "cik string, filings struct<recent struct<form array<string>, accessionNumber array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>>>"


def _day(stamp: Column, offset: Column) -> Column:
    """Date at the exchange; no session time zone is involved."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((stamp + F.coalesce(offset, F.lit(0))) / 86400).cast("int"))


def _zip(**arrays: tuple[Column, str]) -> Column:
    """Parallel arrays as one of structs; an array that is missing gives nulls."""
    return F.arrays_zip(*[F.coalesce(a, F.array().cast(f"array<{kind}>")).alias(n) for n, (a, kind) in arrays.items()])


def _chart(payloads: DataFrame) -> DataFrame:
    return payloads.select("id", F.from_json("payload", _CHART)["chart"]["result"].alias("r")).select("id", F.try_element_at("r", F.lit(1)).alias("r"))


def chart_prices(payloads: DataFrame) -> DataFrame:
    """(id, date, close, adjusted, volume, currency) of parallel arrays; of one date the last row counts."""
    r = _chart(payloads)
    quote, adjusted = (F.try_element_at(f"r.indicators.{n}", F.lit(1)) for n in ("quote", "adjclose"))
    zipped = _zip(ts=(F.col("r.timestamp"), "bigint"), close=(quote["close"], "double"), adj=(adjusted["adjclose"], "double"), volume=(quote["volume"], "bigint"))
    x = r.select("id", "r.meta", F.posexplode(zipped).alias("i", "v")).where("v.ts is not null and v.close is not null")
    row = F.struct(F.col("v.close").alias("close"), F.col("v.adj").alias("adjusted"), F.col("v.volume").alias("volume"), F.col("meta.currency").alias("currency"))
    g = x.groupBy("id", _day(F.col("v.ts"), F.col("meta.gmtoffset")).alias("date")).agg(F.max_by(row, "i").alias("row"))
    return g.select("id", "date", "row.*")


def _action(date: Column, kind: str, factor: Column | None, amount: Column | None, currency: Column) -> list[Column]:
    none = F.lit(None).cast("double")
    return [date.alias("date"), F.lit(kind).alias("kind"), (none if factor is None else factor).alias("factor"), (none if amount is None else amount).alias("amount"), currency.alias("currency")]


def _split(a: Column, b: Column) -> Column:
    return F.try_divide(finite(a), finite(b))


def chart_actions(payloads: DataFrame) -> DataFrame:
    """(id, date, kind, factor, amount, currency); factor k of a split is numerator over denominator."""
    r = _chart(payloads).select("id", "r.meta", "r.events")
    s = r.select("id", "meta", F.explode(F.map_values("events.splits")).alias("e"))
    d = r.select("id", "meta", F.explode(F.map_values("events.dividends")).alias("e"))
    day, money = _day(F.col("e.date"), F.col("meta.gmtoffset")), F.col("meta.currency")
    return s.select("id", *_action(day, "split", _split(F.col("e.numerator"), F.col("e.denominator")), None, money)).unionByName(d.select("id", *_action(day, "dividend", None, finite(F.col("e.amount")), money)))


def series_prices(payloads: DataFrame) -> DataFrame:
    """(id, date, close, adjusted, volume, currency) of a list of days with texts for numbers; days without a close are left out."""
    x = payloads.select("id", F.from_json("payload", _VALUES).alias("p")).select("id", "p.meta.currency", F.explode("p.values").alias("v"))
    cols = [F.to_date(F.substring("v.datetime", 1, 10)).alias("date"), finite(F.col("v.close")).alias("close"), finite(F.col("v.adjusted_close")).alias("adjusted"), finite(F.col("v.volume")).cast("bigint").alias("volume")]
    return x.select("id", *cols, "currency").where("close is not null")


def series_actions(payloads: DataFrame) -> DataFrame:
    """As `chart_actions`; k is from_factor over to_factor, as the vendor's ratio is rounded."""
    p = payloads.select("id", F.from_json("payload", _ACTIONS).alias("p")).select("id", "p.*")
    s, d = p.select("id", "meta", F.explode("splits").alias("e")), p.select("id", "meta", F.explode("dividends").alias("e"))
    day, money = (lambda n: F.try_to_date(F.col(f"e.{n}"))), F.col("meta.currency")
    return s.select("id", *_action(day("date"), "split", _split(F.col("e.from_factor"), F.col("e.to_factor")), None, money)).unionByName(d.select("id", *_action(day("ex_date"), "dividend", None, finite(F.col("e.amount")), money)))


def usable(actions: DataFrame) -> DataFrame:
    """Actions with a date and a number."""
    return actions.where("date is not null and coalesce(factor, amount) is not null")


def skipped(actions: DataFrame) -> DataFrame:
    """(id, kind, n) of the others."""
    return actions.where("date is null or coalesce(factor, amount) is null").groupBy("id", "kind").agg(F.count("*").alias("n"))


def filing_index(payloads: DataFrame, cursors: DataFrame) -> DataFrame:
    """(id, form, filed, period, accn, document, cursor) of filings after each id's cursor (cursors: id, cursor); cursor is the new one."""
    r = payloads.select("id", F.from_json("payload", _INDEX)["filings"]["recent"].alias("r"))
    rows = _zip(**{c: (F.col(f"r.{c}"), "string") for c in ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")})
    x = r.select("id", F.explode(rows).alias("f")).join(cursors.select("id", F.col("cursor").alias("old")), "id", "left")
    x = x.where(filled(F.col("old")).isNull() | (F.col("f.filingDate") > F.col("old")))
    new = F.max("f.filingDate").over(Window.partitionBy("id"))
    return x.select("id", F.col("f.form").alias("form"), F.col("f.filingDate").alias("filed"), filled(F.col("f.reportDate")).alias("period"), F.col("f.accessionNumber").alias("accn"), F.col("f.primaryDocument").alias("document"), new.alias("cursor"))
