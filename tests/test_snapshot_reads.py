"""What a snapshot reads of long histories: two common periods of a recipe, and one close of an issuer and date."""

from __future__ import annotations

import datetime as dt

from ledgerlight.operators import borders
from ledgerlight.plans import snapshots

d = dt.date.fromisoformat


def test_common_periods_at_dates(spark):
    year, half = ("2020-01-01", "2020-12-31"), ("2021-01-01", "2021-06-30")
    spans = [("2019-01-01", "2019-12-31"), year, half, ("2021-07-01", "2021-12-31")]
    rows = [(1, c, d(s), d(e), v + i, u) for i, (s, e) in enumerate(spans) for c, v in (("a", 10.0), ("b", 20.0)) for u in ("EUR", "USD") if not (c == "b" and i == 3)]
    facts = spark.createDataFrame(rows, "issuer int, concept string, start date, end date, value double, unit string")
    targets = spark.createDataFrame([(1, d("2021-12-31"), d("2021-12-31")), (1, d("2020-12-31"), d("2020-12-31")), (1, d("2030-12-31"), d("2030-12-31"))], "issuer int, at date, anchor date")
    got = {str(r.at): r.common for r in borders.common_periods(facts, {"both": ("a", "b"), "none": ("a", "z")}, targets).collect()}
    cut = lambda at: [(str(p["start"]), str(p["end"]), p["unit"], p["annual"], p["values"]) for p in got[at]["both"]]
    assert cut("2021-12-31") == [(*year, "EUR", True, {"a": 11.0, "b": 21.0}), (*half, "EUR", False, {"a": 12.0, "b": 22.0})]
    assert {x[:2] for x in cut("2020-12-31")} == {year} and cut("2030-12-31") == [] and got["2021-12-31"]["none"] == []


def test_closes_of_the_newest_days_only(spark):
    path = "/root/testdata/sf0.001"
    dates = ("1995-06-30", "2001-09-30")
    got = {(r.id, r.date): r.close for r in snapshots._daily_prices(spark, path, dates).collect()}
    every = {(r.issuer, r.date): r.close for r in snapshots._daily(spark, path).collect()}
    want = {(i, max(x for j, x in every if j == i and x <= d(at))) for at in dates for i in {j for j, x in every if x <= d(at)}}
    assert set(got) == want and all(every[k] == v for k, v in got.items())
