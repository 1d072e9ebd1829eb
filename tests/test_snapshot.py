"""Windows, borders, refusals, lineage and percentiles of snapshots on facts made by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import borders
from ledgerlight.operators import snapshot as S

DAY = dt.date


def quarter(y, q):
    start = DAY(y, 3 * q - 2, 1)
    return start, (DAY(y + q // 4, 3 * q % 12 + 1, 1) - dt.timedelta(1))


def flows():
    """1: quarters of all flows; 2: net income by quarters, revenue by years only; 3: a year, the year to date and that of the year before; 4: one quarter."""
    out = []
    for i, (y, q) in enumerate([(2022, 1), (2022, 2), (2022, 3), (2022, 4), (2023, 1)]):
        out += [(1, c, *quarter(y, q), v + i, "USD") for c, v in (("revenue", 100.0), ("cogs", 60.0), ("net_income", 10.0), ("operating_income", 20.0), ("tax_expense", 5.0), ("pretax_income", 18.0))]
        out.append((2, "net_income", *quarter(y, q), 7.0, "USD"))
    out += [(2, c, DAY(y, 1, 1), DAY(y, 12, 31), v, "USD") for y in (2021, 2022) for c, v in (("revenue", 400.0 + y), ("net_income", 29.0))]
    out += [(3, "revenue", DAY(2022, 1, 1), DAY(2022, 12, 31), 1000.0, "EUR"), (3, "revenue", DAY(2023, 1, 1), DAY(2023, 3, 31), 300.0, "EUR"), (3, "revenue", DAY(2022, 1, 1), DAY(2022, 3, 31), 200.0, "EUR")]
    out += [(4, "net_income", *quarter(2023, 1), 1.0, "USD"), (4, "revenue", *quarter(2022, 4), 9.0, "USD")]
    return out


def stocks():
    e = "total_equity"
    return [
        (1, e, DAY(2023, 3, 31), 200.0, "as_reported"), (1, e, DAY(2022, 4, 1), 150.0, "restated"), (1, e, DAY(2022, 3, 31), 100.0, "as_reported"), (1, "total_assets", DAY(2022, 12, 31), 900.0, "as_reported"),
        (2, e, DAY(2023, 3, 31), 50.0, "restated"), (2, e, DAY(2022, 2, 1), 40.0, "as_reported"), (2, e, DAY(2022, 2, 1), 41.0, "restated"), (2, e, DAY(2023, 1, 1), 45.0, "as_reported"),
        (3, "total_assets", DAY(2023, 3, 31), 500.0, "as_reported"), (3, "cash", DAY(2019, 1, 1), 5.0, "as_reported"), (4, e, DAY(2023, 3, 31), 9.0, "as_reported"),
    ]


@pytest.fixture(scope="module")
def wide(spark):
    f = spark.createDataFrame(flows(), "issuer long, concept string, start date, end date, value double, unit string")
    s = spark.createDataFrame(stocks(), "issuer long, concept string, end date, value double, basis string").withColumn("unit", F.lit("USD"))
    i = spark.createDataFrame([(k, k, False, False, None, "USD") for k in (1, 2, 3, 4)], "issuer long, id long, bank boolean, ifrs boolean, ads_ratio double, home string")
    p = spark.createDataFrame([(1, DAY(2023, 4, 2), 10.0, "USD")], "id long, date date, close double, currency string")
    a = spark.createDataFrame([], "id long, date date, kind string, amount double, currency string")
    t = spark.createDataFrame([(k, d) for k in (1, 2, 3, 4) for d in (DAY(2023, 4, 4), DAY(2023, 1, 15))] + [(1, DAY(2020, 1, 1))], "issuer long, at date")
    return S.evaluated(S.inputs(f, s, i, p, a, t)).cache()


@pytest.fixture(scope="module")
def measures(wide):
    return {(r.issuer, str(r["at"]), r.concept): r for r in S.rows_of(wide).collect()}


def value(m, *key):
    return m[key].value, m[key].null_reason


def test_every_measure_has_a_value_or_a_reason(measures):
    assert len(measures) == 9 * len(S.MEASURES)
    assert all((r.value is None) != (r.null_reason is None) for r in measures.values())


def test_windows_follow_the_date(measures):
    late, early = (1, "2023-04-04", "gross_margin"), (1, "2023-01-15", "gross_margin")
    assert measures[late].value == pytest.approx(160 / (101 + 102 + 103 + 104)) and (measures[late].period_start, measures[late].period_end, measures[late].basis) == (DAY(2022, 4, 1), DAY(2023, 3, 31), "ttm")
    assert measures[early].value == pytest.approx(160 / (100 + 101 + 102 + 103)) and measures[early].period_end == DAY(2022, 12, 31)
    assert value(measures, 1, "2020-01-01", "net_margin") == (None, "missing_data: net_income, revenue")


def test_inputs_of_other_windows_fall_back_to_a_common_year(measures):
    # four quarters of net income up to March, but revenue by years: both are filed for 2022
    r = measures[2, "2023-04-04", "net_margin"]
    assert r.value == pytest.approx(29 / 2422) and (r.period_start, r.period_end, r.basis) == (DAY(2022, 1, 1), DAY(2022, 12, 31), "annual_fallback")
    assert value(measures, 4, "2023-04-04", "net_margin") == (None, "period_mismatch")


def test_balances_stand_exactly_at_the_borders(measures):
    # window 2022-04-01 to 2023-03-31: the newest not after the start is restated
    assert measures[1, "2023-04-04", "roe"].value == pytest.approx((11 + 12 + 13 + 14) / ((150 + 200) / 2))
    # at the end a restated balance only, at the start a reported one before a restated one of its date
    assert measures[2, "2023-04-04", "roe"].value == pytest.approx(28 / ((40 + 50) / 2))
    # no balance at the window's end
    assert value(measures, 1, "2023-04-04", "asset_turnover") == (None, "period_mismatch")
    assert value(measures, 3, "2023-04-04", "asset_turnover") == (None, "period_mismatch")
    assert value(measures, 3, "2023-04-04", "roe") == (None, "missing_data: net_income, total_equity")


def test_stale_inputs_are_named(measures):
    assert value(measures, 3, "2023-04-04", "net_debt") == (None, "stale_data: cash: last 2019-01-01; missing_data: st_investments, total_debt")


def test_lineage_has_the_parts_of_a_window_with_signs(wide, measures):
    lines = S.lineage(wide)
    of = lambda i, m: sorted((r.kind, r.source, r.role, str(r.period_start), str(r.period_end), r.sign) for r in lines.where((F.col("issuer") == i) & (F.col("concept") == m) & (F.col("at") == "2023-04-04")).collect())
    assert ("measure", "gross_profit", "feeds", "None", "2023-04-04", 1) in of(1, "gross_margin") and len(of(1, "gross_margin")) == 9
    assert [x[1:5] for x in of(1, "roe") if x[1] == "total_equity"] == [("total_equity", "begin", "2022-04-01", "2022-04-01"), ("total_equity", "end", "2023-03-31", "2023-03-31")]
    assert {x[1] for x in of(1, "nopat")} == {"operating_income", "tax_expense", "pretax_income", "effective_tax"}
    assert S.unexplained(S.rows_of(wide), lines).count() == 0


def test_window_of_a_year_and_parts(spark):
    f = spark.createDataFrame(flows(), "issuer long, concept string, start date, end date, value double, unit string").where("issuer = 3")
    t = spark.createDataFrame([(3, DAY(2023, 4, 4), DAY(2023, 3, 31), "EUR")], "issuer long, at date, anchor date, home string")
    (r,) = borders.trailing_years(f, t).collect()
    assert (r.w.value, r.w.start, r.w.end) == (1100.0, DAY(2022, 4, 1), DAY(2023, 3, 31))
    assert sorted((p.sign, p.start, p.end) for p in r.w.parts) == [(-1, DAY(2022, 1, 1), DAY(2022, 3, 31)), (1, DAY(2022, 1, 1), DAY(2022, 12, 31)), (1, DAY(2023, 1, 1), DAY(2023, 3, 31))]


def test_only_what_is_asked_for(wide):
    assert S.needed(["ev_ebitda"]) == {"ev_ebitda", "ev", "ebitda", "market_cap_total", "market_cap"}


def test_percentiles_of_a_snapshot(spark):
    at = DAY(2023, 1, 1)
    rows = spark.createDataFrame([(i, at, "pe", float(v), None) for i, v in enumerate([1, 2, 2, 3, 4, 5, 6])] + [(9, at, "pe", None, "loss"), (10, at, "pb", 1.0, None)], "issuer long, at date, concept string, value double, null_reason string")
    peers = spark.createDataFrame([(i, "x") for i in range(11)], "issuer long, peer_group string")
    got = {(r.issuer, r.concept): (r.n, r.percentile, r.reason) for r in S.percentiles(rows, peers).collect()}
    assert got[1, "pe"] == got[2, "pe"] == (6, pytest.approx(1 / 6), None) and got[6, "pe"] == (6, 1.0, None)
    assert got[9, "pe"] == (0, None, "loss") and got[10, "pb"] == (0, None, "peer_set_too_small")
