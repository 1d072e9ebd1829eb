"""Exports, table writes, capital and versioned sets by hand-worked values."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.operators import capital, prices, versions
from ledgerlight.sinks import exports, tables

M = "snapshot_id string, measure_id string, scope string, scope_ref string, concept string, value double, unit string, period_start string, period_end string, method_version string, null_reason string"
MEASURES = [("s1", "m2", "issuer", "i", "roe", None, None, None, None, "1", "denominator_zero"), ("s1", "m1", "issuer", "i", "pe", 2.5, "pure", "2024-01-01", "2024-12-31", "1", None), ("s1", "m3", "issuer", "i", "zz", None, None, None, None, "1", "missing_data: a, b")]
L = "measure_id string, fact_id string, concept string, status string, source_kind string, source_ref string, locator string, period_end string"


def test_exports(spark):
    m = spark.createDataFrame(MEASURES, M)
    lin = spark.createDataFrame([("m1", "f1", "x", "ok", None, "abcdefabcdefabcd", None, "2024-12-31"), ("m1", "f2", "y", "ok", "manual", "sha", "p#page=7", None)], L)
    doc = json.loads(exports.to_json(m, "v1", lin).first().text)
    assert [x["concept"] for x in doc["measures"]] == ["pe", "roe", "zz"]
    assert doc["measures"][0]["provenance"]["source_kind"] == "manual"
    assert [f["page"] for f in doc["measures"][0]["provenance"]["facts"]] == [None, 7]
    assert doc["measures"][1]["value"] is None
    assert doc["measures"][1]["null_reason"] == "denominator_zero"
    lines = exports.to_csv(m, "v1").first().text.splitlines()
    assert lines[0] == "concept_map_version,v1"
    assert lines[2:] == ["issuer,i,pe,2.5,pure,2024-01-01,2024-12-31,1,", "issuer,i,roe,,,,,1,denominator_zero", 'issuer,i,zz,,,,,1,"missing_data: a, b"']
    md = exports.to_markdown(m, "v1").first().text
    assert "| pe | 2.5 | pure | 2024-01-01 | 2024-12-31 |\n| roe | — [1] |  |  |  |\n| zz | — [2] |" in md
    assert md.endswith("- [1] roe: denominator_zero\n- [2] zz: missing_data: a, b\n")
    assert exports.source_cells(lin).first().source == "manual:sha@; provider:abcdefabcdef@2024-12-31"


def test_tables(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert [tuple(r) for r in tables.inserted(s, n, ["k"]).collect()] == [(3, "d")]
    assert sorted(map(tuple, tables.replaced(s, n, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d"), (3, "d")]
    assert sorted(map(tuple, tables.upserted(s, n, ["k"], "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    m = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, None), ("c", None, None), ("d", None, "odd"), ("e", None, "missing_data: x"), ("f", 1.0, "non_finite")], "measure_id string, value double, null_reason string")
    got = tables.checked(m, spark.createDataFrame([("a",), ("f",)], "measure_id string")).collect()
    assert {r.measure_id: r.problem for r in got} == {"a": None, "b": "no_lineage", "c": "no_reason", "d": "unknown_reason", "e": None, "f": "value_and_reason"}


def d(t):
    return date.fromisoformat(t)


def test_border(spark):
    b = spark.createDataFrame([(1, d("2024-01-01")), (1, d("2024-07-01"))], "issuer int, border date")
    s = spark.createDataFrame([(1, "cash", d(t), v, r, k) for t, v, r, k in (("2023-12-31", 1.0, 0, "as_reported"), ("2024-01-02", 2.0, 1, "as_reported"), ("2024-01-01", 3.0, 0, "restated"), ("2024-06-20", 4.0, 0, "as_reported"), ("2024-07-11", 5.0, 0, "restated"))], "issuer int, concept string, end date, value double, rank int, basis string")
    assert sorted((r.border, r.value, r.gap) for r in capital.at_border(b, s).collect()) == [(d("2024-01-01"), 1.0, 1), (d("2024-07-01"), 5.0, 10)]


def test_border_meets_all_near(spark):
    days = [date.fromordinal(738000 + i) for i in range(80)]
    for i in range(0, 80, 7):
        b = spark.createDataFrame([(1, x) for x in days], "issuer int, border date")
        s = spark.createDataFrame([(1, "c", days[i], 1.0, 0, "as_reported")], "issuer int, concept string, end date, value double, rank int, basis string")
        if i % 21 == 0:
            assert capital.at_border(b, s).count() == sum(abs((x - days[i]).days) <= 10 for x in days)


def test_debt_and_equity(spark):
    (a, b), (c, e) = capital.DEBT_PAIRS
    f = spark.createDataFrame([(1, "t", "USD", a, "1", 5.0), (1, "t", "USD", b, "1", 2.0), (1, "t", "USD", b, "2", 3.0), (2, "t", "USD", a, "1", 5.0), (2, "t", "USD", c, "1", 7.0), (2, "t", "USD", e, "1", 1.0), (3, "t", "USD", c, "1", 1.0), (4, "t", "USD", "us-gaap:CommercialPaper", "1", 2.0)], "issuer int, end string, unit string, concept string, filed string, value double")
    assert sorted((r.issuer, r.total, r.pair) for r in capital.debt(f).collect()) == [(1, 8.0, 1), (2, 8.0, 2)]
    lt = spark.createDataFrame([(4, "t", capital.LONG_TERM, 10.0), (1, "t", "x", 1.0)], "issuer int, end string, tag string, value double")
    assert sorted((r.issuer, r.value) for r in capital.with_short_term(lt, f).collect()) == [(1, 1.0), (4, 12.0)]
    q = "issuer int, unit string, end string, value double"
    eq = spark.createDataFrame([(1, "USD", "t", 9.0)], q)
    incl = spark.createDataFrame([(i, "USD", "t", 10.0) for i in (1, 2, 3, 4)], q)
    got = capital.parent_equity(eq, incl, spark.createDataFrame([(2, "USD", "t", 1.5)], q), spark.createDataFrame([(3,)], "issuer int"))
    assert sorted((r.issuer, r.value, r.identity) for r in got.collect()) == [(1, 9.0, False), (2, 8.5, True), (3, 10.0, True)]


def test_year_change_and_dividends(spark):
    p = spark.createDataFrame([(1, d("2023-01-02"), 10.0, 5.0), (1, d("2024-01-05"), 12.0, 12.0), (2, d("2022-01-01"), 1.0, None), (2, d("2024-01-05"), 2.0, None)], "id int, date date, close double, adjusted double")
    assert sorted((r.id, r.change) for r in prices.year_change(p, 365).collect() if r.change is not None) == [(1, 12.0 / 5.0 - 1)]
    ins = spark.createDataFrame([(i, "USD") for i in (1, 2, 3, 4, 5)], "id int, currency string")
    v = "id int, value double, end date, currency string"
    acts = spark.createDataFrame([(i, d("2024-06-01"), "dividend", 0.5, c) for i, c in ((1, "USD"), (2, "USD"), (2, "USD"), (3, "EUR"))], "id int, date date, kind string, amount double, currency string")
    win = spark.createDataFrame([(3, 7.0, d("2024-03-31"), "USD"), (4, 8.0, d("2020-12-31"), "USD")], v)
    got = prices.dividends_per_share(ins, spark.createDataFrame([(1, 3.0, d("2024-03-31"), "USD")], v), acts, win, "2024-12-31").collect()
    assert {r.id: (r.dps, r.source, r.reason) for r in got} == {1: (3.0, "filed", None), 2: (1.0, "actions", None), 3: (7.0, "window", None), 4: (None, None, "stale_data: dps: last 2020-12-31"), 5: (None, None, "missing_data: dps_ttm")}


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, d("2024-01-01"), None, ["x", "y"]), ("b", 1, d("2024-01-01"), None, ["x"])], "set_id string, version int, valid_from date, valid_to date, members array<string>")
    w = spark.createDataFrame([("a", ["y", "x", "x"]), ("b", ["z"]), ("c", ["q"]), ("d", [])], "set_id string, members array<string>")
    got = sorted((r.set_id, r.version, r.valid_to, r.members) for r in versions.set_members(v, w, "2024-06-01").collect())
    assert got == [("a", 1, None, ["x", "y"]), ("b", 1, d("2024-06-01"), ["x"]), ("b", 2, None, ["z"]), ("c", 1, None, ["q"])]
    m = spark.createDataFrame([("l", 1, "x"), ("l", 2, "x"), ("l", 2, "y"), ("k", 1, "z")], "list_id string, version int, member string")
    pair = lambda *r: spark.createDataFrame(list(r), "list_id string, member string")
    assert sorted(map(tuple, versions.next_version(m, pair(("l", "w"), ("l", "y")), pair(("l", "x"))).collect())) == [("l", 3, "w"), ("l", 3, "y")]
    assert [tuple(r) for r in versions.rolled_back(m, spark.createDataFrame([("l", 1)], "list_id string, version int")).collect()] == [("l", 3, "x")]
    c = spark.createDataFrame([(1, "llm_summary", "ready", None), (1, "prices", "ready", None), (2, "llm_summary", "ready", None)], "id int, block string, status string, reason string")
    hit = versions.cascade(c, spark.createDataFrame([(1, "fundamentals")], "id int, block string")).where("status = 'stale'").collect()
    assert [tuple(r) for r in hit] == [(1, "llm_summary", "stale", "cascade:after_fundamentals")]


def test_quotes(spark):
    rows = [("1234", "sales of 1 234 units", "Our sales of 1 234 units."), ("42", "at 142", "at 142"), ("1,234", "about 1.234", "about 1.234"), ("5", "five", "five"), ("5", "", "5"), ("7", "x 7", None), ("-3,5", "3.5", "3.5")]
    df = spark.createDataFrame(rows, "v string, q string, p string")
    got = [r.s for r in df.select(T.quote_status(F.col("v"), F.col("q"), F.col("p")).alias("s")).collect()]
    assert got == ["verified", "near_miss", "near_miss", "failed", "failed", "failed", "failed"]
