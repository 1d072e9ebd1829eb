"""Readers of filings, statements, deals and market data on small payloads with the traps of each."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from ledgerlight.sources import filings, market, raw, statements


def docs(spark, *payloads, kind=None):
    rows = [(f"d{i}", "i1", kind, p if isinstance(p, (str, type(None))) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "source_ref string, issuer_id string, doc_kind string, payload string")


REPORT = {"period_end": "2024-12-31", "filed_at": "2025-02-01", "facts": {
    "a": {"concept": "revenue", "value": "10.5", "unit": "USD", "period_start": "2024-01-01", "period_end": "2024-12-31"}, "b": {"concept": "revenue", "value": 9, "unit": "USD", "period_end": "2023-12-31", "period_type": "instant"},
    "c": {"concept": "", "value": "1", "period_end": "2024-12-31"}, "d": {"concept": "x", "value": "NaN", "period_end": "2024-12-31"}, "e": {"concept": "x", "value": "1"}, "f": {"concept": "x", "period_end": "2024-12-31"}}}


def test_report(spark):
    rows = filings.report_facts(docs(spark, REPORT, "{broken", None, {"facts": []}))
    got = sorted((r.concept, r.value, r.currency, r.period_start, r.period_type, r.basis) for r in filings.accepted(rows).collect())
    assert got == [("revenue", 9.0, "USD", "2023-12-31", "instant", "restated"), ("revenue", 10.5, "USD", "2024-01-01", "duration", "as_reported")]
    bad = {(r.source_ref, r.problem): r.n for r in filings.rejected(rows).collect()}
    assert bad == {("d0", "no_concept"): 1, ("d0", "non_finite"): 1, ("d0", "no_period"): 1, ("d0", "no_value"): 1, ("d1", "unreadable"): 1, ("d2", "unreadable"): 1, ("d3", "unreadable"): 1}


def test_table_inherits_periods(spark):
    doc = {"period_end": "2024-12-31", "tables": [
        {"unit": "EUR", "columns": [{"period_end": "2024-12-31", "period_start": "2024-01-01"}, {"period_end": "2023-12-31"}], "rows": [{"cells": [{"concept": "a", "value": 1}, {"concept": "a", "value": 2, "unit": "USD"}, {"concept": "b", "value": 3}]}]},
        {"period_end": "2022-12-31", "period_type": "duration", "rows": [{"cells": [{"concept": "c", "value": "4"}, {"value": "5"}]}]}]}
    rows = filings.table_facts(docs(spark, doc))
    got = sorted((r.concept, r.value, r.unit, r.period_start, r.period_end, r.period_type, r.basis, r.locator) for r in filings.accepted(rows).collect())
    assert got == [
        ("a", 1.0, "EUR", "2024-01-01", "2024-12-31", "instant", "as_reported", "table/0/0/0"), ("a", 2.0, "USD", "2023-12-31", "2023-12-31", "instant", "restated", "table/0/0/1"),
        ("b", 3.0, "EUR", "2024-12-31", "2024-12-31", "instant", "as_reported", "table/0/0/2"), ("c", 4.0, None, "2022-12-31", "2022-12-31", "duration", "restated", "table/1/0/0"),
    ]
    assert [r.problem for r in rows.where("problem is not null").collect()] == ["no_concept"]


def history(**tags):
    return {"facts": {t.split("__")[0].replace("_", "-"): {t.split("__")[1]: {"units": {"USD": entries}}} for t, entries in tags.items()}}


def e(end, val, accn, filed, start=None):
    return {"end": end, "val": val, "accn": accn, "filed": filed} | ({"start": start} if start else {})


def test_company_history(spark):
    first, again, later = e("2023-12-31", 5, "A", "2024-02-01", "2023-01-01"), e("2023-12-31", 5, "A2", "2024-03-01", "2023-01-01"), [e("2023-12-31", v, a, f, "2023-01-01") for v, a, f in ((6, "B", "2025-02-01"), (7, "C", "2026-02-01"))]
    own = [e("2024-12-31", 8, "B", "2025-02-01", "2024-01-01"), e("2025-12-31", 9, "C", "2026-02-01", "2025-01-01")]
    doc = history(us_gaap__Revenue=[again, first, *later, *own, {"val": 1}, e("2025-12-31", "inf", "C", "2026-02-01")], dei__Shares=[e("2024-02-15", 100, "A", "2024-02-01")], other__X=[first])
    rows = filings.company_facts(docs(spark, doc))
    got = sorted((r.concept, r.value, r.period_end, r.basis, r.superseded_by or "") for r in filings.accepted(rows).collect() if r.period_end == "2023-12-31")
    got = [(*g[:4], g[4] or None) for g in got]
    key = "/facts/us-gaap/Revenue/units/USD"
    assert got == [("us-gaap:Revenue", 5.0, "2023-12-31", "as_reported", None), ("us-gaap:Revenue", 5.0, "2023-12-31", "as_reported", f"{key}/1/val"), ("us-gaap:Revenue", 6.0, "2023-12-31", "restated", f"{key}/3/val"), ("us-gaap:Revenue", 7.0, "2023-12-31", "restated", None)]
    assert {r.concept for r in filings.accepted(rows).collect()} == {"us-gaap:Revenue", "dei:Shares"}
    assert sorted(r.problem for r in rows.where("problem is not null").collect()) == ["no_period", "non_finite"]
    assert {r.concept for r in filings.company_facts(docs(spark, history(other__X=[first]))).collect()} == {"other:X"}


def test_dispatch(spark):
    mixed = docs(spark, REPORT, kind="xbrl").union(docs(spark, "%PDF", kind="pdf")).union(docs(spark, "x"))
    got = filings.facts(mixed).groupBy(F.coalesce("problem", F.lit("fact")).alias("p")).count().collect()
    assert {r.p: r["count"] for r in got} == {"fact": 2, "no_concept": 1, "non_finite": 1, "no_period": 1, "no_value": 1, "unknown_kind": 2}


def test_statements(spark, tmp_path):
    head = "CD_CVM;DT_INI_EXERC;DT_FIM_EXERC;ORDEM_EXERC;CD_CONTA;VL_CONTA;VERSAO;ESCALA_MOEDA;MOEDA"
    body = ["1;2024-01-01;2024-12-31;ÚLTIMO;3.01;100;1;MIL;BRL", "1;2024-01-01;2024-12-31;ÚLTIMO;3.01;120.5;2;MIL;BRL", "1;2024-01-01;2024-12-31;ÚLTIMO;3.08;-4;1;UNID;BRL", "1;2024-01-01;2024-12-31;ÚLTIMO;3.08;x;1;UNID;BRL", "2;2024-01-01;2024-12-31;ÚLTIMO;3.08;0;1;UNID;BRL", "1;2024-01-01;2024-12-31;ÚLTIMO;3.02;1;1;ACRES;BRL", "1;;2024-12-31;ÚLTIMO;3.03;;1;MIL;BRL"]
    (tmp_path / "a.csv").write_bytes("\n".join([head, *body]).encode("latin-1"))
    rows = statements.statement_facts(statements.read_statements(spark, str(tmp_path)), flow=True)
    got = sorted((r.CD_CVM, r.concept, r.value, r.period_start, r.order) for r in filings.accepted(rows).collect())
    assert got == [("1", "cvm-dfp:3.01", 120500.0, "2024-01-01", "ÚLTIMO"), ("1", "cvm-dfp:3.08", 4.0, "2024-01-01", "ÚLTIMO"), ("2", "cvm-dfp:3.08", 0.0, "2024-01-01", "ÚLTIMO")]
    assert sorted(r.problem for r in rows.where("problem is not null").collect()) == ["no_value", "not_a_number", "unknown_scale"]


FORM = """<?xml version="1.0"?><ownershipDocument><documentType>4</documentType><periodOfReport>2024-05-01</periodOfReport><issuer><issuerCik>1</issuerCik></issuer>
<reportingOwner><reportingOwnerId><rptOwnerName>DOE JANE</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>0</isDirector><isOfficer>true</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-04-30</value></transactionDate><transactionAmounts><transactionShares><value>1,500</value><footnoteId id="F1"/></transactionShares><transactionPricePerShare><value>10.25</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionAmounts><transactionShares><value>7</value></transactionShares><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable>
<footnotes><footnote id="F1">Under a Rule 10b5-1 plan.</footnote></footnotes></ownershipDocument>"""


def test_deals(spark):
    d = docs(spark, FORM, FORM.replace("<ownershipDocument>", "<!DOCTYPE x><ownershipDocument>", 1), "<other/>", FORM[:-40], None).select("source_ref", "payload")
    got = {(r.source_ref, r.tx_index): r for r in statements.deals(d).collect()}
    assert [(r.insider, r.role, r.title, r.date, r.direction, r.shares, r.price, r.planned) for r in (got["d0", 0], got["d0", 1])] == [("DOE JANE", "officer", "CFO", "2024-04-30", "disposed", 1500.0, 10.25, True), ("DOE JANE", "officer", "CFO", "2024-05-01", "acquired", 7.0, None, False)]
    assert {k[0]: r.problem for k, r in got.items() if k[1] is None} == {"d1": "dtd", "d2": "not_ownership", "d3": "malformed", "d4": "not_ownership"}


def ids(spark, *payloads):
    return spark.createDataFrame([(i, json.dumps(p) if p is not None else None) for i, p in enumerate(payloads)], "id int, payload string")


def chart(**more):
    return {"chart": {"result": [{"meta": {"currency": "USD", "gmtoffset": -18000}, "timestamp": [86400, 90000, 172800, 259200 + 3600], "indicators": {"quote": [{"close": [1.0, 2.0, None, 4.0], "volume": [1, 2, 3, None]}], **more}, "events": {
        "splits": {"x": {"date": 172800, "numerator": 7, "denominator": 2}, "y": {"date": 172800, "numerator": 1, "denominator": 0}}, "dividends": {"z": {"date": 172800, "amount": 0.5}, "w": {"amount": 1}}}}]}}


def test_chart(spark):
    p = ids(spark, chart(), chart(adjclose=[{"adjclose": [0.5, 1.0, 1.5, 2.0]}]), None, {})
    got = sorted((r.id, r.date, r.close, r.adjusted or 0, r.volume or 0) for r in market.chart_prices(p).collect())
    assert got == [(0, date(1970, 1, 1), 2.0, 0, 2), (0, date(1970, 1, 3), 4.0, 0, 0), (1, date(1970, 1, 1), 2.0, 1.0, 2), (1, date(1970, 1, 3), 4.0, 2.0, 0)]
    a = market.chart_actions(ids(spark, chart()))
    assert sorted((r.kind, r.date, r.factor, r.amount, r.currency) for r in market.usable(a).collect()) == [("dividend", date(1970, 1, 2), None, 0.5, "USD"), ("split", date(1970, 1, 2), 3.5, None, "USD")]
    assert {(r.kind, r.n) for r in market.skipped(a).collect()} == {("split", 1), ("dividend", 1)}


def test_series(spark):
    p = ids(spark, {"meta": {"currency": "USD"}, "values": [{"datetime": "2024-01-03", "close": "3.5", "volume": "10"}, {"datetime": "2024-01-02", "close": ""}]})
    assert [tuple(r) for r in market.series_prices(p).collect()] == [(0, date(2024, 1, 3), 3.5, None, 10, "USD")]
    a = market.series_actions(ids(spark, {"splits": [{"date": "2014-06-09", "from_factor": 7, "to_factor": 1, "ratio": 0.14286}, {"date": "2014-06-09", "from_factor": 7, "to_factor": 0}], "dividends": [{"ex_date": "2024-02-09", "amount": 0.24}, {"amount": 1}]}))
    assert sorted((r.kind, r.date, r.factor or r.amount) for r in market.usable(a).collect()) == [("dividend", date(2024, 2, 9), 0.24), ("split", date(2014, 6, 9), 7.0)]
    assert {(r.kind, r.n) for r in market.skipped(a).collect()} == {("split", 1), ("dividend", 1)}


def test_filing_index(spark):
    recent = {"form": ["10-K", "8-K", "4"], "accessionNumber": ["a", "b", "c"], "filingDate": ["2025-02-01", "2025-03-01", "2025-01-01"], "reportDate": ["2024-12-31", "", ""], "primaryDocument": ["x", "y", "z"]}
    p = ids(spark, {"cik": "1", "filings": {"recent": recent}}, {"cik": "2", "filings": {"recent": recent}})
    got = market.filing_index(p, spark.createDataFrame([(0, "2025-02-01")], "id int, cursor string")).collect()
    assert sorted((r.id, r.form, r.period, r.cursor) for r in got) == [(0, "8-K", None, "2025-03-01"), (1, "10-K", "2024-12-31", "2025-03-01"), (1, "4", None, "2025-03-01"), (1, "8-K", None, "2025-03-01")]


def test_raw_objects(spark, tmp_path):
    for name, text in (("a.json", "{}"), ("b.json", "{}"), ("c.html", "<p>x</p>"), ("d.csv", "a;b"), ("e", "%PDF-1.7"), ("f.txt", "plain")):
        (tmp_path / name).write_text(text)
    got = raw.objects(spark, str(tmp_path)).select("sha256", "kind", "size").collect()
    assert sorted(r.kind for r in got) == ["csv", "html", "json", "pdf", "txt"]
    stored = raw.objects(spark, str(tmp_path)).where("kind = 'json'")
    assert raw.unstored(raw.objects(spark, str(tmp_path)), stored).count() == 4
    assert raw.unreferenced(stored, spark.createDataFrame([("zz",)], "source_ref string")).count() == 1
