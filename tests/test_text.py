"""Scalars of text on sentences made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import text as T

RATIOS = [
    ("American Depositary Shares, each representing two ordinary shares, par value $1", 2.0),
    ("Each ADS represents 0.5 of one ordinary share.", 0.5),
    ("ADSs (each representative of ten Class A shares) trade in New York", 10.0),
    ("each American Depositary Share representing one hundred H shares", 100.0),
    ("The ADRs were listed in 1999. Each share represents one vote.", None),
    ("Each ADR represents twenty-five shares; ADSs, each representing 3 shares", 3.0),
    ("ADSs, each of which in turn is held, each representing 1,000 shares", 1.0),
    ("each ADS represents 0 shares", None),
    ("each ADS represents 5000 shares", None),
    ("each ADS represents four shares", 4.0),
    ("each holder of an ADS represents six shares", None),
    ("each ADS representative of six shares", None),
    ("ADSs, each representative six shares", None),
    ("An ADS is a receipt. Shares, each representing six votes", None),
    ("", None),
    (None, None),
]


def test_ads_ratio(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RATIOS)], "i int, t string").select("i", T.ads_ratio(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: x for i, (_, x) in enumerate(RATIOS)}


def test_tickers(spark):
    rows = [("Buy AAPL, BRK.B and I; A BF.BXYZ V2X TOOLONGX 3M aAPL AAPL", ["AAPL", "BRK.B", "BF", "BXYZ", "V2X"]), ("none", [])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(T.tickers(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [x for _, x in rows]


@pytest.mark.parametrize(("answer", "ok"), [("10 and 10", False), ("10 and 1250,5", True), ("", True), ("no number", True), ("7", False)])
def test_number_guard(spark, answer, ok):
    row = spark.createDataFrame([(answer, ["10", "1250.5"])], "a string, x array<string>").select(T.number_guard(F.col("a"), F.col("x")).alias("g")).first().g
    assert row.ok is ok and (row.citations is not None) is ok


def test_large_files_have_a_row(spark, tmp_path):
    from ledgerlight.sources import raw

    for name, data in (("a.txt", b"same"), ("b.txt", b"same"), ("c.csv", b"x;y"), ("d.bin", b"12345678901")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r for r in raw.objects(spark, str(tmp_path), 10).collect()}
    assert sorted(got) == ["a.txt", "c.csv", "d.bin"]
    assert got["d.bin"].reason == "too_large: 11" and got["d.bin"].content is None and got["c.csv"].kind == "csv" and got["a.txt"].size == 4
    assert sorted(r.path[-5:] for r in raw.unstored(raw.objects(spark, str(tmp_path), 10), spark.createDataFrame([(got["a.txt"].sha256,)], "sha256 string")).collect()) == ["c.csv"]
