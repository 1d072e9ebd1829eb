"""Values worked out by hand."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerlight.functions import reasons as R
from ledgerlight.operators import groups, periods, prices


def test_quartiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 10)] + [("b", float(i)) for i in range(1, 9)] + [("c", 1.0), ("c", None)], "g string, value double")
    got = {r.g: (r.p25, r.median, r.p75, r.n, r.no_value, r.reason) for r in groups.quartiles(df, "g").collect()}
    assert got == {"a": (3.0, 5.0, 7.0, 9, 0, None), "b": (2.75, 4.5, 6.25, 8, 0, None), "c": (None, None, None, 0, 1, "peer_set_too_small")}


def test_ratio_reasons(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (None, 2.0), (float("nan"), 1.0), (1e308, 1e-10)], "a double, b double")
    got = [tuple(r.m) for r in df.select(R.ratio(a=F.col("a"), b=F.col("b")).alias("m")).collect()]
    assert got == [(0.5, None), (None, "denominator_zero"), (None, "negative_denominator"), (None, "missing_data: a"), (None, "non_finite"), (None, "non_finite")]


def test_trailing_year_of_four_quarters(spark):
    ends = [(date(2024, 1, 1), date(2024, 3, 31)), (date(2024, 4, 1), date(2024, 6, 30)), (date(2024, 7, 1), date(2024, 9, 30)), (date(2024, 10, 1), date(2024, 12, 31))]
    df = spark.createDataFrame([(1, "ni", s, e, v) for (s, e), v in zip(ends, (110.0, 90.0, 100.0, 100.0), strict=True)], "issuer int, concept string, start date, end date, value double")
    assert [(r.value, r.start, r.basis) for r in periods.trailing_year(df, "2024-12-31").collect()] == [(400.0, date(2024, 1, 1), "ttm")]
    assert periods.trailing_year(df.where("value <> 90"), "2024-12-31").count() == 0


def test_split_and_drawdown(spark):
    p = spark.createDataFrame([(1, date(2024, 1, d), c) for d, c in ((1, 100.0), (2, 80.0), (3, 45.0))], "id int, date date, close double")
    a = spark.createDataFrame([(1, date(2024, 1, 3), "split", 2.0)], "id int, date date, kind string, amount double")
    assert [r.price_adj for r in prices.adjusted(p, a).orderBy("date").collect()] == [50.0, 40.0, 45.0]
    assert tuple(prices.returns(p).first()) == (1, 3, 0.45 - 1, 0.45 - 1)
