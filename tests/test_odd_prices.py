"""Queries over prices of zero, and over values half way between two roundings, against their SQL."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from ledgerlight.plans import catalog


@pytest.fixture
def same(spark, tmp_path):
    """same(query, events): its rows, after a check that its SQL gives the very same ones; events are (user, day, type, value)."""

    def check(name, events):
        rows = [(i, dt.datetime(2024, 1, day, 12), user, kind, float(v)) for i, (user, day, kind, v) in enumerate(events)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        got = sorted(repr(tuple(r)) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect())
        assert got == sorted(map(repr, want.fetchall()))
        return got

    return check


def test_year_change_of_zero(same):
    got = same("year_change", [(1, 10, "view", 0), (1, 25, "view", 40.15), (2, 10, "view", 3), (2, 25, "view", 0), (3, 10, "view", 0), (3, 25, "view", 0), (4, 10, "view", 32), (4, 25, "view", 32.01)])
    assert sum("inf" in r for r in got) == 1 and sum("nan" in r for r in got) == 1 and sum("-1.0" in r for r in got) == 1


#: 64.85 / 32 is half way between two roundings; a dividend after a close of 0, and one of 0.
ADJUSTED = [(1, 21, "view", 64.85), *((1, x, "signup", 9) for x in range(22, 27)), (2, 1, "view", 7), (2, 2, "view", 0), (2, 3, "purchase", 5), (3, 1, "view", 0), (3, 2, "purchase", 0), (4, 3, "view", 102.49), (4, 5, "signup", 1)]


def test_adjusted_at_halves_and_zeros(same):
    got = same("price_adj_suffix_product", ADJUSTED)
    assert any("2.026562)" in r for r in got) and any("-inf" in r for r in got) and any("nan" in r for r in got)


def test_measures_of_a_window_with_zeros(same):
    ends = [(u, x, "view", v) for u in (1, 2, 3) for x, v in ((6, 10), (24, 12))]
    got = same("price_measures_window", [*ends, (1, 10, "view", 0), (1, 11, "purchase", 5), (2, 5, "view", 0), (4, 5, "view", 0), (4, 25, "view", 0)])
    assert any("(2, inf, None, 'missing_data: nonpositive_price')" in r for r in got) and len(got) == 4


def test_returns_from_zero(same):
    got = same("total_return_drawdown", [(1, 1, "view", 0), (1, 2, "view", 5), (1, 3, "view", 4), (2, 1, "view", 0), (2, 2, "view", 0), (3, 1, "view", 32), (3, 2, "view", 32.01)])
    assert any("inf" in r for r in got) and any("nan" in r for r in got)


def test_disagreement_at_halves_and_zeros(same):
    got = same("vendor_disagreement", ADJUSTED)
    assert any("2.026562" in r for r in got) and not any("inf" in r or "nan" in r for r in got)
