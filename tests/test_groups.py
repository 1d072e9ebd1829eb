"""Ranks in two levels against plain sorting, with one group that holds most rows and many ties."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import groups


def data():
    rng = random.Random(8)
    rows = [("hot", i, float(rng.randrange(900))) for i in range(4000)] + [("one", 1, 1.0), ("none", 1, None), ("none", 2, None)]
    rows += [(g, i, rng.random()) for g in "abc" for i in range(5, 15 + ord(g) - 90)] + [("hot", 9000 + i, 7.0) for i in range(2000)] + [(None, i, float(i)) for i in range(9)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(data(), "g string, m long, value double").repartition(6)


def of(g):
    return [v for k, _, v in data() if k == g and v is not None]


def test_quartiles(frame):
    got = {r.g: r for r in groups.quartiles(frame, "g").collect()}
    for g in ("hot", "a", "b", "c"):
        assert [got[g].p25, got[g].median, got[g].p75] == pytest.approx(list(np.percentile(of(g), [25, 50, 75])))
        assert got[g].n == len(of(g)) and got[g].reason is None
    assert (got["one"].p25, got["one"].n, got["one"].reason) == (None, 0, "peer_set_too_small") and got["none"].no_value == 2


def test_percentile(frame):
    got = {(r.g, r.m): r for r in groups.percentile_below(frame, "g", "m").collect()}
    values = of("hot")
    for k, m, v in data():
        if k == "hot":
            assert got[k, m].n == len(values) - 1
    some = [(m, v) for k, m, v in data() if k == "hot"][::97]
    assert [got["hot", m].percentile for m, _ in some] == pytest.approx([sum(x < v for x in values) / (len(values) - 1) for _, v in some])
    assert ("one", 1) not in got


def test_a_hot_group_is_spread(frame):
    r = groups.ranked(frame.withColumn("value", F.col("value") + F.rand(3)), "g", "value")
    parts = r.where("g = 'hot'").select(F.max("_below").alias("m"), F.count("*").alias("n")).first()
    assert parts.m == parts.n - 1 == 5999
