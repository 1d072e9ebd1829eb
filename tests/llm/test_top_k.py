from __future__ import annotations

import math
import random

import numpy as np

from ledgerlight.llm.top_k import Best, top_k


def every(rows, every, k):
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(1024 * c) for c in x]
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(24)]) for i in range(600)]
    rows += [(1000 + i, list(rows[5][1])) for i in range(30)]  # ties
    rows += [(700, None), (701, [float("nan")] * 24), (702, [None] * 24), (703, [float("inf")] * 24), (800, []), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    asfloat = [(i, x and [None if c is None else __import__("struct").unpack("f", __import__("struct").pack("f", c))[0] for c in x]) for i, x in rows]
    got = sorted(tuple(r) for r in top_k(df, 100, 10).collect())
    assert got == every(asfloat, 100, 10)


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 1024 * 3072 - 2048 * 1024)]
    assert top_k(df.limit(0)).count() == 0


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 64)).cumsum(axis=1)  # neighbouring components are alike, as segments want it
    x = np.floor(1024 * (centers[rng.integers(0, 40, 20_000)] + rng.normal(scale=0.05, size=(20_000, 64))))
    ids = np.arange(len(x))
    best = Best(ids[::100], x[::100], 10)
    for a in range(0, len(x), 5000):
        best.add(ids[a : a + 5000], x[a : a + 5000])
    row, vec, score = best.best()
    assert best.scored < 0.3 * best.seen
    for r in range(0, 200, 7):
        s = (x @ x[100 * r]).astype(np.int64)
        s[100 * r] = -(2**62)
        want = np.lexsort((ids, -s))[:10]
        assert vec[row == r].tolist() == want.tolist()
        assert score[row == r].tolist() == s[want].tolist()


def test_repeated_mixed_and_very_large(spark):
    big = 1e300
    rows = [(0, [1.0, 0.0]), (0, [0.5, 2.0]), (1, [big, big]), (2, [-big, 1.0]), (3, [3e10, 5e9]), (4, [1.0, 2.0, 3.0]), (100, [2.0, 1.0, 1.0]), (5, [3.0, 3.0]), (5, [3.0, 3.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())
    m = 2**63 - 1
    third = 512 * 30720000000000 + 2048 * 5120000000000
    assert got == [(0, 1, 1, m), (0, 2, 3, third), (0, 3, 5, 512 * 3072 + 2048 * 3072), (0, 4, 5, 512 * 3072 + 2048 * 3072), (0, 5, 2, -m - 1), (100, 1, 4, 1024 * 1024 * 7)]
