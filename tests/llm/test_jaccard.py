from __future__ import annotations

import numpy as np
import random

import brute
import pytest

from ledgerlight.llm.ngram_jaccard import jaccard_components


def result(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, num):
    docs = brute.odd_documents()
    df = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, component_id int, n long").repartition(5)
    assert result(jaccard_components(df, k, num, 100)) == brute.jaccard(docs, k, num, 100)


def test_links_at_the_threshold_and_long_lists(spark):
    rng = random.Random(2)
    docs = []
    for g in range(4):
        base = brute.prose(rng, 120, 10**6)
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert result(jaccard_components(df, 4, 85, 100)) == brute.jaccard(docs, 4, 85, 100)


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]


def test_pairs_between_components_in_bounded_memory():
    """The nearest pairs of each two components, by blocks that are pruned all the time, against all pairs at once."""
    from ledgerlight.llm import ngram_jaccard as J

    rng = np.random.default_rng(6)
    e = np.zeros(60, J._ENTRY)
    e["id"], e["n"], e["group"], e["comp"] = np.arange(60), 40, np.arange(60), rng.integers(0, 7, 60)
    e["bits"] = rng.integers(0, 4, (60, J.BITS // 64)).astype(np.uint64)
    one = J._List(e, 80, 100)
    want = {}
    for v in range(60):
        near = one.bound(v)
        for u in range(v):
            if near[u] < np.inf and e["comp"][u] != e["comp"][v]:
                want.setdefault(tuple(sorted((int(e["comp"][u]), int(e["comp"][v])))), []).append(near[u])
    was, J.HELD = J.HELD, 5
    try:
        got = {}
        for v, u, more in one.between(3):
            for x, y, m in zip(v.tolist(), u.tolist(), more.tolist(), strict=True):
                got.setdefault(tuple(sorted((int(e["comp"][x]), int(e["comp"][y])))), []).append((one.bound(x)[y], m))
    finally:
        J.HELD = was
    assert {k: sorted(d for d, _ in x) for k, x in got.items()} == {k: sorted(x)[:3] for k, x in want.items()}
    assert {k: x[0][1] for k, x in got.items()} == {k: len(x) > 3 for k, x in want.items()}


def test_many_near_copies(spark):
    """Four thousand near copies of one text and two thousand exact ones of another, over eight slices."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 10**9, 300).astype(str)
    rows = []
    for i in range(4000):
        own = base.copy()
        own[rng.integers(0, 300, 2)] = "x" + str(i)
        rows.append((i, " ".join(own)))
    rows += [(4000 + i, " ".join(map(str, range(50)))) for i in range(2000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("component_id").count().collect()
    assert {r.component_id: r["count"] for r in got} == {0: 4000, 4000: 2000}
