from __future__ import annotations

import math
import zlib

import numpy as np

from ledgerlight.llm.quality import class_prior, fit, quality_scores, train

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs.select("doc_id", "text"), train(docs, labels))
    rows = scored.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [(r.score, r.quality) for r in rows if r.held_out and r.quality is not None]
    good, bad = [s for s, q in own if q == 1], [s for s, q in own if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum((s >= 0.3) == q for s, q in own) / len(own) > 0.85


def test_same_scores_for_any_partitioning(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet").repartition(n) for t, n in (("documents", 5), ("labels", 2)))
    again = quality_scores(docs, train(docs, labels)).select("doc_id", "score").collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    once = quality_scores(docs, train(docs, labels)).select("doc_id", "score").collect()
    a, b = dict(map(tuple, again)), dict(map(tuple, once))
    assert a.keys() == b.keys()
    assert max(abs(a[d] - b[d]) for d in a) < 1e-6


def test_odd_tables(spark):
    empty, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(empty, train(empty, none)).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x", "c"), (3, "words " * 50_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality_scores(docs, train(docs, labels)).collect()) == [1, 2, 2, 3]
    assert quality_scores(docs, train(docs, none)).count() == 4


def test_risk_and_prior_against_loops():
    """One step of the fit against numeric differences of the risk, both branches of the clamp; the prior of a known mixture."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (40, 3)), np.vstack([rng.normal(1, 1, (30, 3)), rng.normal(-1, 1, (70, 3))])
    both = np.vstack([p, u])
    z = lambda x: np.clip((x - both.mean(0)) / both.std(0), -5, 5)

    def risk(theta, prior):
        loss = lambda m: sum(math.log1p(math.exp(-v)) for v in m) / len(m)
        zp, zu = z(p) @ theta[:3] + theta[3], z(u) @ theta[:3] + theta[3]
        positive, negative = prior * loss(zp), loss(-zu) - prior * loss(-zp)
        return positive, negative

    for prior in (0.3, 0.95):
        model = fit(p, u, prior, steps=1, rate=0.05)
        positive, negative = risk(np.zeros(4), prior)
        f = (lambda t: sum(risk(t, prior))) if negative >= 0 else (lambda t: -risk(t, prior)[1])  # noqa: B023
        grad = np.array([(f(h) - f(-h)) / 2e-5 for h in np.eye(4) * 1e-5])
        assert np.sign(np.append(model["w"], model["b"])).tolist() == (-np.sign(grad)).tolist()
        assert np.allclose(np.abs(np.append(model["w"], model["b"])), 0.05, atol=1e-4)  # Adam's first step
    a, b = rng.normal(2, 1, 4000), np.r_[rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)]
    assert abs(class_prior(a, b) - 0.6) < 0.05
