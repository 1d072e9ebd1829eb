from __future__ import annotations

import random

import brute

from ledgerlight.llm.decontaminate import LEAST, SHORTEST, contamination


def every(docs, items):
    """All pairs of a text and an item with a verified overlap on some alignment."""
    out = set()
    for d, t in docs:
        w = brute.plain(t)
        for i, s in items:
            q = brute.plain(s)
            if len(q) >= SHORTEST:
                for diag in range(-len(q) + 1, len(w)):
                    a, b = max(0, diag), min(len(w), diag + len(q))
                    same = [w[p] == q[p - diag] for p in range(a, b)]
                    if brute.stretch(same, LEAST) if len(q) >= LEAST else len(same) == len(q) and 5 * sum(same) >= 4 * len(q):
                        out.add((d, i))
                        break
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(brute.prose(rng, rng.choice([3, 6, 9, 14, 25, 40]), 10**5))) for i in range(30)] + [(90, None), (91, "")]
    docs = [(1, None), (2, "")]
    for n in range(60):
        w, q = brute.prose(rng, 60, 10**5), brute.plain(items[rng.randrange(30)][1])
        if n % 3:
            q = q[rng.randrange(3) :]
            for p in range(rng.randrange(1, 8), len(q), 8):
                q[p] = f"sub{p}" if n % 3 == 2 else q[p]
            at = rng.randrange(len(w))
            w[at:at] = q
        docs.append((10 + n, ", ".join(w).upper()))
    want = every(docs, items)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(4)
    rows = contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got) == len(rows)
    assert got <= want
    assert len(got) >= 0.98 * len(want)
    assert len(want) > 20
    exact = {(d, i) for d, t in docs for i, s in items if s and len(brute.plain(s)) >= SHORTEST and f" {' '.join(brute.plain(s))} " in f" {' '.join(brute.plain(t))} "}
    assert exact <= got


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h"), (None, "a b c d e f g h")], "doc_id long, text string")
    assert contamination(docs, items).count() == contamination(some, items).count() == contamination(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert [tuple(r) for r in contamination(some, some.withColumnRenamed("doc_id", "item_id")).collect()] == [(1, 1, 0, 8, 8)]


def test_every_passage_is_found(spark):
    """Each pattern of exchanged words (1 = equal) that counts, and at random a fifth of the words exchanged, each found as a stretch that is the longest through some word."""
    rng = random.Random(11)
    patterns = ["10111110110110111", "111111000111111", "1" * 13 + "0000" * 4 + "1" * 40] + ["".join(rng.choices("01", (1, 4), k=rng.choice([13, 17, 20, 60]))) for _ in range(2000)]
    items = [(n, " ".join(f"q{n}x{k}" for k in range(len(p)))) for n, p in enumerate(patterns)]
    docs = [(n, " ".join(f"q{n}x{k}" if c == "1" else "other" for k, c in enumerate(p))) for n, p in enumerate(patterns)]
    got = {r.doc_id: (r.item_id, r.n_aligned, r.n_equal) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n, p in enumerate(patterns):
        runs = [(i, j) for i in range(len(p)) for j in range(i + LEAST, len(p) + 1) if p[i] == p[j - 1] == "1" and 5 * p[i:j].count("1") >= 4 * (j - i)]
        through = [max((j - i, -i) for i, j in runs if i <= at < j) for at in {x for i, j in runs for x in range(i, j)}]
        whole = {(n, m, p[-i : m - i].count("1")) for m, i in through}
        assert got.get(n) in (whole or {None}), p
