from __future__ import annotations

import hashlib
import math
import re
import statistics
from collections import Counter

import brute
import xxhash
from pyspark.sql import functions as F

from ledgerlight.llm.fingerprints import GROUP, SAMPLES, edited_fingerprints, fingerprints

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
M = (1 << 64) - 1


def number(x, seed=42, size=8):
    return xxhash.xxh64_intdigest((x & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)


def plain(text, samples=SAMPLES):
    """Every value of every term, without bounds."""
    out = ""
    counts = Counter(TERM.findall(text or ""))
    if not counts:
        return out
    for k in range(samples):
        values = []
        for term, w in counts.items():
            hg = number(k // GROUP, number(xxhash.xxh64_intdigest(term.encode(), 42), 42), 4)
            z = number(hg ^ (0x9E3779B97F4A7C15 * (k % GROUP + 1)) % (1 << 63))
            u = [((z >> 16 * i) & 65535) + 0.5 for i in range(4)]
            r, b = -math.log(u[0] * u[1] / 2**32), (number(z) & 0xFFFFFFFF) / 2**32
            values.append(math.log(-math.log(u[2] * u[3] / 2**32)) - r * (math.floor(math.log(w) / r + b) - b + 1))
        out += f"{int(min(values) * 2**32) & 65535:04x}"
    return out


def alike(a, b):
    same = sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 4 * SAMPLES, 4)) / SAMPLES
    return same if a and b else float(a == b)


def every(docs):
    rows = sorted({(d, t or "") for d, t in docs if d is not None}, key=lambda x: (x[0], (xxhash.xxh64_intdigest(x[1].encode(), 42) + (1 << 63)) % (1 << 64)))
    out = {}
    for i, (d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain(t), plain(edited), plain(after)
        out[d, hashlib.sha256(edited.encode()).hexdigest()] = (len(t), a, b, alike(a, b), alike(a, c))
    return out


def close(a, b):
    """Fingerprints whose last bits may differ where two logarithms are rounded in another way."""
    return a == b or (a and b and abs(len(a) - len(b)) == 0 and alike(a, b) > 0.95)


def test_against_brute_force(spark):
    docs = [d for d in brute.odd_documents() if d[0] not in (112,)]
    docs += [(200, "Àé \U0001f600\U0001f600 x" * 9), (201, "ABC abc 123-abc"), (-5, "..."), (202, "word " * 3000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_chars int, fingerprint string").repartition(5)
    got, want = {(r.doc_id, r.edited_sha256): r for r in edited_fingerprints(df).collect()}, every(docs)
    assert got.keys() == want.keys()
    for k, (n, a, b, near_edited, near_next) in want.items():
        r = got[k]
        assert r.n_chars == n and close(r.fingerprint, a) and close(r.edited_fingerprint, b)
        assert abs(r.near_edited - near_edited) <= 3 / SAMPLES and abs(r.near_next - near_next) <= 3 / SAMPLES
    exact = sum(got[k].fingerprint == v[1] and got[k].edited_fingerprint == v[2] for k, v in want.items())
    assert exact >= 0.97 * len(want)


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """Two hundred pairs of texts with shared terms of other weights."""
    import random

    rng, rows, true = random.Random(3), [], []
    for i in range(200):
        a = Counter({f"t{i}x{j}": rng.randrange(1, 30) for j in range(40)})
        b = Counter({t: max(1, w + rng.randrange(-12, 13)) for t, w in a.items() if rng.random() < 0.8} | {f"u{i}x{j}": rng.randrange(1, 9) for j in range(8)})
        true.append(sum((a & b).values()) / sum((a | b).values()))
        rows += [(2 * i, " ".join(a.elements())), (2 * i + 1, " ".join(b.elements()))]
    got = {r.doc_id: r.fingerprint for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    est = [alike(got[2 * i], got[2 * i + 1]) for i in range(200)]
    assert abs(statistics.mean(est) - statistics.mean(true)) < 0.015
    assert statistics.mean((e - t) ** 2 for e, t in zip(est, true, strict=True)) < 1.3 * statistics.mean(t * (1 - t) / SAMPLES for t in true)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = edited_fingerprints(spark.createDataFrame([(7, "a b c d")], schema)).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (1, "c")]
    got = sorted((r.doc_id, r.n_chars, r.near_next) for r in edited_fingerprints(spark.createDataFrame(rows, schema)).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 3), (1, 3), (2, 0), (3, 0)]
    assert [g[2] for g in got if g[0] == 2] == [1.0]


def test_native(spark):
    df = edited_fingerprints(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert df.where(F.col("near_edited") > 1).count() == 0
