from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import brute
import pytest

from ledgerlight.llm import spelling
from ledgerlight.llm.scratch import Scratch
from ledgerlight.llm.spelling import near_words, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counts(docs):
    out = Counter()
    for d, t, *_ in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def every(docs):
    n = counts(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w, ""), root, n[w], len(near[w]), n[form[w]] if w in form else 0))
    return sorted(out)


def texts():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeà") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "léè×÷x", "É" * 6]
    docs = []
    for i in range(300):
        words = [rng.choice(stems[: rng.randrange(2, len(stems))]) for _ in range(80)]
        for _ in range(12):
            j, w = rng.randrange(80), rng.choice(words)
            k = rng.randrange(len(w))
            words[j] = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("cdé") + w[k + 1 :]])
        docs.append((i * 7, rng.choice([" ", ", ", "1", "中"]).join(words).upper() if i % 9 == 0 else " ".join(words)))
    return [*docs, (3, None), (4, ""), (5, "12 中"), (6, ("q" * 5000 + " ") * 3), (8, ("q" * 4999 + " ") * 7), (9, " ".join(["Straße"] * 5)), (9, " ".join(["Straße"] * 5))]


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("bucket", [64, 2])
def test_against_brute_force(spark, monkeypatch, bucket):
    """Twice: with buckets compared whole, and with nearly all of them by what is left without a letter."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    df = spark.createDataFrame([(*d, "x", 1) for d in texts()], "doc_id long, text string, word string, n int").repartition(6)
    want = every(texts())
    assert len(want) > 300 and sum(w[1] != "" for w in want) > 100
    assert result(spelling_variants(df)) == want


def test_dense_vocabulary(spark):
    """All words over two letters: every key is shared by many, every word has all neighbours."""
    vocabulary = [(f"{i:0{k}b}".translate({48: "a", 49: "b"}), 3 + i) for k in (5, 6, 7) for i in range(1 << k)]
    got = near_words(spark.createDataFrame(vocabulary, "word string, n long"), Scratch(spark, "test")).select("word", "other").collect()
    words = [w for w, _ in vocabulary]
    assert sorted(map(tuple, got)) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert spelling_variants(spark.createDataFrame([], schema)).count() == 0
    assert result(spelling_variants(spark.createDataFrame([(1, "hello hello hello"), (None, None)], schema))) == [("hello", "", "hello", 3, 0, 0)]
