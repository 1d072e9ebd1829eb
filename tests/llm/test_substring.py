from __future__ import annotations

import tempfile

import brute

from ledgerlight.llm.substring_dedup import FAN, Index, substring_dedup

SCHEMA = "doc_id long, text string"


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in df.collect()}


def test_against_brute_force(spark):
    docs = brute.odd_documents()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, slice string, n_words int").repartition(6)
    out = substring_dedup(df)
    assert result(out) == brute.substring(docs)
    assert {r.slice for r in out.collect()} == {"x"}


def test_batches_do_not_matter(spark):
    docs = brute.odd_documents()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert result(substring_dedup(df, batches=1)) == result(substring_dedup(df, batches=4)) == brute.substring(docs)


def test_small_tables(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    words = " ".join(map(str, range(30)))
    got = substring_dedup(spark.createDataFrame([(1, words), (1, words), (None, words), (2, None)], SCHEMA))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 30, 0), (1, 30, 30), (2, 0, 0)]


def test_stored_index_gives_the_rows_of_one_call(spark):
    """Six calls with compaction between them; a lost result is made again from the version before it."""
    docs = sorted(brute.odd_documents())
    want, path = brute.substring(docs), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    got, step = {}, -(-len(docs) // 6)
    for a in range(0, len(docs), step):
        own = spark.createDataFrame(docs[a : a + step], SCHEMA).repartition(2)
        got |= result(substring_dedup(own, index=path))
    assert got == want
    last = Index(spark, path).versions()[-1]
    assert last == -(-len(docs) // step)
    assert len(Index(spark, path).at(None)[2]) < FAN
    assert result(substring_dedup(own, index=path, version=last - 1)) == {r: want[r] for r, _ in docs[a : a + step]}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ll_")]
