"""Versions of several tables, and tables that follow a stream."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlight.sinks.store import Conflict, Store
from ledgerlight.streaming import maintain

FACT = "fact_id long, issuer long, concept string, filed string, value double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data, schema="id long, v string"):
    return spark.createDataFrame(data, schema)


def test_two_tables_have_one_version(spark, monkeypatch):
    store = Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 4)
    assert store.versions() == [] and store.read("a", "id long, v string").count() == 0
    store.commit({"a": (frame(spark, [(1, "x"), (2, "y"), (None, "z")]), ["id"]), "b": (frame(spark, [(1, "p")]), ["id"])})
    before = store.manifest()
    # the second table can't be written: nothing of the commit is seen
    bad = frame(spark, [(9, "q")]).withColumn("v", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": (frame(spark, [(7, "new")]), ["id"]), "b": (bad, ["id"])})
    assert store.manifest() == before and rows(store.read("b")) == [(1, "p")]
    # only the bucket of id 2 is made again
    only = store.touched(frame(spark, [(2, "")]), ["id"])
    old = store.read("a", only=only)
    store.commit({"a": (old.where("id <> 2 or id is null").union(frame(spark, [(2, "later")])), ["id"])}, only)
    now = store.manifest()
    assert {b for b, f in now["tables"]["a"]["parts"].items() if before["tables"]["a"]["parts"].get(b) != f} == {str(only[0])}
    assert now["tables"]["b"] == before["tables"]["b"]
    assert sorted((r.id or 0, r.v) for r in store.read("a").collect()) == [(0, "z"), (1, "x"), (2, "later")]
    assert sorted(r.v for r in store.read("a", version=1).collect()) == ["x", "y", "z"]


def test_commits_on_one_version_collide(spark):
    store = Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 2)
    store.commit({"a": (frame(spark, [(1, "x")]), ["id"])})
    store.commit({"a": (frame(spark, [(1, "first")]), ["id"])}, base=1)
    with pytest.raises(Conflict):
        store.commit({"a": (frame(spark, [(1, "second")]), ["id"])}, base=1)
    assert rows(store.read("a")) == [(1, "first")]
    store.commit({"a": (frame(spark, [(1, "third")]), ["id"])}, batch=("s", 3))
    assert store.commit({"a": (frame(spark, [(1, "again")]), ["id"])}, batch=("s", 3)) == 3
    assert rows(store.read("a")) == [(1, "third")]
    store.vacuum(1)
    assert store.versions() == [3] and rows(store.read("a")) == [(1, "third")]


def put(spark, folder, data):
    spark.createDataFrame(data, FACT).coalesce(1).write.mode("append").parquet(folder)


def test_a_late_restatement_changes_its_issuer_only(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store, calls = Store(spark, f"{top}/store", 8), []

    def derive(facts):
        calls.append(sorted({r.issuer or 0 for r in facts.collect()}))
        return maintain.newest_of(facts, ["issuer"], "value")

    def come():
        stream = spark.readStream.schema(FACT).parquet(f"{top}/in")
        maintain.follow(stream, store, ["issuer"], ["issuer", "concept"], [F.desc("filed"), F.col("fact_id")], derive)

    put(spark, f"{top}/in", [(1, 1, "revenue", "2024-01-01", 10.0), (2, 2, "revenue", "2024-01-01", 20.0), (3, None, "revenue", "2024-01-01", 5.0), (3, None, "revenue", "2024-01-01", 5.0)])
    come()
    first = store.manifest()
    put(spark, f"{top}/in", [(4, 2, "revenue", "2024-02-01", 25.0), (1, 1, "revenue", "2024-01-01", 10.0), (3, None, "revenue", "2024-01-01", 5.0)])
    come()
    put(spark, f"{top}/in", [(5, 2, "revenue", "2023-06-01", 19.0)])  # older than what is stored: kept, superseded
    come()
    assert sorted((r.issuer or 0, r.n, r.n_superseded, r.total) for r in store.read("derived").collect()) == [(0, 1, 0, 5.0), (1, 1, 0, 10.0), (2, 3, 2, 25.0)]
    assert {r.fact_id: r.superseded_by for r in store.read("facts").collect()} == {1: None, 2: 4, 3: None, 4: None, 5: 4}
    assert calls[-1] == [2]
    bucket = str(store.touched(spark.createDataFrame([(2,)], "issuer long"), ["issuer"])[0])
    changed = {b for b, f in store.manifest()["tables"]["derived"]["parts"].items() if first["tables"]["derived"]["parts"].get(b) != f}
    assert bucket in changed
    come()  # nothing new: no version
    assert store.manifest()["batches"]["facts"] == 2


def test_cascade_of_a_stream_rewrites_touched_buckets(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = Store(spark, f"{top}/store", 16)
    coverage = spark.range(40).selectExpr("id", "explode(array('prices', 'industry_metrics')) as block", "'ready' as status", "cast(null as string) as reason")
    store.commit({"coverage": (coverage, ["id"])})
    first = store.manifest()
    spark.createDataFrame([(1, "prices"), (2, "governance")], "id long, block string").write.parquet(f"{top}/in")
    maintain.cascade(spark.readStream.schema("id long, block string").parquet(f"{top}/in"), store)
    got = store.read("coverage")
    assert sorted((r.id, r.block, r.reason) for r in got.where("status = 'stale'").collect()) == [(1, "industry_metrics", "cascade:after_prices"), (2, "industry_metrics", "cascade:after_governance")]
    assert got.count() == 80
    parts = store.manifest()["tables"]["coverage"]["parts"]
    assert sum(parts[b] != f for b, f in first["tables"]["coverage"]["parts"].items()) <= 2


def test_facts_of_a_batch_are_ranked_once(spark):
    """What is derived reads the facts that the batch has written: nothing in its plan ranks or joins stored facts again."""
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store, seen = Store(spark, f"{top}/store", 4), []

    def derive(facts):
        seen.append((facts._jdf.queryExecution().optimizedPlan().toString(), facts.inputFiles()))
        return maintain.newest_of(facts, ["issuer"], "value")

    for data in ([(1, 1, "revenue", "2024-01-01", 10.0)], [(2, 1, "revenue", "2024-02-01", 11.0), (1, 1, "revenue", "2024-01-01", 10.0)]):
        put(spark, f"{top}/in", data)
        maintain.follow(spark.readStream.schema(FACT).parquet(f"{top}/in"), store, ["issuer"], ["issuer", "concept"], [F.desc("filed"), F.col("fact_id")], derive)
    assert len(seen) == 2 and not any("Window" in plan for plan, _ in seen)
    assert any("/store/facts/" in f for f in seen[1][1])
    assert rows(store.read("facts").select("fact_id", "superseded_by")) == [(1, 2), (2, None)]
    assert rows(store.read("derived")) == [(1, 2, 1, 11.0)]
