"""Operations on lists: applied whole or not at all."""

from __future__ import annotations

import tempfile

from ledgerlight.sinks import watchlists
from ledgerlight.sinks.store import Store


def test_apply(spark):
    store = Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 4)
    start = [("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), ("b", 1, "z")]
    store.commit({"members": (spark.createDataFrame(start, "list_id string, version int, member string"), ["list_id"])})
    classed = lambda *rows: spark.createDataFrame([*rows, ("q", None, "not_found")], "ticker string, id string, class string")
    assert watchlists.apply(store, "a", classed(("T", "t", "add"), ("Y", "y", "already_present"), ("U", "u", "add"))) == {"applied": True, "version": 3}
    assert sorted(tuple(r) for r in store.read("members").collect()) == sorted([*start, ("a", 3, "t"), ("a", 3, "u"), ("a", 3, "x"), ("a", 3, "y")])
    assert [tuple(r) for r in store.read("operations").collect()] == [("a", 3, 2)]
    before = store.manifest()
    assert watchlists.apply(store, "a", classed())["reason"] == "nothing_to_add"
    assert watchlists.apply(store, "none", classed(("T", "t", "add")))["reason"] == "unknown_list: none"
    many = classed(*[(f"T{i}", f"t{i}", "add") for i in range(5)])
    assert watchlists.apply(store, "b", many, most=4)["reason"] == "size_not_confirmed: 5>4"
    assert store.manifest() == before
    assert watchlists.apply(store, "b", many, size_confirmed=True, most=4) == {"applied": True, "version": 2}
