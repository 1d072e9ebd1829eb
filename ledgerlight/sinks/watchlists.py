"""Operations on watchlists applied as one step: a new version with all its members, or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators import versions

from .store import Conflict, Store

#: Fixed value: instruments that an operation may add without its size being confirmed.
MOST = 100


def apply(store: Store, list_id: str, classified: DataFrame, size_confirmed: bool = False, most: int = MOST) -> dict:
    """Add what lists.operation() classed as 'add' to the store's table members (list_id, version, member) of one list.

    Returns applied with the version, or not applied with a reason: nothing to add, an unknown list, too many without confirmation, or
    another operation that came first. Members and the log of operations (list_id, version, added) are published together.
    """
    base = store.manifest()
    key = store.spark.createDataFrame([(list_id,)], "list_id string")
    only = store.touched(key, ["list_id"])
    members = store.read("members", "list_id string, version int, member string", base["version"] or None, only)
    own = members.where(F.col("list_id") == list_id)
    add = classified.where("class = 'add'").select(F.lit(list_id).alias("list_id"), F.col("id").cast("string").alias("member")).distinct()
    n, version = add.count(), own.agg(F.max("version")).first()[0]
    if version is None:
        return {"applied": False, "reason": f"unknown_list: {list_id}"}
    if not n:
        return {"applied": False, "reason": "nothing_to_add"}
    if n > most and not size_confirmed:
        return {"applied": False, "reason": f"size_not_confirmed: {n}>{most}"}
    new = versions.next_version(own, add).select("list_id", F.col("version").cast("int").alias("version"), "member")
    log = store.read("operations", "list_id string, version int, added long", base["version"] or None, only)
    entry = store.spark.createDataFrame([(list_id, version + 1, n)], "list_id string, version int, added long")
    try:
        store.commit({"members": (members.unionByName(new), ["list_id"]), "operations": (log.unionByName(entry), ["list_id"])}, only, base["version"] or None)
    except Conflict as e:
        return {"applied": False, "reason": f"conflict: {e}"}
    return {"applied": True, "version": version + 1}
