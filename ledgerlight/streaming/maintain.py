"""Tables that follow a stream: a late row re-triggers its key, and only the buckets of touched keys are made again.

Facts, what is derived from them and coverage are published together, once for each batch (sinks/store.py). A batch that runs again after a
failure finds itself published and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators import picks, versions
from ledgerlight.scratch import saved
from ledgerlight.sinks.store import Store, same_key


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run step(batch, number) on all that is there, going on from the checkpoint."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow(stream: DataFrame, store: Store, key: list[str], fact_key: list[str], rank: list[Column], derive: Callable[[DataFrame], DataFrame], name: str = "facts") -> None:
    """Append the stream's facts to the store's table facts and keep the table derived equal to derive(all facts).

    stream has fact_id; a fact that is stored is not stored again. superseded_by ranks all facts of a *fact_key* by *rank*, late ones too,
    and overwrites none. derive(facts) gives rows with the columns *key* and must work key by key; it is called for touched keys only.
    """

    def step(batch: DataFrame, number: int) -> None:
        base = store.manifest()
        if base["batches"].get(name, -1) >= number or batch.isEmpty():
            return
        rows = saved(batch.dropDuplicates(["fact_id"]), "batch")
        only = store.touched(rows, key)
        schema = picks.supersede(rows, fact_key, rank).schema
        old = store.read("facts", schema, base["version"] or None, only)
        new = saved(rows.join(old.select("fact_id"), same_key(rows, old, ["fact_id"]), "left_anti"), "new")
        # ranked and written once; what is derived comes from the files
        written = store.write("facts", picks.supersede(old.drop("superseded_by").unionByName(new), fact_key, rank), key)
        facts, keys = store.read_written(written), new.select(*key).distinct()
        own = facts.join(keys, same_key(facts, keys, key), "left_semi")
        made = derive(own)
        kept = store.read("derived", made.schema, base["version"] or None, only)
        kept = kept.join(keys, same_key(kept, keys, key), "left_anti")
        store.commit({"facts": (written, key), "derived": (kept.unionByName(made), key)}, only, base["version"] or None, (name, number))

    run(stream, step, f"{store.path}-checkpoint-{name}")


def cascade(touched: DataFrame, store: Store, name: str = "cascade") -> None:
    """Turn dependent blocks of the store's table coverage (id, block, status, reason) stale, as blocks (id, block) of a stream are touched."""

    def step(batch: DataFrame, number: int) -> None:
        base = store.manifest()
        if base["batches"].get(name, -1) >= number or batch.isEmpty():
            return
        rows = saved(batch.select("id", "block").distinct(), "touched")
        only = store.touched(rows, ["id"])
        after = versions.cascade(store.read("coverage", version=base["version"], only=only), rows)
        store.commit({"coverage": (after, ["id"])}, only, base["version"], (name, number))

    run(touched, step, f"{store.path}-checkpoint-{name}")


def newest_of(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """(*key, n, n_superseded, total): facts of a key, those that others have superseded, and the sum of the others."""
    out = F.col("superseded_by").isNotNull()
    return facts.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(out).alias("n_superseded"), F.sum(F.when(~out, F.col(value))).alias("total"))
