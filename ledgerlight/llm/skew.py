"""Joins and running values in which no key, however frequent, lands in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

#: Keys that hold more than this many rows and more than a MOST-th of all rows are broadcast: fewer than MOST can.
LEAST, MOST = 100_000, 10_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread: str) -> DataFrame:
    """rows left-joined with table, which has one row for each key and in *weight* the number of rows of that key, *total* over all.

    The frequent keys' rows of table are broadcast: their number is bounded, as their weights are a MOST-th of the total at least. What
    has found its key there, or has none, is spread by *spread* over the tasks of the join with the others.
    """
    bound, values = max(LEAST, total // MOST), [c for c in table.columns if c not in (*keys, weight)]
    big = F.broadcast(table.where(F.col(weight) > bound).select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_found")))
    rest = table.where(F.col(weight) <= bound).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(0).alias("_slot"), *values)
    probed = rows.join(big, keys, "left").withColumn("_at", F.when(F.col("_found") | F.col(keys[0]).isNull(), 1 + F.pmod(F.hash(spread), F.lit(1 << 20))).otherwise(0))
    out = probed.join(rest, _all([F.col("_at") == F.col("_slot"), *[F.col(k) == F.col(f"_k_{k}") for k in keys]]), "left")
    return out.select(*rows.columns, *[F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def _all(conditions: list[Column]) -> Column:
    first, *others = conditions
    for c in others:
        first = first & c
    return first


def ranged(df: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """df dealt into ranges of *order* and saved, with the number of each row's range in the column part."""
    return scratch.save(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, key: list[str], order: list, values: dict[str, tuple[Callable, Callable, Column]]) -> DataFrame:
    """df with a column for each of *values*, (aggregate, merge, expression): the running aggregate within key in the order (part, *order).

    Rows meet by (key, part) only; what the earlier parts of a key hold comes from a table of the parts.
    """
    one = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumns({n: agg(x).over(one) for n, (agg, _, x) in values.items()})
    parts = df.groupBy(*key, "part").agg(*[agg(x).alias(f"_{n}") for n, (agg, _, x) in values.items()])
    held = parts.withColumns({f"_{n}": agg(f"_{n}").over(before) for n, (agg, _, _) in values.items()}).where(_all([F.col(f"_{n}").isNotNull() for n in values]))
    out = own.join(held, [*key, "part"], "left")
    return out.select(*df.columns, *[F.coalesce(merge(F.col(n), F.col(f"_{n}")), F.col(n)).alias(n) for n, (_, merge, _) in values.items()])
