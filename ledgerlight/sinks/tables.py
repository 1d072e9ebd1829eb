"""Writing to stored tables: what is to be added or replaced, as DataFrames of the new state.

Stored rows are never rewritten in place; a caller appends the new rows, or overwrites the partitions that are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.reasons import is_known
from ledgerlight.functions.text import scrub
from ledgerlight.operators.picks import first_by


def inserted(stored: DataFrame, incoming: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """Rows to append: those whose key is not stored, once for each key; what is stored is never changed."""
    once = first_by(incoming, key, *(order or [F.xxhash64(*incoming.columns)]))
    return once.join(stored.select(*key), key, "left_anti").select(incoming.columns)


def replaced(stored: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """The table after the documents (or other groups) of *incoming* have taken the place of their old rows."""
    return stored.join(incoming.select(*by).distinct(), by, "left_anti").unionByName(incoming)


def upserted(stored: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """The table with the newest row of each key; of equal versions the incoming one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return first_by(both, key, F.desc(version), F.desc("_new")).drop("_new")


def checked(measures: DataFrame, lineage: DataFrame) -> DataFrame:
    """Measures with `problem`: a value without lineage, a missing value without a reason, both at once, or a reason that is unknown."""
    known = lineage.select("measure_id").distinct().withColumn("_has", F.lit(True))
    m = measures.join(known, "measure_id", "left")
    value, reason = F.col("value").isNotNull(), F.col("null_reason")
    why = F.when(value & F.col("_has").isNull(), "no_lineage").when(value & reason.isNotNull(), "value_and_reason").when(~value & reason.isNull(), "no_reason")
    why = why.when(~value & ~is_known(reason), "unknown_reason")
    return m.withColumn("problem", why).drop("_has")


def by_kind(lineage: DataFrame) -> dict[str, DataFrame]:
    """Lineage rows by what they point at: a fact or measure, a corporate action, or a range of prices."""
    fact = F.col("fact_id").isNotNull() | F.col("peer_measure_id").isNotNull()
    action = ~fact & F.col("ca").isNotNull()
    return {"facts": lineage.where(fact), "actions": lineage.where(action), "prices": lineage.where(~fact & ~action & F.col("price").isNotNull())}


def audited(log: DataFrame) -> DataFrame:
    """A log fit to be kept: secrets in its texts are blanked, and it is cut by day."""
    return log.withColumn("message", scrub(F.col("message"))).withColumn("day", F.to_date("at"))
