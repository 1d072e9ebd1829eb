"""Checks of the stored tables: rows that point at nothing, counted by check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def _lacking(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose key is in no row of others; a null key points at nothing either."""
    return rows.join(others.select(F.col(other).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def checks(facts: DataFrame, raw: DataFrame, documents: DataFrame, measures: DataFrame, lineage: DataFrame, states: DataFrame, issuers: DataFrame) -> DataFrame:
    """(check, n), a row for each check, also for those that find nothing.

    facts (source_ref, source_kind, canonical), raw (sha256, provider), documents (sha256), measures (measure_id, value), lineage
    (measure_id), states (issuer), issuers (issuer). Each check is an anti-join, so no table is gathered.
    """
    manual = facts.where("source_kind = 'manual'")
    found = [
        _count(_lacking(facts, "source_ref", raw, "sha256"), "facts_without_raw_object"),
        _count(_lacking(measures.where("value is not null"), "measure_id", lineage, "measure_id"), "values_without_lineage"),
        _count(_lacking(states, "issuer", issuers, "issuer"), "states_without_issuer"),
        _count(facts.where("canonical is null"), "facts_without_concept"),
        _count(_lacking(raw.where("provider = 'manual-import'"), "sha256", documents, "sha256"), "manual_objects_without_document"),
        _count(_lacking(manual, "source_ref", documents, "sha256"), "manual_facts_without_document"),
        _count(_lacking(documents, "sha256", raw, "sha256"), "documents_without_raw_object"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def unmapped(facts: DataFrame, most: int = 5) -> DataFrame:
    """(concept, n) of the tags without a canonical concept that the most facts have (a report of the top few), ties by name."""
    return facts.where("canonical is null").groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(most)
