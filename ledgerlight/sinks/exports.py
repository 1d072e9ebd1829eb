"""Exports of snapshots: one document for each snapshot, its measures in a fixed order.

measures: (snapshot_id, measure_id, scope, scope_ref, concept, value, unit, period_start, period_end, method_version, null_reason).
A snapshot has tens of measures, so a document is small however many snapshots there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the CSV export.
CSV = ["scope", "scope_ref", "concept", "value", "unit", "period_start", "period_end", "method_version", "null_reason"]


def provenance(lineage: DataFrame) -> DataFrame:
    """(measure_id, provenance struct<source_kind, facts>) of lineage (measure_id, fact_id, concept, status, source_kind, source_ref, locator).

    A measure is manual if one of its facts is; a manual fact names its document and the page of its locator (#page=7).
    """
    manual = F.coalesce(F.col("source_kind"), F.lit("provider")) == "manual"
    page = F.regexp_extract("locator", r"#page=(\d+)", 1).try_cast("int")
    fact = F.struct("fact_id", "concept", "status", F.when(manual, "manual").otherwise("provider").alias("kind"), "source_ref", F.when(manual, page).alias("page"))
    g = lineage.groupBy("measure_id").agg(F.array_sort(F.collect_list(fact)).alias("facts"), F.max(manual).alias("manual"))
    return g.select("measure_id", F.struct(F.when(F.col("manual"), "manual").otherwise("provider").alias("source_kind"), "facts").alias("provenance"))


def _documents(measures: DataFrame, row: Column, name: str) -> DataFrame:
    return measures.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("scope", "scope_ref", "concept", "measure_id", row.alias("row")))).alias("m")).select("snapshot_id", F.col("m.row").alias(name), F.col("m.concept").alias("concepts"))


def to_json(measures: DataFrame, map_version: str, lineage: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, text): the measures with nulls and reasons, and with provenance if there is a lineage; keys are sorted."""
    if lineage is not None:
        measures = measures.join(provenance(lineage), "measure_id", "left")
    row = F.struct(*[F.col(c) for c in sorted(set(measures.columns) - {"snapshot_id"})])
    d = _documents(measures, row, "measures")
    return d.select("snapshot_id", F.to_json(F.struct(F.lit(map_version).alias("concept_map_version"), "measures", F.col("snapshot_id").alias("snapshot")), {"ignoreNullFields": "false"}).alias("text"))


def to_csv(measures: DataFrame, map_version: str) -> DataFrame:
    """(snapshot_id, text): a line with the version, the heads, then a line for each measure."""
    line = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in CSV]), {"emptyValue": "", "nullValue": ""})
    d = _documents(measures, line, "lines")
    return d.select("snapshot_id", F.concat(F.lit(f"concept_map_version,{map_version}\n{','.join(CSV)}\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def to_markdown(measures: DataFrame, map_version: str) -> DataFrame:
    """(snapshot_id, text): a table; a missing value is a dash with the number of the note that gives its reason."""
    cells = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("value", "unit", "period_start", "period_end", "null_reason")], F.col("value").isNull().alias("none"))
    d = _documents(measures, cells, "rows")
    nulls = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.element_at("rows", i)["none"])

    def line(r: Column, i: Column) -> Column:
        dash = F.concat(F.lit("— ["), F.array_position(nulls, i + 1).cast("string"), F.lit("] |  |  |  |"))
        full = F.concat(F.concat_ws(" | ", r["value"], r["unit"], r["period_start"], r["period_end"]), F.lit(" |"))
        return F.concat(F.lit("| "), F.element_at("concepts", i + 1), F.lit(" | "), F.when(r["none"], dash).otherwise(full))

    note = lambda i, n: F.concat(F.lit("- ["), (n + 1).cast("string"), F.lit("] "), F.element_at("concepts", i), F.lit(": "), F.element_at("rows", i)["null_reason"])
    head = f"concept_map_version: {map_version}\n\n| concept | value | unit | period_start | period_end |\n|---|---|---|---|---|\n"
    notes = F.when(F.size(nulls) > 0, F.concat(F.lit("\nReasons of missing values:\n"), F.array_join(F.transform(nulls, note), "\n"), F.lit("\n"))).otherwise("")
    return d.select("snapshot_id", F.concat(F.lit(head), F.array_join(F.transform("rows", line), "\n"), F.lit("\n"), notes).alias("text"))


def source_cells(lineage: DataFrame, short: int = 12) -> DataFrame:
    """(measure_id, source): kind:sha@period of each fact, joined by '; '; lineage has also period_end."""
    cell = F.concat(F.coalesce(F.col("source_kind"), F.lit("provider")), F.lit(":"), F.substring(F.coalesce("source_ref", F.lit("")), 1, short), F.lit("@"), F.coalesce(F.col("period_end").cast("string"), F.lit("")))
    return lineage.groupBy("measure_id").agg(F.array_join(F.array_sort(F.collect_set(cell)), "; ").alias("source"))
