"""Filed documents to facts: reports, tables and company histories in JSON.

Input of each reader: (source_ref, issuer_id, payload string). Each gives one row for every number found, with `problem`
null for a fact and else the cause of its refusal; nothing is dropped. A payload that cannot be read is one row with
problem 'unreadable'. `accepted` and `rejected` split the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.text import currency_of

_PERIOD = "period_start string, period_end string, period_type string"
_REPORT = f"period_end string, filed_at string, facts map<string, struct<concept string, value string, unit string, {_PERIOD}>>"
_CELL = f"struct<concept string, value string, unit string, {_PERIOD}>"
_TABLES = f"period_end string, period_type string, filed_at string, tables array<struct<unit string, period_end string, period_type string, columns array<struct<{_PERIOD}>>, rows array<struct<cells array<{_CELL}>>>>>"
_ENTRY = "struct<start string, `end` string, val string, accn string, form string, filed string, frame string>"
_HISTORY = f"facts map<string, map<string, struct<units map<string, array<{_ENTRY}>>>>>"

#: Taxonomies of financial facts, and the one of cover pages, whose dates are days of filing.
FINANCIAL, COVER = ("us-gaap", "ifrs-full"), "dei"
FACT = ["source_ref", "issuer_id", "concept", "value", "raw_value", "unit", "currency", "period_start", "period_end", "period_type", "basis", "filed", "accn", "locator", "problem"]


def filled(*options: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in options])


def finite(raw: Column) -> Column:
    """The text as a number; null where it is none, NaN or infinite."""
    x = raw.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def basis(document_end: Column, end: Column) -> Column:
    """A period that ends before the document's own is a comparative one: restated. ISO dates compare as texts."""
    return F.when(document_end > end, "restated").otherwise("as_reported")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("problem is null").drop("problem")


def rejected(rows: DataFrame) -> DataFrame:
    """(source_ref, problem, n)."""
    return rows.where("problem is not null").groupBy("source_ref", "problem").agg(F.count("*").alias("n"))


def _problem(section: Column, concept: Column, raw: Column, end: Column) -> Column:
    why = F.when(section.isNull(), "unreadable").when(filled(concept).isNull(), "no_concept").when(filled(raw).isNull(), "no_value").when(filled(end).isNull(), "no_period")
    number = raw.try_cast("double")
    return F.coalesce(why, F.when(number.isNotNull() & finite(raw).isNull(), "non_finite"))


def _facts(rows: DataFrame, *more: str, **cols: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    raw = cols["raw_value"]
    all_cols = {"filed": none, "accn": none, "value": finite(raw), "currency": currency_of(cols["unit"])} | cols
    return rows.select("source_ref", "issuer_id", *[all_cols[c].alias(c) for c in FACT[2:]], *more)


def report_facts(documents: DataFrame) -> DataFrame:
    """{"facts": {id: {concept, value, unit, period_*}}}; the start defaults to the end, the type to duration."""
    d = documents.withColumn("d", F.from_json("payload", _REPORT))
    x = d.select("*", F.explode_outer("d.facts").alias("id", "f"))
    f, end = (lambda n: F.col(f"f.{n}")), F.col("f.period_end")
    return _facts(
        x, concept=filled(f("concept")), raw_value=f("value"), unit=filled(f("unit")), period_start=filled(f("period_start"), end), period_end=filled(end), period_type=filled(f("period_type"), F.lit("duration")),
        basis=basis(F.col("d.period_end"), end), filed=filled(F.col("d.filed_at")), locator=F.concat(F.lit("xbrl:"), F.col("id")), problem=_problem(F.col("d.facts"), f("concept"), f("value"), end),
    )


def table_facts(documents: DataFrame) -> DataFrame:
    """{"tables": [{rows: [{cells: [...]}]}]}: what a cell leaves open its column, table or document says."""
    d = documents.withColumn("d", F.from_json("payload", _TABLES))
    x = d.select("*", F.posexplode_outer("d.tables").alias("ti", "t"))
    x = x.select("*", F.posexplode_outer("t.rows").alias("ri", "r"))
    x = x.select("*", F.posexplode_outer("r.cells").alias("ci", "c")).withColumn("k", F.try_element_at("t.columns", F.coalesce("ci", F.lit(0)) + 1))
    at = lambda n: [F.col(f"c.{n}"), F.col(f"k.{n}")]
    end = filled(*at("period_end"), F.col("t.period_end"), F.col("d.period_end"))
    kind = filled(*at("period_type"), F.col("t.period_type"), F.col("d.period_type"), F.lit("instant"))
    return _facts(
        x, concept=filled(F.col("c.concept")), raw_value=F.col("c.value"), unit=filled(F.col("c.unit"), F.col("t.unit")), period_start=filled(*at("period_start"), end), period_end=end, period_type=kind,
        basis=basis(F.col("d.period_end"), end), filed=filled(F.col("d.filed_at")), locator=F.concat_ws("/", F.lit("table"), "ti", "ri", "ci"), problem=_problem(F.col("r.cells"), F.col("c.concept"), F.col("c.value"), F.coalesce(end, F.lit("open"))),
    )


def company_facts(documents: DataFrame) -> DataFrame:
    """facts.<taxonomy>.<tag>.units.<unit>[]; as `report_facts`, and with superseded_by, the locator of the living fact.

    The financial taxonomies are read, or all if a payload has none of them; cover pages always. A filing's own period is
    the last end among its financial facts. Of the facts of one (concept, unit, start, end, basis) one lives: of the reported
    ones the first filed, its own period first; of the restated ones the last filed.
    """
    d = documents.withColumn("d", F.from_json("payload", _HISTORY))
    known = F.exists(F.map_keys("d.facts"), lambda t: t.isin(*FINANCIAL))
    x = d.withColumn("known", known).select("*", F.explode_outer("d.facts").alias("taxonomy", "tags")).where(F.expr("taxonomy is null or not known") | F.col("taxonomy").isin(*FINANCIAL, COVER))
    x = x.select("source_ref", "issuer_id", "taxonomy", F.explode_outer("tags").alias("tag", "node"))
    x = x.select("source_ref", "issuer_id", "taxonomy", "tag", F.explode_outer("node.units").alias("unit", "entries"))
    x = x.select("source_ref", "issuer_id", "taxonomy", "tag", "unit", F.posexplode_outer("entries").alias("i", "e"))
    end, accn = filled(F.col("e.end")), filled(F.col("e.accn"))
    x = x.withColumn("own", F.max(F.when(F.col("taxonomy") != COVER, end)).over(Window.partitionBy("source_ref", accn)))
    own = F.coalesce(F.when(accn.isNotNull(), F.col("own")), end)
    pointer = F.concat_ws("/", F.lit("/facts"), "taxonomy", "tag", F.lit("units"), "unit", F.col("i").cast("string"), F.lit("val"))
    read = _facts(
        x.withColumn("doc_end", own), "doc_end", concept=F.concat_ws(":", "taxonomy", "tag"), raw_value=F.col("e.val"), unit=F.col("unit"), period_start=filled(F.col("e.start"), end), period_end=end,
        period_type=F.when(filled(F.col("e.start")).isNotNull(), "duration").otherwise("instant"), basis=basis(F.col("doc_end"), end), filed=filled(F.col("e.filed")), accn=accn,
        locator=pointer, problem=_problem(F.col("e"), F.lit("tag"), F.col("e.val"), end),
    )
    key = Window.partitionBy("source_ref", "concept", "unit", "period_start", "period_end", "basis", F.col("problem").isNull())
    other = (F.col("basis") == "as_reported") & (F.col("doc_end") != F.col("period_end"))
    rank = F.struct(other.alias("other"), F.coalesce("filed", F.lit("")).alias("filed"), F.coalesce("accn", F.lit("")).alias("accn"), F.col("locator").alias("locator"))
    living = F.when(F.col("basis") == "restated", F.max(rank).over(key)).otherwise(F.min(rank).over(key))
    return read.withColumn("living", living).withColumn("superseded_by", F.when(F.col("problem").isNull() & (F.col("living.locator") != F.col("locator")), F.col("living.locator"))).drop("living", "doc_end")


#: Kind of document -> reader; kinds without one are left over as `unknown_kind`.
READERS = {"xbrl": report_facts, "table": table_facts, "companyfacts": company_facts}


def facts(documents: DataFrame) -> DataFrame:
    """Facts of documents of mixed kinds (with doc_kind), each read by the reader of its kind."""
    out = documents.where(~F.coalesce(F.col("doc_kind").isin(*READERS), F.lit(False)))
    none = {c: F.lit(None).cast("double" if c == "value" else "string").alias(c) for c in FACT[2:-1]}
    out = out.select("source_ref", "issuer_id", *none.values(), F.lit("unknown_kind").alias("problem")).withColumn("superseded_by", F.lit(None).cast("string"))
    for kind, reader in READERS.items():
        out = out.unionByName(reader(documents.where(F.col("doc_kind") == kind)), allowMissingColumns=True)
    return out
