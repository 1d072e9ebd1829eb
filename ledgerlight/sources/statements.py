"""Annual statements in CSV and insiders' deals in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filings import filled, finite

#: Scale words of the statements, and the account whose sign is turned.
SCALES = {"UNID": 1.0, "MIL": 1e3, "MILHOES": 1e6}
TURNED = "3.08"
#: Flags of a reporting owner in order of precedence, and codes of a deal.
ROLES = (("isDirector", "director"), ("isOfficer", "officer"), ("isTenPercentOwner", "ten_percent_owner"), ("isOther", "other"))
DIRECTIONS = {"A": "acquired", "D": "disposed"}

_V = "struct<value string>"
_FORM = "documentType string, periodOfReport string, issuer struct<issuerCik string, issuerName string>, reportingOwner struct<reportingOwnerId struct<rptOwnerCik string, rptOwnerName string>, reportingOwnerRelationship struct<" + ", ".join(f"{f} string" for f, _ in ROLES) + ", officerTitle string>>, _corrupt_record string"
_DEAL = f"securityTitle {_V}, transactionDate {_V}, transactionAmounts struct<transactionShares {_V}, transactionPricePerShare {_V}, transactionAcquiredDisposedCode {_V}>"


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of statement files: semicolons, Latin-1, all columns as texts."""
    return spark.read.csv(path, sep=";", encoding="ISO-8859-1", header=True)


def statement_facts(rows: DataFrame, flow: bool, by: tuple[str, ...] = ("CD_CVM",)) -> DataFrame:
    """Facts of statement rows, with `problem` as in filings: the highest VERSAO of each account, order and period counts.

    Values are scaled; account 3.08 is turned to the sign of a deduction, never to -0.0. The sheet (flow false) has instants.
    """
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    end = filled(cell("DT_FIM_EXERC"))
    start, account, raw = filled(cell("DT_INI_EXERC")) if flow else end, filled(cell("CD_CONTA")), filled(cell("VL_CONTA"))
    version = F.coalesce(filled(cell("VERSAO")), F.lit("0")).try_cast("int")
    scale = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    factor = F.try_element_at(scale, F.upper(F.coalesce(filled(cell("ESCALA_MOEDA")), F.lit("UNID"))))
    value = finite(raw) * factor
    value = F.when(account == TURNED, F.when(value == 0, 0.0).otherwise(-value)).otherwise(value)
    why = F.when(raw.isNull() | account.isNull() | end.isNull(), "no_value").when(finite(raw).isNull() | version.isNull(), "not_a_number")
    x = rows.select(*by, start.alias("period_start"), end.alias("period_end"), account.alias("account"), cell("ORDEM_EXERC").alias("order"), raw.alias("raw_value"), filled(cell("MOEDA")).alias("unit"), version.alias("version"), value.alias("value"), factor.alias("factor"), why.alias("problem"))
    w = Window.partitionBy(*by, "account", "order", "period_start", "period_end", F.col("problem").isNull()).orderBy(F.desc("version"), "raw_value")
    x = x.withColumn("n", F.row_number().over(w)).where("n = 1 or problem is not null")
    late = F.when(F.col("factor").isNull(), "unknown_scale").when(finite(F.col("value").cast("string")).isNull(), "non_finite")
    x = x.withColumn("problem", F.coalesce("problem", late))
    kind = "duration" if flow else "instant"
    return x.select(*by, F.concat(F.lit("cvm-dfp:"), "account").alias("concept"), F.when(F.col("problem").isNull(), F.col("value")).alias("value"), "raw_value", "unit", "period_start", "period_end", F.lit(kind).alias("period_type"), F.lit("as_reported").alias("basis"), "order", "problem")


def deals(documents: DataFrame) -> DataFrame:
    """(source_ref, insider, role, title, date, direction, shares, price, security, planned, tx_index, problem) of ownership forms (source_ref, payload).

    A form with a DTD is refused before it is parsed, as is one that is no ownership document; a deal is planned if a footnote
    it names speaks of rule 10b5-1. The date defaults to the form's period.
    """
    x = documents.withColumn("payload", F.coalesce("payload", F.lit("")))
    refused = F.when(F.col("payload").rlike("(?i)<!DOCTYPE|<!ENTITY"), "dtd").when(~F.col("payload").rlike(r"^(\s|<\?.*?\?>|<!--(?s:.*?)-->)*<ownershipDocument[\s>]"), "not_ownership")
    x = x.withColumn("problem", refused).withColumn("safe", F.when(F.col("problem").isNull(), F.col("payload")))
    x = x.withColumn("f", F.from_xml("safe", _FORM, {"mode": "PERMISSIVE"}))
    x = x.withColumn("problem", F.coalesce("problem", F.when(F.col("f._corrupt_record").isNotNull(), "malformed")))
    note = r'(?s)<footnote id="([^"]*)"[^>]*>(.*?)</footnote>'
    ids, texts = (F.regexp_extract_all("safe", F.lit(note), F.lit(i)) for i in (1, 2))
    plans = F.transform(F.filter(F.arrays_zip(ids.alias("id"), texts.alias("t")), lambda n: n["t"].contains("10b5-1")), lambda n: n["id"])
    found = F.regexp_extract_all("safe", F.lit(r"(?s)<nonDerivativeTransaction>.*?</nonDerivativeTransaction>"), F.lit(0))
    x = x.select("source_ref", "problem", "f", plans.alias("plans"), F.posexplode_outer(F.when(F.col("problem").isNull(), found)).alias("tx_index", "xml"))
    x = x.withColumn("t", F.from_xml("xml", _DEAL)).withColumn("notes", F.regexp_extract_all("xml", F.lit(r'<footnoteId\s+id="([^"]*)"'), F.lit(1)))
    flags = F.col("f.reportingOwner.reportingOwnerRelationship")
    role = F.lit(None).cast("string")
    for flag, name in reversed(ROLES):
        role = F.when(F.lower(F.trim(flags[flag])).isin("1", "true"), name).otherwise(role)
    number = lambda c: finite(F.replace(F.trim(F.col(f"t.transactionAmounts.{c}.value")), F.lit(","), F.lit("")))
    code: Column = F.trim(F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value"))
    direction = F.lit(None).cast("string")
    for c, name in DIRECTIONS.items():
        direction = F.when(code == c, name).otherwise(direction)
    return x.where("problem is not null or xml is not null").select(
        "source_ref", F.col("f.reportingOwner.reportingOwnerId.rptOwnerName").alias("insider"), role.alias("role"), filled(F.trim(flags["officerTitle"])).alias("title"),
        filled(F.trim(F.col("t.transactionDate.value")), F.col("f.periodOfReport")).alias("date"), direction.alias("direction"), number("transactionShares").alias("shares"), number("transactionPricePerShare").alias("price"),
        F.trim(F.col("t.securityTitle.value")).alias("security"), F.coalesce(F.arrays_overlap("notes", "plans"), F.lit(False)).alias("planned"), "tx_index", "problem",
    )
