"""Raw objects by their content: (sha256, path, size, kind, content, reason)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes in hexadecimal, and the kinds that only a file's name tells.
MAGIC = {"25504446": "pdf", "504b0304": "zip"}
BY_NAME = ("csv", "tsv", "json", "docx", "xlsx")
#: Fixed value: largest document that is taken in.
MOST_BYTES = 256 * 1024 * 1024


def kind_of(content: Column, path: Column) -> Column:
    """pdf, docx, xlsx, zip, html, json, csv, tsv or txt."""
    head, name = F.lower(F.hex(F.substring(content, 1, 4))), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    start = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "iso-8859-1")))
    found = F.lit(None).cast("string")
    for magic, kind in MAGIC.items():
        found = F.when(head == magic, kind).otherwise(found)
    office = F.when((found == "zip") & name.isin("docx", "xlsx"), name)
    html = F.when(start.rlike("^<(!doctype html|html|body|p|div|table)\\b"), "html")
    return F.coalesce(office, found, html, F.when(name.isin(*BY_NAME), name), F.when(start.rlike(r"^[\[{]"), "json"), F.lit("txt"))


def objects(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Each distinct content below *path* once, under its first path; a file of more than *most* bytes has a reason instead of its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    taken = files.where(F.col("length") <= most).select(F.sha2("content", 256).alias("sha256"), "path", "content")
    one = taken.groupBy("sha256").agg(F.min("path").alias("path"), F.first("content").alias("content"))  # equal contents, so any will do
    kept = one.select("sha256", "path", F.length("content").cast("long").alias("size"), kind_of(F.col("content"), F.col("path")).alias("kind"), "content", F.lit(None).cast("string").alias("reason"))
    none = lambda kind: F.lit(None).cast(kind)
    large = files.where(F.col("length") > most).select(none("string").alias("sha256"), "path", F.col("length").alias("size"), none("string").alias("kind"), none("binary").alias("content"), F.concat(F.lit("too_large: "), F.col("length").cast("string")).alias("reason"))
    return kept.unionByName(large)


def unstored(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Objects whose content is not stored yet; those that were refused have none."""
    return found.where("sha256 is not null").join(stored.select("sha256"), "sha256", "left_anti")


def unreferenced(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Objects that no fact cites by source_ref: these may be pruned."""
    return stored.join(facts.select(F.col("source_ref").alias("sha256")).where("sha256 is not null"), "sha256", "left_anti")
