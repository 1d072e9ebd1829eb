"""Operator 8: URL filter by rules and by gradient-boosted trees on lexical features.

A rule allows or blocks a host, its subdomains and a path. URLs that a rule fits are the labelled ones; of
a bounded sample of them (max_rows, those of least hash) trees learn from lexical features: lengths, depth,
digit ratio, entropy, parameter counts and the block rates of suffixes, which are counted over all labelled URLs.
Other URLs get the trees' verdict.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules: verdict and host with path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rows that the trees learn from; rates up to SMALL rows are broadcast, more are joined by a shuffle.
MAX_ROWS, SMALL = 5000, 20_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    raw = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(raw, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(raw, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(rows: DataFrame) -> DataFrame:
    """The rows with top, the last label of the host, and first, it with the first part of the path."""
    top = F.substring_index("host", ".", -1)
    return rows.withColumn("top", top).withColumn("first", F.concat(top, F.lit("/"), F.coalesce(F.get(F.split("path", "/", 3), F.lit(1)), F.lit(""))))


def with_rates(rows: DataFrame, labelled: DataFrame, prior: float):
    """A function that adds top_rate and first_rate to rows with top and first: the block rates of all labelled URLs, drawn to the prior."""
    tables = {}
    for key in ("top", "first"):
        rates = labelled.groupBy(key).agg(((F.sum("label") + 4 * prior) / (F.count("*") + 4)).alias(f"{key}_rate"))
        few = rates.limit(SMALL + 1).collect()
        tables[key] = F.broadcast(rows.sparkSession.createDataFrame(few, rates.schema)) if len(few) <= SMALL else rates

    def add(to: DataFrame) -> DataFrame:
        to = to.join(tables["top"], "top", "left").join(tables["first"], "first", "left")
        to = to.withColumn("top_rate", F.coalesce("top_rate", F.lit(prior)))
        return to.withColumn("first_rate", F.coalesce("first_rate", "top_rate"))

    return add


def lexical() -> Column:
    """The features of a row with url, host, path and the two rates, in SQL functions."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    values = [
        F.length(url), F.length(host), F.length(path), count(path, "/"), count(host, "."), digits, digits / size, entropy, F.regexp_count(query, F.lit("[^&]+")), F.length(query), count(url, "-"),
        url.startswith("https").cast("int"), url.contains("#").cast("int"), path.endswith("/").cast("int"), F.substring_index(path, "/", -1).contains(".").cast("int"), F.col("top_rate"), F.col("first_rate"),
    ]
    return F.array(*[v.cast("double") for v in values])


def url_verdicts(pages: DataFrame, rules=RULES, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of *pages* (page_id, url) with host, path, rule and verdict.

    Null urls and urls without :// have an empty host and path; such urls, fitting no rule, get the trees' verdict too. Where the labelled
    urls are of one verdict only it is everyone's (allow, without any). Rows without page_id are left out; repeated
    rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    labelled = suffixes(rows.where("r is not null").select("url", "host", "path", (F.col("r.verdict") == "block").cast("int").alias("label")).distinct())
    good = rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"), "url")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if blocked in (0, n):
        verdict = "block" if blocked else "allow"
        return good.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(verdict)).alias("verdict"))
    prior = blocked / n
    rated = with_rates(rows, labelled, prior)
    least = lambda of, most: rated(of.orderBy(F.xxhash64("url"), "url", "host").limit(most)).select("label", "url", "host", lexical().alias("x")).toPandas()
    sample = least(labelled, max_rows)
    if sample.label.nunique() == 1:  # the other verdict is rare
        sample = pd.concat([sample, least(labelled.where(F.col("label") != int(sample.label.iloc[0])), max_rows)])
    sample = sample.sort_values(["url", "host"], ignore_index=True)
    train = pd.DataFrame({"label": sample.label.astype(float), "x": sample.x.map(list)})
    spark = pages.sparkSession
    # the suffix rates were made from the same labels: half of the sample learns without them, so that the trees also use the rest
    half = train.copy()
    half["x"] = [x[:-2] + [prior, prior] for x in half.x]
    table = spark.createDataFrame(pd.concat([train, half]), "label double, x array<double>").repartition(2).select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=8, maxDepth=3, maxBins=32, seed=7).fit(table)

    todo = rated(suffixes(good.where("own is null")))
    judged = model.transform(todo.withColumn("features", array_to_vector(lexical())))
    of_trees = judged.select("page_id", "host", "path", "rule", F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict"))
    return good.where("own is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict")).union(of_trees)
