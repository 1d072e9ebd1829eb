"""What a source gives: poor ones with their commonest reason, cells that are filled and those that are not, and metrics of the system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The metrics of the system.
METRICS = (
    "provider_success_rate", "provider_rate_limited", "data_lag", "suspect_share", "unparsed_share", "verification_queue", "peer_set_coverage", "peer_set_churn", "locator_resolve_failures",
)


def poor_sources(measures: DataFrame, key: list[str]) -> DataFrame:
    """(*key, valued, total, dominant_reason, reason_count) where under a quarter of the measures (value, null_reason) have a value.

    The reason is the commonest first word of the refusals, of equally common ones the first by name; null where there is none.
    """
    token = F.when(F.col("value").isNull() & (F.coalesce("null_reason", F.lit("")) != ""), F.split("null_reason", ":")[0])
    c = measures.groupBy(*key, token.alias("token")).agg(F.count("*").alias("n"), F.count("value").alias("valued"))
    best = F.min(F.when(F.col("token").isNotNull(), F.struct((-F.col("n")).alias("n"), "token")))
    g = c.groupBy(*key).agg(F.sum("valued").alias("valued"), F.sum("n").alias("total"), best.alias("b"))
    return g.where("valued * 4 < total").select(*key, "valued", "total", F.col("b.token").alias("dominant_reason"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("reason_count"))


def fill(cells: DataFrame, key: list[str]) -> DataFrame:
    """(*key, filled, applicable, gaps) of cells (*key, concept, year, value, senseless): cells that make no sense are not applicable, gaps are
    the empty others (concept, year). A card has tens of concepts and some years, so its gaps are one array."""
    fits = ~F.coalesce("senseless", F.lit(False))
    gap = F.when(fits & F.col("value").isNull(), F.struct("concept", "year"))
    return cells.groupBy(*key).agg(F.count_if(fits & F.col("value").isNotNull()).alias("filled"), F.count_if(fits).alias("applicable"), F.array_sort(F.collect_list(gap)).alias("gaps"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def system_metrics(calls: DataFrame, raw: DataFrame, facts: DataFrame, verifications: DataFrame, instruments: DataFrame, members: DataFrame, locators: DataFrame, now: Column) -> DataFrame:
    """(metric, value) of the nine METRICS; only those that are observed have a row.

    calls (made, refused, rate_limited) are counters by provider; raw (fetched_at, parsed); facts (status); verifications (open);
    instruments (id, has_peers); members (set_id, version, member); locators (status as of resolved()). The churn is that of the set whose
    newest version is the last by number: members that differ between its last two versions over the larger of these.
    """
    two = members.select("set_id", "version").distinct()
    newest = two.withColumn("r", F.dense_rank().over(Window.partitionBy("set_id").orderBy(F.desc("version"))))
    top = newest.where("r = 1").agg(F.max(F.struct("version", "set_id")).alias("t")).select(F.col("t.set_id").alias("set_id"))
    last = members.join(newest.where("r <= 2"), ["set_id", "version"]).join(F.broadcast(top), "set_id")  # one row
    both = last.groupBy("member").agg(F.max((F.col("r") == 1).cast("int")).alias("now"), F.max((F.col("r") == 2).cast("int")).alias("before"))
    larger = F.greatest(F.sum("now"), F.sum("before"))
    made, refused, limited = (F.sum(c) for c in ("made", "refused", "rate_limited"))
    parts = [
        calls.agg(_share(made, made + refused).alias("provider_success_rate"), F.when((limited > 0) | (made > 0), limited).alias("provider_rate_limited")),
        raw.agg((F.unix_timestamp(now) - F.unix_timestamp(F.max("fetched_at"))).alias("data_lag"), _share(F.count_if(~F.col("parsed")), F.count("*")).alias("unparsed_share")),
        facts.agg(_share(F.count_if(F.col("status") == "suspect"), F.count("*")).alias("suspect_share")),
        verifications.agg(F.nullif(F.count_if("open"), F.lit(0)).alias("verification_queue")),
        instruments.agg(_share(F.count_if("has_peers"), F.count("*")).alias("peer_set_coverage")),
        both.agg(F.when(F.sum("before") > 0, _share(F.count_if(F.col("now") != F.col("before")), larger)).alias("peer_set_churn")),
        locators.agg(_share(F.count_if(F.col("status") == "unresolved"), F.count("*")).alias("locator_resolve_failures")),
    ]
    out = None
    for p in parts:
        rows = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns])).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out.where("value is not null")
