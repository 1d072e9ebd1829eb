"""Sector measures by name, their inputs from verified records, and statistics of a peer set at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import concepts as C
from ledgerlight.functions.text import scaled_unit

from . import groups, picks

#: Measures of each sector as (name, unit, kind, inputs). Kinds: ratio, percent, value, mean (of an array), difference,
#: and a few of their own.
MARITIME = (
    ("spot_TCE_per_day_by_class", "USD/day", "ratio", ("voyage_revenue_usd", "voyage_days")),
    ("time_charter_TCE_per_day_by_class", "USD/day", "ratio", ("contract_revenue_usd", "contract_days")),
    ("fleet_utilization_pct", "pct", "utilization", ("off_hire_days",)),
    ("off_hire_days", "days", "value", ("off_hire_days",)),
    ("revenue_per_ship_by_class", "USD", "ratio", ("class_revenue_usd", "ships_in_class")),
    ("vessel_OPEX_per_day_by_class_and_age", "USD/day", "ratio", ("opex_usd", "vessel_days")),
    ("technical_OPEX_per_day", "USD/day", "ratio", ("technical_opex_usd", "vessel_days")),
    ("G&A_per_ship_per_year", "USD", "ratio", ("ga_usd", "ship_count")),
    ("daily_vessel_margin", "USD/day", "difference", ("tce_per_day", "opex_per_day")),
    ("vessel_breakeven_TCE", "USD/day", "breakeven", ("opex_total_usd", "financing_cost_usd", "ga_usd", "ship_count")),
    ("fleet_count_by_class", "ships", "value", ("count",)),
    ("average_fleet_age", "years", "value", ("mean_age",)),
    ("average_residual_years_by_class", "years", "value", ("mean_residual_years",)),
    ("spot_vs_time_charter_exposure_pct", "pct", "percent", ("spot_revenue_usd", "total_revenue_usd")),
    ("orderbook_to_fleet_ratio_pct", "pct", "percent", ("orderbook_ships", "fleet_ships")),
    ("newbuilding_price_index_by_class", "USD", "value", ("newbuilding_price_usd",)),
    ("secondhand_price_index_by_class", "USD", "value", ("secondhand_price_usd",)),
    ("scrapping_age_profile", "years", "value", ("mean_age_of_scrapped",)),
    ("bunker_spread_HSFO_VLSFO", "USD/tonne", "difference", ("hsfo_price_usd", "vlsfo_price_usd")),
    ("CII_per_ship", "g CO2/tonne-mile", "value", ("cii_grams_per_tonmile",)),
    ("scrubber_fitted_pct", "pct", "percent", ("scrubber_ships", "fleet_ships")),
    ("IMO_2020_readiness_pct", "pct", "percent", ("ready_ships", "fleet_ships")),
    ("port_congestion_TEU_waiting", "TEU", "value", ("teu",)),
    ("idle_capacity_pct", "pct", "percent", ("idle_ships", "fleet_ships")),
    ("blank_sailings_pct", "pct", "percent", ("blank_sailings", "scheduled_sailings")),
)
MINING = (
    ("production_volume_tons", "tons", "value", ("production_volume",)),
    ("ore_grade_g_per_ton", "g/t", "value", ("grade",)),
    ("reserves_to_production_ratio", "years", "ratio", ("reserves", "production_volume")),
    ("cash_cost_per_ounce", "USD/t", "ratio", ("cash_cost_per_unit", "grade_multiplier")),
    ("production_per_employee", "tons/person", "ratio", ("production_volume", "employees")),
    ("revenue_per_ton", "USD/t", "ratio", ("revenue_usd", "production_volume")),
    ("reserve_replacement_pct", "pct", "percent_up", ("reserves_added", "reserves_mined")),
    ("all_in_sustaining_cost", "USD/t", "ratio", ("aisc_usd", "production_volume")),
    ("production_cost_ratio", "ratio", "ratio", ("cash_cost_per_unit", "realized_price")),
    ("realized_price_per_ton", "USD/t", "value", ("realized_price",)),
)
SECTORS = {"tankers": MARITIME, "mining": MINING}
YEAR_DAYS = 365


def measures(rows: DataFrame, sector: str) -> DataFrame:
    """(id, concept, value, unit, reason): every measure of a sector for each row.

    rows (id, inputs map<string,double>, unverified array, refused map<string,string>). An unverified input comes before one of another
    unit, and that before a missing one, which is named. Only a zero refuses a denominator.
    """
    table = rows.sparkSession.createDataFrame([(n, u, k, list(i)) for n, u, k, i in SECTORS[sector]], "concept string, unit string, kind string, needs array<string>")
    r = rows.crossJoin(F.broadcast(table))  # a fixed table of tens of rows
    at = lambda i: F.try_element_at("inputs", F.try_element_at("needs", F.lit(i)))
    a, b = at(1), at(2)
    spread = F.aggregate(F.slice("needs", 1, 3), F.lit(0.0), lambda s, n: s + F.try_element_at("inputs", n))
    kind = F.col("kind")
    den = F.when(kind.isin("ratio", "percent", "percent_up"), b).when(kind == "breakeven", at(4))
    value = (
        F.when(kind == "value", a).when(kind == "difference", a - b).when(kind == "ratio", F.try_divide(a, b)).when(kind.isin("percent", "percent_up"), F.try_divide(a, b) * 100)
        .when(kind == "utilization", (YEAR_DAYS - a) / YEAR_DAYS * 100).when(kind == "breakeven", F.try_divide(spread, at(4)) / YEAR_DAYS)
    )
    foreign = F.filter("needs", lambda n: F.try_element_at("refused", n).isNotNull())
    missing = F.array_sort(F.filter("needs", lambda n: F.try_element_at("inputs", n).isNull()))
    why = F.when(F.arrays_overlap("needs", "unverified"), "manual_unverified").when(F.size(foreign) > 0, F.concat(F.lit("missing_data: unit_mismatch:"), F.try_element_at("refused", F.try_element_at(foreign, F.lit(1)))))
    why = why.when(F.size(missing) > 0, F.concat(F.lit("no "), F.array_join(missing, ", "))).when(den == 0, "denominator_zero")
    why = why.when(kind.isin("percent_up", "utilization") & (value < 0), "negative_denominator")
    return r.select("id", "concept", F.when(why.isNull(), value).alias("value"), "unit", why.alias("reason"))


def collected(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, inputs, unverified, refused) from records (id, record_id, metric, value, unit, verified); the first of an input wins.

    wanted (metric, input, unit): names of records as they are compared, and the unit after the scale word. Unverified records
    give no number; so do records of another unit, of which the one wanted is kept.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.translate("metric", "_.", "  ")), r"\s+", " "))
    w = wanted.withColumnRenamed("unit", "want")
    r = records.withColumn("metric", plain).withColumn("s", scaled_unit(F.col("unit"))).join(F.broadcast(w), "metric")
    r = picks.first_by(r, ["id", "input"], F.desc("verified"), "record_id")
    ok = F.col("s.base") == F.col("want")
    put = lambda cond, v: F.map_from_entries(F.collect_list(F.when(cond, F.struct("input", v.alias("v")))))
    return r.groupBy("id").agg(
        put(F.col("verified") & ok, F.col("value") * F.col("s.multiplier")).alias("inputs"),
        F.array_sort(F.collect_list(F.when(~F.col("verified"), F.col("input")))).alias("unverified"),
        put(F.col("verified") & ~ok, F.col("want")).alias("refused"),
    )


def aggregates(members: DataFrame, measures: DataFrame, money: tuple[str, ...], as_of: str, window: int = 730) -> DataFrame:
    """(set_id, concept, p25, median, p75, n, currency, no_value, no_snapshot, excluded, reason) of each peer set at a date.

    members (set_id, member, verified); measures (member, as_of, version, concept, value, currency, period_end): of each member the
    newest snapshot up to the date counts. Members whose period ended over *window* days before the newest one of the set are left
    out, then mixed currencies refuse concepts of *money*, then an unconfirmed set, then fewer than eight values.
    """
    m = measures.where(F.col("as_of") <= F.lit(as_of).cast("date"))
    last = m.groupBy("member").agg(F.max(F.struct("as_of", "version")).alias("s")).select("member", F.col("s.as_of").alias("as_of"), F.col("s.version").alias("version"))
    now = m.join(last, ["member", "as_of", "version"])
    grid = members.join(now.select("concept").distinct(), how="cross")  # members times the few concepts of the catalogue
    r = grid.join(last.select("member", F.lit(True).alias("has")), "member", "left").join(now.select("member", "concept", "value", "currency", "period_end"), ["member", "concept"], "left")
    top = r.groupBy("set_id", "concept").agg(F.max("period_end").alias("top"))
    r = r.join(F.broadcast(top), ["set_id", "concept"])
    out = F.coalesce(F.datediff("top", "period_end") > window, F.lit(False))
    own = F.when(~out & F.col("value").isNotNull(), F.coalesce("currency", F.lit("(blank)")))
    g = r.groupBy("set_id", "concept").agg(
        F.bool_and("verified").alias("verified"), F.count_if(out).alias("excluded"), F.count_if(F.col("has").isNull()).alias("no_snapshot"),
        F.count_if(~out & F.col("value").isNull()).alias("no_value"), F.count(F.when(~out, F.col("value"))).alias("c"), F.array_sort(F.collect_set(own)).alias("money"),
        F.percentile(F.when(~out, F.col("value")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    )
    mixed = F.when(F.col("concept").isin(*money) & (F.size("money") > 1), F.concat(F.lit("currency_mismatch: "), F.array_join("money", ", ")))
    why = F.coalesce(mixed, F.when(~F.col("verified"), "peer_set_not_confirmed"), F.when(F.col("c") < groups.QUARTILES_FROM, "peer_set_too_small"))
    n = F.when(mixed.isNotNull() | why.isNull(), F.col("c")).otherwise(0)
    unit = F.when(F.col("concept").isin(*money) & (F.size("money") == 1), F.nullif(F.col("money")[0], F.lit("(blank)")))
    stats = [F.when(why.isNull(), F.col("q")[i]).alias(c) for i, c in enumerate(("p25", "median", "p75"))]
    return g.select("set_id", "concept", *stats, n.alias("n"), unit.alias("currency"), "no_value", "no_snapshot", "excluded", why.alias("reason"))


def concentration(members: DataFrame, value: str = "value") -> DataFrame:
    """(set_id, hhi, n, currency, reason) of members (set_id, value, currency): mixed currencies refuse, so does nobody."""
    g = members.where(F.col(value).isNotNull()).groupBy("set_id").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("s2"), F.array_sort(F.collect_set(F.coalesce("currency", F.lit("(blank)")))).alias("c"))
    g = members.select("set_id").distinct().join(g, "set_id", "left")
    why = F.when(F.col("n").isNull(), "no_contributors").when(F.size("c") > 1, F.concat(F.lit("currency_mismatch: "), F.array_join("c", ", "))).when(F.col("s") == 0, "denominator_zero")
    return g.select("set_id", F.when(why.isNull(), F.try_divide("s2", F.col("s") * F.col("s"))).alias("hhi"), F.coalesce("n", F.lit(0)).alias("n"), F.when(why.isNull(), F.col("c")[0]).alias("currency"), why.alias("reason"))


def manual_map(spark: SparkSession) -> DataFrame:
    """(metric, concept): names of manual records as they are compared."""
    return spark.createDataFrame([(c.replace("_", " "), c) for c in C.US_GAAP if c not in C.NOT_MANUAL], "metric string, concept string")


def peer_status(n: Column, churn: Column) -> Column:
    """Under 5 members no percentile, under 8 no quartiles; over 20 % changed members is suspect."""
    return F.when(churn > 0.2, "suspect").when(n < groups.PERCENTILE_FROM, "too_small").when(n < groups.QUARTILES_FROM, "percentile_only").otherwise("ok")
