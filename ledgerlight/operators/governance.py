"""Governance indicators: five rules of colour, and which colour is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import picks

#: Thresholds of the rules, and days after which a colour is grey.
DIRECTORS, RELATED, INSIDER, STALE_DAYS = (0.50, 0.33), (0.03, 0.005), (0.001, -0.005), 450
INDICATORS = ("independent_directors", "ceo_chair", "related_party", "insider_net", "auditor")


def _grey(cond: Column, why: str, rule: Column) -> Column:
    return F.when(cond, F.struct(F.lit("gray").alias("color"), F.lit(f"no_data:{why}").alias("reason"))).otherwise(rule)


def _color(color: Column, reason: Column) -> Column:
    return F.struct(color.alias("color"), reason.alias("reason"))


def independent_directors(share: Column) -> Column:
    color = F.when(share >= DIRECTORS[0], "green").when(share >= DIRECTORS[1], "yellow").otherwise("red")
    return _grey(share.isNull(), "board_independence_not_disclosed", _color(color, F.concat(F.lit("share="), share.cast("string"))))


def ceo_chair(separated: Column, lead: Column) -> Column:
    color = F.when(separated, "green").when(lead, "yellow").otherwise("red")
    reason = F.when(separated, "roles_separated").when(lead, "combined_with_lead_independent").otherwise("combined_without_lead_independent")
    return _grey(separated.isNull(), "board_leadership_not_disclosed", _grey(~separated & lead.isNull(), "combined_but_lead_status_not_disclosed", _color(color, reason)))


def related_party(ratio: Column, approved: Column) -> Column:
    refused = F.coalesce(~approved, F.lit(False))
    color = F.when(refused | (ratio > RELATED[0]), "red").when(ratio >= RELATED[1], "yellow").otherwise("green")
    reason = F.concat(F.lit("ratio="), ratio.cast("string"), F.lit(",approved="), F.coalesce(F.initcap(approved.cast("string")), F.lit("None")))
    return _grey(ratio.isNull(), "related_party_section_absent", _color(color, reason))


def insider_net(ratio: Column, planned: Column, net: Column) -> Column:
    """ratio: net deals to market value; planned sales are named with their share of the net."""
    color = F.when(ratio > INSIDER[0], "green").when(ratio < INSIDER[1], "red").otherwise("yellow")
    reason = F.when(ratio > INSIDER[0], "net_buys>0.001").when(ratio < INSIDER[1], "net_sales>0.005").when(ratio >= -INSIDER[0], "within_pm_0.1pct").otherwise("sales_below_0.5pct_not_red_yellow_band")
    share = F.when(net != 0, F.format_string(" (%.0f%% of net)", F.abs(F.try_divide(planned, net)) * 100)).otherwise("")
    told = F.when(F.coalesce(planned, F.lit(0.0)) != 0, F.concat(F.format_string(";tenb5_net=%+.0f", planned), share)).otherwise("")
    return _grey(ratio.isNull(), "insider_deals_not_disclosed", _color(color, F.concat(reason, told)))


#: Names of records put in by hand, and the indicator and input that each one feeds; words for yes and no.
RECORDS = {
    "independent_directors_share": ("independent_directors", "share"), "ceo_chair_roles_separated": ("ceo_chair", "roles_separated"), "ceo_chair_lead_independent": ("ceo_chair", "lead_independent"),
    "related_party_ratio": ("related_party", "ratio"), "auditor_changes_in_5y": ("auditor", "changes_in_5y"), "auditor_qualified_opinion": ("auditor", "qualified_opinion"), "auditor_tenure_years": ("auditor", "tenure_years"),
}
YES, NO = ("yes", "true"), ("no", "false")


def from_records(records: DataFrame) -> DataFrame:
    """(issuer, indicator, inputs, lineage_ref, reason) of records (issuer, record_id, sha256, page, metric, value, verified).

    Names are compared in lower case with blanks and dashes as underscores; other names are left out. Of records of one input the last
    counts, of equal ids that of the last reference; the reference is that of the indicator's first record. If one of its records isn't verified an indicator has no inputs but the
    reason manual_unverified, never a colour.
    """
    of = F.create_map(*[x for n, (i, k) in RECORDS.items() for x in (F.lit(n), F.struct(F.lit(i).alias("indicator"), F.lit(k).alias("input")))])
    name = F.regexp_replace(F.lower(F.trim("metric")), r"[\s\-]+", "_")
    word = F.lower(F.trim("value"))
    value = F.when(word.isin(*YES), "true").when(word.isin(*NO), "false").otherwise(F.coalesce(word.try_cast("double").cast("string"), F.col("value")))
    r = records.withColumn("m", F.try_element_at(of, name)).where("m is not null").select("issuer", "record_id", "m.*", value.alias("value"), F.coalesce("verified", F.lit(False)).alias("verified"), F.concat("sha256", F.lit("#page="), F.col("page").cast("string")).alias("ref"))
    one = r.groupBy("issuer", "indicator", "input").agg(F.max_by("value", F.struct("record_id", "ref", "value")).alias("value"), F.min(F.struct("record_id", "ref")).alias("first"), F.bool_and("verified").alias("verified"))
    g = one.groupBy("issuer", "indicator").agg(F.map_from_entries(F.collect_list(F.struct("input", "value"))).alias("inputs"), F.min("first").alias("first"), F.bool_and("verified").alias("ok"))
    return g.select("issuer", "indicator", F.when(F.col("ok"), F.col("inputs")).alias("inputs"), F.col("first.ref").alias("lineage_ref"), F.when(~F.col("ok"), "manual_unverified").alias("reason"))


def insider_inputs(deals: DataFrame, price_rows: DataFrame, caps: DataFrame, targets: DataFrame, days: int = 365) -> DataFrame:
    """(issuer, at, deals, net_value, net_ratio, planned_net, reason): insiders' net deals in money over the market value.

    deals (issuer, id, date, direction, shares, planned), price_rows (id, date, close, currency), caps (issuer, at, value, unit),
    targets (issuer, at). A deal is worth its shares at the newest close up to its own date. Refused by name: no deals in the *days* before,
    no market value, a deal without a price (a part is no net), prices in another currency than the market value.
    """
    priced = picks.as_of(deals, price_rows, "id", "date", "date", ["close", "currency"])
    money = F.coalesce("shares", F.lit(0.0)) * F.col("close")
    sign = F.when(F.col("direction") == "acquired", 1).when(F.col("direction") == "disposed", -1).otherwise(0)
    # a planned deal that isn't acquired counts as sold, whatever it is called
    own = priced.select("issuer", "date", (money * sign).alias("net"), F.when(F.col("planned"), F.when(sign == 1, money).otherwise(-money)).alias("plan"), F.col("close").isNull().alias("open"), F.nullif("currency", F.lit("")).alias("currency"))
    d = targets.join(own, "issuer").where((F.col("date") <= F.col("at")) & (F.col("date") >= F.date_sub("at", days)))
    g = d.groupBy("issuer", "at").agg(F.count("*").alias("deals"), F.sum("net").alias("net"), F.coalesce(F.sum("plan"), F.lit(0.0)).alias("plan"), F.count_if("open").alias("open"), F.collect_set("currency").alias("money"))
    x = targets.join(g, ["issuer", "at"], "left").join(caps.select("issuer", "at", F.col("value").alias("cap"), "unit"), ["issuer", "at"], "left")
    odd = F.exists(F.coalesce("money", F.array().cast("array<string>")), lambda c: c != F.col("unit"))
    why = (
        F.when(F.col("deals").isNull(), "insider_deals_not_disclosed").when(F.coalesce("cap", F.lit(0.0)) == 0, "ownership_without_market_cap").when(F.col("open") > 0, "ownership_without_deal_price").when(odd, "insider_deal_currency_mismatch")
    )
    put = lambda v: F.when(why.isNull(), v)
    return x.select("issuer", "at", F.coalesce("deals", F.lit(0)).alias("deals"), put(F.col("net")).alias("net_value"), put(F.col("net") / F.col("cap")).alias("net_ratio"), put(F.col("plan")).alias("planned_net"), why.alias("reason"))


def auditor(changes: Column, qualified: Column, tenure: Column) -> Column:
    color = F.when(qualified | (changes >= 2), "red").when(changes == 1, "yellow").when(tenure >= 5, "green").otherwise("gray")
    reason = (
        F.when(qualified, "qualified_or_declined_opinion").when(changes >= 2, F.concat(changes.cast("string"), F.lit(" auditor_changes_in_5y"))).when(changes == 1, "one_auditor_change_in_5y")
        .when(tenure >= 5, "same_auditor_5y_clean_opinion").otherwise(F.concat(F.lit("no_data:disclosure_window_short:"), tenure.cast("string"), F.lit("y")))
    )
    return _grey(changes.isNull() | qualified.isNull() | tenure.isNull(), "auditor_not_disclosed", _color(color, reason))


def assessed(inputs: DataFrame) -> DataFrame:
    """(issuer, indicator, color, reason, at) of inputs (issuer, at, share, separated, lead, ratio, approved, net_ratio, planned, net, changes, qualified, tenure)."""
    c = F.col
    made = (
        independent_directors(c("share")), ceo_chair(c("separated"), c("lead")), related_party(c("ratio"), c("approved")), insider_net(c("net_ratio"), c("planned"), c("net")),
        auditor(c("changes"), c("qualified"), c("tenure")),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("indicator"), m["color"].alias("color"), m["reason"].alias("reason")) for n, m in zip(INDICATORS, made, strict=True)])
    return inputs.select("issuer", "at", F.explode(rows).alias("r")).select("issuer", "r.*", "at")


def shown(assessments: DataFrame, overrides: DataFrame, as_of: str, stale: int = STALE_DAYS) -> DataFrame:
    """(issuer, indicator, color, reason): an override of the same indicator wins; a colour over *stale* days old is grey."""
    o = overrides.select("issuer", "indicator", F.col("color").alias("_c"), F.col("reason").alias("_r"))
    a = assessments.join(o, ["issuer", "indicator"], "full")
    old = F.datediff(F.lit(as_of).cast("date"), "at") > stale
    color = F.when(F.col("_c").isNotNull(), F.col("_c")).when(old, "gray").otherwise(F.col("color"))
    reason = F.when(F.col("_c").isNotNull(), F.concat(F.lit("override:"), F.coalesce("_r", F.lit("")))).when(old, F.concat(F.lit("stale:"), F.col("at").cast("string"))).otherwise(F.col("reason"))
    return a.select("issuer", "indicator", color.alias("color"), reason.alias("reason"))
