"""Concept maps, governance, sector measures and statistics of peer sets, each with its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import concepts as C
from ledgerlight.operators import governance as G
from ledgerlight.operators import sectors as S
from ledgerlight.operators import valuation as V

from .model import SECTORS, periods, periods_sql, query, r6, read, sectors

#: Filed tags with what they should map to: tag, concept, rank.
_TAGS = (
    ("us-gaap:Revenues", "revenue", 0), ("us-gaap:SalesRevenueNet", "revenue", 3), ("ifrs-full:Revenue", "revenue", 100), ("us-gaap:NetIncomeLoss", "net_income", 0),
    ("ifrs-full:ProfitLoss", "net_income", 101), ("us-gaap:Assets", "total_assets", 0), ("dei:EntityCommonStockSharesOutstanding", "shares_outstanding", 1000),
    ("us-gaap:CommonStockSharesOutstanding", "shares_outstanding", 0), ("us-gaap:Goodwill", None, None), ("cvm-dfp:3.08", "tax_expense", 0), ("revenue", "revenue", 4),
    ("us-gaap:DebtLongtermAndShorttermCombinedAmount", "total_debt", 1), ("ifrs-full:Goodwill", None, None),
)
_N = len(_TAGS)
_LIST = ", ".join(f"'{t}'" for t, _, _ in _TAGS)
_VALUES = ", ".join(f"('{t}', {f"'{c}'" if c else 'NULL'}, {r if c else 'NULL'})" for t, c, r in _TAGS)
_FILED = f"""filed AS (SELECT l_suppkey AS issuer, [{_LIST}][l_partkey % {_N} + 1] AS concept, l_orderkey * 100 + l_linenumber AS fact_id, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem),
known AS (SELECT * FROM (VALUES {_VALUES}) t(concept, canonical, tag_rank))"""


def _filed(spark, d):
    tag = F.element_at(F.array(*[F.lit(t) for t, _, _ in _TAGS]), (F.col("l_partkey") % _N + 1).cast("int"))
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("issuer"), tag.alias("concept"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("fact_id"), F.col("l_extendedprice").alias("value"))


@query(f"""WITH {_FILED} SELECT issuer, canonical, concept, tag_rank, fact_id FROM filed JOIN known USING (concept) WHERE canonical IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY issuer, canonical ORDER BY tag_rank, fact_id) = 1""")
def concept_map_rank(spark, d):
    """The strongest tag of each issuer and concept over three taxonomies and the cover."""
    best = C.strongest(C.mapped(_filed(spark, d)).where("canonical is not null"), ["issuer", "canonical"])
    return best.select("issuer", "canonical", "concept", F.col("tag_rank").cast("int").alias("tag_rank"), "fact_id")


@query(f"WITH {_FILED} SELECT concept, count(*) AS n FROM filed JOIN known USING (concept) WHERE canonical IS NULL GROUP BY concept")
def unmapped_tags(spark, d):
    return C.mapped(_filed(spark, d)).where("canonical is null").groupBy("concept").agg(F.count("*").alias("n"))


@query(f"""WITH {_FILED} SELECT issuer, sum(CASE WHEN concept LIKE 'ifrs-full:%' THEN 1 WHEN concept LIKE 'us-gaap:%' THEN -1 ELSE 0 END) > 0 AS mainly_ifrs FROM filed GROUP BY issuer""")
def mainly_ifrs(spark, d):
    return C.mainly_ifrs(_filed(spark, d))


@query(f"""WITH {_FILED} SELECT fact_id, CASE WHEN concept = 'cvm-dfp:3.08' THEN CASE WHEN v = 0 THEN 0.0 ELSE 0 - v END ELSE v END AS value FROM (SELECT *, CASE WHEN fact_id % 4 = 0 THEN 0 ELSE round(value - 30000, 2) END AS v FROM filed)""")
def cvm_signs(spark, d):
    v = F.when(F.col("fact_id") % 4 == 0, 0.0).otherwise(F.round(F.col("value") - 30000, 2))
    return C.mapped(_filed(spark, d).withColumn("value", v)).select("fact_id", C.cvm_sign(F.col("taxonomy"), F.col("tag"), F.col("value")).alias("value"))


_METRICS = ("Net_Income.", "  total   EQUITY incl nci ", "Revenue", "net profit", "shares_outstanding", "D.and.A")


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_orderkey % {len(_METRICS)} WHEN 0 THEN 'net_income' WHEN 1 THEN 'total_equity_incl_nci' WHEN 2 THEN 'revenue' WHEN 5 THEN 'd_and_a' END AS canonical FROM lineitem""")
def manual_metrics(spark, d):
    m = F.element_at(F.array(*map(F.lit, _METRICS)), (F.col("l_orderkey") % len(_METRICS) + 1).cast("int"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.manual_metric(m).alias("canonical"))


@query(f"""WITH {_FILED} SELECT fact_id, CASE WHEN concept = 'us-gaap:Assets' THEN NULL WHEN issuer % 2 = 0 THEN 'own' ELSE canonical END AS canonical FROM filed JOIN known USING (concept)""")
def fill_and_withdraw(spark, d):
    """Canonical names filled only where there is none; one tag withdrawn."""
    f = _filed(spark, d).withColumn("canonical", F.when(F.col("issuer") % 2 == 0, "own"))
    return C.filled(f, withdrawn=("us-gaap:Assets",)).select("fact_id", "canonical")


_GOV = """g AS (SELECT c_custkey AS issuer, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE (c_custkey % 6) / 5.0 END AS share, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS separated,
CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS lead, CASE WHEN c_custkey % 7 <> 6 THEN (c_custkey % 7) / 100.0 END AS ratio, CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN true END AS approved,
CASE WHEN c_custkey % 8 <> 7 THEN (c_custkey % 8 - 5) / 500.0 END AS net, c_custkey % 4 AS changes, c_custkey % 9 = 0 AS qualified, CASE WHEN c_custkey % 11 <> 10 THEN c_custkey % 11 END AS tenure,
DATE '2000-01-01' + CAST(c_custkey % 700 AS INTEGER) AS day FROM customer)"""
_RULES = """
SELECT issuer, day, 'independent_directors' AS indicator, CASE WHEN share IS NULL THEN 'gray' WHEN share >= 0.5 THEN 'green' WHEN share >= 0.33 THEN 'yellow' ELSE 'red' END AS color FROM g
UNION ALL SELECT issuer, day, 'ceo_chair', CASE WHEN separated IS NULL THEN 'gray' WHEN separated THEN 'green' WHEN lead IS NULL THEN 'gray' WHEN lead THEN 'yellow' ELSE 'red' END FROM g
UNION ALL SELECT issuer, day, 'related_party', CASE WHEN ratio IS NULL THEN 'gray' WHEN approved = false OR ratio > 0.03 THEN 'red' WHEN ratio >= 0.005 THEN 'yellow' ELSE 'green' END FROM g
UNION ALL SELECT issuer, day, 'insider_net', CASE WHEN net IS NULL THEN 'gray' WHEN net > 0.001 THEN 'green' WHEN net < -0.005 THEN 'red' ELSE 'yellow' END FROM g
UNION ALL SELECT issuer, day, 'auditor', CASE WHEN tenure IS NULL THEN 'gray' WHEN qualified OR changes >= 2 THEN 'red' WHEN changes = 1 THEN 'yellow' WHEN tenure >= 5 THEN 'green' ELSE 'gray' END FROM g"""


def _boards(spark, d):
    k = F.col("c_custkey")
    three = lambda n, yes, no: F.when(k % n == yes, True).when(k % n == no, False)
    return read(spark, d, "customer").select(
        k.alias("issuer"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 700).cast("int")).alias("at"), F.when(k % 6 != 5, (k % 6) / 5.0).alias("share"), three(3, 0, 1).alias("separated"),
        three(4, 0, 1).alias("lead"), F.when(k % 7 != 6, (k % 7) / 100.0).alias("ratio"), three(5, 1, 0).alias("approved"), F.when(k % 8 != 7, (k % 8 - 5) / 500.0).alias("net_ratio"),
        F.lit(None).cast("double").alias("planned"), F.lit(None).cast("double").alias("net"), (k % 4).alias("changes"), (k % 9 == 0).alias("qualified"), F.when(k % 11 != 10, k % 11).alias("tenure"),
    )


@query(f"WITH {_GOV} SELECT issuer, indicator, color FROM ({_RULES})")
def governance_colors(spark, d):
    """Five rules on boards of every kind, undisclosed ones too."""
    return G.assessed(_boards(spark, d)).select("issuer", "indicator", "color")


@query(f"""WITH {_GOV}, r AS ({_RULES}), o AS (SELECT issuer, 'auditor' AS indicator, 'red' AS color FROM g WHERE issuer % 10 = 3)
SELECT r.issuer, r.indicator, CASE WHEN o.color IS NOT NULL THEN o.color WHEN DATE '2001-12-31' - day > 450 THEN 'gray' ELSE r.color END AS color, o.color IS NULL AND DATE '2001-12-31' - day > 450 AS stale FROM r LEFT JOIN o USING (issuer, indicator)""")
def governance_shown(spark, d):
    """Overrides win, old colours are grey."""
    a = G.assessed(_boards(spark, d))
    o = a.where("issuer % 10 = 3 and indicator = 'auditor'").select("issuer", "indicator", F.lit("red").alias("color"), F.lit("seen in print").alias("reason"))
    return G.shown(a, o, "2001-12-31").select("issuer", "indicator", "color", F.startswith("reason", F.lit("stale:")).alias("stale"))


def _ids() -> tuple:
    return F.concat_ws("/", F.col("issuer").cast("string"), F.col("start").cast("string")).alias("id"), F.col("issuer"), F.col("start")


def _sector_rows(spark, d, inputs: dict):
    q = periods(spark, d)
    some = F.map_filter(F.create_map(*[x for n, c in inputs.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())
    unverified = F.when(F.col("issuer") % 10 == 9, F.array(F.lit(list(inputs)[0]))).otherwise(F.array().cast("array<string>"))
    refused = F.when(F.col("issuer") % 10 == 8, F.create_map(F.lit(list(inputs)[1]), F.lit("days"))).otherwise(F.create_map().cast("map<string,string>"))
    return q.select(_ids()[0], some.alias("inputs"), unverified.alias("unverified"), refused.alias("refused"))


def _ratio_sql(concept: str, n: str, d: str, names: tuple[str, str], first: str, second: str, scale: str = "1") -> str:
    a, b = names
    missing = f"'no ' || concat_ws(', ', {', '.join(f"CASE WHEN {dict(zip(names, (n, d), strict=True))[x]} IS NULL THEN '{x}' END" for x in sorted(names))})"
    bad = " OR ".join(["FALSE", *(["issuer % 10 = 9"] if first in names else [])])
    unit = " OR ".join(["FALSE", *(["issuer % 10 = 8"] if second in names else [])])
    return f"""SELECT issuer || '/' || start AS id, '{concept}' AS concept, CASE WHEN NOT ({bad}) AND NOT ({unit}) AND {d} <> 0 THEN round({n} / {d} * {scale}, 6) END AS value,
    CASE WHEN {bad} THEN 'manual_unverified' WHEN {unit} THEN 'missing_data: unit_mismatch:days' WHEN {n} IS NULL OR {d} IS NULL THEN {missing} WHEN {d} = 0 THEN 'denominator_zero' END AS reason FROM t"""


_T = f"WITH {periods_sql('q')}, t AS (SELECT *, returned AS idle, CASE WHEN issuer % 3 <> 0 THEN returned END AS days FROM q)"


@query(f"""{_T} {_ratio_sql("spot_TCE_per_day_by_class", "revenue", "days", ("voyage_revenue_usd", "voyage_days"), "voyage_revenue_usd", "voyage_days")}
UNION ALL {_ratio_sql("idle_capacity_pct", "cogs", "idle", ("idle_ships", "fleet_ships"), "", "", "100")}
UNION ALL SELECT issuer || '/' || start, 'daily_vessel_margin', round(revenue - opex, 6), NULL FROM t
UNION ALL SELECT issuer || '/' || start, 'teu_missing', NULL, 'no teu' FROM t""")
def tanker_metrics(spark, d):
    """Shipping measures by name: unverified and foreign inputs, missing ones and zero denominators."""
    days = F.when(F.col("issuer") % 3 != 0, F.col("returned"))
    inputs = {"voyage_revenue_usd": F.col("revenue"), "voyage_days": days, "idle_ships": F.col("cogs"), "fleet_ships": F.col("returned"), "tce_per_day": F.col("revenue"), "opex_per_day": F.col("opex")}
    m = S.measures(_sector_rows(spark, d, inputs), "tankers")
    name = F.when(F.col("concept") == "port_congestion_TEU_waiting", "teu_missing").otherwise(F.col("concept"))
    return m.where(F.col("concept").isin("spot_TCE_per_day_by_class", "idle_capacity_pct", "daily_vessel_margin", "port_congestion_TEU_waiting")).select("id", name.alias("concept"), r6("value").alias("value"), "reason")


@query(f"""{_T} {_ratio_sql("reserves_to_production_ratio", "revenue", "days", ("reserves", "production_volume"), "reserves", "production_volume")}
UNION ALL {_ratio_sql("production_cost_ratio", "cogs", "idle", ("cash_cost_per_unit", "realized_price"), "", "")}
UNION ALL SELECT issuer || '/' || start, 'reserve_replacement_pct', CASE WHEN revenue >= opex * 1000 THEN round((revenue - opex * 1000) / revenue * 100, 6) END, CASE WHEN revenue < opex * 1000 THEN 'negative_denominator' END FROM t""")
def mining_metrics(spark, d):
    inputs = {
        "reserves": F.col("revenue"), "production_volume": F.when(F.col("issuer") % 3 != 0, F.col("returned")), "cash_cost_per_unit": F.col("cogs"), "realized_price": F.col("returned"),
        "reserves_added": F.expr("revenue - opex * 1000"), "reserves_mined": F.col("revenue"),
    }
    m = S.measures(_sector_rows(spark, d, inputs), "mining").where(F.col("concept").isin("reserves_to_production_ratio", "production_cost_ratio", "reserve_replacement_pct"))
    return m.select("id", "concept", r6("value").alias("value"), "reason")


_PEERS = f"""{SECTORS}, m AS (SELECT issuer AS member, DATE '2000-12-31' - CAST(issuer % 3 AS INTEGER) AS as_of, 1 AS version, c AS concept, CASE WHEN issuer % 6 <> 5 THEN CASE c WHEN 'revenue' THEN balance ELSE balance / 10000 END END AS value,
CASE WHEN c = 'revenue' THEN CASE WHEN issuer % 12 = 1 THEN 'USD' ELSE currency END END AS currency, DATE '2000-09-30' - CAST(CASE WHEN issuer % 10 = 0 THEN 900 ELSE issuer % 90 END AS INTEGER) AS period_end
FROM sectors, (VALUES ('revenue'), ('net_margin')) t(c) WHERE issuer % 14 <> 13)"""


def _peer_rows(spark, d):
    s, day = sectors(spark, d), lambda c: F.lit(c).cast("date")
    c = s.where("issuer % 14 <> 13").withColumn("concept", F.explode(F.array(F.lit("revenue"), F.lit("net_margin"))))
    value = F.when(F.col("issuer") % 6 != 5, F.when(F.col("concept") == "revenue", F.col("balance")).otherwise(F.col("balance") / 10000))
    money = F.when(F.col("concept") == "revenue", F.when(F.col("issuer") % 12 == 1, "USD").otherwise(F.col("currency")))
    end = F.date_sub(day("2000-09-30"), F.when(F.col("issuer") % 10 == 0, 900).otherwise(F.col("issuer") % 90).cast("int"))
    now = c.select(F.col("issuer").alias("member"), F.date_sub(day("2000-12-31"), (F.col("issuer") % 3).cast("int")).alias("as_of"), F.lit(1).alias("version"), "concept", value.alias("value"), money.alias("currency"), end.alias("period_end"))
    later = now.withColumn("as_of", day("2001-06-30")).withColumn("value", F.lit(-1.0))
    members = s.select(F.col("sector").alias("set_id"), F.col("issuer").alias("member"), (F.col("sector") != "AFRICA").alias("verified"))
    return members, now.union(later)


@query(f"""WITH {_PEERS}, r AS (SELECT sector AS set_id, sectors.issuer, t.c AS concept, value, m.currency, period_end, max(period_end) OVER (PARTITION BY sector, t.c) AS top, m.member IS NULL AS no_snapshot
FROM sectors CROSS JOIN (VALUES ('revenue'), ('net_margin')) t(c) LEFT JOIN m ON m.member = issuer AND m.concept = t.c),
i AS (SELECT *, coalesce(top - period_end > 730, false) AS excluded FROM r),
g AS (SELECT set_id, concept, quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (NOT excluded) AS q, count(value) FILTER (NOT excluded) AS c, count(*) FILTER (NOT excluded AND value IS NULL) AS no_value, count(*) FILTER (no_snapshot) AS no_snapshot,
  count(*) FILTER (excluded) AS excluded, list_sort(list(DISTINCT currency) FILTER (NOT excluded AND value IS NOT NULL AND concept = 'revenue')) AS money FROM i GROUP BY ALL),
w AS (SELECT *, CASE WHEN len(money) > 1 THEN 'currency_mismatch: ' || array_to_string(money, ', ') WHEN set_id = 'AFRICA' THEN 'peer_set_not_confirmed' WHEN c < 8 THEN 'peer_set_too_small' END AS reason FROM g)
SELECT set_id, concept, CASE WHEN reason IS NULL THEN round(q[1], 6) END AS p25, CASE WHEN reason IS NULL THEN round(q[2], 6) END AS median, CASE WHEN reason IS NULL THEN round(q[3], 6) END AS p75,
CASE WHEN reason IS NULL OR reason LIKE 'currency%' THEN c ELSE 0 END AS n, CASE WHEN len(money) = 1 THEN money[1] END AS currency, no_value, no_snapshot, excluded, reason FROM w""")
def sector_build(spark, d):
    """Quartiles of peer sets at a date: old periods out, mixed currencies, an unconfirmed set, members without a snapshot."""
    a = S.aggregates(*_peer_rows(spark, d), ("revenue",), "2000-12-31")
    return a.select("set_id", "concept", *[r6(c).alias(c) for c in ("p25", "median", "p75")], F.col("n").cast("long").alias("n"), "currency", "no_value", "no_snapshot", "excluded", "reason")


@query(f"""WITH {SECTORS}, v AS (SELECT nation AS set_id, CASE WHEN nation NOT LIKE 'A%' AND balance > 0 THEN balance END AS value, CASE WHEN issuer % 9 = 0 THEN 'CHF' ELSE currency END AS currency FROM sectors),
g AS (SELECT set_id, count(value) AS n, sum(value) AS s, sum(value * value) AS s2, list_sort(list(DISTINCT currency) FILTER (value IS NOT NULL)) AS c FROM v GROUP BY set_id)
SELECT set_id, CASE WHEN n > 0 AND len(c) = 1 THEN round(s2 / (s * s), 6) END AS hhi, n, CASE WHEN n > 0 AND len(c) = 1 THEN c[1] END AS currency, CASE WHEN n = 0 THEN 'no_contributors' WHEN len(c) > 1 THEN 'currency_mismatch: ' || array_to_string(c, ', ') END AS reason FROM g""")
def sector_hhi(spark, d):
    s = sectors(spark, d)
    value = F.when(~F.col("nation").startswith("A") & (F.col("balance") > 0), F.col("balance"))
    m = s.select(F.col("nation").alias("set_id"), value.alias("value"), F.when(F.col("issuer") % 9 == 0, "CHF").otherwise(F.col("currency")).alias("currency"))
    return S.concentration(m).select("set_id", r6("hhi").alias("hhi"), "n", "currency", "reason")


@query(f"""WITH {SECTORS} SELECT issuer, c AS concept, CASE WHEN sector = 'ASIA' AND balance <= 4000 AND c IN ('ebitda', 'roic') THEN 'not_applicable: banks' WHEN balance <= 4000 THEN 'missing_data: x' END AS reason FROM sectors, (VALUES ('ebitda'), ('roic'), ('roe')) t(c)""")
def not_applicable_override(spark, d):
    s = sectors(spark, d).withColumn("concept", F.explode(F.array(F.lit("ebitda"), F.lit("roic"), F.lit("roe"))))
    value = F.when(F.col("balance") > 4000, F.col("balance"))
    return s.select("issuer", "concept", V.not_applicable(F.col("sector") == "ASIA", F.col("concept"), value, F.when(value.isNull(), "missing_data: x")).alias("reason"))


@query(f"""WITH {SECTORS}, v AS (SELECT issuer, c AS concept, CASE c WHEN 'pe' THEN balance / 10 WHEN 'net_margin' THEN balance / 5000 WHEN 'roe' THEN balance / 1000 ELSE balance / 10 END AS value, balance - 3000 AS equity FROM sectors, (VALUES ('pe'), ('net_margin'), ('roe'), ('ev_ebitda'), ('pb')) t(c))
SELECT issuer, concept, CASE concept WHEN 'pe' THEN CASE WHEN value <= 0 THEN 'loss' WHEN value > 500 THEN 'denominator_near_zero' END WHEN 'net_margin' THEN CASE WHEN abs(value) > 1 THEN 'over_revenue' END
WHEN 'roe' THEN CASE WHEN equity <= 0 THEN 'negative_equity' WHEN abs(value) > 5 THEN 'equity_near_zero' END WHEN 'ev_ebitda' THEN CASE WHEN value > 500 THEN 'denominator_near_zero' WHEN value <= 0 THEN 'negative_ebitda' END
ELSE CASE WHEN equity <= 0 OR value <= 0 THEN 'negative_equity' END END AS flag FROM v""")
def implausible_flags(spark, d):
    names = ("pe", "net_margin", "roe", "ev_ebitda", "pb")
    s = sectors(spark, d).withColumn("concept", F.explode(F.array(*map(F.lit, names))))
    c, b = F.col("concept"), F.col("balance")
    value = F.when(c == "net_margin", b / 5000).when(c == "roe", b / 1000).otherwise(b / 10)
    return s.select("issuer", "concept", V.implausible(c, value, b - 3000, b).alias("flag"))
