"""Trailing windows and ratios of issuers, with reasons for what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import reasons as R
from ledgerlight.operators import groups, periods, picks

from .model import AS_OF, SECTORS, long, long_sql, periods_sql, query, r6, sectors
from .model import periods as period_rows

_TTM = f"""p AS (SELECT issuer, concept, start, "end", min(value) AS value, "end" - start + 1 AS days FROM f WHERE "end" <= DATE '{AS_OF}' AND "end" > start AND value IS NOT NULL GROUP BY ALL),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY issuer, concept ORDER BY "end" DESC, start DESC) = 1),
qt AS (SELECT * FROM p WHERE days BETWEEN 80 AND 100),
chain AS (SELECT a.issuer, a.concept, a.value + b.value + c.value + d.value AS v, d.start AS s FROM a JOIN qt b ON b.issuer = a.issuer AND b.concept = a.concept AND a.start - b."end" BETWEEN 1 AND 5
  JOIN qt c ON c.issuer = a.issuer AND c.concept = a.concept AND b.start - c."end" BETWEEN 1 AND 5 JOIN qt d ON d.issuer = a.issuer AND d.concept = a.concept AND c.start - d."end" BETWEEN 1 AND 5
  WHERE a.days BETWEEN 80 AND 100 AND a."end" - d.start + 1 BETWEEN 350 AND 380),
alg AS (SELECT a.issuer, a.concept, y.value + a.value - z.value AS v, z."end" + 1 AS s FROM a JOIN p y ON y.issuer = a.issuer AND y.concept = a.concept AND y.days BETWEEN 350 AND 380 AND a.start - y."end" BETWEEN 1 AND 5
  JOIN p z ON z.issuer = a.issuer AND z.concept = a.concept AND a.start - z.start BETWEEN 358 AND 372 AND a."end" - z."end" BETWEEN 358 AND 372
  QUALIFY row_number() OVER (PARTITION BY a.issuer, a.concept ORDER BY y."end" DESC, z."end" DESC) = 1),
back AS (SELECT * FROM p WHERE days BETWEEN 350 AND 380 QUALIFY row_number() OVER (PARTITION BY issuer, concept ORDER BY "end" DESC, start DESC) = 1),
ttm AS (SELECT * FROM (SELECT a.issuer, a.concept, CASE WHEN a.days BETWEEN 350 AND 380 THEN a.value ELSE coalesce(chain.v, alg.v, back.value) END AS value,
  CASE WHEN a.days BETWEEN 350 AND 380 THEN a.start ELSE coalesce(chain.s, alg.s, back.start) END AS start,
  CASE WHEN a.days BETWEEN 350 AND 380 OR chain.v IS NOT NULL OR alg.v IS NOT NULL THEN a."end" ELSE back."end" END AS "end",
  CASE WHEN a.days BETWEEN 350 AND 380 OR chain.v IS NOT NULL OR alg.v IS NOT NULL THEN 'ttm' ELSE 'annual_fallback' END AS basis
  FROM a LEFT JOIN chain USING (issuer, concept) LEFT JOIN alg USING (issuer, concept) LEFT JOIN back USING (issuer, concept)) WHERE value IS NOT NULL)"""
_OUT = 'SELECT issuer, concept, round(value, 4) AS value, start, "end", basis FROM ttm'
_Q = periods_sql("q")


def _rounded(t: DataFrame) -> DataFrame:
    return t.withColumn("value", F.round("value", 4))


@query(f"WITH {_Q}, {long_sql('f', 'q', 'revenue', 'cogs')}, {_TTM} {_OUT}")
def ttm_quarter_chain(spark, d):
    return _rounded(periods.trailing_year(long(period_rows(spark, d), "revenue", "cogs"), AS_OF))


_YTD = """ytd AS (SELECT issuer, CAST(date_trunc('year', start) AS DATE) AS start, "end", sum(revenue) OVER (PARTITION BY issuer, date_trunc('year', start) ORDER BY "end") AS revenue FROM q)"""


def _ytd(spark, d) -> DataFrame:
    year = F.trunc("start", "year")
    w = Window.partitionBy("issuer", year).orderBy("end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return period_rows(spark, d).select("issuer", year.alias("start"), "end", F.sum("revenue").over(w).alias("revenue"))


@query(f"WITH {_Q}, {_YTD}, {long_sql('f', 'ytd', 'revenue')}, {_TTM} {_OUT}")
def ttm_fy_ytd_algebra(spark, d):
    return _rounded(periods.trailing_year(long(_ytd(spark, d), "revenue"), AS_OF))


@query(f"""WITH {periods_sql('y', 'year')}, {_Q}, u AS (SELECT issuer, start, "end", revenue FROM y UNION ALL SELECT issuer, start, "end", revenue FROM q WHERE start = DATE '2001-04-01'), {long_sql('f', 'u', 'revenue')}, {_TTM} {_OUT}""")
def ttm_annual_fallback(spark, d):
    both = period_rows(spark, d, "year").union(period_rows(spark, d).where("start = date'2001-04-01'"))
    return _rounded(periods.trailing_year(long(both, "revenue"), AS_OF))


_Y = periods_sql("y", "year")
#: One row for each issuer and year; some inputs are missing so that reasons show.
_BASE = f"""{_Y}, {SECTORS}, b AS (SELECT *, lag(assets) OVER (PARTITION BY issuer ORDER BY start) AS assets_0 FROM (SELECT y.*, year(y.start) AS yr, nullif(returned, 0) AS interest, CASE WHEN balance > 0 THEN balance * 100 END AS cash, balance AS equity, sector, currency,
sum(revenue - cogs) OVER (PARTITION BY issuer ORDER BY start) AS assets, lag(balance + (year(y.start) - 1995) * 1000) OVER (PARTITION BY issuer ORDER BY start) AS equity_0, balance + (year(y.start) - 1995) * 1000 AS equity_1 FROM y JOIN sectors USING (issuer)))"""


def base(spark, d) -> DataFrame:
    w = Window.partitionBy("issuer").orderBy("start")
    y = period_rows(spark, d, "year").join(sectors(spark, d).select("issuer", "sector", "currency", "balance"), "issuer")
    y = y.withColumn("yr", F.year("start")).withColumn("interest", F.nullif("returned", F.lit(0.0))).withColumn("cash", F.when(F.col("balance") > 0, F.col("balance") * 100)).withColumn("equity", F.col("balance"))
    y = y.withColumn("assets", F.sum(F.col("revenue") - F.col("cogs")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    y = y.withColumn("assets_0", F.lag("assets").over(w))
    return y.withColumn("equity_1", F.col("balance") + (F.col("yr") - 1995) * 1000).withColumn("equity_0", F.lag(F.col("balance") + (F.col("yr") - 1995) * 1000).over(w))


def _measure(name: str, build, value: str, reason: str) -> None:
    """A query (issuer, yr, value, reason) of the yearly rows. value and reason: SQL; the reason wins."""

    def run(spark, d):
        return base(spark, d).select("issuer", "yr", build().alias("m")).select("issuer", "yr", r6("m.value").alias("value"), F.col("m.reason").alias("reason"))

    sql = f"WITH {_BASE} SELECT issuer, yr, CASE WHEN reason IS NULL THEN round(value, 6) END AS value, reason FROM (SELECT issuer, yr, {value} AS value, {reason} AS reason FROM b)"
    query(sql, name)(run)


def _c(x: str) -> Column:
    return F.col(x)


def _gross() -> Column:
    return _c("revenue") - _c("cogs")


def _missing(*names: str) -> str:
    cases = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in sorted(names))
    return f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in names)} THEN 'missing_data: ' || concat_ws(', ', {cases}) END"


def _over(den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 'denominator_zero' WHEN {den} < 0 THEN 'negative_denominator' END"


_measure("gross_margin", lambda: R.ratio(gross_profit=_gross(), revenue=_c("revenue")), "(revenue - cogs) / revenue", _over("revenue"))
_measure("operating_margin", lambda: R.ratio(operating_income=_gross() - _c("opex"), revenue=_c("revenue")), "(revenue - cogs - opex) / revenue", _over("revenue"))
_measure("net_margin", lambda: R.ratio(net_income=_gross() - _c("opex") - _c("tax"), revenue=_c("revenue")), "(revenue - cogs - opex - tax) / revenue", _over("revenue"))
_RATE = "tax / nullif(revenue - cogs, 0)"
_BAND = f"coalesce({_over('(revenue - cogs)')}, CASE WHEN {_RATE} < 0 OR {_RATE} > 0.5 THEN 'jurisdiction_rate: rate=' || printf('%.4f', {_RATE}) END)"
_measure("effective_tax_band", lambda: R.effective_tax(_c("tax"), _gross()), _RATE, _BAND)


def _nopat() -> Column:
    rate = R.effective_tax(_c("tax"), _gross())
    return R.result((_gross() - _c("opex")) * (1 - rate["value"]), F.when(rate["reason"].isNotNull(), "missing_data: effective_tax"))


_measure("nopat_chain", _nopat, f"(revenue - cogs - opex) * (1 - {_RATE})", f"CASE WHEN {_BAND} IS NOT NULL THEN 'missing_data: effective_tax' END")
_measure("interest_coverage", lambda: R.ratio(operating_income=_gross() - _c("opex"), interest_expense=_c("interest")), "(revenue - cogs - opex) / interest", f"coalesce(CASE WHEN interest IS NULL THEN 'missing_data: interest_expense' END, {_over('interest')})")
_measure("fcf", lambda: R.total({"capex": -1}, capex=_c("opex"), ocf=_gross()), "revenue - cogs - opex", "CAST(NULL AS VARCHAR)")
_measure("net_debt", lambda: R.total({"cash": -1}, cash=_c("cash"), total_debt=_c("interest")), "interest - cash", _missing("cash", "interest").replace("'interest'", "'total_debt'"))
_measure("invested_capital", lambda: R.total({"cash": -1}, cash=_c("cash"), equity=_c("equity"), interest=_c("interest")), "equity + interest - cash", _missing("cash", "equity", "interest"))


def _mean_ratio(flow: Column, before: str, after: str) -> Column:
    return R.ratio(flow=flow, mean_stock=(_c(before) + _c(after)) / 2)


_measure("roe_two_period", lambda: _mean_ratio(_gross() - _c("tax"), "equity_0", "equity_1"), "(revenue - cogs - tax) / nullif((equity_0 + equity_1) / 2, 0)", f"coalesce(CASE WHEN equity_0 IS NULL THEN 'missing_data: mean_stock' END, {_over('((equity_0 + equity_1) / 2)')})")
_measure("asset_turnover", lambda: _mean_ratio(_c("revenue"), "assets_0", "assets"), "revenue / nullif((assets_0 + assets) / 2, 0)", f"coalesce(CASE WHEN assets_0 IS NULL THEN 'missing_data: mean_stock' END, {_over('((assets_0 + assets) / 2)')})")
_measure("ebitda_fallback", lambda: R.result(F.coalesce(_c("interest") + _c("opex"), _gross() + _c("opex")), F.lit(None).cast("string")), "coalesce(interest + opex, revenue - cogs + opex)", "CAST(NULL AS VARCHAR)")
_measure("derived_operating_income", lambda: R.total({"income": -1}, expense=_c("interest"), income=F.coalesce(_c("cash"), F.lit(0.0)), pretax=_gross()), "revenue - cogs + interest - coalesce(cash, 0)", "CASE WHEN interest IS NULL THEN 'missing_data: expense' END")
_measure("ev_bridge", lambda: R.total({"cash": -1}, cash=_c("cash"), debt=F.coalesce(_c("interest"), F.lit(0.0)), market_cap=_c("revenue") * 3), "revenue * 3 + coalesce(interest, 0) - cash", _missing("cash"))
_measure("price_to_book", lambda: R.ratio(market_cap=_c("revenue") * 3, equity=_c("equity")), "revenue * 3 / nullif(equity, 0)", _over("equity"))


@query(f"""WITH {_BASE}, e AS (SELECT issuer, min(yr) AS y0, max(yr) AS y1, arg_min(revenue, yr) AS r0, arg_max(revenue, yr) AS r1 FROM b GROUP BY issuer)
SELECT issuer, CASE WHEN y1 > y0 THEN round(pow(r1 / r0, 1.0 / (y1 - y0)) - 1, 6) END AS value, CASE WHEN y1 <= y0 THEN 'missing_data: years' END AS reason FROM e""")
def cagr_n(spark, d):
    e = base(spark, d).groupBy("issuer").agg(F.min("yr").alias("y0"), F.max("yr").alias("y1"), F.min_by("revenue", "yr").alias("r0"), F.max_by("revenue", "yr").alias("r1"))
    m = R.cagr(F.col("r0"), F.col("r1"), F.col("y1") - F.col("y0"))
    return e.select("issuer", m.alias("m")).select("issuer", r6("m.value").alias("value"), "m.reason")


def _margins(spark, d) -> DataFrame:
    t = periods.trailing_year(long(period_rows(spark, d), "revenue", "cogs"), AS_OF)
    wide = t.groupBy("issuer").agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in ("revenue", "cogs")], F.max("end").alias("end"))
    m = wide.select("issuer", "end", R.ratio(gross_profit=_gross(), revenue=_c("revenue")).alias("m"))
    return m.select("issuer", "end", F.col("m.value").alias("value")).join(sectors(spark, d), "issuer")


_MARGINS = f"""{_Q}, {SECTORS}, {long_sql('f', 'q', 'revenue', 'cogs')}, {_TTM}, w AS (SELECT issuer, max("end") AS "end", max(CASE concept WHEN 'revenue' THEN value END) AS r, max(CASE concept WHEN 'cogs' THEN value END) AS c FROM ttm GROUP BY issuer),
m AS (SELECT issuer, "end", CASE WHEN r > 0 THEN (r - c) / r END AS value, sectors.* EXCLUDE (issuer) FROM w JOIN sectors USING (issuer))"""


def _quartile_sql(group: str) -> str:
    q = ", ".join(f"CASE WHEN count(value) >= 8 THEN round(quantile_cont(value, {x}), 6) END AS {n}" for x, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))
    return f"WITH {_MARGINS} SELECT {group}, {q}, CASE WHEN count(value) >= 8 THEN count(value) ELSE 0 END AS n, count(*) - count(value) AS no_value, CASE WHEN count(value) < 8 THEN 'peer_set_too_small' END AS reason FROM m GROUP BY {group}"


def _quartiles(spark, d, group: str) -> DataFrame:
    q = groups.quartiles(_margins(spark, d), group)
    return q.select(group, *[r6(c).alias(c) for c in ("p25", "median", "p75")], F.col("n").cast("long").alias("n"), "no_value", "reason")


query(_quartile_sql("sector"), "sector_quartiles")(lambda s, d: _quartiles(s, d, "sector"))
query(_quartile_sql("nation"), "sector_quartiles_small_n")(lambda s, d: _quartiles(s, d, "nation"))


@query(f"""WITH {_MARGINS}, v AS (SELECT sector, issuer, value FROM m WHERE value IS NOT NULL)
SELECT sector, issuer, n, round(below / n, 6) AS percentile FROM (SELECT a.sector, a.issuer, (SELECT count(*) FROM v b WHERE b.sector = a.sector AND b.issuer <> a.issuer) AS n, (SELECT count(*) FROM v b WHERE b.sector = a.sector AND b.value < a.value) AS below FROM v a) WHERE n >= 5""")
def percentile_rank_strict(spark, d):
    return groups.percentile_below(_margins(spark, d), "sector", "issuer").select("sector", "issuer", "n", r6("percentile").alias("percentile"))


@query(f"WITH {_BASE}, t AS (SELECT sector, issuer, sum(revenue) AS v FROM b GROUP BY ALL), s AS (SELECT sector, v / sum(v) OVER (PARTITION BY sector) AS share FROM t) SELECT sector, count(*) AS n, round(sum(share * share), 6) AS hhi FROM s GROUP BY sector")
def hhi_concentration(spark, d):
    t = base(spark, d).groupBy("sector", "issuer").agg(F.sum("revenue").alias("value"))
    return groups.concentration(t, "sector").select("sector", "n", r6("hhi").alias("hhi"))


@query(f"WITH {SECTORS} SELECT nation, count(DISTINCT c) AS n_currencies, CASE WHEN count(DISTINCT c) > 1 THEN 'currency_mismatch: ' || string_agg(DISTINCT c, ', ' ORDER BY c) END AS reason FROM (SELECT nation, CASE WHEN issuer % 7 = 0 THEN '(blank)' ELSE currency END AS c FROM sectors) GROUP BY nation")
def currency_guard(spark, d):
    s = sectors(spark, d).withColumn("c", F.when(F.col("issuer") % 7 != 0, F.col("currency")))
    return groups.currency_guard(s, "nation", "c").withColumn("n_currencies", F.col("n_currencies").cast("long"))


@query(f"WITH {SECTORS}, c AS (SELECT sector, CASE WHEN issuer % 3 = 0 THEN 'USD' ELSE currency END AS currency FROM sectors) SELECT sector, currency, count(*) AS n FROM c GROUP BY sector, currency QUALIFY row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, currency) = 1")
def dominant_currency(spark, d):
    s = sectors(spark, d).withColumn("currency", F.when(F.col("issuer") % 3 == 0, "USD").otherwise(F.col("currency")))
    return groups.dominant(s, "sector", "currency").select("sector", "currency", "n")


_LAST = 'l AS (SELECT issuer, max("end") AS "end" FROM q GROUP BY issuer)'


@query(f"""WITH {_Q}, {SECTORS}, {_LAST}, w AS (SELECT sector, "end", max("end") OVER (PARTITION BY sector) AS top FROM l JOIN sectors USING (issuer))
SELECT sector, min("end") FILTER (top - "end" <= 730) AS period_from, max(top) AS period_to, count(*) FILTER (top - "end" <= 730) AS included, count(*) FILTER (top - "end" > 730) AS excluded FROM w GROUP BY sector""")
def period_window_730(spark, d):
    last = period_rows(spark, d).groupBy("issuer").agg(F.max("end").alias("end"))
    return groups.period_window(last.join(sectors(spark, d), "issuer"), "sector")


@query(f"""WITH {_Q} SELECT issuer, count(*) AS n FROM (SELECT issuer, "end", max("end") OVER (PARTITION BY issuer) AS top FROM q) WHERE top - "end" <= 1100 GROUP BY issuer""")
def staleness_door(spark, d):
    return periods.staleness_door(period_rows(spark, d)).groupBy("issuer").agg(F.count("*").alias("n"))


@query(f"""WITH {_BASE} SELECT issuer, yr, concept, token, n FROM (SELECT issuer, max(yr) AS yr, 'net_debt' AS concept, CASE WHEN cash IS NULL OR interest IS NULL THEN 'missing_data' ELSE 'ok' END AS token, count(*) AS n FROM b GROUP BY 1, 4) QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY n DESC, token) = 1""")
def reason_counts_dominant(spark, d):
    m = R.total({}, cash=_c("cash"), interest=_c("interest"))
    t = base(spark, d).select("issuer", "yr", F.coalesce(F.split(m["reason"], ":")[0], F.lit("ok")).alias("token"))
    g = t.groupBy("issuer", "token").agg(F.max("yr").alias("yr"), F.count("*").alias("n"))
    return picks.first_by(g, ["issuer"], F.desc("n"), "token").select("issuer", "yr", F.lit("net_debt").alias("concept"), "token", "n")


@query(f"WITH {_BASE} SELECT sector, count(*) AS cells, count(cash) + count(interest) AS filled, round((count(cash) + count(interest)) / (2.0 * count(*)), 6) AS rate FROM b GROUP BY sector")
def fill_rate(spark, d):
    g = base(spark, d).groupBy("sector").agg(F.count("*").alias("cells"), (F.count("cash") + F.count("interest")).alias("filled"))
    return g.withColumn("rate", r6(F.col("filled") / (2.0 * F.col("cells"))))


@query(f"WITH {_BASE} SELECT issuer, yr, round(revenue, 2) AS revenue, round(revenue - lag(revenue) OVER (PARTITION BY issuer ORDER BY yr), 2) AS change FROM b QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY yr DESC) <= 3")
def statement_series(spark, d):
    w = Window.partitionBy("issuer").orderBy("yr")
    t = base(spark, d).withColumn("change", F.round(F.col("revenue") - F.lag("revenue").over(w), 2)).withColumn("_n", F.row_number().over(Window.partitionBy("issuer").orderBy(F.desc("yr"))))
    return t.where("_n <= 3").select("issuer", "yr", F.round("revenue", 2).alias("revenue"), "change")


@query(f"""WITH {_BASE} SELECT issuer, a.yr AS yr, round(a.revenue, 2) AS now, round(b2.revenue, 2) AS before FROM b a JOIN b b2 USING (issuer) WHERE a.yr = 2000 AND b2.yr = 1999 AND abs(a.revenue - b2.revenue) > 0.1 * b2.revenue""")
def snapshot_diff(spark, d):
    b = base(spark, d).select("issuer", "yr", "revenue")
    old = b.where("yr = 1999").select("issuer", F.col("revenue").alias("old"))
    t = b.where("yr = 2000").join(old, "issuer").where("abs(revenue - old) > 0.1 * old")
    return t.select("issuer", "yr", F.round("revenue", 2).alias("now"), F.round("old", 2).alias("before"))


@query(f"WITH {_BASE} SELECT issuer, max(yr) AS yr FROM b WHERE interest IS NOT NULL AND cash IS NOT NULL GROUP BY issuer")
def common_annual_period(spark, d):
    rows = long(base(spark, d), "interest", "cash").where("value is not null and datediff(end, start) + 1 between 350 and 380")
    g = rows.groupBy("issuer", "start").agg(F.count_distinct("concept").alias("n")).where("n = 2")
    return g.groupBy("issuer").agg(F.max(F.year("start")).alias("yr"))


@query(f"WITH {_Q} SELECT issuer, list_filter(generate_series(min(year(start)), max(year(start))), lambda y: NOT list_contains(list(year(start)), y))::VARCHAR AS missing FROM q WHERE returned > 30000 GROUP BY issuer")
def year_gap_sequence(spark, d):
    rows = period_rows(spark, d).where("returned > 30000").withColumn("y", F.year("start"))
    g = periods.year_gaps(rows, "issuer", "y")
    return g.select("issuer", F.concat(F.lit("["), F.array_join("missing", ", "), F.lit("]")).alias("missing"))
