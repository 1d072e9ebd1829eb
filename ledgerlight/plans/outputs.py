"""Ownership forms, versions of peer sets, exports and checks of measures over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import borders, doctor, governance, reports
from ledgerlight.operators import sectors as sector_rules
from ledgerlight.operators import versions, views
from ledgerlight.sinks import exports, tables
from ledgerlight.sources import statements

from . import snapshots
from .measures import _BASE, _TTM, base
from .model import AS_OF, PRICES, SECTORS, dec, long, long_sql, periods, periods_sql, prices, query, r6, read, sectors

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""SELECT o_orderkey, CASE WHEN ok THEN 'C' || o_custkey END AS insider, CASE WHEN ok THEN ['director', 'officer', 'ten_percent_owner'][o_orderkey % 3 + 1] END AS role, CASE WHEN ok THEN {_DAY} END AS date,
CASE WHEN ok THEN CASE o_orderstatus WHEN 'F' THEN 'disposed' WHEN 'O' THEN 'acquired' END END AS direction, CASE WHEN ok THEN CAST(o_totalprice AS DECIMAL(14,2))::DOUBLE END AS shares, ok AND o_orderpriority = '1-URGENT' AS planned,
CASE WHEN o_orderkey % 17 = 0 THEN 'dtd' WHEN o_orderkey % 19 = 0 THEN 'not_ownership' END AS problem FROM (SELECT *, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS ok FROM orders)""")
def source_ownership_deals(spark, d):
    """One form for each order: dealings of a customer, planned where a footnote says so; forms with a DTD or of another kind are refused."""
    k, urgent = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    value = lambda name, x: tag(name, tag("value", x))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    flag = F.when(k % 3 == 0, tag("isDirector", F.lit("1"))).when(k % 3 == 1, tag("isOfficer", F.lit("true"))).otherwise(tag("isTenPercentOwner", F.lit(" TRUE ")))
    owner = tag("reportingOwner", F.concat(tag("reportingOwnerId", tag("rptOwnerName", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))), tag("reportingOwnerRelationship", flag)))
    # shares with thousands parted, as forms have them
    shares = F.format_number(dec("o_totalprice", "decimal(14,2)"), 2)
    code = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "A").otherwise("J")
    note = F.when(urgent, F.lit('<footnoteId id="F1"/>')).otherwise("")
    amounts = tag("transactionAmounts", F.concat(value("transactionShares", shares), note, value("transactionAcquiredDisposedCode", code)))
    deal = tag("nonDerivativeTable", tag("nonDerivativeTransaction", F.concat(F.when(k % 2 == 0, value("transactionDate", day)).otherwise(""), amounts)))
    form = tag("ownershipDocument", F.concat(tag("periodOfReport", day), owner, deal, F.lit('<footnotes><footnote id="F1">Under a Rule 10b5-1 plan.</footnote></footnotes>')))
    payload = F.when(k % 17 == 0, F.concat(F.lit("<!DOCTYPE x>"), form)).when(k % 19 == 0, F.lit("<other/>")).otherwise(form)
    rows = statements.deals(read(spark, d, "orders").select(k.alias("source_ref"), payload.alias("payload")))
    return rows.select(F.col("source_ref").alias("o_orderkey"), "insider", "role", "date", "direction", "shares", "planned", "problem")


@query("""WITH o AS (SELECT o_custkey AS set_id, list_sort(list(DISTINCT o_orderpriority)) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT o_custkey AS set_id, list_sort(list(DISTINCT o_orderpriority)) AS m FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 3 = 0 GROUP BY 1)
SELECT o.set_id, 1 AS version, DATE '1995-01-01' AS valid_from, CASE WHEN n.m <> o.m THEN DATE '2001-09-30' END AS valid_to, array_to_string(o.m, ',') AS members FROM o LEFT JOIN n USING (set_id)
UNION ALL SELECT n.set_id, CASE WHEN o.m IS NULL THEN 1 ELSE 2 END, DATE '2001-09-30', NULL, array_to_string(n.m, ',') FROM n LEFT JOIN o USING (set_id) WHERE o.m IS NULL OR n.m <> o.m""")
def peer_set_versions(spark, d):
    """Sets of priorities set anew: equal ones stay as they are, others end and begin a new version."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("m"), "o_orderstatus")
    set_of = lambda rows: rows.groupBy("set_id").agg(F.array_sort(F.collect_set("m")).alias("members"))
    now = set_of(o.where("o_orderstatus = 'F'")).select("set_id", F.lit(1).alias("version"), F.lit("1995-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), "members")
    out = versions.set_members(now, set_of(o.where("o_orderstatus = 'F' or set_id % 3 = 0")), "2001-09-30")
    return out.withColumn("members", F.array_join("members", ","))


def _measures(spark, d):
    """Revenues of quarters as measures of the issuer's snapshot; small ones are refused."""
    q, big = periods(spark, d), F.col("revenue") > 100000
    key = F.concat_ws("/", F.col("issuer").cast("string"), F.col("end").cast("string"))
    return q.select(F.col("issuer").alias("snapshot_id"), key.alias("measure_id"), F.lit("issuer").alias("scope"), F.col("issuer").cast("string").alias("scope_ref"), F.lit("revenue").alias("concept"), F.when(big, F.col("revenue")).alias("value"),
                    F.lit("USD").alias("unit"), F.col("start").alias("period_start"), F.col("end").alias("period_end"), F.lit("1").alias("method_version"), F.when(~big, "missing_data: revenue").alias("null_reason"))


_MEASURES = f"""{periods_sql('q')}, m AS (SELECT issuer AS snapshot_id, issuer || '/' || "end" AS measure_id, start, "end", CASE WHEN revenue > 100000 THEN revenue END AS value, CASE WHEN revenue <= 100000 THEN 'missing_data: revenue' END AS reason FROM q)"""


@query(f"WITH {_MEASURES} SELECT snapshot_id, 'v1' AS version, measure_id, round(value, 6) AS value, CAST(start AS VARCHAR) AS period_start, reason AS null_reason FROM m")
def export_json(spark, d):
    """The exported documents read back: every measure of every snapshot with its value or its reason."""
    kind = "concept_map_version string, snapshot bigint, measures array<struct<measure_id:string,value:double,period_start:string,null_reason:string>>"
    doc = exports.to_json(_measures(spark, d), "v1").select("snapshot_id", F.from_json("text", kind).alias("d"))
    rows = doc.select("snapshot_id", F.col("d.concept_map_version").alias("version"), F.explode("d.measures").alias("m"))
    return rows.select("snapshot_id", "version", "m.measure_id", r6("m.value").alias("value"), "m.period_start", "m.null_reason")


@query(f"""WITH {_MEASURES}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY measure_id) AS i, count(*) FILTER (value IS NULL) OVER (PARTITION BY snapshot_id ORDER BY measure_id) AS k FROM m)
SELECT snapshot_id, i, CASE WHEN value IS NULL THEN '| revenue | — [' || k || '] |  |  |  |' ELSE '| revenue | ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' | USD | ' || start || ' | ' || "end" || ' |' END AS line FROM r""")
def export_markdown(spark, d):
    """The lines of the exported tables, with numbered notes for missing values."""
    m = _measures(spark, d).withColumn("value", F.col("value").cast("decimal(18,2)"))
    text = exports.to_markdown(m, "v1").select("snapshot_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return text.where("i >= 4 and line like '| revenue%'").select("snapshot_id", (F.col("i") - 3).cast("bigint").alias("i"), "line")


@query("""SELECT l_orderkey AS measure_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'manual' ELSE 'provider' END AS source_kind, count(*) AS facts, CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS pages,
string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN 'manual' ELSE 'provider' END || ':s' || l_suppkey || '@' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR), '; ' ORDER BY CASE WHEN l_returnflag = 'R' THEN 'manual' ELSE 'provider' END || ':s' || l_suppkey || '@' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS source
FROM lineitem GROUP BY l_orderkey""")
def measure_provenance(spark, d):
    """Where an order's number comes from: its facts, the pages of those put in by hand, and the cell that tells the sources."""
    manual = F.col("l_returnflag") == "R"
    lines = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("measure_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("fact_id"), F.lit("revenue").alias("concept"),
        F.lit("ok").alias("status"), F.when(manual, "manual").alias("source_kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_ref"), F.concat(F.lit("d#page="), F.col("l_linenumber").cast("string")).alias("locator"),
        F.to_date("l_shipdate").alias("period_end"),
    )
    p = exports.provenance(lines).select("measure_id", "provenance.source_kind", F.size("provenance.facts").cast("bigint").alias("facts"), F.aggregate("provenance.facts", F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f["page"], F.lit(0))).alias("pages"))
    return p.join(exports.source_cells(lines), "measure_id").select("measure_id", "source_kind", "facts", "pages", "source")


@query("""SELECT o_orderkey AS measure_id, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 = 0 THEN 'no_lineage' WHEN o_orderstatus <> 'P' AND o_orderkey % 7 = 0 THEN 'value_and_reason'
WHEN o_orderstatus = 'P' AND o_orderkey % 7 NOT IN (0, 1) THEN 'no_reason' WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 1 THEN 'unknown_reason' END AS problem FROM orders""")
def measure_checks(spark, d):
    """What is wrong with a measure: no lineage, a value beside a reason, neither, or a reason that is none."""
    k, value = F.col("o_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    reason = F.when(k % 7 == 0, "missing_data: revenue").when((k % 7 == 1) & value.isNull(), "who knows")
    o = read(spark, d, "orders")
    m = o.select(k.alias("measure_id"), value.alias("value"), reason.alias("null_reason"))
    return tables.checked(m, o.where("o_orderkey % 4 <> 0").select(k.alias("measure_id"))).select("measure_id", "problem")


@query("""WITH n AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') / count(*) AS churn FROM orders GROUP BY 1)
SELECT o_custkey, n, CASE WHEN churn > 0.2 THEN 'suspect' WHEN n < 5 THEN 'too_small' WHEN n < 8 THEN 'percentile_only' ELSE 'ok' END AS status FROM n""")
def peer_set_status(spark, d):
    """What a peer set is good for, by its size and the share of members that changed."""
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n"), (F.count_if(F.col("o_orderstatus") == "P") / F.count("*")).alias("churn"))
    return n.select("o_custkey", "n", sector_rules.peer_status(F.col("n"), F.col("churn")).alias("status"))


_AT = "2024-01-30"


@query(f"""WITH {PRICES}, d AS (SELECT user_id AS id, CAST(ts AS DATE) AS date, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS sign, event_id % 5 = 0 AS planned FROM events WHERE event_type IN ('purchase', 'error')),
p AS (SELECT d.*, CASE WHEN d.id % 13 <> 0 OR x.date < DATE '2024-01-15' THEN x.close END AS close FROM d ASOF JOIN prices x ON d.id = x.id AND d.date >= x.date WHERE d.date <= DATE '{_AT}' AND d.date >= DATE '{_AT}' - 365),
g AS (SELECT id, count(*) AS n, sum(sign * close * 10) AS net, coalesce(sum(sign * close * 10) FILTER (planned), 0) AS plan, count(*) FILTER (close IS NULL) AS open FROM p GROUP BY id),
r AS (SELECT u.id, coalesce(n, 0) AS deals, net, plan, CASE WHEN n IS NULL THEN 'insider_deals_not_disclosed' WHEN u.id % 7 = 0 THEN 'ownership_without_market_cap' WHEN open > 0 THEN 'ownership_without_deal_price' WHEN u.id % 11 = 0 THEN 'insider_deal_currency_mismatch' END AS reason
FROM (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL) u LEFT JOIN g USING (id))
SELECT id AS issuer, deals, CASE WHEN reason IS NULL THEN round(net, 4) END AS net_value, CASE WHEN reason IS NULL THEN round(net / 1000000, 6) END AS net_ratio, CASE WHEN reason IS NULL THEN round(plan, 4) END AS planned_net, reason FROM r""")
def insider_net(spark, d):
    """Net deals of the year before over the market value, the planned ones apart; what can't be priced or compared is refused."""
    e = read(spark, d, "events").where("user_id is not null")
    at = F.lit(_AT).cast("date")
    deals = e.where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("issuer"), F.col("user_id").alias("id"), F.to_date("ts").alias("date"), F.when(F.col("event_type") == "purchase", "acquired").otherwise("disposed").alias("direction"), F.lit(10.0).alias("shares"), (F.col("event_id") % 5 == 0).alias("planned"))
    gone = (F.col("id") % 13 == 0) & (F.col("date") >= "2024-01-15")
    closes = prices(spark, d).select("id", "date", F.when(~gone, F.col("close")).alias("close"), F.lit("USD").alias("currency"))
    targets = e.select(F.col("user_id").alias("issuer")).distinct().withColumn("at", at)
    caps = targets.select("issuer", "at", F.when(F.col("issuer") % 7 != 0, 1000000.0).alias("value"), F.when(F.col("issuer") % 11 == 0, "EUR").otherwise("USD").alias("unit"))
    out = governance.insider_inputs(deals, closes, caps, targets)
    return out.select("issuer", "deals", F.round("net_value", 4).alias("net_value"), r6("net_ratio").alias("net_ratio"), F.round("planned_net", 4).alias("planned_net"), "reason")


_NOW = " UNION ALL ".join(f"""SELECT issuer, '{c}' AS concept, DATE '{e}' AS "end", CAST({v} AS DOUBLE) AS value FROM sectors WHERE {w}""" for c, e, v, w, _, b, _ in snapshots._STOCKS if b == "as_reported")


@query(f"""WITH {periods_sql("q")}, {SECTORS}, {long_sql("f", "q", "revenue", "cogs", "returned")}, {_TTM}, stock AS ({_NOW}), top AS (SELECT issuer, max("end") AS top FROM (SELECT issuer, "end" FROM f WHERE value IS NOT NULL AND "end" <= DATE '{AS_OF}' UNION ALL SELECT issuer, "end" FROM stock) GROUP BY issuer)
SELECT issuer, concept, round(value, 4) AS value, start, "end", 'ttm' AS kind FROM ttm WHERE basis = 'ttm'
UNION ALL SELECT issuer, concept, round(arg_max(value, "end"), 4), max("end"), max("end"), 'instant' FROM stock JOIN top USING (issuer) WHERE "end" <= DATE '{AS_OF}' AND "end" >= top - 1100 GROUP BY issuer, concept""")
def statement_now(spark, d):
    """The statement of each issuer at a date: trailing years of its flows and newest balances."""
    f = long(periods(spark, d), "revenue", "cogs", "returned").withColumn("unit", F.lit("USD"))
    s = snapshots.stocks(spark, d).where("basis = 'as_reported'")
    t = sectors(spark, d).select("issuer", F.lit(AS_OF).cast("date").alias("at"), F.lit("USD").alias("home"))
    t = t.join(borders.anchors(t, f.select("issuer", "end").union(s.select("issuer", "end"))), ["issuer", "at"])
    out = borders.statement_now(borders.trailing_years(f, t), borders.newest(t, s))
    return out.select("issuer", "concept", F.round("value", 4).alias("value"), "start", "end", "kind")


@query(f"""WITH s AS ({snapshots._snapshot_sql()}), t AS (SELECT issuer, CASE WHEN value IS NULL THEN split_part(null_reason, ':', 1) END AS token, count(*) AS n, count(value) AS valued FROM s GROUP BY ALL),
d AS (SELECT issuer, token, n FROM t WHERE token IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY n DESC, token) = 1)
SELECT g.issuer, g.valued, g.total, token AS dominant_reason, coalesce(d.n, 0) AS reason_count FROM (SELECT issuer, CAST(sum(valued) AS BIGINT) AS valued, CAST(sum(n) AS BIGINT) AS total FROM t GROUP BY issuer) g LEFT JOIN d USING (issuer) WHERE g.valued * 4 < g.total""")
def poor_sources(spark, d):
    """Issuers whose snapshot is mostly refusals, with the commonest of their reasons."""
    return reports.poor_sources(snapshots._all(spark, d), ["issuer"])


@query(f"""WITH {_BASE}, c AS (SELECT issuer, yr, u.* FROM b, LATERAL (VALUES ('cash', cash, false), ('equity', CASE WHEN equity > 0 THEN equity END, equity <= 0), ('interest', interest, false)) u(concept, value, odd))
SELECT issuer, count(value) FILTER (NOT odd) AS filled, count(*) FILTER (NOT odd) AS applicable, coalesce(string_agg(concept || ' ' || yr, ', ' ORDER BY concept, yr) FILTER (NOT odd AND value IS NULL), '') AS gaps FROM c GROUP BY issuer""")
def fill_gaps(spark, d):
    """Filled and applicable cells of each issuer's card, and the gaps by name; equity that is not positive makes no sense there."""
    b = base(spark, d)
    cell = lambda c, v, odd: F.struct(F.lit(c).alias("concept"), v.alias("value"), odd.alias("senseless"))
    equity, no = F.col("equity"), F.lit(False)
    cells = b.select("issuer", F.col("yr").alias("year"), F.explode(F.array(cell("cash", F.col("cash"), no), cell("equity", F.when(equity > 0, equity), equity <= 0), cell("interest", F.col("interest"), no))).alias("c")).select("issuer", "year", "c.*")
    out = reports.fill(cells, ["issuer"])
    return out.withColumn("gaps", F.array_join(F.transform("gaps", lambda g: F.concat_ws(" ", g["concept"], g["year"].cast("string"))), ", "))


@query("""WITH e AS (SELECT * FROM events), o AS (SELECT * FROM orders), m AS (SELECT DISTINCT o_custkey AS s, year(o_orderdate) AS v, o_orderpriority AS p FROM orders),
t AS (SELECT s FROM (SELECT s, max(v) AS v FROM m GROUP BY s) ORDER BY v DESC, s DESC LIMIT 1), k AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS r FROM (SELECT DISTINCT v FROM m JOIN t USING (s))),
x AS (SELECT p, max(CAST(r = 1 AS INTEGER)) AS a, max(CAST(r = 2 AS INTEGER)) AS z FROM m JOIN t USING (s) JOIN k USING (v) WHERE r <= 2 GROUP BY p)
SELECT metric, round(value, 6) AS value FROM (
SELECT 'provider_success_rate' AS metric, count(*) FILTER (event_type <> 'error') / count(*) AS value FROM e UNION ALL SELECT 'provider_rate_limited', count(*) FILTER (event_type = 'signup') FROM e
UNION ALL SELECT 'data_lag', epoch(TIMESTAMP '2030-01-01') - epoch(date_trunc('second', max(ts))) FROM e UNION ALL SELECT 'unparsed_share', count(*) FILTER (value <= 1) / count(*) FROM e
UNION ALL SELECT 'suspect_share', count(*) FILTER (o_orderstatus = 'P') / count(*) FROM o UNION ALL SELECT 'verification_queue', nullif(count(*) FILTER (o_orderstatus = 'O'), 0) FROM o
UNION ALL SELECT 'peer_set_coverage', (SELECT count(DISTINCT o_custkey) FROM o) / count(*) FROM customer UNION ALL SELECT 'peer_set_churn', CASE WHEN sum(z) > 0 THEN count(*) FILTER (a <> z) / greatest(sum(a), sum(z)) END FROM x
UNION ALL SELECT 'locator_resolve_failures', count(*) FILTER (o_orderkey % 11 = 0) / count(*) FROM o) WHERE value IS NOT NULL""")
def system_metrics_observed(spark, d):
    """The nine metrics of the system, over calls, raw objects, facts, verifications, peer sets and locators."""
    e, o, c = read(spark, d, "events"), read(spark, d, "orders"), read(spark, d, "customer")
    count = lambda cond: F.count_if(cond)
    kind, k = F.col("event_type"), F.col("o_orderkey")
    calls = e.groupBy("user_id").agg(count(kind != "error").alias("made"), count(kind == "error").alias("refused"), count(kind == "signup").alias("rate_limited"))
    raw = e.select(F.col("ts").cast("timestamp").alias("fetched_at"), (F.col("value") > 1).alias("parsed"))
    facts = o.select(F.when(F.col("o_orderstatus") == "P", "suspect").otherwise("ok").alias("status"))
    known = o.select(F.col("o_custkey").alias("id")).distinct().withColumn("has", F.lit(True))
    peers = c.select(F.col("c_custkey").alias("id")).join(known, "id", "left").select("id", F.col("has").isNotNull().alias("has_peers"))
    members = o.select(F.col("o_custkey").alias("set_id"), F.year("o_orderdate").alias("version"), F.col("o_orderpriority").alias("member")).distinct()
    places = o.select(F.when(k % 11 == 0, "unresolved").otherwise("same").alias("status"))
    out = reports.system_metrics(calls, raw, facts, o.select((F.col("o_orderstatus") == "O").alias("open")), peers, members, places, F.lit("2030-01-01").cast("timestamp"))
    return out.select("metric", r6("value").alias("value"))


_YEARLY = f"""{periods_sql('y', 'year')}, h AS (SELECT issuer AS id, 'revenue' AS concept, year(start) AS year, revenue AS value FROM y UNION ALL SELECT issuer, 'opex', year(start), opex FROM y WHERE issuer % 3 <> 0 OR year(start) % 2 = 0)"""


def _yearly(spark, d):
    y = long(periods(spark, d, "year"), "revenue", "opex").select(F.col("issuer").alias("id"), "concept", F.year("start").alias("year"), "value")
    return y.where("concept = 'revenue' or id % 3 <> 0 or year % 2 = 0")


@query(f"""WITH {_YEARLY}, l AS (SELECT id, year FROM h WHERE concept = 'revenue' QUALIFY row_number() OVER (PARTITION BY id ORDER BY year DESC) <= 5)
SELECT l.id, place, c.concept, string_agg(l.year || '=' || coalesce(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '-'), ' ' ORDER BY l.year) AS cells FROM l, (VALUES (0, 'opex'), (1, 'revenue')) c(place, concept) LEFT JOIN h ON h.id = l.id AND h.concept = c.concept AND h.year = l.year GROUP BY ALL""")
def card_view(spark, d):
    """Each issuer's card: two rows over its last five closed years, a dash where a year has no value."""
    rows = views.card(_yearly(spark, d), ["opex", "revenue"], "revenue")
    cell = F.transform("cells", lambda c: F.concat(c["year"].cast("string"), F.lit("="), F.coalesce(c["value"].cast("decimal(18,2)").cast("string"), F.lit("-"))))
    return rows.select("id", "place", "concept", F.array_join(cell, " ").alias("cells"))


@query(f"""WITH {_YEARLY}, p AS (SELECT *, lag(value) OVER (PARTITION BY id, concept ORDER BY year) AS v0, row_number() OVER (PARTITION BY id, concept ORDER BY year DESC) AS r FROM h)
SELECT id, concept, string_agg(CAST(year AS VARCHAR), ' ' ORDER BY year) AS x, count(*) AS n, round(max((value - v0) / abs(v0)) FILTER (r = 1), 6) AS change FROM p GROUP BY id, concept""")
def chart_series(spark, d):
    """The points of each issuer's lines and their last change."""
    s = views.series(_yearly(spark, d), ["revenue", "opex"])
    return s.select("id", "concept", F.array_join(F.transform("x", lambda v: v.cast("string")), " ").alias("x"), F.size("y").cast("bigint").alias("n"), r6("change").alias("change"))


@query(f"""WITH {_YEARLY}, {SECTORS}, m AS (SELECT sector, round(value, 2) AS value FROM h JOIN sectors ON issuer = id WHERE concept = 'revenue'), q AS (SELECT sector, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM m GROUP BY sector)
SELECT sector, CASE WHEN n >= 8 THEN round(min(value) FILTER (value >= q[1] - 1.5 * (q[3] - q[1])), 4) END AS low, CASE WHEN n >= 8 THEN round(any_value(q[1]), 4) END AS p25, CASE WHEN n >= 8 THEN round(any_value(q[2]), 4) END AS median, CASE WHEN n >= 8 THEN round(any_value(q[3]), 4) END AS p75,
CASE WHEN n >= 8 THEN round(max(value) FILTER (value <= q[3] + 1.5 * (q[3] - q[1])), 4) END AS high, CASE WHEN n >= 8 THEN n ELSE 0 END AS n FROM m JOIN q USING (sector) GROUP BY sector, n""")
def chart_boxes(spark, d):
    """Boxes of the yearly revenues of each sector."""
    m = _yearly(spark, d).where("concept = 'revenue'").join(sectors(spark, d).select(F.col("issuer").alias("id"), "sector"), "id").select("sector", F.round("value", 2).alias("value"))
    b = views.boxes(m, "sector")
    return b.select("sector", *[F.round(c, 4).alias(c) for c in ("low", "p25", "median", "p75", "high")], F.col("n").cast("bigint").alias("n"))


@query("""SELECT 'facts_without_raw_object' AS "check", count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 23 <> 0)
UNION ALL SELECT 'values_without_lineage', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'states_without_issuer', count(*) FROM orders WHERE o_custkey % 29 = 0 UNION ALL SELECT 'facts_without_concept', count(*) FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'manual_objects_without_document', count(*) FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0
UNION ALL SELECT 'manual_facts_without_document', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT 'documents_without_raw_object', count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 23 = 0""")
def doctor_checks(spark, d):
    """Rows that point at nothing: facts, measures, states, objects and documents of orders and their lines."""
    li, o, c = read(spark, d, "lineitem"), read(spark, d, "orders"), read(spark, d, "customer")
    k = F.col("o_orderkey")
    facts = li.select(F.col("l_orderkey").alias("source_ref"), F.when(F.col("l_returnflag") == "R", "manual").alias("source_kind"), F.when(F.col("l_returnflag") != "A", "revenue").alias("canonical"))
    raw = o.where("o_orderkey % 23 <> 0").select(k.alias("sha256"), F.when(F.col("o_orderpriority") == "1-URGENT", "manual-import").otherwise("api").alias("provider"))
    measures = o.select(k.alias("measure_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    states, issuers = o.select(F.col("o_custkey").alias("issuer")), c.where("c_custkey % 29 <> 0").select(F.col("c_custkey").alias("issuer"))
    return doctor.checks(facts, raw, o.where("o_orderkey % 3 = 0").select(k.alias("sha256")), measures, li.select(F.col("l_orderkey").alias("measure_id")), states, issuers)


@query("""WITH r AS (SELECT l_orderkey AS issuer, l_linenumber * 1000000 + l_partkey AS id, l_suppkey || '#page=' || l_linenumber AS ref, l_linenumber % 3 AS k, CASE l_linenumber % 3 WHEN 0 THEN 'true' WHEN 1 THEN CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) END AS v, l_returnflag <> 'A' AS ok FROM lineitem WHERE l_linenumber % 3 <> 2),
g AS (SELECT issuer, k, arg_max(v, (id, ref, v)) AS v, arg_min(ref, (id, ref)) AS ref, bool_and(ok) AS ok FROM r GROUP BY ALL)
SELECT issuer, CASE k WHEN 0 THEN 'ceo_chair' ELSE 'auditor' END AS indicator, CASE WHEN ok THEN CASE k WHEN 0 THEN 'roles_separated=' ELSE 'tenure_years=' END || v END AS inputs, ref AS lineage_ref, CASE WHEN NOT ok THEN 'manual_unverified' END AS reason FROM g""")
def governance_records(spark, d):
    """Records of an order's lines as inputs of two indicators, in other spellings of their names; a third name is known to none."""
    li, n = read(spark, d, "lineitem"), F.col("l_linenumber")
    metric = F.when(n % 3 == 0, " CEO chair-Roles  separated").when(n % 3 == 1, "auditor_tenure years").otherwise("fleet_age")
    value = F.when(n % 3 == 0, " Yes ").otherwise(F.col("l_quantity").cast("string"))
    r = li.select(F.col("l_orderkey").alias("issuer"), (n * 1000000 + F.col("l_partkey")).alias("record_id"), F.col("l_suppkey").cast("string").alias("sha256"), n.alias("page"), metric.alias("metric"), value.alias("value"), (F.col("l_returnflag") != "A").alias("verified"))
    out = governance.from_records(r)
    entry = F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("issuer", "indicator", F.array_join(entry, ",").alias("inputs"), "lineage_ref", "reason")
