"""Supersession, semi and anti joins, coverage, streams' batch twins and text guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.operators import picks
from ledgerlight.streaming import ingest

from .model import query, r6, read


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_anti(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N')")
def restated_semi(spark, d):
    li = read(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").join(li.where("l_returnflag = 'N'").select("l_orderkey"), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT fact_id, first_value(fact_id) OVER w AS winner, CASE WHEN first_value(fact_id) OVER w <> fact_id THEN first_value(fact_id) OVER w END AS superseded_by FROM (SELECT event_id AS fact_id, user_id, event_type, CAST(ts AS DATE) AS day, ts FROM events)
WINDOW w AS (PARTITION BY user_id, event_type, day ORDER BY ts, fact_id)""")
def dedup_supersession(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("fact_id"), "user_id", "event_type", F.to_date("ts").alias("day"), "ts")
    s = picks.supersede(e, ["user_id", "event_type", "day"], [F.col("ts"), F.col("fact_id")])
    return s.select("fact_id", F.coalesce("superseded_by", "fact_id").alias("winner"), "superseded_by")


#: The blocks of coverage.
BLOCKS = ("prices", "fundamentals", "ownership", "corporate_actions", "governance", "industry_metrics", "peer_set", "llm_summary")
_BLOCKS = "(VALUES " + ", ".join(f"('{b}')" for b in BLOCKS) + ") b(block)"


@query(f"SELECT s_suppkey AS issuer, block, CASE WHEN block = 'fundamentals' AND EXISTS (FROM lineitem WHERE l_suppkey = s_suppkey) THEN 'ready' ELSE 'missing' END AS status FROM supplier, {_BLOCKS}")
def coverage_ensure_all(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("issuer"))
    have = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("issuer")).distinct().withColumn("has", F.lit(True))
    rows = s.join(have, "issuer", "left").withColumn("block", F.explode(F.array(*map(F.lit, BLOCKS))))
    return rows.select("issuer", "block", F.when(F.col("has") & (F.col("block") == "fundamentals"), "ready").otherwise("missing").alias("status"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' AND value > 15 GROUP BY ALL HAVING count(*) >= 5")
def parser_degradation_30d(spark, d):
    e = read(spark, d, "events").where("ts >= timestamp'2024-01-01' and ts < timestamp'2024-01-31' and value > 15")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 5")


@query("SELECT count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, count(DISTINCT user_id) AS users, round(count(DISTINCT user_id) / count(*), 6) AS user_rate FROM events")
def system_metrics(spark, d):
    g = read(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.count_distinct("user_id").alias("users"))
    return g.select("n", r6(F.col("e") / F.col("n")).alias("error_rate"), "users", r6(F.col("users") / F.col("n")).alias("user_rate"))


@query("SELECT o_orderkey, 'FY' || (year(o_orderdate) + CASE WHEN strftime(o_orderdate, '%m-%d') <= '09-30' THEN 0 ELSE 1 END)::VARCHAR AS label FROM orders")
def fiscal_year_label(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.fiscal_year(F.col("o_orderdate"), "09-30").alias("label"))


_UNITS = ("million tons", "thousand barrels", "USD/shares", "USD", "tons", "billion", "tons million")


_UNIT = "[" + ", ".join(f"'{u}'" for u in _UNITS) + f"][o_orderkey % {len(_UNITS)} + 1]"


@query(f"""SELECT o_orderkey, CASE WHEN split_part(unit, ' ', 1) IN ('thousand', 'million', 'billion') THEN regexp_replace(unit, '^[^ ]+ ?', '') ELSE unit END AS base,
CASE split_part(unit, ' ', 1) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END AS multiplier, nullif(regexp_extract(unit, '^([A-Z]{{3}})(/shares)?$', 1), '') AS currency
FROM (SELECT o_orderkey, {_UNIT} AS unit FROM orders)""")
def unit_scale_parse(spark, d):
    """The unit that each order is told in, with its scale and currency."""
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("o_orderkey") % len(_UNITS) + 1).cast("int"))
    u = read(spark, d, "orders").select("o_orderkey", unit.alias("unit"))
    return u.select("o_orderkey", T.scaled_unit(F.col("unit")).alias("s"), T.currency_of(F.col("unit")).alias("currency")).select("o_orderkey", "s.base", "s.multiplier", "currency")


_ANSWER = """'Order ' || o_orderkey || ' came to ' || CASE WHEN o_orderkey % 3 = 0 THEN '1,250' ELSE '1250' END || ' or ' || replace(printf('%.2f', o_totalprice), '.', ',') ||
CASE WHEN o_orderkey % 5 = 0 THEN ', again 1250' ELSE '' END"""


@query(f"""WITH a AS (SELECT o_orderkey, {_ANSWER} AS said FROM orders),
t AS (SELECT o_orderkey, unnest(string_split(regexp_replace(said, '[^0-9.,]+|[.,]+ ', ' ', 'g'), ' ')) AS x FROM a),
n AS (SELECT o_orderkey, CASE WHEN x = '1,250' THEN '1250' ELSE replace(x, ',', '.') END AS x FROM t WHERE regexp_matches(x, '[0-9]')),
g AS (SELECT o_orderkey, unnest([CAST(o_orderkey AS VARCHAR), '1250', printf('%.2f', o_totalprice)]) AS x FROM orders),
d AS (SELECT o_orderkey, x FROM n EXCEPT ALL SELECT o_orderkey, x FROM g)
SELECT n.o_orderkey, NOT EXISTS (FROM d WHERE d.o_orderkey = n.o_orderkey) AS ok, count(*) AS numbers FROM n GROUP BY n.o_orderkey""")
def number_guard_multiset(spark, d):
    """Answers that tell an order's number and price: a decimal comma, thousands in groups, and one that says a number twice."""
    key, price = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice"))
    group = F.when(key % 3 == 0, "1,250").otherwise("1250")
    more = F.when(key % 5 == 0, ", again 1250").otherwise("")
    said = F.concat(F.lit("Order "), key.cast("string"), F.lit(" came to "), group, F.lit(" or "), F.replace(price, F.lit("."), F.lit(",")), more)
    o = read(spark, d, "orders").select(key, T.number_guard(said, F.array(key.cast("string"), F.lit("1250"), price)).alias("g"), F.size(T.numbers(said)).cast("long").alias("numbers"))
    return o.select("o_orderkey", "g.ok", "numbers")


@query()
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


_CALLED = """url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || ['Token=', 'xref=', 'PASSWORD=', 'key=', 'monkey='][page_id % 5 + 1] || page_id || '&lang=en'"""


@query(f"""WITH u AS (SELECT page_id, {_CALLED} AS u FROM pages), p AS (SELECT page_id, split_part(u, '?', 1) AS head, string_split(substr(u, strpos(u, '?') + 1), '&') AS q FROM u)
SELECT page_id, head || '?' || array_to_string(list_filter(q, lambda x: NOT list_contains(['key', 'token', 'apikey', 'api_key', 'access_token', 'password'], lower(split_part(x, '=', 1)))), '&') AS url FROM p""")
def secret_scrub(spark, d):
    """Page addresses called with another parameter, some secret, some with a name that only ends like one."""
    name = F.element_at(F.array(*map(F.lit, ("Token=", "xref=", "PASSWORD=", "key=", "monkey="))), (F.col("page_id") % 5 + 1).cast("int"))
    called = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), name, F.col("page_id").cast("string"), F.lit("&lang=en"))
    return read(spark, d, "pages").select("page_id", T.scrub(called).alias("url"))


@query("SELECT CAST(floor(p_size / 5) * 5 AS BIGINT) AS age_from, count(*) AS n FROM part GROUP BY ALL")
def age_histogram(spark, d):
    return read(spark, d, "part").groupBy((F.floor(F.col("p_size") / 5) * 5).alias("age_from")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'added' ELSE 'already_present' END AS class FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) ON c_custkey = o_custkey")
def import_classification(spark, d):
    n = read(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").join(n, "c_custkey", "left")
    return c.select("c_custkey", F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "added").otherwise("already_present").alias("class"))


@query("SELECT user_id, CAST(max(ts) AS TIMESTAMP) AS last_seen, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY user_id")
def dedup_stream(spark, d):
    return ingest.last_seen(spark, d, "events.parquet")
