"""Adapters from the driver's tables to the fact model, each with the same in SQL.

issuer = supplier, sector = region; quarterly facts are sums of lineitem; daily prices are user averages of events.
Money is summed in decimals, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
AS_OF = "2001-09-30"
#: The currency of each region.
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "BRL")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        REGISTRY[name or f.__name__] = (f, sql)
        return f

    return put


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def dec(x: Column | str, kind: str = "decimal(12,2)") -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(kind)


def periods(spark: SparkSession, d: str, unit: str = "quarter") -> DataFrame:
    """(issuer, start, end, revenue, cogs, tax, opex, returned) for each quarter or year."""
    price, rate = dec("l_extendedprice"), "decimal(4,2)"
    at = F.date_trunc(unit, "l_shipdate").cast("date")
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("issuer"), at.alias("start"), price.alias("price"), dec(1 - F.col("l_discount"), rate).alias("net"), dec("l_tax", rate).alias("rate"), dec("l_quantity").alias("quantity"), "l_returnflag")
    p = F.col("price")
    g = li.groupBy("issuer", "start").agg(
        F.sum(p).cast("double").alias("revenue"),
        F.sum(p * F.col("net")).cast("double").alias("cogs"),
        F.sum(p * F.col("rate")).cast("double").alias("tax"),
        F.sum("quantity").cast("double").alias("opex"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", p)), F.lit(0)).cast("double").alias("returned"),
    )
    end = F.date_sub(F.add_months("start", 3 if unit == "quarter" else 12), 1)
    return g.select("issuer", "start", end.alias("end"), "revenue", "cogs", "tax", "opex", "returned")


def periods_sql(name: str, unit: str = "quarter") -> str:
    p = "CAST(l_extendedprice AS DECIMAL(12,2))"
    months = 3 if unit == "quarter" else 12
    return f"""{name} AS (SELECT l_suppkey AS issuer, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS start, CAST(date_trunc('{unit}', l_shipdate) + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) AS "end",
CAST(sum({p}) AS DOUBLE) AS revenue, CAST(sum({p} * CAST(1 - l_discount AS DECIMAL(4,2))) AS DOUBLE) AS cogs, CAST(sum({p} * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS tax,
CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS opex, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN {p} END), 0) AS DOUBLE) AS returned FROM lineitem GROUP BY ALL)"""


def long(frame: DataFrame, *concepts: str) -> DataFrame:
    """(issuer, concept, start, end, value)."""
    return frame.select("issuer", "start", "end", F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.col(c).alias("value")) for c in concepts])).alias("f")).select("issuer", "f.concept", "start", "end", "f.value")


def long_sql(name: str, table: str, *concepts: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"""SELECT issuer, '{c}' AS concept, start, "end", {c} AS value FROM {table}""" for c in concepts) + ")"


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """(issuer, name, nation, sector, currency, balance)."""
    s, n, r = (read(spark, d, t) for t in ("supplier", "nation", "region"))
    money = F.element_at(F.array(*map(F.lit, CURRENCIES)), F.col("r_regionkey") + 1)
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.select(F.col("s_suppkey").alias("issuer"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("sector"), money.alias("currency"), F.col("s_acctbal").alias("balance"))


SECTORS = f"""sectors AS (SELECT s_suppkey AS issuer, s_name AS name, n_name AS nation, r_name AS sector, [{", ".join(f"'{c}'" for c in CURRENCIES)}][r_regionkey + 1] AS currency, s_acctbal AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(id, date, close): the daily average of each user's events."""
    e = read(spark, d, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("date"), dec("value").alias("v"))
    return e.groupBy("id", "date").agg((F.sum("v").cast("double") / F.count("v")).alias("close"))


PRICES = "prices AS (SELECT user_id AS id, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(value) AS close FROM events GROUP BY ALL)"


def actions(spark: SparkSession, d: str) -> DataFrame:
    """(id, date, kind, amount): one split by 2 for a day with a signup, one dividend for a day with a purchase."""
    e = read(spark, d, "events").where("event_type in ('signup', 'purchase')")
    kind = F.when(F.col("event_type") == "signup", "split").otherwise("dividend")
    g = e.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("date"), kind.alias("kind")).agg(F.min("value").alias("v"))
    return g.select("id", "date", "kind", F.when(F.col("kind") == "split", 2.0).otherwise(F.col("v") / 100).alias("amount"))


ACTIONS = """actions AS (SELECT id, date, kind, CASE kind WHEN 'split' THEN 2.0::DOUBLE ELSE v / 100 END AS amount FROM (SELECT user_id AS id, CAST(ts AS DATE) AS date, CASE event_type WHEN 'signup' THEN 'split' ELSE 'dividend' END AS kind, min(value) AS v
FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL))"""


def r6(x: Column | str) -> Column:
    """x to six places by the nearest double of 1e6 x, as the SQL does; F.round goes by the decimal digits, and halves differ."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    near = F.round(x * 1e6) / 1e6
    # a rounded zero keeps its sign; infinite ones and those beyond the range of doubles stay as they are
    return F.when(F.abs(x) < 1e300, F.when(near == 0, x * 0.0).otherwise(near)).otherwise(x)
