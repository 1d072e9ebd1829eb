"""Small operators over listings, coverage, lineage and deals: filters, semi joins, counts, plans and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .picks import first_by

#: Venues of the suggestion of peers, days of a poll, most targets of one operation.
US_VENUES, POLL_DAYS, MOST_TARGETS = ("Nasdaq", "NYSE"), 10, 100
STATUSES = ("ready", "stale", "processing", "missing", "error")


def stale_exclusions(facts: DataFrame, most: int = 1100) -> DataFrame:
    """Facts that end over *most* days before the issuer's newest end, with that anchor."""
    anchor = F.max("end").over(Window.partitionBy("issuer"))
    return facts.withColumn("anchor", anchor).where(F.datediff("anchor", "end") > most)


def declarations(facts: DataFrame) -> DataFrame:
    """Facts whose period is a declaration: at most 31 days, or one day."""
    return facts.where(F.datediff("end", "start").between(0, 31))


def declared_by_year(facts: DataFrame) -> DataFrame:
    """(issuer, year, declared, n): declarations summed by calendar year of their date, one for each date."""
    one = first_by(declarations(facts), ["issuer", "end"], "fact_id")
    return one.groupBy("issuer", F.year("end").alias("year")).agg(F.sum("value").alias("declared"), F.count("*").alias("n"))


def usual_count(by_year: DataFrame) -> DataFrame:
    """(issuer, usual): the most frequent number of declarations a year; of equals the smaller."""
    n = by_year.groupBy("issuer", "n").agg(F.count("*").alias("years"))
    return first_by(n, ["issuer"], F.desc("years"), "n").select("issuer", F.col("n").alias("usual"))


def in_market(listings: DataFrame, venues: DataFrame, market: str) -> DataFrame:
    """Listings of a market by venues (exchange, market); an exchange that is unknown is allowed."""
    v = venues.select("exchange", "market")
    return listings.join(F.broadcast(v), "exchange", "left").where(F.col("market").isNull() | (F.col("market") == market)).drop("market")


def searched(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows that have the text in one of the columns, case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def operation(targets: DataFrame, known: DataFrame, members: DataFrame, exclude_delisted: bool = True, most: int = MOST_TARGETS) -> DataFrame:
    """(ticker, id, class) of what an operation on a list would do: not_found, ambiguous, delisted, already_present or add.

    targets (ticker), known (ticker, id, delisted), members (id). More than *most* targets refuse them all ('too_many').
    """
    k = known.groupBy("ticker").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"), F.bool_or("delisted").alias("delisted"))
    out = targets.select("ticker").distinct().join(k, "ticker", "left").join(members.select("id").distinct().withColumn("has", F.lit(True)), "id", "left")
    total = targets.select("ticker").distinct().agg(F.count("*").alias("total"))
    kind = F.when(F.col("total") > most, "too_many").when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous")
    kind = kind.when(F.col("delisted") & F.lit(exclude_delisted), "delisted").when(F.col("has"), "already_present").otherwise("add")
    return out.join(F.broadcast(total), how="cross").select("ticker", F.when(F.coalesce("n", F.lit(0)) == 1, F.col("id")).alias("id"), kind.alias("class"))


def member_snapshots(members: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """members with as_of and version of the newest snapshot up to a date; null where there is none."""
    s = snapshots.where(F.col("as_of") <= F.lit(as_of).cast("date")).groupBy("member").agg(F.max(F.struct("as_of", "version")).alias("s"))
    return members.join(s, "member", "left").select(*members.columns, F.col("s.as_of").alias("as_of"), F.col("s.version").alias("version"))


def previous_version(snapshots: DataFrame) -> DataFrame:
    """snapshots with previous: the newest ready version of the member before it."""
    ready = F.when(F.col("status") == "ready", F.col("version"))
    w = Window.partitionBy("member").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    return snapshots.withColumn("previous", F.max(ready).over(w))


def common_periods(facts: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """(issuer, unit, start, end, and a column for each concept): periods that all the concepts share."""
    g = facts.where(F.col("concept").isin(*concepts) & F.col("value").isNotNull()).groupBy("issuer", "unit", "start", "end")
    wide = g.agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in concepts])
    return wide.dropna(subset=list(concepts))


def annual_ends(facts: DataFrame) -> DataFrame:
    """(issuer, end): distinct ends of years of revenue or net income."""
    year = F.datediff("end", "start") + 1
    return facts.where(F.col("concept").isin("revenue", "net_income") & year.between(350, 380)).select("issuer", "end").distinct()


def fresh_diluted(facts: DataFrame, as_of: str, most: int = 550) -> DataFrame:
    """(issuer, value, end): diluted shares of the newest end, of these the shortest window, unless older than *most* days."""
    at = F.lit(as_of).cast("date")
    f = facts.where((F.col("concept") == "shares_diluted") & (F.col("end") <= at) & (F.datediff(at, "end") <= most))
    return first_by(f, ["issuer"], F.desc("end"), F.datediff("end", "start"), "value").select("issuer", "value", "end")


def measures_of_facts(lineage: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, measure_id, instrument, concept): what rests on each of the facts, through measures that feed measures too."""
    direct = lineage.join(facts.select("fact_id"), "fact_id").select("fact_id", "measure_id")
    fed = lineage.where("peer_measure_id is not null").select(F.col("peer_measure_id").alias("measure_id"), F.col("measure_id").alias("next"))
    second = direct.join(fed, "measure_id").select("fact_id", F.col("next").alias("measure_id"))
    return direct.union(second).distinct()


def pairs_to_verify(facts: DataFrame) -> DataFrame:
    """(issuer, concept, end, manual, provider, differs): a manual fact beside a provider's of the same key."""
    key = ["issuer", "concept", "end"]
    m, p = (facts.where(F.col("source_kind") == k).groupBy(*key).agg(F.max_by("value", "fact_id").alias(k)) for k in ("manual", "provider"))
    return m.join(p, key).withColumn("differs", F.abs(F.col("manual") - F.col("provider")) > 0)


def composition(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(set_id, members, with_facts, currencies): sizes of peer sets and the currencies their members file in."""
    c = facts.groupBy(F.col("issuer").alias("member")).agg(F.collect_set("currency").alias("c"))
    g = members.join(c, "member", "left").groupBy("set_id").agg(F.count("*").alias("members"), F.count("c").alias("with_facts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("c"))
    return g.select("set_id", "members", "with_facts", F.array_join("c", ", ").alias("currencies"))


def coverage_of_list(coverage: DataFrame, lists: DataFrame) -> DataFrame:
    """Coverage rows of the members of each list's latest version."""
    top = lists.groupBy("list_id").agg(F.max("version").alias("version"))
    now = lists.join(top, ["list_id", "version"], "left_semi").select(F.col("member").alias("id")).distinct()
    return coverage.join(now, "id", "left_semi")


def status_summary(coverage: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    """(block, status, n), with zeros for what does not occur."""
    spark = coverage.sparkSession
    grid = spark.createDataFrame([(b, s) for b in blocks for s in STATUSES], "block string, status string")
    n = coverage.groupBy("block", "status").agg(F.count("*").alias("n"))
    return grid.join(n, ["block", "status"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def radar(company: DataFrame, group: DataFrame) -> DataFrame:
    """(issuer, concept, own, median, side): a company's ratios against the medians of its group, and what could not be compared.

    company (issuer, set_id, concept, value), group (set_id, concept, median).
    """
    j = company.join(group.select("set_id", "concept", "median"), ["set_id", "concept"], "left")
    side = F.when(F.col("value").isNull(), "no_own").when(F.col("median").isNull(), "no_group").when(F.col("value") > F.col("median"), "above").when(F.col("value") < F.col("median"), "below").otherwise("equal")
    return j.select("issuer", "concept", F.col("value").alias("own"), "median", side.alias("side"))


def suggested(industry: DataFrame, frames: DataFrame, listed: DataFrame, exclude: DataFrame, most: int = 5) -> DataFrame:
    """(industry, id, ticker, revenue, place): the largest listed companies of an industry.

    industry (industry, id); frames (id, strength, value), the smallest strength first; listed (id, ticker, venue), the first ticker
    counts; exclude (id).
    """
    revenue = first_by(frames.where("value is not null"), ["id"], "strength", "value").select("id", F.col("value").alias("revenue"))
    one = first_by(listed, ["id"], "ticker").where(F.col("venue").isin(*US_VENUES))
    j = industry.distinct().join(exclude.select("id"), "id", "left_anti").join(one, "id").join(revenue.where("revenue > 0"), "id")
    place = F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("revenue"), "ticker"))
    return j.withColumn("place", place).where(F.col("place") <= most).select("industry", "id", "ticker", "revenue", "place")


def measure_currencies(lineage: DataFrame, facts: DataFrame, measures: DataFrame) -> DataFrame:
    """(measure_id, currencies): those of the facts under each measure, blank only for money, and of its own unit if that is one."""
    unit = F.regexp_extract("unit", "^[A-Z]{3}$", 0)
    money = (F.col("unit") == "") | F.col("unit").isNull() | (unit != "")
    m = measures.select("measure_id", money.alias("money"))
    f = lineage.join(facts.select("fact_id", "currency"), "fact_id").join(m, "measure_id")
    from_facts = f.select("measure_id", F.when(F.col("money"), F.coalesce("currency", F.lit("(blank)"))).otherwise(F.col("currency")).alias("c"))
    own = measures.where(unit != "").select("measure_id", unit.alias("c"))
    return from_facts.union(own).where("c is not null").groupBy("measure_id").agg(F.array_join(F.array_sort(F.collect_set("c")), ", ").alias("currencies"))


def channels(listings: DataFrame, measures: DataFrame, facts: DataFrame, raw: DataFrame) -> DataFrame:
    """(market, instruments, degree): how far each market's data come: measures, facts, raw or none; all of them (id)."""
    j = listings.select("market", "id")
    for name, t in (("m", measures), ("f", facts), ("r", raw)):
        j = j.join(t.select("id").distinct().withColumn(name, F.lit(True)), "id", "left")
    g = j.groupBy("market").agg(F.count_distinct("id").alias("instruments"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in "mfr"])
    return g.select("market", "instruments", F.when(F.col("m"), "measures").when(F.col("f"), "facts").when(F.col("r"), "raw").otherwise("none").alias("degree"))


def upper_median(rows: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, median, n): the value at place n div 2 of each key's sorted values, by rank and not in one array."""
    w = Window.partitionBy(*key)
    r = rows.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1)
    return r.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*key, F.col(value).alias("median"), F.col("_n").alias("n"))


def poll_plan(states: DataFrame, polls: DataFrame, as_of: str, days: int = POLL_DAYS, budget: int | None = None) -> DataFrame:
    """(id, action, reason, priority, place): backfill of what is incomplete first, then polls that are due; in order of id.

    states (id, state, reason, last_date), polls (id, last_poll). With a *budget* the rows beyond it are 'wait'.
    """
    p = states.join(polls.groupBy("id").agg(F.max("last_poll").alias("last_poll")), "id", "left")
    since = F.greatest("last_poll", "last_date")
    full = F.col("state") == "complete"
    due = F.datediff(F.lit(as_of).cast("date"), since) >= days
    action = F.when(~full, "backfill").when(due, "poll").otherwise("skip")
    reason = F.when(~full, F.col("reason")).when(due, "due").otherwise(F.concat(F.lit("polled:"), since.cast("string")))
    out = p.select("id", action.alias("action"), reason.alias("reason"), F.when(full, 2).otherwise(1).alias("priority"))
    if budget is None:
        return out
    # only the first rows can be in the budget: a bounded top-k, no global sort
    first = out.where("action <> 'skip'").orderBy("priority", "id").limit(budget).select("id", F.lit(True).alias("_in"))
    return out.join(first, "id", "left").withColumn("action", F.when((F.col("action") == "skip") | F.col("_in"), F.col("action")).otherwise("wait")).drop("_in")


def split_factors(actions: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (id, day_from, day_to) with factor: the product of the splits in (day_from, day_to], one for each date."""
    s = actions.where("kind = 'split' and amount > 0").groupBy("id", "date").agg(F.min("amount").alias("amount"))
    inside = (F.col("date") > F.col("day_from")) & (F.col("date") <= F.col("day_to"))
    g = spans.join(s, "id", "left").groupBy(*spans.columns).agg(F.product(F.when(inside, F.col("amount"))).alias("factor"))
    return g.withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def declared_amounts(actions: DataFrame) -> DataFrame:
    """Dividends with declared: the amount of the vendor's share base times the splits after its day; a suffix product."""
    f = F.when(F.col("kind") == "split", F.col("amount"))
    w = Window.partitionBy("id").orderBy(F.col("date").cast("timestamp").cast("long")).rangeBetween(1, Window.unboundedFollowing)
    a = actions.withColumn("after", F.coalesce(F.product(f).over(w), F.lit(1.0)))
    return a.where("kind = 'dividend'").select("id", "date", "amount", (F.col("amount") * F.col("after")).alias("declared"))


def requests_on(samples: DataFrame, day: Column, name: str = "requests") -> DataFrame:
    """(host, used) of a day's samples (host, at, name, value)."""
    return samples.where((F.col("name") == name) & (F.to_date("at") == day)).groupBy("host").agg(F.sum("value").alias("used"))


def refreshed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, changed, refused, new): measures (id, concept, value) that changed, lost their value or came."""
    j = before.select("id", "concept", F.col("value").alias("b"), F.lit(True).alias("was")).join(after.select("id", "concept", F.col("value").alias("a"), F.lit(True).alias("now")), ["id", "concept"], "full")
    return j.groupBy("id").agg(F.count_if(F.col("was") & F.col("now") & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("now") & F.col("a").isNull()).alias("refused"), F.count_if(F.col("was").isNull()).alias("new"))


def sector_tree(rows: DataFrame) -> DataFrame:
    """(sector, names): the names of each sector in order, one line; a sector's names are bounded by its listings."""
    return rows.groupBy("sector").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"), F.count("*").alias("n"))
