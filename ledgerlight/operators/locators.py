"""Where a fact stands in its raw object: locators as JSON pointers, resolved over variants, and what follows from a value that has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a locator is: kind, the object, and the parts that its kind reads.
LOCATOR = "struct<kind:string,sha256:string,pointer:string,fact:string,table:int,row:int,col:int,snippet:string>"


def pointer(locator: Column) -> Column:
    """The JSON pointer of a locator: its own (api), that of a fact by name (xbrl), that of a cell (table); null for other kinds."""
    name = F.replace(F.replace(locator["fact"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    cell = F.format_string("/tables/%d/rows/%d/cells/%d/value", locator["table"], locator["row"], locator["col"])
    kind = locator["kind"]
    return F.when(kind == "api", locator["pointer"]).when(kind == "xbrl", F.concat(F.lit("/facts/"), name, F.lit("/value"))).when(kind == "table", cell)


def variant_paths(pointer: Column) -> Column:
    """The paths of a variant that a JSON pointer may mean: a number is a place in a list, else a name of an object.

    ~1 and ~0 stand for / and ~. Null for a pointer that doesn't begin with / and for names with both kinds of quotes.
    """
    parts = F.transform(F.slice(F.split(pointer, "/"), 2, F.size(F.split(pointer, "/"))), lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    quoted = lambda p: F.when(p.contains("'"), F.concat(F.lit('["'), p, F.lit('"]'))).otherwise(F.concat(F.lit("['"), p, F.lit("']")))
    number = lambda p: p.rlike("^(0|[1-9][0-9]*)$")
    lists = F.transform(parts, lambda p: F.when(number(p), F.concat(F.lit("["), p, F.lit("]"))).otherwise(quoted(p)))
    names = F.transform(parts, quoted)
    odd = F.exists(parts, lambda p: p.contains("'") & p.contains('"'))
    both = F.array_distinct(F.array(F.concat(F.lit("$"), F.array_join(lists, "")), F.concat(F.lit("$"), F.array_join(names, ""))))
    # a numbered name beside numbered places: the first number as a name, the others as places
    first = F.array_position(F.transform(parts, number), F.lit(True))
    mixed = F.concat(F.lit("$"), F.array_join(F.transform(parts, lambda p, i: F.when(number(p) & (i + 1 > first), F.concat(F.lit("["), p, F.lit("]"))).otherwise(quoted(p))), ""))
    return F.when(pointer.startswith("/") & ~odd, F.array_distinct(F.array_append(both, mixed)))


def resolved(facts: DataFrame, objects: DataFrame) -> DataFrame:
    """(fact_id, status, actual, reason): same, revised (another value stands there now) or unresolved with a reason.

    facts (fact_id, value, locator as LOCATOR) with values as texts; objects (sha256, content as text). An object is joined once for each
    thousand of its facts and parsed once for these; so neither an object nor its text goes out once for each fact.
    """
    asked = facts.select("fact_id", "value", "locator", F.col("locator.sha256").alias("sha256"), variant_paths(pointer(F.col("locator"))).alias("paths"))
    ask = F.struct("fact_id", "value", F.col("locator.kind").alias("kind"), F.col("locator.snippet").alias("snippet"), "paths")
    packed = asked.where("sha256 is not null").groupBy("sha256", F.pmod(F.xxhash64("fact_id"), F.lit(1 << 30)).alias("_h")).agg(F.collect_list(ask).alias("f"))
    sizes = packed.groupBy("sha256").agg(F.sum(F.size("f")).alias("_n"))
    packed = packed.join(sizes, "sha256").groupBy("sha256", F.pmod("_h", F.ceil(F.col("_n") / 1000)).alias("_s")).agg(F.flatten(F.collect_list("f")).alias("f"))
    j = packed.join(objects.select("sha256", "content"), "sha256", "left").withColumn("v", F.try_parse_json("content"))

    def answer(f: Column) -> Column:
        found = F.transform(f["paths"], lambda p: F.try_variant_get(F.col("v"), p, "string"))
        digits = F.regexp_extract_all(f["snippet"], F.lit(r"[\d,]+\.?\d*"), F.lit(0))
        last = F.replace(F.try_element_at(digits, F.lit(-1)), F.lit(","), F.lit(""))
        text = f["kind"].isin("html", "pdf")
        here = F.coalesce((f["snippet"] != "") & F.contains(F.col("content"), f["snippet"]), F.lit(False))
        actual = F.when(text, F.when(here, last)).otherwise(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))
        why = (
            F.when(F.col("content").isNull(), "object_missing").when(text & ~here, "snippet_not_found").when(text & last.isNull(), "no_number").when(text, None).when(f["kind"] == "derived", "derived: computed, not filed")
            .when(~F.coalesce(f["kind"].isin("api", "xbrl", "table"), F.lit(False)), F.concat(F.lit("unknown_locator: "), F.coalesce(f["kind"], F.lit("")))).when(F.col("v").isNull(), "not_json").when(f["paths"].isNull(), "bad_pointer").when(actual.isNull(), "nothing_there")
        )
        return F.struct(f["fact_id"].alias("fact_id"), f["value"].alias("value"), F.when(why.isNull(), actual).alias("actual"), why.alias("reason"))

    out = j.select(F.explode(F.transform("f", answer)).alias("a")).select("a.*")
    lost = asked.where("sha256 is null").select("fact_id", "value", F.lit(None).cast("string").alias("actual"), F.lit("no_locator").alias("reason"))
    status = F.when(F.col("reason").isNotNull(), "unresolved").when(F.col("actual") == F.col("value"), "same").otherwise("revised")
    return out.unionByName(lost).select("fact_id", status.alias("status"), "actual", "reason")


def verified(facts: DataFrame, manual: DataFrame, key: list[str]) -> DataFrame:
    """All facts (fact_id, *key, value, origin, filed) with superseded_by after *manual* ones were verified: these win over filed ones, then
    the last filed; none is overwritten."""
    from .picks import supersede

    both = facts.unionByName(manual)
    return supersede(both, key, [F.col("origin") != "manual", F.desc("filed"), F.col("fact_id")])


def dependants(changed: DataFrame, lines: DataFrame) -> DataFrame:
    """(issuer, at, concept): values that are made of a changed fact (issuer, source, period_start, period_end), by lines of lineage."""
    keys = changed.select("issuer", "source", "period_start", "period_end").distinct()
    return lines.where("kind = 'fact'").join(keys, ["issuer", "source", "period_start", "period_end"], "left_semi").select("issuer", "at", "concept").distinct()
