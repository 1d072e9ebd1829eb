"""Snapshots: the whole catalogue of measures of every issuer at any dates, in one plan, with the lineage of each value.

One row for each issuer and date carries its inputs in maps: windows of flows, balances at their borders, newest balances, price, count of
shares. Measures come level by level, each an array of (name, value, reason) that the next one reads. Every measure has a value or a reason.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import reasons as R
from ledgerlight.scratch import saved

from . import borders, capital, groups, picks, prices
from .valuation import (
    DIVIDEND_DAYS, NOT_FOR_BANKS, PRICE_DAYS, _or_missing, absent, currencies_clash, ebitda, enterprise_value, market_cap_total, mean_ratio, measure, shares,
)

#: The concepts that a snapshot reads, as flows and as balances.
FLOWS = ("revenue", "cogs", "gross_profit", "opex", "operating_income", "d_and_a", "net_income", "pretax_income", "tax_expense", "interest_expense", "interest_income", "ocf", "capex", "dps")
STOCKS = ("cash", "st_investments", "total_debt", "total_equity", "total_equity_incl_nci", "minority_interest", "preferred_equity", "total_assets", "shares_outstanding", "shares_diluted", "dps_ttm")
#: Inputs that must be of one period; where one of several recipes is to be taken, the first that is filed.
RECIPES = {
    "gross_profit": ("revenue", "cogs"), "gross_profit filed": ("gross_profit",), "gross_margin": ("revenue", "cogs"), "gross_margin filed": ("gross_profit", "revenue"),
    "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"), "effective_tax": ("tax_expense", "pretax_income"), "ebitda": ("operating_income", "d_and_a"),
    "ebitda built": ("revenue", "cogs", "opex", "d_and_a"), "fcf": ("ocf", "capex"), "interest_coverage": ("operating_income", "interest_expense"),
    "nopat": ("operating_income", "tax_expense", "pretax_income"), "pe": ("net_income",), "ps": ("revenue",),
}
#: Flows over the mean of a balance at both ends of their window.
TWO_PERIOD = {"roe": ("net_income", "total_equity"), "roe_incl_nci": ("net_income", "total_equity_incl_nci"), "asset_turnover": ("revenue", "total_assets")}
#: Balances that a measure reads at the date, and measures that feed others.
BALANCES = {
    "net_debt": ("total_debt", "cash", "st_investments"), "invested_capital": ("total_equity", "minority_interest", "total_debt", "cash", "st_investments"),
    "ev": ("total_debt", "cash", "st_investments", "minority_interest", "preferred_equity"), "pb": ("total_equity",), "market_cap": ("shares_outstanding", "shares_diluted"),
}
FEEDS = {
    "gross_margin": ("gross_profit",), "nopat": ("effective_tax",), "net_debt_ebitda": ("net_debt", "ebitda"), "market_cap_total": ("market_cap",), "ev": ("market_cap_total",), "pb": ("market_cap_total",),
    "pe": ("market_cap_total",), "ps": ("market_cap_total",), "fcf_yield": ("market_cap", "fcf"), "ev_ebitda": ("ev", "ebitda"), "roic": ("nopat", "invested_capital"),
}
#: The measure whose inputs' period another one has.
SPAN_OF = {"fcf_yield": "fcf", "ev_ebitda": "ebitda", "net_debt_ebitda": "ebitda", "roic": "nopat"}
MONEY = ("gross_profit", "ebitda", "nopat", "fcf", "net_debt", "invested_capital", "ev", "market_cap", "market_cap_total")
LEVELS = (
    ("gross_profit", "operating_margin", "net_margin", "effective_tax", "ebitda", "fcf", "interest_coverage", *TWO_PERIOD, "net_debt", "invested_capital", "market_cap", "div_yield", "price_adj", "hhi"),
    ("gross_margin", "nopat", "net_debt_ebitda", "market_cap_total", "fcf_yield"),
    ("ev", "pb", "pe", "ps", "roic"),
    ("ev_ebitda",),
)
MEASURES = tuple(m for level in LEVELS for m in level)


def needed(measures: Iterable[str]) -> set[str]:
    """The measures and all that feed them."""
    out, todo = set(), list(measures)
    while todo:
        if (m := todo.pop()) not in out:
            out.add(m)
            todo += FEEDS.get(m, ())
    return out


def _text(x: str | None = None) -> Column:
    return F.lit(x).cast("string")


def _get(m: str, key: str | Column) -> Column:
    return F.try_element_at(F.col(m), F.lit(key) if isinstance(key, str) else key)


def _with(rows: DataFrame, **defaults: Column) -> DataFrame:
    return rows.withColumns({n: c for n, c in defaults.items() if n not in rows.columns})


def operating_income(flows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Operating income, period by period, where it is not filed: pretax income with interest put back; never for banks."""
    names = ("operating_income", "pretax_income", "interest_expense", "interest_income")
    at = [F.max(F.when(F.col("concept") == n, F.col("value"))).alias(n) for n in names]
    p = flows.where(F.col("concept").isin(*names)).groupBy("issuer", "unit", "start", "end").agg(*at).where("operating_income is null")
    p = p.join(instruments.where(~F.coalesce("bank", F.lit(False))).select("issuer"), "issuer", "left_semi")
    value = F.col("pretax_income") + F.col("interest_expense") - F.coalesce("interest_income", F.lit(0.0))
    return p.select("issuer", F.lit("operating_income").alias("concept"), "start", "end", value.alias("value"), "unit").where("value is not null")


def with_operating_income(flows: DataFrame, instruments: DataFrame) -> DataFrame:
    """flows with operating_income() put in."""
    return flows.unionByName(operating_income(flows, instruments))


def _inputs(recipes: dict[str, tuple[str, ...]]) -> Column:
    """Map of each recipe to its inputs of one period: (values, start, end, basis, unit, parts, reason).

    All windows must be of one span, basis and unit; else the newest year in which all are filed, else the newest such period, else
    period_mismatch. Inputs that are not filed are named, with their last period where they have become too old.
    """

    def one(r: Column) -> Column:
        flows = F.transform(r["wanted"], lambda c: F.struct(c.alias("concept"), F.try_element_at(F.col("flow"), c).alias("x")))
        near = F.coalesce(_get("common", r["recipe"]), F.array().cast(kind))
        return F.element_at(F.transform(F.array(F.struct(r["recipe"].alias("recipe"), r["wanted"].alias("wanted"), flows.alias("flows"), near.alias("near"))), made), 1)

    def made(x: Column) -> Column:
        gone = lambda f: f["x"].isNull() | f["x"]["last"].isNotNull()
        missing = F.array_sort(F.transform(F.filter(x["flows"], lambda f: f["x"].isNull()), lambda f: f["concept"]))
        old = F.array_sort(F.transform(F.filter(x["flows"], lambda f: f["x"]["last"].isNotNull()), lambda f: F.concat(f["concept"], F.lit(": last "), f["x"]["last"].cast("string"))))
        part = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, ", ")))
        absent_ = F.concat_ws("; ", part("stale_data: ", old), part("missing_data: ", missing))
        first = F.get(x["flows"], F.lit(0))["x"]["w"]
        alike = F.forall(x["flows"], lambda f: F.coalesce((f["x"]["w"]["start"] == first["start"]) & (f["x"]["w"]["end"] == first["end"]) & (f["x"]["w"]["basis"] == first["basis"]) & f["x"]["w"]["unit"].eqNullSafe(first["unit"]), F.lit(False)))
        period = F.coalesce(F.get(F.filter(x["near"], lambda p: p["annual"]), F.lit(0)), F.get(x["near"], F.lit(0)))
        whole = F.flatten(F.transform(x["flows"], lambda f: F.transform(f["x"]["w"]["parts"], lambda p: F.struct(f["concept"].alias("concept"), p["start"].alias("start"), p["end"].alias("end"), p["sign"].alias("sign")))))
        single = F.transform(x["wanted"], lambda c: F.struct(c.alias("concept"), period["start"].alias("start"), period["end"].alias("end"), F.lit(1).alias("sign")))
        row = lambda values, s, e, basis, unit, parts, why: F.struct(values.alias("values"), s.alias("start"), e.alias("end"), basis.alias("basis"), unit.alias("unit"), parts.alias("parts"), why.alias("reason"))
        none = (F.lit(None).cast("map<string,double>"), F.lit(None).cast("date"), F.lit(None).cast("date"), _text(), _text(), F.lit(None).cast("array<struct<concept:string,start:date,end:date,sign:int>>"))
        windows = row(F.map_from_arrays(x["wanted"], F.transform(x["flows"], lambda f: f["x"]["w"]["value"])), first["start"], first["end"], first["basis"], first["unit"], whole, _text())
        years = row(period["values"], period["start"], period["end"], F.when(period["annual"], "annual_fallback").otherwise("period"), period["unit"], single, _text())
        return F.when(F.exists(x["flows"], gone), row(*none, absent_)).when(alike, windows).when(period.isNotNull(), years).otherwise(row(*none, _text("period_mismatch")))

    kind = "array<struct<end:date,start:date,unit:string,annual:boolean,values:map<string,double>>>"
    listed = F.array(*[F.struct(F.lit(r).alias("recipe"), F.array(*map(F.lit, w)).alias("wanted")) for r, w in recipes.items()])
    return F.map_from_entries(F.transform(listed, lambda r: F.struct(r["recipe"], one(r))))


def _two_period(windows: DataFrame, stocks: DataFrame, measures: set[str]) -> DataFrame:
    """(issuer, at, two): map of each two-period measure to (flow, stock, w, first, last)."""
    pairs = {m: p for m, p in TWO_PERIOD.items() if m in measures}
    of = F.create_map(*[x for f in sorted({f for f, _ in pairs.values()}) for x in (F.lit(f), F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(s).alias("stock")) for m, (g, s) in pairs.items() if g == f]))])
    rows = windows.where("w is not null").select("issuer", "at", F.col("concept").alias("flow"), "w", F.explode(F.try_element_at(of, F.col("concept"))).alias("m"))
    rows = rows.select("issuer", "at", "m.measure", F.col("m.stock").alias("concept"), "flow", "w", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    found = borders.at_borders(rows, stocks.where(F.col("concept").isin([s for _, s in pairs.values()])))
    entry = F.struct("measure", F.struct("flow", F.col("concept").alias("stock"), "w", "first", "last").alias("x"))
    return found.groupBy("issuer", "at").agg(F.map_from_entries(F.collect_list(entry)).alias("two"))


def _level(rows: DataFrame, name: str, made: dict[str, tuple[Column, ...]]) -> DataFrame:
    """rows with a map *name* of measures, (value, reason): each of *made* is a measure and reasons that come before its own."""
    entries = [F.struct(F.lit(n).alias("name"), x.alias("made"), F.coalesce(*why, _text()).alias("why"), F.lit(n in NOT_FOR_BANKS).alias("no_bank")) for n, (x, *why) in made.items()]

    def checked(e: Column) -> Column:
        own = F.coalesce(e["why"], e["made"]["reason"])
        why = F.when(own.isNotNull() & e["no_bank"] & F.col("bank"), F.lit("not_applicable: banks")).otherwise(own)
        return F.struct(e["name"], F.struct(F.when(own.isNull(), e["made"]["value"]).alias("value"), why.alias("reason")))

    return rows.withColumn(name, F.map_from_entries(F.transform(F.array(*entries), checked)) if made else F.lit(None).cast("map<string,struct<value:double,reason:string>>"))


def inputs(flows: DataFrame, stocks: DataFrame, instruments: DataFrame, price_rows: DataFrame, actions: DataFrame, targets: DataFrame, zeros: DataFrame | None = None, measures: Iterable[str] = MEASURES) -> DataFrame:
    """One row for each issuer and date with all that the measures read; see snapshot()."""
    wanted = needed(measures)
    stocks = _with(stocks, basis=F.lit("as_reported"), rank=F.lit(0), filed=F.lit(None).cast("date"))
    own, all_stocks = stocks.where((F.col("basis") == "as_reported") & F.col("concept").isin(*STOCKS)), stocks.where(F.col("concept").isin(*STOCKS) & F.col("value").isNotNull())
    # flows are read by four of the steps, and may themselves be sums over far larger tables
    f = saved(flows.where(F.col("concept").isin(*FLOWS) & F.col("value").isNotNull()).select("issuer", "concept", "start", "end", F.col("value").cast("double").alias("value"), "unit"), "flows")
    f = f.unionByName(saved(operating_income(f, instruments), "income"))
    t = targets.select("issuer", "at").distinct().join(_with(instruments, home=_text()).select("issuer", "id", "bank", "ifrs", "ads_ratio", "home"), "issuer")
    # tables are written on the way, as several of the steps that follow read them
    t = saved(t.join(borders.anchors(t, f.select("issuer", "end").union(own.select("issuer", "end"))), ["issuer", "at"], "left"), "targets")
    w = saved(borders.trailing_years(f, t), "windows")
    flow = w.groupBy("issuer", "at").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("w", "last").alias("x")))).alias("flow"), F.max(F.when(F.col("concept") == "dps", F.struct("w", "declared"))).alias("dps_window"))
    recipes = {r: c for r, c in RECIPES.items() if r.split()[0] in wanted}
    common = borders.common_periods(f, recipes, t)
    b = t.join(flow, ["issuer", "at"], "left").join(common, ["issuer", "at"], "left").join(borders.newest(t, own), ["issuer", "at"], "left")
    if wanted & {*TWO_PERIOD}:
        b = b.join(_two_period(w, all_stocks, wanted), ["issuer", "at"], "left")
    b = saved(b.join(_price(t, price_rows), ["issuer", "at"], "left"), "inputs")
    # large expressions stand in plans without an exchange: an adaptive plan is made anew after each one
    b = saved(b.withColumns({"bank": F.coalesce("bank", F.lit(False)), "ifrs": F.coalesce("ifrs", F.lit(False)), "one": _inputs(recipes)}), "periods")
    b = _priced(b, actions)
    if "roic" in wanted:
        edge = b.select("issuer", _get("one", "nopat")["start"].alias("border")).where("border is not null")
        found = capital.at_border(edge, all_stocks.where(F.col("concept").isin(*BALANCES["invested_capital"])).select("issuer", "concept", "end", "value", "rank", "basis", "unit"))
        begin = found.groupBy("issuer", "border").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("value", "end", "basis").alias("x")))).alias("begin"))
        b = b.withColumn("border", _get("one", "nopat")["start"]).join(begin, ["issuer", "border"], "left")
    none = instruments.select("issuer", _text().alias("st_zero"), _text().alias("nci_zero"))
    return saved(b.join(none if zeros is None else zeros, "issuer", "left"), "inputs")


def _price(t: DataFrame, price_rows: DataFrame) -> DataFrame:
    """(issuer, at, price_day, price_age, close, price_unit): the newest price up to each date."""
    p = picks.as_of(t.select("issuer", "id", "at"), price_rows, "id", "at", "date", ["close", "currency"])
    return p.select("issuer", "at", F.col("as_of").alias("price_day"), F.col("age_days").alias("price_age"), "close", F.col("currency").alias("price_unit"))


def _priced(b: DataFrame, actions: DataFrame) -> DataFrame:
    """b with the price in today's shares or its refusal, the share count and the dividends of a year."""
    split = actions.where("kind = 'split' and amount > 0").groupBy("id", "date").agg(F.min("amount").cast("double").alias("factor"))
    split = split.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("date", "factor"))).alias("splits"))
    asked, own, out = b.select("id", "at", F.col("price_unit").alias("currency")), _get("now", "dps_ttm"), b.join(split, "id", "left")
    late = F.col("close").isNull() | (F.col("price_age") > PRICE_DAYS)
    why = F.when(F.col("price_day").isNull(), "missing_data: price_close").when(late, F.concat(F.lit("missing_data: price_close_stale:"), F.col("price_day").cast("string")))
    out = out.withColumn("no_price", why).withColumn("splits", F.filter(F.coalesce("splits", F.array().cast("array<struct<date:date,factor:double>>")), lambda e: e["date"] <= F.col("at")))
    after = F.aggregate(F.filter("splits", lambda e: e["date"] > F.col("price_day")), F.lit(1.0), lambda a, e: a * e["factor"])
    out = out.withColumn("price", F.when(F.col("no_price").isNull(), F.col("close") * after))
    out = out.withColumn("count", shares(_get("now", "shares_outstanding"), _get("now", "shares_diluted"), F.col("splits"), F.col("ads_ratio"), F.col("ifrs"), F.col("at")))
    end = lambda x: x["end"]
    edge, said = F.col("dps_window")["w"], F.col("dps_window")["declared"]
    window = F.when(said.isNotNull() & (edge.isNull() | (end(said) > end(edge))), F.struct(said["value"].alias("value"), end(said).alias("end"), said["unit"].alias("unit"))).otherwise(F.struct(edge["value"].alias("value"), end(edge).alias("end"), edge["unit"].alias("unit")))
    filed = b.select("id", "at", own["value"].alias("value"), end(own).alias("end"), own["unit"].alias("currency")).where("value is not null")
    windows = b.select("id", "at", window.alias("x")).select("id", "at", "x.value", "x.end", F.col("x.unit").alias("currency")).where("value is not null")
    paid = prices.dividends_per_share(asked, filed, actions, windows, stale=DIVIDEND_DAYS)
    return out.join(paid.select("id", "at", F.struct("dps", "end", "currency", "source", "reason").alias("paid")), ["id", "at"], "left")


def evaluated(b: DataFrame, measures: Iterable[str] = MEASURES) -> DataFrame:
    """inputs() with maps m0 to m3 of the measures by level, (value, reason)."""
    wanted = needed(measures)
    of = lambda m: _get("one", m)
    val = lambda m, c: of(m)["values"][c]
    why = lambda m: of(m)["reason"]
    now = lambda c: _get("now", c)
    zero = lambda x, z: F.coalesce(x, F.when(F.col(z).isNotNull(), 0.0))
    level_of = {m: f"m{i}" for i, level in enumerate(LEVELS) for m in level}
    fed = lambda m: _get(level_of[m], m)
    up = lambda m: _or_missing(m, fed(m))
    b = b.withColumns({"st": zero(now("st_investments")["value"], "st_zero"), "minority": zero(now("minority_interest")["value"], "nci_zero")})
    b = b.withColumns({"equity": now("total_equity")["value"], "debt": now("total_debt")["value"], "cash": now("cash")["value"]})
    st, minority, equity, debt, cash, stale, unit, no_price = (F.col(c) for c in ("st", "minority", "equity", "debt", "cash", "stale", "price_unit", "no_price"))
    stale = F.coalesce(stale, F.map_from_entries(F.array().cast("array<struct<a:string,b:date>>")))
    clash = lambda names, *more: currencies_clash(*[now(n)["unit"] for n in names], *more)
    owed = {"total_debt": debt, "cash": cash, "st_investments": st}
    held = {**owed, "total_equity": equity, "minority_interest": minority}
    plain = lambda x: R.result(x, _text())
    filed = lambda m: why(f"{m} filed").isNull()
    built = why("ebitda").isNotNull() & why("ebitda built").isNull()

    def ratio(m: str, a: str, c: str) -> tuple[Column, Column]:
        return R.ratio(**{a: val(m, a), c: val(m, c)}), why(m)

    def two(m: str) -> tuple[Column, ...]:
        flow, stock = TWO_PERIOD[m]
        x, f = _get("two", m), _get("flow", flow)
        gone = lambda c, there: F.when(~F.coalesce(there, F.lit(False)), F.coalesce(F.concat(F.lit("stale_data: "), F.lit(f"{c}: last "), F.coalesce(F.try_element_at(stale, F.lit(c)), f["last"] if c == flow else F.lit(None).cast("date")).cast("string")), F.lit(f"missing_data: {c}")))
        there = {flow: f.isNotNull() & f["last"].isNull(), stock: now(stock).isNotNull()}
        none = F.filter(F.array(*[F.when(~F.coalesce(there[c], F.lit(False)) & gone(c, there[c]).startswith("missing"), F.lit(c)) for c in (flow, stock)]), lambda c: c.isNotNull())
        old = F.concat_ws(", ", *[F.when(gone(c, there[c]).startswith("stale"), F.replace(gone(c, there[c]), F.lit("stale_data: "), F.lit(""))) for c in (flow, stock)])
        absent_ = F.nullif(F.concat_ws("; ", F.when(old != "", F.concat(F.lit("stale_data: "), old)), F.when(F.size(none) > 0, F.concat(F.lit("missing_data: "), F.array_join(none, ", ")))), F.lit(""))
        apart = F.when(x.isNull() | x["first"].isNull() | x["last"].isNull(), F.lit("period_mismatch"))
        nothing = F.lit(None).cast("double")
        return mean_ratio(x["w"]["value"], x["first"]["value"], x["last"]["value"], **{flow: nothing, stock: nothing}), absent_, apart

    def valued(m: str, c: str, alias: str) -> tuple[Column, ...]:
        return R.ratio(market_cap_total=fed("market_cap_total")["value"], **{alias: val(m, c)}), no_price, up("market_cap_total"), F.when(why(m).isNotNull(), F.lit(f"missing_data: {alias}")), currencies_clash(unit, of(m)["unit"])

    first = F.coalesce(_get("begin", "total_equity")["value"] if "roic" in wanted else F.lit(None)).cast("double") if "roic" in wanted else None
    if first is not None:
        at = lambda c: _get("begin", c)["value"]
        first = at("total_equity") + zero(at("minority_interest"), "nci_zero") + at("total_debt") - at("cash") - zero(at("st_investments"), "st_zero")
    paid = F.col("paid")
    make = {
        "gross_profit": lambda: (plain(F.when(filed("gross_profit"), val("gross_profit filed", "gross_profit")).otherwise(val("gross_profit", "revenue") - val("gross_profit", "cogs"))), F.when(~filed("gross_profit"), why("gross_profit"))),
        "operating_margin": lambda: ratio("operating_margin", "operating_income", "revenue"),
        "net_margin": lambda: ratio("net_margin", "net_income", "revenue"),
        "effective_tax": lambda: (R.effective_tax(val("effective_tax", "tax_expense"), val("effective_tax", "pretax_income")), why("effective_tax")),
        "ebitda": lambda: (
            ebitda(val("ebitda", "operating_income"), val("ebitda built", "revenue"), val("ebitda built", "cogs"), val("ebitda built", "opex"), F.coalesce(val("ebitda", "d_and_a"), val("ebitda built", "d_and_a"))),
            F.when(~built, why("ebitda")),
        ),
        "fcf": lambda: (R.total({"capex": -1}, capex=val("fcf", "capex"), ocf=val("fcf", "ocf")), why("fcf")),
        "interest_coverage": lambda: ratio("interest_coverage", "operating_income", "interest_expense"),
        **{m: (lambda m=m: two(m)) for m in TWO_PERIOD},
        "net_debt": lambda: (plain(debt - cash - st), absent(stale, **owed), clash(owed)),
        "invested_capital": lambda: (plain(equity + minority + debt - cash - st), absent(stale, **held), clash(held)),
        "market_cap": lambda: (plain(F.col("price") * F.col("count.value")), no_price, F.col("count.reason"), currencies_clash(now("shares_outstanding")["unit"], unit)),
        "div_yield": lambda: (R.ratio(dps_ttm=paid["dps"], price_close=F.col("price")), no_price, F.coalesce(paid["reason"], F.when(paid.isNull(), F.lit("missing_data: dps_ttm"))), currencies_clash(paid["currency"], unit)),
        "price_adj": lambda: (measure("price_adj"),),
        "hhi": lambda: (measure("hhi"),),
        "gross_margin": lambda: (
            R.ratio(gross_profit=fed("gross_profit")["value"], revenue=F.when(filed("gross_margin"), val("gross_margin filed", "revenue")).otherwise(val("gross_margin", "revenue"))), up("gross_profit"),
            F.when(filed("gross_profit") & ~filed("gross_margin"), why("gross_margin filed")),
        ),
        "nopat": lambda: (plain(val("nopat", "operating_income") * (1 - R.effective_tax(val("nopat", "tax_expense"), val("nopat", "pretax_income"))["value"])), F.when(why("operating_margin").contains("operating_income"), F.lit("missing_data: operating_income")), up("effective_tax"), why("nopat")),
        "net_debt_ebitda": lambda: (R.ratio(net_debt=fed("net_debt")["value"], ebitda=fed("ebitda")["value"]), up("net_debt"), up("ebitda")),
        "market_cap_total": lambda: (market_cap_total(F.array(fed("market_cap")["value"])), fed("market_cap")["reason"]),
        "fcf_yield": lambda: (R.ratio(fcf=fed("fcf")["value"], market_cap=fed("market_cap")["value"]), no_price, up("market_cap"), up("fcf"), currencies_clash(of("fcf")["unit"], unit)),
        "ev": lambda: (enterprise_value(fed("market_cap_total")["value"], debt, cash, st, minority, now("preferred_equity")["value"], F.lit(False)), no_price, up("market_cap_total"), absent(stale, **owed, minority_interest=minority), clash([*owed, "minority_interest", "preferred_equity"], unit)),
        "pb": lambda: (R.ratio(market_cap_total=fed("market_cap_total")["value"], total_equity=equity), no_price, up("market_cap_total"), absent(stale, total_equity=equity), clash(["total_equity"], unit)),
        "pe": lambda: valued("pe", "net_income", "net_income_ttm"),
        "ps": lambda: valued("ps", "revenue", "revenue_ttm"),
        "roic": lambda: (R.ratio(nopat=fed("nopat")["value"], mean_capital=(first + fed("invested_capital")["value"]) / 2), no_price, up("invested_capital"), up("nopat"), F.when(first.isNull(), F.lit("missing_prior_period"))),
        "ev_ebitda": lambda: (R.ratio(ev=fed("ev")["value"], ebitda=fed("ebitda")["value"]), no_price, up("ev"), up("ebitda")),
    }
    for i, level in enumerate(LEVELS):
        b = _level(b, f"m{i}", {m: make[m]() for m in level if m in wanted})
    return b


def _spans(m: str) -> Column | None:
    """The inputs whose window is a measure's period."""
    m = SPAN_OF.get(m, m)
    if m in TWO_PERIOD:
        return _get("two", m)["w"]
    if f"{m} filed" in RECIPES:
        return F.when(_get("one", f"{m} filed")["reason"].isNull(), _get("one", f"{m} filed")).otherwise(_get("one", m))
    if m == "ebitda":
        return F.when(_get("one", m)["reason"].isNull(), _get("one", m)).otherwise(_get("one", "ebitda built"))
    return _get("one", m) if m in RECIPES else None


def rows_of(b: DataFrame, measures: Iterable[str] = MEASURES) -> DataFrame:
    """(issuer, at, concept, value, unit, period_start, period_end, basis, null_reason) of evaluated()."""
    level_of = {m: f"m{i}" for i, level in enumerate(LEVELS) for m in level}

    def row(n: str) -> Column:
        x, span = _get(level_of[n], n), _spans(n)
        there = x["value"].isNotNull()
        cells = (F.col("at"), F.col("at"), _text()) if span is None else tuple(F.when(there, span[c]).otherwise(other) for c, other in (("start", F.col("at")), ("end", F.col("at")), ("basis", _text())))
        money = {"net_debt": _get("now", "total_debt")["unit"], "invested_capital": _get("now", "total_equity")["unit"]}.get(n, F.col("price_unit") if n in ("ev", "market_cap", "market_cap_total") else None if span is None else span["unit"])
        unit = F.coalesce(money, F.lit("")) if n in MONEY else F.lit("ratio")
        return F.struct(F.lit(n).alias("concept"), x["value"].alias("value"), unit.alias("unit"), cells[0].alias("period_start"), cells[1].alias("period_end"), cells[2].alias("basis"), x["reason"].alias("null_reason"))

    return b.select("issuer", "at", F.explode(F.array(*[row(n) for n in MEASURES if n in set(measures)])).alias("r")).select("issuer", "at", "r.*")


def snapshots(flows: DataFrame, stocks: DataFrame, instruments: DataFrame, price_rows: DataFrame, actions: DataFrame, targets: DataFrame, zeros: DataFrame | None = None, measures: Iterable[str] = MEASURES) -> DataFrame:
    """(issuer, at, concept, value, unit, period_start, period_end, basis, null_reason): measures of each issuer at each of its dates.

    flows (issuer, concept, start, end, value, unit) and stocks (issuer, concept, end, value, unit, and where known basis, rank, filed) hold
    canonical concepts; a restated balance counts only at the border of a window. instruments (issuer, id, bank, ifrs, ads_ratio, and
    where known home, the issuer's currency), one each; price_rows (id, date, close, currency); actions (id, date, kind, amount,
    currency); targets (issuer, at); zeros is evidence() of functions.concepts. Only what the named measures read is worked out.
    """
    measures = tuple(measures)
    return rows_of(evaluated(inputs(flows, stocks, instruments, price_rows, actions, targets, zeros, measures), measures), measures)


def snapshot(flows: DataFrame, stocks: DataFrame, instruments: DataFrame, price_rows: DataFrame, actions: DataFrame, as_of: str, zeros: DataFrame | None = None, measures: Iterable[str] = MEASURES) -> DataFrame:
    """snapshots() of all issuers at one date."""
    targets = instruments.select("issuer", F.lit(as_of).cast("date").alias("at"))
    return snapshots(flows, stocks, instruments, price_rows, actions, targets, zeros, measures).drop("at")


def lineage(b: DataFrame, measures: Iterable[str] = MEASURES) -> DataFrame:
    """(issuer, at, concept, kind, source, role, period_start, period_end, sign, basis): what each value of evaluated() is made of.

    kind fact: a filed fact, *source* its concept, with its period and, in a window, its sign; a balance's period is its date. kind price:
    the close of a day. kind measure: another measure. A measure has the facts of those that feed it too, with their role.
    """
    measures = [m for m in MEASURES if m in set(measures)]
    level_of = {m: f"m{i}" for i, level in enumerate(LEVELS) for m in level}
    kind = "array<struct<kind:string,source:string,role:string,period_start:date,period_end:date,sign:int,basis:string>>"
    row = lambda k, source, role, s, e, sign, basis: F.struct(F.lit(k).alias("kind"), source.alias("source"), F.lit(role).alias("role"), s.alias("period_start"), e.alias("period_end"), sign.alias("sign"), basis.alias("basis"))
    none_day = F.lit(None).cast("date")

    def facts(x: Column) -> Column:
        return F.transform(x["parts"], lambda p: row("fact", p["concept"], "input", p["start"], p["end"], p["sign"], x["basis"]))

    def balance(source: str, x: Column, role: str) -> Column:
        return F.when(x.isNotNull(), F.array(row("fact", F.lit(source), role, x["day"], x["day"], F.lit(1), x["basis"])))

    def own(m: str) -> list[Column]:
        out = []
        if m in TWO_PERIOD:
            flow, stock = TWO_PERIOD[m]
            x = _get("two", m)
            out += [F.transform(x["w"]["parts"], lambda p: row("fact", F.lit(flow), "input", p["start"], p["end"], p["sign"], x["w"]["basis"])), balance(stock, x["first"], "begin"), balance(stock, x["last"], "end")]
        elif (span := _spans(m) if m not in SPAN_OF else None) is not None:
            out.append(facts(span))
        for c in BALANCES.get(m, ()):
            x = _get("now", c)
            # of both counts of shares the one that was taken
            used = F.lit(True) if m != "market_cap" else x["value"].isNotNull()
            out.append(F.when(x.isNotNull() & used, F.array(row("fact", F.lit(c), "input", x["end"], x["end"], F.lit(1), _text("as_reported")))))
        if m in ("market_cap", "div_yield"):
            out.append(F.array(row("price", F.lit("price_close"), "input", F.col("price_day"), F.col("price_day"), F.lit(1), _text())))
        if m == "div_yield":
            out.append(F.array(row("dividend", F.col("paid.source"), "input", none_day, F.col("paid.end"), F.lit(1), _text("ttm"))))
        if m == "roic":
            for c in BALANCES["invested_capital"]:
                x = _get("begin", c)
                out.append(F.when(x.isNotNull(), F.array(row("fact", F.lit(c), "begin", x["end"], x["end"], F.lit(1), x["basis"]))))
        return out

    def all_of(m: str) -> Column:
        parts = [F.coalesce(x.cast(kind), F.array().cast(kind)) for f in sorted(needed([m])) for x in own(f)]
        feeds = [F.array(row("measure", F.lit(f), "feeds", none_day, F.col("at"), F.lit(1), _text())).cast(kind) for f in sorted(needed([m]) - {m})]
        return F.array_distinct(F.concat(*parts, *feeds)) if parts or feeds else F.array().cast(kind)

    made = [F.struct(F.lit(m).alias("concept"), F.when(_get(level_of[m], m)["value"].isNotNull(), all_of(m)).alias("x")) for m in measures]
    one = b.select("issuer", "at", F.explode(F.array(*made)).alias("m")).select("issuer", "at", "m.concept", F.explode("m.x").alias("x"))
    return one.select("issuer", "at", "concept", "x.*")


def unexplained(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Values without a line of lineage: there must be none."""
    return rows.where("value is not null").join(lines.select("issuer", "at", "concept").distinct(), ["issuer", "at", "concept"], "left_anti")


def percentiles(rows: DataFrame, peers: DataFrame, least: int = groups.PERCENTILE_FROM) -> DataFrame:
    """(issuer, at, concept, peer_group, n, percentile, reason): where each value of snapshots() stands among its peers at the date.

    peers (issuer, peer_group). The share of the other values strictly below, as a fraction; too few others are peer_set_too_small; a
    measure without value keeps its reason.
    """
    # written once, as it is read for the ranks, for their members and for the rows that have none
    r = saved(rows.join(peers.select("issuer", "peer_group"), "issuer").withColumn("_g", F.struct("peer_group", "at", "concept")), "ranked")
    p = groups.percentile_below(r.select("_g", "issuer", "value"), "_g", "issuer", least=0)
    p = p.select(F.col("_g.at").alias("at"), F.col("_g.concept").alias("concept"), "issuer", "n", "percentile")
    out = r.join(p, ["issuer", "at", "concept"], "left")
    why = F.coalesce("null_reason", F.when(F.coalesce("n", F.lit(0)) < least, F.lit("peer_set_too_small")))
    return out.select("issuer", "at", "concept", "peer_group", F.coalesce("n", F.lit(0)).alias("n"), F.when(why.isNull(), F.col("percentile")).alias("percentile"), why.alias("reason"))
