"""Measures by name: arithmetic of one period and valuation.

An input is a struct (value double, unit string, end date); a measure is a struct (value, reason) with exactly one side set.
In a valuation row a missing or stale input is named first, then a conflict of currencies, then what arithmetic refuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import reasons as R

from . import prices

#: Days after which a price, a share count or a filed dividend is too old; a dual listing's gap in shares and days.
PRICE_DAYS, SHARE_DAYS, DIVIDEND_DAYS, DUAL_GAP, DUAL_DAYS = 7, 550, 550, 1.2, 120
#: Measures that banks do not have.
NOT_FOR_BANKS = (
    "ebitda", "ev", "ev_ebitda", "fcf", "fcf_yield", "gross_profit", "gross_margin", "net_debt", "net_debt_ebitda", "interest_coverage", "capex", "capex_to_revenue", "roic",
    "invested_capital",
)


def _none() -> Column:
    return F.lit(None).cast("double")


def _v(x: Column) -> Column:
    return x["value"]


def _or_missing(name: str, m: dict[str, Column]) -> Column:
    """Reason of a measure that feeds another one: a currency conflict or staleness goes on, all else is a missing input."""
    return F.when(m["reason"].rlike("^(currency_mismatch|stale_data)"), m["reason"]).when(m["reason"].isNotNull(), F.lit(f"missing_data: {name}"))


def gross_profit(gross_profit: Column, revenue: Column, cogs: Column) -> Column:
    """The filed value, else revenue less its costs."""
    return F.when(gross_profit.isNotNull(), R.result(gross_profit, F.lit(None).cast("string"))).otherwise(R.total({"cogs": -1}, revenue=revenue, cogs=cogs))


def ebitda(operating_income: Column, revenue: Column, cogs: Column, opex: Column, d_and_a: Column) -> Column:
    """Operating income and depreciation; without the former revenue less costs; what is missing is named."""
    own = R.total({}, d_and_a=d_and_a, operating_income=operating_income)
    built = R.total({"cogs": -1, "opex": -1}, cogs=cogs, d_and_a=d_and_a, opex=opex, revenue=revenue)
    return F.when(operating_income.isNotNull(), own).when(R.missing(cogs=cogs, opex=opex, revenue=revenue).isNull(), built).otherwise(own)


def operating_income(filed: Column, pretax: Column, interest_expense: Column, interest_income: Column, bank: Column) -> Column:
    """The filed value, else pretax income with interest put back; never for banks."""
    derived = R.total({"income": -1}, expense=interest_expense, income=F.coalesce(interest_income, F.lit(0.0)), pretax=pretax)
    return F.when(filed.isNotNull(), filed).when(~F.coalesce(bank, F.lit(False)), derived["value"])


def mean_ratio(flow: Column, begin: Column, end: Column, **names: Column) -> Column:
    """A flow over the mean of the stocks at both ends of its window; no stock at the start is missing_prior_period."""
    (name, _), (stock, _) = names.items()
    r = R.ratio(**{name: flow, f"mean_{stock}": (begin + end) / 2})
    why = F.coalesce(R.missing(**{name: flow, stock: end}), F.when(begin.isNull(), F.lit("missing_prior_period")), r["reason"])
    return R.result(r["value"], why)


def market_cap_total(caps: Column) -> Column:
    """Sum over the classes of shares (an array); a part is no total."""
    bad = F.exists(caps, lambda c: c.isNull()) | (F.size(caps) <= 0)
    return R.result(F.aggregate(caps, F.lit(0.0), lambda a, c: a + c), F.when(F.coalesce(bad, F.lit(True)), F.lit("missing_data: class_caps")))


def enterprise_value(cap: Column, debt: Column, cash: Column, st: Column, minority: Column, preferred: Column, separate: Column) -> Column:
    """Preferred shares count unless they are a class of their own, and so in the market value."""
    extra = F.when(F.coalesce(separate, F.lit(False)), 0.0).otherwise(F.coalesce(preferred, F.lit(0.0)))
    return R.total({"cash": -1, "st_investments": -1}, cash=cash, market_cap_total=cap, minority_interest=minority, preferred=extra, st_investments=st, total_debt=debt)


#: Formulas by name: their inputs, and a builder of the measure.
FORMULAS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "gross_margin": (("gross_profit", "revenue"), lambda **x: R.ratio(**x)),
    "operating_margin": (("operating_income", "revenue"), lambda **x: R.ratio(**x)),
    "net_margin": (("net_income", "revenue"), lambda **x: R.ratio(**x)),
    "effective_tax": (("tax_expense", "pretax_income"), lambda tax_expense, pretax_income: R.effective_tax(tax_expense, pretax_income)),
    "gross_profit": (("gross_profit", "revenue", "cogs"), gross_profit),
    "ebitda": (("operating_income", "revenue", "cogs", "opex", "d_and_a"), ebitda),
    "fcf": (("ocf", "capex"), lambda **x: R.total({"capex": -1}, **x)),
    "interest_coverage": (("operating_income", "interest_expense"), lambda **x: R.ratio(**x)),
    "market_cap": (("price_close", "shares_outstanding"), lambda **x: R.result(x["price_close"] * x["shares_outstanding"], R.missing(**x))),
    "pe": (("market_cap_total", "net_income_ttm"), lambda **x: R.ratio(**x)),
    "pb": (("market_cap_total", "total_equity"), lambda **x: R.ratio(**x)),
    "ps": (("market_cap_total", "revenue_ttm"), lambda **x: R.ratio(**x)),
    "ev_ebitda": (("ev", "ebitda_ttm"), lambda **x: R.ratio(**x)),
    "div_yield": (("dps_ttm", "price_close"), lambda **x: R.ratio(**x)),
    "net_debt": (("total_debt", "cash", "st_investments"), lambda **x: R.total({"cash": -1, "st_investments": -1}, **x)),
    "net_debt_ebitda": (("net_debt", "ebitda"), lambda **x: R.ratio(**x)),
    "invested_capital": (("total_equity", "minority_interest", "total_debt", "cash", "st_investments"), lambda **x: R.total({"cash": -1, "st_investments": -1}, **x)),
}


def measure(name: str, **inputs: Column) -> Column:
    """The named formula over its inputs; inputs that are not given are missing, a name that is unknown is not mapped."""
    if name not in FORMULAS:
        return R.result(_none(), F.lit("concept_not_mapped"))
    wanted, build = FORMULAS[name]
    return build(**{n: inputs.get(n, _none()) for n in wanted})


def by_name(rows: DataFrame, name: str = "concept", inputs: str = "inputs") -> DataFrame:
    """rows with measure: each row's *name* applied to its map of *inputs* (string to double)."""
    pick = F.when(F.lit(False), measure(""))
    for n, (wanted, _) in FORMULAS.items():
        pick = pick.when(F.col(name) == n, measure(n, **{i: F.try_element_at(F.col(inputs), F.lit(i)) for i in wanted}))
    return rows.withColumn("measure", pick.otherwise(measure("")))


def not_applicable(bank: Column, concept: Column, value: Column, reason: Column) -> Column:
    """The reason of a row: a missing value that banks do not have says so."""
    return F.when(bank & value.isNull() & concept.isin(*NOT_FOR_BANKS), "not_applicable: banks").otherwise(reason)


def implausible(concept: Column, value: Column, equity: Column, ebitda: Column) -> Column:
    """Why a number is not to be shown as one, else null. 500 %, 500 times, the whole of revenue."""
    own = concept.isin("roe", "roe_incl_nci", "pb")
    return (
        F.when(own & (equity <= 0), "negative_equity").when(concept.isin("roe", "roe_incl_nci") & (F.abs(value) > 5), "equity_near_zero").when((concept == "pe") & (value <= 0), "loss")
        .when(concept.isin("pe", "ev_ebitda") & (value > 500), "denominator_near_zero").when(concept.isin("gross_margin", "operating_margin", "net_margin") & (F.abs(value) > 1), "over_revenue")
        .when((concept == "pb") & (value <= 0), "negative_equity").when((concept == "ev_ebitda") & (value <= 0), "negative_ebitda").when((concept == "net_debt_ebitda") & (ebitda <= 0), "negative_ebitda")
    )


def currencies_clash(*units: Column) -> Column:
    """'currency_mismatch: A, B' if the known currencies differ, else null; blanks take no part."""
    known = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.nullif(u, F.lit("")) for u in units]))))
    return F.when(F.size(known) > 1, F.concat(F.lit("currency_mismatch: "), F.array_join(known, ", ")))


def absent(stale: Column, **inputs: Column) -> Column:
    """Names of null inputs: those that *stale* (map of name to last end) knows with their last period, the others as missing."""
    names = F.array_compact(F.array(*[F.when(inputs[n].isNull(), F.lit(n)) for n in sorted(inputs)]))
    last = lambda n: F.try_element_at(stale, n)
    old = F.transform(F.filter(names, lambda n: last(n).isNotNull()), lambda n: F.concat(n, F.lit(": last "), last(n).cast("string")))
    new = F.filter(names, lambda n: last(n).isNull())
    part = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, ", ")))
    return F.nullif(F.concat_ws("; ", part("stale_data: ", old), part("missing_data: ", new)), F.lit(""))


def shares(outstanding: Column, diluted: Column, splits: Column, ads: Column, ifrs: Column, as_of: Column) -> Column:
    """(value, reason): the share count that goes with the price of a date.

    outstanding and diluted (value, end, filed); a count that is stale or gone, or under the diluted one by a dual listing's gap, gives way
    to the diluted one. Splits (array of date, factor) between its end and its filing (as_of where that is not known) divide it, once a date; filers of ifrs are
    counted in depositary shares, and refused if their ratio is unknown.
    """
    fresh = lambda x: F.datediff(as_of, x["end"]) <= SHARE_DAYS
    gone = outstanding["value"].isNull() | ~fresh(outstanding)
    dual = (diluted["value"] > outstanding["value"] * DUAL_GAP) & (F.abs(F.datediff(diluted["end"], outstanding["end"])) <= DUAL_DAYS)
    use = F.when(diluted["value"].isNotNull() & fresh(diluted) & (gone | dual), diluted).otherwise(outstanding)
    own = F.filter(splits, lambda e: (e["date"] > use["end"]) & (e["date"] <= F.least(F.coalesce(use["filed"], as_of), as_of)))
    once = F.map_values(F.map_from_entries(F.array_distinct(F.transform(own, lambda e: F.struct(e["date"], e["factor"])))))
    factor = F.coalesce(F.aggregate(once, F.lit(1.0), lambda a, f: a * f), F.lit(1.0))
    value = use["value"] / factor / F.when(ifrs, ads).otherwise(1.0)
    why = F.when(use["value"].isNull(), "missing_data: shares_outstanding").when(~fresh(use), F.concat(F.lit("stale_input: shares_outstanding ("), use["end"].cast("string"), F.lit(")")))
    return R.result(value, F.coalesce(why, F.when(ifrs & ads.isNull(), "adr_ratio_unknown: price per ADS, shares are ordinary")))


def price_measures(price_rows: DataFrame, actions: DataFrame, as_of: str, days: int = 365, edge: int = 7, divide: prices.Divide = F.try_divide) -> DataFrame:
    """(id, total_return, drawdown, reason): over the year up to a date, dividends put back; both edges must lie within *edge* days.

    A price of 0 or less has no drawdown; *divide* says what division by such a one gives.
    """
    at = F.lit(as_of).cast("date")
    own = price_rows.where((F.col("date") <= at) & F.col("close").isNotNull())
    adj = prices.adjusted(own, actions.where("kind = 'dividend'"), divide).where(F.col("date") >= F.date_sub(at, days))
    r = prices.returns(adj, "price_adj", divide)
    ends = adj.groupBy("id").agg(F.min("date").alias("a"), F.max("date").alias("z"), F.min("price_adj").alias("low"))
    out = price_rows.select("id").distinct().join(r, "id", "left").join(ends, "id", "left")
    ok = F.coalesce((F.datediff("a", F.date_sub(at, days)) <= edge) & (F.datediff(at, "z") <= edge), F.lit(False))
    why = F.when(~ok, "missing_data: price_close").when(F.col("low") <= 0, "missing_data: nonpositive_price")
    return out.select("id", F.when(ok, F.col("total_return")).alias("total_return"), F.when(why.isNull(), F.col("drawdown")).alias("drawdown"), why.alias("reason"))
