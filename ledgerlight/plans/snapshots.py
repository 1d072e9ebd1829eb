"""One snapshot of every issuer, with all measures; valuation, evidence and formulas by name; each with its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import concepts as C
from ledgerlight.operators import capital
from ledgerlight.operators import snapshot as S
from ledgerlight.operators import valuation as V
from ledgerlight.scratch import saved

from .measures import _TTM
from .model import AS_OF, SECTORS, long_sql, periods, periods_sql, query, r6, read, sectors
from .series import _DAILY, _daily

_FLOWS = ("revenue", "cogs", "opex", "tax_expense", "net_income", "pretax_income", "ocf", "capex", "interest_expense", "d_and_a")
_ALL_FLOWS = (*_FLOWS, "operating_income")
#: Fixed inputs: balances as (concept, end, SQL of the value, SQL of the issuers that have it, has a currency, basis, filed).
_STOCKS = tuple(
    (*x, *("as_reported", None)[len(x) - 5 :]) if len(x) < 7 else x
    for x in (
        ("cash", "2001-06-30", "abs(balance) * 10", "issuer % 11 <> 0", True),
        ("cash", "2000-06-30", "abs(balance) * 9", "issuer % 11 <> 0", True),
        ("cash", "2000-09-30", "abs(balance) * 9.5", "issuer % 11 <> 0 and issuer % 2 = 1", True),
        ("cash", "1997-12-31", "abs(balance) * 8", "issuer % 11 = 0", True),
        ("total_debt", "2001-06-30", "abs(balance) * 30", "issuer % 5 <> 0", True),
        ("total_debt", "2000-10-05", "abs(balance) * 28", "issuer % 5 <> 0 and issuer % 4 <> 0", True),
        ("st_investments", "2001-06-30", "balance * 0 + 100", "issuer % 4 <> 0", True),
        ("st_investments", "2000-09-25", "balance * 0 + 90", "issuer % 4 <> 0", True),
        ("total_equity", "2001-06-30", "balance * 50", "issuer > 0", True),
        ("total_equity", "2001-09-30", "balance * 52", "issuer % 3 <> 0", True),
        ("total_equity", "2000-06-30", "balance * 45", "issuer % 7 <> 0", True),
        ("total_equity", "2000-09-30", "balance * 46", "issuer % 7 <> 0 and issuer % 2 = 1", True),
        ("total_equity", "2000-09-30", "balance * 47", "issuer % 7 = 1", True, "restated"),
        ("total_equity", "2000-10-01", "balance * 48", "issuer % 7 = 2", True, "restated"),
        ("total_equity_incl_nci", "2001-09-30", "balance * 51", "issuer % 2 = 0", True, "restated"),
        ("total_equity_incl_nci", "2001-06-30", "balance * 50.5", "issuer > 0", True),
        ("total_equity_incl_nci", "2000-06-30", "balance * 46", "issuer > 0", True),
        ("minority_interest", "2001-06-30", "balance * 2", "issuer % 3 = 0", True),
        ("minority_interest", "2000-09-30", "balance * 3", "issuer % 3 = 0", True),
        ("total_assets", "2001-09-30", "balance + 500000", "issuer % 8 <> 0", True),
        ("total_assets", "2000-06-30", "balance + 400000", "issuer % 2 = 0", True),
        ("shares_outstanding", "2001-06-30", "issuer + 1000.0", "issuer % 9 <> 0", False, "as_reported", "2001-08-01"),
        ("shares_outstanding", "1999-12-31", "issuer + 900.0", "issuer % 9 = 0", False, "as_reported", "2001-09-01"),
        ("shares_diluted", "2001-06-30", "issuer * 1.5 + 1500", "issuer % 10 = 0 or issuer % 18 = 0", False),
    )
)


def flows(spark, d):
    q = periods(spark, d)
    made = {
        "tax_expense": F.col("tax"), "pretax_income": F.expr("revenue - cogs - opex"), "net_income": F.expr("revenue - cogs - opex - tax"), "ocf": F.expr("revenue - cogs"), "capex": F.col("opex"),
        "interest_expense": F.expr("nullif(returned, 0)"), "d_and_a": F.expr("opex * 2"), "cogs": F.expr("case when issuer % 17 <> 0 then cogs end"),
    }
    values = {c: made.get(c, F.col(c)) for c in _FLOWS}
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), x.alias("value")) for c, x in values.items()]))
    rows = q.select("issuer", "start", "end", one.alias("f")).select("issuer", "f.concept", "start", "end", "f.value")
    return rows.join(sectors(spark, d).select("issuer", F.col("currency").alias("unit")), "issuer")


def stocks(spark, d):
    s, out = sectors(spark, d), None
    for concept, end, value, who, money, basis, filed in _STOCKS:
        unit = F.col("currency") if money else F.lit(None).cast("string")
        more = F.lit(basis).alias("basis"), F.lit(0).alias("rank"), F.lit(filed).cast("date").alias("filed")
        own = s.where(who).select("issuer", F.lit(concept).alias("concept"), F.lit(end).cast("date").alias("end"), F.expr(value).cast("double").alias("value"), unit.alias("unit"), *more)
        out = own if out is None else out.unionByName(own)
    return out


def instruments(spark, d):
    ads = F.expr("case when issuer % 26 = 0 then 2.0D end")
    return sectors(spark, d).select("issuer", F.col("issuer").alias("id"), (F.col("sector") == "ASIA").alias("bank"), (F.col("issuer") % 13 == 0).alias("ifrs"), ads.alias("ads_ratio"))


def actions(spark, d):
    s = sectors(spark, d).select(F.col("issuer").alias("id"))
    kinds = (("issuer % 6 = 0", "2001-08-15", "split", 2.0, None), ("issuer % 4 = 1", "2001-03-01", "dividend", 0.5, "USD"), ("issuer % 8 = 5", "2001-05-01", "dividend", 0.25, "EUR"))
    out = None
    for who, day, kind, amount, unit in kinds:
        own = s.where(who.replace("issuer", "id")).select("id", F.lit(day).cast("date").alias("date"), F.lit(kind).alias("kind"), F.lit(amount).alias("amount"), F.lit(unit).cast("string").alias("currency"))
        out = own if out is None else out.union(own)
    return out


def zeros(spark, d):
    st, nci = F.expr("case when issuer % 8 = 4 then 'st_investments_never_reported: us-gaap balance' end"), F.expr("case when issuer % 3 = 1 then 'nci_absent_in_equity_block' end")
    return sectors(spark, d).select("issuer", st.alias("st_zero"), nci.alias("nci_zero"))


def _daily_prices(spark, d, dates):
    """The close of each issuer's newest day up to each of the dates, the only ones that a snapshot reads.

    A sum of every day would be as long as lineitem; so the newest days are looked up first, and only theirs are summed.
    """
    day = F.to_date("l_shipdate")
    after = [F.when(day <= F.lit(x).cast("date"), F.lit(x)) for x in sorted(dates)]
    days = read(spark, d, "lineitem").groupBy("l_suppkey", F.coalesce(*after).alias("at")).agg(F.max(day).alias("date"))
    days = saved(days.where("at is not null").select(F.col("l_suppkey").alias("issuer"), "date"), "days")
    return _daily(spark, d, days).select(F.col("issuer").alias("id"), "date", "close", F.lit("USD").alias("currency"))


def _missing(**named: str) -> str:
    """SQL: 'missing_data: a, b' of null expressions."""
    parts = ", ".join(f"CASE WHEN {named[n]} IS NULL THEN '{n}' END" for n in sorted(named))
    return f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in named.values())} THEN 'missing_data: ' || concat_ws(', ', {parts}) END"


def _den(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 'denominator_zero' WHEN {x} < 0 THEN 'negative_denominator' END"


def _absent(*names: str) -> str:
    parts = ", ".join(f"CASE WHEN {n} IS NULL{' AND NOT old_cash' if n == 'cash' else ''} THEN '{n}' END" for n in sorted(names))
    some = f"nullif(concat_ws(', ', {parts}), '')"
    old = "CASE WHEN cash IS NULL AND old_cash THEN 'stale_data: cash: last 1997-12-31' END" if "cash" in names else "CAST(NULL AS VARCHAR)"
    return f"nullif(concat_ws('; ', {old}, 'missing_data: ' || {some}), '')"


_CLASH = "CASE WHEN currency <> 'USD' THEN 'currency_mismatch: ' || least(currency, 'USD') || ', ' || greatest(currency, 'USD') END"
_UP = "CASE WHEN {0}_r LIKE 'currency_mismatch%' OR {0}_r LIKE 'stale_data%' THEN {0}_r WHEN {0}_r IS NOT NULL THEN 'missing_data: {0}' END"
#: Inputs of one period by measure.
_RECIPES = {
    "gross_profit": ("revenue", "cogs"), "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"), "effective_tax": ("tax_expense", "pretax_income"),
    "ebitda": ("operating_income", "d_and_a"), "built": ("revenue", "cogs", "opex", "d_and_a"), "fcf": ("ocf", "capex"), "interest_coverage": ("operating_income", "interest_expense"),
    "nopat": ("operating_income", "tax_expense", "pretax_income"), "pe": ("net_income",), "ps": ("revenue",),
}


def _x(recipe: str, concept: str) -> str:
    return f"{recipe}__{concept}"


def _ratio(m: str, a: str, c: str) -> tuple[str, list[str]]:
    return f"{_x(m, a)} / nullif({_x(m, c)}, 0)", [f"{m}_why", _den(_x(m, c))]


_RATE = f"{_x('effective_tax', 'tax_expense')} / nullif({_x('effective_tax', 'pretax_income')}, 0)"
#: measure: SQL of the value, SQLs of the reasons in order. A later row reads an earlier measure as x_v and x_r.
_M = {
    "gross_profit": (f"{_x('gross_profit', 'revenue')} - {_x('gross_profit', 'cogs')}", ["gross_profit_why"]),
    "gross_margin": (f"gross_profit_v / nullif({_x('gross_profit', 'revenue')}, 0)", [_UP.format("gross_profit"), _den(_x("gross_profit", "revenue"))]),
    "operating_margin": _ratio("operating_margin", "operating_income", "revenue"),
    "net_margin": _ratio("net_margin", "net_income", "revenue"),
    "effective_tax": (_RATE, ["effective_tax_why", _den(_x("effective_tax", "pretax_income")), f"CASE WHEN {_RATE} NOT BETWEEN 0 AND 0.5 THEN 'jurisdiction_rate: rate=' || printf('%.4f', {_RATE}) END"]),
    "ebitda": (
        f"CASE WHEN ebitda_why IS NULL THEN {_x('ebitda', 'operating_income')} + {_x('ebitda', 'd_and_a')} ELSE {_x('built', 'revenue')} - {_x('built', 'cogs')} - {_x('built', 'opex')} + {_x('built', 'd_and_a')} END",
        ["CASE WHEN built_why IS NOT NULL THEN ebitda_why END"],
    ),
    "fcf": (f"{_x('fcf', 'ocf')} - {_x('fcf', 'capex')}", ["fcf_why"]),
    "interest_coverage": _ratio("interest_coverage", "operating_income", "interest_expense"),
    "nopat": (
        f"{_x('nopat', 'operating_income')} * (1 - {_x('nopat', 'tax_expense')} / nullif({_x('nopat', 'pretax_income')}, 0))",
        ["CASE WHEN operating_margin_why LIKE '%operating_income%' THEN 'missing_data: operating_income' END", _UP.format("effective_tax"), "nopat_why", f"CASE WHEN {_x('nopat', 'pretax_income')} <= 0 OR {_x('nopat', 'tax_expense')} / nullif({_x('nopat', 'pretax_income')}, 0) NOT BETWEEN 0 AND 0.5 THEN 'missing_data' END"],
    ),
    "net_debt": ("total_debt - cash - st", [_absent("total_debt", "cash", "st_investments").replace("st_investments IS", "st IS")]),
    "net_debt_ebitda": ("net_debt_v / nullif(ebitda_v, 0)", [_UP.format("net_debt"), _UP.format("ebitda"), _den("ebitda_v")]),
    "invested_capital": ("total_equity + minority + total_debt - cash - st", [_absent("total_equity", "minority_interest", "total_debt", "cash", "st_investments").replace("st_investments IS", "st IS").replace("minority_interest IS", "minority IS")]),
    "market_cap": ("close * n_shares", ["no_price", "shares_r"]),
    "market_cap_total": ("market_cap_v", ["market_cap_r"]),
    "ev": ("market_cap_total_v + total_debt - cash - st + minority", ["no_price", _UP.format("market_cap_total"), _absent("minority_interest", "total_debt", "cash", "st_investments").replace("st_investments IS", "st IS").replace("minority_interest IS", "minority IS"), _CLASH]),
    "pb": ("market_cap_total_v / nullif(total_equity, 0)", ["no_price", _UP.format("market_cap_total"), _absent("total_equity"), _CLASH, _den("total_equity")]),
    "pe": (f"market_cap_total_v / nullif({_x('pe', 'net_income')}, 0)", ["no_price", _UP.format("market_cap_total"), "CASE WHEN pe_why IS NOT NULL THEN 'missing_data: net_income_ttm' END", _CLASH, _den(_x("pe", "net_income"))]),
    "ps": (f"market_cap_total_v / nullif({_x('ps', 'revenue')}, 0)", ["no_price", _UP.format("market_cap_total"), "CASE WHEN ps_why IS NOT NULL THEN 'missing_data: revenue_ttm' END", _CLASH, _den(_x("ps", "revenue"))]),
    "fcf_yield": ("fcf_v / nullif(market_cap_v, 0)", ["no_price", _UP.format("market_cap"), _UP.format("fcf"), _CLASH, _den("market_cap_v")]),
    "ev_ebitda": ("ev_v / nullif(ebitda_v, 0)", ["no_price", _UP.format("ev"), _UP.format("ebitda"), _den("ebitda_v")]),
    "div_yield": ("0.5 / close", ["no_price", "CASE WHEN NOT paid THEN 'missing_data: dps_ttm' END"]),
    "roic": ("nopat_v / nullif((first_capital + invested_capital_v) / 2, 0)", ["no_price", _UP.format("invested_capital"), _UP.format("nopat"), "CASE WHEN first_capital IS NULL THEN 'missing_prior_period' END", _den("((first_capital + invested_capital_v) / 2)")]),
    "price_adj": ("CAST(NULL AS DOUBLE)", ["'concept_not_mapped'"]),
    "hhi": ("CAST(NULL AS DOUBLE)", ["'concept_not_mapped'"]),
}
for _name, (_flow, _stock) in S.TWO_PERIOD.items():
    _mean = f"((first_{_name} + last_{_name}) / 2)"
    _M[_name] = (f"{_flow} / nullif({_mean}, 0)", [_missing(**{_stock: _stock}), f"CASE WHEN {_flow} IS NULL OR first_{_name} IS NULL OR last_{_name} IS NULL THEN 'period_mismatch' END", _den(_mean)])


def _snapshot_sql(as_of: str = AS_OF, select: str = "") -> str:
    """All measures of all issuers at a date, or another query over the same tables; {last} is the wide one."""
    text = lambda x: "NULL" if x is None else f"DATE '{x}'"
    stock = " UNION ALL ".join(f"""SELECT issuer, '{c}' AS concept, DATE '{e}' AS "end", CAST({v} AS DOUBLE) AS value, '{b}' AS basis, CAST({text(f)} AS DATE) AS filed FROM sectors WHERE {w}""" for c, e, v, w, _, b, f in _STOCKS)
    at = f"DATE '{as_of}'"
    names = sorted({x[0] for x in _STOCKS})
    newest = ", ".join(f"""arg_max(value, "end") FILTER (concept = '{c}' AND basis = 'as_reported' AND "end" <= {at} AND "end" >= top - 1100) AS {c}""" for c in names)
    wide = ", ".join(f"max(CASE concept WHEN '{c}' THEN value END) AS {c}, max(CASE concept WHEN '{c}' THEN start END) AS s_{c}, max(CASE concept WHEN '{c}' THEN \"end\" END) AS e_{c}, max(CASE concept WHEN '{c}' THEN basis END) AS b_{c}" for c in _ALL_FLOWS)
    there = ", ".join(f"""count(*) FILTER (concept = '{c}') > 0 AS has_{c}""" for c in _ALL_FLOWS)
    recipes = []
    for r, wanted in _RECIPES.items():
        gone = ", ".join(f"CASE WHEN NOT coalesce(has_{c}, false) THEN '{c}' END" for c in sorted(wanted))
        first = wanted[0]
        same = " AND ".join(f"w.{c} IS NOT NULL AND s_{c} = s_{first} AND e_{c} = e_{first} AND b_{c} = b_{first}" for c in wanted)
        values = ", ".join(f"CASE WHEN {same} THEN w.{c} ELSE l.{c} END AS {_x(r, c)}" for c in wanted)
        recipes.append(f"""l_{r} AS (SELECT * FROM q2 WHERE "end" <= {at} AND {' AND '.join(f'{c} IS NOT NULL' for c in wanted)} QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY "end" DESC) = 1),
        r_{r} AS (SELECT sectors.issuer, {values}, CASE WHEN {same} THEN s_{first} ELSE l.start END AS s_{r}, CASE WHEN {same} THEN e_{first} ELSE l."end" END AS e_{r}, CASE WHEN {same} THEN b_{first} WHEN l.issuer IS NOT NULL THEN 'period' END AS b_{r},
        CASE WHEN {' AND '.join(f'coalesce(has_{c}, false)' for c in wanted)} THEN CASE WHEN NOT coalesce({same}, false) AND l.issuer IS NULL THEN 'period_mismatch' END ELSE 'missing_data: ' || concat_ws(', ', {gone}) END AS {r}_why
        FROM sectors LEFT JOIN w USING (issuer) LEFT JOIN there USING (issuer) LEFT JOIN l_{r} l USING (issuer))""")
    two = []
    for m, (flow, st) in S.TWO_PERIOD.items():
        two.append(f"""t_{m} AS (SELECT w.issuer, arg_min(value, (- epoch("end"), basis)) FILTER ("end" <= s_{flow}) AS first_{m}, arg_min(value, basis) FILTER ("end" = e_{flow}) AS last_{m} FROM w JOIN stock ON stock.issuer = w.issuer AND concept = '{st}' GROUP BY w.issuer)""")
    near = ", ".join(f"""arg_min(value, (basis, abs("end" - s_nopat), "end")) FILTER (concept = '{c}') AS n_{c}""" for c in S.BALANCES["invested_capital"])
    steps, last = [], "i"
    for n, (value, reasons) in _M.items():
        why = f"coalesce({', '.join([*reasons, 'NULL'])})"
        steps.append(f"x_{n} AS (SELECT *, CASE WHEN {n}_r IS NULL THEN {n}_w END AS {n}_v FROM (SELECT *, {value} AS {n}_w, {why} AS {n}_r FROM {last}))")
        last = f"x_{n}"

    def row(n: str) -> str:
        span = {"gross_margin": "gross_profit", "fcf_yield": "fcf", "ev_ebitda": "ebitda", "net_debt_ebitda": "ebitda", "roic": "nopat"}.get(n, n)
        span = {"roe": "net_income", "roe_incl_nci": "net_income", "asset_turnover": "revenue"}.get(span, span if span in _RECIPES else None)
        unit = "'USD'" if n in ("ev", "market_cap", "market_cap_total") else "currency" if n in S.MONEY else "'ratio'"
        if n in ("gross_profit", "ebitda", "nopat", "fcf"):
            unit = f"CASE WHEN {'e_ebitda IS NULL AND e_built' if n == 'ebitda' else f'e_{n}'} IS NULL THEN '' ELSE currency END"
        if n in ("net_debt", "invested_capital"):
            unit = f"CASE WHEN {'total_debt' if n == 'net_debt' else 'total_equity'} IS NULL THEN '' ELSE currency END"
        if n in ("ev", "market_cap", "market_cap_total"):
            unit = "CASE WHEN close0 IS NULL THEN '' ELSE 'USD' END"
        of = lambda x: f"CASE WHEN ebitda_why IS NULL THEN {x}_ebitda ELSE {x}_built END" if span == "ebitda" else f"{x}_{span}"
        start, end = (f"CASE WHEN {n}_v IS NULL THEN {at} ELSE {of(x)} END" for x in "se") if span else (at, at)
        basis = f"CASE WHEN {n}_v IS NOT NULL THEN {of('b')} END" if span else "CAST(NULL AS VARCHAR)"
        bank = f"CASE WHEN {n}_v IS NULL AND sector = 'ASIA' THEN 'not_applicable: banks' END" if n in V.NOT_FOR_BANKS else "CAST(NULL AS VARCHAR)"
        null = "CAST(NULL AS DATE)"
        return f"""{{'concept': '{n}', 'value': CAST(round({n}_v, 6) AS DOUBLE), 'unit': CAST({unit} AS VARCHAR), 'period_start': coalesce({start}, {null}), 'period_end': coalesce({end}, {null}), 'basis': CAST({basis} AS VARCHAR), 'null_reason': CAST(coalesce({bank}, {n}_r) AS VARCHAR)}}"""

    q2 = """q2 AS (SELECT issuer, start, "end", revenue, CASE WHEN issuer % 17 <> 0 THEN cogs END AS cogs, opex, tax AS tax_expense, revenue - cogs - opex - tax AS net_income, revenue - cogs - opex AS pretax_income,
    revenue - cogs AS ocf, opex AS capex, nullif(returned, 0) AS interest_expense, opex * 2 AS d_and_a, CASE WHEN sector <> 'ASIA' THEN revenue - cogs - opex + nullif(returned, 0) END AS operating_income FROM q JOIN sectors USING (issuer))"""
    ttm = _TTM.replace(AS_OF, as_of)
    out = f"""WITH {periods_sql("q")}, {SECTORS}, {q2}, {long_sql("f", "q2", *_ALL_FLOWS)}, {ttm}, {_DAILY}, stock AS ({stock}),
    w AS (SELECT issuer, {wide} FROM ttm GROUP BY issuer), there AS (SELECT issuer, {there} FROM f WHERE value IS NOT NULL AND "end" <= {at} GROUP BY issuer),
    {", ".join(recipes)}, {", ".join(two)},
    top AS (SELECT issuer, max("end") AS top FROM (SELECT issuer, "end" FROM f WHERE value IS NOT NULL AND "end" <= {at} UNION ALL SELECT issuer, "end" FROM stock WHERE basis = 'as_reported' AND "end" <= {at}) GROUP BY issuer),
    n AS (SELECT issuer, {newest}, {", ".join(f"""max("end") FILTER (concept = '{c}' AND "end" <= {at} AND "end" >= top - 1100) AS {k}_end, arg_max(filed, "end") FILTER (concept = '{c}' AND "end" <= {at} AND "end" >= top - 1100) AS {k}_filed""" for k, c in (("so", "shares_outstanding"), ("sd", "shares_diluted")))} FROM stock JOIN top USING (issuer) GROUP BY issuer),
    nb AS (SELECT stock.issuer, {near} FROM stock JOIN r_nopat USING (issuer) WHERE abs("end" - s_nopat) <= 10 GROUP BY stock.issuer),
    px AS (SELECT issuer, arg_max(close, date) AS close0, max(date) AS day FROM daily WHERE date <= {at} GROUP BY issuer),
    g AS (SELECT sectors.*, w.* EXCLUDE (issuer), n.* EXCLUDE (issuer), px.* EXCLUDE (issuer), nb.* EXCLUDE (issuer), {", ".join(f"r_{r}.* EXCLUDE (issuer)" for r in _RECIPES)}, {", ".join(f"t_{m}.* EXCLUDE (issuer)" for m in S.TWO_PERIOD)},
      cash IS NULL AND issuer % 11 = 0 AND top - DATE '1997-12-31' > 1100 AS old_cash, coalesce(st_investments, CASE WHEN issuer % 8 = 4 THEN 0 END) AS st, coalesce(minority_interest, CASE WHEN issuer % 3 = 1 THEN 0 END) AS minority,
      CASE WHEN day IS NULL THEN 'missing_data: price_close' WHEN {at} - day > 7 THEN 'missing_data: price_close_stale:' || day END AS no_price, coalesce({at} - so_end > 550, true) AS gone
      FROM sectors LEFT JOIN w USING (issuer) LEFT JOIN n USING (issuer) LEFT JOIN top USING (issuer) LEFT JOIN px USING (issuer) LEFT JOIN nb USING (issuer) {" ".join(f"LEFT JOIN r_{r} USING (issuer)" for r in _RECIPES)} {" ".join(f"LEFT JOIN t_{m} USING (issuer)" for m in S.TWO_PERIOD)}),
    h AS (SELECT *, shares_diluted IS NOT NULL AND {at} - sd_end <= 550 AND (gone OR (shares_diluted > shares_outstanding * 1.2 AND abs(sd_end - so_end) <= 120)) AS swap FROM g),
    i AS MATERIALIZED (SELECT *, CASE WHEN no_price IS NULL THEN close0 * CASE WHEN issuer % 6 = 0 AND DATE '2001-08-15' > day AND DATE '2001-08-15' <= {at} THEN 2 ELSE 1 END END AS close,
      CASE WHEN NOT coalesce(swap, false) AND shares_outstanding IS NULL THEN 'missing_data: shares_outstanding' WHEN gone AND NOT coalesce(swap, false) THEN 'stale_input: shares_outstanding (' || so_end || ')' WHEN issuer % 13 = 0 AND issuer % 26 <> 0 THEN 'adr_ratio_unknown: price per ADS, shares are ordinary' END AS shares_r,
      CASE WHEN swap THEN shares_diluted ELSE shares_outstanding END / CASE WHEN issuer % 6 = 0 AND DATE '2001-08-15' <= CASE WHEN swap THEN {at} ELSE so_filed END AND DATE '2001-08-15' <= {at} THEN 2 ELSE 1 END / CASE WHEN issuer % 13 = 0 THEN 2 ELSE 1 END AS n_shares,
      issuer % 4 = 1 AND issuer % 8 <> 5 AND DATE '2001-03-01' <= {at} AND DATE '2001-03-01' > {at} - 365 OR issuer % 8 = 5 AND DATE '2001-03-01' <= {at} AND DATE '2001-03-01' > {at} - 365 AND NOT (DATE '2001-05-01' <= {at} AND DATE '2001-05-01' > {at} - 365) AS paid,
      n_total_equity + coalesce(n_minority_interest, CASE WHEN issuer % 3 = 1 THEN 0 END) + n_total_debt - n_cash - coalesce(n_st_investments, CASE WHEN issuer % 8 = 4 THEN 0 END) AS first_capital FROM h),
    {", ".join(steps)}
    """
    if select:
        return out + select.format(last=last)
    return out + f"""SELECT issuer, {at} AS "at", r.* FROM (SELECT issuer, unnest([{", ".join(map(row, _M))}]) AS r FROM {last})"""


_COLUMNS = "issuer, concept, value, unit, period_start, period_end, basis, null_reason"


def _all(spark, d, *measures):
    return S.snapshot(flows(spark, d), stocks(spark, d), instruments(spark, d), _daily_prices(spark, d, (AS_OF,)), actions(spark, d), AS_OF, zeros(spark, d), measures or S.MEASURES)


@query(f"SELECT {_COLUMNS} FROM ({_snapshot_sql()})")
def snapshot_measures(spark, d):
    """The whole catalogue for each issuer: windows that differ, balances at their borders, missing, stale and foreign inputs, banks, splits, depositary shares."""
    return _all(spark, d).select("issuer", "concept", r6("value").alias("value"), "unit", "period_start", "period_end", "basis", "null_reason")


_VALUATION = ("pe", "ps", "pb", "ev_ebitda", "fcf_yield")


@query(f"SELECT issuer, concept, value, null_reason FROM ({_snapshot_sql()}) WHERE concept IN {_VALUATION}")
def pe_ps_pb(spark, d):
    """Five measures; only what they read is worked out."""
    return _all(spark, d, *_VALUATION).select("issuer", "concept", r6("value").alias("value"), "null_reason")


#: Fixed inputs: two ends of quarters and a day between.
_DATES = ("2000-12-31", "2001-07-20", AS_OF)


def _inputs(spark, d, dates=_DATES, measures=S.MEASURES):
    targets = instruments(spark, d).select("issuer", F.explode(F.array(*[F.lit(x).cast("date") for x in dates])).alias("at"))
    return S.inputs(flows(spark, d), stocks(spark, d), instruments(spark, d), _daily_prices(spark, d, dates), actions(spark, d), targets, zeros(spark, d), measures)


@query(" UNION ALL ".join(f'SELECT "at", {_COLUMNS} FROM ({_snapshot_sql(x)})' for x in _DATES))
def snapshot_grid(spark, d):
    """The whole catalogue of all issuers at several dates by one plan."""
    rows = S.rows_of(S.evaluated(_inputs(spark, d)))
    return rows.select("at", "issuer", "concept", r6("value").alias("value"), "unit", "period_start", "period_end", "basis", "null_reason")


_TRACED = ("gross_margin", "roe", "net_debt_ebitda")
_PART = """SELECT issuer, '{m}' AS concept, 'fact' AS kind, c AS source, 'input' AS role, q2.start AS period_start, q2."end" AS period_end, 1 AS sign, {b} AS basis FROM {{last}} x JOIN q2 USING (issuer), (VALUES {cs}) t(c) WHERE {m}_v IS NOT NULL AND q2.start >= {s} AND q2."end" <= {e}"""
_LINES = " UNION ALL ".join(
    [
        _PART.format(m="gross_margin", b="b_gross_profit", cs="('revenue'), ('cogs')", s="s_gross_profit", e="e_gross_profit"),
        _PART.format(m="roe", b="x.b_net_income", cs="('net_income')", s="x.s_net_income", e="x.e_net_income"),
        _PART.format(m="net_debt_ebitda", b="b_ebitda", cs="('operating_income'), ('d_and_a')", s="s_ebitda", e="e_ebitda") + " AND ebitda_why IS NULL",
        _PART.format(m="net_debt_ebitda", b="b_built", cs="('revenue'), ('cogs'), ('opex'), ('d_and_a')", s="s_built", e="e_built") + " AND ebitda_why IS NOT NULL",
        """SELECT issuer, 'roe', 'fact', 'total_equity', 'begin', "end", "end", 1, basis FROM (SELECT x.issuer, stock."end", basis FROM {last} x JOIN stock ON stock.issuer = x.issuer AND concept = 'total_equity' AND stock."end" <= s_net_income WHERE roe_v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x.issuer ORDER BY stock."end" DESC, basis) = 1)""",
        """SELECT x.issuer, 'roe', 'fact', 'total_equity', 'end', stock."end", stock."end", 1, basis FROM {last} x JOIN stock ON stock.issuer = x.issuer AND concept = 'total_equity' AND stock."end" = e_net_income AND basis = 'as_reported' WHERE roe_v IS NOT NULL""",
        f"""SELECT x.issuer, 'net_debt_ebitda', 'fact', concept, 'input', max(stock."end"), max(stock."end"), 1, 'as_reported' FROM {{last}} x JOIN stock ON stock.issuer = x.issuer AND concept IN ('total_debt', 'cash', 'st_investments') AND basis = 'as_reported' AND stock."end" <= DATE '{AS_OF}' WHERE net_debt_ebitda_v IS NOT NULL GROUP BY x.issuer, concept""",
        f"""SELECT issuer, m, 'measure', f, 'feeds', NULL, DATE '{AS_OF}', 1, NULL FROM (SELECT issuer, unnest([{{{{'m': 'gross_margin', 'f': 'gross_profit', 'v': gross_margin_v}}}}, {{{{'m': 'net_debt_ebitda', 'f': 'net_debt', 'v': net_debt_ebitda_v}}}}, {{{{'m': 'net_debt_ebitda', 'f': 'ebitda', 'v': net_debt_ebitda_v}}}}], recursive := true) FROM {{last}}) WHERE v IS NOT NULL""",
    ]
)


@query(_snapshot_sql(select=_LINES))
def snapshot_lineage(spark, d):
    """What three measures are made of: the quarters of their windows, balances at borders and at the date, and the measures that feed them."""
    return S.lineage(S.evaluated(_inputs(spark, d, (AS_OF,), _TRACED), _TRACED), _TRACED).drop("at")


_RANKED = ("gross_margin", "roe", "pe", "net_debt_ebitda")


@query(f"""WITH r AS ({_snapshot_sql()}), m AS (SELECT r.*, r_name AS sector FROM r JOIN supplier ON s_suppkey = issuer JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE concept IN {_RANKED}),
p AS (SELECT issuer, concept, count(*) OVER (PARTITION BY sector, concept) - 1 AS n, (rank() OVER (PARTITION BY sector, concept ORDER BY value) - 1) / nullif(count(*) OVER (PARTITION BY sector, concept) - 1, 0) AS pct FROM m WHERE value IS NOT NULL)
SELECT issuer, concept, sector AS peer_group, coalesce(n, 0) AS n, CASE WHEN null_reason IS NULL AND n >= 5 THEN round(pct, 6) END AS percentile, coalesce(null_reason, CASE WHEN coalesce(n, 0) < 5 THEN 'peer_set_too_small' END) AS reason FROM m LEFT JOIN p USING (issuer, concept)""")
def peer_percentiles(spark, d):
    """Percentile rows of a snapshot: where each measure stands in its sector at the date, or why it has no place."""
    # the value is rounded first, as both sides must see the same ties
    rows = S.rows_of(S.evaluated(_inputs(spark, d, (AS_OF,), _RANKED), _RANKED), _RANKED).withColumn("value", r6("value"))
    out = S.percentiles(rows, sectors(spark, d).select("issuer", F.col("sector").alias("peer_group")))
    return out.select("issuer", "concept", "peer_group", "n", r6("percentile").alias("percentile"), "reason")


_NAMES = ("gross_margin", "pb", "net_debt", "div_yield", "no_such_measure")


@query(f"""WITH {SECTORS}, c AS (SELECT issuer, ['gross_margin', 'pb', 'net_debt', 'div_yield', 'no_such_measure'][issuer % 5 + 1] AS concept, balance AS x, CASE WHEN issuer % 7 <> 0 THEN balance - 1000 END AS y FROM sectors)
SELECT issuer, concept, CASE concept WHEN 'no_such_measure' THEN NULL WHEN 'net_debt' THEN CASE WHEN y IS NOT NULL THEN round(x - y - 5, 6) END ELSE CASE WHEN y > 0 THEN round(x / y, 6) END END AS value,
CASE WHEN concept = 'no_such_measure' THEN 'concept_not_mapped' WHEN y IS NULL THEN 'missing_data: ' || CASE concept WHEN 'gross_margin' THEN 'revenue' WHEN 'pb' THEN 'total_equity' WHEN 'net_debt' THEN 'cash' ELSE 'price_close' END
WHEN concept = 'net_debt' THEN NULL WHEN y = 0 THEN 'denominator_zero' WHEN y < 0 THEN 'negative_denominator' END AS reason FROM c""")
def formula_dispatch(spark, d):
    """Formulas by name over maps of inputs, an unknown one among them."""
    s = sectors(spark, d).withColumn("concept", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("issuer") % 5 + 1).cast("int")))
    x, y = F.col("balance"), F.when(F.col("issuer") % 7 != 0, F.col("balance") - 1000)
    inputs = {"gross_profit": x, "revenue": y, "market_cap_total": x, "total_equity": y, "total_debt": x, "cash": y, "st_investments": F.lit(5.0), "dps_ttm": x, "price_close": y}
    rows = s.withColumn("inputs", F.create_map(*[v for n, c in inputs.items() for v in (F.lit(n), c)]))
    return V.by_name(rows).select("issuer", "concept", r6("measure.value").alias("value"), "measure.reason")


@query(f"""WITH {SECTORS}, s AS (SELECT issuer, balance AS b, DATE '2000-12-31' - CAST(issuer % 20 AS INTEGER) AS day FROM sectors)
SELECT issuer, CAST(DATE '2000-12-31' AS DATE) AS border, round(CASE WHEN issuer % 20 <= 10 THEN b WHEN issuer % 2 = 0 THEN b + 1 END, 6) AS value,
CAST(CASE WHEN issuer % 20 <= 10 THEN issuer % 20 WHEN issuer % 2 = 0 THEN 3 END AS INTEGER) AS gap, CASE WHEN issuer % 20 <= 10 THEN 'as_reported' WHEN issuer % 2 = 0 THEN 'restated' END AS basis FROM s WHERE issuer % 20 <= 10 OR issuer % 2 = 0""")
def roic_border_band(spark, d):
    """Equity nearest to the end of 2000, ten days off at most; a restated balance only where no reported one is near."""
    s = sectors(spark, d)
    at = F.lit("2000-12-31").cast("date")
    own = s.select("issuer", F.lit("total_equity").alias("concept"), F.date_sub(at, (F.col("issuer") % 20).cast("int")).alias("end"), F.col("balance").alias("value"), F.lit(0).alias("rank"), F.lit("as_reported").alias("basis"))
    later = s.where("issuer % 2 = 0").select("issuer", F.lit("total_equity"), F.date_add(at, 3), F.col("balance") + 1, F.lit(0), F.lit("restated"))
    best = capital.at_border(s.select("issuer", at.alias("border")), own.union(later))
    return best.select("issuer", "border", r6("value").alias("value"), "gap", "basis")


@query(f"""WITH {SECTORS} SELECT issuer, CAST(DATE '2000-12-31' AS DATE) AS "end", round(CASE WHEN issuer % 4 = 0 THEN balance WHEN issuer % 4 = 1 THEN balance * 2 - 10 ELSE balance * 2 END, 6) AS value, issuer % 4 <> 0 AS identity FROM sectors WHERE issuer % 4 <> 3""")
def nci_identity(spark, d):
    """Parent equity: filed; or with minorities less these; or the former alone for issuers that never have any; else no row."""
    s = sectors(spark, d).withColumn("end", F.lit("2000-12-31").cast("date")).withColumn("unit", F.col("currency"))
    one = lambda cond, value: s.where(cond).select("issuer", "unit", "end", value.alias("value"))
    eq, incl = one("issuer % 4 = 0", F.col("balance")), one("issuer % 4 <> 0", F.col("balance") * 2)
    out = capital.parent_equity(eq, incl, one("issuer % 4 = 1", F.lit(10.0)), s.where("issuer % 4 = 2").select("issuer"))
    return out.select("issuer", "end", r6("value").alias("value"), "identity")


@query(f"""WITH {SECTORS} SELECT issuer, CASE WHEN issuer % 4 = 0 THEN NULL WHEN issuer % 4 = 1 THEN 'st_investments_discontinued: last 1999-12-31' WHEN issuer % 4 = 2 THEN 'st_investments_never_reported: us-gaap balance' END AS st_zero,
CASE WHEN issuer % 3 = 0 THEN NULL WHEN issuer % 3 = 1 THEN 'nci_absent_in_equity_block' ELSE 'nci_discontinued: last 1999-12-31' END AS nci_zero FROM sectors""")
def evidence_of_zeros(spark, d):
    """Investments: current, ended, never filed, never filed beside an unmapped one; minorities: current, never filed, ended."""
    s = sectors(spark, d)
    rows = (
        ("cash", "CashAndCashEquivalentsAtCarryingValue", "2000-12-31", "issuer > -1"), ("total_equity", "StockholdersEquity", "2000-12-31", "issuer > -1"),
        ("st_investments", "ShortTermInvestments", "2000-12-31", "issuer % 4 = 0"), ("st_investments", "ShortTermInvestments", "1999-12-31", "issuer % 4 = 1"),
        (None, "OtherInvestmentsCURRENT", "2000-12-31", "issuer % 4 = 3"), (None, "LongTermInvestmentsNoncurrent", "2000-12-31", "issuer % 4 = 2"),
        ("minority_interest", "MinorityInterest", "2000-12-31", "issuer % 3 = 0"), ("minority_interest", "MinorityInterest", "1999-12-31", "issuer % 3 = 2"),
    )
    out = None
    for canonical, tag, end, who in rows:
        own = s.where(who).select("issuer", F.lit(f"us-gaap:{tag}").alias("concept"), F.lit(canonical).cast("string").alias("canonical"), F.lit(end).cast("date").alias("end"))
        out = own if out is None else out.union(own)
    return C.evidence(out)


