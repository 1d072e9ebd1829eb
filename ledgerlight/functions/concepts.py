"""Canonical concepts of filed tags, with ranks; signs, evidence and names of manual metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: By taxonomy, the tags of each concept, the strongest first.
US_GAAP = {
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"),
    "cogs": ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold", "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization"),
    "gross_profit": ("GrossProfit",),
    "opex": ("OperatingExpenses",),
    "operating_income": ("OperatingIncomeLoss",),
    "d_and_a": ("DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAndAmortization", "Depreciation"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "pretax_income": (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ),
    "tax_expense": ("IncomeTaxExpenseBenefit",),
    "interest_expense": ("InterestExpense", "InterestExpenseDebt", "InterestExpenseNonoperating"),
    "interest_income": ("InvestmentIncomeInterest",),
    "eps_diluted": ("EarningsPerShareDiluted",),
    "shares_diluted": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
    "ocf": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "st_investments": ("ShortTermInvestments", "MarketableSecuritiesCurrent", "AvailableForSaleSecuritiesDebtSecuritiesCurrent"),
    "total_assets": ("Assets",),
    "total_equity": ("StockholdersEquity",),
    "total_debt": ("LongTermDebt", "DebtLongtermAndShorttermCombinedAmount"),
    "shares_outstanding": ("CommonStockSharesOutstanding",),
    "total_equity_incl_nci": ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",),
    "minority_interest": ("MinorityInterest",),
    "preferred_equity": ("PreferredStockValue",),
    "dps": ("CommonStockDividendsPerShareDeclared", "CommonStockDividendsPerShareCashPaid"),
    "buyback_amount": ("PaymentsForRepurchaseOfCommonStock",),
}
IFRS = {
    "revenue": ("Revenue", "RevenueFromContractsWithCustomers"),
    "net_income": ("ProfitLossAttributableToOwnersOfParent", "ProfitLoss"),
    "operating_income": ("ProfitLossFromOperatingActivities",),
    "gross_profit": ("GrossProfit",),
    "cogs": ("CostOfSales",),
    "pretax_income": ("ProfitLossBeforeTax",),
    "tax_expense": ("IncomeTaxExpenseContinuingOperations",),
    "d_and_a": ("DepreciationAndAmortisationExpense", "AdjustmentsForDepreciationAndAmortisationExpense"),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "total_equity": ("EquityAttributableToOwnersOfParent",),
    "total_equity_incl_nci": ("Equity",),
    "cash": ("CashAndCashEquivalents",),
    "ocf": ("CashFlowsFromUsedInOperatingActivities",),
    "capex": ("PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",),
    "interest_expense": ("FinanceCosts",),
    "shares_diluted": ("AdjustedWeightedAverageShares",),
    "dps": ("DividendsRecognisedAsDistributionsToOwnersPerShare",),
}
CVM = {"revenue": ("3.01",), "gross_profit": ("3.03",), "pretax_income": ("3.07",), "tax_expense": ("3.08",), "net_income": ("3.11",), "total_equity_incl_nci": ("2.03",)}
DEI = {"shares_outstanding": ("EntityCommonStockSharesOutstanding",)}
TAXONOMIES = {"us-gaap": US_GAAP, "ifrs-full": IFRS, "cvm-dfp": CVM, "dei": DEI}
#: What a taxonomy's ranks begin from, and the rank of a tag outside the map.
OFFSETS, UNKNOWN = {"ifrs-full": 100, "dei": 1000}, 1 << 30
#: Concepts that manual records may not have, as they are no money.
NOT_MANUAL = ("shares_outstanding", "shares_diluted", "eps_diluted", "dps", "interest_income", "total_liabilities")


def table(spark: SparkSession, maps: dict = TAXONOMIES) -> DataFrame:
    """(taxonomy, tag, concept, tag_rank), under two hundred rows. Canonical names stand for themselves in us-gaap, after the tags."""
    rows = [(x, tag, concept, OFFSETS.get(x, 0) + i) for x, own in maps.items() for concept, tags in own.items() for i, tag in enumerate(tags)]
    rows += [("us-gaap", c, c, len(tags)) for c, tags in maps.get("us-gaap", {}).items()]
    return spark.createDataFrame(rows, "taxonomy string, tag string, concept string, tag_rank int")


def mapped(facts: DataFrame, maps: dict = TAXONOMIES, name: str = "concept") -> DataFrame:
    """facts with taxonomy, tag, canonical and tag_rank; *name* holds taxonomy:tag, or a tag of us-gaap. Unmapped ones stay, with null.

    Ranks make us-gaap stronger than ifrs-full and that than dei.
    """
    x = F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise("us-gaap")
    tag = F.when(F.contains(name, F.lit(":")), F.expr(f"substr({name}, instr({name}, ':') + 1)")).otherwise(F.col(name))
    t = table(facts.sparkSession, maps).withColumnRenamed("concept", "canonical")
    out = facts.withColumn("taxonomy", x).withColumn("tag", tag).join(F.broadcast(t), ["taxonomy", "tag"], "left")
    return out.withColumn("tag_rank", F.coalesce("tag_rank", F.lit(UNKNOWN)))


def cvm_sign(taxonomy: Column, tag: Column, value: Column) -> Column:
    """Tax lines of CVM statements come as deductions: their sign turns; zero has none."""
    turned = F.when(value == 0, 0.0).otherwise(-value)
    return F.when((taxonomy == "cvm-dfp") & (tag == "3.08"), turned).otherwise(value)


def manual_metric(metric: Column) -> Column:
    """Canonical concept of a manual record's metric: case, underscores, points and spaces do not count; else null."""
    plain = F.trim(F.regexp_replace(F.lower(F.translate(metric, "_.", "  ")), r"\s+", " "))
    names = [c for c in {**US_GAAP} if c not in NOT_MANUAL]
    return F.try_element_at(F.create_map(*[F.lit(x) for c in names for x in (c.replace("_", " "), c)]), plain)


def filled(facts: DataFrame, maps: dict = TAXONOMIES, withdrawn: tuple[str, ...] = ()) -> DataFrame:
    """facts (concept, canonical) with canonical filled where it is null and a map has the tag; tags in *withdrawn* lose theirs."""
    new = mapped(facts.withColumnRenamed("canonical", "_was"), maps)
    value = F.when(F.col("concept").isin(*withdrawn), F.lit(None)).otherwise(F.coalesce("_was", "canonical"))
    return new.withColumn("canonical", value).select(facts.columns)


def mainly_ifrs(facts: DataFrame) -> DataFrame:
    """(issuer, mainly_ifrs): whether more facts come from ifrs-full than from us-gaap."""
    n = lambda x: F.count_if(F.startswith("concept", F.lit(f"{x}:")))
    return facts.groupBy("issuer").agg((n("ifrs-full") > n("us-gaap")).alias("mainly_ifrs"))


def unmapped_investments(facts: DataFrame) -> DataFrame:
    """(issuer, end) of balances with a current investment under a tag that no map has."""
    tag = F.col("concept")
    current = (tag.ilike("%investments%current%") | tag.ilike("%securities%current%")) & ~tag.ilike("%noncurrent%")
    return facts.where(F.col("canonical").isNull() & current).select("issuer", "end").distinct()


def evidence(facts: DataFrame) -> DataFrame:
    """(issuer, st_zero, nci_zero): why short-term investments or minorities may be taken as zero, else null.

    facts (issuer, concept, canonical, end), all as reported. Investments: the line ended before the newest cash balance, or a
    balance of us-gaap only never had it; in neither case may that balance have a current investment without a map.
    Minorities: equity is filed, and they never were, or ended before it.
    """
    odd = unmapped_investments(facts).withColumn("_odd", F.lit(True))
    last = lambda *c: F.max(F.when(F.col("canonical").isin(*c), F.col("end")))
    gaap = F.bool_and(F.when(F.col("canonical") == "cash", F.startswith("concept", F.lit("us-gaap:"))))
    g = facts.groupBy("issuer").agg(
        last("cash").alias("cash"), last("st_investments").alias("st"), last("total_equity").alias("equity"),
        last("minority_interest", "total_equity_incl_nci").alias("nci"), gaap.alias("gaap"),
    )
    g = g.join(odd.withColumnRenamed("end", "cash"), ["issuer", "cash"], "left")
    ended = lambda what, day: F.concat(F.lit(f"{what}_discontinued: last "), F.col(day).cast("string"))
    st = F.when(F.col("st") < F.col("cash"), ended("st_investments", "st")).when(F.col("st").isNull() & F.col("gaap"), "st_investments_never_reported: us-gaap balance")
    nci = F.when(F.col("nci").isNull(), "nci_absent_in_equity_block").when(F.col("nci") < F.col("equity"), ended("nci", "nci"))
    return g.select("issuer", F.when(F.col("cash").isNotNull() & F.col("_odd").isNull(), st).alias("st_zero"), F.when(F.col("equity").isNotNull(), nci).alias("nci_zero"))


def strongest(facts: DataFrame, key: list[str], home: str | None = None) -> DataFrame:
    """The fact of each key with the best rank, then in the *home* currency, then the first."""
    first = [F.col("tag_rank"), *([F.desc_nulls_last(F.col("currency").eqNullSafe(F.col(home)))] if home else []), F.col("fact_id")]
    return facts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*first))).where("_n = 1").drop("_n")
