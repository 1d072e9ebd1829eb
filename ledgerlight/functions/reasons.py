"""Null-with-reason arithmetic: a value is a struct (value double, reason string) with exactly one side set.

Nothing raises and nothing is NaN or infinite: such inputs and results give 'non_finite'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first words that a reason may have.
REASONS = (
    "missing_data", "period_mismatch", "missing_prior_period", "concept_not_mapped", "denominator_zero", "negative_denominator", "jurisdiction_rate", "peer_set_too_small", "peer_set_not_confirmed", "no_sec_filings",
    "manual_import_required", "manual_unverified", "format_unsupported", "no_text_layer", "unknown_issuer", "source_unreachable", "currency_mismatch", "manual_near_miss", "stale_data", "adr_ratio_unknown", "non_finite", "stale_input", "not_applicable",
)


def is_known(reason: Column) -> Column:
    """True for null and for a reason whose first word is of the vocabulary."""
    return reason.isNull() | F.split(reason, ":")[0].isin(*REASONS)


def _odd(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def result(value: Column, reason: Column) -> Column:
    """A checked result: the reason wins, then a non-finite value gives its own."""
    value = value.cast("double")
    why = F.coalesce(reason, F.when(value.isNull(), F.lit("missing_data")), F.when(_odd(value), F.lit("non_finite")))
    return F.struct(F.when(why.isNull(), value).alias("value"), why.alias("reason"))


def missing(**inputs: Column) -> Column:
    """'missing_data: a, b' with the sorted names of null inputs, else null."""
    names = F.array_compact(F.array(*[F.when(inputs[n].isNull(), F.lit(n)) for n in sorted(inputs)]))
    return F.when(F.size(names) > 0, F.concat(F.lit("missing_data: "), F.array_join(names, ", ")))


def non_finite(*inputs: Column) -> Column:
    bad = F.lit(False)
    for x in inputs:
        bad = bad | F.coalesce(_odd(x.cast("double")), F.lit(False))
    return F.when(bad, F.lit("non_finite"))


def ratio(positive: bool = True, **inputs: Column) -> Column:
    """First input over the second, refused where the denominator is 0 or (positive) below 0."""
    (_, n), (_, d) = inputs.items()
    why = F.coalesce(missing(**inputs), non_finite(n, d), F.when(d == 0, F.lit("denominator_zero")), F.when(d < 0, F.lit("negative_denominator")) if positive else F.lit(None))
    return result(F.try_divide(n, d), why)


def effective_tax(tax: Column, pretax: Column) -> Column:
    """tax / pretax, refused outside 0 to 0.5; it is never clipped."""
    base = ratio(tax=tax, pretax=pretax)
    rate = base["value"]
    out = F.when((rate < 0) | (rate > 0.5), F.format_string("jurisdiction_rate: rate=%.4f", rate))
    return result(rate, F.coalesce(base["reason"], out))


def total(signs: dict[str, int], **inputs: Column) -> Column:
    """Signed sum, refused where an input is missing."""
    value = F.lit(0.0)
    for name, x in inputs.items():
        value = value + signs.get(name, 1) * x
    return result(value, F.coalesce(missing(**inputs), non_finite(*inputs.values())))


def cagr(start: Column, end: Column, years: Column) -> Column:
    why = F.coalesce(missing(start=start, end=end), F.when(years <= 0, F.lit("missing_data: years")), F.when(start <= 0, F.lit("negative_denominator")), F.when(end <= 0, F.lit("non_finite")))
    return result(F.when((start > 0) & (end > 0), F.pow(F.try_divide(end, start), 1 / years) - 1), why)
