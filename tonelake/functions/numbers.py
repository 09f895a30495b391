"""Numbers: clamps, safe quotients, amounts in text, accruals, cosine, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitudes that a number in text may carry.
MAGNITUDES = {"t": 1e12, "trillion": 1e12, "b": 1e9, "bn": 1e9, "billion": 1e9, "m": 1e6, "mn": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}
_AMOUNT = r"(?i)(-?)\$?\s*(\d[\d,]*(?:\.\d+)?)(?:\s*(trillion|billion|million|thousand|bn|mn|[tbmk])\b)?"


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def safe_float(x: Column) -> Column:
    """A double, null where it is none or not a number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)


def safe_int(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast("int")


def parse_financial_value(text: Column) -> Column:
    """The first number of a text with sign, separators and magnitude; the magnitude must end a word."""
    part = lambda i: F.regexp_extract(text, _AMOUNT, i)
    scale = F.create_map(*[F.lit(v) for kv in MAGNITUDES.items() for v in kv])
    value = F.replace(part(2), F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.try_element_at(scale, F.lower(part(3))), F.lit(1.0))
    return F.when(part(1) == "-", -value).otherwise(value)


def to_millions(value: Column, unit: Column) -> Column:
    scale = F.create_map(*[F.lit(v) for kv in MAGNITUDES.items() for v in kv])
    return value * F.coalesce(F.try_element_at(scale, F.lower(F.trim(unit))), F.lit(1.0)) / 1e6


def large_number(x: Column, decimals: int = 2) -> Column:
    """$ with a T, B, M or K suffix."""
    size = F.abs(x)
    out = F.format_string(f"$%.{decimals}f", x)
    for least, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(size >= least, F.format_string(f"$%.{decimals}f{mark}", x / least)).otherwise(out)
    return out


def accruals_ratio(income: Column, cash_flow: Column, assets: Column) -> Column:
    return F.try_divide(income - cash_flow, assets)


def accruals_component(ratio: Column) -> Column:
    return F.coalesce(-F.tanh(10 * ratio), F.lit(0.0))


def accuracy(mid: Column, actual: Column) -> Column:
    return F.when(actual == 0, 0.5).otherwise(clamp(1 - F.abs(mid - actual) / F.abs(actual), 0.0, 1.0))


def bias(mid: Column, actual: Column) -> Column:
    return F.when(actual == 0, 0.0).otherwise(clamp((mid - actual) / F.abs(actual), -2.0, 2.0))


def midpoint(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def mean_of_present(*columns: Column) -> Column:
    """Mean of those that aren't null, 0 if all are."""
    there = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return safe_divide(F.aggregate(there, F.lit(0.0), lambda s, v: s + v), F.size(there))
