"""Names for numbers: signals, bands and sentences made from scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the signal, and the bands of the guidance bias.
SIGNAL = 0.30
BIAS = ((-0.10, "sandbagging"), (0.05, "accurate"), (0.10, "slightly optimistic"), (0.25, "optimistic"))


def signal(score: Column) -> Column:
    return F.when(score > SIGNAL, "LONG").when(score < -SIGNAL, "SHORT").otherwise("NEUTRAL")


def bias_label(mean_bias: Column) -> Column:
    return reduce(lambda out, band: F.when(mean_bias < band[0], band[1]).otherwise(out), reversed(BIAS), F.lit("aggressively optimistic"))


def dominant(positive: Column, negative: Column, neutral: Column) -> Column:
    """Ties go to positive, then negative."""
    return F.when((positive >= negative) & (positive >= neutral), "positive").when(negative >= neutral, "negative").otherwise("neutral")


def direction(delta: Column, band: float = 0.10) -> Column:
    return F.when(F.abs(delta) <= band, "stable").when(delta > 0, "improving").otherwise("deteriorating")


def source_label(ticker: Column, form: Column, quarter: Column, year: Column, section: Column) -> Column:
    return F.concat_ws(" ", ticker, form, quarter, year.cast("string"), F.lit("—"), section)


def contradiction_sentence(score: Column, same_period: Column, a: Column, b: Column) -> Column:
    how = F.when(score > 0.85, "HIGH").otherwise("MODERATE")
    when = F.when(same_period, "the same period").otherwise("different periods")
    return F.format_string("%s contradiction (score %.2f) in %s: %s against %s", how, score, when, a, b)


def explanation(score: Column, drift: Column, guidance: Column, accruals: Column, analyst: Column) -> Column:
    """One line for the score and one for each component, marked by its threshold."""
    mark = lambda x, t: F.when(x > t, "+").when(x < -t, "-").otherwise("=")
    rows = [("drift", drift, 0.1), ("guidance", guidance, 0.2), ("accruals", accruals, 0.2), ("analyst", analyst, 0.1)]
    return F.concat_ws("\n", F.format_string("score %+.3f (%s)", score, signal(score)), *[F.format_string(f"%s {n} %+.3f", mark(x, t), x) for n, x, t in rows])


def band(x: Column, bands: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The name of the first band whose least value x reaches."""
    return reduce(lambda out, b: F.when(x >= b[0], b[1]).otherwise(out), reversed(bands), F.lit(rest))


def quality_band(x: Column) -> Column:
    return band(x, ((0.80, "EXCELLENT"), (0.65, "ACCEPTABLE")), "IMPROVE")


def hedging_band(x: Column) -> Column:
    return F.when(x > 8, "high").when(x > 4, "medium").otherwise("low")


def gauge_fill(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x + 1) / 2 * 100))


def accruals_label(ratio: Column) -> Column:
    return F.when(ratio < 0, "Cash-backed").otherwise("Accrual-heavy")


def freshness(modified: Column, now: Column, days: int = 7) -> Column:
    """Fresh, Stale after so many days, Not ingested without a time."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(modified)) / 86400
    return F.when(modified.isNull(), "Not ingested").when(age > days, "Stale").otherwise("Fresh")
