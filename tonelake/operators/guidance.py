"""Guidance against what was reported, and guidance in text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from tonelake.functions.dates import next_period, period_index
from tonelake.functions.numbers import accuracy, bias, clamp, midpoint

# Bounds of a plausible amount by metric.
BOUNDS = {"EPS": (0.01, 1000.0), "revenue": (1e4, 5e12), "capex": (1e4, 1e12), "margin": (0.01, 100.0), "growth": (-100.0, 10000.0), "other": (0.0, None)}
# What stands between the ends of a range, magnitudes, mentions of a period, and metric, unit, confidence and pattern of guided amounts.
_TO = r"\s*(?:to|-|and|–|—)\s*"
_SIZE = r"billion|million|B|M|bn|mm"
MAGNITUDES = {"b": 1e9, "bn": 1e9, "bil": 1e9, "billion": 1e9, "m": 1e6, "mm": 1e6, "mil": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3, "t": 1e12, "tn": 1e12, "trillion": 1e12}
PERIOD = r"(?:(?:Q[1-4]\s+\d{4})|(?:fiscal\s+(?:year\s+)?\d{4})|(?:FY\s*\d{2,4})|(?:(?:first|second|third|fourth)\s+quarter(?:\s+of\s+\d{4})?)|(?:full.year\s+\d{4})|(?:next\s+(?:quarter|year|fiscal\s+year)))"
_CENTS = r"\$?(\d+\.\d{1,4})(?:" + _TO + r"\$?(\d+\.\d{1,4}))?"
_DOLLARS = rf"\$?(\d+(?:\.\d+)?)\s*({_SIZE})?(?:{_TO}\$?(\d+(?:\.\d+)?)\s*({_SIZE})?)?"
_SHARE = rf"(\d+(?:\.\d+)?)\s*%?(?:{_TO}(\d+(?:\.\d+)?)\s*%)?"
PATTERNS = (
    ("EPS", "USD/share", 0.85, r"(?:expect|guide|guidance|project|anticipate)\w*\s+(?:earnings\s+per\s+share|EPS|diluted\s+EPS)\s+(?:of\s+|to\s+be\s+|between\s+|in\s+(?:the\s+)?range\s+of\s+)?" + _CENTS),
    ("EPS", "USD/share", 0.85, r"EPS\s+guidance\s+of\s+" + _CENTS),
    ("revenue", "USD", 0.85, r"(?:expect|guide|project|anticipate|forecast)\w*\s+(?:(?:total\s+)?(?:net\s+)?revenue[s]?|(?:net\s+)?sales)\s+(?:of\s+|to\s+(?:be\s+)?|between\s+|in\s+(?:the\s+)?range\s+of\s+)?" + _DOLLARS),
    ("revenue", "USD", 0.85, r"revenue\s+(?:guidance|outlook)\s+of\s+" + _DOLLARS),
    ("capex", "USD", 0.80, r"(?:capital\s+expenditure[s]?|capex)\s+(?:of\s+|approximately\s+|between\s+)?" + _DOLLARS),
    ("margin", "%", 0.80, r"(?:gross|operating|net|EBITDA)\s+margin\s+(?:of\s+|approximately\s+|between\s+|expected\s+(?:at|to\s+be)\s+)?" + _SHARE),
    ("growth", "%", 0.75, r"(?:expect|anticipate|project)\w*\s+(?:revenue\s+)?growth\s+(?:of\s+|approximately\s+|between\s+)?" + _SHARE),
)
#: characters around a match in which a period is looked for, and characters kept on both sides of its text
NEAR, AROUND = 100, 20
# What every match of one of the patterns begins with, in one pattern: only texts that have it leave the JVM.
_S = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"
_BEGUN = (
    rf"(?i)(?:expect|guid|project|anticipate|forecast)\w*{_S}(?:earnings{_S}per|EPS|diluted|total{_S}|net{_S}|revenue|sales|growth)|EPS{_S}guidance|revenue{_S}(?:guidance|outlook)"
    rf"|(?:capital{_S}expenditures?|capex){_S}(?:of|approximately|between|\$|\p{{Nd}})|(?:gross|operating|net|EBITDA){_S}margin{_S}(?:of|approximately|between|expected|\p{{Nd}})"
)


def filing_of_period(filings: DataFrame) -> DataFrame:
    """One filing for each company and period: the last amendment if there is one, else the first filing."""
    w = Window.partitionBy("ticker", "quarter", "year").orderBy(F.desc("is_amendment"), F.when(F.col("is_amendment"), -F.unix_date("filed_date")).otherwise(F.unix_date("filed_date")), "accession_number")
    return filings.where("quarter is not null and year is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def match_guidance(guidance: DataFrame, filings: DataFrame) -> DataFrame:
    """Every guidance row with the actual of the next period, its accuracy and bias; null where nothing is reported."""
    q, y = next_period(F.col("quarter"), F.col("year"))
    g = guidance.select("*", q.alias("aq"), y.alias("ay"), midpoint(F.col("value_low"), F.col("value_high")).alias("guided_mid"))
    f = filing_of_period(filings).select(F.col("ticker").alias("ft"), F.col("quarter").alias("aq"), F.col("year").alias("ay"), "eps_diluted", "revenue", F.abs("capex").alias("capex"), "gross_margin")
    joined = g.join(f, (g.ticker == f.ft) & (g.aq == f.aq) & (g.ay == f.ay), "left")
    margin = F.when(F.col("gross_margin").between(0, 1), F.col("gross_margin") * 100).otherwise(F.col("gross_margin"))
    actual = F.when(F.col("metric") == "EPS", F.col("eps_diluted")).when(F.col("metric") == "revenue", F.col("revenue")).when(F.col("metric") == "capex", F.col("capex")).when(F.col("metric") == "margin", margin)
    m = joined.withColumn("actual", actual)
    return m.select("guidance_id", "ticker", "quarter", "year", "metric", "guided_mid", "actual", accuracy(F.col("guided_mid"), F.col("actual")).alias("accuracy"), bias(F.col("guided_mid"), F.col("actual")).alias("bias"))


def _component(n, acc, b, least: int = 3):
    bonus = F.when(b < -0.05, 0.10).otherwise(0.0)
    return F.when(n >= least, clamp((acc - 0.5) * 2 + bonus, -1.0, 1.0)).otherwise(0.0)


def guidance_component(matched: DataFrame) -> DataFrame:
    """A company's guidance score: 0 with fewer than three matched records."""
    m = matched.groupBy("ticker").agg(F.count("accuracy").alias("records"), F.avg("accuracy").alias("a"), F.avg(F.when(F.col("accuracy").isNotNull(), F.col("bias"))).alias("b"))
    return m.select("ticker", "records", _component(F.col("records"), F.col("a"), F.col("b")).alias("guidance_component"))


def guidance_component_by_period(matched: DataFrame) -> DataFrame:
    """The same for each period from the records up to it alone: a running sum, no look ahead."""
    known = matched.where("accuracy is not null").groupBy("ticker", "quarter", "year").agg(F.count("*").alias("n"), F.sum("accuracy").alias("a"), F.sum("bias").alias("b"))
    w = Window.partitionBy("ticker").orderBy(period_index(F.col("quarter"), F.col("year"))).rangeBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(w)
    return known.select("ticker", "quarter", "year", run("n").alias("records"), _component(run("n"), run("a") / run("n"), run("b") / run("n")).alias("guidance_component"))


def guidance_by_metric(matched: DataFrame) -> DataFrame:
    return matched.where("accuracy is not null").groupBy("ticker", "metric").agg(F.round(F.avg("accuracy"), 4).alias("mean_accuracy"), F.round(F.avg("bias"), 4).alias("mean_bias"), F.round(F.coalesce(F.stddev_samp("bias"), F.lit(0.0)), 4).alias("std_bias"), F.count("*").alias("records"))


def distinct_guidance(guidance: DataFrame) -> DataFrame:
    """Of equal amounts of one metric and period, the row with most confidence; ties go to the least id."""
    w = Window.partitionBy("ticker", "quarter", "year", "metric", F.round("value_low", 4), F.round("value_high", 4)).orderBy(F.desc("confidence_score"), "guidance_id")
    return guidance.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def plausible(metric, value):
    """Whether an amount lies within the bounds of its metric, both included; an unknown metric has none."""
    bound = lambda i: F.try_element_at(F.create_map(*[F.lit(v) for m, b in BOUNDS.items() for v in (m, float("inf") if b[i] is None else b[i])]), metric)
    return F.coalesce(value.between(bound(0), bound(1)), F.lit(False))


def _reader(grouped: bool):
    """A function from a text to its guided amounts, equal ones once: of equal ones (to four places) the most confident, then the first."""
    number = (lambda p: p.replace(r"\d+(?:\.\d+)?", r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?")) if grouped else lambda p: p
    compiled = [(m, u, c, re.compile(number(p), re.I)) for m, u, c, p in PATTERNS]
    period = re.compile(PERIOD, re.I)

    def read(text: str | None) -> list[tuple]:
        best: dict[tuple, tuple] = {}
        for metric, unit, confidence, pattern in compiled:
            least, most = BOUNDS[metric]
            for m in pattern.finditer(text or ""):
                first, first_size, second, second_size = m.groups() if pattern.groups == 4 else (m[1], None, m[2], None)
                scale = lambda x, size: float(x.replace(",", "")) * MAGNITUDES.get((size or "").lower(), 1.0)
                low = scale(first, first_size)
                high = scale(second, second_size or first_size) if second else None
                if low < least or most is not None and low > most:
                    continue
                near = period.search(text[max(0, m.start() - NEAR) : m.start() + NEAR])
                low, high = (min(low, high), max(low, high)) if high else (low, None)
                key = (metric, round(low, 4), None if high is None else round(high, 4))
                if key not in best or confidence > best[key][4]:
                    best[key] = (metric, low, high, unit, confidence, near[0].strip() if near else "", text[max(0, m.start() - AROUND) : m.end() + AROUND].strip(), high is not None)
        return list(best.values())

    return read


_FOUND = ArrayType(StructType([StructField(n, t) for n, t in (("metric", StringType()), ("low", DoubleType()), ("high", DoubleType()), ("unit", StringType()), ("confidence", DoubleType()), ("fiscal_period", StringType()), ("raw_text", StringType()), ("is_explicit", BooleanType()))]))


def _found(grouped: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = _reader(grouped)
        for texts in batches:
            yield texts.map(read)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, _FOUND)


def extract_guidance(texts: DataFrame, key: str, text: str = "text", grouped: bool = False) -> DataFrame:
    """key, metric, low, high (null for a lone amount), unit, confidence, fiscal_period, raw_text, is_explicit: every plausible amount or range that a metric's patterns find in a text.

    All matches of all patterns count; equal ones of a metric once for each text. The period is the first one mentioned around the match. With `grouped` a number
    may have thousands separators; without, digits after a comma are another number. Only texts that have the beginning of a pattern leave the JVM. key tells texts apart.
    """
    rows = texts.where(F.col(text).rlike(_BEGUN)).select(key, _found(grouped)(F.col(text)).alias("found"))
    return rows.select(key, F.inline("found"))
