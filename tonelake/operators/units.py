"""Amounts recorded in many units, brought to one unit for each kind of quantity (problem 4).

An automaton over all unit aliases finds the aliases that touch a number in the text, or that make up the
unit field; the longest alias wins, and the metric of the row decides what is still open. The code that comes
out is joined with a table of conversion factors, and currencies with the rates of the row's period.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.storage import one_of_each, small_enough, spread

# Unit aliases, by meaning.
SCALES = {
    1e3: ["k", "thousand", "thousands", "'000", "000s"],
    1e6: ["m", "mm", "mn", "mln", "million", "millions"],
    1e9: ["b", "bn", "bln", "billion", "billions"],
    1e12: ["tn", "trillion", "trillions"],
}
CURRENCIES = {
    "USD": ["$", "us$", "usd", "dollar", "dollars", "us dollar", "us dollars"],
    "EUR": ["€", "eur", "euro", "euros"],
    "GBP": ["£", "gbp", "pound", "pounds", "pounds sterling"],
    "CHF": ["chf", "swiss franc", "swiss francs"],
    "JPY": ["¥", "jpy", "yen"],
    "CAD": ["cad", "c$", "ca$", "canadian dollar", "canadian dollars"],
}
OTHERS = {
    "CENT": ["c", "¢", "cent", "cents", "us cent", "us cents", "c/sh", "cents/share", "cents per share", "us cents per share"],
    "PCT": ["%", "pct", "percent", "per cent", "percentage points"],
    "BP": ["bp", "bps", "basis point", "basis points"],
    "RATIO": ["ratio", "decimal", "fraction"],
    "SHARE": ["share", "shares", "sh"],
    "PERSHARE": ["/share", "per share", "/sh", "a share"],
}
#: unit of the result -> how many of the stored whole numbers make one unit
STORED = {"USD": 1, "USD/share": 10_000, "%": 100, "shares": 1}
#: of a table of rates that is broadcast; a larger one is joined by a shuffle
RATE_ROWS = 200_000

_COMPARED = re.compile(r"(?i)[,;(]?\s*\b(?:against|versus|vs\.?|compared (?:with|to)|up from|down from|as opposed to)\s.*$", re.S)
_PERIODS = re.compile(
    r"(?i)\b(?:fy\s?'?\d{2,4}|q[1-4]\s*(?:fy)?\s*'?\d{2,4}|(?:fiscal|full[- ]year|calendar|year)\s+(?:year\s+)?\d{4}"
    r"|(?:first|second|third|fourth)\s+quarter(?:\s+of)?(?:\s+(?:fiscal\s+)?\d{4})?|h[12]\s*\d{4}|\d{4}\s+fiscal\s+year"
    r"|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+(?:\d{1,2},?\s+)?\d{4})\b"
)
_HEADER = re.compile(r"(?i)\bin\s+(thousand|million|billion)s\b|\((?:us)?\$\s?(?:'?(000)s?|(k|mm?|bn?))\)")
_NUMBER = re.compile(r"(?<![\w.,])([-−–]?)(\d[\d,]*(?:\.\d+)?|\.\d+)")
_RANGE = re.compile(r"(?i)^\s*(?:-|–|—|to|and|up to|through)\s*$")


_SIGNS = sorted((n for names in CURRENCIES.values() for n in names), key=len, reverse=True)
# Numerals below a thousand in words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SPELLED = re.compile(rf"(?i)\b(?:{'|'.join(_TENS + _ONES[::-1])}|hundred)(?:(?:-|\s+|\s+and\s+(?<=hundred and ))(?:{'|'.join(_TENS + _ONES[::-1])}|hundred)\b)*\b")


def _digits(m: re.Match) -> str:
    """A spelled numeral in digits: ninety-five, six hundred and two."""
    total = 0
    for word in re.split(r"[\s-]+", m[0].lower()):
        if word == "hundred":
            total = max(total, 1) * 100
        elif word != "and":
            total += _ONES.index(word) if word in _ONES else 20 + 10 * _TENS.index(word)
    return str(total)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for scale, names in SCALES.items():
        for name in names:
            found.add_word(name, (len(name), "scale", scale))
    for code, names in CURRENCIES.items():
        for name in names:
            found.add_word(name, (len(name), "currency", code))
    for kind, names in OTHERS.items():
        for name in names:
            found.add_word(name, (len(name), "kind", kind))
    found.make_automaton()
    return found


class UnitReader:
    """Reads a row's guided amount: (low, high, code) or None. The code is base|scale, as in factors()."""

    def __init__(self) -> None:
        self.aliases = _automaton()

    def spans(self, text: str, whole_words: bool) -> tuple[dict, dict]:
        """The longest alias by where it starts, and by where it ends."""
        starts: dict[int, tuple] = {}
        ends: dict[int, tuple] = {}
        for last, (size, what, value) in self.aliases.iter(text):
            a, b = last - size + 1, last + 1
            if whole_words and text[b - 1].isalpha() and b < len(text) and text[b].isalpha():
                continue
            if a not in starts or starts[a][1] < b:
                starts[a] = (a, b, what, value)
            if b not in ends or ends[b][0] > a:
                ends[b] = (a, b, what, value)
        return starts, ends

    def field(self, unit: str | None) -> dict:
        """What a unit field says, cut from the left into longest aliases."""
        said: dict = {}
        text = (unit or "").strip().lower()
        starts, _ = self.spans(text, False)
        at = 0
        while at < len(text):
            if (hit := starts.get(at)) is None:
                at += 1
                continue
            said.setdefault(hit[2], hit[3]) if hit[2] != "kind" else said.setdefault("kind", []).append(hit[3])
            at = hit[1]
        return said

    def amounts(self, text: str) -> tuple[list[dict], float | None]:
        """Numbers of the text with the aliases that touch them, and the scale a header announces."""
        text = _COMPARED.sub("", text)
        header = _HEADER.search(text)
        scale = {"t": 1e3, "0": 1e3, "k": 1e3, "m": 1e6, "b": 1e9}[(header[1] or header[2] or header[3])[0].lower()] if header else None
        if header:
            text = text[: header.start()] + " " * (header.end() - header.start()) + text[header.end() :]
        text = _SPELLED.sub(_digits, _PERIODS.sub(lambda m: " " * len(m[0]), text)).lower()
        starts, ends = self.spans(text, True)
        out = []
        for m in _NUMBER.finditer(text):
            a, b = m.start(), m.end()
            number = float(m[2].replace(",", ""))
            if m[1]:
                if _touches_number(text, a) or m[1] == "–" and out and _RANGE.match(text[out[-1]["end"] : a + 1]):
                    a += 1
                else:
                    number = -number
            said: dict = {"kind": []}
            at = a
            while at and text[at - 1] == " ":
                at -= 1
            if (hit := ends.get(at)) and hit[2] == "currency":
                said["currency"] = hit[3]
                left = hit[0]
                if left and text[left - 1] in "-−" and number >= 0 and not _touches_number(text, left - 1):
                    number = -number
            at = b
            while True:
                gap = at
                while gap < len(text) and text[gap] == " ":
                    gap += 1
                hit = starts.get(gap)
                if hit is None or (gap > b and gap == at and text[gap].isalpha() and text[at - 1].isalpha()):
                    break
                if hit[2] == "currency" and re.match(r"\s*\d", text[hit[1] :]):
                    break  # the next number's own sign
                if hit[2] == "kind":
                    said["kind"].append(hit[3])
                elif hit[2] in said:
                    break
                else:
                    said[hit[2]] = hit[3]
                at = hit[1]
            out.append(said | {"number": number, "start": a, "end": at})
        for x, y in zip(out, out[1:]):
            between = text[x["end"] : y["start"]].rstrip()
            sign = next((n for n in _SIGNS if between.endswith(n)), "")
            x["joined"] = bool(_RANGE.match(between[: len(between) - len(sign)]))
        return out, scale

    def read(self, metric: str | None, low: float | None, high: float | None, unit: str | None, text: str | None):
        metric = (metric or "").strip().lower()
        field = self.field(unit)
        if text:
            numbers, header = self.amounts(text)
            said = [n for n in numbers if n["kind"] or "currency" in n or "scale" in n]
            first = said[0] if said else numbers[0] if numbers else None
            if first is not None:
                i = numbers.index(first)
                if i and numbers[i - 1].get("joined"):
                    i -= 1
                pair = numbers[i : i + 2] if numbers[i].get("joined") else numbers[i : i + 1]
                whole: dict = {"kind": [k for n in pair for k in n["kind"]]}
                for key in ("currency", "scale"):
                    values = [n[key] for n in pair if key in n]
                    if values:
                        whole[key] = values[-1]
                if "scale" not in whole and header:
                    whole["scale"] = header
                if not whole["kind"] and "currency" not in whole and not header and "scale" not in whole:
                    whole = field | {"kind": field.get("kind", [])}
                elif "currency" not in whole and field.get("currency") and metric in ("revenue", "capex"):
                    whole["currency"] = field["currency"]
                code = self.code(metric, whole)
                if code:
                    last = whole.get("scale", 1)
                    values = sorted(n["number"] * (n.get("scale", last) / last) for n in pair)
                    return values[0], values[-1], code
        values = sorted(v for v in (low, high) if v is not None)
        if values and field:
            code = self.code(metric, field | {"kind": field.get("kind", [])})
            if code:
                return values[0], values[-1], code
        return None

    @staticmethod
    def code(metric: str, said: dict) -> str | None:
        """Field context: the metric tells what a bare sign, scale or letter stands for; a contradiction tells nothing."""
        kinds, currency, scale = set(said["kind"]), said.get("currency"), said.get("scale", 1)
        if metric in ("margin", "growth"):
            for kind in ("BP", "PCT", "RATIO"):
                if kind in kinds:
                    return f"{kind}|1"
            return None
        if metric == "eps":
            if "CENT" in kinds:
                return "CENT|1"
            if kinds & {"PCT", "BP", "RATIO"} or not (currency or kinds & {"PERSHARE", "SHARE"}):
                return None
            return f"{currency or 'USD'}/share|{scale:g}"
        if metric in ("revenue", "capex"):
            if kinds & {"PCT", "BP", "RATIO", "CENT", "SHARE", "PERSHARE"} or not (currency or scale != 1):
                return None
            return f"{currency or 'USD'}|{scale:g}"
        for kind in ("BP", "PCT", "RATIO"):
            if kind in kinds:
                return f"{kind}|1"
        if "CENT" in kinds:
            return "CENT|1"
        if "PERSHARE" in kinds:
            return f"{currency or 'USD'}/share|{scale:g}"
        if "SHARE" in kinds:
            return f"SHARE|{scale:g}"
        return f"{currency}|{scale:g}" if currency else None


def _touches_number(text: str, at: int) -> bool:
    """Whether a dash at this place follows a number or its unit without a space, as in 9.5-11 or $49m-$51m."""
    return at > 0 and not text[at - 1].isspace() and (text[at - 1].isalnum() or text[at - 1] in "%¢")


def factors() -> list[tuple[str, str | None, str, float]]:
    """code, currency to convert from, common unit, factor."""
    scales = [1.0, *SCALES]
    rows = [("PCT|1", None, "%", 1.0), ("BP|1", None, "%", 0.01), ("RATIO|1", None, "%", 100.0), ("CENT|1", None, "USD/share", 0.01)]
    for s in scales:
        rows.append((f"SHARE|{s:g}", None, "shares", s))
        for c in CURRENCIES:
            rows.append((f"{c}|{s:g}", None if c == "USD" else c, "USD", s))
            rows.append((f"{c}/share|{s:g}", None if c == "USD" else c, "USD/share", s))
    return rows


_READ = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("code", T.StringType())])


@F.pandas_udf(_READ)
def _read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    reader = UnitReader()
    for metric, low, high, unit, text in batches:
        rows = []
        for m, a, b, u, t in zip(metric, low, high, unit, text):
            a, b = (None if pd.isna(v) or v in (float("inf"), float("-inf")) else float(v) for v in (a, b))
            got = reader.read(m, a, b, u, t)
            rows.append(got if got else (None, None, None))
        yield pd.DataFrame(rows, columns=["low", "high", "code"])


def to_common_units(guidance: DataFrame, rates: DataFrame, key: str = "guidance_id") -> DataFrame:
    """One row for each key: key, common_unit, low, high (whole numbers as in STORED; low <= high), recorded_ok.

    The amount in the text, with its units, goes before the fields; without one the fields and the unit field
    tell it. common_unit, low and high are null where neither tells an amount, or where the rate of the row's
    quarter and year is missing. recorded_ok: whether value_low and value_high, in either order, are already that amount in
    the common unit; null where both are. Rows loaded twice (same key) come out once; every row with a null key
    comes out. Other columns of guidance are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = spread(guidance.select(
        F.col(key).alias("k"), F.col("metric_type").cast("string").alias("m"), F.col("value_low").cast("double").alias("a"), F.col("value_high").cast("double").alias("b"),
        F.col("unit").cast("string").alias("u"), F.col("raw_text").cast("string").alias("t"), F.upper(F.trim("quarter")).alias("q"), F.col("year").cast("int").alias("y"),
    ))
    rows = one_of_each(rows, ["k"], "t").unionByName(rows.where("k is null"))
    read = rows.withColumn("r", _read("m", "a", "b", "u", "t")).select("k", "a", "b", "q", "y", "r.low", "r.high", "r.code")
    spark = guidance.sparkSession
    by_code = spark.createDataFrame(factors(), "code string, from_currency string, common_unit string, factor double")
    fx = rates.select(F.upper(F.trim("currency")).alias("from_currency"), F.upper(F.trim("quarter")).alias("q"), F.col("year").cast("int").alias("y"), F.col("usd_per_unit").cast("double").alias("rate"))
    fx = fx.groupBy("from_currency", "q", "y").agg(F.max("rate").alias("rate"))
    fx = F.broadcast(fx) if small_enough(fx, RATE_ROWS) else fx
    joined = read.join(F.broadcast(by_code), "code", "left").join(fx, ["from_currency", "q", "y"], "left")
    stored = F.when(F.col("common_unit") == "USD/share", 10_000.0).when(F.col("common_unit") == "%", 100.0).otherwise(1.0)
    rate = F.when(F.col("from_currency").isNull(), 1.0).otherwise(F.col("rate"))
    whole = lambda c: F.round(F.round(F.col(c) * F.col("factor") * rate * stored, 4)).cast("bigint")
    out = joined.withColumn("lo", whole("low")).withColumn("hi", whole("high"))
    told = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    near = lambda v: F.round(F.round(v * stored, 4)).cast("bigint")
    return out.select(
        F.col("k").alias(key), F.when(told, F.col("common_unit")).alias("common_unit"), F.when(told, F.least("lo", "hi")).alias("low"), F.when(told, F.greatest("lo", "hi")).alias("high"),
        F.when(told & a.isNotNull(), (near(F.least(a, b)) == F.least("lo", "hi")) & (near(F.greatest(a, b)) == F.greatest("lo", "hi"))).alias("recorded_ok"),
    )


def conversion_cases(guidance: DataFrame, rates: DataFrame, key: str = "guidance_id") -> DataFrame:
    """The rows of to_common_units whose amount is told and not already recorded in the common unit."""
    return to_common_units(guidance, rates, key).where(F.col("common_unit").isNotNull() & ~F.coalesce(F.col("recorded_ok"), F.lit(False))).select(key, "common_unit", "low", "high")
