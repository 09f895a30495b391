"""Quarters, earnings dates and trading days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_order(quarter: Column) -> Column:
    """1 to 4, Annual 5, anything else 0."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in {"Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "Annual": 5}.items() for v in kv]), quarter), F.lit(0))


def period_index(quarter: Column, year: Column) -> Column:
    return year * 10 + quarter_order(quarter)


def quarter_of(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day))


def next_period(quarter: Column, year: Column) -> tuple[Column, Column]:
    """Q1 to Q2 and so on; Q4 and Annual lead to Q1 of the next year."""
    wraps = quarter.isin("Q4", "Annual")
    return F.when(wraps, "Q1").otherwise(F.concat(F.lit("Q"), F.substring(quarter, 2, 1).cast("int") + 1)), year + wraps.cast("int")


def previous_period(quarter: Column, year: Column) -> tuple[Column, Column]:
    wraps = quarter == "Q1"
    return F.when(wraps, "Q4").otherwise(F.concat(F.lit("Q"), F.substring(quarter, 2, 1).cast("int") - 1)), year - wraps.cast("int")


def period_end(quarter: Column, year: Column) -> Column:
    """Last day of a quarter; December 31 for Annual and unknown."""
    q = F.when(quarter_order(quarter).between(1, 4), quarter_order(quarter)).otherwise(4)
    return F.last_day(F.make_date(year, (q * 3).cast("int"), F.lit(1)))


def quarters_between(q1: Column, y1: Column, q2: Column, y2: Column, most: int = 40) -> Column:
    """Labels from the first to the second quarter, both included, at most so many."""
    a, b = y1 * 4 + quarter_order(q1) - 1, y2 * 4 + quarter_order(q2) - 1
    stop = F.when(b < a, a + most - 1).otherwise(F.least(b, a + most - 1))
    return F.transform(F.sequence(a, stop), lambda i: F.format_string("Q%d %d", (i % 4 + 1).cast("int"), F.floor(i / 4).cast("int")))


def past_quarters(day: Column, n: int) -> Column:
    """The n quarters before a day, newest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(quarter_of(F.add_months(day, -3 * i)), F.lit(" "), F.year(F.add_months(day, -3 * i))))


def earnings_date(quarter: Column, year: Column) -> Column:
    """The 15th of April, July, October, January (of the next year) or, for Annual, February."""
    month = F.when(quarter == "Q1", 4).when(quarter == "Q2", 7).when(quarter == "Q3", 10).when(quarter == "Q4", 1).otherwise(2)
    return F.make_date(clamp_year(year + (quarter == "Q4").cast("int")), month, F.lit(15))


def clamp_year(year: Column) -> Column:
    return F.greatest(F.lit(1990), F.least(F.lit(2099), year))


def next_trading_day(day: Column) -> Column:
    """The day itself, or Monday after a weekend."""
    return F.date_add(day, F.greatest(F.lit(0), 7 - F.greatest(F.weekday(day), F.lit(4)) % 7).cast("int") % 7 * (F.weekday(day) > 4).cast("int"))


def add_trading_days(day: Column, n: int) -> Column:
    """The nth weekday after a day, in closed form."""
    from_monday = F.least(F.weekday(day), F.lit(4))
    weeks, rest = F.floor((from_monday + n) / 5).cast("int"), (from_monday + n) % 5
    return F.date_add(F.date_sub(day, F.weekday(day)), (weeks * 7 + rest).cast("int"))


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays from a to b, both included."""
    upto = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))
    return F.greatest(F.lit(0), upto(b) - upto(F.date_sub(a, 1))).cast("int")


def period_string(quarter: Column, year: Column) -> Column:
    return F.concat_ws(" ", quarter, year.cast("string"))


def first_month(quarter: Column) -> Column:
    """The first month of a quarter; null for other periods."""
    return F.when(quarter.isin("Q1", "Q2", "Q3", "Q4"), F.substring(quarter, 2, 1).cast("int") * 3 - 2)
