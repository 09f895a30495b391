"""Filings: listing, newest, reported facts nearest to a period, loads that go stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listing(filings: DataFrame, forms: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Filings of some forms filed in a range, ends included; a missing day is kept."""
    day = F.col("filed_date")
    return filings.where(F.col("filing_type").isin(*forms)).where(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def newest(filings: DataFrame, n: int = 12) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("filed_date"), F.desc("accession_number"))
    return filings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def columns_to_rows(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays to rows."""
    return df.select(F.inline(F.arrays_zip(*arrays)))


def fact_as_of(wanted: DataFrame, facts: DataFrame, days: int = 10) -> DataFrame:
    """wanted (id, ticker, period_end) with the value of the fact (ticker, ended, form, seq, value) of that day, else the nearest within so many days.

    A fact of the very day must be of a form 10-...; a nearer day goes before a farther, a lesser seq before a greater.
    A fact is exploded over the days it may serve, so this is an equi-join.
    """
    near = facts.withColumn("shift", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("period_end", F.date_add("ended", F.col("shift")))
    j = wanted.join(near, ["ticker", "period_end"], "left")
    exact = (F.col("shift") == 0) & F.col("form").startswith("10-")
    best = F.min_by("value", F.struct(F.when(exact, 0).otherwise(1), F.abs("shift"), "seq"))
    return j.groupBy("id").agg(best.alias("value"))


def watchlist(wanted: DataFrame, loads: DataFrame, now: str, days: int = 7) -> DataFrame:
    """ticker, status of each wanted company by its last load: New, Stale or Fresh."""
    last = loads.groupBy("ticker").agg(F.max("loaded_at").alias("loaded_at"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("loaded_at").cast("timestamp"))) / 86400
    return wanted.select("ticker").distinct().join(last, "ticker", "left").select("ticker", F.when(F.col("loaded_at").isNull(), "New").when(age > days, "Stale").otherwise("Fresh").alias("status"))


def with_cik(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows with the ten-digit cik of their ticker, null where the table (ticker, cik; bounded by the number of listed companies) has none; tickers compare trimmed and in upper case."""
    known = companies.where("ticker is not null").groupBy(F.upper(F.trim("ticker")).alias("_t")).agg(F.min("cik").alias("_c"))
    padded = F.when(F.length(F.trim("_c")) < 10, F.lpad(F.trim("_c"), 10, "0")).otherwise(F.trim("_c"))
    return rows.join(known, F.upper(F.trim(rows["ticker"])) == known["_t"], "left").withColumn("cik", padded).drop("_t", "_c")


def hydrated(rows: DataFrame, today: str, base: str = "") -> DataFrame:
    """Filing rows that have an accession number, their day filled (from today), their period filled (from that day) and their address put together where they have none."""
    filed = F.coalesce("filed_date", F.lit(today).cast("date"))
    url = F.coalesce("filing_url", F.concat(F.lit(base), F.regexp_replace("accession_number", "-", "")))
    return rows.where("accession_number <> ''").withColumn("filed_date", filed).withColumn("period_of_report", F.coalesce("period_of_report", "filed_date")).withColumn("filing_url", url)


def periods(rows: DataFrame) -> DataFrame:
    """quarter, year, n: the periods that occur, numbered in their order."""
    from tonelake.functions.dates import period_index

    d = rows.where("quarter is not null and year is not null").select("quarter", "year").distinct()
    return d.withColumn("n", F.row_number().over(Window.orderBy(period_index(F.col("quarter"), F.col("year")))))


def score_of(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """wanted (ticker, quarter, year) with the score of that period, else the company's last; null without any."""
    from tonelake.functions.dates import period_index

    s = scores.select("ticker", F.col("quarter").alias("q"), F.col("year").alias("y"), "composite_score")
    exact = (F.col("q") == F.col("quarter")) & (F.col("y") == F.col("year"))
    best = F.max_by(F.struct(F.col("composite_score"), F.col("q").alias("scored_quarter"), F.col("y").alias("scored_year")), F.struct(exact, period_index(F.col("q"), F.col("y"))))
    return wanted.join(s, "ticker", "left").groupBy("ticker", "quarter", "year").agg(best.alias("b")).select("ticker", "quarter", "year", "b.*")


def targets(watched: DataFrame) -> DataFrame:
    """Of a watchlist's companies (ticker, status) those to run: the new ones, else the stale ones, else all."""
    found = watched.agg(F.max(F.col("status") == "New").alias("new"), F.max(F.col("status") == "Stale").alias("stale"))
    take = F.when(F.col("new"), F.col("status") == "New").when(F.col("stale"), F.col("status") == "Stale").otherwise(True)
    return watched.join(F.broadcast(found)).where(take).select("ticker")  # one row is broadcast


def recent(rows: DataFrame, day: str, days: int = 30) -> DataFrame:
    """Rows of the last days before each company's newest one."""
    newest_ = rows.groupBy("ticker").agg(F.max(day).alias("_newest"))
    return rows.join(newest_, "ticker").where(F.col(day) >= F.date_sub("_newest", days)).drop("_newest")


def metadata(chunks: DataFrame) -> DataFrame:
    """The flat columns that a vector store keeps beside a chunk; texts that are missing are empty, numbers 0."""
    text = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in chunks.columns else F.lit("")).alias(c)
    number = lambda c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in chunks.columns else F.lit(0)).alias(c)
    return chunks.select("chunk_id", *map(text, ("ticker", "form", "section", "quarter")), *map(number, ("year", "chunk_index", "total_chunks", "words")), *map(text, ("filed_date", "speaker", "strategy", "source_url", "accession_number")))
