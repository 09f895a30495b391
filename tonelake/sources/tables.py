"""The library's entities, read from stored tables with their dirt taken off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import text as T
from tonelake.functions.dates import quarter_of
from tonelake.storage import spread

# The section that a source's documents stand for.
SECTIONS = {"filing_mda": "mda", "filing_risk": "risk_factors", "call_excerpt": "qa", "press_release": "press_release", "analyst_note": "guidance"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticker(c="ticker"):
    return F.upper(F.trim(F.col(c)))


def padded_cik(c="cik"):
    """Ten digits; a longer one is kept."""
    t = F.trim(F.col(c))
    return F.when(F.length(t) < 10, F.lpad(t, 10, "0")).otherwise(t)


def chunks(documents: DataFrame) -> DataFrame:
    """chunk_id, text, ticker, form, section, quarter, year, words of every document with text, company and period; the form as source and quarter tell it."""
    section = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SECTIONS.items() for v in kv]), F.col("source")), F.lit("unknown"))
    report = F.when(F.col("quarter").isin("Q4", "Annual"), "10-K").otherwise("10-Q")
    form = F.when(F.col("source").isin("filing_mda", "filing_risk"), report).when(F.col("source") == "call_excerpt", "transcript").when(F.col("source") == "press_release", "8-K").otherwise("other")
    return spread(documents.select("doc_id", "text", "source", "ticker", "quarter", "year")).where("text <> '' and trim(ticker) <> '' and quarter is not null and year is not null").select(
        F.col("doc_id").alias("chunk_id"), "text", ticker().alias("ticker"), form.alias("form"), section.alias("section"), "quarter", "year", T.word_count(F.col("text")).alias("words")
    )


def filings(rows: DataFrame) -> DataFrame:
    """Each filing once (the first load), with company, cik, quarter and year filled from the period, and the reported figures flat."""
    first = rows.where("accession_number is not null").groupBy("accession_number").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("accession_number", "raw_text")]), F.col("loaded_at")).alias("r"))
    r = first.select("accession_number", "r.*")
    return r.where("trim(ticker) <> ''").select(
        "accession_number", ticker().alias("ticker"), padded_cik().alias("cik"), "filing_type", "period_of_report", "filed_date",
        F.coalesce("quarter", quarter_of(F.col("period_of_report"))).alias("quarter"), F.coalesce("year", F.year("period_of_report")).alias("year"),
        F.coalesce("is_amendment", F.lit(False)).alias("is_amendment"), "xbrl_data.*",
    )


def _first_load(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each key once: its first load, a missing time last."""
    order = F.struct(F.col("loaded_at").isNull(), "loaded_at", F.xxhash64("raw_text"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def filing_texts(rows: DataFrame) -> DataFrame:
    """accession_number, ticker, form, quarter, year, text: the cleaned text of each filing once, quarter and year filled from the period."""
    r = _first_load(rows, "accession_number", "ticker", "filing_type", "quarter", "year", "period_of_report", "raw_text")
    period = F.coalesce("quarter", quarter_of(F.col("period_of_report"))).alias("quarter"), F.coalesce("year", F.year("period_of_report")).alias("year")
    return r.where("raw_text <> ''").select("accession_number", ticker().alias("ticker"), F.col("filing_type").alias("form"), *period, T.clean_filing(F.col("raw_text")).alias("text"))


def call_texts(rows: DataFrame) -> DataFrame:
    """transcript_id, ticker, quarter, year, text: the cleaned text of each call once."""
    r = _first_load(rows, "transcript_id", "ticker", "quarter", "year", "raw_text")
    return r.where("raw_text <> ''").select("transcript_id", ticker().alias("ticker"), "quarter", "year", T.clean_call(F.col("raw_text")).alias("text"))


def guidance(rows: DataFrame) -> DataFrame:
    """Each guidance row once, metric in one case, company in one form."""
    metric = F.lower(F.trim("metric_type"))
    return rows.where("guidance_id is not null and trim(ticker) <> ''").select(
        "guidance_id", ticker().alias("ticker"), "quarter", "year", F.when(metric == "eps", "EPS").otherwise(metric).alias("metric"), "value_low", "value_high", "confidence_score"
    ).dropDuplicates(["guidance_id"])


def analysts(rows: DataFrame) -> DataFrame:
    return rows.where("analyst_row_id is not null and trim(ticker) <> ''").select("analyst_row_id", ticker().alias("ticker"), "fetch_date", "price_target_mean", "price_target_high", "price_target_low", "num_price_target_analysts", F.lower(F.trim("current_rating")).alias("rating"), "revision_direction").dropDuplicates(["analyst_row_id"])


def prices(lineitem: DataFrame, names: int = 20) -> DataFrame:
    """A stand-in for market prices: a day's quantities and line numbers put open and close of each of some names between 100 and 110."""
    return lineitem.where("l_quantity is not null and l_shipdate is not null").groupBy(F.concat(F.lit("S"), F.col("l_suppkey") % names).alias("ticker"), F.to_date("l_shipdate").alias("dt")).agg(
        (100.0 + F.sum(F.col("l_quantity").cast("bigint")) % 11).alias("open"), (100.0 + F.sum("l_linenumber") % 11).alias("close")
    )
