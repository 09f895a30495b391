"""Tone of chunks, and of a company's quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions import text as T
from tonelake.functions.labels import dominant
from tonelake.functions.numbers import clamp

QUARTER = ["ticker", "quarter", "year"]


def _lexicon() -> list:
    p, n = F.regexp_count("text", F.lit(T.POSITIVE_PATTERN)), F.regexp_count("text", F.lit(T.NEGATIVE_PATTERN))
    return [(p / (p + n + 1)).alias("positive"), (n / (p + n + 1)).alias("negative"), (1 / (p + n + 1)).alias("neutral")]


def lexicon_scores(chunks: DataFrame) -> DataFrame:
    """The default scorer: shares of positive and negative words. A model's scores (chunk_id, positive, negative, neutral) take its place."""
    return chunks.select("chunk_id", *_lexicon())


def scored(chunks: DataFrame) -> DataFrame:
    """Chunks with the default scores beside them."""
    return chunks.select("*", *_lexicon())


def _scored(chunks: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Chunks with their scores: without any the lexicon's, as columns of the same rows; else joined, the counts taken first so that no text is shuffled."""
    text = F.col("text")
    counts = F.regexp_count(text, F.lit(T.HEDGE_PATTERN)).alias("h"), T.specific_numbers(text).alias("f"), F.regexp_count(text, F.lit(T.VAGUE_PATTERN)).alias("v")
    if scores is None:
        return chunks.select(*QUARTER, "words", *_lexicon(), *counts)
    return chunks.select("chunk_id", *QUARTER, "words", *counts).join(scores.select("chunk_id", "positive", "negative", "neutral"), "chunk_id")


def with_dominant(scores: DataFrame) -> DataFrame:
    return scores.select("*", (F.col("positive") - F.col("negative")).alias("net_score"), dominant(F.col("positive"), F.col("negative"), F.col("neutral")).alias("dominant_label"))


def quarter_sentiment(chunks: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Word-weighted mean tone, hedging and specificity of each company's quarter. Quarters without words are left out.

    The counts are taken from each chunk and added, so no quarter's text is ever put together in one task.
    """
    counted = _scored(chunks, scores)
    mean = lambda c: F.sum(F.col(c) * F.col("words")) / F.sum("words")
    out = counted.groupBy(*QUARTER).agg(mean("positive").alias("positive_pct"), mean("negative").alias("negative_pct"), mean("neutral").alias("neutral_pct"), F.sum("words").alias("words"), F.sum("h").alias("h"), F.sum("f").alias("f"), F.sum("v").alias("v"), F.count("*").alias("chunk_count"))
    return out.where("words > 0").select(
        *QUARTER, "positive_pct", "negative_pct", "neutral_pct", clamp(F.col("positive_pct") - F.col("negative_pct"), -1.0, 1.0).alias("net_sentiment_score"),
        (100.0 * F.col("h") / F.greatest(F.lit(1), F.col("words"))).alias("hedging_score"), T.specificity(F.col("f"), F.col("v")).alias("specificity_score"), "chunk_count",
    )


def most_negative(chunks: DataFrame, scores: DataFrame | None = None, k: int = 5, length: int = 200) -> DataFrame:
    """The k chunks of each quarter with the least net score, and the start of their text; no more of a text is shuffled."""
    text = F.col("text")
    scored = chunks.select("*", *_lexicon()) if scores is None else chunks.join(scores, "chunk_id")
    ranked = scored.select("chunk_id", *QUARTER, F.substring(text, 1, length).alias("text"), "positive", "negative").withColumn("net", F.col("positive") - F.col("negative"))
    ranked = ranked.withColumn("rank", F.expr("row_number() over (partition by ticker, quarter, year order by net, chunk_id)")).where(F.col("rank") <= k)
    return ranked.select(*QUARTER, "rank", "chunk_id", F.col("text").alias("start"))


def section_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("section").agg(F.count("*").alias("chunks"))


def hedging_by_section(chunks: DataFrame, quarters=("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """A heat map: mean hedging of each section, a column for each quarter."""
    scored = chunks.select("section", "quarter", T.hedging(F.col("text"), F.col("words")).alias("h"))
    return scored.groupBy("section").pivot("quarter", list(quarters)).agg(F.avg("h"))
