"""Candidate pairs for contradictions, their scores and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: pairs of one company that the SQL of intra_period_pairs keeps (the feature's own limit; nothing else is cut to it), and the least score
MOST_PAIRS, LEAST_SCORE = 500, 0.70
# The side of a call, that of reports (form and section), and sections whose language is compared across periods.
CALLS, REPORTS = (("transcript",), ("prepared_remarks", "guidance")), (("10-Q", "10-K"), ("mda", "guidance"))
LANGUAGE = ("mda", "risk_factors", "guidance", "prepared_remarks", "qa", "press_release")


def intra_period_pairs(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """ticker, a, b, source: remarks and guidance of calls against discussion and guidance of reports of the same company and period; with `most`, the first so many of each company in the order of their ids (and their number n).

    The first `most` pairs of a period use only its first `most` chunks of either side, so each side is cut to those
    before they meet: the result is the same, and a large period can't multiply.
    """
    period = ["ticker", "quarter", "year"]

    def side(of: tuple, name: str) -> DataFrame:
        rows = chunks.where(F.col("form").isin(*of[0]) & F.col("section").isin(*of[1]))
        if most is not None:
            rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*period).orderBy("chunk_id"))).where(F.col("n") <= most)
        return rows.select(*period, F.col("chunk_id").alias(name))

    met = side(CALLS, "a").join(side(REPORTS, "b"), period).select("ticker", "a", "b", F.lit(1).alias("source"))
    return distinct_pairs(met) if most is None else capped(met, most)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs once each, whatever their order: the one of the least source, then of the least ids."""
    first = pairs.groupBy("ticker", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("source", "a", "b")).alias("p"))
    return first.select("ticker", "p.a", "p.b", "p.source")


def capped(pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Distinct pairs, at most so many of each company: by source (0 before 1), then by id. Not for pairs that are still to be scored."""
    order = Window.partitionBy("ticker").orderBy("source", "a", "b")
    return distinct_pairs(pairs).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("ticker", "a", "b", "source", "n")


def contradictions(scored: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Pairs (with contradiction, entailment, neutral) of at least the score, highest first by their number."""
    w = Window.partitionBy("ticker").orderBy(F.desc("contradiction"), "a", "b")
    return scored.where(F.col("contradiction") >= least).withColumn("rank", F.row_number().over(w))
