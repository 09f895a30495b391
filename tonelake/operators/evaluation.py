"""Evaluation of answers, metrics as long tables, and the routing of the question loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.numbers import mean_of_present

METRICS = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
# Sections that an intent asks for, most hops, and the grade that ends the loop.
INTENTS = {"earnings_analysis": ("mda", "guidance", "financial_statements"), "risk_assessment": ("risk_factors",), "guidance_tracking": ("guidance",), "tone_drift": ("prepared_remarks", "mda", "qa")}
MOST_HOPS, GRADE = 3, 0.70


def overlap(said: Column, source: Column) -> Column:
    """The default grader: the share of a text's words that its source holds; 0 without words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(said), words(source))), F.size(words(said))), F.lit(0.0))


def evaluate(answers: DataFrame, score=None) -> DataFrame:
    """answers (question, answer, contexts, ground_truth) with their four metrics and the mean of those that are there.

    faithfulness: how far the contexts support the answer; answer_relevance: how far the answer speaks of the question; context_precision: nine tenths of the relevance;
    context_recall: how far the contexts hold the ground truth, null without one. score(text, source) is a column function, by default the share of words; a null score counts as 0.5.
    Rows without an answer have null metrics and a mean of 0.
    """
    score = score or overlap
    there = F.coalesce(F.col("answer") != "", F.lit(False))
    source = F.array_join("contexts", "\n\n")
    graded = lambda c: F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5)))))
    x = answers.withColumn("faithfulness", graded(score(F.col("answer"), source))).withColumn("answer_relevance", graded(score(F.col("question"), F.col("answer"))))
    truth = F.when(F.coalesce(F.col("ground_truth") != "", F.lit(False)), score(F.col("ground_truth"), source)) if "ground_truth" in answers.columns else F.lit(None).cast("double")
    return with_mean(x.withColumn("context_precision", 0.9 * F.col("answer_relevance")).withColumn("context_recall", F.when(there, truth)))


def with_mean(evaluations: DataFrame) -> DataFrame:
    return evaluations.withColumn("mean_score", mean_of_present(*[F.col(m) for m in METRICS]))


def to_long(df: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """key, metric, value of the metrics that are there."""
    return df.unpivot(key, list(metrics), "metric", "value").where("value is not null")


def summary(evaluations: DataFrame, key: str) -> DataFrame:
    """Mean, spread, least and most of each metric."""
    return to_long(evaluations, key).groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("std"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"), F.count("*").alias("count"))


def batch_mean(evaluations: DataFrame) -> DataFrame:
    return with_mean(evaluations).agg(F.coalesce(F.avg(F.when(F.col("mean_score") > 0, F.col("mean_score"))), F.lit(0.0)).alias("mean_overall"), F.count("*").alias("count"))


def route(needs_more: Column, grade: Column, hops: Column) -> tuple[Column, Column]:
    """Where a request goes after retrieval, and after grading."""
    after_retrieval = F.when(needs_more & (hops < MOST_HOPS), "industry").otherwise("contradiction")
    after_grading = F.when((grade < GRADE) & (hops < MOST_HOPS), "company").otherwise("ragas_prep")
    return after_retrieval, after_grading


def intent_of(question: Column) -> Column:
    """The default classifier: the first intent whose words a question has."""
    q = F.lower(question)
    rules = (("risk_assessment", r"\brisk"), ("guidance_tracking", r"\b(?:guidance|outlook|forecast)"), ("tone_drift", r"\b(?:tone|sentiment|drift)"), ("comparative_analysis", r"\b(?:peers?|industry|competitors?|compared?|versus|rivals?)\b"), ("macro_context", r"\b(?:macro|economy|economic|inflation|interest rates?)\b"), ("earnings_analysis", r"\b(?:earnings|revenue|margin|profit)"))
    out = F.lit("general")
    for name, pattern in reversed(rules):
        out = F.when(q.rlike(pattern), name).otherwise(out)
    return out


def fits_intent(intent: Column, section: Column) -> Column:
    """Whether a section answers an intent; intents without sections take all."""
    out = F.lit(True)
    for name, sections in INTENTS.items():
        out = F.when(intent == name, section.isin(*sections)).otherwise(out)
    return out


def context(chunks: DataFrame, group: str, most: int = 10, length: int = 600, prefix: str = "SOURCE") -> DataFrame:
    """One text for each group out of its first chunks (by rank), each with a heading."""
    kept = chunks.where(F.col("rank") <= most)
    part = F.concat(F.lit(f"[{prefix} "), F.col("rank"), F.lit(": "), F.concat_ws(" ", "ticker", "quarter", F.col("year").cast("string"), F.lit("-"), "section"), F.lit("]\n"), F.substring("text", 1, length))
    return kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def recent_runs(runs: DataFrame, n: int = 10, ticker: str | None = None) -> DataFrame:
    r = runs if ticker is None else runs.where(F.col("params")["ticker"] == ticker)
    return r.orderBy(F.desc("started_at"), "run_id").limit(n).select("run_id", "started_at", F.col("params")["ticker"].alias("ticker"), "metrics")


def ranked(chunks: DataFrame, by: str, partition: str, k: int) -> DataFrame:
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(by), "chunk_id"))).where(F.col("rank") <= k)
