"""The composite quality score, and the components that aren't tone or guidance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import labels
from tonelake.functions.numbers import accruals_component, accruals_ratio, clamp
from tonelake.operators.guidance import filing_of_period

# Weights of drift, guidance, accruals and analysts, and words of rating changes.
WEIGHTS = {"drift": 0.30, "guidance": 0.25, "accruals": 0.25, "analyst": 0.20}
UP, DOWN = r"upgrade|initiated|raised|buy|outperform|overweight", r"downgrade|lowered|sell|underperform|underweight"
if abs(sum(WEIGHTS.values()) - 1) > 1e-6:
    raise ValueError("the weights must sum to 1")


def accruals(filings: DataFrame) -> DataFrame:
    f = filing_of_period(filings)
    ratio = accruals_ratio(F.col("net_income"), F.col("operating_cash_flow"), F.col("total_assets"))
    return f.select("ticker", "quarter", "year", ratio.alias("accruals_ratio"), accruals_component(ratio).alias("accruals_component"))


def latest_analyst(analysts: DataFrame) -> DataFrame:
    """Each company's last analyst row; its revision, clamped, 0 if null, is the component."""
    w = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("fetch_date"), F.desc("analyst_row_id"))
    last = analysts.withColumn("n", F.row_number().over(w)).where("n = 1")
    return last.select("ticker", "fetch_date", F.coalesce(clamp(F.col("revision_direction"), -1.0, 1.0), F.lit(0.0)).alias("analyst_component"))


def revision_moves(changes: DataFrame, text: str = "change", group: str = "ticker") -> DataFrame:
    """Moves up and down by group; a change with words of both counts as up. The direction shrinks small samples."""
    up = F.lower(F.col(text)).rlike(UP)
    down = ~up & F.lower(F.col(text)).rlike(DOWN)
    m = changes.groupBy(group).agg(F.count_if(up).alias("ups"), F.count_if(down).alias("downs"))
    return m.select(group, "ups", "downs", clamp((F.col("ups") - F.col("downs")) / (F.col("ups") + F.col("downs") + 1), -1.0, 1.0).alias("revision_direction"))


def estimates_wide(estimates: DataFrame, key: str = "ticker", kind: str = "kind", value: str = "value", kinds=("mean", "high", "low")) -> DataFrame:
    return estimates.groupBy(key).pivot(kind, list(kinds)).agg(F.avg(value))


def quality_scores(periods: DataFrame, drift: DataFrame, guidance: DataFrame, accrual: DataFrame, analyst: DataFrame) -> DataFrame:
    """The weighted score of every period; a missing component is 0. drift, guidance and analyst are by company, accruals by period."""
    zero = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    j = periods.select("ticker", "quarter", "year").distinct().join(drift, "ticker", "left").join(guidance.select("ticker", "guidance_component"), "ticker", "left")
    j = j.join(accrual, ["ticker", "quarter", "year"], "left").join(analyst.select("ticker", "analyst_component"), "ticker", "left")
    parts = {"drift": "drift_score", "guidance": "guidance_component", "accruals": "accruals_component", "analyst": "analyst_component"}
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    s = j.select("ticker", "quarter", "year", clamp(total, -1.0, 1.0).alias("composite_score"), *[zero(F.col(c)).alias(k) for k, c in parts.items()], "accruals_ratio")
    return s.withColumn("signal", labels.signal(F.col("composite_score")))


def explained(scores: DataFrame) -> DataFrame:
    return scores.select("ticker", "quarter", "year", labels.explanation(*[F.col(c) for c in ("composite_score", "drift", "guidance", "accruals", "analyst")]).alias("explanation"))
