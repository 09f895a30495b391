"""How a company's tone moves from quarter to quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.dates import period_index
from tonelake.functions.labels import direction
from tonelake.functions.numbers import clamp

# Weights of the last deltas from the oldest, growth of hedging and loss of specificity that count.
WEIGHTS, HEDGING_UP, SPECIFICITY_DOWN = (0.25, 0.35, 0.40), 1.2, 0.85


def _ordered(quarters: DataFrame) -> tuple[DataFrame, Window]:
    return quarters.withColumn("p", period_index(F.col("quarter"), F.col("year"))), Window.partitionBy("ticker").orderBy("p")


def quarter_changes(quarters: DataFrame) -> DataFrame:
    """Change, magnitude and direction against the quarter before that is there."""
    q, w = _ordered(quarters)
    delta = F.col("net_sentiment_score") - F.lag("net_sentiment_score").over(w)
    return q.withColumn("delta", delta).where("delta is not null").select("ticker", "quarter", "year", "delta", F.round(F.abs("delta"), 4).alias("magnitude"), direction(F.col("delta")).alias("direction"))


def compare_quarters(quarters: DataFrame) -> DataFrame:
    """Changes of all three scores against the quarter before."""
    q, w = _ordered(quarters)
    change = lambda c: F.round(F.col(c) - F.lag(c).over(w), 4)
    return q.withColumn("against", F.concat(F.lag("quarter").over(w), F.lit(" "), F.lag("year").over(w))).select(
        "ticker", "quarter", "year", "against", change("net_sentiment_score").alias("net_change"), change("hedging_score").alias("hedging_change"), change("specificity_score").alias("specificity_change")
    ).where("against is not null")


def drift_alerts(quarters: DataFrame) -> DataFrame:
    """One row for each company: trailing deteriorations, rising hedging, falling specificity, and the alert they make."""
    q, w = _ordered(quarters)
    back = Window.partitionBy("ticker").orderBy(F.desc("p"))
    steps = q.withColumn("way", direction(F.col("net_sentiment_score") - F.lag("net_sentiment_score").over(w)))
    steps = steps.withColumn("broken", F.sum(F.when(F.col("way") == "deteriorating", 0).otherwise(1)).over(back)).withColumn("n", F.row_number().over(back))
    steps = steps.withColumn("h2", F.lag("hedging_score", 2).over(w)).withColumn("s2", F.lag("specificity_score", 2).over(w))
    last = lambda c: F.max(F.when(F.col("n") == 1, c))
    one = steps.groupBy("ticker").agg(
        F.count("*").alias("quarters"), F.count_if(F.col("broken") == 0).alias("deteriorations"),
        F.coalesce(last(F.col("hedging_score") > F.col("h2") * HEDGING_UP), F.lit(False)).alias("hedging_rising"), F.coalesce(last(F.col("specificity_score") < F.col("s2") * SPECIFICITY_DOWN), F.lit(False)).alias("specificity_falling"),
    )
    d, h, s = F.col("deteriorations"), F.col("hedging_rising"), F.col("specificity_falling")
    level = F.when(F.col("quarters") < 2, "GREEN").when((d >= 2) & (h | s), "RED").when((d >= 2) | ((d == 1) & h) | (h & s), "YELLOW").otherwise("GREEN")
    reason = F.when(F.col("quarters") < 2, "Insufficient data").otherwise(F.concat_ws("; ", F.when(d > 0, F.format_string("%d falling quarters", d)), F.when(h, "hedging rises"), F.when(s, "specificity falls")))
    return one.select("*", level.alias("alert_level"), reason.alias("alert_reason"))


def drift_trends(quarters: DataFrame) -> DataFrame:
    """One row for each company: its scores as arrays in the order of quarters."""
    q, _ = _ordered(quarters)
    g = q.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("p", "quarter", "year", "net_sentiment_score", "hedging_score", "specificity_score"))).alias("t"))
    pick = lambda f: F.transform("t", lambda x: x[f])
    return g.select("ticker", F.transform("t", lambda x: F.concat(x["quarter"], F.lit(" "), x["year"])).alias("periods"), pick("net_sentiment_score").alias("sentiment_trend"), pick("hedging_score").alias("hedging_trend"), pick("specificity_score").alias("specificity_trend"))


def drift_scores(quarters: DataFrame) -> DataFrame:
    """The last three changes at most, weighted (the weights from the oldest of them, renormalised), doubled and clamped; 0 without a change."""
    q, w = _ordered(quarters)
    back = Window.partitionBy("ticker").orderBy(F.desc("p"))
    d = q.withColumn("delta", F.col("net_sentiment_score") - F.lag("net_sentiment_score").over(w)).withColumn("back", F.row_number().over(back))
    d = d.withColumn("m", F.least(F.lit(3), F.count("*").over(Window.partitionBy("ticker")) - 1))
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), F.greatest(F.lit(1), F.col("m") - F.col("back") + 1).cast("int"))
    d = d.withColumn("weight", F.when((F.col("back") <= F.col("m")) & F.col("delta").isNotNull(), weight))
    score = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("delta")), F.sum("weight")), F.lit(0.0))
    return d.groupBy("ticker").agg(clamp(score * 2, -1.0, 1.0).alias("drift_score"))


def latest_change(quarters: DataFrame) -> DataFrame:
    """Each company's last quarter: its score, its change (0 if it's alone), and the range of all."""
    q, w = _ordered(quarters)
    x = q.withColumn("change", F.coalesce(F.col("net_sentiment_score") - F.lag("net_sentiment_score").over(w), F.lit(0.0)))
    return x.groupBy("ticker").agg(F.max_by("net_sentiment_score", "p").alias("latest"), F.max_by("change", "p").alias("change"), (F.max("net_sentiment_score") - F.min("net_sentiment_score")).alias("range"))
