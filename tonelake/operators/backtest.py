"""Signals, trades, equity curves and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import dates as D
from tonelake.functions.labels import signal
from tonelake.storage import small_enough, stage

# Days held, days a price is looked for, trading days of a year, risk-free rate, capital.
HOLDING, TOLERANCE, YEAR, RISK_FREE, CAPITAL = 20, 4, 252, 0.045, 100_000.0

#: ranges of numbered() that are broadcast at most
RUNS = 100_000


def latest_run(scores: DataFrame, computed: str = "computed_at") -> DataFrame:
    """Of several runs for one company and period, the newest; ties go to the highest score."""
    w = Window.partitionBy("ticker", "quarter", "year").orderBy(F.desc_nulls_last(computed), F.desc("composite_score"))
    return scores.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def signals(scores: DataFrame, announced: DataFrame | None = None, start: str = "2019-01-01", end: str = "2024-12-31") -> DataFrame:
    """LONG and SHORT signals within the window. A known announcement day (ticker, quarter, year, announced_on) goes before the estimate."""
    s = latest_run(scores) if "computed_at" in scores.columns else scores
    day = D.earnings_date(F.col("quarter"), F.col("year"))
    if announced is not None:
        s = s.join(announced, ["ticker", "quarter", "year"], "left")
        day = F.coalesce(F.col("announced_on"), day)
    s = s.withColumn("signal_date", day).withColumn("direction", signal(F.col("composite_score"))).where("direction <> 'NEUTRAL'").where(F.col("signal_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    entry = D.next_trading_day(F.date_add("signal_date", 1))
    return s.select("ticker", "quarter", "year", "direction", F.col("composite_score").alias("quality_score"), "signal_date", entry.alias("entry_date"), D.add_trading_days(entry, HOLDING).alias("exit_date"))


def price_on_or_after(days: DataFrame, prices: DataFrame, price: str, day: str = "day", tolerance: int = TOLERANCE) -> DataFrame:
    """days (ticker, day) with the first price within so many calendar days; null without one.

    A day is exploded into the few days it may use, so the join is an equi-join on (ticker, day) and never a range join.
    """
    wanted = days.select("ticker", day).distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(tolerance)))).withColumn("dt", F.date_add(day, F.col("offset")))
    hit = wanted.join(prices.where(F.col(price).isNotNull()).select("ticker", "dt", F.col(price).alias("p")), ["ticker", "dt"])
    first = hit.groupBy("ticker", day).agg(F.min_by("p", "offset").alias(price))
    return days.join(first, ["ticker", day], "left")


def trades(signals_: DataFrame, prices: DataFrame) -> DataFrame:
    """Signals with entry at the open, exit at the close; those without a price or with an entry price of 0 drop out."""
    signals_ = stage(signals_, "signals")  # read three times; made once
    e = price_on_or_after(signals_.select("ticker", F.col("entry_date").alias("day")).distinct(), prices, "open").select("ticker", F.col("day").alias("entry_date"), F.col("open").alias("entry_price"))
    x = price_on_or_after(signals_.select("ticker", F.col("exit_date").alias("day")).distinct(), prices, "close").select("ticker", F.col("day").alias("exit_date"), F.col("close").alias("exit_price"))
    t = signals_.join(e, ["ticker", "entry_date"]).join(x, ["ticker", "exit_date"]).where("entry_price > 0 and exit_price is not null")
    change = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")
    return t.select(
        "ticker", "direction", "signal_date", "entry_date", "exit_date", F.round("entry_price", 2).alias("entry_price"), F.round("exit_price", 2).alias("exit_price"), "quality_score",
        F.round(F.when(F.col("direction") == "LONG", change).otherwise(-change), 4).alias("gross_return"), D.weekdays_between(F.col("entry_date"), F.col("exit_date")).alias("holding_days"),
    )


def trade_table(trades_: DataFrame) -> DataFrame:
    """The trade log: the return also in percent (of the rounded return), by entry day."""
    return trades_.withColumn("gross_return_pct", F.round(F.col("gross_return") * 100, 2)).orderBy("entry_date", "ticker", "direction")


def equity_curve(trades_: DataFrame, capital: float = CAPITAL, by: str | None = None) -> DataFrame:
    """Capital after each exit day, compounded over all trades and held forward; a row for each weekday from the first exit to the last, for each value of `by`.

    Days are few whatever the number of trades: trades are folded to one factor a day before anything is ordered.
    """
    keys = [by] if by else []
    daily = trades_.groupBy(*keys, F.col("exit_date").alias("dt")).agg(F.product(1 + F.col("gross_return")).alias("f"))
    span = daily.groupBy(*keys).agg(F.min("dt").alias("a"), F.max("dt").alias("z")).where("a is not null").select(*keys, F.explode(F.sequence("a", "z")).alias("dt")).where(F.weekday("dt") < 5)
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    grown = span.join(daily, [*keys, "dt"], "full").select(*keys, "dt", F.coalesce("f", F.lit(1.0)).alias("f"))
    return grown.select(*keys, "dt", (capital * F.product("f").over(w)).alias("equity"))


def variants(trades_: DataFrame) -> DataFrame:
    """Trades of each variant of the strategy: long_short has all, long_only those bought."""
    return trades_.withColumn("variant", F.explode(F.when(F.col("direction") == "LONG", F.array(F.lit("long_short"), F.lit("long_only"))).otherwise(F.array(F.lit("long_short")))))


def numbered(df: DataFrame, by: list[str], order: list[str], into: str) -> DataFrame:
    """df with the place of each row among those of the same `by`, from 1, without putting any of these groups into one task: rows are spread by ranges of
    the order, and each range's first place is told by how many rows the ranges before it hold."""
    spread_ = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    x = stage(spread_.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "numbered")
    runs = x.groupBy("_range", *by).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n"))
    runs = F.broadcast(runs) if small_enough(runs, RUNS) else runs
    return x.join(runs, ["_range", *by]).withColumn(into, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_range", "_first", "_n", "_before")


def by_slice(trades_: DataFrame) -> DataFrame:
    return trades_.withColumn("slice", F.explode(F.array(F.lit("overall"), F.lower("direction"))))


def hit_statistics(trades_: DataFrame) -> DataFrame:
    """Counts, hit rate, mean return, mean win and loss, and their ratio, overall and by direction. A return of 0 is a loss; empty means are 0."""
    r = F.col("gross_return")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = by_slice(trades_).groupBy("slice").agg(F.count("*").alias("trades"), F.count_if(r > 0).alias("winners"), zero(F.avg((r > 0).cast("double"))).alias("hit_rate"), zero(F.avg(r)).alias("avg_return"), zero(F.avg(F.when(r > 0, r))).alias("avg_win"), zero(F.avg(F.when(r <= 0, r))).alias("avg_loss"))
    return g.withColumn("win_loss_ratio", F.coalesce(F.try_divide(F.col("avg_win"), F.abs("avg_loss")), F.lit(0.0)))


def information_coefficient(trades_: DataFrame, by: str | None = None) -> DataFrame:
    """Rank correlation of score and return, with ties by their order, for each value of `by` (one row without); 0 below five trades. And Pearson's correlation of average ranks, where ties count as such."""
    x = trades_.select((F.col(by) if by else F.lit("")).alias("_by"), "quality_score", "gross_return", "entry_date", "ticker", "direction")
    x = numbered(numbered(x, ["_by"], ["quality_score", "entry_date", "ticker", "direction"], "a"), ["_by"], ["gross_return", "entry_date", "ticker", "direction"], "b")
    x = stage(x.select("_by", "quality_score", "gross_return", "a", "b"), "ranks")
    tied = lambda value, rank: x.groupBy("_by", value).agg(((F.min(rank) + F.max(rank)) / 2).alias(f"t{rank}"))
    x = x.join(tied("quality_score", "a"), ["_by", "quality_score"]).join(tied("gross_return", "b"), ["_by", "gross_return"])
    g = x.groupBy("_by").agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("d"), F.corr("ta", "tb").alias("tied"))
    if not by:  # a row even without trades
        g = g.groupBy().agg(*[F.max(c).alias(c) for c in ("_by", "n", "d", "tied")])
    ic = F.when(F.col("n") >= 5, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 6 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1))))).otherwise(0.0)
    return g.select(*([F.col("_by").alias(by)] if by else []), ic.alias("ic"), F.coalesce("tied", F.lit(0.0)).alias("ic_with_ties"))


def _returns(curve: DataFrame, by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy("dt")
    return curve.select(*keys, "dt", "equity", (F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).alias("r"), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


def curve_statistics(curve: DataFrame, by: str | None = None) -> DataFrame:
    """Annual return, Sharpe ratio (0 below 20 returns or without spread) and largest drawdown of a curve (dt, equity), for each value of `by`."""
    keys = [by] if by else []
    x = _returns(curve, by)
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("equity", "dt").alias("first"), F.max_by("equity", "dt").alias("last"), F.count("r").alias("m"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.max(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))).alias("drawdown"))
    sharpe = F.when((F.col("m") >= 20) & (F.col("sd") > 0), (F.col("mean") - RISK_FREE / YEAR) / F.col("sd") * F.sqrt(F.lit(YEAR))).otherwise(0.0)
    annual = F.when(F.col("n") >= 2, F.pow(F.greatest(F.lit(0.0), F.try_divide(F.col("last"), F.col("first"))), YEAR / F.col("n")) - 1).otherwise(0.0)
    return g.select(*keys, annual.alias("annual_return"), sharpe.alias("sharpe"), F.coalesce("drawdown", F.lit(0.0)).alias("max_drawdown"))


def slice_metrics(trades_: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """A row of metrics for overall, long and short (and benchmark, with its curve's alone), each from its own trades, curve and ranks; rounded as they are reported."""
    x = stage(by_slice(trades_), "slices")
    joined = hit_statistics(trades_).join(curve_statistics(equity_curve(x, by="slice"), "slice"), "slice").join(information_coefficient(x, "slice"), "slice")
    r = lambda c, n: F.round(F.round(c, 9), n).alias(c)  # noqa: E731  # what differs by the order of a sum alone is the same number
    columns = [r("sharpe", 3), r("max_drawdown", 4), r("annual_return", 4)]
    out = joined.select("slice", "trades", r("hit_rate", 4), r("avg_return", 5), r("avg_win", 5), r("avg_loss", 5), r("win_loss_ratio", 3), r("ic", 4), *columns)
    if benchmark is None:
        return out
    return out.unionByName(curve_statistics(benchmark).select(F.lit("benchmark").alias("slice"), *columns), allowMissingColumns=True)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """slice and its metrics as lines of text: shares in percent, other numbers to three places."""
    shown = lambda c: F.format_string("%.1f%%", F.col(c) * 100) if "rate" in c or "return" in c or "drawdown" in c else F.format_string("%.3f", c)
    kinds = dict(metrics.dtypes)
    lines = [F.concat(F.rpad(F.lit(c), 18, " "), shown(c) if kinds[c] == "double" else F.col(c).cast("string")) for c in metrics.columns if c != "slice"]
    return metrics.select("slice", F.concat_ws("\n", F.upper("slice"), *lines).alias("text"))


def benchmark_comparison(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Tracking error, information ratio, beta, alpha and captures of the strategy against the benchmark (both dt, equity); no row below 20 common days."""
    w = Window.orderBy("dt")
    held = lambda c: F.last(c, ignorenulls=True).over(w)  # noqa: E731  # a day without a value has the one before
    both = curve.join(benchmark.select("dt", F.col("equity").alias("base")), "dt").select("dt", held("equity").alias("equity"), held("base").alias("base"))
    d = both.select((F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).alias("s"), (F.try_divide(F.col("base"), F.lag("base").over(w)) - 1).alias("b")).where("s is not null and b is not null")
    ratio = lambda up: F.try_divide(F.avg(F.when(up, F.col("s"))), F.avg(F.when(up, F.col("b"))))
    g = d.agg(F.count("*").alias("days"), F.avg("s").alias("ms"), F.avg("b").alias("mb"), F.stddev_pop(F.col("s") - F.col("b")).alias("te"), F.covar_samp("s", "b").alias("cov"), F.var_samp("b").alias("var"), ratio(F.col("b") > 0).alias("up"), ratio(F.col("b") < 0).alias("down"))
    beta = F.coalesce(F.try_divide("cov", "var"), F.lit(1.0))
    te = F.col("te") * F.sqrt(F.lit(YEAR))
    return g.where("days >= 20").select("days", te.alias("tracking_error"), F.coalesce(F.try_divide((F.col("ms") - F.col("mb")) * YEAR, te), F.lit(0.0)).alias("information_ratio"), beta.alias("beta"), ((F.col("ms") - beta * F.col("mb")) * YEAR).alias("alpha"), F.coalesce("up", F.lit(0.0)).alias("up_capture"), F.coalesce("down", F.lit(0.0)).alias("down_capture"))


def benchmark_curve(prices: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Mean close of each day, scaled to the capital on the first."""
    d = prices.groupBy("dt").agg(F.avg("close").alias("c"))
    return d.select("dt", (F.col("c") / F.first("c").over(Window.orderBy("dt")) * capital).alias("equity"))


def return_histogram(trades_: DataFrame, low: float = -60.0, high: float = 60.0, bins: int = 30) -> DataFrame:
    """Trades by bin of their return in percent; beyond the ends in bins 0 and bins + 1."""
    return trades_.groupBy(F.width_bucket(F.col("gross_return") * 100, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("trades"))


def equity_levels(curve: DataFrame) -> DataFrame:
    """The curve with its running peak and drawdown."""
    x = _returns(curve)
    return x.select("dt", "equity", "peak", F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")).alias("drawdown"))
