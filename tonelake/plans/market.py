"""Queries on signals, trades, vectors, pairs, evaluation and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonelake.functions import dates as D
from tonelake.functions import labels, numbers
from tonelake.functions import text as T
from tonelake.operators import backtest, chunking, evaluation, models, pairs, qa, sentiment, vectors
from tonelake.plans import expected as E
from tonelake.plans import pipeline
from tonelake.plans.catalog import query, table
from tonelake.plans.texts import SECTIONS, TURNS
from tonelake.plans.tone import CHUNKS, SCORES, _chunks, rounded
from tonelake.sources import tables
from tonelake.storage import spread, stage

_HALF_UP = "CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"  # rounds the shortest decimal form, as Spark does
WINDOW = ("1995-01-01", "2001-12-31")
RUNS = """runs AS (
  SELECT 'S' || (o_custkey % 20) AS ticker, 'Q' || quarter(o_orderdate) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS run, CAST(max(o_orderdate) AS VARCHAR)[:10] AS computed_at,
    (CAST(sum(o_orderkey) AS BIGINT) % 2001 - 1000) / 1000.0 AS composite_score FROM orders GROUP BY ALL),
scores AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY ticker, quarter, year ORDER BY computed_at DESC, composite_score DESC) = 1)"""
PRICES = """prices AS (
  SELECT 'S' || (l_suppkey % 20) AS ticker, CAST(l_shipdate AS DATE) AS dt, CAST(100 + sum(CAST(l_quantity AS BIGINT)) % 11 AS DOUBLE) AS open, CAST(100 + sum(l_linenumber) % 11 AS DOUBLE) AS close
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY ALL)"""
SIGNALS = f"""{RUNS}, s1 AS (
  SELECT *, make_date(year + CASE WHEN quarter = 'Q4' THEN 1 ELSE 0 END, CASE quarter WHEN 'Q1' THEN 4 WHEN 'Q2' THEN 7 WHEN 'Q3' THEN 10 WHEN 'Q4' THEN 1 ELSE 2 END, 15) AS signal_date,
    CASE WHEN composite_score > 0.3 THEN 'LONG' WHEN composite_score < -0.3 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction FROM scores),
s2 AS (SELECT *, signal_date + 1 + CASE isodow(signal_date + 1) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS entry_date FROM s1 WHERE direction <> 'NEUTRAL' AND signal_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'),
signals AS (SELECT ticker, quarter, year, direction, composite_score AS quality_score, signal_date, CAST(entry_date AS DATE) AS entry_date, CAST(entry_date + 28 AS DATE) AS exit_date FROM s2)"""
TRADES = f"""{SIGNALS}, {PRICES},
entries AS (SELECT s.ticker, s.entry_date, arg_min(open, dt) AS entry_price FROM (SELECT DISTINCT ticker, entry_date FROM signals) s JOIN prices p ON p.ticker = s.ticker AND p.dt BETWEEN s.entry_date AND s.entry_date + 4 GROUP BY ALL),
exits AS (SELECT s.ticker, s.exit_date, arg_min(close, dt) AS exit_price FROM (SELECT DISTINCT ticker, exit_date FROM signals) s JOIN prices p ON p.ticker = s.ticker AND p.dt BETWEEN s.exit_date AND s.exit_date + 4 GROUP BY ALL),
trades AS (
  SELECT ticker, direction, signal_date, entry_date, exit_date, {_HALF_UP.format(x='entry_price', n=2)} AS entry_price, {_HALF_UP.format(x='exit_price', n=2)} AS exit_price, quality_score,
    {_HALF_UP.format(x="CASE WHEN direction = 'LONG' THEN (exit_price - entry_price) / entry_price ELSE -((exit_price - entry_price) / entry_price) END", n=4)} + 0.0 AS gross_return, 21 AS holding_days
  FROM signals JOIN entries USING (ticker, entry_date) JOIN exits USING (ticker, exit_date) WHERE entry_price > 0)"""
CURVE = f"""{TRADES},
daily AS (SELECT exit_date AS dt, product(1 + gross_return) AS f FROM trades GROUP BY exit_date),
span AS (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM daily),
grown AS (SELECT coalesce(span.dt, daily.dt) AS dt, coalesce(f, 1.0) AS f FROM (SELECT dt FROM span WHERE isodow(dt) < 6) span FULL JOIN daily ON span.dt = daily.dt),
curve AS (SELECT dt, 100000.0 * product(f) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS equity FROM grown),
moves AS (SELECT dt, equity, equity / lag(equity) OVER (ORDER BY dt) - 1 AS r, max(equity) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM curve)"""


def _runs(spark, folder):
    o = table(spark, folder, "orders")
    q = F.concat(F.lit("Q"), F.quarter("o_orderdate"))
    return o.groupBy(F.concat(F.lit("S"), F.col("o_custkey") % 20).alias("ticker"), q.alias("quarter"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("run")).agg(
        F.substring(F.max("o_orderdate").cast("string"), 1, 10).alias("computed_at"), ((F.sum("o_orderkey") % 2001 - 1000) / 1000.0).alias("composite_score")
    )


def _signals(spark, folder):
    return backtest.signals(_runs(spark, folder), None, *WINDOW)


def _prices(spark, folder):
    return tables.prices(table(spark, folder, "lineitem"))


def _trades(spark, folder):
    return backtest.trades(_signals(spark, folder), stage(_prices(spark, folder), "prices"))


def _curve(spark, folder):
    return backtest.equity_curve(_trades(spark, folder))


def plain(df):
    """Days as text, so that both engines give them alike."""
    return rounded(df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes]))


@query(f"WITH {RUNS} SELECT ticker, quarter, year, run, round(composite_score, 6) + 0.0 AS composite_score FROM scores")
def latest_run_dedup(spark, folder):
    return rounded(backtest.latest_run(_runs(spark, folder)).drop("computed_at"))


@query(f"WITH {RUNS} SELECT ticker, quarter, year, run, CASE WHEN composite_score > 0.3 THEN 'LONG' WHEN composite_score < -0.3 THEN 'SHORT' ELSE 'NEUTRAL' END AS signal FROM runs")
def signal_classify(spark, folder):
    return _runs(spark, folder).select("ticker", "quarter", "year", "run", labels.signal(F.col("composite_score")).alias("signal"))


@query(f"WITH {SIGNALS} SELECT ticker, quarter, year, direction, round(quality_score, 6) + 0.0 AS quality_score, CAST(signal_date AS VARCHAR) AS signal_date, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date FROM signals")
def signals(spark, folder):
    return plain(_signals(spark, folder))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-03-01', INTERVAL 1 DAY)) AS DATE) AS x)
SELECT CAST(d AS VARCHAR) AS day, CAST((SELECT min(x) FROM c WHERE x >= d AND isodow(x) < 6) AS VARCHAR) AS trading_day,
  CAST((SELECT max(x) FROM (SELECT x FROM c WHERE x > d AND isodow(x) < 6 ORDER BY x LIMIT 20)) AS VARCHAR) AS plus20,
  CAST((SELECT count(*) FROM c WHERE x BETWEEN d AND d + 28 AND isodow(x) < 6) AS INTEGER) AS weekdays FROM d""")
def trading_calendar(spark, folder):
    d = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return plain(d.select(F.col("d").alias("day"), D.next_trading_day(F.col("d")).alias("trading_day"), D.add_trading_days(F.col("d"), 20).alias("plus20"), D.weekdays_between(F.col("d"), F.date_add("d", 28)).alias("weekdays")))


@query(f"""WITH {PRICES}, w AS (SELECT DISTINCT 'S' || (o_custkey % 20) AS ticker, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT w.ticker, CAST(day AS VARCHAR) AS day, round(arg_min(open, dt), 6) + 0.0 AS open FROM w LEFT JOIN prices p ON p.ticker = w.ticker AND dt BETWEEN day AND day + 4 GROUP BY w.ticker, day""")
def price_asof_forward(spark, folder):
    days = table(spark, folder, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 20).alias("ticker"), F.to_date("o_orderdate").alias("day")).distinct()
    return plain(backtest.price_on_or_after(days, _prices(spark, folder), "open"))


@query(f"WITH {TRADES} SELECT ticker, direction, CAST(signal_date AS VARCHAR) AS signal_date, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, entry_price + 0.0 AS entry_price, exit_price + 0.0 AS exit_price, round(quality_score, 6) + 0.0 AS quality_score, gross_return, holding_days FROM trades")
def trades(spark, folder):
    return plain(_trades(spark, folder))


@query(f"WITH {CURVE} SELECT CAST(dt AS VARCHAR) AS dt, round(ln(equity), 6) + 0.0 AS log_equity, round((peak - equity) / peak, 6) + 0.0 AS drawdown FROM moves")
def equity_curve(spark, folder):
    return plain(backtest.equity_levels(_curve(spark, folder)).select("dt", F.log("equity").alias("log_equity"), "drawdown"))


@query(f"""WITH {TRADES}, x AS (SELECT 'overall' AS slice, gross_return AS r FROM trades UNION ALL SELECT lower(direction), gross_return FROM trades),
g AS (SELECT slice, count(*) AS trades, count(*) FILTER (WHERE r > 0) AS winners, coalesce(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 0) AS hit_rate, coalesce(avg(r), 0) AS avg_return, coalesce(avg(r) FILTER (WHERE r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (WHERE r <= 0), 0) AS avg_loss FROM x GROUP BY slice)
SELECT slice, trades, winners, round(hit_rate, 6) + 0.0 AS hit_rate, round(avg_return, 6) + 0.0 AS avg_return, round(avg_win, 6) + 0.0 AS avg_win, round(avg_loss, 6) + 0.0 AS avg_loss, round(coalesce(avg_win / nullif(abs(avg_loss), 0), 0), 6) + 0.0 AS win_loss_ratio FROM g""")
def hit_rate_by_direction(spark, folder):
    return rounded(backtest.hit_statistics(_trades(spark, folder)))


@query(f"""WITH {TRADES}, x AS (SELECT quality_score, gross_return, row_number() OVER (ORDER BY quality_score, entry_date, ticker, direction) AS a, row_number() OVER (ORDER BY gross_return, entry_date, ticker, direction) AS b FROM trades),
t AS (SELECT a, b, avg(a) OVER (PARTITION BY quality_score) AS ta, avg(b) OVER (PARTITION BY gross_return) AS tb FROM x)
SELECT round(CASE WHEN count(*) >= 5 THEN greatest(-1, least(1, 1 - 6 * sum(pow(a - b, 2)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)))) ELSE 0 END, 6) + 0.0 AS ic, round(coalesce(corr(ta, tb), 0), 6) + 0.0 AS ic_with_ties FROM t""")
def information_coefficient(spark, folder):
    return rounded(backtest.information_coefficient(_trades(spark, folder)))


@query(f"""WITH {CURVE} SELECT round(CASE WHEN count(*) >= 2 THEN pow(greatest(0, arg_max(equity, dt) / arg_min(equity, dt)), 252.0 / count(*)) - 1 ELSE 0 END, 6) + 0.0 AS annual_return,
  round(CASE WHEN count(r) >= 20 AND stddev_samp(r) > 0 THEN (avg(r) - 0.045 / 252) / stddev_samp(r) * sqrt(252) ELSE 0 END, 6) + 0.0 AS sharpe, round(max((peak - equity) / peak), 6) + 0.0 AS max_drawdown FROM moves""")
def curve_statistics(spark, folder):
    return rounded(backtest.curve_statistics(_curve(spark, folder)))


_SLICED = f"""{TRADES}, x AS (SELECT 'overall' AS slice, * FROM trades UNION ALL SELECT lower(direction), * FROM trades),
daily AS (SELECT slice, exit_date AS dt, product(1 + gross_return) AS f FROM x GROUP BY ALL),
span AS (SELECT slice, CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM daily GROUP BY slice),
grown AS (SELECT coalesce(span.slice, daily.slice) AS slice, coalesce(span.dt, daily.dt) AS dt, coalesce(f, 1.0) AS f FROM (SELECT * FROM span WHERE isodow(dt) < 6) span FULL JOIN daily ON span.dt = daily.dt AND span.slice = daily.slice),
curve AS (SELECT slice, dt, 100000.0 * product(f) OVER (PARTITION BY slice ORDER BY dt ROWS UNBOUNDED PRECEDING) AS equity FROM grown),
moves AS (SELECT slice, dt, equity, equity / lag(equity) OVER w - 1 AS r, max(equity) OVER (PARTITION BY slice ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM curve WINDOW w AS (PARTITION BY slice ORDER BY dt)),
cs AS (SELECT slice, CASE WHEN count(*) >= 2 THEN pow(greatest(0, arg_max(equity, dt) / arg_min(equity, dt)), 252.0 / count(*)) - 1 ELSE 0 END AS annual_return,
  CASE WHEN count(r) >= 20 AND stddev_samp(r) > 0 THEN (avg(r) - 0.045 / 252) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe, max((peak - equity) / peak) AS max_drawdown FROM moves GROUP BY slice),
h AS (SELECT slice, count(*) AS trades, avg(CASE WHEN gross_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(gross_return) AS avg_return, coalesce(avg(gross_return) FILTER (WHERE gross_return > 0), 0) AS avg_win, coalesce(avg(gross_return) FILTER (WHERE gross_return <= 0), 0) AS avg_loss FROM x GROUP BY slice),
rk AS (SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY quality_score, entry_date, ticker, direction) AS a, row_number() OVER (PARTITION BY slice ORDER BY gross_return, entry_date, ticker, direction) AS b FROM x),
i AS (SELECT slice, CASE WHEN count(*) >= 5 THEN greatest(-1, least(1, 1 - 6 * sum(pow(a - b, 2)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)))) ELSE 0 END AS ic FROM rk GROUP BY slice)"""


_REPORTED = lambda x, n, name: _HALF_UP.format(x=f"round({x}, 9)", n=n) + f" + 0.0 AS {name}"


@query(f"""WITH {_SLICED} SELECT slice, trades, {_REPORTED('hit_rate', 4, 'hit_rate')}, {_REPORTED('avg_return', 5, 'avg_return')}, {_REPORTED('avg_win', 5, 'avg_win')}, {_REPORTED('avg_loss', 5, 'avg_loss')},
  {_REPORTED('coalesce(avg_win / nullif(abs(avg_loss), 0), 0)', 3, 'win_loss_ratio')}, {_REPORTED('ic', 4, 'ic')}, {_REPORTED('sharpe', 3, 'sharpe')}, {_REPORTED('max_drawdown', 4, 'max_drawdown')}, {_REPORTED('annual_return', 4, 'annual_return')} FROM h JOIN cs USING (slice) JOIN i USING (slice)""")
def slice_metrics(spark, folder):
    return rounded(backtest.slice_metrics(_trades(spark, folder)))


@query()
def metrics_text(spark, folder):
    return backtest.metrics_text(backtest.slice_metrics(_trades(spark, folder), backtest.benchmark_curve(_prices(spark, folder))))


@query(f"""WITH {_SLICED} SELECT CASE slice WHEN 'overall' THEN 'long_short' ELSE 'long_only' END AS variant, CAST(dt AS VARCHAR) AS dt, round(ln(equity), 6) + 0.0 AS log_equity FROM curve WHERE slice <> 'short'""")
def variant_curves(spark, folder):
    v = backtest.variants(_trades(spark, folder))
    return plain(backtest.equity_curve(v, by="variant").select("variant", "dt", F.log("equity").alias("log_equity")))


@query(f"WITH {TRADES} SELECT ticker, direction, CAST(entry_date AS VARCHAR) AS entry_date, gross_return, round(gross_return * 100, 2) + 0.0 AS gross_return_pct FROM trades")
def trade_table(spark, folder):
    return plain(backtest.trade_table(_trades(spark, folder)).select("ticker", "direction", "entry_date", "gross_return", "gross_return_pct"))


_LATE = SIGNALS.replace("make_date(year + CASE WHEN quarter = 'Q4'", "CASE WHEN quarter = 'Q2' THEN make_date(year, 7, 20) ELSE make_date(year + CASE WHEN quarter = 'Q4'").replace("ELSE 2 END, 15) AS signal_date", "ELSE 2 END, 15) END AS signal_date")


@query(f"WITH {_LATE} SELECT ticker, quarter, year, direction, CAST(signal_date AS VARCHAR) AS signal_date, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date FROM signals")
def signals_announced(spark, folder):
    """Known announcement days go before estimates: here of all second quarters, on the 20th of July."""
    runs = _runs(spark, folder)
    known = runs.where("quarter = 'Q2'").select("ticker", "quarter", "year", F.make_date("year", F.lit(7), F.lit(20)).alias("announced_on")).distinct()
    return plain(backtest.signals(runs, known, *WINDOW).drop("quality_score"))


@query(f"""WITH {CURVE}, bp AS (SELECT dt, avg(close) AS c FROM prices GROUP BY dt), bench AS (SELECT dt, c / first(c) OVER (ORDER BY dt) * 100000.0 AS base FROM bp),
both_ AS (SELECT curve.dt, equity, base FROM curve JOIN bench USING (dt)), d AS (SELECT equity / lag(equity) OVER (ORDER BY dt) - 1 AS s, base / lag(base) OVER (ORDER BY dt) - 1 AS b FROM both_),
g AS (SELECT count(*) AS days, avg(s) AS ms, avg(b) AS mb, stddev_pop(s - b) * sqrt(252) AS te, covar_samp(s, b) / var_samp(b) AS beta, avg(s) FILTER (WHERE b > 0) / avg(b) FILTER (WHERE b > 0) AS up, avg(s) FILTER (WHERE b < 0) / avg(b) FILTER (WHERE b < 0) AS down FROM d WHERE s IS NOT NULL AND b IS NOT NULL)
SELECT days, round(te, 6) + 0.0 AS tracking_error, round((ms - mb) * 252 / te, 6) + 0.0 AS information_ratio, round(beta, 6) + 0.0 AS beta, round((ms - beta * mb) * 252, 6) + 0.0 AS alpha, round(up, 6) + 0.0 AS up_capture, round(down, 6) + 0.0 AS down_capture FROM g WHERE days >= 20""")
def benchmark_compare(spark, folder):
    return rounded(backtest.benchmark_comparison(_curve(spark, folder), backtest.benchmark_curve(_prices(spark, folder))))


@query(f"WITH {TRADES} SELECT CAST(CASE WHEN gross_return * 100 < -12.05 THEN 0 WHEN gross_return * 100 >= 12.05 THEN 31 ELSE floor((gross_return * 100 + 12.05) / 24.1 * 30) + 1 END AS INTEGER) AS bin, count(*) AS trades FROM trades GROUP BY bin")
def return_histogram(spark, folder):
    return backtest.return_histogram(_trades(spark, folder), -12.05, 12.05)


# --- vectors: queries are the rows whose id is divisible by 20, against all rows

_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


def _vectors(spark, folder):
    v = table(spark, folder, "embeddings")
    return v, v.where("vec_id % 20 = 0")


def _top(where: str, k: int = 10, more: str = "") -> str:
    return f"""SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id{more} ORDER BY round({_COS}, 12) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON {where} WHERE q.vec_id % 20 = 0) WHERE rank <= {k}"""


@query(_top("c.vec_id <> q.vec_id"))
def vector_topk(spark, folder):
    v, q = _vectors(spark, folder)
    return rounded(vectors.top_k(v, q, "vec_id", "embedding"))


@query(_top("c.vec_id <> q.vec_id AND c.label = q.label"))
def vector_topk_filtered(spark, folder):
    v, q = _vectors(spark, folder)
    return rounded(vectors.top_k(v, q, "vec_id", "embedding", group="label"))


@query(_top("c.label IN (3, 5) AND c.vec_id <> q.vec_id"))
def vector_topk_metadata(spark, folder):
    v, q = _vectors(spark, folder)
    return rounded(vectors.top_k(v.where(vectors.metadata_filter(label=[3, 5])), q, "vec_id", "embedding"))


@query()
def vector_topk_indexed(spark, folder):
    v, q = _vectors(spark, folder)
    return rounded(vectors.indexed_top_k(v, q, "vec_id", "embedding"))


@query(f"""SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id, c.label ORDER BY round({_COS}, 12) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id AND c.label IN ((q.label + 1) % 10, (q.label + 2) % 10, (q.label + 3) % 10) WHERE q.vec_id % 20 = 0) WHERE rank <= 3""")
def peer_topk(spark, folder):
    v, q = _vectors(spark, folder)
    parts = [vectors.top_k(v.withColumn("g", F.col("label")), q.withColumn("g", (F.col("label") + i) % 10), "vec_id", "embedding", 3, "g") for i in (1, 2, 3)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"""SELECT CAST(q.label AS VARCHAR) AS g, q.vec_id AS a, c.vec_id AS b, round({_COS}, 6) + 0.0 AS similarity FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 4 < c.vec_id % 4 WHERE {_COS} >= 0.25""")
def similarity_pairs(spark, folder):
    v = table(spark, folder, "embeddings").withColumn("period", F.col("vec_id") % 4).withColumn("words", F.lit(30))
    return rounded(vectors.similar_pairs(v, "vec_id", "embedding", "label", "period", "words", 0.25))


_PAIRS = f"""{SECTIONS}, {TURNS},
fl AS (SELECT accession_number, upper(trim(ticker)) AS ticker, filing_type AS form, coalesce(quarter, 'Q' || quarter(period_of_report)) AS quarter, coalesce(year, year(period_of_report)) AS year FROM filings WHERE raw_text <> '' QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY loaded_at) = 1),
tc AS (SELECT transcript_id, upper(trim(ticker)) AS ticker, quarter, year FROM transcripts WHERE raw_text <> '' QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY loaded_at) = 1),
sec AS (SELECT accession_number, section, string_agg(body, chr(10) || chr(10) ORDER BY n) AS body FROM kind WHERE many = 1 OR (n > 1 AND length(body) > 200) GROUP BY accession_number, section),
opened AS (SELECT transcript_id, min(turn_index) AS start FROM t WHERE turn_index > 0 AND (regexp_matches(body, '(?i)\\b(?:question.and.answer|q\\s?&\\s?a session|questions and answers|q&a)\\b') OR role = 'Analyst' OR (role = 'Operator' AND turn_index > 2)) GROUP BY 1),
k AS (SELECT accession_number || ' ' || section AS chunk_id, ticker, quarter, year, form, CASE WHEN regexp_matches(body, '{E.KEYWORDS}') THEN 'guidance' ELSE section END AS section FROM sec JOIN fl USING (accession_number)
  UNION ALL SELECT 'call ' || transcript_id || ' ' || turn_index, ticker, quarter, year, 'transcript', CASE WHEN regexp_matches(body, '{E.KEYWORDS}') THEN 'guidance' WHEN turn_index >= start THEN 'qa' ELSE 'prepared_remarks' END FROM t JOIN tc USING (transcript_id) LEFT JOIN opened USING (transcript_id)),
p AS (
  SELECT a.ticker, a.chunk_id AS a, b.chunk_id AS b, row_number() OVER (PARTITION BY a.ticker ORDER BY a.chunk_id, b.chunk_id) AS n
  FROM k a JOIN k b ON a.ticker = b.ticker AND a.quarter = b.quarter AND a.year = b.year AND a.form = 'transcript' AND a.section IN ('prepared_remarks', 'guidance') AND b.form IN ('10-Q', '10-K') AND b.section IN ('mda', 'guidance'))"""


def _spoken(spark, folder):
    """Sections of filings and turns of calls as chunks, those with a guidance keyword in the guidance section."""
    columns = ["chunk_id", "k.ticker", "k.quarter", "k.year", "k.form", "section", F.col("body").alias("text")]
    f = spread(tables.filing_texts(table(spark, folder, "filings"))).withColumn("k", F.struct("accession_number", "ticker", "form", "quarter", "year"))
    f = chunking.merged_sections(f, "k").withColumn("chunk_id", F.concat_ws(" ", "k.accession_number", "section")).select(*columns)
    c = spread(tables.call_texts(table(spark, folder, "transcripts"))).withColumn("k", F.struct("transcript_id", "ticker", F.lit("transcript").alias("form"), "quarter", "year"))
    c = chunking.first_question(chunking.line_turns(c, "k"), "k").withColumn("chunk_id", F.concat_ws(" ", F.lit("call"), "k.transcript_id", "turn_index")).select(*columns)
    spoken = f.unionByName(c).withColumn("section", F.when(T.has_guidance_keyword(F.col("text")), "guidance").otherwise(F.col("section"))).drop("text")
    return stage(spoken, "spoken")  # both sides of the pairs; made once


@query(f"WITH {_PAIRS} SELECT ticker, a, b FROM p WHERE n <= 500")
def intra_period_pairs(spark, folder):
    """The first 500 of a company, as the SQL says; intra_period_pairs_all has every pair."""
    return pairs.intra_period_pairs(_spoken(spark, folder), most=pairs.MOST_PAIRS).select("ticker", "a", "b")


@query(f"WITH {_PAIRS} SELECT ticker, a, b FROM p")
def intra_period_pairs_all(spark, folder):
    return pairs.intra_period_pairs(_spoken(spark, folder)).select("ticker", "a", "b")


@query("""WITH u AS (SELECT 'T' || label AS ticker, vec_id AS a, (vec_id * 7 + 3) % 500 AS b, 0 AS source FROM embeddings UNION ALL SELECT 'T' || label, (vec_id * 7 + 3) % 500, vec_id, 1 FROM embeddings),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ticker, least(a, b), greatest(a, b) ORDER BY source, a, b) = 1)
SELECT ticker, a, b, source, CAST(row_number() OVER (PARTITION BY ticker ORDER BY source, a, b) AS INTEGER) AS n FROM o QUALIFY n <= 20""")
def pair_dedup_cap(spark, folder):
    e = table(spark, folder, "embeddings").select(F.concat(F.lit("T"), "label").alias("ticker"), F.col("vec_id").alias("x"), ((F.col("vec_id") * 7 + 3) % 500).alias("y"))
    u = e.select("ticker", F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("source")).unionByName(e.select("ticker", F.col("y").alias("a"), F.col("x").alias("b"), F.lit(1).alias("source")))
    return pairs.capped(u, 20)


@query("""WITH u AS (SELECT 'T' || label AS ticker, vec_id AS a, vec_id * 7 + 3 AS b, 0 AS source FROM embeddings UNION ALL SELECT 'T' || label, vec_id * 7 + 3, vec_id, 1 FROM embeddings)
SELECT ticker, a, b, source FROM u QUALIFY row_number() OVER (PARTITION BY ticker, least(a, b), greatest(a, b) ORDER BY source, a, b) = 1""")
def pair_dedup(spark, folder):
    """Every distinct pair, with partners from all ids."""
    e = table(spark, folder, "embeddings").select(F.concat(F.lit("T"), "label").alias("ticker"), F.col("vec_id").alias("x"), (F.col("vec_id") * 7 + 3).alias("y"))
    u = e.select("ticker", F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("source")).unionByName(e.select("ticker", F.col("y").alias("a"), F.col("x").alias("b"), F.lit(1).alias("source")))
    return pairs.distinct_pairs(u)


@query(f"""WITH {CHUNKS}, {SCORES} SELECT ticker, chunk_id AS a, round(negative, 6) + 0.0 AS contradiction, CAST(row_number() OVER (PARTITION BY ticker ORDER BY negative DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE negative >= 0.5""")
def contradictions(spark, folder):
    s = sentiment.scored(_chunks(spark, folder)).select("ticker", F.col("chunk_id").alias("a"), F.col("chunk_id").alias("b"), F.col("negative").alias("contradiction"))
    return rounded(pairs.contradictions(s, 0.5).drop("b"))


@query("SELECT s.vec_id, coalesce(n.label, s.label) AS label FROM embeddings s LEFT JOIN (SELECT vec_id, max(label) + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1) n USING (vec_id) UNION ALL SELECT 100000 + vec_id, label FROM embeddings WHERE vec_id % 7 = 0")
def upsert_latest(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(v.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 100000))
    return vectors.upsert(v, new, "vec_id")


@query("SELECT upper(trim(ticker)) AS ticker FROM companies WHERE upper(trim(ticker)) NOT IN (SELECT upper(trim(ticker)) FROM documents WHERE ticker IS NOT NULL AND year = 2020)")
def watchlist_anti(spark, folder):
    seen = table(spark, folder, "documents").where("ticker is not null and year = 2020").select(tables.ticker().alias("ticker"))
    return table(spark, folder, "companies").select(tables.ticker().alias("ticker")).join(seen, "ticker", "left_anti")


# --- evaluation, calendars, labels

EVALS = "e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 101 / 100.0 END AS faithfulness, doc_id % 97 / 96.0 AS answer_relevance, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 89 / 88.0 END AS context_precision, doc_id % 83 / 82.0 AS context_recall FROM documents)"


def _evals(spark, folder):
    i = F.col("doc_id")
    part = lambda m: i % m / F.lit(float(m - 1))
    return table(spark, folder, "documents").select("doc_id", F.when(i % 7 != 0, part(101)).alias("faithfulness"), part(97).alias("answer_relevance"), F.when(i % 5 != 0, part(89)).alias("context_precision"), part(83).alias("context_recall"))


_LONG = "l AS (UNPIVOT e ON faithfulness, answer_relevance, context_precision, context_recall INTO NAME metric VALUE value)"


@query(f"WITH {EVALS}, {_LONG} SELECT metric, round(avg(value), 4) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 4) + 0.0 AS std, round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max, count(*) AS count FROM l GROUP BY metric")
def eval_summary(spark, folder):
    return rounded(evaluation.summary(_evals(spark, folder), "doc_id"))


@query(f"WITH {EVALS} SELECT doc_id, round((coalesce(faithfulness, 0) + answer_relevance + coalesce(context_precision, 0) + context_recall) / (2 + CASE WHEN faithfulness IS NULL THEN 0 ELSE 1 END + CASE WHEN context_precision IS NULL THEN 0 ELSE 1 END), 6) + 0.0 AS mean_score FROM e")
def mean_score(spark, folder):
    return rounded(evaluation.with_mean(_evals(spark, folder)).select("doc_id", "mean_score"))


@query(f"WITH {EVALS}, {_LONG} SELECT doc_id, metric, round(value, 6) + 0.0 AS value FROM l")
def metrics_unpivot(spark, folder):
    return rounded(evaluation.to_long(_evals(spark, folder), "doc_id"))


@query(f"WITH {EVALS}, m AS (SELECT (coalesce(faithfulness, 0) + answer_relevance + coalesce(context_precision, 0) + context_recall) / (2 + CASE WHEN faithfulness IS NULL THEN 0 ELSE 1 END + CASE WHEN context_precision IS NULL THEN 0 ELSE 1 END) AS s FROM e) SELECT round(coalesce(avg(s) FILTER (WHERE s > 0), 0), 6) + 0.0 AS mean_overall, count(*) AS count FROM m")
def eval_batch_mean(spark, folder):
    return rounded(evaluation.batch_mean(_evals(spark, folder)))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 < 3 THEN 'industry' ELSE 'contradiction' END AS after_retrieval, CASE WHEN doc_id % 11 / 10.0 < 0.7 AND doc_id % 5 < 3 THEN 'company' ELSE 'ragas_prep' END AS after_grading FROM documents")
def qa_route(spark, folder):
    i = F.col("doc_id")
    a, b = evaluation.route(i % 2 == 0, i % 11 / F.lit(10.0), i % 5)
    return table(spark, folder, "documents").select("doc_id", a.alias("after_retrieval"), b.alias("after_grading"))


@query(f"""WITH {CHUNKS}, i AS (SELECT *, CASE chunk_id % 4 WHEN 0 THEN 'risk_assessment' WHEN 1 THEN 'guidance_tracking' WHEN 2 THEN 'tone_drift' ELSE 'general' END AS intent FROM chunks)
SELECT chunk_id, intent, section FROM i WHERE CASE intent WHEN 'risk_assessment' THEN section IN ('risk_factors') WHEN 'guidance_tracking' THEN section IN ('guidance') WHEN 'tone_drift' THEN section IN ('prepared_remarks', 'mda', 'qa') ELSE true END""")
def intent_filter(spark, folder):
    intent = F.element_at(F.array(*[F.lit(x) for x in ("risk_assessment", "guidance_tracking", "tone_drift", "general")]), (F.col("chunk_id") % 4 + 1).cast("int"))
    return _chunks(spark, folder).withColumn("intent", intent).where(evaluation.fits_intent(F.col("intent"), F.col("section"))).select("chunk_id", "intent", "section")


@query(f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY words DESC, chunk_id) AS rank FROM chunks)
SELECT ticker, string_agg('[SOURCE ' || rank || ': ' || concat_ws(' ', ticker, quarter, year, '-', section) || ']' || chr(10) || substring(text, 1, 600), chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY ticker""")
def context_format(spark, folder):
    return evaluation.context(evaluation.ranked(_chunks(spark, folder), "words", "ticker", 5), "ticker", 5)


@query("""SELECT DISTINCT quarter, year, CAST(last_day(make_date(year, CAST(substring(quarter, 2, 1) AS INTEGER) * 3, 1)) AS VARCHAR) AS ended,
  CASE WHEN quarter = 'Q4' THEN 'Q1 ' || (year + 1) ELSE 'Q' || (CAST(substring(quarter, 2, 1) AS INTEGER) + 1) || ' ' || year END AS next, CASE WHEN quarter = 'Q1' THEN 'Q4 ' || (year - 1) ELSE 'Q' || (CAST(substring(quarter, 2, 1) AS INTEGER) - 1) || ' ' || year END AS previous,
  CAST(least(40, (2025 * 4 + 3) - (year * 4 + CAST(substring(quarter, 2, 1) AS INTEGER) - 1) + 1) AS INTEGER) AS quarters_left FROM guidance WHERE quarter LIKE 'Q%' AND year <= 2025""")
def quarter_calendar(spark, folder):
    q, y = F.col("quarter"), F.col("year")
    label = lambda p: F.concat(p[0], F.lit(" "), p[1])
    g = table(spark, folder, "guidance").where("quarter like 'Q%' and year <= 2025").select("quarter", "year").distinct()
    return g.select("quarter", "year", D.period_end(q, y).cast("string").alias("ended"), label(D.next_period(q, y)).alias("next"), label(D.previous_period(q, y)).alias("previous"), F.size(D.quarters_between(q, y, F.lit("Q4"), F.lit(2025))).alias("quarters_left"))


@query("SELECT accession_number, max(CASE WHEN epoch(TIMESTAMP '2024-01-01') - epoch(loaded_at) > 7 * 86400 THEN 'Stale' ELSE 'Fresh' END) AS state FROM filings WHERE loaded_at IS NOT NULL GROUP BY accession_number")
def freshness(spark, folder):
    f = table(spark, folder, "filings").where("loaded_at is not null")
    return f.groupBy("accession_number").agg(F.max(labels.freshness(F.col("loaded_at").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("state"))


_ROLE = E.ROLE.format(c="s")


@query(f"WITH n AS (SELECT DISTINCT unnest(string_split(raw_text, chr(10))) AS s FROM transcripts WHERE raw_text IS NOT NULL) SELECT s AS line, {_ROLE} AS role FROM n WHERE length(s) < 80")
def speaker_role(spark, folder):
    lines = table(spark, folder, "transcripts").where("raw_text is not null").select(F.explode(F.split("raw_text", "\n")).alias("line")).distinct()
    return lines.where("length(line) < 80").select("line", T.speaker_role(F.col("line")).alias("role"))


@query(f"WITH n AS (SELECT DISTINCT unnest(string_split(raw_text, chr(10))) AS s FROM transcripts WHERE raw_text IS NOT NULL) SELECT s AS line, {_ROLE} AS role FROM n")
def speaker_role_all(spark, folder):
    """Lines of any length."""
    lines = table(spark, folder, "transcripts").where("raw_text is not null").select(F.explode(F.split("raw_text", "\n")).alias("line")).distinct()
    return lines.select("line", T.speaker_role(F.col("line")).alias("role"))


@query("SELECT DISTINCT accession_number, CASE " + " ".join(f"WHEN abs(v) >= {x} THEN printf('$%.2f{m}', {_HALF_UP.format(x=f'v / {x}', n=2)})" for m, x in (("T", "1e12"), ("B", "1e9"), ("M", "1e6"), ("K", "1e3"))) + " ELSE printf('$%.2f', v) END AS shown FROM (SELECT accession_number, round(xbrl_data.revenue / 1000) * 1000 AS v FROM filings WHERE xbrl_data.revenue IS NOT NULL)")
def large_numbers(spark, folder):
    f = table(spark, folder, "filings").select("accession_number", (F.round(F.col("xbrl_data.revenue") / 1000) * 1000).alias("v")).where("v is not null").distinct()
    return f.select("accession_number", numbers.large_number(F.col("v")).alias("shown"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM e")
def softmax(spark, folder):
    p = numbers.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    return table(spark, folder, "embeddings").select("vec_id", F.transform(p, lambda x: F.round(x, 6)).alias("p"))


_QUESTIONS = ("What are the risk disclosures of management?", "What is the guidance and outlook for revenue?", "How did the tone drift?", "Which operating margins improved?", "How do peers of the industry compare on costs?", "How does inflation weigh on the economy?")


def _requests(spark, folder):
    """A question for each company."""
    asked = F.element_at(F.array(*[F.lit(x) for x in _QUESTIONS]), (F.col("request_id") % len(_QUESTIONS) + 1).cast("int"))
    r = table(spark, folder, "companies").select(F.xxhash64("ticker").alias("h"), tables.ticker().alias("ticker")).select(F.shiftrightunsigned("h", 16).alias("request_id"), "ticker")
    return r.withColumn("question", asked)


@query()
def qa_loop(spark, folder):
    peers = qa.same_sector(table(spark, folder, "companies").select(tables.ticker().alias("ticker"), "sector"))
    return rounded(qa.answer_each(_requests(spark, folder), _chunks(spark, folder), peers=peers))


@query("""WITH c AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, sector FROM companies WHERE sector IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ticker) - 1 AS i, count(*) OVER (PARTITION BY sector) AS many FROM c)
SELECT a.ticker, b.ticker AS peer, CAST(n AS INTEGER) AS n FROM r a, unnest([1, 2, 3]) AS s(n), r b WHERE n < a.many AND b.sector = a.sector AND b.i = (a.i + n) % a.many""")
def sector_peers(spark, folder):
    return qa.same_sector(table(spark, folder, "companies").select(tables.ticker().alias("ticker"), "sector"))


_WORDS_OF = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
_SHARE_OF = lambda a, b: f"coalesce(len(list_intersect({_WORDS_OF.format(c=a)}, {_WORDS_OF.format(c=b)})) / nullif(len({_WORDS_OF.format(c=a)}), 0), 0)"


@query(f"""WITH {CHUNKS}, p AS (SELECT chunk_id, 'What did ' || ticker || ' say on ' || section || ' in ' || quarter AS question, text AS answer, lead(text) OVER w AS after, lag(text) OVER w AS truth FROM chunks WINDOW w AS (PARTITION BY ticker ORDER BY chunk_id)),
s AS (SELECT *, text_all AS ctx FROM (SELECT *, CASE WHEN after IS NULL THEN question ELSE question || chr(10) || chr(10) || after END AS text_all FROM p)),
e AS (SELECT chunk_id, {_SHARE_OF('answer', 'ctx')} AS f, {_SHARE_OF('question', 'answer')} AS r, CASE WHEN truth IS NOT NULL THEN {_SHARE_OF('truth', 'ctx')} END AS rec FROM s)
SELECT chunk_id, round(f, 6) + 0.0 AS faithfulness, round(r, 6) + 0.0 AS answer_relevance, round(0.9 * r, 6) + 0.0 AS context_precision, round(rec, 6) + 0.0 AS context_recall, round((f + r + 0.9 * r + coalesce(rec, 0)) / (3 + CASE WHEN rec IS NULL THEN 0 ELSE 1 END), 6) + 0.0 AS mean_score FROM e""")
def answers_evaluated(spark, folder):
    """Each chunk as an answer to a question about itself, with the next chunk of its company as context and the one before as the truth."""
    w = Window.partitionBy("ticker").orderBy("chunk_id")
    q = F.concat(F.lit("What did "), "ticker", F.lit(" say on "), "section", F.lit(" in "), "quarter")
    c = _chunks(spark, folder).select("chunk_id", q.alias("question"), F.col("text").alias("answer"), F.filter(F.array(q, F.lead("text").over(w)), lambda x: x.isNotNull()).alias("contexts"), F.lag("text").over(w).alias("ground_truth"))
    return rounded(evaluation.evaluate(c).select("chunk_id", *evaluation.METRICS, "mean_score"))


_ENTITY_SQL = (
    ("MONEY", r"[$€£]\s?\d[\d,]*(?:\.\d+)?(?:\s(?:million|billion))?"), ("PERCENT", r"\d+(?:\.\d+)?\s?%"),
    ("DATE", r"\b(?:Q[1-4] \d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)(?: \d{1,2},)? \d{4})\b"), ("CARDINAL", r"\b\d{1,3}(?:,\d{3})+\b"),
    ("ORG", r"\b[A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+){0,4} (?:Inc|Corp|Corporation|Ltd|LLC|PLC|Group|Holdings|Company|Bank|Capital|Partners)\b"),
    ("GPE", r"\b(?:United States|United Kingdom|European Union|China|Japan|Germany|France|India|Canada|Mexico|Brazil|Italy|Spain|Australia|South Korea|Netherlands|Switzerland|Ireland|Israel|Taiwan|Singapore|Hong Kong|Russia|Turkey|Poland|Sweden|Norway|Europe|Asia|America)\b"),
)


@query(" UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS text, '{k}' AS label FROM documents WHERE text IS NOT NULL" for k, p in _ENTITY_SQL))
def entities(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.inline(models.entities(F.col("text"))))


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM documents WHERE text IS NOT NULL" for k, p in _ENTITY_SQL) + """),
e AS (SELECT doc_id, label, m, p, unnest(generate_series(1, len(m))) AS i FROM m WHERE len(m) > 0),
s AS (SELECT doc_id, label, m[i] AS text, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start FROM e)
SELECT doc_id, text, label, start, CAST(start + length(text) AS INTEGER) AS end FROM s""")
def entity_spans(spark, folder):
    """Entities with their places in the text."""
    d = spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", F.inline(models.entity_spans(F.col("text"))))


@query(f"WITH {CHUNKS}, {SCORES} SELECT chunk_id, round(positive, 6) + 0.0 AS positive, round(negative, 6) + 0.0 AS negative, round(neutral, 6) + 0.0 AS neutral FROM scored")
def scored_texts(spark, folder):
    """Scores through a model's list of labels, in several spellings."""
    s = _chunks(spark, folder).select("chunk_id", models.score_text(F.col("text")).alias("s"))
    item = lambda names, c: F.struct(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("chunk_id") % len(names) + 1).cast("int")).alias("label"), F.col("s")[c].alias("score"))
    listed = F.array(item(("POSITIVE", "pos", "LABEL_2"), "positive"), item(("Negative", "neg", "label_0"), "negative"), item(("neutral", "neu", "something"), "neutral"))
    return rounded(s.select("chunk_id", models.labelled_scores(listed).alias("r")).select("chunk_id", "r.*"))


@query()
def embed_texts(spark, folder):
    return models.embed(_chunks(spark, folder)).select("chunk_id", "embedding")


@query()
def contradiction_pairs(spark, folder):
    chunks = _chunks(spark, folder).unionByName(pipeline.filing_chunks(table(spark, folder, "filings"))).unionByName(pipeline.call_chunks(table(spark, folder, "transcripts")))
    return rounded(pipeline.contradictions(models.embed(chunks)))
