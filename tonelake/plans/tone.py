"""Queries on tone, drift, guidance and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import labels, numbers
from tonelake.functions import text as T
from tonelake.operators import chunking, drift, filings, guidance, quality, sentiment
from tonelake.plans import expected as E
from tonelake.plans.catalog import query, table
from tonelake.plans.expected import count_of
from tonelake.sources import tables
from tonelake.storage import stage


def rounded(df, digits: int = 6):
    """Doubles to so many digits, without a negative zero, for results that two engines add in different orders."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CHUNKS = rf"""chunks AS (
  SELECT doc_id AS chunk_id, text, upper(trim(ticker)) AS ticker, quarter, year, {count_of(E.WORD)} AS words,
    CASE WHEN source IN ('filing_mda', 'filing_risk') THEN CASE WHEN quarter IN ('Q4', 'Annual') THEN '10-K' ELSE '10-Q' END WHEN source = 'call_excerpt' THEN 'transcript' WHEN source = 'press_release' THEN '8-K' ELSE 'other' END AS form,
    CASE source WHEN 'filing_mda' THEN 'mda' WHEN 'filing_risk' THEN 'risk_factors' WHEN 'call_excerpt' THEN 'qa' WHEN 'press_release' THEN 'press_release' WHEN 'analyst_note' THEN 'guidance' ELSE 'unknown' END AS section
  FROM documents WHERE text <> '' AND trim(ticker) <> '' AND quarter IS NOT NULL AND year IS NOT NULL)"""
SCORES = f"""counted AS (SELECT *, {count_of(E.POSITIVE)} AS pc, {count_of(E.NEGATIVE)} AS nc FROM chunks),
scored AS (SELECT *, pc / (pc + nc + 1) AS positive, nc / (pc + nc + 1) AS negative, 1 / (pc + nc + 1) AS neutral FROM counted)"""
PERIOD = "year * 10 + CASE quarter WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 2 WHEN 'Q3' THEN 3 WHEN 'Q4' THEN 4 WHEN 'Annual' THEN 5 ELSE 0 END"
QUARTERS = f"""quarters AS (
  SELECT *, {PERIOD} AS p, greatest(-1, least(1, positive_pct - negative_pct)) AS net_sentiment_score FROM (
    SELECT ticker, quarter, year, sum(positive * words) / sum(words) AS positive_pct, sum(negative * words) / sum(words) AS negative_pct, sum(neutral * words) / sum(words) AS neutral_pct,
      100.0 * sum({count_of(E.HEDGING)}) / greatest(1, sum(words)) AS hedging_score,
      CASE WHEN sum({count_of(E.SPECIFIC_NUMBER)}) + sum({count_of(E.VAGUE)}) = 0 THEN 0.5 ELSE sum({count_of(E.SPECIFIC_NUMBER)}) / (sum({count_of(E.SPECIFIC_NUMBER)}) + sum({count_of(E.VAGUE)})) END AS specificity_score,
      count(*) AS chunk_count
    FROM scored GROUP BY ticker, quarter, year HAVING sum(words) > 0))"""
TONE = f"WITH {CHUNKS}, {SCORES}, {QUARTERS}"
_R = lambda *cs: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cs)


def _chunks(spark, folder):
    return tables.chunks(table(spark, folder, "documents"))


def _quarters(spark, folder):
    return sentiment.quarter_sentiment(_chunks(spark, folder))


@query(f"{TONE} SELECT ticker, quarter, year, {_R('positive_pct', 'negative_pct', 'neutral_pct', 'net_sentiment_score', 'hedging_score', 'specificity_score')}, chunk_count FROM quarters")
def quarter_sentiment(spark, folder):
    return rounded(_quarters(spark, folder))


@query(f"WITH {CHUNKS} SELECT chunk_id, round(100.0 * {count_of(E.HEDGING)} / greatest(1, words), 6) + 0.0 AS hedging, {count_of(E.VAGUE)} AS vague, {count_of(E.SPECIFIC_NUMBER)} AS numbers FROM chunks")
def hedging_specificity(spark, folder):
    t = F.col("text")
    return rounded(_chunks(spark, folder).select("chunk_id", T.hedging(t, F.col("words")).alias("hedging"), F.regexp_count(t, F.lit(T.VAGUE_PATTERN)).alias("vague"), T.specific_numbers(t).alias("numbers")))


@query(f"""WITH {CHUNKS}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, quarter, year ORDER BY positive - negative, chunk_id) AS rank FROM scored)
SELECT ticker, quarter, year, CAST(rank AS INTEGER) AS rank, chunk_id, substring(text, 1, 200) AS start FROM r WHERE rank <= 5""")
def most_negative_k(spark, folder):
    return sentiment.most_negative(_chunks(spark, folder))


@query(f"WITH {CHUNKS}, {SCORES} SELECT chunk_id, round(positive - negative, 6) + 0.0 AS net_score, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS dominant_label FROM scored")
def dominant_labels(spark, folder):
    return rounded(sentiment.with_dominant(sentiment.lexicon_scores(_chunks(spark, folder))).select("chunk_id", "net_score", "dominant_label"))


@query(f"WITH {CHUNKS} SELECT section, count(*) AS chunks FROM chunks GROUP BY section")
def section_histogram(spark, folder):
    return sentiment.section_histogram(_chunks(spark, folder))


@query(f"WITH {CHUNKS}, h AS (SELECT section, quarter, 100.0 * {count_of(E.HEDGING)} / greatest(1, words) AS h FROM chunks) SELECT section, " + ", ".join(f"round(avg(h) FILTER (WHERE quarter = '{q}'), 6) + 0.0 AS {q}" for q in ("Q1", "Q2", "Q3", "Q4")) + " FROM h GROUP BY section")
def heatmap_pivot(spark, folder):
    return rounded(sentiment.hedging_by_section(_chunks(spark, folder)))


_DELTA = f"{TONE}, d AS (SELECT *, net_sentiment_score - lag(net_sentiment_score) OVER w AS delta, lag(quarter) OVER w || ' ' || lag(year) OVER w AS against, hedging_score - lag(hedging_score) OVER w AS dh, specificity_score - lag(specificity_score) OVER w AS ds FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY p))"
_WAY = "CASE WHEN abs(delta) <= 0.1 THEN 'stable' WHEN delta > 0 THEN 'improving' ELSE 'deteriorating' END"


@query(f"{_DELTA} SELECT ticker, quarter, year, round(delta, 6) + 0.0 AS delta, round(abs(delta), 4) + 0.0 AS magnitude, {_WAY} AS direction FROM d WHERE delta IS NOT NULL")
def tone_drift(spark, folder):
    return rounded(drift.quarter_changes(_quarters(spark, folder)))


@query(f"{_DELTA} SELECT ticker, quarter, year, against, round(delta, 4) + 0.0 AS net_change, round(dh, 4) + 0.0 AS hedging_change, round(ds, 4) + 0.0 AS specificity_change FROM d WHERE against IS NOT NULL")
def compare_quarters(spark, folder):
    return rounded(drift.compare_quarters(_quarters(spark, folder)))


_ALERT = f"""{_DELTA}, s AS (
  SELECT *, row_number() OVER b AS n, sum(CASE WHEN delta IS NOT NULL AND {_WAY} = 'deteriorating' THEN 0 ELSE 1 END) OVER b AS broken,
    lag(hedging_score, 2) OVER w AS h2, lag(specificity_score, 2) OVER w AS s2
  FROM d WINDOW b AS (PARTITION BY ticker ORDER BY p DESC), w AS (PARTITION BY ticker ORDER BY p)),
o AS (
  SELECT ticker, count(*) AS quarters, count(*) FILTER (WHERE broken = 0) AS deteriorations,
    coalesce(bool_or(hedging_score > h2 * 1.2) FILTER (WHERE n = 1), false) AS hedging_rising, coalesce(bool_or(specificity_score < s2 * 0.85) FILTER (WHERE n = 1), false) AS specificity_falling
  FROM s GROUP BY ticker)"""


@query(f"{_ALERT} SELECT ticker, deteriorations FROM o")
def trailing_deterioration(spark, folder):
    return drift.drift_alerts(_quarters(spark, folder)).select("ticker", "deteriorations")


@query(f"""{_ALERT} SELECT ticker, quarters, deteriorations, hedging_rising, specificity_falling,
  CASE WHEN quarters < 2 THEN 'GREEN' WHEN deteriorations >= 2 AND (hedging_rising OR specificity_falling) THEN 'RED'
    WHEN deteriorations >= 2 OR (deteriorations = 1 AND hedging_rising) OR (hedging_rising AND specificity_falling) THEN 'YELLOW' ELSE 'GREEN' END AS alert_level FROM o""")
def drift_alert(spark, folder):
    return drift.drift_alerts(_quarters(spark, folder)).drop("alert_reason")


_DRIFT = f"""{_DELTA}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p DESC) AS back, least(3, count(*) OVER (PARTITION BY ticker) - 1) AS m FROM d),
drifts AS (
  SELECT ticker, greatest(-1, least(1, 2 * coalesce(sum(weight * delta) / nullif(sum(weight), 0), 0))) AS drift_score
  FROM (SELECT *, CASE WHEN back <= m AND delta IS NOT NULL THEN CASE m - back + 1 WHEN 1 THEN 0.25 WHEN 2 THEN 0.35 ELSE 0.40 END END AS weight FROM b) GROUP BY ticker)"""


@query(f"{_DRIFT} SELECT ticker, round(drift_score, 6) + 0.0 AS drift_score FROM drifts")
def drift_score(spark, folder):
    return rounded(drift.drift_scores(_quarters(spark, folder)))


@query(f"{_DELTA} SELECT ticker, round(arg_max(net_sentiment_score, p), 6) + 0.0 AS latest, round(arg_max(coalesce(delta, 0), p), 6) + 0.0 AS change, round(max(net_sentiment_score) - min(net_sentiment_score), 6) + 0.0 AS range FROM d GROUP BY ticker")
def latest_change(spark, folder):
    return rounded(drift.latest_change(_quarters(spark, folder)))


# --- filings and guidance

FILINGS = """firsts AS (
  SELECT * FROM filings WHERE accession_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY loaded_at) = 1),
f AS (
  SELECT accession_number, upper(trim(ticker)) AS ticker, CASE WHEN length(trim(cik)) < 10 THEN lpad(trim(cik), 10, '0') ELSE trim(cik) END AS cik, filing_type, period_of_report, filed_date,
    coalesce(quarter, 'Q' || quarter(period_of_report)) AS quarter, coalesce(year, year(period_of_report)) AS year, coalesce(is_amendment, false) AS is_amendment, xbrl_data AS x
  FROM firsts WHERE trim(ticker) <> ''),
one AS (
  SELECT * FROM f WHERE quarter IS NOT NULL AND year IS NOT NULL QUALIFY row_number() OVER (
    PARTITION BY ticker, quarter, year ORDER BY is_amendment DESC, CASE WHEN is_amendment THEN -(filed_date - DATE '1970-01-01') ELSE filed_date - DATE '1970-01-01' END NULLS FIRST, accession_number) = 1)"""
GUIDANCE = """g AS (
  SELECT DISTINCT ON (guidance_id) guidance_id, upper(trim(ticker)) AS ticker, quarter, year, CASE WHEN lower(trim(metric_type)) = 'eps' THEN 'EPS' ELSE lower(trim(metric_type)) END AS metric, value_low, value_high, confidence_score
  FROM guidance WHERE guidance_id IS NOT NULL AND trim(ticker) <> '')"""
MATCHED = f"""{FILINGS}, {GUIDANCE},
j AS (
  SELECT g.*, coalesce((value_low + value_high) / 2, value_low) AS guided_mid,
    CASE metric WHEN 'EPS' THEN x.eps_diluted WHEN 'revenue' THEN x.revenue WHEN 'capex' THEN abs(x.capex) WHEN 'margin' THEN CASE WHEN x.gross_margin BETWEEN 0 AND 1 THEN x.gross_margin * 100 ELSE x.gross_margin END END AS actual
  FROM g LEFT JOIN one ON g.ticker = one.ticker
    AND one.quarter = CASE WHEN g.quarter IN ('Q4', 'Annual') THEN 'Q1' ELSE 'Q' || (CAST(substring(g.quarter, 2, 1) AS INTEGER) + 1) END
    AND one.year = g.year + CASE WHEN g.quarter IN ('Q4', 'Annual') THEN 1 ELSE 0 END),
m AS (
  SELECT *, CASE WHEN actual = 0 THEN 0.5 WHEN actual IS NOT NULL AND guided_mid IS NOT NULL THEN greatest(0, least(1, 1 - abs(guided_mid - actual) / abs(actual))) END AS accuracy,
    CASE WHEN actual = 0 THEN 0.0 WHEN actual IS NOT NULL AND guided_mid IS NOT NULL THEN greatest(-2, least(2, (guided_mid - actual) / abs(actual))) END AS bias FROM j)"""


def _filings(spark, folder):
    return tables.filings(table(spark, folder, "filings"))


def _matched(spark, folder):
    return guidance.match_guidance(tables.guidance(table(spark, folder, "guidance")), _filings(spark, folder))


@query(f"WITH {MATCHED} SELECT guidance_id, ticker, quarter, year, metric, {_R('guided_mid', 'actual', 'accuracy', 'bias')} FROM m")
def guidance_match(spark, folder):
    return rounded(_matched(spark, folder))


_COMPONENT = "CASE WHEN {n} >= 3 THEN greatest(-1, least(1, ({a} - 0.5) * 2 + CASE WHEN {b} < -0.05 THEN 0.10 ELSE 0 END)) ELSE 0 END"


@query(f"WITH {MATCHED} SELECT ticker, count(accuracy) AS records, round({_COMPONENT.format(n='count(accuracy)', a='avg(accuracy)', b='avg(CASE WHEN accuracy IS NOT NULL THEN bias END)')}, 6) + 0.0 AS guidance_component FROM m GROUP BY ticker")
def guidance_component(spark, folder):
    return rounded(guidance.guidance_component(_matched(spark, folder)))


@query(f"""WITH {MATCHED}, k AS (SELECT ticker, quarter, year, count(*) AS n, sum(accuracy) AS a, sum(bias) AS b FROM m WHERE accuracy IS NOT NULL GROUP BY ALL),
r AS (SELECT ticker, quarter, year, sum(n) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b FROM k WINDOW w AS (PARTITION BY ticker ORDER BY {PERIOD}))
SELECT ticker, quarter, year, CAST(n AS BIGINT) AS records, round({_COMPONENT.format(n='n', a='a / n', b='b / n')}, 6) + 0.0 AS guidance_component FROM r""")
def guidance_no_lookahead(spark, folder):
    return rounded(guidance.guidance_component_by_period(_matched(spark, folder)))


@query(f"WITH {MATCHED} SELECT ticker, metric, round(avg(accuracy), 4) + 0.0 AS mean_accuracy, round(avg(bias), 4) + 0.0 AS mean_bias, round(coalesce(stddev_samp(bias), 0), 4) + 0.0 AS std_bias, count(*) AS records FROM m WHERE accuracy IS NOT NULL GROUP BY ticker, metric")
def guidance_by_metric(spark, folder):
    return rounded(guidance.guidance_by_metric(_matched(spark, folder)), 4)


@query(f"""WITH {MATCHED}, b AS (SELECT ticker, metric, avg(bias) AS mean_bias FROM m WHERE accuracy IS NOT NULL GROUP BY ticker, metric)
SELECT ticker, metric, CASE WHEN mean_bias < -0.10 THEN 'sandbagging' WHEN mean_bias < 0.05 THEN 'accurate' WHEN mean_bias < 0.10 THEN 'slightly optimistic' WHEN mean_bias < 0.25 THEN 'optimistic' ELSE 'aggressively optimistic' END AS label FROM b""")
def bias_label(spark, folder):
    m = _matched(spark, folder).where("accuracy is not null").groupBy("ticker", "metric").agg(F.avg("bias").alias("b"))
    return m.select("ticker", "metric", labels.bias_label(F.col("b")).alias("label"))


@query(f"WITH {GUIDANCE} SELECT guidance_id FROM g QUALIFY row_number() OVER (PARTITION BY ticker, quarter, year, metric, round(value_low, 4), round(value_high, 4) ORDER BY confidence_score DESC NULLS LAST, guidance_id) = 1")
def guidance_dedup(spark, folder):
    return guidance.distinct_guidance(tables.guidance(table(spark, folder, "guidance"))).select("guidance_id")


ACCRUALS = "a AS (SELECT ticker, quarter, year, (x.net_income - x.operating_cash_flow) / nullif(x.total_assets, 0) AS accruals_ratio FROM one)"


@query(f"WITH {FILINGS}, {ACCRUALS} SELECT ticker, quarter, year, round(accruals_ratio, 6) + 0.0 AS accruals_ratio, round(coalesce(-tanh(10 * accruals_ratio), 0), 6) + 0.0 AS accruals_component FROM a")
def accruals(spark, folder):
    return rounded(quality.accruals(_filings(spark, folder)))


ANALYSTS = """ad AS (SELECT DISTINCT ON (analyst_row_id) analyst_row_id, upper(trim(ticker)) AS ticker, fetch_date, lower(trim(current_rating)) AS rating, revision_direction, price_target_mean, price_target_high, price_target_low FROM analyst_data WHERE analyst_row_id IS NOT NULL AND trim(ticker) <> ''),
la AS (SELECT ticker, fetch_date, coalesce(CASE WHEN revision_direction IS NOT NULL THEN greatest(-1, least(1, revision_direction)) END, 0) AS analyst_component FROM ad QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fetch_date DESC NULLS LAST, analyst_row_id DESC) = 1)"""


def _analysts(spark, folder):
    return tables.analysts(table(spark, folder, "analyst_data"))


@query(f"WITH {ANALYSTS} SELECT ticker, CAST(fetch_date AS VARCHAR) AS fetch_date, round(CASE WHEN analyst_component IS NULL THEN 0 ELSE analyst_component END, 6) + 0.0 AS analyst_component FROM la")
def analyst_latest(spark, folder):
    return rounded(quality.latest_analyst(_analysts(spark, folder)).withColumn("fetch_date", F.col("fetch_date").cast("string")))


@query(f"""WITH {ANALYSTS}, c AS (SELECT ticker, count(*) FILTER (WHERE regexp_matches(rating, '{E.RATED_UP}')) AS ups, count(*) FILTER (WHERE NOT regexp_matches(rating, '{E.RATED_UP}') AND regexp_matches(rating, '{E.RATED_DOWN}')) AS downs FROM ad GROUP BY ticker)
SELECT ticker, ups, downs, round(greatest(-1, least(1, (ups - downs) / (ups + downs + 1))), 6) + 0.0 AS revision_direction FROM c""")
def analyst_revision(spark, folder):
    return rounded(quality.revision_moves(_analysts(spark, folder), "rating"))


@query(f"WITH {ANALYSTS} SELECT ticker, round(avg(price_target_mean), 6) + 0.0 AS mean, round(avg(price_target_high), 6) + 0.0 AS high, round(avg(price_target_low), 6) + 0.0 AS low FROM ad GROUP BY ticker")
def estimates_pivot(spark, folder):
    long = _analysts(spark, folder).unpivot("ticker", [F.col("price_target_mean").alias("mean"), F.col("price_target_high").alias("high"), F.col("price_target_low").alias("low")], "kind", "value")
    return rounded(quality.estimates_wide(long))


QUALITY = f"""gc AS (SELECT ticker, {_COMPONENT.format(n='count(accuracy)', a='avg(accuracy)', b='avg(CASE WHEN accuracy IS NOT NULL THEN bias END)')} AS guidance_component FROM m GROUP BY ticker),
qs AS (
  SELECT p.ticker, p.quarter, p.year, coalesce(drift_score, 0) AS ds, coalesce(guidance_component, 0) AS gs, coalesce(-tanh(10 * accruals_ratio), 0) AS acs, coalesce(analyst_component, 0) AS ans, accruals_ratio
  FROM (SELECT DISTINCT ticker, quarter, year FROM quarters) p LEFT JOIN drifts USING (ticker) LEFT JOIN gc USING (ticker) LEFT JOIN a USING (ticker, quarter, year) LEFT JOIN la USING (ticker)),
scores AS (SELECT *, greatest(-1, least(1, ds * 0.30 + gs * 0.25 + acs * 0.25 + ans * 0.20)) AS composite_score FROM qs)"""
FULL = f"{_DRIFT}, {MATCHED}, {ACCRUALS}, {ANALYSTS}, {QUALITY}"


def _scores(spark, folder):
    q = stage(_quarters(spark, folder), "quarters")  # read twice, made once
    return quality.quality_scores(q, drift.drift_scores(q), guidance.guidance_component(_matched(spark, folder)), quality.accruals(_filings(spark, folder)), quality.latest_analyst(_analysts(spark, folder)))


@query(f"""{FULL} SELECT ticker, quarter, year, round(composite_score, 6) + 0.0 AS composite_score, round(ds, 4) + 0.0 AS drift, round(gs, 4) + 0.0 AS guidance, round(acs, 4) + 0.0 AS accruals, round(ans, 4) + 0.0 AS analyst,
  round(accruals_ratio, 6) + 0.0 AS accruals_ratio, CASE WHEN composite_score > 0.3 THEN 'LONG' WHEN composite_score < -0.3 THEN 'SHORT' ELSE 'NEUTRAL' END AS signal FROM scores""")
def quality_score(spark, folder):
    return rounded(_scores(spark, folder))


@query()
def quality_explained(spark, folder):
    return quality.explained(_scores(spark, folder))


# --- filings

@query(f"WITH {FILINGS} SELECT accession_number, ticker, cik, filing_type, CAST(filed_date AS VARCHAR) AS filed_date FROM f WHERE filing_type IN ('10-K', '10-Q', '8-K') AND (filed_date IS NULL OR filed_date BETWEEN DATE '2020-01-01' AND DATE '2024-12-31')")
def filing_listing(spark, folder):
    return filings.listing(_filings(spark, folder), ("10-K", "10-Q", "8-K"), "2020-01-01", "2024-12-31").select("accession_number", "ticker", "cik", "filing_type", F.col("filed_date").cast("string").alias("filed_date"))


@query(f"WITH {FILINGS}, r AS (SELECT ticker, accession_number, row_number() OVER (PARTITION BY ticker ORDER BY filed_date DESC NULLS LAST, accession_number DESC) AS rank FROM f) SELECT ticker, accession_number, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12")
def filing_topn(spark, folder):
    return filings.newest(_filings(spark, folder)).select("ticker", "accession_number", "rank")


@query(f"""WITH {FILINGS}, want AS (SELECT ticker || ' ' || d AS id, ticker, d FROM (SELECT DISTINCT upper(trim(ticker)) AS ticker, call_date AS d FROM transcripts WHERE trim(ticker) <> '' AND call_date IS NOT NULL)),
facts AS (SELECT ticker, period_of_report + 30 AS ended, filing_type AS form, accession_number AS seq, x.revenue AS value FROM f WHERE period_of_report IS NOT NULL)
SELECT id, arg_min_null(value, struct_pack(e := CASE WHEN ended = d AND form LIKE '10-%' THEN 0 ELSE 1 END, a := abs(ended - d), s := seq)) AS value FROM want LEFT JOIN facts ON facts.ticker = want.ticker AND abs(ended - d) <= 10 GROUP BY id""")
def xbrl_asof(spark, folder):
    want = table(spark, folder, "transcripts").where("trim(ticker) <> '' and call_date is not null").select(tables.ticker().alias("ticker"), F.col("call_date").alias("period_end")).distinct()
    want = want.withColumn("id", F.concat_ws(" ", "ticker", "period_end"))
    facts = _filings(spark, folder).where("period_of_report is not null").select("ticker", F.date_add("period_of_report", 30).alias("ended"), F.col("filing_type").alias("form"), F.col("accession_number").alias("seq"), F.col("revenue").alias("value"))
    return filings.fact_as_of(want, facts)


@query(f"WITH {FILINGS}, w AS (SELECT upper(trim(ticker)) AS ticker FROM companies), l AS (SELECT upper(trim(ticker)) AS ticker, max(loaded_at) AS seen FROM filings WHERE year >= 2024 GROUP BY 1) SELECT DISTINCT ticker, CASE WHEN seen IS NULL THEN 'New' WHEN epoch(TIMESTAMP '2025-06-01') - epoch(seen) > 86400 * 60 THEN 'Stale' ELSE 'Fresh' END AS status FROM w LEFT JOIN l USING (ticker)")
def watchlist(spark, folder):
    loads = table(spark, folder, "filings").where("year >= 2024").select(tables.ticker().alias("ticker"), "loaded_at")
    return filings.watchlist(table(spark, folder, "companies").select(tables.ticker().alias("ticker")), loads, "2025-06-01 00:00:00", 60)


# --- text

@query(f"SELECT doc_id, {count_of(E.WORD)} AS words, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, {count_of(E.FINANCIAL_NUMBER)} AS numbers FROM documents WHERE text IS NOT NULL")
def word_token_counts(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.word_count(t).alias("words"), T.token_count(t).alias("tokens"), T.financial_numbers(t).alias("numbers"))


@query(f"""WITH c AS (SELECT doc_id, {count_of(E.POSITIVE)} AS p, {count_of(E.NEGATIVE)} AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN p = 0 AND n = 0 THEN 'neutral' WHEN p > 1.5 * n THEN 'positive' WHEN n > 1.5 * p THEN 'negative' ELSE 'neutral' END AS tone FROM c""")
def quick_sentiment(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.quick_sentiment(F.col("text")).alias("tone"))


_QUARTER = E.QUARTER


@query(f"SELECT DISTINCT guidance_id, {_QUARTER.format(c='raw_text')} AS quarter FROM guidance WHERE raw_text IS NOT NULL")
def quarter_infer(spark, folder):
    return table(spark, folder, "guidance").where("raw_text is not null").select("guidance_id", T.quarter_in_text(F.col("raw_text")).alias("quarter")).distinct()


TAGGED = f"""SELECT chunk_id, ticker,
  CASE WHEN section NOT IN ('qa', 'prepared_remarks') AND regexp_matches(text, '{E.GUIDANCE}') AND {count_of(E.FINANCIAL_NUMBER)} > 0 THEN 'guidance'
    WHEN section = 'unknown' AND regexp_matches(text, '{E.RISK}') THEN 'risk_factors' WHEN section = 'unknown' AND regexp_matches(text, '{E.HIGHLIGHT}') THEN 'financial_statements' ELSE section END AS section,
  CASE WHEN quarter = 'Q4' AND form IN ('10-K', '10-K/A') THEN quarter ELSE coalesce({_QUARTER.format(c='text')}, quarter) END AS quarter, year, {count_of(E.FINANCIAL_NUMBER)} > 0 AS contains_numbers FROM chunks"""


@query(f"WITH {CHUNKS} {TAGGED}")
def tag_chunks(spark, folder):
    return chunking.tag(_chunks(spark, folder)).drop("tone")


@query(f"WITH {CHUNKS}, t AS ({TAGGED}) SELECT t.* FROM t JOIN chunks c ON t.chunk_id = c.chunk_id WHERE t.section = 'guidance' OR (t.contains_numbers AND regexp_matches(c.text, '{E.GUIDANCE}'))")
def guidance_chunks(spark, folder):
    return chunking.guidance_chunks(chunking.tag(_chunks(spark, folder), keep_text=True)).drop("tone", "text")


@query(r"""SELECT DISTINCT guidance_id, round(CASE WHEN regexp_extract(raw_text, '(?i)(-?)\$?\s*(\d[\d,]*(?:\.\d+)?)(?:\s*(trillion|billion|million|thousand|bn|mn|[tbmk])\b)?', 1) = '-' THEN -1 ELSE 1 END
  * TRY_CAST(replace(regexp_extract(raw_text, '(?i)(-?)\$?\s*(\d[\d,]*(?:\.\d+)?)(?:\s*(trillion|billion|million|thousand|bn|mn|[tbmk])\b)?', 2), ',', '') AS DOUBLE)
  * CASE lower(regexp_extract(raw_text, '(?i)(-?)\$?\s*(\d[\d,]*(?:\.\d+)?)(?:\s*(trillion|billion|million|thousand|bn|mn|[tbmk])\b)?', 3))
    WHEN 't' THEN 1e12 WHEN 'trillion' THEN 1e12 WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'billion' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 ELSE 1 END, 4) + 0.0 AS value FROM guidance WHERE raw_text IS NOT NULL""")
def parse_financial_value(spark, folder):
    return rounded(table(spark, folder, "guidance").where("raw_text is not null").select("guidance_id", numbers.parse_financial_value(F.col("raw_text")).alias("value")).distinct(), 4)
