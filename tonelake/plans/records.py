"""Queries on records: listings, periods, labels, bands, casts, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import dates as D
from tonelake.functions import labels, numbers
from tonelake.operators import backtest, evaluation, filings, quality
from tonelake.plans import expected as E
from tonelake.plans.catalog import query, table
from tonelake.plans.market import RUNS, _runs
from tonelake.plans.tone import ACCRUALS, ANALYSTS, CHUNKS, FILINGS, _analysts, _chunks, _filings, rounded
from tonelake.sources import tables


@query("SELECT DISTINCT accession_number, filing_type, CAST(filed_date AS VARCHAR) AS filed_date FROM filings WHERE accession_number IS NOT NULL AND ticker IS NOT NULL AND filing_type IN ('10-K', '10-Q')")
def filing_stubs(spark, folder):
    """A company's listing as parallel arrays, and back to rows."""
    f = table(spark, folder, "filings").where("accession_number is not null and ticker is not null").select("ticker", "accession_number", "filing_type", F.coalesce(F.col("filed_date").cast("string"), F.lit("")).alias("filed_date")).distinct()
    wide = f.groupBy("ticker").agg(*[F.collect_list(c).alias(c) for c in ("accession_number", "filing_type", "filed_date")])
    return filings.columns_to_rows(wide, "accession_number", "filing_type", "filed_date").where("filing_type in ('10-K', '10-Q')").withColumn("filed_date", F.nullif("filed_date", F.lit("")))


@query("SELECT DISTINCT d.ticker, CASE WHEN length(trim(c.cik)) < 10 THEN lpad(trim(c.cik), 10, '0') ELSE trim(c.cik) END AS cik FROM documents d LEFT JOIN companies c ON upper(trim(d.ticker)) = upper(trim(c.ticker))")
def cik_lookup(spark, folder):
    return filings.with_cik(table(spark, folder, "documents").select("ticker").distinct(), table(spark, folder, "companies"))


@query("SELECT DISTINCT accession_number, CAST(coalesce(filed_date, DATE '2025-06-01') AS VARCHAR) AS filed_date, CAST(coalesce(period_of_report, filed_date, DATE '2025-06-01') AS VARCHAR) AS period, coalesce(filing_url, 'https://files/' || replace(accession_number, '-', '')) AS url FROM filings WHERE accession_number <> ''")
def filings_hydrated(spark, folder):
    h = filings.hydrated(table(spark, folder, "filings"), "2025-06-01", "https://files/")
    return h.select("accession_number", F.col("filed_date").cast("string").alias("filed_date"), F.col("period_of_report").cast("string").alias("period"), F.col("filing_url").alias("url")).distinct()


@query(f"""WITH {ANALYSTS}, r AS (SELECT * FROM ad QUALIFY fetch_date >= max(fetch_date) OVER (PARTITION BY ticker) - 30),
c AS (SELECT ticker, count(*) FILTER (WHERE regexp_matches(rating, '{E.RATED_UP}')) AS ups, count(*) FILTER (WHERE NOT regexp_matches(rating, '{E.RATED_UP}') AND regexp_matches(rating, '{E.RATED_DOWN}')) AS downs FROM r GROUP BY ticker)
SELECT ticker, ups, downs, round(greatest(-1, least(1, (ups - downs) / (ups + downs + 1))), 6) + 0.0 AS revision_direction FROM c""")
def recent_revisions(spark, folder):
    """Moves of the last 30 days alone."""
    return rounded(quality.revision_moves(filings.recent(_analysts(spark, folder), "fetch_date"), "rating"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 20 = 0")
def stored_by_ids(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", "label")
    return v.join(v.where("vec_id % 20 = 0").select("vec_id"), "vec_id", "left_semi")


@query(f"""WITH {RUNS}, w AS (SELECT DISTINCT ticker, quarter, year FROM scores WHERE year = 1997 UNION SELECT DISTINCT ticker, 'Q1', 1900 FROM scores),
j AS (SELECT w.ticker, w.quarter, w.year, s.quarter AS sq, s.year AS sy, composite_score, row_number() OVER (PARTITION BY w.ticker, w.quarter, w.year ORDER BY CASE WHEN s.quarter = w.quarter AND s.year = w.year THEN 0 ELSE 1 END, s.year DESC, s.quarter DESC) AS n FROM w JOIN scores s USING (ticker))
SELECT ticker, quarter, CAST(year AS INTEGER) AS year, round(composite_score, 6) + 0.0 AS composite_score, sq AS scored_quarter, sy AS scored_year FROM j WHERE n = 1""")
def score_or_last(spark, folder):
    s = backtest.latest_run(_runs(spark, folder))
    w = s.where("year = 1997").select("ticker", "quarter", "year").union(s.select("ticker", F.lit("Q1"), F.lit(1900))).distinct()
    return rounded(filings.score_of(w, s))


@query(f"""WITH {CHUNKS}, d AS (SELECT DISTINCT quarter, year FROM chunks) SELECT quarter, year, CAST(row_number() OVER (ORDER BY year * 10 + CASE quarter WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 2 WHEN 'Q3' THEN 3 WHEN 'Q4' THEN 4 WHEN 'Annual' THEN 5 ELSE 0 END) AS INTEGER) AS n FROM d""")
def available_periods(spark, folder):
    return filings.periods(_chunks(spark, folder))


@query("SELECT label, count(*) AS vectors FROM embeddings GROUP BY label")
def collection_counts(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"))


@query(f"""WITH {CHUNKS} SELECT chunk_id, ticker, form, section, quarter, CAST(year AS INTEGER) AS year, CAST(0 AS INTEGER) AS chunk_index, CAST(0 AS INTEGER) AS total_chunks, CAST(words AS INTEGER) AS words, '' AS filed_date, '' AS speaker, '' AS strategy, '' AS source_url, '' AS accession_number FROM chunks""")
def chunk_metadata(spark, folder):
    return filings.metadata(_chunks(spark, folder))


@query(f"WITH {CHUNKS} SELECT chunk_id, ticker || ' ' || form || ' ' || quarter || ' ' || year || ' — ' || section AS label FROM chunks")
def source_labels(spark, folder):
    return _chunks(spark, folder).select("chunk_id", labels.source_label(F.col("ticker"), F.col("form"), F.col("quarter"), F.col("year"), F.col("section")).alias("label"))


@query("""SELECT vec_id, (CASE WHEN s > 0.85 THEN 'HIGH' ELSE 'MODERATE' END) || ' contradiction (score ' || printf('%.2f', s) || ') in ' || (CASE WHEN vec_id % 2 = 0 THEN 'the same period' ELSE 'different periods' END) || ': A' || label || ' against B' AS sentence
FROM (SELECT vec_id, label, 0.7 + (vec_id % 30) / 100.0 AS s FROM embeddings)""")
def contradiction_sentences(spark, folder):
    s = F.lit(0.7) + (F.col("vec_id") % 30) / 100.0
    return table(spark, folder, "embeddings").select("vec_id", labels.contradiction_sentence(F.round(s, 4), F.col("vec_id") % 2 == 0, F.concat(F.lit("A"), "label"), F.lit("B")).alias("sentence"))


@query(f"""WITH {FILINGS}, {ACCRUALS}, b AS (SELECT *, greatest(-1, least(1, coalesce(accruals_ratio, 0) * 10)) AS x FROM a)
SELECT ticker, quarter, year, CASE WHEN abs(x) >= 0.80 THEN 'EXCELLENT' WHEN abs(x) >= 0.65 THEN 'ACCEPTABLE' ELSE 'IMPROVE' END AS quality, CASE WHEN x * 10 > 8 THEN 'high' WHEN x * 10 > 4 THEN 'medium' ELSE 'low' END AS hedging,
  round(greatest(0, least(100, (x + 1) / 2 * 100)), 6) + 0.0 AS fill, CASE WHEN accruals_ratio < 0 THEN 'Cash-backed' ELSE 'Accrual-heavy' END AS accruals, CASE WHEN x > 0.3 THEN 'LONG' WHEN x < -0.3 THEN 'SHORT' ELSE 'NEUTRAL' END AS status FROM b""")
def bands(spark, folder):
    a = quality.accruals(_filings(spark, folder))
    x = numbers.clamp(F.coalesce("accruals_ratio", F.lit(0.0)) * 10, -1.0, 1.0)
    return rounded(a.select("ticker", "quarter", "year", labels.quality_band(F.abs(x)).alias("quality"), labels.hedging_band(x * 10).alias("hedging"), labels.gauge_fill(x).alias("fill"), labels.accruals_label(F.col("accruals_ratio")).alias("accruals"), labels.signal(x).alias("status")))


@query("""SELECT DISTINCT guidance_id, TRY_CAST(coalesce(unit, year || '.5') AS DOUBLE) AS as_float, TRY_CAST(replace(CAST(CAST(round(value_low) AS BIGINT) AS VARCHAR), ',', '') AS INTEGER) AS as_int, round(value_low * CASE guidance_id % 4 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1e3 ELSE 1 END / 1e6, 8) + 0.0 AS millions
FROM guidance WHERE guidance_id IS NOT NULL AND value_low BETWEEN 0 AND 1000000""")
def casts(spark, folder):
    """Texts as numbers where they are some, and amounts of several magnitudes in millions."""
    g = table(spark, folder, "guidance").where("guidance_id is not null and value_low between 0 and 1000000").select("guidance_id", "unit", "year", "value_low").distinct()
    unit = F.element_at(F.array(*[F.lit(x) for x in ("billion", "M", "thousand", "units")]), (F.col("guidance_id") % 4 + 1).cast("int"))
    return g.select("guidance_id", numbers.safe_float(F.coalesce("unit", F.concat("year", F.lit(".5")))).alias("as_float"), numbers.safe_int(F.round("value_low").cast("bigint").cast("string")).alias("as_int"), (F.round(numbers.to_millions(F.col("value_low"), unit), 8) + 0.0).alias("millions"))


@query("""WITH g AS (SELECT DISTINCT ON (guidance_id) guidance_id, upper(trim(ticker)) AS ticker, quarter, year FROM guidance WHERE guidance_id IS NOT NULL AND trim(ticker) <> '' AND value_low IS NOT NULL)
SELECT ticker, quarter, year, list_sort(list(guidance_id)) AS ids FROM g GROUP BY ticker, quarter, year""")
def guidance_by_period(spark, folder):
    """A period's guidance that has an amount, as a list."""
    g = tables.guidance(table(spark, folder, "guidance")).where("value_low is not null")
    return g.groupBy("ticker", "quarter", "year").agg(F.sort_array(F.collect_list("guidance_id")).alias("ids"))


_WATCHED = "w AS (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM companies), l AS (SELECT upper(trim(ticker)) AS ticker, max(loaded_at) AS seen FROM filings GROUP BY 1), s AS (SELECT ticker, CASE WHEN seen IS NULL THEN 'New' WHEN epoch(TIMESTAMP '2025-06-01') - epoch(seen) > 86400 * 60 THEN 'Stale' ELSE 'Fresh' END AS status FROM w LEFT JOIN l USING (ticker))"


@query(f"WITH {_WATCHED} SELECT ticker FROM s WHERE CASE WHEN (SELECT bool_or(status = 'New') FROM s) THEN status = 'New' WHEN (SELECT bool_or(status = 'Stale') FROM s) THEN status = 'Stale' ELSE true END")
def watchlist_targets(spark, folder):
    loads = table(spark, folder, "filings").select(tables.ticker().alias("ticker"), "loaded_at")
    return filings.targets(filings.watchlist(table(spark, folder, "companies").select(tables.ticker().alias("ticker")), loads, "2025-06-01 00:00:00", 60))


@query("SELECT DISTINCT quarter, year, quarter || ' ' || year AS period, CASE quarter WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 4 WHEN 'Q3' THEN 7 WHEN 'Q4' THEN 10 END AS first_month FROM guidance WHERE quarter LIKE 'Q%' AND year IS NOT NULL")
def period_strings(spark, folder):
    g = table(spark, folder, "guidance").where("quarter like 'Q%' and year is not null").select("quarter", "year").distinct()
    return g.select("quarter", "year", D.period_string(F.col("quarter"), F.col("year")).alias("period"), D.first_month(F.col("quarter")).alias("first_month"))


@query("""WITH q AS (SELECT unnest(generate_series(1, 8)) AS i), p AS (SELECT 'Q' || quarter(DATE '2024-06-30' - to_months(CAST(3 * i AS INTEGER))) AS quarter, CAST(year(DATE '2024-06-30' - to_months(CAST(3 * i AS INTEGER))) AS INTEGER) AS year FROM q),
c AS (SELECT DISTINCT transcript_id, upper(trim(ticker)) AS ticker, quarter, year FROM transcripts WHERE transcript_id IS NOT NULL AND trim(ticker) <> '')
SELECT c.ticker, quarter, year, count(*) AS calls FROM c JOIN p USING (quarter, year) GROUP BY ALL""")
def recent_calls(spark, folder):
    """Calls of the eight quarters before a day, by company and quarter."""
    past = spark.range(1).select(F.explode(D.past_quarters(F.lit("2024-06-30").cast("date"), 8)).alias("p")).select(F.split("p", " ")[0].alias("quarter"), F.split("p", " ")[1].cast("int").alias("year"))
    calls = table(spark, folder, "transcripts").where("transcript_id is not null and trim(ticker) <> ''").select("transcript_id", tables.ticker().alias("ticker"), "quarter", "year").distinct()
    return calls.join(F.broadcast(past), ["quarter", "year"]).groupBy("ticker", "quarter", "year").agg(F.count("*").alias("calls"))  # eight rows are broadcast


@query("""SELECT o_orderstatus AS run_id, CAST(max(o_orderdate) AS VARCHAR)[:10] AS started_at, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY o_orderstatus ORDER BY max(o_orderdate) DESC, run_id LIMIT 2""")
def recent_runs(spark, folder):
    """The two newest runs."""
    o = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("run_id")).agg(F.max("o_orderdate").alias("at"), F.count("*").alias("orders"))
    runs = o.select("run_id", F.col("at").alias("started_at"), F.create_map(F.lit("ticker"), F.lit("all")).alias("params"), F.create_map(F.lit("orders"), F.col("orders")).alias("metrics"))
    r = evaluation.recent_runs(runs, 2, "all")
    return r.select("run_id", F.substring(F.col("started_at").cast("string"), 1, 10).alias("started_at"), F.col("metrics")["orders"].alias("orders"))
