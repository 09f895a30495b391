"""From stored tables to stored results, for all companies at once: ingest, embed, analyse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.dates import period_index
from tonelake.operators import backtest, chunking, drift, guidance, models, pairs, quality, sentiment, vectors
from tonelake.sources import sinks, tables
from tonelake.storage import spread, stage


def _hashed_id(*columns):
    """A whole number of at least 2^62 out of what tells a row apart, so that it is no stored table's id."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2) + F.lit(1 << 62)


def _stored(chunks: DataFrame) -> DataFrame:
    """Chunks as tables.chunks() gives them: those of a company and period, their id as a whole number of at least 2^60, so that it is no document's."""
    number = F.conv(F.substring("chunk_id", 1, 15), 16, 10).cast("bigint") + F.lit(1 << 60)
    return chunks.where("trim(ticker) <> '' and quarter is not null and year is not null").select(number.alias("chunk_id"), "text", "ticker", "form", "section", "quarter", "year", "words")


def filing_chunks(filings: DataFrame) -> DataFrame:
    """Chunks of every filing with text, company and period."""
    return _stored(chunking.filing_chunks(spread(tables.filing_texts(filings)).withColumnRenamed("accession_number", "doc")))


def call_chunks(transcripts: DataFrame) -> DataFrame:
    """Chunks of every call with text, company and period; a call without a label is one turn of prepared remarks."""
    about = ["transcript_id", "ticker", "quarter", "year"]
    texts = stage(spread(tables.call_texts(transcripts)).select(F.struct(*about).alias("k"), "text"), "calls")
    turns = stage(chunking.first_question(chunking.line_turns(texts, "k"), "k"), "turns")
    bare = texts.join(turns.select(F.col("k.transcript_id").alias("id")).distinct(), F.col("k.transcript_id") == F.col("id"), "left_anti")
    bare = bare.select("k", F.lit(0).alias("turn_index"), F.lit("Unknown").alias("speaker"), F.lit("unknown").alias("role"), F.col("text").alias("body"), F.lit("prepared_remarks").alias("section"))
    rows = turns.select("k", "turn_index", "speaker", "role", "body", "section").unionByName(bare)
    return _stored(chunking.call_chunks(rows.select("k.*", "turn_index", "speaker", "role", "body", "section").withColumn("doc", F.col("transcript_id").cast("string"))))


def ingest(spark: SparkSession, folder: str, out: str, companies: DataFrame | None = None) -> None:
    """Chunks (of documents, of the sections of filings, of the turns of calls) and filings of all (or the named) companies; partitions of others stay."""
    raw = tables.read(spark, folder, "filings")
    chunks = tables.chunks(tables.read(spark, folder, "documents")).unionByName(filing_chunks(raw)).unionByName(call_chunks(tables.read(spark, folder, "transcripts")))
    filings = tables.filings(raw)
    if companies is not None:
        chunks, filings = chunks.join(companies, "ticker", "left_semi"), filings.join(companies, "ticker", "left_semi")
    chunks = stage(chunks, "chunks")
    tagged = chunking.tag(chunks)
    sinks.by_company(chunks.drop("section", "quarter").join(tagged.drop("ticker", "year"), "chunk_id"), f"{out}/chunks")
    sinks.by_company(filings, f"{out}/filings")


def found_guidance(chunks: DataFrame) -> DataFrame:
    """Guidance rows, as tables.guidance() gives them, out of the chunks that hold numbers."""
    numbered = chunks.where("contains_numbers")
    found = guidance.extract_guidance(numbered.select(F.struct("chunk_id", "ticker", "quarter", "year").alias("k"), "text"), "k")
    return found.select(_hashed_id("k.chunk_id", "metric", "low", "high").alias("guidance_id"), "k.ticker", "k.quarter", "k.year", "metric", F.col("low").alias("value_low"), F.col("high").alias("value_high"), F.col("confidence").alias("confidence_score"))


def embed(spark: SparkSession, out: str, load=None) -> None:
    sinks.by_company(models.embed(spark.read.parquet(f"{out}/chunks"), load=load), f"{out}/vectors")


def contradictions(chunks: DataFrame, pair_model=None) -> DataFrame:
    """Pairs across periods that are alike and of sections whose language counts, and of calls and reports of one period: every distinct pair is scored, those of at least pairs.LEAST_SCORE stay.

    A pair model takes both whole texts. The default one (models.opposition) compares their tones, which are found once for each chunk.
    """
    seen, score = (models.pair_tone(F.col("text")), models.opposed) if pair_model is None else (F.col("text"), pair_model)
    rows = chunks.select("chunk_id", "ticker", "quarter", "year", "form", "section", "words", "embedding", seen.alias("seen"))
    if pair_model is None:
        rows = rows.where("seen <> 'neutral'")  # opposed() never gives such a text the least score
    rows = stage(rows, "pairs")
    across = vectors.similar_pairs(rows.where(F.col("section").isin(*pairs.LANGUAGE)).withColumn("period", period_index(F.col("quarter"), F.col("year"))), "chunk_id", "embedding", "ticker", "period", "words")
    both = across.select(F.col("g").alias("ticker"), "a", "b", F.lit(0).alias("source")).unionByName(pairs.intra_period_pairs(rows))
    side = lambda k: rows.select(F.col("chunk_id").alias(k), F.col("seen").alias(f"t{k}"))
    p = pairs.distinct_pairs(both).join(side("a"), "a").join(side("b"), "b")
    return pairs.contradictions(p.withColumn("s", score(F.col("ta"), F.col("tb"))).select("ticker", "a", "b", "s.*"))


def analyse(spark: SparkSession, folder: str, out: str, tone=None) -> None:
    """Quarters, alerts, contradictions, scores and signals."""
    chunks = spark.read.parquet(f"{out}/vectors")
    scores = sentiment.lexicon_scores(chunks) if tone is None else chunks.select("chunk_id", tone(F.col("text")).alias("s")).select("chunk_id", "s.*")
    quarters = sentiment.quarter_sentiment(chunks, scores)
    # The stored rows and those in the chunks are often the same guidance: each amount of a period counts once.
    guided = guidance.distinct_guidance(tables.guidance(tables.read(spark, folder, "guidance")).unionByName(found_guidance(chunks)))
    matched = guidance.match_guidance(guided, spark.read.parquet(f"{out}/filings"))
    composite = quality.quality_scores(quarters, drift.drift_scores(quarters), guidance.guidance_component(matched), quality.accruals(spark.read.parquet(f"{out}/filings")), quality.latest_analyst(tables.analysts(tables.read(spark, folder, "analyst_data"))))
    for name, df in (("quarters", quarters), ("alerts", drift.drift_alerts(quarters)), ("contradictions", contradictions(chunks)), ("scores", composite), ("signals", backtest.signals(composite))):
        sinks.by_company(df, f"{out}/{name}")


def wanted(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Companies that are asked for and have no result yet."""
    return requested.select("ticker").distinct().join(done.select("ticker").distinct(), "ticker", "left_anti")
