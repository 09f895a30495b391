"""Calls published as web pages: links to them, and their turns out of paragraphs with bold names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import text as T

# Quarters in words; the speaker in a bold text: a name, and after a dash, comma or colon a title.
NAMED = {"Q1": "first.quarter", "Q2": "second.quarter", "Q3": "third.quarter", "Q4": "fourth.quarter"}
SPEAKER = r"(?s)^([A-Z][a-zA-Z\s.\-]+?)(?:\s*[-–—,]+\s*|\s*:\s*)([^:]+)?:\s*"
_BARE = r"(?s)^([A-Z][a-zA-Z\s.\-]+?)\s*:\s*$"
_BOLD = r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>"


def links(pages: DataFrame, calls: DataFrame, base: str) -> DataFrame:
    """ticker, quarter, year, url: for each call wanted (ticker, quarter, year) the first link (of page_ticker's page, in order n, with href and text) that names the ticker, and quarter and year in either order."""
    both = calls.join(pages, calls.ticker == pages.page_ticker)
    low = lambda c: F.lower(F.col(c))
    words = F.try_element_at(F.create_map(*[F.lit(v) for kv in NAMED.items() for v in kv]), F.col("quarter"))
    year = F.col("year").cast("string")
    either = lambda c, q: F.expr(f"lower({c}) rlike concat(lower({q}), '.*', cast(year as string))") | F.expr(f"lower({c}) rlike concat(cast(year as string), '.*', lower({q}))")
    named = low("href").contains(low("ticker")) | low("text").contains(low("ticker"))
    hit = both.withColumn("words", words).withColumn("y", year).where(named & (either("text", "quarter") | either("href", "quarter") | either("text", "words")))
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), "href"))
    return hit.groupBy("ticker", "quarter", "year").agg(F.min_by(url, "n").alias("url"))


def turns(pages: DataFrame, key: str, html: str = "html", least: int = 5) -> DataFrame:
    """key, turn_index, speaker, role, company, body: a paragraph that begins with a bold name opens a turn, the ones after it belong to it.

    Pages with fewer than `least` paragraphs have none; turns of at most three words are dropped. Nulls and pages without a bold name have no turns.
    """
    body = F.regexp_extract(F.col(html), r"""(?is)<(?:div|article)\b[^>]*(?:article|content|body)[^>]*>(.*)""", 1)
    whole = F.when(body == "", F.col(html)).otherwise(body)
    found = F.regexp_extract_all(whole, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    rows = pages.where(F.size(found) >= least).select(key, F.posexplode(found).alias("n", "p"))
    plain = lambda c: T.squeeze(T.remove_html(c))
    rows = rows.withColumn("bold", plain(F.regexp_extract("p", _BOLD, 1))).withColumn("said", plain(F.col("p")))
    rows = rows.withColumn("full", F.regexp_extract("bold", SPEAKER, 1)).withColumn("bare", F.regexp_extract("bold", _BARE, 1))
    name = F.coalesce(F.nullif("full", F.lit("")), F.nullif("bare", F.lit("")))
    rows = rows.withColumn("speaker", F.regexp_replace(F.trim(name), r"[-–—,]+$", "")).withColumn("title", F.when(F.col("speaker").isNotNull(), F.trim(F.regexp_extract("bold", SPEAKER, 2))))
    rest = F.when(F.col("speaker").isNotNull(), F.trim(F.regexp_replace(F.expr("substr(said, length(bold) + 1)"), r"^[\s:]+", ""))).otherwise(F.col("said"))
    w = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumn("rest", rest).withColumn("turn", F.count("speaker").over(w)).where("turn > 0")
    g = rows.groupBy(key, "turn").agg(F.max("speaker").alias("speaker"), F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("n", "rest"))).alias("b"))
    g = g.withColumn("body", F.trim(F.array_join(F.filter(F.transform("b", lambda x: x["rest"]), lambda x: x != ""), " "))).where(T.word_count(F.col("body")) > 3)
    index = (F.row_number().over(Window.partitionBy(key).orderBy("turn")) - 1).alias("turn_index")
    return g.select(key, index, "speaker", T.article_role(F.col("title")).alias("role"), T.article_company(F.coalesce("title", F.lit(""))).alias("company"), "body")


def calls(pages: DataFrame, key: str, html: str = "html", quarter: str = "quarter", year: str = "year", least: int = 5) -> DataFrame:
    """key, call_date, raw_text of every page with turns: the day that the page gives (published time, else its schema's), else the first of its quarter; the turns as `name: text`, an empty line between them."""
    from tonelake.functions.dates import first_month

    day = lambda p: F.regexp_extract(F.col(html), p, 1).try_cast("date")
    meta = F.coalesce(day(r"""(?is)<meta[^>]*property=["']article:published_time["'][^>]*content=["'](\d{4}-\d{2}-\d{2})"""), day(r"""(?is)itemprop=["']datePublished["'][^>]*content=["'](\d{4}-\d{2}-\d{2})"""))
    dated = pages.select(key, F.coalesce(meta, F.make_date(F.col(year), first_month(F.col(quarter)), F.lit(1))).alias("call_date"))
    told = turns(pages, key, html, least).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_index", F.concat_ws(": ", "speaker", "body").alias("t")))).alias("t"))
    return dated.join(told, key).select(key, "call_date", F.array_join(F.transform("t", lambda x: x["t"]), "\n\n").alias("raw_text"))
