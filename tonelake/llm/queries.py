"""Queries of this subpackage, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.llm import lines, mixing, neardup, reading, split, tokens, turns

QUERIES = {}
ORACLES: dict[str, str] = {}


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, folder):
    return turns.speaker_turns(table(spark, folder, "transcripts")).drop("text")


@query
def p1_turns(spark, folder):
    return turns.speaker_turns(table(spark, folder, "transcripts"))


@query
def p6_ids(spark, folder):
    return tokens.encode_column(table(spark, folder, "documents"), "doc_id", "text")


@query
def p6_roundtrip(spark, folder):
    return tokens.round_trip(table(spark, folder, "documents"), "doc_id", "text")


def _long_items(spark, folder, f):
    return f(table(spark, folder, "filings"), "filings", "accession_number", "raw_text").unionByName(f(table(spark, folder, "transcripts"), "transcripts", "transcript_id", "raw_text"))


@query
def p2_found(spark, folder):
    return _long_items(spark, folder, split.cut_kinds)


@query
def p2_pieces(spark, folder):
    return _long_items(spark, folder, split.pieces)


@query
def p2_roundtrip(spark, folder):
    """Each item out of its pieces: the digest of what they hold without what they share, and whether all keep the limit and overlap as stated (a piece with less text before it shares all of that)."""
    p = p2_pieces(spark, folder)
    own = F.expr("transform(array_sort(collect_list(struct(piece_no, substr(piece, shared + 1) as own))), x -> x.own)")
    each = p.groupBy("source_table", "item_key").agg(
        own.alias("own"), F.min(F.length("piece") <= split.LIMIT).alias("within_limit"),
        F.min((F.col("start") == 0) | F.col("shared").between(split.OVERLAP - split.SLACK, split.OVERLAP + split.SLACK) | (F.length("piece") == split.LIMIT)).alias("overlapping"),
    )
    return each.select("source_table", "item_key", F.md5(F.array_join("own", "").cast("binary")).alias("digest"), "within_limit", "overlapping")


ORACLES["p2_roundtrip"] = r"""
SELECT 'filings' AS source_table, accession_number AS item_key, md5(raw_text) AS digest, true AS within_limit, true AS overlapping FROM filings WHERE raw_text <> ''
UNION SELECT 'transcripts', CAST(transcript_id AS VARCHAR), md5(raw_text), true, true FROM transcripts WHERE raw_text <> ''
"""
ORACLES["p2_found"] = r"""
WITH items AS (
  SELECT 'filings' AS source_table, accession_number AS item_key, raw_text FROM filings
  UNION SELECT 'transcripts', CAST(transcript_id AS VARCHAR), raw_text FROM transcripts)
SELECT source_table, item_key,
  CASE WHEN list_max(list_transform(string_split_regex(raw_text, '[ \t\r\n]'), lambda x: length(x))) > 4000 THEN 'hard' ELSE 'natural' END AS boundary
FROM items WHERE length(raw_text) > 4000
"""


@query
def p5_found(spark, folder):
    return lines.repeated_lines(table(spark, folder, "filings"), "accession_number", "ticker", "raw_text")


@query
def p5_clean(spark, folder):
    return lines.without_repeated_lines(table(spark, folder, "filings"), "accession_number", "ticker", "raw_text")


ORACLES["p5_found"] = r"""
WITH docs AS (
  SELECT accession_number, min(upper(trim(ticker))) AS s, min(raw_text) AS t FROM filings WHERE trim(ticker) <> '' AND raw_text <> '' GROUP BY 1),
cut AS (SELECT accession_number, s, string_split(t, chr(10)) AS lines FROM docs),
each AS (SELECT accession_number, s, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS n FROM cut),
keyed AS (
  SELECT accession_number, s, n, lower(regexp_replace(line, '[^\pL]', '', 'g')) AS letters FROM each
  WHERE NOT regexp_matches(line, '^\s*(?i:item|part)(?:[^\pL\pN_]|$)')),
sizes AS (SELECT s, count(*) AS docs FROM docs GROUP BY 1),
repeated AS (
  SELECT s, letters FROM keyed JOIN sizes USING (s) WHERE length(letters) >= 25 GROUP BY s, letters
  HAVING count(DISTINCT accession_number) >= 4 AND count(DISTINCT accession_number) >= 0.2 * any_value(docs))
SELECT accession_number, CAST(n AS INTEGER) AS line_no FROM keyed JOIN repeated USING (s, letters)
"""


@query
def p3_found(spark, folder):
    return neardup.similar_pairs(table(spark, folder, "filings"), "accession_number", "raw_text", ("accession_a", "accession_b"))


@query
def p3_groups(spark, folder):
    return neardup.similar_groups(table(spark, folder, "filings"), "accession_number", "raw_text")


def _mixture(spark, folder):
    sized = tokens.encode_column(table(spark, folder, "documents"), "doc_id", "text", counts_only=True, carry=("source",))
    return mixing.mixture(sized, table(spark, folder, "mix_targets"))


@query
def p7_mixture(spark, folder):
    return _mixture(spark, folder)[0]


@query
def p7_shares(spark, folder):
    return _mixture(spark, folder)[1]


@query
def p8_found(spark, folder):
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_grades")).where("reading_level is not null").dropDuplicates(["doc_id"])
