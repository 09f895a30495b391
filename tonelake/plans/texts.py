"""Queries on the text of filings, calls and documents: cleaning, sections, turns, chunks, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import text as T
from tonelake.operators import articles, chunking, guidance, models
from tonelake.plans import expected as E
from tonelake.plans.catalog import query, table
from tonelake.plans.expected import count_of
from tonelake.sources import files, tables
from tonelake.storage import spread, stage

# The SQL of the cleaner, written out.
_SPACE = r"[\s\x0B\x{85}\p{Z}]"


def _subbed(x: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return x


def _swapped(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


_NO_TAGS = _subbed("raw_text", (r"(?i)<ix:[^>]+>|</ix:[^>]+>", " "), (r"(?is)<SEC-HEADER>.*?</SEC-HEADER>", ""), (r"(?i)</?(?:SEC-DOCUMENT|SEQUENCE|FILENAME|DESCRIPTION|TYPE|TEXT)>", ""), (r"<[^>]+>", " "))
_DECODED = _subbed(_swapped(_NO_TAGS, ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&#8212;", "—"), ("&#8211;", "–"), ("&#8216;", "'"), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"')), (r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);", " "))
_PLAIN = _subbed(_swapped(f"nfc_normalize({_DECODED})", ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), ("…", "..."), ("\u00a0", " "), ("\u200b", ""), ("\u00ad", ""), ("\ufeff", "")), (r"[^\PC\n\t]", " "))
_PHRASES = [
    r"this report contains forward.looking statements[^\n]*", r"see accompanying notes to (?:condensed )?(?:consolidated )?financial statements", r"the following discussion should be read in conjunction with[^\n]*",
    r"for the (?:three|six|nine|twelve) months? ended[^\n]{0,60}", r"table of contents", r"index to financial statements", r"(?:incorporated herein by reference|incorporated by reference)[^\n]*",
]
_LINES = ((r"\f", "\n"), (r"(?m)^[\-=*_~#]{3,}\s*$", ""), (r"(?m)^.{0,80}\.{3,}\s*\d+\s*$", ""), (r"(?m)^\s*\d{1,4}\s*$", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (rf"\A{_SPACE}+|{_SPACE}+\z", ""))
_CLEAN = _subbed(_PLAIN, (r"(?i)(?:Exhibit|EX)-?\d{1,3}(?:\.\d{1,2})?[^\n]*\n", ""), *((f"(?i){p}", "") for p in _PHRASES), *_LINES)
_CALL = _subbed(
    _PLAIN, (r"(?i)(?:This transcript|The following|Motley Fool|Seeking Alpha)[^\n]*(?:transcription|transcript service|accuracy)[^\n]*", ""),
    (r"(?im)^(?:Operator|Coordinator):\s*(?:Thank you[,.]?|Ladies and gentlemen[,.]?|Please (?:stand by|hold)[,.]?|Your (?:next|first) question[^\n]*)[^\n]*$", ""), *((f"(?i){p}", "") for p in _PHRASES), *_LINES,
)
_FLAT = _subbed(_swapped(_subbed("raw_text", (r"(?is)<ix:[^>]+>.*?</ix:[^>]+>", " "), (r"<[^>]+>", " ")), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"')), (rf"{_SPACE}+", " "))


def _filings(spark, folder):
    return spread(table(spark, folder, "filings").where("accession_number is not null and raw_text is not null").select("accession_number", "raw_text").dropDuplicates(["accession_number"]))


def _calls(spark, folder):
    return spread(table(spark, folder, "transcripts").where("transcript_id is not null and raw_text is not null").select("transcript_id", "raw_text").dropDuplicates(["transcript_id"]))


@query(f"SELECT DISTINCT accession_number, {_CLEAN} AS cleaned, length(trim({_FLAT}, ' ')) AS flat_length FROM filings WHERE accession_number IS NOT NULL AND raw_text IS NOT NULL")
def clean_texts(spark, folder):
    return _filings(spark, folder).select("accession_number", T.clean_filing(F.col("raw_text")).alias("cleaned"), F.length(T.flat_html(F.col("raw_text"))).alias("flat_length"))


@query()
def parsed_texts(spark, folder):
    """Pages by their visible text, other filings as they are, both cleaned."""
    return _filings(spark, folder).select("accession_number", files.parsed(F.col("raw_text")).alias("text"))


@query(f"SELECT DISTINCT transcript_id, {_CALL} AS cleaned FROM transcripts WHERE transcript_id IS NOT NULL AND raw_text IS NOT NULL")
def clean_calls(spark, folder):
    return _calls(spark, folder).select("transcript_id", T.clean_call(F.col("raw_text")).alias("cleaned"))


@query(f"SELECT DISTINCT guidance_id, {_subbed(_PLAIN, *_LINES)} AS cleaned FROM guidance WHERE guidance_id IS NOT NULL AND raw_text IS NOT NULL")
def clean_analyst_notes(spark, folder):
    return table(spark, folder, "guidance").where("guidance_id is not null and raw_text is not null").select("guidance_id", T.clean_analyst(F.col("raw_text")).alias("cleaned")).distinct()


@query(f"SELECT doc_id, trim({_subbed('text', (E.REPORT_PHRASES, ' '), (rf'{_SPACE}+', ' '))}, ' ') AS cleaned FROM documents WHERE text IS NOT NULL")
def report_phrases(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.without_report_phrases(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {count_of(E.ANY_NUMBER)} AS numbers, {count_of(E.ANY_NUMBER)} > 0 AS any FROM documents WHERE text IS NOT NULL")
def any_number_counts(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.any_numbers(t).alias("numbers"), T.has_numbers(t).alias("any"))


_MARKED = _subbed(
    _subbed("text", (r"(?i)(item\s+1\.?\s+busi)(ness\s+of)", "\\1\x02\\2")),
    (r"(?i)(item\s+1\.?\s+business|item\s+1a\.?\s+risk\s+factors|item\s+[27]\.?\s+management(?:'s|\s+discussion|'s\s+discussion)\s+and\s+analysis|item\s+[18]\.?\s+(?:financial\s+statements|consolidated\s+balance)|item\s+(?:3|7a)\.?\s+quantitative\s+and\s+qualitative\s+disclosures|item\s+(?:4|9a)\.?\s+controls\s+and\s+procedures)", "\x01\\1"),
)
SECTIONS = rf"""ct AS (SELECT DISTINCT accession_number, {_CLEAN} AS text FROM filings WHERE accession_number IS NOT NULL AND raw_text IS NOT NULL),
cut AS (SELECT accession_number, string_split({_MARKED}, chr(1)) AS p FROM ct WHERE text <> ''),
part AS (SELECT accession_number, len(p) AS many, unnest(p) AS body, generate_subscripts(p, 1) AS n FROM cut),
kind AS (SELECT accession_number, n, CASE WHEN many = 1 THEN 'mda' WHEN regexp_matches(body, '(?i)\A(?:item\s+1\.?\s+business)') THEN 'cover' WHEN regexp_matches(body, '(?i)\Aitem\s+1a') THEN 'risk_factors' WHEN regexp_matches(body, '(?i)\Aitem\s+[27]\.?\s+management') THEN 'mda'
    WHEN regexp_matches(body, '(?i)\Aitem\s+[18]\.?\s+(?:financial|consolidated)') THEN 'financial_statements' ELSE 'mda' END AS section,
  replace(CASE WHEN many = 1 THEN body ELSE {_subbed('body', (rf"\A{_SPACE}+|{_SPACE}+\z", ""))} END, chr(2), '') AS body, many FROM part)"""


@query(f"WITH {SECTIONS} SELECT accession_number, section, string_agg(body, chr(10) || chr(10) ORDER BY n) AS body FROM kind WHERE many = 1 OR (n > 1 AND length(body) > 200) GROUP BY accession_number, section")
def section_split(spark, folder):
    return chunking.merged_sections(_filings(spark, folder).select("accession_number", T.clean_filing(F.col("raw_text")).alias("text")), "accession_number")


_CUT = _subbed("text", (r"(?i)\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|approx|est)\.", "\\1\x01"), (r"\b([A-Z])\.", "\\1\x01"), (r"([.!?])[ \t\n\x0B\f\r]+([A-Z\"])", "\\1\x02\\2"))


@query(rf"""WITH s AS (SELECT doc_id, string_split({_CUT}, chr(2)) AS s FROM documents WHERE text <> ''),
each AS (SELECT doc_id, generate_subscripts(s, 1) AS i, {_subbed("replace(unnest(s), chr(1), '.')", (rf"\A{_SPACE}+|{_SPACE}+\z", ""))} AS sentence FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, sentence FROM each WHERE sentence <> ''""")
def sentence_split(spark, folder):
    return table(spark, folder, "documents").where("text <> ''").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query()
def chunk_windows(spark, folder):
    return chunking.windows(table(spark, folder, "documents").where("text <> ''"), "doc_id")


# --- calls

_LABEL = r"^(?:[\[(]?\d{1,2}:\d{2}(?::\d{2})?[\])]?[ \t]*(?:-[ \t]*)?)?([A-Z][\w.'' -]{2,50}?)(?:[ \t]*(?:--|[-–—,])[ \t]*([A-Za-z &,.]+?))?[ \t]*(?:\([^()]*\))?:[ \t]*"
TURNS = rf"""c AS (SELECT DISTINCT transcript_id, {_CALL} AS text FROM transcripts WHERE transcript_id IS NOT NULL AND raw_text IS NOT NULL),
l AS (SELECT transcript_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS n FROM c WHERE text <> ''),
m AS (SELECT *, nullif(trim(regexp_extract(line, '{_LABEL}', 1), ' '), '') AS speaker, regexp_extract(line, '{_LABEL}', 2) AS title, regexp_replace(line, '{_LABEL}', '') AS body FROM l),
g AS (SELECT *, count(speaker) OVER (PARTITION BY transcript_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS turn FROM m),
u AS (SELECT transcript_id, turn, max(speaker) AS speaker, max(title) AS title, trim(string_agg(body, ' ' ORDER BY n), ' ') AS body FROM g WHERE turn > 0 GROUP BY ALL),
t AS (SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, speaker, {E.ROLE.format(c="(speaker || ' ' || title)")} AS role, body FROM u WHERE length(body) >= 10 AND NOT regexp_matches(speaker, '^[0-9]+$'))"""


def _turns(spark, folder):
    return chunking.line_turns(_calls(spark, folder).select("transcript_id", T.clean_call(F.col("raw_text")).alias("text")), "transcript_id")


@query(rf"""WITH {TURNS}, b AS (SELECT *, min(CASE WHEN turn_index > 0 AND (regexp_matches(body, '(?i)\b(?:question.and.answer|q\s?&\s?a session|questions and answers|q&a)\b') OR role = 'Analyst' OR (role = 'Operator' AND turn_index > 2)) THEN turn_index END) OVER (PARTITION BY transcript_id) AS start FROM t)
SELECT transcript_id, turn_index, speaker, role, body, CASE WHEN turn_index >= start THEN 'qa' ELSE 'prepared_remarks' END AS section FROM b""")
def call_turns(spark, folder):
    return chunking.first_question(_turns(spark, folder), "transcript_id")


@query(rf"""WITH {TURNS}, w AS (SELECT *, lead(role) OVER o AS nr, lead(body) OVER o AS nb, lag(role) OVER o AS lr FROM t WINDOW o AS (PARTITION BY transcript_id ORDER BY turn_index)),
p AS (SELECT transcript_id, turn_index, CASE WHEN role = 'Analyst' THEN 'QA_PAIR' ELSE role END AS speaker,
  CASE WHEN role = 'Analyst' THEN {_subbed("('Q: ' || body || chr(10) || chr(10) || 'A: ' || CASE WHEN nr IN ('CEO', 'CFO', 'COO', 'IR') THEN nb ELSE '' END)", (rf"\A{_SPACE}+|{_SPACE}+\z", ""))} WHEN role IN ('CEO', 'CFO', 'COO', 'IR') AND lr IS DISTINCT FROM 'Analyst' THEN body END AS body FROM w)
SELECT * FROM p WHERE length(body) > 50""")
def qa_pairs(spark, folder):
    return chunking.question_pairs(_turns(spark, folder), "transcript_id")


@query(f"WITH {TURNS} SELECT transcript_id, list_sort(list_distinct(list(speaker))) AS speakers FROM t GROUP BY transcript_id")
def call_speakers(spark, folder):
    return chunking.speakers(_turns(spark, folder), "transcript_id")


@query()
def marked_turns(spark, folder):
    return chunking.marked_turns(_calls(spark, folder).select("transcript_id", T.clean_call(F.col("raw_text")).alias("text")), "transcript_id")


@query()
def filing_chunks(spark, folder):
    """Chunks by the form's own strategy."""
    return chunking.filing_chunks(spread(tables.filing_texts(table(spark, folder, "filings"))).withColumnRenamed("accession_number", "doc"))


@query()
def call_chunks(spark, folder):
    calls = tables.call_texts(table(spark, folder, "transcripts")).withColumn("k", F.struct(F.col("transcript_id").cast("string").alias("doc"), "ticker", "quarter", "year"))
    turns = stage(chunking.first_question(chunking.line_turns(spread(calls), "k"), "k"), "turns")
    return chunking.call_chunks(turns.select("k.*", "section", "turn_index", "speaker", "role", "body"))


@query(f"WITH d AS (SELECT DISTINCT trim(split_part(l, ':', 1), ' ') AS title FROM (SELECT unnest(string_split(raw_text, chr(10))) AS l FROM transcripts WHERE raw_text IS NOT NULL) WHERE contains(l, ':')) SELECT title, {E.ARTICLE_ROLE.format(c='title')} AS role FROM d")
def article_roles(spark, folder):
    lines = table(spark, folder, "transcripts").where("raw_text is not null").select(F.explode(F.split("raw_text", "\n")).alias("l")).where("contains(l, ':')")
    titles = lines.select(F.trim(F.element_at(F.split("l", ":"), 1)).alias("title")).distinct()
    return titles.select("title", T.article_role(F.col("title")).alias("role"))


@query()
def article_turns(spark, folder):
    """Calls that came as pages: paragraphs with bold names."""
    pages = _calls(spark, folder).where("raw_text like '%<p>%'")
    return articles.turns(pages, "transcript_id", "raw_text", least=1)


# --- extraction

_TO = r"\s*(?:to|-|and|–|—)\s*"
_DOLLARS = rf"\$?(\d+(?:\.\d+)?)\s*(billion|million|B|M|bn|mm)?(?:{_TO}\$?(\d+(?:\.\d+)?)\s*(billion|million|B|M|bn|mm)?)?"
_CENTS = rf"\$?(\d+\.\d{{1,4}})()(?:{_TO}\$?(\d+\.\d{{1,4}}))?()"
_SHARE = rf"(\d+(?:\.\d+)?)()\s*%?(?:{_TO}(\d+(?:\.\d+)?)\s*%)?()"
_GUIDED = [
    ("EPS", "USD/share", 0.85, rf"(?i)(?:expect|guide|guidance|project|anticipate)\w*\s+(?:earnings\s+per\s+share|EPS|diluted\s+EPS)\s+(?:of\s+|to\s+be\s+|between\s+|in\s+(?:the\s+)?range\s+of\s+)?{_CENTS}", 0.01, 1000),
    ("EPS", "USD/share", 0.85, rf"(?i)EPS\s+guidance\s+of\s+{_CENTS}", 0.01, 1000),
    ("revenue", "USD", 0.85, rf"(?i)(?:expect|guide|project|anticipate|forecast)\w*\s+(?:(?:total\s+)?(?:net\s+)?revenue[s]?|(?:net\s+)?sales)\s+(?:of\s+|to\s+(?:be\s+)?|between\s+|in\s+(?:the\s+)?range\s+of\s+)?{_DOLLARS}", 1e4, 5e12),
    ("revenue", "USD", 0.85, rf"(?i)revenue\s+(?:guidance|outlook)\s+of\s+{_DOLLARS}", 1e4, 5e12),
    ("capex", "USD", 0.80, rf"(?i)(?:capital\s+expenditure[s]?|capex)\s+(?:of\s+|approximately\s+|between\s+)?{_DOLLARS}", 1e4, 1e12),
    ("margin", "%", 0.80, rf"(?i)(?:gross|operating|net|EBITDA)\s+margin\s+(?:of\s+|approximately\s+|between\s+|expected\s+(?:at|to\s+be)\s+)?{_SHARE}", 0.01, 100),
    ("growth", "%", 0.75, rf"(?i)(?:expect|anticipate|project)\w*\s+(?:revenue\s+)?growth\s+(?:of\s+|approximately\s+|between\s+)?{_SHARE}", -100, 10000),
]


def _amounts(source: str, key: str) -> str:
    """SQL: the guided amounts of (key, text) rows, equal ones of a text once."""
    parts = []
    for i, (metric, unit, confidence, pattern, least, most) in enumerate(_GUIDED):
        groups = ", ".join(f"unnest(regexp_extract_all(text, '{pattern}', {g})) AS g{g}" for g in (1, 2, 3, 4))
        parts.append(f"SELECT {key}, {i} AS p, '{metric}' AS metric, '{unit}' AS unit, CAST({confidence} AS DOUBLE) AS confidence, CAST({least} AS DOUBLE) AS least, CAST({most} AS DOUBLE) AS most, {groups} FROM {source}")
    size = lambda c: f"CASE lower({c}) WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'billion' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'mm' THEN 1e6 WHEN 'million' THEN 1e6 ELSE 1 END"
    return f"""m AS ({" UNION ALL ".join(parts)}),
v AS (SELECT *, CAST(g1 AS DOUBLE) * {size('g2')} AS a, CASE WHEN g3 <> '' THEN CAST(g3 AS DOUBLE) * {size("CASE WHEN g4 <> '' THEN g4 ELSE g2 END")} END AS b FROM m),
k AS (SELECT {key}, metric, unit, confidence, CASE WHEN b <> 0 THEN least(a, b) ELSE a END AS low, CASE WHEN b <> 0 THEN greatest(a, b) END AS high FROM v WHERE a BETWEEN least AND most),
found AS (SELECT {key}, metric, any_value(round(low, 4)) + 0.0 AS low, any_value(round(high, 4)) + 0.0 AS high, any_value(unit) AS unit, max(confidence) AS confidence FROM k GROUP BY {key}, metric, round(low, 4), round(high, 4))"""


def _found(texts, key):
    x = guidance.extract_guidance(texts, key)
    return x.select(key, "metric", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "unit", "confidence")


@query(f"WITH t AS (SELECT DISTINCT guidance_id, raw_text AS text FROM guidance WHERE guidance_id IS NOT NULL AND raw_text IS NOT NULL), {_amounts('t', 'guidance_id')} SELECT * FROM found")
def guidance_extract(spark, folder):
    return _found(table(spark, folder, "guidance").where("guidance_id is not null and raw_text is not null").select("guidance_id", F.col("raw_text").alias("text")).distinct(), "guidance_id")


@query(f"""WITH t AS (SELECT 'document ' || doc_id AS text_id, text FROM documents WHERE text <> '' UNION SELECT 'filing ' || accession_number, {_CLEAN} FROM filings WHERE raw_text <> '' UNION SELECT 'call ' || transcript_id, {_CALL} FROM transcripts WHERE raw_text <> '' UNION SELECT 'guidance ' || guidance_id, raw_text FROM guidance WHERE raw_text <> ''),
{_amounts('t', 'text_id')} SELECT * FROM found""")
def guidance_extract_texts(spark, folder):
    """The same over whole texts: documents, filings, calls and sentences of guidance."""
    return _found(_all_texts(spark, folder), "text_id")


@query()
def guidance_mentions(spark, folder):
    """Every guided amount with its period, the text around it, and whether it is a range."""
    return guidance.extract_guidance(_all_texts(spark, folder), "text_id")


def _all_texts(spark, folder):
    named = lambda df, source, key: df.select(F.concat(F.lit(f"{source} "), key).alias("text_id"), "text")
    d = spread(table(spark, folder, "documents").where("doc_id is not null and text <> ''"))
    f, c = tables.filing_texts(table(spark, folder, "filings")), tables.call_texts(table(spark, folder, "transcripts"))
    g = table(spark, folder, "guidance").where("guidance_id is not null and raw_text <> ''").select("guidance_id", F.col("raw_text").alias("text")).distinct()
    return named(d, "document", "doc_id").unionByName(named(f, "filing", "accession_number")).unionByName(named(c, "call", "transcript_id")).unionByName(named(g, "guidance", "guidance_id"))


@query()
def semantic_chunks(spark, folder):
    """The sentences of every document, embedded."""
    d = spread(table(spark, folder, "documents").where("doc_id is not null and text <> ''").dropDuplicates(["doc_id"]))
    sentences = d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return chunking.semantic_chunks(models.embed(sentences, "sentence"), "doc_id")
