"""Sections of filings, turns and question pairs of calls, and chunks with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tonelake.functions import text as T

# Chunk and overlap in tokens, and the headings of filings by section.
SIZE, OVERLAP = 512, 64
# Which headings open a section, in the order in which they are looked for; the section they open.
OPENED = {"business": "cover", "risk_factors": "risk_factors", "mda": "mda", "financial_statements": "financial_statements", "quantitative_disclosures": "mda", "controls": "mda"}
_ANY = "(?i)(?:" + "|".join(T.SECTION_HEADINGS[h] for h in OPENED) + ")"
OFFICERS = ("CEO", "CFO", "COO", "IR")


def _once(df: DataFrame, key: str, made: Column, name: str) -> DataFrame:
    """key and a column that is costly to make. It comes out of a generator, so what follows reads it and doesn't make it again."""
    return df.select(key, F.inline(F.array(F.struct(made.alias(name)))))


def sections(filings: DataFrame, key: str, text: str = "text", least: int = 200) -> DataFrame:
    """key, section, n, body: the text from each heading to the next; those of at most `least` characters are dropped, a text without heading is one mda."""
    mark = F.regexp_replace(text, f"({_ANY})", "\u0001$1")
    cut = _once(filings, key, F.split(mark, "\u0001"), "_parts").where("size(_parts) > 1 or _parts[0] <> ''")
    rows = cut.select(key, F.posexplode("_parts").alias("n", "body"), F.size("_parts").alias("of"))
    kind = F.lit("unknown")
    for heading, section in reversed(OPENED.items()):
        kind = F.when(F.col("body").rlike(f"(?i)\\A(?:{T.SECTION_HEADINGS[heading]})"), section).otherwise(kind)
    kind = F.when(F.col("of") == 1, "mda").otherwise(kind)
    body = F.when(F.col("of") == 1, F.col("body")).otherwise(T.stripped(F.col("body")))
    return rows.select(key, kind.alias("section"), "n", body.alias("body"), "of").where(((F.col("n") > 0) & (F.length("body") > least)) | (F.col("of") == 1)).drop("of")


def merged_sections(filings: DataFrame, key: str, text: str = "text", least: int = 200) -> DataFrame:
    """key, section, body: one row for each section of a text, its parts in order, an empty line between them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"])
    return sections(filings, key, text, least).groupBy(key, "section").agg(F.array_join(parts, "\n\n").alias("body"))


# A line's label (name, title), with the time before it; what parts questions from remarks; what says that questions begin.
_TIME = r"(?:[\[(]?\d{1,2}:\d{2}(?::\d{2})?[\])]?[ \t]*(?:-[ \t]*)?)?"
LABEL = rf"^{_TIME}([A-Z][\w.' -]{{2,50}}?)(?:[ \t]*(?:--|[-–—,])[ \t]*([A-Za-z &,.]+?))?[ \t]*(?:\([^()]*\))?:[ \t]*"
QA_START = r"question.and.answer|q\s*[&and]+\s*a\s+session|q\s*[&and]+\s*a\s+portion"
QA_MARKERS = r"\b(?:question.and.answer|q\s?&\s?a session|questions and answers|q&a)\b"


def line_turns(calls: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, turn_index, speaker, role, body out of lines that begin with `Name:`, `Name -- Title:` or `Name, Title:`, after a time or not; following lines belong to the last speaker.

    Names of fewer than three characters or of digits alone are none; turns under ten characters are dropped, the rest numbered from 0.
    """
    lines = _once(calls, key, F.split(text, r"\r\n|\r|\n"), "_lines").select(key, F.posexplode("_lines").alias("n", "line"))
    lines = lines.withColumn("speaker", F.nullif(F.trim(F.regexp_extract("line", LABEL, 1)), F.lit(""))).withColumn("title", F.regexp_extract("line", LABEL, 2))
    w = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("turn", F.count("speaker").over(w)).where("turn > 0")
    body = F.regexp_replace("line", LABEL, "")
    turns = lines.groupBy(key, "turn").agg(F.max("speaker").alias("speaker"), F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("n", body.alias("b")))).alias("b"))
    turns = turns.withColumn("body", F.trim(F.array_join(F.transform("b", lambda x: x["b"]), " "))).where((F.length("body") >= 10) & ~F.col("speaker").rlike(r"^\d+$"))
    return turns.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("turn")) - 1).alias("turn_index"), "speaker", T.speaker_role(F.concat_ws(" ", "speaker", "title")).alias("role"), "body")


def marked_turns(calls: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Turns with their section, each section numbered from 0: the text is cut once, where it first speaks of the questions and answers; without that all are prepared remarks.

    A side without a label is one turn of Unknown. The words that mark the cut are in neither side.
    """
    sides = F.split(F.regexp_replace(F.col(text), f"(?is)\\A(.*?)(?:{QA_START})", "$1\u0001"), "\u0001", 2)
    rows = calls.where(F.length(text) > 0).select(key, F.posexplode(sides).alias("side", "body")).where(T.stripped(F.col("body")) != "")
    rows = rows.select(F.struct(key, F.when(F.col("side") == 0, "prepared_remarks").otherwise("qa").alias("section")).alias("s"), "body")
    turns = line_turns(rows, "s", "body").select("s", "turn_index", "speaker", "role", "body")
    # whether a side has a label is told by its own text, without a join
    plain = rows.where(~F.col("body").rlike(f"(?md){LABEL}")).select("s", F.lit(0).alias("turn_index"), F.lit("Unknown").alias("speaker"), F.lit("unknown").alias("role"), T.stripped(F.col("body")).alias("body"))
    return turns.unionByName(plain).select(f"s.{key}", "s.section", "turn_index", "speaker", "role", "body")


def speakers(turns: DataFrame, key: str) -> DataFrame:
    """key and the names of everybody who speaks, sorted, each once."""
    return turns.groupBy(key).agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))


def first_question(turns: DataFrame, key: str) -> DataFrame:
    """Turns with their section: qa from the first one (not the very first) that speaks of questions and answers, is an analyst's, or is an operator's after the third."""
    w = Window.partitionBy(key)
    mark = (F.col("turn_index") > 0) & (F.col("body").rlike(f"(?i){QA_MARKERS}") | (F.col("role") == "Analyst") | ((F.col("role") == "Operator") & (F.col("turn_index") > 2)))
    start = F.min(F.when(mark, F.col("turn_index"))).over(w)
    return turns.withColumn("section", F.when(F.col("turn_index") >= start, "qa").otherwise("prepared_remarks"))


def question_pairs(turns: DataFrame, key: str) -> DataFrame:
    """An analyst's question with the officer's answer right after it, or alone; officers' other turns alone; the rest is left out, and so are bodies of at most 50 characters."""
    w = Window.partitionBy(key).orderBy("turn_index")
    x = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("next_body", F.lead("body").over(w)).withColumn("last_role", F.lag("role").over(w))
    asks = F.col("role") == "Analyst"
    answer = F.when(F.col("next_role").isin(*OFFICERS), F.col("next_body")).otherwise("")
    alone = F.col("role").isin(*OFFICERS) & ~F.coalesce(F.col("last_role") == "Analyst", F.lit(False))
    body = F.when(asks, T.stripped(F.concat(F.lit("Q: "), "body", F.lit("\n\nA: "), answer))).when(alone, F.col("body"))
    return x.select(key, "turn_index", F.when(asks, "QA_PAIR").otherwise(F.col("role")).alias("speaker"), body.alias("body")).where(F.length("body") > 50)


def built(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Chunk rows (doc, ticker, form, section, quarter, year, place, text, strategy, speaker) as chunks: chunk_id, its place in the document and how many there are, words, numbers.

    A chunk with a guidance keyword is of the guidance section. The id is a digest of document, section, place and text, so the same input has the same ids again.
    With `most` the document's first so many chunks stay and total_chunks counts those; without, all do.
    """
    w = Window.partitionBy("doc").orderBy("place")
    section = F.when((F.col("section") == "guidance") | T.has_guidance_keyword(F.col("text")), "guidance").otherwise(F.col("section"))
    x = rows.withColumn("chunk_index", F.row_number().over(w) - 1).withColumn("section", section)
    if most is not None:
        x = x.where(F.col("chunk_index") < most)
    x = x.withColumn("total_chunks", F.count("*").over(Window.partitionBy("doc")).cast("int"))
    digest = F.substring(F.sha2(F.concat_ws("|", "doc", "section", "chunk_index", "text"), 256), 1, 16)
    return x.select(digest.alias("chunk_id"), "doc", "text", "ticker", "form", "section", "quarter", "year", "chunk_index", "total_chunks", T.word_count(F.col("text")).alias("words"), (T.financial_numbers(F.col("text")) > 0).alias("contains_numbers"), "speaker", "strategy")


REPORTS = ("10-K", "10-K/A", "10-Q", "10-Q/A")


def filing_chunks(filings: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks of filings (doc, ticker, form, quarter, year, text): reports by section in windows, 8-K as press releases where their sentences change subject, others in windows of unknown section."""
    from tonelake.operators.models import embed

    about = ["doc", "ticker", "form", "quarter", "year"]
    parts = merged_sections(filings.withColumn("k", F.struct(*about)), "k").withColumn("place", F.array_position(F.array(*map(F.lit, dict.fromkeys(OPENED.values()))), "section"))
    reports = windows(parts.where(F.col("k.form").isin(*REPORTS)).select(F.struct("k", "section", "place").alias("s"), "body"), "s", "body")
    reports = reports.select("s.k", "s.section", F.struct(F.col("s.place").cast("bigint").alias("a"), F.col("chunk_index").cast("bigint").alias("b")).alias("place"), F.col("chunk").alias("text"), F.lit("section_aware").alias("strategy"))
    whole = parts.where(~F.coalesce(F.col("k.form").isin(*REPORTS), F.lit(False))).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    place = F.struct(F.lit(0).cast("bigint").alias("a"), F.col("chunk_index").cast("bigint").alias("b")).alias("place")
    release = whole.where(F.col("k.form") == "8-K").select("k", F.posexplode(T.sentences(F.col("body"))).alias("n", "sentence"))
    release = semantic_chunks(embed(release, "sentence"), "k").select("k", F.lit("press_release").alias("section"), place, F.col("chunk").alias("text"), F.lit("semantic").alias("strategy"))
    other = windows(whole.where(~F.coalesce(F.col("k.form") == "8-K", F.lit(False))), "k", "body").select("k", F.lit("unknown").alias("section"), place, F.col("chunk").alias("text"), F.lit("fixed_overlap").alias("strategy"))
    rows = reports.unionByName(release).unionByName(other)
    return built(rows.select("k.*", "section", "place", "text", "strategy", F.lit("").alias("speaker")), most)


def call_chunks(turns: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks of calls out of turns (doc, ticker, quarter, year, section, turn_index, speaker, role, body): a remark that isn't the operator's, a question with its answer, an officer's other turn; long ones in windows."""
    about = ["doc", "ticker", "quarter", "year"]
    t = turns.withColumn("k", F.struct(*about))
    remarks = t.where("section = 'prepared_remarks' and role <> 'Operator'").select("k", "section", "turn_index", F.col("role").alias("speaker"), "body")
    asked = question_pairs(t.where("section = 'qa'"), "k").select("k", F.lit("qa").alias("section"), "turn_index", "speaker", "body")
    whole = asked.where("speaker = 'QA_PAIR'").select("k", "section", "turn_index", F.lit(0).alias("chunk_index"), "speaker", F.col("body").alias("text"))
    long = remarks.unionByName(asked.where("speaker <> 'QA_PAIR'")).select(F.struct("k", "section", "turn_index", "speaker").alias("s"), "body")
    cut = windows(long, "s", "body").select("s.k", "s.section", "s.turn_index", "chunk_index", "s.speaker", F.col("chunk").alias("text"))
    rows = whole.unionByName(cut)
    order = F.struct(F.when(F.col("section") == "qa", 1).otherwise(0).cast("bigint").alias("side"), F.col("turn_index").cast("bigint").alias("a"), F.col("chunk_index").cast("bigint").alias("b")).alias("place")
    return built(rows.select("k.*", F.lit("transcript").alias("form"), "section", order, "text", F.lit("speaker_turn").alias("strategy"), "speaker"), most)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _packed(column: pd.Series) -> pd.Series:
    def pack(sentences):
        out, held, size = [], [], 0
        for s in sentences if sentences is not None else ():
            n = max(1, len(s) // 4)
            if held and size + n > SIZE:
                out.append(held)
                kept, size = [], 0
                for old in reversed(held):
                    kept.insert(0, old)
                    size += max(1, len(old) // 4)
                    if size >= OVERLAP:
                        break
                held = kept
            held = [*held, s]
            size += n
        return [*out, held] if held else out

    return column.map(pack)


@F.pandas_udf(ArrayType(IntegerType()))
def _breaks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def split(tokens, similar):
        out, group, size = [], 0, 0
        tokens, similar = (list(v) if v is not None else [] for v in (tokens, similar))
        for i, n in enumerate(tokens):
            out.append(group)
            size += n
            if i < len(similar) and (size >= SIZE or similar[i] is not None and similar[i] < 0.75 and size >= SIZE / 2):
                group, size = group + 1, 0
        return out

    for tokens, similar in batches:
        yield pd.Series([split(t, s) for t, s in zip(tokens, similar)])


def windows(texts: DataFrame, key: str, text: str = "text", most: int | None = None) -> DataFrame:
    """key, chunk_index, total_chunks, chunk, words: sentences packed up to SIZE tokens, each chunk with at least OVERLAP tokens of the one before; all chunks of a text, or the first `most` of the total_chunks that it has."""
    packed = texts.select(F.col(key).alias("_key"), _packed(T.sentences(F.col(text))).alias("_all"))
    kept = F.col("_all") if most is None else F.slice("_all", 1, most)
    rows = packed.select("_key", F.size("_all").alias("total_chunks"), F.posexplode(kept).alias("chunk_index", "_said"))
    return rows.select(F.col("_key").alias(key), "chunk_index", "total_chunks", F.array_join("_said", " ").alias("chunk")).withColumn("words", T.word_count(F.col("chunk")))


def semantic_chunks(sentences: DataFrame, key: str) -> DataFrame:
    """sentences (key, n, sentence, embedding) to chunks: a break where neighbours are unlike and half a chunk is full, or where it is full."""
    from tonelake.functions.numbers import cosine

    w = Window.partitionBy(key).orderBy("n")
    x = sentences.withColumn("next", cosine(F.col("embedding"), F.lead("embedding").over(w)))
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "sentence", "next"))).alias("s"))
    g = g.withColumn("at", _breaks(F.transform("s", lambda v: T.token_count(v["sentence"])), F.transform("s", lambda v: v["next"])))
    rows = g.select(key, F.inline(F.arrays_zip("at", "s"))).select(key, F.col("at").alias("chunk_index"), "s.n", "s.sentence")
    return rows.groupBy(key, "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda v: v["sentence"]), " ").alias("chunk"))


def tag(chunks: DataFrame, keep_text: bool = False) -> DataFrame:
    """Sections and quarters as the text tells them, numbers counted, tone labelled, speakers (where there are any) as roles.

    Questions and prepared remarks keep their section, the fourth quarter of an annual report its quarter.
    """
    text, section = F.col("text"), F.col("section")
    numbers = T.financial_numbers(text)
    free = ~section.isin("qa", "prepared_remarks")
    new = F.when(free & text.rlike(T.GUIDANCE_PATTERN) & (numbers > 0), "guidance").when((section == "unknown") & text.rlike(T.RISK_PATTERN), "risk_factors").when((section == "unknown") & text.rlike(T.HIGHLIGHT_PATTERN), "financial_statements").otherwise(section)
    annual = (F.col("quarter") == "Q4") & F.col("form").isin("10-K", "10-K/A") if "form" in chunks.columns else F.lit(False)
    quarter = F.when(F.coalesce(annual, F.lit(False)), F.col("quarter")).otherwise(F.coalesce(T.quarter_in_text(text), F.col("quarter")))
    more = [T.chunk_speaker(F.col("speaker")).alias("speaker")] if "speaker" in chunks.columns else []
    return chunks.select("chunk_id", "ticker", new.alias("section"), quarter.alias("quarter"), "year", (numbers > 0).alias("contains_numbers"), T.quick_sentiment(text).alias("tone"), *more, *(["text"] if keep_text else []))


def guidance_chunks(tagged: DataFrame) -> DataFrame:
    """Chunks of the guidance section, and chunks of any section that have numbers and speak of guidance."""
    return tagged.where((F.col("section") == "guidance") | (F.col("contains_numbers") & F.col("text").rlike(T.GUIDANCE_PATTERN)))
