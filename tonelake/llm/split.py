"""Texts above a size limit, cut into overlapping pieces at natural boundaries (problem 2).

One regular expression with bounded quantifiers eats the text from the left: its alternatives are ordered by the
strength of the boundary they end at (paragraph, sentence, line, word), each takes as much as fits, and only where none
fits does the last one cut after a fixed number of characters. The bodies so found are the whole text, without gaps.
A second expression looks back from the start of each body for the overlap. Everything stays in array functions
of the JVM; sizes are in Unicode code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.storage import one_of_each, spread

LIMIT, OVERLAP = 4000, 200
#: how far the overlap may be from OVERLAP, to start at a natural unit
SLACK = 50


def body_pattern(limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> str:
    """Alternatives, the strongest boundary first. A body leaves room for the overlap before it, except one long word.

    A body never ends inside a run without space, tab or line break, but by the last alternative, which is group 1: it is reached only at
    the start of a run longer than the limit (and within it), so a text has a body of group 1 if and only if it holds such a run.
    """
    room = limit - overlap - slack
    take = rf"[\s\S]{{1,{room}}}"
    return "|".join([
        rf"[\s\S]{{1,{room}}}+\z",
        take + r"(?<=\n[ \t]{0,8}\r?\n|\r[ \t]{0,8}\r)(?![\r\n])",
        take + r"(?<=[.!?][\"')\]\u201d\u2019]{0,2}[ \t\r\n]{1,4})(?![ \t\r\n])",
        take + r"(?<=[\r\n])(?!\n)",
        take + r"(?<=[ \t])(?![ \t])",
        take + r"(?<=[ \t\r\n])",
        rf"[^ \t\r\n]{{{room},{limit}}}(?=[ \t\r\n]|\z)",
        rf"([\s\S]{{{room}}})",
    ])


def lookback_patterns(overlap: int = OVERLAP, slack: int = SLACK) -> tuple[str, str]:
    """What a piece shares with the one before, at the end of a stretch of overlap + slack (sentence or line starts) or overlap + slack // 3 characters (word starts)."""
    low = overlap - slack - 1
    return rf"(?<=[.!?][ \t\r\n]|[\r\n])[^ \t\r\n][\s\S]{{{low},}}\z", rf"(?<=[ \t\r\n])[^ \t\r\n][\s\S]{{{low},}}\z"


def _items(df: DataFrame, source: str, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.lit(source).alias("s"), F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))


def cut_kinds(df: DataFrame, source: str, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """source_table, item_key, boundary of each item above the limit, once for each key.

    boundary is hard where the alternative that cuts after a fixed number of characters was the one that matched, which happens in a
    run without space, tab or line break longer than the limit; else natural. A key with several texts is hard if one of them is.
    Items with a null key are left out; null, empty and short texts are no items. Other columns are ignored.
    """
    by_count = F.regexp_extract_all("t", F.lit(body_pattern(limit, overlap, slack)), F.lit(1))
    kind = F.when(F.exists(by_count, lambda x: x != ""), "hard").otherwise("natural")
    cut = spread(_items(df, source, key, text)).where(F.length("t") > limit)
    return cut.select(F.col("s").alias("source_table"), F.col("k").alias("item_key"), kind.alias("boundary")).groupBy("source_table", "item_key").agg(F.min("boundary").alias("boundary"))


def pieces(df: DataFrame, source: str, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """source_table, item_key, piece_no (from 0), start (offset of the piece), shared (characters it shares with the piece before), piece.

    Every piece has at most limit characters; the pieces without what they share are the text, without gaps. A text of
    at most limit characters is one piece; null and empty texts have none. Of rows with the same key one is taken (the
    first by its text); rows with a null key are left out. Other columns are ignored.
    """
    one = one_of_each(spread(_items(df, source, key, text).where(F.length("t") > 0)), ["s", "k"], "t")
    b = F.when(F.length("t") <= limit, F.array("t")).otherwise(F.regexp_extract_all("t", F.lit(body_pattern(limit, overlap, slack)), F.lit(0)))
    starts = F.expr("aggregate(b, array(0), (a, x) -> array_append(a, element_at(a, -1) + length(x)))")
    # what precedes a body as far as the overlap can reach, over as many bodies as that takes: several in a row may be short
    before = F.expr(f"aggregate(b, array(''), (a, x) -> array_append(a, right(concat(element_at(a, -1), x), {overlap + slack})))")
    by_sentence, by_word = lookback_patterns(overlap, slack)

    def piece(i):
        body = F.element_at("b", i + 1)
        tail = F.element_at("p", i + 1)
        units = [F.regexp_extract(tail, by_sentence, 0), F.regexp_extract(F.right(tail, F.lit(overlap + slack // 3)), by_word, 0)]
        found = F.coalesce(*[F.nullif(u, F.lit("")) for u in units], F.right(tail, F.lit(overlap)))
        room = F.lit(limit) - F.length(body)
        shared = F.when(i == 0, "").otherwise(F.when(F.length(found) <= room, found).otherwise(F.right(found, room)))
        return F.struct(i.alias("n"), (F.element_at("e", i + 1) - F.length(shared)).alias("at"), F.length(shared).alias("o"), F.concat(shared, body).alias("x"))

    cut = one.select("s", "k", b.alias("b")).withColumns({"e": starts, "p": before}).select("s", "k", F.inline(F.transform(F.sequence(F.lit(0), F.size("b") - 1), piece)))
    return cut.select(F.col("s").alias("source_table"), F.col("k").alias("item_key"), F.col("n").alias("piece_no"), F.col("at").alias("start"), F.col("o").alias("shared"), F.col("x").alias("piece"))
