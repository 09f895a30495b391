"""Lines that one source repeats through its documents (problem 5).

A line is known by the letters in it, as 128 bits of hash, so variants (other case, spacing, page numbers, bullets) share a key. For each
source and line, the documents that hold it are a compressed bitmap: one row for each 64-bit word that isn't empty.
Documents are numbered in order of their source, so a source's documents lie in neighbouring words. Bitmaps of variants
are united by bitwise or, their exact cardinalities are counted, and lines are deleted where a document's bit is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.storage import small_enough, spread, stage

LEAST_LETTERS, LEAST_DOCUMENTS, LEAST_SHARE = 25, 4, 0.2
#: words of the repeated lines' bitmaps that are broadcast at most (24 bytes each); more are joined by a shuffle
BROADCAST_WORDS = 1_000_000
#: lines that start with these words open a section and are never boilerplate
HEADINGS = ("item", "part")


def line_keys(text: str, source: str, least_letters: int, headings: tuple[str, ...]):
    """An array with two hashes of source and letters for each line; null for a line that can't count."""
    opened = rf"(?mid)^[^\S\n]*(?:{'|'.join(headings)})(?![\p{{L}}\p{{N}}_])[^\n]*" if headings else r"(?!)"
    letters = F.lower(F.regexp_replace(F.regexp_replace(F.col(text), opened, ""), r"[^\p{L}\n]+", ""))
    return F.transform(F.split(letters, "\n"), lambda x: F.when(F.length(x) >= least_letters, F.struct(F.xxhash64(F.col(source), x).alias("x"), F.xxhash64(x, F.col(source), F.lit(1)).alias("y"))))


def repeated_lines(
    df: DataFrame, key: str, source: str, text: str,
    least_letters: int = LEAST_LETTERS, least_documents: int = LEAST_DOCUMENTS, least_share: float = LEAST_SHARE, headings: tuple[str, ...] = HEADINGS,
) -> DataFrame:
    """key, line_no (from 1, pieces between \\n) of every line that recurs in its source.

    A line recurs if it has least_letters letters, doesn't start (after spaces) with one of the headings as a whole word,
    and is equal in its letters, in lower case, to lines in at least least_documents and at least least_share of
    the source's documents that have text. Sources compare trimmed and in upper case. Documents with null key, null or blank source, or null or
    empty text are left out. Rows with the same key count once. Other columns are ignored; an empty table gives none.
    """
    rows = df.select(F.col(key).alias("k"), F.upper(F.trim(F.col(source).cast("string"))).alias("s"), F.col(text).cast("string").alias("t"))
    rows = rows.where(F.col("k").isNotNull() & (F.col("s") != "") & (F.length("t") > 0))
    lines = spread(rows).select("k", "s", line_keys("t", "s", least_letters, headings).alias("lines"))
    # The numbering must be the same whenever it's read, so it is written: documents once each, by source.
    once = stage(lines.groupBy("k").agg(F.min("s").alias("s"), F.min_by("lines", "s").alias("lines")).repartitionByRange("s", "k").sortWithinPartitions("s", "k").withColumn("d", F.monotonically_increasing_id()), "lines")
    needs = once.groupBy("s").agg(F.greatest(F.lit(least_documents), F.ceil(F.round(F.count("*") * least_share, 6))).cast("bigint").alias("need"))
    each = once.select("s", "d", F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("line"))
    word, bit = (F.shiftright("d", 6)).alias("word"), F.expr("shiftleft(1L, cast(d & 63 as int))")
    bitmaps = each.groupBy("s", "line", word).agg(F.bit_or(bit).alias("bits"))
    counted = bitmaps.groupBy("s", "line").agg(F.sum(F.bit_count("bits")).alias("documents"))
    kept = counted.where(F.col("documents") >= least_documents).join(needs, "s").where(F.col("documents") >= F.col("need")).select("line")
    kept = stage(kept, "repeated")
    found = stage(_meet(bitmaps, kept, ["line"], small_enough(kept, BROADCAST_WORDS), "left_semi").select("line", "word", "bits"), "bitmaps")
    at = once.select("k", "d", F.posexplode("lines").alias("n", "line")).where(F.col("line").isNotNull()).withColumn("word", F.shiftright("d", 6))
    hit = _meet(at, found, ["line", "word"], small_enough(found, BROADCAST_WORDS), "inner").where(F.expr("shiftright(bits, cast(d & 63 as int)) & 1") == 1)
    return hit.select(F.col("k").alias(key), (F.col("n") + 1).alias("line_no"))


def _meet(left: DataFrame, right: DataFrame, on: list[str], small: bool, how: str) -> DataFrame:
    return left.join(F.broadcast(right) if small else right, on, how)


def without_repeated_lines(df: DataFrame, key: str, source: str, text: str, **bounds) -> DataFrame:
    """key, text and removed (a count): every document once, without the lines that repeated_lines finds.

    Documents that it leaves out come through unchanged, null texts as null; rows with a null key are left out.
    """
    gone = repeated_lines(df, key, source, text, **bounds).groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    once = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.col(text).cast("string")).alias("t"))
    kept = F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("gone", i + 1)), "\n")
    return once.join(gone, key, "left").select(key, F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias(text), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
