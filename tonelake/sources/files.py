"""Readers of files: permissive JSON, whole texts, HTML pages, columnar listings, nested facts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tonelake.functions import text as T

_HIDDEN = {"script", "style", "head", "meta", "noscript"}
FACTS = "facts map<string, struct<units: map<string, array<struct<end: date, val: double, form: string, accn: string>>>>>"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in _HIDDEN and tag != "meta"

    def handle_endtag(self, tag):
        self.depth -= tag in _HIDDEN and tag != "meta" and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(StringType())
def html_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The visible text of pages, a line for each text node."""

    def one(page):
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        return "\n".join(parser.parts)

    for batch in batches:
        yield batch.map(one)


def parsed(raw):
    """A filing's text: of a page its visible text, cleaned; else the text, cleaned. Only pages leave the JVM; null stays null, empty stays empty."""
    page = T.is_markup(raw)
    return F.when(raw == "", "").otherwise(T.clean_filing(F.coalesce(html_text(F.when(page, raw)), raw)))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON arrays, or of a JSON object a line; each malformed row is skipped alone."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.split("value", "\n"))
    row = F.from_json("x", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = whole.select(F.explode(listed).alias("x")).where(F.trim("x") != "").select(row.alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; pages become their visible text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))
    page = F.ltrim("value").startswith("<")
    return raw.select("path", F.when(page, html_text("value")).otherwise(T.squeeze(F.col("value"))).alias("text"), "modified")


def reported_facts(spark: SparkSession, path: str) -> DataFrame:
    """concept, unit, end, value, form of nested facts."""
    f = spark.read.schema(FACTS).option("multiLine", True).json(path)
    c = f.select(F.explode("facts").alias("concept", "v")).select("concept", F.explode("v.units").alias("unit", "entries"))
    return c.select("concept", "unit", F.inline("entries")).select("concept", "unit", F.col("end").alias("ended"), F.col("val").alias("value"), "form", F.col("accn").alias("accession_number"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as plain columns with dotted names."""
    out = []

    def walk(fields, path):
        for f in fields:
            at = [*path, f.name]
            if f.dataType.typeName() == "struct":
                walk(f.dataType.fields, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at)))

    walk(df.schema.fields, [])
    return df.select(*out)
