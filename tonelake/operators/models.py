"""Models as replaceable functions over columns: a factory is called once in each worker, a failing batch degrades to the neutral result."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from tonelake.functions import text as T

#: dimensions of the default embedding
DIMENSIONS = 64
# Kinds of entities and their patterns; names of a tone model's labels.
ENTITIES = (
    ("MONEY", r"[$€£]\s?\d[\d,]*(?:\.\d+)?(?:\s(?:million|billion))?"), ("PERCENT", r"\d+(?:\.\d+)?\s?%"),
    ("DATE", r"\b(?:Q[1-4] \d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)(?: \d{1,2},)? \d{4})\b"), ("CARDINAL", r"\b\d{1,3}(?:,\d{3})+\b"),
    ("ORG", r"\b[A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+){0,4} (?:Inc|Corp|Corporation|Ltd|LLC|PLC|Group|Holdings|Company|Bank|Capital|Partners)\b"),
    ("GPE", r"\b(?:United States|United Kingdom|European Union|China|Japan|Germany|France|India|Canada|Mexico|Brazil|Italy|Spain|Australia|South Korea|Netherlands|Switzerland|Ireland|Israel|Taiwan|Singapore|Hong Kong|Russia|Turkey|Poland|Sweden|Norway|Europe|Asia|America)\b"),
)
LABELS = {"positive": "positive", "pos": "positive", "label_2": "positive", "negative": "negative", "neg": "negative", "label_0": "negative", "neutral": "neutral", "neu": "neutral", "label_1": "neutral"}
_TONE = StructType([StructField(c, DoubleType()) for c in ("positive", "negative", "neutral")])
_PAIR = StructType([StructField(c, DoubleType()) for c in ("contradiction", "entailment", "neutral")])


def tone_model(load: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]], batch: int = 32):
    """A column function: text to (positive, negative, neutral); 0, 0, 1 where the model fails or text is missing."""

    @F.pandas_udf(_TONE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            out = []
            for i in range(0, len(texts), batch):
                part = [t or "" for t in texts[i : i + batch]]
                try:
                    out += [x if t else (0.0, 0.0, 1.0) for x, t in zip(model(part), part)]
                except Exception:
                    out += [(0.0, 0.0, 1.0)] * len(part)
            yield pd.DataFrame(out, columns=["positive", "negative", "neutral"])

    return score


def embedding_model(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64):
    """A column function: text to a unit vector; null for a missing text."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list = []
            for i in range(0, len(texts), batch):
                part = list(texts[i : i + batch])
                m = np.asarray(model([t or "" for t in part]), np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                out += [v.astype(np.float32).tolist() if t is not None else None for v, t in zip(m, part)]
            yield pd.Series(out)

    return embed


def hashing_embedder(dimensions: int = DIMENSIONS):
    """The default embedding: words hashed into signed dimensions, the same on every machine."""

    def load():
        def embed(texts: list[str]) -> np.ndarray:
            m = np.zeros((len(texts), dimensions))
            for i, t in enumerate(texts):
                for word in t.lower().split():
                    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                    m[i, h % dimensions] += 1 if h >> 16 & 1 else -1
            return m

        return embed

    return load


def embed(df: DataFrame, text: str = "text", into: str = "embedding", load=None) -> DataFrame:
    return df.withColumn(into, embedding_model(load or hashing_embedder())(F.col(text)))


def pair_tone(text: Column) -> Column:
    """All that the default pair model needs of a text: the tone of the whole of it, so that a text is read once and not for each of its pairs."""
    return F.when(text.isNotNull(), T.quick_sentiment(text))


def opposed(x: Column, y: Column) -> Column:
    """The default pair model over tones: opposite ones contradict, the same agree; a missing text contradicts nothing."""
    against = ((x == "positive") & (y == "negative")) | ((x == "negative") & (y == "positive"))
    p = lambda c, e, n: F.struct(F.lit(c).alias("contradiction"), F.lit(e).alias("entailment"), F.lit(n).alias("neutral"))
    return F.when(x.isNull() | y.isNull(), p(0.0, 1.0, 0.0)).when(against, p(0.9, 0.05, 0.05)).when((x == y) & (x != "neutral"), p(0.05, 0.9, 0.05)).otherwise(p(0.1, 0.1, 0.8))


def opposition(a: Column, b: Column) -> Column:
    """The default pair model over texts."""
    return opposed(pair_tone(a), pair_tone(b))


def entities(text: Column) -> Column:
    """The default entity finder: amounts, percentages, dates and numbers with their kind."""
    def tagged(kind: str):
        return lambda x: F.struct(x.alias("text"), F.lit(kind).alias("label"))

    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), tagged(k)) for k, p in ENTITIES]))


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))
def entity_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The default entity finder with places: text, label, start and end (characters from 0, the end not included), kind by kind in the order of the text."""
    patterns = [(k, re.compile(p, re.ASCII)) for k, p in ENTITIES]
    for texts in batches:
        yield texts.map(lambda t: [(m[0], k, m.start(), m.end()) for k, p in patterns for m in p.finditer(t or "")])


def labelled_scores(items: Column) -> Column:
    """A model's list of (label, score) as positive, negative, neutral: names in any case, unknown ones are neutral, the last of a label counts, a missing one is 0."""
    names = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])
    kind = lambda x: F.coalesce(F.try_element_at(names, F.lower(x["label"])), F.lit("neutral"))
    score = lambda k: F.coalesce(F.try_element_at(F.filter(items, lambda x: kind(x) == k), F.lit(-1))["score"].cast("double"), F.lit(0.0)).alias(k)
    return F.struct(score("positive"), score("negative"), score("neutral"))


def score_text(text: Column) -> Column:
    """The default tone of one text: positive, negative, neutral."""
    p, n = F.regexp_count(text, F.lit(T.POSITIVE_PATTERN)), F.regexp_count(text, F.lit(T.NEGATIVE_PATTERN))
    return F.struct((p / (p + n + 1)).alias("positive"), (n / (p + n + 1)).alias("negative"), (1 / (p + n + 1)).alias("neutral"))
