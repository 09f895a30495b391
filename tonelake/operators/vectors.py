"""Nearest vectors: exactly, block by block, and by an inverted file; similar pairs within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.storage import stage

#: vectors in a block; two blocks are one matrix product
BLOCK = 1024
#: parts that the blocks of a group are spread over at most; the other side's blocks come to each part
PARTS = 256
#: vectors that the cells are fitted to, cells, and cells that a query looks into
SAMPLE, CELLS, PROBES = 20_000, 64, 36


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; a null, zero or not finite vector is a row of zeros, which is near to nothing."""
    rows = [np.asarray(v, np.float64) if v is not None else None for v in column.to_pylist()]
    width = max((len(r) for r in rows if r is not None), default=0)
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r is not None and len(r) == width and np.isfinite(r).all():
            m[i] = r
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _blocks(df: DataFrame, key: str, vector: str, group: str | None, size: int) -> DataFrame:
    """Rows (g, block, ids, vectors): the vectors of a group in blocks of about size, spread by a hash of the key."""
    g = F.col(group).cast("string") if group else F.lit("")
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.coalesce(g, F.lit("")).alias("g"), F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    counts = rows.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("of"))
    return rows.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("id"), "of").cast("int")).groupBy("g", "block", "of").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))


def _spread(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' blocks with a key (g, part) to meet by: blocks of the right side are dealt to parts, those of the left come to every part of their group. So no group is one task's."""
    parts = right.select("g", F.least("of", F.lit(PARTS)).alias("parts")).distinct()
    over = left.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return over, right.withColumn("part", F.col("block") % F.least("of", F.lit(PARTS)))


def top_k(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, group: str | None = None, size: int = BLOCK) -> DataFrame:
    """query_id, neighbour_id, rank, score: the k nearest of the corpus by cosine for each query, exactly; ties go to the lesser id; itself left out.

    With a group (a filter by metadata) only vectors of the query's group count. Every block of queries meets every block of
    the corpus in one matrix product and only k rows of each query leave it.
    """
    left, right = _blocks(queries, key, vector, group, size), _blocks(corpus, key, vector, group, size)
    left, right = _spread(left.select("g", F.col("ids").alias("qi"), F.col("vs").alias("qv")), stage(right, "blocks"))
    met = left.join(right, ["g", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                qi, ci = (np.asarray(batch.column(c)[i].as_py(), np.int64) for c in (0, 2))
                score = _matrix(batch.column(1)[i].values) @ _matrix(batch.column(3)[i].values).T
                score = np.where(qi[:, None] == ci[None, :], -np.inf, score)
                order = np.lexsort((np.broadcast_to(ci, score.shape), -np.round(score, 12)), axis=1)[:, :k]
                q, s = np.repeat(qi, order.shape[1]), np.take_along_axis(score, order, 1).ravel()
                keep = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(ci[order].ravel()[keep]), pa.array(s[keep])], names=["query_id", "neighbour_id", "score"])

    near = met.select("qi", "qv", "ids", "vs").mapInArrow(run, "query_id bigint, neighbour_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "neighbour_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", "score")


def fit_cells(corpus: DataFrame, key: str, vector: str, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centres of cells by spherical k-means over at most `sample` vectors, chosen by a hash of the key; that bound is what reaches the driver."""
    rows = corpus.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.xxhash64("k"), "k").limit(sample).select("v").toArrow()
    x = _matrix(rows.column(0).combine_chunks())
    if not len(x):
        return np.zeros((1, 0))
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            total = x[near == c].sum(axis=0)
            if (n := np.linalg.norm(total)) > 0:
                centres[c] = total / n
    return centres


def in_cells(df: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """id, v and the cells nearest to each vector. Every row is indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            score = m @ centres.T if m.shape[1] == centres.shape[1] else np.zeros((len(m), len(centres)))
            cells = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["id", "v", "cells"])

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, f"id bigint, v {dict(rows.dtypes)['v']}, cells array<int>")


def indexed_top_k(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, cells: int = CELLS, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """top_k over the cells nearest to each query alone. Its recall against the exact search is measured in the tests (at least 0.9)."""
    centres = fit_cells(corpus, key, vector, cells, sample)
    placed = stage(in_cells(corpus, key, vector, centres).select("id", "v", F.explode("cells").alias("cell")), "cells")
    asked = in_cells(queries, key, vector, centres, probes).select("id", "v", F.explode("cells").alias("cell"))
    near = top_k(placed, asked, "id", "v", k, "cell")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "neighbour_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, key: str, vector: str, group: str, period: str, words: str, least: float = 0.75, least_words: int = 30, size: int = BLOCK) -> DataFrame:
    """g, a, b, similarity: pairs within a group, of different periods, both long enough, at least so similar; a is of the earlier period.

    Blocks of a group meet once each; pairs below the threshold never leave the matrix product that finds them.
    """
    rows = df.where(F.col(words) >= least_words).where(F.col(period).isNotNull() & F.col(group).isNotNull())
    b = stage(_blocks(rows.withColumn("v2", F.concat(F.array(F.col(period).cast("double")), F.transform(vector, lambda x: x.cast("double")))), key, "v2", group, size), "blocks")
    left, right = _spread(b.select("g", "block", "ids", "vs"), b)
    met = left.join(right.select("g", "part", F.col("block").alias("b2"), F.col("ids").alias("i2"), F.col("vs").alias("v2")), ["g", "part"]).where("block <= b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, others = (np.asarray(batch.column(c)[i].as_py(), np.int64) for c in (1, 3))
                x, y = (np.asarray(batch.column(c)[i].as_py(), np.float64) for c in (2, 4))
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                score = unit(x[:, 1:]) @ unit(y[:, 1:]).T
                hit = (score >= least) & (x[:, :1] < y[:, 0]) if batch.column(5)[i].as_py() else (score >= least) & (x[:, :1] != y[:, 0])
                r, c = np.nonzero(hit)
                first = x[r, 0] < y[c, 0]
                a, z = np.where(first, ids[r], others[c]), np.where(first, others[c], ids[r])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(r), pa.string()), pa.array(a), pa.array(z), pa.array(score[r, c])], names=["g", "a", "b", "similarity"])

    return met.select("g", "ids", "vs", "i2", "v2", (F.col("block") == F.col("b2")).alias("same")).mapInArrow(run, "g string, a bigint, b bigint, similarity double")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Stored rows, replaced by incoming ones of the same key.

    With an order column the row that is last by it stays, whichever side it came from; a null order is before all others, and an
    incoming row goes before a stored one of the same order. Of rows that are still alike, and of several incoming ones without an
    order, the one that is last by all columns stays. A null key is a key like any other.
    """
    columns = incoming.columns
    rest = F.struct(*[c for c in columns if c != key])
    if order:
        both = stored.select(*columns, F.lit(0).alias("_side")).unionByName(incoming.select(*columns, F.lit(1).alias("_side")))
        return both.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), "_side", rest.alias("r"))).alias("m")).select(key, "m.r.*").select(*columns)
    new = incoming.groupBy(key).agg(F.max(rest).alias("r")).select(key, "r.*").select(*columns)
    gone = new.select(F.col(key).alias("_key"))
    return stored.join(gone, stored[key].eqNullSafe(gone["_key"]), "left_anti").unionByName(new)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that were found."""
    both = exact.select("query_id", "neighbour_id").join(found.select("query_id", "neighbour_id"), ["query_id", "neighbour_id"], "left_semi").count()
    return both / max(1, exact.count())


def metadata_filter(**wanted):
    """A condition from column = value (typed), column = [values] or column = {operator: value}; None values are skipped."""
    terms = []
    for c, v in wanted.items():
        if isinstance(v, dict):
            ops = {"$gt": lambda x, y: x > y, "$gte": lambda x, y: x >= y, "$lt": lambda x, y: x < y, "$lte": lambda x, y: x <= y, "$ne": lambda x, y: x != y, "$eq": lambda x, y: x == y, "$in": lambda x, y: x.isin(y)}
            terms += [ops[o](F.col(c), y) for o, y in v.items()]
        elif isinstance(v, (list, tuple, set)):
            terms.append(F.col(c).isin(*v))
        elif v is not None:
            terms.append(F.col(c) == v)
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out
