"""Near-duplicate texts by circulant MinHash (problem 3).

Two permutations make all coordinates of a signature: sigma places a text's word sequences on a circle, and
coordinate k is the least value of pi, shifted by k around the circle, over those places; so for one place the values of
all coordinates lie next to each other in memory. Texts meet where a band of coordinates is equal, and the exact Jaccard
similarity of every pair that met decides. Equal texts are one class, known by 128 bits of digest; a task computes a class once.

Keys of bands are shuffled once, 48 bits each with 48 bits of the class, and read in order as a stream. Keys that a sample of classes shows to be
frequent take another way: their rows are spread over blocks, and every block of a key meets every other.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.storage import small_enough, spread, spread_by, stage, unstage

THRESHOLD, WIDTH = 0.55, 3
#: coordinates of a signature, bands, coordinates in a band, places on the circle, seed of the permutations
COORDINATES, BANDS, ROWS, CIRCLE, SEED = 384, 224, 5, 1 << 20, 20_250
#: rows of a frequent key that meet in one task: its rows are spread over such blocks, and every block meets every other
BLOCK = 1024
#: one class in so many is looked at to find frequent keys, which are those that so many of them share; it decides on the way alone, not on the result
SAMPLED, FREQUENT = 64, 8
#: frequent keys that are broadcast at most
BROADCAST_KEYS = 1_000_000
#: classes that a task remembers, so as not to compute copies again
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W_]+")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _P2
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_WORDS = _Words()


def sequences(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct sequences of so many consecutive words, sorted. Words are runs of letters or digits in lower case."""
    words = _WORD.findall(text.lower())
    if len(words) < width:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1].copy()
        for i in range(1, width):
            out = out * _P1 + h[i : len(h) - width + 1 + i]
        return np.unique(_mix(out))


class Circle:
    """The two permutations and the choice of coordinates for each band."""

    def __init__(self, coordinates: int, bands: int, rows: int, places: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.sigma = rng.permutation(places).astype(np.int64)
        pi = rng.permutation(places).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)
        self.chosen = np.stack([rng.choice(coordinates, rows, replace=False) for _ in range(bands)])
        self.coordinates, self.bands, self.mask = coordinates, bands, np.uint64(places - 1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.sigma[(hashes & self.mask).astype(np.int64)]
        out = np.full(self.coordinates, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(at), 1024):
            np.minimum(out, self.shifted[at[i : i + 1024]].min(axis=0), out=out)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key for each text and band."""
        with np.errstate(over="ignore"):
            out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * _P2, (len(signatures), self.bands)).copy()
            for column in self.chosen.T:
                out = _mix(out * _P1 + signatures[:, column].astype(np.uint64))
        return out.view(np.int64)


_CIRCLES: dict[tuple, Circle] = {}


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """k, t, h (the class of equal texts) and c (a short form of it, to find candidates by)."""
    t = F.col(text).cast("string")
    return df.where(F.col(key).isNotNull() & (F.length(t) > 0)).select(F.col(key).cast("string").alias("k"), t.alias("t"), F.unhex(F.md5(t.cast("binary"))).alias("h"), F.shiftrightunsigned(F.xxhash64(t), 16).alias("c"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches whose first column is a class, with the rows that are the first of their class in this task."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for i, h in enumerate(batch.column(0).to_pylist()):
            if h not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(h)
                rows.append(i)
        yield batch, rows


def _band_keys(texts: DataFrame, width: int, shape: tuple) -> DataFrame:
    """c and b, the keys of its bands (48 bits), of every class with a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = _CIRCLES.get(shape) or _CIRCLES.setdefault(shape, Circle(*shape))
        for batch, rows in _once(batches):
            for at in range(0, len(rows), 256):
                ids, signatures = [], []
                for i in rows[at : at + 256]:
                    hashes = sequences(batch.column(2)[i].as_py(), width)
                    if len(hashes):
                        ids.append(batch.column(1)[i].as_py())
                        signatures.append(circle.signature(hashes))
                if ids:
                    keys = circle.keys(np.stack(signatures)).view(np.uint64) >> np.uint64(16)
                    offsets = pa.array(np.arange(0, keys.size + 1, circle.bands, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))], names=["c", "b"])

    return texts.select("h", "c", "t").mapInArrow(run, "c bigint, b array<bigint>")


def _pairs_of(g: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (rows of two) of members of the same key, from rows in order of key and member."""
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])) if len(g) else np.empty(0, np.int64)
    g, c = g[new], c[new]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(g)))
    for n in np.unique(sizes[sizes > 1]):
        of = starts[sizes == n]
        if n <= 64:
            i, j = np.triu_indices(n, 1)
            for part in range(0, len(of), 256):
                members = c[of[part : part + 256, None] + np.arange(n)]
                yield np.stack([members[:, i].ravel(), members[:, j].ravel()], axis=1)
        else:
            for start in of:
                members = c[start : start + n]
                for k in range(n - 1):
                    yield np.stack([np.full(n - 1 - k, members[k]), members[k + 1 :]], axis=1)


def _met_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b out of rows (g, c) in order: what shares a key. A key that batches cut apart is carried over."""
    kept_g, kept_c = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: list[np.ndarray] = []
    rows = 0

    def out() -> pa.RecordBatch:
        both = np.unique(np.concatenate(waiting), axis=0)
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in itertools.chain(batches, [None]):
        if batch is None:
            g, c, cut = kept_g, kept_c, len(kept_g)
        else:
            g, c = np.concatenate([kept_g, batch.column(0).to_numpy()]), np.concatenate([kept_c, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
        for pairs in _pairs_of(g[:cut], c[:cut]):
            waiting.append(pairs)
            rows += len(pairs)
            if rows > 100_000:
                yield out()
                rows = 0
        kept_g, kept_c = g[cut:], c[cut:]
    if waiting:
        yield out()


def _candidates(texts: DataFrame, width: int, shape: tuple) -> DataFrame:
    """a, b (a < b): short classes that share a band."""
    sampled = _band_keys(texts.where(F.pmod("c", F.lit(SAMPLED)) == 0), width, shape).dropDuplicates(["c"]).select(F.explode("b").alias("g"))
    frequent = stage(sampled.groupBy("g").count().where(F.col("count") >= FREQUENT).select("g"), "frequent")
    some = not frequent.isEmpty()
    frequent = F.broadcast(frequent) if small_enough(frequent, BROADCAST_KEYS) else frequent
    keys = _band_keys(texts, width, shape)
    keys = stage(keys, "bands") if some else keys
    rows = keys.select("c", F.explode("b").alias("g"))
    usual = rows.join(frequent, "g", "left_anti") if some else rows
    met = spread_by(usual.select("g", "c"), "g").sortWithinPartitions("g", "c").mapInArrow(_met_in_order, "a bigint, b bigint")
    if some:
        hot = stage(rows.join(frequent, "g", "left_semi").distinct(), "hot")
        sizes = hot.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        sizes = F.broadcast(sizes) if small_enough(sizes, BROADCAST_KEYS) else sizes
        met = met.unionByName(_meetings(hot.join(sizes, "g"), "g", "n", "c"))
    return met.distinct()


def _meetings(rows: DataFrame, group: str, size: str, member: str, block: int | None = None) -> DataFrame:
    """a, b (a < b): members of the same group, the group's rows spread over blocks; size is the number of its rows."""
    blocks = F.ceil(F.col(size) / (block or BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks)
    every = F.sequence(F.lit(0), blocks - 1)
    left = rows.select(F.col(group).alias("g"), F.col(member).alias("a"), own.cast("int").alias("p"), F.explode(every).alias("q"))
    right = rows.select(F.col(group).alias("g"), F.col(member).alias("b"), own.cast("int").alias("q"), F.explode(every).alias("p"))
    return left.join(right, ["g", "p", "q"]).where("a < b").select("a", "b")


def _members(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """k, h, c, worded (whether the text has a sequence) of every key once; h and c are null without text. Texts are read, not shuffled."""
    t = F.col(text).cast("string")
    h, c = F.unhex(F.md5(t.cast("binary"))), F.shiftrightunsigned(F.xxhash64(t), 16)
    worded = t.rlike(r"(?:[\p{L}\p{N}]+[^\p{L}\p{N}]+){%d}[\p{L}\p{N}]" % (width - 1))
    one = F.min(F.when(F.length(t) > 0, F.struct(h.alias("h"), c.alias("c"), worded.alias("worded"))))
    return stage(df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(one.alias("m")).select("k", "m.*"), "members")


def similar_classes(df: DataFrame, key: str, text: str, members: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, shape: tuple = (COORDINATES, BANDS, ROWS, CIRCLE, SEED)) -> DataFrame:
    """a, b (a < b, classes of equal texts by their digest) and similarity, of all classes that are at least so similar."""
    texts = spread(_texts(df, key, text))
    alike_by_chance = members.where("c is not null").select("c", "h").distinct().groupBy("c").count().where("count > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
    candidates = stage(_candidates(texts, width, shape).unionByName(alike_by_chance), "candidates")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_KEYS) else wanted

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _once(batches):
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                sets = [sequences(batch.column(2)[i].as_py(), width).tobytes() for i in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), pa.array(sets, pa.binary())], names=["h", "c", "s"])

    # The hashed sets of texts that met anything, once for each class: what pairs are decided by.
    # Only classes with copies are shuffled to keep one of them.
    own = texts.select("h", "c", "t").join(wanted, "c", "left_semi").select("h", "c", "t").mapInArrow(hashed, "h binary, c bigint, s binary")
    own = stage(own, "sets")
    copied = own.groupBy("h").count().where("count > 1").select("h")
    copied = F.broadcast(copied) if small_enough(copied, BROADCAST_KEYS) else copied
    several = own.join(copied, "h", "left_semi").groupBy("h").agg(F.first("c").alias("c"), F.first("s").alias("s"))
    own = own.join(copied, "h", "left_anti").unionByName(several)
    both = candidates.join(own.select(F.col("c").alias("a"), F.col("h").alias("ha"), F.col("s").alias("sa")), "a").join(own.select(F.col("c").alias("b"), F.col("h").alias("hb"), F.col("s").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                together = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((together[1:] == together[:-1]).sum())
                found.append(common / max(1, len(together) - common))
            alike = pa.array(found, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), alike], names=["a", "b", "similarity"]).filter(pa.compute.greater_equal(alike, threshold - 1e-12))

    first = F.col("ha") < F.col("hb")
    named = both.where((F.col("a") != F.col("b")) | first).select(F.when(first, F.col("ha")).otherwise(F.col("hb")).alias("a"), F.when(first, F.col("hb")).otherwise(F.col("ha")).alias("b"), "sa", "sb")
    return named.mapInArrow(verify, "a binary, b binary, similarity double")


def similar_pairs(df: DataFrame, key: str, text: str, names: tuple[str, str] = ("a", "b"), threshold: float = THRESHOLD, width: int = WIDTH, **more) -> DataFrame:
    """Two keys (the first less than the second) for every pair of rows whose texts share at least the threshold of their distinct word sequences.

    Equal texts are pairs too, if they have a sequence. Null and empty texts, texts with fewer words than a sequence and rows with a null key
    are in no pair; rows with the same key count once. Other columns are ignored; an empty table gives no pair.
    """
    members = _members(df, key, text, width)
    classes = stage(similar_classes(df, key, text, members, threshold, width, **more), "similar")
    members = members.where("h is not null").select("k", F.col("h").alias("c"), "worded")
    apart = classes.join(members.select(F.col("c").alias("a"), F.col("k").alias("x")), "a").join(members.select(F.col("c").alias("b"), F.col("k").alias("y")), "b")
    sizes = members.where("worded").groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    copies = _meetings(members.join(sizes, "c"), "c", "n", "k").select(F.col("a").alias("x"), F.col("b").alias("y"))
    pairs = apart.select("x", "y").unionByName(copies)
    return pairs.select(F.least("x", "y").alias(names[0]), F.greatest("x", "y").alias(names[1]))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) for edges (a, b), by repeated joins of labels, each round written to the shared folder."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("root", "m").alias("r"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("r"), F.col("root").alias("far"))
        before, labels = labels, stage(step.join(jump, "r", "left").select("node", F.least("r", F.coalesce("far", "r")).alias("root"), "was"), "labels")
        unstage(before)
        if labels.where("root <> was").isEmpty():
            return labels.select("node", "root")
    raise RuntimeError("components need more rounds")


def similar_groups(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, width: int = WIDTH, **more) -> DataFrame:
    """One row for each key: class_id (the least key with the same text), links (other classes that it's similar to), group_id (the least class_id that links lead to).

    A text without a similar one is its own group; null and empty texts have null class_id and group_id, and no links.
    """
    members = _members(df, key, text, width)
    classes = stage(similar_classes(df, key, text, members, threshold, width, **more), "similar")
    members = members.select("k", F.col("h").alias("c"))
    named = members.where("c is not null").groupBy("c").agg(F.min("k").alias("class_id"))
    links = classes.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    by_name = classes.join(named.select(F.col("c").alias("a"), F.col("class_id").alias("x")), "a").join(named.select(F.col("c").alias("b"), F.col("class_id").alias("y")), "b")
    roots = components(by_name.select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = members.join(named, "c", "left").join(links, "c", "left").join(roots, F.col("class_id") == F.col("node"), "left")
    return out.select(F.col("k").alias(key), "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class_id").alias("group_id"))
