"""Reading level of running prose by a familiar-word formula (problem 8).

The formula has two terms: the share of words outside one list of familiar words, and the length of the sentence. It is taken for
every sentence, and a document has the level of most of its sentences. The list comes from the corpus's document frequencies: words
that enough documents hold, and that documents of the easier levels hold more often than those of the harder ones. Where
the line between the two is drawn, the formula's two weights and the cuts between the levels are fitted to ratings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.storage import small_enough, spread, stage

LEVELS = (1, 2, 3, 4)
#: rated documents that the formula is fitted to at most (by a hash of their id)
RATED_DOCUMENTS = 5_000
#: share of all documents that must hold a word of the list; so the list has at most (distinct words of a document) / share words
LEAST_SHARE = 0.001
#: words whose frequencies the driver takes at most; more are an error
LIST_WORDS = 1_000_000
#: lists that are tried, as (level, times): words that documents up to the level hold so many times as often as those above it
LISTS = tuple((level, times) for level in LEVELS[:-1] for times in (0.25, 0.5, 1.0, 2.0, 4.0))
#: steps of the share, and of the logarithm of the length to base 2, in which sentences are counted for the fit
SHARES, LENGTHS = 48, 8
#: lists that the cuts are fitted for (those of the least loss), steps of the score between which cuts may lie (at most 256)
FITTED_LISTS, STEPS = 6, 160
#: words (split at white space) that a document needs
LEAST_WORDS = 40
# Closing notices (a sentence with one of these), and abbreviations that end no sentence.
NOTICES = ("all rights reserved", "forward-looking statements", "http://", "https://")
ABBREVIATIONS = frozenset("approx sec no i.e e.g u.s u.k mr mrs ms dr inc corp co ltd vs etc st jr sr fig art dept est p pp vol".split())
_BULLET = re.compile(r"^\s*(?:[-*•·–]|\(?\d{1,3}[.)])\s+")
_LABEL = re.compile(r"^\s*(?:[\[(]?\d{1,2}:\d{2}(?::\d{2})?[\])]?\s*)?(?:-\s*)?(?:[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3}|[a-z]+ [a-z]+):\s+")
_TAG = re.compile(r"<[^<>]{1,80}>")
_TABLE = re.compile(r"\t|\s{2,}[-$(]?\d[\d,.]*|\|")
_ENDS = re.compile(r"[.!?][\"')\]”’]*\s+(?=[\"'(\[“]?[A-Z0-9])")
_WORDS = re.compile(r"[a-z]+(?:'[a-z]+)?")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the running prose: wrapped lines joined; headings, table rows, closing notices and sentences of fewer than three words left out; a list item is a sentence."""
    blocks: list[list[str]] = []
    items: list[bool] = []
    open_block = False
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            open_block = False
        elif (m := _BULLET.match(bare)) is not None:
            blocks.append([bare[m.end() :]])
            items.append(True)
            open_block = True
        elif len(bare) < 160 and _TABLE.search(bare) and len(_WORDS.findall(bare.lower())) < 12:
            open_block = False
        elif open_block:
            blocks[-1].append(bare)
        else:
            blocks.append([bare])
            items.append(False)
            open_block = True
    found = []
    for lines, item in zip(blocks, items):
        block = " ".join(lines)
        if "<" in block:
            block = _TAG.sub(" ", block)
        block = _LABEL.sub("", block, count=1)
        start, parts = 0, []
        for m in _ENDS.finditer(block):
            at = m.start()
            if block[at] == ".":
                last = block[max(start, at - 10) : at].rpartition(" ")[2].lstrip("(\"'").lower()
                if last in ABBREVIATIONS or len(last) == 1 and last.isalpha():
                    continue
            parts.append(block[start : m.end()])
            start = m.end()
        parts.append(block[start:])
        if not item and len(parts) == 1 and len(block) < 120 and not block.rstrip("\"')]”’ ").endswith((".", "!", "?")) and len(block.split()) < 12:
            continue  # a heading
        for part in parts:
            low = part.lower()
            words = _WORDS.findall(low)
            if len(words) > 2 and not any(n in low for n in NOTICES):
                found.append(words)
    return found


def is_case(text: str | None) -> bool:
    return bool(text) and len(text.split()) >= LEAST_WORDS


class Formula:
    """The list of familiar words, the weights of the two terms, and the cuts between the levels."""

    def __init__(self, familiar: frozenset[str], weights: np.ndarray) -> None:
        self.familiar, self.weights = familiar, weights
        self.by_share, self.by_length, *self.cuts = (float(x) for x in weights)
        self.cuts.sort()

    def score(self, words: list[str]) -> float:
        outside = len(words) - sum(map(self.familiar.__contains__, words))
        return self.by_share * outside / len(words) + self.by_length * log2(len(words))

    def level(self, text: str) -> int | None:
        """The level of most sentences; of levels with as many, the one nearest to the mean; null without a sentence."""
        found = sentences(text)
        if not found:
            return None
        best = [LEVELS[bisect_left(self.cuts, self.score(s))] for s in found]
        counts = Counter(best)
        most, mean = max(counts.values()), sum(best) / len(best)
        return min((level for level, n in counts.items() if n == most), key=lambda x: (abs(x - mean), x))


def fit(counts: dict[tuple[float, float], np.ndarray], rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights (share, length, cuts) and loss of an ordinal logistic regression, by Newton's method, to counts of (share, log length) by level."""
    x = np.array(list(counts), float)
    y = np.array(list(counts.values()), float)
    k = len(LEVELS) - 1
    above = np.stack([y[:, j + 1 :].sum(axis=1) for j in range(k)], axis=1)
    total = y.sum(axis=1, keepdims=True)
    design = np.concatenate([np.concatenate([x, -np.tile(np.eye(k)[j], (len(x), 1))], axis=1) for j in range(k)])
    hits, n = above.T.ravel(), np.tile(total[:, 0], k)
    ridge = 1e-4 * max(1.0, n.sum()) * np.concatenate([np.full(2, 0.01), np.full(k, 1e-4)])
    w = np.zeros(2 + k)
    loss = lambda w: float((n * np.logaddexp(0, design @ w) - hits * (design @ w)).sum() + (ridge * w * w).sum() / 2)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve(design.T @ ((n * p * (1 - p))[:, None] * design) + np.diag(ridge + 1e-9), design.T @ (hits - n * p) - ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w, before, now = w + size * step, now, loss(w + size * step)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w, now


def familiar_words(words: list[tuple[str, list[int]]], documents: list[int], level: int, times: float) -> frozenset[str]:
    """Of frequent words, with the documents of each level that hold them, those that documents up to a level hold at least so many times as often as those above it."""
    n = np.array(documents, float) + 0.5
    held = (np.array([by for _, by in words], float).reshape(-1, len(LEVELS)) + 0.02) / n
    familiar = held[:, :level].mean(axis=1) >= times * held[:, level:].mean(axis=1)
    return frozenset(w for (w, _), yes in zip(words, familiar) if yes)


def _cases(documents: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return documents.where((F.col(lang) == "en") & F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))


def _collected(df: DataFrame) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """Frequent words with their document frequencies by level, and the number of documents by level. LEAST_SHARE bounds what reaches the driver."""
    total = df.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"n{x}").alias(f"n{x}") for x in LEVELS])
    total = stage(total, "frequencies")
    documents = total.where("word = ''").first()
    if documents is None:
        return [], [0] * len(LEVELS)
    words = total.where(F.col("word") != "").where(F.col("n") >= LEAST_SHARE * documents["n"])
    if not small_enough(words, LIST_WORDS):
        raise ValueError(f"more than {LIST_WORDS} frequent words")
    return [(r["word"], [r[f"n{x}"] for x in LEVELS]) for r in words.collect()], [documents[f"n{x}"] for x in LEVELS]


_COUNTS = "word string, n bigint, " + ", ".join(f"n{x} bigint" for x in LEVELS)


def _frequencies(cases: DataFrame, formula: Formula | None) -> DataFrame:
    """Document frequencies of words by the level of the document: a rated document's own, else the formula's where there is one. The row of the empty word counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for t, level in zip(batch.column(1), batch.column(2).to_pylist()):
                t = t.as_py()
                if not is_case(t):
                    continue
                if level is None and formula is not None:
                    level = formula.level(t)
                for word in {"", *_WORDS.findall(t.lower())}:
                    row = counts.get(word)
                    if row is None:
                        row = counts[word] = [0] * (1 + len(LEVELS))
                    row[0] += 1
                    if level:
                        row[level] += 1
            if len(counts) > 300_000:
                yield _packed(counts)
                counts = {}
        if counts:
            yield _packed(counts)

    return cases.select("k", "t", "level").mapInArrow(run, _COUNTS)


def _packed(counts: dict[str, list[int]]) -> pa.RecordBatch:
    values = np.array(list(counts.values()), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(values[:, i]) for i in range(values.shape[1])]], names=["word", "n", *[f"n{x}" for x in LEVELS]])


def _fit(rated: DataFrame, words: list[tuple[str, list[int]]], documents: list[int]) -> Formula | None:
    """The list, the weights and the cuts that fit the rated documents best. Sentences are counted on the executors, for every
    list that is tried, by their terms; the grid of terms bounds what is collected."""
    lists = [familiar_words(words, documents, *x) for x in LISTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t, level in zip(batch.column(0), batch.column(1).to_pylist()):
                if is_case(t.as_py()):
                    for said in sentences(t.as_py()):
                        n = len(said)
                        length = round(LENGTHS * log2(n))
                        counts.update((i, round(SHARES * (n - sum(map(x.__contains__, said))) / n), length, level) for i, x in enumerate(lists))
        if counts:
            rows = np.array([(*k, n) for k, n in counts.items()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=["list", "share", "length", "level", "n"])

    rows = rated.select("t", "level").mapInArrow(run, "list bigint, share bigint, length bigint, level bigint, n bigint")
    tried: dict[int, dict[tuple[float, float], np.ndarray]] = {}
    counted = rows.groupBy("list", "share", "length", "level").agg(F.sum("n").cast("int").alias("n")).select(*[F.col(c).cast("smallint").alias(c) for c in ("list", "share", "length", "level")], "n").toArrow()
    for r in sorted(zip(*(c.to_pylist() for c in counted.columns))):
        tried.setdefault(r[0], {}).setdefault((r[1] / SHARES, r[2] / LENGTHS), np.zeros(len(LEVELS)))[r[3] - 1] += r[4]
    if not tried:
        return None
    fits = sorted(((*fit(counts), i) for i, counts in tried.items()), key=lambda x: x[1:])[:FITTED_LISTS]
    formulas, edges = [Formula(lists[i], w) for w, _, i in fits], []
    for w, _, i in fits:
        scores = np.array(list(tried[i])) @ w[:2]
        edges.append(np.linspace(scores.min(), max(scores.max(), scores.min() + 1e-6), STEPS - 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, level in zip(batch.column(0), batch.column(1).to_pylist()):
                if is_case(t.as_py()) and (found := sentences(t.as_py())):
                    for i, (f, e) in enumerate(zip(formulas, edges)):
                        at, n = np.unique(np.searchsorted(e, [f.score(s) for s in found]), return_counts=True)
                        rows.append((i, level, at.astype(np.uint8).tobytes(), n.astype(np.int32).tobytes()))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], types[j]) for j in range(4)], names=["list", "level", "steps", "counts"])

    got = rated.select("t", "level").mapInArrow(scored, "list int, level int, steps binary, counts binary").collect()
    best = (-1.0, 0, formulas[0].weights)
    for i, (f, e) in enumerate(zip(formulas, edges)):
        own = [r for r in got if r["list"] == i]
        if own:
            steps = np.zeros((len(own), STEPS), np.int32)
            for j, r in enumerate(own):
                steps[j, np.frombuffer(r["steps"], np.uint8)] = np.frombuffer(r["counts"], np.int32)
            cuts, agreed = fit_cuts(steps, np.array([r["level"] for r in own]), np.searchsorted(e, f.cuts))
            if agreed > best[0]:
                best = (agreed, i, np.concatenate([f.weights[:2], e[np.minimum(cuts, STEPS - 2)]]))
    return Formula(formulas[best[1]].familiar, best[2])


def fit_cuts(steps: np.ndarray, level: np.ndarray, cuts: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, float]:
    """Cuts (steps of the score) under which the level of most sentences is the rated one for most documents, each moved in turn from where the regression
    put it to the middle of the best places; and the share of documents that agree."""
    up_to = np.concatenate([np.zeros((len(steps), 1), np.int64), np.cumsum(steps, axis=1)], axis=1)
    at = np.arange(len(LEVELS))

    def agreed(cuts: np.ndarray) -> float:
        ends = np.concatenate([[0], np.sort(cuts) + 1, [steps.shape[1]]])
        counts = np.diff(up_to[:, ends], axis=1)
        away = np.abs(at - (counts @ at / counts.sum(axis=1))[:, None]) + np.where(counts == counts.max(axis=1, keepdims=True), 0, 100)
        return float((away.argmin(axis=1) + 1 == level).mean())

    cuts = np.minimum(np.array(cuts), steps.shape[1] - 2)
    for _ in range(rounds):
        before = cuts.copy()
        for j in range(len(cuts)):
            shares = np.array([agreed(np.concatenate([cuts[:j], [x], cuts[j + 1 :]])) for x in range(steps.shape[1] - 1)])
            best = np.flatnonzero(shares >= shares.max() - 1e-12)
            stretch = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
            cuts[j] = stretch[len(stretch) // 2]
        if (before == cuts).all():
            break
    return np.sort(cuts), agreed(cuts)


def reading_levels(documents: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rated_documents: int = RATED_DOCUMENTS) -> DataFrame:
    """key and reading_level (1 to 4) of every English document of at least LEAST_WORDS words.

    Fitted to the most frequent rating of at most rated_documents documents, chosen by a hash of their key: first with the words of those
    alone; by the levels that this gives to all documents, document frequencies are then counted over all of them, and the fit repeated. Documents in
    other or no language, shorter ones, and null and empty texts are left out, and so are rows with a null key; a text without a
    sentence has a null level, and so have all if nothing is rated. Rows that occur twice come out twice. Other columns are ignored.

    The texts are read three times: for the rated ones (no Python), for the frequencies, and for the levels.
    """
    rating = grades.where(F.col("reading_level").isin(*LEVELS) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.expr("mode(reading_level, true)").cast("int").alias("level"))
    rating = F.broadcast(stage(rating.orderBy(F.xxhash64("k"), "k").limit(rated_documents), "ratings"))
    cases = spread(_cases(documents, key, text, lang))
    rated = stage(cases.join(rating, "k"), "rated")
    formula = None
    for read in (rated, cases.join(rating, "k", "left")):
        words, n = _collected(_frequencies(read, formula))
        formula = _fit(spread(rated), [(w, by) for w, by in words if sum(by)], n)
        if formula is None:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            keep = [is_case(t) for t in texts]
            levels = [formula.level(t) if formula is not None else None for t, k in zip(texts, keep) if k]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(levels, pa.int32())], names=["k", "reading_level"])

    return cases.mapInArrow(run, f"k {dict(cases.dtypes)['k']}, reading_level int").withColumnRenamed("k", key)
