"""Token ids of a byte-level BPE as a streaming transducer (problem 6).

A text is cut lazily into words by the vocabulary's own pattern; inside a word, bytes flow through a window and a
token leaves it as soon as no further byte can change it. How many bytes must be seen for that, the sufficient
lookahead, is computed from the merge list. So memory is bounded by the window, whatever the length of a word,
and a word without a space of a million characters costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.storage import spread

#: folder of the vocabulary files
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN)
#: the same pattern for texts of ASCII alone, where the standard engine, which is faster, can say it
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: remembered words, and bytes of a word that is remembered
MEMO_WORDS, MEMO_BYTES = 400_000, 48
#: ids after which a batch leaves the worker, whatever the number of its texts
BATCH_IDS = 1 << 20
#: characters of a text beyond which its words are not listed at once
LISTED_CHARS = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line has a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _merge(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The pieces of a word after all merges (of a rank below the given one), lowest rank first, leftmost first."""
    if len(word) < 100:
        pieces = [word[i : i + 1] for i in range(len(word))]
        while len(pieces) > 1:
            best, at = below, -1
            for i in range(len(pieces) - 1):
                rank = ranks.get(pieces[i] + pieces[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces
    size = len(word)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if (b := end[a]) < size and (rank := ranks.get(word[a : end[b]])) is not None and (below is None or rank < below):
            heapq.heappush(heap, (rank, a, end[b]))

    for a in range(size - 1):
        offer(a)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if b < 0 or b >= size or end[b] != stop:
            continue  # one of the two pieces has changed since
        end[a], end[b] = stop, -1
        if stop < size:
            before[stop] = a
        offer(a)
        if (left := before[a]) >= 0:
            offer(left)
    pieces, a = [], 0
    while a < size:
        pieces.append(word[a : end[a]])
        a = end[a]
    return pieces


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token's end that settle it, from the merge list alone.

    Take the segmentations of a prefix and of any longer word. At first they differ only beyond the prefix. A merge (u, v)
    carries the difference to the left, by the length of u, only where v starts just where the difference does; then v
    is, or starts with, what an earlier such merge left there. So the furthest that it can get is the heaviest chain
    of merges in rank order in which the left part of each is on the left edge of the right part of the next.
    """
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    furthest = 0
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = _merge(token, ranks, rank)
        if len(parts) != 2:
            continue  # no merge makes it
        u, v = left[token], edge = parts
        best = 0
        while True:
            best = max(best, reach.get(edge, 0))
            if edge not in left:
                break
            edge = left[edge]
        far = len(u) + best
        reach[u] = max(reach.get(u, 0), far)
        left[token] = u
        furthest = max(furthest, far)
    return furthest


class Transducer(dict):
    """Text to ids. As a dict it remembers the ids of short words, up to MEMO_WORDS of them."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int) -> None:
        super().__init__()
        self.ranks, self.lookahead = ranks, lookahead
        self.window = max(4 * lookahead, 1024)

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        ids = list(self.word(data))
        if len(data) <= MEMO_BYTES and len(self) < MEMO_WORDS:
            self[word] = ids
        return ids

    def word(self, data: bytes) -> Iterator[int]:
        """The ids of one word, each as soon as it is stable."""
        at, size = 0, len(data)
        while size - at > self.window:
            stable = at + self.window - self.lookahead
            for piece in _merge(data[at : at + self.window], self.ranks):
                if at + len(piece) > stable:
                    break
                at += len(piece)
                yield self.ranks[piece]
        for piece in _merge(data[at:], self.ranks):
            yield self.ranks[piece]

    def stream(self, text: str) -> Iterator[int]:
        """The ids of a text, lazily and in constant memory."""
        pattern = _ASCII_WORDS if text.isascii() and not _ODD_SPACE.search(text) else _WORDS
        return chain.from_iterable(self[m.group()] if len(m.group()) <= MEMO_BYTES else self.word(m.group().encode("utf-8", "surrogatepass")) for m in pattern.finditer(text))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty text or null."""
        if not text:
            return []
        if len(text) > LISTED_CHARS:
            return list(self.stream(text))
        pattern = _ASCII_WORDS if text.isascii() and not _ODD_SPACE.search(text) else _WORDS
        return list(chain.from_iterable(map(self.__getitem__, pattern.findall(text))))


#: separators that only one of the two engines counts as white space
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


class Utf8Machine:
    """Bytes to text, a token at a time: a character comes out with its last byte; what is no UTF-8 as U+FFFD."""

    def __init__(self) -> None:
        self.code = self.missing = self.least = 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.missing:
                if byte & 0xC0 == 0x80:
                    self.code = self.code << 6 | byte & 0x3F
                    self.missing -= 1
                    if not self.missing:
                        bad = self.code < self.least or self.code > 0x10FFFF or 0xD800 <= self.code <= 0xDFFF
                        out.append("�" if bad else chr(self.code))
                    continue
                out.append("�")
                self.missing = 0
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.missing = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                self.code, self.least = byte & (0x3F >> self.missing), (0x80, 0x800, 0x10000)[self.missing - 1]
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        """What is left of a character that never ended."""
        cut, self.missing = "�" if self.missing else "", 0
        return cut


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> str:
    """The text of ids; an id that the vocabulary lacks gives U+FFFD."""
    machine = Utf8Machine()
    text = "".join(machine.feed(tokens.get(i, b"\xff")) for i in ids)
    return text + machine.finish()


_READY: dict[str, Transducer] = {}
_LOOKAHEAD: dict[str, int] = {}


def _transducer(name: str, data: bytes, lookahead: int) -> Transducer:
    """One for each worker process and vocabulary."""
    if name not in _READY:
        _READY[name] = Transducer(read_ranks(data), lookahead)
    return _READY[name]


def vocabulary(path: str) -> tuple[str, bytes, int]:
    """Name, content and sufficient lookahead of a vocabulary file. Its size, under 2 MB, doesn't depend on the corpus."""
    with open(path, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data).hexdigest()
    if name not in _LOOKAHEAD:
        _LOOKAHEAD[name] = sufficient_lookahead(read_ranks(data))
    return name, data, _LOOKAHEAD[name]


def encode_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, file: str = VOCABULARY, counts_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns and ids (or n_tokens) of each row, in one pass without a shuffle.

    A null or empty text has an empty list (0 tokens). Rows that occur twice come out twice; a null key stays
    null. Special tokens are never made: their strings are ordinary text. Other columns are ignored. The vocabulary
    file is read on the driver and sent to the executors, so they need not have it.
    """
    name, data, lookahead = vocabulary(f"{folder}/{file}")
    sent = df.sparkSession.sparkContext.broadcast(data)
    kept = df.select(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _transducer(name, sent.value, lookahead).encode
        for batch in batches:
            first, ends, values = 0, array("q", [0]), array("i")
            for i, one in enumerate(batch.column(len(carry) + 1), 1):
                ids = encode(one.as_py())
                ends.append(ends[-1] + len(ids))
                if not counts_only:
                    values.extend(ids)
                if len(values) >= BATCH_IDS or i == len(batch):
                    own = [c.slice(first, i - first) for c in batch.columns[:-1]]
                    if counts_only:
                        at = pa.array(ends, pa.int64())
                        last: pa.Array = pa.compute.subtract(at[1:], at[:-1])
                    else:
                        last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(values), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*own, last], names=[*batch.schema.names[:-1], "ids"])
                    first, ends, values = i, array("q", [0]), array("i")

    types = {c: t for c, t in kept.dtypes}
    schema = ", ".join(f"{c} {types[c]}" for c in kept.columns[:-1]) + (", ids bigint" if counts_only else ", ids array<int>")
    out = spread(kept).mapInArrow(run, schema)
    return out.select(F.col("k").alias(key), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("ids").alias("n_tokens" if counts_only else "ids"))


def round_trip(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """key, n_tokens, n_chars and same: whether the decoded ids are the text again (null and empty texts: true)."""
    name, data, lookahead = vocabulary(f"{folder}/{file}")
    sent = df.sparkSession.sparkContext.broadcast(data)
    kept = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _transducer(name, sent.value, lookahead)
        tokens = {rank: token for token, rank in made.ranks.items()}
        for batch in batches:
            rows = [(x.as_py() or "") for x in batch.column(1)]
            ids = [made.encode(t) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([len(t) for t in rows], pa.int64()), pa.array([decode(i, tokens) == t for i, t in zip(ids, rows)])],
                names=["k", "n_tokens", "n_chars", "same"],
            )

    return spread(kept).mapInArrow(run, f"k {dict(kept.dtypes)['k']}, n_tokens bigint, n_chars bigint, same boolean").withColumnRenamed("k", key)
