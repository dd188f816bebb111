"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A benchmark item gives every window of ``WINDOW`` consecutive words; an item
with fewer, but not none, is one window. Each window is a 64-bit hash in a sorted
array, with the place of its words in the items' text. A document's windows are
hashed in the same way and looked up; a hit counts when the words' bytes
are those at that place. A word inside any window found is hit.

Memory: the benchmark is cut in blocks of about ``BLOCK_BYTES`` of text, whose arrays are made
on executors and reach the driver one block at a time. A window takes 16 bytes and its
item's text is held once, so that a block is about 60 MB, of which a worker holds one: with
several blocks, each batch of documents is scanned for one after the other, and blocks wait on disk.

Defined results: null and empty texts have no words and no hits; items without
words match nothing; equal items and repeated rows count each (a row for each
document, an item id once); null item ids are left out of the list of ids but
their windows hit; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xxhash import xxh64_intdigest

from brindle.llm.words import TO_WORDS, alnum_words, fresh

WINDOW = 10
#: UTF-8 bytes of benchmark text in one block, about; an item is in one block, whatever its size.
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are looked up at once, about.
BYTES_AT_ONCE = 1 << 18

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Windows:
    """The windows of one block of the benchmark, in arrays that are sorted by hash within each window length."""

    #: The factor between neighbours in a window's hash; odd, so that no word is lost.
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, lengths: dict[int, tuple[np.ndarray, np.ndarray]], blob: bytes, starts: np.ndarray, ids: list[list[str]]) -> None:
        """``lengths``: for each window length its hashes, and where in ``blob`` the words begin; ``starts`` and ``ids``: of each distinct item text in it."""
        self.lengths, self.blob, self.starts, self.ids = lengths, blob, starts, ids

    @classmethod
    def made(cls, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Windows:
        texts: dict[bytes, list[str]] = {}
        for item_id, text in items:
            words = alnum_words(text)
            if words:
                texts.setdefault(b" ".join(words), []).extend([] if item_id is None else [item_id])
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]], dtype=np.int64)[:-1]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for start, text in zip(starts.tolist(), texts):
            words = text.split(b" ")
            n = min(window, len(words))
            at = np.array(list(accumulate((len(w) + 1 for w in words), initial=start))[: len(words) - n + 1], dtype=np.int64)
            hashes, firsts = np.unique(cls.hashes(Words([text]).hashes, n), return_index=True)
            found.setdefault(n, []).append((hashes, at[firsts]))
        lengths = {}
        for n, parts in found.items():
            hashes, at = (np.concatenate(column) for column in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            lengths[n] = hashes[order], at[order]
        return cls(lengths, b" ".join(texts), starts, [sorted(set(ids)) for ids in texts.values()])

    @classmethod
    def hashes(cls, words: np.ndarray, n: int) -> np.ndarray:
        """A hash of each window of n words, from the words' hashes."""
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out *= cls.FACTOR
            out += words[k : len(words) - n + 1 + k]
        return out

    def scan(self, group: Words) -> list[tuple[list[list[int]], set[str]]]:
        """For each text of the group the spans of windows found and the ids of their items."""
        out: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in group.counts]
        starts = np.cumsum([0, *group.counts])
        for n, (known, at) in self.lengths.items():
            if len(group.hashes) < n:
                continue
            asked = self.hashes(group.hashes, n)
            place = np.searchsorted(known, asked)
            for i in np.flatnonzero(known[np.minimum(place, len(known) - 1)] == asked).tolist():
                text = int(np.searchsorted(starts, i, side="right")) - 1
                if i + n > starts[text + 1]:
                    continue
                words, k, hit = group.joined(i, n), int(place[i]), False
                while k < len(known) and known[k] == asked[i]:
                    begin = int(at[k])
                    if self.blob[begin : begin + len(words)] == words and self.blob[begin + len(words) : begin + len(words) + 1] in (b" ", b""):
                        hit = True
                        out[text][1].update(self.ids[int(np.searchsorted(self.starts, begin, side="right")) - 1])
                    k += 1
                if hit:
                    out[text][0].append([i - int(starts[text]), i - int(starts[text]) + n])
        return out


class Words:
    """The words of several texts in a row: where they are, how many each text has, and a 64-bit hash of each."""

    BASE = 0x5851F42D4C957F2D
    #: Bytes whose powers are held; a longer word is hashed on its own.
    SPAN = 1 << 18

    def __init__(self, texts: list[bytes | None]) -> None:
        plain = [(t or b"").translate(TO_WORDS) for t in texts]
        self.buffer = b" ".join(plain)
        is_word = np.frombuffer(b" " + self.buffer + b" ", np.uint8) != 0x20
        edges = np.flatnonzero(is_word[1:] != is_word[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        bounds = np.cumsum([0, *[len(t) + 1 for t in plain]])
        self.counts = np.diff(np.searchsorted(self.starts, bounds)).tolist()
        self.hashes = self._hashed()

    def joined(self, i: int, n: int) -> bytes:
        """n words from the i-th, with a space between them."""
        return b" ".join(self.buffer[s:e] for s, e in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist()))

    def _hashed(self) -> np.ndarray:
        """A polynomial of each word's bytes, from sums over the bytes so far, scattered by a last multiplication."""
        data, out, i = np.frombuffer(self.buffer, np.uint8), np.empty(len(self.starts), np.uint64), 0
        while i < len(self.starts):
            base = int(self.starts[i])
            j = int(np.searchsorted(self.ends, base + self.SPAN, side="right"))
            if j == i:
                out[i] = xxh64_intdigest(self.buffer[base : int(self.ends[i])])
                i += 1
                continue
            span = int(self.ends[j - 1]) - base
            powers, inverse = _powers(max(1 << 12, 1 << (span - 1).bit_length()))
            sums = np.zeros(span + 1, np.uint64)
            np.cumsum(data[base : base + span] * powers[:span], out=sums[1:])
            first = self.starts[i:j] - base
            hashes = (sums[self.ends[i:j] - base] - sums[first]) * inverse[first]
            out[i:j] = (hashes ^ (hashes >> np.uint64(32))) * Windows.FACTOR
            i = j
        return out


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and their inverses."""
    made = []
    for base in (Words.BASE, pow(Words.BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return made[0], made[1]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


BLOCK = "lengths array<struct<n:int,hashes:binary,at:binary>>, blob binary, starts binary, ids array<array<string>>"


def _make(items: pa.Table) -> pa.Table:
    texts = [None if t is None else t.encode() for t in items.column("text").to_pylist()]
    made = Windows.made(list(zip(items.column("item_id").to_pylist(), texts)))
    lengths = [{"n": n, "hashes": h.tobytes(), "at": at.tobytes()} for n, (h, at) in made.lengths.items()]
    one = pa.list_(pa.struct([("n", pa.int32()), ("hashes", pa.binary()), ("at", pa.binary())]))
    return pa.table([pa.array([lengths], one), pa.array([made.blob], pa.binary()), pa.array([made.starts.tobytes()], pa.binary()), pa.array([made.ids], pa.list_(pa.list_(pa.string())))], ["lengths", "blob", "starts", "ids"])


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark's windows in parts of about ``most`` bytes of text, dealt by a hash of the text, each broadcast."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // most))
    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(text), F.lit(n)).alias("block"))
    out = []
    for row in rows.where("text is not null").groupBy("block").applyInArrow(_make, BLOCK).toLocalIterator():
        lengths = {part.n: (np.frombuffer(part.hashes, np.uint64), np.frombuffer(part.at, np.int64)) for part in row.lengths}
        out.append(benchmark.sparkSession.sparkContext.broadcast(Windows(lengths, bytes(row.blob), np.frombuffer(row.starts, np.int64), row.ids)))
    return out


def _groups(texts: list[bytes | None]) -> Iterator[Words]:
    """The texts' words, in groups of about ``BYTES_AT_ONCE``."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or b"")
        if size >= BYTES_AT_ONCE:
            yield Words(group)
            group, size = [], 0
    yield Words(group)


def _scanner(parts: list[Broadcast]) -> Callable:
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        found: list[tuple[int, list, set]] = []
        for group in _groups(texts.cast(pa.binary()).to_pylist()):
            spans, ids = [[] for _ in group.counts], [set() for _ in group.counts]
            for part in parts:
                for k, (its_spans, its_ids) in enumerate(part.value.scan(group)):
                    spans[k] += its_spans
                    ids[k] |= its_ids
                if len(parts) > 1:
                    # The next block is read from disk instead of being held beside this one.
                    del part._value
            found += zip(group.counts, spans, ids)
        rows = []
        for n, spans, ids in found:
            spans = merged(spans)
            rows.append({"n_words": n, "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(ids)})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return scan


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with a column ``into`` (an equally named one is replaced): n_words, starts and ends of hit spans in words, ids of items as strings."""
    return docs.withColumn(into, _scanner(blocks(benchmark, most=block_bytes))(F.col(text)))


def hit_words(found: str = "found"):
    """Words inside any span."""
    spans = F.zip_with(f"{found}.starts", f"{found}.ends", lambda s, e: e - s)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    into = fresh(docs, "contamination")
    return find(docs, benchmark, text, into).where(F.size(F.col(into)["starts"]) == 0).drop(into)


def cut_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them; the rest stays byte for byte."""
    plain, at, bounds = text.translate(TO_WORDS), 0, []
    for word in plain.split():
        at = plain.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for start, end in zip(starts, ends):
        out.append(text[done : bounds[start][0]])
        done = bounds[end - 1][1]
    return b"".join([*out, text[done:]])


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, found: pa.Array) -> pa.Array:
    rows = zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist())
    return pa.array([t if t is None or not f["starts"] else cut_spans(t, f["starts"], f["ends"]) for t, f in rows], pa.binary()).cast(pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with hit words cut out of their texts."""
    into = fresh(docs, "contamination")
    return find(docs, benchmark, text, into).withColumn(text, _cut(F.col(text), F.col(into))).drop(into)
