"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut at special strings (one token each) and into pre-tokens. The
pre-tokens of a batch that aren't known yet become one flat array of symbols, with
the place where each sequence begins. In each round every sequence applies its
pair of lowest rank, at all its places, all sequences at the same time; those with
no pair left are counted and leave. Counts of short pre-tokens are remembered in
a table of bounded size.

That equals merging one pair at a time: a pair that holds a merged symbol
ranks after the pair that made the symbol.

Defined results: null and empty texts have no tokens; repeated rows get equal
counts; a vocabulary file is read on the driver and broadcast (about 50,000
merges, 2 MB as arrays; ``MOST_MERGES`` refuses larger files); other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Merges in a vocabulary that is broadcast, at most.
MOST_MERGES = 1_000_000
#: Pre-tokens remembered by a task, and the longest of them in characters.
REMEMBER, REMEMBER_LENGTH = 200_000, 32
#: Symbols in one flat array, about.
FLAT = 1 << 20

#: Unicode white space as the tokenizer's pattern engine has it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-token pattern of the byte-level vocabulary, with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(others)}


class Merges:
    """Pairs of symbols in order, their ranks and what they become."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], specials: Iterable[str] = ()) -> None:
        if len(merges) > MOST_MERGES:
            raise ValueError(f"{len(merges)} merges; at most {MOST_MERGES} are broadcast")
        self.width = max(vocabulary.values()) + 1
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.becomes = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        self.specials = tuple(specials)

    @classmethod
    def from_json(cls, path: str) -> Merges:
        """A byte-level vocabulary file with merges."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        return cls(whole["model"]["vocab"], merges, [t["content"] for t in whole["added_tokens"] if t["special"]])

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges for one that doesn't merge."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.order[at], len(self.pairs))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (none is empty)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        result = lengths.copy()
        ids = np.arange(len(words))
        none = len(self.pairs)
        while len(ids):
            owner = np.repeat(np.arange(len(ids)), lengths)
            rank = np.full(len(symbols), none, dtype=np.int64)
            inside = owner[:-1] == owner[1:]
            rank[:-1][inside] = self.ranks(symbols[:-1][inside] * self.width + symbols[1:][inside])
            begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            lowest = np.minimum.reduceat(rank, begins)
            going = lowest < none
            result[ids[~going]] = lengths[~going]
            place = np.flatnonzero((rank == lowest[owner]) & going[owner])
            # In a run of places one apart, as in "aaa", every second one merges, from the left.
            new_run = np.ones(len(place), dtype=bool)
            new_run[1:] = (np.diff(place) > 1) | (owner[place[1:]] != owner[place[:-1]])
            nth = np.arange(len(place)) - np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
            place = place[nth % 2 == 0]
            symbols[place] = self.becomes[rank[place]]
            stays = going[owner]
            stays[place + 1] = False
            lengths = (lengths - np.bincount(owner[place], minlength=len(ids)))[going]
            symbols, ids = symbols[stays], ids[going]
        return result


class Counter:
    """Counts tokens of texts, with a memory of short pre-tokens."""

    def __init__(self, merges: Merges) -> None:
        import regex

        self.merges = merges
        self.known: dict[str, int] = {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return 0, self.find(text)
        return len(parts) - 1, [w for part in parts if part for w in self.find(part)]

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of pre-tokens, in flat arrays of bounded size."""
        found, part, size = {}, [], 0
        for word in sorted(words, key=len):
            part.append(word)
            size += len(word)
            if size >= FLAT:
                found.update(zip(part, self.merges.count([w.encode() for w in part]).tolist()))
                part, size = [], 0
        if part:
            found.update(zip(part, self.merges.count([w.encode() for w in part]).tolist()))
        return found

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. Long pre-tokens are forgotten after each flat array's worth of words, short ones when too many."""
        out, todo, size, new = [0] * len(texts), [], 0, set()
        known = self.known
        for n, text in enumerate(texts):
            if text:
                out[n], words = self._pieces(text)
                todo.append((n, words))
                new.update(words)
                size += len(words)
            if size > FLAT or n == len(texts) - 1:
                fresh = self.learn(new - known.keys())
                known.update(fresh)
                for k, words in todo:
                    out[k] += sum(map(known.__getitem__, words))
                for word in fresh:
                    if len(word) > REMEMBER_LENGTH:
                        del known[word]
                if len(known) > REMEMBER:
                    known.clear()
                todo, size, new = [], 0, set()
        return out


def token_counter(spark: SparkSession, path: str) -> Callable:
    """A function from a text column to its number of tokens, by the vocabulary file at ``path`` on the driver."""
    shared = spark.sparkContext.broadcast(Merges.from_json(path))
    held: list[Counter] = []

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Counter(shared.value))
        return pa.array(held[0].counts(texts.to_pylist()), pa.int64())

    return count
