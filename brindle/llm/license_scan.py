"""License detections by ordered signature rules.

Texts become words (ASCII letters and digits, lower case, and all non-ASCII
characters). A signature is a regex over the words, one space apart: those of
``license_rules`` are written one by one, and ``FAMILIES`` times versions times ``FORMS``
gives the ways in which a name is mentioned. Only the signatures run of whose keywords and cues the text has at least one each. Detections are
taken by priority, then by length and place; one that lies inside the
interval of a detection already taken is suppressed. The base phrases always
count and are never suppressed.

Defined results: a null or empty text has no words, no detections and a score
of 0; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.license_rules import WRITTEN
from brindle.llm.words import alnum_words

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keywords of which every such name has one, name as a regex over words, versions ("" is any or none).
FAMILIES = (
    ("mit", "mit expat", "(?:mit|expat)(?: x11)?", ("",)),
    ("apache", "apache", "apache(?: software)?", ("1", "1 1", "2", "")),
    ("agpl", "agpl affero", "(?:agpl|(?:gnu )?affero(?: general public)?)", ("3", "")),
    ("lgpl", "lgpl lesser library", "(?:lgpl|(?:gnu )?(?:lesser|library) general public)", ("2", "2 1", "3", "")),
    ("gpl", "gpl general", "(?:(?:gnu )?gpl|(?:gnu )?general public)", ("1", "2", "3", "")),
    ("gfdl", "gfdl documentation", "(?:gfdl|(?:gnu )?free documentation)", ("1 2", "1 3", "")),
    ("bsd-2", "bsd", "(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd)", ("",)),
    ("bsd-3", "bsd", "(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)", ("",)),
    ("bsd-4", "bsd", "(?:bsd 4 clause|(?:4|four) clause bsd|original bsd)", ("",)),
    ("bsd", "bsd", "bsd", ("",)),
    ("mpl", "mpl mozilla", "(?:mpl|mozilla public)", ("1 1", "2", "")),
    ("epl", "epl eclipse", "(?:epl|eclipse public)", ("1", "2", "")),
    ("eupl", "eupl european", "(?:eupl|european union public)", ("1 1", "1 2", "")),
    ("cddl", "cddl distribution", "(?:cddl|common development and distribution)", ("1", "1 1", "")),
    ("cpl", "common", "common public", ("1", "")),
    ("artistic", "artistic", "artistic", ("1", "2", "")),
    ("boost", "bsl boost", "(?:bsl|boost(?: software)?)", ("1", "")),
    ("isc", "isc", "isc", ("",)),
    ("zlib", "zlib", "zlib(?: libpng)?", ("",)),
    ("unlicense", "unlicense", "unlicense", ("",)),
    ("wtfpl", "wtfpl", "wtfpl", ("2", "")),
    ("psf", "psf python", "(?:psf|python software foundation)", ("2", "")),
    ("ofl", "ofl sil", "(?:ofl|sil open font)", ("1", "1 1", "")),
    ("odbl", "odbl database", "(?:odbl|open database)", ("1", "")),
    ("cc0", "cc0 zero", "(?:cc0|cc zero|creative commons zero)", ("1", "")),
    ("cc-by", "cc commons", "(?:cc|creative commons) (?:by|attribution)", ("1", "2", "3", "4", "")),
    ("cc-by-sa", "cc commons", "(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)", ("1", "2", "3", "4", "")),
    ("cc-by-nd", "cc commons", "(?:cc|creative commons) (?:by|attribution) (?:nd|no ?derivatives)", ("1", "2", "3", "4", "")),
    ("cc-by-nc", "cc commons", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)", ("1", "2", "3", "4", "")),
    ("cc-by-nc-sa", "cc commons", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)", ("1", "2", "3", "4", "")),
    ("cc-by-nc-nd", "cc commons", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?derivatives)", ("1", "2", "3", "4", "")),
)

#: Acronyms that a version is often glued to, by label; those whose licenses are given as "only" or "or later".
GLUED = {"apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "gfdl": "gfdl", "mpl": "mpl", "epl": "epl", "eupl": "eupl", "cddl": "cddl", "ofl": "ofl", "wtfpl": "wtfpl"}
LATER = frozenset(["agpl", "lgpl", "gpl", "gfdl"])
SUFFIXES = (("-or-later", "(?: or later| or newer| or any later version| or at your option any later version| plus)"), ("-only", " only"), ("", ""))

#: Priority, cues of which the form has one, form with {n} for the name and {v} for the version.
FORMS = (
    (90, "spdx", "spdx license identifier {n}"),
    (85, "spdx", "(?:or|and) {n}"),
    (80, "under", "(?:licensed|released|distributed|available|published|provided|covered) under (?:a |an |the )?(?:terms of (?:a |an |the )?)?{n}(?: licen[cs]e)?{v}"),
    (75, "licensed released dual", "(?:and|or) (?:under )?(?:a |an |the )?{n}(?: licen[cs]e)?{v}"),
    (70, "subject terms accordance", "(?:subject to|terms (?:and conditions )?of|in accordance with) (?:a |an |the )?{n} licen[cs]e{v}"),
    (60, "license licence", "{n} licen[cs]e{v}"),
    (60, "license licensed licence licenced", "licen[cs]ed? {n}"),
)
#: A form with a version goes before the same form without.
VERSIONED, SUFFIXED = 3, 1


class Signature(NamedTuple):
    label: str
    priority: int
    keywords: frozenset[bytes]
    cues: frozenset[bytes]
    pattern: bytes


class Detection(NamedTuple):
    """Words from ``start`` up to ``end``, which is exclusive."""

    label: str
    priority: int
    start: int
    end: int


def _signature(label: str, priority: int, keywords: str, cues: str, pattern: str) -> Signature:
    sets = [frozenset(w.encode() for w in words.split()) for words in (keywords, cues)]
    return Signature(label, priority, *sets, f"(?<= )(?:{pattern})(?= )".encode())


@cache
def _compiled(pattern: bytes) -> re.Pattern[bytes]:
    """Patterns are compiled when a text first has their keyword."""
    return re.compile(pattern)


def _family(label: str, keywords: str, name: str, versions: tuple[str, ...]) -> Iterator[Signature]:
    """One license's rules: each version with each suffix in each form; a version stands behind the name, glued to it, or at the end."""
    glue = GLUED.get(label, "")
    for version in versions:
        number = version.replace(" ", ".")
        for suffix, says in SUFFIXES if version and label in LATER else SUFFIXES[-1:]:
            digits = f"(?: (?:version|v))? v?{version}(?: 0)?{says}" if version else ""
            glued = f"|{glue}v?{version}(?: 0)?{says}" if glue and version else ""
            also = f" {glue}{version.split()[0]} {glue}v{version.split()[0]}" if glued else ""
            for priority, cues, form in FORMS:
                patterns = [form.format(n=f"(?:{name}{digits}{glued})", v="")] + ([form.format(n=name, v=digits)] if digits and "{v}" in form else [])
                more = (VERSIONED if version else 0) + (SUFFIXED if says else 0)
                yield _signature(f"{label}-{number}{suffix}" if version else label, priority + more, keywords + also, cues, "|".join(patterns))


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules in falling priority; equal ones in the order written."""
    rules = [rule for family in FAMILIES for rule in _family(*family)]
    for line in WRITTEN.strip().splitlines():
        label, priority, keywords, pattern = line.split(" | ")
        rules.append(_signature(label, int(priority), keywords, keywords, pattern))
    return tuple(sorted(rules, key=lambda r: -r.priority))


@cache
def _by_keyword() -> dict[bytes, tuple[int, ...]]:
    index: dict[bytes, list[int]] = {}
    for n, rule in enumerate(signatures()):
        for word in rule.keywords:
            index.setdefault(word, []).append(n)
    return {word: tuple(rules) for word, rules in index.items()}


def base_places(words: list[bytes]) -> list[Detection]:
    """Every place of every base phrase."""
    present, found = set(words), []
    for phrase, label in BASE:
        want = phrase.encode().split()
        if not present.issuperset(want):
            continue
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                found.append(Detection(label, 100, at, at + len(want)))
    return found


def suppressed(found: list[Detection]) -> list[Detection]:
    """Those that don't lie inside one that goes before: higher priority, then longer, then earlier."""
    kept: list[Detection] = []
    reach: list[Detection] = []  # by start; ends rise too, as none contains another
    for one in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_left(reach, one.start + 1, key=lambda d: d.start)
        if at and reach[at - 1].end >= one.end:
            continue
        kept.append(one)
        past = at
        while past < len(reach) and reach[past].end <= one.end:
            past += 1
        first = at - 1 if at and reach[at - 1].start == one.start else at
        reach[first:past] = [one]
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def detect(words: list[bytes]) -> list[Detection]:
    """The method's detections in a text's words."""
    present, index = set(words), _by_keyword()
    rules = sorted({n for word in present & index.keys() for n in index[word]})
    rules = [signatures()[n] for n in rules if not present.isdisjoint(signatures()[n].cues)]
    if not rules:
        return []
    joined = b" " + b" ".join(words) + b" "
    starts = list(accumulate((len(w) + 1 for w in words), initial=1))
    found = []
    for rule in rules:
        for match in _compiled(rule.pattern).finditer(joined):
            found.append(Detection(rule.label, rule.priority, bisect_left(starts, match.start()), bisect_left(starts, match.end() + 1)))
    return suppressed(found)


def scan(text: bytes | None) -> tuple[int, list[Detection], list[Detection]]:
    """Number of words, base places, and the method's detections."""
    words = alnum_words(text)
    return len(words), base_places(words), detect(words)


_SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base", _SPANS),
        T.StructField("more", _SPANS),
        T.StructField("score", T.DoubleType()),
    ]
)


@F.arrow_udf(FOUND)
def licenses(texts: pa.Array) -> pa.Array:
    """For each text: n_words, base places and the method's detections by word span (last inclusive), and a score.

    The score is the highest priority of any detection, over 100.
    """
    rows = []
    for text in texts.cast(pa.binary()).to_pylist():
        n, base, more = scan(text)
        spans = [[{"label": d.label, "first": d.start, "last": d.end - 1} for d in part] for part in (base, more)]
        rows.append({"n_words": n, "base": spans[0], "more": spans[1], "score": max((d.priority for d in base + more), default=0) / 100})
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("base", span), ("more", span), ("score", pa.float64())]))


def label_list(spans: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda d: d["label"]))), ",")
