"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, schemes
and identifier cues. A local parser at each anchor expands to the left and right,
finds the boundaries and validates (octets, digit counts, Luhn, IBAN remainder,
host). A parser that has consumed a stretch skips the anchors in it.

Kinds: email, ip, card and phone are the base; url (scheme and host), secret
(a value after a cue such as ``token =``, or a key with a known prefix) and
account (IBAN, or digits after an account cue) are the method's own.

Defined results: null is empty; positions are code points, end exclusive;
repeated rows get equal results; spans of different kinds may overlap; other
columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base kinds first, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone", "url", "secret", "account")
BASE = KINDS[:4]

#: Cues whose value is secret, prefixes of keys with the length that follows, account cues.
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key")
KEY_PREFIXES = (("AKIA", 16), ("ASIA", 16), ("ghp_", 36))
ACCOUNT_CUES = ("iban", "account", "acct")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_VALUE = re.compile(r"[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9+/_.~-]{8,})")
_IBAN = re.compile(r"[^A-Za-z0-9\n]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:[ \t]+(?:no|number|nr))?[.#]?[ \t]*[:=#][ \t]*([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    """True if the check digit is right."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    """True if the rearranged number leaves 1 by 97."""
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def octet(digits: str) -> bool:
    """True if the number is 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def emails(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """At an at-sign; nothing before ``free`` belongs to the local part. The spans and the new ``free``."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return ([(start, 0, domain.end())], domain.end()) if domain else ([], free)


def addresses(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """At a digit: a chain of dotted numbers is cut into fours from the left; fewer than four left over are none."""
    chain = _DOTTED.match(text, at)
    parts = chain[0].split(".")
    found, pos = [], at
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = pos + sum(map(len, four)) + 3
        if all(map(octet, four)):
            found.append((pos, 1, end))
        pos = end + 1
    return found, chain.end()


def cards(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """At a digit: the whole chain of digits with single spaces or hyphens between."""
    chain = _CHAIN.match(text, at)
    digits = chain[0].replace(" ", "").replace("-", "")
    good = 12 <= len(digits) <= 19 and luhn(digits)
    return [(at, 2, chain.end())] if good else [], chain.end()


def phones(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """At a plus sign."""
    match = _PHONE.match(text, at)
    if not match:
        return [], free
    good = 9 <= sum(c in _DIGITS for c in match[0]) <= 15
    return [(at, 3, match.end())] if good else [], match.end()


def urls(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """At ``://``: scheme letters to the left, a host with a dot to the right, closing punctuation left out."""
    start = at
    while start > free and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    rest = _URL_REST.match(text, at + 3) if start < at else None
    if not rest:
        return [], free
    end = at + 3 + len(rest[0].rstrip(".,;:!?)]}"))
    host = re.split("[:/?#]", text[at + 3 : end], maxsplit=1)[0]
    return ([(start, 4, end)], end) if "." in host.strip(".") or host == "localhost" else ([], free)


def secrets(text: str, at: int, free: int, cue: str = "") -> tuple[list[Span], int]:
    """At the start of a cue: the value that follows = or :, if it has a digit."""
    match = _VALUE.match(text, at + len(cue))
    if not match or not any(c in _DIGITS for c in match[1]):
        return [], free
    return [(match.start(1), 5, match.end(1))], match.end(1)


def keys(text: str, at: int, free: int, prefix: str = "", more: int = 0) -> tuple[list[Span], int]:
    """At the prefix of a key of fixed length that stands alone."""
    end = at + len(prefix) + more
    body = text[at + len(prefix) : end]
    alone = (at == 0 or text[at - 1] not in _WORD) and (end == len(text) or text[end : end + 1] not in _WORD)
    good = len(body) == more and all(c in _WORD for c in body) and alone
    return ([(at, 5, end)], end) if good else ([], free)


def accounts(text: str, at: int, free: int, cue: str = "") -> tuple[list[Span], int]:
    """At the start of a cue: an IBAN whose remainder is right (the longest such), or a labelled number."""
    if match := _IBAN.match(text, at + len(cue)):
        for end in range(match.end(1), match.start(1) + 14, -1):
            if text[end - 1] != " " and iban_ok(text[match.start(1) : end]):
                return [(match.start(1), 6, end)], end
    if match := _ACCOUNT.match(text, at + len(cue)):
        return [(match.start(1), 6, match.end(1))], match.end(1)
    return [], free


@cache
def _automaton():
    """Anchors with their parsers. A parser has its own ``free`` position, by lane."""
    import ahocorasick

    anchors: dict[str, list[tuple[int, Callable]]] = {"@": [(0, emails)], "+": [(3, phones)], "://": [(4, urls)]}
    for digit in "0123456789":
        anchors[digit] = [(1, addresses), (2, cards)]

    def cased(cue: str) -> set[str]:
        return {cue, cue.upper(), cue.capitalize()}

    for cue in SECRET_CUES:
        for form in cased(cue):
            anchors[form] = [(5, lambda t, at, free, c=cue: secrets(t, at, free, c))]
    for prefix, more in KEY_PREFIXES:
        anchors[prefix] = [(6, lambda t, at, free, p=prefix, m=more: keys(t, at, free, p, m))]
    for cue in ACCOUNT_CUES:
        for form in cased(cue):
            anchors[form] = [(7, lambda t, at, free, c=cue: accounts(t, at, free, c))]
    automaton = ahocorasick.Automaton()
    for anchor, parsers in anchors.items():
        automaton.add_word(anchor, (len(anchor), parsers))
    automaton.make_automaton()
    return automaton


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind."""
    if not text:
        return []
    found: set[Span] = set()
    free = [0] * 8
    for last, (length, parsers) in _automaton().iter(text):
        at = last - length + 1
        for lane, parse in parsers:
            if at >= free[lane]:
                spans, free[lane] = parse(text, at, free[lane])
                found.update(spans)
    return sorted(found)


def shown(spans: list[Span]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in capitals."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.arrow_udf(_SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([t and redact(t, find(t)) for t in texts.to_pylist()], pa.string())


def spans(text: Column) -> Column:
    """Array of (kind, start, end) by start, then kind."""
    return _spans(text)


def redact_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with personal data in ``text`` replaced by ``<KIND>``; null stays null."""
    return docs.withColumn(text, _redacted(F.col(text)))


_DIGEST = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _digests(texts: list[str | None]) -> Iterator[dict]:
    for text in texts:
        found = find(text)
        base = [s for s in found if s[1] < len(BASE)]
        counts = {f"n_{k}": sum(s[1] == n for s in base) for n, k in enumerate(BASE)}
        yield counts | {"base_sha256": hashlib.sha256(shown(base).encode()).hexdigest(), "spans": shown(found)}


@F.arrow_udf(_DIGEST)
def digest(texts: pa.Array) -> pa.Array:
    """Counts and digest of the base spans, and all spans as a string."""
    rows = list(_digests(texts.to_pylist()))
    return pa.array(rows, pa.struct([(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())]))
