"""The two word definitions that the operators share, for Columns and for bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"

#: Byte table for ``alnum_words``: A-Z to a-z, other ASCII but digits and a-z to a space; bytes from 0x80 stay.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Array of the words between white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z in lower case."""
    return text.translate(TO_WORDS).split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
