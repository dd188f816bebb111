"""The four tokenizers, as Columns for documents and as functions for query literals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.stem import stem

#: UTF-8 bytes from which the default tokenizer drops a token.
TOKEN_BYTES = 40


#: Tokens that are stemmed at a time.
TOKENS_AT_ONCE = 1 << 20


def _stems(words: pa.Array) -> pa.Array:
    """The stem of each word; a word is made a Python string once for many places."""
    made = []
    for at in range(0, len(words), TOKENS_AT_ONCE):
        coded = words[at : at + TOKENS_AT_ONCE].dictionary_encode()
        made.append(pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices))
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def _inside(lists: pa.ListArray, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The lists with all their items changed at once; null lists stay null."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32"))
    return pa.ListArray.from_arrays(offsets, change(lists.flatten()), mask=lists.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    return _inside(tokens, _stems)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _stemmed_lists(lists: pa.Array) -> pa.Array:
    return _inside(lists, lambda inner: _inside(inner, _stems))


def tokens(text: Column, tokenizer: str = "default") -> Column:
    """Array of tokens in order; null stays null."""
    if tokenizer == "raw":
        return F.when(text.isNotNull(), F.array(text))
    if tokenizer == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    plain = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < TOKEN_BYTES))
    return _stemmed(plain) if tokenizer == "en_stem" else plain


def token_lists(texts: Column, tokenizer: str = "default") -> Column:
    """The tokens of each text of an array. (The stemmer is a UDF, which a lambda can't call.)"""
    plain = F.transform(texts, lambda t: tokens(t, "default" if tokenizer == "en_stem" else tokenizer))
    return _stemmed_lists(plain) if tokenizer == "en_stem" else plain


def literal_tokens(text: str, tokenizer: str = "default") -> list[str]:
    """The tokens of a query literal."""
    import regex

    if tokenizer == "raw":
        return [text]
    if tokenizer == "whitespace":
        return text.split()
    plain = [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t and len(t.encode()) < TOKEN_BYTES]
    return [stem(t) for t in plain] if tokenizer == "en_stem" else plain
