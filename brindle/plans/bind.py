"""Query trees bound to a table's fields: predicates and scored terms as Columns.

An undeclared name is looked up in every dynamic field; a dynamic value is
compared in each reading that the literal allows; where an array stands on its path, each
element is followed. Bare terms search every default field whose type the literal fits, and
the text of every string in a dynamic one.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import DYNAMIC, Field, IndexConfig, split_name
from brindle.functions.parse import address_name, format_time, is_number, json_path, kind_of, let
from brindle.functions.tokenize import literal_tokens, token_lists, tokens
from brindle.plans.grammar import Among, Boolean, Everything, Exists, Node, QuerySyntaxError, Range, Term


#: The undeclared keys of a document.
SPILL_OVER = Field((DYNAMIC,), "dynamic_object", {"indexed": True, "expand_dots": True})


def column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Searchable:
    """A table with the fields that queries can name."""

    df: DataFrame
    fields: tuple[Field, ...]
    dynamic: bool = False

    @classmethod
    def of(cls, df: DataFrame, config: IndexConfig) -> Searchable:
        return cls(df, tuple(config.leaves()), True)

    def resolve(self, name: str) -> list[tuple[Field, list[str]]]:
        """Fields with the path inside them that a name means."""
        parts = split_name(name)
        for field in self.fields:
            here = list(field.path)
            if here == parts and field.kind != "dynamic_object":
                return [self._indexed(field, [])]
            if field.kind == "dynamic_object" and parts[: len(here)] == here:
                return [self._indexed(field, parts[len(here) :])]
        found = [(f, parts) for f in self.fields if f.kind == "dynamic_object" and f.indexed]
        if self.dynamic:
            found.append((SPILL_OVER, parts))
        if not found:
            raise QuerySyntaxError(f"no field {name!r}")
        return found

    @staticmethod
    def _indexed(field: Field, rest: list[str]) -> tuple[Field, list[str]]:
        if not field.indexed:
            raise QuerySyntaxError(f"field {field.name!r} isn't indexed")
        return field, rest

    def targets(self, name: str | None) -> list[tuple[Field, list[str]]]:
        if name is not None:
            return self.resolve(name)
        return [(f, []) for f in self.fields if f.indexed] + ([(SPILL_OVER, [])] if self.dynamic else [])


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def phrase(words: Column, wanted: list[str], slop: int = 0, prefix: bool = False) -> Column:
    """Whether the tokens stand in this order, with at most ``slop`` others between; the last may be a prefix.

    Tokens of several words' literals hold no space, so that they are compared as one string with
    single spaces: a search in it for slop 0; for slop a bounded pattern, which for more than two
    words is followed by one pass over the tokens.
    """
    n = len(wanted)
    if n == 0:
        return F.lit(False)
    if n == 1:
        return F.exists(words, lambda t: t.startswith(wanted[0])) if prefix else F.array_contains(words, wanted[0])
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    if slop == 0:
        return F.contains(joined, F.lit(f" {' '.join(wanted)}{'' if prefix else ' '}"))
    near = joined.rlike(" " + f"(?:[^ ]+ ){{0,{slop}}}".join(re.escape(w) + " " for w in wanted))
    return near if n == 2 else near & _within(words, wanted, slop)


def _within(words: Column, wanted: list[str], slop: int) -> Column:
    """The same in one pass: for each number of words found in order the latest place where they began, and whether all fitted."""
    n = len(wanted)
    nowhere = -(slop + n + 1)
    begun = [f"b{k}" for k in range(n - 1)]
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("found"), *[F.lit(nowhere).alias(b) for b in begun])

    def step(state: Column, t: Column) -> Column:
        at = state["at"]
        made = [F.when(t == wanted[0], at).otherwise(state["b0"]).alias("b0")]
        # A word of the phrase moves on from where the ones before it were found, earlier tokens only.
        made += [F.when(t == wanted[k], state[f"b{k - 1}"]).otherwise(state[f"b{k}"]).alias(f"b{k}") for k in range(1, n - 1)]
        ends = (t == wanted[-1]) & (at - state[begun[-1]] - (n - 1) <= slop) & (state[begun[-1]] >= 0)
        return F.struct((at + 1).alias("at"), (state["found"] | ends).alias("found"), *made)

    return F.aggregate(words, start, step, lambda state: state["found"])


_TIME = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)?)?")
_DECIMAL = re.compile(r"[+-]?\d{1,37}")


def literal(field: Field, text: str) -> Column | None:
    """The literal as the field's type; null if it isn't one."""
    if field.kind == "number":
        if _DECIMAL.fullmatch(text):
            return F.lit(int(text)) if abs(int(text)) < 2**63 else F.lit(text).cast("decimal(38,0)")
        try:
            return F.lit(float(text))
        except ValueError:
            return None
    if field.kind == "boolean":
        return F.lit(text == "true") if text in ("true", "false") else None
    if field.kind == "datetime":
        return F.lit(text).cast("timestamp") if _TIME.fullmatch(text) else None
    if field.kind == "ip":
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        return F.lit(bytearray(ip.packed if ip.version == 6 else b"\0" * 10 + b"\xff\xff" + ip.packed))
    return F.lit(text)


def _between(value: Column, low: Column | None, high: Column | None, r: Range) -> Column:
    parts = []
    if low is not None:
        parts.append(value >= low if r.with_low else value > low)
    if high is not None:
        parts.append(value <= high if r.with_high else value < high)
    # A comparison with null is null, which is no match: the value, which may stand for all of its parsing, isn't named once more.
    return reduce(lambda a, b: a & b, parts) if parts else value.isNotNull()


def _typed(field: Field, leaf: Node, named: bool) -> Column | None:
    """A leaf on a field that is no text and not dynamic."""
    value = column(address_name(field) if field.kind == "ip" else field.name)

    def read(text: str) -> Column | None:
        found = literal(field, text)
        if found is None and named:
            raise QuerySyntaxError(f"{text!r} is no {field.kind} for {field.name!r}")
        return found

    if isinstance(leaf, Term):
        wanted = read(leaf.text)
        test = None if wanted is None else (lambda v: v == wanted)
    elif isinstance(leaf, Among):
        listed = [x for x in map(read, leaf.values) if x is not None]
        test = lambda v: _any([v == x for x in listed])
    else:
        low, high = (None if b is None else read(b) for b in (leaf.low, leaf.high))
        test = None if (low is None) != (leaf.low is None) or (high is None) != (leaf.high is None) else (lambda v: _between(v, low, high, leaf))
    if test is None:
        return None
    return F.exists(value, test) if field.array else test(value)


def _text_leaf(words: Column, field: Field, leaf: Node) -> Column:
    tokenizer = field.tokenizer

    def wanted(text: str) -> list[str]:
        found = literal_tokens(text, tokenizer)
        if len(found) > 1 and not field.positions:
            raise QuerySyntaxError(f"{text!r} is a phrase, and field {field.name!r} has no positions")
        return found

    if isinstance(leaf, Term):
        return phrase(words, wanted(leaf.text), leaf.slop, leaf.prefix)
    if isinstance(leaf, Among):
        return _any([phrase(words, wanted(v)) for v in leaf.values])
    low, high = (None if b is None else F.lit(b if tokenizer in ("raw", "whitespace") else b.lower()) for b in (leaf.low, leaf.high))
    return F.exists(words, lambda t: _between(t, low, high, leaf))


def _dynamic_leaf(field: Field, path: list[str], leaf: Node) -> Column:
    base = column(field.name)
    if not path:
        return _anywhere(base, field, leaf)
    deep = len(path) > 1

    def value(b: Column) -> Column:
        found = F.try_variant_get(b, json_path(path), "variant")
        if deep and field.options.get("expand_dots", True):
            found = F.coalesce(found, F.try_variant_get(b, json_path([".".join(path)]), "variant"))
        return found

    def begun(b: Column) -> Column:
        """Whether an object has the path's first key, or all of it as one: most have neither, and are done."""
        first = F.try_variant_get(b, json_path(path[:1]), "variant").isNotNull()
        return first | F.try_variant_get(b, json_path([".".join(path)]), "variant").isNotNull() if deep else first

    def something(v: Column) -> Column:
        return v.isNotNull() & (kind_of(v) != "VOID")

    # The column may stand for an expression that parses the document: it is named once.
    if isinstance(leaf, Exists):
        return let(base, lambda b: begun(b) & (let(value(b), something) | F.coalesce(F.exists(_through_arrays(b, path), something), F.lit(False))) if deep else let(value(b), something))
    # But a UDF's input takes no lambda that names another's variable.
    once = (lambda v, then: then(v)) if field.tokenizer == "en_stem" else let
    items = once(base, lambda b: F.when(begun(b), once(value(b), lambda v: F.coalesce(_elements(v), F.when(v.isNotNull(), F.array(v)), *([_through_arrays(b, path)] if deep else [])))))

    def string(v: Column) -> Column:
        return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def spoken(text: Column) -> Column:
        # A range over words doesn't fit a string that is a time: there it is one of times only.
        return F.when(format_time(text, "rfc3339").isNull(), text) if isinstance(leaf, Range) else text

    def one(v: Column, kind: Column, text: Column, words: Column) -> Column:
        readings = [_text_leaf(words, field, leaf)]
        kinds = {
            "number": F.when(is_number(v, kind), F.try_variant_get(v, "$", "double")),
            "boolean": F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
            "datetime": format_time(text, "rfc3339"),
        }
        for name, held in kinds.items():
            typed = Field(("_",), name, {})
            if isinstance(leaf, Term):
                wanted = literal(typed, leaf.text)
                readings += [held == wanted] if wanted is not None else []
            elif isinstance(leaf, Among):
                readings += [held == x for x in (literal(typed, t) for t in leaf.values) if x is not None]
            else:
                low, high = (None if b is None else literal(typed, b) for b in (leaf.low, leaf.high))
                if (low is None) == (leaf.low is None) and (high is None) == (leaf.high is None):
                    readings.append(let(held, lambda x: _between(x, low, high, leaf)))  # noqa: B023
        return _any([F.coalesce(r, F.lit(False)) for r in readings])

    def read(v: Column, words: Callable[[Column], Column]) -> Column:
        return let(kind_of(v), lambda kind: let(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), lambda text: let(words(text), lambda w: one(v, kind, text, w))))

    if _only_words(leaf):
        found = lambda words: F.coalesce(_text_leaf(words, field, leaf), F.lit(False))
        if field.tokenizer == "en_stem":
            return F.exists(token_lists(F.transform(items, string), field.tokenizer), found)
        return F.exists(items, lambda v: let(tokens(string(v), field.tokenizer), found))
    if field.tokenizer != "en_stem":
        return F.exists(items, lambda v: read(v, lambda text: tokens(spoken(text), field.tokenizer)))
    stems = token_lists(F.transform(items, lambda v: spoken(string(v))), field.tokenizer)
    return F.exists(F.zip_with(items, stems, lambda v, words: read(v, lambda _: words)), lambda found: found)


def _only_words(leaf: Node) -> bool:
    """Whether a leaf's literals are words only, so that nothing but strings can hold them."""
    texts = [leaf.text] if isinstance(leaf, Term) else leaf.values if isinstance(leaf, Among) else None
    kinds = [Field(("_",), name, {}) for name in ("number", "boolean", "datetime")]
    return texts is not None and all(literal(kind, t) is None for kind in kinds for t in texts)


def _elements(v: Column) -> Column:
    """The elements of an array variant; null for anything else."""
    # What isn't an array can't be read as one; its kind, spelled out with all that is in it, isn't needed.
    return F.try_variant_get(v, "$", "array<variant>")


def _through_arrays(base: Column, path: list[str]) -> Column:
    """The values at a path whose every step goes into each element of an array that stands there."""
    items = F.array(base)
    for part in path:
        one = json_path([part])
        several = F.transform(items, lambda v: F.coalesce(_elements(v), F.array(v)))
        items = F.filter(F.transform(F.flatten(several), lambda v: F.try_variant_get(v, one, "variant")), lambda v: v.isNotNull())
    return F.flatten(F.transform(items, lambda v: F.coalesce(_elements(v), F.array(v))))


def _anywhere(base: Column, field: Field, leaf: Node) -> Column | None:
    """A bare term in any string of a dynamic value; other bare leaves need a path."""
    if not isinstance(leaf, Term):
        return None
    # Strings of the JSON text, keys included, which a colon follows; escapes end words but for quotes and the like.
    strings = F.regexp_extract_all(F.to_json(base), F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    plain = F.transform(F.filter(strings, lambda t: ~t.endswith(":")), lambda t: F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"\\[nrtbf]", " "), r"\\(.)", "$1"))
    return F.exists(token_lists(plain, field.tokenizer), lambda words: _text_leaf(words, field, leaf))


def field_tokens(field: Field) -> Column:
    """All tokens of a text field."""
    value = column(field.name)
    return tokens(F.array_join(value, " ") if field.array else value, field.tokenizer)


def _leaf(table: Searchable, leaf: Node) -> Column:
    parts = []
    for field, path in table.targets(leaf.field):
        if field.kind == "dynamic_object":
            part = _dynamic_leaf(field, path, leaf)
        elif isinstance(leaf, Exists):
            part = column(field.name).isNotNull()
        elif field.kind == "text":
            if field.array and field.tokenizer == "raw":
                words = column(field.name)
            else:
                words = field_tokens(field)
            if field.tokenizer == "raw" and not field.array and isinstance(leaf, (Range, Among)) or (field.tokenizer == "raw" and not field.array and isinstance(leaf, Term) and not leaf.prefix):
                part = _raw(column(field.name), leaf)
            else:
                part = _text_leaf(words, field, leaf)
        else:
            part = _typed(field, leaf, leaf.field is not None)
        if part is not None:
            parts.append(F.coalesce(part, F.lit(False)) if len(table.targets(leaf.field)) > 1 else part)
    return _any(parts)


def _raw(value: Column, leaf: Node) -> Column:
    """On a raw text the value itself is compared, so that the scan can skip by it."""
    if isinstance(leaf, Term):
        return value == leaf.text
    if isinstance(leaf, Among):
        return value.isin(*leaf.values) if leaf.values else F.lit(False)
    return _between(value, None if leaf.low is None else F.lit(leaf.low), None if leaf.high is None else F.lit(leaf.high), leaf)


def predicate(table: Searchable, node: Node) -> Column:
    """The tree as one boolean Column (null counts as no match)."""
    if isinstance(node, Everything):
        return F.lit(True)
    if not isinstance(node, Boolean):
        return _leaf(table, node)
    if not node.must and not node.should:
        return F.lit(False)
    needed = [predicate(table, n) for n in node.must] or [_any([F.coalesce(predicate(table, n), F.lit(False)) if len(node.should) > 1 else predicate(table, n) for n in node.should])]
    barred = [~F.coalesce(predicate(table, n), F.lit(False)) for n in node.never]
    return reduce(lambda a, b: a & b, needed + barred)


def scored_leaves(node: Node, boost: float = 1.0) -> Iterator[tuple[Node, float]]:
    """The leaves that can add to a score, with the product of their boosts."""
    boost *= node.boost
    if isinstance(node, Boolean):
        for child in (*node.must, *node.should):
            yield from scored_leaves(child, boost)
    else:
        yield node, boost
