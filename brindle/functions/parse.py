"""JSON lines to typed columns, in one select. Casts are guarded: what Spark accepts too freely is refused."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import DYNAMIC, Field, IndexConfig

TYPES = {"u64": "decimal(20,0)", "i64": "bigint", "f64": "double"}
ERRORS, LINE = "_errors", "_line"
#: Seconds between which an integer is an epoch time; its unit follows from its size.
EPOCH = (72_057_595, 8_589_934_591)
U64_MOST = 2**64 - 1


#: A word in any case between white space.
_SPELLED = r"^[ \t\n\x0B\f\r]*(?i:{})[ \t\n\x0B\f\r]*\z"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FOUR = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _four_hex(text: Column) -> Column:
    """The eight hex digits of an IPv4 address."""
    parts = F.split(text, r"\.")
    return F.concat(*[F.lpad(F.hex(F.get(parts, F.lit(k)).try_cast("bigint")), 2, "0") for k in range(4)])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _groups(text: Column) -> Column:
    """The parts between colons; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _six_hex(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address, an IPv4 address at its end included; null for what is none."""
    four = F.regexp_extract(text, rf"(?<=:)({_FOUR})\z", 1)

    def plain(last: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(last))
        tail = _four_hex(last)
        return F.when(last == "", text).otherwise(F.concat(head, F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))

    def filled(halves: Column) -> Column:
        # A double colon stands for one group of zeros at least.
        left, right = _groups(F.get(halves, F.lit(0))), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        fits = ((F.size(halves) == 1) & (missing == 0)) | ((F.size(halves) == 2) & (missing > 0))
        return F.when(fits, F.concat(left, zeros, right))

    def joined(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z")), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    return let(let(let(four, plain), lambda t: F.split(t, "::")), lambda halves: let(filled(halves), joined))


def address_bytes(text: Column) -> Column:
    """16 bytes of an address, IPv4 mapped into IPv6; null for what is no address (or has a zone)."""
    four = F.when(text.rlike(rf"^{_FOUR}\z"), F.concat(F.lit("0" * 20 + "FFFF"), _four_hex(text)))
    return F.unhex(four.when(text.contains(":"), _six_hex(text)))


def json_path(parts: list[str] | tuple[str, ...]) -> str:
    """A variant path of literal keys."""
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)


def kind_of(v: Column) -> Column:
    """Type of a variant; VOID for a JSON null, null where there is none."""
    return F.schema_of_variant(v)


def is_number(v: Column, kind: Column | None = None) -> Column:
    kind = kind_of(v) if kind is None else kind
    return (kind == "BIGINT") | kind.startswith("DECIMAL(") | (kind == "DOUBLE") | (kind == "FLOAT")


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _string(v: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", _get(v, "string"))


# Each parser takes the variant's kind too where the caller has it: finding a kind costs as much as a value.


def parse_number(v: Column, kind: str, parse_string: bool = True, found: Column | None = None) -> Column:
    """Numbers of the kind, and (untrimmed) strings that spell one."""
    target = TYPES[kind]
    found = kind_of(v) if found is None else found
    if kind == "f64":
        native = F.when(is_number(v, found), _get(v, "double"))
        guard = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
    else:
        # An integer of 64 bits is read as it is: the variant's own way to a decimal costs several times as much.
        native = F.when(found == "BIGINT", _get(v, "bigint").cast("decimal(38,0)")).when(found.startswith("DECIMAL(") & found.endswith(",0)"), _get(v, "decimal(38,0)"))
        guard = r"^[+-]?\d+$" if kind == "i64" else r"^\+?\d+$"
    # Filters that are moved below the parsing spell this out for each time that it is named, so that kind and text are named as seldom as may be.
    spelled = F.regexp_extract(_get(v, "string"), guard, 0).try_cast("double" if kind == "f64" else "decimal(38,0)")
    value = F.when(found == "STRING", spelled if parse_string else None).otherwise(native)
    if kind == "u64":
        value = F.when(value.between(F.lit(0).cast("decimal(38,0)"), F.lit(str(U64_MOST)).cast("decimal(38,0)")), value)
    return value.try_cast(target)


def parse_boolean(v: Column, parse_string: bool = True, found: Column | None = None) -> Column:
    """JSON booleans, and true or false in any case, trimmed."""
    found = kind_of(v) if found is None else found
    native = F.when(found == "BOOLEAN", _get(v, "boolean"))
    # Both patterns take ASCII letters only, as no other letter's lower case is one of these.
    text = _string(v, found)
    spelled = F.when(text.rlike(_SPELLED.format("true")), True).when(text.rlike(_SPELLED.format("false")), False)
    return F.coalesce(native, spelled) if parse_string else native


def epoch_time(number: Column) -> Column:
    """A timestamp from an integer of seconds, milli-, micro- or nanoseconds; null in the gaps between their ranges."""
    low, high = EPOCH
    made = F.when(number.between(low, high), F.timestamp_seconds(number))
    made = made.when(number.between(low * 1000, high * 1000 + 999), F.timestamp_millis(number))
    made = made.when(number.between(low * 10**6, high * 10**6 + 999_999), F.timestamp_micros(number))
    return made.when(number >= low * 10**9, F.timestamp_micros(F.call_function("div", number, F.lit(1000))))


def format_time(text: Column, name: str) -> Column:
    """A timestamp from a string of the format; null if it isn't of it."""
    if name == "rfc2822":
        return F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    # What doesn't begin with a year isn't tried: to fail costs far more than to fit.
    text = F.when(text.rlike(r"^[+-]?\d{4}"), text)
    whole = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]XXX"))
    if name == "rfc3339":
        return whole
    basic = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssXX"))
    return F.coalesce(whole, basic, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmXXX")))


def parse_datetime(v: Column, formats: list[str], found: Column | None = None) -> Column:
    """The first format that fits; ``timestamp`` takes JSON integers only, the others strings only."""
    found = kind_of(v) if found is None else found
    text = _string(v, found)
    number = F.when(found == "BIGINT", _get(v, "bigint"))
    return F.coalesce(*[epoch_time(number) if f == "timestamp" else format_time(text, f) for f in formats])


def parse_value(v: Column, field: Field, found: Column | None = None) -> Column:
    """One value of a field; null if it isn't one."""
    o = field.options
    found = kind_of(v) if found is None else found
    if field.kind == "number":
        return parse_number(v, o["type"], o["parse_string"], found)
    if field.kind == "boolean":
        return parse_boolean(v, o["parse_string"], found)
    if field.kind == "datetime":
        return parse_datetime(v, o["formats"], found)
    if field.kind == "dynamic_object":
        return F.when(_get(v, "map<string,variant>").isNotNull(), v)
    return _string(v, found)


def _each(items: Column, field: Field) -> Column:
    return F.transform(items, lambda v: parse_value(v, field))


def _holds(field: Field) -> bool:
    """Whether a field's value is an array or an object."""
    return field.array or field.kind == "dynamic_object"


def _last_of_equal_keys(found: Column) -> Column:
    # Reading a map keeps equal keys; making one follows the session's rule.
    return F.map_from_entries(F.map_entries(found))


def address_name(field: Field) -> str:
    """The column of an ip field's 16-byte form."""
    return field.name + "#bytes"


def _apart(value: Column) -> Column:
    """The value by way of a lambda, which keeps its step out of whole-stage code: one method for all fields is too long to be compiled by the JVM."""
    return let(value, lambda v: v)


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_documents(lines: DataFrame, config: IndexConfig, column: str = "value") -> DataFrame:
    """Typed columns of every line, ``_dynamic`` (a variant of all undeclared keys), ``_errors`` and ``_line``.

    ``_errors`` names the fields whose value isn't of their type, or has "json" if the line isn't a JSON object.

    Each step uses the one before it more than once, as columns: the keys of the line, their values and kinds,
    what is read from them, the errors. The keys come from a generator, below which no filter is
    moved: it would parse the line again for each time that it names a field.
    """
    keys = _last_of_equal_keys(F.from_json(column, "map<string,variant>"))
    docs = lines.select(F.col(column).alias(LINE), F.explode_outer(F.array(keys)).alias("_map"))
    declared, leaves = [f.path[0] for f in config.fields], config.leaves()

    def found(field: Field) -> Column:
        top = F.col("_map").getItem(field.path[0])
        return top if len(field.path) == 1 else F.try_variant_get(top, json_path(field.path[1:]), "variant")

    rest = F.map_filter("_map", lambda k, _: ~k.isin(declared)) if declared else F.col("_map")
    raws = [found(f).alias(f"_raw{k}") for k, f in enumerate(leaves)]
    # The kind of a container would be spelled out with all that is in it: it's asked for where a scalar should be.
    kinds = [kind_of(found(f)).alias(f"_kind{k}") for k, f in enumerate(leaves) if not _holds(f)]
    docs = docs.select(LINE, *raws, *kinds, rest.alias("_rest"), _apart(F.col("_map").isNull()).alias("_broken"))
    values, there = [], []
    for k, field in enumerate(leaves):
        raw, kind = F.col(f"_raw{k}"), None if _holds(field) else F.col(f"_kind{k}")
        made = _each(_get(raw, "array<variant>"), field) if field.array else parse_value(raw, field, kind)
        null_is_absent = field.kind not in ("datetime", "ip")
        values.append(made.alias(field.name))
        there.append((raw.isNotNull() & ~F.is_variant_null(raw) if null_is_absent else raw.isNotNull()).alias(f"_there{k}"))
    docs = docs.select(LINE, *values, *there, F.to_variant_object("_rest").alias(DYNAMIC), _apart(F.col("_broken")).alias("_broken"))
    packed = {f.name: F.transform(_named(f.name), address_bytes) if f.array else address_bytes(_named(f.name)) for f in leaves if f.kind == "ip"}
    docs = docs.select("*", *[value.alias(name + "#bytes") for name, value in packed.items()])
    shown, faults = [], [("json", F.col("_broken"))]
    for k, field in enumerate(leaves):
        read = _named(address_name(field) if field.kind == "ip" else field.name)
        bad = read.isNull() | F.exists(read, lambda v: v.isNull()) if field.array else read.isNull()
        faults.append((field.name, F.col(f"_there{k}") & bad))
        shown += [read] if field.kind == "ip" else []
        shown.append(_named(field.name))
    # Most lines have none: then no array is made and looked through, which isn't compiled.
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults]))
    none = F.array().cast("array<string>")
    return docs.select(LINE, *shown, DYNAMIC, F.when(reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, bad in faults]), errors).otherwise(none).alias(ERRORS))
