"""The registered queries of the search engine on the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import Field, escape_name, load, split_name
from brindle.functions.parse import EPOCH, address_bytes, address_name, epoch_time, format_time, parse_boolean, parse_datetime, parse_documents, parse_number
from brindle.functions.tokenize import tokens
from brindle.operators.catalog import Catalog
from brindle.operators.search import SCORE, matches, postings, postings_search, ranked, result_json, top
from brindle.plans.bind import Searchable
from brindle.plans.shared import shared_dir
from brindle.session import configure
from brindle.sources.connect import connect, kafka_options
from brindle.sources.tables import dealt, read_table
from brindle.streaming.ingest import ingest, milliseconds


def _text(name: str, tokenizer: str = "default") -> Field:
    return Field((name,), "text", {"indexed": {"tokenizer": tokenizer}})


def _number(name: str, kind: str = "f64") -> Field:
    return Field((name,), "number", {"indexed": True, "type": kind})


def _time(name: str) -> Field:
    return Field((name,), "datetime", {"indexed": True})


#: What each table's columns are as fields.
FIELDS = {
    "documents": (_text("text"), _text("lang", "raw"), _text("source", "raw"), _number("n_chars", "i64")),
    "benchmark": (_text("text"),),
    "conversations": (_text("role"), _text("text")),
    "pages": (_text("url"),),
    "lineitem": (_number("l_quantity"), _number("l_discount"), _text("l_returnflag", "raw")),
    "orders": (_time("o_orderdate"), _text("o_orderstatus", "raw")),
    "part": (_text("p_brand", "raw"),),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> Searchable:
    configure(spark)
    df = read_table(spark, sf_dir, name)
    for field in FIELDS[name]:
        if field.kind == "datetime":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return Searchable(df, FIELDS[name])


def _filter(table: str, query: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A search of a table for all its matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matches(_table(spark, sf_dir, table), query).select(*columns)

    return run


_TOK = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' and strlen(x) < 40)"


def _sql_tokens(column: str = "text") -> str:
    return _TOK.format(column)


def _has(word: str, column: str = "text") -> str:
    return f"coalesce(list_contains({_sql_tokens(column)}, '{word}'), false)"


#: Three words with at most six others between them in all: each way to share six among the two gaps.
_GAPS = "|".join(f"(?:[^ ]+ ){{0,{n}}}of (?:[^ ]+ ){{0,{6 - n}}}" for n in range(7))
_SLOP_THREE = f"regexp_matches(' ' || array_to_string({_sql_tokens()}, ' ') || ' ', ' the (?:{_GAPS})and ')"

#: name: (table, query, columns, SQL condition)
FILTERS: dict[str, tuple[str, str, tuple[str, ...], str]] = {
    "term_text": ("documents", "text:The", ("doc_id",), _has("the")),
    "term_raw": ("documents", "lang:en", ("doc_id",), "lang = 'en'"),
    "bool_and": ("documents", "text:the AND lang:en", ("doc_id",), f"{_has('the')} and lang = 'en'"),
    "bool_or": ("documents", "text:der OR lang:fr", ("doc_id",), f"{_has('der')} or lang = 'fr'"),
    "bool_default_or": ("documents", "text:der lang:fr", ("doc_id",), f"{_has('der')} or lang = 'fr'"),
    "bool_not": ("documents", "* AND NOT text:the", ("doc_id",), f"not {_has('the')}"),
    "negative_only": ("documents", "-text:the", ("doc_id",), "false"),
    "must_mustnot": ("documents", "+text:the -lang:en text:of", ("doc_id",), f"{_has('the')} and lang <> 'en'"),
    "grouping": ("documents", "(text:the OR text:der) AND lang:(en OR de) AND n_chars:<3000", ("doc_id",), f"({_has('the')} or {_has('der')}) and lang in ('en', 'de') and n_chars < 3000"),
    "range_inclusive": ("lineitem", "l_quantity:[10 TO 12]", ("l_orderkey", "l_linenumber"), "l_quantity between 10 and 12"),
    "range_half_open": ("lineitem", "l_quantity:[10 TO 12}", ("l_orderkey", "l_linenumber"), "l_quantity >= 10 and l_quantity < 12"),
    "range_exclusive": ("lineitem", "l_quantity:{10 TO 12}", ("l_orderkey", "l_linenumber"), "l_quantity > 10 and l_quantity < 12"),
    "range_open": ("lineitem", "l_quantity:[45 TO *]", ("l_orderkey", "l_linenumber"), "l_quantity >= 45"),
    "cmp_ge": ("lineitem", "l_quantity:>=49", ("l_orderkey", "l_linenumber"), "l_quantity >= 49"),
    "cmp_lt": ("lineitem", "l_discount:<0.02", ("l_orderkey", "l_linenumber"), "l_discount < 0.02"),
    "range_date": ("orders", "o_orderdate:[1995-01-01 TO 1995-07-01}", ("o_orderkey",), "o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-07-01'"),
    "range_text": ("part", "p_brand:[Brand#2 TO Brand#4}", ("p_partkey",), "p_brand >= 'Brand#2' and p_brand < 'Brand#4'"),
    "in_set": ("lineitem", "l_returnflag: IN [A R]", ("l_orderkey", "l_linenumber"), "l_returnflag in ('A', 'R')"),
    "phrase": ("documents", 'text:"of the"', ("doc_id",), f"contains(' ' || array_to_string({_sql_tokens()}, ' ') || ' ', ' of the ')"),
    "phrase_prefix": ("documents", 'text:"of th"*', ("doc_id",), f"contains(' ' || array_to_string({_sql_tokens()}, ' ') || ' ', ' of th')"),
    "phrase_slop": ("documents", 'text:"the of"~2', ("doc_id",), f"regexp_matches(' ' || array_to_string({_sql_tokens()}, '  ') || ' ', ' the (?: [^ ]+ ){{0,2}} of ')"),
    "default_fields": ("conversations", "assistant", ("conv_id", "turn"), f"{_has('assistant', 'role')} or {_has('assistant')}"),
    "match_all": ("documents", "*", ("doc_id",), "true"),
    "exists": ("documents", "lang:*", ("doc_id",), "lang is not null"),
    "array_contains": ("pages", "url:example", ("page_id",), _has("example", "url")),
    "text_token_range": ("documents", "text:[of TO og}", ("doc_id",), f"len(list_filter({_sql_tokens()}, lambda y: y >= 'of' and y < 'og')) > 0"),
    "phrase_slop_three": ("documents", 'text:"the of and"~6', ("doc_id",), _SLOP_THREE),
}


def dynamic_path_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undeclared number in a schemaless object."""
    configure(spark)
    events = read_table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("props"))
    props = Field(("props",), "dynamic_object", {"indexed": True, "expand_dots": True})
    return matches(Searchable(events, (props,)), "props.k:[60 TO 64]").select("event_id")


def epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as integers of three units, read back by size."""
    configure(spark)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    unit = F.when(F.col("event_id") % 3 == 0, F.floor(micros / 1_000_000)).when(F.col("event_id") % 3 == 1, F.floor(micros / 1000)).otherwise(micros)
    return read_table(spark, sf_dir, "events").select("event_id", F.unix_micros(epoch_time(unit.cast("bigint"))).alias("micros"))


def datetime_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in two formats and parsed in the order of formats."""
    configure(spark)
    date = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(date, "EEE, dd MMM yyyy HH:mm:ss Z"))
    parsed = F.coalesce(format_time(text, "rfc3339"), format_time(text, "rfc2822"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(parsed).alias("seconds"))


def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that are booleans, and others that aren't."""
    configure(spark)
    spelled = F.element_at(F.array(*map(F.lit, (" true ", "FaLsE", "t", "1"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "labels").select("doc_id", F.try_parse_json(F.concat(F.lit('"'), spelled, F.lit('"'))).alias("v"))
    return rows.select("doc_id", parse_boolean(F.col("v")).alias("value"))


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that are integers, and others that aren't."""
    configure(spark)
    number = F.col("event_id").cast("string")
    spelled = F.element_at(F.array(F.concat(F.lit("+"), number), F.concat(F.lit(" "), number), F.concat(number, F.lit("d")), F.concat(F.lit("-"), number)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.concat(F.lit('"'), spelled, F.lit('"'))).alias("v"))
    return rows.select("event_id", parse_number(F.col("v"), "i64").alias("value"))


def _lines(table: str, keys: Callable[[DataFrame], dict[str, object]]) -> Callable[[SparkSession, str], DataFrame]:
    """Rows of a table as JSON lines with the given keys."""

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = dealt(read_table(spark, sf_dir, table))
        return df.select(F.to_json(F.struct(*[value.alias(key) for key, value in keys(df).items()])).alias("value"))

    return made


#: An index that has every kind of field.
EVENTS_YAML = """
name: events
path: unused
schema:
  time_field: at
  fields:
    - {name: id, type: !number {type: u64}}
    - {name: at, type: !datetime {formats: [timestamp]}}
    - {name: kind, type: !text {indexed: {tokenizer: raw}}}
    - {name: words, type: !text }
    - {name: odd, type: !boolean }
    - {name: steps, array: true, type: !number {type: i64}}
    - {name: from, type: !ip }
    - {name: secret, type: !text {stored: false}}
    - {name: shown, type: !text {indexed: false}}
    - name: user
      type: !static_object
        fields:
          - {name: id, type: !number {type: i64}}
          - {name: name, type: !text }
    - {name: props, type: !dynamic_object {expand_dots: true}}
    - {name: note, type: !dynamic_object {stored: false, indexed: {tokenizer: en_stem}}}
"""


def _event_keys(df: DataFrame) -> dict[str, object]:
    n, user = F.col("event_id"), F.col("user_id")
    return {
        "id": n,
        "at": F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"),
        "kind": F.col("event_type"),
        "words": F.concat(F.lit("Event "), F.col("event_type"), F.lit(", user-"), user.cast("string")),
        "odd": F.when(n % 2 == 1, " TRUE ").otherwise("false"),
        "steps": F.array(n % 7, (n % 5).cast("long")),
        "from": F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(n / 256) % 256, n % 256),
        "secret": F.concat(F.lit("hush"), (n % 10).cast("string")),
        "shown": F.lit("no"),
        "user": F.struct(user.cast("string").alias("id"), F.concat(F.lit("u"), user.cast("string")).alias("name"), F.lit(1).alias("dropped")),
        "props": F.try_parse_json("props"),
        "note": F.struct(F.element_at(F.array(*map(F.lit, ("it failed", "users reporting, reporters too", "retried"))), (n % 3 + 1).cast("int")).alias("said")),
        "more": F.struct((n % 3).alias("left"), F.array(F.struct(F.concat(F.lit("tag"), (n % 4).cast("string")).alias("name"))).alias("list")),
        "day": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }


_event_lines = _lines("events", _event_keys)

#: What a result shows of an event, keys in order at every level; ``shown`` isn't indexed, and ``secret`` isn't stored.
_EVENT_JSON = """'{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","day":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","from":"10.0.' || (event_id // 256) % 256 || '.' || event_id % 256
  || '","id":' || event_id || ',"kind":"' || event_type || '","more":{"left":' || event_id % 3 || ',"list":[{"name":"tag' || event_id % 4 || '"}]},"odd":' || (event_id % 2 = 1)
  || ',"props":' || props_json || ',"steps":[' || event_id % 7 || ',' || event_id % 5 || '],"user":{"id":' || user_id || ',"name":"u' || user_id || '"},"words":"Event ' || event_type || ', user-' || user_id || '"}'"""


def _events_sql(condition: str, show: str = f"{_EVENT_JSON} as json", last: str = "") -> str:
    return f"select {show} from (select *, replace(replace(props, ': ', ':'), ', ', ',') as props_json from events) where {condition} {last}"


def _parsed(spark: SparkSession, sf_dir: str) -> Searchable:
    config, _ = load(EVENTS_YAML)
    return Searchable.of(parse_documents(_event_lines(spark, sf_dir), config), config)


def _event_filter(query: str) -> Callable[[SparkSession, str], DataFrame]:
    """Ids of the parsed events that match."""
    return lambda spark, sf_dir: matches(_parsed(spark, sf_dir), query).select("id")


#: name: (query over parsed events, SQL condition)
EVENT_FILTERS: dict[str, tuple[str, str]] = {
    "undeclared_term": ("day:2024", "true"),
    "undeclared_number": ("more.left:2 AND odd:true", "event_id % 3 = 2 and event_id % 2 = 1"),
    "dynamic_array_path": ("more.list.name:tag3", "event_id % 4 = 3"),
    "dynamic_date": ("day:[2024-01-05T00:00:00Z TO 2024-01-09T12:00:00Z}", "date_trunc('second', ts) >= timestamp '2024-01-05' and date_trunc('second', ts) < timestamp '2024-01-09 12:00:00'"),
    "dynamic_stems": ("note.said:reporter", "event_id % 3 = 1"),
    "dynamic_stemmed_phrase": ('note.said:"user report"', "event_id % 3 = 1"),
    "dynamic_default": ("tag1", "event_id % 4 = 1"),
    "dynamic_exists": ("more.list.name:* AND NOT gone:*", "true"),
    "number_array": ("steps:6", "event_id % 7 = 6 or event_id % 5 = 6"),
    "static_object_number": ("user.id:<20", "user_id < 20"),
    "static_object_text": ("user.name: IN [u1 u2 u3]", "user_id in (1, 2, 3)"),
    "escaped_term": (r"words:user\-7", "user_id = 7"),
    "unstored_field": ("secret:hush3", "event_id % 10 = 3"),
    "ip_field": ("from:{10.0.1.0 TO 10.0.2.0]", "event_id % 65536 > 256 and event_id % 65536 <= 512"),
    "boolean_field": ("odd:true", "event_id % 2 = 1"),
    "declared_time": ("at:>2024-01-20T00:00:00Z", "epoch_us(ts) // 1000000 > epoch_us(timestamp '2024-01-20') // 1000000"),
}


def result_json_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON: projection, nesting, spill-over, times, addresses, arrays, key order."""
    config, _ = load(EVENTS_YAML)
    return result_json(matches(_parsed(spark, sf_dir), "kind:click"), config)


def _catalog(spark: SparkSession, config: str = EVENTS_YAML) -> Catalog:
    catalog = Catalog(spark, f"{shared_dir(spark)}/brindle/catalog-{uuid4().hex}")
    catalog.create(config)
    return catalog


def _indexed(spark: SparkSession, sf_dir: str, parts: int = 3) -> Catalog:
    """The events, from text files, in an index of several file groups."""
    catalog = _catalog(spark)
    folder = f"{catalog.root}-lines"
    _event_lines(spark, sf_dir).write.text(folder)
    lines = connect(spark, folder)
    for k in range(parts):
        catalog.index("events", lines.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == k))
    return catalog


def _everything(catalog: Catalog) -> DataFrame:
    """A limit above any number of hits."""
    return catalog.search("events", "words:click AND NOT user.id:>=40", 2**31 - 1)


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, index in three commits, and search by the postings."""
    return _everything(_indexed(spark, sf_dir))


def merge_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a merge, with the number of file groups before and after."""
    catalog = _indexed(spark, sf_dir)
    before = len(catalog.files("events"))
    catalog.merge("events")
    return _everything(catalog).select("json", F.lit(before).cast("long").alias("files_before"), F.lit(len(catalog.files("events"))).cast("long").alias("files_after"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines streamed in micro-batches of one file; a second run finds nothing new, and a replayed batch isn't committed again."""
    catalog, lines = _catalog(spark), _event_lines(spark, sf_dir)
    folder = f"{catalog.root}-lines"
    lines.repartition(3).write.text(folder)
    for _ in range(2):
        ingest(catalog, "events", connect(spark, folder, True, 1), None).awaitTermination()
    catalog.index("events", lines, batch=("stream", 0))
    return _everything(catalog).select("json", F.lit(len(catalog.files("events"))).cast("long").alias("commits"))


def index_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results: by default one, none, some, of each file group, unranked, and of an index that is dropped and made anew."""
    catalog = _indexed(spark, sf_dir)
    counts = {
        "default": catalog.search("events", "*").count(),
        "none": catalog.search("events", "*", 0).count(),
        "some": catalog.search("events", "kind:click", 7).count(),
        "per_file": catalog.search("events", "kind:click", 7, per_file=True).count(),
        "unranked": catalog.search("events", "kind:click", 9, ranking=False).count(),
    }
    catalog.drop("events")
    catalog.create(EVENTS_YAML)
    counts["anew"] = catalog.search("events", "*", 5).count()
    return spark.createDataFrame(list(counts.items()), "asked string, hits long")


def index_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can't be indexed with the fields at fault: no JSON, bad numbers, times and addresses."""
    spoiled = {0: "broken", 1: "id", 2: "at", 3: "from"}
    n = F.col("event_id")

    def keys(df: DataFrame) -> dict[str, object]:
        made = _event_keys(df)
        made["id"] = F.when(n % 5 == 1, F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string"))
        made["at"] = F.when(n % 5 == 2, F.lit(12)).otherwise(made["at"])
        made["from"] = F.when(n % 5 == 3, F.lit("10.0.0")).otherwise(made["from"])
        return {k: made[k] for k in ("id", "at", "from")}

    lines = _lines("events", keys)(spark, sf_dir)
    lines = lines.select(F.when(F.get_json_object("value", "$.id").try_cast("long") % 5 == 0, F.concat(F.lit("["), "value")).otherwise(F.col("value")).alias("value"))
    bad = _catalog(spark).rejects("events", lines)
    known = F.element_at(F.col("_errors"), 1)
    return bad.select(F.regexp_extract("_line", r'"id":"x?(\d+)"', 1).cast("long").alias("id"), F.when(known == "json", spoiled[0]).otherwise(known).alias("fault"))


def epoch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers at both ends of each unit's range and in the gaps between, nanoseconds included."""
    configure(spark)
    low, high = EPOCH
    ends = [end for unit in (1, 10**3, 10**6) for end in (low * unit, high * unit + unit - 1)] + [low * 10**9, 2**63 - 1]
    values = sorted({v + d for v in ends for d in (-1, 0, 1) if v + d < 2**63} | {0, -5})
    rows = spark.createDataFrame([(v,) for v in values], "value long")
    return rows.select("value", F.unix_micros(epoch_time(F.col("value"))).alias("micros"))


def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in the four formats, each read by its own, and by one that doesn't fit."""
    configure(spark)
    date = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 4
    spelled = {
        "rfc3339": F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"),
        "iso8601": F.date_format(date, "yyyyMMdd'T'HHmmss'Z'"),
        "rfc2822": F.date_format(date, "d MMM yyyy HH:mm:ss Z"),
    }
    text = F.when(k == 0, spelled["rfc3339"]).when(k == 1, spelled["iso8601"]).when(k == 2, spelled["rfc2822"]).otherwise(F.unix_seconds(date).cast("string"))
    json = F.try_parse_json(F.when(k == 3, text).otherwise(F.concat(F.lit('"'), text, F.lit('"'))))
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", json.alias("v"))
    read = {name: F.unix_seconds(parse_datetime(F.col("v"), [name])).alias(f"by_{name}") for name in ("rfc3339", "iso8601", "rfc2822", "timestamp")}
    return rows.select("o_orderkey", *read.values())


def number_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON numbers and strings read as u64 and f64: negatives, fractions, exponents, what is no number."""
    configure(spark)
    n = F.col("event_id").cast("string")
    k = F.col("event_id") % 6
    text = F.when(k == 0, n).when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.concat(n, F.lit(".5"))).when(k == 3, F.concat(F.lit('"'), n, F.lit('e1"')))
    text = text.when(k == 4, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(F.concat(F.lit('"'), n, F.lit('f"')))
    rows = read_table(spark, sf_dir, "events").select("event_id", F.try_parse_json(text).alias("v"))
    return rows.select("event_id", parse_number(F.col("v"), "u64").cast("long").alias("u64"), parse_number(F.col("v"), "f64").alias("f64"), parse_number(F.col("v"), "f64", False).alias("native"))


def exists_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that two of three rows have."""
    df = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"))
    return matches(Searchable(df, (_text("lang", "raw"),)), "lang:*").select("doc_id")


def ip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses 10.x.y.z made from event ids, searched by range."""
    n = F.col("event_id")
    return _addresses(spark, sf_dir, F.concat_ws(".", F.lit("10"), F.floor(n / 65536) % 256, F.floor(n / 256) % 256, n % 256), "ip:[10.0.1.0 TO 10.0.2.255]")


def ip_six_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with addresses of both kinds: fd00::n for odd ids."""
    n = F.col("event_id")
    text = F.when(n % 2 == 1, F.concat(F.lit("fd00::"), F.lower(F.hex(n)))).otherwise(F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(n / 256) % 256, n % 256))
    return _addresses(spark, sf_dir, text, "ip:[fd00::10 TO FD00:0::ff]")


def _addresses(spark: SparkSession, sf_dir: str, text: Column, query: str) -> DataFrame:
    configure(spark)
    ip = Field(("ip",), "ip", {"indexed": True})
    events = read_table(spark, sf_dir, "events").select("event_id", text.alias("ip"))
    events = events.withColumn(address_name(ip), address_bytes(F.col("ip")))
    return matches(Searchable(events, (ip,)), query).select("event_id", "ip")


def kafka_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of Kafka sources, in batch and as a stream, from their URL."""
    rows = [(stream, k, v) for stream in (False, True) for k, v in kafka_options("kafka://one:9092,two:9092/topic", stream).items()]
    return spark.createDataFrame(rows, "stream boolean, name string, setting string")


def names_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names in their parts, escaped again, and durations in milliseconds."""
    rows = [(name, "|".join(split_name(name)), ".".join(map(escape_name, split_name(name)))) for name in ("a", "a.b", r"a\.b", r"a\.b.c", "")]
    rows += [(text, str(milliseconds(text)), None) for text in ("500ms", "30s", "1m 30s", "2h")]
    return spark.createDataFrame(rows, "given string, read string, escaped string")


def tok_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens between white space."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"), "whitespace")).cast("long").alias("n_tokens"))


def tok_en_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of each text. No SQL: tests hold the stemmer against worked examples."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens(F.col("text"), "en_stem"), " ").alias("stems"))


def _bm25(query: str, limit: int, per: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = ranked(_table(spark, sf_dir, "documents"), query).withColumn(SCORE, F.round(SCORE, 4))
        return top(hits, limit, ["doc_id"], per).select("doc_id", SCORE, *([per] if per else []))

    return run


def _bm25_sql(terms: dict[str, float], limit: int, per: str | None = None) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::double as tf{k}" for k, t in enumerate(terms))
    stats = ", ".join(f"count(*) filter (tf{k} > 0) as df{k}" for k in range(len(terms)))
    score = " + ".join(
        f"{boost}::double * ln(1 + (n - df{k} + 0.5::double) / (df{k} + 0.5::double)) * tf{k} * 2.2::double / (tf{k} + 1.2::double * (0.25::double + 0.75::double * dl / mean))"
        for k, boost in enumerate(terms.values())
    )
    some = " or ".join(f"tf{k} > 0" for k in range(len(terms)))
    last = f"order by score desc, doc_id limit {limit}" if per is None else f"qualify row_number() over (partition by {per} order by score desc, doc_id) <= {limit}"
    return f"""
with d as (select doc_id, lang, source, {_sql_tokens()} as w from documents),
c as (select doc_id, lang, source, len(w)::double as dl, {tf} from d),
s as (select count(*)::double as n, sum(dl) / count(*) as mean, {stats} from c)
select doc_id, round({score}, 4) as score{f', {per}' if per else ''} from c, s where {some} {last}
"""


def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit is the feature: the first 25 matches in a total order."""
    return matches(_table(spark, sf_dir, "documents"), "lang:de").orderBy("doc_id").limit(25).select("doc_id")


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of every term, from the postings."""
    found = postings(_table(spark, sf_dir, "documents"), _text("text"), "doc_id")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def postings_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms by the postings path."""
    found = postings(_table(spark, sf_dir, "documents"), _text("text"), "doc_id")
    return postings_search(found, ["the", "of"]).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _filter(table, query, *columns) for name, (table, query, columns, _) in FILTERS.items()},
    "dynamic_path_range": dynamic_path_range,
    "epoch_units": epoch_units,
    "datetime_formats": datetime_formats,
    "bool_parse": bool_parse,
    "number_parse": number_parse,
    "ip_range": ip_range,
    "tok_whitespace": tok_whitespace,
    "tok_en_stem": tok_en_stem,
    "bm25_topk": _bm25("text:the text:of", 10),
    "bm25_boost": _bm25("text:the^2.5 text:der", 50),
    "per_file_topk": _bm25("text:the text:of", 3, "source"),
    **{name: _event_filter(query) for name, (query, _) in EVENT_FILTERS.items()},
    "result_json": result_json_all,
    "index_search": index_search,
    "merge_invariance": merge_invariance,
    "stream_ingest": stream_ingest,
    "index_limits": index_limits,
    "index_rejects": index_rejects,
    "epoch_edges": epoch_edges,
    "time_formats": time_formats,
    "number_kinds": number_kinds,
    "exists_absent": exists_absent,
    "ip_six_range": ip_six_range,
    "kafka_settings": kafka_settings,
    "names_and_durations": names_and_durations,
    "limit_n": limit_n,
    "postings_stats": postings_stats,
    "postings_and": postings_and,
}

ORACLES: dict[str, str] = {
    **{name: f"select {', '.join(columns)} from {table} where {condition}" for name, (table, _, columns, condition) in FILTERS.items()},
    **{name: _events_sql(condition, "event_id::decimal(20,0) as id") for name, (_, condition) in EVENT_FILTERS.items()},
    "result_json": _events_sql("event_type = 'click'"),
    "index_search": _events_sql("event_type = 'click' and user_id < 40"),
    "merge_invariance": _events_sql("event_type = 'click' and user_id < 40", f"{_EVENT_JSON} as json, 3::bigint as files_before, 1::bigint as files_after"),
    "stream_ingest": _events_sql("event_type = 'click' and user_id < 40", f"{_EVENT_JSON} as json, 3::bigint as commits"),
    "index_limits": "select * from (values ('default', 1::bigint), ('none', 0), ('some', 7), ('per_file', 21), ('unranked', 9), ('anew', 0)) t(asked, hits)",
    "index_rejects": "select event_id as id, ['broken', 'id', 'at', 'from'][(event_id % 5 + 1)::int] as fault from events where event_id % 5 < 4",
    "epoch_edges": f"""
with ends as (select unnest([{', '.join(f'{EPOCH[0]} * {u}::bigint, {EPOCH[1]} * {u}::bigint + {u - 1}' for u in (1, 1000, 1000000))}, {EPOCH[0]} * 1000000000::bigint]) as v),
rows as (select distinct v + d as value from ends, (select unnest([-1, 0, 1]) as d) union select unnest([9223372036854775806, 9223372036854775807, 0, -5]))
select value::bigint as value, (case when value between {EPOCH[0]} and {EPOCH[1]} then value * 1000000
  when value between {EPOCH[0]} * 1000::bigint and {EPOCH[1]} * 1000::bigint + 999 then value * 1000
  when value between {EPOCH[0]} * 1000000::bigint and {EPOCH[1]} * 1000000::bigint + 999999 then value
  when value >= {EPOCH[0]} * 1000000000::bigint then value // 1000 end)::bigint as micros from rows""",
    "time_formats": """
select o_orderkey, case when o_orderkey % 4 = 0 then s end as by_rfc3339, case when o_orderkey % 4 in (0, 1) then s end as by_iso8601,
  case when o_orderkey % 4 = 2 then s end as by_rfc2822, case when o_orderkey % 4 = 3 and s between 72057595 and 8589934591 then s end as by_timestamp
from (select o_orderkey, epoch_us(o_orderdate) // 1000000 as s from orders)""",
    "number_kinds": """
select event_id, case when event_id % 6 in (0, 4) or (event_id % 6 = 1 and event_id = 0) then event_id end as u64,
  case event_id % 6 when 0 then event_id when 1 then -event_id when 2 then event_id + 0.5 when 3 then event_id * 10 when 4 then event_id end::double as f64,
  case event_id % 6 when 0 then event_id when 1 then -event_id when 2 then event_id + 0.5 end::double as native from events""",
    "exists_absent": "select doc_id from documents where doc_id % 3 > 0",
    "ip_six_range": "select event_id, 'fd00::' || lower(to_hex(event_id)) as ip from events where event_id % 2 = 1 and event_id between 16 and 255",
    "kafka_settings": """select * from (values (false, 'kafka.bootstrap.servers', 'one:9092,two:9092'), (false, 'subscribe', 'topic'), (false, 'startingOffsets', 'earliest'), (false, 'endingOffsets', 'latest'),
  (true, 'kafka.bootstrap.servers', 'one:9092,two:9092'), (true, 'subscribe', 'topic'), (true, 'startingOffsets', 'earliest')) t(stream, name, setting)""",
    "names_and_durations": r"""select * from (values ('a', 'a', 'a'), ('a.b', 'a|b', 'a.b'), ('a\.b', 'a.b', 'a\.b'), ('a\.b.c', 'a.b|c', 'a\.b.c'), ('', '', ''),
  ('500ms', '500', null), ('30s', '30000', null), ('1m 30s', '90000', null), ('2h', '7200000', null)) t(given, read, escaped)""",
    "dynamic_path_range": "select event_id from events where try_cast(json_extract(props, '$.k') as double) between 60 and 64",
    "epoch_units": """select event_id, case event_id % 3 when 0 then epoch_us(ts) // 1000000 * 1000000 when 1 then epoch_us(ts) // 1000 * 1000 else epoch_us(ts) end as micros from events""",
    "datetime_formats": "select o_orderkey, epoch_us(o_orderdate) // 1000000 as seconds from orders",
    "bool_parse": "select doc_id, case doc_id % 4 when 0 then true when 1 then false end as value from labels",
    "number_parse": "select event_id, case event_id % 4 when 0 then event_id when 3 then -event_id end as value from events",
    "ip_range": "select event_id, '10.' || (event_id // 65536) % 256 || '.' || (event_id // 256) % 256 || '.' || event_id % 256 as ip from events where event_id % 16777216 between 256 and 767",
    "tok_whitespace": r"select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::bigint as n_tokens from documents",
    "bm25_topk": _bm25_sql({"the": 1.0, "of": 1.0}, 10),
    "bm25_boost": _bm25_sql({"the": 2.5, "der": 1.0}, 50),
    "per_file_topk": _bm25_sql({"the": 1.0, "of": 1.0}, 3, "source"),
    "limit_n": "select doc_id from documents where lang = 'de' order by doc_id limit 25",
    "postings_stats": f"select term, count(distinct doc_id) as df, count(*) as tf from (select doc_id, unnest({_sql_tokens()}) as term from documents) group by term",
    "postings_and": f"select doc_id from documents where {_has('the')} and {_has('of')}",
}
