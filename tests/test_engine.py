import ipaddress
import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brindle.config import ConfigError, escape_name, load, split_name
from brindle.functions.parse import ERRORS, address_bytes, parse_documents
from brindle.functions.stem import stem
from brindle.functions.tokenize import literal_tokens, token_lists, tokens
from brindle.operators.catalog import BadLineError, Catalog, CatalogError
from brindle.operators.search import matches, ranked
from brindle.plans.bind import Searchable, phrase
from brindle.plans.grammar import QuerySyntaxError, parse_query
from brindle.queries import QUERIES as REGISTERED
from brindle.sources.connect import SourceError, connect, kafka_options, kafka_url, stdin_batches
from brindle.streaming.ingest import ingest, milliseconds

PARCELS = """
version: 1
name: parcels
path: unused
schema:
  fields:
    - name: grams
      type: !number {type: i64}
    - name: route
      type: !static_object
        fields:
          - {name: hub, type: !text }
          - {name: legs, array: true, type: !number {type: u64}}
    - name: scanned
      type: !datetime {formats: [timestamp, rfc3339]}
    - name: fragile
      type: !boolean
    - name: extras
      type: !dynamic_object {expand_dots: true}
"""
ROWS = [
    {"grams": 1200, "scanned": 1700000000, "fragile": True, "route": {"hub": "Oslo north", "legs": [3, 8]}, "extras": {"box": {"side": "left wall"}}, "note": "handle with care, glass"},
    {"grams": 350, "scanned": "2024-02-03T04:05:06.5Z", "fragile": False, "route": {"hub": "Bergen"}, "extras": {"box": {"side": "lid"}}, "note": "with love"},
    {"grams": 80, "route": {"hub": "north sea oslo", "legs": []}, "tags": [{"by": "Ada", "on": "2024-01-15T00:00:00Z"}, {"by": ["Bo", 7]}], "note": "care: none"},
]


def one(kind, options="", array=""):
    return f"name: t\npath: p\nschema:\n  fields:\n    - name: x\n      {array}\n      type: !{kind} {options}\n"


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/catalog")


def found(catalog, name, query, limit=10):
    return sorted(r.json for r in catalog.search(name, query, limit).collect())


QUERIES = {
    "grams:>100 AND fragile:true": [1200],
    "note:care": [80, 1200],
    "grams:[80 TO 350}": [80],
    "extras.box.side:wall": [1200],
    'extras.box.side:"left wall"': [1200],
    "route.hub:north -note:glass": [80],
    'route.hub:"oslo north"': [1200],
    'route.hub:"north oslo"~1': [80],
    'route.hub:"north se"*': [80],
    "route.legs:8": [1200],
    "scanned:>=2024-01-01": [350],
    "nowhere:x": [],
    "nowhere:*": [],
    "tags:*": [80],
    "tags.by:ada": [80],
    "tags.by:7": [80],
    "tags.on:[2024-01-01T00:00:00Z TO 2024-02-01T00:00:00Z]": [80],
    "tags.on:<2024-01-01T00:00:00Z": [],
    "route.hub:(oslo OR bergen) AND NOT grams:80": [350, 1200],
    "bergen": [350],
    "glass": [1200],
    "ada": [80],
    "care": [80, 1200],
    "by": [],
    "grams: IN [350 351]": [350],
}


def test_parcels_end_to_end_and_merge(spark, catalog):
    catalog.create(PARCELS)
    with pytest.raises(CatalogError):
        catalog.create(PARCELS)
    assert found(catalog, "parcels", "*") == []
    for row in ROWS:
        assert catalog.index("parcels", lines(spark, [row]))
    first = '{"extras":{"box":{"side":"left wall"}},"fragile":true,"grams":1200,"note":"handle with care, glass","route":{"hub":"Oslo north","legs":[3,8]},"scanned":"2023-11-14T22:13:20Z"}'

    def grams(query, **options):
        return sorted(json.loads(r.json)["grams"] for r in catalog.search("parcels", query, 10, **options).collect())

    assert found(catalog, "parcels", "grams:>100 AND fragile:true") == [first]
    assert {q: grams(q) for q in QUERIES} == QUERIES
    assert len(found(catalog, "parcels", "*", 1)) == 1 and found(catalog, "parcels", "*", 0) == []
    old = catalog.files("parcels")
    under_way = catalog.search("parcels", "note:care", 10)
    assert len(old) == 3 and catalog.merge("parcels") and len(catalog.files("parcels")) == 1
    assert under_way.count() == 2 and catalog.vacuum("parcels") == []
    assert {q: grams(q) for q in QUERIES} == QUERIES == {q: grams(q, by_postings=False) for q in QUERIES}
    assert sorted(catalog.vacuum("parcels", 0)) == sorted(old) and catalog.merge("parcels") is None
    assert grams("note:care") == [80, 1200]
    catalog.drop("parcels")
    with pytest.raises(CatalogError):
        catalog.search("parcels", "*")


def test_postings_give_what_all_documents_give(spark, catalog):
    rng = random.Random(5)
    catalog.create(one("text"))
    for _ in range(2):
        catalog.index("t", lines(spark, [{"x": " ".join(rng.choices("abcdef", [30, 20, 10, 5, 2, 1], k=rng.randint(1, 12))), "n": n} for n in range(40)]))
    table = catalog.table("t")
    for query in ("x:f", "x:e x:f", 'x:"b a"', 'x:"a b c"~2', "x:d AND NOT x:a", "+x:c x:f^3", "(x:e OR x:f) AND x:b"):
        narrow, known = catalog.candidates("t", table, query)
        assert known and known.documents == 80 and narrow.df.count() <= 80
        a, b = ([r.json for r in catalog.search("t", query, 7, by_postings=way).collect()] for way in (True, False))
        assert a == b
        assert sorted(r.json for r in catalog.search("t", query, 99, ranking=False).collect()) == sorted(r.json for r in catalog.search("t", query, 99, by_postings=False).collect())
    for query in ("*", "x:*", "x:[a TO b]", "x:a n:3", 'x:"a b"*', "NOT x:a"):
        assert catalog.candidates("t", table, query) == (table, None)


def test_phrases_against_all_places(spark):
    rng = random.Random(11)
    texts = [rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, w array<string>").cache()

    def fits(words, wanted, slop):
        places = [tuple(p) for p in combinations(range(len(words)), len(wanted)) if [words[k] for k in p] == list(wanted)]
        return any(p[-1] - p[0] - (len(wanted) - 1) <= slop for p in places)

    for wanted in ("ab", "aa", "abc", "aba", "abcd", "aabb"):
        for slop in (0, 1, 3):
            got = {r.n for r in df.where(phrase(F.col("w"), list(wanted), slop)).collect()}
            assert got == {n for n, t in enumerate(texts) if fits(t, wanted, slop)}, (wanted, slop)


@pytest.mark.parametrize(
    ("kind", "options", "array", "rows", "query", "want"),
    [
        ("number", "{type: u64}", "array: true", [{"x": [70, 7]}, {"x": [17]}, {"x": []}], "x:7", ['{"x":[70,7]}']),
        ("boolean", "", "", [{"x": False}, {"x": " TRUE"}, {"x": True}], "x:true", ['{"x":true}', '{"x":true}']),
        ("ip", "", "", [{"x": "10.1.2.3"}, {"x": "fe80::a:1"}, {"x": "10.1.9.9"}, {"x": "11.0.0.0"}], "x:{10.1.2.3 TO 10.255.255.255]", ['{"x":"10.1.9.9"}']),
        ("ip", "", "", [{"x": "10.1.2.3"}, {"x": "fe80::a:1"}, {"x": "FE80:0::b:0"}], "x:>fe80::a:1", ['{"x":"FE80:0::b:0"}']),
        ("number", "{type: i64}", "", [{"x": "-7"}, {"x": "+12"}, {"x": 0}], "x:<=0", ['{"x":-7}', '{"x":0}']),
        ("text", "{indexed: {tokenizer: en_stem}}", "", [{"x": "the ponies ran"}, {"x": "a dog"}], "x:pony", ['{"x":"the ponies ran"}']),
        ("text", "{indexed: {tokenizer: raw}}", "", [{"x": "A b"}, {"x": "A"}], 'x:"A b"', ['{"x":"A b"}']),
        ("text", "", "", [{"x": "a b q c"}, {"x": "a c b"}], 'x:"a b c"~1', ['{"x":"a b q c"}']),
        ("text", "", "", [{"x": "big bad wolf"}, {"x": "bad big wool"}], 'x:"bad wo"*', ['{"x":"big bad wolf"}']),
    ],
)
def test_types(spark, catalog, kind, options, array, rows, query, want):
    catalog.create(one(kind, options, array))
    catalog.index("t", lines(spark, rows))
    assert found(catalog, "t", query) == want


@pytest.mark.parametrize(
    ("kind", "options", "good", "bad"),
    [
        ("number", "{type: i64}", ["+100", -5, 2**63 - 1], [" 100", "1e2", "1.5", 1.5, "", True, [1], 2**63]),
        ("number", "{type: u64}", [2**64 - 1, "7"], [-1, "-1", 2**64]),
        ("number", "{type: f64}", ["25.52", "1e2", 5, "+.5"], ["1d", " 1", "x"]),
        ("number", "{type: i64, parse_string: false}", [3], ["3"]),
        ("boolean", "", [" true ", "FaLsE", True], ["t", "1", "yes", 1]),
        ("datetime", "", ["2024-02-03T04:05:06Z", "2024-02-03T04:05:06.123456789+02:00", 1700000000, 1700000000000], ["2024", "2024-02-03", 12, "1700000000", 1.5]),
        ("datetime", "{formats: [rfc2822]}", ["Sat, 03 Feb 2024 04:05:06 +0000", "3 Feb 2024 04:05:06 +0000"], ["2024-02-03T04:05:06Z", None]),
        ("ip", "", ["1.2.3.4", "::1"], ["1.2.3", "x", 5, None]),
    ],
)
def test_values(spark, kind, options, good, bad):
    config, _ = load(one(kind, options))
    rows = parse_documents(lines(spark, [{"x": v} for v in [*good, *bad]]), config).collect()
    assert [bool(r[ERRORS]) for r in rows] == [False] * len(good) + [True] * len(bad)
    assert all(r["x"] is not None for r in rows[: len(good)])


def test_bad_lines(spark, catalog):
    catalog.create(one("text"))
    with pytest.raises(BadLineError):
        catalog.index("t", lines(spark, ['{"x":"a"}', "[1]"]))
    assert catalog.files("t") == []
    assert catalog.index("t", lines(spark, ['{"x":"a"}', "[1]", ""]), on_bad_json="skip")
    assert found(catalog, "t", "*") == ['{"x":"a"}']
    assert catalog.rejects("t", lines(spark, ["", '{"x":"b"}'])).count() == 1
    assert catalog.index("t", lines(spark, [])) is None


def test_stream_commits_once(spark, catalog, tmp_path):
    catalog.create(PARCELS)
    folder = tmp_path / "in"
    folder.mkdir()
    for n, row in enumerate(ROWS):
        (folder / f"{n}.json").write_text(json.dumps(row) + "\n")
    for _ in range(2):
        ingest(catalog, "parcels", connect(spark, str(folder), True, 1), None).awaitTermination()
        assert len(catalog.files("parcels")) == 3
    (folder / "3.json").write_text(json.dumps(ROWS[0]) + "\n")
    ingest(catalog, "parcels", connect(spark, str(folder), True, 1), None).awaitTermination()
    assert len(found(catalog, "parcels", "*")) == 4
    assert catalog.index("parcels", lines(spark, ROWS), batch=("stream", 1)) is None


def test_helpers(spark):
    assert split_name(r"a\.b.c") == ["a.b", "c"] and escape_name("a.b") == r"a\.b"
    assert kafka_url("kafka://h:1,i:2/t/u") == ("h:1,i:2", "t/u")
    assert "endingOffsets" in kafka_options("kafka://h/t", False) and "endingOffsets" not in kafka_options("kafka://h/t", True)
    with pytest.raises(SourceError):
        kafka_url("kafka://h")
    assert milliseconds("1m 30s") == 90_000 and milliseconds("500ms") == 500
    assert [d.count() for d in stdin_batches(spark, iter(["a\n", "b\n", "c"]), 2)] == [2, 1]
    for query in ("(a", "a)", "x:[1 2]", "a AND", "x:", "a^b", 'x: IN a', '"a"~'):
        with pytest.raises(QuerySyntaxError):
            parse_query(query)
    with pytest.raises(ConfigError):
        load(one("static_object", "{fields: []}", "array: true"))


def test_addresses_against_plain_parsing(spark):
    def plain(text):
        try:
            found = None if text is None or "%" in text else ipaddress.ip_address(text)
        except ValueError:
            return None
        return found and (found.packed if found.version == 6 else b"\0" * 10 + b"\xff\xff" + found.packed)

    rng = random.Random(3)
    texts = [None, "", "::", "1::2::3", ":::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", "1.2.3.4\n", "::1\n", "::1.2.3.4\n", "1.2.3.04", "fe80::1%eth0", "::g"]
    for _ in range(500):
        texts.append("".join(rng.choices(["1", "ab", ":", "::", ".", "0", "255", "FfFf", "1.2.3.4", "12"], k=rng.randint(1, 9))))
        texts.append(":".join(rng.choices(["1", "ab", "", "0", "ffff", "1.2.3.4"], [5, 5, 1, 5, 5, 0.5], k=rng.randint(5, 9))))
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & ~(0xFFFF << 16 * rng.randint(0, 7)))))
        texts.append(".".join(str(rng.randint(0, 300)) for _ in range(rng.choice([3, 4, 4, 4, 5]))))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", address_bytes(F.col("t")).alias("b")).collect()
    assert [r.t for r in rows if (None if r.b is None else bytes(r.b)) != plain(r.t)] == []
    assert sum(r.b is not None for r in rows) > 500


def test_options_of_terms(spark, catalog):
    catalog.create("""
name: t
path: p
schema:
  fields:
    - {name: all, type: !text {indexed: {record: position}}}
    - {name: often, type: !text {indexed: {record: freq}}}
    - {name: once, type: !text {indexed: {record: basic, fieldnorms: false}}}
""")
    texts = ["b", "b a", "b b b b c d"]
    catalog.index("t", lines(spark, [{"all": t, "often": t, "once": t} for t in texts]))
    assert [json.loads(r.json)["all"] for r in catalog.search("t", "often:b", 9).collect()] == ["b b b b c d", "b", "b a"]
    table = catalog.table("t")
    assert len({round(r.score, 9) for r in ranked(table, "once:b").collect()}) == 1
    assert len({round(r.score, 9) for r in ranked(table, "often:b").collect()}) == 3
    assert len(found(catalog, "t", 'all:"b a"')) == 1
    for field in ("often", "once"):
        with pytest.raises(QuerySyntaxError):
            found(catalog, "t", f'{field}:"b a"')
    for options in ("{indexed: {record: some}}", "{indexed: {tokeniser: raw}}", "{indexed: {fieldnorms: 1}}"):
        with pytest.raises(ConfigError):
            load(one("text", options))
    with pytest.raises(ConfigError):
        load(one("dynamic_object", "{indexed: {fieldnorms: true}}"))


def test_equal_keys_of_an_object(spark, catalog):
    catalog.create(one("text"))
    catalog.index("t", lines(spark, ['{"x":"a","more":{"k":1,"k":[2],"j":0},"x":"b"}']))
    assert found(catalog, "t", "more.k:2 AND x:b") == ['{"more":{"j":0,"k":[2]},"x":"b"}']


#: Pairs of the sample vocabulary that the stemmer's author publishes with the algorithm.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist
consolation consol consolations consol consolatory consolatori console consol consolidate consolid consolidating consolid consoling consol consolingly consol
consonant conson consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspire conspir conspiring conspir
constable constabl constance constanc constancy constanc knackeries knackeri knave knave knaves knave knavish knavish kneaded knead kneel kneel knees knee
knew knew knightly knight knitted knit knitting knit knives knive knocker knocker knockers knocker knotted knot
"""


def test_stems_of_the_vocabulary():
    words = STEMS.split()
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2])) and len(words) > 70


def test_stem_query_stems_every_token(spark):
    sf = "/root/testdata/sf0.001"
    plain = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in REGISTERED["tok_en_stem"](spark, sf).collect():
        assert row.stems is plain[row.doc_id] is None or row.stems.split() == literal_tokens(plain[row.doc_id], "en_stem")


@pytest.mark.parametrize("name", ["dynamic_array_path", "undeclared_number", "dynamic_date", "dynamic_default", "dynamic_exists", "boolean_field", "result_json", "index_rejects"])
def test_a_line_is_parsed_once(spark, name):
    plan = REGISTERED[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_events_are_dealt_over_all_cores(spark):
    assert REGISTERED["boolean_field"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_stems_in_lists(spark):
    texts = [["users reporting", None, ""], None, [], [None], ["ponies", "Users"]]
    df = spark.createDataFrame([(n, t, None if not t else t[0]) for n, t in enumerate(texts)], "n int, t array<string>, x string").coalesce(1)
    rows = df.select("n", token_lists(F.col("t"), "en_stem").alias("l"), tokens(F.col("x"), "en_stem").alias("w")).orderBy("n").collect()
    assert [r.l for r in rows] == [[["user", "report"], None, []], None, [], [None], [["poni"], ["user"]]]
    assert [r.w for r in rows] == [["user", "report"], None, None, None, ["poni"]]


def test_paths_begin_with_a_key_of_the_object(spark, catalog):
    catalog.create("name: t\npath: p\nschema:\n  fields:\n    - {name: d, type: !dynamic_object {expand_dots: true}}\n")
    catalog.index("t", lines(spark, [{"d": {"a.b": "yes"}, "n": 1}, {"d": {"a": [{"b": "yes"}]}, "n": 2}, {"d": {"a": {"b": None}}, "n": 3}, {"d": {"b": "yes"}, "n": 4}, {"n": 5}]))
    for query in ("d.a.b:yes", "d.a.b:*"):
        assert sorted(json.loads(j)["n"] for j in found(catalog, "t", query)) == [1, 2]


def test_postings_come_in_order_by_one_shuffle(spark, catalog, monkeypatch):
    from brindle.operators import catalog as module

    monkeypatch.setattr(module, "POSTINGS_PER_FILE", 3)
    config = catalog.create(one("text"))
    file_id = catalog.index(config.name, lines(spark, [{"x": f"b a b c{n} b"} for n in range(4)]))
    found = spark.read.parquet(catalog._postings(config.name, file_id))
    assert found.columns == ["field", "term", "_doc", "tf", "positions"]
    rows = found.collect()
    assert sorted((r.term, r.tf, tuple(r.positions)) for r in rows) == sorted([("a", 1, (1,)), ("b", 3, (0, 2, 4))] * 4 + [(f"c{n}", 1, (3,)) for n in range(4)])
    # Each file is in order, a document's places of a term are in one of them, and the session's setting is as before.
    by_file = found.select("term", "_doc", F.input_file_name().alias("file")).collect()
    for file in {r.file for r in by_file}:
        keys = [(r.term, r._doc) for r in by_file if r.file == file]
        assert keys == sorted(keys)
    assert len({r.file for r in by_file}) > 1 and spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"


def test_a_merge_takes_no_shuffle_of_documents(spark, catalog, monkeypatch):
    from brindle.operators import catalog as module

    config = catalog.create(one("text"))
    for n in range(3):
        catalog.index(config.name, lines(spark, [{"x": f"w{n} v{k}"} for k in range(8)]))
    monkeypatch.setattr(module, "ROWS_PER_TASK", 6)
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda *_: pytest.fail("dealt anew"))
    merged = spark.read.parquet(catalog._data(config.name, catalog.merge(config.name)))
    assert merged.count() == 24 and merged.select("_doc").distinct().count() == 24
    # One file for each six documents, none of which a core has to write alone.
    assert merged.select(F.input_file_name()).distinct().count() == 4
    assert catalog.search(config.name, "w1", 100).count() == 8


def test_dynamic_objects_are_written_whole(spark, catalog):
    import pathlib

    import pyarrow.parquet as pq

    config = catalog.create(one("dynamic_object"))
    file_id = catalog.index(config.name, lines(spark, [{"x": {"a": n}, "more": "m"} for n in range(50)]))
    for file in pathlib.Path(catalog._data(config.name, file_id).removeprefix("file:").replace("//", "/", 1)).glob("*.parquet"):
        assert not any("typed_value" in c.path for c in pq.ParquetFile(file).schema)


@pytest.mark.parametrize(("query", "want"), [("x.a:report", {0, 1, 3}), ("x.a: IN [report news]", {0, 1, 2, 3}), ("x.a:7", {4, 5}), ("x.a:true", {6, 7})])
@pytest.mark.parametrize("tokenizer", ["default", "en_stem"])
def test_words_in_dynamic_objects(spark, catalog, query, want, tokenizer):
    config = catalog.create(one("dynamic_object", f"{{indexed: {{tokenizer: {tokenizer}}}}}"))
    held = ["a report", ["x", "Report"], "news", [None, {"b": 1}, "report 8"], 7, "seven 7", True, "true", None, {"b": "report"}]
    catalog.index(config.name, lines(spark, [{"x": {"a": v}, "n": n} for n, v in enumerate(held)]))
    assert {json.loads(r.json)["n"] for r in catalog.search(config.name, query, 100).collect()} == want


def test_words_alone_are_sought_in_strings_alone(spark):
    from brindle.config import Field
    from brindle.plans.bind import Searchable, predicate

    field = Field(("x",), "dynamic_object", {"indexed": {"tokenizer": "en_stem"}})
    tree = str(predicate(Searchable(spark.range(1), (field,)), parse_query("x.a:reporter")))
    assert "zip_with" not in tree and "to_timestamp" not in tree


def test_kinds_of_containers_and_faults(spark):
    config, _ = load("name: t\npath: p\nschema:\n  fields:\n    - {name: a, array: true, type: !number {type: i64}}\n    - {name: o, type: !dynamic_object }\n    - {name: b, type: !boolean }\n    - {name: n, type: !number {type: u64}}\n")
    cases = [
        ({"a": [1, "2"], "o": {"k": 1}, "b": "\t TRUE\n", "n": 2**64 - 1}, []),
        ({"a": None, "o": None, "b": None, "n": None}, []),
        ({"a": {"k": 1}, "o": [1], "b": "true x", "n": -1}, ["a", "o", "b", "n"]),
        ({"a": [1, None], "o": "s", "b": "\u00a0true", "n": 2**64}, ["a", "o", "b", "n"]),
        ({"a": [[1]], "o": 1, "b": {"k": True}, "n": [1]}, ["a", "o", "b", "n"]),
        ({}, []),
        ("[1]", ["json"]),
    ]
    got = parse_documents(lines(spark, [row for row, _ in cases]).coalesce(1), config)
    assert [r[ERRORS] for r in got.collect()] == [faults for _, faults in cases]
    # No kind of an array or object is spelled out, and a line without a fault makes no array of faults.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(_map") <= 2


def test_rows_are_dealt_where_splits_have_no_row_group(spark, tmp_path):
    from brindle.session import setting
    from brindle.sources.tables import dealt

    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("*.parquet"))
    # Of ten splits one has the only row group.
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(file.stat().st_size // 10)):
        df = spark.read.parquet(str(file))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = dealt(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in sizes) == 4000


def test_a_filter_finds_a_number_s_kind_seldom(spark):
    plan = REGISTERED["static_object_number"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "schemaOfVariant" in line]
    assert len(filters) == 1 and filters[0].count("schemaOfVariant(") <= 4


def test_spelled_numbers(spark):
    config, _ = load("name: t\npath: p\nschema:\n  fields:\n    - {name: i, type: !number {type: i64}}\n    - {name: f, type: !number {type: f64}}\n    - {name: s, type: !number {type: i64, parse_string: false}}\n")
    cases = [("12", 12, 12.0), ("+7\n", 7, 7.0), ("1\n2", None, None), (" 3", None, None), ("", None, None), ("2e1", None, 20.0), ("9223372036854775808", None, 2.0**63), (5, 5, 5.0), (None, None, None)]
    got = parse_documents(lines(spark, [{"i": v, "f": v, "s": v} for v, _, _ in cases]).coalesce(1), config).collect()
    assert [(r.i, r.f, r.s) for r in got] == [(i, f, v if isinstance(v, int) else None) for v, i, f in cases]
    assert matches(Searchable.of(parse_documents(lines(spark, [{"i": 1}, {"i": "x"}, {}]), config), config), "NOT i:<1 AND *").count() == 3
