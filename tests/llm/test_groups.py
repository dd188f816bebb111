"""Mixing, quality rules, decontamination, near duplicates and the pipeline: against SQL, brute force and edge rows."""

import re
from itertools import combinations

import duckdb
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from brindle.llm import decontaminate, mixing, quality_rules, similar, simhash
from brindle.llm.queries import ORACLES, QUERIES
from brindle.sources.tables import read_table

SF = "/root/testdata/sf0.001"
#: Names that operators could use for themselves.
CLASHES = "fp size row b id _id _rows component _row _found _contamination contamination th u target words rank may_go salt figures bits band root least".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = " ".join(f"word{n}" for n in range(20_000))
EDGE = [None, "", " \n\t", "x" * 100_000, LONG, LONG + " more", "same text here", "same text here", "a b " * 9_000]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(n if n else None, t, None, None if n % 2 else "s", None, *[f"kept {c}" for c in CLASHES]) for n, t in enumerate(EDGE)]
    return spark.createDataFrame(rows + rows[6:7], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_components(ids, linked):
    """Smallest id reachable, by asking all pairs."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("name", ["op2_mixing", "op3_quality_rules", "op6_decontamination", "op7_chat_format"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_simhash_against_all_pairs(spark, docs):
    def plain(text):
        words = plain_words(text)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << n for n in range(64) if 2 * sum(h >> n & 1 for h in hashes) > len(hashes))

    fps = {r.doc_id: plain(r.text) for r in docs.select("doc_id", "text").collect()}
    root = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_large_shards_lose_no_link(spark):
    values = sorted({0} | {1 << a | 1 << b for a in range(0, 60, 7) for b in range(0, 60, 5)})
    found = spark.createDataFrame([(v,) for v in values], "fp long")
    root = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    for most in (1, 4000):
        got = {r.node: r.root for r in simhash.components(simhash.links(found, most)).collect()}
        assert {v: got.get(v, v) for v in values} == root


def shingles(text):
    words = plain_words(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("tree_most", [2, similar.TREE_MOST])
def test_similar_against_all_pairs(spark, docs, tree_most):
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    # A chain: each link is similar to the next, the ends are not; and pairs just above and below the threshold.
    base = [f"w{n}" for n in range(104)]
    extra = {10_000 + k: " ".join(base[:5] + [f"e{k}-{n}" if n < 0 else w for n, w in enumerate(base[5:])][6 * k :]) for k in range(6)}
    extra |= {20_000: " ".join(f"v{n}" for n in range(104)), 20_001: " ".join(f"v{n}" for n in range(80)), 20_002: " ".join(f"v{n}" for n in range(76))}
    sets |= {i: shingles(t) for i, t in extra.items()}
    more = spark.createDataFrame(list(extra.items()), "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    root = plain_components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    got = {r.id: r.component_id for r in similar.classes(both, tree_most=tree_most).collect()}
    assert got == root
    if tree_most > 2:
        assert sorted(r.doc_id for r in similar.keep_one_similar(both).collect()) == sorted(set(root.values()))


def test_fingerprint_is_of_the_set():
    rest = " ".join(f"w{n}" for n in range(800))
    once, often = (f"a b c d e {'a b c d e ' * times}{rest}".encode() for times in (1, 40))
    changed = often.replace(b" w799", b" other")
    (fp, bits, *_), (same_fp, same_bits, *_), (_, near, *_) = map(similar.sketch, (once, often, changed))
    assert (fp, bits) == (same_fp, same_bits)
    assert (bits ^ near).bit_count() <= similar.RADIUS


def test_edge_rows(spark, edge):
    kept = quality_rules.keep_good(edge).collect()
    assert all(r.text and len(r.text.split()) >= 10 for r in kept) and kept
    assert quality_rules.measure(edge).count() == 10
    mixed = mixing.mix(mixing.weigh(edge)).collect()
    assert len(mixed) == 10 and all(r.copies == 0 for r in mixed if r.size == 0) and all(r.copies <= 2 for r in mixed)
    assert simhash.classes(edge).count() == 10
    for one in (simhash.keep_one(edge), similar.keep_one_similar(edge)):
        rows = one.collect()
        assert one.columns == edge.columns and len({r.text for r in rows}) == len(rows)
        assert all(r[c] == f"kept {c}" for r in rows for c in CLASHES)
    assert len(rows) == 5  # no words, x, the two long ones, same, a b
    bench = spark.createDataFrame([(1, "same  TEXT"), (2, None), (None, ""), (3, "same text")], "item_id long, text string")
    for out in (decontaminate.drop_contaminated(edge, bench), decontaminate.remove_spans(edge, bench), mixing.mixed(edge).drop("mix_copies", "mix_words")):
        assert out.columns == edge.columns and all(r[c] == f"kept {c}" for r in out.collect() for c in CLASHES)
    found = decontaminate.find(edge, bench).collect()
    assert sorted(r.found["items"] for r in found if r.found["starts"]) == [["1", "3"]] * 3
    assert decontaminate.drop_contaminated(edge, bench).count() == 7
    assert sorted(r.text for r in decontaminate.remove_spans(edge, bench).collect() if r.text and r.text.endswith("here")) == [" here"] * 3


def test_blocks_of_the_benchmark_agree(spark, docs):
    bench = read_table(spark, SF, "benchmark")
    pick = lambda most: sorted((r.doc_id, repr(r.found)) for r in decontaminate.find(docs, bench, block_bytes=most).collect())
    assert pick(2_000) == pick(decontaminate.BLOCK_BYTES)


def test_cascade_order_is_the_same_on_each_run(docs):
    rules = quality_rules.BASE_RULES + quality_rules.MORE_RULES
    runs = [quality_rules.profile(some, rules) for some in (docs, docs, docs.repartition(5))]
    assert all(r.rejected == s.rejected and r.cost == pytest.approx(s.cost) for run in runs for r, s in zip(runs[0], run))
    assert len({quality_rules.ordered(run) for run in runs}) == 1 and quality_rules.ordered(runs[0])[0].name == "few_words"
    assert any(0 < p.rejected < 1 for p in runs[0])


def test_windows_end_with_words():
    windows = decontaminate.Windows.made([("a", b"one two"), ("b", b"two threes"), (None, b"six"), ("c", b"One, two!")])
    group = decontaminate.Words([b"One two, three", b"x two threes", b"six\xc3\xa9 SIX one", b"two", None, b"y" * (1 << 21) + b" six"])
    assert group.counts == [3, 3, 3, 1, 0, 2]
    hits = windows.scan(group)
    assert hits == [([[0, 2]], {"a", "c"}), ([[1, 3]], {"b"}), ([[1, 2]], set()), ([], set()), ([], set()), ([[1, 2]], set())]


def test_own_weight_multiplies_the_odds(spark):
    rows = [(n, "w " * 20, "s", 50.0 if n % 4 == 0 else 1.0) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, worth double")
    weighed = mixing.weigh(docs, own_weight="worth")
    table = spark.createDataFrame([("s", 200, 4000, 1000.0)], "source string, rows long, words long, target double")
    got = {r.id: r.copies for r in mixing.mix(weighed, table).collect()}
    order = sorted(weighed.collect(), key=lambda r: r.u / (1 - r.u) / r.own)
    assert {i for i, n in got.items() if n} == {r.id for r in order[:50]}
    assert sum(n for i, n in got.items() if i % 4 == 0) > 40


def test_equal_rows_enter_together(spark):
    rows = [(1, "a b c", "s")] * 5 + [(n, "x y", "s") for n in range(2, 40)]
    weighed = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    table = spark.createDataFrame([("s", 43, 91, 40.0)], "source string, rows long, words long, target double")
    got = mixing.mix(weighed, table).collect()
    assert len({r.copies for r in got if r.id == 1}) == 1
    assert abs(sum(r.copies * r.size for r in got) - 40) <= 1


def test_cascade_order_keeps_the_verdict(docs):
    rules = quality_rules.BASE_RULES + quality_rules.MORE_RULES
    ids = lambda r: sorted(x.doc_id for x in quality_rules.keep_good(docs, rules=r).collect())
    assert ids(rules) == ids(rules[::-1])


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert simhash.classes(none).count() == 0


def test_pipeline_against_plain(spark, docs):
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    good = stages["quality_rules"](spark, docs, SF).cache()
    verdict = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, kept in verdict.items() if kept)

    sets = {r.doc_id: shingles(r.text) for r in good.collect()}
    root = plain_components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    one = stages["near_duplicates"](spark, good, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(root.values()))

    hit = {r.doc_id for r in QUERIES["op6_decontamination"](spark, SF).collect() if r.contaminated}
    clean = stages["decontamination"](spark, one, SF).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in one.collect()} - hit)

    masked = stages["personal_data"](spark, clean, SF).cache()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert masked.columns == columns and masked.count() == clean.count()
    assert all(r.n_chars == len(r.text) and not email.search(r.text) for r in masked.collect())

    last = stages["mixture"](spark, masked, SF).collect()
    words = {r.doc_id: len(plain_words(r.text)) for r in masked.collect()}
    assert all(r.mix_copies in (1, 2) and r.mix_words == words[r.doc_id] for r in last)
    took, due = sum(r.mix_copies * r.mix_words for r in last), 1.5 * sum(words.values())
    assert abs(took - due) <= 4 * max(words.values())
    assert sorted((r.doc_id, r.mix_copies) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.mix_copies) for r in last)


def test_mix_goes_on_past_misfits(spark):
    sizes = {"long": [400] * 50 + [20_000], "mixed": [n * n % 997 + 1 for n in range(60)] + [9_000, 30_000], None: [5, 3, 70, 1_500]}
    rows = [(1000 * k + n, " ".join(["w"] * size), source) for k, (source, each) in enumerate(sizes.items()) for n, size in enumerate(each)]
    weighed = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for share in (0.3, 0.7):
        table = spark.createDataFrame([(s, len(each), sum(each), share * sum(each)) for s, each in sizes.items()], "source string, rows long, words long, target double")
        got = {r.id: r.copies for r in mixing.mix(weighed, table).collect()}
        for source, each in sizes.items():
            left, gap, taken = sorted((r.u, r.size, r.id) for r in weighed.collect() if r.source == source), share * sum(each), set()
            for _, size, one in left:
                if size <= gap:
                    gap -= size
                    taken.add(one)
            close = min(((abs(gap - size), u, one) for u, size, one in left if one not in taken and size < 2 * gap), default=None)
            assert {one for _, _, one in left if got[one]} == taken | ({close[2]} if close else set())
