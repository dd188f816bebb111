"""The operators that SQL can't express, against plain versions on small inputs and edge rows."""

import hashlib
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from brindle.llm import chat_format, html_text, license_scan, quality_classifier, token_count
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "x" * 100_000, "a b " * 20_000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture
def edge(spark):
    return spark.createDataFrame([(n if n else None, t, "clash") for n, t in enumerate(EDGE)], "doc_id long, text string, r string")


def test_license_base_against_plain(spark, texts):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for row in QUERIES["op4_license_scan"](spark, SF).collect():
        lower = "".join(c.lower() if c.isascii() else c for c in texts[row.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_license_suppression_against_all_pairs():
    random.seed(3)
    for _ in range(3000):
        found = [license_scan.Detection("ab"[random.random() < 0.5], random.choice([50, 60]), s := random.randrange(8), s + random.randrange(1, 5)) for _ in range(random.randrange(6))]
        kept = []
        for one in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
            if not any(k.start <= one.start and one.end <= k.end for k in kept):
                kept.append(one)
        assert license_scan.suppressed(found) == sorted(kept, key=lambda d: (d.start, d.end, d.label))


def test_license_rules():
    assert len(license_scan.signatures()) > 200
    labels = lambda s: [d.label for d in license_scan.scan(s.encode())[2]]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2"]
    assert labels("All rights reserved. A general public of readers") == ["proprietary"]
    for text, found in {
        "SPDX-License-Identifier: GPL-3.0-or-later": ["gpl-3-or-later"],
        "SPDX-License-Identifier: LGPL-2.1-only": ["lgpl-2.1-only"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["mit", "apache-2"],
        "SPDX-License-Identifier: BSD-3-Clause": ["bsd-3"],
        "licensed under the GPLv3": ["gpl-3"],
        "released under LGPLv2.1": ["lgpl-2.1"],
        "distributed under a Creative Commons Attribution 4.0 license": ["cc-by-4"],
        "licensed under MIT and GPL v2": ["mit", "gpl-2"],
        "the BSD-3-Clause license": ["bsd-3"],
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": ["cc-by-nc-sa-4"],
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ["gpl-3-or-later"],
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ["agpl-3-or-later"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": ["mpl-2"],
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": ["apache-2"],
        "under the same terms as Perl itself": ["artistic-perl"],
        "a license to drive, general terms, public roads and an apache helicopter": [],
        "boost your zlib with common sense and artistic freedom": [],
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": ["mpl-2", "mpl-2"],
        "distributed under the LaTeX Project Public License, version 1.3c": ["lppl-1.3"],
        "the Blue Oak Model License 1.0.0": ["blueoak-1"],
        "an apple, a public source of light; an oak model and a game of chess": [],
        "the museum gives credit, and anyone is free to copy the font of the deed": [],
    }.items():
        assert labels(text) == found, text


def test_written_license_rules_find_themselves():
    """Each rule whose regex is a plain sentence finds it, whole, and nothing is found when its keyword is another word."""
    rules = [line.split(" | ") for line in license_scan.WRITTEN.strip().splitlines()]
    plain = [(label, keywords, pattern) for label, _, keywords, pattern in rules if re.fullmatch(r"[a-z0-9 ]+", pattern)]
    assert len(rules) > 300 and len(plain) > 60 and len(set(map(tuple, rules))) == len(rules)
    for label, keywords, pattern in plain:
        words = pattern.encode().split()
        assert (label, 0, len(words)) in [(d.label, d.start, d.end) for d in license_scan.detect(words)], pattern
        other = [b"zzz" if w in keywords.encode().split() else w for w in words]
        assert label not in [d.label for d in license_scan.detect(other) if (d.start, d.end) == (0, len(words))]


def test_tokens_against_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    for row in QUERIES["op5_token_count"](spark, SF).collect():
        text = texts[row.doc_id] or ""
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (count(text), len(text.encode()), count(text) > 512)
    random.seed(5)
    letters = [*map(chr, range(0, 0x30)), "\x85", "\xa0", "　", "​", "́", "é", "中", "\U0001f600", "<|endoftext|>", "'s", "aaaa", " "]
    noise = ["".join(random.choices(letters, k=random.randint(1, 15))) for _ in range(1000)] + [t for t in EDGE if t]
    counter = token_count.Counter(token_count.Merges.from_json(public_tokenizers.path("byte_bpe_50k.json")))
    assert counter.counts(noise) == [count(t) for t in noise]


def test_tokens_of_edge_rows(spark, edge):
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, count = Tokenizer.from_file(path), token_count.token_counter(spark, path)
    counted = edge.select("*", count(F.col("text")).alias("n_tokens"))
    assert counted.columns == [*edge.columns, "n_tokens"] and counted.limit(0).count() == 0
    want = [(t, "clash", len(own.encode(t or "", add_special_tokens=False).ids)) for t in EDGE]
    assert sorted(((r.text, r.r, r.n_tokens) for r in counted.collect()), key=repr) == sorted(want, key=repr)


def test_chat_sql_counts_escapes(spark, tmp_path):
    import duckdb

    from brindle.llm.queries import ORACLES

    random.seed(8)
    pieces = [*chat_format.CONTROL, "\\", "n", "\n", "<", "|", "é", "<<", "s>", "[", chat_format.END]
    rows = [(random.choice([None, *range(9)]), random.choice([None, *range(5)]), random.choice(["user", "assistant", None, "a\nb", "<s>"]), random.choice([None, "".join(random.choices(pieces, k=6))])) for _ in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = QUERIES["op7_chat_format"](spark, str(tmp_path)), con.sql(ORACLES["op7_chat_format"])
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_chat_round_trip_on_noise():
    random.seed(2)
    pieces = [*chat_format.CONTROL, "\\", "n", "\n", "<", "|", "turn|>", "[", "a", "é", "s>", "\\n", chat_format.END]
    for _ in range(3000):
        said = [{"role": random.choice(["user", "assistant", "".join(random.choices(pieces, k=3))]), "text": "".join(random.choices(pieces, k=random.randint(0, 8)))} for _ in range(random.randint(0, 4))]
        reader = chat_format.Reader()
        chat_format.compile_template(chat_format.DEFAULT)(iter(said), reader.feed)
        assert reader.turns.hexdigest() == hashlib.sha256("".join(f"{m['role']}\n{m['text']}\n" for m in said).encode()).hexdigest()
        assert reader.loss.hexdigest() == hashlib.sha256("".join(m["text"] for m in said if m["role"] == "assistant").encode()).hexdigest()
        text, spans = chat_format.render(said)
        assert len(text) == reader.formatted_chars
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == [m["text"] for m in said if m["role"] == "assistant" and m["text"]]


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", said), ("assistant", said)]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = QUERIES["op7_chat_format"](spark, SF).collect()
    assert {r.conv_id for r in got} == set(turns) and len(got) == len(turns)
    for r in got:
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns[r.conv_id]), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id]).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edges_and_language(spark):
    rows = spark.createDataFrame([(None, 1, "user", None, "x"), (None, None, None, "a", "y"), (1, 0, "assistant", "b", "z"), (1, 0, "assistant", "b", "z")], "conv_id long, turn long, role string, text string, id string")
    got = {r.id: (r.n_turns, r.loss_chars) for r in chat_format.digests(rows).collect()}
    assert got == {None: (2, 0), 1: (2, 2)}
    assert chat_format.digests(rows.limit(0)).count() == 0
    joined = "".join(r.piece for r in chat_format.formatted(rows).where("id = 1").orderBy("nth").collect())
    assert joined == chat_format.render([{"role": "assistant", "text": "b"}] * 2)[0]
    assert chat_format.fold(chat_format.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}y{% endif %}")) == ("block", [("text", "abCy")])
    for bad in ("{% for x %}", "{% if a %}", "{{ a | nofilter }}", "{{ }}", "{% endif %}", "{{ a not b }}", "{{ a is odd }}", "{% set 1 = a %}", "{% set a %}", "{{ loop.__class__ }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)


@pytest.mark.parametrize(
    ("template", "text"),
    [
        ("a {#- no {{ x }} -#} b", "ab"),
        ("{% for m in messages -%}\n  {{- m.text }}{% if not loop.last %}, {% endif %}\n{%- endfor %}", "hi, you, end"),
        ("{% for m in messages %}{% set t = m.text + '!' %}{{ t | upper }}{% endfor %}{{ t }}", "HI!YOU!END!"),
        ("{% for m in messages %}{{ loop.index if_none }}{% endfor %}", None),
        ("{% for m in messages %}{% if m.role in 'user tool' and m.text not in 'you' %}{{ loop.index }}{% endif %}{% endfor %}", "1"),
        ("{% if nothing is defined %}a{% elif nothing is not none %}b{% elif 'x' is string and 1 is number %}c{% endif %}", "c"),
        ("{{ 'b' in 'abc' }}{{ 'b' not in 'abc' }}{{ 'role' in m }}", "TrueFalseFalse"),
    ],
)
def test_chat_template_language(spark, template, text):
    said = [{"role": "user", "text": "hi"}, {"role": "user", "text": "you"}, {"role": "assistant", "text": "end"}]
    if text is None:
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(template)
        return
    assert chat_format.render(said, template)[0] == text
    if [node[0] for node in chat_format.fold(chat_format.parse(template))[1]] == ["for"]:
        rows = spark.createDataFrame([(1, n, m["role"], m["text"]) for n, m in enumerate(said)], "conv_id long, turn long, role string, text string")
        assert "".join(r.piece for r in chat_format.formatted(rows, template).orderBy("nth").collect()) == text


def test_classifier(spark):
    import zlib

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in held]) > 0.8


def test_classifier_fit_against_plain():
    """Ratios by counting, and the dual problem by projected gradients over all rows at once."""
    rng = np.random.default_rng(4)
    texts = [np.unique(rng.choice(40, size=rng.integers(0, 12))).astype(np.int32) for _ in range(60)]
    labels = np.array([int(rng.random() < (0.9 if 3 in t or 7 in t else 0.3)) for t in texts])
    positive = labels.sum()

    ones = [[1 + sum(place in t for t, label in zip(texts, labels) if label == c) for place in range(40)] for c in (0, 1)]
    unseen = (1 << quality_classifier.BITS) - 40
    ratios = np.array([np.log(b / (sum(ones[1]) + unseen)) - np.log(a / (sum(ones[0]) + unseen)) for a, b in zip(*ones)])
    x = np.zeros((60, 41))
    for row, places in zip(x, texts):
        row[places] = ratios[places] / np.sqrt(max(1, len(places)))
        row[40] = 1
    signs = np.where(labels == 1, 1.0, -1.0)
    most = quality_classifier.COST * 60 / 2 / np.where(labels == 1, positive, 60 - positive)
    inner = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(inner)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - inner @ alpha), 0, most)
    want = x @ (x.T @ (alpha * signs))

    def loss(margins, norm):
        return norm / 2 + (most * np.maximum(0, 1 - signs * margins)).sum()

    exact = quality_classifier.fit(texts, labels, passes=2000)
    assert np.allclose([exact.margin(t) for t in texts], want, atol=1e-3)
    quick = quality_classifier.fit(texts, labels)
    w = quick.weights[:40] / ratios
    least = loss(want, np.square(x.T @ (alpha * signs)).sum())
    assert least - 1e-6 <= loss(np.array([quick.margin(t) for t in texts]), w @ w + quick.bias**2) <= 1.02 * least


def test_classifier_edge_rows(spark, edge):
    from pyspark.sql import functions as F

    docs = edge.unionByName(spark.createDataFrame([(n, f"good plain text number {n}" if n % 2 else f"junk junk {n} junk", "x") for n in range(100, 160)], edge.schema))
    labels = spark.createDataFrame([(n, n % 2) for n in range(100, 160)] + [(101, None), (None, 1), (103, 5), (9999, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    scored = docs.select("*", quality_classifier.scorer(spark, model)(F.col("text")).alias("s"))
    rows = scored.collect()
    assert len(rows) == len(EDGE) + 60 and all(0 <= r.s <= 1 for r in rows) and scored.limit(0).count() == 0
    assert len({r.s for r in rows if not (r.text or "").strip()}) == 1 and len({r.s for r in rows if r.text == "same text here"}) == 1
    assert all((r.s >= 0.5) == bool(r.doc_id % 2) for r in rows if (r.doc_id or 0) >= 100)


def test_classifier_without_both_classes(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.train(edge, none)
    assert model.score(np.zeros(0, dtype=np.int32)) == 0.5
    ones = spark.createDataFrame([(n, 1) for n in range(7)], "doc_id long, quality int")
    model = quality_classifier.train(edge, ones)
    from pyspark.sql import functions as F

    scores = [r.s for r in edge.select(quality_classifier.scorer(spark, model)(F.col("text")).alias("s")).collect()]
    assert len(scores) == len(EDGE) and all(s > 0.9 for s in scores)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<title>no</title><h1>A&amp;b</h1>c  d<p>e<br>f", "A&b\n\nc d\n\ne\nf"),
        ("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  1. c\n  2. d\n- e"),
        ("<table><caption>t<tr><th>a<th>bbb<tr><td>long<td>2<tr><td rowspan=2>r<td>x<tr><td>y</table>", "t\na     bbb\nlong  2\nr     x\n      y"),
        ("<p hidden>a</p><div style='display: none'>b</div><script>c</script>d", "d"),
        ("<pre>  a\n\n   b</pre>", "  a\n\n   b"),
        ("<p>a<p>b", "a\n\nb"),
    ],
)
def test_html(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>x</title><body><p>hi", "hi"),
        ("<head><meta charset=utf-8><p>hi<p>you", "hi\n\nyou"),
        ("<head> <title>x</title> <style>a {}</style> some text</head> more", "some text more"),
        ("<head><noscript><img alt=no></noscript><title>no</title></head><body>yes", "yes"),
    ],
)
def test_html_head_without_end(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p><svg class='i'/> Hello</p><p>you", "Hello\n\nyou"),
        ("<svg><defs><path/></defs><g/></svg>a<math/>b", "ab"),
        ("<svg><defs><p>out</p>", "out"),
        ("<div/>in<span/> it", "in it"),
    ],
)
def test_html_foreign_elements_end_themselves(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p style='backface-visibility: hidden'>a<b style='x-display:none'>b</b>", "ab"),
        ("<p style='content: \"; display: none\"'>a", "a"),
        ("<p style='display:none;DISPLAY: block'>a<p style='Display : None !important; display: block'>b<p style='/*;*/visibility:hidden'>c", "a"),
        ("<p>so <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math> is", "so a+b is"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>one</text><text>two</text><foreignObject><p>three</p></foreignObject></svg>", "one two\n\nthree"),
    ],
)
def test_html_formulas_drawings_and_styles(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("deep", [600, 50_000])
def test_html_deep_elements(deep):
    page = "<p>a" + "<b>" * deep + "<script>no</script><i hidden>no<b>no</b></i>b" + "</b>" * deep + "c<p>d" + "<b>" * deep + "<hr>" * 1000 + "e"
    assert html_text.visible_text(page) == "abc\n\nd\n\ne"


def test_edges(spark, edge):
    from pyspark.sql import functions as F

    rows = edge.select(license_scan.licenses("text").alias("f")).collect()
    assert [r.f.n_words for r in rows] == [0, 0, 0, 1, 40_000, 3, 3]
    pages = html_text.extract(edge.withColumnRenamed("text", "html"))
    assert pages.count() == len(EDGE) and pages.limit(0).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 600 + "a<script>var x=1;</script><p hidden>no</p><style>b{}</style>z", "az"),
        ("<table><td>a<td>b<tr><td>c", "a  b\nc"),
        (f"<table><tr><td>{'w' * 60}<td>b<tr><td>c<td>d</table>", f"{'w' * 60}  b\nc{' ' * 61}d"),
        ("<table><td>x<table><td>1<td>2<tr><td>33<td>4</table><td>y</table>", "x      y\n\n1   2\n33  4"),
        ("<table><tr><td rowspan=2>a<td colspan=2>b<td>c<tr><td>d<td>e<td>f</table>", "a  b     c\n   d  e  f"),
        ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no", "yes"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes"),
        ("<p style='display:none'>no<b style='visibility:visible'>no</b>", ""),
        ("<p hidden style='display:block'>yes", "yes"),
        ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kanji"),
        ("a < b &amp; c <3 &lt;i&gt; &copy 1", "a < b & c <3 <i> © 1"),
        ("<tr><td>in</td></tr> text", "in text"),
        ("<!--> a <!---> b <!-- - -- no --!> c <!doctype no> d <?no?> e </ no> f </> g", "a b c d e f g"),
        ("<script>'</scripts>'</SCRIPT >a<textarea>&lt;b></textarea>c<title>no &amp;</title>", "a <b>c"),
        ("<a title='>' b=\"'\" c=>x</a y='>'>z", "xz"),
        ("a<b c='no end> d", "a"),
    ],
)
def test_html_tokens_tables_and_visibility(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("piece", ["<a b='", "<!--", "<p<p", "<", "</", "&", "<script>", "<table><tr><td>x", "<ul><li>x", "<svg><p>", "<p>", "<td rowspan=1000 colspan=1000>x<tr>", "<p style='(a", "<![CDATA["])
def test_html_is_linear(piece):
    began = time.perf_counter()
    html_text.visible_text("<table>" * ("rowspan" in piece) + piece * (200_000 // len(piece)))
    assert time.perf_counter() - began < 5


class PlainPage(HTMLParser):
    """Words of a page in order, without any layout: another reading of what is visible, for pages without styles."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden, self.lists = "", 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")
        if tag == "body":
            self.hidden = 0
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        self.words += "" if tag in ("a", "b", "i", "span") else " "
        if tag == "li":
            self.lists[-1] = self.lists[-1] and self.lists[-1] + 1
            self.words += "- " if self.lists[-1] is None else f"{self.lists[-1]}. "

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")
        self.words += "" if tag in ("a", "b", "i", "span") else " "

    def handle_data(self, data):
        self.words += "" if self.hidden else data


def test_html_query_against_plain_reading(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_html_text"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for row in rows:
        plain = PlainPage()
        plain.feed(pages[row.page_id] or "")
        plain.close()
        assert row.text.split() == plain.words.split() and row.n_chars == len(row.text)


def test_html_edge_rows(spark):
    rows = [(1, None, "clash"), (2, "", "clash"), (2, "<p>a", "clash"), (2, "<p>a", "clash"), (None, "x" * 500_000, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == pages.columns and sorted(len(r.text) for r in got.collect()) == [0, 0, 1, 1, 500_000]
    assert html_text.extract(pages.limit(0)).count() == 0
