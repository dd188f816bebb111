"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit for each of 64 places: 1 if the bit is set in
over half of its shingles' hashes. Two fingerprints link if they differ in at
most ``RADIUS`` bits. Equal fingerprints are one node from the start.

Search: of RADIUS + 1 blocks of bits, linked fingerprints agree in at least one.
Fingerprints that agree in a block make a shard. A shard above ``TREE_MOST`` is
split again: its members agree in the blocks so far and differ in RADIUS of the
other bits at most, so that these are cut into RADIUS + 1 blocks in turn, until all
shards are small (when few bits are left, there are few distinct fingerprints).
Every shard gets a BK-tree (children keyed by their Hamming distance to the
parent); each fingerprint asks the tree before it enters and follows only edges
within the radius of its own distance. The trees together are as large as the
corpus, so that they are not broadcast: each is built in the task to which its
shard and all of the shard's queries were dealt.

Components: alternating large and small stars over the links, on tables.

Defined results: a null or empty text has the fingerprint 0, linked like any
other; component ids are the smallest id, null only if every id is; equal rows
are in one component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.words import fresh
from brindle.plans.shared import Scratch, scratch
from brindle.plans.sieve import bits_of, sieve, sifted

RADIUS = 2
SHINGLE = 3
#: Fingerprints in one BK-tree at most.
TREE_MOST = 4000
#: Rows of one fingerprint from which it is joined by broadcast. A table of n rows has n / HOT_ROWS such fingerprints at most.
HOT_ROWS = 100_000


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # for bytes both know ASCII only, and split at 09-0D and 20
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.array([xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as an unsigned integer."""
    return majority(shingle_hashes(text, shingle))


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text as a signed long."""
    found = np.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, th (a hash of the text) and fp."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), fingerprint_of(F.col(text)).alias("fp"))


def hexed(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    __slots__ = ("root", "children")

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def within(self, value: int, radius: int) -> list[int]:
        """The members at most ``radius`` from the value."""
        if self.root is None:
            return []
        found, todo, children = [], [self.root], self.children
        while todo:
            node = todo.pop()
            far = (node ^ value).bit_count()
            if far <= radius:
                found.append(node)
            for distance, child in children[node].items():
                if -radius <= distance - far <= radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        """Enter a value that is not there yet."""
        self.children[value] = {}
        if self.root is None:
            self.root = value
            return
        node = self.root
        while True:
            below = self.children[node]
            far = (node ^ value).bit_count()
            if far not in below:
                below[far] = value
                return
            node = below[far]


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """For one shard: a link from each value that has any to its class's smallest value."""
    tree, parent = BKTree(), {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        if value in parent:
            continue
        parent[value] = value
        for other in tree.within(value, radius):
            a, b = top(other), top(value)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(x, root) for x in parent if (root := top(x)) != x]


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards follow one another in a task, sorted by key; one is held at a time."""
    key, members = None, []
    out: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        rows = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1]))], ["a", "b"])

    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        values = batch.column(2).to_numpy().view(np.uint64).tolist()
        for k, v in zip(keys, values):
            if k != key:
                out += shard_links(members)
                key, members = k, []
            members.append(v)
        if len(out) > 50_000:
            yield flush()
    out += shard_links(members)
    yield flush()


def cut(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The mask with each of ``parts`` blocks of its free bits added."""
    free = [n for n in range(64) if not mask >> n & 1]
    bounds = [k * len(free) // parts for k in range(parts + 1)]
    return [mask | sum(1 << n for n in free[a:b]) for a, b in zip(bounds, bounds[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, tree_most: int = TREE_MOST, tables: Scratch | None = None) -> DataFrame:
    """Links between distinct fingerprints that join all that are within the radius, directly or by others: columns a, b."""
    if tables is None:
        with scratch(fps.sparkSession) as own:
            return own.keep(links(fps, tree_most, own), "simhash-found")
    spark = fps.sparkSession
    masks, members, trees = [0], fps.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        children = [(_signed(m), _signed(c)) for m in masks for c in cut(m)]
        below = F.broadcast(spark.createDataFrame(children, "mask long, child long"))
        dealt = members.join(below, "mask").select("fp", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("part"))
        sizes = tables.write(dealt.groupBy("mask", "part").count().where("count > 1"), "simhash-shards")
        dealt = dealt.join(sizes, ["mask", "part"])
        # With RADIUS free bits there is nothing to cut, and no more than 2 ** RADIUS members.
        is_small = (F.col("count") <= tree_most) | (F.bit_count("mask") >= 64 - RADIUS)
        small = dealt.where(is_small).select("mask", "part", "fp")
        trees = small if trees is None else trees.unionByName(small)
        large = [r.mask for r in sizes.where(~is_small).select("mask").distinct().toLocalIterator()]
        if not large:
            break
        masks = [m % (1 << 64) for m in large]
        members = tables.write(dealt.where(~is_small).select("fp", "mask").distinct(), "simhash-large")
    return trees.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(_link_shards, "a bigint, b bigint")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over pairs (a, b) with a > b: every a points to the smallest that it sees."""
    seen = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        moved = seen.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(found: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """(node, root) for each node of a link but the roots; root is its component's smallest node."""
    if tables is None:
        with scratch(found.sparkSession) as own:
            return own.keep(components(found, own), "simhash-components")
    pairs = tables.write(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "simhash-links")
    before = None
    while True:
        last, pairs = pairs, tables.write(_star(_star(pairs, True), False), "simhash-stars")
        tables.drop(last)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def least() -> Column:
    """The row of a component that stays, as a sort key: null ids last, then the smallest id, then the smallest hash of the text."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("least")


def labels(nodes: DataFrame, found: DataFrame, tables: Scratch) -> DataFrame:
    """Of ``nodes`` (fp, least, rows) those whose component has several rows: fp, rows, component, least of the component."""
    roots = components(found, tables)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = tables.write(nodes.select("fp", "rows", "least").join(roots, F.col("fp") == F.col("node")).drop("node"), "simhash-linked")
    over_all = linked.groupBy("root").agg(F.min("least").alias("over_all"))
    linked = linked.join(over_all, "root").select("fp", "rows", F.col("root").alias("component"), F.col("over_all").alias("least"))
    alone = nodes.where("rows > 1").join(roots, F.col("fp") == F.col("node"), "left_anti")
    return linked.unionByName(alone.select("fp", "rows", F.col("fp").alias("component"), "least"))


def with_labels(narrow: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with component and least, null for a row that is its own component. A hot fingerprint's row is broadcast, the others are joined by key."""
    hot = F.broadcast(named.where(F.col("rows") >= HOT_ROWS).select(F.col("fp").alias("hot_fp"), F.struct("component", "least").alias("hot")))
    rest = named.where(F.col("rows") < HOT_ROWS).select(F.col("fp").alias("rest_fp"), F.struct("component", "least").alias("rest"))
    rows = narrow.join(hot, F.col("fp") == F.col("hot_fp"), "left")
    # Rows that are named already are dealt by a hash of their own; should it meet a fingerprint, the first name counts.
    key = F.when(F.col("hot_fp").isNull(), F.col("fp")).otherwise(F.xxhash64("id", "th"))
    rows = rows.withColumn("key", key).join(rest, F.col("key") == F.col("rest_fp"), "left")
    label = F.coalesce("hot", "rest")
    return rows.select(*narrow.columns, label["component"].alias("component"), label["least"].alias("least"))


def marked(docs: DataFrame, id_col: str, text: str, tree_most: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, fp) and the ``labels`` of those in components of several rows."""
    narrow = tables.write(fingerprints(docs, id_col, text), "simhash-fps")
    nodes = tables.write(narrow.groupBy("fp").agg(least(), F.count("*").alias("rows")), "simhash-nodes")
    return narrow, tables.write(labels(nodes, links(nodes.select("fp"), tree_most, tables), tables), "simhash-labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tree_most: int = TREE_MOST, mark=marked) -> DataFrame:
    """One row a document: id, fp, component (a label) and component_id (its smallest id)."""
    with scratch(docs.sparkSession) as tables:
        rows = with_labels(*tables.outlive(*mark(docs, id_col, text, tree_most, tables)))
    component_id = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return rows.select("id", "fp", F.coalesce("component", "fp").alias("component"), component_id.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tree_most: int = TREE_MOST, mark=marked) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (then with the smallest hash of the text).

    Of several rows with that id and text, the one with the smallest digest of all columns stays.
    Only rows that a sieve of those that go lets through are joined: most texts are neither shuffled nor sorted.
    ``mark`` finds the components, as ``marked`` does.
    """
    with scratch(docs.sparkSession) as tables:
        rows = with_labels(*mark(docs, id_col, text, tree_most, tables)).where("component is not null")
        same = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("th") == F.col("least.th"))
        gone = tables.keep(rows.where(~same).select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "simhash-gone")
        again = rows.where(same).groupBy(F.col("id").alias("again_id"), F.col("th").alias("again_th")).count().where("count > 1")
        again = tables.keep(again.drop("count"), "simhash-again")
        goes = tables.keep(sieve(gone.select(F.col("gone_th").alias("th")).union(again.select("again_th")), "th"), "simhash-sieve")
    th, may = fresh(docs, "th"), fresh(docs, "may_go")
    keyed = sifted(docs.withColumn(th, F.xxhash64(text)), F.col(th), goes, bits_of(goes), may)
    stays, keyed = keyed.where(~F.col(may)), keyed.where(may).drop(may)

    def at(other: DataFrame, name: str) -> Column:
        return keyed[id_col].eqNullSafe(other[f"{name}_id"]) & (keyed[th] == other[f"{name}_th"])

    left = keyed.join(gone, at(gone, "gone"), "left_anti")
    if again.isEmpty():
        return stays.drop(may).unionByName(left).drop(th)
    digest = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    firsts = keyed.join(again, at(again, "again"), "left_semi").groupBy(id_col, th).agg(F.min_by(F.struct(*docs.columns), digest).alias("row"))
    kept = stays.drop(may).unionByName(left.join(again, at(again, "again"), "left_anti"))
    return kept.drop(th).unionByName(firsts.select("row.*"))
