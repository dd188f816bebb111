"""Near duplicates at a similarity of 0.8 or more of five-word shingle sets: SimHash and BK-trees, verified.

Two texts at that similarity differ in about 10 of 64 bits; of 48,000 simulated pairs
of sets of 5 to 300 shingles none differed in more than 24, and ``RADIUS`` is 28. No
blocks of bits find so wide a radius, so that shards are made of texts that agree in
a band of minimal shingle hashes (at a similarity of 0.8 a pair misses all of the
bands with a probability of 0.0006). Shards with the same members are searched once.

Texts with equal sets are one node from the start. Within a shard a BK-tree over the
fingerprints gives the candidates, and the shingle sets decide at once, in the task:
candidates are never rows. A task keeps the classes found so far, asks only for
candidates of other classes, and gives one link for each two classes that it joins.

A shard with more than ``TREE_MOST`` members or ``WEIGHT_MOST`` shingles is too large for
one task. Its members are first held against its pivot, the member whose bands are the
largest, which is the original in a group of copies. Members that this doesn't join are
open. They are cut in chunks that make a tree each, and all members of the shard, in
parts, ask every such tree. Memory is bounded by a chunk, and no pair is left out.

Defined results: null and empty texts are one component; a text of fewer than five
words is one shingle; component ids are the smallest id, null only if every id is;
equal rows are in one component; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import simhash
from brindle.llm.simhash import BKTree, components, labels, least, majority, shingle_hashes
from brindle.plans.shared import Scratch, scratch
from brindle.plans.sieve import bits_of, sieve, sifted

SHINGLE = 5
#: The least similarity, as a fraction of integers.
SIMILARITY = (4, 5)
BANDS, ROWS = 14, 4
RADIUS = 28
#: Members in a tree at most, and the shingles that they have together.
TREE_MOST, WEIGHT_MOST = 2000, 4_000_000
#: Candidates whose sets are held against a text's at once.
AT_ONCE = 64

SKETCH = T.StructType(
    [T.StructField("fp", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


@lru_cache(1)
def _slots() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each slot, from the slot's number."""
    from xxhash import xxh64_intdigest

    made = [(xxh64_intdigest(b"factor", n) | 1, xxh64_intdigest(b"mask", n)) for n in range(BANDS * ROWS)]
    return np.array([f for f, _ in made], dtype=np.uint64), np.array([m for _, m in made], dtype=np.uint64)


def sketch(text: bytes | None) -> tuple[int, int, int, list[int]]:
    """A hash of the shingle set, the 64-bit fingerprint of the set, its size, and a key for each band."""
    from xxhash import xxh64_intdigest

    hashes = shingle_hashes(text, SHINGLE)
    if not len(hashes):
        return 0, 0, 0, []
    members = np.unique(hashes)
    factors, masks = _slots()
    lowest = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(members), 1024):
        lowest = np.minimum(lowest, ((members[at : at + 1024, None] ^ masks) * factors).min(axis=0))
    bands = [xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(lowest.astype("<u8").reshape(BANDS, ROWS))]
    return xxh64_intdigest(members.astype("<u8").tobytes(), 5), majority(members), len(members), bands


@F.arrow_udf(SKETCH)
def sketch_of(texts: pa.Array) -> pa.Array:
    fps, bits, weights, bands = zip(*map(sketch, texts.cast(pa.binary()).to_pylist())) if len(texts) else ((), (), (), ())
    keys = pa.array([_signed(b) for b in bands], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([pa.array(_signed(fps)), pa.array(_signed(bits)), pa.array(weights, pa.int64()), keys], ["fp", "bits", "weight", "bands"])


@F.arrow_udf(T.BinaryType())
def shingles_of(texts: pa.Array) -> pa.Array:
    """The sorted shingle set of each text, 8 bytes a shingle."""
    return pa.array([np.unique(shingle_hashes(t, SHINGLE)).astype("<u8").tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def similar_to(members: np.ndarray, others: list[np.ndarray]) -> list[bool]:
    """Whether each of the sets shares at least ``SIMILARITY`` of its union with the first one."""
    up, down = SIMILARITY
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.searchsorted(members, every)
    found = members[np.minimum(at, len(members) - 1)] == every
    both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return (both * down >= up * (len(members) + sizes - both)).tolist()


class Shard:
    """The tree of one shard or chunk, and the classes found so far."""

    def __init__(self) -> None:
        self.tree, self.at = BKTree(), {}
        self.members: list[tuple[int, int, np.ndarray]] = []
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, root: int) -> int:
        parent = self.parent
        parent.setdefault(root, root)
        while parent[root] != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        return root

    def add(self, fp: int, bits: int, root: int, members: np.ndarray) -> None:
        if bits in self.at:
            self.at[bits].append(len(self.members))
        else:
            self.at[bits] = [len(self.members)]
            self.tree.add(bits)
        self.members.append((fp, root, members))

    def ask(self, fp: int, bits: int, root: int, members: np.ndarray) -> None:
        """Join the member's class with those of the similar members in the tree, the nearest fingerprints first."""
        up, down = SIMILARITY
        size, mine = len(members), self.top(root)
        near = sorted(self.tree.within(bits, RADIUS), key=lambda other: (other ^ bits).bit_count())
        todo = [m for other in near for m in self.at[other] if self.top(self.members[m][1]) != mine]
        todo = [m for m in todo if up * max(size, len(self.members[m][2])) <= down * min(size, len(self.members[m][2]))]
        while todo:
            now, todo = todo[:AT_ONCE], todo[AT_ONCE:]
            joined = False
            for m, is_similar in zip(now, similar_to(members, [self.members[m][2] for m in now])):
                other = self.top(self.members[m][1])
                if is_similar and other != self.top(root):
                    self.parent[other] = self.top(root)
                    self.links.append((fp, self.members[m][0]))
                    joined = True
            if joined:
                todo = [m for m in todo if self.top(self.members[m][1]) != self.top(root)]


#: What a dealt row does in its shard: enter the tree, ask it, or ask and then enter.
ENTERS, ASKS, BOTH = 0, 1, 2


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards follow one another in a task, sorted by key and role; one tree is held at a time."""
    key, shard = None, Shard()

    def flush() -> pa.RecordBatch:
        rows = np.array(shard.links, dtype=np.int64).reshape(-1, 2)
        shard.links = []
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1]))], ["a", "b"])

    for batch in batches:
        sets = batch.column("members")
        for n, row in enumerate(batch.drop_columns(["members"]).to_pylist()):
            if (now := (row["band"], row["i"], row["j"])) != key:
                if shard.links:
                    yield flush()
                key, shard = now, Shard()
            # A copy, so that a tree doesn't hold whole batches.
            member = row["fp"], row["bits"] % (1 << 64), row["root"], np.frombuffer(sets[n].as_buffer(), dtype="<u8").copy()
            if row["role"] != ENTERS:
                shard.ask(*member)
            if row["role"] != ASKS:
                shard.add(*member)
    yield flush()


def _search(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what is similar; ``dealt`` has band, i, j (the task's key), role, fp, bits, root."""
    rows = dealt.join(sets, "th").drop("th").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "role", "fp")
    return rows.mapInArrow(_search_shards, "a bigint, b bigint")


def _chunks(n: Column, weight: Column, tree_most: int) -> Column:
    return F.greatest(F.ceil(n / tree_most), F.ceil(weight / WEIGHT_MOST), F.lit(1)).cast("int")


def _chunk_of(chunks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("fp", F.lit(seed)), chunks.cast("long")).cast("int")


def _every(chunks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), chunks - 1))


def _large_shards(members: DataFrame, sets: DataFrame, tree_most: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """The links to pivots, and rows for ``_search`` that find the rest."""
    score = members.groupBy("fp").agg(F.sum("n").alias("score"))
    members = tables.write(members.join(score, "fp"), "similar-large")
    pivots = tables.write(members.groupBy("band").agg(F.max(F.struct("score", "fp"))["fp"].alias("pivot")), "similar-pivots")
    members = members.join(pivots, "band").withColumn("parts", _chunks(F.col("n"), F.col("of_all"), tree_most))
    is_pivot = F.col("fp") == F.col("pivot")
    row = [F.col("th"), F.col("fp"), F.col("bits"), F.col("fp").alias("root")]
    stars = members.where(is_pivot).select("band", F.lit(0).alias("i"), _every(F.col("parts")).alias("j"), F.lit(ENTERS).alias("role"), *row)
    stars = stars.unionByName(members.where(~is_pivot).select("band", F.lit(0).alias("i"), _chunk_of(F.col("parts"), 1).alias("j"), F.lit(ASKS).alias("role"), *row))
    stars = tables.write(_search(stars, sets), "similar-stars")

    roots = tables.write(components(stars, tables), "similar-roots")
    of_member, of_pivot = (roots.select(F.col("node").alias(at), F.col("root").alias(name)) for at, name in (("fp", "r"), ("pivot", "p")))
    members = members.join(of_member, "fp", "left").join(of_pivot, "pivot", "left")
    members = members.withColumns({"root": F.coalesce("r", "fp"), "open": F.coalesce("r", "fp") != F.coalesce("p", "pivot")}).drop("r", "p")
    counts = members.where("open").groupBy("band").agg(F.count("*").alias("n_open"), F.sum("weight").alias("of_open"))
    members = tables.write(members.join(counts, "band").withColumn("trees", _chunks(F.col("n_open"), F.col("of_open"), tree_most)), "similar-open")
    row = [F.col("th"), F.col("fp"), F.col("bits"), F.col("root")]
    enter = members.where("open").select("band", _chunk_of(F.col("trees"), 2).alias("i"), _every(F.col("parts")).alias("j"), F.lit(ENTERS).alias("role"), *row)
    ask = members.select("band", _every(F.col("trees")).alias("i"), _chunk_of(F.col("parts"), 1).alias("j"), F.lit(ASKS).alias("role"), *row)
    return stars, enter.unionByName(ask)


def links(docs: DataFrame, text: str, nodes: DataFrame, tree_most: int, tables: Scratch) -> DataFrame:
    """Links between ``nodes`` (fp, bits, weight, bands, least) that join all that are similar, directly or by others."""
    banded = nodes.select("fp", F.explode("bands").alias("band"), "weight")
    shards = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("weight").alias("of_all"), F.bit_xor(F.xxhash64("fp")).alias("all"))
    shards = shards.where("n > 1").groupBy("all", "n", "of_all").agg(F.min("band").alias("band")).drop("all")
    shards = tables.write(shards, "similar-shards")
    members = tables.write(banded.join(shards, "band"), "similar-banded")
    known = nodes.select("fp", "bits", F.col("least.th").alias("th"))
    needed = tables.write(known.join(members.select("fp"), "fp", "left_semi"), "similar-needed")
    members = tables.write(members.join(needed, "fp"), "similar-members")

    # Texts that aren't needed stop in the scan; of each needed one copies are put together before the shuffle.
    wanted = tables.write(sieve(needed, "th"), "similar-sieve")
    texts = sifted(docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("t")), F.col("th"), wanted, bits_of(wanted), "may").where("may")
    texts = texts.join(needed.select("th"), "th", "left_semi")
    sets = texts.groupBy("th").agg(F.first("t").alias("t")).select("th", shingles_of("t").alias("members"))

    is_large = (F.col("n") > tree_most) | (F.col("of_all") > WEIGHT_MOST)
    whole = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(BOTH).alias("role")]
    dealt = members.where(~is_large).select("band", *whole, "th", "fp", "bits", F.col("fp").alias("root"))
    if shards.where(is_large).isEmpty():
        return _search(dealt, sets)
    sets = tables.write(sets, "similar-sets")
    stars, rest = _large_shards(members.where(is_large), sets, tree_most, tables)
    return stars.unionByName(_search(dealt.unionByName(rest), sets))


def marked(docs: DataFrame, id_col: str, text: str, tree_most: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, fp: a hash of the shingle set) and the labels of those in components of several rows."""
    sketches = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), sketch_of(F.col(text)).alias("s"))
    sketches = tables.write(sketches.select("id", "th", "s.*"), "similar-sketches")
    one = [F.first(c).alias(c) for c in ("bits", "weight", "bands")]
    nodes = tables.write(sketches.groupBy("fp").agg(least(), F.count("*").alias("rows"), *one), "similar-nodes")
    rows = tables.write(sketches.select("id", "th", "fp"), "similar-rows")
    tables.drop(sketches)
    with scratch(docs.sparkSession) as own:
        found = tables.write(links(docs, text, nodes, tree_most, own), "similar-links")
    return rows, tables.write(labels(nodes, found, tables), "similar-labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tree_most: int = TREE_MOST) -> DataFrame:
    """One row a document: id, fp (the hash of its shingle set), component (a label) and component_id (its smallest id)."""
    return simhash.classes(docs, id_col, text, tree_most, marked)


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tree_most: int = TREE_MOST) -> DataFrame:
    """One row of each component of similar texts, with all its columns, chosen as ``keep_one`` does."""
    return simhash.keep_one(docs, id_col, text, tree_most, marked)
