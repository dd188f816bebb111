"""The catalog: named indexes as folders of Parquet with a versioned manifest.

A manifest version is one JSON file, created exclusively; it lists the folders that are
the index. Each file group has its documents and, sorted by term, their postings, which lead a search
to the documents that can match; a file's counts stand in the manifest. Writing data first and publishing then makes a commit atomic; a writer
that loses the race for a version reads again and retries. All files go through
Hadoop's file system, so that any store Spark writes to will do (its create must
be exclusive).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import IndexConfig, from_dict, load
from brindle.functions.parse import ERRORS, LINE, parse_documents
from brindle.operators.search import Statistics, matches, needed_terms, places, ranked, result_json, text_terms, top
from brindle.plans.bind import Searchable, field_tokens
from brindle.plans.grammar import parse_query
from brindle.session import configure, setting

FILE_ID, DOC_ID = "_file", "_doc"
RETRIES = 20
#: Postings in one Parquet file, about.
POSTINGS_PER_FILE = 1_000_000
#: Documents from which a merge has a task, and with it a file, more; up to the number of cores.
ROWS_PER_TASK = 100_000
#: How long replaced file groups stay, and how many manifest versions.
GRACE_SECONDS, MANIFESTS_KEPT = 3600.0, 100


class CatalogError(RuntimeError):
    """The index exists already, is missing, or couldn't be published."""


class BadLineError(ValueError):
    """A line isn't a JSON object."""


class Catalog:
    """Verbs on the indexes below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = configure(spark), root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _create(self, path: str, text: str) -> bool:
        """Write a new file whole; false if there is one already."""
        try:
            out = self._fs.create(self._path(path), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, config_yaml: str) -> IndexConfig:
        """A new, empty index."""
        config, raw = load(config_yaml)
        if not self._create(f"{self.root}/{config.name}/config.json", raw):
            raise CatalogError(f"index {config.name!r} exists already")
        return config

    def config(self, name: str) -> IndexConfig:
        path = f"{self.root}/{name}/config.json"
        if not self._fs.exists(self._path(path)):
            raise CatalogError(f"no index {name!r}")
        return from_dict(json.loads(self._read(path)))

    def _manifest(self, name: str) -> tuple[int, dict]:
        folder = f"{self.root}/{name}/manifest"
        versions = [n for n in self._names(folder) if n.endswith(".json") and not n.startswith(".")]
        if not versions:
            return 0, {"files": [], "batches": {}}
        return int(versions[-1].removesuffix(".json")), json.loads(self._read(f"{folder}/{versions[-1]}"))

    def files(self, name: str) -> list[str]:
        """Ids of the committed file groups."""
        return self._manifest(name)[1]["files"]

    def _publish(self, name: str, change: Callable[[dict], dict | None]) -> bool:
        """Apply a change to the manifest; a change that returns None has nothing to do."""
        for _ in range(RETRIES):
            version, manifest = self._manifest(name)
            new = change(manifest)
            if new is None:
                return False
            if self._create(f"{self.root}/{name}/manifest/{version + 1:010d}.json", json.dumps(new)):
                return True
        raise CatalogError(f"index {name!r} is written to by too many at once")

    def _data(self, name: str, file_id: str) -> str:
        return f"{self.root}/{name}/data/{file_id}"

    def index(self, name: str, lines: DataFrame, on_bad_json: str = "fail", batch: tuple[str, int] | None = None) -> str | None:
        """Parse lines (a column ``value``) and commit them as one file group; None if no document is left.

        Documents with a bad value are skipped, and lines that aren't JSON objects fail the run or, by
        ``on_bad_json="skip"``, are skipped too. ``batch`` makes a repeated commit of a stream's batch do nothing.
        """
        config = self.config(name)
        if batch and self._manifest(name)[1]["batches"].get(batch[0], -1) >= batch[1]:
            return None
        parsed = parse_documents(lines, config)
        bad = F.array_contains(ERRORS, "json")
        if on_bad_json == "fail":
            stop = F.raise_error(F.concat(F.lit("not a JSON object: "), F.coalesce(F.substring(LINE, 1, 200), F.lit("null"))))
            parsed = parsed.withColumn(ERRORS, F.when(bad, stop.cast("array<string>")).otherwise(F.col(ERRORS)))
        file_id = uuid.uuid4().hex
        path = self._data(name, file_id)
        try:
            # The id goes first: a filter isn't moved below it, where it would parse each line once more for every field.
            numbered = parsed.select(F.monotonically_increasing_id().alias(DOC_ID), "*")
            numbered.where(F.size(ERRORS) == 0).drop(ERRORS, LINE).write.parquet(path)
        except Exception as error:
            if "not a JSON object" in str(error):
                raise BadLineError(str(error).splitlines()[0]) from error
            raise
        empty = self.spark.read.parquet(path).isEmpty()
        if empty:
            self._fs.delete(self._path(path), True)
        facts = {} if empty else self._invert(name, file_id, config)

        def add(manifest: dict) -> dict | None:
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return None
            batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
            more = [] if empty else [file_id]
            return manifest | {"files": manifest["files"] + more, "batches": batches, "facts": manifest.get("facts", {}) | {f: facts for f in more}}

        done = self._publish(name, add) if batch or not empty else False
        return file_id if done and not empty else None

    def _postings(self, name: str, file_id: str) -> str:
        return f"{self.root}/{name}/postings/{file_id}"

    def _invert(self, name: str, file_id: str, config: IndexConfig) -> dict:
        """Write the postings of a file group; returns its number of documents and of tokens by field.

        Files are ranges of (field, term, document), so that a term is read from few files and a frequent one isn't one task's.
        """
        table = Searchable.of(self.spark.read.parquet(self._data(name, file_id)), config)
        fields, found = [f for f in config.leaves() if f.kind == "text" and f.indexed and f.tokenizer != "raw"], None
        for field in fields:
            part = places(table, field, DOC_ID).select(F.lit(field.name).alias("field"), "term", F.col("id").alias(DOC_ID), "position")
            found = part if found is None else found.unionByName(part)
        facts = {"documents": table.df.count(), "lengths": {}}
        if found is not None:
            path = self._postings(name, file_id)
            sizes = table.df.agg(*[F.sum(F.greatest(F.size(field_tokens(f)), F.lit(0))).alias(f"n{k}") for k, f in enumerate(fields)]).first()
            facts["lengths"] = {f.name: sizes[k] or 0 for k, f in enumerate(fields)}
            parts = max(1, -(-sum(facts["lengths"].values()) // POSTINGS_PER_FILE))
            # One shuffle and one sort: the ranges keep a document's places of a term together, in order, so that they are gathered as they come.
            # (A lone field's name is a constant, which the optimizer takes out of the key, so that the ranges wouldn't fit it.)
            several = len(fields) > 1
            key = ("field", "term", DOC_ID) if several else ("term", DOC_ID)
            ordered = found.repartitionByRange(parts, *key).sortWithinPartitions(*key, "position")
            with setting(self.spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
                gathered = ordered.groupBy(*key).agg(F.count("*").alias("tf"), F.collect_list("position").alias("positions"))
                name_of = F.col("field") if several else F.lit(fields[0].name).alias("field")
                gathered.select(name_of, "term", DOC_ID, "tf", "positions").write.parquet(path)
        return facts

    def rejects(self, name: str, lines: DataFrame) -> DataFrame:
        """Lines that wouldn't be indexed, with the fields at fault."""
        return parse_documents(lines, self.config(name)).where(F.size(ERRORS) > 0).select(LINE, ERRORS)

    def read(self, name: str) -> DataFrame | None:
        """All committed documents with ``_file``; None if there are none."""
        files = self.files(name)
        if not files:
            return None
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return self.spark.read.parquet(*[self._data(name, f) for f in files]).select("*", folder.alias(FILE_ID))

    def table(self, name: str) -> Searchable | None:
        df = self.read(name)
        return None if df is None else Searchable.of(df, self.config(name))

    def candidates(self, name: str, table: Searchable, query: str) -> tuple[Searchable, Statistics | None]:
        """The documents that can match by their postings, and the index's statistics; the whole table if its terms don't tell."""
        _, manifest = self._manifest(name)
        needed, facts = needed_terms(table, parse_query(query)), manifest.get("facts", {})
        if needed is None or any(f not in facts for f in manifest["files"]):
            return table, None
        asked: list[tuple[str, str]] = []

        def has(field: str, token: str) -> Column:
            if (field, token) not in asked:
                asked.append((field, token))
            return F.col(f"has{asked.index((field, token))}")

        wanted = needed(has)
        # Terms that only add to scores are counted too.
        scored = text_terms(table, parse_query(query))
        if any(field.tokenizer == "raw" for field, _, _ in scored):
            return table, None
        for field, token, _ in scored:
            has(field.name, token)
        one_of = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") == t) for f, t in asked])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        found = self.spark.read.parquet(*[self._postings(name, f) for f in manifest["files"]]).where(one_of).select("field", "term", DOC_ID, folder.alias(FILE_ID))
        counts = {(r.field, r.term): r["count"] for r in found.groupBy("field", "term").count().toLocalIterator()}
        flags = [F.bool_or((F.col("field") == f) & (F.col("term") == t)).alias(f"has{k}") for k, (f, t) in enumerate(asked)]
        docs = found.groupBy(FILE_ID, DOC_ID).agg(*flags).where(wanted).select(FILE_ID, DOC_ID)
        lengths: dict[str, int] = {}
        for f in manifest["files"]:
            for field, n in facts[f]["lengths"].items():
                lengths[field] = lengths.get(field, 0) + n
        known = Statistics(sum(facts[f]["documents"] for f in manifest["files"]), lengths, counts)
        return replace(table, df=table.df.join(docs, [FILE_ID, DOC_ID], "left_semi")), known

    def search(self, name: str, query: str, limit: int = 1, ranking: bool = True, per_file: bool = False, by_postings: bool = True) -> DataFrame:
        """The best ``limit`` documents as JSON; ``per_file`` takes that many of each file group, as single-file engines do.

        Without ``by_postings`` all documents are read, which gives the same.
        """
        parse_query(query)
        config, table = self.config(name), self.table(name)
        if table is None or limit == 0:
            return self.spark.createDataFrame([], "json string")
        table, known = self.candidates(name, table, query) if by_postings else (table, None)
        if not ranking:
            return result_json(matches(table, query).limit(limit), config)
        # Equal scores need some total order: that of the documents' own text.
        hits = ranked(table, query, known).withColumn("_tie", F.xxhash64(*[f"`{f.name}`" for f in config.leaves() if f.kind != "dynamic_object"], F.to_json("_dynamic")))
        return result_json(top(hits, limit, [FILE_ID, "_tie"], FILE_ID if per_file else None), config)

    def merge(self, name: str, rows_per_file: int = 5_000_000) -> str | None:
        """Rewrite all file groups as one and swap it in by one manifest version; None if there are fewer than two."""
        old = self.files(name)
        if len(old) < 2:
            return None
        file_id = uuid.uuid4().hex
        df = self.read(name).drop(FILE_ID, DOC_ID)
        # The scan's splits are even and bounded, so that rows needn't be dealt anew; one file for all would leave it to one task.
        rows, splits = df.count(), df.rdd.getNumPartitions()
        parts, tasks = max(1, -(-rows // rows_per_file)), min(self.spark.sparkContext.defaultParallelism, rows // ROWS_PER_TASK)
        df = df.repartition(parts) if parts > splits else df.coalesce(max(parts, tasks))
        df.select(F.monotonically_increasing_id().alias(DOC_ID), "*").write.parquet(self._data(name, file_id))
        facts = self._invert(name, file_id, self.config(name))

        def swap(manifest: dict) -> dict:
            if set(old) - set(manifest["files"]):
                raise CatalogError(f"index {name!r} was merged or dropped meanwhile")
            kept = {f: its for f, its in manifest.get("facts", {}).items() if f not in old}
            retired = manifest.get("retired", []) + [[f, time.time()] for f in old]
            return manifest | {"files": [f for f in manifest["files"] if f not in old] + [file_id], "facts": kept | {file_id: facts}, "retired": retired}

        self._publish(name, swap)
        return file_id

    def vacuum(self, name: str, older_than: float = GRACE_SECONDS) -> list[str]:
        """Delete file groups that merges replaced more than ``older_than`` seconds ago, so that searches under way can end, and old manifests."""
        self.config(name)
        gone: list[str] = []

        def forget(manifest: dict) -> dict | None:
            gone[:] = [f for f, at in manifest.get("retired", []) if time.time() - at >= older_than]
            return manifest | {"retired": [r for r in manifest["retired"] if r[0] not in gone]} if gone else None

        self._publish(name, forget)
        for f in gone:
            self._fs.delete(self._path(self._data(name, f)), True)
            self._fs.delete(self._path(self._postings(name, f)), True)
        folder = f"{self.root}/{name}/manifest"
        for old in self._names(folder)[:-MANIFESTS_KEPT]:
            self._fs.delete(self._path(f"{folder}/{old}"), False)
        return gone

    def drop(self, name: str) -> None:
        """Remove an index: its configuration first, then what it held."""
        self.config(name)
        self._fs.delete(self._path(f"{self.root}/{name}/config.json"), False)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
