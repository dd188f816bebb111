"""Tables written to the folder that the driver and all executors share.

They cut lineage: a lost executor costs a re-read, not a recomputation. The
folder is the one that the cluster names in ``spark.checkpoint.dir``; only a
local master, where driver and executors are one process, may do without.

``scratch`` is the scope of one computation: its tables are deleted when it
ends, but for those that its result still reads, which ``sweep`` deletes later.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables that results may still read, by application.
_KEPT: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a cluster it must be configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return _LOCAL[app]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The tables of one scope."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows once as Parquet in the shared folder and return the table read back."""
        path = f"{shared_dir(self.spark)}/brindle/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        gone = [path for path, table in self.paths.items() if any(table is t for t in tables)]
        for path in gone:
            del self.paths[path]
        _delete(self.spark, gone)

    def outlive(self, *tables: DataFrame) -> tuple[DataFrame, ...]:
        """Let tables stay after the scope's end, until ``sweep``."""
        for path in [path for path, table in self.paths.items() if any(table is t for t in tables)]:
            del self.paths[path]
            _KEPT.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        return tables

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``write`` a table that outlives the scope."""
        return self.outlive(self.write(df, name))[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A scope for tables; what isn't kept is deleted at its end, and shuffles that only they needed may go."""
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        _delete(spark, list(tables.paths))
        tables.paths.clear()
        # Spark deletes a shuffle's files when the driver's collector finds it unused.
        spark._jvm.System.gc()


def outlived(spark: SparkSession) -> frozenset[str]:
    """The tables that have outlived their scopes so far."""
    return frozenset(_KEPT.get(spark.sparkContext.applicationId, ()))


def sweep(spark: SparkSession, but: frozenset[str] = frozenset()) -> None:
    """Delete what outlived its scope, once the results that read it are written; ``but`` stays."""
    kept = _KEPT.get(spark.sparkContext.applicationId, [])
    _delete(spark, [path for path in kept if path not in but])
    kept[:] = [path for path in kept if path in but]


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """A table of its own that is kept until ``sweep``."""
    return Scratch(df.sparkSession).keep(df, name)
