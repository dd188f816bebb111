"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table in ``<sf_dir>/<name>.parquet``, a file or a folder, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core that rows are dealt to: a core that is slower, or comes late, then gets fewer.
TASKS_PER_CORE = 4


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores, where few files would leave them to fewer: for rows that cost far more to work on than to read.

    A table has splits by its bytes, of which those without the start of a row group are empty: a few splits a core don't tell that all have rows.
    """
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
