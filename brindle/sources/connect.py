"""Where lines come from: files, standard input, or Kafka, in batch or as a stream. All give a column ``value``."""

from __future__ import annotations

import sys
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KAFKA = "kafka://"
#: Lines of standard input that are handed over at a time.
STDIN_LINES = 100_000


class SourceError(ValueError):
    """The source can't be read like this."""


def kafka_url(url: str) -> tuple[str, str]:
    """(servers, topic) of ``kafka://servers/topic``."""
    servers, slash, topic = url.removeprefix(KAFKA).partition("/")
    if not url.startswith(KAFKA) or not slash or not servers or not topic:
        raise SourceError(f"expected {KAFKA}servers/topic, got {url!r}")
    return servers, topic


def kafka_options(url: str, stream: bool) -> dict[str, str]:
    """Options of Spark's Kafka source: all of the topic, in batch up to its present end."""
    servers, topic = kafka_url(url)
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}
    return options if stream else options | {"endingOffsets": "latest"}


def stdin_batches(spark: SparkSession, lines: IO[str] | None = None, size: int = STDIN_LINES):
    """Standard input as DataFrames of at most ``size`` lines."""
    part: list[tuple[str]] = []
    for line in lines or sys.stdin:
        part.append((line.rstrip("\r\n"),))
        if len(part) == size:
            yield spark.createDataFrame(part, "value string")
            part = []
    if part:
        yield spark.createDataFrame(part, "value string")


def connect(spark: SparkSession, source: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """A Kafka URL or a path. A folder of text files can be streamed; a single batch file can't."""
    if source.startswith(KAFKA):
        reader = (spark.readStream if stream else spark.read).format("kafka").options(**kafka_options(source, stream))
        return reader.load().where("value is not null").select(F.col("value").cast("string").alias("value"))
    if not stream:
        return spark.read.text(source)
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)
