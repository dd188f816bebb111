"""The corpus pipeline: five stages over ``documents``, each written as Parquet in the shared folder and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All
but the last return the columns of ``documents``; the last adds how often the mix takes a row.

Defined results: null and empty texts fall to the quality rules; repeated rows are one group of
near duplicates; an empty table stays empty; further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, mixing, pii, quality_rules, similar
from brindle.plans.shared import outlived, scratch, sweep
from brindle.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at a similarity of 0.8 or more of five-word shingles."""
    return similar.keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    masked = pii.redact_column(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that the mix takes, with mix_copies (how often) and mix_words (its size); columns of these names are replaced."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL has neither the fingerprints' hash nor the local parsers; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    others = outlived(spark)
    with scratch(spark) as tables:
        for name, stage in STAGES:
            before, docs = docs, tables.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.drop(before)
            sweep(spark, others)
        return tables.outlive(docs)[0]


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
