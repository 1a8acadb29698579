"""A training-data pipeline: quality rules, quality classifier, near-duplicate removal, mixing, packing.

Each stage reads what the one before wrote; all but the last give the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import factor_machine, jaccard_join, line_rules, mixing, packing
from fieldloom.llm.common import table
from fieldloom.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines and the documents that fail; the recorded length follows the text.

    Null, empty and blank texts go, as do all with fewer words than the rules ask for; repeated rows are judged each by
    itself, so all of them stay or go; long texts are judged whole; an empty table gives an empty table; other columns, of
    whatever name, are kept as they are.
    """
    kept = line_rules.clean_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold; the machine is fitted on labelled rows of the whole table.

    Null, empty and blank texts are scored by their statistics, a score at the threshold stays; repeated rows score alike;
    long texts are scored whole; an empty table gives an empty table; other columns, of whatever name, are kept.
    """
    machine = factor_machine.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return factor_machine.keep_good(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group.

    Rows without words or without an id link with nothing and stay; rows that share the least id all stay; long texts are
    compared whole; an empty table gives an empty table; other columns, of whatever name, are kept.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix takes, repeated as often as it takes it, in the order in which it takes it.

    Rows without words are never taken; a null source is a source; rows that share id, source and size share what is taken
    of them; equal keys go by id and size; an empty table gives an empty table; other columns, of whatever name, are kept.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and offset.

    A null or empty text is one piece with the end token alone; long texts are cut; repeated rows are packed each by itself;
    an empty table gives an empty table; only the id and the text are read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier's and the tokenizer's results have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result written as Parquet in the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldloom-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
