"""Codes documentary texts to ordinal levels by the terms that they mention.

    python -m jobs.code_texts --source FOLDER --target FOLDER [--config FILE]

The config gives each level's terms by language. A text's level is the one that its words mention most often, ties go to the
level mentioned first, as in the coding of records. The target has one row per document, partitioned by language (``und`` for
null): doc_id, source, level (null without a mention), n_mentions, n_levels (different ones), agreement (share of mentions of the level).

Whole texts are read. A-Z are lowered; words end at blanks and at . , ; : ! and ?. Rows with one id are one document: their
mentions count together, language and source are the least. Rows without an id are counted, logged and left out. Each run replaces the
whole output, so that a run that failed is simply run again.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import expect, relational

LOG = logging.getLogger("jobs.code_texts")
CONFIG = Path(__file__).with_suffix(".json")
CODED = "doc_id long, source string, level int, n_mentions long, n_levels long, agreement double, language string"
GAP = r"[\x20\x09-\x0D.,;:!?]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a config: its table goes to every task.
MOST_TERMS = 100_000


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def term_rows(config: dict) -> list[tuple[str, str, int]]:
    """(language, word, level); a word stands for one level of a language."""
    rows = [(language, word, int(level)) for level, by_language in config["terms"].items() for language, words in by_language.items() for word in words]
    if len({r[:2] for r in rows}) < len(rows):
        raise ValueError("a term has two levels")
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return rows


def mentions(texts: DataFrame, config: dict) -> DataFrame:
    """doc_id, level and place of every mention in texts (doc_id, language, text)."""
    terms = texts.sparkSession.createDataFrame(term_rows(config), "language string, word string, level int")
    words = texts.select("doc_id", "language", F.posexplode(F.split(F.translate("text", UPPER, LOWER), GAP)).alias("place", "word"))
    return words.join(F.broadcast(terms), ["language", "word"]).select("doc_id", "level", "place")


def coded(texts: DataFrame, config: dict) -> DataFrame:
    """One row per document of texts (doc_id, language, source, text)."""
    found = mentions(texts, config)
    per_level = found.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    mode = relational.mode_first(found, ["doc_id"], "level", "place").select("doc_id", "level", F.col("n_records").alias("n_mentions"))
    spread = per_level.groupBy("doc_id").agg(F.count("*").alias("n_levels"), F.max("n").alias("most"))
    documents = texts.groupBy("doc_id").agg(F.min("language").alias("language"), F.min("source").alias("source"))
    joined = documents.join(mode.join(spread, "doc_id"), "doc_id", "left")
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "source", "level", F.coalesce("n_mentions", none).alias("n_mentions"), F.coalesce("n_levels", none).alias("n_levels"), (F.col("most") / F.col("n_mentions")).alias("agreement"), "language")


def run(spark: SparkSession, source: str, target: str, config: dict) -> None:
    """Codes all texts of ``source`` and replaces what ``target`` holds."""
    seen, wrote = Observation(), Observation()
    rows = expect.require_columns(spark.read.parquet(source), [config[k] for k in ("id", "text", "language", "source")])
    language = F.coalesce(F.col(config["language"]), F.lit("und"))
    texts = rows.select(F.col(config["id"]).cast("long").alias("doc_id"), language.alias("language"), F.col(config["source"]).alias("source"), F.col(config["text"]).alias("text"))
    texts.select("doc_id").observe(seen, F.count("*").alias("read"), F.count("doc_id").alias("kept")).write.format("noop").mode("overwrite").save()
    LOG.info("%s: read %d texts, left out %d without an id", source, seen.get["read"], seen.get["read"] - seen.get["kept"])
    out = coded(texts.filter("doc_id is not null"), config).observe(wrote, F.count("*").alias("rows"), F.count("level").alias("coded"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("language").parquet(target)
    LOG.info("wrote %d documents, of which %d have a level, to %s", wrote.get["rows"], wrote.get["coded"], target)
    counts = relational.zero_filled_counts(result(spark, target), "level", sorted(map(int, config["terms"])))
    LOG.info("%s", relational.report(counts.orderBy("level"), "documents by level"))


def result(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(CODED).parquet(target)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--source", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    told = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("code_texts").getOrCreate()
    try:
        run(spark, told.source, told.target, settings(told.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
