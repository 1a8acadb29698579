"""The jobs as registered queries, each run twice into one folder, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.scalar import fixed, fixed_sql
from fieldloom.session import ensure_checkpoint_dir
from jobs import code_texts, site_levels


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_site_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, config = _folder(spark, "job1"), site_levels.settings()
    for _ in range(2):
        site_levels.run(spark, f"{sf_dir}/events*.parquet", target, config)
    return site_levels.result(spark, target)


def job2_code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, config = _folder(spark, "job2"), code_texts.settings()
    for _ in range(2):
        code_texts.run(spark, f"{sf_dir}/documents.parquet", target, config)
    return code_texts.result(spark, target).withColumn("agreement", fixed(F.col("agreement")))


def _site_levels_sql(config: dict) -> str:
    level = " ".join(f"WHEN '{name}' THEN {value}" for name, value in config["levels"].items())
    return f"""
WITH r AS (SELECT {config['site']} AS site, {config['order']} AS source_order, CAST(CASE {config['category']} {level} END AS INT) AS level, strftime({config['time']}, '%Y-%m-%d') AS day FROM events),
c AS (SELECT site, day, level, count(*) AS n, min(source_order) AS first FROM r WHERE site IS NOT NULL AND day IS NOT NULL AND level IS NOT NULL GROUP BY ALL)
SELECT site, arg_min(level, struct_pack(a := -n, b := first)) AS level, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_levels, day FROM c GROUP BY site, day"""


def _code_texts_sql(config: dict) -> str:
    terms = ", ".join(f"('{language}', '{word}', {level})" for language, word, level in code_texts.term_rows(config))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS language, source, regexp_split_to_array(translate(text, '{code_texts.UPPER}', '{code_texts.LOWER}'), '{code_texts.GAP}') AS ws FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, language, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM t),
c AS (SELECT doc_id, level, count(*) AS n, min(place) AS first FROM w JOIN (VALUES {terms}) v(language, word, level) USING (language, word) GROUP BY ALL),
m AS (SELECT doc_id, arg_min(level, struct_pack(a := -n, b := first)) AS level, CAST(sum(n) AS BIGINT) AS n_mentions, count(*) AS n_levels, max(n) AS most FROM c GROUP BY doc_id),
d AS (SELECT doc_id, min(language) AS language, min(source) AS source FROM t GROUP BY doc_id)
SELECT doc_id, source, level, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_levels, 0) AS n_levels, {fixed_sql('most / n_mentions')} AS agreement, language FROM d LEFT JOIN m USING (doc_id)"""


QUERIES = {"job1_site_levels": job1_site_levels, "job2_code_texts": job2_code_texts}
ORACLES = {"job1_site_levels": _site_levels_sql(site_levels.settings()), "job2_code_texts": _code_texts_sql(code_texts.settings())}
