"""The jobs: against their SQL, over growing input, after a failure between two writes, from the command line, and on odd rows."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import code_texts, queries, site_levels

from .sqlcheck import DIR, assert_same, connection

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert_same(spark, con, queries.QUERIES[name], queries.ORACLES[name])


def expected(rows):
    config = site_levels.settings()
    return sorted(site_levels.levels(site_levels.coded(rows, config).filter("site is not null and day is not null and level is not null")).collect())


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    events, source, target = spark.read.parquet(f"{DIR}/events.parquet"), str(tmp_path / "in"), str(tmp_path / "out")
    config = site_levels.settings() | {"files_per_batch": 2}
    early = events.filter("event_id % 3 > 0")  # the rest comes late, on days that are there already, and one new day alone
    early.filter("day(ts) <> 9").repartition(3).write.parquet(source)
    with caplog.at_level(logging.INFO, "jobs.site_levels"):
        first = site_levels.run(spark, source, target, config)
    assert (first.batches, first.read, first.kept) == (2, *[early.filter("day(ts) <> 9").count()] * 2)
    assert sorted(site_levels.result(spark, target).collect()) == expected(early.filter("day(ts) <> 9"))
    assert f"read {first.read} new records" in caplog.text

    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/levels/day=2024-01-05").iterdir()}
    late = events.filter("(event_id % 3 = 0 or day(ts) = 9) and day(ts) <> 5")
    late.coalesce(1).write.mode("append").parquet(source)
    second = site_levels.run(spark, source, target, config)
    assert second.read == late.count() and second.batches == 1
    assert sorted(site_levels.result(spark, target).collect()) == expected(early.unionByName(events.filter("(event_id % 3 = 0 or day(ts) = 9) and day(ts) <> 5")).dropDuplicates(["event_id"]))
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out/levels/day=2024-01-05").iterdir()} == untouched  # only touched days are written

    third = site_levels.run(spark, source, target, config)
    assert (third.batches, third.read) == (0, 0)


def test_a_batch_that_failed_between_its_writes_is_taken_again(spark, tmp_path, monkeypatch):
    events, source, target = spark.read.parquet(f"{DIR}/events.parquet").limit(2000), str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(2).write.parquet(source)
    whole = site_levels.levels

    def broken(records):
        raise RuntimeError("lost")

    monkeypatch.setattr(site_levels, "levels", broken)
    with pytest.raises(Exception, match="lost"):
        site_levels.run(spark, source, target, site_levels.settings())
    monkeypatch.setattr(site_levels, "levels", whole)
    done = site_levels.run(spark, source, target, site_levels.settings())
    rows = spark.read.parquet(source)
    assert done.read == rows.count() and sorted(site_levels.result(spark, target).collect()) == expected(rows)


def test_records_without_site_time_or_category(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 2, 1, 5)
    rows = [(1, at, 7, "view", 1.0, None), (2, at, 7, "click", 1.0, None), (3, None, 7, "click", 1.0, None), (4, at, None, "view", 1.0, None), (5, at, 7, "other", 1.0, None), (6, at, 7, None, 1.0, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    done = site_levels.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), site_levels.settings())
    assert (done.read, done.kept) == (6, 2)
    assert [tuple(r) for r in site_levels.result(spark, str(tmp_path / "out")).collect()] == [(7, -1, 2, 2, "2024-02-01")]


def test_texts_are_coded_and_a_rerun_replaces_all(spark, tmp_path):
    config = code_texts.settings() | {"terms": {"-2": {"en": ["frost"], "und": ["frost"]}, "1": {"en": ["mild", "warm"]}}}
    rows = [
        (1, "Frost, mild\nFROST; warm mild", "en", "a"),
        (2, "frost. warm", "en", "b"),
        (3, "warm frost frost", "de", "b"),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, "a frost", None, "c"),
        (7, "warm", "en", "c"),
        (7, "frost frost", "en", "b"),
        (None, "frost", "en", "c"),
        (8, "frosty warmer é", "en", "c"),
    ]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("level", F.lit(9)).withColumn("place", F.lit(9))
    frame.write.parquet(source)
    want = [(1, "a", 1, 5, 2, 0.6, "en"), (2, "b", -2, 2, 2, 0.5, "en"), (3, "b", None, 0, 0, None, "de"), (4, "b", None, 0, 0, None, "en"), (5, None, None, 0, 0, None, "und"), (6, "c", -2, 1, 1, 1.0, "und"), (7, "b", -2, 3, 2, 2 / 3, "en"), (8, "c", None, 0, 0, None, "en")]
    for _ in range(2):
        code_texts.run(spark, source, target, config)
        assert sorted(tuple(r) for r in code_texts.result(spark, target).collect()) == want
    frame.filter("lang = 'en'").write.mode("overwrite").parquet(source)
    code_texts.run(spark, source, target, config)
    assert {r.language for r in code_texts.result(spark, target).collect()} == {"en"}


def test_a_term_of_two_levels_is_refused():
    with pytest.raises(ValueError, match="two levels"):
        code_texts.term_rows({"terms": {"0": {"en": ["a"]}, "1": {"en": ["a"]}}})


@pytest.mark.parametrize(("job", "table"), [(site_levels, "events"), (code_texts, "documents")])
def test_command_line(spark, tmp_path, monkeypatch, job, table):
    """The command line reads its config and ends the session that it got; here that is the tests' own, so its end is left out."""
    spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(str(tmp_path / "in"))
    config = tmp_path / "config.json"
    config.write_text(json.dumps(job.settings()))
    stopped = []
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(True))
    job.main(["--source", str(tmp_path / "in"), "--target", str(tmp_path / "out"), "--config", str(config)])
    assert stopped and job.result(spark, str(tmp_path / "out")).count() > 0
