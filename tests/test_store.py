"""The store under failing, racing and repeated writes, and its bucketed layout."""

from __future__ import annotations

import re
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.operators import joins, summary
from veilframe.sources import commits, store


def numbers(spark, n, start=0):
    return spark.range(start, start + n).withColumn("part", F.col("id") % 3)


def opened(spark, root, *tables):
    return store.open_store(spark, str(root), tables)


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path)
    store.write_table(numbers(spark, 10), root, "t")
    # Nine of ten tasks finish their files before the last one fails.
    dies = spark.range(0, 100, 1, 10).withColumn(
        "part", F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(1)
    )
    with pytest.raises(Exception, match="lost"):
        store.write_table(dies, root, "t")
    with pytest.raises(Exception, match="lost"):
        store.export_tables({"u": numbers(spark, 5), "t": dies}, root)
    assert opened(spark, root, "t")["t"].count() == 10
    with pytest.raises(FileNotFoundError):
        opened(spark, root, "u")


def test_reader_keeps_its_snapshot(spark, tmp_path):
    root = str(tmp_path)
    store.export_tables({"t": numbers(spark, 10), "u": numbers(spark, 20)}, root)
    before = opened(spark, root, "t", "u")
    store.write_table(before["t"].unionAll(numbers(spark, 5, 100)), root, "t", ["part"])
    assert before["t"].count() == 10
    assert {t: df.count() for t, df in opened(spark, root, "t", "u").items()} == {"t": 15, "u": 20}


def test_vacuum_keeps_what_is_in_force(spark, tmp_path):
    root = str(tmp_path)
    for n in (1, 2, 3):
        store.write_table(numbers(spark, n), root, "t")
    store.write_table(numbers(spark, 9), root, "u")
    assert store.vacuum(spark, root) == []
    gone = store.vacuum(spark, root, older_than_hours=-1)
    assert len(gone) == 2 and all(not (tmp_path / g).exists() for g in gone)
    assert {t: df.count() for t, df in opened(spark, root, "t", "u").items()} == {"t": 3, "u": 9}
    assert len(list((tmp_path / "_commits").glob("*.json"))) == 1


def test_racing_writers_lose_nothing(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    errors = []

    def write(name):
        try:
            for i in range(5):
                commits.CommitLog(spark, str(tmp_path / "log")).commit(lambda state: {**state, f"{name}{i}": i})
        except Exception as error:
            errors.append(error)

    writers = [threading.Thread(target=write, args=(name,)) for name in "abc"]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    assert not errors
    assert log.current() == {f"{name}{i}": i for name in "abc" for i in range(5)}


def test_abandoned_commit_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "ABANDONED_SECONDS", 0.2)
    log = commits.CommitLog(spark, str(tmp_path))
    log.commit(lambda _: {"a": 1})
    (tmp_path / f"{2:020}.json").write_text('{"a": 2, "b')
    assert log.current() == {"a": 1}
    assert log.commit(lambda state: {**state, "c": 3}) == {"a": 1, "c": 3}
    assert log.current() == {"a": 1, "c": 3}
    log.forget(1)
    assert [p.name for p in tmp_path.glob("*.json")] == [f"{3:020}.json"]


def test_empty_log_and_store(spark, tmp_path):
    assert commits.CommitLog(spark, str(tmp_path / "none")).current() == {}
    assert store.vacuum(spark, str(tmp_path / "none")) == []
    assert store.export_tables({}, str(tmp_path)) == {}


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """One patient has a third of all visits."""
    root = str(tmp_path_factory.mktemp("bucketed"))
    patients = spark.range(900).selectExpr(
        "concat('DEID-', id % 890) AS patient_deid_key", "'F' AS gender", "'x' AS race", "'y' AS ethnicity",
        "concat(id % 7, '0s') AS age_bucket")
    visits = spark.range(9000).selectExpr(
        "concat('ENC-', id) AS encounter_id",
        "concat('DEID-', CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END) AS patient_deid_key",
        "CAST(date_add(DATE '2024-01-01', CAST(id % 300 AS INT)) AS STRING) AS start_time", "'2025-01-01' AS end_time",
        "CAST(id % 11 AS DOUBLE) AS cost")
    tables = {store.PATIENTS: patients, store.ENCOUNTERS: visits}
    store.export_bucketed(tables, root, joins.KEY, 4, files_per_bucket=3)
    return root, tables


def test_summary_of_bucketed_tables_needs_no_shuffle(spark, bucketed):
    root, tables = bucketed
    found = store.open_store(spark, root, tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = summary.clinical_summary(found[store.PATIENTS], found[store.ENCOUNTERS])
        rows = sorted(map(tuple, df.collect()))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = summary.clinical_summary(tables[store.PATIENTS], tables[store.ENCOUNTERS])
    assert "Exchange" in expected._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted(map(tuple, expected.collect()))


def test_buckets_are_known_to_other_sessions(spark, bucketed):
    root, tables = bucketed
    path = store.table_path(spark, root, store.ENCOUNTERS)
    name = "_".join(path.rsplit("/", 2)[1:])
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    found = store.open_store(spark, root, tables)
    counts = found[store.ENCOUNTERS].groupBy(joins.KEY).count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert found[store.ENCOUNTERS].count() == 9000


def test_hot_key_is_written_by_several_tasks(spark, bucketed):
    root, _ = bucketed
    files = Path(store.table_path(spark, root, store.ENCOUNTERS)).glob("*.parquet")
    buckets = [int(re.search(r"_(\d{5})\.", f.name)[1]) for f in files]
    assert set(buckets) == {0, 1, 2, 3}
    by_file = [spark.read.parquet(str(f)).where("patient_deid_key = 'DEID-7'").count()
               for f in Path(store.table_path(spark, root, store.ENCOUNTERS)).glob("*.parquet")]
    assert sum(n > 0 for n in by_file) == 3 and max(by_file) < 0.5 * sum(by_file)
