"""Streams whose state stays bounded, and logs rewritten while they are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilframe.operators import spans as S
from veilframe.sources import spans as log
from veilframe.sources.commits import CommitLog
from veilframe.streaming import spans as live

KEYS = ("window_start", "window_end", "name")


def write_days(spark, path, days, per_day=500, copies=1):
    """One file a day."""
    for day in range(days):
        rows = spark.range(per_day * copies).select(
            F.lit("t").alias("trace_id"),
            F.concat(F.lit(f"{day}-"), F.col("id") % per_day).alias("span_id"),
            F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("name"),
            F.timestamp_seconds(F.lit((day + 1) * 86400) + F.col("id") % per_day * 60).alias("end_time"),
            (F.col("id") % per_day + 1.0).alias("duration_ms"),
        )
        rows.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]


def test_state_is_bounded_and_table_equals_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    write_days(spark, source, 10)
    query = live.upsert_table(
        live.windowed_latency(stream(spark, source), "1 hour"), table, str(tmp_path / "c"), KEYS, drain=True, fold_after=3
    )
    query.awaitTermination()
    assert query.exception() is None
    rows = state_rows(query)
    # A day has some 9 hours of two names; without a watermark there would be ten days of them.
    assert len(rows) == 10 and max(rows) <= 2 * 18
    batch = spark.read.parquet(source).groupBy(F.window("end_time", "1 hour").alias("w"), "name")
    expected = batch.agg(*S.latency_metrics()).select("w.start", "w.end", "name", "invocations", "avg_ms", "min_ms", "max_ms")
    found = live.read_upserts(spark, table, KEYS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert len(CommitLog(spark, f"{table}/_commits").current()["folders"]) <= 3
    assert len([p for p in (tmp_path / "table").iterdir() if not p.name.startswith("_")]) <= 8


def test_batch_run_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    written = {}

    class Writer:
        def foreachBatch(self, write):  # noqa: N802
            written["write"] = write
            return self

        def outputMode(self, mode):  # noqa: N802
            assert mode == "update"
            return self

        def option(self, *_):
            return self

        def start(self):
            return None

    class Stream:
        writeStream = Writer()  # noqa: N815

    live.upsert_table(Stream(), path, "", ["k"], fold_after=2)
    batches = [[(1, 1)], [(1, 2), (2, 2)], [(1, 2), (2, 3)], [(3, 4)]]
    for number, rows in zip((0, 1, 1, 2), batches):
        written["write"](spark.createDataFrame(rows, "k int, v int"), number)
    assert {r.k: r.v for r in live.read_upserts(spark, path, ["k"]).collect()} == {1: 2, 2: 3, 3: 4}
    with pytest.raises(FileNotFoundError):
        live.read_upserts(spark, str(tmp_path / "none"), ["k"])


def test_spans_delivered_twice_count_once(spark, tmp_path):
    source = str(tmp_path / "in")
    write_days(spark, source, 4, per_day=50, copies=2)
    unique = live.unique_spans(stream(spark, source))
    query = live.append_to_table(unique.select("span_id"), str(tmp_path / "out"), str(tmp_path / "c"), drain=True)
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.distinct().count() == 200
    assert max(state_rows(query)) <= 100
    table = str(tmp_path / "table")
    latency = live.windowed_latency(live.unique_spans(stream(spark, source)), "1 day")
    query = live.append_to_table(latency, table, str(tmp_path / "c2"), drain=True)
    query.awaitTermination()
    closed = spark.read.parquet(table).agg(F.sum("invocations"), F.count_distinct("window_start")).first()
    assert tuple(closed) == (150, 3)


def append(spark, path, first, n, files):
    rows = spark.range(first, first + n).select(F.col("id").cast("string").alias("span_id"), F.lit("x").alias("name"))
    rows.repartition(files).write.mode("append").json(path)


def test_compaction_keeps_every_span(spark, tmp_path):
    path = str(tmp_path / "log")
    append(spark, path, 0, 40, 20)
    (tmp_path / "log" / "broken.json").write_text('{"span_id": "no\n\n')
    before = log.read_spans(spark, path)
    assert log.compact_log(spark, path) == len([p for p in (tmp_path / "log").iterdir() if p.suffix == ".json"])
    assert before.count() == log.read_spans(spark, path).count() == 40
    append(spark, path, 40, 10, 5)
    assert log.read_spans(spark, path).count() == 50 and log.corrupt_spans(spark, path).count() == 1
    assert log.compact_log(spark, path) == 5
    append(spark, path, 50, 1, 1)
    assert log.compact_log(spark, path) == 0
    found = log.read_spans(spark, path)
    assert sorted(int(r.span_id) for r in found.collect()) == list(range(51))
    # The first compaction's files and those it replaced are gone by the second.
    shown = [p for p in (tmp_path / "log").iterdir() if p.suffix == ".json"]
    assert len(shown) == 6 and len(list((tmp_path / "log" / "_compacted").iterdir())) == 1
    assert len(found.inputFiles()) == 2


def test_compaction_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    append(spark, path, 0, 40, 8)

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(CommitLog, "commit", lost)
    with pytest.raises(OSError):
        log.compact_log(spark, path)
    assert log.read_spans(spark, path).count() == 40
    assert log.compact_log(spark, str(tmp_path / "none")) == 0
