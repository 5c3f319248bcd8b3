from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import query
from veilframe.operators import spans as S
from veilframe.operators.percentiles import exact_percentiles
from veilframe.sources.schemas import SPAN
from veilframe.sources.spans import append_spans, finish_spans, read_spans
from veilframe.streaming import spans as stream


def span(n, name="work", status="OK", description="", ms=1.0, end=None, attributes=None, events=None, trace="t1"):
    at = dt.datetime(2024, 1, 1, 0, 0, n if end is None else end)
    return (trace, f"s{n}", None, name, at, at, ms, status, description, attributes or {}, events or [])


ROWS = [
    span(1, "test_activity_1", attributes={"batch": "1"}, ms=15.5),
    span(2, "test_failing_activity", "ERROR", "Simulated activity timeout", 50.0, attributes={"error.message": "x"}),
    span(3, "HandleError"),
    span(4, attributes={"error": "broken"}, ms=0.0),
    span(5, None, ms=4.0, end=4),
    span(6, attributes={"error": ""}, ms=float("nan"), trace="t2"),
    span(7, ms=3.004, trace="t2"),
    span(8, status=None, ms=None, trace="t2"),
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(ROWS, SPAN)


def test_failed_spans(log):
    assert {r.span_id for r in S.failed_spans(log).collect()} == {"s2", "s3", "s4"}
    assert S.failed_spans(log.where("span_id = 's7'")).count() == 0


def test_error_attribute_of_a_variant(spark):
    df = spark.createDataFrame(
        [("a", '{"error": false}'), ("b", '{"error": "false"}'), ("c", '{"error": 0}'), ("d", '{"error": {"x": 1}}'),
         ("e", "{}"), ("f", '{"error": null}'), ("g", '{"error": ""}'), ("h", '{"error": []}')],
        "name string, j string",
    ).select("name", F.lit("OK").alias("status"), F.parse_json("j").alias("attributes"))
    assert {r.name for r in S.failed_spans(df).collect()} == {"b", "d"}


def test_recent_spans(log):
    rows = S.recent_spans(log, 3).collect()
    assert [r.trace_id for r in rows] == ["t2"] * 3
    assert [r.duration_ms for r in rows][1:] == [3.004, None]
    assert [r.error for r in S.recent_spans(log, 7).collect()][:3] == ["Simulated activity timeout", None, "broken"]
    assert len(S.recent_spans(log, 0).collect()) == len(ROWS)
    assert S.recent_spans(log).columns == [
        "trace_id", "name", "status", "duration_ms", "start_time", "end_time", "error",
    ]
    with pytest.raises(ValueError):
        S.recent_spans(log, -1)


def test_trace_details_and_listing(log):
    assert [r.span_id for r in S.trace_details(log, "t1").collect()] == ["s1", "s2", "s3", "s4", "s5"]
    assert S.trace_details(log, "none").count() == 0
    assert S.span_listing(log).columns == ["name", "status", "duration_ms", "start_time", "end_time"]
    assert S.span_count(log).first().spans == len(ROWS)


def test_reports_name_what_is_missing(log):
    healthy = log.where("span_id = 's7'")
    assert query.to_report(S.failed_spans(healthy), query.NO_FAILURES, 100) == {"status": "ALL_HEALTHY"}
    assert query.to_report(S.trace_details(log, "none"), query.NO_SUCH_TRACE, 100) == {"status": "NOT_FOUND"}
    assert query.to_report(S.recent_spans(log.limit(0)), query.NO_SPANS, 100) == {"status": "NO_TRACES_FOUND"}
    rows = query.to_report(S.trace_details(log, "t1"), query.NO_SUCH_TRACE, 100)["rows"]
    assert [r["span_id"] for r in rows] == ["s1", "s2", "s3", "s4", "s5"]
    assert rows[0]["attributes"] == {"batch": "1"}


def test_latency_summary(log):
    rows = {r.name: tuple(r)[1:] for r in S.latency_summary(log).collect()}
    assert rows == {
        "test_activity_1": (1, 15.5, 15.5, 15.5),
        "test_failing_activity": (1, 50.0, 50.0, 50.0),
        "HandleError": (1, 1.0, 1.0, 1.0),
        "unknown": (1, 4.0, 4.0, 4.0),
        "work": (1, 3.0, 3.0, 3.0),
    }


def test_stack_traces(spark):
    at = dt.datetime(2024, 1, 1)
    events = [
        ("exception", at, {"exception.stacktrace": "line 1"}),
        ("retry", at, {}),
        ("exception", at, {"exception.stacktrace": "line 2"}),
    ]
    log = spark.createDataFrame([span(1, status="ERROR", events=events), span(2, events=events)], SPAN)
    assert [tuple(r) for r in S.stack_traces(log).collect()] == [
        ("t1", "s1", "work", "line 1"),
        ("t1", "s1", "work", "line 2"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_percentiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    data = {
        "hot": [12.5] * 700 + [rng.lognormvariate(2, 3) for _ in range(300)],
        "narrow": [100 + rng.random() / 100 for _ in range(500)],
        "wide": [10 ** rng.uniform(-300, 300) for _ in range(200)],
        "one": [7.0],
        "two": [1.0, 2.0],
    }
    rows = [(k, v) for k, values in data.items() for v in values]
    probabilities = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.percentiles for r in exact_percentiles(df, "g", "v", probabilities).collect()}
    for name, values in data.items():
        assert got[name] == pytest.approx(np.quantile(values, probabilities), rel=1e-9)


def test_latency_percentiles(spark):
    log = spark.createDataFrame([span(i % 60, ms=float(i)) for i in range(0, 101)], SPAN)
    assert tuple(S.latency_percentiles(log).first()) == ("work", 50.5, 95.05, 99.01)
    rows = S.latency_percentiles(log, [0.5, 0.999])
    assert rows.columns == ["name", "p50_ms", "p99_9_ms"]


def test_approximate_percentiles_stay_within_their_bound(spark):
    log = spark.range(50_000).select(F.lit("work").alias("name"), (F.col("id") + 1.0).alias("duration_ms"))
    accuracy = 1000
    row = S.latency_percentiles_approx(log, (0.5, 0.95), accuracy).first()
    for value, p in ((row.p50_ms, 0.5), (row.p95_ms, 0.95)):
        assert abs(value - p * 50_000) <= 50_000 / accuracy + 1


ENDED = (
    "trace_id string, span_id string, parent_span_id string, name string, start_ns long, end_ns long, "
    "status_code string, status_description string, attributes map<string,string>, "
    "events array<struct<name:string,timestamp:timestamp,attributes:map<string,string>>>"
)


def test_finished_spans_survive_the_log(spark, tmp_path):
    start = 1_704_067_200_123_456_789
    ended = spark.createDataFrame(
        [
            ("AB", "1", None, "a", start, start + 15_504_999, "OK", None, {"n": "1"}, []),
            ("ab", "2", "1", "b", None, start, "ERROR", "bad", {}, []),
            ("ab", "3", "1", "c", 0, start, "UNSET", "", None, None),
        ],
        ENDED,
    )
    append_spans(finish_spans(ended.limit(1)), str(tmp_path / "log"))
    append_spans(finish_spans(ended.where("span_id <> '1'")), str(tmp_path / "log"))
    read = read_spans(spark, str(tmp_path / "log"))
    assert read.schema == SPAN
    one, two, three = read.orderBy("span_id").collect()
    assert (one.trace_id, one.span_id) == ("ab".rjust(32, "0"), "1".rjust(16, "0"))
    assert one.duration_ms == 15.5 and one.status_description == "" and one.attributes == {"n": "1"}
    assert one.start_time == dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    assert (two.duration_ms, two.status, two.status_description, two.start_time) == (0.0, "ERROR", "bad", None)
    assert (three.duration_ms, three.status, three.start_time) == (0.0, "OK", None)


def test_unreadable_logs_are_empty(spark, tmp_path):
    assert read_spans(spark, str(tmp_path / "missing")).count() == 0
    for name, text in (("empty", ""), ("broken", '[{"span_id": "s1", "name": "a"'), ("text", "hello")):
        (tmp_path / name).write_text(text)
        assert read_spans(spark, str(tmp_path / name), array_file=True).collect() == []
    (tmp_path / "lines").write_text('{"span_id": "s1", "name": "a", "duration_ms": 2}\n{"span_id": "s2", "na\n')
    lines = read_spans(spark, str(tmp_path / "lines"))
    assert [r.span_id for r in lines.collect()] == ["s1"] and lines.count() == 1


def test_array_file(spark, tmp_path):
    (tmp_path / "log.json").write_text(
        """[
          {"trace_id": "t", "span_id": "s1", "name": "a", "start_time": "2024-01-01T00:00:00+00:00",
           "end_time": "2024-01-01T00:00:01.500000+00:00", "duration_ms": 1500.0, "status": "OK",
           "attributes": {"n": 3, "deep": {"x": 1}}, "events": []},
          {"trace_id": "t", "span_id": "s2", "name": "b", "status": "ERROR"}
        ]"""
    )
    one, two = read_spans(spark, str(tmp_path / "log.json"), array_file=True).orderBy("span_id").collect()
    assert one.attributes["n"] == "3" and json.loads(one.attributes["deep"]) == {"x": 1}
    assert one.end_time == dt.datetime(2024, 1, 1, 0, 0, 1, 500000)
    assert two.status == "ERROR"
    typed = read_spans(spark, str(tmp_path / "log.json"), array_file=True, typed_attributes=True)
    kinds = typed.where("span_id = 's1'").select(F.schema_of_variant("attributes")).first()[0]
    assert "n: BIGINT" in kinds and "x: BIGINT" in kinds
    assert [r.span_id for r in S.failed_spans(typed).collect()] == ["s2"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [span(i % 60, f"n{i % 3}", ms=float(i), status="ERROR" if i % 10 == 0 else "OK") for i in range(300)]
    log = spark.createDataFrame(rows, SPAN).withColumn(
        "end_time", F.timestamp_add("SECOND", F.hash("duration_ms") % 3000, "end_time")
    )
    path = str(tmp_path / "log")
    for part in log.randomSplit([0.5, 0.5], seed=1):
        append_spans(part, path)
    live = stream.windowed_latency(stream.watch_spans(spark, path, 1), probabilities=(0.5, 0.99))
    job = stream.replace_table(live, str(tmp_path / "latency"), str(tmp_path / "c1"), drain=True)
    job.awaitTermination()
    batch = stream.windowed_latency(read_spans(spark, path), probabilities=(0.5, 0.99))
    assert batch.columns[-2:] == ["p50_ms", "p99_ms"]
    rows = spark.read.parquet(str(tmp_path / "latency"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, batch.collect()))
    alerts = S.failed_spans(stream.watch_spans(spark, path, 1)).select("span_id", "duration_ms")
    stream.append_to_table(alerts, str(tmp_path / "alerts"), str(tmp_path / "c2"), drain=True).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "alerts")).collect()
    expected = S.failed_spans(read_spans(spark, path)).select("span_id", "duration_ms").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


def test_closed_windows_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    first = [span(i, ms=1.0) for i in range(3)]
    late = [("t", "z", None, "work", None, dt.datetime(2024, 1, 1, 6), 9.0, "OK", "", {}, [])]
    append_spans(spark.createDataFrame(first, SPAN).coalesce(1), path)
    live = stream.windowed_latency(stream.watch_spans(spark, path))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    stream.append_to_table(live, out, checkpoint, drain=True).awaitTermination()
    append_spans(spark.createDataFrame(late, SPAN).coalesce(1), path)
    stream.append_to_table(live, out, checkpoint, drain=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.window_start, r.invocations) for r in rows] == [(dt.datetime(2024, 1, 1), 3)]
