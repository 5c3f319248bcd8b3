"""Percentiles of values that lie close together, and sketches over windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import percentiles, spans

PROBABILITIES = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def expected(values):
    return [float(x) for x in np.quantile(np.array(values), PROBABILITIES)]


def check(spark, values, **options):
    df = spark.createDataFrame([("g", float(v)) for v in values], "name string, v double")
    found = percentiles.exact_percentiles(df, "name", "v", PROBABILITIES, **options).first()
    assert found.percentiles == pytest.approx(expected(values), rel=1e-14)


def test_many_values_near_one_duration(spark, monkeypatch):
    """200,000 distinct values within a millionth of each other: no task orders more than the
    bound, which the ranges that are ordered in the end show."""
    ordered = []
    inside = percentiles._inside

    def watched(counted, ranges, group, value):
        ordered.append((ranges.select("low", "values").collect(), inside(counted, ranges, group, value)))
        return ordered[-1][1]

    monkeypatch.setattr(percentiles, "_inside", watched)
    n = 200_000
    df = spark.range(n).select(
        F.lit("work").alias("name"), (F.lit(1000.0) + (F.col("id") * 7919 % n) * 5e-9).alias("v")
    )
    values = np.array([r.v for r in df.select("v").collect()])
    assert len(np.unique(values)) == n
    found = percentiles.exact_percentiles(df, "name", "v", PROBABILITIES, most_ordered=1000).first()
    assert found.percentiles == pytest.approx(expected(values), rel=1e-15)
    ranges, rows = ordered[-1]
    assert len(ordered) >= 2 and max(r["values"] for r in ranges) <= 1000
    assert rows.groupBy("low").count().agg(F.max("count")).first()[0] <= 1000


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    for values in (
        rng.lognormal(3, 4, 3000),
        np.repeat(rng.random(20) + 5, rng.integers(1, 200, 20)),
        np.concatenate([[5e-324, 1e-310, 1e308, 1.7e308], 1 + rng.random(2000) * 1e-12]),
        [7.5],
        [1.0, np.nextafter(1.0, 2)] * 30,
    ):
        check(spark, values, most_ordered=3, parts=4)


def test_groups_apart_and_infinity(spark):
    rows = [("a", 1.0), ("a", float("inf")), ("a", float("inf")), (None, 2.0), ("b", 3.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "name string, v double")
    found = {r.name: r.percentiles for r in percentiles.exact_percentiles(df.where("name IS NOT NULL"), "name", "v", (0.5, 1.0)).collect()}
    assert found == {"a": [float("inf")] * 2, "b": [4.0, 5.0]}
    assert percentiles.exact_percentiles(df.limit(0), "name", "v", (0.5,)).collect() == []


def test_sketches_of_windows_merge(spark):
    n = 50_000
    log = spark.range(n).select(
        F.timestamp_seconds(F.col("id") * 60).alias("end_time"),
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("name"),
        ((F.col("id") * 7919 % n) + 1.0).alias("duration_ms"),
    )
    windows = spans.latency_sketches(log, "1 day")
    assert windows.count() == 2 * -(-n // 1440)
    wanted = (0.01, 0.5, 0.95, 0.99)
    truth = {}
    for r in log.groupBy("name").agg(F.sort_array(F.collect_list("duration_ms")).alias("v")).collect():
        truth[r.name] = np.array(r.v)
    found = spans.merged_percentiles(windows, wanted).collect()
    assert {r.name: r.invocations for r in found} == {"a": n - n // 5, "b": n // 5}
    for r in found:
        ranks = np.searchsorted(truth[r.name], r["values"], "right") / len(truth[r.name])
        assert np.abs(ranks - wanted).max() <= percentiles.rank_error()
    assert windows.agg(F.max(F.length("sketch"))).first()[0] < 100_000
