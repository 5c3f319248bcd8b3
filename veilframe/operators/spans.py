"""Diagnosis of span logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from veilframe.operators.percentiles import SKETCH_SIZE, exact_percentiles, merged, quantiles, sketch

UNKNOWN_NAME = "unknown"
RECENT_LIMIT = 10
PERCENTILES = (0.5, 0.95, 0.99)
APPROX_ACCURACY = 10_000
# JSON spellings of values that say "no error".
NO_ERROR_JSON = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")


def _error_attribute(spans: DataFrame) -> Column:
    if isinstance(spans.schema["attributes"].dataType, VariantType):
        return F.try_variant_get("attributes", "$.error", "string")
    return F.col("attributes")["error"]


def _has_error_attribute(spans: DataFrame) -> Column:
    """Whether ``attributes.error`` says anything. In a map every value is text, so only
    empty text means no; a variant still tells JSON false and 0 from text."""
    if isinstance(spans.schema["attributes"].dataType, VariantType):
        value = F.to_json(F.try_variant_get("attributes", "$.error", "variant"))
        return F.coalesce(~value.isin(*NO_ERROR_JSON), F.lit(False))
    return F.coalesce(F.col("attributes")["error"], F.lit("")) != ""


def recent_spans(spans: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Summaries of the last ``limit`` spans by end time, oldest first; 0 means all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit:
        spans = spans.orderBy(F.desc("end_time"), F.desc("span_id")).limit(limit)
    return span_summary(spans, "span_id").orderBy("end_time", "span_id").drop("span_id")


def span_summary(spans: DataFrame, *extra: str) -> DataFrame:
    """Seven columns naming a span, its outcome, times and error text."""
    error = F.coalesce(F.nullif("status_description", F.lit("")), _error_attribute(spans))
    return spans.select(
        "trace_id", "name", "status", "duration_ms", "start_time", "end_time", error.alias("error"), *extra
    )


def span_listing(spans: DataFrame) -> DataFrame:
    """Five columns for a table of spans."""
    return spans.select("name", "status", "duration_ms", "start_time", "end_time")


def trace_details(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace in order; none if there is no such trace."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("end_time", "span_id")


def failed_spans(spans: DataFrame) -> DataFrame:
    """Spans with an error status, an error attribute, or a name that mentions an error.
    A plain filter: works on streams as an alert."""
    failed = (
        (F.coalesce("status", F.lit("")) == "ERROR")
        | F.lower(F.coalesce("name", F.lit(""))).contains("error")
        | _has_error_attribute(spans)
    )
    return spans.where(failed)


def stack_traces(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, name, stack_trace), one row for each exception a failed span
    recorded."""
    exceptions = F.filter("events", lambda e: e["name"] == "exception")
    traces = F.transform(exceptions, lambda e: e["attributes"]["exception.stacktrace"])
    return failed_spans(spans).select(
        "trace_id", "span_id", "name", F.explode(traces).alias("stack_trace")
    )


def timed_spans(spans: DataFrame) -> DataFrame:
    """Spans that took measurable time, nameless ones under one name."""
    timed = (F.col("duration_ms") > 0) & ~F.isnan("duration_ms")
    return spans.where(timed).withColumn(
        "name", F.coalesce("name", F.lit(UNKNOWN_NAME))
    )


def latency_metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("invocations"),
        F.round(F.avg("duration_ms"), 2).alias("avg_ms"),
        F.round(F.min("duration_ms"), 2).alias("min_ms"),
        F.round(F.max("duration_ms"), 2).alias("max_ms"),
    ]


def latency_summary(spans: DataFrame) -> DataFrame:
    """Number, average, least and greatest duration for each span name."""
    return timed_spans(spans).groupBy("name").agg(*latency_metrics())


def latency_percentiles_approx(
    spans: DataFrame, probabilities: Sequence[float] = PERCENTILES, accuracy: int = APPROX_ACCURACY
) -> DataFrame:
    """Durations at the given probabilities from a mergeable sketch of bounded size,
    within 1/``accuracy`` of the rank. One light shuffle; works on streams."""
    sketch = duration_sketch(probabilities, accuracy)
    wide = timed_spans(spans).groupBy("name").agg(sketch.alias("values"))
    return wide.select("name", *percentile_columns(F.col("values"), probabilities))


def duration_sketch(probabilities: Sequence[float], accuracy: int = APPROX_ACCURACY) -> Column:
    return F.approx_percentile("duration_ms", list(probabilities), accuracy)


def latency_percentiles(spans: DataFrame, probabilities: Sequence[float] = PERCENTILES) -> DataFrame:
    """Durations at the given probabilities for each span name, exact and interpolated
    between neighbours."""
    wide = exact_percentiles(timed_spans(spans), "name", "duration_ms", probabilities)
    return wide.select("name", *percentile_columns(F.col("percentiles"), probabilities))


def latency_sketches(spans: DataFrame, window: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(window_start, window_end, name, invocations, sketch) by window of end time: kept as a
    table, they answer for any span of time without the spans. Works on streams."""
    return (
        timed_spans(spans)
        .groupBy(F.window("end_time", window).alias("window"), "name")
        .agg(F.count(F.lit(1)).alias("invocations"), sketch("duration_ms", size).alias("sketch"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "name",
            "invocations",
            "sketch",
        )
    )


def merged_percentiles(sketches: DataFrame, probabilities: Sequence[float] = PERCENTILES) -> DataFrame:
    """(name, invocations, values) of all the windows given, within ``percentiles.rank_error``."""
    whole = sketches.groupBy("name").agg(
        F.sum("invocations").alias("invocations"), merged("sketch").alias("sketch")
    )
    return whole.select("name", "invocations", quantiles("sketch", probabilities).alias("values"))


def percentile_columns(values: Column, probabilities: Sequence[float]) -> list[Column]:
    """An array of percentiles as columns named like ``p95_ms``."""
    return [
        F.round(values[i], 2).alias(f"p{p * 100:g}_ms".replace(".", "_")) for i, p in enumerate(probabilities)
    ]


def span_count(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count(F.lit(1)).alias("spans"))
