"""Span logs watched while jobs still append to them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.spans import (
    duration_sketch,
    latency_metrics,
    percentile_columns,
    timed_spans,
)
from veilframe.sources.commits import CommitLog, Folder
from veilframe.sources.spans import parse_lines

WINDOW = "5 minutes"
LATENESS = "10 minutes"
# Batches of an updated table before they are folded into one.
FOLD_AFTER = 16


def watch_spans(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of the readable spans appended to a JSON-lines log, told apart as in batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_lines(lines).where("span IS NOT NULL").select("span.*")


def unique_spans(spans: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Spans a log delivered more than once, once. Ids are remembered until the watermark has
    passed them, so state does not grow with the log."""
    return spans.withWatermark("end_time", lateness).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def windowed_latency(
    spans: DataFrame,
    window: str = WINDOW,
    lateness: str = LATENESS,
    probabilities: Sequence[float] = (),
) -> DataFrame:
    """Latency summary for each span name and window of end time, with approximate
    percentiles on request. In append mode a window is final and its state dropped once
    the watermark passes it, so state stays bounded by the windows still open."""
    metrics = latency_metrics()
    if probabilities:
        metrics.append(duration_sketch(probabilities).alias("values"))
    timed = timed_spans(spans)
    if "EventTimeWatermark" not in spans._jdf.queryExecution().logical().toString():
        timed = timed.withWatermark("end_time", lateness)
    return (
        timed.groupBy(F.window("end_time", window).alias("window"), "name")
        .agg(*metrics)
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "name",
            "invocations",
            "avg_ms",
            "min_ms",
            "max_ms",
            *percentile_columns(F.col("values"), probabilities),
        )
    )


def append_to_table(df: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Write finished rows of a stream to Parquet, exactly once. ``drain`` stops at the
    end of the data present now."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start(path)


def replace_table(df: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep a Parquet table equal to the whole aggregate so far (complete mode). All
    windows stay in state: meant for aggregates of few rows, such as dashboards."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def upsert_table(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], drain: bool = False, fold_after: int = FOLD_AFTER
) -> StreamingQuery:
    """Keep a table of the newest row for each key. The stream runs in update mode: windows the
    watermark has passed leave its state but stay in the table, and open ones are in the table
    before they are final.

    Each batch adds what changed in it, under its own number, so a batch that is run again
    replaces itself. After ``fold_after`` batches they are folded into one; a commit switches
    between the two, and the files it replaced go with the fold after.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{number:012}-{uuid.uuid4().hex}"
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.parquet(f"{path}/{folder}")
        log = CommitLog(spark, f"{path}/_commits")

        def add(state: dict) -> dict:
            kept = [f for f in state.get("folders", []) if int(f.split("-")[0]) != number]
            return {"folders": [*kept, folder], "gone": state.get("gone", [])}

        state = log.commit(add)
        if len(state["folders"]) > fold_after:
            folded = f"{number:012}-{uuid.uuid4().hex}"
            _newest(spark, path, state["folders"], keys).write.parquet(f"{path}/{folded}")
            log.commit(lambda _: {"folders": [folded], "gone": state["folders"]})
            log.forget(1)
            for name in state["gone"]:
                Folder(spark, path).delete(name)

    writer = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def _newest(spark: SparkSession, path: str, folders: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(*[f"{path}/{folder}" for folder in folders])
    last = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [*keys, "_batch"]).select(*rows.columns)


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row for each key of a table kept by ``upsert_table``."""
    folders = CommitLog(spark, f"{path}/_commits").current().get("folders", [])
    if not folders:
        raise FileNotFoundError(f"{path} has no batch yet")
    return _newest(spark, path, folders, keys).drop("_batch")
