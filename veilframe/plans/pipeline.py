"""The whole job: validate, de-identify, summarise, store, and log each stage."""

from __future__ import annotations

import base64
import datetime as dt
import time
import traceback
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.identifiers import PATIENT_KEY_HEX
from veilframe.operators.joins import KEY, join_counts
from veilframe.operators.summary import age_histogram, clinical_summary, reduced_summary
from veilframe.operators.transforms import (
    METRIC_COLUMNS,
    deidentify_encounters,
    deidentify_patients,
    pseudonym_map,
    suppress_small_zips,
)
from veilframe.sources.spans import append_spans, finish_spans
from veilframe.sources.store import (
    ENCOUNTERS,
    PATIENTS,
    SUMMARY,
    SUMMARY_EXPORT,
    open_store,
    with_start_year,
    write_table,
)
from veilframe.sources.tabular import InputNotFound, read_encounters, read_patients, validate_inputs

FAILURE_SPAN = "pipeline_failure"
# The span attribute that holds a run's sketch of its patients, as text.
PEOPLE_SKETCH = "unique_patients_sketch"

_TEXT_MAP = "map<string,string>"
_EVENTS = f"array<struct<name:string,timestamp:timestamp,attributes:{_TEXT_MAP}>>"


def _text_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for item in values.items() for part in item]).cast(_TEXT_MAP)


def safe_message(error: Exception) -> str:
    """What went wrong, without quoting data. Spark's messages repeat the offending cell,
    so only the kind of error and its condition are kept; a missing input is named, as its
    message holds nothing but the path the caller gave."""
    if isinstance(error, InputNotFound):
        return str(error)
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return f"{type(error).__name__}: {condition}" if condition else type(error).__name__


def stack_trace(error: Exception) -> str:
    """Where an error came from, the way Python prints it but for the message."""
    calls = "".join(traceback.format_tb(error.__traceback__))
    return f"Traceback (most recent call last):\n{calls}{type(error).__name__}"


class RunLog:
    """Appends one span for each finished stage of a run to a JSON-lines log."""

    def __init__(self, spark: SparkSession, path: str | None) -> None:
        self._spark = spark
        self._path = path
        self.run_id = uuid.uuid4().hex

    def record(
        self,
        name: str,
        start_ns: int,
        attributes: Mapping[str, Any],
        error: Exception | None = None,
    ) -> float:
        """Log a span that ends now and return its duration in milliseconds."""
        end_ns = time.time_ns()
        attributes = {k: str(v) for k, v in attributes.items()}
        events = F.array()
        if error is not None:
            message = safe_message(error)
            attributes["error.message"] = message
            detail = {
                "exception.type": type(error).__name__,
                "exception.message": message,
                "exception.stacktrace": stack_trace(error),
            }
            events = F.array(
                F.struct(
                    F.lit("exception"), F.timestamp_micros(F.lit(end_ns // 1000)), _text_map(detail)
                )
            )
        if self._path is not None:
            # Literals over one generated row: no Python worker has to start.
            ended = self._spark.range(1, numPartitions=1).select(
                F.lit(self.run_id).alias("trace_id"),
                F.lit(uuid.uuid4().hex[:16]).alias("span_id"),
                F.lit(None).cast("string").alias("parent_span_id"),
                F.lit(name).alias("name"),
                F.lit(start_ns).alias("start_ns"),
                F.lit(end_ns).alias("end_ns"),
                F.lit("OK" if error is None else "ERROR").alias("status_code"),
                F.lit("" if error is None else safe_message(error)).alias("status_description"),
                _text_map(attributes).alias("attributes"),
                events.cast(_EVENTS).alias("events"),
            )
            append_spans(finish_spans(ended), self._path)
        return round((end_ns - start_ns) / 1e6, 2)


@dataclass
class PipelineResult:
    run_id: str
    processed_patients: int = 0
    unique_patients: int = 0
    unique_pseudonyms: int = 0
    age_buckets: dict[str, int] = field(default_factory=dict)
    unreadable_dates: int = 0
    processed_encounters: int = 0
    total_clinical_cost: float = 0.0
    merged_rows: int = 0
    matched_rows: int = 0
    matched_patients: int = 0
    paths: dict[str, str] = field(default_factory=dict)
    stage_ms: dict[str, float] = field(default_factory=dict)


# Registers of a sketch of distinct values, as a power of two: estimates are off by more than
# ``DISTINCT_ERROR``, three times the standard error, once in some 400 runs.
DISTINCT_REGISTERS = 12
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_REGISTERS / 2)


def _write_counted(
    df: DataFrame, root: str, table: str, partition_by: Sequence[str], *metrics
) -> tuple[str, dict[str, Any]]:
    """Write a table and count it in the same pass. The metrics sit in the writing stage
    itself, whose tasks count once even if they are run again; columns that are there for
    the metrics only are not written."""
    observed = Observation(table)
    path = write_table(df, root, table, partition_by, (observed, metrics), METRIC_COLUMNS)
    return path, observed.get


def distinct_sketch(column: str, name: str) -> Column:
    """A HyperLogLog sketch as a metric of a write."""
    return F.hll_sketch_agg(column, F.lit(DISTINCT_REGISTERS)).alias(name)


def _estimates(spark: SparkSession, seen: Mapping[str, Any], *names: str) -> list[int]:
    sketches = [F.hll_sketch_estimate(F.lit(bytes(seen[name]))) if seen[name] else F.lit(0) for name in names]
    return list(spark.range(1).select(*[s.alias(n) for s, n in zip(sketches, names)]).first())


def distinct_over_runs(spans: DataFrame, metric: str) -> DataFrame:
    """One row: runs that logged a sketch of this name, and how many distinct values all of
    them saw together, within ``DISTINCT_ERROR``. Runs over the same people count them once."""
    sketch = F.unbase64(F.col("attributes")[metric])
    return spans.where(F.col("attributes")[metric].isNotNull()).agg(
        F.count_distinct("trace_id").alias("runs"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).alias("distinct_values"),
    )


def _sketch_text(seen: Mapping[str, Any]) -> str:
    return base64.b64encode(bytes(seen["people"] or b"")).decode()


def write_logged(spark: SparkSession, patients: DataFrame, root: str, table: str, span_log: str) -> None:
    """Replace a table of patients made ``with_metrics`` and log a span with their sketch."""
    log, start_ns = RunLog(spark, span_log), time.time_ns()
    rows = F.count(F.lit(1)).alias("rows")
    _, seen = _write_counted(patients, root, table, (), rows, distinct_sketch("_person", "people"))
    log.record(f"write_{table}", start_ns, {"rows": seen["rows"], PEOPLE_SKETCH: _sketch_text(seen)})


def run_pipeline(
    spark: SparkSession,
    patients_path: str,
    encounters_path: str,
    output_dir: str,
    salt: str,
    span_log: str | None = None,
    reference_date: dt.date | str | None = None,
    partitioned: bool = False,
    zip_population: DataFrame | None = None,
    patient_options: Mapping[str, Any] | None = None,
    encounter_options: Mapping[str, Any] | None = None,
    key_hex_len: int = PATIENT_KEY_HEX,
    exact_distinct: bool = False,
) -> PipelineResult:
    """De-identify two CSV inputs into a store of four Parquet tables.

    The wide tables are written first, in one map-only pass each; everything later
    reads the few columns it needs back from Parquet, so neither hashing nor redaction
    is ever repeated. ``partitioned`` lays patients and summaries out by age bucket and
    encounters by year; ``key_hex_len`` is the width of patient keys in all tables;
    ``zip_population`` hides ZIP prefixes of small areas. People and pseudonyms are counted by
    sketches in the pass that writes them, exactly (two more passes) with ``exact_distinct``;
    the people's sketch is logged, so that ``distinct_over_runs`` can add runs up. A failing
    stage leaves an error span and the tables and spans of the stages before it, and the
    error is raised again.
    """
    log = RunLog(spark, span_log)
    result = PipelineResult(log.run_id)

    def stage(name: str, work: Callable[[], dict[str, Any]]) -> None:
        start_ns = time.time_ns()
        try:
            outcome = work()
        except Exception as error:
            failed = {"failed_stage": name, "error_type": type(error).__name__, "run_id": log.run_id}
            log.record(name, start_ns, {"error": safe_message(error)}, error)
            log.record(FAILURE_SPAN, start_ns, failed, error)
            raise
        result.stage_ms[name] = log.record(name, start_ns, outcome)

    def validate() -> dict[str, Any]:
        check = validate_inputs(spark, patients_path, encounters_path)
        return vars(check)

    def patients() -> dict[str, Any]:
        raw = read_patients(spark, patients_path)
        df = deidentify_patients(
            raw, salt, reference_date, key_hex_len=key_hex_len, with_metrics=True, **(patient_options or {})
        )
        if zip_population is not None:
            df = suppress_small_zips(df, zip_population)
        path, seen = _write_counted(
            df,
            output_dir,
            PATIENTS,
            ["age_bucket"] if partitioned else [],
            F.count(F.lit(1)).alias("rows"),
            F.sum("_unread").alias("unread"),
            distinct_sketch("_person", "people"),
            distinct_sketch(KEY, "pseudonyms"),
        )
        stored = open_store(spark, output_dir, [PATIENTS])[PATIENTS]
        result.paths[PATIENTS] = path
        result.processed_patients = seen["rows"]
        # Fewer pseudonyms than raw ids mean that keys collide: raise key_hex_len.
        result.unique_patients, result.unique_pseudonyms = _estimates(spark, seen, "people", "pseudonyms")
        if exact_distinct:
            result.unique_patients = pseudonym_map(raw, salt).count()
            result.unique_pseudonyms = stored.select(KEY).distinct().count()
        result.unreadable_dates += seen["unread"] or 0
        result.age_buckets = {r["age_bucket"]: r["patients"] for r in age_histogram(stored).collect()}
        return {
            "processed_patients": result.processed_patients,
            "unique_patients": result.unique_patients,
            "unique_pseudonyms": result.unique_pseudonyms,
            "age_buckets": result.age_buckets,
            "unreadable_dates": seen["unread"] or 0,
            PEOPLE_SKETCH: _sketch_text(seen),
        }

    def encounters() -> dict[str, Any]:
        df = deidentify_encounters(
            read_encounters(spark, encounters_path),
            salt,
            key_hex_len=key_hex_len,
            with_metrics=True,
            **(encounter_options or {}),
        )
        if partitioned:
            df = with_start_year(df)
        path, seen = _write_counted(
            df,
            output_dir,
            ENCOUNTERS,
            ["start_year"] if partitioned else [],
            F.count(F.lit(1)).alias("rows"),
            F.sum("cost").alias("cost"),
            F.sum("_unread").alias("unread"),
        )
        result.paths[ENCOUNTERS] = path
        result.processed_encounters = seen["rows"]
        result.total_clinical_cost = seen["cost"] or 0.0
        result.unreadable_dates += seen["unread"] or 0
        return {
            "processed_encounters": result.processed_encounters,
            "total_clinical_cost": result.total_clinical_cost,
            "unreadable_dates": seen["unread"] or 0,
        }

    def merge() -> dict[str, Any]:
        stored = open_store(spark, output_dir, [PATIENTS, ENCOUNTERS])
        counts = join_counts(stored[PATIENTS], stored[ENCOUNTERS]).first().asDict()
        result.merged_rows = counts["merged_rows"]
        result.matched_rows = counts["matched_rows"]
        result.matched_patients = counts["matched_patients"]
        return counts

    def export() -> dict[str, Any]:
        stored = open_store(spark, output_dir, [PATIENTS, ENCOUNTERS])
        summary = clinical_summary(stored[PATIENTS], stored[ENCOUNTERS])
        by_age = ["age_bucket"] if partitioned else []
        result.paths[SUMMARY] = write_table(summary, output_dir, SUMMARY, by_age)
        written = open_store(spark, output_dir, [SUMMARY])[SUMMARY]
        reduced = reduced_summary(written)
        result.paths[SUMMARY_EXPORT] = write_table(reduced, output_dir, SUMMARY_EXPORT, by_age)
        open_store(spark, output_dir, [SUMMARY_EXPORT])
        return result.paths

    for name, work in (
        ("validate_inputs", validate),
        ("deidentify_patients", patients),
        ("deidentify_encounters", encounters),
        ("merge", merge),
        ("export", export),
    ):
        stage(name, work)
    return result
