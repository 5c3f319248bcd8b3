"""Plans that have to hold at scale: what is read, shuffled, split and broadcast."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from veilframe import functions as V
from veilframe.operators import audit, joins, spans, summary, transforms
from veilframe.plans import catalog
from veilframe.sources import store
from veilframe.sources.schemas import SPAN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan as adaptive execution left it."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0]


@contextmanager
def settings(spark, **values):
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(name, None) for k, name in names.items()}
    for k, value in values.items():
        spark.conf.set(names[k], value)
    try:
        yield
    finally:
        for k, value in before.items():
            if value is None:
                spark.conf.unset(names[k])
            else:
                spark.conf.set(names[k], value)


@pytest.fixture(scope="module")
def stored(spark, salt, tmp_path_factory):
    """A store in which one patient has a third of all encounters."""
    root = str(tmp_path_factory.mktemp("plans"))
    patients = spark.range(3000).select(
        F.col("id").cast("string").alias("Id"), F.lit("1950-01-01").alias("BIRTHDATE"), F.lit("F").alias("GENDER")
    )
    owner = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    encounters = spark.range(90_000, numPartitions=12).select(
        F.col("id").cast("string").alias("Id"),
        owner.cast("string").alias("PATIENT"),
        F.lit("2024-01-10").alias("START"),
        F.lit("2.5").alias("COST"),
        F.sha2(F.col("id").cast("string"), 512).alias("NOTES"),
    )
    store.export_tables(
        {
            store.PATIENTS: transforms.deidentify_patients(patients, salt, "2026-01-01"),
            store.ENCOUNTERS: transforms.deidentify_encounters(encounters, salt),
        },
        root,
    )
    return store.open_store(spark, root, [store.PATIENTS, store.ENCOUNTERS])


def test_deidentifying_needs_no_shuffle_and_no_python(spark, salt):
    raw = spark.createDataFrame([("1", "2", "n")], "Id string, PATIENT string, NOTES string")
    for df in (transforms.deidentify_patients(raw, salt), transforms.deidentify_encounters(raw, salt)):
        assert not re.search("Exchange|Python|Join", plan(df))


def test_the_salt_is_not_shown(spark):
    raw = spark.createDataFrame([("1", "2")], "Id string, PATIENT string")
    for df in (
        transforms.deidentify_patients(raw, "k3y-9f(1)"),
        transforms.deidentify_encounters(raw, "k3y-9f(1)", encounter_salt="k3y-9f(1)"),
        raw.select(V.patient_key(F.col("Id"), "k3y-9f(1)"), V.provider_key(F.col("Id"), "k3y-9f(1)")),
    ):
        assert "k3y" not in df._jdf.queryExecution().toString()


def test_digest_is_worked_out_once_a_row(spark, salt):
    raw = spark.createDataFrame([("1", "1950-01-01")], "Id string, BIRTHDATE string")
    assert plan(transforms.deidentify_patients(raw, salt, "2026-01-01")).count("try_cast(BIRTHDATE") == 1


def test_generated_code_stays_short_enough_to_compile(spark, salt, capsys):
    """HotSpot leaves methods over 8,000 bytes to the interpreter."""
    fields = "Id string, PATIENT string, START string, STOP string, NOTES string, DESCRIPTION string, COST string"
    raw = spark.createDataFrame([], fields)
    for df in (
        transforms.deidentify_encounters(raw, salt, keep_parties=True),
        transforms.deidentify_patients(raw.withColumnRenamed("START", "BIRTHDATE"), salt, "2026-01-01"),
    ):
        df.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000


def test_hot_patient_is_split(spark, stored):
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="100KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="300KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__coalescePartitions__minPartitionSize="1KB",
    ):
        joined = joins.join_encounters(stored[store.PATIENTS], stored[store.ENCOUNTERS])
        text = final_plan(joined)
        assert "skew=true" in text
        plain = stored[store.PATIENTS].join(stored[store.ENCOUNTERS], joins.KEY, "left")
        assert "skew=true" not in final_plan(plain)
        assert joined.count() == plain.count()


def test_summary_reads_and_shuffles_little(spark, stored):
    df = summary.clinical_summary(stored[store.PATIENTS], stored[store.ENCOUNTERS])
    text = plan(df)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("clinical_notes" in s or "description" in s or "state" in s for s in schemas)
    before_shuffle = re.findall(r"Exchange hashpartitioning[^\n]*\n[^\n]*?(\w+Aggregate)", text)
    assert before_shuffle == ["HashAggregate", "HashAggregate"]


def test_statistics_do_not_expand_rows(spark, stored):
    table = summary.clinical_summary(stored[store.PATIENTS], stored[store.ENCOUNTERS])
    assert len(re.findall(r"\bExpand\b", plan(summary.cohort_statistics(table)))) <= 1
    pairs = plan(summary.cohort_statistics(table)).split("Expand")[-1]
    assert "keys=[age_bucket" in pairs and "partial_count" in pairs


def test_audit_is_one_pass(spark, stored):
    notes = {store.ENCOUNTERS: ("clinical_notes",)}
    df = audit.audit_tables({store.ENCOUNTERS: stored[store.ENCOUNTERS]}, notes, ("ssn", "phone", "email", "mrn"))
    text = plan(df)
    assert text.count("FileScan") == 1 and "ReadSchema: struct<clinical_notes:string>" in text


def test_filters_reach_the_files(spark, tmp_path):
    spark.createDataFrame([], SPAN).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert "EqualTo(trace_id,t1)" in plan(spans.trace_details(log, "t1"))
    assert "GreaterThan(duration_ms,0.0)" in plan(spans.latency_summary(log))
    assert "TakeOrderedAndProject" in plan(spans.recent_spans(log, 5))


def test_no_query_multiplies_rows_or_runs_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name, query in catalog.queries().items():
        # Those that run a whole job to make their input.
        if not name.startswith(("csv", "stored", "stream", "span_log", "corrupt", "input", "pipeline", "failure")):
            text = plan(query(spark, sf_dir))
            assert not re.search("CartesianProduct|BroadcastNestedLoop|Python|Pandas", text), name
