from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.operators.spans import failed_spans, latency_summary, stack_traces
from veilframe.operators.transforms import deidentify_encounters
from veilframe.plans import pipeline
from veilframe.plans.pipeline import run_pipeline
from veilframe.session import shared_folder
from veilframe.sources import spans, store, tabular

PATIENTS_CSV = """Id,FIRST,LAST,SSN,BIRTHDATE,GENDER,RACE,ETHNICITY,ZIP
P-101,Jane,Doe,111-22-3333,1980-04-12,F,white,non-hispanic,02138
P-102,John,Smith,444-55-6666,1932-02-10,M,NA,non-hispanic,90210
"""
ENCOUNTERS_CSV = """Id,PATIENT,START,STOP,ENCOUNTERCLASS,CODE,DESCRIPTION,COST,NOTES
E-201,P-101,2024-01-10T10:00:00Z,2024-01-10T12:00:00Z,ambulatory,185345009,Follow-up,120.0,"Patient said ""fine"",
call 555-010-1234."
"""


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "patients.csv").write_text(PATIENTS_CSV)
    (tmp_path / "encounters.csv").write_text(ENCOUNTERS_CSV)
    return str(tmp_path / "patients.csv"), str(tmp_path / "encounters.csv")


@pytest.mark.parametrize("partitioned", [False, True])
def test_end_to_end(spark, salt, inputs, tmp_path, partitioned):
    out, log = str(tmp_path / "store"), str(tmp_path / "log")
    result = run_pipeline(
        spark, *inputs, out, salt, span_log=log, reference_date="2026-01-01", partitioned=partitioned
    )
    assert (result.processed_patients, result.unique_pseudonyms) == (2, 2)
    assert result.age_buckets == {"40-49": 1, "90+": 1}
    assert (result.processed_encounters, result.total_clinical_cost) == (1, 120.0)
    assert (result.merged_rows, result.matched_rows, result.matched_patients) == (2, 1, 1)
    assert list(result.paths) == [store.PATIENTS, store.ENCOUNTERS, store.SUMMARY, store.SUMMARY_EXPORT]
    summary = {r.patient_deid_key: r for r in spark.table(store.SUMMARY).collect()}
    one, two = summary["DEID-679C56B338E2"], summary["DEID-B62ADBD292A5"]
    assert (one.total_encounters, one.total_clinical_cost, one.first_encounter_time) == (1, 120.0, "2023-11-28")
    assert (two.total_encounters, two.total_clinical_cost, two.first_encounter_time) == (0, 0.0, None)
    note = spark.table(store.ENCOUNTERS).first().clinical_notes
    assert note == 'Patient said "fine",\ncall [REDACTED_PHONE].'
    assert spark.table(store.PATIENTS).where("race = 'UNKNOWN'").count() == 1
    logged = spans.read_spans(spark, log)
    assert {r.name for r in logged.collect()} == set(result.stage_ms) and len(result.stage_ms) == 5
    assert failed_spans(logged).count() == 0
    assert latency_summary(logged).count() == 5


def test_running_again_replaces_the_store(spark, salt, inputs, tmp_path):
    out = str(tmp_path / "store")
    for _ in range(2):
        result = run_pipeline(spark, *inputs, out, salt, reference_date="2026-01-01")
    assert result.processed_patients == 2
    assert spark.read.parquet(store.table_path(spark, out, store.PATIENTS)).count() == 2


def test_missing_input_is_logged_and_raised(spark, salt, inputs, tmp_path):
    log = str(tmp_path / "log")
    missing = str(tmp_path / "none.csv")
    with pytest.raises(tabular.InputNotFound, match="Encounters input not found"):
        run_pipeline(spark, inputs[0], missing, str(tmp_path / "store"), salt, span_log=log)
    rows = {r.name: r for r in failed_spans(spans.read_spans(spark, log)).collect()}
    assert set(rows) == {"validate_inputs", "pipeline_failure"}
    assert rows["pipeline_failure"].attributes["failed_stage"] == "validate_inputs"
    assert rows["pipeline_failure"].attributes["error_type"] == "InputNotFound"
    with pytest.raises(tabular.InputNotFound, match="Patients input not found"):
        tabular.validate_inputs(spark, missing, inputs[1])


def test_failing_stage_keeps_what_came_before(spark, salt, inputs, tmp_path):
    (tmp_path / "encounters.csv").write_text(ENCOUNTERS_CSV.replace("120.0", "free"))
    log, out = str(tmp_path / "log"), str(tmp_path / "store")
    with pytest.raises(Exception, match="not a number"):
        run_pipeline(spark, *inputs, out, salt, span_log=log)
    logged = spans.read_spans(spark, log)
    status = {r.name: r.status for r in logged.collect()}
    assert status == {
        "validate_inputs": "OK",
        "deidentify_patients": "OK",
        "deidentify_encounters": "ERROR",
        "pipeline_failure": "ERROR",
    }
    assert all("Traceback" in r.stack_trace for r in stack_traces(logged).collect())
    assert spark.read.parquet(store.table_path(spark, out, store.PATIENTS)).count() == 2
    tolerant = run_pipeline(spark, *inputs, out, salt, encounter_options={"bad_cost": "null"})
    assert tolerant.total_clinical_cost == 0.0


def test_validation_reports_missing_columns(spark, inputs):
    check = tabular.validate_inputs(spark, *inputs)
    assert check.patients_columns[0] == "Id" and "NOTES" in check.encounters_columns
    assert check.missing_patients == ["DEATHDATE", "CITY", "STATE"]
    assert check.missing_encounters == ["ORGANIZATION", "PROVIDER", "PAYER"]


def test_cells_stay_text_and_missing_ones_are_null(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Id,ZIP,RACE\n007,02138,NA\nnan,,x\n")
    one, two = tabular.read_patients(spark, str(tmp_path / "p.csv")).collect()
    assert tuple(one) == ("007", "02138", None) and tuple(two) == (None, None, "x")


def test_rows_with_other_numbers_of_cells(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Id,PATIENT,NOTES\nE1,P1,seen, then sent home\nE2,P2,fine\n")
    with pytest.raises(Exception, match="more or fewer cells"):
        tabular.read_encounters(spark, str(path)).select("Id").collect()
    good = tabular.read_text_cells(spark, str(path), False, bad_rows="drop")
    assert [r.Id for r in good.collect()] == ["E2"] and good.count() == 1
    assert tabular.count_bad_rows(spark, str(path)).first().bad_rows == 1


def test_numbered_headers_are_no_case_clash(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Id,x1,X2\n1,2,3\n")
    assert tabular.read_patients(spark, str(tmp_path / "n.csv")).columns == ["Id", "x1", "X2"]


def test_columns_differing_in_case(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Id,id,x2\n1,2,3\n")
    with pytest.raises(ValueError, match="differ only in case"):
        tabular.read_patients(spark, str(tmp_path / "p.csv"))
    (tmp_path / "q.csv").write_text("x0,x1,Id\n1,2,3\n")
    assert tabular.read_patients(spark, str(tmp_path / "q.csv")).columns == ["x0", "x1", "Id"]


def test_small_areas_in_the_job(spark, salt, inputs, tmp_path):
    population = spark.createDataFrame([("021", 30_000)], "zip string, population long")
    run_pipeline(spark, *inputs, str(tmp_path / "s"), salt, zip_population=population)
    zips = {r.coarsened_zip for r in spark.table(store.PATIENTS).collect()}
    assert zips == {"021XX", "000XX"}


def test_files_with_other_column_order_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Id,ZIP\n1,02138\n")
    (tmp_path / "in" / "b.csv").write_text("ZIP,Id\n02138,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tabular.read_patients(spark, str(tmp_path / "in")).collect()


def test_partitioned_store(spark, salt, tmp_path):
    raw = spark.range(500).select(
        F.col("id").cast("string").alias("Id"),
        F.lit("7").alias("PATIENT"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 3).cast("int")).cast("string").alias("START"),
    )
    encounters = store.with_start_year(deidentify_encounters(raw, salt))
    path = store.write_table(encounters, str(tmp_path), store.ENCOUNTERS, ["start_year"])
    opened = store.open_store(spark, str(tmp_path), [store.ENCOUNTERS])[store.ENCOUNTERS]
    assert opened.count() == 500
    plan = opened.where("start_year = 2021")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(start_year" in plan
    assert path == store.table_path(spark, str(tmp_path), store.ENCOUNTERS)
    assert len(list(Path(path).glob("start_year=2021/*.parquet"))) == 1


def test_catalog_tables(spark):
    store.save_as_tables({"saved_rows": spark.range(3)})
    store.save_as_tables({"saved_rows": spark.range(5)})
    assert spark.table("saved_rows").count() == 5


def test_transform_runs_on_streams(spark, salt, inputs, tmp_path):
    schema = tabular.read_encounters(spark, inputs[1]).schema
    live = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    query = (
        deidentify_encounters(live.csv(str(tmp_path / "enc*.csv")), salt)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    batch = deidentify_encounters(tabular.read_encounters(spark, inputs[1]), salt)
    assert spark.read.parquet(str(tmp_path / "out")).collect() == batch.collect()


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_unreadable_dates_are_counted(spark, salt, inputs, tmp_path):
    (tmp_path / "patients.csv").write_text(PATIENTS_CSV.replace("1932-02-10", "long ago"))
    (tmp_path / "encounters.csv").write_text(ENCOUNTERS_CSV.replace("2024-01-10T12:00:00Z", "later"))
    log = str(tmp_path / "log")
    for partitioned in (False, True):
        done = run_pipeline(spark, *inputs, str(tmp_path / "s"), salt, span_log=log, partitioned=partitioned)
        assert done.unreadable_dates == 2
    stages = {r.name: r.attributes for r in spans.read_spans(spark, log).collect()}
    assert stages["deidentify_patients"]["unreadable_dates"] == "1"
    assert stages["deidentify_encounters"]["unreadable_dates"] == "1"
    stored = store.open_store(spark, str(tmp_path / "s"), [store.PATIENTS, store.ENCOUNTERS])
    assert not any(c.startswith("_") for df in stored.values() for c in df.columns)


def test_people_are_counted_in_the_writing_pass(spark, salt, tmp_path):
    """Estimates within their bound, and people of several runs counted once."""
    for part in range(2):
        rows = spark.range(part * 2000, part * 2000 + 6000).selectExpr("CAST(id AS STRING) AS Id", "'F' AS GENDER")
        rows.unionAll(rows).write.option("header", True).csv(str(tmp_path / f"p{part}"))
        (tmp_path / "e.csv").write_text(ENCOUNTERS_CSV)
        inputs = (str(tmp_path / f"p{part}"), str(tmp_path / "e.csv"))
        done = run_pipeline(spark, *inputs, str(tmp_path / "s"), salt, span_log=str(tmp_path / "log"))
        assert done.processed_patients == 12_000
        assert abs(done.unique_patients - 6000) <= pipeline.DISTINCT_ERROR * 6000
        assert abs(done.unique_pseudonyms - 6000) <= pipeline.DISTINCT_ERROR * 6000
    whole = pipeline.distinct_over_runs(spans.read_spans(spark, str(tmp_path / "log")), pipeline.PEOPLE_SKETCH).first()
    assert whole.runs == 2 and abs(whole.distinct_values - 8000) <= pipeline.DISTINCT_ERROR * 8000
    exact = run_pipeline(spark, *inputs, str(tmp_path / "s"), salt, exact_distinct=True)
    assert (exact.unique_patients, exact.unique_pseudonyms) == (6000, 6000)
    none = pipeline.distinct_over_runs(spans.read_spans(spark, str(tmp_path / "nothing")), pipeline.PEOPLE_SKETCH)
    assert tuple(none.first()) == (0, 0)
