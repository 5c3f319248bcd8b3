"""Rows without an id belong to no one, and are counted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilframe.operators import audit, joins, summary, transforms
from veilframe.sources import store


@pytest.fixture(scope="module")
def tables(spark):
    """200 patients and 300 visits without an id, besides 50 patients with two visits each."""
    patients = spark.range(250).select(F.when(F.col("id") >= 200, F.col("id").cast("string")).alias("Id"))
    visits = spark.range(400).select(
        F.col("id").cast("string").alias("Id"),
        F.when(F.col("id") >= 300, (F.col("id") % 50 + 200).cast("string")).alias("PATIENT"),
        F.lit("1.5").alias("COST"),
    )
    return (
        transforms.deidentify_patients(patients, "s", "2026-01-01"),
        transforms.deidentify_encounters(visits, "s"),
    )


def stored(spark, tables, root, bucketed):
    named = dict(zip((store.PATIENTS, store.ENCOUNTERS), tables))
    if bucketed:
        store.export_bucketed(named, root, joins.KEY, 2)
        for name in named:
            folder = store.table_path(spark, root, name).rsplit("/", 2)[1:]
            spark.sql(f"DROP TABLE `{'_'.join(folder)}`")
    else:
        store.export_tables(named, root)
    return tuple(store.open_store(spark, root, named).values())


def test_strangers_are_not_joined(tables):
    joined = joins.join_encounters(*tables)
    counts = joins.join_counts(*tables).first().asDict()
    assert joined.count() == counts["merged_rows"] == 200 + 100
    assert joined.where("encounter_id IS NULL").count() == 200
    assert counts["matched_rows"] == 100 and counts["matched_patients"] == 50
    assert (counts["patients_without_id"], counts["encounters_without_id"]) == (200, 300)


def test_strangers_are_joined_on_request(tables):
    joined = joins.join_encounters(*tables, link_missing=True)
    counts = joins.join_counts(*tables, link_missing=True).first().asDict()
    assert joined.count() == counts["merged_rows"] == 200 * 300 + 100
    assert counts["matched_rows"] == 60_100 and counts["patients_without_id"] == 200


@pytest.mark.parametrize("bucketed", [False, True])
def test_stored_tables_know_their_missing_key(spark, tables, tmp_path, bucketed):
    patients, visits = stored(spark, tables, str(tmp_path), bucketed)
    assert joins.join_encounters(patients, visits).count() == 300
    assert joins.join_counts(patients, visits).first().encounters_without_id == 300


def test_null_keys_are_missing_as_well(spark, tables):
    null = F.lit(None).cast("string")
    patients, visits = (t.withColumn(joins.KEY, null) for t in tables)
    assert joins.join_encounters(patients, visits).count() == 250
    assert joins.join_encounters(patients, visits, link_missing=True).count() == 250
    counts = joins.join_counts(patients, visits).first()
    assert (counts.merged_rows, counts.matched_rows, counts.encounters_without_id) == (250, 0, 400)


def test_summaries_and_orphans(tables):
    patients, visits = tables
    key = patients.schema[joins.KEY].metadata[joins.MISSING_KEY]
    of_key = F.col(joins.KEY) == key
    assert summary.clinical_summary(patients, visits).where(of_key).first().total_encounters == 0
    linked = summary.clinical_summary(patients, visits, link_missing=True).where(of_key).first()
    assert linked.total_encounters == 200 * 300
    assert [tuple(r) for r in joins.orphan_encounters(patients, visits).collect()] == [(key, 300)]
    named = dict(zip((store.PATIENTS, store.ENCOUNTERS), tables))
    report = {(r.table, r.check): r for r in audit.audit_tables(named, orphans=True).collect()}
    assert report[store.ENCOUNTERS, audit.ORPHAN_CHECK].violations == 300
    assert report[store.PATIENTS, audit.FORBIDDEN_CHECK].total_rows == 250


def test_audit_scans_each_table_once(spark, tables, tmp_path):
    patients, visits = stored(spark, tables, str(tmp_path), bucketed=False)
    named = {store.PATIENTS: patients, store.ENCOUNTERS: visits}
    found = audit.audit_tables(named, audit.ALL_TEXT, ("ssn", "phone"), oldest_birth_dates=True, orphans=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    rows = found.collect()
    texts = {(r.table, r.column) for r in rows if r.check == "ssn"}
    assert {c for t, c in texts if t == store.PATIENTS} == {
        f.name for f in patients.schema if f.dataType.typeName() == "string"
    }
    assert len(rows) == len(set((r.table, r.check, r.column) for r in rows))
