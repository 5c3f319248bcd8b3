from __future__ import annotations

import pytest

from veilframe.operators import audit, query
from veilframe.sources import store

PATIENTS = [
    ("DEID-1111", "F", "white", "non-hispanic", "30-39"),
    ("DEID-2222", "M", "asian", "non-hispanic", "90+"),
]
ENCOUNTERS = [
    ("ENC-001", "DEID-1111", "2026-01-01", "2026-01-02", 150.0, "Followup visit"),
    ("ENC-002", "DEID-2222", "2026-02-01", "2026-02-01", 300.0, "Consultation"),
]


@pytest.fixture
def tables(spark):
    return {
        store.PATIENTS: spark.createDataFrame(
            PATIENTS, "patient_deid_key string, gender string, race string, ethnicity string, age_bucket string"
        ),
        store.ENCOUNTERS: spark.createDataFrame(
            ENCOUNTERS,
            "encounter_id string, patient_deid_key string, start_time string, end_time string, cost double, clinical_notes string",
        ),
    }


@pytest.fixture
def views(tables):
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def test_clean_tables_are_compliant(tables):
    report = audit.compliance_report(audit.audit_tables(tables))
    assert report == {
        "compliant": True,
        "total_patients": 2,
        "total_encounters": 2,
        "tables_audited": ["deid_encounters", "deid_patients"],
        "findings": [audit.ALL_CLEAR],
    }


def test_every_row_is_audited(spark, tables):
    notes = tables[store.ENCOUNTERS]
    many = spark.range(3000).selectExpr("concat('ENC-', id) AS encounter_id", "'DEID-9' AS patient_deid_key",
        "CASE WHEN id = 2999 THEN 'x 123-45-6789' WHEN id = 2998 THEN 'a@b.org' END AS clinical_notes")
    found = audit.audit_tables({store.ENCOUNTERS: many, store.PATIENTS: tables[store.PATIENTS]}, orphans=True)
    violations = {(r.check, r.column): r.violations for r in found.collect() if r.violations}
    assert violations == {
        ("ssn", "clinical_notes"): 1,
        ("email", "clinical_notes"): 1,
        ("orphan_encounter", "patient_deid_key"): 3000,
    }
    assert audit.compliance_report(audit.audit_tables({store.ENCOUNTERS: notes}))["compliant"]


def test_forbidden_columns_and_options(spark):
    leaky = spark.createDataFrame(
        [("1", "a", "90+", "1930-01-01")], "SSN string, Phone string, age_bucket string, shifted_birth_date string"
    )
    report = audit.compliance_report(audit.audit_tables({"t": leaky}, oldest_birth_dates=True))
    assert not report["compliant"] and len(report["findings"]) == 3
    assert audit.compliance_report(audit.audit_tables({"t": leaky.limit(0)}))["findings"] == [
        "t: column SSN holds raw identifiers",
        "t: column Phone holds raw identifiers",
    ]


def test_collisions_and_missing_ids(spark, salt):
    ids = spark.createDataFrame([(str(i % 200),) for i in range(1000)] + [(None,)] * 3, "Id string")
    full = audit.pseudonym_collisions(ids, "Id", salt).first()
    assert tuple(full) == (201, 201, 0)
    short = audit.pseudonym_collisions(ids, "Id", salt, 1).first()
    assert short.pseudonyms <= 16 and short.raw_ids == 201 and short.colliding_ids > 0
    assert tuple(audit.missing_patient_ids(ids, "Id").first()) == (3, 1003)


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE x",
        "select 1;drop table x",
        "WITH a AS (SELECT 1)\nINSERT INTO t SELECT 1",
        "create or replace table t as select 1",
        "COPY t TO 'x.csv'",
        "INSERT INTO t VALUES (1)",
        "truncate table t",
        "SELECT 1) ; DROP TABLE x; --",
        "SET spark.sql.ansi.enabled = false",
        "BEGIN DROP TABLE x; END",
        "FROM deid_patients INSERT INTO t SELECT *",
        "SELECT reflect('java.lang.System', 'exit', '1')",
        "SELECT java_method ('java.lang.System', 'exit', '1')",
        "show tables; drop table x",
        "",
    ],
)
def test_writes_are_refused(spark, views, text):
    assert "error" in query.run_sql(spark, text, 200)


@pytest.mark.parametrize(
    "text",
    [
        "select ' update ' as s",
        "SELECT COUNT(*) AS n FROM deid_patients;",
        "WITH a AS (SELECT 1 AS x) SELECT * FROM a ORDER BY x -- drop table t",
        "SELECT 'drop table x; delete from y' AS s /* insert into */",
        "SHOW TABLES",
        "describe deid_patients",
        "VALUES (1), (2)",
    ],
)
def test_reads_are_answered(spark, views, text):
    assert query.run_sql(spark, text, 200)["rows"]


def test_updated_at_is_a_column(spark):
    spark.sql("SELECT 1 AS updated_at").createOrReplaceTempView("t_updated")
    assert query.run_sql(spark, "select updated_at from t_updated", 5) == {
        "rows": [{"updated_at": 1}],
        "truncated": False,
    }


def test_results_are_whole_and_records_say_what_is_left(spark):
    spark.range(1000).createOrReplaceTempView("many")
    assert query.read_only_sql(spark, "SELECT * FROM many").count() == 1000
    found = query.run_sql(spark, "SELECT * FROM many ORDER BY id DESC", 5)
    assert [r["id"] for r in found["rows"]] == [999, 998, 997, 996, 995] and found["truncated"]
    assert not query.run_sql(spark, "SELECT * FROM many", 1000)["truncated"]
    assert len(query.to_report(spark.table("many"), query.NO_FAILURES, 2000)["rows"]) == 1000


@pytest.mark.parametrize(
    "text",
    [
        "SELECT reflect/*x*/('java.util.UUID', 'randomUUID')",
        "SELECT * FROM (SELECT 1 WHERE (SELECT try_reflect('java.util.UUID', 'randomUUID')) IS NOT NULL)",
        "SELECT * FROM parquet.`/tmp`",
        "EXPLAIN EXTENDED SELECT 1",
    ],
)
def test_ways_around_the_guard(spark, text):
    assert "error" in query.run_sql(spark, text, 5)


def test_literals_are_no_calls(spark):
    assert query.run_sql(spark, "SELECT 'to reflect (again)' AS s", 5)["rows"] == [{"s": "to reflect (again)"}]


def test_engine_errors_are_returned(spark):
    assert "error" in query.run_sql(spark, "SELECT * FROM no_such_table", 5)


def test_table_schemas(spark, views):
    rows = {(r.table, r.column_name): (r.column_type, r.null) for r in query.table_schemas(spark).collect()}
    assert rows["deid_encounters", "cost"] == ("double", "YES")
    assert rows["deid_patients", "age_bucket"] == ("string", "YES")
