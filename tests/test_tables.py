"""Transforms, joins and summaries on small hand-made tables, checked by brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.functions import date_offset, patient_key
from veilframe.operators import joins, summary, transforms
from veilframe.sources.schemas import FORBIDDEN_COLUMNS, resolve_columns

PATIENT_FIELDS = "Id string, FIRST string, LAST string, SSN string, BIRTHDATE string, GENDER string, RACE string, ZIP string"
PATIENTS = [
    ("pat-1", "Alice", "Smith", "111-22-3333", "1990-06-15", "F", "white", "02138"),
    ("pat-2", "Bob", "Jones", "444-55-6666", "1925-03-20", "M", None, "90210"),
]
ENCOUNTER_FIELDS = (
    "Id string, PATIENT string, START string, STOP string, ENCOUNTERCLASS string, CODE string, "
    "DESCRIPTION string, COST string, NOTES string, PROVIDER string, PAYER string"
)
ENCOUNTERS = [
    ("E-201", "P-101", "2024-01-10T10:00:00Z", "2024-01-12T12:00:00Z", "ambulatory", "185345009",
     "Follow-up", "120.0", "Call 555-010-1234", "dr-1", "payer-1"),
    ("E-202", "P-101", "2024-02-10", "bad", None, None, None, None, None, None, None),
]


def test_patients(spark, salt):
    raw = spark.createDataFrame(PATIENTS, PATIENT_FIELDS)
    safe = transforms.deidentify_patients(raw, salt, "2026-01-01")
    assert safe.columns == [
        "patient_deid_key", "gender", "race", "ethnicity", "shifted_birth_date",
        "shifted_death_date", "age_bucket", "city", "state", "coarsened_zip",
    ]
    assert not {c.lower() for c in safe.columns} & set(FORBIDDEN_COLUMNS)
    one, two = safe.collect()
    assert tuple(one) == (
        "DEID-4EA16FF67FE2", "F", "white", "UNKNOWN", "1990-04-16", None, "30-39", "UNKNOWN", "UNKNOWN", "021XX",
    )
    assert (two.race, two.age_bucket, two.shifted_birth_date) == ("UNKNOWN", "90+", "1925-01-07")
    parity = transforms.deidentify_patients(raw, salt, "2026-01-01", null_token="nan").collect()
    assert (parity[1].race, parity[1].ethnicity) == ("nan", "UNKNOWN")


def test_lower_case_columns_and_first_column_as_id(spark, salt):
    raw = spark.createDataFrame([("pat-1", "1990-06-15")], "person string, birthdate string")
    row = transforms.deidentify_patients(raw, salt, "2026-01-01").first()
    assert (row.patient_deid_key, row.shifted_birth_date) == ("DEID-4EA16FF67FE2", "1990-04-16")
    assert (row.gender, row.coarsened_zip) == ("UNKNOWN", "XXX")


def test_upper_case_wins():
    aliases = {"id": ("Id", "id"), "race": ("RACE", "race")}
    assert resolve_columns(["x", "race", "RACE", "id"], aliases) == {"id": "id", "race": "RACE"}
    assert resolve_columns(["x", "Race"], aliases) == {"id": "x", "race": None}


def test_typed_columns_need_no_text(spark, salt):
    typed = spark.sql(
        "SELECT 7L AS Id, DATE '1990-06-15' AS BIRTHDATE, TIMESTAMP_NTZ '2020-01-01 23:00:00' AS DEATHDATE"
    )
    text = spark.sql("SELECT '7' AS Id, '1990-06-15' AS BIRTHDATE, '2020-01-01' AS DEATHDATE")
    one, two = (transforms.deidentify_patients(df, salt, "2026-01-01").collect() for df in (typed, text))
    assert one == two


def test_encounters(spark, salt):
    raw = spark.createDataFrame(ENCOUNTERS, ENCOUNTER_FIELDS)
    one, two = transforms.deidentify_encounters(raw, salt, keep_parties=True).collect()
    assert tuple(one) == (
        "ENC-3ECAA95CBE", "DEID-679C56B338E2", "2023-11-28", "2023-11-30", "ambulatory", "185345009",
        "Follow-up", 120.0, "Call [REDACTED_PHONE]", one.provider_deid_key, None, "payer-1",
    )
    assert one.provider_deid_key.startswith("PROV-")
    assert tuple(two)[2:] == (
        "2023-12-29", None, "UNKNOWN", "", "", None, "Patient presented for routine evaluation.",
        None, None, None,
    )
    parity = transforms.deidentify_encounters(raw, salt, null_token="nan").collect()[1]
    assert (parity.encounter_class, parity.clinical_code, parity.clinical_notes) == (
        "nan", "nan", "Patient presented for nan.",
    )


def test_missing_encounter_columns(spark, salt):
    row = transforms.deidentify_encounters(spark.createDataFrame([("E-201",)], "Id string"), salt).first()
    assert tuple(row) == (
        "ENC-3ECAA95CBE", "DEID-7CE4DD125201", None, None, "UNKNOWN", "", "", 0.0,
        "Patient presented for routine evaluation.",
    )


def test_null_patient_id_hashes_as_nan(spark, salt):
    raw = spark.createDataFrame([("e", None)], "Id string, PATIENT string")
    assert transforms.deidentify_encounters(raw, salt).first().patient_deid_key == "DEID-3B846EE9EBCE"


def test_intervals_survive_shifting(spark, salt):
    raw = spark.range(2000).select(
        F.col("id").cast("string").alias("Id"),
        (F.col("id") % 50).cast("string").alias("PATIENT"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("START"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") + F.col("id") % 9).cast("int"))
        .cast("string")
        .alias("STOP"),
    )
    safe = transforms.deidentify_encounters(raw, salt)
    days = F.datediff("end_time", "start_time")
    assert safe.groupBy(days.alias("d")).count().orderBy("d").collect() == raw.groupBy(
        F.datediff("STOP", "START").alias("d")
    ).count().orderBy("d").collect()


def test_mapping_overrides_without_multiplying_rows(spark, salt):
    raw = spark.createDataFrame(ENCOUNTERS, ENCOUNTER_FIELDS)
    mapping = spark.createDataFrame(
        [("P-101", "OWN-A"), ("P-101", "OWN-B"), ("P-9", "OWN-C")], "raw_id string, patient_deid_key string"
    )
    rows = transforms.deidentify_encounters(raw, salt, mapping=mapping).collect()
    assert [r.patient_deid_key for r in rows] == ["OWN-B", "OWN-B"]
    assert rows[0].start_time == "2023-11-28"
    none = transforms.deidentify_encounters(raw, salt, mapping=mapping.where("raw_id = 'P-9'")).collect()
    assert [r.patient_deid_key for r in none] == ["DEID-679C56B338E2"] * 2


def test_pseudonym_map(spark, salt):
    raw = spark.createDataFrame([("pat-1",), ("pat-1",), (None,)], "Id string")
    assert sorted(map(tuple, transforms.pseudonym_map(raw, salt).collect())) == [
        ("nan", "DEID-3B846EE9EBCE"),
        ("pat-1", "DEID-4EA16FF67FE2"),
    ]


def test_small_zip_areas_are_suppressed(spark):
    patients = spark.createDataFrame(
        [("a", "021XX"), ("b", "036XX"), ("c", "999XX"), ("d", "XXX")], "k string, coarsened_zip string"
    )
    population = spark.createDataFrame(
        [("02138", 15_000), ("02139", 5_001), ("03601", 20_000), ("bad", 1)], "zip string, population long"
    )
    safe = transforms.suppress_small_zips(patients, population).collect()
    assert [r.coarsened_zip for r in safe] == ["021XX", "000XX", "000XX", "XXX"]


PROFILE = "patient_deid_key string, gender string, race string, ethnicity string, age_bucket string"
VISIT = "encounter_id string, patient_deid_key string, start_time string, end_time string, cost double"


def skewed_tables(spark, seed):
    """A third of the visits belong to one patient, a third of the patients are copies of
    one, some patients have no visits and some visits no patient."""
    rng = random.Random(seed)
    patients = [(f"p{i}", rng.choice("MF"), "r", "e", rng.choice(["30-39", "90+"])) for i in range(40)]
    patients += [patients[0]] * 20 + [("p1", "X", "r", "e", "90+")]
    visits = []
    for i in range(600):
        key = "p0" if i % 3 == 0 else f"p{rng.randrange(10, 60)}"
        day = f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"
        cost = rng.choice([None, float("nan"), rng.randrange(1000) / 4])
        visits.append((rng.choice([None, f"e{i}", f"e{i}"]), key, day, rng.choice([None, day]), cost))
    return (
        patients,
        visits,
        spark.createDataFrame(patients, PROFILE).repartition(5),
        spark.createDataFrame(visits, VISIT).repartition(7),
    )


def clean(row):
    return tuple(None if v != v else v for v in row)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    patients, visits, p, e = skewed_tables(spark, seed)
    by_key = defaultdict(list)
    for v in visits:
        by_key[v[1]].append((v[0], *v[2:]))
    expected = Counter()
    for row in patients:
        for visit in by_key.get(row[0], [(None,) * 4]):
            expected[clean(row + visit)] += 1
    joined = joins.join_encounters(p, e)
    assert joined.columns == [c.split()[0] for c in PROFILE.split(", ")] + [
        "encounter_id", "start_time", "end_time", "cost",
    ]
    assert Counter(clean(r) for r in joined.collect()) == expected

    counts = joins.join_counts(p, e).first()
    with_id = {r[0] for r in expected if r[5] is not None}
    assert counts.merged_rows == sum(expected.values())
    assert counts.matched_rows == sum(n for r, n in expected.items() if r[5] is not None)
    assert counts.matched_patients == len(with_id)

    orphans = {k: len(v) for k, v in by_key.items() if k not in {r[0] for r in patients}}
    assert {r[0]: r[1] for r in joins.orphan_encounters(p, e).collect()} == orphans


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("dates", [True, False])
def test_summary_equals_brute_force(spark, seed, dates):
    _, _, p, e = skewed_tables(spark, seed)
    plain = (
        p.join(e, "patient_deid_key", "left")
        .groupBy(*summary.PROFILE)
        .agg(
            F.count("encounter_id"),
            F.coalesce(F.sum(F.nanvl("cost", F.lit(None).cast("double"))), F.lit(0.0)),
            F.min("start_time"),
            F.max("end_time"),
        )
    )
    fast = summary.clinical_summary(p, e, dates)
    assert Counter(map(tuple, fast.collect())) == Counter(map(tuple, plain.collect()))
    assert summary.reduced_summary(fast).columns == summary.PROFILE + summary.TOTALS


def test_summary_is_hash_aggregated(spark):
    _, _, p, e = skewed_tables(spark, 1)
    plan = summary.clinical_summary(p, e)._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_summary_of_raw_equals_summary_of_deidentified(spark, salt):
    patients = spark.createDataFrame(PATIENTS, PATIENT_FIELDS).union(
        spark.createDataFrame([PATIENTS[0]], PATIENT_FIELDS)
    )
    rows = [(f"e{i}", f"pat-{i % 4}", f"2024-01-{i % 28 + 1:02}", None, None, None, None, str(i / 4), None, None, None)
            for i in range(300)]
    encounters = spark.createDataFrame(rows, ENCOUNTER_FIELDS)
    through = summary.clinical_summary(
        transforms.deidentify_patients(patients, salt, "2026-01-01"),
        transforms.deidentify_encounters(encounters, salt),
    )
    direct = summary.clinical_summary_of_raw(patients, encounters, salt, "2026-01-01")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, through.collect()))
    assert through.columns == direct.columns


def test_summary_of_raw_merges_colliding_ids(spark, salt, monkeypatch):
    """Two raw ids with one pseudonym share their totals, as in the de-identified join."""
    def short(raw_id, salt, hex_len=1):
        return patient_key(raw_id, salt, 1)

    monkeypatch.setattr(summary, "patient_key", short)
    monkeypatch.setattr(transforms, "patient_key", short)
    patients = spark.range(40).select(F.col("id").cast("string").alias("Id"))
    encounters = spark.range(200).select(
        F.col("id").cast("string").alias("Id"),
        (F.col("id") % 40).cast("string").alias("PATIENT"),
        F.lit("2024-01-10").alias("START"),
        F.lit("1.5").alias("COST"),
    )
    direct = summary.clinical_summary_of_raw(patients, encounters, salt, "2026-01-01").collect()
    through = summary.clinical_summary(
        transforms.deidentify_patients(patients, salt, "2026-01-01"),
        transforms.deidentify_encounters(encounters, salt),
    ).collect()
    assert len(direct) <= 16
    assert sorted(map(tuple, direct)) == sorted(map(tuple, through))


def test_cohort_statistics(spark):
    table = spark.createDataFrame(
        [("a", "F", "30-39", 1, 150.0), ("b", "M", "90+", 1, 300.0)],
        "patient_deid_key string, gender string, age_bucket string, total_encounters long, total_clinical_cost double",
    )
    assert tuple(summary.cohort_statistics(table).first()) == (2, 2, 2, 2, 450.0, 225.0)
    assert tuple(summary.cohort_statistics(table.limit(0)).first()) == (0, 0, 0, None, None, None)


def test_histogram_and_cost(spark):
    _, _, p, e = skewed_tables(spark, 3)
    rows = summary.age_histogram(p).collect()
    assert sum(r.patients for r in rows) == 61
    assert [r.patients for r in rows] == sorted((r.patients for r in rows), reverse=True)
    total = summary.total_cost(e).first()
    assert total.processed_encounters == 600 and total.total_clinical_cost > 0
    assert tuple(summary.total_cost(e.limit(0)).first()) == (0, 0.0)


def test_offset_is_the_same_for_every_encounter(spark, salt):
    assert spark.range(100).select(date_offset(F.lit("P-101"), salt).alias("o")).distinct().count() == 1
