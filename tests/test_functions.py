"""Scalar functions against fixed values and against Python's own hashlib and re."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe import functions as V
from veilframe.functions import redaction
from veilframe.operators.transforms import redact_column


def values(spark, rows, expression, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


PSEUDONYMS = {
    "patient-001": ("DEID-9BAD8E5B5778", -34),
    "patient-xyz-42": ("DEID-45A0B91CDD4C", -141),
    "patient-abc-99": ("DEID-76EED589C090", 108),
    "pat-1": ("DEID-4EA16FF67FE2", -60),
    "pat-2": ("DEID-E409E295C3C3", -72),
    "P-101": ("DEID-679C56B338E2", -43),
    "P-102": ("DEID-B62ADBD292A5", 76),
    "": ("DEID-7CE4DD125201", -32),
    "nan": ("DEID-3B846EE9EBCE", 131),
    None: ("DEID-3B846EE9EBCE", 131),
}


def test_pseudonyms_and_offsets(spark, salt):
    ids = list(PSEUDONYMS)
    assert values(spark, ids, V.patient_key(F.col("v"), salt)) == [k for k, _ in PSEUDONYMS.values()]
    assert values(spark, ids, V.date_offset(F.col("v"), salt)) == [o for _, o in PSEUDONYMS.values()]


def test_zero_offset_is_replaced(spark, salt):
    assert values(spark, ["35", "738"], V.date_offset(F.col("v"), salt)) == [42, 42]


def test_offsets_match_big_integers(spark, salt):
    ids = [str(i) for i in range(5000)]

    def expected(raw_id):
        number = int(hashlib.md5(f"offset_{salt}_{raw_id}".encode()).hexdigest(), 16)
        return number % 360 - 180 or 42

    assert values(spark, ids, V.date_offset(F.col("v"), salt)) == [expected(i) for i in ids]


def test_pseudonym_options(spark, salt):
    long = hashlib.sha256(f"{salt}_pat-1".encode()).hexdigest()[:20].upper()
    assert values(spark, ["pat-1"], V.patient_key(F.col("v"), salt, 20)) == [f"DEID-{long}"]
    assert values(spark, ["E-201"], V.encounter_key(F.col("v"))) == ["ENC-3ECAA95CBE"]
    salted = hashlib.md5(f"{salt}_E-201".encode()).hexdigest()[:10].upper()
    assert values(spark, ["E-201"], V.encounter_key(F.col("v"), salt=salt)) == [f"ENC-{salted}"]
    keys = values(spark, ["pat-1", None], V.provider_key(F.col("v"), salt))
    assert keys == ["PROV-4EA16FF67FE2", None]


def test_keys_do_not_depend_on_partitioning(spark, salt):
    df = spark.range(1000).select(V.patient_key(F.col("id"), salt).alias("k"))
    assert sorted(df.collect()) == sorted(df.repartition(13).collect())


def test_key_of_a_join_is_not_hashed_twice(spark, salt):
    left = spark.range(10).select(V.patient_key(F.col("id"), salt).alias("k"))
    assert left.schema["k"].nullable is False


@pytest.mark.parametrize(
    ("raw_id", "date", "shifted"),
    [
        ("P-101", "1980-04-12", "1980-02-29"),
        ("P-102", "1932-02-10", "1932-04-26"),
        ("P-101", "2024-01-10", "2023-11-28"),
        ("pat-1", "1990-06-15", "1990-04-16"),
        ("pat-2", "1925-03-20", "1925-01-07"),
        ("P-101", "2024-01-10T10:00:00Z", "2023-11-28"),
        ("P-101", "2024-01-10T23:30:00-05:00", "2023-11-28"),
        ("P-101", "2024-01-10 10:00:00.125", "2023-11-28"),
        ("P-101", "not a date", None),
        ("P-101", "2024-02-30", None),
        ("P-101", "2024-01-10 and more", None),
        ("P-101", "", None),
        ("P-101", None, None),
    ],
)
def test_shift_date(spark, salt, raw_id, date, shifted):
    days = V.date_offset(F.lit(raw_id), salt)
    assert values(spark, [date], V.shift_date(F.col("v"), days)) == [shifted]


def test_slashed_dates(spark):
    texts = ["04/12/1980", "4/5/1980 10:30", "13/01/1980", "1980/4/12", "4/31/1980", "1/2/3"]
    dates = values(spark, texts, V.shift_date(F.col("v"), F.lit(0)))
    assert dates == ["1980-04-12", "1980-04-05", "1980-01-13", "1980-04-12", None, None]
    assert values(spark, texts, V.shift_date(F.col("v"), F.lit(0), ())) == [None] * len(texts)


def test_further_date_formats(spark):
    shifted = V.shift_date(F.col("v"), F.lit(1), ["MM/dd/yyyy", "dd.MM.yyyy"])
    assert values(spark, ["12/31/1999", "31.12.1999", "1999-12-31", "31-12"], shifted) == [
        "2000-01-01",
        "2000-01-01",
        "2000-01-01",
        None,
    ]


AGES = {
    "2015-05-10": "0-17",
    "1985-05-10": "40-49",
    "1930-01-01": "90+",
    "1910-01-01": "90+",
    "1936-01-01": "90+",
    "1936-01-02": "80-89",
    "2007-06-01": "10-19",
    "2008-01-01": "10-19",
    "2008-01-02": "0-17",
    "1996-02-29": "20-29",
    "2030-01-01": "0-17",
    "": "UNKNOWN",
    "soon": "UNKNOWN",
    None: "UNKNOWN",
}


def test_age_bucket(spark):
    assert values(spark, list(AGES), V.age_bucket(F.col("v"), "2026-01-01")) == list(AGES.values())


def test_age_on_leap_days(spark):
    for reference, bucket in (("2026-02-28", "20-29"), ("2026-03-01", "30-39")):
        assert values(spark, ["1996-02-29"], V.age_bucket(F.col("v"), reference)) == [bucket]


def test_age_today_by_default(spark):
    assert values(spark, ["1900-01-01"], V.age_bucket(F.col("v"))) == ["90+"]


def test_coarsen_zip(spark):
    zips = ["02138", "90210", "123", "12", "", None]
    assert values(spark, zips, V.coarsen_zip(F.col("v"))) == ["021XX", "902XX", "123XX", "XXX", "XXX", "XXX"]


NOTES = {
    "Patient John Doe with SSN 123-45-6789 and phone (555) 019-2834, email john.doe@example.com, "
    "MRN: MRN-99887.": "Patient John Doe with SSN [REDACTED_SSN] and phone ([REDACTED_PHONE], email "
    "[REDACTED_EMAIL], MRN: [REDACTED_MRN].",
    "MRN: 1234567890": "MRN: [REDACTED_PHONE]",
    "id: 42": "MRN: [REDACTED_MRN]",
    "valid: 7": "valid: 7",
    "Patient ID:\n A-1": "MRN: [REDACTED_MRN]",
    "call +1 555-010-1234": "call +[REDACTED_PHONE]",
    "١٢٣-45-6789": "[REDACTED_SSN]",
    "MRN: X1": "MRN: [REDACTED_MRN]",
    "mrn:\x1cX1": "MRN: [REDACTED_MRN]",
    "a.b@c.d|": "a.b@c.d|",
    "nothing here": "nothing here",
    "": "",
    None: "",
}


def test_redact_notes(spark):
    assert values(spark, list(NOTES), V.redact_notes(F.col("v"))) == list(NOTES.values())


PYTHON = [
    (re.compile(redaction.SSN), redaction.SSN_MASK),
    (re.compile(redaction.PHONE), redaction.PHONE_MASK),
    (re.compile(redaction.EMAIL), redaction.EMAIL_MASK),
    (re.compile(redaction.MRN, re.IGNORECASE), redaction.MRN_MASK),
]


def python_redaction(text):
    for pattern, mask in PYTHON:
        text = pattern.sub(mask, text)
    return text


def test_redacting_twice_changes_nothing(spark):
    once = V.redact_notes(F.col("v"))
    assert values(spark, list(NOTES), V.redact_notes(once)) == list(NOTES.values())


PIECES = st.sampled_from(
    ["123-45-6789", "555", "-", " ", "(", ")", "+1", "0100", "4567", ".", "a@b.co", "@", "x", "MRN:", "id:",
     "Patient ID: ", "ID", ":", "Z9", "é", "٣", "[REDACTED_SSN]", "1234567890", "\n", "_"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=8).map("".join), min_size=200, max_size=200))
def test_redaction_equals_python_both_ways(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    once = V.redact_notes(F.col("v"))
    rows = df.withColumns({"once": once, "stepwise": F.col("v")})
    rows = redact_column(rows, "stepwise").withColumn("twice", V.redact_notes(F.col("once")))
    for row in rows.collect():
        assert row.once == row.stepwise == python_redaction(row.v)
        assert row.twice == python_redaction(row.once)


@pytest.mark.parametrize("check", ["ssn", "phone", "email", "mrn"])
def test_matches_pii(spark, check):
    pattern = dict(zip(["ssn", "phone", "email", "mrn"], [p for p, _ in PYTHON]))[check]
    texts = [t or "" for t in NOTES]
    found = values(spark, texts, V.matches_pii(F.col("v"), check))
    assert found == [bool(pattern.search(t)) for t in texts]
    assert values(spark, [None], V.matches_pii(F.col("v"), check)) == [False]


def test_single_redactions_keep_null(spark):
    for redact in (V.redact_ssn, V.redact_phone, V.redact_email, V.redact_mrn):
        assert values(spark, [None, "plain"], redact(F.col("v"))) == [None, "plain"]


def test_values(spark):
    assert values(spark, ["x", None], V.to_label(F.col("v"), "nan")) == ["x", "nan"]
    assert values(spark, ["12.5", "NaN", None], V.to_cost(F.col("v"))) == [12.5, None, None]
    assert values(spark, ["12.5", "free"], V.to_cost(F.col("v"), "null")) == [12.5, None]
    note = V.note_or_default(F.col("v"), F.lit("Flu"))
    assert values(spark, ["x", "", None], note) == ["x", *["Patient presented for Flu."] * 2]
    assert values(spark, ["y" * 600], V.preview(F.col("v"), 500)) == ["y" * 500]
    with pytest.raises(Exception, match="not a number"):
        values(spark, ["free"], V.to_cost(F.col("v")))
    with pytest.raises(ValueError, match="bad_cost"):
        V.to_cost(F.col("v"), "skip")
