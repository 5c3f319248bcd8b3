"""Column contracts of the inputs and outputs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
    VariantType,
)

# Names each logical input column goes by, in order of preference.
PATIENT_COLUMNS = {
    "id": ("Id", "id"),
    "birth_date": ("BIRTHDATE", "birthdate"),
    "death_date": ("DEATHDATE", "deathdate"),
    "gender": ("GENDER", "gender"),
    "race": ("RACE", "race"),
    "ethnicity": ("ETHNICITY", "ethnicity"),
    "city": ("CITY", "city"),
    "state": ("STATE", "state"),
    "zip": ("ZIP", "zip"),
}
ENCOUNTER_COLUMNS = {
    "id": ("Id", "id"),
    "patient": ("PATIENT", "patient", "patient_id"),
    "start": ("START", "start"),
    "stop": ("STOP", "stop"),
    "encounter_class": ("ENCOUNTERCLASS", "encounterclass"),
    "code": ("CODE", "code"),
    "description": ("DESCRIPTION", "description"),
    "cost": ("COST", "cost"),
    "notes": ("NOTES", "notes"),
    "organization": ("ORGANIZATION", "organization"),
    "provider": ("PROVIDER", "provider"),
    "payer": ("PAYER", "payer"),
}

# Column names that must never reach a de-identified table.
FORBIDDEN_COLUMNS = ("ssn", "first", "last", "drivers", "passport", "address", "phone", "email")

# Cells a CSV reader takes for missing, as pandas does by default.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SPAN_EVENT = StructType(
    [
        StructField("name", StringType()),
        StructField("timestamp", TimestampType()),
        StructField("attributes", MapType(StringType(), StringType())),
    ]
)
SPAN = StructType(
    [
        StructField("trace_id", StringType()),
        StructField("span_id", StringType()),
        StructField("parent_span_id", StringType()),
        StructField("name", StringType()),
        StructField("start_time", TimestampType()),
        StructField("end_time", TimestampType()),
        StructField("duration_ms", DoubleType()),
        StructField("status", StringType()),
        StructField("status_description", StringType()),
        StructField("attributes", MapType(StringType(), StringType())),
        StructField("events", ArrayType(SPAN_EVENT)),
    ]
)
SPAN_TYPED = StructType(
    [StructField(f.name, VariantType()) if f.name == "attributes" else f for f in SPAN.fields]
)


def resolve_columns(
    columns: Sequence[str], aliases: Mapping[str, Iterable[str]]
) -> dict[str, str | None]:
    """Actual column for each logical name, or None. Names match in exact case, and a
    table without a named id is identified by its first column."""
    present = set(columns)
    found = {
        logical: next((name for name in names if name in present), None)
        for logical, names in aliases.items()
    }
    if found.get("id") is None and columns:
        found["id"] = columns[0]
    return found
