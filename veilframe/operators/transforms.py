"""De-identification of whole tables. Each is one projection: no shuffle, and the same
code serves batch and streaming DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from veilframe.functions import (
    as_identifier,
    coarsen_zip,
    date_offset,
    encounter_key,
    missing_id_key,
    note_or_default,
    parse_date,
    patient_key,
    provider_key,
    redact_email,
    redact_mrn,
    redact_numbers,
    suppress_small_zip,
    to_cost,
    to_label,
    unreadable_date,
)
from veilframe.functions.dates import SLASHED_DATES, age_group, age_in_years
from veilframe.functions.identifiers import ENCOUNTER_KEY_HEX, PATIENT_KEY_HEX
from veilframe.functions.places import MIN_ZIP3_POPULATION, ZIP_MASK, ZIP_PREFIX_LEN
from veilframe.functions.values import DEFAULT_VISIT_REASON
from veilframe.operators.joins import KEY, MISSING_KEY
from veilframe.sources.schemas import ENCOUNTER_COLUMNS, PATIENT_COLUMNS, resolve_columns

UNKNOWN = "UNKNOWN"


class _Input:
    """Logical columns of a raw table."""

    def __init__(self, df: DataFrame, aliases) -> None:
        self._names = resolve_columns(df.columns, aliases)
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def has(self, logical: str) -> bool:
        return self._names[logical] is not None

    def get(self, logical: str) -> Column:
        return F.col(f"`{self._names[logical]}`")

    def date(self, logical: str, formats: Sequence[str]) -> Column:
        """The column as a date; null if absent. Typed columns need no parsing."""
        if not self.has(logical):
            return F.lit(None).cast("date")
        return self.get(logical).cast("date") if self.is_typed(logical) else parse_date(self.get(logical), formats)

    def is_typed(self, logical: str) -> bool:
        return isinstance(self._types[self._names[logical]], DateType | TimestampType | TimestampNTZType)

    def label(self, logical: str, absent: str, null_token: str) -> Column:
        return to_label(self.get(logical), null_token) if self.has(logical) else F.lit(absent)


def deidentify_patients(
    df: DataFrame,
    salt: str,
    reference_date: dt.date | str | None = None,
    null_token: str | None = None,
    date_formats: Sequence[str] = SLASHED_DATES,
    key_hex_len: int = PATIENT_KEY_HEX,
    with_metrics: bool = False,
) -> DataFrame:
    """Ten safe columns; names, numbers, contacts and anything unlisted are left out.

    Null labels become ``UNKNOWN``; pass ``null_token="nan"`` to have them spelled the
    way a stringified missing cell is. ``with_metrics`` adds ``METRIC_COLUMNS``, from which
    the pass that writes the table counts people and unreadable dates before it drops them.
    """
    raw = _Input(df, PATIENT_COLUMNS)
    token = UNKNOWN if null_token is None else null_token
    raw_id, birth_date, age = F.col("_id"), F.col("_birth_date"), F.col("_age")
    # Parsing, hashing and ages get projections of their own: Spark keeps those apart
    # from expressions that use them more than once, so each is worked out once a row.
    parsed = df.select(
        as_identifier(raw.get("id")).alias("_id"),
        raw.date("birth_date", date_formats).alias("_birth_date"),
        raw.date("death_date", date_formats).alias("_death_date"),
        raw.label("gender", UNKNOWN, token).alias("gender"),
        raw.label("race", UNKNOWN, token).alias("race"),
        raw.label("ethnicity", UNKNOWN, token).alias("ethnicity"),
        raw.label("city", UNKNOWN, token).alias("city"),
        raw.label("state", UNKNOWN, token).alias("state"),
        (raw.get("zip") if raw.has("zip") else F.lit("")).alias("_zip"),
        *_unread(raw, ("birth_date", "death_date"), date_formats, with_metrics),
    )
    derived = parsed.withColumns(
        {"_offset": date_offset(raw_id, salt), "_age": age_in_years(birth_date, reference_date)}
    )
    return derived.select(
        _known_missing(patient_key(raw_id, salt, key_hex_len), salt, key_hex_len),
        "gender",
        "race",
        "ethnicity",
        F.date_add(birth_date, F.col("_offset")).cast("string").alias("shifted_birth_date"),
        F.date_add("_death_date", F.col("_offset")).cast("string").alias("shifted_death_date"),
        age_group(age).alias("age_bucket"),
        "city",
        "state",
        coarsen_zip(F.col("_zip")).alias("coarsened_zip"),
        *_metrics(raw_id, salt, with_metrics),
    )


# A digest of the raw id no shorter than its hash, so that people can be counted when their
# pseudonyms collide, and the number of dates in the row that are given but cannot be read.
METRIC_COLUMNS = ("_person", "_unread")


def _metrics(raw_id: Column, salt: str, wanted: bool) -> list[Column]:
    return [patient_key(raw_id, salt, 64).alias("_person"), F.col("_unread")] if wanted else []


def _unread(raw: _Input, dates: Sequence[str], formats: Sequence[str], wanted: bool) -> list[Column]:
    if not wanted:
        return []
    texts = [d for d in dates if raw.has(d) and not raw.is_typed(d)]
    cells = [unreadable_date(raw.get(d), formats).cast("bigint") for d in texts]
    return [sum(cells, F.lit(0).cast("bigint")).alias("_unread")]


def deidentify_encounters(
    df: DataFrame,
    salt: str,
    mapping: DataFrame | None = None,
    null_token: str | None = None,
    date_formats: Sequence[str] = SLASHED_DATES,
    bad_cost: str = "raise",
    key_hex_len: int = PATIENT_KEY_HEX,
    encounter_hex_len: int = ENCOUNTER_KEY_HEX,
    encounter_salt: str | None = None,
    keep_parties: bool = False,
    with_metrics: bool = False,
) -> DataFrame:
    """Nine safe columns, dates moved by the patient's own offset, notes redacted.

    Keys are computed, not looked up, so there is no join unless ``mapping`` (raw_id,
    patient_deid_key) overrides some of them. ``keep_parties`` adds the provider's
    pseudonym and the organization and payer as they are; ``with_metrics`` as for patients.
    """
    raw = _Input(df, ENCOUNTER_COLUMNS)
    token = UNKNOWN if null_token is None else null_token
    text_token = "" if null_token is None else null_token
    reason_token = DEFAULT_VISIT_REASON if null_token is None else null_token
    patient = F.col("_patient")
    null_text = F.lit(None).cast("string")

    def text(logical: str) -> Column:
        return raw.get(logical).cast("string") if raw.has(logical) else null_text

    columns = [
        as_identifier(raw.get("patient") if raw.has("patient") else F.lit("")).alias("_patient"),
        encounter_key(raw.get("id"), encounter_hex_len, encounter_salt).alias("encounter_id"),
        raw.date("start", date_formats).alias("_start"),
        raw.date("stop", date_formats).alias("_stop"),
        raw.label("encounter_class", UNKNOWN, token).alias("encounter_class"),
        raw.label("code", "", text_token).alias("clinical_code"),
        raw.label("description", "", text_token).alias("description"),
        (to_cost(raw.get("cost"), bad_cost) if raw.has("cost") else F.lit(0.0)).alias("cost"),
        note_or_default(text("notes"), raw.label("description", DEFAULT_VISIT_REASON, reason_token)).alias(
            "_note"
        ),
        *_unread(raw, ("start", "stop"), date_formats, with_metrics),
    ]
    if keep_parties:
        columns += [
            provider_key(text("provider"), salt).alias("provider_deid_key"),
            text("organization").alias("organization"),
            text("payer").alias("payer"),
        ]
    visits = df.select(*columns).withColumn("_offset", date_offset(patient, salt))
    key = patient_key(patient, salt, key_hex_len)
    if mapping is not None:
        override = unique_mapping(mapping).select(
            F.col("raw_id").alias("_patient"), F.col("patient_deid_key").alias("_known_key")
        )
        visits = visits.join(override, "_patient", "left")
        key = F.coalesce("_known_key", key)
    visits = redact_column(visits, "_note")
    parties = ["provider_deid_key", "organization", "payer"] if keep_parties else []
    return visits.select(
        "encounter_id",
        _known_missing(key, salt, key_hex_len),
        F.date_add("_start", F.col("_offset")).cast("string").alias("start_time"),
        F.date_add("_stop", F.col("_offset")).cast("string").alias("end_time"),
        "encounter_class",
        "clinical_code",
        "description",
        "cost",
        F.col("_note").alias("clinical_notes"),
        *parties,
        *_metrics(patient, salt, with_metrics),
    )


def _known_missing(key: Column, salt: str, key_hex_len: int) -> Column:
    """The key column, with a note beside its type which key stands for a missing id. Parquet
    keeps such notes, so joins can tell strangers without an id from one patient."""
    return key.alias(KEY, metadata={MISSING_KEY: missing_id_key(salt, key_hex_len)})


def redact_column(df: DataFrame, column: str) -> DataFrame:
    """``redact_notes`` of one column, a projection for each step. The nested expression
    repeats earlier steps in each branch of later ones, which beside other columns makes
    generated code too long for the JVM to compile."""
    text = F.col(column)
    df = df.withColumn(column, F.coalesce(text.cast("string"), F.lit("")))
    for step in (redact_numbers, redact_email, redact_mrn):
        df = df.withColumn(column, step(text))
    return df


def pseudonym_map(df: DataFrame, salt: str, key_hex_len: int = PATIENT_KEY_HEX) -> DataFrame:
    """(raw_id, patient_deid_key) of a raw patient table. It re-identifies people: keep it
    out of the de-identified store."""
    raw_id = _Input(df, PATIENT_COLUMNS).get("id")
    ids = df.select(as_identifier(raw_id).alias("raw_id")).distinct()
    return ids.withColumn("patient_deid_key", patient_key(F.col("raw_id"), salt, key_hex_len))


def unique_mapping(mapping: DataFrame) -> DataFrame:
    """One key for each raw id, so that a join with it never multiplies rows."""
    return mapping.groupBy("raw_id").agg(F.max("patient_deid_key").alias("patient_deid_key"))


def suppress_small_zips(
    patients: DataFrame, zip_population: DataFrame, min_population: int = MIN_ZIP3_POPULATION
) -> DataFrame:
    """Keep a ZIP prefix only where more than ``min_population`` people live.

    ``zip_population`` has (zip, population), by whole ZIP or by prefix; an area outside it
    has no population. Whether its few rows are broadcast is left to Spark's size check.
    """
    zip3 = F.substring(F.col("zip").cast("string"), 1, ZIP_PREFIX_LEN)
    areas = (
        zip_population.select(zip3.alias("_zip3"), "population")
        .where(F.length("_zip3") == ZIP_PREFIX_LEN)
        .groupBy("_zip3")
        .agg(F.sum("population").alias("_population"))
        .select(F.concat("_zip3", F.lit(ZIP_MASK)).alias("_area"), "_population")
    )
    joined = patients.join(areas, F.col("coarsened_zip") == F.col("_area"), "left")
    safe = suppress_small_zip(F.col("coarsened_zip"), F.col("_population"), min_population)
    return joined.withColumn("coarsened_zip", safe).select(*patients.columns)
