"""Per-patient summaries and cohort statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import as_identifier, date_offset, patient_key, to_cost
from veilframe.functions.dates import SLASHED_DATES
from veilframe.functions.identifiers import PATIENT_KEY_HEX
from veilframe.operators.joins import KEY, has_id
from veilframe.operators.transforms import _Input, deidentify_patients
from veilframe.sources.schemas import ENCOUNTER_COLUMNS

PROFILE = [KEY, "gender", "race", "ethnicity", "age_bucket"]
TOTALS = ["total_encounters", "total_clinical_cost"]
SPAN_OF_CARE = ["first_encounter_time", "last_encounter_time"]


def _totals(encounters: DataFrame, dates: bool) -> DataFrame:
    def moment(column: str):
        return F.col(column).cast("date") if dates else F.col(column)

    return encounters.groupBy(KEY).agg(
        F.count("encounter_id").alias("total_encounters"),
        F.sum(F.nanvl("cost", F.lit(None).cast("double"))).alias("total_clinical_cost"),
        F.min(moment("start_time")).cast("string").alias("first_encounter_time"),
        F.max(moment("end_time")).cast("string").alias("last_encounter_time"),
    )


def _attach(patients: DataFrame, totals: DataFrame, link_missing: bool) -> DataFrame:
    profiles = patients.groupBy(*PROFILE).agg(F.count(F.lit(1)).alias("copies"))
    copies = F.col("copies")
    if not link_missing:
        totals = totals.where(has_id(patients, totals))
    return profiles.join(totals, KEY, "left").select(
        *PROFILE,
        F.coalesce(F.col("total_encounters") * copies, F.lit(0)).alias("total_encounters"),
        F.coalesce(F.col("total_clinical_cost") * copies, F.lit(0.0)).alias("total_clinical_cost"),
        *SPAN_OF_CARE,
    )


def clinical_summary(
    patients: DataFrame, encounters: DataFrame, dates: bool = True, link_missing: bool = False
) -> DataFrame:
    """Encounter count, cost and first and last dates for each patient profile.

    Both sides are aggregated before they meet: encounters to one row a key, patients
    to one row a profile with its number of copies, by which the totals are multiplied
    as the join would have repeated them. Partial aggregation runs ahead of each
    shuffle, so neither a busy patient nor a pile of duplicates reaches one task whole.

    Times are the ``yyyy-MM-dd`` texts of de-identified encounters. They are compared as
    dates, which Spark aggregates by hashing, where text would have to be sorted first;
    pass ``dates=False`` for tables with other texts. Encounters without an id belong to no
    patient, unless ``link_missing`` gives them to the patients without one.
    """
    return _attach(patients, _totals(encounters, dates), link_missing)


def clinical_summary_of_raw(
    raw_patients: DataFrame,
    raw_encounters: DataFrame,
    salt: str,
    reference_date: dt.date | str | None = None,
    null_token: str | None = None,
    date_formats: Sequence[str] = SLASHED_DATES,
    bad_cost: str = "raise",
    key_hex_len: int = PATIENT_KEY_HEX,
    link_missing: bool = False,
) -> DataFrame:
    """``clinical_summary`` of the de-identified tables, straight from the raw ones.

    All encounters of a raw id get the same key and the same shift, so they are
    aggregated by raw id first and hashed once for each patient instead of once for
    each encounter. The second aggregation joins raw ids that share a pseudonym.
    """
    raw = _Input(raw_encounters, ENCOUNTER_COLUMNS)
    patient = raw.get("patient") if raw.has("patient") else F.lit("")
    by_id = (
        raw_encounters.select(
            as_identifier(patient).alias("raw_id"),
            raw.date("start", date_formats).alias("start_date"),
            raw.date("stop", date_formats).alias("stop_date"),
            (to_cost(raw.get("cost"), bad_cost) if raw.has("cost") else F.lit(0.0)).alias("cost"),
        )
        .groupBy("raw_id")
        .agg(
            F.count(F.lit(1)).alias("encounters"),
            F.sum("cost").alias("cost"),
            F.min("start_date").alias("first_date"),
            F.max("stop_date").alias("last_date"),
        )
    )
    offset = date_offset(F.col("raw_id"), salt)
    totals = (
        by_id.select(
            patient_key(F.col("raw_id"), salt, key_hex_len).alias(KEY),
            "encounters",
            "cost",
            F.date_add("first_date", offset).alias("first_date"),
            F.date_add("last_date", offset).alias("last_date"),
        )
        .groupBy(KEY)
        .agg(
            F.sum("encounters").alias("total_encounters"),
            F.sum("cost").alias("total_clinical_cost"),
            F.min("first_date").cast("string").alias("first_encounter_time"),
            F.max("last_date").cast("string").alias("last_encounter_time"),
        )
    )
    patients = deidentify_patients(
        raw_patients, salt, reference_date, null_token, date_formats, key_hex_len=key_hex_len
    )
    return _attach(patients, totals, link_missing)


def reduced_summary(summary: DataFrame) -> DataFrame:
    """The seven exported columns of a clinical summary."""
    return summary.select(*PROFILE, *TOTALS)


def cohort_statistics(summary: DataFrame) -> DataFrame:
    """One row of totals over a clinical summary.

    Age buckets and genders are few, so rows are first combined for each pair; counting
    distinct values over the rows themselves would triple them in the shuffle.
    """
    cost = F.col("total_clinical_cost")
    pairs = summary.groupBy("age_bucket", "gender").agg(
        F.count(F.lit(1)).alias("patients"),
        F.sum("total_encounters").alias("encounters"),
        F.sum(cost).alias("cost"),
        F.count(cost).alias("costed"),
    )
    return pairs.agg(
        F.coalesce(F.sum("patients"), F.lit(0)).alias("total_patients"),
        F.count_distinct("age_bucket").alias("age_bucket_count"),
        F.count_distinct("gender").alias("gender_count"),
        F.sum("encounters").alias("aggregated_encounters"),
        F.round(F.sum("cost"), 2).alias("aggregated_clinical_cost"),
        F.round(F.try_divide(F.sum("cost"), F.sum("costed")), 2).alias("avg_cost_per_patient"),
    )


def age_histogram(patients: DataFrame) -> DataFrame:
    """Patients for each age bucket, largest first."""
    counts = patients.groupBy("age_bucket").agg(F.count(F.lit(1)).alias("patients"))
    return counts.orderBy(F.desc("patients"), "age_bucket")


def total_cost(encounters: DataFrame) -> DataFrame:
    """One row: encounters and their cost, missing costs skipped."""
    cost = F.nanvl("cost", F.lit(None).cast("double"))
    return encounters.agg(
        F.count(F.lit(1)).alias("processed_encounters"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_clinical_cost"),
    )
