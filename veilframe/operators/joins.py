"""Patients and their encounters, row by row.

Null ids all hash to one key. Joined by it, every patient without an id would get the encounters
of every other one, and two such piles multiply. So rows without an id stay out of the join: the
patients come back as patients without encounters, and both sides are counted. What key that is
travels with the key column; null keys count as missing as well. ``link_missing=True`` joins them
like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "patient_deid_key"
# Where a key column says which key stands for a missing id.
MISSING_KEY = "missing_key"


def has_id(*tables: DataFrame) -> Column:
    """Condition on the key column of any of these tables: the row belongs to someone."""
    missing = {t.schema[KEY].metadata.get(MISSING_KEY) for t in tables} - {None}
    return F.col(KEY).isNotNull() & ~F.col(KEY).isin(*sorted(missing)) if missing else F.col(KEY).isNotNull()


def join_encounters(patients: DataFrame, encounters: DataFrame, link_missing: bool = False) -> DataFrame:
    """Every patient with each of their encounters; patients without any appear once,
    encounters without a patient not at all.

    A left join cannot split a key that holds a large share of the encounters, and
    cannot broadcast the patients. An inner join can do both, so the left join is
    written as the inner join and the patients it leaves out; the latter need only the
    distinct keys of the encounters, which are combined before the shuffle.
    """
    known = F.col(KEY).isNotNull() if link_missing else has_id(patients, encounters)
    someone, visits = patients.where(known), encounters.where(known)
    matched = someone.join(visits, KEY, "inner")
    unmatched = someone.join(visits.select(KEY).distinct(), KEY, "left_anti")
    return matched.unionByName(unmatched.unionAll(patients.where(~known)), allowMissingColumns=True)


def join_counts(patients: DataFrame, encounters: DataFrame, link_missing: bool = False) -> DataFrame:
    """One row: rows of ``join_encounters``, those with an encounter, the number of patients
    with one, and rows of either table without an id. Computed from counts for each key,
    without making the join."""
    known = has_id(patients, encounters)
    copies = patients.groupBy(KEY).agg(F.count(F.lit(1)).alias("copies"))
    visits = encounters.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("visits"), F.count("encounter_id").alias("identified")
    )
    both = copies.join(visits, KEY, "full")
    linked = F.col(KEY).isNotNull() if link_missing else known
    rows = F.col("copies") * F.when(linked, F.coalesce("visits", F.lit(1))).otherwise(1)
    matched = F.when(linked, F.col("copies") * F.coalesce("identified", F.lit(0)))

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return both.agg(
        total(rows).alias("merged_rows"),
        total(matched).alias("matched_rows"),
        F.count_if(linked & F.col("copies").isNotNull() & (F.col("identified") > 0)).alias("matched_patients"),
        total(F.when(~known, F.col("copies"))).alias("patients_without_id"),
        total(F.when(~known, F.col("visits"))).alias("encounters_without_id"),
    )


def orphan_encounters(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """(patient_deid_key, encounters) of keys no patient has, that of missing ids among them."""
    visits = encounters.groupBy(KEY).agg(F.count(F.lit(1)).alias("encounters"))
    someone = patients.where(has_id(patients, encounters))
    return visits.join(someone.select(KEY).distinct(), KEY, "left_anti")
