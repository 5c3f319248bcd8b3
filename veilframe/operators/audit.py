"""Compliance checks over de-identified tables: every row of every table, one pass each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import as_identifier, matches_pii, patient_key
from veilframe.functions.dates import TOP_BUCKET
from veilframe.functions.identifiers import PATIENT_KEY_HEX
from veilframe.operators.joins import KEY, has_id
from veilframe.sources.schemas import FORBIDDEN_COLUMNS
from veilframe.sources.store import ENCOUNTERS, PATIENTS

DEFAULT_CHECKS = ("ssn", "email")
NOTE_COLUMNS = {ENCOUNTERS: ("clinical_notes",)}
FORBIDDEN_CHECK = "forbidden_column"
ORPHAN_CHECK = "orphan_encounter"
BIRTH_DATE_CHECK = "birth_date_of_oldest"
UNREADABLE_CHECK = "unreadable"
ALL_TEXT: Mapping[str, Sequence[str]] = {}


def pii_counts(df: DataFrame, columns: Sequence[str], checks: Sequence[str] = DEFAULT_CHECKS) -> DataFrame:
    """(check, column, violations, total_rows): rows of ``df`` holding an identifier."""
    counts = {(check, c): F.count_if(matches_pii(F.col(c), check)) for c in columns for check in checks}
    return _one_pass(df, counts)


Counts = dict[tuple[str, str | None], Column]


def _one_pass(df: DataFrame, counts: Mapping[tuple[str, str | None], Column]) -> DataFrame:
    aggregates = [count.alias(f"_{i}") for i, count in enumerate(counts.values())]
    totals = df.agg(F.count(F.lit(1)).alias("total_rows"), *aggregates)
    findings = [_finding(check, column, F.col(f"_{i}")) for i, (check, column) in enumerate(counts)]
    return totals.select("total_rows", F.explode(F.array(*findings)).alias("finding")).select(
        "finding.check", "finding.column", "finding.violations", "total_rows"
    )


def _finding(check: str, column: str | None, violations: Column, **more: Column) -> Column:
    return F.struct(
        *[value.alias(name) for name, value in more.items()],
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column"),
        violations.alias("violations"),
    )


def audit_tables(
    tables: Mapping[str, DataFrame],
    note_columns: Mapping[str, Sequence[str]] = NOTE_COLUMNS,
    checks: Sequence[str] = DEFAULT_CHECKS,
    oldest_birth_dates: bool = False,
    orphans: bool = False,
    unread: Mapping[str, Mapping[str, Column]] | None = None,
) -> DataFrame:
    """(table, check, column, violations, total_rows), one row a check, clean ones included.

    Always checked: column names, and ``checks`` over the note columns, or with ``ALL_TEXT``
    over all text columns of every table. On request: birth dates kept for the top age group,
    encounters whose patient is missing, and cells that hold something which cannot be read:
    ``unread`` has conditions by table and column, such as ``unreadable_date`` of raw dates.
    """
    wanted: dict[str, Counts] = {}
    for name, df in tables.items():
        leaked = [c for c in df.columns if c.lower() in FORBIDDEN_COLUMNS]
        counts: Counts = {(FORBIDDEN_CHECK, c): F.count(F.lit(1)) * 0 + 1 for c in leaked}
        wanted[name] = counts = counts or {(FORBIDDEN_CHECK, None): F.count(F.lit(1)) * 0}
        texts = _text_columns(df) if note_columns is ALL_TEXT else note_columns.get(name, ())
        for column in texts:
            for check in checks:
                counts[check, column] = F.count_if(matches_pii(F.col(f"`{column}`"), check))
        if oldest_birth_dates and {"age_bucket", "shifted_birth_date"} <= set(df.columns):
            kept = (F.col("age_bucket") == TOP_BUCKET) & F.col("shifted_birth_date").isNotNull()
            counts[BIRTH_DATE_CHECK, "shifted_birth_date"] = F.count_if(kept)
        if unread and name in unread:
            for column, given in unread[name].items():
                counts[UNREADABLE_CHECK, column] = F.count_if(given)
    both = orphans and {PATIENTS, ENCOUNTERS} <= set(tables)
    reports = [
        _one_pass(df, wanted[name]).select(F.lit(name).alias("table"), "*")
        for name, df in tables.items()
        if not (both and name in (PATIENTS, ENCOUNTERS))
    ]
    if both:
        reports.append(_joint_pass(tables[PATIENTS], tables[ENCOUNTERS], wanted))
    return reduce(DataFrame.unionByName, reports)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "varchar", "char")]


def _joint_pass(patients: DataFrame, encounters: DataFrame, wanted: Mapping[str, Counts]) -> DataFrame:
    """All checks of both tables and the orphans between them from one scan of each: counts are
    taken for each key, the keys of both tables meet once, and everything is summed up. An orphan
    cannot be told by less than a meeting of all keys: a Bloom filter of the patients' keys would
    only say of some that no patient has them, and of the others, nearly all, nothing for certain.
    """

    def by_key(df: DataFrame, table: str) -> DataFrame:
        named = [count.alias(f"{table}_{i}") for i, count in enumerate(wanted[table].values())]
        return df.groupBy(KEY).agg(F.count(F.lit(1)).alias(f"{table}_rows"), *named)

    visits, people = by_key(encounters, ENCOUNTERS), by_key(patients, PATIENTS)
    met = visits.join(people, KEY, "full")
    orphaned = F.col(f"{PATIENTS}_rows").isNull() | ~has_id(patients, encounters) | F.col(KEY).isNull()
    sums, findings = [], []
    for table in (PATIENTS, ENCOUNTERS):
        rows = F.col(f"{table}_total")
        sums.append(F.coalesce(F.sum(f"{table}_rows"), F.lit(0)).alias(f"{table}_total"))
        for i, (check, column) in enumerate(wanted[table]):
            # Names of columns are said once a table, whatever its rows.
            constant = check == FORBIDDEN_CHECK
            total = F.lit(0 if column is None else 1).cast("bigint") if constant else F.col(f"{table}_{i}_total")
            if not constant:
                sums.append(F.coalesce(F.sum(f"{table}_{i}"), F.lit(0)).alias(f"{table}_{i}_total"))
            findings.append(_finding(check, column, total, table=F.lit(table), total_rows=rows))
    lost = F.when(orphaned, F.col(f"{ENCOUNTERS}_rows"))
    sums.append(F.coalesce(F.sum(lost), F.lit(0)).alias("orphans"))
    total_rows = F.col(f"{ENCOUNTERS}_total")
    findings.append(_finding(ORPHAN_CHECK, KEY, F.col("orphans"), table=F.lit(ENCOUNTERS), total_rows=total_rows))
    return met.agg(*sums).select(F.explode(F.array(*findings)).alias("f")).select(
        "f.table", "f.check", "f.column", "f.violations", "f.total_rows"
    )


ALL_CLEAR = "No residual direct identifiers found."


def compliance_report(audit: DataFrame) -> dict:
    """The audit as a dictionary: verdict, table sizes and findings. An audit has a few
    rows for each table, which is all that is collected."""
    rows = audit.collect()
    sizes = {r["table"]: r["total_rows"] for r in rows}
    findings = []
    for r in rows:
        if not r["violations"]:
            continue
        if r["check"] == FORBIDDEN_CHECK:
            findings.append(f"{r['table']}: column {r['column']} holds raw identifiers")
        else:
            findings.append(f"{r['table']}.{r['column']}: {r['violations']} rows fail {r['check']}")
    return {
        "compliant": not findings,
        "total_patients": sizes.get(PATIENTS, 0),
        "total_encounters": sizes.get(ENCOUNTERS, 0),
        "tables_audited": sorted(sizes),
        "findings": findings or [ALL_CLEAR],
    }


def pseudonym_collisions(
    raw_ids: DataFrame, id_column: str, salt: str, key_hex_len: int = PATIENT_KEY_HEX
) -> DataFrame:
    """One row: distinct ids, distinct pseudonyms, and ids that share one. Run it before
    raw ids are dropped; null ids count as the one text they are hashed as."""
    ids = raw_ids.select(as_identifier(F.col(id_column)).alias("raw_id")).distinct()
    keys = ids.groupBy(patient_key(F.col("raw_id"), salt, key_hex_len).alias("key")).agg(
        F.count(F.lit(1)).alias("ids")
    )
    return keys.agg(
        F.coalesce(F.sum("ids"), F.lit(0)).alias("raw_ids"),
        F.count(F.lit(1)).alias("pseudonyms"),
        F.coalesce(F.sum(F.when(F.col("ids") > 1, F.col("ids"))), F.lit(0)).alias("colliding_ids"),
    )


def missing_patient_ids(raw: DataFrame, id_column: str) -> DataFrame:
    """One row: rows of a raw table whose patient id is null, and all rows."""
    return raw.agg(
        F.count_if(F.col(id_column).isNull()).alias("missing_ids"),
        F.count(F.lit(1)).alias("total_rows"),
    )
