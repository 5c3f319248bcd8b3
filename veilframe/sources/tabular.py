"""Raw patient and encounter tables: CSV with a header, every cell read as text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilframe.sources.schemas import (
    ENCOUNTER_COLUMNS,
    MISSING_CELLS,
    PATIENT_COLUMNS,
    resolve_columns,
)


BAD_ROW = "_bad_row"


class InputNotFound(FileNotFoundError):
    """An input path does not exist."""


def read_text_cells(
    spark: SparkSession,
    path: str | list[str],
    multiline: bool,
    missing_cells: Sequence[str] = MISSING_CELLS,
    bad_rows: str = "fail",
) -> DataFrame:
    """CSV without type inference, so codes and ZIPs keep leading zeros and no pass over
    the data is spent on guessing. Files whose header order differs from the first
    file's are refused rather than read into the wrong columns.

    A row with more or fewer cells than the header fails the read, without quoting it;
    ``bad_rows="drop"`` leaves such rows out and ``"mark"`` adds a column with their text,
    null for others. Whole rows are parsed, whatever columns are used.
    """
    if bad_rows not in ("fail", "drop", "mark"):
        raise ValueError("bad_rows must be 'fail', 'drop' or 'mark'")
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", BAD_ROW)
        .option("columnPruning", False)
    )
    names = reader.csv(path).columns
    if spark.conf.get("spark.sql.caseSensitive") != "true":
        header = spark.read.option("multiLine", multiline).option("escape", '"').csv(path).first()
        _refuse_renamed(header or ())
    schema = StructType([StructField(n, StringType()) for n in [*names, BAD_ROW]])
    marked = reader.schema(schema).csv(path)
    bad = F.col(BAD_ROW)
    if bad_rows == "mark":
        return marked
    # Spark refuses queries that look at nothing but the marker, so a cell is looked at too.
    message = F.lit("a row has more or fewer cells than the header")
    fine = bad.isNull() if bad_rows == "drop" else F.when(bad.isNotNull(), F.raise_error(message)).isNull()
    fine = fine & (F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0)
    cells = [(F.col(f"`{n}`"), n) for n in names]
    raw = marked.where(fine)
    if not missing_cells:
        return raw.select(*[cell for cell, _ in cells])
    return raw.select(*[F.when(~cell.isin(*missing_cells), cell).alias(name) for cell, name in cells])


def count_bad_rows(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """One row: ``bad_rows``, those with more or fewer cells than the header."""
    marked = read_text_cells(spark, path, multiline, bad_rows="mark")
    # Spark refuses queries that look at nothing but the marker, so a cell is looked at too.
    cell = F.coalesce(F.col(f"`{marked.columns[0]}`"), F.lit(""))
    return marked.agg(F.count(F.when(F.col(BAD_ROW).isNotNull(), cell)).alias("bad_rows"))


def _refuse_renamed(header: Sequence[str | None]) -> None:
    """Spark numbers header names that differ only in case, which would hide them from the
    lookup by name. The header line itself tells them from names that end in a number."""
    seen: dict[str, str] = {}
    for name in header:
        if name is not None and seen.setdefault(name.lower(), name) != name:
            raise ValueError(
                f"columns {seen[name.lower()]!r} and {name!r} differ only in case; "
                "set spark.sql.caseSensitive to true to read them"
            )


def read_patients(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    return read_text_cells(spark, path, multiline)


def read_encounters(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Notes may hold quoted line breaks, which is why ``multiline`` is on. Spark cannot
    split such a file, so deliver many files; where notes have no line breaks, pass
    ``multiline=False`` and large files are split too."""
    return read_text_cells(spark, path, multiline)


@dataclass(frozen=True)
class InputCheck:
    patients_columns: list[str]
    encounters_columns: list[str]
    missing_patients: list[str]
    missing_encounters: list[str]


def validate_inputs(spark: SparkSession, patients_path: str, encounters_path: str) -> InputCheck:
    """Both inputs exist and their first rows parse; only headers and a few rows are read.
    Missing columns are reported, never an error: they get defaults."""
    headers = []
    readers = (
        ("Patients", read_patients, patients_path),
        ("Encounters", read_encounters, encounters_path),
    )
    for label, reader, path in readers:
        try:
            frame = reader(spark, path)
            frame.limit(5).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise InputNotFound(f"{label} input not found: {path}") from error
            raise
        headers.append(frame.columns)
    patients, encounters = headers

    def missing(columns, aliases):
        found = resolve_columns(columns, aliases)
        return [names[0] for logical, names in aliases.items() if found[logical] is None]

    return InputCheck(
        patients, encounters, missing(patients, PATIENT_COLUMNS), missing(encounters, ENCOUNTER_COLUMNS)
    )
