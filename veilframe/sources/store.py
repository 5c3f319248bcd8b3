"""The de-identified store: Parquet tables, replaced as a whole, seen as temp views.

Every write of a table goes to a folder of its own. Which folder is the table is said by the
store's newest commit, a file that names all tables and is written last: a job that dies while
writing leaves the old tables in force, readers never see half of a table, and tables exported
together change together. Folders no commit names any more go with ``vacuum``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.commits import CommitLog, Folder

PATIENTS = "deid_patients"
ENCOUNTERS = "deid_encounters"
SUMMARY = "clinical_summary"
SUMMARY_EXPORT = "patient_encounters_summary"

_COMMITS = "_commits"


def _log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root.rstrip('/')}/{_COMMITS}")


def table_path(spark: SparkSession, root: str, table: str) -> str:
    """Folder that holds the table as of now."""
    tables = _log(spark, root).current()
    if table not in tables:
        raise FileNotFoundError(f"{root} has no table {table}")
    return f"{root.rstrip('/')}/{tables[table]['folder']}"


def _put_in_force(spark: SparkSession, root: str, written: Mapping[str, dict]) -> None:
    _log(spark, root).commit(lambda tables: {**tables, **written})


def _new_folder(table: str) -> str:
    return f"{table}/{uuid.uuid4().hex}"


def _stage(
    df: DataFrame,
    root: str,
    table: str,
    partition_by: Sequence[str] = (),
    observe: tuple[Observation, Sequence[Column]] | None = None,
    drop: Sequence[str] = (),
) -> dict:
    """Writes a table nobody sees yet.

    With ``partition_by`` rows are first brought together by those columns through a
    rebalance, which lets AQE merge small partitions and split a value that holds a
    large share of the rows, so neither tiny files nor one giant task appear.
    """
    folder = _new_folder(table)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if observe is not None:
        df = df.observe(observe[0], *observe[1])
    writer = df.drop(*drop).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root.rstrip('/')}/{folder}")
    return {"folder": folder}


def write_table(
    df: DataFrame,
    root: str,
    table: str,
    partition_by: Sequence[str] = (),
    observe: tuple[Observation, Sequence[Column]] | None = None,
    drop: Sequence[str] = (),
) -> str:
    """Replace one table and return its new folder. ``observe`` computes metrics on the way,
    from columns that may be dropped after it."""
    written = _stage(df, root, table, partition_by, observe, drop)
    _put_in_force(df.sparkSession, root, {table: written})
    return f"{root.rstrip('/')}/{written['folder']}"


def with_start_year(encounters: DataFrame) -> DataFrame:
    """Adds ``start_year``, the partition column for encounters."""
    return encounters.withColumn("start_year", F.substring("start_time", 1, 4))


def export_tables(
    tables: Mapping[str, DataFrame],
    root: str,
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Replace several tables at once and return their folders: readers see all of the old ones
    or all of the new."""
    partition_by = partition_by or {}
    written = {name: _stage(df, root, name, partition_by.get(name, ())) for name, df in tables.items()}
    for df in list(tables.values())[:1]:
        _put_in_force(df.sparkSession, root, written)
    return {name: f"{root.rstrip('/')}/{entry['folder']}" for name, entry in written.items()}


def export_bucketed(
    tables: Mapping[str, DataFrame], root: str, key: str, buckets: int, files_per_bucket: int = 1
) -> None:
    """Replace several tables at once, each dealt into ``buckets`` by a hash of ``key`` and sorted
    by it, so that joins and sums by that key need no shuffle however often they are made.

    Rows of a key that holds a large share of a table are written by ``files_per_bucket`` tasks;
    a bucket is read by one, so many keys of that kind are better kept in plain tables.
    """
    written = {}
    for name, df in tables.items():
        folder = _new_folder(name)
        bucket = F.pmod(F.hash(key), F.lit(buckets))
        part = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))
        dealt = df.repartition(buckets * files_per_bucket, bucket, part)
        entry = {"folder": folder, "buckets": buckets, "key": key, "columns": df._jdf.schema().toDDL()}
        entry["notes"] = {f.name: f.metadata for f in df.schema if f.metadata}
        writer = dealt.write.format("parquet").option("path", f"{root.rstrip('/')}/{folder}")
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(_catalog_name(entry))
        written[name] = entry
    for df in list(tables.values())[:1]:
        _put_in_force(df.sparkSession, root, written)


def _catalog_name(entry: Mapping) -> str:
    return entry["folder"].replace("/", "_")


def _read(spark: SparkSession, root: str, entry: Mapping) -> DataFrame:
    path = f"{root.rstrip('/')}/{entry['folder']}"
    if "buckets" not in entry:
        return spark.read.parquet(path)
    # How a table is bucketed is known to the session's catalog only, so another session tells
    # its own from the commit.
    name = _catalog_name(entry)
    if not spark.catalog.tableExists(name):
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{name}` ({entry['columns']}) USING parquet CLUSTERED BY (`{entry['key']}`) "
            f"SORTED BY (`{entry['key']}`) INTO {int(entry['buckets'])} BUCKETS LOCATION '{location}'"
        )
    df = spark.table(name)
    for column, note in entry["notes"].items():
        df = df if df.schema[column].metadata == note else df.withMetadata(column, note)
    return df


def save_as_tables(tables: Mapping[str, DataFrame], database: str | None = None) -> None:
    """Replace catalog tables instead of bare directories."""
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}" if database else name)


def open_store(spark: SparkSession, root: str, tables: Iterable[str]) -> dict[str, DataFrame]:
    """Make stored tables visible to SQL and return them, all as of one commit."""
    known, opened = _log(spark, root).current(), {}
    for name in tables:
        if name not in known:
            raise FileNotFoundError(f"{root} has no table {name}")
        opened[name] = _read(spark, root, known[name])
        opened[name].createOrReplaceTempView(name)
    return opened


def vacuum(spark: SparkSession, root: str, keep_commits: int = 1, older_than_hours: float = 24.0) -> list[str]:
    """Delete folders that none of the newest commits names, and older commits; returns the
    folders. Young folders stay, since a job may still be writing them or reading them."""
    log = _log(spark, root)
    states = log.states(keep_commits)
    named = {entry["folder"] for _, tables in states for entry in tables.values()}
    log.forget(keep_commits)
    before, gone = time.time() - older_than_hours * 3600, []
    for table in Folder(spark, root).names():
        if table == _COMMITS:
            continue
        versions = Folder(spark, f"{root.rstrip('/')}/{table}")
        for version, changed in versions.names().items():
            if f"{table}/{version}" not in named and changed <= before:
                versions.delete(version)
                gone.append(f"{table}/{version}")
    return gone
