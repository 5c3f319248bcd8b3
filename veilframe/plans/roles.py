"""Retail tables cast in the roles of clinical ones, to run the operators on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SALT = "test_salt_123"
REFERENCE_DATE = "2026-01-01"
_EVENT = "struct<name:string,timestamp:timestamp,attributes:map<string,string>>"


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Its schema is read from the files once a session, as a
    catalog would keep it, since each look costs a job."""
    path = f"{sf_dir}/{name}.parquet"
    known = spark.sparkContext.applicationId, path
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


def _zip(key: str) -> Column:
    text = F.col(key).cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients, with two columns that must not survive."""
    key = F.col("c_custkey")
    joined = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    birth = F.date_add(F.lit("1920-01-01").cast("date"), (key * 37 % 38000).cast("int"))
    death = F.date_add(F.lit("2021-01-01").cast("date"), (key % 1000).cast("int"))
    return joined.select(
        key.cast("string").alias("Id"),
        birth.cast("string").alias("BIRTHDATE"),
        F.when(key % 11 == 0, death.cast("string")).alias("DEATHDATE"),
        F.concat(F.lit("555-12-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("SSN"),
        F.col("c_name").alias("FIRST"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("GENDER"),
        F.when(key % 13 != 0, F.col("c_mktsegment")).alias("RACE"),
        F.col("n_name").alias("CITY"),
        F.col("r_name").alias("STATE"),
        _zip("c_custkey").alias("ZIP"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as encounters; three in four carry a note with an identifier in it."""
    key, patient = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    number = F.lpad((key % 10000).cast("string"), 4, "0")
    note = (
        F.when(key % 4 == 1, F.concat(F.lit("SSN 123-45-"), number, F.lit(" on file.")))
        .when(key % 4 == 2, F.concat(F.lit("Patient ID: "), patient, F.lit(" call (555) 010-"), number))
        .when(key % 4 == 3, F.concat(F.lit("Write to user"), patient, F.lit("@example.org, mrn:A-"), number))
    )
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("Id"),
        patient.alias("PATIENT"),
        F.col("o_orderdate").cast("date").cast("string").alias("START"),
        F.date_add(F.col("o_orderdate").cast("date"), (key % 5).cast("int")).cast("string").alias("STOP"),
        (key % 100).cast("string").alias("PROVIDER"),
        (key % 7).cast("string").alias("PAYER"),
        F.col("o_orderpriority").alias("ENCOUNTERCLASS"),
        F.col("o_orderstatus").alias("CODE"),
        F.lower("o_orderpriority").alias("DESCRIPTION"),
        F.col("o_totalprice").alias("COST"),
        note.alias("NOTES"),
    )


def device_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as encounters: most patients have none, and there are no notes at all."""
    return device_columns(table(spark, sf_dir, "events"))


def device_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("patient"),
        F.col("ts").alias("start"),
        F.col("event_type").alias("encounterclass"),
        F.col("value").alias("cost"),
    )


def as_spans(events: DataFrame) -> DataFrame:
    """Events as spans of traces named by user."""
    end_time = F.col("ts").cast("timestamp")
    elapsed_us = F.round(F.col("value") * 1000).cast("bigint")
    failed = F.col("event_type") == "error"
    trace = F.concat(F.lit("error in event "), F.col("event_id").cast("string"))
    exception = F.struct(
        F.lit("exception").alias("name"),
        end_time.alias("timestamp"),
        F.create_map(F.lit("exception.stacktrace"), trace).alias("attributes"),
    ).cast(_EVENT)
    return events.select(
        F.col("user_id").cast("string").alias("trace_id"),
        F.lpad(F.col("event_id").cast("string"), 16, "0").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.col("event_type").alias("name"),
        F.timestamp_micros(F.unix_micros(end_time) - elapsed_us).alias("start_time"),
        end_time.alias("end_time"),
        F.col("value").alias("duration_ms"),
        F.when(failed, "ERROR").otherwise("OK").alias("status"),
        F.when(failed, F.concat(F.lit("event "), F.col("event_id").cast("string")))
        .otherwise("")
        .alias("status_description"),
        F.from_json("props", "map<string,string>").alias("attributes"),
        F.when(failed, F.array(exception)).otherwise(F.array().cast(f"array<{_EVENT}>")).alias("events"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_spans(table(spark, sf_dir, "events"))


def zip_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zip, population) derived from the customers living there."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(_zip("c_custkey").alias("zip"))
        .agg((F.sum("c_nationkey") * 16).alias("population"))
    )
