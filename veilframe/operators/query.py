"""Read-only SQL and the table catalog."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Statements that only describe, and functions that run arbitrary JVM code.
DESCRIBING = ("show", "describe", "desc")
UNSAFE_FUNCTIONS = ("reflect", "java_method", "try_reflect")

# What span reports say instead of an empty list.
NO_SPANS = "NO_TRACES_FOUND"
NO_SUCH_TRACE = "NOT_FOUND"
NO_FAILURES = "ALL_HEALTHY"

_LEADING_WORD = re.compile(r"\s*(\w+)")
_SQL_ON_FILES = "spark.sql.runSQLOnFiles"


def _guarded(spark: SparkSession) -> SparkSession:
    """A copy of the session, with its views and settings, in which nothing can call into the
    JVM or read a file by its path. The caller's own session is left as it is."""
    jvm = spark._jvm
    copy = spark._jsparkSession.cloneSession()
    registry = copy.sessionState().functionRegistry()
    for name in UNSAFE_FUNCTIONS:
        registry.dropFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    session = SparkSession(spark.sparkContext, copy)
    session.conf.set(_SQL_ON_FILES, "false")
    return session


def read_only_sql(spark: SparkSession, text: str) -> DataFrame:
    """All rows of a single query, lazily.

    Spark's own grammar decides what a query is: the text is placed inside a subquery,
    where any statement that writes, and any second statement, is a syntax error. It runs in
    a copy of the session whose function registry lacks the functions that call into the JVM
    and where only tables and views can be named, not files by path, so neither comments nor
    literals matter and nothing has to be searched for. Statements that describe run there
    too. EXPLAIN is refused, since plans of views over raw tables hold their salt.
    """
    text = text.strip().rstrip(";")
    word = _LEADING_WORD.match(text)
    describing = word and word.group(1).lower() in DESCRIBING
    return _guarded(spark).sql(text if describing else f"SELECT * FROM (\n{text}\n)")


def run_sql(spark: SparkSession, text: str, limit: int) -> dict:
    """``{"rows": [...], "truncated": bool}`` of at most ``limit`` rows, or
    ``{"error": message}`` for refused and failing statements."""
    try:
        return bounded_records(read_only_sql(spark, text), limit)
    except PySparkException as error:
        return {"error": str(error)}


def bounded_records(df: DataFrame, limit: int) -> dict:
    """At most ``limit`` rows as dictionaries, and whether there are more of them."""
    rows = [row.asDict(recursive=True) for row in df.limit(limit + 1).collect()]
    return {"rows": rows[:limit], "truncated": len(rows) > limit}


def to_report(df: DataFrame, empty_status: str, limit: int) -> dict:
    """``bounded_records``, or ``{"status": empty_status}`` where there are none."""
    found = bounded_records(df, limit)
    return found if found["rows"] else {"status": empty_status}


def table_schemas(spark: SparkSession) -> DataFrame:
    """(table, column_name, column_type, null) of every table and view in sight."""
    rows = [
        (table.name, column.name, column.dataType, "YES" if column.nullable else "NO")
        for table in spark.catalog.listTables()
        for column in spark.catalog.listColumns(table.name)
    ]
    schema = "table string, column_name string, column_type string, null string"
    return spark.createDataFrame(rows, schema)
