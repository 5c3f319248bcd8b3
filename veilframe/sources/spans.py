"""Span logs: JSON-lines directories that jobs append to, or one JSON array."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from veilframe.sources.commits import CommitLog, Folder
from veilframe.sources.schemas import SPAN, SPAN_TYPED

# Fixed value: ISO-8601 with microseconds and a numeric zone.
ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
CORRUPT = "_corrupt_record"
# Below a log, hidden from readers of the folder itself: rewritten files, and which they replace.
_COMPACTED, _COMPACTIONS = "_compacted", "_compactions"


def parse_lines(lines: DataFrame, schema: StructType = SPAN) -> DataFrame:
    """(raw, span) of every non-empty line; ``span`` is null where the line cannot be read.

    Each line is parsed whole, whatever columns are asked for later, so that counts do not
    depend on them. A line that gives neither id nor name is unreadable too.
    """
    marked = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    full = lines.where(F.trim("value") != "")
    parsed = full.select(F.col("value").alias("raw"), F.from_json("value", marked, options).alias("read"))
    span = F.col("read")
    good = span[CORRUPT].isNull() & (span["span_id"].isNotNull() | span["name"].isNotNull())
    return parsed.select("raw", F.when(good, F.struct(*[span[f.name].alias(f.name) for f in schema.fields])).alias("span"))


def parse_arrays(files: DataFrame, schema: StructType = SPAN) -> DataFrame:
    """The same of whole files holding one JSON array each; a file with a bad byte anywhere
    is one unreadable record."""
    items = F.from_json("value", ArrayType(schema), {"mode": "PERMISSIVE"})
    return files.where(F.trim("value") != "").select(
        F.col("value").alias("raw"), F.explode_outer(F.coalesce(items, F.array(F.lit(None).cast(schema)))).alias("span")
    ).where("span IS NULL OR span.span_id IS NOT NULL OR span.name IS NOT NULL")


def _parsed(spark: SparkSession, path: str, array_file: bool, schema: StructType) -> DataFrame | None:
    try:
        lines = spark.read.text(path if array_file else _log_files(spark, path), wholetext=array_file)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return parse_arrays(lines, schema) if array_file else parse_lines(lines, schema)


def read_spans(
    spark: SparkSession, path: str, array_file: bool = False, typed_attributes: bool = False
) -> DataFrame:
    """All readable spans of a log; a missing or empty log has none. ``corrupt_spans`` has
    the rest.

    ``array_file`` reads files holding one JSON array. Spark cannot split those, so
    logs of any size should be JSON lines, the default. Attributes are a map of texts,
    or with ``typed_attributes`` a variant that keeps numbers and booleans apart.
    """
    schema = SPAN_TYPED if typed_attributes else SPAN
    parsed = _parsed(spark, path, array_file, schema)
    if parsed is None:
        return spark.createDataFrame([], schema)
    return parsed.where("span IS NOT NULL").select("span.*")


def corrupt_spans(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """(raw): the lines, or files, of a log that cannot be read."""
    parsed = _parsed(spark, path, array_file, SPAN)
    if parsed is None:
        return spark.createDataFrame([], "raw string")
    return parsed.where("span IS NULL").select("raw")


def finish_spans(ended: DataFrame) -> DataFrame:
    """Span records from raw measurements.

    ``ended`` has trace_id, span_id, parent_span_id (hex text), name, start_ns, end_ns
    (epoch nanoseconds), status_code, status_description, attributes and events. An
    absent or zero time counts as missing and gives a duration of 0.
    """
    timed = (F.coalesce("start_ns", F.lit(0)) != 0) & (F.coalesce("end_ns", F.lit(0)) != 0)
    elapsed_ms = F.round((F.col("end_ns") - F.col("start_ns")) / 1_000_000, 2)

    def moment(ns: str):
        # Whole-number division: epoch nanoseconds exceed what a double holds exactly.
        at = F.timestamp_micros(F.call_function("div", F.col(ns), F.lit(1000)))
        return F.when(F.col(ns) != 0, at)

    def hex_id(name: str, width: int):
        # Shorter ids are padded, longer ones never cut.
        given = F.lower(F.col(name))
        return F.when(F.length(given) < width, F.lpad(given, width, "0")).otherwise(given).alias(name)

    return ended.select(
        hex_id("trace_id", 32),
        hex_id("span_id", 16),
        hex_id("parent_span_id", 16),
        "name",
        moment("start_ns").alias("start_time"),
        moment("end_ns").alias("end_time"),
        F.when(timed, elapsed_ms).otherwise(F.lit(0.0)).alias("duration_ms"),
        F.when(F.col("status_code") == "ERROR", "ERROR").otherwise("OK").alias("status"),
        F.coalesce("status_description", F.lit("")).alias("status_description"),
        "attributes",
        "events",
    )


def append_spans(spans: DataFrame, path: str) -> None:
    """Add files to a log; earlier files are never rewritten, so writers need no lock."""
    spans.write.mode("append").option("timestampFormat", ISO_TIMESTAMP).json(path)


def _compactions(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path.rstrip('/')}/{_COMPACTIONS}")


def _appended(spark: SparkSession, path: str) -> list[str]:
    return sorted(name for name in Folder(spark, path).names() if not name.startswith(("_", ".")))


def _log_files(spark: SparkSession, path: str) -> list[str]:
    """What makes up a log now: its folder, or after a compaction the rewritten files and those
    appended since. One commit says which, so that no span is seen twice or not at all."""
    state = _compactions(spark, path).current()
    if not state:
        return [path]
    root, replaced = path.rstrip("/"), set(state["replaced"])
    fresh = [name for name in _appended(spark, path) if name not in replaced]
    return [f"{root}/{name}" for name in (*state["folders"], *fresh)]


def compact_log(spark: SparkSession, path: str, bytes_per_file: int = 128 << 20) -> int:
    """Rewrites the many small files of a log into few and returns how many it replaced.

    Writers go on appending meanwhile, and readers need not wait: the new files are hidden until
    a commit puts them in the place of the old ones. Those are deleted by the next compaction,
    when readers that listed them are done. Lines are copied as they are, unreadable ones too.
    """
    log, root = _compactions(spark, path), path.rstrip("/")
    before = log.current() or {"folders": [], "replaced": []}
    files = Folder(spark, path)
    old = _log_files(spark, path)
    fresh = [name for name in _appended(spark, path) if name not in set(before["replaced"])]
    if len(fresh) < 2:
        return 0
    sizes = spark.read.format("binaryFile").load(old).agg(F.sum("length")).first()[0] or 0
    made = f"{_COMPACTED}/{uuid.uuid4().hex}"
    lines = spark.read.text(old).repartition(max(1, -(-sizes // bytes_per_file)))
    lines.write.text(f"{root}/{made}")

    def replace(state: dict) -> dict:
        if (state or before) != before:
            raise RuntimeError(f"{path} is being compacted by another job")
        return {"folders": [made], "replaced": fresh}

    log.commit(replace)
    for name in (*before["replaced"], *before["folders"]):
        files.delete(name)
    return len(fresh)
