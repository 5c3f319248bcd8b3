"""Every operator as a query over whole tables, each with its result in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import functions as V
from veilframe.operators import audit, conversations, joins, percentiles, query, spans, summary, transforms
from veilframe.plans import roles
from veilframe.plans.pipeline import DISTINCT_ERROR, PEOPLE_SKETCH, distinct_over_runs, run_pipeline, write_logged
from veilframe.plans.roles import REFERENCE_DATE, SALT
from veilframe.session import shared_folder
from veilframe.sources import spans as span_log
from veilframe.sources import store, tabular
from veilframe.streaming import spans as span_stream

Query = Callable[[SparkSession, str], DataFrame]
TRACE_ID = "8"
CHECKS = ("ssn", "phone", "email", "mrn")
# The test conversations are invented prose, so the intents use words found in it.
PROSE_INTENTS = (
    ("french", ("é", "que")),
    ("german", ("ung", "sch")),
    ("english", ("the", "ing")),
    ("spanish", ("ción", "los")),
)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of this run's own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _patients(spark: SparkSession, d: str) -> DataFrame:
    return transforms.deidentify_patients(roles.patients(spark, d), SALT, REFERENCE_DATE)


def _encounters(spark: SparkSession, d: str) -> DataFrame:
    return transforms.deidentify_encounters(roles.encounters(spark, d), SALT)


def _device_encounters(spark: SparkSession, d: str) -> DataFrame:
    return transforms.deidentify_encounters(roles.device_encounters(spark, d), SALT)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.clinical_summary_of_raw(
        roles.patients(spark, d), roles.encounters(spark, d), SALT, REFERENCE_DATE
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


# Scalar functions ------------------------------------------------------------------


def pseudonymize(spark: SparkSession, d: str) -> DataFrame:
    orders, patient = roles.table(spark, d, "orders"), F.col("o_custkey")
    return orders.select(
        "o_orderkey",
        V.patient_key(patient, SALT).alias("patient_deid_key"),
        V.encounter_key(F.col("o_orderkey")).alias("encounter_id"),
        V.provider_key(patient, SALT).alias("provider_deid_key"),
    )


def date_offset(spark: SparkSession, d: str) -> DataFrame:
    customers = roles.table(spark, d, "customer")
    return customers.select("c_custkey", V.date_offset(F.col("c_custkey"), SALT).alias("offset_days"))


def shift_dates(spark: SparkSession, d: str) -> DataFrame:
    days = V.date_offset(F.col("PATIENT"), SALT)
    return roles.encounters(spark, d).select(
        "Id",
        V.shift_date(F.col("START"), days).alias("start_time"),
        V.shift_date(F.col("STOP"), days).alias("end_time"),
    )


def age_bucket(spark: SparkSession, d: str) -> DataFrame:
    bucket = V.age_bucket(F.col("BIRTHDATE"), REFERENCE_DATE)
    return roles.patients(spark, d).select("Id", bucket.alias("age_bucket"))


def coarsen_zip(spark: SparkSession, d: str) -> DataFrame:
    return roles.patients(spark, d).select("Id", V.coarsen_zip(F.col("ZIP")).alias("coarsened_zip"))


def redact_notes(spark: SparkSession, d: str) -> DataFrame:
    documents = roles.table(spark, d, "documents")
    return documents.select("doc_id", V.redact_notes(F.col("text")).alias("redacted"))


def redact_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = roles.table(spark, d, "pages")
    return transforms.redact_column(pages, "html").select("page_id", F.col("html").alias("redacted"))


def redact_each(spark: SparkSession, d: str) -> DataFrame:
    note = F.col("NOTES")
    return roles.encounters(spark, d).select(
        "Id",
        V.redact_ssn(note).alias("no_ssn"),
        V.redact_phone(note).alias("no_phone"),
        V.redact_email(note).alias("no_email"),
        V.redact_mrn(note).alias("no_mrn"),
    )


def default_notes(spark: SparkSession, d: str) -> DataFrame:
    note = V.note_or_default(F.col("NOTES"), F.col("DESCRIPTION"))
    return roles.encounters(spark, d).select("Id", note.alias("note"))


def result_preview(spark: SparkSession, d: str) -> DataFrame:
    documents = roles.table(spark, d, "documents")
    return documents.select("doc_id", V.preview(F.col("text"), 500).alias("preview"))


def unreadable_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in many ways, every ninth in none, read back and counted."""
    key, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    written = F.lit("some day")
    patterns = ("yyyyMMdd", "MMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy.M.d", "yyyy/M/d", "yyyy-MM-dd", "M/d/yyyy h:mm a")
    for i, pattern in enumerate(patterns):
        written = F.when(key % 9 == i, F.date_format(date.cast("timestamp"), pattern)).otherwise(written)
    orders = roles.table(spark, d, "orders").select("o_orderkey", written.alias("written"))
    text = F.col("written")
    return orders.select(
        "o_orderkey", V.shift_date(text, F.lit(0)).alias("date"), V.unreadable_date(text).alias("unreadable")
    )


# Table transforms ------------------------------------------------------------------


def deid_encounters_parties(spark: SparkSession, d: str) -> DataFrame:
    return transforms.deidentify_encounters(roles.encounters(spark, d), SALT, keep_parties=True)


def pseudonym_map(spark: SparkSession, d: str) -> DataFrame:
    return transforms.pseudonym_map(roles.patients(spark, d), SALT)


def mapping_override(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' ids keep a key of their own; all other patients are hashed."""
    key = F.col("s_suppkey").cast("string")
    mapping = roles.table(spark, d, "supplier").select(
        key.alias("raw_id"), F.concat(F.lit("KNOWN-"), key).alias("patient_deid_key")
    )
    encounters = roles.encounters(spark, d)
    return transforms.deidentify_encounters(encounters, SALT, mapping=mapping).select(
        "encounter_id", "patient_deid_key", "start_time"
    )


def zip_population(spark: SparkSession, d: str) -> DataFrame:
    safe = transforms.suppress_small_zips(_patients(spark, d), roles.zip_population(spark, d))
    return safe.select("patient_deid_key", "coarsened_zip")


def zip_population_alphanumeric(spark: SparkSession, d: str) -> DataFrame:
    """Areas that are not numbers count as any others."""
    area = F.concat(F.lit("M"), (F.col("c_custkey") % 7).cast("string"), F.lit("V"))
    patients = roles.table(spark, d, "customer").select("c_custkey", F.concat(area, F.lit("XX")).alias("coarsened_zip"))
    people = roles.table(spark, d, "customer").select(area.alias("zip"), (F.col("c_custkey") % 7 * 10_000).alias("n"))
    population = people.groupBy("zip").agg(F.max("n").alias("population"))
    return transforms.suppress_small_zips(patients, population)


# Joins -----------------------------------------------------------------------------


def patient_encounter_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_encounters(_patients(spark, d), _encounters(spark, d))


def patient_device_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_encounters(_patients(spark, d), _device_encounters(spark, d)).select(
        "patient_deid_key", "age_bucket", "encounter_id", "encounter_class", "cost"
    )


def join_match_counts(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_counts(_patients(spark, d), _device_encounters(spark, d))


def _some_without_id(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every seventh patient and every fifth encounter without a patient's id."""
    patients, encounters = roles.patients(spark, d), roles.encounters(spark, d)
    patients = patients.withColumn("Id", F.when(F.col("Id").cast("bigint") % 7 != 0, F.col("Id")))
    encounters = encounters.withColumn("PATIENT", F.when(F.col("Id").cast("bigint") % 5 != 0, F.col("PATIENT")))
    return (
        transforms.deidentify_patients(patients, SALT, REFERENCE_DATE),
        transforms.deidentify_encounters(encounters, SALT),
    )


def missing_id_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an id meet nobody."""
    joined = joins.join_encounters(*_some_without_id(spark, d))
    return joined.select("patient_deid_key", "age_bucket", "encounter_id")


def missing_id_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same join counted, and as it would be if null ids were one patient's."""
    tables = _some_without_id(spark, d)
    apart = joins.join_counts(*tables).withColumn("linked", F.lit(False))
    return apart.unionAll(joins.join_counts(*tables, link_missing=True).withColumn("linked", F.lit(True)))


def orphan_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers who are not on the list of suppliers."""
    listed = roles.table(spark, d, "supplier").select(F.col("s_suppkey").alias("Id"))
    patients = transforms.deidentify_patients(listed, SALT, REFERENCE_DATE)
    return joins.orphan_encounters(patients, _encounters(spark, d))


# Aggregations ----------------------------------------------------------------------


def clinical_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(
        summary.clinical_summary(_patients(spark, d), _encounters(spark, d)), "total_clinical_cost"
    )


def clinical_summary_of_raw(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_summary(spark, d), "total_clinical_cost")


def device_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(
        summary.clinical_summary(_patients(spark, d), _device_encounters(spark, d)),
        "total_clinical_cost",
    )


def clinical_summary_reduced(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.reduced_summary(_summary(spark, d)), "total_clinical_cost")


def clinical_stats(spark: SparkSession, d: str) -> DataFrame:
    return summary.cohort_statistics(_summary(spark, d))


def age_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summary.age_histogram(_patients(spark, d))


def total_cost(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.total_cost(_encounters(spark, d)), "total_clinical_cost")


# Audit and SQL ---------------------------------------------------------------------


def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.pii_counts(roles.table(spark, d, "documents"), ["text"], CHECKS)


def page_pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.pii_counts(roles.table(spark, d, "pages"), ["html"], CHECKS)


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        store.PATIENTS: _patients(spark, d),
        store.ENCOUNTERS: _encounters(spark, d),
        "raw_patients": roles.patients(spark, d),
        "raw_encounters": roles.encounters(spark, d),
    }
    notes = {store.ENCOUNTERS: ("clinical_notes",), "raw_encounters": ("NOTES",)}
    return audit.audit_tables(tables, notes, CHECKS, oldest_birth_dates=True, orphans=True)


def audit_all_text(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in any text column, and dates that are given but cannot be read."""
    start = F.when(F.col("Id").cast("bigint") % 9 == 0, "some day").otherwise(F.col("START"))
    visits = roles.encounters(spark, d).select("Id", start.alias("START"), "DESCRIPTION", "NOTES")
    unread = {"visits": {"START": V.unreadable_date(F.col("START"))}}
    return audit.audit_tables({"visits": visits}, audit.ALL_TEXT, CHECKS, unread=unread)


def pseudonym_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Keys cut to four hex digits, so that some do collide."""
    return audit.pseudonym_collisions(roles.table(spark, d, "orders"), "o_custkey", SALT, 4)


def missing_patient_ids(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_patient_ids(roles.encounters(spark, d), "PATIENT")


def read_only_sql(spark: SparkSession, d: str) -> DataFrame:
    _patients(spark, d).createOrReplaceTempView(store.PATIENTS)
    _encounters(spark, d).createOrReplaceTempView(store.ENCOUNTERS)
    return query.read_only_sql(
        spark,
        """
        SELECT p.age_bucket, p.state, COUNT(*) AS visits, ROUND(SUM(e.cost), 2) AS cost
        FROM deid_patients p JOIN deid_encounters e ON p.patient_deid_key = e.patient_deid_key
        GROUP BY p.age_bucket, p.state
        """,
    )


def sql_all_rows(spark: SparkSession, d: str) -> DataFrame:
    """SQL results are whole, however many rows they have."""
    roles.table(spark, d, "orders").createOrReplaceTempView("all_orders")
    return query.read_only_sql(spark, "SELECT o_orderkey, o_custkey, o_totalprice FROM all_orders")


def sql_records(spark: SparkSession, d: str) -> DataFrame:
    """Bounded records, and whether more are left."""
    roles.table(spark, d, "orders").createOrReplaceTempView("all_orders")
    text = "SELECT o_orderstatus, COUNT(*) AS n FROM all_orders GROUP BY o_orderstatus ORDER BY o_orderstatus"
    found = query.run_sql(spark, text, 2)
    rows = [(r["o_orderstatus"], r["n"], found["truncated"]) for r in found["rows"]]
    return spark.createDataFrame(rows, "o_orderstatus string, n bigint, truncated boolean")


def table_schemas(spark: SparkSession, d: str) -> DataFrame:
    for name in ("orders", "customer"):
        roles.table(spark, d, name).createOrReplaceTempView(f"schema_of_{name}")
    return query.table_schemas(spark).where(F.col("table").startswith("schema_of_")).select("table", "column_name")


# Spans -----------------------------------------------------------------------------


def failed_span_report_size(spark: SparkSession, d: str) -> DataFrame:
    return spans.failed_spans(roles.spans(spark, d)).agg(F.count(F.lit(1)).alias("failed"))


def corrupt_spans(spark: SparkSession, d: str) -> DataFrame:
    """A log in which every seventh line is cut off: what is readable, and what is not."""
    path = _scratch(spark, "corrupt")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("span_id"), F.col("event_type").alias("name")))
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 2)")).otherwise(F.col("line"))
    events = roles.table(spark, d, "events").select("event_id", line.alias("line"))
    events.select(cut.alias("value")).write.text(path)
    good = span_log.read_spans(spark, path).select(F.lit("readable").alias("kind"))
    bad = span_log.corrupt_spans(spark, path).select(F.lit("corrupt").alias("kind"))
    return good.unionAll(bad).groupBy("kind").agg(F.count(F.lit(1)).alias("spans"))


def recent_spans(spark: SparkSession, d: str) -> DataFrame:
    return _naive(spans.recent_spans(roles.spans(spark, d), 25))


def trace_details(spark: SparkSession, d: str) -> DataFrame:
    flat = spans.trace_details(roles.spans(spark, d), TRACE_ID)
    return _naive(flat.withColumn("k", F.col("attributes")["k"]).drop("attributes", "events"))


def failed_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.failed_spans(roles.spans(spark, d)).select("span_id", "name", "status")


def stack_traces(spark: SparkSession, d: str) -> DataFrame:
    return spans.stack_traces(roles.spans(spark, d))


def span_projection(spark: SparkSession, d: str) -> DataFrame:
    return _naive(spans.span_summary(roles.spans(spark, d), "span_id"))


def span_listing(spark: SparkSession, d: str) -> DataFrame:
    return _naive(spans.span_listing(roles.spans(spark, d)))


def span_count(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_count(roles.spans(spark, d))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return spans.latency_summary(roles.spans(spark, d))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return spans.latency_percentiles(roles.spans(spark, d))


def latency_percentiles_approx(spark: SparkSession, d: str) -> DataFrame:
    """Whether each sketched percentile's exact rank is within the sketch's bound."""
    timed = spans.timed_spans(roles.spans(spark, d))
    sketched = timed.groupBy("name").agg(spans.duration_sketch(spans.PERCENTILES).alias("values"))
    return _within_bound(timed, sketched, 1 / spans.APPROX_ACCURACY)


def latency_sketch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Daily sketches stored, read back and merged: whether percentiles of the whole time are
    within the bound of one sketch."""
    path = _scratch(spark, "sketches")
    log = roles.spans(spark, d)
    spans.latency_sketches(log, "1 day").write.parquet(path)
    merged = spans.merged_percentiles(spark.read.parquet(path))
    return _within_bound(spans.timed_spans(log), merged, percentiles.rank_error())


def _within_bound(timed: DataFrame, sketched: DataFrame, bound: float) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in spans.PERCENTILES])
    each = sketched.select("name", F.explode(F.arrays_zip(wanted.alias("p"), "values")).alias("z"))
    each = each.select("name", F.col("z.p").alias("p"), F.col("z.values").alias("sketched"))
    ranks = timed.join(each, "name").groupBy("name", "p").agg(
        F.avg((F.col("duration_ms") < F.col("sketched")).cast("int")).alias("below"),
        F.avg((F.col("duration_ms") <= F.col("sketched")).cast("int")).alias("up_to"),
    )
    within = (F.col("below") <= F.col("p") + bound) & (F.col("up_to") >= F.col("p") - bound)
    return ranks.select("name", "p", within.alias("within_bound"))


def _naive(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, the way the source table keeps them."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


# Conversations ---------------------------------------------------------------------


def latest_user_message(spark: SparkSession, d: str) -> DataFrame:
    return conversations.latest_user_message(roles.table(spark, d, "conversations"))


def intent_tags(spark: SparkSession, d: str) -> DataFrame:
    return conversations.tag_intents(roles.table(spark, d, "conversations"), PROSE_INTENTS, "other")


def diagnostic_intents(spark: SparkSession, d: str) -> DataFrame:
    documents = roles.table(spark, d, "documents")
    return conversations.tag_texts(documents, "text").select("doc_id", "intent")


# Sources, sinks, whole jobs and streams ---------------------------------------------


def stored_tables(spark: SparkSession, d: str) -> DataFrame:
    """Both tables written as partitioned Parquet, opened again and queried."""
    root = _scratch(spark, "store")
    encounters = store.with_start_year(_encounters(spark, d))
    store.export_tables(
        {store.PATIENTS: _patients(spark, d), store.ENCOUNTERS: encounters},
        root,
        {store.PATIENTS: ["age_bucket"], store.ENCOUNTERS: ["start_year"]},
    )
    opened = store.open_store(spark, root, [store.PATIENTS, store.ENCOUNTERS])
    return _rounded(
        summary.clinical_summary(opened[store.PATIENTS], opened[store.ENCOUNTERS]),
        "total_clinical_cost",
    )


def bucketed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Both tables bucketed by patient, joined and summed where they lie."""
    root = _scratch(spark, "buckets")
    tables = {store.PATIENTS: _patients(spark, d), store.ENCOUNTERS: _encounters(spark, d)}
    store.export_bucketed(tables, root, joins.KEY, 8, files_per_bucket=2)
    opened = store.open_store(spark, root, tables)
    return _rounded(
        summary.clinical_summary(opened[store.PATIENTS], opened[store.ENCOUNTERS]), "total_clinical_cost"
    )


def store_survives_failed_write(spark: SparkSession, d: str) -> DataFrame:
    """Two tables replaced by a job whose second table fails after most of its rows: the store
    still has both old ones, here counted by age group and year."""
    root = _scratch(spark, "survives")
    patients, encounters = _patients(spark, d), _encounters(spark, d)
    store.export_tables({store.PATIENTS: patients, store.ENCOUNTERS: encounters}, root)
    broken = F.when(F.col("cost") > 400_000, F.raise_error(F.lit("lost"))).otherwise(F.col("cost"))
    replaced = {
        store.PATIENTS: patients.withColumn("age_bucket", F.lit("replaced")),
        store.ENCOUNTERS: encounters.withColumn("cost", broken.cast("double") * 0).withColumn("start_time", F.lit("0")),
    }
    failed = False
    try:
        store.export_tables(replaced, root)
    except PySparkException:
        failed = True
    opened = store.open_store(spark, root, [store.PATIENTS, store.ENCOUNTERS])
    ages = opened[store.PATIENTS].select(F.col("age_bucket").alias("group"))
    years = store.with_start_year(opened[store.ENCOUNTERS]).select(F.col("start_year").alias("group"))
    rows = ages.unionAll(years).groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("write_failed", F.lit(failed))


def csv_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Encounters through CSV files and back, then de-identified."""
    path = _scratch(spark, "csv")
    roles.encounters(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return transforms.deidentify_encounters(tabular.read_encounters(spark, path), SALT)


def csv_to_store(spark: SparkSession, d: str) -> DataFrame:
    """The whole job from CSV files to the stored summary."""
    root = _scratch(spark, "job")
    run_pipeline(
        spark,
        *_csv_inputs(spark, d, root),
        f"{root}/store",
        SALT,
        span_log=f"{root}/spans",
        reference_date=REFERENCE_DATE,
    )
    stored = store.open_store(spark, f"{root}/store", [store.SUMMARY])[store.SUMMARY]
    return _rounded(stored, "total_clinical_cost")


def _csv_inputs(spark: SparkSession, d: str, root: str) -> tuple[str, str]:
    for name, df in (("patients", roles.patients(spark, d)), ("encounters", roles.encounters(spark, d))):
        df.write.option("header", True).option("escape", '"').csv(f"{root}/{name}")
    return f"{root}/patients", f"{root}/encounters"


def csv_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    """Files in which every fifth row has a cell too many: how many are found. Each input
    partition becomes a file that begins with the header."""
    path = _scratch(spark, "bad-rows")
    key = F.col("o_orderkey").cast("string")
    row = F.concat_ws(",", key, F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, "extra"))
    # Whole rows as the one column of a CSV file, whose name is the header.
    rows = roles.table(spark, d, "orders").select(row.alias("Id,STATUS"))
    whole = rows.write.option("header", True).option("sep", "\x01").option("emptyValue", "")
    whole.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tabular.count_bad_rows(spark, path)


def input_check(spark: SparkSession, d: str) -> DataFrame:
    check = tabular.validate_inputs(spark, *_csv_inputs(spark, d, _scratch(spark, "check")))
    rows = [("patients", c) for c in check.missing_patients] + [("encounters", c) for c in check.missing_encounters]
    return spark.createDataFrame(rows, "input string, missing string")


def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a run of the job reports, and the status its log has of each stage."""
    root = _scratch(spark, "counts")
    done = run_pipeline(
        spark, *_csv_inputs(spark, d, root), f"{root}/store", SALT, f"{root}/spans", REFERENCE_DATE, key_hex_len=16,
        exact_distinct=True,
    )
    names = ("processed_patients", "unique_patients", "unique_pseudonyms", "processed_encounters", "merged_rows",
             "matched_rows", "matched_patients")
    stages = span_log.read_spans(spark, f"{root}/spans").select("name", "status")
    counts = F.create_map(*[F.lit(x) for n in names for x in (n, int(getattr(done, n)))])
    return stages.select(F.concat_ws(":", "name", "status").alias("item"), F.lit(1).cast("bigint").alias("n")).unionAll(
        spark.range(1).select(F.explode(counts).alias("item", "n")).select("item", F.col("n").cast("bigint"))
    )


def people_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three overlapping shares of the patients written with a sketch each, and their union:
    whether each estimate is within the bound."""
    root, patients = _scratch(spark, "runs"), roles.patients(spark, d)
    share = F.col("Id").cast("bigint") % 4
    for run in range(3):
        some = patients.where((share == run) | (share == run + 1))
        table = transforms.deidentify_patients(some, SALT, REFERENCE_DATE, with_metrics=True)
        write_logged(spark, table, f"{root}/store", store.PATIENTS, f"{root}/spans")
    whole = distinct_over_runs(span_log.read_spans(spark, f"{root}/spans"), PEOPLE_SKETCH).first()
    people = patients.agg(F.count_distinct("Id")).first()[0]
    within = abs(whole.distinct_values - people) <= DISTINCT_ERROR * people
    return spark.range(1).select(F.lit(whole.runs).alias("runs"), F.lit(within).alias("within_bound"))


def failure_span(spark: SparkSession, d: str) -> DataFrame:
    """A job that meets a cost cell with personal data: its error spans, free of that."""
    root = _scratch(spark, "failure")
    cost = F.when(F.col("COST") > 0, "Jane Doe 123-45-6789")
    roles.patients(spark, d).write.option("header", True).csv(f"{root}/patients")
    roles.encounters(spark, d).withColumn("COST", cost).write.option("header", True).option("escape", '"').csv(
        f"{root}/encounters"
    )
    try:
        run_pipeline(spark, f"{root}/patients", f"{root}/encounters", f"{root}/store", SALT, f"{root}/spans")
    except PySparkException:
        pass
    logged = span_log.read_spans(spark, f"{root}/spans").where("status = 'ERROR'")
    everything = F.to_json(F.struct(*[F.col(c) for c in logged.columns]))
    return logged.select("name", "status_description", everything.contains("Jane").alias("quotes_data"))


def span_log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Raw measurements finished as spans, appended to a log and read back."""
    path = _scratch(spark, "spans")
    source = roles.spans(spark, d)
    ended = source.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        (F.unix_micros("start_time") * 1000).alias("start_ns"),
        (F.unix_micros("end_time") * 1000).alias("end_ns"),
        F.col("status").alias("status_code"),
        "status_description",
        "attributes",
        "events",
    )
    span_log.append_spans(span_log.finish_spans(ended), path)
    read = span_log.read_spans(spark, path)
    return _naive(
        read.withColumn("k", F.col("attributes")["k"]).drop("attributes", "events", "parent_span_id")
    )


def span_log_compaction(spark: SparkSession, d: str) -> DataFrame:
    """A log of many small files, some lines cut off, compacted between two appends: spans by
    name and unreadable lines, as before."""
    path = _scratch(spark, "compaction")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("span_id"), F.col("event_type").alias("name")))
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 2)")).otherwise(F.col("line"))
    events = roles.table(spark, d, "events").select("event_id", line.alias("line"))
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).repartition(12).select(cut).write.mode("append").text(path)
        span_log.compact_log(spark, path)
    good = span_log.read_spans(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("spans"))
    bad = span_log.corrupt_spans(spark, path).agg(F.count(F.lit(1)).alias("spans"))
    return good.unionAll(bad.select(F.lit("unreadable").alias("name"), "spans"))


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream. The braces make the path a pattern, which may name a
    single file as well as a directory."""
    schema = roles.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{{events.parquet}}")


def stream_latency(spark: SparkSession, d: str) -> DataFrame:
    """Windowed latency kept up to date by a stream over the events."""
    root, keys = _scratch(spark, "latency"), ("window_start", "window_end", "name")
    live = span_stream.windowed_latency(roles.as_spans(_events_stream(spark, d)), "1 day")
    span_stream.upsert_table(live, f"{root}/table", f"{root}/checkpoint", keys, drain=True).awaitTermination()
    return _naive(span_stream.read_upserts(spark, f"{root}/table", keys))


def stream_unique_spans(spark: SparkSession, d: str) -> DataFrame:
    """A log that delivers every span twice, read once each."""
    root = _scratch(spark, "unique")
    live = roles.as_spans(_events_stream(spark, d))
    unique = span_stream.unique_spans(live.unionAll(live)).select("span_id", "name")
    span_stream.append_to_table(unique, f"{root}/table", f"{root}/checkpoint", drain=True).awaitTermination()
    return spark.read.parquet(f"{root}/table")


def stream_failed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Failed spans picked out of a stream over the events."""
    root = _scratch(spark, "alerts")
    alerts = spans.failed_spans(roles.as_spans(_events_stream(spark, d)))
    alerts = alerts.select("span_id", "name", "status")
    span_stream.append_to_table(alerts, f"{root}/table", f"{root}/checkpoint", drain=True).awaitTermination()
    return spark.read.parquet(f"{root}/table")


def stream_deid_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Device encounters de-identified on arrival by the batch transform."""
    root = _scratch(spark, "deid")
    live = transforms.deidentify_encounters(roles.device_columns(_events_stream(spark, d)), SALT)
    span_stream.append_to_table(live, f"{root}/table", f"{root}/checkpoint", drain=True).awaitTermination()
    return spark.read.parquet(f"{root}/table")


def queries() -> dict[str, Query]:
    named = [
        pseudonymize,
        date_offset,
        shift_dates,
        age_bucket,
        coarsen_zip,
        redact_notes,
        redact_pages,
        redact_each,
        default_notes,
        result_preview,
        deid_encounters_parties,
        pseudonym_map,
        mapping_override,
        zip_population,
        patient_encounter_join,
        patient_device_join,
        join_match_counts,
        missing_id_join,
        missing_id_counts,
        orphan_encounters,
        clinical_summary,
        clinical_summary_of_raw,
        device_summary,
        clinical_summary_reduced,
        clinical_stats,
        age_histogram,
        total_cost,
        pii_scan,
        page_pii_scan,
        audit_report,
        audit_all_text,
        pseudonym_collisions,
        missing_patient_ids,
        read_only_sql,
        sql_all_rows,
        sql_records,
        table_schemas,
        failed_span_report_size,
        corrupt_spans,
        unreadable_dates,
        zip_population_alphanumeric,
        csv_bad_rows,
        input_check,
        pipeline_counts,
        people_over_runs,
        failure_span,
        recent_spans,
        trace_details,
        failed_spans,
        stack_traces,
        span_projection,
        span_listing,
        span_count,
        latency_summary,
        latency_percentiles,
        latency_percentiles_approx,
        latency_sketch_merge,
        latest_user_message,
        intent_tags,
        diagnostic_intents,
        stored_tables,
        bucketed_summary,
        store_survives_failed_write,
        csv_encounters,
        csv_to_store,
        span_log_roundtrip,
        span_log_compaction,
        stream_latency,
        stream_unique_spans,
        stream_failed_spans,
        stream_deid_encounters,
    ]
    return {
        "deid_patients": _patients,
        "deid_encounters": _encounters,
        "deid_device_encounters": _device_encounters,
    } | {q.__name__: q for q in named}
