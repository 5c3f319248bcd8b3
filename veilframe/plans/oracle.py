"""Results of the catalog's queries in plain SQL, written independently of the Spark code."""

from __future__ import annotations

from veilframe.functions import redaction
from veilframe.operators.conversations import DIAGNOSTIC_INTENTS
from veilframe.plans.catalog import CHECKS, PROSE_INTENTS, TRACE_ID
from veilframe.plans.roles import REFERENCE_DATE, SALT

PATTERNS = {
    "ssn": (redaction.SSN, redaction.SSN_MASK, "g"),
    "phone": (redaction.PHONE, redaction.PHONE_MASK, "g"),
    "email": (redaction.EMAIL, redaction.EMAIL_MASK, "g"),
    "mrn": (redaction.MRN, redaction.MRN_MASK, "gi"),
}


def key(raw_id: str, prefix: str = "DEID-", digits: int = 12) -> str:
    return f"'{prefix}' || upper(substr(sha256('{SALT}_' || {raw_id}), 1, {digits}))"


def encounter_id(raw_id: str) -> str:
    return f"'ENC-' || upper(substr(md5({raw_id}), 1, 10))"


def offset(raw_id: str) -> str:
    """The digest modulo 360, eight hex digits at a time (2^32 mod 360 is 256)."""
    rest = "0"
    for start in (1, 9, 17, 25):
        chunk = f"('0x' || substr(md5('offset_{SALT}_' || {raw_id}), {start}, 8))::BIGINT"
        rest = f"(({rest}) * 256 + {chunk}) % 360"
    return f"CAST(COALESCE(NULLIF(({rest}) - 180, 0), 42) AS INTEGER)"


def iso(date: str) -> str:
    return f"strftime({date}, '%Y-%m-%d')"


def redact(text: str, *checks: str) -> str:
    for check in checks:
        pattern, mask, flags = PATTERNS[check]
        text = f"regexp_replace({text}, '{pattern}', '{mask}', '{flags}')"
    return text


def pii_rows(text: str, check: str) -> str:
    pattern, _, flags = PATTERNS[check]
    return f"count(*) FILTER (WHERE regexp_matches({text}, '{pattern}', '{flags.replace('g', '') or 'c'}'))"


AGE = f"""(year(DATE '{REFERENCE_DATE}') - year(birth)
    - CASE WHEN strftime(DATE '{REFERENCE_DATE}', '%m%d') < strftime(birth, '%m%d') THEN 1 ELSE 0 END)"""
BUCKET = f"""CASE WHEN {AGE} >= 90 THEN '90+' WHEN {AGE} < 18 THEN '0-17'
    ELSE (({AGE} // 10) * 10)::VARCHAR || '-' || (({AGE} // 10) * 10 + 9)::VARCHAR END"""

RAW_PATIENTS = """raw_patients AS (
    SELECT c_custkey::VARCHAR AS id,
        DATE '1920-01-01' + CAST(c_custkey * 37 % 38000 AS INTEGER) AS birth,
        CASE WHEN c_custkey % 11 = 0 THEN DATE '2021-01-01' + CAST(c_custkey % 1000 AS INTEGER) END AS death,
        CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS race,
        n_name AS city, r_name AS state, lpad(c_custkey::VARCHAR, CAST(greatest(5, length(c_custkey::VARCHAR)) AS INTEGER), '0') AS zip
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey)"""
RAW_ENCOUNTERS = """raw_encounters AS (
    SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient,
        o_orderdate::DATE AS start, o_orderdate::DATE + CAST(o_orderkey % 5 AS INTEGER) AS stop,
        (o_orderkey % 100)::VARCHAR AS provider, (o_orderkey % 7)::VARCHAR AS payer,
        o_orderpriority AS class, o_orderstatus AS code, lower(o_orderpriority) AS description,
        o_totalprice AS cost,
        CASE o_orderkey % 4
            WHEN 1 THEN 'SSN 123-45-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' on file.'
            WHEN 2 THEN 'Patient ID: ' || o_custkey || ' call (555) 010-'
                || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')
            WHEN 3 THEN 'Write to user' || o_custkey || '@example.org, mrn:A-'
                || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END AS notes
    FROM orders)"""
NOTE = "COALESCE(notes, 'Patient presented for ' || description || '.')"
PATIENTS = f"""{RAW_PATIENTS}, deid_patients AS (
    SELECT {key("id")} AS patient_deid_key, gender, race, 'UNKNOWN' AS ethnicity,
        {iso(f"birth + {offset('id')}")} AS shifted_birth_date,
        {iso(f"death + {offset('id')}")} AS shifted_death_date,
        {BUCKET} AS age_bucket, city, state, substr(zip, 1, 3) || 'XX' AS coarsened_zip
    FROM raw_patients)"""
ENCOUNTERS = f"""{RAW_ENCOUNTERS}, deid_encounters AS (
    SELECT {encounter_id("id")} AS encounter_id, {key("patient")} AS patient_deid_key,
        {iso(f"start + {offset('patient')}")} AS start_time,
        {iso(f"stop + {offset('patient')}")} AS end_time,
        class AS encounter_class, code AS clinical_code, description, cost,
        {redact(NOTE, *CHECKS)} AS clinical_notes,
        {key("provider", "PROV-")} AS provider_deid_key, CAST(NULL AS VARCHAR) AS organization, payer
    FROM raw_encounters)"""
DEVICES = f"""device_encounters AS (
    SELECT {encounter_id("event_id::VARCHAR")} AS encounter_id,
        {key("user_id::VARCHAR")} AS patient_deid_key,
        {iso(f"ts::DATE + {offset('user_id::VARCHAR')}")} AS start_time,
        CAST(NULL AS VARCHAR) AS end_time, event_type AS encounter_class, '' AS clinical_code,
        '' AS description, value AS cost,
        'Patient presented for routine evaluation.' AS clinical_notes
    FROM events)"""


def summarised(encounters: str) -> str:
    return f"""SELECT p.patient_deid_key, gender, race, ethnicity, age_bucket,
        COUNT(encounter_id) AS total_encounters,
        ROUND(COALESCE(SUM(cost), 0.0), 2) AS total_clinical_cost,
        MIN(start_time) AS first_encounter_time, MAX(end_time) AS last_encounter_time
    FROM deid_patients p LEFT JOIN {encounters} e ON p.patient_deid_key = e.patient_deid_key
    GROUP BY p.patient_deid_key, gender, race, ethnicity, age_bucket"""


SUMMARY = f"WITH {PATIENTS}, {ENCOUNTERS} {summarised('deid_encounters')}"
SPANS = """spans AS (
    SELECT user_id::VARCHAR AS trace_id, lpad(event_id::VARCHAR, 16, '0') AS span_id, event_type AS name,
        ts - to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS start_time, ts AS end_time,
        value AS duration_ms, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
        CASE WHEN event_type = 'error' THEN 'event ' || event_id ELSE '' END AS status_description,
        json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS parent_span_id
    FROM events)"""
SPAN_SUMMARY = "trace_id, name, status, duration_ms, start_time, end_time, NULLIF(status_description, '') AS error"
LATENCY = """COUNT(*) AS invocations, ROUND(AVG(value), 2) AS avg_ms,
    ROUND(MIN(value), 2) AS min_ms, ROUND(MAX(value), 2) AS max_ms"""
LATEST = """latest AS (
    SELECT c.conv_id, COALESCE(lower(m.text), '') AS message
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN (SELECT conv_id, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
               FROM conversations WHERE role = 'user') m ON c.conv_id = m.conv_id AND m.rn = 1)"""


def ladder(text: str, intents, default: str) -> str:
    cases = []
    for label, words in intents:
        hits = " OR ".join(f"contains({text}, '{word}')" for word in words)
        cases.append(f"WHEN {hits} THEN '{label}'")
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


def scan(table: str, column: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{check}' AS "check", '{column}' AS "column",
            {pii_rows(column, check)} AS violations, COUNT(*) AS total_rows FROM {table}"""
        for check in CHECKS
    )


def audited(table: str, notes: str | None, leaked: list[str]) -> list[str]:
    def row(check: str, column: str, violations: str) -> str:
        return f"""SELECT '{table}' AS "table", '{check}' AS "check", {column} AS "column",
            {violations} AS violations, COUNT(*) AS total_rows FROM {table}"""

    rows = [row("forbidden_column", f"'{c}'", "1") for c in leaked]
    rows = rows or [row("forbidden_column", "CAST(NULL AS VARCHAR)", "0")]
    if notes:
        label = notes.upper() if table.startswith("raw") else notes
        rows += [row(check, f"'{label}'", pii_rows(notes, check)) for check in CHECKS]
    return rows


AUDIT_ROWS = [
    *audited("deid_patients", None, []),
    """SELECT 'deid_patients', 'birth_date_of_oldest', 'shifted_birth_date',
        COUNT(*) FILTER (WHERE age_bucket = '90+' AND shifted_birth_date IS NOT NULL), COUNT(*)
    FROM deid_patients""",
    *audited("deid_encounters", "clinical_notes", []),
    """SELECT 'deid_encounters', 'orphan_encounter', 'patient_deid_key', COUNT(*) FILTER (WHERE
        patient_deid_key NOT IN (SELECT patient_deid_key FROM deid_patients)), COUNT(*)
    FROM deid_encounters""",
    *audited("raw_patients", None, ["SSN", "FIRST"]),
    *audited("raw_encounters", "notes", []),
]

SOME_WITHOUT_ID = f"""{RAW_PATIENTS}, {RAW_ENCOUNTERS},
    known_patients AS (SELECT * REPLACE (CASE WHEN id::BIGINT % 7 <> 0 THEN id END AS id) FROM raw_patients),
    known_encounters AS (SELECT * REPLACE (CASE WHEN id::BIGINT % 5 <> 0 THEN patient END AS patient)
        FROM raw_encounters)"""
DEID_ENCOUNTERS = f"""WITH {ENCOUNTERS}
    SELECT * EXCLUDE (provider_deid_key, organization, payer) FROM deid_encounters"""
DEID_DEVICES = f"WITH {DEVICES} SELECT * FROM device_encounters"
FAILED = f"WITH {SPANS} SELECT span_id, name, status FROM spans WHERE name = 'error'"


def oracle_sql() -> dict[str, str]:
    return {
        "deid_patients": f"WITH {PATIENTS} SELECT * FROM deid_patients",
        "deid_encounters": DEID_ENCOUNTERS,
        "deid_device_encounters": DEID_DEVICES,
        "pseudonymize": f"""SELECT o_orderkey, {key("o_custkey")} AS patient_deid_key,
            {encounter_id("o_orderkey::VARCHAR")} AS encounter_id,
            {key("o_custkey", "PROV-")} AS provider_deid_key FROM orders""",
        "date_offset": f"SELECT c_custkey, {offset('c_custkey')} AS offset_days FROM customer",
        "shift_dates": f"""WITH {RAW_ENCOUNTERS} SELECT id AS "Id",
            {iso(f"start + {offset('patient')}")} AS start_time,
            {iso(f"stop + {offset('patient')}")} AS end_time FROM raw_encounters""",
        "age_bucket": f"""WITH {RAW_PATIENTS} SELECT id AS "Id", {BUCKET} AS age_bucket FROM raw_patients""",
        "coarsen_zip": f"""WITH {RAW_PATIENTS}
            SELECT id AS "Id", substr(zip, 1, 3) || 'XX' AS coarsened_zip FROM raw_patients""",
        "redact_notes": f"SELECT doc_id, {redact('text', *CHECKS)} AS redacted FROM documents",
        "redact_pages": f"SELECT page_id, {redact('html', *CHECKS)} AS redacted FROM pages",
        "redact_each": f"""WITH {RAW_ENCOUNTERS} SELECT id AS "Id", {redact("notes", "ssn")} AS no_ssn,
            {redact("notes", "phone")} AS no_phone, {redact("notes", "email")} AS no_email,
            {redact("notes", "mrn")} AS no_mrn FROM raw_encounters""",
        "default_notes": f"""WITH {RAW_ENCOUNTERS} SELECT id AS "Id", {NOTE} AS note FROM raw_encounters""",
        "result_preview": "SELECT doc_id, substr(text, 1, 500) AS preview FROM documents",
        "deid_encounters_parties": f"WITH {ENCOUNTERS} SELECT * FROM deid_encounters",
        "pseudonym_map": f"""SELECT DISTINCT c_custkey::VARCHAR AS raw_id,
            {key("c_custkey")} AS patient_deid_key FROM customer""",
        "mapping_override": f"""WITH {RAW_ENCOUNTERS} SELECT {encounter_id("id")} AS encounter_id,
            CASE WHEN patient IN (SELECT s_suppkey::VARCHAR FROM supplier)
                THEN 'KNOWN-' || patient ELSE {key("patient")} END AS patient_deid_key,
            {iso(f"start + {offset('patient')}")} AS start_time FROM raw_encounters""",
        "zip_population": f"""WITH {PATIENTS}, areas AS (
                SELECT substr(lpad(c_custkey::VARCHAR, CAST(greatest(5, length(c_custkey::VARCHAR)) AS INTEGER), '0'), 1, 3) || 'XX' AS area,
                    sum(c_nationkey) * 16 AS people FROM customer GROUP BY 1)
            SELECT patient_deid_key,
                CASE WHEN people > 20000 THEN coarsened_zip ELSE '000XX' END AS coarsened_zip
            FROM deid_patients LEFT JOIN areas ON coarsened_zip = area""",
        "patient_encounter_join": f"""WITH {PATIENTS}, {ENCOUNTERS}
            SELECT p.*, e.* EXCLUDE (patient_deid_key, provider_deid_key, organization, payer)
            FROM deid_patients p LEFT JOIN deid_encounters e ON p.patient_deid_key = e.patient_deid_key""",
        "patient_device_join": f"""WITH {PATIENTS}, {DEVICES}
            SELECT p.patient_deid_key, age_bucket, encounter_id, encounter_class, cost
            FROM deid_patients p LEFT JOIN device_encounters e ON p.patient_deid_key = e.patient_deid_key""",
        "join_match_counts": f"""WITH {PATIENTS}, {DEVICES}
            SELECT COUNT(*) AS merged_rows, COUNT(encounter_id) AS matched_rows,
                COUNT(DISTINCT p.patient_deid_key) FILTER (WHERE encounter_id IS NOT NULL)
                    AS matched_patients
                ,(SELECT COUNT(*) FROM customer WHERE c_custkey IS NULL) AS patients_without_id
                ,(SELECT COUNT(*) FROM events WHERE user_id IS NULL) AS encounters_without_id
            FROM deid_patients p LEFT JOIN device_encounters e ON p.patient_deid_key = e.patient_deid_key""",
        "missing_id_join": f"""WITH {SOME_WITHOUT_ID}
            SELECT {key("COALESCE(p.id, 'nan')")} AS patient_deid_key, {BUCKET} AS age_bucket,
                CASE WHEN e.id IS NOT NULL THEN {encounter_id("e.id")} END AS encounter_id
            FROM known_patients p LEFT JOIN known_encounters e ON p.id = e.patient""",
        "missing_id_counts": f"""WITH {SOME_WITHOUT_ID}, people AS (SELECT id, COUNT(*) AS copies FROM known_patients GROUP BY id),
                visits AS (SELECT patient, COUNT(*) AS n FROM known_encounters GROUP BY patient)
            SELECT CAST(SUM(copies * COALESCE(n, 1)) AS BIGINT) AS merged_rows,
                CAST(SUM(copies * COALESCE(n, 0)) AS BIGINT) AS matched_rows, COUNT(n) AS matched_patients,
                (SELECT COUNT(*) FROM known_patients WHERE id IS NULL) AS patients_without_id,
                (SELECT COUNT(*) FROM known_encounters WHERE patient IS NULL) AS encounters_without_id, linked
            FROM (SELECT linked, copies, n FROM people CROSS JOIN (VALUES (true), (false)) AS m(linked)
                LEFT JOIN visits ON id = patient OR (linked AND id IS NULL AND patient IS NULL)) GROUP BY linked""",
        "orphan_encounters": f"""SELECT {key("o_custkey")} AS patient_deid_key, COUNT(*) AS encounters
            FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey""",
        "clinical_summary": SUMMARY,
        "clinical_summary_of_raw": SUMMARY,
        "device_summary": f"WITH {PATIENTS}, {DEVICES} {summarised('device_encounters')}",
        "clinical_summary_reduced": f"""SELECT * EXCLUDE (first_encounter_time, last_encounter_time)
            FROM ({SUMMARY})""",
        "clinical_stats": f"""SELECT COUNT(*) AS total_patients,
            COUNT(DISTINCT age_bucket) AS age_bucket_count, COUNT(DISTINCT gender) AS gender_count,
            CAST(SUM(total_encounters) AS BIGINT) AS aggregated_encounters,
            ROUND(SUM(total_clinical_cost), 2) AS aggregated_clinical_cost,
            ROUND(AVG(total_clinical_cost), 2) AS avg_cost_per_patient FROM ({SUMMARY})""",
        "age_histogram": f"""WITH {PATIENTS} SELECT age_bucket, COUNT(*) AS patients
            FROM deid_patients GROUP BY age_bucket ORDER BY patients DESC, age_bucket""",
        "total_cost": """SELECT COUNT(*) AS processed_encounters,
            ROUND(SUM(o_totalprice), 2) AS total_clinical_cost FROM orders""",
        "pii_scan": scan("documents", "text"),
        "page_pii_scan": scan("pages", "html"),
        "audit_report": f"WITH {PATIENTS}, {ENCOUNTERS} " + "\nUNION ALL ".join(AUDIT_ROWS),
        "audit_all_text": f"""WITH {RAW_ENCOUNTERS}, visits AS (SELECT id, description, notes,
                CASE WHEN id::BIGINT % 9 = 0 THEN 'some day' ELSE strftime(start, '%Y-%m-%d') END AS start
                FROM raw_encounters)
            SELECT 'visits' AS "table", 'forbidden_column' AS "check", CAST(NULL AS VARCHAR) AS "column",
                0 AS violations, COUNT(*) AS total_rows FROM visits
            UNION ALL SELECT 'visits', 'unreadable', 'START', COUNT(*) FILTER (id::BIGINT % 9 = 0), COUNT(*) FROM visits
            UNION ALL """ + "\nUNION ALL ".join(
            f"""SELECT 'visits', '{check}', '{label}', {pii_rows(column, check)}, COUNT(*) FROM visits"""
            for label, column in (("Id", "id"), ("START", "start"), ("DESCRIPTION", "description"), ("NOTES", "notes"))
            for check in CHECKS
        ),
        "pseudonym_collisions": f"""SELECT CAST(SUM(ids) AS BIGINT) AS raw_ids, COUNT(*) AS pseudonyms,
                CAST(COALESCE(SUM(ids) FILTER (WHERE ids > 1), 0) AS BIGINT) AS colliding_ids
            FROM (SELECT {key("o_custkey", digits=4)} AS k, COUNT(DISTINCT o_custkey) AS ids
                  FROM orders GROUP BY 1)""",
        "missing_patient_ids": """SELECT COUNT(*) FILTER (WHERE o_custkey IS NULL) AS missing_ids,
            COUNT(*) AS total_rows FROM orders""",
        "read_only_sql": f"""WITH {PATIENTS}, {ENCOUNTERS}
            SELECT age_bucket, state, COUNT(*) AS visits, ROUND(SUM(cost), 2) AS cost
            FROM deid_patients p JOIN deid_encounters e ON p.patient_deid_key = e.patient_deid_key
            GROUP BY age_bucket, state""",
        "sql_all_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
        "sql_records": """SELECT o_orderstatus, COUNT(*) AS n, true AS truncated FROM orders
            GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 2""",
        "table_schemas": """SELECT 'schema_of_' || table_name AS "table", column_name FROM information_schema.columns
            WHERE table_name IN ('orders', 'customer')""",
        "failed_span_report_size": f"SELECT COUNT(*) AS failed FROM ({FAILED})",
        "corrupt_spans": """SELECT CASE WHEN event_id % 7 = 0 THEN 'corrupt' ELSE 'readable' END AS kind,
            COUNT(*) AS spans FROM events GROUP BY 1""",
        "unreadable_dates": """SELECT o_orderkey, o_orderkey % 9 = 8 AS unreadable,
            CASE WHEN o_orderkey % 9 <> 8 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date FROM orders""",
        "zip_population_alphanumeric": """SELECT c_custkey, CASE WHEN c_custkey % 7 * 10000 > 20000
            THEN 'M' || c_custkey % 7 || 'VXX' ELSE '000XX' END AS coarsened_zip FROM customer""",
        "csv_bad_rows": "SELECT COUNT(*) AS bad_rows FROM orders WHERE o_orderkey % 5 = 0",
        "input_check": """SELECT unnest(['patients', 'encounters']) AS input,
            unnest(['ETHNICITY', 'ORGANIZATION']) AS missing""",
        "pipeline_counts": """SELECT unnest(['validate_inputs:OK', 'deidentify_patients:OK', 'deidentify_encounters:OK',
                'merge:OK', 'export:OK']) AS item, 1 AS n
            UNION ALL SELECT unnest(['processed_patients', 'unique_patients', 'unique_pseudonyms']),
                (SELECT COUNT(*) FROM customer)
            UNION ALL SELECT unnest(['processed_encounters', 'matched_rows']), (SELECT COUNT(*) FROM orders)
            UNION ALL SELECT 'merged_rows', (SELECT COUNT(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
            UNION ALL SELECT 'matched_patients', (SELECT COUNT(DISTINCT o_custkey) FROM orders)""",
        "people_over_runs": """SELECT 3 AS runs, COUNT(*) > 0 AS within_bound FROM customer""",
        "failure_span": """SELECT unnest(['deidentify_encounters', 'pipeline_failure']) AS name,
            'SparkRuntimeException: USER_RAISED_EXCEPTION' AS status_description, false AS quotes_data""",
        "latency_percentiles_approx": """SELECT name, p, true AS within_bound FROM
            (SELECT DISTINCT event_type AS name FROM events WHERE value > 0),
            (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS p)""",
        "latency_sketch_merge": """SELECT name, p, true AS within_bound FROM
            (SELECT DISTINCT event_type AS name FROM events WHERE value > 0),
            (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS p)""",
        "span_log_compaction": """SELECT CASE WHEN event_id % 7 = 0 THEN 'unreadable' ELSE event_type END AS name,
            COUNT(*) AS spans FROM events GROUP BY 1""",
        "stream_unique_spans": f"WITH {SPANS} SELECT span_id, name FROM spans",
        "recent_spans": f"""WITH {SPANS} SELECT {SPAN_SUMMARY} FROM (
            SELECT * FROM spans ORDER BY end_time DESC, span_id DESC LIMIT 25)""",
        "trace_details": f"""WITH {SPANS} SELECT * FROM spans WHERE trace_id = '{TRACE_ID}'""",
        "failed_spans": FAILED,
        "stack_traces": f"""WITH {SPANS} SELECT trace_id, span_id, name,
            'error in ' || status_description AS stack_trace FROM spans WHERE name = 'error'""",
        "span_projection": f"WITH {SPANS} SELECT {SPAN_SUMMARY}, span_id FROM spans",
        "span_listing": f"WITH {SPANS} SELECT name, status, duration_ms, start_time, end_time FROM spans",
        "span_count": "SELECT COUNT(*) AS spans FROM events",
        "latency_summary": f"""SELECT event_type AS name, {LATENCY}
            FROM events WHERE value > 0 GROUP BY event_type""",
        "latency_percentiles": """SELECT event_type AS name,
            ROUND(quantile_cont(value, 0.5), 2) AS p50_ms, ROUND(quantile_cont(value, 0.95), 2) AS p95_ms,
            ROUND(quantile_cont(value, 0.99), 2) AS p99_ms
            FROM events WHERE value > 0 GROUP BY event_type""",
        "latest_user_message": f"WITH {LATEST} SELECT * FROM latest",
        "intent_tags": f"""WITH {LATEST} SELECT conv_id, message,
            {ladder("message", PROSE_INTENTS, "other")} AS intent FROM latest""",
        "diagnostic_intents": f"""SELECT doc_id, {ladder("lower(text)", DIAGNOSTIC_INTENTS, "recent")} AS intent
            FROM documents""",
        "stored_tables": SUMMARY,
        "bucketed_summary": SUMMARY,
        "store_survives_failed_write": f"""WITH {PATIENTS}, {ENCOUNTERS}
            SELECT "group", COUNT(*) AS rows, (SELECT MAX(cost) > 400000 FROM deid_encounters) AS write_failed
            FROM (SELECT age_bucket AS "group" FROM deid_patients
                  UNION ALL SELECT substr(start_time, 1, 4) FROM deid_encounters) GROUP BY 1""",
        "csv_encounters": DEID_ENCOUNTERS,
        "csv_to_store": SUMMARY,
        "span_log_roundtrip": f"""WITH {SPANS} SELECT * EXCLUDE (parent_span_id)
            REPLACE (lpad(trace_id, 32, '0') AS trace_id) FROM spans""",
        "stream_latency": f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
            time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type AS name, {LATENCY}
            FROM events WHERE value > 0 GROUP BY ALL""",
        "stream_failed_spans": FAILED,
        "stream_deid_encounters": DEID_DEVICES,
    }
