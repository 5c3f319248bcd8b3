"""One query an operator, over its whole table, and results in SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    conversation_repair,
    decontamination,
    html_extraction,
    importance_resampling,
    language_model,
    license_scan,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.ledger(_documents(spark, sf_dir))
    return measured.select(
        "doc_id",
        *quality_rules.MEASURES,
        (~quality_rules.verdict(quality_rules.BASE)).alias("base_failed"),
        quality_rules.verdict(quality_rules.CURRENT).alias("kept"),
        "fail_bits",
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(_documents(spark, sf_dir)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir), with_text=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_lines(line_dedup.only(_documents(spark, sf_dir), "doc_id", "text"))
    return cleaned.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text"
    )


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(_read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(_read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "rule_ablation": rule_ablation,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_token_counts": op3_token_counts,
        "op4_packing": op4_packing,
        "op5_decontamination": op5_decontamination,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_license_scan": op7_license_scan,
        "op8_language_model": op8_language_model,
        "op9_simhash": op9_simhash,
        "op10_line_dedup": op10_line_dedup,
        "op11_html_extraction": op11_html_extraction,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_conversation_repair": op13_conversation_repair,
    }


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))"


def _ledger_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)
    return rf"""
    WITH parts AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, {_WORDS} AS words, {_LINES} AS lines
      FROM documents
    ), windows AS (
      SELECT r, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS win
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM parts WHERE len(words) >= 5)
    ), repeated AS (
      SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
    ), covered AS (
      SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY r
    ), measured AS (
      SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(body, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM parts LEFT JOIN covered USING (r)
    ), ledger AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM measured)"""


def _op1_sql() -> str:
    base, current = quality_rules.BASE.mask(), quality_rules.CURRENT.mask()
    return f"""{_ledger_sql()}
    SELECT *, fail_bits & {base} <> 0 AS base_failed, fail_bits & {current} = 0 AS kept FROM ledger"""


def _ablation_sql() -> str:
    bit = {r.name: 1 << r.bit for r in quality_rules.RULES}
    cases = ", ".join(
        f"('{p.version}', '{name}', {p.mask()}, {bit[name]})" for p in quality_rules.POLICIES for name in p.enforced
    )
    return f"""{_ledger_sql()}
    SELECT policy, rule, count(*) FILTER (fail_bits & own <> 0) AS failing,
      count(*) FILTER (fail_bits & enforced = 0) AS kept,
      count(*) FILTER (fail_bits & enforced & ~own = 0) AS kept_without_rule
    FROM ledger, (VALUES {cases}) AS c(policy, rule, enforced, own) GROUP BY policy, rule"""


def _op12_sql() -> str:
    """CRC-32 byte by byte, over a table made by its polynomial, for every distinct word."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""
    WITH shifts AS (
      SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
      FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
    ), docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents
    ), doc_words AS (SELECT r, unnest(words) AS word FROM docs
    ), target_words AS (SELECT unnest({words}) AS word FROM benchmark
    ), hashed AS (
      SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
          list_transform(range(0, CAST(length(hex(word)) / 2 AS BIGINT)),
            lambda i: CAST('0x' || substr(hex(word), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words), shifts
    ), in_docs AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (word) GROUP BY bucket
    ), in_target AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket
    ), gains AS (
      SELECT bucket, floor(1000 * ln(
        (coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM in_docs) + 10000)
        / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM in_target) + 10000)))) AS gain
      FROM in_docs FULL JOIN in_target USING (bucket)
    ), weights AS (
      SELECT r, sum(gain) AS weight FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r
    ), scored AS (
      SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
          (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
          / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM docs LEFT JOIN weights USING (r)
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
    )
    SELECT doc_id, n_features, weight, score,
      CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
    FROM placed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _op1_sql(),
        "rule_ablation": _ablation_sql(),
        "op12_importance_resampling": _op12_sql(),
    }
