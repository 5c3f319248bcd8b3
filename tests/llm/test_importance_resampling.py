"""Importance resampling beside a plain computation."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import zlib

import pytest

from tests.llm.conftest import ODD, lower
from veilframe.llm import importance_resampling, ranking
from veilframe.llm.storage import Workspace

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(documents, target):
    """{row: (doc_id, n_features, weight, score, rank)} by definition; documents are pairs."""

    def buckets(text):
        return [zlib.crc32(w.encode()) % 10000 for w in WORD.findall(lower(text or ""))]

    bags = [buckets(text) for _, text in documents]
    s, t = collections.Counter(sum(bags, [])), collections.Counter(b for x in target for b in buckets(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for (doc_id, _), bag in zip(documents, bags):
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in bag
        )
        seen = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"2024:{seen}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    drawn = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(drawn[: 10 * len(drawn) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def resampled(documents, target):
    rows = importance_resampling.resample(documents, target).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str)


def test_draw_on_odd_rows(spark, make):
    """Ties, repeated rows, null ids and texts of no words."""
    many = [(i, f"Wort{i % 7} été, " * 12 + "Zahl 12 東京 x" * 9) for i in range(60)]
    rows = [*many, *many[:20], *[(5, "same " * 30)] * 45, *[(None, "null id " * 15)] * 5, *enumerate(ODD, 200)]
    target = ["same target WORDS", None, "", "wort1 12"]
    benchmark = spark.createDataFrame([(i, x, 1) for i, x in enumerate(target)], "item_id int, text string, rank int")
    assert resampled(make(rows, extra=True).selectExpr("*", "1 AS rank", "2 AS score"), benchmark) == plain(rows, target)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampled(none, none) == []
    rows = [(i, "a b c d " * 6 + str(i)) for i in range(30)]
    assert resampled(make(rows), none) == plain(rows, [])
    few = [(1, "too few words"), (2, None)]
    assert resampled(make(few), none) == plain(few, [])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_whole_table(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert resampled(documents, benchmark) == plain(rows, [r.text for r in benchmark.select("text").collect()])


def test_bisection_finds_the_last_that_does():
    values = [3, 3, 9, -4, 0]
    for wanted in range(1, 6):
        cutoff = ranking.bisect(lambda x: sum(v >= x for v in values), -4, 9, wanted)
        assert cutoff == sorted(values, reverse=True)[wanted - 1]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(2000).selectExpr("id", "id * 7919 % 2000 AS key")
    found = ranking.ranked(rows, [rows.key.desc()], Workspace(spark, "ranks"), "rank").collect()
    assert all(r["rank"] == 2000 - r.key for r in found) and len(found) == 2000
    assert ranking.ranked(rows.limit(0), [rows.key], Workspace(spark, "ranks"), "rank").collect() == []
