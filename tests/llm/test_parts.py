"""Sorting, components and the pipeline."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from veilframe.llm import components, induced_sorting
from veilframe.llm.components import connected_components
from veilframe.llm.storage import Workspace

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("per_bucket", [1, 16])
def test_suffix_array_and_common_prefixes(monkeypatch, per_bucket):
    monkeypatch.setattr(induced_sorting, "LEAST_PER_BUCKET", per_bucket)
    rng = random.Random(per_bucket)
    for _ in range(200):
        symbols = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 70))]
        text = np.array(symbols * rng.choice([1, 1, 3]) + [0], np.uint16)
        order = induced_sorting.suffix_array(text, int(text.max()) + 1)
        plain = text.tolist()
        expected = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert order.tolist() == expected
        shared = induced_sorting.common_prefixes(text, order, 1)
        for a, b in zip(expected, expected[1:]):
            n = 0
            while plain[a + n] == plain[b + n] > 1:
                n += 1
            assert shared[b] == n


def test_components_of_long_paths(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (None, 3)]
    links += [(2000 + rng.randint(0, 60), 2000 + rng.randint(0, 60)) for _ in range(40)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "node bigint, root bigint").repartition(6)
    found = {r.node: r.root for r in connected_components(df, Workspace(spark, "test")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in list(parent) if find(x) != x}


def test_doubling_sorts_only_what_is_equal_still(monkeypatch):
    """Names in random order take few comparisons after the first round, however many there are."""
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2000, 20_000)
    names[:50] = names[100:150]
    sizes = []
    monkeypatch.setattr(induced_sorting, "_sorted_keys", lambda key: sizes.append(len(key)) or np.argsort(key))
    plain = names.tolist()
    assert induced_sorting._by_doubling(names).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    assert sizes[0] == 20_000 and len(sizes) > 3 and sum(sizes[2:]) < 2000


@pytest.mark.parametrize("piece", [50, 1000])
def test_components_in_pieces(spark, piece):
    """Links of many pieces, and so many of one node that a piece has to be contracted half-way."""
    rng = random.Random(piece)
    links = [(i, i + 1) for i in range(0, 200)] + [(5000, x) for x in range(5001, 6500)]
    links += [(x, x + 1) for x in range(5001, 6500, 3)] + [(8000 + 2 * i, 8001 + 2 * i) for i in range(400)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "node bigint, root bigint").repartition(5)
    found = {r.node: r.root for r in connected_components(df, Workspace(spark, "test"), piece).collect()}
    expected = {i: 0 for i in range(1, 201)} | {x: 5000 for x in range(5001, 6500)}
    assert found == expected | {8001 + 2 * i: 8000 + 2 * i for i in range(400)}


def test_links_of_one_piece_need_no_joins(spark, monkeypatch):
    """A path through many batches of several partitions, which rounds of joins made much of."""
    monkeypatch.setattr(components, "_large_star", None)
    links = [((i * 7919) % 30_011, (i * 7919 + 1) % 30_011) for i in range(30_010)]
    df = spark.createDataFrame(links, "node bigint, root bigint").repartition(4)
    roots = connected_components(df, Workspace(spark, "test"))
    assert roots.count() == 30_010 and {r.root for r in roots.select("root").distinct().collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    work = Workspace(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = work.store(stage(spark, docs, SF_DIR))
        assert after.columns == columns, name
        assert 0 < after.count() <= docs.count(), name
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF_DIR).count() == packed.count()
