"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has 64 bits, and two documents are linked where at most ``max_bits`` of them
differ. The candidates come from an inverted index over the fingerprint's eight bytes: a
difference spoils at most one byte, so linked fingerprints agree in at least
``8 - max_bits`` byte positions. Of the positions, every set of that size holds three from
the same half (for up to three bits), so postings of three byte values each are enough, and
short. Pairs met in a posting are counted by equal bytes and verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilframe.llm.components import LINK, connected_components, find_roots
from veilframe.llm.storage import Workspace
from veilframe.llm.text import LOWER, chunks, joined_words, only, word_spans

SEED = 42
BYTES = 8
# Postings this long are compared in one task; longer ones are joined over shared neighbours.
LARGEST_POSTING = 8192

# For each byte value, its bits spread over the eight bytes of a word: adding such words
# counts all eight bits at once, up to 255 of them.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_BLOCK = 255


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of ``words`` words joined by spaces, and how many each row has. A
    row with fewer words has one run of them all, one without words none."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    compact, left, right = joined_words(data, starts, ends)
    joined = compact.tobytes()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.arange(len(starts))
    last = first[row + 1] - 1
    whole = number + words - 1 <= last
    wanted = whole | (number == first[row])
    stop = np.minimum(number + words - 1, last)[wanted]
    digest = xxhash.xxh64_intdigest
    spans = zip(left[wanted].tolist(), right[stop].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(stop))
    return hashes, np.bincount(row[wanted], minlength=len(offsets) - 1)


def majority_bits(hashes: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """For each row the 64 bits set in over half of its hashes; zero for a row without any."""
    result = np.zeros(len(per_row), np.uint64)
    full = np.flatnonzero(per_row)
    if not len(full):
        return result
    counts = per_row[full]
    begin = np.cumsum(counts) - counts
    blocks = -(-counts // _BLOCK)
    block_row = np.repeat(np.arange(len(full)), blocks)
    block_first = np.cumsum(blocks) - blocks
    block_begin = begin[block_row] + (np.arange(len(block_row)) - block_first[block_row]) * _BLOCK
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, BYTES)]
    by_block = np.add.reduceat(spread, block_begin, axis=0).view(np.uint8).reshape(-1, 64)
    sums = np.add.reduceat(by_block.astype(np.int64), block_first, axis=0)
    bits = (2 * sums > counts[:, None]).astype(np.uint8)
    result[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint bigint) of every row: A-Z lower-cased, word shingles hashed with
    XXH64, repeats included. Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"]):
                bits = majority_bits(*shingle_hashes(LOWER[chunk.data], chunk.offsets, words))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"][chunk.rows], pa.array(bits.view(np.int64))], ["id", "fingerprint"]
                )

    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    rows = only(docs, id_col, text_col).toDF("id", "text")
    return rows.mapInArrow(run, f"id {kind}, fingerprint bigint")


def _positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any two fingerprints within ``max_bits`` agree on
    all of at least one: the k-subsets of each of several parts, where agreeing bytes are
    too many to have fewer than k in every part."""
    agreeing = BYTES - max_bits
    if agreeing < 1:
        raise ValueError("at most 7 bits may differ")
    half = BYTES // 2
    size = -(-agreeing // 2)
    parts = (range(half), range(half, BYTES))
    return [c for part in parts for c in combinations(part, size)]


def _posting_key(which: int, positions: tuple[int, ...]):
    value = F.lit(which).cast("bigint")
    for p in positions:
        byte = F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255))
        value = F.shiftleft(value, 8).bitwiseOR(byte)
    return value


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _close(one: np.uint64 | np.ndarray, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the others are within ``max_bits``: first enough equal bytes, then the bits."""
    differing = others ^ one
    equal_bytes = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    close = equal_bytes >= BYTES - max_bits
    close[close] = _popcount(differing[close]) <= max_bits
    return close


def _links_of_postings(max_bits: int):
    """Union-find inside each posting; emits at most one link a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = [], []
            lists = batch["members"]
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            # Nearly all postings are pairs: compare those all at once.
            first = edges[:-1][sizes == 2]
            near = _close(values[first].view(np.uint64), values[first + 1].view(np.uint64), max_bits)
            nodes.append(np.maximum(values[first], values[first + 1])[near])
            roots.append(np.minimum(values[first], values[first + 1])[near])
            for a, b in zip(edges[:-1][sizes > 2].tolist(), edges[1:][sizes > 2].tolist()):
                members = values[a:b]
                unsigned = members.view(np.uint64)
                left, right = [], []
                waiting = np.ones(len(members), bool)
                stack: list[int] = []
                # Walk each component from member to member, looking only at those not yet reached.
                while waiting.any() or stack:
                    if not stack:
                        stack.append(int(np.argmax(waiting)))
                        waiting[stack[-1]] = False
                    i = stack.pop()
                    rest = np.flatnonzero(waiting)
                    if not len(rest):
                        stack.clear()
                        break
                    near = rest[_close(unsigned[i], unsigned[rest], max_bits)]
                    waiting[near] = False
                    stack.extend(near.tolist())
                    left.append(np.full(len(near), members[i]))
                    right.append(members[near])
                if left and sum(map(len, left)):
                    node, root = find_roots(np.concatenate(left), np.concatenate(right))
                    nodes.append(node)
                    roots.append(root)
            if sum(map(len, nodes)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], ["node", "root"]
                )

    return run


def _neighbourhoods(max_bits: int):
    """All points near a fingerprint that leave the posting's bytes alone: within the larger
    half of ``max_bits``, marked where also within the smaller half."""
    far, near = -(-max_bits // 2), max_bits // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _positions(max_bits)
        flips = {}
        for which, fixed in enumerate(sets):
            free = [8 * p + i for p in range(BYTES) if p not in fixed for i in range(8)]
            masks = [(sum(1 << i for i in c), k <= near) for k in range(far + 1) for c in combinations(free, k)]
            flips[which] = (np.array([m for m, _ in masks], np.uint64), np.array([n for _, n in masks]))
        for batch in batches:
            for key, fingerprint in zip(batch["key"].to_pylist(), batch["fingerprint"].to_pylist()):
                masks, inner = flips[key >> (8 * len(sets[0]))]
                points = (masks ^ np.array(fingerprint).astype(np.int64).view(np.uint64)).view(np.int64)
                columns = [
                    pa.array(np.full(len(points), key)),
                    pa.array(points),
                    pa.array(np.full(len(points), fingerprint)),
                    pa.array(inner),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "point", "fingerprint", "inner"])

    return run


def fingerprint_links(
    distinct: DataFrame, work: Workspace, max_bits: int = 3, largest_posting: int = LARGEST_POSTING
) -> DataFrame:
    """(node, root) links that connect all distinct fingerprints within ``max_bits``.

    Postings up to ``largest_posting`` members are compared inside one task, which emits one
    link a member at most. In a longer one, two members are within ``max_bits`` exactly if
    some point lies within half of that from one and the other half from the other, so they
    are joined over points: work in proportion to the members, however many there are.
    """
    sets = _positions(max_bits)
    keys = F.explode(F.array(*[_posting_key(i, p) for i, p in enumerate(sets)])).alias("key")
    index = distinct.select("fingerprint", keys)
    sizes = work.store(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    short = (
        index.join(sizes.where(F.col("n") <= largest_posting), "key")
        .groupBy("key")
        .agg(F.collect_list("fingerprint").alias("members"))
        .select("members")
        .mapInArrow(_links_of_postings(max_bits), LINK)
    )
    long = sizes.where(F.col("n") > largest_posting)
    if long.isEmpty():
        return short
    points = index.join(long, "key").mapInArrow(
        _neighbourhoods(max_bits), "key bigint, point bigint, fingerprint bigint, inner boolean"
    )
    centres = (
        points.where("inner").groupBy("key", "point").agg(F.min("fingerprint").alias("centre"))
    )
    linked = points.join(centres, ["key", "point"]).select(
        F.col("fingerprint").alias("node"), F.col("centre").alias("root")
    )
    return short.unionAll(linked.distinct())


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    max_bits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    largest_posting: int = LARGEST_POSTING,
) -> DataFrame:
    """(id, fingerprint bigint, component_id) of every row of ``docs``.

    ``component_id`` is the least id reachable over links, the row's own included. Copies
    share a fingerprint and enter the search once. Null and wordless texts have fingerprint
    zero and are linked like any other; a null id never names a component unless all ids of
    it are null; repeated rows give repeated results; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "simhash")
    marked = work.store(fingerprints(docs, words, id_col, text_col))
    distinct = marked.groupBy("fingerprint").agg(F.min("id").alias("least"))
    links = fingerprint_links(distinct.select("fingerprint"), work, max_bits, largest_posting)
    roots = connected_components(links, work).select(F.col("node").alias("fingerprint"), "root")
    grouped = distinct.join(roots, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    # Only fingerprints linked to another need the least id of their component.
    linked = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(linked, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(
        F.col("id").alias(id_col), "fingerprint", "component_id"
    )


def _with_fingerprints(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """(doc, fingerprint): every row whole, as a struct, since ``docs`` may have any names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"]):
                bits = majority_bits(*shingle_hashes(LOWER[chunk.data], chunk.offsets, words))
                columns = [batch["doc"][chunk.rows], pa.array(bits.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "fingerprint"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col(f"`{text_col}`").alias("text"))
    schema = StructType([StructField("doc", docs.schema), StructField("fingerprint", LongType())])
    return rows.mapInArrow(run, schema)


def keep_first(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, in all its columns: that of the least id, null ids
    last. Every row is a document of its own, also where ids are null or repeated: of rows with
    the least id any one, but one, stays. Rows are numbered when they are stored with their
    fingerprints, so what goes is told by that number alone.
    """
    work = Workspace(docs.sparkSession, "simhash-keep")
    rows = work.store(_with_fingerprints(docs, words, text_col).withColumn("nth", F.monotonically_increasing_id()))
    own = F.col(f"doc.`{id_col}`")
    place = F.struct(own.isNull().alias("unnamed"), own.alias("id"), F.col("nth").alias("nth"))
    distinct = work.store(rows.groupBy("fingerprint").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")))
    links = fingerprint_links(distinct.select("fingerprint"), work, max_bits)
    roots = connected_components(links, work).select(F.col("node").alias("fingerprint"), "root")
    grouped = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    several = grouped.groupBy("root").agg(F.min("least").alias("stays"), F.sum("n").alias("rows")).where("rows > 1")
    stays = grouped.join(several, "root").select("fingerprint", F.col("stays.nth").alias("stays"))
    others = rows.select("fingerprint", "nth").join(stays, "fingerprint").where("nth != stays").select("nth")
    return rows.join(others, "nth", "left_anti").select("doc.*")
