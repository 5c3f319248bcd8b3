"""Removal of byte strings that occur more than once in a corpus.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes. The
suffixes to compare are dealt into shards such that equal strings meet: each possible start
belongs to the anchor its string selects, the least-hashing run of ``ANCHOR`` bytes inside
it. Equal strings select equal anchors at equal places. Starts in a row with one anchor make a
segment; only segments whose anchor occurs again are looked at, equal segments once. A shard
holds whole anchors, and its suffix array and common prefixes, from induced sorting, tell
which starts of its segments begin a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.induced_sorting import common_prefixes, suffix_array
from veilframe.llm.line_dedup import _mixed, _powers
from veilframe.llm.storage import Workspace
from veilframe.llm.text import chunks, only

LENGTH = 200
ANCHOR = 64
# A shard's segments, and how many different ones an anchor may have there. The segments of
# more frequent anchors are taken apart into single strings first.
SHARD_BYTES = 1 << 20
MOST_SEGMENTS = 2048

_BYTE_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64))
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _running_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(1 << max(len(data) - 1, 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def _span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[begin:end]``, from the running sums."""
    _, down = _powers(1 << max(len(sums) - 2, 1).bit_length())
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray]:
    """The starts of all strings of ``length`` bytes within a row, in runs that select the
    same anchor: the row, the first start in it, how many there are, and hashes of the anchor
    and of all bytes the run's strings cover."""
    names = ("row", "start", "n", "anchor", "content")
    if len(data) < length:
        return {name: np.zeros(0, np.int64) for name in names}
    sums = _running_sums(data)
    at = np.arange(len(data) - anchor + 1)
    hashes = _span_hash(sums, at, at + anchor)
    # Hash above, place below: the least is the leftmost of the least hashes.
    chosen = _least_of_windows((hashes & _HIGH) | at.astype(np.uint64), length - anchor + 1)
    chosen = (chosen & ~_HIGH).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    inside = np.arange(len(chosen)) + length <= offsets[row + 1]
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(inside & new)
    stops = np.flatnonzero(np.concatenate([new, [True]]) | np.concatenate([~inside, [True]]))
    end = stops[np.searchsorted(stops, first, "right")]
    return {
        "row": row[first],
        "start": first - offsets[row[first]],
        "n": end - first,
        "anchor": hashes[chosen[first]].view(np.int64),
        "content": _span_hash(sums, first, end - 1 + length).view(np.int64),
    }


def repeated_starts(texts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """Which of each text's first ``starts`` positions begin a string of ``length`` bytes that
    another of those positions, in any of the texts, begins as well."""
    size = np.array([len(t) for t in texts])
    whole = np.zeros(int(size.sum()) + len(texts) + 1, np.uint16)
    whole[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 2
    first = np.cumsum(size + 1) - size - 1
    whole[first + size] = 1
    sa = suffix_array(whole, 258)
    shared = common_prefixes(whole, sa, 1)
    # Both of two neighbours in the array begin a repeated string if they share enough.
    long = np.zeros(len(whole), bool)
    ordered = shared[sa] >= length
    long[sa[ordered]] = True
    long[sa[:-1][ordered[1:]]] = True
    return [np.flatnonzero(long[f : f + n]) for f, n in zip(first.tolist(), starts)]


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    edge = np.flatnonzero(np.diff(places) != 1)
    begins = places[np.append(0, edge + 1)]
    ends = places[np.append(edge, len(places) - 1)] + 1
    return list(zip(begins.tolist(), ends.tolist()))


def _pack_ranges(ranges: list[tuple[int, int]]) -> bytes:
    return np.array(ranges, "<i8").tobytes()


def _unpack_ranges(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


SEGMENT = "anchor bigint, content bigint, copies bigint, n int, bytes binary"


def _segments_of(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch["text"], 1 << 20):
                found = segments(chunk.data, chunk.offsets, length, anchor)
                where = pa.array(found["row"])
                columns = [
                    pa.array(found["anchor"]),
                    pa.array(found["content"]),
                    batch["id"][chunk.rows].take(where),
                    batch["mark"][chunk.rows].take(where),
                    pa.array(found["start"]),
                    pa.array(found["n"].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "id", "mark", "start", "n"])

    return rows.mapInArrow(run, f"anchor bigint, content bigint, id {kind}, mark bigint, start bigint, n int")


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist()):
                raw = text.encode()
                cut = [raw[w["start"] : w["start"] + w["n"] - 1 + length] for w in wanted]
                columns = [pa.array([w[name] for w in wanted], pa.int64()) for name in ("anchor", "content", "copies")]
                columns += [pa.array([w["n"] for w in wanted], pa.int32()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "copies", "n", "bytes"])

    return run


def _strings(length: int):
    """Each string of a segment as a segment of its own, by a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, n = row["bytes"], row["n"]
                sums = _running_sums(np.frombuffer(raw, np.uint8))
                at = np.arange(n)
                keys = _span_hash(sums, at, at + length).view(np.int64)
                columns = [
                    pa.array(keys),
                    pa.array([row["anchor"]] * n, pa.int64()),
                    pa.array([row["content"]] * n, pa.int64()),
                    pa.array(at),
                    pa.array([row["copies"]] * n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["string", "anchor", "content", "at", "copies"])

    return run


def _sort_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        texts, starts = table["bytes"].to_pylist(), table["n"].to_pylist()
        found = repeated_starts(texts, starts, length)
        # A segment with copies repeats as a whole, whatever else it shares.
        ranges = [
            [(0, n)] if copies > 1 else _ranges(places)
            for places, n, copies in zip(found, starts, table["copies"].to_pylist())
        ]
        columns = {
            "anchor": table["anchor"],
            "content": table["content"],
            "ranges": pa.array([_pack_ranges(r) for r in ranges], pa.binary()),
        }
        return pa.table(columns).filter(pa.array([bool(r) for r in ranges], pa.bool_()))

    return run


RANGES = "anchor bigint, content bigint, ranges binary"


def _repeats(candidates: DataFrame, work: Workspace, length: int, shard_bytes: int, most_segments: int) -> DataFrame:
    """(anchor, content, ranges): repeated starts within the segments, all different."""
    sizes = candidates.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments"))
    frequent = work.store(sizes.where(F.col("segments") > most_segments).select("anchor"))
    total = candidates.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    few = candidates.join(frequent, "anchor", "left_anti") if not frequent.isEmpty() else candidates
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    sorted_few = few.select("*", shard).groupBy("shard").applyInArrow(_sort_shard(length), RANGES)
    if frequent.isEmpty():
        return sorted_few
    single = work.store(
        candidates.join(frequent, "anchor").mapInArrow(
            _strings(length), "string bigint, anchor bigint, content bigint, at bigint, copies bigint"
        )
    )
    again = single.groupBy("string").agg(F.sum("copies").alias("times")).where("times > 1")
    pack = F.udf(lambda places: _pack_ranges(_ranges(np.array(sorted(places)))), "binary")
    many = (
        single.join(again.select("string"), "string", "left_semi")
        .groupBy("anchor", "content")
        .agg(pack(F.collect_list("at")).alias("ranges"))
    )
    return sorted_few.unionAll(many)


def _covered(n_bytes: int, ranges: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes covered by the strings at these starts."""
    if not len(ranges):
        return ranges
    begin, end = ranges[:, 0], ranges[:, 1] - 1 + length
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return np.stack([begin[new], end[last]], axis=1)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
    most_segments: int = MOST_SEGMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept) of every row; ``removed``
    lists the runs of bytes taken out as (begin, end), ``kept`` is what remains, as bytes,
    both only ``with_text``.

    A null text is an empty one and loses nothing, as does any text shorter than ``length``.
    Repeated rows repeat each other. Rows are told apart by id and text, so ids may be null
    or occur twice. Segments are compared by 64-bit hashes before they are sorted.
    """
    work = Workspace(docs.sparkSession, "repeats")
    rows = only(docs, id_col, text_col).toDF("id", "text")
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    place = F.struct("mark", "start", "n", "id")
    found = _segments_of(rows, length, anchor).repartition("anchor")
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor")
    occurring = work.store(found.join(often, "anchor"))
    distinct = occurring.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("place"))
    wanted = (
        distinct.select("anchor", "content", "copies", "place.*")
        .groupBy(F.col("id").alias("of"), F.col("mark").alias("as"))
        .agg(F.collect_list(F.struct("anchor", "content", "copies", "start", "n")).alias("wanted"))
    )
    here = F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as"))
    # Repeated rows give equal segments twice, which changes nothing.
    candidates = work.store(rows.join(wanted, here).select("text", "wanted").mapInArrow(_cut_out(length), SEGMENT))
    repeats = work.store(_repeats(candidates, work, length, shard_bytes, most_segments))
    marked = (
        occurring.join(repeats, ["anchor", "content"])
        .groupBy(F.col("id").alias("of"), F.col("mark").alias("as"))
        .agg(F.collect_set(F.struct("start", "ranges")).alias("repeats"))
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        schema += ", removed array<struct<begin:bigint,end:bigint>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, repeats in zip(batch["text"].to_pylist(), batch["repeats"].to_pylist()):
                raw = text.encode()
                parts = [_unpack_ranges(r["ranges"]) + r["start"] for r in repeats or ()]
                spans = _covered(len(raw), np.concatenate(parts) if parts else np.zeros((0, 2), np.int64), length)
                kept, at = [], 0
                for a, b in spans.tolist():
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"begin": a, "end": b} for a, b in spans.tolist()], kept))
            names = [field.split()[0] for field in schema.split(", ")]
            types = [pa.int64()] * 3 + [pa.string()]
            if with_text:
                types += [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names)

    joined = rows.join(marked, here, "left").select("id", "text", "repeats")
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)

