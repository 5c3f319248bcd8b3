"""Exact ranks of a large table, and cutoffs of its order, without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.storage import Workspace


def bisect(count_at_least, low: int, high: int, wanted: int) -> int:
    """The largest whole number in [low, high] that ``count_at_least`` finds ``wanted`` rows
    for; ``low`` must do. Each step is one exact count, at most 64 of them."""
    while low < high:
        middle = low + (high - low + 1) // 2
        if count_at_least(middle) >= wanted:
            low = middle
        else:
            high = middle - 1
    return low


def ranked(rows: DataFrame, order: list[Column], work: Workspace, rank: str) -> DataFrame:
    """``rows`` with their place 1, 2, 3... in the order, which must be total.

    Rows are dealt to partitions by ranges of the order and ordered inside each. The dealt
    table is stored, because ranges are drawn by sampling: only what is on disk can be counted
    and numbered alike. One count a partition reaches the driver.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id is the partition's number and, in the lower 33 bits, the row's place in it.
    dealt = work.store(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, {}
    for size in sorted(sizes, key=lambda s: s.part):
        offsets[size.part] = before
        before += size.n
    if not offsets:
        return dealt.withColumn(rank, F.lit(None).cast("long")).drop("_at")
    starts = [offsets.get(p, 0) for p in range(max(offsets) + 1)]
    start = F.get(F.array(*map(F.lit, starts)), part.cast("int"))
    place = start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn(rank, place.cast("long")).drop("_at")
