"""Exact percentiles of groups too large for one task, and sketches that add up over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.sources.scratch import Scratch

# Distinct values ordered in one task at most, and parts a range is cut into while it has more.
MOST_ORDERED = 10_000
PARTS = 1024
# Greatest exponent of a finite double, for a band of its own above it.
_ABOVE_ALL = 710


def exact_percentiles(
    df: DataFrame,
    group: str,
    value: str,
    probabilities: Sequence[float],
    most_ordered: int = MOST_ORDERED,
    parts: int = PARTS,
) -> DataFrame:
    """(group, percentiles array) of positive doubles, interpolated between neighbours.

    Spark's ``percentile`` keeps all distinct values of a group in one task's memory. Here equal
    values are counted and the counts stored. Values are cut into bands by their logarithm, and
    running totals over the bands, some 1,450 a group at most, tell which hold a wanted rank.
    Bands with more than ``most_ordered`` distinct values are cut again into ``parts`` of equal
    width, round by round, until none is left: then the values of the wanted ranges, and no
    others, are ordered. No task orders more than that, however many values lie close together:
    a range's least and greatest value never fall into one part, and doubles within one band
    are spaced evenly enough for some six rounds at the very most. The driver sees one number
    a round.
    """
    scratch = Scratch(df.sparkSession, "percentiles")
    counted = scratch.store(df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")))
    band = F.when(F.col(value) == float("inf"), _ABOVE_ALL).otherwise(F.floor(F.ln(value)))
    bands = counted.groupBy(group, band.cast("int").alias("part")).agg(*_extent(value))
    totals = W.partitionBy(group)
    bands = bands.withColumn("before", F.sum("n").over(totals.orderBy("part")) - F.col("n"))
    bands = bands.withColumn("ranks", _ranks(probabilities, F.sum("n").over(totals)))
    ranges = scratch.store(_holding(bands, group))
    done = []
    while True:
        done.append(ranges.where(F.col("values") <= most_ordered))
        wide = ranges.where(F.col("values") > most_ordered)
        if not wide.select(F.count(F.lit(1))).first()[0]:
            break
        ranges = scratch.store(_narrowed(counted, wide, group, value, parts))
    ranges = done[0]
    for more in done[1:]:
        ranges = ranges.unionAll(more)
    by_value = W.partitionBy(group, "low").orderBy(value)
    hits = _inside(counted, ranges, group, value).withColumn(
        "before", F.col("before") + F.sum("n").over(by_value) - F.col("n")
    )
    hits = hits.select(group, value, F.explode(_held(F.col("ranks"), F.col("before"), F.col("n"))).alias("hit"))
    # Each percentile is the weighted sum of its two neighbours, which may be one value.
    share = F.when(F.col("hit.weight") > 0, F.col(value) * F.col("hit.weight")).otherwise(0.0)
    per_probability = [F.sum(F.when(F.col("hit.i") == i, share)) for i in range(len(probabilities))]
    return hits.groupBy(group).agg(F.array(*per_probability).alias("percentiles"))


def _extent(value: str) -> list[Column]:
    """Rows, distinct values, and the least and greatest of some counted values."""
    return [
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("values"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]


def _ranks(probabilities: Sequence[float], total: Column) -> Column:
    """The two ranks around each percentile, from 0, and how much each of them weighs."""

    def rank(i: int, p: float, upper: bool) -> Column:
        position = F.lit(float(p)) * (total - 1)
        edge = F.ceil(position) if upper else F.floor(position)
        weight = position - F.floor(position)
        return F.struct(
            F.lit(i).alias("i"),
            edge.cast("bigint").alias("rank"),
            (weight if upper else 1 - weight).alias("weight"),
        )

    return F.array(*[rank(i, p, upper) for i, p in enumerate(probabilities) for upper in (False, True)])


def _held(ranks: Column, before: Column, n: Column) -> Column:
    return F.filter(ranks, lambda r: (r["rank"] >= before) & (r["rank"] < before + n))


def _holding(ranges: DataFrame, group: str) -> DataFrame:
    """The ranges that hold a wanted rank."""
    held = ranges.withColumn("ranks", _held(F.col("ranks"), F.col("before"), F.col("n")))
    return held.where(F.size("ranks") > 0).select(group, "low", "high", "values", "before", "ranks")


def _inside(counted: DataFrame, ranges: DataFrame, group: str, value: str) -> DataFrame:
    """Counted values in one of the ranges, which never overlap."""
    found = counted.join(ranges.drop("values"), group)
    return found.where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))


def _narrowed(counted: DataFrame, wide: DataFrame, group: str, value: str, parts: int) -> DataFrame:
    """Each range cut into parts of equal width, of which those with a wanted rank remain."""
    share = (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))
    part = F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")
    found = _inside(counted, wide, group, value).select(
        group, value, "n", F.col("low").alias("whole"), part.alias("part")
    )
    cut = found.groupBy(group, "whole", "part").agg(*_extent(value))
    around = wide.select(group, F.col("low").alias("whole"), F.col("before").alias("start"), "ranks")
    cut = cut.join(around, [group, "whole"])
    inside = W.partitionBy(group, "whole").orderBy("part")
    return _holding(cut.withColumn("before", F.col("start") + F.sum("n").over(inside) - F.col("n")), group)


# Sketches ---------------------------------------------------------------------------

SKETCH_SIZE = 2000


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far a quantile's rank may be off, as a share of all values, in 99 of 100 cases: the
    published bound of KLL sketches of this size."""
    return 2.296 / size**0.9021


def sketch(value: str, size: int = SKETCH_SIZE) -> Column:
    """A KLL sketch of some kilobytes, whatever the number of values."""
    return F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size))


def merged(sketches: str) -> Column:
    """One sketch of all the values behind several."""
    return F.kll_merge_agg_double(sketches)


def quantiles(sketched: str, probabilities: Sequence[float]) -> Column:
    """Array of values at the given probabilities."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return F.kll_sketch_get_quantile_double(sketched, wanted)
