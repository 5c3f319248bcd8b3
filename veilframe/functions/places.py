"""ZIP generalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask, and the Safe Harbor population a 3-digit area must exceed.
ZIP_PREFIX_LEN = 3
ZIP_MASK = "XX"
ZIP_TOO_SHORT = "XXX"
ZIP_SMALL_AREA = "000XX"
MIN_ZIP3_POPULATION = 20_000


def coarsen_zip(zip_code: Column) -> Column:
    """First three characters and a mask; ``XXX`` for null or shorter codes."""
    text = zip_code.cast("string")
    kept = F.concat(F.substring(text, 1, ZIP_PREFIX_LEN), F.lit(ZIP_MASK))
    return F.when(F.length(text) >= ZIP_PREFIX_LEN, kept).otherwise(ZIP_TOO_SHORT)


def suppress_small_zip(
    coarsened_zip: Column, population: Column, min_population: int = MIN_ZIP3_POPULATION
) -> Column:
    """Replace a coarsened ZIP whose area has too few, or an unknown number of, people."""
    large_enough = F.coalesce(population > min_population, F.lit(False))
    return F.when(large_enough | (coarsened_zip == ZIP_TOO_SHORT), coarsened_zip).otherwise(ZIP_SMALL_AREA)
