"""Drawing documents that look like a target collection, by importance resampling.

Documents and target are bags of hashed words. A bucket's gain says how much more often the
target has it; a document's weight is the sum of its words' gains, and Gumbel noise on top
turns the highest scores into a draw without replacement in proportion to the weights.

The gains are one array, as long as there are buckets, that every task holds. Scores are stored;
the score of the last row drawn is found by bisection over whole numbers, each step an exact
count over the stored column, then the doc_id among rows of that score in the same way. Only
drawn rows are dealt by ranges and ranked.

A null or empty text has no words, weight 0, and is never drawn, as no document under
``LEAST_WORDS`` words is. A null doc_id counts as empty text in the noise and comes last among
ties. Repeated rows are rows of their own: of equal ones that do not all fit, whichever come
first are drawn. Empty tables give empty results; an empty target gives gains of smoothing alone.
Extra columns are left behind.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.ranking import bisect, ranked
from veilframe.llm.storage import Workspace
from veilframe.llm.text import chunks, only

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024

# Lower-cases A-Z; every other byte below 0x80 but digits and letters parts words.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
# Words whose bucket a task remembers; beyond that it starts over.
_REMEMBERED = 1 << 20


class _Buckets(dict):
    """Buckets of words, each computed once."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % self.n
        return bucket

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a table's texts: one array, whatever its size."""

    def count(batches):
        known = _Buckets(buckets)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                # Words never cross texts: each is followed by a byte that parts words.
                words = b" ".join(chunk.texts()).translate(_BYTES).split()
                total += np.bincount(known.of(words), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = only(texts, "text").mapInArrow(count, "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, B of them."""
    n, s, t = len(documents), int(documents.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((int(in_target) + 1) * (s + n) / ((int(in_docs) + 1) * (t + n))))
            for in_docs, in_target in zip(documents, target)
        ],
        np.int64,
    )


def weighted(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every row."""

    def weigh(batches):
        known = _Buckets(len(gain))
        for batch in batches:
            sizes, weights = [], []
            for chunk in chunks(batch.column("text")):
                for text in chunk.texts():
                    words = text.translate(_BYTES).split()
                    sizes.append(len(words))
                    weights.append(int(gain[known.of(words)].sum()))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())],
                ["doc_id", "n_features", "weight"],
            )

    documents = only(documents, "doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(weigh, f"doc_id {kind}, n_features bigint, weight bigint")


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank null if not drawn."""
    work = Workspace(documents.sparkSession, "resampling")
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    found = weighted(documents, gain)
    scored = work.store(
        found.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn(
            "_row", F.monotonically_increasing_id()
        )
    )
    eligible = scored.where(F.col("n_features") >= LEAST_WORDS)
    total, low, high = eligible.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    wanted = percent * total // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("doc_id", "n_features", "weight", "score", unranked)
    cutoff = bisect(lambda score: eligible.where(F.col("score") >= score).count(), low, high, wanted)
    above = eligible.where(F.col("score") > cutoff).count()
    tied = eligible.where(F.col("score") == cutoff)
    drawn = F.col("n_features") >= LEAST_WORDS
    drawn = drawn & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & _first_ids(tied, wanted - above)))
    drawn = F.coalesce(drawn, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ranks = ranked(scored.where(drawn), order, work, "rank")
    # Equal rows at the cutoff may be more than fit.
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    kept = ranks.select("doc_id", "n_features", "weight", "score", rank)
    return kept.unionAll(scored.where(~drawn).select("doc_id", "n_features", "weight", "score", unranked))


def _first_ids(tied: DataFrame, wanted: int) -> Column:
    """Condition on doc_id that at least ``wanted`` of the tied rows meet, smallest ids first,
    and no more than that but for rows of equal ids."""
    known, low, high = tied.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if known < wanted:
        return F.lit(True)
    # Whole numbers are bisected from above, so that fewer ids are more.
    largest = -bisect(lambda minus: tied.where(F.col("doc_id") <= -minus).count(), -high, -low, wanted)
    return F.col("doc_id") <= largest
