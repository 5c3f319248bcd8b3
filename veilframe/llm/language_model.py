"""Log-probabilities of texts under a word n-gram model with backoff.

The model is a weighted automaton. Its states are the histories seen in training, of up to
``order - 1`` words; an arc for each n-gram seen carries the interpolated probability
``share * c(hw) / c(h) + (1 - share) * p(w | shorter h)``, and every state has a failure arc
of weight ``1 - share`` to the state of its history without the first word, down to the empty
history, whose arcs are the smoothed unigrams ``p(w)``. One walk from left to right keeps the
state, the longest history seen, follows failure arcs until an arc for the token is found, and
adds up logarithms. Each state's probabilities sum to one, unknown words included.

The model grows with the corpus and is never in one place. Texts are dealt into blocks; a
block lists the n-grams it needs, with their own counts in training texts, to buckets of
n-gram hashes; a bucket adds up the counts and answers each block in the order of its list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import LOWER, chunks, only, word_spans
from veilframe.llm.line_dedup import _mixed, _powers

# Words of the longest n-gram, at most seven. Three ask for about twice as many n-grams as two,
# which is more than the disk the shuffle may take.
ORDER = 2
# Weight of a history's own estimate beside that of the next shorter one.
SHARE = 0.3
# A block is what one task scores, a bucket what one task adds up; both in bytes of text.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20

_BYTE_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64))
_END = np.uint64(0x5851F42D4C957F2D)
# The low bits of a key say how many words it has.
_LENGTH_BITS = np.uint64(7)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(len(data) - 1, 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return _mixed((sums[ends] - sums[starts]) * down[starts] + lengths)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begin): the tokens of all rows back to back, each row closed by an end."""
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets)
    rows = len(offsets) - 1
    begin = first + np.arange(rows + 1)
    out = np.full(begin[-1], _END, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))
    out[np.arange(len(starts)) + row] = word_hashes(lower, starts, ends)
    return out, begin


def ngram_keys(words: np.ndarray, begin: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each length up to ``order`` the keys of the n-grams that end at each token. A row
    begins after an end; where it has no n-gram of a length, the key is 0, which none has."""
    place = np.arange(len(words)) - np.repeat(begin[:-1], np.diff(begin))
    keys = [words & ~_LENGTH_BITS | np.uint64(1)]
    # What came before, word by word outwards: hash of the n-gram so far.
    run = words
    for length in range(2, order + 1):
        back = length - 1
        before = np.zeros_like(words)
        before[back:] = words[: max(len(words) - back, 0)]
        before[place == back - 1] = _END
        run = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + run)
        there = place >= back - 1
        keys.append(np.where(there, run & ~_LENGTH_BITS | np.uint64(length), np.uint64(0)))
    return keys


def weights(counts: list[np.ndarray], begin: np.ndarray, unigram: np.ndarray, share: float) -> np.ndarray:
    """Probability of each token on the walk. ``counts`` has for each length those of the
    n-grams that end at each token, 0 where there is none."""
    weight = unigram
    # From the empty history up: what an arc or, failing that, the failure arc leads to.
    for shorter, arc in zip(counts, counts[1:]):
        # The history ends at the token before; at the first it is the end behind the row.
        history = np.empty_like(arc)
        history[1:] = shorter[:-1]
        history[begin[:-1]] = counts[0][begin[1:] - 1] if shorter is counts[0] else 0
        with np.errstate(divide="ignore", invalid="ignore"):
            failed = (1 - share) * weight
            taken = share * arc / history + failed
        # A history not seen is no state: the walk is in a shorter one already.
        weight = np.where(history == 0, weight, np.where(arc > 0, taken, failed))
    return weight


def _tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    parts = [tokens(c.data, c.offsets) for c in chunks(column)]
    words = np.concatenate([w for w, _ in parts])
    sizes = np.concatenate([np.diff(b) for _, b in parts])
    return words, np.concatenate([[0], np.cumsum(sizes)])


def _packed(values: np.ndarray) -> bytes:
    """Byte planes: what sorted or small numbers have in common stands together."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind)[:, 0]


def _bucket_spans(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, begin, end) of the sorted keys in each bucket that has any. Buckets are ranges
    of the upper half of the keys, so their number costs nothing."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return bucket[begin].astype(np.int32), begin, np.append(begin[1:], len(keys)) if len(keys) else begin


def _vocabulary(texts: DataFrame) -> dict:
    """Bytes of all texts, and of training texts the tokens and distinct tokens. ``texts``
    has ``text`` and ``learn``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = batch["learn"].to_numpy(zero_copy_only=False)
            for chunk in chunks(batch["text"]):
                words, begin = tokens(chunk.data, chunk.offsets)
                known = np.repeat(learn[chunk.rows], np.diff(begin))
                key, n = np.unique(words[known], return_counts=True)
                columns = [
                    pa.array(np.append(key.view(np.int64), 0)),
                    pa.array(np.append(n, 0)),
                    pa.array(np.append(np.zeros(len(key), np.int64), len(chunk.data))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "bytes"])

    counted = texts.mapInArrow(count, "word bigint, n bigint, bytes bigint")
    by_word = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    row = by_word.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("n") > 0).alias("distinct"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    ).first()
    return row.asDict()


def held_out(id_column: Column) -> Column:
    """The fifth of all rows not learned from; rows without an id are learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(
    docs: DataFrame,
    order: int = ORDER,
    share: float = SHARE,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text is an empty one, whose only token is its end. Repeated rows are scored and
    learned from each for itself. Without any training text every token has probability one
    under the base and the model, as the formula gives. Words are told apart by 64-bit hashes,
    n-grams by 61 bits.
    """
    if not 1 <= order <= int(_LENGTH_BITS):
        raise ValueError(f"order {order} is not between 1 and {_LENGTH_BITS}")
    rows = only(docs, id_col, text_col).toDF("id", "text")
    rows = rows.withColumn("held_out", held_out(F.col("id")))
    total = _vocabulary(rows.select("text", (~F.col("held_out")).alias("learn")))
    blocks = max(1, -(-total["bytes"] // block_bytes))
    buckets = max(1, -(-total["bytes"] // bucket_bytes))
    divisor = total["tokens"] + 0.5 * (total["distinct"] + 1)
    train_tokens = total["tokens"]
    # By id and text, so that rows without an id, or with one and the same, are dealt apart.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def request(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        words, begin = _tokens_of(table)
        learn = np.repeat(~table["held_out"].to_numpy(zero_copy_only=False), np.diff(begin))
        distinct, at = np.unique(np.concatenate(ngram_keys(words, begin, order)), return_inverse=True)
        counts = np.bincount(at[np.tile(learn, order)], minlength=len(distinct)).astype(np.uint32)
        if not distinct[0]:
            distinct, counts = distinct[1:], counts[1:]
        bucket, first, last = _bucket_spans(distinct, buckets)
        spans = list(zip(first.tolist(), last.tolist()))
        return pa.table(
            {
                "bucket": pa.array(bucket),
                "block": pa.array(np.full(len(spans), block, np.int32)),
                "keys": pa.array([_packed(distinct[i:j]) for i, j in spans], pa.binary()),
                "counts": pa.array([_packed(counts[i:j]) for i, j in spans], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        lists = [_unpacked(raw, np.uint64) for raw in table["keys"].to_pylist()]
        counts = np.concatenate([_unpacked(raw, np.uint32) for raw in table["counts"].to_pylist()])
        distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(at, counts, len(distinct)).astype(np.uint64)[at]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).tolist()
        answers = [_packed(sums[i:j]) for i, j in zip(edges, edges[1:])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "sums": pa.array(answers, pa.binary())})

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, begin = _tokens_of(texts)
        keys = ngram_keys(words, begin, order)
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["sums"].to_pylist()))
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        # In the order of the block's own list, before which may come the key of no n-gram.
        sums = [np.zeros(int(distinct[0] == 0)), *(_unpacked(raw, np.uint64).astype(np.float64) for _, raw in parts)]
        counts = np.split(np.concatenate(sums)[at], order)
        seen = counts[0]
        unigram = (seen + 0.5) / divisor
        weight = weights(counts, begin, unigram, share)
        first = begin[:-1]
        return pa.table(
            {
                "id": texts["id"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array(np.diff(begin)),
                "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), first)),
                "train_tokens": pa.array(np.full(len(first), train_tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(unigram), first)),
                "score": pa.array(np.add.reduceat(np.log10(weight), first)),
            }
        )

    requests = dealt.groupBy("block").applyInArrow(request, "bucket int, block int, keys binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(answer, "block int, bucket int, sums binary")
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, schema)
    return scored.withColumnRenamed("id", id_col)
