"""Bytes and words of whole texts, for tasks that work on Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but these six bytes, which never occur inside a UTF-8 character.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# The same as a regular expression.
WORD_GAP = r"[\x20\x09-\x0D]+"

IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

CHUNK_BYTES = 4 << 20


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, by exact name; whatever else the table has is left behind."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


@dataclass
class Chunk:
    """Some rows of a batch: their bytes back to back, and where each row's begin."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def texts(self) -> list[bytes]:
        whole = self.data.tobytes()
        edges = self.offsets.tolist()
        return [whole[a:b] for a, b in zip(edges, edges[1:])]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A text column in pieces of about ``limit`` bytes; null counts as empty. A longer text
    is a piece of its own, so memory follows the longest text, not the batch."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield Chunk(slice(start, end), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words: word ``i`` is ``data[starts[i]:ends[i]]``, and the
    words of row ``r`` are ``first[r]:first[r + 1]``. Words never cross rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    white = IS_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~white
    begins[1:] &= white[:-1] | edge[1:-1]
    stops = ~white
    stops[:-1] &= white[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def joined_words(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, left, right): the words of ``word_spans`` and at most one space behind each,
    so that consecutive words joined by spaces are one slice."""
    white = IS_WHITE[data]
    keep = ~white
    keep[ends[ends < len(data)]] = True
    at = np.cumsum(keep) - 1
    return np.where(white, 0x20, data)[keep].astype(np.uint8), at[starts], at[ends - 1] + 1
