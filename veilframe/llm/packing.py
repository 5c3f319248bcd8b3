"""Packing of documents into training sequences of balanced cost.

A document costs its tokens once and, for attention, their square. Documents longer than a
sequence fill whole sequences first. What remains of each is assigned in descending length
to the sequence of lowest cost that has room; when none has room for all of it, it is cut.
Sequences are planned to hold exactly the tokens there are: all full, but for the last
tokens of a group, which go to sequences of powers of two, the lengths that need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilframe.llm.text import chunks, only
from veilframe.llm.tokenizing import PieceEncoder

SEQUENCE_TOKENS = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_TOKEN = 1
# Cost of attention over n tokens, beside n for all else: n * n / ATTENTION_SCALE.
ATTENTION_SCALE = 2048
# Documents are packed in groups of so many tokens, the memory a task needs.
GROUP_TOKENS = 1 << 20

PACKED = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint"
)
IDS = "ids array<int>"


def piece_cost(tokens: int) -> float:
    return tokens + tokens * tokens / ATTENTION_SCALE


def capacities(tokens: int, size: int) -> list[int]:
    """Sequence lengths that hold exactly so many tokens: full ones, then powers of two."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    ``lengths`` are tokens of documents, all positive. Ties go to the earlier document and
    the earlier sequence, so the result depends on nothing else.
    """
    pieces, rests, sequence = [], [], 0
    for doc, tokens in enumerate(lengths):
        for start in range(0, tokens - size + 1, size):
            pieces.append((doc, start, size, sequence, 0))
            sequence += 1
        if tokens % size:
            rests.append((-(tokens % size), doc, tokens - tokens % size))
    room = capacities(-sum(r[0] for r in rests), size)
    free, costs = np.array(room, np.int64), np.zeros(len(room))

    def cheapest(tokens: int) -> int:
        """The sequence of lowest cost with room for so many tokens, -1 if there is none."""
        s = int(np.where(free >= tokens, costs, np.inf).argmin())
        return s if free[s] >= tokens else -1

    def place(doc: int, start: int, length: int, s: int) -> None:
        pieces.append((doc, start, length, sequence + s, room[s] - int(free[s])))
        free[s] -= length
        costs[s] += piece_cost(length)

    for negative, doc, start in sorted(rests):
        left = -negative
        s = cheapest(left)
        if s >= 0:
            place(doc, start, left, s)
            continue
        while left:
            s = cheapest(1)
            length = min(left, int(free[s]))
            place(doc, start, length, s)
            start += length
            left -= length
    return pieces


def pack(
    docs: DataFrame,
    size: int = SEQUENCE_TOKENS,
    tokenizer: str = TOKENIZER,
    ranks: str | None = RANKS,
    end_token: int = END_TOKEN,
    group_tokens: int = GROUP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece,
    the last only ``with_ids``.

    Each input partition packs its own documents, group by group, so nothing is shuffled, and
    a lost task packs the same documents the same way again. Sequence ids hold the partition
    in their upper bits. A null or empty text is a document of only the end token; repeated
    rows are documents of their own; ids are carried along and may be null.
    """
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(tokenizer, ranks)
        sequence = TaskContext.get().partitionId() << 33
        docs_held, tokens, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            placed = assign([len(t) for t in tokens], size)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*placed))
            cut = [tokens[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            crc = np.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], np.int64)
            every = pa.concat_arrays(docs_held).take(pa.array(doc))
            total = np.array([len(t) for t in tokens], np.int64)[doc]
            columns = [every, *map(pa.array, (start, length, crc, total, seq + sequence, offset))]
            if with_ids:
                edges = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(edges, pa.array(np.concatenate(cut).astype(np.int32))))
            sequence += int(seq.max()) + 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for chunk in chunks(batch["text"]):
                ids, begin = encoder.encode(chunk)
                docs_held.append(batch["id"][chunk.rows])
                edges = begin.tolist()
                tokens.extend(np.append(ids[a:b], np.uint32(end_token)) for a, b in zip(edges, edges[1:]))
                held += len(ids) + len(edges) - 1
                if held >= group_tokens:
                    yield flush()
                    docs_held, tokens, held = [], [], 0
        if tokens:
            yield flush()

    schema = f"id {kind}, {PACKED}" + (f", {IDS}" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]
    rows = only(docs, id_col, text_col).toDF("id", "text")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
