"""Token counts of texts under a unigram tokenizer, without making the tokens.

The tokenizer is a vocabulary of scored pieces; a word's segmentation is the one of highest
total score. An Aho-Corasick automaton lists all pieces that end at each character, and
dynamic programming carries only the best score and its number of pieces. Words are cut at
spaces, which no piece crosses, and each distinct word is worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.text import Chunk, chunks, only
from veilframe.llm.tokenizing import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
# What stands for a space in pieces, and how far below the least score an unknown character is.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Pieces of at most this score are placeholders, never used.
UNUSED = -1e8
MANY_WORDS = 1 << 18


@lru_cache(maxsize=2)
def vocabulary(file_name: str = VOCABULARY) -> tuple[tuple[str, float], ...]:
    """The pieces of a public model and their scores, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(file_name))
    numbers = range(model.get_piece_size())
    return tuple(
        (model.id_to_piece(i), model.get_score(i))
        for i in numbers
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
        and model.get_score(i) > UNUSED
    )


class UnigramCounter:
    """Best segmentations of words. ``pieces`` are (text, score)."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        self._automaton = ahocorasick.Automaton()
        for text, score in pieces:
            self._automaton.add_word(text, (len(text), score))
        if pieces:
            self._automaton.make_automaton()
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._any = bool(pieces)
        self._known: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of one word, its mark included.

        Of equal scores the one whose last piece starts earlier wins, at every end. A
        character no piece consists of may be unknown, as one token for each of its bytes.
        """
        n = len(text)
        score = [0.0] + [None] * n
        count = [0] * (n + 1)
        ending: dict[int, list[tuple[int, float]]] = {}
        if self._any:
            for last, match in self._automaton.iter(text):
                ending.setdefault(last + 1, []).append(match)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            for size, value in sorted(ending.get(end, ()), reverse=True):
                single = single or size == 1
                total = score[end - size] + value
                if best is None or total > best:
                    best, pieces = total, count[end - size] + 1
            if not single:
                total = score[end - 1] + self._unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def rows(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of each row."""
        rows = len(chunk.offsets) - 1
        tokens, scores = np.zeros(rows, np.int64), np.zeros(rows)
        # The mark written out in a text is a space to the tokenizer.
        mark = SPACE.encode()
        texts = [t.replace(mark, b" ") for t in chunk.texts()]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        whole = b"".join(texts)
        if not whole:
            return tokens, scores
        data = np.frombuffer(whole, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = data == 0x20
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        words = pa.Array.from_buffers(
            pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(whole)]
        ).dictionary_encode()
        if len(self._known) > MANY_WORDS:
            self._known.clear()
        known = self._known
        found = []
        for raw in words.dictionary.to_pylist():
            if raw not in known:
                text = raw.decode("utf-8", "replace")
                known[raw] = self.word(SPACE + text.removeprefix(" "))
            found.append(known[raw])
        per_word = np.array([c for c, _ in found], np.int64), np.array([s for _, s in found])
        code = words.indices.to_numpy(zero_copy_only=False)
        row = np.searchsorted(offsets, edges[:-1], "right") - 1
        tokens += np.bincount(row, per_word[0][code], rows).astype(np.int64)
        scores += np.bincount(row, per_word[1][code], rows)
        return tokens, scores


def count_tokens(
    docs: DataFrame,
    pieces: tuple[tuple[str, float], ...] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, score) of every row: tokens of the whole text and the score of its best
    segmentation. Null and empty texts have none; repeated rows count each for itself."""
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary() if pieces is None else pieces)
        for batch in batches:
            for chunk in chunks(batch["text"]):
                tokens, scores = counter.rows(chunk)
                columns = [batch["id"][chunk.rows], pa.array(tokens), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "score"])

    rows = only(docs, id_col, text_col).toDF("id", "text")
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, score double").withColumnRenamed("id", id_col)
