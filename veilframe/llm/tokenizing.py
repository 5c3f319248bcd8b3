"""Token ids of whole texts, encoding each distinct piece of text once."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from veilframe.llm.text import IS_WHITE, Chunk

MANY_PIECES = 1 << 18


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The same vocabulary for a quicker encoder, from its file of merge ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that a byte-level BPE gives the same ids for the pieces:
    before white space that follows a character surely none itself. Its splitting pattern
    ends a piece there, and looks ahead only within white space. Edges of rows are included."""
    if not len(data):
        return np.unique(offsets)
    cut = np.zeros(len(data) + 1, bool)
    solid = (data > 0x20) & (data < 0x7F)
    # Two-byte characters from U+00C0 on are not white space either.
    solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    cut[1:-1] = IS_WHITE[data[1:]] & solid[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes chunks of texts. Ids of pieces are remembered, up to a bounded number.

    ``file_name`` is the tokenizer, ``ranks_name`` the same byte-level vocabulary as merge
    ranks, which encodes pieces five times faster; the ids are equal. Without it, and where
    a text holds the text of a special token, the tokenizer itself encodes.
    """

    def __init__(self, file_name: str, ranks_name: str | None = None):
        self._tokenizer = _tokenizer(tokenizer_path(file_name))
        self._ranked = _ranked(tokenizer_path(ranks_name)) if ranks_name else None
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, list[int]] = {}

    def _encode_pieces(self, texts: list[str]) -> list[list[int]]:
        if self._ranked is not None:
            return [self._ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begin): the ids of all rows back to back, row ``r`` at ``begin[r]``."""
        rows = len(chunk.offsets) - 1
        whole = chunk.data.tobytes()
        if any(s in whole for s in self._special):
            # A special token's text may hold white space, so rows are encoded uncut.
            texts = [t.decode("utf-8", "replace") for t in chunk.texts()]
            lists = [e.ids for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        edges = piece_edges(chunk.data, chunk.offsets)
        if len(edges) < 2:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        pieces = pa.Array.from_buffers(
            pa.binary(),
            len(edges) - 1,
            [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(whole)],
        ).dictionary_encode()
        distinct = pieces.dictionary.cast(pa.string()).to_pylist()
        if len(self._known) > MANY_PIECES:
            self._known.clear()
        fresh = [p for p in distinct if p not in self._known]
        known = self._known
        known.update(zip(fresh, self._encode_pieces(fresh)))
        lists = [known[p] for p in distinct]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        code = pieces.indices.to_numpy(zero_copy_only=False)
        count = sizes[code]
        begin = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.arange(begin[-1]) + np.repeat(first[code] - begin[:-1], count)]
        return ids, begin[np.searchsorted(edges, chunk.offsets)]
