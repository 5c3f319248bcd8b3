"""Documents that hold a benchmark item, give or take a few characters.

An item of m characters may differ in k of them. Cut into k + 1 pieces, at least one piece
of any such occurrence is untouched, so an Aho-Corasick automaton over all pieces finds
every candidate, and Myers' bit-parallel distance verifies it in the window around the hit.
An item too short to differ at all (k = 0) must stand as whole words, not inside of others.

Items come in blocks of bounded size, stored in the shared folder. A job holds one block and
stores what it finds before the next begins, so neither driver nor tasks grow with the items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.storage import Workspace
from veilframe.llm.text import only

# Characters of an item that may differ, as a share of all.
ERROR_RATE = 0.1
# Every item is looked for that has a character besides white space.
SHORTEST_ITEM = 1
# Items are matched in blocks of about so many characters, which is what a task holds. An item
# counts as some characters more, for what is kept of each however short it is.
BLOCK_CHARS = 1 << 20
ITEM_CHARS = 64
# Candidates verified at once.
BATCH = 16384
PAIR_BUCKETS = 512

HIT = "distance int, item_chars int, match_end bigint"


def normalised(text: str | None) -> str:
    """Lower case, words joined by single spaces."""
    return " ".join((text or "").lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` pieces of an item, as even as can be."""
    n = budget + 1
    return [(p * length // n, (p + 1) * length // n) for p in range(n)]


@dataclass
class Matcher:
    """Finds items in texts. ``items`` are (id, normalised text)."""

    items: Sequence[tuple[object, str]]
    error_rate: float = ERROR_RATE
    shortest: int = SHORTEST_ITEM

    def __post_init__(self) -> None:
        self.items = [(i, t) for i, t in self.items if len(t) >= max(self.shortest, 1)]
        self._length = np.array([len(t) for _, t in self.items], np.int64)
        self._budget = np.array([int(self.error_rate * len(t)) for _, t in self.items], np.int64)
        places = defaultdict(list)
        for number, ((_, text), budget) in enumerate(zip(self.items, self._budget.tolist())):
            for a, b in pieces(len(text), budget):
                places[text[a:b]].append((number, a))
        self._automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self._automaton.add_word(piece, (len(piece), where))
        if places:
            self._automaton.make_automaton()
        symbols = sorted(set("".join(t for _, t in self.items)))
        self._code = np.zeros(0x110000, np.int32)
        self._code[[ord(s) for s in symbols]] = np.arange(1, len(symbols) + 1)
        self._symbols = len(symbols)
        self._masks = [self._pattern_masks(t) for _, t in self.items]
        self._pairs = np.zeros((len(self.items), PAIR_BUCKETS), np.int16)
        for number, (_, text) in enumerate(self.items):
            codes = self._coded(text)
            self._pairs[number] = np.bincount(self._pair(codes), minlength=PAIR_BUCKETS)

    def _pattern_masks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The item's own symbols in order, and for each the positions it has, 64 to a word;
        one more row, the last, for all symbols it has not."""
        codes = self._coded(text)
        own, row = np.unique(codes, return_inverse=True)
        place = np.arange(len(codes))
        masks = np.zeros((len(own) + 1, -(-len(codes) // 64)), np.uint64)
        np.bitwise_or.at(masks, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        return own, masks

    def _coded(self, text: str) -> np.ndarray:
        """A number for each symbol: from 1 for those of items, 0 for any other."""
        return self._code[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def _whole_words(self, text: str, item: int, begin: int) -> bool:
        """No letter or digit of the item is continued by one of the text."""
        wanted = self.items[item][1]
        end = begin + len(wanted)
        before, after = text[begin - 1 : begin] if begin else "", text[end : end + 1]
        return not (wanted[0].isalnum() and before.isalnum()) and not (wanted[-1].isalnum() and after.isalnum())

    @staticmethod
    def _pair(codes: np.ndarray) -> np.ndarray:
        left, right = codes[..., :-1].astype(np.int64), codes[..., 1:]
        return (left * 131 + right) & (PAIR_BUCKETS - 1)

    def find(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item number, distance, end) of the best occurrence of each item in each
        text: of least distance, then the earliest end in the normalised text."""
        if not self.items:
            return
        best: dict[tuple[int, int], tuple[int, int]] = {}
        hits: list[tuple[int, np.ndarray, int, int]] = []
        likely: list[tuple[int, np.ndarray, int, int]] = []
        for number, raw in enumerate(texts):
            text = normalised(raw)
            begins = {
                (item, last + 1 - size - a) for last, (size, where) in self._automaton.iter(text) for item, a in where
            }
            begins = {(item, begin) for item, begin in begins if self._budget[item] or self._whole_words(text, item, begin)}
            if begins:
                coded = self._coded(text)
                hits.extend((number, coded, item, begin) for item, begin in sorted(begins))
            if len(hits) >= BATCH:
                likely += self._shares_enough(hits)
                hits = []
            if len(likely) >= BATCH:
                self._verify(likely, best)
                likely = []
        self._verify(likely + self._shares_enough(hits), best)
        for (number, item), (distance, end) in sorted(best.items()):
            yield number, item, distance, end

    def _windows(self, cases: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(windows, begins, length, budget): symbols around each case, a column each."""
        numbers = np.array([c[2] for c in cases])
        budget, length = self._budget[numbers], self._length[numbers]
        windows = np.zeros((len(cases), int((length + 2 * budget).max())), np.int32)
        begins = np.array([c[3] for c in cases]) - budget
        for row, ((_, coded, _, _), a, n) in enumerate(zip(cases, begins.tolist(), (length + 2 * budget).tolist())):
            cut = coded[max(a, 0) : a + n]
            windows[row, max(-a, 0) : max(-a, 0) + len(cut)] = cut
        return windows, begins, length, budget

    def _shares_enough(self, cases: list) -> list:
        """The cases whose window may hold an occurrence: an edit spoils at most two pairs of
        neighbouring characters, so all others must be there. Pairs are counted in few
        buckets, which can only make a window look better."""
        kept = []
        for start in range(0, len(cases), 1024):
            part = cases[start : start + 1024]
            windows, _, _, budget = self._windows(part)
            flat = self._pair(windows) + np.arange(len(part))[:, None] * PAIR_BUCKETS
            there = np.bincount(flat.reshape(-1), minlength=len(part) * PAIR_BUCKETS)
            there = there.reshape(len(part), -1).astype(np.int16)
            missing = np.maximum(self._pairs[[c[2] for c in part]] - there, 0).sum(axis=1)
            kept.extend(part[i] for i in np.flatnonzero(missing <= 2 * budget).tolist())
        return kept

    def _verify(self, cases: list, best: dict) -> None:
        by_words = defaultdict(list)
        for case in cases:
            by_words[self._masks[case[2]][1].shape[1]].append(case)
        for words, same in by_words.items():
            for start in range(0, len(same), BATCH):
                self._verify_cases(same[start : start + BATCH], words, best)

    def _verify_cases(self, cases: list, words: int, best: dict) -> None:
        windows, begins, length, budget = self._windows(cases)
        items, which = np.unique([c[2] for c in cases], return_inverse=True)
        own = [self._masks[i][0] for i in items]
        masks = np.concatenate([self._masks[i][1] for i in items])
        # Where each item's rows begin, the last of them for symbols it has not.
        sizes = np.array([len(codes) + 1 for codes in own])
        begin = np.cumsum(sizes) - sizes
        span = self._symbols + 1
        known = np.concatenate([codes + np.int64(i) * span for i, codes in enumerate(own)])
        wanted = windows + (which * np.int64(span))[:, None]
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        rows = np.where(known[at] == wanted, at + which[:, None], (begin + sizes - 1)[which][:, None])
        distance, end = _least_distance(masks, np.ascontiguousarray(rows.T), length, words)
        for row in np.flatnonzero(distance <= budget).tolist():
            number, _, item, _ = cases[row]
            found = (int(distance[row]), int(begins[row] + end[row] + 1))
            key = (number, item)
            if key not in best or found < best[key]:
                best[key] = found


def _least_distance(
    masks: np.ndarray, rows: np.ndarray, length: np.ndarray, words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Myers' algorithm for many pairs of an item and a window at once: the least edit
    distance of the whole item to any part of the window, and where the first such ends.
    ``rows`` has a column a pair: for each symbol of the window its row in ``masks``."""
    n = rows.shape[1]
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    plus = [np.full(n, full) for _ in range(words)]
    minus = [np.zeros(n, np.uint64) for _ in range(words)]
    last_word = (length - 1) // 64
    last_bit = ((length - 1) % 64).astype(np.uint64)
    score = length.copy()
    least, end = score.copy(), np.full(n, -1)
    for step in range(len(rows)):
        equal = masks[rows[step]]
        carry = np.zeros(n, np.uint64)
        plus_in = minus_in = carry
        for w in range(words):
            eq, pv, mv = equal[:, w], plus[w], minus[w]
            both = eq & pv
            total = both + pv
            over = total < both
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            across = (total ^ pv) | eq
            down = eq | mv
            up = mv | ~(across | pv)
            low = pv & across
            here = last_word == w
            if here.any():
                score += np.where(here, ((up >> last_bit) & one).astype(np.int64), 0)
                score -= np.where(here, ((low >> last_bit) & one).astype(np.int64), 0)
            up_out, low_out = up >> np.uint64(63), low >> np.uint64(63)
            up = (up << one) | plus_in
            low = (low << one) | minus_in
            plus_in, minus_in = up_out, low_out
            plus[w] = low | ~(down | up)
            minus[w] = up & down
        better = score < least
        least[better] = score[better]
        end[better] = step
    return least, end


class _Blocks:
    """The items in ``n`` blocks, read one at a time. Several blocks are stored first, a
    folder each, so that reading one reads nothing of the others."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, block_chars: int, work: Workspace):
        rows = only(items, id_col, text_col).toDF("id", "text").where("text IS NOT NULL").distinct()
        size = rows.agg(F.sum(F.length("text") + F.lit(ITEM_CHARS))).first()[0] or 0
        self.n = -(-size // block_chars)
        if self.n > 1:
            dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(self.n)))
            rows = work.store(dealt, by="block")
        self._rows = rows

    def __iter__(self) -> Iterator[list[tuple]]:
        for number in range(self.n):
            rows = self._rows if self.n == 1 else self._rows.where(F.col("block") == number)
            yield [(r.id, normalised(r.text)) for r in rows.select("id", "text").collect()]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = ERROR_RATE,
    shortest_item: int = SHORTEST_ITEM,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item_id, distance, item_chars, match_end) of every document and item it holds
    within the error budget; ``match_end`` counts characters of the normalised text.

    Null and empty texts hold nothing; null items and those of white space only are never
    looked for; items below ``shortest_item`` characters neither, by default none; repeated
    items with one id count once, repeated documents each for themselves.
    """
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    item_kind = items.select(f"`{item_id}`").schema[0].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, {HIT}"
    rows = only(docs, id_col, text_col).toDF("id", "text")

    def search(block: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate, shortest_item)
            for batch in batches:
                found = list(matcher.find(batch["text"].to_pylist()))
                if found:
                    text, item, distance, end = map(list, zip(*found))
                    item_type = _arrow_type(item_kind)
                    columns = [
                        batch["id"].take(pa.array(text)),
                        pa.array([matcher.items[i][0] for i in item], item_type),
                        pa.array(distance, pa.int32()),
                        pa.array([len(matcher.items[i][1]) for i in item], pa.int32()),
                        pa.array(end, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "distance", "item_chars", "match_end"])

        return run

    work = Workspace(docs.sparkSession, "decontamination")
    blocks = _Blocks(items, item_id, item_text, block_chars, work)
    if blocks.n <= 1:
        result = rows.mapInArrow(search(next(iter(blocks), [])), schema)
    else:
        result = work.read_all([work.store(rows.mapInArrow(search(block), schema)) for block in blocks])
    return result.withColumnsRenamed({"id": id_col, "item": item_id})


def _arrow_type(kind: str) -> pa.DataType | None:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = ERROR_RATE,
    shortest_item: int = SHORTEST_ITEM,
    block_chars: int = BLOCK_CHARS,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, in all their columns. Rows are judged where
    they are, so no join is needed and ids may be null or repeated."""
    place = docs.columns.index(text_col)

    def keep(block: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate, shortest_item)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for text, *_ in matcher.find(batch.column(place).to_pylist()):
                    clean[text] = False
                yield batch.filter(pa.array(clean))

        return run

    work = Workspace(docs.sparkSession, "decontamination")
    blocks = _Blocks(items, item_id, item_text, block_chars, work)
    before = None
    for number, block in enumerate(blocks, 1):
        docs = docs.mapInArrow(keep(block), docs.schema)
        if number < blocks.n:
            docs = work.store(docs)
            if before is not None:
                work.drop(before)
            before = docs
    return docs
