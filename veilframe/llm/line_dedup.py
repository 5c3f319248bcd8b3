"""Removal of lines that repeat, exactly or nearly, anywhere in a corpus.

Lines are compared by the sets of their character shingles. MinHash signatures from one
permutation, banded for high recall, put lines into buckets; the exact Jaccard similarity
of lines that share one decides; links make components, and of each component the first
line stays. Equal lines are one class from the start, and a text is parsed once for its
classes, places and bands.

Lines that are connected through buckets are a family. A family, where it is small enough
for one task, meets there once, whatever the number of buckets its lines share; in larger
families each bucket meets, and of larger buckets each pair of bounded parts. So every pair
that shares a bucket is compared, no join makes pairs, and tasks emit links, at most one a
line. Bands, families, links and components all stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import LINK, connected_components
from veilframe.llm.storage import Workspace
from veilframe.llm.text import LOWER, Chunk, chunks, joined_words, only, word_spans

SHINGLE = 10
SIMILARITY = 0.8
# At the threshold, a pair shares a band with probability 1 - (1 - 0.8^4)^13 = 0.999.
ROWS, BANDS = 4, 13
# Families, and buckets of larger families, up to so many lines and characters are compared
# whole. Beyond that they are cut into parts; the results are the same.
TOGETHER = 2048
CHARS_TOGETHER = 8 << 20
# Up to so many lines, comparing sets one by one is cheaper than counting by matrices.
FEW = 24
# Columns of the matrices: half of them for the most frequent shingles, one each, half for the
# others together, of which a line has few. Where that counts too many, sets decide.
COLUMNS = 2048
BLOCK = 512
# Shingle sets a task remembers while it compares lines, and line hashes it remembers having sent.
KNOWN_SETS = 256
REMEMBERED = 1 << 20
# The bit map of lines whose texts are needed: two megabytes.
SKETCH_BITS = 1 << 24

# Bins drawn at once for empty ones.
DRAWS = 1 << 20

# Bytes of text worked on at once; signatures take about eighty times as much memory.
CHUNK = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


# Of the code points up to U+FFFF, which are nearly all; a table of half a megabyte.
_SYMBOL = _mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _mixed_symbols(symbols: np.ndarray) -> np.ndarray:
    if len(symbols) and symbols.max() >= len(_SYMBOL):
        return _mixed(symbols.astype(np.uint64) + np.uint64(1))
    return _SYMBOL[symbols]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _MULTIPLIER)
    down = np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` symbols, from running sums."""
    n = len(symbols)
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed_symbols(symbols) * up[:n], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


class Lines:
    """The lines of a chunk that have a word: where each stands, its words joined by single
    spaces with A-Z in lower case, and a 64-bit hash of that."""

    def __init__(self, chunk: Chunk):
        data, offsets = LOWER[chunk.data], chunk.offsets
        breaks = np.flatnonzero(data == 0x0A)
        edges = np.unique(np.concatenate([offsets, breaks + 1]))
        starts, ends, first = word_spans(data, edges)
        full = np.flatnonzero(np.diff(first))
        self.row = np.searchsorted(offsets, edges[full], "right") - 1
        self.number = np.searchsorted(breaks, edges[full]) - np.searchsorted(breaks, offsets[self.row])
        if len(full):
            self.data, left, right = joined_words(data, starts, ends)
            self.left, self.right = left[first[full]], right[first[full + 1] - 1]
        else:
            self.data, self.left, self.right = data[:0], full, full
        self.whole = self.data.tobytes()
        digest = xxhash.xxh64_intdigest
        spans = zip(self.left.tolist(), self.right.tolist())
        hashes = np.fromiter((digest(self.whole[a:b]) for a, b in spans), np.uint64, len(full))
        self.hash = hashes.view(np.int64)

    def distinct(self) -> np.ndarray:
        return np.unique(self.hash, return_index=True)[1]


@lru_cache(maxsize=16)
def _drawn(size: int, block: int) -> np.ndarray:
    """The bins that each empty bin draws at the attempts from ``2 ** block`` on, as many again."""
    attempts = np.arange(1 << block, 2 << block, dtype=np.uint64) * np.uint64(size)
    bins = np.arange(size, dtype=np.uint64)
    return (_mixed(bins[:, None] + attempts) % np.uint64(size)).astype(np.int64)


def signatures(whole: bytes, left: np.ndarray, right: np.ndarray, shingle: int, size: int) -> np.ndarray:
    """One-permutation MinHash of ``size`` bins for each text ``whole[left:right]``. An empty
    bin borrows the value of a bin drawn by its own fixed sequence, the same for all texts."""
    raw = np.frombuffer(whole, np.uint8)
    leads = (raw & 0xC0) != 0x80
    char = np.concatenate([[0], np.cumsum(leads)])
    symbols = np.frombuffer(whole.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin, chars = char[left], char[right] - char[left]
    # A text shorter than a shingle is one shingle: the hash of all of it.
    count = np.maximum(chars - shingle + 1, 1)
    if len(symbols) >= shingle:
        hashes = window_hashes(symbols, shingle)
    else:
        hashes = np.zeros(1, np.uint64)
    text = np.repeat(np.arange(len(left)), count)
    at = np.arange(len(text)) + np.repeat(begin - (np.cumsum(count) - count), count)
    values = hashes[np.minimum(at, len(hashes) - 1)]
    short = np.flatnonzero(chars < shingle)
    values[(np.cumsum(count) - count)[short]] = [
        xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(left[short].tolist(), right[short].tolist())
    ]
    bins = ((values >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    empty = np.uint64(0xFFFFFFFF)
    table = np.full(len(left) * size, empty, np.uint64)
    np.minimum.at(table, text * size + bins.astype(np.int64), values & np.uint64(0xFFFFFFFE))
    filled = table.copy()
    holes = np.flatnonzero(table == empty)
    block = 0
    while len(holes):
        # The later the attempts, the more at once, for fewer and fewer holes.
        drawn = _drawn(size, block)
        left_open = []
        width = max(DRAWS >> block, 1)
        for part in np.split(holes, range(width, len(holes), width)):
            bin_ = part % size
            found = table[(part - bin_)[:, None] + drawn[bin_]]
            first = (found != empty).argmax(axis=1)
            value = found[np.arange(len(part)), first]
            filled[part] = value
            left_open.append(part[value == empty])
        holes = np.concatenate(left_open)
        block += 1
    return filled.reshape(-1, size)


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins."""
    keys = []
    for band in range(table.shape[1] // rows):
        key = np.full(len(table), band + 1, np.uint64)
        for column in range(band * rows, (band + 1) * rows):
            key = _mixed(key * _MULTIPLIER + table[:, column])
        keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


class _Unsent:
    """Which lines a task has not sent before, as far as it remembers."""

    def __init__(self):
        self._sent: set[int] = set()

    def among(self, lines: Lines) -> np.ndarray:
        own = lines.distinct()
        if len(self._sent) > REMEMBERED:
            self._sent.clear()
        hashes = lines.hash[own].tolist()
        new = np.fromiter((h not in self._sent for h in hashes), bool, len(hashes))
        self._sent.update(hashes)
        return own[new]


def _places(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(line, id, mark, number, bands, words): where each line stands. Its bands and its text
    come with the first place a task meets it at, other places have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsent = _Unsent()
        for batch in batches:
            for chunk in chunks(batch["text"], CHUNK):
                lines = Lines(chunk)
                own = unsent.among(lines)
                row, sizes = pa.array(lines.row), np.zeros(len(lines.hash) + 1, np.int32)
                keys, cut = np.zeros(0, np.int64), []
                if len(own):
                    own = np.sort(own)
                    table = signatures(lines.whole, lines.left[own], lines.right[own], shingle, rows * bands)
                    keys = band_keys(table, rows).reshape(-1)
                    sizes[own + 1] = bands
                    cut = [lines.whole[a:b] for a, b in zip(lines.left[own].tolist(), lines.right[own].tolist())]
                nth = np.cumsum(sizes[1:] > 0) - 1
                words = pa.array(cut, pa.binary()).cast(pa.string()).take(pa.array(nth, mask=sizes[1:] == 0))
                columns = [pa.array(lines.hash), *[batch[c][chunk.rows].take(row) for c in ("id", "mark")]]
                columns.append(pa.array(lines.number.astype(np.int32)))
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys)))
                yield pa.RecordBatch.from_arrays([*columns, words], ["line", "id", "mark", "number", "bands", "words"])

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"line bigint, id {kind}, mark bigint, number int, bands array<bigint>, words string"
    return docs.select("id", "mark", "text").mapInArrow(run, schema)


def _line_texts(places: DataFrame, sketch: bytes) -> DataFrame:
    """(line, text) of the lines in the sketch, perhaps repeated, and of a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch, np.int64)
        for batch in batches:
            place = batch["line"].to_numpy() & (SKETCH_BITS - 1)
            yield batch.filter(pa.array((bits[place >> 6] >> (place & 63)) & 1 == 1))

    texts = places.where("words IS NOT NULL").select("line", F.col("words").alias("text"))
    return texts.mapInArrow(run, "line bigint, text string")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, from rows sorted by ``key``. The last group of a batch waits
    for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        if held and keys[-1] == held[0][key][0].as_py():
            held.append(batch)
            continue
        begin = int(np.searchsorted(keys, keys[-1]))
        yield pa.concat_batches([*held, batch.slice(0, begin)])
        held = [batch.slice(begin)]
    if held:
        yield pa.concat_batches(held)


def _edges(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where groups begin in a sorted batch, and its end."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = batch[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _members(places: DataFrame) -> DataFrame:
    """(band, line, least) of the lines of every bucket with two or more; ``least`` is the
    bucket's least line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "band"):
            order = np.lexsort((batch["line"].to_numpy(), batch["band"].to_numpy()))
            batch = batch.take(pa.array(order))
            batch = batch.take(pa.array(_edges(batch, ["band", "line"])[:-1]))
            edges = _edges(batch, ["band"])
            sizes = np.diff(edges)
            least = np.repeat(batch["line"].to_numpy()[edges[:-1]], sizes)
            several = pa.array(np.repeat(sizes > 1, sizes))
            columns = [*batch.columns, pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, ["band", "line", "least"]).filter(several)

    banded = places.select(F.explode("bands").alias("band"), "line")
    # Spark sorts by one number alone much faster than by two.
    ordered = banded.repartition("band").sortWithinPartitions("band")
    return ordered.mapInArrow(run, "band bigint, line bigint, least bigint")


def _meetings(members: DataFrame, texts: DataFrame, work: Workspace, together: int) -> DataFrame:
    """(key, part, other, line): which lines are compared with which. Lines of equal key and
    parts meet in one task: families by their least line, buckets of larger families by band,
    and the parts of larger buckets two by two."""
    stars = members.where("line != least").select(F.col("line").alias("node"), F.col("least").alias("root"))
    families = connected_components(stars, work).select(F.col("node").alias("line"), F.col("root").alias("family"))
    lines = texts.select("line", F.octet_length("text").alias("chars")).join(families, "line", "left")
    lines = work.store(lines.withColumn("family", F.coalesce("family", "line")))

    def sized(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("total"))

    fits = (F.col("n") <= together) & (F.col("total") <= CHARS_TOGETHER)
    whole, part = F.lit(-1), F.col("part")
    sizes = work.store(sized(lines, "family").withColumn("fits", fits))
    met = lines.join(sizes.where("fits"), "family").select(
        F.col("family").alias("key"), whole.alias("part"), whole.alias("other"), "line"
    )
    large = lines.join(sizes.where("NOT fits"), "family").select("line", "chars")
    if large.isEmpty():
        return met
    buckets = work.store(members.join(large, "line").select("band", "line", "chars"))
    sizes = sized(buckets, "band")
    # Two parts meet at a time, so each has half of what fits.
    n_parts = F.greatest(F.ceil(F.col("n") * 2 / F.lit(max(together, 2))), F.ceil(F.col("total") * 2 / F.lit(CHARS_TOGETHER)))
    dealt = buckets.join(sizes.select("band", F.when(fits, 1).otherwise(n_parts).cast("int").alias("n_parts")), "band")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("line", "band"), F.col("n_parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    pairs = dealt.select(
        F.col("band").alias("key"), F.least(part, "with").alias("part"), F.greatest(part, "with").alias("other"), "line"
    )
    return met.unionAll(pairs)


def shingle_set(text: str, shingle: int) -> frozenset[str]:
    return frozenset([text[i : i + shingle] for i in range(max(len(text) - shingle + 1, 1))])


def _similar(one: frozenset, other: frozenset, similarity: float) -> bool:
    if min(len(one), len(other)) < similarity * max(len(one), len(other)):
        return False
    both = len(one & other)
    return both >= similarity * (len(one) + len(other) - both)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _similar_values(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """``_similar`` for sets given as arrays of distinct numbers, which are faster to make and meet."""
    if min(len(one), len(other)) < similarity * max(len(one), len(other)):
        return False
    values = np.concatenate([one, other])
    values.sort()
    both = int(np.count_nonzero(values[1:] == values[:-1]))
    return both >= similarity * (len(one) + len(other) - both)


def shingle_hashes(texts: list[str], shingle: int) -> list[np.ndarray]:
    """The hashes of each text's shingles, some of them repeated, from one pass over all texts."""
    hashes, start = [], 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK):
            chars += len(texts[end])
            end += 1
        slab = texts[start:end]
        symbols = np.frombuffer("".join(slab).encode("utf-32-le", "replace"), np.uint32)
        windows = window_hashes(symbols, shingle) if len(symbols) >= shingle else None
        at = 0
        for text in slab:
            if len(text) < shingle:
                hashes.append(np.array([xxhash.xxh64_intdigest(text)], np.uint64))
            else:
                hashes.append(windows[at : at + len(text) - shingle + 1].copy())
            at += len(text)
        start = end
    return hashes


def similar_links(hashes: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect the same texts as all pairs at least that similar, one a text
    at most, from the texts' shingle hashes of 64 bits. Pairs within one component are not
    compared.

    Of more than a few texts, products of matrices count the shingles of each pair. Columns that
    several shingles share can only count too many; sets decide in the end.
    """
    n, links = len(hashes), []
    component = np.arange(n)
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            if len(sets) >= KNOWN_SETS:
                sets.clear()
            sets[i] = _distinct(hashes[i])
        return sets[i]

    def compare(a: int, others) -> None:
        for b in others:
            if component[a] != component[b] and _similar_values(shingles(a), shingles(b), similarity):
                links.append((a, b))
                component[component == component[b]] = component[a]

    if n <= FEW:
        for a in range(n):
            compare(a, range(a + 1, n))
        return links
    counts, sizes = _shingle_counts(hashes)
    share = similarity / (1 + similarity)
    for top in range(0, n, BLOCK):
        upper = counts[top : top + BLOCK]
        for left in range(top, n, BLOCK):
            met = component[[*range(top, min(top + BLOCK, n)), *range(left, min(left + BLOCK, n))]]
            if (met == met[0]).all():
                continue
            least = share * (sizes[top : top + BLOCK, None] + sizes[None, left : left + BLOCK]) - 1e-6
            likely = upper @ counts[left : left + BLOCK].T >= least
            for i in np.flatnonzero(likely.any(axis=1)).tolist():
                a = top + i
                others = left + np.flatnonzero(likely[i])
                compare(a, others[(others > a) & (component[others] != component[a])].tolist())
    return links


def _shingle_counts(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has each column's shingles, of those that several texts have, and the
    number of shingles of each text."""
    own = [_distinct(h) for h in hashes]
    sizes = np.array([len(h) for h in own])
    owner = np.repeat(np.arange(len(own)), sizes)
    _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
    half = COLUMNS // 2
    place = np.where(rank < half, rank, half + rank % half)[column[shared]]
    counts = np.bincount(owner[shared] * COLUMNS + place, minlength=len(own) * COLUMNS)
    return counts.reshape(-1, COLUMNS).astype(np.float32), sizes


def _links(meetings: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links between lines that meet. Should two meetings get one number, they are one meeting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "meeting"):
            edges = _edges(batch, ["meeting"]).tolist()
            lines = batch["line"].to_pylist()
            hashes = shingle_hashes(batch["text"].to_pylist(), shingle)
            node, root = [], []
            for a, b in zip(edges, edges[1:]):
                for x, y in similar_links(hashes[a:b], similarity):
                    node.append(lines[a + y])
                    root.append(lines[a + x])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])

    numbered = meetings.select(F.xxhash64("key", "part", "other").alias("meeting"), "line")
    met = numbered.join(texts, "line").select("meeting", "line", "text")
    return met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, LINK)


def line_links(
    places: DataFrame,
    work: Workspace,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    smallest: int = TOGETHER,
) -> DataFrame:
    """(node, root): the components of the similarity links between distinct lines, without
    the least line of each. ``places`` is what ``_places`` made of the documents.
    Families and buckets of more than ``smallest`` lines are compared in parts, which is a
    matter of memory and changes no result but for pairs that share no bucket."""
    members = work.store(_members(places))
    wanted = members.select("line").distinct()
    texts = _line_texts(places, _sketch(wanted)).join(wanted, "line", "left_semi")
    found = work.store(texts.dropDuplicates(["line"]))
    meetings = work.store(_meetings(members, found, work, smallest))
    return connected_components(work.store(_links(meetings, found, shingle, similarity)), work)


def _sketch(lines: DataFrame) -> bytes:
    """A bit map of fixed size in which every line's bit is set, to leave most other lines
    out before they are shuffled. However many lines there are, it does not grow."""
    place = F.col("line").bitwiseAND(F.lit(SKETCH_BITS - 1))
    word = F.shiftright(place, 6)
    bit = F.expr(f"shiftleft(1L, CAST((line & {SKETCH_BITS - 1}) & 63 AS INT))")
    words = lines.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    full = np.zeros(SKETCH_BITS // 64, np.int64)
    found = words.toArrow()
    full[found["word"].to_numpy()] = found["bits"].to_numpy()
    return full.tobytes()


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as (id, text, mark), a mark for each text."""
    rows = only(docs, id_col, text_col).toDF("id", "text")
    return rows.withColumn("mark", F.xxhash64("text"))


def _equal_rows(rows: DataFrame, work: Workspace) -> DataFrame:
    """(id, mark) of the rows that occur more than once with a text."""
    times = rows.where("text IS NOT NULL").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("times"))
    return work.store(times.where("times > 1").select("id", "mark"))


def _removals(
    docs: DataFrame, equal: DataFrame, work: Workspace, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, **settings
) -> DataFrame:
    """(id, mark, again, number), perhaps repeated: the lines to remove; ``again`` has those that equal rows
    lose after the first of them, which are all their lines."""
    everywhere = work.store(_places(docs, shingle, rows, bands))
    roots = work.store(line_links(everywhere, work, shingle, **settings))
    places = everywhere.select("line", "id", "mark", "number")
    # Lines at several places, and lines linked to others; the rest stays where it is.
    again = places.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    linked = roots.select(F.col("node").alias("line"), "root")
    heads = roots.select(F.col("root").alias("line")).distinct()
    touched = again.unionAll(linked.select("line")).unionAll(heads).distinct().join(linked, "line", "left")
    repeated = work.store(places.join(touched, "line").withColumn("root", F.coalesce("root", "line")))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "number", "mark")
    firsts = repeated.groupBy("root").agg(F.min(place).alias("stays"))
    stays = F.col("stays.id").eqNullSafe(F.col("id"))
    for name in ("mark", "number"):
        stays &= F.col(f"stays.{name}") == F.col(name)
    gone = repeated.join(firsts, "root").where(~stays).select("id", "mark", F.lit(False).alias("again"), "number")
    if not equal.isEmpty():
        same = places["id"].eqNullSafe(equal["id"]) & (places["mark"] == equal["mark"])
        copies = places.join(equal, same, "left_semi")
        gone = gone.unionAll(copies.select("id", "mark", F.lit(True).alias("again"), "number"))
    return gone


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """(id, mark, again, number int): the lines to remove, numbered from 0 between line feeds.

    Lines without a word are never removed. Of a component the line of least (id, number)
    stays, null ids last. Every row is a document of its own, also where ids are null or
    repeated: ``mark``, the 64-bit hash of its text, tells rows of one id apart. Of rows equal
    in id and text one, whichever, is the first (``again`` is false); the others lose all
    their lines.
    """
    work = Workspace(docs.sparkSession, "lines")
    rows = _marked(docs, id_col, text_col)
    gone = _removals(rows, _equal_rows(rows, work), work, **settings)
    return gone.distinct().select(F.col("id").alias(id_col), "mark", "again", "number")


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, **settings
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, in all its columns and rows. A null
    text stays null. With ``counts`` there are two more columns, ``_n_lines`` and ``_n_removed``,
    with another underscore before them as long as ``docs`` has such a column itself."""
    work = Workspace(docs.sparkSession, "lines")
    rows = _marked(docs, id_col, text_col)
    equal = _equal_rows(rows, work)
    gone = _removals(rows, equal, work, **settings)
    gone = gone.groupBy("id", "mark", "again").agg(F.collect_set("number").alias("gone"))
    # Columns stay inside of a struct, since ``docs`` may have any names.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    id_, text = F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")
    marked = docs.select(whole).withColumns({"row_id": id_, "row_mark": F.xxhash64(text)})
    marked = _first_or_again(marked, equal, work)
    here = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_mark") == F.col("mark"))
    joined = marked.join(gone, here & (F.col("row_again") == F.col("again")), "left")
    # A text is split in a projection of its own, once, and only where something goes.
    numbers, lines = F.col("gone"), F.col("lines")
    joined = joined.select("doc", "gone", F.when(numbers.isNotNull(), F.split(text, "\n")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    cleaned = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    columns = [
        F.when(lines.isNull(), text).otherwise(cleaned).alias(c) if c == text_col else F.col(f"doc.`{c}`")
        for c in docs.columns
    ]
    if counts:
        breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        n_lines, n_removed = "_n_lines", "_n_removed"
        while {n_lines, n_removed} & set(docs.columns):
            n_lines, n_removed = f"_{n_lines}", f"_{n_removed}"
        columns.append(F.coalesce(breaks + 1, F.lit(0)).cast("bigint").alias(n_lines))
        columns.append(F.when(lines.isNull(), 0).otherwise(F.size(numbers)).cast("bigint").alias(n_removed))
    return joined.select(*columns)


def _first_or_again(rows: DataFrame, equal: DataFrame, work: Workspace) -> DataFrame:
    """``rows`` (doc, row_id, row_mark) with ``row_again``: false for one of equal rows, true
    for the others. Only equal rows are stored and numbered."""
    if equal.isEmpty():
        return rows.withColumn("row_again", F.lit(False))
    here = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_mark") == F.col("mark"))
    copies = work.store(rows.join(equal, here, "left_semi").withColumn("nth", F.monotonically_increasing_id()))
    firsts = copies.groupBy(F.col("row_id").alias("id"), F.col("row_mark").alias("mark")).agg(F.min("nth").alias("least"))
    again = copies.join(firsts, here).select("doc", "row_id", "row_mark", (F.col("nth") != F.col("least")).alias("row_again"))
    single = rows.join(equal, here, "left_anti").withColumn("row_again", F.lit(False))
    return single.unionAll(again)
