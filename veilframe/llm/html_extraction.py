"""Main text of web pages, by the template their site was filled into.

Pages of one host are one template with different contents. The tokens of a page are the
begin and end tags of its block elements, told apart by the path that leads to them, and its
text blocks. A token's occurrence vector says how often each page of the host has it; tokens
with equal vectors form an equivalence class. Classes that nearly all pages have, that hold
several tokens, keep their order on a page and nest with one another are the template. What is
left between their tokens are the slots, and the main text is what fills the article's slots.

Vectors are as long as a host has pages, so they are never put together: the sum over pages of
a hash of (page, count) stands for one, and adds up in partial aggregates however many pages a
host has. A class is checked against the order and nesting of each page it is applied to.

The article is the ``article`` or ``main`` element, where a page has one. Elsewhere it is the
template element, as deep as possible, that holds most text which is not in links; text of the
template itself and blocks of links are left out of it. Elements that say by name that they are
something else (menus, footers, forms, comments and the like) are left out wherever they are.
Inside a marked article a passage stays even if all pages of a host have it.

A null or empty page has empty text. A page with a null or unreadable url belongs to no host and
is read on its own, like the pages of hosts with fewer than ``LEAST_PAGES``. Repeated rows are
extracted each; extra columns are left behind.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.html_pages import CONTAINERS, Block, Page
from veilframe.llm.storage import Workspace
from veilframe.llm.text import only

# Hosts with fewer pages show no template. Elements are known from half of a host's pages on, a
# text is the template's from nine tenths on: some pages that copy each other are no template.
LEAST_PAGES = 4
LEAST_TOKENS = 2
# Go down into an element that holds this share of the text of the element around it.
MAIN_SHARE = 0.7


def _token_id(token: tuple[str, str]) -> int:
    return xxhash.xxh64_intdigest(f"{token[0]}\0{token[1]}".encode("utf-8", "surrogatepass"), 42) - (1 << 63)


_COUNTED = {
    "host": pa.string(),
    "token": pa.int64(),
    "path": pa.string(),
    "pages": pa.int64(),
    "vector_a": pa.int64(),
    "vector_b": pa.int64(),
    "place": pa.int64(),
    "chars": pa.int64(),
}
_TEMPLATE = {
    "host": pa.string(),
    "tokens": pa.list_(pa.int64()),
    "classes": pa.list_(pa.int32()),
    "main_path": pa.string(),
}
_SPARK_TYPES = {
    pa.string(): "string",
    pa.int64(): "bigint",
    pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.int32()): "array<int>",
}


def _spark_schema(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SPARK_TYPES[kind]}" for name, kind in fields.items())


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every token of a host: pages that have it, the two halves of its vector's hash, the sum
    of its first places, and for elements the text in them. Summed over the rows of a batch."""
    schema = pa.schema(list(_COUNTED.items()))
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for row in range(batch.num_rows):
            host, source, key = (batch.column(c)[row].as_py() for c in ("host", "html", "key"))
            page = Page(source or "")
            places: dict[tuple[str, str], list[int]] = defaultdict(list)
            for place, token in enumerate(page.tokens):
                places[token].append(place)
            chars: dict[str, int] = defaultdict(int)
            for block in page.blocks:
                chars[block.path] += len(block.text) - block.linked
            for token, at in places.items():
                is_tag = token[1] == "<"
                sums = found.setdefault((host, _token_id(token)), [token[0] if is_tag else None, 0, 0, 0, 0, 0])
                of_count = xxhash.xxh64_intdigest(f"{key}:{len(at)}")
                sums[1] += 1
                sums[2] += of_count & 0xFFFFFFFF
                sums[3] += of_count >> 32
                sums[4] += at[0]
                sums[5] += chars[token[0]] if is_tag else 0
        rows = [(*where, *sums) for where, sums in found.items()]
        columns = zip(*rows) if rows else [()] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _main_path(chars: dict[str, int]) -> str:
    """Down from the root as long as one container holds most of the text around it."""
    below: dict[str, int] = defaultdict(int)
    children: dict[str, set[str]] = defaultdict(set)
    for path, n in chars.items():
        below[path] += n
        while path:
            around = path.rpartition("/")[0]
            children[around].add(path)
            below[around] += n
            path = around
    at = ""
    while children[at]:
        best = max(sorted(children[at]), key=lambda child: below[child])
        tag = re.match(r"[^.#]*", best.rpartition("/")[2])[0]
        if tag not in CONTAINERS or not below[best] or below[best] < MAIN_SHARE * below[at]:
            break
        at = best
    return at


def _deduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The template of one host from tokens that at least half of its pages have, of which
    there are at most twice as many as an average page has."""
    classes: dict[tuple[int, int, int], list] = defaultdict(list)
    chars: dict[str, int] = {}
    for row in table.to_pylist():
        if 10 * row["pages"] >= 9 * row["n_pages"]:
            classes[row["pages"], row["vector_a"], row["vector_b"]].append((row["place"], row["token"]))
        if row["path"] is not None:
            chars[row["path"]] = row["chars"]
    tokens, numbers = [], []
    large = sorted((-vector[0], sorted(m)) for vector, m in classes.items() if len(m) >= LEAST_TOKENS)
    for number, (_, members) in enumerate(large):
        # Members keep their order wherever the class is valid, so the order of mean places is it.
        tokens += [token for _, token in members]
        numbers += [number] * len(members)
    return pa.table([[key[0].as_py()], [tokens], [numbers], [_main_path(chars)]], schema=pa.schema(list(_TEMPLATE.items())))


def _nests(inner: list[int], size: int, outer: list[int]) -> bool:
    """No place of ``outer`` within a round of ``size`` places of ``inner``."""
    rounds = ((inner[i], inner[i + size - 1]) for i in range(0, len(inner), size))
    return all(bisect.bisect(outer, first) == bisect.bisect(outer, last) for first, last in rounds)


def valid_tokens(found: list[int], tokens: list[int], classes: list[int]) -> set[int]:
    """Template tokens of a page. A class counts if its tokens follow in the class's order,
    over and over, and if it nests with every class that more pages have: each of its rounds
    lies in one gap of the other, or each of the other's in one of its own."""
    member: dict[int, tuple[int, int]] = {}
    sizes: dict[int, int] = defaultdict(int)
    for token, c in zip(tokens, classes):
        member[token] = (c, sizes[c])
        sizes[c] += 1
    places: dict[int, list[int]] = defaultdict(list)
    order: dict[int, list[int]] = defaultdict(list)
    for place, token in enumerate(found):
        if token in member:
            c, i = member[token]
            places[c].append(place)
            order[c].append(i)
    kept: list[int] = []
    for c in sorted(places):
        in_order = order[c] == list(range(sizes[c])) * (len(order[c]) // sizes[c])
        if in_order and all(
            _nests(places[c], sizes[c], places[k]) or _nests(places[k], sizes[k], places[c]) for k in kept
        ):
            kept.append(c)
    return {token for token in found if token in member and member[token][0] in kept}


def _inside(blocks: list[Block], path: str) -> list[Block]:
    return [b for b in blocks if b.path == path or b.path.startswith(path + "/")]


def _slots(page: Page, tokens: list[int] | None, classes: list[int] | None, main_path: str | None) -> list[Block]:
    """Blocks that fill the article's slots on a page without marks. Where a page has nothing
    but template, copies of one page passed for one, and it is read on its own."""
    template = valid_tokens([_token_id(t) for t in page.tokens], tokens, classes) if tokens else set()
    filled = [b for b in page.blocks if not template or _token_id((b.path, b.text)) not in template]
    if not any(len(b.text) > b.linked for b in filled):
        filled = page.blocks
    if not main_path or not _inside(filled, main_path):
        chars: dict[str, int] = defaultdict(int)
        for block in filled:
            chars[block.path] += len(block.text) - block.linked
        main_path = _main_path(chars)
    return [b for b in _inside(filled, main_path) if 2 * b.linked < len(b.text)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, tokens, classes, paths = (batch.column(c) for c in ("html", "tokens", "classes", "main_path"))
        texts = []
        for i in range(batch.num_rows):
            page = Page(sources[i].as_py() or "")
            if page.marked:
                blocks = [b for b in page.blocks if b.marked == page.marked]
            else:
                blocks = _slots(page, tokens[i].as_py(), classes[i].as_py(), paths[i].as_py())
            texts.append(" ".join(b.text for b in blocks).encode("utf-8", "replace"))
        found = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), found], ["page_id", "url", "text"])


def host(url: str) -> Column:
    """Host of a url in lower case, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, classes, main_path): the template of every host with enough pages.

    Tokens are counted by (host, token), so a host with a third of all pages is spread over
    all tasks; what half of a host's pages share is a small group, however many those are.
    """
    named = pages.select(host("`url`").alias("host"), F.col("`html`").alias("html")).where("host IS NOT NULL")
    counted = named.select("host", "html", F.xxhash64("html").alias("key")).mapInArrow(
        _count_tokens, _spark_schema(_COUNTED)
    )
    counted = counted.groupBy("host", "token").agg(
        F.max("path").alias("path"),
        *[F.sum(c).alias(c) for c in ("pages", "vector_a", "vector_b", "place", "chars")],
    )
    sizes = named.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    frequent = counted.join(sizes, "host").where("2 * pages >= n_pages")
    return frequent.groupBy("host").applyInArrow(_deduce, _spark_schema(_TEMPLATE))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page. Templates are stored first, so that Spark knows
    their size and sends them to the pages only if small; beyond that it joins by host."""
    pages = only(pages, "page_id", "url", "html")
    work = Workspace(pages.sparkSession, "templates")
    known = work.store(templates(pages)).withColumnRenamed("host", "_host")
    joined = pages.join(known, host("`url`") == F.col("_host"), "left").drop("_host")
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string")
