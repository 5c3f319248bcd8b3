"""Main text of pages: by hand-made pages, and templates beside whole occurrence vectors."""

from __future__ import annotations

import html
import os
import re
from collections import Counter, defaultdict

import pytest

from veilframe.llm import html_extraction
from veilframe.llm.html_pages import Page

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"


def extracted(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "'x' AS host", "1 AS tokens", "'y' AS text", "0 AS _host")
    rows = html_extraction.extract(df).collect()
    assert len(rows) == len(pages)
    return {r.page_id: r.text for r in rows}


def alone(spark, body, head=""):
    return extracted(spark, [(1, "http://one.example/", f"<!DOCTYPE html><html>{head}<body>{body}</body></html>")])[1]


FURNITURE = [
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>",
    "<header class='site'><h2>My site</h2><p>Slogan</p></header>",
    "<footer>&copy; us<p>All rights</footer>",
    "<aside><p>Other stories</p></aside>",
    "<div class='sidebar left'><p>Side</p></div>",
    "<div id=cookie-notice>We use <b>cookies</b></div>",
    "<div class=\"ad\">Buy <i>this</i></div>",
    "<form action=/s><label>Name</label><input name=q><button>Go</button> Sign up</form>",
    "<script>var a = '<p>no</p>' < 3;</script><style>p > b {x: y}</style>",
    "<section class='comments'><div class=comment>First!</div><article class=comment>Second</article></section>",
    "<!-- <p>hidden</p> --><div hidden>unseen</div><p style='display: none'>unseen</p>",
    "<div role=\"navigation\">Up</div><select><option>A<option>B</select>",
]


@pytest.mark.parametrize("inside", [False, True])
def test_furniture_goes(spark, inside):
    """Around an article and, but for the header, in the middle of it."""
    pages = []
    for i, extra in enumerate(FURNITURE):
        text = f"<h1>Title &amp; more</h1><p>One <b>bo</b>ld\n\n word</p>{extra if inside else ''}<p>Last&nbsp;words"
        around = "" if inside else extra
        pages.append((i, f"http://host{i}.example/", f"<html><body>{around}<article>{text}</article>{around}</body>"))
    texts = extracted(spark, pages)
    for i, extra in enumerate(FURNITURE):
        if not (inside and "<header" in extra):
            assert texts[i] == "Title & more One bold word Last words", extra


def test_broken_markup(spark):
    assert alone(spark, "<article><p>a &lt; b<br>c<p>1 < 2 & 3 &#233;&eacute;&bogus; <img src='>'>x</article>") == (
        "a < b c 1 < 2 & 3 éé&bogus; x"
    )
    assert alone(spark, "<form><article><p>In a form</article><p>not this</form>") == "In a form"
    assert alone(spark, "<article><p>kept</p></div></span><p>this too<footer>not this") == "kept this too"
    assert alone(spark, "<article><p>open <b>bold<p>next <a href=x>link</a></article><p>after") == "open bold next link"
    assert alone(spark, "<article><p>cut off <a hr") == "cut off"
    assert alone(spark, "<main><h1>T</h1><p>in main</p></main><p>out") == "T in main"
    assert alone(spark, "<main><p>crumbs</p><article>story<article>a comment</article></article></main>") == "story"
    assert alone(spark, "<div class=has-sidebar><article>story</article></div>") == "story"
    assert alone(spark, "<article></article><p>only furniture") == ""


def test_odd_rows(spark):
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "not a url", "<p>no host, " + "long text " * 50_000),
        (4, None, "plain text"),
        (5, "HTTP://User@Host.Example:80/", "<article>&#xD800;&#0;x</article>"),
        (5, "HTTP://User@Host.Example:80/", "<article>&#xD800;&#0;x</article>"),
        (None, "http://host.example", " \n\t "),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = html_extraction.extract(df).collect()
    assert len(found) == len(rows)
    texts = defaultdict(list)
    for r in found:
        texts[r.page_id].append(r.text)
    assert texts[1] == texts[2] == texts[None] == [""]
    assert texts[3] == [" ".join(["no host,"] + ["long text"] * 50_000)] and texts[4] == ["plain text"]
    assert len(texts[5]) == 2 and texts[5][0] == texts[5][1]
    assert html_extraction.extract(df.limit(0)).collect() == []


def site(n, host="http://site.example/", note="Welcome to our little site, please sign in"):
    """Pages without any telling names: only repetition parts template and article."""
    for i in range(n):
        story = "".join(f"<p>Story {i} paragraph {j} {'word ' * (5 + i % 3)}</p>" for j in range(3 + i % 2))
        yield (
            i,
            f"{host}{i}",
            f"<html><body><div class=x1><p>{note}</p><p>Today</p></div>"
            f"<div class=x2><div class=x3><h1>Story {i}</h1><p>Posted by the editors</p>{story}</div></div>"
            f"<div class=x4><p><a href=/>Back to all of our many stories</a></p></div></body></html>",
        )


def story_of(i):
    paragraphs = [f"Story {i} paragraph {j} {'word ' * (5 + i % 3)}".strip() for j in range(3 + i % 2)]
    return " ".join([f"Story {i}", *paragraphs])


def test_template_of_unmarked_pages(spark):
    texts = extracted(spark, list(site(12)))
    assert texts == {i: story_of(i) for i in range(12)}


def test_copies_are_no_template(spark):
    """A site that has one page many times keeps that page's article, boilerplate and all."""
    page = next(iter(site(1)))[2]
    texts = extracted(spark, [(i, f"http://copies.example/{i}", page) for i in range(10)])
    assert all(story_of(0).split("Story 0", 1)[1] in text for text in texts.values())


def test_shared_passages_stay_in_marked_articles(spark):
    rows = [
        (i, f"http://s.example/{i}", f"<body><p>top</p><article><p>Same for all.</p><p>Own {i}</p></article></body>")
        for i in range(8)
    ]
    assert extracted(spark, rows) == {i: f"Same for all. Own {i}" for i in range(8)}


def plain_classes(pages):
    """Tokens of at least nine tenths of a host's pages, by their whole occurrence vectors."""
    vectors = defaultdict(dict)
    for i, source in enumerate(pages):
        for token, n in Counter(Page(source).tokens).items():
            vectors[token][i] = n
    classes = defaultdict(set)
    for token, vector in vectors.items():
        if 10 * len(vector) >= 9 * len(pages):
            classes[tuple(sorted(vector.items()))].add(html_extraction._token_id(token))
    return {frozenset(c) for c in classes.values() if len(c) >= html_extraction.LEAST_TOKENS}


def check_templates(spark, rows):
    by_host = defaultdict(list)
    for _, url, source in rows:
        by_host[re.match(r"https?://([^/?#]+)", url)[1]].append(source)
    found = {r.host: r for r in html_extraction.templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for host, sources in by_host.items():
        if len(sources) < html_extraction.LEAST_PAGES:
            assert host not in found
            continue
        classes = defaultdict(set)
        for token, c in zip(found[host].tokens, found[host].classes):
            classes[c].add(token)
        assert {frozenset(c) for c in classes.values()} == plain_classes(sources)


def test_classes_are_those_of_whole_vectors(spark):
    check_templates(spark, [*site(30), *site(4, "https://other.example/", "Hi"), *site(3, "http://few.example/")])


def test_order_and_nesting_are_checked():
    tokens, classes = [1, 2, 3, 4, 5, 6], [0, 0, 1, 1, 2, 2]
    valid = html_extraction.valid_tokens
    assert valid([1, 3, 4, 3, 4, 9, 2], tokens, classes) == {1, 2, 3, 4}
    assert valid([1, 4, 3, 2], tokens, classes) == {1, 2}
    assert valid([1, 3, 2, 4], tokens, classes) == {1, 2}
    assert valid([3, 1, 5, 6, 2, 4], tokens, classes) == {1, 2, 3, 4, 5, 6}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    for page_id, text in extracted(spark, rows).items():
        inside = re.search(r"<article>(.*)</article>", rows[page_id][2], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inside))
        assert text == " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.split())
    check_templates(spark, rows)
