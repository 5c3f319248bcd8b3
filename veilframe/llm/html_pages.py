"""Web pages read into blocks of text and the tokens a template is found by."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Elements of HTML by what they mean for reading; fixed by its standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SKIPPED = frozenset(
    "head nav footer aside form select option optgroup fieldset legend menu dialog iframe object canvas svg audio "
    "video map datalist".split()
)
SKIPPED_INLINE = frozenset(("button", "label"))
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main menu nav ol p pre section table tr td th ul".split()
)
CLOSES_SIBLING = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())

# Words in class, id or role that name something other than the article.
SKIPPED_NAMES = frozenset(
    "ad ads adbox adslot advert advertisement adverts alert alertdialog announcement banner breadcrumb breadcrumbs "
    "captcha comment comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus "
    "footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEADER_NAMES = frozenset(("header", "topbar"))
ARTICLE_NAMES = frozenset(("article", "content", "entry", "post", "story"))
# Names that say how a page is laid out, such as has-sidebar.
LAYOUT_NAMES = frozenset(("has", "layout", "no", "with", "without"))

MARKED_MAIN, MARKED_ARTICLE = 1, 2

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMING = re.compile(
    r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE
)
_HIDDEN = re.compile(
    r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)",
    re.IGNORECASE,
)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Block:
    """Text without a block boundary inside, the path to it, the strongest mark around it,
    and how many of its characters are links."""

    path: str
    text: str
    marked: int
    linked: int


@dataclass
class Element:
    tag: str
    path: str
    skipped: bool
    marked: int


class Page:
    """``blocks`` outside skipped elements, ``tokens`` in page order, and ``marked``: how
    clearly the page says where its article is. Reads on through any broken markup."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.tokens: list[tuple[str, str]] = []
        self.marked = 0
        self._open = [Element("", "", False, 0)]
        self._inline: list[tuple[str, bool]] = []
        self._text: list[str] = []
        self._linked = 0
        for piece in _PIECE.finditer(source):
            if (text := piece[5]) is not None:
                self._add(text)
            elif (tag := piece[3]) is None:
                continue
            elif piece[2]:
                self._end(tag.lower())
            else:
                self._begin(tag.lower(), piece[4])
        self._flush()

    def _add(self, text: str) -> None:
        if self._open[-1].skipped or any(skipped for _, skipped in self._inline):
            return
        text = html.unescape(text) if "&" in text else text
        self._text.append(text)
        if any(tag == "a" for tag, _ in self._inline):
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                top = self._open[-1]
                self.blocks.append(Block(top.path, text, top.marked, min(self._linked, len(text))))
                self.tokens.append((top.path, text))
            self._text, self._linked = [], 0

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in VOID and tag not in BREAKS:
            return
        names, hidden, words, values = "", False, set(), set()
        if "=" in attributes or "hidden" in attributes:
            hidden = bool(_HIDDEN.search(attributes))
            for name, *value in _NAMING.findall(attributes):
                value = "".join(value)
                if name.lower() in ("class", "id"):
                    names += ("." if name.lower() == "class" else "#") + _DIGITS.sub("0", value.replace("/", " "))
                values.add(value.lower())
                words.update(word.lower() for word in _NAME_WORD.findall(value))
        other = hidden or bool(words & SKIPPED_NAMES and not words & LAYOUT_NAMES)
        if tag in INLINE or tag in SKIPPED_INLINE:
            self._inline.append((tag, other or tag in SKIPPED_INLINE))
            return
        self._flush()
        self._inline = []
        if tag in CLOSES_PARAGRAPH:
            self._close(("p",), within=CONTAINERS)
        if tag in VOID:
            return
        if self._open[-1].tag == "head" and tag not in IN_HEAD:
            self._close(("head",))
        if tag in CLOSES_SIBLING:
            self._close(CLOSES_SIBLING[tag], within=("ul", "ol", "dl", "table", "select"))
        around = self._open[-1]
        marks = MARKED_ARTICLE if tag == "article" or "articlebody" in values else 0
        marks = marks or (MARKED_MAIN if tag == "main" or "main" in values else 0)
        if tag in ("html", "body"):
            skipped = False
        elif tag in ("article", "main") and around.marked < MARKED_ARTICLE:
            # Some sites put the whole page into one form.
            skipped = bool(words & {"comment", "comments"}) or any(e.skipped and e.tag != "form" for e in self._roots())
        else:
            header = (tag == "header" or words & HEADER_NAMES) and not words & ARTICLE_NAMES and not around.marked
            # An article inside an article is a reader's comment on it.
            skipped = around.skipped or other or tag in SKIPPED or bool(header) or tag == "article"
        path = f"{around.path}/{tag}{names}"
        self._open.append(Element(tag, path, skipped, max(around.marked, marks)))
        if not skipped:
            self.marked = max(self.marked, marks)
            self.tokens.append((path, "<"))

    def _roots(self) -> list[Element]:
        """Skipped elements that are so by themselves, not through what is around them."""
        return [e for around, e in zip(self._open, self._open[1:]) if e.skipped and not around.skipped]

    def _end(self, tag: str) -> None:
        if tag in INLINE or tag in SKIPPED_INLINE:
            for i in range(len(self._inline) - 1, -1, -1):
                if self._inline[i][0] == tag:
                    del self._inline[i]
                    break
            return
        self._flush()
        self._inline = []
        self._close((tag,))

    def _close(self, tags: tuple[str, ...], within=()) -> None:
        """Closes the nearest open element with one of these tags, unless a boundary is nearer."""
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag in tags:
                self.tokens += [(e.path, ">") for e in reversed(self._open[i:]) if not e.skipped]
                del self._open[i:]
                return
            if self._open[i].tag in within:
                return
