"""Main-text extraction by tag-path ratios.

A page becomes text nodes with their root-to-leaf tag paths. For each path, the length of its text and its punctuation are
added up over its nodes and set against the number of nodes; the two ratios are smoothed over neighbouring paths in page
order, fused by multiplication and compared with a threshold taken from the page's own spread. Nodes of paths at or above it are
content, on every page. Marked articles and names are priors of the fused score: paths outside a marked article count less, and so
do paths in elements whose class or id names adverts, comments and the like. Only elements that by their tag, role or attributes
are not text of an article (menus, scripts, forms, hidden ones and so on) are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import bytekernels as bk

#: A tag's attributes go on to the first > that is not inside a quoted value; a quote that opens no value is a letter like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S,
)
#: A name, with or without a value; values are read past, so that none is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none\b")
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no part of an article, whatever they hold.
_APART = frozenset("head script style noscript template nav footer aside form button select option input textarea iframe object canvas svg math dialog menu audio video map".split())
_APART_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Parts of a class or id that name what is hardly content; a name is cut at everything but letters. The first count always, the
#: second only where no part names content, and neither where the name says that the element has such a thing or wraps it with content.
_APART_NAME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation breadcrumb breadcrumbs "
    "footer sidebar related recommended comment comments commentlist disqus replies share sharing cookie cookies consent popup modal "
    "newsletter subscribe disclaimer".split()
)
_APART_WEAK = frozenset("header masthead menu aside widget reply respond social notice notices alert overlay signup login form search pagination pager toolbar skip".split())
_WRAPS = frozenset("wrap wrapper container layout".split())
_HAS = frozenset("has with no without".split())
_CONTENT_TAG = frozenset(("article", "main"))
_CONTENT_NAME = frozenset("article post entry story content main body text".split())
#: An opening tag that ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tr body html article section div main td th".split())
_LISTS = frozenset("ul ol dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BESIDE = _HEADINGS | frozenset("p li dt dd blockquote pre figcaption".split())
_CELLS = frozenset("td th".split())
_ROW_GROUPS = frozenset("thead tbody tfoot".split())
#: What a path's fused ratio is multiplied by for a name that is hardly content, and the length of text for each node from
#: which such a path can be content all the same.
NAMED_APART = 0.02
NAMED_LEAST = 140
_SPACES = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")


def _apart(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool]:
    """Whether an element is no text of an article, and whether its names say that it is hardly content."""
    if tag in _APART or (tag == "header" and not in_content):
        return True, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    named = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "style" and _NOT_SHOWN.search(value)) or (name == "role" and value in _APART_ROLE):
            return True, False
        if name in ("class", "id"):
            for one in value.split():
                words = set(re.split(r"[^a-z]+", one))
                content = words & _CONTENT_NAME
                named |= not words & _HAS and bool((words & _APART_NAME and not (content and words & _WRAPS)) or (words & _APART_WEAK and not content))
    return False, named


class Paths:
    """Numbers for root-to-leaf tag paths, each by its parent's number and its own tag; elements named apart have paths of their
    own. Number 0 is the root."""

    def __init__(self):
        self.parent, self.tag, self.named, self.known = [0], [""], [False], {}

    def below(self, parent: int, tag: str, named: bool) -> int:
        if (found := self.known.get((parent, tag, named))) is None:
            found = self.known[parent, tag, named] = len(self.tag)
            self.parent.append(parent)
            self.tag.append(tag)
            self.named.append(named or self.named[parent])
        return found

    def section(self, path: int) -> int:
        """The path of the element that a block stands in; lists count as a block."""
        up = self.parent[path]
        while self.tag[up] in _LISTS:
            up = self.parent[up]
        return up

    def table_of_cell(self, path: int) -> int:
        """The path of the table that a path ends as a cell of, or 0."""
        up = self.parent[path]
        if self.tag[path] not in _CELLS or self.tag[up] != "tr":
            return 0
        up = self.parent[up]
        if self.tag[up] in _ROW_GROUPS:
            up = self.parent[up]
        return up if self.tag[up] == "table" else 0


def blocks(html: str) -> tuple[Paths, list[tuple[int, str, bool]]]:
    """The paths of a page, and ``(path, text, inside article or main)`` of each block with text, in page order."""
    paths, out = Paths(), []
    stack: list[tuple[str, bool, int]] = []  # (tag, left out, path)
    open_: dict[str, int] = {}  # how many of each tag are open
    pieces: list[str] = []
    out_depth = content = where = 0

    def end_block() -> None:
        if pieces:
            text = _SPACES.sub(" ", unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.append((where, text, content > 0))

    def pop() -> None:
        nonlocal out_depth, content
        tag, gone, _ = stack.pop()
        open_[tag] -= 1
        out_depth -= gone
        content -= tag in _CONTENT_TAG

    def add(text: str) -> None:
        nonlocal where
        if not out_depth and text:
            if not pieces:
                where = stack[-1][2] if stack else 0
            pieces.append(text)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not open_.get("p"):
                end_block()
                continue
            if not open_.get(tag):
                continue
            if tag not in _INLINE:
                end_block()
                while stack[-1][0] != tag:
                    pop()
                pop()
            else:
                # A stray end tag of an inline element never closes a block.
                k = len(stack) - 1
                while stack[k][0] != tag and stack[k][0] in _INLINE:
                    k -= 1
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                end_block() if tag == "hr" else add(" ")
            continue
        if tag not in _INLINE:
            end_block()
        closes = ("p",) if tag in _ENDS_P else _SAME_ENDS.get(tag, ())
        if any(open_.get(t) for t in closes):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _SCOPE:
                    break
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        gone, named = _apart(tag, m[3], content > 0)
        above = stack[-1][2] if stack else 0
        stack.append((tag, gone, above if tag in _INLINE and not named else paths.below(above, tag, named)))
        open_[tag] = open_.get(tag, 0) + 1
        out_depth += gone
        content += tag in _CONTENT_TAG
    end_block()
    return paths, out


def content_paths(paths: Paths, found: list[tuple[int, str, bool]]) -> set[int]:
    """The paths whose fused ratio reaches the page's threshold. Where the page marks an article, paths outside it count the
    less the more of the page's text the article holds; paths in elements named apart count little."""
    if not found:
        return set()
    own = list(dict.fromkeys(p for p, _, _ in found))
    at = {p: k for k, p in enumerate(own)}
    length, marks, nodes, marked = (np.zeros(len(own)) for _ in range(4))
    for p, text, inside in found:
        length[at[p]] += len(text)
        marks[at[p]] += len(_PUNCTUATION.findall(text))
        nodes[at[p]] += 1
        marked[at[p]] += inside
    named = np.array([paths.named[p] for p in own])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), [0.15, 0.7, 0.15], "valid")
    fused = smooth(length / nodes) * smooth((marks + 0.1) / nodes)
    # An article with up to a quarter of the text is one block among others; from two fifths on little beside it counts.
    share = length[marked > 0].sum() / length.sum()
    fused *= np.where(marked > 0, 1, min(1, (1 - share) / (3 * share)) ** 4 if share else 1)
    fused *= np.where(named, NAMED_APART * (length >= NAMED_LEAST * nodes), 1)
    # Far below the best path is boilerplate; on pages of one kind of text everything stays.
    limit = min(0.05 * fused.max(), fused.mean())
    return {p for p in own if fused[at[p]] >= limit and fused[at[p]] > 0}


def extract(html: str | None) -> str:
    """The main text: content blocks joined by line feeds; empty where nothing is content."""
    paths, found = blocks(html or "")
    keep = content_paths(paths, found)
    tag, named = paths.tag, paths.named
    # Headings, lists and the like go with the content that they stand beside, tables in a marked article as well. There a
    # heading that its neighbours lift above the threshold takes nothing with it.
    beside = {paths.section(p) for p, _, inside in found if p in keep and not (inside and tag[p] in _HEADINGS)}
    out: list[str] = []
    article = any(inside and p in keep for p, _, inside in found)
    follows = False
    for p, text, inside in reversed(found):
        stays = p in keep or (not named[p] and tag[p] in _BESIDE and paths.section(p) in beside)
        if inside and not stays and not named[p]:
            # A title goes with its article, a heading with the content after it.
            heading = tag[p] in _HEADINGS
            table = paths.table_of_cell(p)
            stays = (heading and (follows or (article and tag[p] == "h1"))) or (table > 0 and paths.parent[table] in beside)
        if tag[p] not in _HEADINGS:
            follows = stays
        if stays:
            out.append(text)
    return "\n".join(reversed(out))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every column of ``pages`` with ``text`` (the main text) and ``n_chars`` (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks stand in page order, one to a
    line. A null or empty page has an empty text. Input columns named like the new ones are replaced; equal rows stay apart. Pages
    are handled one by one in their tasks, in time and memory that grow with their length, however deep they nest; there is no shuffle.
    """
    pages = pages.drop("text", "n_chars")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    at = pages.columns.index(html_col)

    @bk.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.mapInArrow(run, schema)
