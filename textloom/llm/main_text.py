"""Main text of web pages: flat blocks classified by a decision tree on shallow text features.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its word count and link density,
those of its two neighbours, and whether it lies in an element named for boilerplate or for an article. A name counts
only on a part of the page, not on what holds its article or nearly all of its words. A decision tree grown on the
labelled blocks below says which blocks are main text. The table has every page with and without its names, so that
the tree learns to tell blocks by their words and neighbours where a page names nothing.

Parsing is one walk over the tags: what a block lies in is told by counts handed down from parent to child, so time
follows the length of the page however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import table

# Elements that end a block, whose contents are no text, and that have no end tag.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head textarea select button".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role names that mark boilerplate and articles.
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion related "
    "reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
_BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
# Elements whose marks never count, and boilerplate tags that may yet wrap a page.
_PAGE_TAGS = frozenset("html body main".split())
_WRAPPING_TAGS = frozenset("form dialog".split())
#: Share of a page's words from which on an element wraps the page.
PAGE_WIDE = 0.9
_ARTICLE_TAGS = frozenset("article main".split())
_ARTICLE_NAMES = frozenset("article post entry story content main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^<>]*+>", re.S)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW | _SILENT}
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool
    article: bool
    heading: bool


@dataclass(eq=False)
class _Element:
    tag: str
    named: bool  # for boilerplate, by its marks or as a form or dialog
    fixed: bool  # boilerplate wherever it is
    article: bool
    parent: _Element | None
    words: int = 0
    wraps: bool = False
    boiler: bool = False  # by itself or by what it is in
    inside: bool = False  # of an article
    heading: bool = False


def _marks(tag: str) -> tuple[set[str], set[str]]:
    """Whole names and leading words of the class, id and role of a start tag, and all words of them."""
    if "=" not in tag:
        return set(), set()
    names = [n for m in _MARKS.findall(tag) for x in m for n in x.split()]
    parts = [[w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower()) if w] for n in names]
    return {p[0] for p in parts if p} | {n.lower() for n in names}, {w for p in parts for w in p}


def _settle(elements: list[_Element]) -> None:
    """Say which elements wrap the page or its article, so that their names don't count, and which are boilerplate.

    The article is the longest one that isn't itself named for boilerplate or holds half of the page; so is the main.
    ``elements`` are in page order, the root first, with their own words.
    """
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
    total = elements[0].words
    for tag in _ARTICLE_TAGS:
        standing = [e for e in elements if e.tag == tag and (not e.named or 2 * e.words >= total)]
        e = max(standing, key=lambda e: e.words, default=None)
        while e:
            e.wraps, e = True, e.parent
    for e in elements:
        e.wraps = e.wraps or e.tag in _PAGE_TAGS or e.words >= PAGE_WIDE * total
        e.boiler = e.fixed or e.named and not e.wraps or bool(e.parent and e.parent.boiler)


def flat_blocks(page: str) -> list[Block]:
    """The text blocks of ``page`` in order; scripts, styles, comments and the like aren't text.

    An element of such contents without an end tag takes the rest of the page; so does an unfinished comment. An
    unfinished tag at the end is no text.
    """
    root = _Element("", False, False, False, None)
    elements, stack, open_tags = [root], [root], Counter[str]()
    blocks: list[tuple[Block, _Element]] = []
    text: list[str] = []
    linked = links = at = 0
    size = page.rfind(">") + 1
    tail = _UNFINISHED.search(page, size)
    length = tail.start() if tail else len(page)

    def flush() -> None:
        nonlocal linked
        own = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if own:
            n, e = len(_WORD.findall(own)), stack[-1]
            e.words += n
            blocks.append((Block(own, n, linked, False, e.inside, e.heading), e))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            text.append(plain)
            if links:
                linked += len(_WORD.findall(plain))

    def leave() -> str:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        return tag

    while m := _TOKEN.search(page, at, size):
        token = m.group()
        name = _NAME.match(token)
        tag = name.group(1).lower() if name else ""
        say(page[at : m.start()])
        at = m.end()
        if not tag:
            if token.startswith("<!--") and not token.endswith("-->"):
                at = length
                break
            continue
        if token.startswith("</"):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK:
                flush()
                if open_tags[tag]:
                    while leave() != tag:
                        pass
            continue
        if tag in _RAW or tag in _SILENT and tag != "head":
            if tag in _BLOCK:
                flush()
            if not token.endswith("/>"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else length
                if not end:
                    break
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links += 1
        elif tag in _BLOCK:
            flush()
            if tag in ("p", *_HEADINGS):  # these don't nest in a paragraph
                while stack[-1].tag == "p":
                    leave()
            links = 0
            parent = stack[-1]
            leading, words = _marks(token)
            # a post's article stays one whatever else it is named for
            named = tag in _WRAPPING_TAGS or bool(leading & _BOILER_NAMES) and not (tag == "article" and leading & _ARTICLE_NAMES)
            fixed = tag in _BOILER_TAGS - _WRAPPING_TAGS or (tag == "header" and not parent.inside)
            if tag not in _VOID and not token.endswith("/>"):
                article = tag in _ARTICLE_TAGS or tag not in _PAGE_TAGS and bool(words & _ARTICLE_NAMES)
                e = _Element(tag, named, fixed, article, parent, inside=article or parent.inside, heading=tag in _HEADINGS or parent.heading)
                stack.append(e)
                elements.append(e)
                open_tags[tag] += 1
    say(page[at:length])
    flush()
    _settle(elements)
    for b, e in blocks:
        b.boiler = e.boiler
    return [b for b, _ in blocks]


FEATURES = ("words", "links", "share", "before_words", "before_links", "after_words", "after_links", "boiler", "article", "heading")
#: Word count and link density of a neighbour that isn't there.
NONE = (-1.0, -1.0)


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """For each block its word count, link density and share of the longest block's words, its neighbours' counts and
    densities (NONE beyond either end), and its element marks: boiler and heading are 0 or 1; article is 1 in one, -1 outside of a
    page's articles and 0 where a page has none. Blocks marked as boilerplate are no neighbours, nor the longest."""
    if not blocks:
        return []
    own = [(float(b.words), b.linked / b.words if b.words else 0.0) for b in blocks]
    longest = max((b.words for b in blocks if not b.boiler), default=0) or 1
    none = -1.0 if any(b.article and not b.boiler for b in blocks) else 0.0
    plain = [i for i, b in enumerate(blocks) if not b.boiler]
    before, after = dict(zip(plain[1:], plain)), dict(zip(plain, plain[1:]))
    beside = lambda i, to: own[to[i]] if i in to else NONE
    rows = []
    for i, b in enumerate(blocks):
        rows.append((*own[i], b.words / longest, *beside(i, before), *beside(i, after), float(b.boiler), 1.0 if b.article and not b.boiler else none, float(b.heading and not b.boiler)))
    return rows


# The labelled table: blocks of pages in order, as "words linked element label", where element is nav, ad, side, form,
# foot, note or comment (boilerplate), art (in an article) or head (a heading in one). Pages of many shapes: with and
# without menus, footers, titles; one paragraph, lists of links, tables, code, talk in short lines, comments after the article.
LABELLED = (
    "5 5 nav 0|4 4 nav 0|6 6 nav 0|9 0 ad 0|8 0 head 1|62 2 art 1|3 0 art 1|48 0 art 1|1 0 art 1|95 4 art 1|20 1 foot 0|7 2 foot 0",
    "1 1 nav 0|1 1 nav 0|2 2 nav 0|30 0 note 0|11 0 head 1|18 0 art 1|140 0 art 1|6 0 head 1|75 5 art 1|4 1 art 1|22 0 comment 0|45 0 comment 0|5 3 foot 0",
    "3 3 nav 0|2 2 nav 0|4 4 nav 0|12 0 head 1|80 3 art 1|55 0 art 1|64 1 art 1|8 8 side 0|6 6 side 0|9 1 side 0|4 0 foot 0",
    "6 0 ad 0|2 2 nav 0|5 5 nav 0|3 3 nav 0|38 0 art 1|90 2 art 1|44 0 art 1|14 12 side 0|7 7 side 0|5 5 side 0|35 4 side 0|60 0 side 0",
    "2 2 nav 0|3 3 nav 0|70 0 art 1|12 0 head 1|85 1 art 1|5 0 art 1|66 0 art 1|24 2 art 1|58 0 art 1|4 4 foot 0|3 3 foot 0",
    "4 4 nav 0|10 0 head 1|52 0 art 1|7 0 head 1|61 3 art 1|18 0 art 1|90 0 art 1|9 9 nav 0|6 0 foot 0|12 2 foot 0",
    "1 1 nav 0|1 1 nav 0|1 1 nav 0|8 0 ad 0|9 0 head 1|22 0 art 1|31 0 art 1|4 0 art 1|88 0 art 1|2 0 art 1|17 0 art 1|26 0 art 1|8 1 foot 0",
    "1 1 nav 0|1 1 nav 0|9 0 head 1|40 0 art 1|6 0 art 1|75 0 art 1|90 0 art 1|5 5 foot 0|6 0 foot 0",
    "1 1 nav 0|7 0 head 1|60 0 art 1|3 0 art 1|33 0 art 1|5 5 foot 0|5 2 foot 0",
    "2 2 nav 0|1 1 nav 0|6 0 ad 0|12 0 head 1|28 0 art 1|1 0 art 1|52 0 art 1|4 4 foot 0|7 0 foot 0",
    "2 2 nav 0|1 1 nav 0|5 0 ad 0|10 0 head 1|120 0 art 1|9 0 art 1|14 0 art 1|70 0 art 1|3 0 art 1|40 0 art 1|11 2 foot 0|2 2 foot 0",
    "1 1 nav 0|1 1 nav 0|7 0 ad 0|6 0 head 1|3 0 art 1|12 9 art 1|1 1 art 1|14 0 art 1|2 0 art 1|10 8 art 1|5 5 art 1|33 0 art 1|9 1 foot 0",
    "70 0 ad 0|30 0 note 0|1 0 head 1|4 4 art 1|8 0 art 1|3 2 art 1|1 0 art 1|6 6 art 1|64 0 side 0|55 1 side 0|16 0 foot 0",
    "1 0 nav 0|60 0 form 0|2 0 head 1|1 0 art 1|2 2 art 1|4 0 art 1|9 0 art 1|7 7 art 1|48 0 comment 0|90 0 comment 0|75 0 comment 0|2 0 comment 0",
    "9 0 ad 0|1 0 head 1|2 0 art 1|3 0 art 1|1 0 art 1|5 0 art 1|4 0 art 1|2 0 art 1|9 0 art 1|7 0 art 1|1 0 art 1|12 0 art 1|1 0 art 1|6 0 art 1|1 0 art 1|13 0 art 1|3 0 foot 0",
    "1 1 nav 0|5 0 head 1|1 0 art 1|14 0 art 1|4 0 art 1|1 0 art 1|8 0 art 1|14 0 art 1|10 0 art 1|11 0 art 1|2 0 art 1|1 0 art 1|4 1 art 1|3 3 art 1|12 0 foot 0",
    "4 4 nav 0|14 0 head 1|2 0 art 1|1 0 art 1|4 0 art 1|3 0 art 1|12 0 art 1|2 0 art 1|13 2 art 1|6 0 art 1|1 1 art 1|3 0 art 1|6 0 art 1|1 0 art 1|4 0 comment 0|3 0 foot 0",
    "12 0 form 0|4 0 form 0|40 2 ad 0|9 0 head 1|2 0 art 1|2 0 art 1|200 9 art 1|5 0 art 1|120 1 side 0|17 0 comment 0|80 0 comment 0|110 20 foot 0",
    "30 0 art 1|30 0 comment 0|12 0 comment 0",
    "120 0 art 1|150 0 art 1",
    "200 0 art 1",
    "4 0 art 1",
    "7 0 head 1|60 0 art 1",
    "2 2 nav 0|3 3 nav 0|6 0 head 1|40 0 art 1|60 0 art 1",
    "40 0 art 1|55 0 art 1|12 0 art 1|70 0 art 1|33 0 art 1",
    "2 2 nav 0|1 1 nav 0|1 1 nav 0|50 1 art 1|42 0 art 1|18 0 art 1",
    "9 0 head 1|33 0 art 1|28 0 art 1|5 0 head 1|41 0 art 1|3 3 foot 0|2 2 foot 0",
    "3 3 art 1|4 4 art 1|50 0 art 1",
    "8 0 head 1|50 0 art 1|5 4 art 1|6 5 art 1|4 4 art 1|30 0 art 1|2 2 foot 0",
    "5 0 head 1|3 0 art 1|2 0 art 1|4 0 art 1|2 0 art 1|3 0 art 1|25 0 art 1",
    "2 0 art 1|24 0 art 1|31 0 art 1|16 0 art 1",
    "6 0 head 1|9 0 art 1|12 0 art 1|7 0 art 1|11 0 art 1|8 0 art 1|14 0 art 1",
    "1 1 nav 0|2 2 nav 0|1 1 nav 0|2 2 nav 0|10 0 head 1|20 0 art 1|17 0 art 1|23 1 art 1|5 4 foot 0|1 1 foot 0",
    "3 3 nav 0|3 3 nav 0|80 2 art 1|3 0 art 1|44 0 art 1|6 4 foot 0",
    "2 2 nav 0|1 1 nav 0|9 0 ad 0|11 0 head 1|45 0 art 1|39 0 art 1|9 0 foot 0",
    "1 1 nav 0|1 1 nav 0|3 3 nav 0|6 0 note 0|8 0 head 1|64 0 art 1|6 0 art 1|70 0 art 1|12 0 foot 0",
    "4 4 nav 0|3 3 nav 0|12 0 ad 0|5 0 head 1|52 0 art 1|58 0 art 1|7 0 foot 0",
    "2 2 nav 0|2 2 nav 0|3 0 nav 0|14 0 head 1|88 2 art 1|47 0 art 1|61 1 art 1|14 0 foot 0",
    "1 1 nav 0|1 1 nav 0|1 1 nav 0|8 0 head 1|35 0 art 1|26 0 art 1|30 0 comment 0|14 0 comment 0|6 3 foot 0",
    "5 5 nav 0|6 6 nav 0|5 0 head 1|18 0 art 1|19 0 art 1|21 0 art 1|7 7 side 0|8 8 side 0|6 6 side 0",
    "110 3 art 1|90 1 art 1|4 4 foot 0|3 3 foot 0|5 5 foot 0",
    "2 2 nav 0|65 0 art 1|72 0 art 1|10 0 art 1",
    "3 3 nav 0|4 4 nav 0|2 2 nav 0|3 3 nav 0|5 5 nav 0|16 0 art 1",
    "4 4 nav 0|1 0 head 1|70 0 art 1|2 0 head 1|64 0 art 1|1 0 head 1|58 0 art 1",
    "300 0 art 1|280 0 art 1|310 2 art 1|260 0 art 1|8 5 foot 0",
    "2 2 nav 0|2 2 nav 0|12 0 head 1|300 4 art 1|12 0 art 1|280 3 art 1|6 0 art 1|200 0 art 1|40 0 comment 0|25 0 comment 0",
)

Tree = tuple  # (share of main text,) or (feature, threshold, tree at or below, tree above)


def labelled_rows(pages: tuple[str, ...] = LABELLED) -> list[tuple[tuple[float, ...], int]]:
    """(features, label) of every block of ``pages``, of each page with all its marks, with boilerplate alone marked, with
    its article alone marked, and without any marks.

    Without marks only what words and links can tell is kept: no long texts of comments, sidebars and footers, as
    nothing but their names says that they aren't the article, and no page of short lines only.
    """
    rows = []
    for page in pages:
        cells = [(int(w), int(k), e, int(y)) for w, k, e, y in (c.split() for c in page.split("|"))]
        plain = [c for c in cells if c[3] or c[0] <= LONG or 3 * c[1] >= c[0]]
        bare = plain if any(c[0] > LONG and c[3] for c in cells) else []
        for own, boiler, article in ((cells, True, True), (cells, True, False), (plain, False, True), (bare, False, False)):
            blocks = [Block("", w, k, boiler and e not in ("art", "head"), article and e in ("art", "head"), article and e == "head") for w, k, e, _ in own]
            rows += [(f, c[3]) for f, c in zip(features(blocks), own, strict=True)]
    return rows


#: Words from which on a block with few links is taken for main text where a page names nothing.
LONG = 15


def grow_tree(rows: list[tuple[tuple[float, ...], int]], depth: int = 6, least: int = 10) -> Tree:
    """A binary tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    ones = sum(y for _, y in rows)
    share = ones / len(rows)
    if depth == 0 or ones in (0, len(rows)):
        return (share,)
    best: tuple[float, int, float] | None = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            cut = (lo + hi) / 2
            sides = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
            if min(map(len, sides)) < least:
                continue
            gini = sum(sum(s) * (1 - sum(s) / len(s)) for s in sides)
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, cut
    if best is None or best[0] >= ones * (1 - share) - 1e-12:
        return (share,)
    _, f, cut = best
    return f, cut, grow_tree([r for r in rows if r[0][f] <= cut], depth - 1, least), grow_tree([r for r in rows if r[0][f] > cut], depth - 1, least)


def score(tree: Tree, x: tuple[float, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: Tree) -> str:
    """The main text of one page: its main blocks joined by a line feed; empty for null or a page without any."""
    blocks = flat_blocks(page or "")
    return "\n".join(b.text for b, x in zip(blocks, features(blocks), strict=True) if score(tree, x) >= 0.5)


def extract_main_text(pages: DataFrame, labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; broken markup is read as far as it goes; repeated rows give equal results;
    other columns aren't read. The tree is grown from ``labelled``, a table of a few dozen blocks, before the job.
    """
    tree = grow_tree(labelled_rows(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column("html")]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(cols, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op3_tree_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
