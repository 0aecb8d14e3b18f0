"""Main text of pages of many shapes that the labelled table doesn't hold, with and without element names."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from textloom.llm import main_text

TREE = main_text.grow_tree(main_text.labelled_rows())


def said(n, c="w"):
    return " ".join(f"{c}{i}" for i in range(n))


def links(n):
    return "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(n))


def p(*sizes):
    return "".join(f"<p>{said(n, chr(97 + i % 26))}</p>" for i, n in enumerate(sizes))


NAV, FOOT, SIDE = f"<nav><ul>{links(6)}</ul></nav>", "<footer><p>Imprint 2020 all rights</p></footer>", f"<aside><ul>{links(4)}</ul><p>{said(30, 'side')}</p></aside>"
TALK = f'<section id="comments"><p>{said(40, "talk")}</p><p>{said(9, "reply")}</p></section>'
TABLE = "<table>" + "".join(f"<tr><td>row {i}</td><td>{i * i}</td></tr>" for i in range(6)) + "</table>"
CODE = "<pre>def f(x):\n    return x + 1</pre>"
#: (before, article, after) of pages: whatever stands in the middle is the main text.
SHAPES = {
    "one paragraph": ("", p(200), ""), "one line": ("", "<p>One short line.</p>", ""), "two paragraphs": ("", p(120, 150), ""), "five paragraphs": ("", p(40, 55, 12, 70, 33), ""),
    "title and text": ("", "<h1>A title here</h1>" + p(61), ""), "menu, no footer": (NAV, "<h1>A title here</h1>" + p(40, 60), ""), "footer, no menu": ("", p(75, 64), FOOT),
    "menu and footer": (NAV, "<h1>Some title</h1>" + p(33, 71, 28), FOOT), "side after": (NAV, p(88, 93), SIDE + FOOT), "side before": (NAV + SIDE, "<h2>Head</h2>" + p(54, 47), FOOT),
    "comments after": ("", p(30), TALK), "comments and footer": (NAV, "<h1>Title</h1>" + p(90, 45), TALK + FOOT), "list first": ("", f"<ul>{links(2)}</ul>" + p(50), ""),
    "list inside": (NAV, p(60) + "<ul><li>first of all</li><li>second of all</li><li>third of all</li></ul>" + p(48), FOOT), "table": (NAV, "<h1>Numbers</h1>" + p(35) + TABLE + p(41), FOOT),
    "table last": (NAV, p(44, 39) + TABLE, FOOT), "code": (NAV, p(38) + CODE + p(52) + CODE, FOOT), "code only": ("", "<p>a &amp; b</p>" + CODE, ""),
    "many short lines": (NAV, "".join(f"<p>line number {i} of a poem</p>" for i in range(12)), FOOT), "talk in lines": ("", p(3, 5, 2, 4, 6, 3, 25, 4), ""), "headings between": (NAV, "".join(f"<h2>Part {i}</h2>" + p(30 + i) for i in range(5)), FOOT),
    "quote": (NAV, p(70) + f"<blockquote>{said(22, 'q')}</blockquote>" + p(66), FOOT), "picture": (NAV, p(58) + "<figure><img src=a><figcaption>What one sees</figcaption></figure>" + p(63), FOOT),
    "links in text": (NAV, f"<p>{said(20)} <a href=x>link one</a> {said(20, 'v')} <a href=y>link two</a> {said(9, 'u')}</p>" * 3, FOOT), "long paragraphs": (NAV, p(400, 380, 420), FOOT), "no paragraphs": (NAV, f"{said(80)}<br>{said(70, 'x')}", FOOT),
    "advert inside": (NAV, p(50), f'<div class="advert"><p>{said(25, "buy")}</p></div>' + FOOT), "notice first": (f'<div class="cookie-notice"><p>{said(35, "cookie")}</p></div>' + NAV, p(57, 49), FOOT), "form after": (NAV, p(66, 72), f"<form><p>{said(18, 'sign')}</p></form>" + FOOT),
    "definitions": (NAV, "<dl><dt>term</dt><dd>" + said(24) + "</dd><dt>other</dt><dd>" + said(31, "x") + "</dd></dl>", FOOT), "menu of many": (f"<nav><ul>{links(40)}</ul></nav>", p(81, 64, 77), FOOT), "one long, one short": (NAV, p(150, 20), FOOT),
}


def overlap(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain(html):
    """The page with div for every element that says what it is for, and without names."""
    html = re.sub(r"<(/?)(nav|aside|footer|form|section|article|main)\b[^>]*>", r"<\1div>", html)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", html)


@pytest.mark.parametrize("name", SHAPES)
def test_article_of_each_shape(name):
    before, article, after = SHAPES[name]
    want = "\n".join(b.text for b in main_text.flat_blocks(article))
    for page in (f"<body>{before}<article>{article}</article>{after}</body>", f"<body>{before}<div class='post-content'>{article}</div>{after}</body>"):
        assert main_text.main_text(page, TREE) == want
    assert overlap(main_text.main_text(f"<body>{before}<div>{article}</div>{after}</body>", TREE), want) >= 0.95


def test_shapes_without_any_names():
    """Words and links alone: long comments, asides and notices read like text, menus and footers don't."""
    scores = {}
    for name, (before, article, after) in SHAPES.items():
        want = "\n".join(b.text for b in main_text.flat_blocks(article))
        scores[name] = overlap(main_text.main_text(plain(f"<body>{before}<div>{article}</div>{after}</body>"), TREE), want)
    assert sum(scores.values()) / len(scores) >= 0.85, scores
    assert all(scores[n] == 1 for n in ("one paragraph", "two paragraphs", "five paragraphs", "one line", "title and text"))


def test_the_tree_decides_where_names_do_not():
    """On supplied pages without any names the tree's answer isn't the marks', and is mostly right."""
    same = kept = 0
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for row in pages:
        want = Counter(b.text for b in main_text.flat_blocks(re.search("<article>.*</article>", row["html"], re.S).group()))
        blocks = main_text.flat_blocks(plain(row["html"].replace("<header", "<div").replace("</header", "</div")))
        told = [main_text.score(TREE, x) >= 0.5 for x in main_text.features(blocks)]
        assert not any(b.boiler or b.article for b in blocks) and any(told) and not all(told)
        same += sum(t == (b.text in want) for t, b in zip(told, blocks))
        kept += len(blocks)
    assert same / kept > 0.85


def test_no_leaf_rests_on_a_few_blocks():
    rows = main_text.labelled_rows()

    def leaves(tree, own):
        if len(tree) == 1:
            return [len(own)]
        low, high = [r for r in own if r[0][tree[0]] <= tree[1]], [r for r in own if r[0][tree[0]] > tree[1]]
        return leaves(tree[2], low) + leaves(tree[3], high)

    assert min(leaves(TREE, rows)) >= 10 and len(leaves(TREE, rows)) <= 24
