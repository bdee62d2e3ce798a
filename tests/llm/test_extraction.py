from __future__ import annotations

import os

import pytest

from punctual.llm import extraction
from punctual.llm.extraction import main_text

LONG = (
    "This is the first paragraph of the article and it has all of the small words that a text of this kind has, so that the rules can "
    "see that it is a part of the text and not of the menu, and it goes on for more than two hundred characters."
)


def test_marked_article():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
      <div class="ad">Buy the best of it and more of this and that and all of those.</div>
      <article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short&nbsp;one.<p>Next<br>line &#8212; &lt;b&gt;
      <form><input value=x><p>Name</p></form><aside>Side</aside><div class="user-comments"><p>{LONG}</p></div>
      <p><a href="x">only a link here</a></p></article><footer>&copy; all</footer></body></html>"""
    assert main_text(page) == f"Title & more\n\n{LONG}\n\nShort one.\n\nNext line — <b>"


def test_rules_without_article():
    menu = "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(6))
    page = f"<div><ul>{menu}</ul></div><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div>{menu}</div><p>Terms</p><div>{menu}</div>"
    assert main_text(page) == f"Head\n\n{LONG}\n\nYes.\n\n{LONG}"


MENU = "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(6))
RUSSIAN = (
    "Это первый абзац статьи, и в нём есть все те слова, которые бывают в таком тексте, и он достаточно длинный, чтобы правила могли "
    "увидеть, что это часть текста, а не меню, и он продолжается дальше, пока не станет больше двухсот знаков."
)
CHINESE = "这是文章的第一段，它包含了这类文本所具有的所有常见的字，所以规则可以看出它是文本的一部分，而不是菜单的一部分，而且它继续写下去，直到超过七十个字的长度。"


@pytest.mark.parametrize("page, want", [
    (f'<body class="no-sidebar"><ul>{MENU}</ul><p>{LONG}</p></body>', LONG),
    (f'<article class="post widget"><p>{LONG}</p></article>', LONG),
    (f'<div class="widget main-column"><article><p>{LONG}</p></article></div><p>{LONG}</p>', LONG),
    (f"<body><form><ul>{MENU}</ul><p>{LONG}</p></form></body>", LONG),
    (f"<body><ul>{MENU}</ul><h1>Да</h1><p>{RUSSIAN}</p><ul>{MENU}</ul></body>", f"Да\n\n{RUSSIAN}"),
    (f"<div>{MENU}</div><p>{CHINESE}</p>", CHINESE),
    (f'<div class="related"><article>A card</article></div><p>{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
    (f'<article><p>{LONG}</p><article class="comment"><p>{LONG} {LONG}</p></article></article>', LONG),
    (f'<p>{LONG}</p><div id="comments"><p>{LONG * 9}</p></div>', LONG),
    (f'<p>{LONG}</p><form><p>Name</p></form><div hidden><p>{LONG}</p></div>', LONG),
])
def test_names_and_marks_are_signs(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<nav><p>x</p></nav>", "<script>x", "<!-- x", "<style>p</style>"])
def test_nothing_there(page):
    assert main_text(page) == ""


def test_broken_markup():
    assert main_text("<article><p>a <b>b <i>c</p><p>d</article") == "a b c\n\nd"
    assert main_text("<main><p>1 < 2 &am") == "1 < 2 &am"
    assert main_text('<article><p>x<a href="y>z</a><p>w</article>').startswith("x")
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_second_pass_nearest_label():
    g, b, o = extraction.GOOD, extraction.BAD, extraction.OPEN
    none = [False] * 5
    assert extraction.second_pass([g, o, o, o, b], none, none) == [True, True, True, False, False]
    assert extraction.second_pass([b, o, g, o, b], none, none) == [False, False, True, True, False]
    assert extraction.second_pass([b, o, b, o, o], [True] * 5, none) == [False, False, False, True, True]


def test_odd_rows(spark):
    rows = [(1, "u", None, "old"), (1, "u", None, "old"), (2, None, f"<article><p>{'word ' * 100_000}</p></article>", "x"), (None, "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(df).orderBy("page_id").collect()
    assert [r["n_chars"] for r in got] == [0, 0, 0, 499_999]
    assert extraction.extract(df.limit(0)).count() == 0
    assert extraction.extract(df).columns == ["page_id", "url", "html", "text", "n_chars"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_pages_keep_the_article_and_drop_the_rest(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.sub(r"<[^<]*\Z", "", r["html"].split("<article>")[1].split("</article>")[0])
        parts = [" ".join(html.unescape(re.sub(r"<(?!p\b|h1\b)[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
        assert main_text(r["html"]) == "\n\n".join(p for p in parts if p)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_pages_without_the_tag_give_the_same_text(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [p.replace("<article>", "").replace("</article>", "") for p in pages]
    same = sum(main_text(p) == main_text(b) for p, b in zip(pages, bare, strict=True))
    assert same >= 0.9 * len(pages)
    assert all(main_text(b) for p, b in zip(pages, bare, strict=True) if main_text(p))
