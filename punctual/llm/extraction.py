"""Main text of web pages by two passes over their text blocks.

The first pass classifies blocks by share of stop words, length and share of link text; the second lets
undecided ones inherit from their nearest decided neighbours.  How many stop words are many is
measured against the page's own running text, and words frequent there count as well, so pages in languages
without a list, or with few function words, are judged by their own measure.

Marks are signs beside the two passes.  A marked article lifts the blocks inside by a step and
takes out those outside, unless it holds only a small part of the text.  A name such as
"sidebar" takes an element out, unless that element is what holds the text.
"""

from __future__ import annotations

import collections
import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from punctual.llm.arrow import per_row

#: Frequent function words of the languages the rules know.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do even for from
    get had has have he her him his how i if in into is it its just like more my no not now of on one only or
    our out over she so some than that the their them then there these they this those to up us was we were
    what when which who will with would you your
    der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war waren von vor mit
    zu zum zur im am auf aus bei nach für über unter durch als auch wie dass sich es er sie wir ihr ich du man
    noch nur so wenn werden wird hat haben
    le la les un une du de des et ou mais ne pas que qui est sont au aux en dans par pour sur avec sans ce cet
    cette ces il elle ils elles on nous vous je tu se sa son ses leur plus comme être avoir
    el los las unos unas uno del al y o pero no es son en por para con sin sobre este esta estos estas ese esa
    lo su sus se que como más muy ya
    il lo gli i un uno una di da del della dei nel nella su per tra fra che non è sono con e ed o ma come più
    """.split()
)
#: Thresholds of the first pass: characters of a short and of a long block (a character of a script
#: without spaces is worth WIDE), most that few and many stop words can be, shares of the page's own level
#: at which they are reached, level below which they say nothing, and share of link text.
SHORT, LONG, WIDE = 70, 200, 3
FEW_STOPS, MANY_STOPS = 0.30, 0.32
FEW_OF_LEVEL, MANY_OF_LEVEL = 0.3, 0.75
NO_LEVEL = 0.06
LINKED = 0.33
#: A word is frequent on a page if it is found so often, and this share of its words.
FREQUENT, FREQUENT_SHARE = 3, 0.01
#: Share of the text that an element must hold for its name not to count, and least share of the text that
#: marked articles must hold for the mark to count.
HOLDS_TEXT, MARK_COUNTS = 0.8, 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^<>]*>"  # a tag with a stray quote
    r"|(?P<text>[^<]+)|<(?=[a-zA-Z/!?])[^<]*\Z|(?P<stray><)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements whose content is never text of the page, and elements that hold no article text.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside button select option menu dialog datalist label fieldset legend input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p
    pre section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
WHOLE = frozenset(["html", "body"])
#: An unclosed one of these ends where the next one opens.
CLOSED_BY_SIBLING = frozenset("p li dd dt tr td th option".split())
#: Words of class, id and role names that mark what is not the article.
_OFF_TOPIC = frozenset(
    """ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies disqus footer masthead menu menubar modal nav navbar navigation navigationmenu newsletter
    notice notices overlay pager pagination popup promo promoted promotion recommended related respond share
    sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar topbar widget alert
    contentinfo complementary search""".split()
)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
#: Names of reader comments: such an element stays out, however much text it holds.
_COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: A character of a script written without spaces is a word of its own.
_NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_NO_SPACES}]|[^\W\d_{_NO_SPACES}]+")
_UNSPACED = re.compile(rf"[{_NO_SPACES}]")


def _hidden(attrs: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _names(attrs: str) -> set[str]:
    """Words of the class, id and role names."""
    values = (value for name, value in _ATTRIBUTE.findall(attrs) if name.lower() in ("class", "id", "role"))
    return {part.lower() for value in values for part in _NAME_PARTS.findall(value)}


class Block:
    """Text between two block borders: its characters, those within links, and where it stands."""

    __slots__ = ("parts", "linked", "main", "heading", "text", "doubt")

    def __init__(self, main: bool, heading: bool, doubt: int):
        self.parts: list[str] = []
        self.linked = 0
        self.main, self.heading, self.doubt = main, heading, doubt
        self.text = ""


class Doubt:
    """An element whose name or tag says that it is off topic, the one around it, and the text it holds."""

    __slots__ = ("around", "comments", "inside_main", "size", "main_size")

    def __init__(self, around: int, comments: bool, inside_main: bool):
        self.around, self.comments, self.inside_main = around, comments, inside_main
        self.size = self.main_size = 0


def _settled(found: list[Block], doubts: list[Doubt]) -> list[Block]:
    """Blocks that stand in no off-topic element.

    A name is not believed where the element holds most of the marked article's text, or on a page
    without one most of all text.  Inside a marked article, and for reader comments, it always is.
    """
    total, main_total = sum(len(b.text) for b in found), sum(len(b.text) for b in found if b.main)
    if main_total < MARK_COUNTS * total:
        main_total = 0
    for b in found:
        if b.doubt >= 0:
            doubts[b.doubt].size += len(b.text)
            doubts[b.doubt].main_size += len(b.text) if b.main else 0
    for d in reversed(doubts):  # the one around stands before
        if d.around >= 0:
            doubts[d.around].size += d.size
            doubts[d.around].main_size += d.main_size
    out: list[bool] = []
    for d in doubts:
        held = d.main_size >= HOLDS_TEXT * main_total if main_total else d.size >= HOLDS_TEXT * total
        out.append(d.comments or d.inside_main or not held or d.around >= 0 and out[d.around])
    return [b for b in found if b.doubt < 0 or not out[b.doubt]]


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without scripts, markup and elements that are marked off-topic."""
    found: list[Block] = []
    doubts: list[Doubt] = []
    stack: list[tuple[str, bool, int]] = []  # open elements, if each takes its content out, and the doubt around it
    doubt = -1
    out = links = main = heading = 0
    current: Block | None = None
    raw = ""

    def finish():
        nonlocal current
        if current is not None:
            current.text = " ".join(entities.unescape("".join(current.parts)).split())
            if current.text:
                found.append(current)
            current = None

    def leave(entry):
        nonlocal out, links, main, heading, doubt
        tag, dropped, doubt = entry
        out -= dropped
        links -= tag == "a"
        main -= tag in MAIN
        heading -= tag in HEADINGS

    at = 0
    while at < len(page):
        if raw:  # only the matching end tag ends such an element
            end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            raw = ""
            if end is None:
                break
            at = end.end()
            continue
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        text = m["text"] or m["stray"]
        if text:
            if not out:
                if current is None:
                    current = Block(main > 0, heading > 0, doubt)
                current.parts.append(text)
                current.linked += len(text.strip()) if links else 0
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            finish()
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if m["close"]:
            if any(t == tag for t, _, _ in stack):
                while True:
                    entry = stack.pop()
                    leave(entry)
                    if entry[0] == tag:
                        break
            continue
        if tag in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                raw = re.escape(tag)
            continue
        if tag in VOID or m["attrs"].rstrip().endswith("/"):
            continue
        if tag in CLOSED_BY_SIBLING and stack and stack[-1][0] == tag:
            leave(stack.pop())
        dropped = tag in DROPPED or tag == "header" and not main or _hidden(m["attrs"])
        stack.append((tag, dropped, doubt))
        out += dropped
        names = _names(m["attrs"]) if tag not in WHOLE else frozenset()
        if tag == "form" or names & _OFF_TOPIC or not main and "header" in names and "article" not in names:
            if tag not in BLOCK:  # text on both sides of it is not its own
                finish()
            doubts.append(Doubt(doubt, bool(names & _COMMENTS) and tag != "main", main > 0))
            doubt = len(doubts) - 1
        links += tag == "a"
        main += tag in MAIN
        heading += tag in HEADINGS
    finish()
    return _settled(found, doubts)


GOOD, BAD, NEAR, OPEN = "good", "bad", "near", "open"


class Level:
    """What counts as a stop word on a page, and which shares of them are few and many.

    Measured on the running text: long blocks without many links, inside the article if one is marked.  Text
    with hardly any (tables, lists of names) is judged by length and links alone.
    """

    def __init__(self, found: list[Block]):
        running = [_WORD.findall(b.text.lower()) for b in found if b.linked <= LINKED * len(b.text) and width(b.text) >= SHORT]
        counts = collections.Counter(w for words in running for w in words)
        total = sum(counts.values())
        least = max(FREQUENT, FREQUENT_SHARE * total)
        self.words = STOP_WORDS | {w for w, n in counts.items() if n >= least}
        level = sum(n for w, n in counts.items() if w in self.words) / max(1, total)
        if level < NO_LEVEL:
            level = 0.0
        self.few, self.many = min(FEW_STOPS, FEW_OF_LEVEL * level), min(MANY_STOPS, MANY_OF_LEVEL * level)

    def share(self, text: str) -> float:
        words = _WORD.findall(text.lower())
        return sum(w in self.words for w in words) / max(1, len(words))


def width(text: str) -> int:
    """Length, a character of a script without spaces taken for several."""
    return len(text) + (WIDE - 1) * sum(1 for _ in _UNSPACED.finditer(text))


def first_pass(block: Block, level: Level) -> str:
    """Good, bad, nearly good or open (short, or long without the words that would decide)."""
    text, size = block.text, width(block.text)
    if block.linked > LINKED * len(text) or not block.main and text.startswith("©"):
        return BAD
    if size < SHORT or block.heading:
        return OPEN
    stops = level.share(text)
    if stops >= level.many:
        return GOOD if size > LONG else NEAR
    if stops >= level.few:
        return NEAR
    return OPEN if block.main or size <= LONG else BAD  # in few words, few stop words prove little


def second_pass(kinds: list[str], inside: list[bool], headings: list[bool]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block before and after them.

    Where the two differ, or one is missing, the nearer side wins; nearly good blocks then need one
    good side only, headings look ahead alone, and blocks of a marked article stay unless both
    sides are bad.  Where no block is decided, all stay.
    """
    n = len(kinds)
    if not {GOOD, BAD} & set(kinds):
        return [True] * n
    before: list[tuple[str, int]] = [("", n)] * n
    after: list[tuple[str, int]] = [("", n)] * n
    last = ("", -n)
    for i in range(n):
        before[i] = (last[0], i - last[1])
        if kinds[i] in (GOOD, BAD):
            last = (kinds[i], i)
    last = ("", 2 * n)
    for i in reversed(range(n)):
        after[i] = (last[0], last[1] - i)
        if kinds[i] in (GOOD, BAD):
            last = (kinds[i], i)
    kept = []
    for i, kind in enumerate(kinds):
        (b, b_far), (a, a_far) = before[i], after[i]
        if kind in (GOOD, BAD):
            kept.append(kind == GOOD)
        elif inside[i]:
            kept.append(not (b == a == BAD))
        elif headings[i]:
            kept.append(a == GOOD or not a and not b)
        elif kind == NEAR:
            kept.append(GOOD in (a, b) or not a and not b)
        elif a == b:
            kept.append(a == GOOD)
        else:
            kept.append((b if b and (b_far <= a_far or not a) else a) == GOOD)
    return kept


def main_text(page: str | None) -> str:
    """Text of a page's article, its blocks joined by an empty line; empty for null.

    Blocks that share of link text, length and share of stop words decide are good or bad; the
    rest inherit from their nearest decided neighbours.  If the page marks an article that holds a
    fair part of its text, blocks outside are left out beforehand and say nothing about those inside.
    """
    if not page:
        return ""
    found = blocks(page)
    marked = sum(len(b.text) for b in found if b.main)
    if marked and marked >= MARK_COUNTS * sum(len(b.text) for b in found if b.linked <= LINKED * len(b.text)):
        found = [b for b in found if b.main]
    else:
        for b in found:
            b.main = False
    level = Level(found)
    kept = second_pass([first_pass(b, level) for b in found], [b.main for b in found], [b.heading for b in found])
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every page.

    Null and empty pages, and pages without an article, give an empty text.  Rows are independent;
    whole pages are read; an empty table stays empty; input columns of the two names are replaced.
    """
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(value):
        text = main_text(value)
        return text, len(text)

    return per_row(pages, [html], fields, work, pages.columns if keep is None else keep)
