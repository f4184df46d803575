"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for each block of a page, in page order. The lengths of lines are summed over
a sliding window. A surge is where the sums rise above the threshold, a dive where they have fallen to nothing; the text
between the dives around a surge is kept, on every page by the same rule: the threshold is THRESHOLD signs a window. How long
the rest of the page is does not matter, but for text beside a marked article that surges: it must reach a PEAK-th of the article's
highest window, too.

Elements and attributes only weigh the distribution:

* A line that cannot be article text has length zero: in menus, headers and footers of the page, sidebars, notices,
  adverts, forms and reader comments, known by element, role or by a class or id that says nothing else; and lines that are
  links for the most part, unless text stands before and after in the same container. A class or id (or a form) that would hide more than half of a page's text, and its heading or
  article with it, is a wrapper around the page and hides nothing.
* A line in a marked article (article, main, or a role of that kind) weighs WEIGHT times its length, and the edges of marked
  articles are dives, so that what stands beside them surges on its own or not at all. Hidden lines inside an article are
  taken out of the distribution, so that they do not cut the article in two.
* Short lines that a dive has cut off stay if their container has kept lines of their kind of element, THRESHOLD signs of them.

Scripts, styles and comments leave no line. Reading is linear in the page's length, however deep its elements nest: open
elements are found by name. A quote is a quote only where a value begins, as browsers have it.

Defined results: a null or empty page has the empty text. Unclosed and misnested elements, cut pages and stray end tags
are read as browsers read them, in outline. Repeated rows come out each; ties do not arise, as all that surges is kept; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
THRESHOLD = 86
WEIGHT = PEAK = 8
#: A line with more than this share of its signs in links is a menu line.
LINK_SHARE = 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# HTML's void elements, elements whose content is not text, and inline elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml noembed noframes canvas audio video xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd semantics mstyle mpadded mphantom menclose mspace".split())
#: Blocks of text; what else is a block is a container.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption center address hgroup".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table menu select article body html div section td".split())
_NOT_TEXT = frozenset("nav aside footer button select textarea dialog head menu fieldset title option datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
_MAIN_ROLES = frozenset("main article".split())
#: What a class or id says of an element that holds no article text, in the singular.
_BOILER = frozenset(
    "ad adv advert advertisement advertising adsense adbox adslot adsbygoogle adunit dfp taboola outbrain banner promo promotion promoted sponsor sponsored nav navbar navigation menu submenu topnav breadcrumb "
    "sidebar side aside widget related recommended recommendation trending popular footer foot masthead topbar toolbar cookie consent gdpr notice disclaimer alert popup modal overlay newsletter subscribe subscription "
    "signup login comment commentlist disqu respond response reply reaction feedback guestbook discussion share sharing social pager pagination skip copyright legal paywall toc hidden".split()
)
#: Words beside them that change nothing. A class with any other word ("has-sidebar", "legal-guide") says something else.
_NEUTRAL = frozenset(
    "list box wrap wrapper container inner outer section area bar block panel left right top bottom main site page global primary secondary item link slot unit group row col column content body text title heading form field button "
    "author meta count thread tree post article entry story new user reader blog media icon info law google my the js sticky fixed floating mobile desktop small large big first last and".split()
)
#: Headers of a site; an article's own header is not one.
_HEADER = frozenset("header site-header page-header top-header global-header main-header header-top header-main header-bar header-wrap header-wrapper header-inner header-container".split())
_WORD_EDGE = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I)


def _attributes(text: str) -> dict[str, str]:
    if "=" not in text and not text.strip(" /\n\t"):
        return {}
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape("".join(values)))
    return found


@lru_cache(1 << 14)
def _names(value: str) -> tuple[bool, bool]:
    """Whether a class or id names a site's header, and whether it names other boilerplate."""
    header = boiler = False
    for name in value.split():
        words = [w.lower() for w in _WORD_EDGE.split(name) if w]
        header |= "-".join(words) in _HEADER
        plain = [w if w in _BOILER else w.removesuffix("s") for w in words]
        boiler |= any(w in _BOILER for w in plain) and all(w in _BOILER or w in _NEUTRAL for w in plain)
    return header, boiler


def _is_boiler(tag: str, at: dict[str, str], inside: bool) -> int:
    """2 if the element itself holds no article text, 1 if its names (or a form) say so, else 0.

    inside: within a marked article, where a header is the article's own.
    """
    if tag == "form":
        return 1
    if tag in _NOT_TEXT or tag == "header" and not inside:
        return 2
    if not at:
        return 0
    names = [_names(at[k]) for k in ("class", "id") if at.get(k)]
    if not inside and any(header for header, _ in names):
        return 2
    if tag in ("html", "body"):
        return 0
    role = at.get("role", "").lower()
    if role in _ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        return 2
    return int(any(boiler for _, boiler in names))


class Line:
    """mark: the number of the innermost element that hides it, or 0. article: whether it is in a marked article.

    holder: the number of its container (0: the page's body), with the kind of its innermost block.
    """

    __slots__ = ("text", "links", "mark", "article", "holder")

    def __init__(self, text: str, links: int, mark: int, article: bool, holder: tuple[int, str]):
        self.text, self.links, self.mark, self.article, self.holder = text, links, mark, article, holder


class Mark:
    """An element that hides its text, unless it turns out to be a wrapper around the page."""

    __slots__ = ("parent", "named", "size", "holds")

    def __init__(self, parent: int, named: bool):
        self.parent, self.named, self.size, self.holds = parent, named, 0, False


class Open:
    """The open elements, innermost last, and the places of each kind."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool, tuple[int, str]]] = []  # tag, mark, article, link, holder
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, entry: tuple[str, int, bool, bool, tuple[int, str]]) -> None:
        self.places.setdefault(entry[0], []).append(len(self.stack))
        if entry[0] not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(entry)

    def cut(self, depth: int) -> bool:
        """Close all elements from a place on; whether a block was among them."""
        block = False
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()
                block = True
        return block


def lines(page: str) -> tuple[list[Line], list[Mark]]:
    """The page's lines and the marks that hide some of them; marks[0] hides nothing."""
    out: list[Line] = []
    marks = [Mark(0, False)]
    parts: list[str] = []
    links = 0
    opened = Open()
    mark, article, link, holder, containers = 0, False, False, (0, ""), 0

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if link:
                links += len(raw)

    def end_line() -> None:
        nonlocal links
        line = " ".join("".join(parts).split())
        if line:
            out.append(Line(line, links, mark, article, holder))
            marks[mark].size += len(line)
        parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal mark, article, link, holder
        # The line ends before its element does.
        if opened.blocks and opened.blocks[-1] >= depth:
            end_line()
        opened.cut(depth)
        _, mark, article, link, holder = opened.stack[-1] if opened.stack else ("", 0, False, False, (0, ""))

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if not token:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            place = opened.last((tag,))
            if place >= 0 and not (tag in _INLINE and opened.blocks and opened.blocks[-1] > place):
                close(place)
            elif tag == "p" and place < 0:
                end_line()
            continue
        if tag in _RAW and not token[3].rstrip().endswith("/"):
            ending = _raw_end(tag).search(page, at)
            close_at = page.find(">", ending.end()) if ending else -1
            at = close_at + 1 if close_at >= 0 else end
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                end_line()
            continue
        if tag in _CLOSES_P or tag in _ALIKE:
            closed = _ALIKE.get(tag, set()) | ({"p"} if tag in _CLOSES_P or tag in ("li", "dd", "dt") else set())
            place = opened.last(closed)
            if place > opened.last(_HOLDS - closed):
                close(place)
        attributes = _attributes(token[3])
        if tag not in _INLINE:
            end_line()
        marked = tag in ("article", "main") or attributes.get("role", "").lower() in _MAIN_ROLES
        bad = _is_boiler(tag, attributes, article)
        if tag == "h1" or marked and not bad:
            marks[mark].holds = True
        own = mark
        if bad:
            if tag in _INLINE:
                end_line()
            marks.append(Mark(mark, bad == 1))
            own = len(marks) - 1
        within = holder
        if tag not in _INLINE and tag not in ("html", "body"):
            containers += tag not in _TEXTUAL
            within = (holder[0] if tag in _TEXTUAL else containers, tag)
        opened.push((tag, own, article or marked and not bad, link or tag == "a", within))
        _, mark, article, link, holder = opened.stack[-1]
    end_line()
    return out, marks


def hiding(marks: list[Mark]) -> list[bool]:
    """For each mark, whether it or one around it hides text."""
    for m in reversed(marks[1:]):
        around = marks[m.parent]
        around.size += m.size
        around.holds |= m.holds
    hides = [False]
    for m in marks[1:]:
        wrapper = m.named and m.holds and 2 * m.size > marks[0].size
        hides.append(not wrapper or hides[m.parent])
    return hides


def distribution(page: str, weight: int = WEIGHT, window: int = WINDOW) -> tuple[list[Line | None], list[int]]:
    """The page's lines and their weighed lengths, with empty lines (None) at the edges of marked articles."""
    found, marks = lines(page)
    hides = hiding(marks)
    mostly = [x.links > LINK_SHARE * len(x.text) for x in found]
    texts: list[Line | None] = []
    lengths: list[int] = []
    inside = False

    def between(i: int) -> bool:
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(found)]
        return len(near) == 2 and all(not mostly[j] and not hides[found[j].mark] and found[j].holder[0] == found[i].holder[0] for j in near)

    for i, x in enumerate(found):
        if x.article and hides[x.mark]:
            continue
        if x.article != inside:
            texts += [None] * window
            lengths += [0] * window
            inside = x.article
        texts.append(x)
        menu = not x.article and mostly[i] and not between(i)
        lengths.append(0 if hides[x.mark] or menu else len(x.text) * (weight if x.article else 1))
    return texts, lengths


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The page's main text: its blocks joined by one space."""
    if not page:
        return ""
    found, lengths = distribution(page, window=window)
    kept = surges(lengths, window, threshold, [bool(x and x.article) for x in found])
    sizes: dict[tuple[int, str], int] = {}
    for i in kept:
        if lengths[i]:
            sizes[found[i].holder] = sizes.get(found[i].holder, 0) + len(found[i].text)
    stays = {holder for holder, size in sizes.items() if size >= threshold and (holder[0] or holder[1] == "p")}
    also = [i for i, x in enumerate(found) if x and x.holder in stays]
    return " ".join(found[i].text for i in sorted({*kept, *also}) if lengths[i])


def surges(lengths: list[int], window: int, threshold: int, inside: list[bool] | None = None) -> list[int]:
    """The lines between the dives around each surge.

    sums[i] is over the lines i to i + window - 1. A dive is where a window is empty; between two dives the sums rise and
    fall, and if one of them reaches the threshold, all lines there are kept. If no window of the page reaches the threshold,
    the highest stands in for it. inside: the lines of marked articles; others must also reach a PEAK-th of their highest.
    """
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    if not total[-1]:
        return []
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    inside = inside or [False] * n
    least = min(threshold, max(sums))
    beside = max(least, max((s for s, x in zip(sums, inside, strict=True) if x), default=0) / PEAK)
    kept, i = [], 0
    while i < n:
        begin = i
        while i < n and sums[i]:
            i += 1
        # A stretch is of one kind: the edges of articles are dives. Its last line tells, as windows look ahead.
        if i > begin and max(sums[begin:i]) >= (least if inside[i - 1] else beside):
            kept += range(begin, i)
        i += 1
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages (page_id, url, html)."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            arrays = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=schema.names)

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(take, schema)
