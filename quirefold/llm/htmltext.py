"""Main text of web pages by text-to-tag ratios.

The standard library's parser reads a page in chunks; its events are folded into lines, one per block of text, each with
its characters, the tags met since the line before, and the elements around it. The ratio of characters to tags is smoothed
over the lines with a Gaussian, and two clusters of the smoothed ratios give the threshold above which a line is content.
The article is the element that holds most of the content lines, the article elements of the others, and what lies between the
first and the last of them below the element that holds them all: its blocks are the text, short ones too, without elements that say by
their tag, role, class or id that they are menus, headers, footers, sidebars, notices, adverts, forms or comments. Inside the
article a class or id says so only if it ends in the telling word, never of headings and paragraphs, and, but for the plainest
words, only of elements whose own ratio is not that of content: a section may be called related-work. A name says nothing if
all content of the page lies in the element that has it.

Elements are numbered as they open, and each knows the last number given while it was open, so that "lies in" is a comparison
of numbers: time and memory grow with the page's length, however deep its elements lie and whether or not they are closed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import pieces, spread

CHUNK = 1 << 16
SIGMA = 1.5
SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr td th "
    "math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
SILENT = frozenset("script style noscript template head title svg annotation annotation-xml iframe object audio video canvas select textarea button datalist".split())
FRAME = frozenset("nav header footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
HOLDERS = frozenset("html body main article section div center table tbody tr td".split())
#: Words in class or id that mark what surrounds an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies cc copyright discussion discussions disqus disclaimer dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply respond response responses search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription "
    "teaser toc toolbar topbar widget widgets".split()
)
#: Words that a telling word may be followed by: comment-list, share-bar, nav-container.
LAYOUT = frozenset(
    "area articles bar block bottom box button buttons column container content group holder icons inner item items left link links list "
    "main outer panel posts right row section stories tags text title top window wrap wrapper".split()
)
#: Names by themselves that mark what is no part of an article, however much prose it holds.
PLAIN = frozenset("ad ads advert adverts advertisement comment comments disqus replies reply respond responses sponsored".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
IN_ARTICLE = frozenset("ad ads advert comment comments promo related reply sponsored teaser".split())
#: A class with one of these words is a part of the article when it says header, and a state when it begins with one of those.
OF_ARTICLE = frozenset("article content entry post story text".split())
STATES = frozenset("has is js no with without".split())
#: An element that a start tag ends although its end tag is missing, and the elements beyond which it is not looked for.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "dl", "menu")), "dt": (("dt", "dd"), ("ul", "ol", "dl", "menu")), "dd": (("dt", "dd"), ("ul", "ol", "dl", "menu")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
TOKEN = re.compile(r"[A-Za-z]+")
MARKED = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata)\s*\[", re.IGNORECASE)
OPEN_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


class Line:
    """``place`` is the number of the innermost element that may hold an article, ``told`` that of the innermost telling one; -1 for none."""

    __slots__ = ("text", "tags", "place", "aside", "heading", "told")

    def __init__(self, text: str, tags: int, place: int, aside: bool, heading: bool, told: int):
        self.text, self.tags, self.place, self.aside, self.heading, self.told = text, tags, place, aside, heading, told


class Told:
    """An element whose class or id holds a telling word: whether a name ends in it, or is a plain one, and where it stands."""

    __slots__ = ("prose", "ends", "plain", "inside", "place")

    def __init__(self, prose: bool, ends: bool, plain: bool, inside: bool, place: int):
        self.prose, self.ends, self.plain, self.inside, self.place = prose, ends, plain, inside, place


class Tree:
    """Numbered elements: the one above each, and the last number given while it was open."""

    def __init__(self):
        self.above: list[int] = []
        self.last: list[int] = []

    def open(self, above: int) -> int:
        self.above.append(above)
        self.last.append(-1)
        return len(self.above) - 1

    def close(self, number: int) -> None:
        self.last[number] = len(self.above) - 1

    def holds(self, number: int, place: int) -> bool:
        """Whether a place lies in an element or is it; -1 is the page."""
        return number < 0 or number <= place <= self.last[number]

    def sums(self, places: list[int], values: list[int]) -> np.ndarray:
        """For each element the sum of the values whose places lie in it."""
        size = len(self.above)
        own = np.bincount(np.array(places, np.int64) + 1, np.array(values, np.float64), size + 1)[1:]
        total = np.concatenate(([0.0], np.cumsum(own)))
        return total[np.array(self.last, np.int64) + 1] - total[:size]

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        found = list(own)
        for number, above in enumerate(self.above):
            if above >= 0 and found[above]:
                found[number] = True
        return found

    def common(self, low: int, high: int) -> int:
        """The innermost element that holds both places, ``low`` not after ``high``."""
        while high >= 0 and not high <= low:
            high = self.above[high]
        while high >= 0 and not self.holds(high, low):
            high = self.above[high]
        return high

    def below(self, number: int, place: int) -> int:
        """The element directly in ``number`` that holds a place, or ``number`` if the place is there."""
        while place != number and self.above[place] != number:
            place = self.above[place]
        return place


def ending(said: list[str], hints: frozenset[str]) -> tuple[bool, bool]:
    """Whether a name ends in one of the words, not counting words of layout, and whether it is a plain one."""
    end = len(said)
    while end > 1 and said[end - 1] in LAYOUT and said[end - 1] not in hints:
        end -= 1
    return said[end - 1] in hints, end == 1 and said[0] in PLAIN & hints


class LineReader(HTMLParser):
    """Folds parser events into lines. Elements that may hold an article are numbered, and so are those with telling names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tree, self.told_tree = Tree(), Tree()
        self.kinds: list[str] = []
        self.told: list[Told] = []
        self.open: list[tuple[str, int, bool, bool, int, int]] = []  # tag, own number, silent, aside, innermost told and place
        self.at: dict[str, list[int]] = {}  # where the open elements of a tag stand in ``open``
        self.parts: list[str] = []
        self.tags = 0

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _cut(self, size: int) -> None:
        """Close all open elements from place ``size`` on."""
        while len(self.open) > size:
            tag, number, _, _, told, _ = self.open.pop()
            self.at[tag].pop()
            if number >= 0:
                self.tree.close(number)
            if told >= 0 and (self.open[-1][4] if self.open else -1) != told:
                self.told_tree.close(told)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            aside, told, place = self.open[-1][3:] if self.open else (False, -1, -1)
            self.lines.append(Line(text, self.tags, place, aside, bool(self.at.get("h1")), told))
            self.tags = 0

    def _is_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | Told:
        if tag in ("html", "body", "main"):
            return False
        inside = bool(self.at.get("article") or self.at.get("main"))
        if tag in FRAME and not (tag == "header" and inside):
            return True
        hints = IN_ARTICLE if tag == "article" or (inside and tag == "header") else HINTS
        holds = ends = plain = False
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
                return True
            if name in ("class", "id"):
                for token in value.split():
                    said = [x.lower() for x in TOKEN.findall(token)]
                    if said and said[0] not in STATES:
                        if inside or OF_ARTICLE.intersection(said):
                            said = [x for x in said if x != "header"]
                        if hints.intersection(said):
                            last, alone = ending(said, hints)
                            holds, ends, plain = True, ends or last, plain or alone
        if not holds or (inside and (tag in PROSE or not ends)):
            return False
        if inside and (plain or tag == "article"):
            return True
        return Told(tag in PROSE, ends, plain, inside, self.open[-1][5] if self.open else -1)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in SILENT:
            self._end_line()
            if self.open and self.open[-1][0] == "p":  # a block ends an open paragraph
                self._cut(len(self.open) - 1)
        elif tag in ("br", "td", "th", "img", "math", "mtd", "mtr"):
            self.parts.append(" ")
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            place = self._last(ended)
            if place > self._last(within):
                self._cut(place)
        if tag in VOID or (tag in INLINE and tag not in ("td", "th")):
            return
        above = self.open[-1] if self.open else ("", -1, False, False, -1, -1)
        aside, told, place = above[3] or self._is_aside(tag, attrs), above[4], above[5]
        if isinstance(aside, Told):
            self.told.append(aside)
            aside, told = False, self.told_tree.open(told)
        number = -1
        if tag in HOLDERS:
            number = place = self.tree.open(place)
            self.kinds.append(tag)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, above[2] or tag in SILENT, aside, told, place))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE and tag not in ("td", "th"):
            if tag == "math":
                self.parts.append(" ")
            return
        if tag not in INLINE and tag not in SILENT:
            self._end_line()
        if self.at.get(tag):
            self._cut(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of unknown names, and conditional ones, end at the next ``>``, as bogus comments do; the parser would raise or go on reading."""
        if MARKED.match(self.rawdata, i):
            return super().parse_marked_section(i, report)
        end = self.rawdata.find(">", i + 3)
        return end + 1 or -1

    def close(self) -> None:
        super().close()
        self._end_line()
        self._cut(0)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of three ``sigma`` to each side; at the ends the weights are those of the lines that exist."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach:reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the values (logarithms, 2-means from the extremes); values all alike are all above it."""
    logs = np.log1p(values)
    low, high = logs.min(), logs.max()
    if high - low < 0.7:
        return 0.0
    for _ in range(20):
        middle = (low + high) / 2
        upper = logs >= middle
        low, high = logs[~upper].mean(), logs[upper].mean()
    return float(np.expm1((low + high) / 2))


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by an empty line; empty if the page has none."""
    if not html:
        return ""
    html = OPEN_TAG.sub("", html) if html.rfind("<") > html.rfind(">") else html  # a page may end within a tag
    reader = LineReader()
    for at in range(0, len(html), CHUNK):
        reader.feed(html[at:at + CHUNK])
    reader.close()
    return _article(reader)


def _wrappers(reader: LineReader) -> set[int]:
    """Telling elements that say nothing, as they hold all content of the page and no article or main element stands beside them."""
    lines, tree = reader.lines, reader.told_tree
    aside = [x.aside for x in lines]
    if not reader.told or all(aside):
        return set()
    _, content = _content(lines, aside)
    number = tree.common(min(x.told for x in content), max(x.told for x in content))
    around = set()
    while number >= 0:
        around.add(number)
        number = tree.above[number]
    if any(reader.told[k].plain for k in around):
        return set()
    outer = min(around, default=-1)
    story = reader.tree.inherited([kind in ("article", "main") for kind in reader.kinds])
    beside = any(not x.aside and x.place >= 0 and story[x.place] and not tree.holds(outer, x.told) for x in lines)
    return set() if beside else around


def _article(reader: LineReader) -> str:
    lines = reader.lines
    wrappers = _wrappers(reader)

    def apart_but(free: set[int]) -> list[bool]:
        """Lines that are aside, or in a telling element that is not ``free``."""
        if not reader.told:
            return [x.aside for x in lines]
        marked = reader.told_tree.inherited([k not in free for k in range(len(reader.told))])
        return [x.aside or (x.told >= 0 and marked[x.told]) for x in lines]

    apart = apart_but(wrappers)
    if all(apart):
        return ""
    cut, content = _content(lines, apart)
    free = set(wrappers)
    if reader.told:
        own = [x for x in lines if not x.aside]
        texts = reader.told_tree.sums([x.told for x in own], [len(x.text) for x in own])
        tags = reader.told_tree.sums([x.told for x in own], [x.tags for x in own])
        level = cut or np.median([len(x.text) / max(1, x.tags) for x, out in zip(lines, apart) if not out]) / 2
        rich = texts / np.maximum(1, tags) >= level
        free |= {k for k, x in enumerate(reader.told) if x.inside and rich[k]}
        if len(free) > len(wrappers):
            apart = apart_but(free)
            _, content = _content(lines, apart)
    holder, around, kept = _region(reader, content, cut)
    if reader.told:
        before = len(free)
        for k, x in enumerate(reader.told):
            if x.inside or x.plain:
                continue
            if holder >= 0 and reader.tree.holds(holder, x.place) and reader.kinds[holder] not in ("html", "body"):
                if x.prose or rich[k] or not x.ends:
                    free.add(k)
            elif not x.ends and (x.prose or rich[k]) and reader.tree.holds(around, x.place):
                free.add(k)
        apart = apart_but(free)
        if len(free) > before:
            cut, content = _content(lines, apart)
            _, _, kept = _region(reader, content, cut)
    kept = [k for k in kept if not apart[k]]
    if kept and not any(lines[k].heading for k in kept):
        before = [k for k in range(kept[0]) if lines[k].heading and not apart[k]]
        kept = before[-1:] + kept
    return "\n\n".join(lines[k].text for k in kept)


def _content(lines: list[Line], apart: list[bool]) -> tuple[float, list[Line]]:
    """The threshold of the smoothed ratios, and the lines above it; lines that are apart count as empty."""
    smooth = smoothed(np.array([0.0 if out else len(x.text) / max(1, x.tags) for x, out in zip(lines, apart)]))
    cut = threshold(smooth[[not out for out in apart]])
    return cut, [x for x, out, value in zip(lines, apart, smooth) if not out and value >= cut]


def _region(reader: LineReader, content: list[Line], cut: float) -> tuple[int, int, list[int]]:
    """The elements that hold most of the content and all of it (-1: the page), and the places of the article's lines."""
    lines, tree, kinds = reader.lines, reader.tree, reader.kinds
    held = tree.sums([x.place for x in content], [len(x.text) for x in content])
    most = SHARE * sum(len(x.text) for x in content)
    named = [n for n, kind in enumerate(kinds) if kind in ("article", "main") and held[n] >= most]
    if named:
        holder = max(named, key=lambda n: (kinds[n] == "article", n))
    else:  # the innermost element that still holds most of the content
        holder = max((n for n in range(len(held)) if held[n] >= most), default=-1)
    # lines of content by themselves too, not by their neighbours alone
    ends = [x for x in content if len(x.text) >= cut * max(1, x.tags)] or content
    mains = {n for n in named if kinds[n] == "main"}
    articles = [kind == "article" for kind in kinds]
    scope = tree.inherited([n in mains for n in range(len(kinds))] if mains else articles)
    inside = [x for x in ends if x.place >= 0 and scope[x.place]]
    if mains or sum(len(x.text) for x in inside) >= SHARE * sum(len(x.text) for x in ends):
        ends = inside or ends
    stories = [n == holder for n in range(len(kinds))]
    innermost = [n if kind == "article" else -1 for n, kind in enumerate(kinds)]
    for n, above in enumerate(tree.above):
        if innermost[n] < 0 <= above:
            innermost[n] = innermost[above]
    for x in ends:
        if x.place >= 0 and innermost[x.place] >= 0:
            stories[innermost[x.place]] = True
    story = tree.inherited(stories)
    shared = tree.common(min(x.place for x in ends), max(x.place for x in ends))
    first, last = (tree.below(shared, x.place) for x in (ends[0], ends[-1]))
    places = [k for k, x in enumerate(lines) if tree.holds(shared, x.place)]
    begin = next(k for k in places if lines[k] is ends[0] or (first != shared and tree.holds(first, lines[k].place)))
    end = next(k for k in reversed(places) if lines[k] is ends[-1] or (last != shared and tree.holds(last, lines[k].place)))
    between = {k for k in places if begin <= k <= end}
    kept = [k for k, x in enumerate(lines) if holder < 0 or k in between or (x.place >= 0 and story[x.place])]
    return holder, shared, kept


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; null and empty pages, and pages without an article, have an empty text.

    Repeated rows and null ids are read like any other, an empty table gives no rows, further columns are not read, whatever their
    names, and a very long page takes time and memory in proportion to its length.
    """
    rows = spread(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
