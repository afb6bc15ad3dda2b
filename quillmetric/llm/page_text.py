"""Main text of web pages by text-to-tag ratios.

Events of the standard library's streaming parser become lines: one per block of text, with the tags met on the way and the element
it stands in. A line's ratio is its text outside links by its tags; ratios are smoothed by a Gaussian over neighbouring lines, and a
threshold (one standard deviation of the smoothed ratios) separates the cluster of content lines from the rest. The content lines choose the content
region: the article element, the main element or the deepest element that holds most of their text. All lines of the region are
kept, however short, but for elements that are no article text wherever they stand: navigation, footers, asides, forms, scripts,
adverts, notices, comments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmetric.llm.work import slices

SIGMA = 1.5
REGION_SHARE = 0.75
LINK_SHARE = 0.6
FEED_CHARS = 1 << 16
OUT = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav noscript ol optgroup option p plaintext pre search "
    "section select summary table tbody td template textarea tfoot th thead title tr ul xmp".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label menu meter nav noembed "
    "noframes noscript object optgroup option output progress script search select style svg template textarea title video".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: words of a class or id that name something other than the article
NEVER_WORDS = frozenset(
    "ad ads adbox adslot adunit advert advertisement advertising adverts adsense sponsor sponsored sponsors promo promos promoted promotion banner "
    "cookie cookies consent gdpr notice notices notification notifications disclaimer newsletter subscribe subscription signup paywall popup modal overlay "
    "menu menus nav navbar navi navigation breadcrumb breadcrumbs crumbs sidebar sidebars sidenav widget widgets footer footnav masthead topbar toolbar "
    "comment comments commentlist respond reply replies disqus discussion guestbook share sharing shares social related "
    "recommended recommendations pagination pager login form search skip".split())
HEADER_WORDS = frozenset(["header", "topnav"])
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# elements whose open element of the same kind ends when another one starts, up to an element that shields it
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
NO_PARAGRAPH_INSIDE = BLOCKS - {"body", "caption", "head", "html", "legend", "noscript", "optgroup", "option", "select", "td", "template", "textarea",
                                "th", "title", "tr", "tbody", "tfoot", "thead"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SCOPES = frozenset("article aside blockquote body div footer form header html main nav section table td th".split())


class Element:
    __slots__ = ("tag", "parent", "depth", "never", "named", "chars", "link_chars", "article", "heading", "within")

    def __init__(self, tag: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.never = parent is not None and parent.never  # no article text here, nor in anything inside
        self.within = parent is not None and parent.within  # in an article element
        self.named = self.heading = False
        self.article = ""
        self.chars = self.link_chars = 0

    def up(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


def words_of(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


class Line:
    __slots__ = ("text", "element", "tags", "link_chars")

    def __init__(self, text: str, element: Element, tags: int, link_chars: int) -> None:
        self.text, self.element, self.tags, self.link_chars = text, element, tags, link_chars


class Lines(HTMLParser):
    """The lines of a page with text, and the elements they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", None)
        self.lines: list[Line] = []
        self._parts: list[str] = []
        self._tags = self._link_chars = self._links = 0
        self._head: Element | None = None

    def _end_line(self) -> None:
        if not self._parts:
            return
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append(Line(text, self.at, self._tags, min(self._link_chars, len(text))))
            self._tags = 0
        self._parts, self._link_chars = [], 0

    def _close(self, element: Element) -> None:
        """End an element and all that are open inside it."""
        while self.at is not element.parent:
            if self.at.tag in BLOCKS:
                self._end_line()
            if self.at.tag == "a":
                self._links -= 1
            if self.at is self._head:
                self._head = None
            self.at = self.at.parent

    def _open_one(self, tags: set[str], until: set[str] | frozenset[str]) -> Element | None:
        for element in self.at.up():
            if element.tag in tags:
                return element
            if element.tag in until:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in CLOSED_BY:
            tags, until = CLOSED_BY[tag]
            while (ended := self._open_one(tags, until)) is not None:
                self._close(ended)
        if self._head is not None and tag not in IN_HEAD:
            self._close(self._head)
        if tag in NO_PARAGRAPH_INSIDE and (ended := self._open_one({"p"}, SCOPES)) is not None:
            self._close(ended)
        if tag in BLOCKS:
            self._end_line()
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                self._parts.append("" if tag == "wbr" else " ")
            return
        element = Element(tag, self.at)
        if not element.never:
            self._name(element, {k: v or "" for k, v in attrs})
        self.at = element
        if tag == "a":
            self._links += 1
        elif tag == "head":
            self._head = element
        elif tag in ("td", "th"):
            self._parts.append(" ")

    def _name(self, element: Element, attrs: dict[str, str]) -> None:
        """What tag and attributes tell of an element."""
        tag, within = element.tag, element.within
        element.heading = tag == "h1"
        element.article = tag if tag in ("article", "main") else ""
        element.never = tag in NEVER or (tag == "header" and not within)
        if attrs:
            role = attrs.get("role", "").lower()
            if role in ("article", "main"):
                element.article = role
            elif "articlebody" in attrs.get("itemprop", "").lower():
                element.article = "article"
            named = words_of(f"{attrs.get('class', '')} {attrs.get('id', '')}")
            comment = bool({"comment", "comments", "commentlist"} & named) if tag != "article" else "comment" in named
            comment = comment or "comment" in words_of(f"{attrs.get('itemprop', '')} {attrs.get('itemtype', '')}")
            element.never |= (role in NEVER_ROLES or "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style", "")))
                              or (comment and tag not in ("html", "body", "main")))
            if tag not in ("html", "body", "main", "article"):
                element.named = bool(named & NEVER_WORDS) or (not within and bool(named & HEADER_WORDS))
        element.within |= bool(element.article)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # outside of SVG and MathML, a slash does not close an element
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(e.tag in ("svg", "math") for e in self.at.up()):
            self._close(self.at)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
        ended = self._open_one({tag}, SCOPES - {tag} if tag not in SCOPES and tag not in ("ul", "ol", "dl") else frozenset())
        if ended is not None:
            self._close(ended)
        elif tag in BLOCKS:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if self.at.never:
            return
        self._parts.append(data)
        if self._links:
            self._link_chars += len(data)

    def finished(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian means over neighbouring lines, three deviations to both sides; weights beyond the ends are left out."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    found = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        near = weights[low - i + reach:high - i + reach]
        found.append(sum(w * v for w, v in zip(near, values[low:high])) / sum(near))
    return found


def content_lines(lines: list[Line]) -> list[bool]:
    """Whether each line belongs to the cluster of high smoothed text-to-tag ratios."""
    ratios = smoothed([(len(x.text) - x.link_chars) / max(1, x.tags) for x in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    least = min(deviation, max(ratios))
    return [r >= least and len(x.text) > x.link_chars for r, x in zip(ratios, lines)]


def main_text(html: str) -> str:
    """The article's blocks, joined by line feeds; empty if there are none.

    White space in a block, line breaks included, is one blank. Cells and list items are blocks.
    """
    parser = Lines()
    for start in range(0, len(html), FEED_CHARS):
        parser.feed(html[start:start + FEED_CHARS])
    lines = _article_candidates(parser.finished())
    if not lines:
        return ""
    for line in lines:
        for element in line.element.up():
            element.chars += len(line.text)
            element.link_chars += line.link_chars
    content = content_lines(lines)
    region = _region(lines, content)
    inside = [(x, c) for x, c in zip(lines, content) if any(e is region for e in x.element.up())]
    if not region.article:
        inside = _between_content([(x, c) for x, c in inside if not _is_menu(x, region)])
        inside = _title_above(lines, inside) + inside
    return "\n".join(x.text for x, _ in inside)


def _article_candidates(lines: list[Line]) -> list[Line]:
    """Lines outside elements that never are article text. A class or id does not count on an element around an article or the top heading."""
    around = {id(e) for x in lines for own in x.element.up() if own.article or own.heading for e in own.up() if e is not own}
    return [x for x in lines if not any(e.named and id(e) not in around for e in x.element.up())]


def _region(lines: list[Line], content: list[bool]) -> Element:
    """The element that the content lines choose."""
    weights: dict[int, int] = {}
    elements: dict[int, Element] = {}
    for line, chosen in zip(lines, content):
        for element in line.element.up():
            elements[id(element)] = element
            weights[id(element)] = weights.get(id(element), 0) + (len(line.text) if chosen else 0)
    total = max(weights.values())
    for kind in ("article", "main"):
        named = [e for e in elements.values() if e.article == kind]
        outer = [e for e in named if not any(o.article == kind for o in e.up() if o is not e)]
        best = max(outer, key=lambda e: (weights[id(e)], e.chars), default=None)
        if best is not None and (len(outer) == 1 or 2 * weights[id(best)] >= total):
            return best
    deep = [e for e in elements.values() if e.tag in BLOCKS - {"p", "li"} or e.parent is None]
    return max((e for e in deep if weights[id(e)] >= max(1, REGION_SHARE * total)), key=lambda e: e.depth, default=next(e for e in deep if e.parent is None))


def _between_content(lines: list[tuple[Line, bool]]) -> list[tuple[Line, bool]]:
    """The lines from the first content line, with the headings right above it, to the last; all, if none is content."""
    chosen = [i for i, (_, c) in enumerate(lines) if c]
    if not chosen:
        return lines
    first = chosen[0]
    while first and any(e.tag in HEADINGS for e in lines[first - 1][0].element.up()):
        first -= 1
    return lines[first:chosen[-1] + 1]


def _title_above(lines: list[Line], inside: list[tuple[Line, bool]]) -> list[tuple[Line, bool]]:
    """The last top heading above the region, if the region has none."""
    if not inside or any(_in_top_heading(x) for x, _ in inside):
        return []
    above = lines[:next(i for i, x in enumerate(lines) if x is inside[0][0])]
    return [(x, False) for x in above if _in_top_heading(x)][-1:]


def _in_top_heading(line: Line) -> bool:
    return any(e.heading for e in line.element.up())


def _is_menu(line: Line, region: Element) -> bool:
    """Whether a line stands in a list or block of the region that is mostly links."""
    for element in line.element.up():
        if element is region:
            return False
        if element.tag in BLOCKS and element.tag not in ("p", "li") and element.link_chars >= LINK_SHARE * element.chars:
            return True
    return False


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text, as does html without article text. Rows keep their place and are treated one by one, so
    repeated rows and null ids or urls stay; other columns are ignored; no rows give no rows. Whole pages are parsed, of any length.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, OUT)
