"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block of text. A line weighs the letters that are not in links; in an article it
weighs more, in menus, forms, reader comments and the like nothing. Weights are summed over a sliding window of lines. Where
the sum rises from nothing and surges the main text begins, where it dives to nothing it ends, and what lies between is kept,
however short. A section that surged in one place is main text in others too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, prepare

#: Lines of the sliding window; the sum that is a surge, if it is also this share of the page's largest sum.
WINDOW, SURGE, LEAST_SHARE = 3, 80, 0.15
#: What a letter in an article or main element weighs.
ARTICLE_WEIGHT = 8
#: Share of a line's letters that may be in links.
MOST_LINKED = 0.5

# Fixed values of HTML: elements that make blocks, whose content is no page text, and that hold page furniture.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head title svg math canvas object audio video map select button datalist".split())
_FURNITURE = frozenset("nav aside footer form menu dialog fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd", "title"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol li dl dt dd menu".split())
_CONTAINERS = frozenset("div section td th center details".split())
_ROLES = frozenset("navigation complementary contentinfo banner search alert dialog menu menubar toolbar tooltip".split())

#: Words of class and id that mark furniture, and words that may stand beside them; a name with any other word marks nothing.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent"
    " cookie cookies copyright disclaimer disqus dropdown footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice"
    " notices notification notifications outbrain overlay pager pagination paywall popup promo promos promoted promotion recommended related replies reply"
    " respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar tooltip topbar widget widgets".split()
)
_BESIDE = frozenset(
    "area article articles bar blog block body bottom box button buttons col container content entry fixed form global group holder home inner item items left"
    " link links list main mini more news outer page panel post posts primary reader right row secondary section site slot small sticky story text the top"
    " unit user wrap wrapper".split()
)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Line:
    """A block's text with its weight; `section` is the article, main element or container that it stands in (0: the page)."""

    text: str
    weight: int
    section: int = 0
    article: bool = False


@lru_cache(4096)
def _marks(name: str) -> bool:
    """Whether a class or id is made of furniture's words alone, as `cookie-notice` is and `search-results` is not."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    return any(w in _MARKS for w in words) and all(w in _MARKS or w in _BESIDE for w in words)


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _FURNITURE:
        return True
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and any(_marks(x) and not (inside and x.lower() == "header") for x in value.split()):
            return True
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, ""), ("<", tag, attributes) and ("/", tag, "") in page order; a tag or comment that the page cuts off is dropped."""
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            yield "", page[at:], ""
            return
        if begin > at:
            yield "", page[at:begin], ""
        following = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
        elif following in ("!", "?"):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
        elif following.isalpha() or following == "/" and page[begin + 2 : begin + 3].isalpha():
            if tag := _TAG.match(page, begin):
                at, name, attributes = tag.end(), tag[2].lower(), tag[3]
            else:
                end = page.find(">", begin)
                if end < 0:
                    return
                at, attributes = end + 1, ""
                name = re.match(r"[a-zA-Z0-9:-]*", page[begin + 1 + (following == "/") : begin + 32])[0].lower()
            if following == "/":
                yield "/", name, ""
            elif name in _RAW:
                found = _RAW_END[name].search(page, at)
                end = page.find(">", found.end()) if found else -1
                if end < 0:
                    return  # the rest of the page is in it
                at = end + 1
            else:
                yield "<", name, attributes
        else:
            yield "", "<", ""
            at = begin + 1


class _Open:
    """The open elements, with the ends that HTML implies."""

    def __init__(self) -> None:
        self.stack: list[list] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, entry: list) -> None:
        self.stack.append([tag, *entry])
        self.count[tag] = self.count.get(tag, 0) + 1

    def implied(self, tag: str) -> list[str]:
        """What a start tag ends before it."""
        found = ["p"] if tag in _ENDS_P and self.count.get("p") else []
        return found + ([tag] if tag in ("p", "li", "option") and self.count.get(tag) and tag not in found else [])

    def end(self, tag: str) -> Iterator[list]:
        if self.count.get(tag):
            while self.stack:
                entry = self.stack.pop()
                self.count[entry[0]] -= 1
                yield entry
                if entry[0] == tag:
                    return


def _closed(events: list[tuple[str, str, str]]) -> set[int]:
    """Numbers of the start tags that have an end tag of their own."""
    found, opened = set(), _Open()
    for k, (kind, tag, _) in enumerate(events):
        if not kind or tag not in _BLOCKS and tag not in _HIDDEN and not opened.count.get(tag) and kind == "/":
            continue
        if kind == "<":
            if tag in _VOID:
                continue
            for name in opened.implied(tag) if tag in _BLOCKS else ():
                for _ in opened.end(name):
                    pass
            opened.push(tag, [k])
        else:
            for name, number in opened.end(tag):
                if name == tag:
                    found.add(number)
    return found


class _Stripper:
    """Lines of a page. `None` among them is a break: an article or main element begins or ends there."""

    def __init__(self) -> None:
        self.lines: list[Line | None] = []
        self.text: list[str] = []
        self.linked = 0
        self.open = _Open()  # entries: tag, hides ("" or why), article, its number as a section, hiding elements around, header
        self.hidden = self.whole = self.article = self.link = self.header = self.heading = self.sections = 0
        self.section = [0]
        self.bounded: dict[str, list[list]] = {"open": [], "list": []}  # open entries that hide only up to what comes next

    def put(self, text: str) -> None:
        if self.hidden or self.header and not self.heading:
            return
        text = entities.unescape(text)
        self.text.append(text)
        if self.link:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                weight = len(text) if self.linked <= MOST_LINKED * len(text) else 0
                self.lines.append(Line(text, weight * (ARTICLE_WEIGHT if self.article else 1), self.section[-1], self.article > 0))
            self.text, self.linked = [], 0

    def _furniture_line(self) -> None:
        """Furniture stands in the lines as one of no weight and no text."""
        if self.lines and (self.lines[-1] is None or self.lines[-1].text):
            self.lines.append(Line("", 0))

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in _BLOCKS:
            self.flush()
            for name in self.open.implied(tag):
                self.end(name)
        if tag in _VOID:
            return
        if tag == "a":
            self.link = 1
        article = tag in ("article", "main")
        self._bound(tag, article)
        inside = self.article > 0
        # an article's own header keeps its headings; the page's header goes whole
        hides = ""
        if tag in _HIDDEN:
            hides = "whole"
        elif tag not in ("html", "body") and not article and (_is_furniture(tag, attributes, inside) or tag == "header" and not inside):
            hides = ("form" if tag in ("form", "fieldset", "div", "section") else "whole") if closed else "list" if tag not in ("footer", "aside", "form", "dialog", "fieldset") else "open"
        if tag in _BLOCKS or hides:
            self.flush()
            if hides:
                self._furniture_line()
            around = self.hidden
            if article:
                self.lines.append(None)
                if not self.whole:
                    self.hidden = 0  # what is wrapped around the main text hides nothing of it
            is_header = tag == "header" and inside and closed
            self.open.push(tag, [hides, article, around, is_header])
            self.hidden += bool(hides)
            self.whole += hides == "whole"
            if hides in self.bounded:
                self.bounded[hides].append(self.open.stack[-1])
            self.article += article
            self.header += is_header
            self.heading += tag in _HEADINGS
            if article or tag in _CONTAINERS and not self.article:
                self.sections += 1
                self.section.append(self.sections)
            else:
                self.section.append(self.section[-1])

    def _bound(self, tag: str, article: bool) -> None:
        """Where furniture without an end tag stops to hide: at an article or a page's heading, and menus at what is no list."""
        for kind, stops in (("open", article or tag == "h1"), ("list", article or tag in _BLOCKS and tag not in _LISTS)):
            if stops and self.bounded[kind]:
                for e in self.bounded[kind]:
                    self.hidden -= e[1] == kind
                    e[1] = ""
                self.bounded[kind] = []

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in _BLOCKS:
            self.flush()
        for entry in self.open.end(tag):
            name, hides, article, around, is_header = entry
            entry[1] = ""
            self.section.pop()
            self.whole -= hides == "whole"
            self.hidden = around if article else self.hidden - bool(hides)
            self.article -= article
            self.header -= is_header
            self.heading -= name in _HEADINGS
            if article:
                self.lines.append(None)


def page_lines(page: str) -> list[Line | None]:
    """Lines of text with breaks."""
    events = list(_events(page))
    closed, out = _closed(events), _Stripper()
    for k, (kind, value, attributes) in enumerate(events):
        if not kind:
            out.put(value)
        elif kind == "<":
            out.start(value, attributes, k in closed)
        else:
            out.end(value)
    out.flush()
    return out.lines


def main_lines(lines: list[Line | None], window: int = WINDOW, surge: int = SURGE, share: float = LEAST_SHARE) -> list[str]:
    """The lines between surges and dives of the windowed sums.

    A run of lines whose sums are not zero is main text if one of them reaches `surge` and `share` of the largest; if none
    reaches `surge`, the largest does. A break parts runs. Runs keep their lines from the first with weight to the last.
    Of an article or main element with a line in main text every line is kept, of another container those with weight.
    """
    weights: list[int] = []
    owners: list[Line | None] = []
    for x in lines:
        weights += [0] * window if x is None else [x.weight]
        owners += [None] * window if x is None else [x]
    size = len(weights)
    total = [0] * (size + 1)
    for k, w in enumerate(weights):
        total[k + 1] = total[k] + w
    sums = [total[min(size, k + window)] - total[k] for k in range(size)]
    peak = max(sums, default=0)
    if not peak:
        return []
    least = max(min(surge, peak), share * peak)
    kept, sections = [False] * size, set()
    k = 0
    while k < size:
        if not sums[k]:
            k += 1
            continue
        end = k  # from here to the dive
        while end < size and sums[end]:
            end += 1
        if max(sums[k:end]) >= least:
            first, last = k, min(size, end + window) - 1
            while not weights[first]:
                first += 1
            while not weights[last]:
                last -= 1
            for i in range(first, last + 1):
                kept[i] = True
                if weights[i]:
                    sections.add(owners[i].section)
        k = end
    sections.discard(0)
    return [x.text for x, keep in zip(owners, kept, strict=True) if x is not None and x.text and (keep or x.section in sections and (x.article or x.weight))]


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by an empty line; empty for null, empty and textless pages."""
    return "\n\n".join(main_lines(page_lines(page))) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id column, url column, text, n_chars: its code points) for each row.

    Null, empty and textless pages give an empty text. An element that is not closed ends with its parent; furniture that is
    not closed hides no article or page heading after it, and a menu only lists. Work is linear in a page's length for a
    bounded depth of elements. Repeated rows and ids each get a row, an empty table an empty result; other columns are
    ignored, whatever their names.
    """
    prepare(pages.sparkSession)
    rows = pages.select(column(id_col).cast("long").alias("id"), column(url_col).cast("string").alias("url"), column(html_col).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    out = rows.mapInArrow(extract, "id long, url string, text string, n_chars long")
    return out.select(out["id"].alias(id_col), out["url"].alias(url_col), "text", "n_chars")
