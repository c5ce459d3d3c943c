"""Main text of web pages by line-block distribution.

A page becomes a list of lines, one for each block element's text, without scripts, styles, forms, comments and other parts that
never hold an article; where such a part, or one marked as a menu, advert, notice or the like, has been left out, blank lines stand, so
it separates what is before it from what is behind it, unless both belong to the same element: an advert amid an article doesn't end it. Text inside links doesn't count towards a line's length. The lengths
are summed over sliding windows of WINDOW lines: a surge is a window of SURGE code points or more behind an empty line, a dive is where
all lines of a window are empty. The text between surges and dives is kept, and so is a short block right in an element that holds
such text. Where there are article or main elements, only their lines count, and each of them stands or falls as a whole: it is kept if there is a surge within it, so a
card that holds a linked headline alone is none.

A page may be short: if no window reaches SURGE, the largest window there is, of an article or else of paragraphs, is surge enough.

A name may tell how or where an element stands and not what it holds ("content-header-fixed", "widget"). If parts with such names hold
more than what is left without them, they are no side parts, and their text is read too. If nothing at all is left, names count only where they say
what an element is and nothing else ("comments", but not "comments-layout").

Markup is read in one pass, in time that grows with the page's length however malformed it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_columns, in_batches, slices

WINDOW, SURGE = 3, 40
#: Content up to the end tag (or the page's end) is no text at all.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/><\"']{0,63})")
SPECIAL = re.compile("[>\"']")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("nav footer aside header form menu dialog head title button select option fieldset label input".split())
#: Elements that tell what belongs together.
AROUND = frozenset("article blockquote body center dd div fieldset main section table td".split())
#: Elements whose end tag may be missing, and elements whose end ends them.
UNCLOSED = frozenset("p li dt dd tr td th".split())
ENDS = frozenset("article body div dl main ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MARKED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side-bar sidenav aside menu nav navbar navigation topnav breadcrumb breadcrumbs crumbs header masthead footer foot bottom cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond discussion widget pagination pager toolbar search copyright legal disclaimer toc contentinfo complementary".split()
)
#: Words that turn a compound name into a state of what surrounds such a part ("has-sidebar").
STATES = frozenset("closed disabled enabled has is layout no open with without".split())
#: Names, and words of compound names, that may stand on an element around an article.
LOOSE = frozenset("modal overlay popup widget".split())
LOOSE_PARTS = LOOSE | frozenset("banner bottom foot footer header masthead menu nav navbar sidebar toolbar".split())
#: Elements whose text is prose, however short.
PROSE = frozenset("p pre blockquote".split())
SPLIT = re.compile(r"[\s_]+")
PARTS = re.compile(r"-+|(?<=[a-z])(?=[A-Z])")


def unwanted(attributes: str, names: str = "all") -> bool:
    """True if a class, id, role or label names a part that is no article. names: "all", "firm" (not those that tell only a place or look) or "exact" (whole firm names only)."""
    for m in MARKED.finditer(attributes):
        for name in SPLIT.split(m[1] or m[2] or m[3] or ""):
            parts = {p.lower() for p in PARTS.split(name)}
            exact = name.lower() in NAMES
            if exact or parts & NAMES and not parts & STATES:
                if names == "all" or (name.lower() not in LOOSE if exact else names == "firm" and not parts & NAMES <= LOOSE_PARTS):
                    return True
    return False


class Tags:
    """The tags of a page in order, each found in time that doesn't depend on what is wrong elsewhere."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.gap = (0, -1)  # between these places nothing special stands
        self.next_end = -1
        self.dead: set[int] = set()  # special characters from which no tag's end is found outside quotes

    def _special(self, at: int) -> int:
        if not self.gap[0] <= at <= self.gap[1]:
            m = SPECIAL.search(self.page, at)
            self.gap = (at, m.start() if m else len(self.page))
        return self.gap[1]

    def _end(self, at: int) -> int:
        """The > that ends a tag: the first outside quotes, or the first of all if quotes don't close; -1 if there is none."""
        page, start, passed = self.page, at, []
        while True:
            at = self._special(at)
            if at == len(page) or at in self.dead:
                break
            if page[at] == ">":
                return at
            passed.append(at)
            if at >= self.last[page[at]]:
                break
            at = page.find(page[at], at + 1) + 1
        # Whoever comes by one of these places later on need not look again.
        self.dead.update(passed)
        return self._first_end(start)

    def _first_end(self, at: int) -> int:
        if at > self.last[">"]:
            return -1
        if self.next_end < at:
            self.next_end = self.page.find(">", at)
        return self.next_end

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, closing, name, attributes); what is no text has no name."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                yield start, at, False, "", ""
                continue
            if page[at : at + 1] in ("!", "?"):
                end = self._first_end(at)
                if end >= 0:
                    at = end + 1
                    yield start, at, False, "", ""
                continue
            m = NAME.match(page, at)
            if not m:
                continue
            end = self._end(m.end())
            if end < 0:
                continue
            at, name = end + 1, m[2].lower()
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                yield start, at, False, "", ""
            else:
                yield start, at, bool(m[1]), name, page[m.end() : end]


class Line:
    """A block's text, its code points outside links, the element right around it, the article or main element that holds it (0: none), and whether it is prose by its element."""

    __slots__ = ("text", "size", "element", "article", "prose")

    def __init__(self, text: str, size: int, element: int, article: int, prose: bool = False) -> None:
        self.text, self.size, self.element, self.article, self.prose = text, size, element, article, prose


def lines(page: str, names: str = "all") -> tuple[list[Line], list[int]]:
    """The lines of a page, blank ones where a part is left out, and the number of the element around each element (0: none).

    Parts are left out by their element, and by their names too, as ``unwanted`` has it.
    """
    out: list[Line] = []
    around: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    parent = [0]
    articles: list[int] = []
    text: list[str] = []
    linked = at = 0
    in_link = False
    block, skip, depth = "", "", 0

    def end() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                own = around[-1][1] if around else 0
                if out and not out[-1].text:
                    last = next((i for i in range(len(out) - 1, -1, -1) if out[i].text), None)
                    if last is not None and out[last].element == own:
                        del out[last + 1 :]
                out.append(Line(line, max(0, len(line) - linked), own, articles[0] if articles else 0, block in PROSE))
            text.clear()
        linked = 0

    for start, stop, close, name, attributes in Tags(page):
        if start > at and not skip:
            piece = page[at:start]
            text.append(piece)
            if in_link:
                linked += len(" ".join(html.unescape(piece).split()))
        at = stop
        if not name:
            if not skip:
                text.append(" ")
            continue
        if skip:
            if name in ("article", "main") and not close and skip not in ("article", "main") and not unwanted(attributes):
                skip = ""  # a part that was never closed can't hold the article
            elif skip in UNCLOSED and (name in ENDS if close else name == skip or name in BLOCKS and skip == "p"):
                skip = ""  # its end tag may be missing
            elif name == skip:
                depth += -1 if close else 1
                if not depth:
                    skip = ""
                continue
            else:
                continue
        if name in BLOCKS:
            end()
            block = "" if close else name
        elif name == "br" or name in ("td", "th"):
            text.append(" ")
        if not close and name not in VOID and (name in LEFT_OUT or (name not in ("body", "html", "main") and attributes and unwanted(attributes, names))):
            end()
            out += [Line("", 0, -1, articles[0] if articles else 0)] * WINDOW
            if not attributes.rstrip().endswith("/"):
                skip, depth = name, 1
            continue
        if name in AROUND:
            if not close:
                parent.append(around[-1][1] if around else 0)
                around.append((name, len(parent) - 1))
                open_[name] = open_.get(name, 0) + 1
                if name in ("article", "main"):
                    articles.append(len(parent) - 1)
            elif open_.get(name):
                while True:
                    ended, number = around.pop()
                    open_[ended] -= 1
                    if articles and articles[-1] == number:
                        articles.pop()
                    if ended == name:
                        break
        elif name == "a":
            in_link = not close
    if not skip:
        text.append(page[at:])
    end()
    return out, parent


def main_text(page: str) -> str:
    found, parent = lines(page)
    text = between(found, parent)
    if not any(x.article and x.text for x in found):
        more = between(*lines(page, "firm"))
        if len(more) > 2 * len(text):
            text = more
    return text or between(*lines(page, "exact"))


def windows(size: list[int]) -> list[int]:
    """The sum of the WINDOW lines from each line on."""
    return [sum(size[i : i + WINDOW]) for i in range(len(size))]


def surged(size: list[int], surge: int) -> list[bool]:
    """Which lines lie between a surge and the dive behind it."""
    window, kept, on = windows(size), [], False
    for n, w in zip(size, window):
        on = w > 0 if on else n > 0 and w >= surge
        kept.append(on)
    return kept


def between(found: list[Line], parent: list[int]) -> str:
    """The text between surges and dives, and what belongs to it: the rest of the article element, or short blocks right in an element that holds some of it."""
    if any(x.article and x.text for x in found):
        return _articles(found)
    size = [x.size for x in found]
    surge = SURGE
    if max(windows(size), default=0) < SURGE:
        surge = max(windows([n if x.prose else 0 for n, x in zip(size, found)]), default=0) or SURGE
    kept = surged(size, surge)
    holds: set[int] = set()
    for own in (x.element for x, k in zip(found, kept) if k and x.text):
        while own not in holds:
            holds.add(own)
            own = parent[own]
    return "\n\n".join(x.text for x, k in zip(found, kept) if x.text and (k or x.size and x.element in holds))


def _articles(found: list[Line]) -> str:
    """The text of each article or main element with a surge in it."""
    held: dict[int, list[Line]] = {}
    for x in found:
        if x.article:
            held.setdefault(x.article, []).append(x)
    size = {a: [x.size for x in own] for a, own in held.items()}
    if not any(map(any, size.values())):
        size = {a: [len(x.text) for x in own] for a, own in held.items()}  # an article that is one link
    surge = min(SURGE, max(max(windows(n)) for n in size.values()))
    return "\n\n".join(x.text for a, own in held.items() if any(surged(size[a], surge)) for x in own if x.text)


def _extract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = pa.array([main_text(x) for x in pc.fill_null(part.column("html"), "").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts, pc.utf8_length(texts).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, or one without an article, has an empty text. Repeated rows and null ids are rows like others; pages
    cut off in the middle of an element keep what they have. An empty table gives an empty result.
    """
    has_columns(pages, "page_id", "url", "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(in_batches, _extract_all, "page_id long, url string, text string, n_chars long")
