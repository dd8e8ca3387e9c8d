"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped to *lines*: the text between block-level tags, with white space collapsed and
character references decoded. What never belongs to an article (scripts, styles, forms, and
elements that their name, role, class or id marks as menu, header, footer, sidebar, notice, advert
or reader comments) leaves blank lines, unless it holds the page's article or main element or most
of its text. A line's weight is its text outside links. Weights are
summed over a sliding window of lines; the text begins where the sum surges over a threshold and
ends where it dives to nothing; the heaviest such stretch has the peak.

The stretches are the main text: those of the article or main element around the peak, where there
is one, else all of the page. Blank lines that dropped blocks left do not part them. What lies
between the first surge and the last dive of one article or main element is text too. Tags widen a
stretch by the lines next to it alone: of the same element, lines of text, and up to WINDOW - 1
lines of links. Where no article or main element is, stretches are widened to the ends of the
containers that hold them and by the lines of the same parents.

Tags are scanned once from left to right; elements are numbered in page order, with their parents,
so that pages of any size and depth take time in proportion. A tag whose quotes never close ends
at its first ">", and so do the tags behind it.

Defined cases: null or empty html gives an empty text; a page without a stretch gives its heaviest
line's text and what its parent holds beside it, or an empty one; unclosed and stray tags are tolerated; every page is read whole;
repeated rows come back once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Lines in a window, and the least sum of a surge.
WINDOW, LEAST_SURGE = 3, 40
#: Stretches of at least this share of the heaviest one have all between them kept too.
SIDE_SHARE = 0.5

# Elements by what they do to a text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Of the raw ones, those whose content is never markup: unclosed, they last to the page's end.
UNPARSED = set("script style iframe textarea title noscript".split())
RAW = set("script style noscript template svg math iframe object canvas textarea title select head".split())
NEVER = set("nav aside footer form button dialog menu fieldset datalist audio video map".split())
MAIN = {"article", "main"}
CONTAINERS = MAIN | {"div", "section", "td", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IMPLIED_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
# Words in class and id, and roles, that mark what is not article text.
MARKS = set(
    """ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo
    promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar
    comment comments commentlist disqus replies reply respond notice notices alert cookie cookies consent gdpr
    disclaimer banner popup modal overlay newsletter subscribe subscription signup signin login register search
    share sharing social related recommended recommendations widget widgets toolbar pagination pager paging
    copyright""".split()
)
#: Of the marks, those that stand for wrappers too: an element so marked (or a form) with most of the
#: page's text is kept. Other marked elements are kept only where nothing else could be the text.
WRAPPERS = set("form fieldset sidebar sidebars search register login signin signup share sharing social related recommended recommendations widget widgets toolbar masthead topbar banner overlay notice notices alert promo promos subscribe subscription respond".split())
COMMENTS = set("comment comments commentlist disqus reply replies respond".split())
ADS = set("ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion".split())
#: A class or id is a mark where nothing but these stands before and behind its marking words.
BEFORE = set("site page main global primary secondary top bottom left right upper lower header foot post article entry blog user google text sticky fixed floating mobile desktop js the".split())
BEHIND = set("box block area section container wrapper wrap inner outer list item items bar panel link links post posts article articles story stories news form field row column col group holder unit slot zone title label button buttons btn icon icons body top bottom left right primary secondary main count thread x".split())
HEADER_MARKS = {"header", "pageheader", "siteheader"}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))|([^\s=/\"'>]+)")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+|\d+")


@dataclass
class Line:
    text: str
    weight: int
    inside: int  # number of the innermost container that it is in, or -1


@dataclass
class Containers:
    """Elements that hold lines, numbered as they open: the container around each, the last one
    that is inside it, and which are article or main elements."""

    around: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    mains: set[int] = field(default_factory=set)

    def holds(self, number: int, other: int) -> bool:
        return number < 0 or number <= other <= self.last[number]

    def chain(self, number: int) -> Iterator[int]:
        """The container and those around it, innermost first."""
        while number >= 0:
            yield number
            number = self.around[number]


@dataclass
class Tag:
    start: int
    end: int
    name: str = ""  # empty for comments and declarations
    closing: bool = False
    source: str = ""


class Scanner:
    """Finds tags from left to right. What a search to the page's end did not find is not searched
    for again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.absent: set[str] = set()
        self.loose = False

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.absent else self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Behind the tag that goes on at ``at``; -1 if it never ends."""
        first = self.find(">", at)
        if first < 0 or self.loose:
            return first + 1 if first >= 0 else -1
        k = at
        while True:
            k = _PLAIN.match(self.page, k).end()
            if k >= len(self.page):
                break
            if self.page[k] == ">":
                return k + 1
            if (k := self.find(self.page[k], k + 1)) < 0:
                break
            k += 1
        self.loose = True
        return first + 1

    def next(self, at: int) -> Tag | None:
        while (start := self.find("<", at)) >= 0:
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if self.page.startswith(opening, start):
                    end = self.find(closing, start + len(opening))
                    return Tag(start, len(self.page) if end < 0 else end + len(closing))
            if self.page[start + 1 : start + 2] in ("!", "?"):
                if (end := self.find(">", start)) >= 0:
                    return Tag(start, end + 1)
            elif m := _NAME.match(self.page, start):
                if (end := self.tag_end(m.end())) >= 0:
                    return Tag(start, end, m[1].lower(), self.page[start + 1] == "/", self.page[m.end() : end - 1])
            at = start + 1
        return None


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(source):
        found.setdefault((name or bare).lower(), html.unescape(a or b or c))
    return found


def marks_of(names: str) -> set[str]:
    """The marks that whole names of a class or id stand for: 'main-nav', not 'no-nav'."""
    found: set[str] = set()
    for token in names.split():
        words = [w for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if not w.isdigit()]
        at = [k for k, w in enumerate(words) if w in MARKS or w in HEADER_MARKS]
        if at and set(words[: at[0]]) <= BEFORE and all(w in BEHIND or w in MARKS for w in words[at[0] + 1 :]):
            found.update(words[k] for k in at)
    return found


def marked(name: str, source: str, in_main: bool) -> str:
    """What an element is: '' for text, 'head' (only headings of it are kept), or why it is dropped:
    'hidden', 'wrapper' or 'apart'."""
    if name in NEVER:
        return "wrapper" if name in WRAPPERS else "apart"
    kind = ""
    if name == "header":
        kind = "head" if in_main else "apart"
    if not source or source.isspace():
        return kind
    given = attributes(source)
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""))
    if name in ("html", "body", "main"):
        return kind
    words, anchor = marks_of(given.get("class", "")), marks_of(given.get("id", ""))
    if name in HEADINGS:  # an id of a heading is its anchor
        words = set() if in_main else words
    elif name == "section" and in_main:  # so is one of an article's section
        words |= anchor & (COMMENTS | ADS | {"related", "recommended", "recommendations", "newsletter"})
    else:
        words |= anchor
    if name == "article":
        words &= COMMENTS | ADS
        return "hidden" if hidden or words else kind
    if hidden:
        return "hidden"
    role = given.get("role", "").lower()
    if (found := words & MARKS) or role in ROLES:
        return "wrapper" if found <= WRAPPERS and role not in ROLES - WRAPPERS else "apart"
    if words & HEADER_MARKS and name not in HEADINGS:
        return "head" if in_main else "wrapper"
    return kind


@dataclass
class Dropped:
    """An element that is dropped by its marks: why, the one around it, its text outside links."""

    kind: str
    around: int
    weight: int = 0


def spared_of(drops: list[Dropped], mains: list[tuple[str, int, int]], kept: int) -> frozenset[int]:
    """Which dropped elements hold the page's article or main element, or most of its text. ``mains``
    has the name, innermost dropped element around it and weight of each article or main."""
    # of each: is any element up from it hidden, are all of them wrappers
    hidden, wrapped = [], []
    for d in drops:
        hidden.append(d.kind == "hidden" or d.around >= 0 and hidden[d.around])
        wrapped.append(d.kind == "wrapper" and (d.around < 0 or wrapped[d.around]))
    spared: set[int] = set()
    outside = max((w for _, k, w in mains if k < 0), default=0)
    for name, k, w in mains:
        if w and (name == "main" or w > 2 * outside and 2 * w > kept) and not (k >= 0 and hidden[k]):
            while k >= 0 and k not in spared:
                spared.add(k)
                k = drops[k].around
    if outside or spared:
        return frozenset(spared)
    # without article or main elements, by weight: inner elements come before those around them
    weight = [d.weight for d in drops]
    whole = sum(weight)
    page = kept + sum(d.weight for d, w in zip(drops, wrapped, strict=True) if w)
    for k in range(len(drops) - 1, -1, -1):
        d = drops[k]
        if d.kind == "wrapper" and 2 * weight[k] > page or d.kind == "apart" and not page and 2 * weight[k] > whole:
            spared.add(k)
            if d.around >= 0:
                weight[d.around] += weight[k]
                whole += weight[k]
    return frozenset(spared)


def lines_of(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[Line], Containers]:
    """The page's lines (blank ones where something was dropped), and what holds them. Dropped
    elements are numbered as they open; the ``spared`` ones are kept."""
    lines: list[Line] = []
    stack: list[tuple[str, str, int, bool]] = []  # name, kind, number as a container or -1, is it in drops
    open_names: Counter[str] = Counter()
    drops: list[Dropped] = []
    open_drops = [-1]
    held = Containers()
    inside = [-1]
    open_mains: list[int] = []
    main_of: dict[int, tuple[str, int, int]] = {}  # name, innermost dropped element, main around
    main_weight: Counter[int] = Counter()
    kept = 0
    parts: list[str] = []
    link_chars, links, dropped, heads, heading = 0, 0, 0, 0, 0

    def end_line() -> None:
        nonlocal link_chars
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(Line(text, max(0, len(text) - link_chars), inside[-1]))
        link_chars = 0

    def pop() -> None:
        nonlocal dropped, heads, heading
        name, kind, number, numbered = stack.pop()
        open_names[name] -= 1
        if numbered:
            open_drops.pop()
        if kind == "drop":
            dropped -= 1
            if not dropped:
                lines.extend([Line("", 0, -1)] * WINDOW)
        if kind == "head":
            heads -= 1
        if number >= 0:
            inside.pop()
            held.last[number] = len(held.around) - 1
            if number in main_of:
                open_mains.pop()
        if name in HEADINGS:
            heading -= 1

    def weigh(text: str) -> None:
        nonlocal kept
        w = len(text.strip())
        if not w or links:
            return
        if (k := open_drops[-1]) >= 0:
            drops[k].weight += w
        else:
            kept += w
        if open_mains and main_of[open_mains[-1]][1] == k:
            main_weight[open_mains[-1]] += w

    def push(name: str, kind: str, number: int = -1) -> str:
        """The kind that the element has after all."""
        nonlocal dropped
        numbered = kind in ("hidden", "wrapper", "apart")
        if numbered:
            drops.append(Dropped(kind, open_drops[-1]))
            open_drops.append(len(drops) - 1)
            kind = "" if len(drops) - 1 in spared else "drop"
        dropped += kind == "drop"
        stack.append((name, kind, number, numbered))
        open_names[name] += 1
        return kind

    scanner = Scanner(page)
    at = 0
    unended: set[str] = set()  # raw elements without an end tag in the rest of the page
    while tag := scanner.next(at):
        text = page[at : tag.start]
        weigh(text)
        if not dropped and (not heads or heading):
            parts.append(text)
            if links:
                link_chars += len(text.strip())
        at, name, closing, source = tag.end, tag.name, tag.closing, tag.source
        if not name:
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE and not closing and not dropped and source and marked(name, source, bool(open_mains)) in ("", "head"):
            continue
        if name in INLINE and not source.strip() and not (closing and open_names[name]):
            continue
        if name not in INLINE:
            end_line()
        if closing:
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or source.endswith("/"):
            continue
        if name in RAW:
            if name == "head":
                push(name, "apart")
            elif name not in unended and (end := _END[name].search(page, at)):
                at = end.end()  # nothing but its own end tag ends raw text
            elif name in UNPARSED:
                at = len(page)
            else:
                unended.add(name)
            continue
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if name in IMPLIED_END and stack and stack[-1][0] == name:
            pop()
        kind = marked(name, source, bool(open_mains))
        if name in INLINE and kind in ("", "head"):
            continue
        number = -1
        if name in CONTAINERS and (kind in ("", "head") or len(drops) in spared):
            number = len(held.around)
            held.around.append(inside[-1])
            held.last.append(number)
            inside.append(number)
            if name in MAIN:
                held.mains.add(number)
                main_of[number] = (name, open_drops[-1], open_mains[-1] if open_mains else -1)
                open_mains.append(number)
        kind = push(name, kind, number)
        if kind == "head":
            heads += 1
        if name in HEADINGS:
            heading += 1
    weigh(page[at:])
    if not dropped and (not heads or heading):
        parts.append(page[at:])
    end_line()
    while stack:
        pop()
    for number in sorted(main_of, reverse=True):  # inner ones count for those around them
        _, k, around = main_of[number]
        if around >= 0 and main_of[around][1] == k:
            main_weight[around] += main_weight[number]
    weighed = [(name, k, main_weight[number]) for number, (name, k, _) in main_of.items()]
    if drops and not spared and (spared := spared_of(drops, weighed, kept)):
        return lines_of(page, spared)
    return lines, held


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of every stretch: lines from where the window sum surges to where it dives."""
    n = len(weights)
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    sums = [upto[min(n, k + WINDOW)] - upto[k] for k in range(n)]
    found, k = [], 0
    while k < n:
        if sums[k] > LEAST_SURGE:
            surge = k
            while k < n and sums[k] > 0:
                k += 1
            while surge < k and not weights[surge]:
                surge += 1
            found.append((surge, k))
        else:
            k += 1
    return found


def heaviest(lines: list[Line], weights: list[int]) -> tuple[int, int] | None:
    """The heaviest stretch; without any, the heaviest line; None without lines."""
    if found := stretches(weights):
        return max(found, key=lambda s: sum(line.weight for line in lines[s[0] : s[1]]))
    full = [k for k, line in enumerate(lines) if line.text]
    if not full:
        return None
    peak = max(full, key=lambda k: lines[k].weight)
    return peak, peak + 1


def widened(first: int, last: int, weights: list[int]) -> tuple[int, int]:
    """A stretch (its last line's end) with the lines of text next to it, and a few of links."""
    for step in (-1, 1):
        k, links = (first - 1 if step < 0 else last), 0
        while 0 <= k < len(weights) and (weights[k] or links < WINDOW - 1):
            links = 0 if weights[k] else links + 1
            k += step
        if step < 0:
            first = k + 1
        else:
            last = k
    return first, last


def main_text(page: str | None) -> str:
    lines, held = lines_of(page or "")
    weights = [0 if 2 * line.weight < len(line.text) else line.weight for line in lines]
    top = heaviest(lines, weights)
    if top is None:
        return ""
    peak = max(range(*top), key=lambda k: lines[k].weight)
    mains = [m for m in held.chain(lines[peak].inside) if m in held.mains]
    if not mains:
        return " ".join(lines[k].text for k in _of_containers(lines, weights, held, top))
    # the innermost main element that holds most of the text around the peak
    total = {m: 0 for m in mains}
    for line in lines:
        if line.text:
            m = next((m for m in mains if held.holds(m, line.inside)), None)
            if m is not None:
                total[m] += line.weight
    upto, around = 0, sum(total.values())
    for number in mains:
        upto += total[number]
        if 2 * upto >= around:
            break
    own = [k for k, line in enumerate(lines) if line.text and held.holds(number, line.inside)]
    kept = [weights[k] for k in own]
    if found := stretches(kept):
        first, last = widened(found[0][0], found[-1][1], kept)
    else:
        first, last = widened(own.index(peak), own.index(peak) + 1, kept)
    return " ".join(lines[k].text for k in own[first:last])


def _of_containers(lines: list[Line], weights: list[int], held: Containers, top: tuple[int, int]) -> list[int]:
    """Where no article or main element is around the peak: all stretches, widened to the ends of
    the containers that hold them and by the lines of text of the same parents."""
    found = stretches(weights) or [top]
    total = [sum(line.weight for line in lines[a:b]) for a, b in found]
    heavy = [s for s, t in zip(found, total, strict=True) if t >= SIDE_SHARE * max(total)]
    common = holder((lines[k] for a, b in heavy for k in range(a, b)), held)
    keep = set() if common >= 0 else set(range(heavy[0][0], heavy[-1][1]))
    holders = {common, *(holder(lines[a:b], held) for a, b in found)}
    # what only dropped blocks part belongs together: stretches again, without the blank lines
    full = [k for k, line in enumerate(lines) if line.text]
    for a, b in stretches([weights[k] for k in full]):
        keep.update(full[a:b])
    ends: list[tuple[int, int]] = []  # first and last container of each holder, none in another
    for number in sorted(h for h in holders if h >= 0):
        if not ends or number > ends[-1][1]:
            ends.append((number, held.last[number]))
    parents = {held.around[h] if h >= 0 else -1 for h in holders}
    for k in full:
        inside = lines[k].inside
        at = bisect_right(ends, (inside, len(held.around))) - 1
        within = inside >= 0 and at >= 0 and inside <= ends[at][1]
        if within or weights[k] and (inside in parents or inside >= 0 and held.around[inside] in parents):
            keep.add(k)
    return [k for k in full if k in keep]


def holder(lines: Iterable[Line], held: Containers) -> int:
    """The innermost container around all of the lines that have text; -1 for body."""
    numbers = [line.inside for line in lines if line.text]
    low, high = min(numbers), max(numbers)
    return next((m for m in held.chain(low) if held.holds(m, high)), -1) if low >= 0 else -1


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return whole.mapInArrow(run, "page_id long, url string, text string, n_chars long")
