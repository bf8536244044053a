"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Tandem repeats in it fold into repeated groups.
The streams of one host are then aligned one after another: what both have stays,
texts that differ are text slots, and a run that only one has becomes an optional
group. The result is a regular expression without unions. It is inferred in parallel:
each task aligns the pages it reads, and the wrappers of tasks are aligned with each
other in rounds of a few, so that a host with many pages is never one task's work.

A second pass matches every page with its host's expression, which gives each text and
tag its place there, and gathers what the places hold. These decide the text:

* a repeated group that holds nothing but links is a menu;
* the region of the article is the tag's place with the most running text: an article or
  main element, else the innermost holder of most of it. Places in a repeated group,
  such as teasers and reader comments, are records and no region;
* the text is what the slots in that region hold, block by block.

Elements that by their HTML name hold no article (nav, footer, ...) never count. Outside the
region, nor do those that are named as menus, adverts or comments, unless they are a box
around it. Inside the region a name alone decides nothing: such a text goes if it
is a link, if its place holds the same text on other pages too, or if it lies in a
repeated record. Text that is the same on many pages stays, wherever it is in the region. On
a host without a region, what is the same on ``TEMPLATE_PAGES`` different pages goes before
the first text that differs and after the last, never between.
A page that does not match its host's expression is walked by its tags, within the
element that has the sign of the region; there, and on hosts of one page, boxes that are
named as asides go.

Defined results: a null, empty or wholly marked-up page gives the empty text; a null
url is a host of its own; repeated rows are extracted each for itself; a host of copies
of one page has no template; of regions with equal text the first in the expression is taken; very long pages and pages
of very many different tags are read as a whole; an empty table gives no rows; columns
other than id, url and html are not looked at.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Bytes of wrappers that are broadcast at most.
BROADCAST_BYTES = 32_000_000
#: Beyond that, tasks that the pages of one host are dealt out over.
SALTS = 16
#: Repeated units up to so many tokens are found by expression, longer ones by their distances.
UNIT = 24
#: Elements of a wrapper at most: page shapes that would make it longer are not aligned, and their pages are walked by their tags.
MOST = 20_000
#: Longer runs are cut at what occurs once in both before they are aligned pair by pair.
PAIRS = 250_000
#: Wrappers of one host that are aligned by one task.
FEW = 8
#: Different pages that must share a text before it is template, on hosts without a region.
TEMPLATE_PAGES = 8
RAW = "script|style|noscript|template|svg|iframe|title|textarea|object|math|select|datalist|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    rf"|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|</?[a-zA-Z][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE).findall
PART = re.compile(r"[A-Za-z]+").findall
# HTML elements that never close, that break a line, and that hold no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE = set("nav footer aside form menu head dialog button fieldset".split())
#: Of these, what may hold no article at all; others of ASIDE and all ASIDE_WORDS may also name a box around it.
NEVER = ASIDE - {"form", "fieldset"}
#: Ends the sign of an element that is named like an aside but holds the article.
BOX = ".="
ASIDE_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert newsletter subscribe subscription popup modal sidebar widget related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu navigation nav navbar footer comment comments disqus respond replies reply login signup search toolbar skip".split())
HOLDERS = set("article main section div td body".split())
#: Elements that may be one record of a list, as a reader's comment is.
RECORDS = set("article section div td li tr dd".split())


class Page:
    """The tokens of one page: signatures, and the texts between them."""

    __slots__ = ("signs", "texts")

    def __init__(self, html: str) -> None:
        self.signs: list[str] = []  # "name.class", "/name", or "#" for a text
        self.texts: list[str] = []  # of each token; empty for tags
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m[3]
            if name:
                name = name.lower()
                self.signs.append(f"/{name}" if m[2] else _sign(name, m[4]) if m[4] else name)
                self.texts.append("")
        if at < len(html):
            self._text(html[at:])
        for i in boxes(self.signs, self.texts):
            self.signs[i] += BOX

    def _text(self, raw: str) -> None:
        if raw.strip():
            if self.signs and self.signs[-1] == "#":
                self.texts[-1] += raw
            else:
                self.signs.append("#")
                self.texts.append(raw)


@lru_cache(20_000)
def _sign(name: str, attributes: str) -> str:
    words = [w.lower() for found in NAMED(attributes) for w in PART("".join(found))]
    return ".".join([name, *words]) if words else name


def name_of(sign: str) -> str:
    return sign.partition(".")[0]


@lru_cache(20_000)
def is_aside(sign: str) -> bool:
    name, _, words = sign.partition(".")
    if sign.endswith(BOX):
        return False
    return name in ASIDE or (name not in ("article", "main", "body", "html") and not ASIDE_WORDS.isdisjoint(words.split(".")))


@lru_cache(20_000)
def is_header(sign: str) -> bool:
    name, _, words = sign.partition(".")
    return name == "header" or (name in HOLDERS and bool({"header", "masthead"} & set(words.split("."))))


def elements(signs: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end (the token after it) of every element, inner ones first."""
    stack: list[tuple[str, int]] = []
    for i, sign in enumerate(signs):
        if sign == "#":
            continue
        name = name_of(sign.lstrip("/"))
        if sign[0] == "/":
            if any(n == name for n, _ in stack):
                while True:
                    gone, begin = stack.pop()
                    yield begin, i + (gone == name)
                    if gone == name:
                        break
        elif name not in VOID:
            if stack and (stack[-1][0] == name in ("p", "li", "td", "tr") or (name == "body" and stack[-1][0] == "head")):
                yield stack.pop()[1], i
            stack.append((name, i))
    while stack:
        yield stack.pop()[1], len(signs)


def boxes(signs: list[str], texts: list[str]) -> list[int]:
    """Elements named like an aside that are boxes around the article.

    They hold all article and main elements and half of the page's running text, or
    nine tenths of it on a page without such elements.
    """
    if not any(is_aside(s) and name_of(s) not in NEVER for s in set(signs)):
        return []
    spans = list(elements(signs))
    never = bytearray(len(signs))
    for b, e in spans:
        if name_of(signs[b]) in NEVER or is_header(signs[b]) or name_of(signs[b]) == "a":
            never[b:e] = b"\1" * (e - b)
    mass, held = [0], [0]  # running sums of text, and of article and main elements
    for i, (sign, text) in enumerate(zip(signs, texts, strict=True)):
        mass.append(mass[-1] + (len(text) if sign == "#" and not never[i] else 0))
        held.append(held[-1] + (not never[i] and name_of(sign) in ("article", "main")))
    least = 0.5 if held[-1] else 0.9
    return [b for b, e in spans if is_aside(signs[b]) and name_of(signs[b]) not in NEVER and not never[b] and mass[-1] and held[e] - held[b] == held[-1] and mass[e] - mass[b] >= least * mass[-1]]


class Reading:
    """A walk over the tags of a page that says of each text in which elements it lies."""

    def __init__(self, page: Page) -> None:
        signs = page.signs
        #: Of each text: its token, whether it is part of an aside, whether of a link, the tokens that opened its elements; None where a block ends.
        self.texts: list[tuple[int, bool, bool, tuple[int, ...]] | None] = []
        stack: list[int] = []
        names: list[str] = []
        opened: tuple[int, ...] = ()
        aside = links = holders = 0

        def step(i: int, by: int) -> None:
            nonlocal aside, links, holders
            sign = signs[i]
            if is_aside(sign) or i in headers:
                aside += by
            if sign == "a" or sign.startswith("a."):
                links += by
            if name_of(sign) in ("article", "main"):
                holders += by

        headers = self.headers = set()  # page headers; an article's own stays
        for i, sign in enumerate(signs):
            if sign == "#":
                self.texts.append((i, aside > 0, links > 0, opened))
                continue
            name = name_of(sign[1:]) if sign[0] == "/" else name_of(sign)
            if name in BLOCKS:
                self.texts.append(None)
            if sign[0] == "/":
                if name in names:
                    while True:
                        gone = names.pop()
                        step(stack.pop(), -1)
                        if gone == name:
                            break
                    opened = tuple(stack)
            elif name not in VOID:
                if names and (names[-1] == name in ("p", "li", "td", "tr") or (name == "body" and names[-1] == "head")):
                    names.pop()
                    step(stack.pop(), -1)  # these end where the next begins
                if is_header(sign) and not holders:
                    headers.add(i)
                stack.append(i)
                names.append(name)
                step(i, 1)
                opened = tuple(stack)

    def named(self, page: Page, opened: tuple[int, ...], begin: int) -> list[int] | None:
        """The elements from token ``begin`` on that make a text an aside, if it is one by their class, id or role alone; else None."""
        found = [o for o in opened if is_aside(page.signs[o]) or o in self.headers]
        return found if all(o > begin and o not in self.headers and name_of(page.signs[o]) not in ASIDE for o in found) else None

    def blocks_of(self, page: Page, wanted) -> list[str]:
        """The blocks made of the texts that ``wanted`` takes by (token, whether it is part of an aside, whether of a link, elements)."""
        blocks, current = [], []
        for text in (*self.texts, None):
            if text is None:
                if current:
                    block = " ".join(unescape("".join(current)).split())
                    if block:
                        blocks.append(block)
                    current = []
            elif wanted(*text):
                current.append(page.texts[text[0]])
        return blocks


# --- inference ---------------------------------------------------------------
# A wrapper is a tuple of elements: a sign, or (kind, wrapper) with kind "+", "?" or "*".


def code_point(n: int) -> str:
    """The n-th character from 256 on, without surrogates."""
    return chr(n + 0x100 if n + 0x100 < 0xD800 else n + 0x900)


#: So many different characters there are.
CODES = 0x110000 - 0x900


def fold(signs: list[str]) -> tuple:
    """Tandem repeats as repeated groups, innermost first; a page of more different signs than there are characters stays as it is."""
    if len(signs) > CODES // 2 and len(set(signs)) > CODES // 2:
        return tuple(signs)
    code: dict[object, str] = {}
    back: dict[str, object] = {}

    def char(x: object) -> str:
        if x not in code:
            code[x] = code_point(len(code))
            back[code[x]] = x
        return code[x]

    line = "".join(map(char, signs))
    while True:
        width = 1
        while 2 * width <= len(line) and width <= UNIT:
            new = REPEATS[width - 1].sub(lambda m: char(("+", tuple(back[c] for c in m[1]))), line)
            line, width = (new, 1) if new != line and width > 1 else (new, width + 1)
        found = long_repeat(line)
        if found is None:
            return tuple(back[c] for c in line)
        begin, width, end = found
        line = line[:begin] + char(("+", tuple(back[c] for c in line[begin : begin + width]))) + line[end:]


def long_repeat(line: str) -> tuple[int, int, int] | None:
    """(begin, width, end) of a repeat whose unit is longer than ``UNIT``; its width is a distance between two equal neighbours."""
    if len(line) <= 2 * UNIT:
        return None
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    gaps = (order[1:] - order[:-1])[same]
    widths, counts = np.unique(gaps[gaps > UNIT], return_counts=True)
    for width in widths[np.argsort(-counts, kind="stable")].tolist():
        if 2 * width > len(codes):
            continue
        equal = np.r_[0, codes[width:] == codes[:-width], 0]
        edges = np.flatnonzero(np.diff(equal))
        begins, lengths = edges[::2], edges[1::2] - edges[::2]
        at = np.flatnonzero(lengths >= width)
        if len(at):
            begin = int(begins[at[0]])
            return begin, width, begin + (int(lengths[at[0]]) // width + 1) * width
    return None


REPEATS = [re.compile(r"(.{%d})\1+" % n, re.DOTALL) for n in range(1, UNIT + 1)]


def looks(x: object) -> object:
    """What elements must share to be aligned: a sign itself, or how a group begins and ends."""
    if isinstance(x, str):
        return x
    first, last = x[1][0], x[1][-1]
    while isinstance(first, tuple):
        first = first[1][0]
    while isinstance(last, tuple):
        last = last[1][-1]
    return first, last


def merged(a: object, b: object) -> object:
    """One element for both, given that they look alike."""
    if a == b:
        return a
    kind = a[0] if a[0] == b[0] else "*" if "*" in (a[0], b[0]) or {a[0], b[0]} == {"+", "?"} else "+"
    return (kind, align(a[1], b[1]))


def align(a: tuple, b: tuple) -> tuple:
    """The union-free expression of both: common elements, and optional groups for what only one has."""
    if a == b:
        return a
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = list(a[:head])
    rest = a[len(a) - tail :] if tail else ()
    if not x or not y:
        out += optional(x or y)
    elif len(x) * len(y) > PAIRS and (cuts := anchors(x, y)):
        i = j = 0
        for i2, j2 in (*cuts, (len(x), len(y))):
            out += align(x[i:i2], y[j:j2])
            if i2 < len(x):
                out.append(merged(x[i2], y[j2]))
            i, j = i2 + 1, j2 + 1
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        lx, ly = [looks(e) for e in x], [looks(e) for e in y]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                same = best[i + 1][j + 1] + (3 if x[i] == y[j] else 2) if lx[i] == ly[j] else -1
                best[i][j] = max(best[i + 1][j], best[i][j + 1], same)
        i = j = 0
        only: list[list] = [[], []]
        while i < len(x) and j < len(y):
            if lx[i] == ly[j] and best[i][j] == best[i + 1][j + 1] + (3 if x[i] == y[j] else 2):
                out += optional(tuple(only[0])) + optional(tuple(only[1]))
                only = [[], []]
                out.append(merged(x[i], y[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                only[0].append(x[i])
                i += 1
            else:
                only[1].append(y[j])
                j += 1
        out += optional((*only[0], *x[i:])) + optional((*only[1], *y[j:]))
    return (*out, *rest)


def anchors(x: tuple, y: tuple) -> list[tuple[int, int]]:
    """Places of elements that look like nothing else in either run, in the longest order that both share."""
    lx, ly = [looks(e) for e in x], [looks(e) for e in y]
    cx, cy = Counter(lx), Counter(ly)
    place = {e: j for j, e in enumerate(ly) if cy[e] == 1}
    pairs = [(i, place[e]) for i, e in enumerate(lx) if cx[e] == 1 and e in place]
    ends: list[int] = []  # last place in y of the shortest-ending chain of each length
    chain: list[int] = []
    before: list[int] = []
    for at, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        ends[n : n + 1] = [j]
        before.append(chain[n - 1] if n else -1)
        chain[n : n + 1] = [at]
    out, at = [], chain[-1] if chain else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def optional(run: tuple) -> list:
    """A run that may be missing: what is optional already stays so, the rest is one group."""
    out: list = []
    held: list = []
    for e in (*run, None):
        if e is not None and not (isinstance(e, tuple) and e[0] in "?*"):
            held.append(e)
            continue
        if held:
            out.append(("?", tuple(held)) if len(held) > 1 or not isinstance(held[0], tuple) else ("*", held[0][1]))
            held = []
        if e is not None:
            out.append(e)
    return out


def refold(w: tuple) -> tuple:
    """Neighbouring groups of one body become one; a group before its own body, too."""
    out: list = []
    for e in w:
        if out and isinstance(e, tuple) and isinstance(out[-1], tuple) and e[1] == out[-1][1]:
            out[-1] = ("*" if "*" in (e[0], out[-1][0]) or e[0] == out[-1][0] == "?" else "+", e[1])
        else:
            out.append(e)
    return tuple(out)


def units(w: tuple) -> set[tuple]:
    """Bodies of all repeated groups."""
    found: set[tuple] = set()
    for e in w:
        if isinstance(e, tuple):
            found |= units(e[1])
            if e[0] != "?" and len(e[1]) > 1:
                found.add(e[1])
    return found


def regrouped(w: tuple, known: list[tuple]) -> tuple:
    """A single copy of a unit that repeats elsewhere becomes a repeated group, too."""
    w = tuple((e[0], e[1] if e[1] in known else regrouped(e[1], known)) if isinstance(e, tuple) else e for e in w)
    for unit in known:
        out: list = []
        i, n = 0, len(unit)
        while i < len(w):
            if w[i : i + n] == unit:
                out.append(("+", unit))
                i += n
            else:
                out.append(w[i])
                i += 1
        w = refold(tuple(out))
    return fold(list(w))


def unified(shapes: set[tuple]) -> tuple:
    """One wrapper for all: units are shared first, then shapes are aligned one after another."""
    known = sorted(set().union(*(units(s) for s in shapes)), key=lambda u: (len(repr(u)), repr(u)))
    shapes = {regrouped(s, known) for s in shapes if s}
    w: tuple = ()
    for shape in sorted(shapes, key=lambda s: (-len(s), repr(s))):
        longer = refold(align(w, shape)) if w else shape
        w = longer if len(longer) <= MOST or not w else w
    return w


def pack(w: tuple | None) -> str:
    return json.dumps(w)


def unpack(text: str) -> tuple | None:
    def tuples(x: object) -> object:
        return tuple(tuples(e) for e in x) if isinstance(x, list) else x

    return tuples(json.loads(text))


def combine(packed: list[str]) -> str:
    """Align wrappers of one host, whatever their order; one of empty pages (None) adds nothing."""
    shapes = {w for w in map(unpack, packed) if w}
    return pack(unified(shapes) if shapes else None)


def other_article(page: Page, main: str | None) -> tuple[int, int] | None:
    """The article of a page that has it under another sign than its host: begin and end.

    That is the element of main's name with most running text, if no element with the
    sign ``main`` has half as much and none holds it.
    """
    name = name_of(main) if main else None
    if name not in ("article", "main") or all(s == main or name_of(s) != name for s in set(page.signs)):
        return None
    spans = list(elements(page.signs))
    out = bytearray(len(page.signs))
    for b, e in spans:
        if is_aside(page.signs[b]) or (name_of(page.signs[b]) == "a"):
            out[b:e] = b"\1" * (e - b)
    mass = [0]
    for i, (sign, text) in enumerate(zip(page.signs, page.texts, strict=True)):
        mass.append(mass[-1] + (len(text) if sign == "#" and not out[i] else 0))
    found = [(mass[e] - mass[b], -b, e) for b, e in spans if name_of(page.signs[b]) == name and not out[b]]
    most, b, e = max(found, default=(0, 0, 0))
    own = [(n, -b2, e2) for n, b2, e2 in found if page.signs[-b2] == main]
    if not most or page.signs[-b] == main or any(2 * n >= most or (b2 <= -b and e <= e2) for n, b2, e2 in own):
        return None
    return -b, e


class Sequence:
    """A compiled run of a wrapper: gives the tokens that it matches their places."""

    def __init__(self, w: tuple, wrapper: Wrapper, repeated: bool) -> None:
        #: Literals as their first place and number; groups.
        self.items: list[tuple[int, int] | Sequence] = []
        captured, bare = [], []
        for e in w:
            if isinstance(e, str):
                at = len(wrapper.signs)
                if self.items and isinstance(self.items[-1], tuple):
                    at, n = self.items.pop()
                    self.items.append((at, n + 1))
                else:
                    self.items.append((at, 1))
                wrapper.signs.append(e)
                wrapper.repeated.append(repeated)
                captured.append(re.escape(wrapper.code_of(e)))
                bare.append(captured[-1])
                continue
            begin = len(wrapper.signs)
            group = Sequence(e[1], wrapper, repeated or e[0] != "?")
            self.items.append(group)
            if e[0] != "?":
                wrapper.groups.append((begin, len(wrapper.signs)))
            bare.append(f"(?:{group.bare}){e[0]}+")  # possessive: what would need backtracking does not match
            captured.append(f"({bare[-1]})")
        self.bare = "".join(bare)
        self.regex = re.compile("".join(captured), re.DOTALL)

    def place(self, m: re.Match, line: str, out: list[int]) -> None:
        """Append the places of the tokens of a match."""
        g = 0
        for item in self.items:
            if isinstance(item, tuple):
                out.extend(range(item[0], item[0] + item[1]))
                continue
            g += 1
            at, end = m.span(g)
            if len(item.items) == 1 and isinstance(item.items[0], tuple):
                first, n = item.items[0]
                out.extend([*range(first, first + n)] * ((end - at) // n))
                continue
            while at < end:
                inner = item.regex.match(line, at, end)
                if inner is None or inner.end() == at:
                    raise LookupError
                item.place(inner, line, out)
                at = inner.end()


class Wrapper:
    """A compiled wrapper: ``places`` gives each token of a matching page its place in the expression."""

    def __init__(self, packed: str) -> None:
        w = unpack(packed)
        self.signs: list[str] = []  # of each place
        self.repeated: list[bool] = []
        self.groups: list[tuple[int, int]] = []  # places of each repeated group
        self.code: dict[str, str] = {}
        self.top = Sequence(w, self, False) if w else None

    def code_of(self, sign: str) -> str:
        return self.code.setdefault(sign, code_point(len(self.code)))

    def places(self, page: Page) -> list[int] | None:
        if self.top is None:
            return None
        line = "".join([self.code.get(s, "\x00") for s in page.signs])
        m = self.top.regex.fullmatch(line)
        if m is None:
            return None
        out: list[int] = []
        try:
            self.top.place(m, line, out)
        except LookupError:
            return None
        return out if len(out) == len(line) else None


class Holdings:
    """What the places of a wrapper hold, as gathered over pages: place -> (pages, characters, of links, running text below, the same outside records, least and largest hash, different pages)."""

    FIELDS = "place int, pages long, chars long, links long, mass long, own long, low long, high long, bits long"

    def __init__(self) -> None:
        self.rows: dict[int, list[int]] = {}

    def add(self, page: Page, reading: Reading, places: list[int], wrapper: Wrapper) -> None:
        digest = 1 << (xxhash.xxh64_intdigest("\x00".join(page.texts)) & 63)
        digest -= (digest >> 63) << 64  # as a signed number
        seen: set[int] = set()
        for text in reading.texts:
            if text is None:
                continue
            i, aside, link, opened = text
            words = " ".join(page.texts[i].split())
            row = self._row(places[i])
            if places[i] not in seen:
                seen.add(places[i])
                row[0] += 1
            row[1] += len(words)
            row[2] += len(words) * link
            mark = xxhash.xxh64_intdigest(words) >> 1
            row[5], row[6], row[7] = min(row[5], mark), max(row[6], mark), row[7] | digest
            if not aside and not link:
                record = any(wrapper.repeated[places[o]] and name_of(page.signs[o]) in HOLDERS for o in opened)
                for at in {places[o] for o in opened if name_of(page.signs[o]) in HOLDERS} | {-1}:
                    other = self._row(at)
                    other[3] += len(words)
                    other[4] += 0 if record else len(words)

    def _row(self, place: int) -> list[int]:
        if place not in self.rows:
            self.rows[place] = [0, 0, 0, 0, 0, (1 << 63) - 1, -1, 0]
        return self.rows[place]


class Extractor:
    """A host's wrapper with what its places hold: says which of them are the article."""

    def __init__(self, packed: str, holdings: list[tuple]) -> None:
        self.wrapper = Wrapper(packed)
        rows = {r[0]: r[1:] for r in holdings}
        signs = self.wrapper.signs
        self.main = self._main(rows)
        self.sign = signs[self.main] if self.main is not None else None
        #: Places with one and the same text on two different pages or more, and on ``TEMPLATE_PAGES``.
        pages = {p: (r[7] & ((1 << 64) - 1)).bit_count() for p, r in rows.items() if p >= 0 and signs[p] == "#" and r[5] == r[6]}
        self.constant = {p for p, n in pages.items() if n >= 2}
        #: One page, however often, shows nothing about its places.
        self.alone = all((r[7] & ((1 << 64) - 1)).bit_count() < 2 for r in rows.values())
        self.dropped: set[int] = set()
        for begin, end in self.wrapper.groups:
            texts = [p for p in range(begin, end) if signs[p] == "#" and p in rows]
            chars = sum(rows[p][1] for p in texts)
            if chars and sum(rows[p][2] for p in texts) >= 0.95 * chars:
                self.dropped.update(texts)
        if self.main is None:  # no region: template is what is the same everywhere before the first text that differs, or after the last
            own = [p for p in rows if p >= 0 and signs[p] == "#" and p not in pages and p not in self.dropped]
            self.dropped |= {p for p, n in pages.items() if n >= TEMPLATE_PAGES and own and not min(own) < p < max(own)}

    def _no_article(self, page: Page, places: list[int], i: int, link: bool, named: list[int], opened: tuple[int, ...]) -> bool:
        """Whether a text inside the region, in elements named like an aside, is one: a link, the same text on other pages, or in a repeated record."""
        repeated = self.wrapper.repeated
        record = any(o >= named[0] and repeated[places[o]] and name_of(page.signs[o]) in RECORDS for o in opened)
        return link or record or places[i] in self.constant

    def _main(self, rows: dict) -> int | None:
        """The place that opens the article: an article or main element with its share of the text, else the innermost holder of most of it."""
        total, outside = (rows[-1][3], rows[-1][4]) if -1 in rows else (0, 0)
        signs, repeated = self.wrapper.signs, self.wrapper.repeated
        column, whole = (4, outside) if outside >= 0.02 * total else (3, total)  # all text may be in records
        own = {p: r[column] for p, r in rows.items() if p >= 0 and r[column] and not repeated[p]}
        for name in ("article", "main"):
            found = sorted((-n, p) for p, n in own.items() if name_of(signs[p]) == name)
            if found and -found[0][0] >= 0.3 * whole:
                return found[0][1]
        most = sorted((n, -p) for p, n in own.items() if name_of(signs[p]) not in ("body", "article", "main") and n >= 0.7 * whole)
        return -most[0][1] if most and whole else None

    def extract(self, html: str | None) -> tuple[str, bool]:
        """The main text, and whether the page matched the wrapper."""
        if not html:
            return "", False
        page = Page(html)
        reading = Reading(page)
        other = other_article(page, self.sign)
        if other:
            return "\n".join(reading.blocks_of(page, lambda i, aside, _, opened: other[0] <= i < other[1] and (not aside or self._plain(page, reading, opened, other[0])))), False
        places = self.wrapper.places(page)
        if places is not None and (self.main is None or self.main in places):
            main, dropped = self.main, self.dropped

            def wanted(i: int, aside: bool, link: bool, opened: tuple[int, ...]) -> bool:
                if places[i] in dropped:
                    return False
                if main is None:
                    return not aside
                begin = next((o for o in opened if places[o] == main), None)
                if begin is None or not aside:
                    return begin is not None
                if self.alone:
                    return self._plain(page, reading, opened, begin)
                named = reading.named(page, opened, begin)
                return named is not None and not self._no_article(page, places, i, link, named, opened)

            return "\n".join(reading.blocks_of(page, wanted)), True
        sign = self.sign if self.sign in page.signs else None

        def walked(_: int, aside: bool, __: bool, opened: tuple[int, ...]) -> bool:
            begin = next((o for o in opened if page.signs[o] == sign), None)
            if sign is None or not aside or begin is None:
                return not aside and (sign is None or begin is not None)
            return self._plain(page, reading, opened, begin)

        return "\n".join(reading.blocks_of(page, walked)), False

    @staticmethod
    def _plain(page: Page, reading: Reading, opened: tuple[int, ...], begin: int) -> bool:
        """Without a wrapper: whether only paragraphs, headings and the like are named as asides, and no box is."""
        named = reading.named(page, opened, begin)
        return named is not None and not any(name_of(page.signs[o]) in RECORDS or name_of(page.signs[o]) in ("ul", "ol") for o in named)


@lru_cache(256)
def compiled(packed: str) -> Wrapper:
    return Wrapper(packed)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one packed wrapper a host, from all its pages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[str, set] = defaultdict(set)
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shapes[host].add(fold(Page(html.as_py() or "").signs))
            found = [pack(unified(shapes[host] - {()}) if shapes[host] != {()} else None) for host in shapes]
            yield pa.RecordBatch.from_pydict({"host": pa.array(list(shapes), pa.string()), "wrapper": pa.array(found, pa.string())})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [combine(frame["wrapper"].tolist())]})

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    # batches of a large host give one and the same wrapper again and again: it is one row before any group is made
    found = written(rows.mapInArrow(scan, "host string, wrapper string").distinct(), "host-shapes")
    most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // FEW)
    while True:  # a few rounds: the number of wrappers of a host falls by FEW each time
        found = found.groupBy("host", F.pmod(F.xxhash64("wrapper", F.lit(parts)), F.lit(parts)).alias("part")).applyInPandas(join, "host string, wrapper string")
        if parts == 1:
            return found
        found, parts = found.distinct(), -(-parts // FEW)


def with_wrappers(rows: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, object]:
    """(rows, table): what the tasks need to know of each row's host.

    If all wrappers are small, ``table`` is a broadcast of them by host and rows stay as
    they are. Else it is None and rows have the wrappers' columns, by a join in which
    each host is dealt out over ``SALTS`` tasks.
    """
    size = wrappers.agg(F.sum(F.length(F.to_json(F.struct(*wrappers.columns))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = {r["host"]: tuple(r[c] for c in wrappers.columns if c != "host") for r in wrappers.collect()}
        return rows, rows.sparkSession.sparkContext.broadcast(known)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    every = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, ["host", "salt"]).drop("salt"), None


def known_of(batch: pa.RecordBatch, table: object) -> Iterator[tuple]:
    """What is known of each row's host, as ``with_wrappers`` brought it."""
    if table is not None:
        return map(table.value.__getitem__, batch.column("host").to_pylist())
    names = [n for n in ("wrapper", "holdings") if n in batch.schema.names]
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def host_holdings(pages: DataFrame, wrappers: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, holdings): each wrapper with what its places hold over all pages of the host."""
    rows, table = with_wrappers(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), wrappers)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, Holdings] = defaultdict(Holdings)
            for host, html, (packed, *_) in zip(batch.column("host").to_pylist(), batch.column("html"), known_of(batch, table), strict=True):
                page, wrapper = Page(html.as_py() or ""), compiled(packed)
                places = wrapper.places(page) if page.signs else None
                if places is not None:
                    held[host].add(page, Reading(page), places, wrapper)
            out = [(host, place, *r) for host, h in held.items() for place, r in h.rows.items()]
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["host", "place", "pages", "chars", "links", "mass", "own", "low", "high", "bits"])

    parts = rows.mapInArrow(gather, f"host string, {Holdings.FIELDS}")
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "links", "mass", "own")]
    whole = parts.groupBy("host", "place").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("bits").alias("bits"))
    lists = whole.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "pages", "chars", "links", "mass", "own", "low", "high", "bits"))).alias("holdings"))
    return wrappers.join(lists, "host", "left")


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, host, matched) for every row of ``pages``."""
    wrappers = written(infer_wrappers(pages, url_col=url_col, html_col=html_col), "wrappers")
    known = written(host_holdings(pages, wrappers, url_col=url_col, html_col=html_col), "holdings")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractors: dict[str, Extractor] = {}
        for batch in batches:
            if len(extractors) > 256:
                extractors.clear()
            found = []
            for host, html, (packed, holdings) in zip(batch.column("host").to_pylist(), batch.column("html"), known_of(batch, table), strict=True):
                if host not in extractors:
                    extractors[host] = Extractor(packed, [tuple(h.values() if isinstance(h, dict) else h) for h in holdings or []])
                found.append(extractors[host].extract(html.as_py()))
            texts = pa.array([f[0] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts, pa.array([len(f[0]) for f in found], pa.int64()), batch.column("host"), pa.array([f[1] for f in found], pa.bool_())], names=["page_id", "url", "text", "n_chars", "host", "matched"])

    kind = dict(rows.dtypes)["page_id"]
    rows, table = with_wrappers(rows, known)
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long, host string, matched boolean")
