"""Main text of web pages by page structure and nearest-URL page differencing.

A page is cut into blocks (lines of text). Blocks in an element that the markup names as something else than the article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) are dropped: an element says so by
its tag or role, or by a word of its class or id that means nothing but that; an article or main element never does, nor
does anything inside a line of text. Of the rest, what stands in an article or main element stays, for the contract lets
nothing of an article be dropped, and articles of one host do share lines. If a container named as the content holds more
text outside of these than the longest of them has, it is the article instead. Beside the longest such element only those
stay that have a third of its text at least; shorter ones are teasers. What the markup doesn't decide, on pages without
such an element, is decided by differencing: pages are ordered by URL path within their host, each is paired with the
neighbour whose path has the longer common start, their lines are aligned by longest common subsequence, and shared lines
are deleted. One that is alone on its host keeps its lines.

Pages are parsed once; their lines are written. Those to be differenced are dealt out by ranges of (host, path, page_id),
so a host with a third of all pages is spread over many tasks. A range's first and last page may have their neighbour in
the range before or after; those rows, two for each range, find it by a join on the range's number. The lines of a
neighbour are all that is held.

Null and empty pages have no text. A null URL is a host of its own. Pages of equal URL stand in the order of page_id.
Broken markup is read as far as it goes, in time that grows with its length. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import lean, written

# Elements by what they hold, and what a class, an id and a role say of an element.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object", "canvas", "audio", "video"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "input", "fieldset", "datalist"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: A word of a class or id names chrome if one of its parts is here and the others are in AROUND.
CHROME = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent",
    "cookie", "cookies", "discuss", "discussion", "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
}
AROUND = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "entry", "global", "group", "icons", "inner", "item", "items", "left", "link",
    "links", "list", "main", "media", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "secondary", "section", "side", "site", "slot", "stories", "top",
    "unit", "user", "widget", "widgets", "wrap", "wrapper", "zone",
}
#: Words of a class or id that name the container of the article.
CONTENT = {"article-body", "article-content", "articlebody", "body-content", "content", "entry-content", "main-content", "maincontent", "page-content", "post-body", "post-content", "story", "story-body"}

_TAG = re.compile(r"<(?:!--(?P<note>)|!|\?|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*'|["'])*>?""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def names_chrome(word: str) -> bool:
    parts = [p.lower() for p in _PART.findall(word)]
    if "".join(parts) in CHROME:
        return True
    return any(p in CHROME for p in parts) and all(p in CHROME or p in AROUND or p.isdigit() for p in parts)


@lru_cache(4096)
def told(attributes: str) -> tuple[bool, bool, bool, bool]:
    """What an element's attributes say: its name is chrome's, its role is, it is hidden, it is the content."""
    chrome = role = hidden = content = False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            chrome = chrome or any(map(names_chrome, value.split()))
            content = content or any(w.lower() in CONTENT for w in value.split())
        elif name == "role":
            role, content = role or value.lower() in ROLES, content or value.lower() in MAIN
        else:
            hidden = hidden or name == "hidden" or value == "true"
    return chrome, role, hidden, content


@dataclass(slots=True)
class Open:
    """An element that isn't closed yet."""

    name: str
    block: bool
    dropped: bool
    main: int  # the outermost article or main element around, or 0
    content: int  # the same of containers of the content


class Tree:
    """The open elements. Finding one to close takes constant time, and closing it as long as opening what it holds took."""

    def __init__(self) -> None:
        self.stack: list[Open] = [Open("", True, False, 0, 0)]
        self.blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # names since each open block

    @property
    def top(self) -> Open:
        return self.stack[-1]

    def open(self, e: Open) -> None:
        self.stack.append(e)
        if e.block:
            self.blocks[e.name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][e.name] += 1

    def pop(self) -> str:
        e = self.stack.pop()
        if e.block:
            self.blocks[e.name] -= 1
            self.inline.pop()
        else:
            self.inline[-1][e.name] -= 1
        return e.name

    def close(self, name: str, block: bool) -> None:
        """Closes the innermost element of this name and what it holds. One inside a line never closes a block."""
        if self.blocks[name] if block else self.inline[-1][name]:
            while self.pop() != name:
                pass

    def leave_paragraph(self) -> None:
        """A paragraph ends where the next block starts, whatever is open in it."""
        open_ = self.inline[-1].total() if self.blocks["p"] else 0
        if self.blocks["p"] and self.stack[-1 - open_].name == "p":
            self.close("p", True)


def blocks(page: str) -> list[tuple[int, int, str]]:
    """The page's blocks in order, without those the markup names as chrome, each with the number of the outermost article
    or main element and of the outermost container of the content that it is in."""
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    tree, made = Tree(), 0

    def end_block() -> None:
        if held:
            if line := " ".join(html.unescape("".join(held)).split()):
                out.append((tree.top.main, tree.top.content, line))
            held.clear()

    at = 0
    while at < len(page):
        if (mark := page.find("<", at)) < 0:
            mark = len(page)
        dropped = tree.top.dropped
        if mark > at and not dropped:
            held.append(page[at:mark])
        if not (m := _TAG.match(page, mark)):
            if mark < len(page) and not dropped:
                held.append("<")
            at = mark + 1
            continue
        if m["note"] is not None:
            close = page.find("-->", m.end())
            at = len(page) if close < 0 else close + 3
            continue
        rest = _REST.match(page, m.end())
        at = rest.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        block = name in BLOCKS or name in DROPPED
        if block:
            end_block()
        if m["close"]:
            tree.close(name, block)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            at = _REST.match(page, close.end() - 1).end() if close else len(page)
            continue
        if name in VOID or rest[0].endswith("/>"):
            continue
        if block:
            tree.leave_paragraph()
        if name in CLOSED_BY and tree.top.name in CLOSED_BY[name]:
            tree.pop()
        around, (chrome, role, hidden, content) = tree.top, told(rest[0])
        own = name in MAIN
        if name in ("html", "body") or own and not around.main:
            gone = False
        else:
            gone = name in DROPPED or hidden or block and (chrome or role)
        made += 1
        tree.open(Open(name, block, around.dropped or gone, around.main or made * own, around.content or made * (content and block and not own)))
    end_block()
    return out


def article(found: list[tuple[int, int, str]]) -> list[str] | None:
    """The lines of the article, if the markup tells it."""
    mains: Counter[int] = Counter()
    contents: Counter[int] = Counter()
    apart: Counter[int] = Counter()
    for main, content, line in found:
        mains[main] += len(line) * (main > 0)
        contents[content] += len(line) * (content > 0)
        apart[content] += len(line) * (content > 0 and not main)
    longest = max(mains.values(), default=0)
    which, sizes = (1, contents) if max(apart.values(), default=0) > longest else (0, mains)
    longest = max(sizes.values(), default=0)
    return [x[2] for x in found if x[which] and 3 * sizes[x[which]] >= longest] if longest else None


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes of a's lines in a longest common subsequence of a and b."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(line, len(codes)) for line in lines], np.int64) for lines in (a, b))
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[-1 - end] == y[-1 - end]:
        end += 1
    found = {*range(start), *range(len(x) - end, len(x))}
    x, y = x[start : len(x) - end], y[start : len(y) - end]
    common = np.intersect1d(x, y)
    own = np.flatnonzero(np.isin(x, common))
    found.update(start + int(own[i]) for i in aligned(x[own], y[np.isin(y, common)]))
    return found


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the longest common subsequences of x and each prefix of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for code in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == code, row[:-1] + 1, 0)))
    return row


def aligned(x: np.ndarray, y: np.ndarray, at: int = 0) -> list[int]:
    """Indexes of x in a longest common subsequence of x and y. Both are halved again and again (Hirschberg), so memory
    grows with their lengths and not with the product."""
    if len(x) <= 1 or not len(y):
        return [at] if len(x) and (y == x[0]).any() else []
    half = len(x) // 2
    cut = int((lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
    return aligned(x[:half], y[:cut], at) + aligned(x[half:], y[cut:], at + half)


@dataclass
class Page:
    page_id: int | None
    url: str | None
    host: str
    path: str
    sure: bool  # the page has an article
    lines: list[str]
    edge: int = 0  # 1: its neighbour before is in another range, 2: the one after, 3: both
    others: tuple[tuple[str, list[str]] | None, ...] = (None, None)  # path and lines of the neighbours before and after

    def text(self) -> str:
        if self.sure or not self.lines:
            return "\n".join(self.lines)
        near = [o for o in self.others if o]
        if not near:
            return "\n".join(self.lines)
        best = max(near, key=lambda o: common_start(self.path, o[0]))  # the first, if equal
        gone = shared_lines(self.lines, best[1])
        return "\n".join(line for i, line in enumerate(self.lines) if i not in gone)


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def parsed(page_id: int | None, url: str | None, host: str, path: str, page: str | None) -> Page:
    found = blocks(page or "")
    lines = article(found)
    return Page(page_id, url, host, path, lines is not None, [x[2] for x in found] if lines is None else lines)


def linked(pages: Iterator[Page]) -> Iterator[Page]:
    """Sets neighbours from the order; the first and the last page are edges."""
    before, now = None, next(pages, None)
    first = True
    while now is not None:
        after = next(pages, None)
        now.others = tuple((o.path, o.lines) if o is not None and o.host == now.host else None for o in (before, after))
        now.edge = first | (after is None) << 1
        yield now
        first, before, now = False, now, after


HOST, PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"
_PAGE = "page_id long, url string, host string, path string, lines array<string>, edge int, path0 string, lines0 array<string>, path1 string, lines1 array<string>, range int"


def _rows(pages: Iterator[Page]) -> Iterator[pa.RecordBatch]:
    """A page that is done has its text as its only line; an edge keeps its lines and those of the neighbour it knows."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.int32()]
    names = ["page_id", "url", "host", "path", "lines", "edge", "path0", "lines0", "path1", "lines1", "range"]
    here = TaskContext.get().partitionId()

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kind) for i, kind in enumerate(kinds)], names)

    held: list[tuple] = []
    for p in pages:
        if p.edge:
            (path0, lines0), (path1, lines1) = (o or (None, None) for o in p.others)
            held.append((p.page_id, p.url, p.host, p.path, p.lines, p.edge, path0, lines0, path1, lines1, here))
        else:
            held.append((p.page_id, p.url, p.host, p.path, [p.text()], 0, None, None, None, None, here))
        if len(held) >= 500:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")).alias("path"),
        "html",
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                few = b.slice(at, 256)
                found = [parsed(*row) for row in zip(*(c.to_pylist() for c in few.columns), strict=True)]
                more = [pa.array([p.sure for p in found]), pa.array([[p.text()] if p.sure else p.lines for p in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*few.columns[:4], *more], ["page_id", "url", "host", "path", "sure", "lines"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
        for b in batches:
            for page_id, url, host, path, lines, *known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path0, lines0, path1, lines1 = known or (None, None, None, None)
                yield Page(page_id, url, host, path, False, lines, 0, (None if lines0 is None else (path0, lines0), None if lines1 is None else (path1, lines1)))

    lines = written(keyed.mapInArrow(lean(parse), "page_id long, url string, host string, path string, sure boolean, lines array<string>"), "lines")
    ordered = lines.where("not sure").drop("sure").repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    done = written(ordered.mapInArrow(lean(lambda batches: _rows(linked(read(batches)))), _PAGE), "texts")
    edges = done.where("edge > 0")
    ranges = edges.select("range").distinct()
    along = Window.orderBy("range")  # a number for each range is all that this window sees
    near = ranges.select("range", F.lag("range").over(along).alias("last"), F.lead("range").over(along).alias("next"))
    side = lambda i, name: edges.where(F.col("edge").bitwiseAND(F.lit(2 - i)) > 0).select(F.col("range").alias(name), F.col("host").alias(f"host_{i}"), F.col("path").alias(f"path_{i}"), F.col("lines").alias(f"lines_{i}"))
    paired = edges.join(near, "range").join(side(0, "last"), "last", "left").join(side(1, "next"), "next", "left")
    other = [F.when(F.col("edge").bitwiseAND(F.lit(1 + i)) > 0, F.when(F.col(f"host_{i}") == F.col("host"), F.col(f"{c}_{i}"))).otherwise(F.col(f"{c}{i}")).alias(f"{c}{i}") for i in (0, 1) for c in ("path", "lines")]
    rest = paired.select("page_id", "url", "host", "path", "lines", *other).mapInArrow(lean(lambda batches: _rows(read(batches))), _PAGE)
    found = lines.where("sure").select("page_id", "url", "lines").union(done.where("edge = 0").select("page_id", "url", "lines")).union(rest.select("page_id", "url", "lines"))
    return found.select("page_id", "url", F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("text"))
