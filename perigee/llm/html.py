"""Operator 4, HTML extraction: nearest-URL page differencing.

1. A page becomes a list of text lines (blocks), each with its place: inside an element that says
   what it is (article, main: content; nav, header, footer, aside, form, script, ... or a class or
   id that names menus, adverts, notices, sidebars or comments: not content), or unmarked.
2. Pages of a host are paired with the nearest page by URL path: in the order of (host, path)
   the neighbour with the longer common path.  Row numbers come from a range partitioning with
   summed counts, so a host with a third of all pages is never sorted in one task; each page's
   lines travel to at most two neighbours.
3. The lines of the two pages are aligned by their longest common subsequence; unmarked lines on
   it are template text and go, the others stay, whether or not the page marks an article.  Lines
   that an element marks as content stay even if shared (two articles may quote the same passage),
   lines marked otherwise go even if not shared.  A class, id or role of an article or main element
   itself (``main.has-sidebar``) says nothing about its lines.  Below an article or main, a ``header`` and a
   class that is no furniture throughout (``social-history``, ``legal``) are in doubt: their lines go only
   where they are shared, as the unmarked do.
   Where everything unmarked and everything marked as content is shared (a copy of the page),
   differencing says nothing and the unmarked lines stay.

The alignment hashes lines and uses Hunt and Szymanski's method after cutting the common start and
end, with memory in proportion to the number of equal line pairs, unique lines first.

Null or empty html, and html without text, give an empty text; a null url pairs with nothing;
repeated pages are rows of their own; empty tables give empty results; extra columns are not read.
Broken markup is read as far as it goes: an unclosed element ends with its parent.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import written

# Elements by role, and words in a class, id or role attribute that name page furniture.
SKIP = frozenset("script style noscript template svg math iframe object canvas select textarea button datalist".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
ROOTS = frozenset("html body".split())
BLOCKS = frozenset(
    """address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html li main nav ol p pre section table tbody tfoot thead tr ul center details summary caption""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SPACED = frozenset("br td th".split())
NAMES = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|"
    r"nav|navigation|navbar|menu|breadcrumbs?|sidebar|widget|related|share|sharing|social|comments?|respond|reply|replies|"
    r"disqus|footer|header|masthead|toolbar|pagination|pager|search|login|signup|skip|legal|copyright)(?![a-z])"
)
# Words that only say how a piece of furniture is laid out, and names that an article's own parts bear too.
LAYOUT = frozenset("area bar block body box button buttons container content form group icons inner item items link links list module panel post posts section slot top bottom left right unit wrap wrapper".split())
DOUBTFUL = frozenset("header notice menu social search skip legal copyright banner login signup reply replies toolbar".split())
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|"
    + TAG + r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|" + TAG + r"([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
BARE_SLASH = re.compile(r"=\s*[^\s\"'>]*/$")  # the slash ends an unquoted value, not the tag
WHITE = re.compile(r"\s+")

CONTENT_LINE, OPEN_LINE, FURNITURE_LINE = 2, 1, 0


def surely_furniture(marks: str) -> bool:
    """Whether one of the names is furniture throughout (``ad-slot``, ``comments``), not in part or in doubt."""
    for name in marks.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        named = [x for x in parts if NAMES.fullmatch(x)]
        if set(named) - DOUBTFUL and all(x in LAYOUT or x in named for x in parts):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, place) of the blocks of a page in order; the place is one of the three constants."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # element, place inside it
    articles = 0  # open elements that mark content
    place = OPEN_LINE

    def flush() -> None:
        if buffer:
            text = WHITE.sub(" ", unescape("".join(buffer))).strip()
            if text:
                out.append((text, place))
            buffer.clear()

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the second: unbalanced quotes
        if not name:
            continue
        name = name.lower()
        if name in SPACED:
            buffer.append(" ")
        if closing:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    outside = stack[k - 1][1] if k else OPEN_LINE
                    if outside != place:
                        flush()
                    articles -= sum(e in CONTENT for e, _ in stack[k:])
                    del stack[k:]
                    place = outside
                    break
            continue
        if name in BLOCKS:
            flush()
        for other in CLOSES.get(name, ()):
            if stack and stack[-1][0] == other:
                stack.pop()
                place = stack[-1][1] if stack else OPEN_LINE
        if name in VOID or (rest.endswith("/") and not BARE_SLASH.search(rest)):
            continue
        if name in SKIP:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        marks = " ".join(v for a in ATTRIBUTE.finditer(rest) for v in a.groups()[1:] if v).lower()
        named = marks and name not in ROOTS and name not in CONTENT and NAMES.search(marks)
        element = name in FURNITURE and not (articles and name == "header")
        if place == FURNITURE_LINE or element or HIDDEN.search(rest) or (named and (not articles or surely_furniture(marks))):
            inside = FURNITURE_LINE
        elif named or name == "header":
            inside = OPEN_LINE
        else:
            inside = CONTENT_LINE if name in CONTENT else place
        if inside != place:
            flush()
        stack.append((name, inside))
        articles += name in CONTENT
        place = inside
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of two lists of line hashes."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    keep = set(range(start)) | set(range(len(a) - stop, len(a)))
    where: dict[int, list[int]] = {}
    for j in range(start, len(b) - stop):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple] = []  # (place in a, link before it)
    for i in range(start, len(a) - stop):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        keep.add(link[0])
        link = link[1]
    return keep


def main_text(lines: list[str], places: list[int], shared: set[int]) -> str:
    """The lines that are content, joined; ``shared``: those on the alignment with the paired page."""
    template = {k for k in shared if places[k] == OPEN_LINE}
    unmarked = [k for k, p in enumerate(places) if p == OPEN_LINE]
    own = [k for k in unmarked if k not in template]
    if not own and all(k in shared for k, p in enumerate(places) if p == CONTENT_LINE):
        own = unmarked  # a copy of the page
    stays = {*own, *(k for k, p in enumerate(places) if p == CONTENT_LINE)}
    return "\n\n".join(x for k, x in enumerate(lines) if k in stays)


def line_hash(line: str) -> int:
    return zlib.crc32(line.encode("utf-8", "replace")) | (len(line) & 0x7FFFFFFF) << 32


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.xxhash64("page_id", "url", "html").alias("page_key"), "html"
    )


def page_hashes(pages: DataFrame) -> DataFrame:
    """url, page_key and the line hashes of every page."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = [[line_hash(t) for t, _ in lines_of(h or "")] for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64()))], ["url", "page_key", "hashes"]
            )

    keyed = _keyed(pages).select("url", "page_key", "html")
    return keyed.mapInArrow(run, "url string, page_key bigint, hashes array<bigint>")


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, url, page_key, lines, places of every page; the text of furniture lines is left out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [lines_of(h or "") for h in part.column(3).to_pylist()]
            lines = [[t if p != FURNITURE_LINE else "" for t, p in ls] for ls in found]
            places = [[p for _, p in ls] for ls in found]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in range(3)), pa.array(lines, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int8()))],
                ["page_id", "url", "page_key", "lines", "places"],
            )

    return _keyed(pages).mapInArrow(
        run, "page_id bigint, url string, page_key bigint, lines array<string>, places array<tinyint>"
    )


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(page_key, near_key): the page of the same host with the nearest URL path, where there is one.

    ``pages`` has url and page_key.  Equal keys (repeated pages) count once.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    keyed = pages.where("url IS NOT NULL").select("page_key", host.alias("host"), path.alias("path")).distinct()
    ranged = written(
        keyed.repartitionByRange("host", "path", "page_key").withColumn("part", F.spark_partition_id()), "html-order"
    )
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per partition
    before = counts.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS before")
    numbered = written(
        ranged.withColumn("k", F.expr("row_number() OVER (PARTITION BY part ORDER BY host, path, page_key)"))
        .join(F.broadcast(before), "part")
        .select("host", "path", "page_key", (F.col("before") + F.col("k")).alias("place")),
        "html-places",
    )
    nxt = numbered.select(
        F.col("host").alias("host2"), F.col("path").alias("path2"), F.col("page_key").alias("key2"), (F.col("place") - 1).alias("place")
    )
    pairs = numbered.join(nxt, "place").where("host = host2")
    common = F.length(F.regexp_extract(F.concat("path", F.lit("\n"), "path2"), r"^(.*).*\n\1", 1))
    pairs = pairs.withColumn("common", common)
    both = pairs.select("page_key", F.col("key2").alias("near_key"), "common", F.lit(0).alias("after")).unionByName(
        pairs.select(F.col("key2").alias("page_key"), F.col("page_key").alias("near_key"), "common", F.lit(1).alias("after"))
    )
    return (
        both.groupBy("page_key")
        .agg(F.max(F.struct("common", "after", "near_key")).alias("m"))
        .select("page_key", F.col("m.near_key").alias("near_key"))
    )


def shared_lines(hashed: DataFrame) -> DataFrame:
    """(page_key, shared): places of the lines that a page shares with its nearest page, in order."""
    own = hashed.select("page_key", "hashes").dropDuplicates(["page_key"])
    pairs = (
        nearest_pages(hashed.select("url", "page_key"))
        .join(own, "page_key")
        .join(own.select(F.col("page_key").alias("near_key"), F.col("hashes").alias("near")), "near_key")
        .select("page_key", "hashes", "near")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            both = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
            shared = [sorted(common_lines(a, b)) for a, b in both]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared, pa.list_(pa.int32()))], ["page_key", "shared"])

    return pairs.mapInArrow(run, "page_key bigint, shared array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Pages are parsed twice, once for the hashes that pair and align them (narrow rows) and once for
    their text: cheaper than to keep all lines on disk between.
    """
    shared = shared_lines(written(page_hashes(pages), "html-hashes"))
    joined = page_lines(pages).join(shared, "page_key", "left").select("page_id", "url", "lines", "places", "shared")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cols = [part.column(k).to_pylist() for k in range(2, 5)]
            texts = [main_text(lines, places, set(found or ())) for lines, places, found in zip(*cols)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
