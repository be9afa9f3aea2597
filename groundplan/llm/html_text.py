"""Main text of web pages: each page is compared with the nearest pages of its host, by URL path; shared lines and shared structure go.

A line is known by the path of its blocks (tags and names) and its text. The lines of a page are aligned by longest common subsequence with those of the page before
and of the page after on the host, in the order of paths. What is left of all three, the unshared text, tells where texts stand: the body of
the text is the deepest container that holds over half of it. Lines of other containers that stand in the same place on both neighbours, and hold little
beside it, are frame, whatever they say; lines that both neighbours share are frame too. Names and tags (nav, `class="ad"`) decide where structure
can't: within the body, in elements that the neighbours lack, and on pages without a neighbour or without such a container.

There, elements that are frames by their tag or name are dropped, and lines within an article or main element are marked by the page as its text
and stay. Of the others, those that both neighbours share are deleted (on a host of two pages, those that the other one shares). If under LEFT
characters would be left, the pages are copies of one text and not texts in one frame, and nothing is deleted. Unmarked lines that are left are part of the text
if the marked ones are no more than half of it.

Pages are dealt into ranges of (host, path, page_id), so a host with a third of all pages is many ranges. The first and last page of each range go to the
range beside it as well, so the result does not depend on where ranges end.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements that hold no text of the page, and frames by their tag.
DROPPED = frozenset("form label script style noscript template iframe button select textarea svg title dialog object canvas".split())
FRAMES = frozenset("nav footer aside".split())
#: Blocks that can be the body of a text.
CONTAINERS = frozenset("html body div section article main header footer nav aside address".split())
PAGE = frozenset("html body".split())
#: Of the body's unshared text, what another container has at most to be a frame.
BESIDE = 1 / 2
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th blockquote pre section article main header footer nav aside figure figcaption hr body html form address".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FRAME = frozenset("ad ads advert adverts advertisement sponsored promo banner sidebar menu nav navbar navigation footer comment comments discussion cookie cookies consent notice popup modal newsletter subscribe share social related breadcrumb breadcrumbs masthead topbar disqus complementary contentinfo".split())
#: Words that say nothing of what a name is for: `ad-slot` is a frame, `related-work` is none.
PLAIN = frozenset("slot box block wrapper wrap container area bar widget section list links link item items top bottom left right site page unit inner outer user users thread threads post posts button buttons text label labels".split())
MAIN = ("article", "main")
#: Characters that must be left of a page for lines to be deleted.
LEFT = 20
#: Bits of rows that an alignment holds at once (16 MB).
HELD = 1 << 27
#: Bytes of html of a range, ranges at most (they are larger then), and pages for each range in the sample that tells where ranges end.
RANGE, RANGES, SAMPLE = 8 << 20, 1 << 16, 4
#: Elements whose end tag may be missing: the start tags that end one, and the elements within it that keep them from doing so.
_CELL, _ROW = frozenset("td th tr tbody thead tfoot".split()), frozenset("tr tbody thead tfoot".split())
OPTIONAL = {"p": (BLOCKS, frozenset())} | {"li": (frozenset({"li"}), frozenset({"ul", "ol"}))} | {t: (frozenset({"dt", "dd"}), frozenset({"dl"})) for t in ("dt", "dd")}
OPTIONAL |= {t: (_CELL, frozenset({"table"})) for t in ("td", "th")} | {"tr": (_ROW, frozenset({"table"})), "option": (frozenset({"option", "optgroup"}), frozenset())}
#: Elements whose end tag ends such an element within them.
OUTER = (BLOCKS | {"tbody", "thead", "tfoot", "optgroup"}) - {"p"}
_SPACE = re.compile(r"\s+")
#: Numbers of pages in names, which do not tell blocks apart.
_NUMBER = re.compile(r"\d{3,}")


class Line(NamedTuple):
    text: str
    inner: bool  # in an article or main element
    named: bool  # in a frame by its tag or name
    path: tuple[str, ...]  # its blocks, from the outermost


class Lines(HTMLParser):
    """Text lines of a page outside of elements that hold none. Without names, frames are lines like others, and no line is inner."""

    def __init__(self, names: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.names = names
        self.lines: list[Line] = []
        self.held: list[str] = []
        self.framed: list[str] = []  # text of a frame
        self.open: list[str] = []
        self.blocks: list[tuple[str, str]] = []  # open blocks: tag, tag with names
        self.dropped: str | None = None  # tag of the outermost dropped element, and how many of its kind are open
        self.frame = False  # it is a frame by tag or name, whose lines are kept apart
        self.depth = self.inner = self.hidden = 0
        self.within: list[str] = []  # open elements of a dropped one with an optional end tag, itself first

    def end_line(self) -> None:
        for held, named in ((self.held, False), (self.framed, True)):
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                self.lines.append(Line(text, self.inner > 0, named, tuple(name for _, name in self.blocks)))
            if named or not self.dropped:
                held.clear()

    def begin_block(self, tag: str, names: list[str]) -> None:
        while self.blocks and tag in OPTIONAL.get(self.blocks[-1][0], (frozenset(),))[0]:
            self.blocks.pop()
        self.blocks.append((tag, ".".join([tag, *sorted(_NUMBER.sub("", w) for w in names)])))

    def end_block(self, tag: str) -> None:
        if any(t == tag for t, _ in self.blocks):
            while self.blocks.pop()[0] != tag:
                pass

    def drop(self, tag: str, frame: bool) -> None:
        self.dropped, self.depth, self.within, self.frame, self.hidden = tag, 1, [tag], frame, 0

    def leave(self) -> None:
        if self.frame:
            held, self.held = self.held, []
            self.end_line()
            self.held = held
            self.end_block(self.dropped)
        self.dropped, self.frame = None, False

    def in_frame(self, tag: str, names: list[str], begins: bool) -> None:
        """Blocks and lines of a frame."""
        if tag in DROPPED:
            self.hidden += 1 if begins else -1
        elif tag in BLOCKS:
            held, self.held = self.held, []
            self.end_line()
            self.held = held
            if begins and tag not in VOID:
                self.begin_block(tag, names)
            elif not begins and (tag != self.dropped or self.depth > 1):
                self.end_block(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()]
        words = [set(re.split(r"[^a-z]+", w)) - {""} for w in names]
        if self.dropped in OPTIONAL:
            ends, keeps = OPTIONAL[self.dropped]
            if tag not in ends or not keeps.isdisjoint(self.within):
                if self.frame:
                    self.in_frame(tag, names, True)
                if tag not in VOID:
                    self.within.append(tag)
                return
            self.leave()
        if self.dropped:
            if self.frame:
                self.in_frame(tag, names, True)
            self.depth += tag == self.dropped
            return
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        frame = any(w & FRAME and w <= FRAME | PLAIN for w in words)
        if tag in DROPPED or self.names and (tag in FRAMES or (tag == "header" and not self.inner) or (tag not in ("main", "body", "html") and frame)):
            self.drop(tag, tag not in DROPPED)
            if self.frame and tag in BLOCKS:
                self.begin_block(tag, names)
            return
        if tag in BLOCKS:
            self.begin_block(tag, names)
        if tag in MAIN and self.names:
            self.inner += 1
        if tag in OUTER:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped in OPTIONAL:
            if tag in self.within:
                if self.frame:
                    self.in_frame(tag, [], False)
                while self.within.pop() != tag:
                    pass
                if not self.within:
                    self.leave()
                return
            if tag not in self.open:
                return
            self.leave()
        if self.dropped:
            if self.frame:
                self.in_frame(tag, [], False)
            self.depth -= tag == self.dropped
            if not self.depth:
                self.leave()
            return
        if tag in BLOCKS:
            self.end_line()
            self.end_block(tag)
        if tag in MAIN and self.inner:
            self.inner -= 1
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped in OPTIONAL and tag in VOID:
            self.handle_starttag(tag, attrs)
        elif not self.dropped and tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.held.append(data)
        elif self.frame and not self.hidden:
            self.framed.append(data)


def all_lines(html: str | None, names: bool = True) -> list[Line]:
    parser = Lines(names)
    parser.feed(html or "")
    parser.close()
    if parser.dropped:
        parser.leave()
    parser.end_line()
    return parser.lines


def lines_of(html: str | None) -> list[tuple[str, bool]]:
    """The lines that are in no frame by tag or name, each with whether it is in an article or main element."""
    return [(x.text, x.inner) for x in all_lines(html) if not x.named]


def _places(b: list) -> dict:
    """The places of each line of b, as bits."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    return where


def _lengths(a: list, b: list) -> np.ndarray:
    """Of b[:j], for each j, the length of a longest common subsequence with a."""
    where, full = _places(b), (1 << len(b)) - 1
    row = full
    for line in a:  # a zero bit j: the length grows at b[j]
        u = row & where.get(line, 0)
        row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_lines(a: list, b: list, most: int = HELD) -> set[int]:
    """Places in a of a longest common subsequence with b, by bits of whole rows; a pair that needs over most bits is cut in two where lengths of both halves add up to the most."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) * len(b) > most and len(a) > 1:
        half = len(a) // 2
        j = int((_lengths(a[:half], b) + _lengths(a[: half - 1 : -1], b[::-1])[::-1]).argmax())
        first, second = common_lines(a[:half], b[:j], most), common_lines(a[half:], b[j:], most)
        return out | {lo + i for i in first} | {lo + half + i for i in second}
    where, full = _places(b), (1 << len(b)) - 1
    row, rows = full, []
    for line in a:
        rows.append(row)
        u = row & where.get(line, 0)
        row = ((row + u) | (row - u)) & full
    j = len(b)
    for i in range(len(a) - 1, -1, -1):
        height = lambda r, k: k - (r & ((1 << k) - 1)).bit_count()
        now = height(row, j)
        if height(rows[i], j) < now:
            while height(row, j - 1) == now:
                j -= 1
            j -= 1
            out.add(lo + i)
        row = rows[i]
    return out


def named_text(own: list[tuple[str, bool]], beside: list[list[tuple[str, bool]]]) -> str:
    """The text of a page from its lines outside of named frames, and those of the pages beside it."""
    outer = [k for k, (_, inner) in enumerate(own) if not inner]
    if outer and beside:
        lines = [own[k][0] for k in outer]
        shared = set.intersection(*(common_lines(lines, [text for text, inner in other if not inner]) for other in beside))
        left = [k for j, k in enumerate(outer) if j not in shared]
        marked = sum(len(text) for text, inner in own if inner)
        if marked + sum(len(own[k][0]) for k in left) >= LEFT:
            outer = left
    marked = sum(len(text) for text, inner in own if inner)
    if marked > sum(len(own[k][0]) for k in outer):
        return "\n\n".join(text for text, inner in own if inner)
    keep = set(outer)
    return "\n\n".join(text for k, (text, inner) in enumerate(own) if inner or k in keep)


def containers(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The containers of a line, from the outermost."""
    return [path[: k + 1] for k, block in enumerate(path) if block.split(".")[0] in CONTAINERS]


def body_of(pages: list[list[Line]]) -> tuple[tuple[str, ...] | None, dict[tuple[str, ...], int]]:
    """The deepest container that holds over half of the text of pages, and the characters of all containers. None if that is the page itself, or there is none."""
    held: dict[tuple[str, ...], int] = {}
    for line in (x for page in pages for x in page):
        for c in containers(line.path):
            held[c] = held.get(c, 0) + len(line.text)
    total = sum(len(x.text) for page in pages for x in page)
    most = [c for c, n in held.items() if 2 * n > total]
    best = max(most, key=len, default=None)
    return (None if best is None or best[-1].split(".")[0] in PAGE else best), held


def main_text(own: list[Line], beside: list[list[Line]]) -> str:
    """The text of a page from its lines and those of the pages beside it."""
    known = lambda x: (x.path, x.text)
    shared: set[int] = set()
    if beside:
        lines = list(map(known, own))
        shared = set.intersection(*(common_lines(lines, list(map(known, other))) for other in beside))
    mine = set(map(known, own))
    body, held = body_of([[x for k, x in enumerate(own) if k not in shared], *([x for x in other if known(x) not in mine] for other in beside)])
    plain = lambda lines: [(x.text, x.inner) for x in lines if not x.named]
    if body is None or not (beside or any(x.inner for x in own) or not any(x.named for x in own)):
        return named_text(plain(own), [plain(other) for other in beside])
    places = [{x.path for x in other} for other in beside]
    within, around = [], []
    for k, x in enumerate(own):
        if x.path[: len(body)] == body:
            if not x.named:
                within.append(k)
        elif not x.named and k not in shared:
            outer = containers(x.path)
            aside = [c for c in outer if c != body[: len(c)]]
            stands = beside and all(x.path in p for p in places)
            if x.inner or not (aside and stands and held.get(aside[0], 0) <= BESIDE * held[body]):
                around.append(k)
    size = lambda places: sum(len(own[k].text) for k in places)
    if size(within) + size(around) < LEFT or not within:
        return named_text(plain(own), [plain(other) for other in beside])
    # what stands around a body that the page marks itself, or alone, is no part of it if it is less
    marked = any(own[k].inner for k in within)
    if marked and size(within) > size(around):
        around = []
    return "\n\n".join(own[k].text for k in sorted(within + around))


def _in_ranges(bounds: list[tuple]):
    """Adds the number of the range that a row is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in ("host", "path", "place")), strict=True)
            number = pa.array([bisect.bisect_right(bounds, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, number], names=[*batch.schema.names, "range"])

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, host, path; border rows (of the ranges beside) are compared with, and give no row."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def extracted() -> Iterator[tuple]:
        before = here = None
        for page_id, url, html, host, range_, border in rows():
            after = (page_id, url, border, (range_, host), all_lines(html))
            if here and not here[2]:
                yield here[0], here[1], main_text(here[4], [x[4] for x in (before, after) if x and x[3] == here[3]])
            before, here = here, after
        if here and not here[2]:
            yield here[0], here[1], main_text(here[4], [before[4]] if before and before[3] == here[3] else [])

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        page_ids, urls, texts = zip(*held, strict=True)
        arrays = [pa.array(page_ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    held, size = [], 0
    for row in extracted():
        held.append(row)
        size += len(row[2])
        if size > 1 << 20 or len(held) == 1024:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def extract_text(pages: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text; null URLs share a host of their own; pages without a page_id come first on a path; repeated rows give
    repeated rows. Only page_id, url and html are read. An empty table gives an empty table. The ranges' ends come from a few pages for
    each range and the borders are one page on each side of it: neither changes the result.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.coalesce("page_id", F.lit(-(1 << 62))).alias("place"))
    size, rows = keyed.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)), F.count("*")).first()
    n = min(max(-(-size // range_bytes), 1), RANGES)
    key = ["host", "path", "place"]
    wanted, name = max(SAMPLE * n, 4096), F.xxhash64("page_id", "url")
    # about four times as many rows are looked at, so that tasks hand few to the driver
    some = keyed.where(F.pmod(name, F.lit(max(1, rows // (4 * wanted)))) == 0)
    sample = sorted({tuple(r) for r in some.select(*key, name.alias("name")).orderBy("name", "place", "path").limit(wanted).select(*key).collect()})
    bounds = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
    fields = "page_id long, url string, html string, host string, path string, place long, range int"
    keys = keyed.select(*key).mapInArrow(_in_ranges(bounds), "host string, path string, place long, range int")
    ends = keys.groupBy("range").agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last")).orderBy("range").collect()  # RANGES rows at most
    across = [x for a, b in zip(ends[:-1], ends[1:], strict=True) if a["first"] is not None and a["last"].host == b["first"].host for x in ((*a["last"], b["range"]), (*b["first"], a["range"]))]
    borders = spark.createDataFrame(across, "host string, path string, place long, target int")
    rows = keyed.select("page_id", "url", "html", *key).mapInArrow(_in_ranges(bounds), fields).select("page_id", "url", "html", *key, "range", F.lit(False).alias("border"))
    beside = keyed.join(F.broadcast(borders), key).select("page_id", "url", "html", *key, F.col("target").alias("range"), F.lit(True).alias("border"))
    ordered = rows.union(beside).repartition(n, "range").sortWithinPartitions("range", *key)
    return ordered.select("page_id", "url", "html", "host", "range", "border").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
#: SQL has no HTML parser; the tests compare with hand-made pages and with a plain version for the given pages.
ORACLES: dict[str, str] = {}
