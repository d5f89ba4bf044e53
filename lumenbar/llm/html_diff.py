"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path and id, so that a page's neighbours come from the
same section and template. A page is aligned with other articles among the ``NEAR`` pages
before it and behind it by a longest common subsequence of text lines, and shared lines are
template: inside what the markup calls the article a line goes if all of them (two at least)
share it, since articles quote each other; anywhere else if the nearest on either side does
(the two nearest where one side has none). A neighbour that holds nearly the same lines
(``TWIN``) is the same article published again and says nothing about the template.

Lines that the markup names as menu, header, footer, sidebar, notice, advert, form or comment
go with or without a neighbour, because templates that rotate their menus, adverts and
notices do not repeat them on the next page. Inside an article the name of a class counts
only as a whole: ``ad-box`` is chrome there, ``art-share-price`` is not.

Defined results: NULL html is empty; pages without text give the empty text; rows that repeat
id and page are one page and get the same text; NULL urls form one host of their own; an empty
table gives no rows. Texts are neither cut nor capped, and do not depend on how the rows are
partitioned. Only id, url and html are read. Rows that repeat one id and url stay in one task.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbar.llm.common import whole, workers_of

# Element names of HTML by what they mean for the text.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "math")
CHROME = frozenset(
    "nav header footer aside form menu dialog button select option label fieldset head "
    "object canvas".split()
)
#: What holds the whole page or its article is not chrome, whatever its class says.
WHOLE = frozenset("html body main article".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert form menu menubar".split()
)
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login sidebar side aside widget related recommended menu nav navbar navigation "
    "breadcrumb breadcrumbs header footer masthead copyright social share sharing comment comments "
    "disqus reply replies respond toolbar pagination pager skip".split()
)
#: Words that may stand beside those above in a name that is chrome as a whole.
PLAIN_WORDS = frozenset(
    "area bar block bottom box button container content group inner item left link links list "
    "main page panel post right section site slot small top wrap wrapper".split()
)
# End of fixed values.

#: Pages on each side that are asked at most.
NEAR = 3
#: Two pages whose lines differ in no more than this share of their characters are one article.
TWIN = 0.1

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")

#: What a line is: in the article, elsewhere, or in a part that the markup names as chrome.
ARTICLE, OPEN, NAMED = 2, 1, 0


def _names_chrome(name: str, inside: bool) -> bool:
    words = [w.lower() for w in WORDS.findall(name)]
    if not any(w in CHROME_WORDS for w in words):
        return False
    return not inside or all(w in CHROME_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words)


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether markup names an element as chrome; ``inside`` an article only whole names do."""
    if tag in CHROME:
        return True
    if not attributes or tag in WHOLE:
        return False
    for kind, a, b, c in NAMES.findall(attributes):
        value = a or b or c
        if kind.lower() == "role":
            if value.lower() in CHROME_ROLES:
                return True
        elif any(_names_chrome(name, inside) for name in value.split()):
            return True
    return bool(HIDDEN.search(attributes))


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """Text lines of a page, one a block, in page order, and where each stands."""
    lines: list[str] = []
    places: list[int] = []
    text: list[str] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, chrome, article
    chrome = article = 0
    at, end = 0, len(page)

    def flush() -> None:
        if text:
            line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                lines.append(line)
                places.append(NAMED if chrome else ARTICLE if article else OPEN)

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == tag:
                    flush()
                    for _, was_chrome, was_article in open_tags[depth:]:
                        chrome -= was_chrome
                        article -= was_article
                    del open_tags[depth:]
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in INLINE and not (m[3] and _is_chrome(tag, m[3], article > 0)):
            continue
        flush()
        if tag in VOID or (m[3] or "").endswith("/"):
            continue
        entry = (tag, _is_chrome(tag, m[3], article > 0), tag in ("article", "main"))
        open_tags.append(entry)
        chrome += entry[1]
        article += entry[2]
    flush()
    return lines, places


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCS lengths of ``a`` with every beginning of ``b``, by bit vectors."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & full
    bits = np.unpackbits(
        np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little"
    )[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal beginnings and ends are taken off first; the middle is halved again and again,
    so memory stays linear for pages of any number of lines.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if (b[b0:b1] == a[a0]).any():
                out.append(a0)
            continue
        middle = (a0 + a1) // 2
        ahead = _last_row(a[a0:middle], b[b0:b1])
        behind = _last_row(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(ahead + behind))
        todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return sorted(out)


class Page:
    """One page as its neighbours see it: lines, places, characters and one hash a line."""

    def __init__(self, path: str, lines: list[str], places: list[int]) -> None:
        self.host, self.lines, self.places = path.split("/", 1)[0], lines, places
        self.hashes = np.array([hash(x) for x in lines], np.int64)
        sizes = np.array([len(x) for x in lines], np.int64)
        self.sizes = np.where(np.array(places, np.int64) != NAMED, sizes, 0)
        self.size = int(self.sizes.sum())

    def shared(self, other: Page) -> set[int]:
        return set(common_lines(self.hashes, other.hashes))

    def unlike(self, other: Page) -> bool:
        """Whether the pages' lines, but for named chrome, are those of two articles."""
        small, large = sorted((self.size, other.size))
        if small < (1 - TWIN) * large:
            return True
        own = int(self.sizes[np.isin(self.hashes, other.hashes)].sum())
        its = int(other.sizes[np.isin(other.hashes, self.hashes)].sum())
        return own < (1 - TWIN) * self.size or its < (1 - TWIN) * other.size


def kept_text(page: Page, before: list[Page], behind: list[Page]) -> str:
    """The page's lines that are neither named chrome nor template.

    ``before`` and ``behind`` are pages of its host, nearest first.
    """
    sides = [[x for x in side if page.unlike(x)] for side in (before, behind)]
    places = set(page.places)
    template: set[int] = set()
    if OPEN in places:
        nearest = [side[0] for side in sides if side]
        if len(nearest) == 1:
            nearest += [x for side in sides for x in side[1:2]]
        shared = set().union(*(page.shared(x) for x in nearest))
        template.update(i for i in shared if page.places[i] == OPEN)
    every = [x for side in sides for x in side]
    if ARTICLE in places and len(every) > 1:
        # most pages have no line that stands on every other: no need to align them
        if set(page.hashes.tolist()).intersection(*(x.hashes.tolist() for x in every)):
            shared = set.intersection(*(page.shared(x) for x in every))
            template.update(i for i in shared if page.places[i] == ARTICLE)
    return " ".join(
        line
        for i, (line, place) in enumerate(zip(page.lines, page.places))
        if place != NAMED and i not in template
    )


def _order(path: str, page_id: object) -> tuple:
    """Sort key that orders as Spark does, NULL ids first."""
    return path, page_id is not None, page_id


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last ``NEAR`` keys of a sorted range, and its number among the ranges."""
    from pyspark import TaskContext

    first: list[tuple] = []
    last: deque[tuple] = deque(maxlen=NEAR)
    fields = None
    for batch in batches:
        fields = [batch.schema.field(0), batch.schema.field(1)]
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last and last[-1] == key:
                continue
            last.append(key)
            if len(first) < NEAR:
                first.append(key)
    if fields:
        keys = [*first, *last]
        part = TaskContext.get().partitionId()
        columns = [pa.array([k[i] for k in keys], fields[i].type) for i in (0, 1)]
        ends = [i >= len(first) for i in range(len(keys))]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(ends), pa.array([part] * len(keys), pa.int32())],
            ["path", "id", "is_end", "part"],
        )


class Ranges:
    """Upper ends of the ranges of (path, id), and the ranges a key is lent to as neighbour."""

    def __init__(self, rows: list) -> None:
        found: dict[int, tuple[list, list]] = {}
        for r in rows:
            found.setdefault(r["part"], ([], []))[r["is_end"]].append(_order(r["path"], r["id"]))
        sides = [(sorted(first), sorted(last)) for _, (first, last) in sorted(found.items())]
        self.ends = [last[-1] for _, last in sides]
        self.lent: dict[tuple, set[int]] = {}
        for i in range(len(sides)):
            for others, pick in ((range(i), slice(-NEAR, None)), (range(i + 1, len(sides)), slice(NEAR))):
                # as many ranges away as it takes to see NEAR keys: ranges may be short
                keys: set[tuple] = set()
                for j in reversed(others) if others.stop == i else others:
                    keys.update(sides[j][others.stop == i])
                    if len(keys) >= NEAR:
                        break
                for key in sorted(keys)[pick]:
                    self.lent.setdefault(key, set()).add(i)

    def of(self, key: tuple) -> int:
        """The range of a key; one behind all ends belongs to the last."""
        return min(bisect_left(self.ends, key), len(self.ends) - 1)


def _parsed(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Lines of each page, compressed, for its range and those it is lent to."""
    import hashlib
    import zlib

    for batch in batches:
        rows: list[tuple] = []
        for page_id, url, path, html in zip(*(batch.column(i) for i in range(4))):
            key = _order(path.as_py(), page_id.as_py())
            raw = html.as_py()
            packed = zlib.compress(json.dumps(lines_of(raw)).encode(), 3)
            mark = hashlib.blake2b(raw.encode(), digest_size=8).digest()
            part = ranges.of(key)
            for to in {part} | ranges.lent.get(key, set()):
                rows.append((page_id.as_py(), url.as_py(), key[0], mark, packed, to, to == part))
        kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[i] for r in rows], kind)
                for i, kind in enumerate([*kinds, pa.int32(), pa.bool_()])
            ],
            ["id", "url", "path", "mark", "lines", "part", "own"],
        )


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of ranges in order; each is compared with those before and behind it.

    ``2 * NEAR + 1`` pages are held at a time, and the urls of rows that repeat one of them.
    """
    import zlib

    kind = pa.int64()

    def pages():
        """(range and host, page, rows): a page once, with the rows that repeat it."""
        nonlocal kind
        last = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for page_id, url, path, mark, lines, part, own in zip(*(batch.column(i) for i in range(7))):
                key = (part.as_py(), path.as_py(), page_id.as_py(), mark.as_py())
                if last is None or last[0] != key:
                    if last:
                        yield last
                    page = Page(key[1], *json.loads(zlib.decompress(lines.as_py())))
                    last = key, page, []
                if own.as_py():
                    last[2].append((key[2], url.as_py()))
        if last:
            yield last

    out: tuple[list, list, list] = ([], [], [])
    size = 0
    behind: deque = deque()
    before: deque = deque(maxlen=NEAR)
    for nxt in chain(pages(), [None] * NEAR):
        behind.append(nxt)
        if len(behind) <= NEAR:
            continue
        now = behind.popleft()
        if now is None:
            continue
        key, page, rows = now
        if rows:
            sides = [
                [x[1] for x in side if x and x[0][0] == key[0] and x[1].host == page.host]
                for side in (reversed(before), behind)
            ]
            text = kept_text(page, *sides)
            for page_id, url in rows:
                for column, value in zip(out, (page_id, url, text)):
                    column.append(value)
                size += len(text)
                if size > 1 << 20 or len(out[0]) >= 512:
                    yield _batch(out, kind)
                    out, size = ([], [], []), 0
        before.append(now)
    if out[0]:
        yield _batch(out, kind)


def _batch(columns: tuple[list, list, list], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
        ["id", "url", "text"],
    )


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    A first pass over ids and urls alone finds ranges of (path, id), so a host with a third of
    all pages is spread over many tasks; the first and last pages of a range are lent to the
    ranges beside it. The driver holds ``2 * NEAR`` keys a range. Pages are parsed once, and
    their compressed lines cross the network once.
    """
    url = F.col(url_col)
    rest = F.regexp_replace(F.lower(whole(url)), r"^[a-z]+://(www\.|m\.)?|[?#].*$", "")
    source = pages.select(
        F.col(id_col).alias("id"),
        url.alias("url"),
        F.regexp_replace(rest, r"/+$", "").alias("path"),
        whole(F.col(html_col)).alias("html"),
    )
    kind = source.schema["id"].dataType.simpleString()
    n = workers_of(pages)
    edges = (
        source.select("path", "id")
        .repartitionByRange(n, "path", "id")
        .sortWithinPartitions("path", "id")
        .mapInArrow(_edges, f"path string, id {kind}, is_end boolean, part int")
    )
    ranges = Ranges(edges.collect())
    if not ranges.ends:
        return source.select(
            F.col("id").alias(id_col), F.col("url").alias(url_col),
            F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"),
        )
    return (
        source.mapInArrow(
            lambda batches: _parsed(batches, ranges),
            f"id {kind}, url string, path string, mark binary, lines binary, part int, own boolean",
        )
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "path", "id", "mark")
        .mapInArrow(_differenced, f"id {kind}, url string, text string")
        .select(
            F.col("id").alias(id_col),
            F.col("url").alias(url_col),
            "text",
            F.length("text").cast("long").alias("n_chars"),
        )
    )
