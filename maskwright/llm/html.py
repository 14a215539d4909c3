"""Main text of web pages by nearest-URL page differencing.

Pages are paired by URL path within each host: of the pages before and after it
in the order of paths, a page is compared with the one that shares the longer
beginning of its path.  Their text lines are aligned by a longest common
subsequence, and the lines that both share are boilerplate and go.

Markup bears on that in two ways.  A line inside an article or main element
belongs to the article even where a neighbour repeats it, so those elements veto
the deletion.  And boilerplate that differs from page to page, which no neighbour
can show, is known by its element: menus, footers, sidebars, forms, adverts,
comments.  Inside an article a mere name that may mean such a thing (``related``,
``discussion``) counts only where the neighbour shares the line too.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from maskwright.llm.urls import url_parts

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg select".split())
NEVER = frozenset("nav header footer aside form button dialog menu head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Words of a class, id, role or label that may name something other than the article.
OTHER = re.compile(
    r"(?:^|[\s_-])(?<!with-)(?<!has-)(?<!no-)(?:ad|ads|advert|adverts|advertisement|advertising|adbox|banner|sponsor|sponsored|promo|promoted|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|sidebar|side-bar|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|commentlist|reply|replies|respond|disqus|discussion|widget|toolbar|pagination|pager|skip|search|masthead|copyright|toc|tags|contentinfo|complementary|alert)(?:$|[\s_-]|\d)",
    re.I,
)
#: Whole class names or ids that name an advert or readers' comments, within an article too.
SURELY = re.compile(r"(?:^|\s)(?:ads?|advert|adverts|advertisement|advertising|sponsored|comments?|commentlist|disqus)(?:[-_](?:slot|box|unit|banner|block|container|wrapper|thread|list|section|area|form|item|body|\d+))*(?:$|\s)", re.I)
#: Those that name the article.
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|article-body|main-content|post-content|entry-content)(?:$|[\s_-])", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*)(?P<rest>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/><]*)(?P<rest2>[^<>]*)>?",  # quotes that do not pair
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Cells of an alignment, in bits, whose rows are kept at once; a larger one is halved first.
CELLS = 1 << 26
#: A range of neighbouring pages holds about so many bytes of HTML, and a task about four ranges.
RANGE_BYTES = 8 << 20
#: Ranges at most; beyond that they grow.  Their bounds go to every task.
RANGES = 1 << 15
#: Characters of a host and of a path that a bound keeps.
BOUND = 256
#: Lines of links that follow one another from so many on are a list of links.
LINKS = 3


@dataclass
class Line:
    text: str
    #: 2 inside an article element, 1 inside a main element or one whose class says so, 0 elsewhere.
    main: int
    #: 2 inside an element that is never the article's, 1 inside one of an article whose name may mean so.
    other: int
    #: Share of characters inside links.
    linked: float = 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _role(tag: str, attrs: dict[str, str], depth: int) -> tuple[int, int]:
    """How strongly an element is the article, and how surely it is something else; ``depth`` is how strongly its parents are the article."""
    if tag in ("html", "body"):
        return 0, 0
    named = " ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""), attrs.get("aria-label", ""))).strip() if attrs else ""
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", ""))):
        return 0, 2
    surely = bool(named) and any(SURELY.search(attrs.get(k, "")) for k in ("class", "id"))
    if tag == "article":
        return (0, 2) if surely else (2, 0)
    if tag == "main":
        return 1, 0
    if tag == "header" and depth == 2:  # an article's own header holds its title
        return 0, 0
    if tag in NEVER or surely and tag not in HEADINGS:
        return 0, 2
    if named:
        if OTHER.search(named) and tag not in HEADINGS:
            return 0, 1 if depth else 2
        if attrs.get("role") == "main" or MAIN.search(named):
            return 1, 0
    return 0, 0


def lines(page: str) -> list[Line]:
    """The text blocks of a page in order, white space folded and character references decoded.

    Broken markup is taken as it comes: an end tag closes what is open down to
    its element, a stray one nothing; what is never closed ends with the page.
    """
    out: list[Line] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, main so far, elements surely and maybe of other kinds open
    text: list[str] = []
    linked = links = main = other = maybe = muted = 0
    at, low = 0, None

    def flush() -> None:
        nonlocal text, linked
        if text:
            folded = " ".join("".join(text).split())
            if folded:
                out.append(Line(folded, main, 2 if other else 1 if maybe else 0, min(1.0, linked / len(folded))))
            text, linked = [], 0

    def write(s: str) -> None:
        nonlocal linked
        if s and not muted:
            s = entities.unescape(s) if "&" in s else s
            text.append(s)
            if links:
                linked += len(s.strip())

    def pop_to(index: int) -> None:
        nonlocal main, other, maybe, links, muted
        while len(stack) > index:
            tag, was_main, was_other, was_maybe = stack.pop()
            if tag in BLOCK:
                flush()
            if tag == "a":
                links -= 1
            if other > was_other and tag not in BLOCK:
                muted -= 1
            main, other, maybe = was_main, was_other, was_maybe

    find = TOKEN.finditer(page)
    for m in find:
        if m.start() < at:
            continue
        write(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"] or m["tag2"]):
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P or tag == "p":
                for i in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                peers = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for i in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                    if stack[i][0] in peers:
                        pop_to(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "tr") and stack[i][0] != tag:
                        break
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            continue
        gain, is_other = _role(tag, _attributes(rest), main)
        stack.append((tag, main, other, maybe))
        main, other, maybe = max(main, gain), other + (is_other == 2), maybe + (is_other == 1)
        muted += is_other == 2 and tag not in BLOCK  # a button, say, within a paragraph
        if tag == "a":
            links += 1
    write(page[at:])
    pop_to(0)
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    What agrees at both ends is cut first.  The rest is aligned by bit-parallel
    rows (Hyyro), one whole number of len(b) bits for each line of ``a``.  Where
    the rows would take more than CELLS bits, ``a`` is halved where the lengths
    from both sides add up to the most (Hirschberg), so memory stays bounded.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.add(i_end)
        if i == i_end or j == j_end:
            continue
        if i_end - i == 1 or (i_end - i) * (j_end - j) <= CELLS:
            out |= {i + x for x in _aligned(a[i:i_end], b[j:j_end])}
            continue
        half = (i + i_end) // 2
        before = _lengths(a[i:half], b[j:j_end])
        after = _lengths(a[half:i_end][::-1], b[j:j_end][::-1])[::-1]
        cut = j + max(range(j_end - j + 1), key=lambda k: before[k] + after[k])
        todo += [(i, half, j, cut), (half, i_end, cut, j_end)]
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each line of ``a`` a number of len(b) bits: bit y is zero if the common subsequence of the lines so far and b[: y + 1] is longer than that with b[:y]."""
    where: dict[int, int] = {}
    for y, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << y
    every = row = (1 << len(b)) - 1
    for line in a:
        hit = row & where.get(line, 0)
        row = (row + hit | row - hit) & every
        yield row


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for bit in reversed(format(row, f"0{len(b)}b")):
        out.append(out[-1] + (bit == "0"))
    return out


def _aligned(a: list[int], b: list[int]) -> list[int]:
    rows, out, y = list(_rows(a, b)), [], len(b)
    x = len(a)
    while x and y:
        if rows[x - 1] >> (y - 1) & 1:
            y -= 1
        elif x > 1 and not rows[x - 2] >> (y - 1) & 1:
            x -= 1
        else:
            x, y = x - 1, y - 1
            out.append(x)
    return out


def kept(found: list[Line], shared: set[int]) -> list[str]:
    """The lines of the main text: those in no element of another kind, that are not shared with the neighbour unless an article or main element holds them, and that belong to no list of links outside of such elements."""
    lists: set[int] = set()
    run: list[int] = []
    for i, x in enumerate([*found, Line("", 0, 0)]):
        if x.main == 0 and x.linked >= 0.8:
            run.append(i)
            continue
        if len(run) >= LINKS:
            lists.update(run)
        run = []
    return [x.text for i, x in enumerate(found) if x.other < 2 and not (x.other and i in shared) and (x.main or i not in shared and i not in lists)]


def nearer(path: str, before: str | None, after: str | None) -> int:
    """Which of two neighbours, 0 or 1, has a path with the longer common beginning; the one before if they are alike."""
    begun = [-1 if p is None else len(commonprefix((path, p))) for p in (before, after)]
    return int(begun[1] > begun[0])


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


@dataclass
class Page:
    host: str
    path: str
    lines: list[Line]
    digests: list[int]
    #: page_id and url of the rows that are this page: several where neighbours are alike in all lines.
    rows: list[tuple]


def differenced(pages: Iterable[Page]) -> Iterator[tuple]:
    """Rows (page_id, url, text, n_chars, n_shared, n_cut) of pages in order of host and path; pages without rows are guests, which only take part.

    Neighbours that are alike in all lines are one page here, as copies show no
    boilerplate.  Three pages are held at a time.
    """

    def finished(page: Page, before: Page | None, after: Page | None) -> Iterator[tuple]:
        near = [p for p in (before, after) if p is not None and p.host == page.host]
        if len(near) == 2:
            near = [near[nearer(page.path, near[0].path, near[1].path)]]
        shared = common_lines(page.digests, near[0].digests) if near else set()
        text = kept(page.lines, shared)
        cut = len(kept(page.lines, set())) - len(text)
        whole = "\n\n".join(text)
        for page_id, url in page.rows:
            yield page_id, url, whole, len(whole), len(shared), cut

    before = held = None
    for page in pages:
        if held is not None and held.host == page.host and held.digests == page.digests:
            held.rows += page.rows
            continue
        if held is not None:
            yield from finished(held, before, page)
        before, held = held, page
    if held is not None:
        yield from finished(held, before, None)


def _order(page_id) -> tuple:
    """A key that sorts ids as Spark does, null first."""
    return (0,) if page_id is None else (1, page_id)


def _bounds(keys: DataFrame, n_bytes: int) -> tuple[list[tuple], int]:
    """The least keys of ranges of ``keys(host, path, page_id)`` but the first, and how many tasks to use.

    RANGES bounds at most, of BOUND characters of host and path; where either is
    longer, the bound is its beginning alone.
    """
    least = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(4 * least, n_bytes // RANGE_BYTES), RANGES)
    low = keys.repartitionByRange(n, "host", "path", "page_id").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("host", "path", "page_id")).alias("low"))
    short = F.struct(F.left("low.host", F.lit(BOUND + 1)).alias("host"), F.left("low.path", F.lit(BOUND + 1)).alias("path"), F.col("low.page_id").alias("page_id"))
    rows = low.select(short.alias("low"), "range").orderBy("range").collect()
    bounds = []
    for r in rows[1:]:
        host, path, page_id = r["low"]
        bounds.append((host[:BOUND],) if len(host) > BOUND else (host, path[:BOUND]) if len(path) > BOUND else (host, path, _order(page_id)))
    return bounds, max(least, n // 4)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_cut`` of every row of ``pages(page_id, url, html)``: n_shared lines are the nearest page's too, and n_cut lines go for that reason alone.

    Pages are ordered by host, path and page_id and cut into ranges of about
    RANGE_BYTES; the page at either end of a range is copied into the next one,
    so that a page meets both its neighbours wherever the cuts fall, on hosts of
    any size.  The bounds come from the keys alone, so the pages are shuffled
    once.  Null html is an empty page, a null url one without host and path; a
    page alone on its host shares nothing; repeated rows have the same text.  Rows
    of a page whose copies fill a range and more see no neighbour beyond them.
    """
    host, path, _ = url_parts(F.coalesce("url", F.lit("")))
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    n_bytes = keyed.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    keys = keyed.select("host", "path", "page_id")
    bounds, tasks = _bounds(keys, n_bytes)

    @F.arrow_udf("int")
    def place(hosts: pa.Array, paths: pa.Array, page_ids: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, (h.as_py(), p.as_py(), _order(i.as_py()))) for h, p, i in zip(hosts, paths, page_ids, strict=True)], pa.int32())

    # the page at either end of each range, known by a digest: one that collides is copied needlessly, and its order tells it apart
    key = F.struct("host", "path", "page_id")
    ends = keys.withColumn("chunk", place("host", "path", "page_id")).groupBy("chunk").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    found = ends.select("chunk", *(F.xxhash64(f"{e}.host", f"{e}.path", f"{e}.page_id").alias(e) for e in ("low", "high"))).orderBy("chunk").collect()
    before = {r["chunk"]: at["chunk"] for at, r in zip(found, found[1:], strict=False)}
    after = {at["chunk"]: r["chunk"] for at, r in zip(found, found[1:], strict=False)}
    lows, highs = {r["chunk"]: r["low"] for r in found if r["chunk"] in before}, {r["chunk"]: r["high"] for r in found if r["chunk"] in after}

    @F.arrow_udf("array<int>")
    def guest_in(chunks: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for k, d in zip(chunks.to_pylist(), digests.to_pylist(), strict=True):
            out.append([c[k] for c, e in ((before, lows), (after, highs)) if e.get(k) == d])
        return pa.array(out, pa.list_(pa.int32()))

    placed = keyed.withColumn("chunk", place("host", "path", "page_id")).withColumn("guests", guest_in("chunk", F.xxhash64("host", "path", "page_id")))
    at = F.concat(F.array(F.struct("chunk", F.lit(False).alias("guest"))), F.transform("guests", lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("guest"))))
    dealt = placed.select("page_id", "url", "html", "host", "path", F.explode(at).alias("at")).select("page_id", "url", "html", "host", "path", "at.*")
    near = dealt.repartition(tasks, "chunk").sortWithinPartitions("chunk", "host", "path", "page_id")
    ids = to_arrow_type(pages.schema["page_id"].dataType)
    schema = pa.schema([("page_id", ids), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64()), ("n_cut", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed() -> Iterator[tuple[int, Page]]:
            for batch in batches:
                for page_id, url, page, host, path, chunk, guest in zip(*(batch.column(c) for c in ("page_id", "url", "html", "host", "path", "chunk", "guest")), strict=True):
                    found = lines(page.as_py())
                    yield chunk.as_py(), Page(host.as_py(), path.as_py(), found, [_digest(x.text) for x in found], [] if guest.as_py() else [(page_id.as_py(), url.as_py())])

        rows, size = [], 0
        for _, own in groupby(parsed(), key=itemgetter(0)):
            for row in differenced(page for _, page in own):
                rows.append(row)
                size += len(row[2])
                if size > 4 << 20 or len(rows) > 5000:
                    yield batch_of(rows)
                    rows, size = [], 0
        yield batch_of(rows)

    def batch_of(rows) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    kind = pages.schema["page_id"].dataType.simpleString()
    return near.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_shared bigint, n_cut bigint")


def op10_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, how many of its lines the nearest page shares, and how many go for that reason alone."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
