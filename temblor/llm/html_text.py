"""Main text of HTML pages: page differencing finds the template lines, markup is the prior.

A page is cut into the text lines of its blocks. Menus, adverts and the like that are known by their
elements, roles and class names go at once, and of a page with an ``article`` or ``main`` element all
that is outside. Then every page is compared with the page of the nearest URL of the host: both pages'
lines are aligned by their longest common subsequence. Shared lines are template, not text.

Markup says how much that is worth. Of a page without an article all shared lines go. Copies of an
article and passages that many articles quote are common, so an article loses only those shared lines
that most articles of the host share with their own partners.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from temblor.llm.graph import settle
from temblor.llm.url_filters import host_of, path_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Elements by what they mean for a reader.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript template xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset(
    "nav footer aside form button select option datalist dialog menu svg canvas object audio video map head".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promoted promotion "
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead header footer cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations widget comment comments reply replies respond disqus toolbar "
    "pagination pager hidden".split())
_HOLDERS = frozenset("content main article body wrapper container page layout with has no without".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
HOST_PAGES = 8  # articles of a host that may tell its template
FEW = 2_000_000  # so many numbers are sent to all tasks at most
_SCOPES = frozenset("article main section div td th li blockquote body html table ul ol dl aside nav header footer form".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def _is_noise(name: str, attributes: dict[str, str]) -> bool:
    if name in _DROPPED:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    for key in ("class", "id"):
        for one in attributes.get(key, "").split():
            parts = {p.lower() for p in _NAME.findall(one)}
            if parts & _NOISE and not parts & _HOLDERS:
                return True
    return False


def page_lines(source: str) -> list[tuple[bool, str]]:
    """(in the article, text) of each block with text, in page order, without marked noise."""
    lines: list[tuple[bool, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, noise, article, article header
    where = (False, False, False)  # noise, article, in an article's header

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                lines.append((where[1], text))
            held.clear()

    def enter(name: str, noise: bool, article: bool, header: bool) -> None:
        nonlocal where
        stack.append((name, *where))
        where = (where[0] or noise, where[1] or article, header)

    def leave(depth: int) -> None:
        nonlocal where
        where = stack[depth][1:]
        del stack[depth:]

    def find(name: str, bounded: bool) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                return i
            if bounded and stack[i][0] in _SCOPES:
                return None
        return None

    at = 0
    while True:
        match = _TOKEN.search(source, at)
        end = match.start() if match else len(source)
        if end > at and not where[0]:
            held.append(source[at:end])
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue  # a comment or a declaration
        name = match[2].lower()
        if name in _RAW:
            if not match[1]:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            continue
        if name == "br":
            held.append(" ")
            continue
        block = name not in _INLINE
        if block:
            flush()
        if match[1]:
            depth = find(name, False)
            if depth is not None:
                leave(depth)
            continue
        if block:
            # A block ends an open paragraph, an item an open item.
            depth = find("p", True)
            if depth is None and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                depth = find(name, True) if name != "li" else next(
                    (i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("li", "ul", "ol")), None)
                if depth is not None and stack[depth][0] != name:
                    depth = None
            if depth is not None:
                leave(depth)
        if name in _VOID:
            continue
        attributes = _attributes(match[3]) if match[3].strip() else {}
        noise = _is_noise(name, attributes)
        article = not where[0] and not noise and (
            name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
            or attributes.get("itemprop", "").lower() == "articlebody")
        header = where[2]
        if name == "header":
            # A site's header goes; of an article's header the headings stay.
            noise, header = noise or not where[1], where[1]
        if where[2] and name not in _HEADINGS and name not in _INLINE and name not in ("div", "hgroup", "section"):
            noise = True
        enter(name, noise, article, header)
    flush()
    return lines


def _line_hash(text: str | bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


def _ends(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    places = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list) -> list[int]:
    """Indices into ``a`` of a longest common subsequence with ``b``. Memory grows with the lengths,
    not with their product: long sequences are halved first."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    head, tail = list(range(start)), list(range(len(a) - stop, len(a)))
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return head + tail
    if len(a) == 1:
        return head + ([start] if a[0] in b else []) + tail
    middle = len(a) // 2
    split = int(np.argmax(_ends(a[:middle], b) + _ends(a[middle:][::-1], b[::-1])[::-1]))
    left = shared_lines(a[:middle], b[:split])
    right = shared_lines(a[middle:], b[split:])
    return head + [start + i for i in left] + [start + middle + i for i in right] + tail


def _lines(source: str | None) -> tuple[bool, list[str]]:
    """(marked, lines) of a page: those of its article, or all if no article is marked."""
    found = page_lines(source or "")
    inside = [t for article, t in found if article]
    return bool(inside), inside or [t for _, t in found]


def _key(hashes: list[int]) -> int:
    return _line_hash(np.array(hashes, np.int64).tobytes())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with text as the hashes of their lines."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            kept, marked, keys, hashes = [], [], [], []
            for i, source in enumerate(part.column("html").to_pylist()):
                article, lines = _lines(source)
                if lines:
                    own = [_line_hash(t) for t in lines]
                    kept.append(i)
                    marked.append(article)
                    keys.append(_key(own))
                    hashes.append(own)
            rows = part.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("host"), rows.column("path"), pa.array(marked, pa.bool_()), pa.array(keys, pa.int64()),
                 pa.array(hashes, pa.list_(pa.int64()))], names=["host", "path", "marked", "key", "hashes"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the lines that a page shares, in order, with its partner."""
    for batch in batches:
        found = []
        for own, other in zip(batch.column("hashes").to_pylist(), batch.column("other").to_pylist()):
            found.append([] if not other or set(own).isdisjoint(other) else sorted(shared_lines(own, other)))
        yield batch.select(["host", "marked", "key", "hashes"]).append_column("places", pa.array(found, pa.list_(pa.int32())))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their lines and their key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            marked, lines, keys = [], [], []
            for source in part.column("html").to_pylist():
                article, found = _lines(source)
                marked.append(article)
                lines.append(found)
                # Pages without text are spread over all tasks.
                keys.append(_key([_line_hash(t) for t in found]) if found else _line_hash(source or ""))
            yield part.select(["page_id", "url", "host"]).append_column("marked", pa.array(marked, pa.bool_())).append_column(
                "key", pa.array(keys, pa.int64())).append_column("lines", pa.array(lines, pa.list_(pa.string())))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text that is left without the template's lines."""
    for batch in batches:
        texts = []
        for marked, lines, places in zip(*(batch.column(c).to_pylist() for c in ("marked", "lines", "places"))):
            gone = set(places or ())
            left = [t for i, t in enumerate(lines) if i not in gone]
            # An article is more than its template: one that loses most of itself is quoted or copied.
            if marked and 2 * sum(map(len, left)) < sum(map(len, lines)):
                left = lines
            texts.append(" ".join(left))
        yield batch.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Blocks of the main text are joined by one space, white space inside them is one space, character
    references are decoded. ``n_chars`` counts code points. Null or empty html gives an empty text.

    Every page is aligned with the page of the host whose path is nearest: the neighbour in path order
    that shares more leading segments (the one before, if equal), of pages with other lines; first among
    paths with the same first segment, else among the first pages of the host's segments. Pages with a
    marked article and pages without are aligned among themselves. Pages with equal lines are one page
    here, so a copy cannot empty its original. Without a neighbour all lines stay.

    A page without a marked article loses all lines that it shares, in order, with its partner. An
    article loses those of them that so many articles of its host share with their partners too:
    half of at least ``HOST_PAGES``. It keeps them if they are more than half of its text. Repeated
    rows and null ids are pages of their own; empty tables give no rows.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    own = rows.select("host", "path", "html").mapInArrow(
        _hashed, "host string, path string, marked boolean, key bigint, hashes array<bigint>")
    single = settle(own.groupBy("host", "marked", "key").agg(F.min("path").alias("path"), F.any_value("hashes").alias("hashes")))
    slim = single.select("host", "marked", "key", "path", F.substring_index(F.substring("path", 2, 1_000_000), "/", 1).alias("segment"))

    def nearest(frame: DataFrame, keys: list[str]) -> DataFrame:
        """``other``, the key of the neighbour in path order. Lines are not sorted along."""
        order = Window.partitionBy(*keys).orderBy("path", "key")
        # Leading segments that two paths share; -1 without a neighbour.
        def common(other):
            mine, theirs = F.split("path", "/"), F.split(other, "/")
            equal = F.zip_with(mine, theirs, lambda x, y: F.coalesce(x == y, F.lit(False)))
            first = F.array_position(equal, F.lit(False))
            return F.when(other.isNull(), -1).when(first == 0, F.size(mine)).otherwise(first - 1)

        before, after = F.lag("path").over(order), F.lead("path").over(order)
        frame = frame.withColumns({"_b": common(before), "_a": common(after), "_kb": F.lag("key").over(order),
                                   "_ka": F.lead("key").over(order)})
        return frame.withColumn("other", F.when((F.col("_b") >= F.col("_a")) & (F.col("_b") >= 0), F.col("_kb")).otherwise(F.col("_ka"))).drop(
            "_b", "_a", "_kb", "_ka")

    pool = ["host", "marked"]
    close = nearest(slim, [*pool, "segment"])
    firsts = slim.groupBy(*pool, "segment").agg(F.min(F.struct("path", "key")).alias("m")).select(*pool, "m.path", "m.key")
    far = nearest(slim.join(firsts, [*pool, "path", "key"], "left_semi"), pool).select(*pool, "key", F.col("other").alias("far"))
    partners = close.join(far, [*pool, "key"], "left").select(*pool, "key", F.coalesce("other", "far").alias("other"))
    partners = partners.filter("other is not null")
    theirs = single.select(*pool, F.col("key").alias("other"), F.col("hashes").alias("_other"))
    pairs = single.select(*pool, "key", "hashes").join(partners, [*pool, "key"]).join(theirs, [*pool, "other"]).select(
        *pool, "key", "hashes", F.col("_other").alias("other"))
    shared = settle(pairs.mapInArrow(
        _difference, "host string, marked boolean, key bigint, hashes array<bigint>, places array<int>").filter(F.size("places") > 0))

    # What differencing found, counted over the host: lines that most of its articles share are template.
    found = shared.filter("marked").select("host", "key", F.explode("places").alias("place"), "hashes").select(
        "host", "key", "place", F.col("hashes")[F.col("place")].alias("line"))
    of_host = single.filter("marked").groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOST_PAGES)
    often = found.groupBy("host", "line").agg(F.countDistinct("key").alias("m")).join(of_host, "host").filter("2 * m >= n")
    template = found.join(often, ["host", "line"], "left_semi").groupBy("host", "key").agg(F.collect_list("place").alias("places"))
    gone = settle(template.select("host", F.lit(True).alias("marked"), "key", "places").unionByName(
        shared.filter("not marked").select(*pool, "key", "places")))

    read = rows.select("page_id", "url", "host", "html").mapInArrow(
        _keyed, f"page_id {kind}, url string, host string, marked boolean, key bigint, lines array<string>")
    # Few lines are sent to the pages' readers; for more the pages are shuffled.
    if (gone.agg(F.sum(F.size("places") + 10)).first()[0] or 0) <= FEW:
        gone = F.broadcast(gone)
    text = read.join(gone, [*pool, "key"], "left").select("page_id", "url", "marked", "lines", "places").mapInArrow(
        _joined, f"page_id {kind}, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("bigint"))
