"""Main text of web pages: markup says what it can, a host's suffix array decides the rest.

Each page is parsed into text blocks with a zone: content (inside an article or main element), chrome (menus, headers,
footers, sidebars, adverts, forms and the like) or open (neither). Content stays whole and chrome goes; open blocks, on
pages with and without marked content, are decided by the repeats of their host. The token streams of the host's pages
are concatenated and their suffixes sorted; neighbours that share LENGTH tokens or more, of distinct pages, are long
repeats. Runs that repeats cover are cut out of open blocks, blocks covered as a whole go, unique runs stay. Near-equal
pages count as one, so copies of a page are no evidence against each other.

A host of more than TOKENS tokens or PAGES pages is never gathered: its suffixes are grouped by a hash of their first
LENGTH tokens, over all tasks, which finds the same repeats. Pages of hosts without open blocks are not shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import shared_table
from gatelake.llm.near_dedup import links_among, near_duplicates
from gatelake.llm.shingles import mix, shingle_sets, word_hashes

#: Tokens that a repeated substring has at least.
LENGTH = 8
#: Share of a block's tokens from which it counts as covered.
COVERED = 1.0
#: Tokens and pages of one host that one task sorts; the repeats of a larger host are found by shuffles.
TOKENS, PAGES = 500_000, 1024
#: Pages that share so many percent of their shingles of so many words, as links reach, are near-equal; chrome is left out.
WIDTH, PERCENT = 5, 90
#: Up to so many hosts with open blocks, their sizes are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000

CONTENT, OPEN, CHROME = 0, 1, 2

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SILENT = frozenset("script style noscript template title textarea svg math iframe object audio video canvas".split())
_END = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])", re.I) for tag in _SILENT}
_HOLDERS = frozenset("html head body article main section div span nav header footer aside form dialog menu ul ol dl table tr td th thead tbody figure details fieldset button select label a p blockquote".split())
_CHROME_TAGS = frozenset("head nav footer aside form dialog menu button select fieldset label".split())
_BLOCKS = frozenset(
    "html head body article main section div nav header footer aside form dialog menu ul ol dl li dt dd table caption thead tbody tfoot tr td th figure figcaption details summary fieldset p h1 h2 h3 h4 h5 h6 blockquote pre hr address".split()
)
_CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotion|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletters?|subscribe|subscription|sidebars?|side|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|topbar|toolbar|header|share|sharing|social|related|recommended|recommendations|comments?|commentlist|disqus|replies|respond|login|signup|paywall|pagination|pager|skip|search|tags|meta|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
_CONTENT_NAMES = re.compile(r"(?:^|\s)(?:article|post|entry|story|main|content)(?:[_-]?(?:body|content|text|main))?(?:$|\s)|articlebody", re.I)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


def _zone(tag: str, attributes: str, parent: int) -> int:
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = f"{got.get('class', '')} {got.get('id', '')}"
    if parent == CHROME or tag in _CHROME_TAGS or (tag == "header" and parent != CONTENT):
        return CHROME
    if got and ("hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")) or got.get("role", "").lower() in _CHROME_ROLES):
        return CHROME
    if names.strip() and tag not in ("html", "body") and _CHROME_NAMES.search(names):
        return CHROME
    if tag in ("article", "main") or got.get("role") == "main" or (names.strip() and tag in ("div", "section") and _CONTENT_NAMES.search(names)) or got.get("itemprop", "").lower() == "articlebody":
        return CONTENT
    return parent


def _markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Pieces of a page in order: text, then the tag that follows it as slash, lower-case name and attributes (empty for none).

    Each character is read a bounded number of times: what has no ``>`` is text, and after the first tag whose quotes do
    not close, quotes are no longer looked at.
    """
    at, n, last, tag_of = 0, len(page), page.rfind(">"), _TAG
    begin = 0  # of the text that has not been given out
    while 0 <= (lt := page.find("<", at)) < last:
        following = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[begin:lt], "", "", ""
            at = begin = n if end < 0 else end + 3
        elif following and following in "!?":
            yield page[begin:lt], "", "", ""
            at = begin = page.find(">", lt) + 1
        elif following.isascii() and (following.isalpha() or following == "/"):
            m = tag_of.match(page, lt)
            if m is None and tag_of is _TAG and _BARE_TAG.match(page, lt):
                tag_of = _BARE_TAG
                m = tag_of.match(page, lt)
            if m is None:
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if not m[1] and tag in _SILENT and not m[3].endswith("/"):
                end = _END[tag].search(page, at)
                close = page.find(">", end.end()) if end else -1
                yield page[begin:lt], "", "", ""
                at = n if close < 0 else close + 1
            else:
                yield page[begin:lt], m[1], tag, m[3]
            begin = at
        else:
            at = lt + 1
    end = page.find("<!--", begin)  # a comment that nothing closes
    yield page[begin : end if end >= 0 else n], "", "", ""


def blocks(page: str) -> list[tuple[str, int]]:
    """The page's text blocks in order, white space as one space, with their zones."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()  # tags on the stack
    zone = OPEN

    def close() -> None:
        if text := " ".join(html.unescape("".join(parts)).split()):
            out.append((text, zone))
        parts.clear()

    def back_to(k: int) -> int:
        for tag, _ in stack[k:]:
            held[tag] -= 1
        before = stack[k][1]
        del stack[k:]
        return before

    for text, slash, tag, attributes in _markup(page):
        if text:
            parts.append(text)
        if not tag:
            continue
        if tag in _BLOCKS:
            close()
        elif tag == "br":
            parts.append(" ")
        if tag not in _HOLDERS:
            continue
        if not slash:
            if tag == "p" and stack and stack[-1][0] == "p":
                zone = back_to(len(stack) - 1)
            if not attributes.endswith("/"):
                stack.append((tag, zone))
                held[tag] += 1
                zone = _zone(tag, attributes, zone)
        elif held[tag]:
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            if parts and zone != stack[k][1]:
                close()
            zone = back_to(k)
    close()
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts`` and the number of each text's first one."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)


def spread(hit: np.ndarray) -> np.ndarray:
    """Tokens that lie in a window that starts at a hit."""
    n = len(hit)
    edge = np.zeros(n + LENGTH, dtype=np.int64)
    edge[:n] += hit
    edge[LENGTH:] -= hit
    return np.cumsum(edge[:n]) > 0


def suffix_array(words: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a token stream in order, and for each how many tokens it shares with the one before it in that order.

    A suffix ends with its page. Ranks by the first 1, 2, 4, ... tokens are doubled until all differ; the shared length of
    neighbours is read off the same ranks, from the longest step to the shortest.
    """
    n = len(words)
    left = np.searchsorted(page, page, side="right") - np.arange(n)  # tokens to the end of the page; pages ascend
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < int(left.max(initial=0)) and int(ranks[-1].max(initial=0)) < n - 1:
        following = np.zeros(n, dtype=np.int64)
        on = np.flatnonzero(left > width)
        following[on] = ranks[-1][on + width] + 1
        ranks.append(np.unique(ranks[-1] * (n + 2) + following, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            step = 1 << k
            # Equal ranks of suffixes that are long enough mean equal tokens; shorter ones are told apart by smaller steps.
            same = (a < n) & (b < n)
            same[same] = (ranks[k][a[same]] == ranks[k][b[same]]) & (left[a[same]] >= step) & (left[b[same]] >= step)
            shared[1:] += step * same
            # At the end of its page a suffix has no more tokens.
            a, b = np.where(same, np.where(left[np.minimum(a, n - 1)] > step, a + step, n), a), np.where(same, np.where(left[np.minimum(b, n - 1)] > step, b + step, n), b)
    return order, shared


def repeats(words: np.ndarray, page: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Starts of substrings of LENGTH tokens or more that occur in pages of two different ``same``; both arrays give a token's page."""
    n = len(words)
    hit = np.zeros(n, dtype=bool)
    if n < LENGTH:
        return hit
    order, shared = suffix_array(words, page)
    run = np.cumsum(shared < LENGTH)  # neighbours that share LENGTH tokens are in one run
    low, high = np.full(n + 1, np.iinfo(np.int64).max), np.full(n + 1, -1)
    np.minimum.at(low, run, same[order])
    np.maximum.at(high, run, same[order])
    hit[order] = (high > low)[run]
    return hit


def covered_share(texts: list[str], zones: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Share of each block's tokens covered by repeats of LENGTH tokens in distinct pages; content counts as evidence and is never covered."""
    words, first = tokens(texts)
    page = np.repeat(pages, np.diff(first))
    return _shares(spread(repeats(words, page, page)) & np.repeat(zones != CONTENT, np.diff(first)), first)


def _shares(taken: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(taken)))
    return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)


def without_repeats(texts: list[str], hit: np.ndarray, first: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The texts of blocks without the runs that windows inside the block repeat, and the share of each block covered.

    ``hit`` marks the starts of repeated windows among the tokens. A window over the end of a block counts for the share
    alone: it takes blocks that are covered as a whole, and no words from the edge of others.
    """
    share = _shares(spread(hit), first)
    block = np.repeat(np.arange(len(texts)), np.diff(first))
    inside = hit.copy()
    inside[: max(0, len(hit) - LENGTH + 1)] &= block[LENGTH - 1 :] == block[: max(0, len(hit) - LENGTH + 1)]
    cut = spread(inside)
    out = list(texts)
    for k in np.unique(block[cut]).tolist():
        out[k] = " ".join(w for w, c in zip(texts[k].split(), cut[first[k] : first[k + 1]]) if not c)
    return out, share


def main_text(parsed: list[tuple[str, int]], share: np.ndarray) -> str:
    """Content blocks, and open ones that are not covered as a whole, in page order."""
    return "\n".join(t for (t, z), s in zip(parsed, share) if z == CONTENT or (z == OPEN and s < COVERED))


def page_text(parsed: list[tuple[str, int]], hit: np.ndarray, first: np.ndarray) -> str:
    """The text of one page; ``hit`` and ``first`` are of its own tokens. Only open blocks are cut."""
    if not is_open(parsed):
        return main_text(parsed, np.zeros(len(parsed)))
    cut, share = without_repeats([t for t, _ in parsed], hit, first)
    return main_text([(c if z == OPEN else t, z) for c, (t, z) in zip(cut, parsed)], share)


def is_open(parsed: list[tuple[str, int]]) -> bool:
    return any(z == OPEN for _, z in parsed)


def alike(texts: list[str]) -> np.ndarray:
    """A number for each page's text that near-equal pages share."""
    out = np.arange(len(texts))
    for a, b in links_among(list(shingle_sets(pa.array(texts, pa.string()), WIDTH)), PERCENT):
        out[out == out[b]] = out[a]
    return out


def window_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of LENGTH tokens, in order."""
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(LENGTH):
        h = mix(h + words[k : k + n])
    return h.view(np.int64)


def host_texts(parsed: list[list[tuple[str, int]]]) -> list[str]:
    """The texts of all pages of one host."""
    words, first = tokens([t for p in parsed for t, _ in p])
    page = np.repeat(np.repeat(np.arange(len(parsed)), [len(p) for p in parsed]), np.diff(first))
    hit = repeats(words, page, alike([" ".join(t for t, z in p if z != CHROME) for p in parsed])[page])
    out, b = [], 0
    for p in parsed:
        own = first[b : b + len(p) + 1]
        out.append(page_text(p, hit[own[0] : own[-1]], own - own[0]))
        b += len(p)
    return out


_PARSED = "row long, host string, page_id long, url string, open boolean, words long, texts array<string>, zones array<int>"
_RESULT = "page_id long, url string, text string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (row, host, page_id, url, html) as their blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            parsed = [blocks(x) for x in part.column(4).to_pylist()]
            texts = pa.array([[t for t, _ in p] for p in parsed], pa.list_(pa.string()))
            zones = pa.array([[z for _, z in p] for p in parsed], pa.list_(pa.int32()))
            n = pa.array([sum(t.count(" ") + 1 for t, _ in p) for p in parsed], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([is_open(p) for p in parsed], pa.bool_()), n, texts, zones], ["row", "host", "page_id", "url", "open", "words", "texts", "zones"])


def _host_pages(table: pa.Table) -> pa.Table:
    order = table.sort_by([("page_id", "ascending"), ("row", "ascending")])
    parsed = [list(zip(t, z)) for t, z in zip(order.column("texts").to_pylist(), order.column("zones").to_pylist())]
    return pa.table({"page_id": order.column("page_id"), "url": order.column("url"), "text": pa.array(host_texts(parsed), pa.string())})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each page (row, host, texts)."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, host, texts = (c[k].as_py() for c in batch.columns)
            found = np.unique(window_hashes(tokens(texts)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(found), t) for x, t in ((row, pa.int64()), (host, pa.string()))] + [pa.array(found, pa.int64())], ["row", "host", "window"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of each page (page_id, url, texts, zones, known); ``known`` are its repeated windows."""
    for batch in batches:
        out = []
        for texts, zones, known in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
            parsed = list(zip(texts, zones))
            if not known:
                out.append(main_text(parsed, np.zeros(len(parsed))))
                continue
            words, first = tokens(texts)
            hit = np.zeros(len(words), dtype=bool)
            found = window_hashes(words)
            hit[: len(found)] = np.isin(found, np.array(known, dtype=np.int64))
            out.append(page_text(parsed, hit, first))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _without_evidence(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", "texts", "zones", F.lit(None).cast("array<long>").alias("known")).mapInArrow(_texts, _RESULT)


def _large_hosts(parsed: DataFrame) -> DataFrame:
    """page_id, url and text of the pages of large hosts: suffixes are grouped by their first LENGTH tokens over the whole host."""
    # Words carry the host, so near-equal pages are of one.
    mark = F.concat(F.lit(" "), F.col("host"), F.lit("|"))
    said = F.transform(F.filter(F.arrays_zip("texts", "zones"), lambda b: b["zones"] != CHROME), lambda b: b["texts"])
    said = F.when(F.size(said) > 0, F.replace(F.concat(F.lit(" "), F.array_join(said, " ")), F.lit(" "), mark)).otherwise("")
    own = near_duplicates(parsed.select("row", said.alias("text")), id_col="row", width=WIDTH, percent=PERCENT)
    shape = "row long, host string, window long"
    windows = parsed.select("row", "host", "texts").mapInArrow(_windows, shape).join(own.select(F.col("doc_id").alias("row"), "component_id"), "row")
    twice = windows.groupBy("host", "window").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b")
    twice = shared_table(twice.select("host", "window"), "html_windows")
    asked = parsed.where("open").select("row", "host", "texts").mapInArrow(_windows, shape)
    known = asked.join(twice, ["host", "window"], "left_semi").groupBy("row").agg(F.collect_list("window").alias("known"))
    return parsed.join(known, "row", "left").select("page_id", "url", "texts", "zones", "known").mapInArrow(_texts, _RESULT)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text for each row of ``pages``; a page without main text, or without html, has an empty text.

    Null and unreadable urls have no host; pages without a host form a group of their own. Repeats are decided over all
    pages of a host. Rows that repeat a page, and copies of it, give equal texts. Broken markup and very long pages are
    read whole, in time in proportion to their length. Other columns, also of clashing names, are not read; an empty table
    gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("")))
    parsed = shared_table(rows.select(F.monotonically_increasing_id().alias("row"), "host", "page_id", "url", "html").mapInArrow(_parse, _PARSED), "html_blocks")
    sizes = parsed.groupBy("host").agg(F.bool_or("open").alias("open"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("pages")).where("open")
    hosts = shared_table(sizes.select("host", ((F.col("words") > TOKENS) | (F.col("pages") > PAGES)).alias("large")), "html_hosts")
    n, large = hosts.agg(F.count(F.lit(1)), F.bool_or("large")).head()
    if not n:
        return _without_evidence(parsed)
    held = F.broadcast(hosts) if n <= BROADCAST_HOSTS else hosts
    settled = _without_evidence(parsed.join(held, "host", "left_anti"))
    sized = parsed.join(held, "host")
    out = settled.unionByName(sized.where("not large").drop("large").groupBy("host").applyInArrow(_host_pages, _RESULT))
    return out.unionByName(_large_hosts(sized.where("large").drop("large"))) if large else out
