"""Main text of web pages: a suffix array over each host's pages finds what repeats, markup decides the rest."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.llm.common import WordHash, small_batches, staged

#: Tokens of a repeated run, and the distinct pages that must hold it.
RUN, PAGES = 6, 3
#: A block outside articles is boilerplate when repeated runs cover this share of its tokens.
COVERED = 0.5
#: Bytes of html that one suffix array takes; hosts with more are split by page, and their runs counted by hash.
CHUNK_BYTES = 4_000_000

_PIECES = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title", "canvas", "audio", "video", "xmp"}
#: Elements whose content lasts to the end of the page if they aren't closed.
_TO_THE_END = {"script", "style", "textarea", "title", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"} | _RAW
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert|advertisement|adverts|adsense|banner|sponsor|sponsored|promo|promotion|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|disqus|respond|replies|pagination|pager|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_MAIN_NAMES = re.compile(r"(?:^|\s)(?:main|content|main-content|article|article-body|post-content|entry-content|articleBody|post|entry)(?:$|\s)", re.I)
_BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_SPACED = {"br", "td", "th", "option", "wbr"}
#: Regions of a page: NAMED ones are chrome by the names that their authors gave them, CHROME ones by element or role.
OUTSIDE, CHROME, ARTICLE, MAIN, NAMED = range(5)


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(region, text) of every block of a page in order, character references decoded, white space made single."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements, and the region inside each
    text: list[str] = []
    region = OUTSIDE
    page = page or ""
    at = 0

    def flush() -> None:
        if text:
            got = " ".join(html.unescape("".join(text)).split())
            if got:
                out.append((region, got))
            text.clear()

    while at < len(page):
        m = _PIECES.match(page, at)
        at = m.end()
        if m[4] is not None:
            text.append(m[4])
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCKS:
                flush()
            elif name in _SPACED:
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][1] != region or (i and stack[i - 1][1] != region):
                        flush()
                    del stack[i:]
                    region = stack[-1][1] if stack else OUTSIDE
                    break
            continue
        if name in _SPACED:
            text.append(" ")
        if name in _BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                stack.pop()
                region = stack[-1][1] if stack else OUTSIDE
        if name in _RAW:
            if not m[3].rstrip().endswith("/"):  # its content is no markup: go on at its end tag
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                if end or name in _TO_THE_END:
                    at = end.start() if end else len(page)
            continue
        if name in _VOID:
            continue
        inner = _region(name, m[3], region)
        if inner != region:
            flush()
        if name in _BLOCKS or inner != region:
            stack.append((name, inner))
            region = inner
    flush()
    return out


def _region(name: str, attributes: str, outer: int) -> int:
    if outer == CHROME:
        return CHROME
    if name in _CHROME:
        return CHROME
    if name in ("html", "body"):
        return outer
    names, main = "", outer
    if attributes:
        for k, *v in _ATTRIBUTE.findall(attributes):
            k, value = k.lower(), "".join(v)
            if k in ("class", "id"):
                names += " " + value
            elif k == "role" and value.lower() in _ROLES or k == "hidden" or k == "aria-hidden" and value.lower() == "true":
                return CHROME
            elif k == "role" and value.lower() == "main" or k == "itemprop" and value == "articleBody":
                main = max(main, MAIN)
    if outer == NAMED or names and _CHROME_NAMES.search(names) and name not in ("article", "main") or names and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names, re.I):
        return NAMED
    if name == "article":
        return ARTICLE
    if name == "main" or names and name in ("div", "section", "td") and _MAIN_NAMES.search(names):
        main = max(main, MAIN) if outer != ARTICLE else ARTICLE
    return outer if outer == ARTICLE else main


def repeated(streams: list[np.ndarray], run: int = RUN, pages: int = PAGES, contents: list[int] | None = None) -> list[np.ndarray]:
    """For each page's token ids, which positions lie in a run of `run` or more tokens that `pages` distinct pages hold.

    Pages are distinct when their numbers in `contents` are; without it each stream is a page of its own.
    The streams are put one after another with separators that differ, and the suffixes are sorted by prefix doubling
    up to `run` tokens: suffixes with equal rank share a run, and a longer repeat is the union of its runs.
    """
    n = sum(map(len, streams)) + len(streams)
    if not n:
        return [np.zeros(len(s), bool) for s in streams]
    flat, owner, ends = np.empty(n, np.int64), np.empty(n, np.int64), []
    at = 0
    for p, s in enumerate(streams):
        flat[at : at + len(s)] = s
        flat[at + len(s)] = -1 - p
        owner[at : at + len(s) + 1] = p if contents is None else contents[p]
        at += len(s) + 1
        ends.append(at - 1)
    rank, length = np.unique(flat, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        length += step
    order = np.lexsort((owner, rank))  # the suffix array by the first `run` tokens, by page within equal ones
    r, o = rank[order], owner[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])]
    distinct = np.bincount(r[new], minlength=rank.max() + 1)
    hit = distinct[rank] >= pages
    tail = np.cumsum(np.r_[0, (flat < 0).astype(np.int64)])
    starts = np.flatnonzero(hit)
    starts = starts[starts + run <= n]
    starts = starts[tail[starts + run] == tail[starts]]  # no run crosses the end of a page
    covered, out, at = _covered(starts, n, run), [], 0
    for end in ends:
        out.append(covered[at:end])
        at = end + 1
    return out


def _covered(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n positions lie in a run that begins at one of `starts`."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + run, -1)
    return np.cumsum(delta[:-1]) > 0


def _judged(page: list[dict]) -> list[list[str]]:
    """Tokens of each block that repeats decide: all but those of articles, which share passages that belong to them."""
    return [b["text"].lower().split() if b["region"] != ARTICLE else [] for b in page]


def _content(page: list[dict]) -> int:
    """A number for a page's tokens, articles' too: equal for copies of one page only."""
    h = xxhash.xxh3_64()
    for b in page:
        h.update("\0".join([str(b["region"]), *b["text"].lower().split(), "\n"]))
    return h.intdigest() - (1 << 63)


def _sought(page: list[dict]) -> set[int]:
    """The regions that a page's text comes from: articles and the main element round them, else what lies outside chrome.

    A name alone can't drop most of a page: where NAMED blocks hold more words than the rest, they count as OUTSIDE.
    """
    has = {b["region"] for b in page}
    if has & {ARTICLE, MAIN}:
        return {ARTICLE, MAIN}
    size = {r: sum(len(b["text"].split()) for b in page if b["region"] == r) for r in (OUTSIDE, NAMED)}
    return {OUTSIDE, NAMED} if size[NAMED] > size[OUTSIDE] else {OUTSIDE}


def _runs(judged: list[list[str]], hashes: WordHash) -> np.ndarray:
    """Hashes of the runs of RUN tokens that begin at each position of a page's judged tokens."""
    t = np.array([hashes[w] for ws in judged for w in ws], np.uint64)
    n = len(t) - RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(RUN):
        h = (h ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their blocks, compressed: they are what travels to a page's host."""
    pack = zstandard.ZstdCompressor(3).compress
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            b = whole.slice(lo, 512)
            parsed = [pack(json.dumps(blocks_of(x.as_py()), ensure_ascii=False).encode("utf-8", "surrogatepass")) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), b.column("chunk"), pa.array(parsed, pa.binary())], ["page_id", "url", "host", "chunk", "blocks"])


def _unpacked(blocks: pa.Array | pa.ChunkedArray) -> list[list[dict]]:
    """The blocks of every page."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [[{"region": r, "text": t} for r, t in json.loads(unpack(x).decode("utf-8", "surrogatepass"))] for x in blocks.to_pylist()]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, chunk, run, content, wanted) of parsed pages, once in a batch: of a chunk's run PAGES contents at most, which settle it.

    `wanted` marks runs of pages that have a block which repeats may drop.
    """
    hashes = WordHash()
    for b in batches:
        pages = _unpacked(b.column("blocks"))
        groups: dict[tuple[str, int], int] = {}
        group = np.array([groups.setdefault(k, len(groups)) for k in zip(b.column("host").to_pylist(), b.column("chunk").to_pylist(), strict=True)], np.int64)
        runs = [np.unique(_runs(_judged(p), hashes)) for p in pages]
        at = np.repeat(np.arange(len(pages)), [len(r) for r in runs])
        run = np.concatenate([*runs, np.empty(0, np.int64)])
        content, wanted = np.array([_content(p) for p in pages], np.int64)[at], np.array([any(b["region"] in s and b["region"] != ARTICLE for s in [_sought(p)] for b in p) for p in pages], bool)[at]
        order = np.lexsort((content, run, group[at]))
        g, run, content, wanted = group[at][order], run[order], content[order], wanted[order]
        first = np.ones(len(run), bool)
        first[1:] = (g[1:] != g[:-1]) | (run[1:] != run[:-1])
        new = first.copy()
        new[1:] |= content[1:] != content[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            sizes = np.diff(np.r_[starts, len(run)])
            wanted = np.repeat(np.logical_or.reduceat(wanted, starts), sizes)
            place = np.cumsum(new) - np.repeat(np.cumsum(new)[starts], sizes)
            new &= place < PAGES
        names = list(groups)
        g = g[new]
        host = pa.array([n[0] for n in names], pa.string()).take(pa.array(g))
        chunk = pa.array([n[1] for n in names], pa.int64()).take(pa.array(g))
        yield pa.RecordBatch.from_arrays([host, chunk, pa.array(run[new]), pa.array(content[new]), pa.array(wanted[new])], ["host", "chunk", "run", "content", "wanted"])


def _texts(group: pa.Table, pages: list, judged: list, cover: list[np.ndarray]) -> pa.Table:
    """First what repeats cover goes, then what markup doesn't hold for the page's text."""
    texts = []
    for p, ws, c in zip(pages, judged, cover, strict=True):
        sought, kept, at = _sought(p), [], 0
        for b, w in zip(p, ws, strict=True):
            unique = not w or c[at : at + len(w)].mean() < COVERED
            at += len(w)
            if unique and b["region"] in sought:
                kept.append(b["text"])
        texts.append("\n\n".join(kept))
    return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string())})


def _extracted(group: pa.Table) -> pa.Table:
    """Texts of a whole host's pages."""
    ids: dict[str, int] = {}
    pages = _unpacked(group.column("blocks"))
    judged = [_judged(p) for p in pages]
    cover = repeated([np.array([ids.setdefault(w, len(ids)) for ws in p for w in ws], np.int64) for p in judged], contents=[_content(p) for p in pages])
    return _texts(group, pages, judged, cover)


def _extracted_by(group: pa.Table, marked: pa.Table) -> pa.Table:
    """Texts of a part of a host's pages, by the runs that are repeated in the whole host."""
    hashes, pages = WordHash(), _unpacked(group.column("blocks"))
    judged, runs = [_judged(p) for p in pages], marked.column("run").to_numpy()
    cover = [_covered(np.flatnonzero(np.isin(_runs(ws, hashes), runs)), sum(map(len, ws)), RUN) for ws in judged]
    return _texts(group, pages, judged, cover)


def extract(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, text for every row of `pages` (page_id, url, html; others ignored).

    Every page is parsed into blocks whose region the markup tells: chrome (menus, headers, footers, sidebars, notices,
    adverts, forms, comments), an article, a main element, or none of them. The pages of a host then meet, the tokens
    of all blocks outside articles are put into one suffix array, and runs of RUN or more tokens that PAGES distinct
    pages hold are marked. Blocks that marked runs cover at least half are boilerplate and go. Of the rest a page's text is
    what stands in its articles and in a main element beside them, or, where it has neither, what chrome doesn't hold. The array
    alone can't decide: adverts and reader comments needn't repeat, and the pages of a small host show no repeats. Runs
    inside an article stay even if many pages share them.

    A host with more than `chunk_bytes` is split by hash of the page into parts of about that size, so that no group
    grows with the host. Its runs are then counted by 64-bit hash over all its parts, and each part gets those of its
    runs that are repeated in the host: the result is that of one array. Copies of one page (equal tokens) and repeated
    rows count as one page. Null and empty html give an empty text; a page without url counts to the host ''; repeated
    rows each give a row; a page cut off in a tag or reference is read as far as it goes. An empty table gives an empty
    table.
    """
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    # few hosts are that large: once written, the table's size tells Spark whether to broadcast it, so that the pages
    # needn't move for this join
    sizes = staged(p.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / chunk_bytes).alias("chunks")).where("chunks > 1"), "page-hosts")
    parsed = lambda df: df.select("page_id", "url", "host", "chunk", "html").mapInArrow(_parsed, "page_id long, url string, host string, chunk long, blocks binary")
    out = "page_id long, url string, text string"
    if sizes.isEmpty():
        return parsed(p.withColumn("chunk", F.lit(0).cast("long"))).groupBy("host").applyInArrow(_extracted, out)
    small = parsed(p.join(sizes, "host", "left_anti").withColumn("chunk", F.lit(0).cast("long"))).groupBy("host").applyInArrow(_extracted, out)
    large = parsed(p.join(sizes, "host").withColumn("chunk", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("chunks"))))
    seen = staged(large.mapInArrow(_seen, "host string, chunk long, run long, content long, wanted boolean"), "page-runs")
    marked = seen.select("host", "run", "content").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES)
    marked = seen.where("wanted").select("host", "chunk", "run").distinct().join(marked.select("host", "run"), ["host", "run"])
    by = lambda df: df.groupBy("host", "chunk")
    return small.unionByName(by(large).cogroup(by(marked)).applyInArrow(_extracted_by, out))
