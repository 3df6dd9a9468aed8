"""HTML extraction: structure first, then the runs of tokens that a host's pages share.

A page's article (or main) element is its text. Elements that are menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts or styles by tag, role, class or id are not. What is in neither is undecided, and there the host decides: windows of tokens are counted
over all its distinct pages by their hash, tokens in windows that a share of them have go, and the blocks' uncovered runs stay. A run of `long`
tokens is no chance phrase and needs a smaller share, but must then not be most of a page, as pages that share most of their text are near
copies. Article text is exempt: hosts serve copies of an article, and those are text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship, source_columns, splitmix, written

# Fixed values of HTML: void elements, elements whose content is raw text, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that are never a page's text, and the names that say so: a whole token of class or id, or a role. Inside an article fewer names do.
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies cookie-banner cookie-notice "
    "disclaimer discussion disqus footer main-nav masthead menu menubar modal nav navbar navigation newsletter notice notices overlay page-footer page-header popup promo "
    "promoted reader-comments related replies respond search-form share sharing sidebar signup site-footer site-header site-nav social sponsor sponsored subscribe toolbar "
    "topbar widget".split()
)
INSIDE = frozenset("ad ads advert adverts advertisement advertising comments cookie-banner cookie-notice menu nav navigation newsletter notices reader-comments sidebar".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN = ("main", "article")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'/=>][^\s/=>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ASKED = re.compile(r"class|id|role|hidden", re.I)
_SPACES = re.compile(r"\s+")
_P_CLOSERS = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}


#: Keys that one host's rows are dealt over in joins.
SALTS = 64


def is_boilerplate(tag: str, attrs: str, inside: int) -> bool:
    """By tag, hidden mark, role, or a whole token of class or id. inside: 0, 1 in a main element, 2 in an article, where a header is the article's own."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    for name, a, b, c in _ATTR.findall(attrs) if _ASKED.search(attrs) else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if tag in ("html", "body"):
            continue
        if name == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if name in ("class", "id") and not (INSIDE if inside > 1 else NAMES).isdisjoint(value.replace("_", "-").split()):
            return True
    return False


def blocks(page: str) -> list[tuple[bool, str]]:
    """(in the article or main element, text) of each block outside of known boilerplate, in page order; spaces joined, trimmed, not empty."""
    out: list[tuple[bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, dropped, in main (1) or article (2)
    state = [False]

    def flush() -> None:
        whole = _SPACES.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if whole:
            out.append((state[0], whole))

    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        low = size if low < 0 else low
        dropped = bool(stack) and stack[-1][1]
        if low > at and not dropped:
            text.append(page[at:low])
        if low >= size:
            break
        m = _TAG.match(page, low)
        if not m:
            if not dropped:
                text.append("<")
            at = low + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag in BLOCKS and not dropped:
                flush()
            # an end tag closes nothing outside the boilerplate or main element that it is in
            fence = max((i for i in range(len(stack)) if stack[i][1] != (i > 0 and stack[i - 1][1]) or stack[i][0] in MAIN), default=-1)
            if depth >= 0 and (depth >= fence or tag in BLOCKS):
                if not dropped and tag in BLOCKS:
                    flush()
                del stack[depth:]
                state[0] = bool(stack) and stack[-1][2] > 0
            continue
        if tag == "br":
            if not dropped:
                text.append(" ")
            continue
        if tag in BLOCKS and not dropped:
            flush()
        if tag in _P_CLOSERS:
            _close_p(stack)
        if tag in VOID:
            continue
        inside = stack[-1][2] if stack else 0
        dropped = bool(stack) and stack[-1][1]
        drop = dropped or is_boilerplate(tag, m[3], inside)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if not end and not drop:
                text.append(page[at:])
            if not end:
                break
            if not drop:
                text.append(page[at : end.start()])
            close = page.find(">", end.start())
            at = size if close < 0 else close + 1
            continue
        stack.append((tag, drop, max(inside, MAIN.index(tag) + 1) if tag in MAIN and not drop else inside))
        state[0] = stack[-1][2] > 0
    if not (stack and stack[-1][1]):
        flush()
    return out


def _close_p(stack: list[tuple[str, bool, int]]) -> None:
    """A block's start ends an open paragraph, with the inline elements in it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == "p":
            del stack[i:]
            return
        if stack[i][0] in BLOCKS:
            return


def covered(streams: list[np.ndarray], least: int, pages: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream of token ids, which tokens lie in a run of `least` that another page has too. pages: the page of each stream; else each is one.

    The plain form of what main_text decides by counted windows, in one place; tests hold one against the other.

    The suffix array of the concatenated streams is sorted by prefix doubling up to `least` tokens, which is all that is asked of it:
    suffixes equal that far are neighbours, and a group of them is boilerplate if it spans two pages.
    """
    size = [len(s) for s in streams]
    out = [np.zeros(n, bool) for n in size]
    if sum(size) < least or len(streams) < 2:
        return out
    text = np.concatenate([np.append(s.astype(np.int64) + 1, 0) for s in streams])
    stream = np.repeat(np.arange(len(streams)), np.array(size) + 1)
    page = stream if pages is None else pages[stream]
    n = len(text)
    end = np.cumsum(np.array(size) + 1)[stream] - 1  # the stream's mark
    rank, have = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while have < least:
        step = min(have, least - have)
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    whole = np.flatnonzero(np.arange(n) + least <= end)
    order = whole[np.lexsort((page[whole], rank[whole]))]  # the suffix array, equal prefixes by page
    r, p = rank[order], page[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    group = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:], len(order)) - 1
    shared = p[np.flatnonzero(new)] != p[last]
    mark = np.zeros(n + 1, np.int64)
    hit = order[shared[group]]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + least, -1)
    on = np.cumsum(mark)[:n] > 0
    start = np.concatenate([[0], np.cumsum(np.array(size) + 1)[:-1]])
    return [on[a : a + k] for a, k in zip(start, size, strict=True)]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to page_id, url and h the text that the markup decides, the undecided blocks, whether these are all there is, and a hash of all blocks."""
    for batch in batches:
        text, rest, unsure, content = [], [], [], []
        for page in batch.column(3):
            found = blocks(page.as_py() or "")
            text.append("\n\n".join(t for m, t in found if m))
            rest.append([t for m, t in found if not m])
            unsure.append(bool(rest[-1]) and not text[-1])
            content.append(_digest("\0".join(f"{m:d}{t}" for m, t in found)))
        columns = [*batch.columns[:3], pa.array(text, pa.string()), pa.array(rest, pa.list_(pa.string())), pa.array(unsure, pa.bool_()), pa.array(content, pa.int64())]
        yield pa.record_batch(columns, ["page_id", "url", "h", "text", "rest", "unsure", "content"])


def _window_hashes(words: np.ndarray, width: int, h: int) -> np.ndarray:
    """A hash of the host and each window of `width` token hashes."""
    out = np.full(max(0, len(words) - width + 1), (h + width) % (1 << 64), np.uint64)
    for i in range(width if len(out) else 0):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : len(words) - width + 1 + i]
    return splitmix(out).view(np.int64)


def _windows(widths: tuple[int, ...], rows: int = 200_000, memory: int = 500_000):
    """Pages (h, content, rest) to their windows: h, content, width, w and the places that begin one, each window of a page once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        parts: list[pa.RecordBatch] = []
        names, held = ["h", "content", "width", "w", "at"], 0
        for batch in batches:
            for h, content, rest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(ids) > memory:
                    ids.clear()
                words = [w for block in rest for w in block.split(" ")]
                for w in words:
                    if w not in ids:
                        ids[w] = _digest(w)
                hashed = np.array([ids[w] for w in words], np.int64).view(np.uint64)
                for width in widths:
                    found = _window_hashes(hashed, width, h)
                    order = np.argsort(found, kind="stable")
                    first = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1])) if len(found) else order
                    n = len(first)
                    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(found)).astype(np.int32)), pa.array(order.astype(np.int32)))
                    parts.append(pa.record_batch([pa.array(np.full(n, h)), pa.array(np.full(n, content)), pa.array(np.full(n, width, np.int32)), pa.array(found[order][first]), at], names))
                    held += n
                if held >= rows:
                    yield from parts
                    parts, held = [], 0
        yield from parts

    return emit


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, rest, marks: width, places and commonness of shared windows) to their text without what the host's pages share."""
    for batch in batches:
        out = []
        for rest, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            out.append("\n\n".join(rest if not marks else _without(rest, marks)))
        yield pa.record_batch([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])


def _without(rest: list[str], marks: list[dict]) -> list[str]:
    """A run may cross blocks, as menus do, and then takes the blocks that it covers whole; inside a block it is long enough by itself."""
    words = [block.split(" ") for block in rest]
    block = np.repeat(np.arange(len(words)), [len(w) for w in words])

    def masks(common: bool) -> tuple[np.ndarray, np.ndarray]:
        across, within = np.zeros(len(block), bool), np.zeros(len(block), bool)
        for m in marks:
            for at in m["at"] if m["common"] == common else ():
                across[at : at + m["width"]] = True
                if block[at] == block[at + m["width"] - 1]:
                    within[at : at + m["width"]] = True
        return across, within

    (across, within), (rare, rare_within) = masks(True), masks(False)
    if (rare & ~across).sum() * 2 <= (~across).sum():
        across, within = across | rare, within | rare_within
    out, at = [], 0
    for ws in words:
        gone = within[at : at + len(ws)] | across[at : at + len(ws)].all()
        at += len(ws)
        out.append(" ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return [x for x in out if x]


def main_text(pages: DataFrame, least: int = 5, share: float = 0.3, fewest: int = 3, long: int = 25, long_share: float = 0.05) -> DataFrame:
    """page_id, url, text and n_chars of every page; text is empty where there is none, never null.

    A page with an article or main element gives that element's blocks; any other page the blocks that aren't boilerplate by name nor by what
    its host's pages share. Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by two
    \\n. Null or empty html: empty text. A null url is a host of its own. Repeated rows come back repeated; rows of a host with the same blocks
    count as one page. Empty table: empty result. Other columns are not read.

    Such a page loses the runs of `least` tokens that `share` of the host's distinct pages with undecided blocks have, `fewest` at least, and the
    runs of `long` tokens that long_share of them have, `fewest` at least, unless these are over half of what the page has besides the former.

    Sharing is decided over the whole host, of any size: windows are dealt by their hash and counted with partial sums, so a host with a
    third of all pages is many groups. Only hosts with a page that the markup leaves open are counted. A host's pages and windows are
    dealt over SALTS keys where they meet the host's row.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    rows = source_columns(pages, "page_id", "url", "html").select("page_id", "url", F.xxhash64(host).alias("h"), "html")
    found = written(rows.mapInArrow(_parsed, "page_id long, url string, h long, text string, rest array<string>, unsure boolean, content long"), "parsed")
    unsure = found.where("unsure")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = found.where(F.size("rest") > 0).withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
    asked = asked.join(unsure.select("h").distinct().withColumn("salt", salts), ["h", "salt"], "left_semi")
    distinct = written(asked.groupBy("h", "content").agg(F.first("rest").alias("rest"), F.first("unsure").alias("unsure")).select("h", "content", "rest", "unsure"), "undecided")
    widths, form = tuple(sorted({least, long})), "h long, content long, width int, w long, at array<int>"
    seen = distinct.select("h", "content", "rest").mapInArrow(_windows(widths), form)
    counted = seen.groupBy("w", "h", "width").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    sizes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("pages")).withColumn("salt", salts)
    counted = counted.withColumn("salt", F.pmod("w", F.lit(SALTS)).cast("int"))
    on = lambda part: F.col("n") >= F.greatest(F.lit(fewest), F.ceil(F.col("pages") * part))
    common = (F.col("width") == least) & on(share)
    shared = counted.join(sizes, ["h", "salt"]).withColumn("common", common).where(F.col("common") | ((F.col("width") == long) & on(long_share))).select("w", "common")
    marks = distinct.where("unsure").select("h", "content", "rest").mapInArrow(_windows(widths), form).join(shared, "w")
    marks = marks.groupBy("h", "content").agg(F.collect_list(F.struct("width", "at", "common")).alias("marks"))
    open_pages = unsure.join(marks, ["h", "content"], "left").select("page_id", "url", "rest", "marks")
    out = found.where("not unsure").select("page_id", "url", "text").unionByName(open_pages.mapInArrow(_decided, "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
