"""Main text of web pages: a host's suffix array over the blocks that structure proposes.

A page is cut into blocks (block-level tags end a block; white space inside is one space). Each block is

* chrome: in nav, footer, aside, script, style and the like, in a header outside article and main, or hidden;
* soft: in a form, or in an element whose class, id or role says advert, menu, sidebar, notice, comments and so on
  (``CHROME``; camel case and hyphens are split; html and body are never judged by their words). An article or main
  element inside is no longer soft, unless the element around it holds comments, related pages or promotion
  (``OTHERS``, alone or with words of mere structure: comment-list, but not comment-policy);
* main: in an article, else in main or role=main, else in an element whose class or id says content (``CONTENT``), which
  is inner where it stands inside something soft;
* open: none of these.

A page proposes its article blocks (with all of main, where main has more text outside its articles than in them), else
its main blocks. Without either, the words are a prior and the amount of text decides: content counts ``PRIOR`` times
its characters, inner and open text count as they are, and the largest is proposed; open text that wins takes the content
elements' with it. Soft blocks are proposed where there is nothing else.

Structure only proposes. The token streams of all pages of a host are taken together, and strings of 50 bytes or more
that occur on several distinct pages are found with the suffix arrays of ``repeats``, in pieces by host and anchor:

1. Every segment's gram (40 bits, host included) is counted by pages, in column blocks. Grams on under 3 pages, and on
   under 2 open pages, cannot be boilerplate.
2. Segments of the other grams are suffix rows. Equal ones are one row with its number of pages before they meet
   (pages that hold one gram in several segments keep their id, so that a page counts once); then the suffixes are
   sorted and the stack scan gives the common-prefix intervals, each a string with its pages.
3. A string is boilerplate if it stands on ``least_pages`` of the host's pages (a fifth, at least 3, at most 30 are
   asked), or on two open pages. Words that boilerplate covers, by 50 bytes of their block or by all of it, are removed;
   the unique runs stay. A
   string of the first sort also has to stand on more pages than the page's own text does, which is what a quarter of
   the page's bytes do not exceed: a whole copy of an article stands on as many pages as there are copies.

Grams and strings are boilerplate alone, so they are few; they are sent to all tasks while under ``broadcast_bytes``
(64 MB, checked), and joined by key beyond it. If all blocks of a page would go, all stay: a page and its copy are no
boilerplate of each other.

Nulls and empty pages give an empty text. Rows that repeat a page_id each give a row; rows alike in full are one page
in the counts. A
missing or odd url is a host of its own, the empty one. Character references are decoded by the standard's table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import repeats
from docloom.llm.common import mix, stored

PRIOR = 3
FEWEST, ENOUGH, SHARE, OPEN = 3, 30, 5, 2
BROADCAST_BYTES, REPEATED, BUCKET_BYTES = 64 << 20, 1_000_000, 8 << 20
_GRAM_BITS = (1 << 40) - 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(script|style|textarea|noscript|template|iframe|svg|title|select|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CHROME_TAGS = frozenset("nav footer aside button dialog head menu object".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation navigation-bar "
    "newsletter notice notices notification pager pagination paywall popup promo promos promoted promotion recommended related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tagcloud toolbar tooltip widget widgets".split()
)
CONTENT = frozenset("article articlebody content entry maincontent post story text".split())
#: Chrome that holds whole articles of its own.
OTHERS = frozenset("ad ads advert advertisement comment comments commentlist disqus promo promos promoted recommended related replies reply respond sponsor sponsored sponsors".split())
#: Words that say nothing about what an element holds.
STRUCTURE = frozenset("area article articles author block body box container content count date entry footer form header inner item items like link links list meta news nav post posts section stories story text thread title video videos widget wrap wrapper".split())
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CONTAINERS = frozenset("article main div section td body html table".split())


def _marks(attributes: str) -> tuple[set[str], set[str], bool, bool]:
    """(names in class, id and role; the words they are made of; whether the element is hidden; whether a name says that it holds others' texts)."""
    names, hidden = set(), False
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        else:
            names.update(value.split())
    split = [{w.lower() for w in re.split(r"[_-]+", _HUMP.sub("-", n)) if w} for n in names]
    others = any(w & OTHERS and w <= OTHERS | STRUCTURE for w in split)
    names = {n.lower() for n in names}
    return names, set().union(*split) | names, hidden, others


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks, kinds chrome, soft, others (soft, and no article inside counts), article, main, content, inner and open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, kind of what is inside)
    kind, parts = "open", []

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((kind, text))
            parts.clear()

    def leave(to: int) -> None:
        nonlocal kind
        del stack[to:]
        now = stack[-1][1] if stack else "open"
        if now != kind:
            close()
            kind = now

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m.group(2), m.group(3), m.group(4)) if m.group(3) else (m.group(5), m.group(6), m.group(7))
        if not tag:
            if m.group(1):
                parts.append(" ")
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if tag not in BLOCK and stack[k][0] in _CONTAINERS:
                    break
            continue
        if tag in BLOCK:
            close()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, a list item the one before it
                if stack[k][0] == "p" or (tag == "li" == stack[k][0]):
                    leave(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        elif tag in ("br", "td", "th", "img"):
            parts.append(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        inside = kind
        if kind != "chrome":
            names, words, hidden, others = _marks(attributes) if attributes else (set(), set(), False, False)
            if tag in ("html", "body"):
                names, words, others = set(), set(), False
            is_main = tag in ("article", "main") or "main" in names
            if hidden or tag in CHROME_TAGS or (tag == "header" and kind not in ("article", "main")):
                inside = "chrome"
            elif kind == "others" or (names & OTHERS if is_main else others):
                inside = "others"
            elif tag == "article":
                inside = "article"
            elif is_main and kind != "article":
                inside = "main"
            elif kind != "soft" and (tag == "form" or words & CHROME or (kind != "article" and "header" in words)):
                inside = "soft"
            elif kind in ("open", "soft") and words & CONTENT:
                inside = "content" if kind == "open" else "inner"
        if inside != kind:
            close()
        stack.append((tag, inside))
        kind = inside
    if at < len(page):
        parts.append(re.sub(r"<[a-zA-Z/!][^>]*\Z", " ", page[at:]))
    close()
    return out


def chosen(found: list[tuple[str, str]]) -> tuple[bool, list[str]]:
    """(whether structure leaves the page open; the blocks it proposes)."""
    of = lambda *kinds: [t for k, t in found if k in kinds]
    article, main = of("article"), of("main", "content")
    if article:
        inside = sum(map(len, of("main")))
        return False, of("article", "main") if inside > sum(map(len, article)) else article
    if of("main"):
        return False, main
    size = lambda *kinds: sum(map(len, of(*kinds)))
    content, inner, loose = PRIOR * size("content"), size("inner"), size("open")
    if content and content >= max(inner, loose):
        return False, main
    if inner and inner >= loose:
        return True, of("inner")
    return True, of("open", "content") or of("soft") or of("others")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, row, host, html) to (page_id, url, row, host, blocks): the last bit of row is set on open pages."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            is_open, rests = zip(*(chosen(blocks(x)) for x in part.column(4).to_pylist()), strict=True)
            row = (part.column(2).to_numpy() & ~1) | np.array(is_open, np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(row), part.column(3), pa.array(rests, pa.list_(pa.string()))], ["page_id", "url", "row", "host", "blocks"])


def _segments(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """(page number in the batch, start, windows, gram, bytes of all streams, where each begins) of a batch's pages; the host is part of the gram."""
    raw = ["\n".join(rest).encode() for rest in batch.column(at + 1).to_pylist()]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    page, start, n, gram, _ = repeats.segments(data, offs)
    host = batch.column(at).to_numpy().view(np.uint64)
    return page, start, n, mix(gram.view(np.uint64) ^ host[page]).view(np.int64), data, offs


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of (row, host, blocks, ...) batches with about ``most`` characters; a longer page is a part alone."""
    for batch in batches:
        ends = np.cumsum([sum(map(len, rest)) + len(rest) for rest in batch.column(2).to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _gram_blocks(n_buckets: int):
    """(row, host, blocks) to column blocks of (40 bits of each gram, pages, open pages), counted by input part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 4 << 20):
            page, _, _, gram, _, _ = _segments(part, 1)
            if not len(page):
                continue
            pair = np.unique(np.stack([(gram >> 24) & _GRAM_BITS, page], axis=1), axis=0)
            is_open = (part.column(0).to_numpy() & 1)[pair[:, 1]]
            first = np.flatnonzero(np.append(True, pair[1:, 0] != pair[:-1, 0]))
            gram = pair[first, 0]
            yield repeats.to_blocks(repeats._bucket_of(gram, n_buckets), [gram, np.diff(np.append(first, len(pair))), np.add.reduceat(is_open, first)])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams on FEWEST pages of a host or more, or on OPEN open ones."""
    for _, (gram, pages, is_open) in repeats.from_blocks(batches, 3):
        order = np.argsort(gram, kind="stable")
        gram, pages, is_open = gram[order], pages[order], is_open[order]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        keep = (np.add.reduceat(pages, first) >= FEWEST) | (np.add.reduceat(is_open, first) >= OPEN)
        yield pa.RecordBatch.from_arrays([pa.array(gram[first][keep])], ["short"])


def _suffixes(grams: np.ndarray | None):
    """(row, host, blocks) to suffix rows of each page's token stream: of the given grams, or of all; one for each page, gram and bytes.

    id is 0 where the page has the gram in one segment's bytes alone, else the page's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        for part in _parts(batches):
            page, start, n, gram, data, offs = _segments(part, 1)
            row, host = part.column(0).to_numpy(), part.column(1).to_numpy()
            if grams is not None:
                keep = _among(grams, (gram >> 24) & _GRAM_BITS)
                page, start, n, gram = page[keep], start[keep], n[keep], gram[keep]
            low = offs[page] + start
            bodies = [data[a:b].tobytes() for a, b in zip(low.tolist(), (low + n + repeats.LENGTH - 1).tolist(), strict=True)]
            once = dict.fromkeys(zip(page.tolist(), gram.tolist(), bodies, strict=True))
            times = Counter((p, g) for p, g, _ in once)
            rows = [(g, (g >> 24) & _GRAM_BITS, int(host[p]), serial + p + 1 if times[p, g] > 1 else 0, int(row[p] & 1), body) for p, g, body in once]
            serial += len(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["gram", "short", "host", "id", "open", "bytes"])

    return run


def _among(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, x), max(0, len(ordered) - 1))
    return ordered[at] == x if len(ordered) else np.zeros(len(x), bool)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, host, bytes, open pages, pages) of repeated strings, from rows (gram, host, id, open pages, pages, bytes) in order of gram and bytes."""
    for gram, host, page, is_open, pages, bodies in repeats._buckets(batches):
        new = np.array([True] + [gram[k] != gram[k - 1] or bodies[k] != bodies[k - 1] for k in range(1, len(bodies))])
        seg, one = np.cumsum(new) - 1, np.flatnonzero(new)
        found = []

        def add(of: np.ndarray, member: np.ndarray, texts: list[bytes], first: np.ndarray) -> None:
            """Strings of groups 0, 1, ... whose rows are ``member``: those with an id count once for each."""
            none = page[member] == 0
            counts = [np.bincount(of[none], x[member][none], len(texts)).astype(np.int64) for x in (is_open, pages)]
            pair, at = np.unique(np.stack([of[~none], page[member][~none]], axis=1), axis=0, return_index=True)
            counts[0] += np.bincount(pair[:, 0], is_open[member][~none][at], len(texts)).astype(np.int64)
            counts[1] += np.bincount(pair[:, 0], minlength=len(texts))
            for k in np.flatnonzero((counts[1] >= FEWEST) | (counts[0] >= OPEN)).tolist():
                found.append((int(gram[first[k]]), int(host[first[k]]), texts[k], int(counts[0][k]), int(counts[1][k])))

        add(seg, np.arange(len(seg)), [bodies[k] for k in one], one)
        edges = np.flatnonzero(np.append(True, gram[one][1:] != gram[one][:-1]))
        upto = np.append(one, len(seg))
        for a, b in zip(edges, [*edges[1:], len(one)], strict=True):
            if b - a < 2:
                continue
            group, size, owner, window = repeats.repeat_groups([bodies[k] for k in one[a:b]], np.arange(b - a))
            if not len(group):
                continue
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            texts = [bodies[one[a + owner[k]]][window[k] : window[k] + size[k]] for k in first]
            pair = np.unique(np.stack([group, owner], axis=1), axis=0)
            times = upto[a + pair[:, 1] + 1] - upto[a + pair[:, 1]]
            member = np.repeat(upto[a + pair[:, 1]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            add(np.repeat(pair[:, 0], times), member, texts, one[a + owner[first]])
        if found := list(dict.fromkeys(found)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["gram", "host", "bytes", "open", "pages"])


def _met(body: bytes, start: int, strings: list[tuple[bytes, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, open pages, pages) of the strings in one segment."""
    for w, is_open, pages in strings:
        at = body.find(w)
        while at >= 0:
            yield start + at, start + at + len(w), is_open, pages
            at = body.find(w, at + 1)


def _page_ranges(strings: dict[int, list[tuple[bytes, int, int]]] | None):
    """(row, host, blocks, strings) to the same rows' ranges: strings by gram for all, or those that came with the page."""
    grams = np.sort(np.fromiter(strings, np.int64, len(strings))) if strings is not None else None

    def run(part: pa.RecordBatch, own: list | None = None) -> list[list[tuple[int, int, int, int]]]:
        page, start, n, gram, data, offs = _segments(part, 1)
        if grams is not None:
            keep = np.flatnonzero(_among(grams, gram))
            page, start, n, gram = page[keep], start[keep], n[keep], gram[keep]
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(part.num_rows)]
        for p, s, k, g in zip(page.tolist(), start.tolist(), n.tolist(), gram.tolist(), strict=True):
            if mine := strings.get(g) if strings is not None else own[p].get(g):
                low = int(offs[p]) + s
                out[p].extend(_met(data[low : low + k + repeats.LENGTH - 1].tobytes(), s, mine))
        return out

    return run


def _left(text: str, gone: np.ndarray) -> str:
    """The words of a block of which a byte is not ``gone``. A run that covers neither the block nor the length of a string is the end of one in the next block, and stays."""
    if gone.all():
        return ""
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    gone = gone.copy()
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        gone[a:b] = b - a >= repeats.LENGTH
    raw = np.frombuffer(text.encode(), np.uint8)
    stays = np.append(~gone & (raw != 32), False)
    begins = np.flatnonzero(np.append(True, raw[:-1] == 32))
    kept = np.logical_or.reduceat(stays, begins)
    return " ".join(w for w, k in zip(text.split(" "), kept.tolist(), strict=True) if k)


def unique_runs(rest: list[str], ranges: list[tuple[int, int, int, int]], is_open: bool) -> list[str]:
    """The blocks without the words that boilerplate (start, end, open pages, pages) covers; all as they are if none is left."""
    if not ranges:
        return rest
    quads = np.array(ranges, np.int64)
    total = sum(len(t.encode()) + 1 for t in rest)
    of_open, of_all = np.zeros(total, np.int64), np.ones(total, np.int64)
    for out, k in ((of_open, 2), (of_all, 3)):
        for a, b, n in quads[np.argsort(quads[:, k], kind="stable")][:, [0, 1, k]].tolist():  # the most pages last
            out[a:b] = n
    copies = np.partition(of_all, total // 4)[total // 4]
    gone = (of_all > copies) & (of_all > 1)
    if is_open:
        gone |= of_open >= OPEN
    kept, at = [], 0
    for t in rest:
        size = len(t.encode())
        if here := _left(t, gone[at : at + size]) if gone[at : at + size].any() else t:
            kept.append(here)
        at += size + 1
    return kept or rest


def _decide(strings: dict[int, list[tuple[bytes, int, int]]] | None):
    """(row, host, blocks, page_id, url[, strings]) to the result's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges_of = _page_ranges(strings)
        for part in _parts(batches):
            own = None
            if strings is None:
                own = [{} for _ in range(part.num_rows)]
                for mine, given in zip(own, part.column(5).to_pylist(), strict=True):
                    for x in given or []:
                        mine.setdefault(x["gram"], []).append((x["bytes"], x["open"], x["pages"]))
            text = ["\n\n".join(unique_runs(rest, ranges, row & 1 == 1)) for rest, ranges, row in zip(part.column(2).to_pylist(), ranges_of(part, own), part.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def boilerplate(parsed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(gram, bytes, open, pages): the repeated strings of every host, with the pages they stand on; pages is 1 where only open pages count."""
    size = parsed.select(F.expr("aggregate(blocks, 0L, (s, t) -> s + octet_length(t))").alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    streams = parsed.select("row", "host", "blocks")
    shared = streams.mapInArrow(_gram_blocks(n), repeats._BLOCKS).repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "short long")
    shared = stored(shared, "shared-grams")
    schema = "gram long, short long, host long, id long, open long, bytes binary"
    if 8 * shared.count() <= broadcast_bytes:
        suffixes = streams.mapInArrow(_suffixes(np.sort(shared.toArrow().column(0).to_numpy())), schema)
    else:
        suffixes = streams.mapInArrow(_suffixes(None), schema).join(shared, "short", "left_semi")
    suffixes = stored(suffixes, "host-suffixes")
    once = suffixes.where("id = 0").groupBy("gram", "host", "bytes").agg(F.sum("open").alias("open"), F.count("*").alias("pages")).withColumn("id", F.lit(0).cast("long"))
    names = ["gram", "host", "id", "open", "pages", "bytes"]
    rows = once.select(*names).unionByName(suffixes.where("id <> 0").withColumn("pages", F.lit(1).cast("long")).select(*names))
    found = rows.repartition("gram").sortWithinPartitions("gram", "bytes").mapInArrow(_strings, "gram long, host long, bytes binary, open long, pages long")
    sizes = parsed.groupBy("host").agg(F.count("*").alias("n_pages"))
    least = F.greatest(F.lit(FEWEST), F.least(F.lit(ENOUGH), F.ceil(F.col("n_pages") / SHARE)))
    found = found.join(sizes, "host").withColumn("often", F.col("pages") >= least).where(f"often or open >= {OPEN}")
    return found.select("gram", "bytes", "open", F.when(F.col("often"), F.col("pages")).otherwise(1).alias("pages"))


def _without_repeats(parsed: DataFrame) -> DataFrame:
    """One of the rows that are alike in full: they are one page."""
    least = parsed.groupBy("row").agg(F.min("serial").alias("least"), F.count("*").alias("n")).where("n > 1")
    extra = stored(parsed.select("row", "serial").join(least, "row").where("serial <> least").select("serial"), "repeated-pages")
    n = extra.count()
    return parsed.join(F.broadcast(extra) if n <= REPEATED else extra, "serial", "left_anti") if n else parsed


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html)."""
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64("page_id", "url", "html").alias("row"), F.coalesce("html", F.lit("")).alias("html"))
    source = source.select("page_id", "url", "row", host.alias("host"), "html")
    parsed = source.mapInArrow(_parse, "page_id long, url string, row long, host long, blocks array<string>").withColumn("serial", F.monotonically_increasing_id())
    parsed = stored(parsed, "parsed-pages")
    strings = stored(boilerplate(_without_repeats(parsed), broadcast_bytes), "host-strings")
    out = "page_id long, url string, text string, n_chars long"
    names = ["row", "host", "blocks", "page_id", "url"]
    if (strings.agg(F.sum(F.octet_length("bytes") + 100)).first()[0] or 0) <= broadcast_bytes:
        by: dict[int, list[tuple[bytes, int, int]]] = {}
        for x in strings.toLocalIterator():
            by.setdefault(x["gram"], []).append((bytes(x["bytes"]), x["open"], x["pages"]))
        return parsed.select(*names).mapInArrow(_decide(by), out)
    # strings meet the pages that have their grams; a page then gets its own ones
    streams = parsed.select("row", "host", "blocks").mapInArrow(_page_grams, "row long, gram long")
    own = streams.distinct().join(strings, "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "bytes", "open", "pages")).alias("strings"))
    return parsed.join(own, "row", "left").select(*names, "strings").mapInArrow(_decide(None), out)


def _page_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, gram) of a page's segments, once each."""
    for part in _parts(batches):
        page, _, _, gram, _, _ = _segments(part, 1)
        pair = np.unique(np.stack([page, gram], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[pair[:, 0]]), pa.array(pair[:, 1])], ["row", "gram"])
