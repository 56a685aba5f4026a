"""Document structure: pages, lines, heading paths, sections, blocks, chunk keys, context packing.

What frames can express is windows and aggregates. What depends on earlier decisions (item stacks, packing, fences) is a
short fold over one document's or one query's rows, run by Spark over all groups.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import col

# The marker patterns of a line.
HEADING, NUMBERED, LETTERED, BULLET = r"^(#{1,6})\s+(.+)$", r"^(\(?\d+(?:\.\d+)*[.)/])\s+(.+)$", r"^([A-Za-zĐđ][.)/])\s+(.+)$", r"^([-+*])\s+(.+)$"
FENCE, RULE_CELL = r"^(`{3,}|~{3,})", r"^:?-{3,}:?$"
PAGE_MARK = r"(?i)<!--\s*page:\s*(\d+)\s*-->"


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_number, content): the trimmed text after each page mark; what stands before the first mark and empty pages go."""
    marks = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(1))
    parts = F.split(F.col(text), PAGE_MARK, -1)
    each = docs.select(key, F.explode(F.arrays_zip(marks.alias("n"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("t"))).alias("p"))
    each = each.select(key, F.col("p.n").cast("int").alias("page_number"), F.trim(F.regexp_replace(F.col("p.t"), r"^\s+|\s+$", "")).alias("content"))
    return each.where(F.col("content") != "")


def rendered(page_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): pages in order, each after its mark, a rule between them."""
    one = F.concat(F.lit("<!-- page: "), F.col("page_number"), F.lit(" -->\n\n"), F.trim("content"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", one.alias("t"))))
    return page_rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("text"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line)."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def line_class(c: Column | str) -> Column:
    s = F.trim(col(c))
    return F.when(s == "", "blank").when(s.rlike(HEADING), "heading").when(s.rlike(NUMBERED), "numbered_item").when(s.rlike(LETTERED), "lettered_item").when(s.rlike(BULLET), "bullet_item").when(s.rlike(FENCE), "fence").otherwise("text")


def heading_paths(rows: DataFrame, key: str = "doc_id", deepest: int = 6) -> DataFrame:
    """Rows (key, pos, level, title) with heading_path: a level's last title counts until a heading of its level or above."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out, parts = rows, []
    for n in range(1, deepest + 1):
        out = out.withColumn(f"_p{n}", F.max(F.when(F.col("level") == n, F.col("pos"))).over(w)).withColumn(f"_t{n}", F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(w))
    for n in range(1, deepest + 1):
        above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_p{m}"), F.lit(-1)) for m in range(1, n)]) if n > 1 else F.lit(-1)
        parts.append(F.when(F.col(f"_p{n}") > above, F.col(f"_t{n}")))
    return out.withColumn("heading_path", F.array_compact(F.array(*parts))).drop(*[f"_{x}{n}" for x in "pt" for n in range(1, deepest + 1)])


def sections(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, heading_path, first_pos, last_pos, content): blocks from one heading to the next; before the first, the path is document-root."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    out = out.groupBy(key, "section").agg(F.min_by("heading_path", "pos").alias("heading_path"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.array_join(texts, "\n\n").alias("content"))
    return out.withColumn("heading_path", F.when(F.size("heading_path") == 0, F.array(F.lit("document-root"))).otherwise(F.col("heading_path")))


def chunk_keys(rows: DataFrame, key: str = "version_key") -> DataFrame:
    """Rows (key, section, child or null) with chunk_key and chunk_index: parents and their children in turn, children counted over the document."""
    order = Window.partitionBy(key).orderBy("section", F.col("child").isNotNull(), "child")
    parent, child = F.sum(F.when(F.col("child").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(F.when(F.col("child").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    name = F.when(F.col("child").isNull(), F.concat(F.col(key), F.lit("::p::"), F.lpad(parent.cast("string"), 4, "0"))).otherwise(F.concat(F.col(key), F.lit("::c::"), F.lpad(child.cast("string"), 4, "0")))
    return rows.withColumn("chunk_key", name).withColumn("chunk_index", F.row_number().over(order) - 1)


def legal_unit(kind: Column, title: Column, heading_path: Column) -> Column:
    """What a block is in a law: an article is a heading that says so; below one, items are clauses, points and bullets by their marks; all else is none.

    Headings end all items, so an item stands in a law exactly if a heading above it is an article.
    """
    is_article = lambda t: F.lower(t).startswith("điều ")
    item = F.when(kind == "numbered_item", "clause").when(kind == "lettered_item", "point").when(kind == "bullet_item", "bullet").otherwise("none")
    return F.when(kind == "heading", F.when(is_article(title), "article").otherwise("none")).when(F.exists(heading_path, is_article), item).otherwise("none")


# ---- folds


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _table_at(rows: list[str], i: int) -> bool:
    if i + 1 >= len(rows) or "|" not in rows[i]:
        return False
    head, rule = _cells(rows[i]), _cells(rows[i + 1])
    return len(head) == len(rule) >= 2 and all(re.match(RULE_CELL, c) for c in rule)


def _kind(rows: list[str], i: int) -> tuple[str, re.Match | None]:
    s = rows[i].strip()
    if not s:
        return "blank", None
    if s.startswith("<!--"):
        return "comment", None
    if re.match(FENCE, s):
        return "code", None
    if _table_at(rows, i):
        return "table", None
    for name, pattern in (("heading", HEADING), ("numbered_item", NUMBERED), ("lettered_item", LETTERED), ("bullet_item", BULLET)):
        if m := re.match(pattern, s):
            return name, m
    return "paragraph", None


def _reach(rows: list[str], i: int, kind: str) -> tuple[int, bool]:
    """(one past the block's last line, whether it ends as it should)."""
    j = i + 1
    if kind == "comment":
        while "-->" not in rows[j - 1] and j < len(rows):
            j += 1
    elif kind == "code":
        fence = re.match(FENCE, rows[i].strip())[1]
        while j < len(rows):
            s = rows[j].strip()
            j += 1
            if len(s) >= len(fence) and set(s) == {fence[0]}:
                return j, True
        return j, False
    elif kind == "table":
        width, j = len(_cells(rows[i])), i + 2
        while j < len(rows) and "|" in rows[j] and len(_cells(rows[j])) == width:
            j += 1
    elif kind == "paragraph":
        while j < len(rows) and _kind(rows, j)[0] == "paragraph":
            j += 1
    return j, True


BLOCK_SCHEMA = "source_order int, block_type string, page_start int, page_end int, heading_path array<string>, item_level int, item_marker string, item_path array<string>, item_key string, parent_item_key string, legal_unit string, content string, problem string"


def fold_blocks(rows: list[str], page_of: list[int]) -> Iterator[tuple]:
    """Blocks of one document's lines. Items hang on the nearest item of a lower level; a heading ends all items."""
    heads: list[tuple[int, str]] = []
    items: list[dict] = []
    i = order = 0
    while i < len(rows):
        kind, m = _kind(rows, i)
        j, whole = _reach(rows, i, kind)
        if kind not in ("blank", "comment"):
            path, level, parent, legal, problem = [t for _, t in heads], None, items[-1] if items else None, "none", None
            trail = parent["path"] if parent else []
            if kind == "heading":
                depth, title = len(m[1]), m[2].strip()
                heads = [h for h in heads if h[0] < depth] + [(depth, title)]
                path, items, parent, trail = [t for _, t in heads], [], None, []
                legal = "article" if title.casefold().startswith("điều ") else "none"
            elif m:
                level = _level(kind, m[1], items)
                in_law = any(t.casefold().startswith("điều ") for t in path) or any(x["legal"] in ("clause", "point", "article") for x in items)
                legal = {"numbered_item": "clause", "lettered_item": "point", "bullet_item": "bullet"}[kind] if in_law else "none"
                parent = next((x for x in reversed(items) if x["level"] < level), None)
                problem = "item_level_jump" if level > 1 and parent is None else None
                while items and items[-1]["level"] >= level:
                    items.pop()
                trail = [*(parent["path"] if parent else []), rows[i].strip()]
                items.append({"key": f"item:{order:06d}", "level": level, "kind": kind, "legal": legal, "path": trail})
            else:
                parent = None
                problem = None if whole else "unclosed_code_fence"
            own = f"item:{order:06d}" if level else f"{kind}:{order:06d}" if kind in ("code", "table") else None
            yield order, kind, min(page_of[i:j]), max(page_of[i:j]), path, level, m[1] if level else None, trail, own, parent["key"] if level and parent else None, legal, "\n".join(rows[i:j]), problem
            order += 1
        i = j


def _level(kind: str, marker: str, items: list[dict]) -> int:
    if kind == "numbered_item":
        return max(1, len([p for p in marker.strip().lstrip("(").rstrip(".)/").split(".") if p]))
    for x in reversed(items):
        if x["kind"] == kind:
            return x["level"]
    if kind == "lettered_item":
        return next((x["level"] + 1 for x in reversed(items) if x["kind"] == "numbered_item"), 1)
    return items[-1]["level"] + 1 if items else 1


#: Characters of content and paths, and so many more for each block, after which a task hands on the blocks it has made.
ROOM, BLOCK_CHARS = 1 << 21, 256
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def block_batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The blocks of documents (key, pages), handed on whenever ROOM is full."""
    names, kinds = zip(*(f.split() for f in BLOCK_SCHEMA.split(", ")), strict=True)
    for batch in batches:
        keys, parts = batch.column(0), batch.column(1)
        at: list[int] = []
        out: list[tuple] = []
        room = ROOM

        def made(keys: pa.Array, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, _ARROW[kind]) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], [key, *names])

        for k in range(batch.num_rows):
            rows = [(p["page_number"].as_py(), line) for p in parts[k] for line in p["content"].as_py().splitlines()]
            for b in fold_blocks([x for _, x in rows], [n for n, _ in rows]):
                at.append(k)
                out.append(b)
                room -= BLOCK_CHARS + len(b[11]) + sum(map(len, b[4])) + sum(map(len, b[7]))
                if room < 0:
                    yield made(keys, at, out)
                    at, out, room = [], [], ROOM
        if out:
            yield made(keys, at, out)


def blocks(page_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source_order, block_type, ...) from (key, page_number, content). A task holds one document and ROOM of blocks as Python values."""
    whole = page_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", "content"))).alias("pages"))
    kind = page_rows.schema[key].dataType.simpleString()
    return whole.mapInArrow(lambda batches: block_batches(batches, key), f"`{key}` {kind}, {BLOCK_SCHEMA}")


def recursive_split(text: str, size: int = 1200, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters at the coarsest separator that does, neighbours sharing up to ``overlap``."""
    mark = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(mark) + 1 :]
    parts = list(text) if mark == "" else [p if n == 0 else mark + p for n, p in enumerate(text.split(mark))]
    out, now, used = [], deque(), 0

    def close() -> None:
        if piece := "".join(now).strip():
            out.append(piece)

    for p in parts:
        if len(p) > size and rest:
            close()
            now.clear()
            used = 0
            out += recursive_split(p, size, overlap, rest)
            continue
        if now and used + len(p) > size:
            close()
            while now and (used > overlap or used + len(p) > size):
                used -= len(now.popleft())
        now.append(p)
        used += len(p)
    close()
    return out


def grouped_lines(rows: list[str], room: int) -> list[list[str]]:
    """Neighbouring lines together while they and the line ends between them are within ``room``; a longer line stands alone."""
    out: list[list[str]] = []
    used = 0
    for row in rows:
        if out and used + 1 + len(row) <= room:
            out[-1].append(row)
            used += 1 + len(row)
        else:
            out.append([row])
            used = len(row)
    return out


def split_table(text: str, size: int) -> list[str]:
    """Parts of a table within ``size`` characters, each with header and rule; a longer row stays whole."""
    rows = [r.strip() for r in text.strip().splitlines() if r.strip()]
    if len(text.strip()) <= size or len(rows) <= 2:
        return [text.strip()]
    head = "\n".join(rows[:2])
    return ["\n".join([head, *some]) for some in grouped_lines(rows[2:], size - len(head) - 1)]


def split_code(text: str, size: int) -> list[str]:
    """Parts of a fenced block at whole lines, fenced again; whole if the fences alone fill ``size``."""
    rows = text.strip("\n").split("\n")
    if len(text) <= size or len(rows) < 3:
        return [text]
    fence = re.match(FENCE, rows[0].strip())[1]
    closed = len(rows[-1].strip()) >= len(fence) and set(rows[-1].strip()) == {fence[0]}
    head, tail = fence + rows[0].strip()[len(fence) :].strip(), rows[-1].strip() if closed else fence
    room = size - len(head) - len(tail) - 2
    parts = grouped_lines(rows[1:-1] if closed else rows[1:], room) if room > 0 else []
    return ["\n".join([head, *some, tail]) for some in parts] if len(parts) > 1 else [text]


def pieces(units: DataFrame, size: int = 1200, overlap: int = 100, key: str = "doc_id") -> DataFrame:
    """(key, source_order, split_index, split_count, content) of blocks, tables by rows, code by lines, other text by separators."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, order, kind, text in zip(f[key], f["source_order"], f["block_type"], f["content"], strict=True):
                parts = [text] if len(text) <= size else split_table(text, size) if kind == "table" else split_code(text, size) if kind == "code" else recursive_split(text, size, overlap)
                out += [(k, order, i, len(parts), p) for i, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=[key, "source_order", "split_index", "split_count", "content"])

    kind = units.schema[key].dataType.simpleString()
    return units.select(key, "source_order", "block_type", "content").mapInPandas(run, f"{key} {kind}, source_order int, split_index int, split_count int, content string")


def bullet_groups(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, pos, pack): neighbouring bullets of one parent go together while their characters and separators are within size. A fold over an ordered array."""
    each = F.array_sort(F.collect_list(F.struct("pos", "parent", F.length("line").alias("n"))))
    packed = F.aggregate(
        each,
        F.struct(F.lit(0).alias("pack"), F.lit(0).alias("used"), F.lit(0).alias("count"), F.lit(None).cast("string").alias("parent"), F.lit(-2).alias("pos"), F.array().cast("array<struct<pos:int,pack:int>>").alias("out")),
        lambda s, x: F.when(
            s["parent"].eqNullSafe(x["parent"]) & (x["pos"] == s["pos"] + 1) & (s["used"] + s["count"] + x["n"] <= size),
            F.struct(s["pack"].alias("pack"), (s["used"] + x["n"]).alias("used"), (s["count"] + 1).alias("count"), x["parent"].alias("parent"), x["pos"].alias("pos"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), s["pack"].alias("pack")))).alias("out")),
        ).otherwise(F.struct((s["pack"] + 1).alias("pack"), x["n"].alias("used"), F.lit(1).alias("count"), x["parent"].alias("parent"), x["pos"].alias("pos"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), (s["pack"] + 1).alias("pack")))).alias("out"))),
        lambda s: s["out"],
    )
    return rows.groupBy(key).agg(packed.alias("p")).select(key, F.explode("p").alias("p")).select(key, "p.pos", "p.pack")


def pack_context(hits: list[dict], budget: int = 12_000) -> str:
    """Sources in rank order within ``budget`` characters: each child after its parent, a parent once.

    A parent that does not fit beside its child is cut if 100 characters are left for it; a child that does not fit is
    cut and ends the context.
    """
    out: list[str] = []
    seen: set[str] = set()
    parents: set[str] = set()

    def left() -> int:
        return budget - sum(len(s) + 2 for s in out)

    def cut(s: str, n: int) -> str:
        return s if len(s) <= n else "…" if n == 1 else s[: n - 1].rstrip() + "…"

    for h in hits:
        text = (h["content"] or "").strip()
        if h["chunk_key"] in seen or not text:
            continue
        child = f"[Nguồn | {h['title']} | {h['citation']}]\n{text}"
        above = (h["parent_content"] or "").strip()
        if len(child) <= left():
            if above and h["parent_key"] is not None and h["parent_key"] not in parents:
                parent, room = f"[Ngữ cảnh cha | {h['title']} | {h['citation']}]\n{above}", left() - len(child) - 2
                if len(parent) <= room or room >= 100:
                    out.append(cut(parent, room).strip())
                    parents.add(h["parent_key"])
            out.append(child)
            seen.add(h["chunk_key"])
        else:
            if left() > 0:
                out.append(cut(child, left()))
            break
    return "\n\n".join(out)


def contexts(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """(query_id, context) from hits (query_id, rank, chunk_key, title, citation, content, parent_key, parent_content)."""
    fields = ["rank", "chunk_key", "title", "citation", "content", "parent_key", "parent_content"]
    whole = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "context": [pack_context([dict(h) if isinstance(h, dict) else h.asDict() for h in hs], budget) for hs in f["hits"]]})

    return whole.mapInPandas(run, f"query_id {hits.schema['query_id'].dataType.simpleString()}, context string")


# ---- child units

_ITEMS = ("numbered_item", "lettered_item", "bullet_item")


def child_units(block_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, unit, block_type, page_start, page_end, item_key, parent_item_key, content, warning) from ``blocks``.

    A section runs from one heading to the next. An item takes in the paragraphs that follow it; tables, code and other
    paragraphs stand alone. A section of a heading alone is a unit if it is an article, else a warning without content.
    """
    order = Window.partitionBy(key).orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0)
    b = block_rows.withColumn("section", F.sum(F.when(F.col("block_type") == "heading", 1).otherwise(0)).over(order))
    inside = Window.partitionBy(key, "section").orderBy("source_order")
    owner = F.last(F.when(F.col("block_type") != "paragraph", F.col("block_type")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    joins = (F.col("block_type") == "paragraph") & F.coalesce(owner.isin(*_ITEMS), F.lit(False))
    b = b.withColumn("alone", F.count("*").over(Window.partitionBy(key, "section")) == 1)
    b = b.where((F.col("block_type") != "heading") | F.col("alone"))
    b = b.withColumn("unit", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    first = lambda c: F.min_by(c, "source_order").alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", F.trim("content").alias("t")))), lambda x: x["t"]), "\n\n")
    out = b.groupBy(key, "section", "unit").agg(first("block_type"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), first("item_key"), first("parent_item_key"), first("legal_unit"), text.alias("content"))
    bare = (F.col("block_type") == "heading") & (F.col("legal_unit") != "article")
    return out.withColumn("warning", F.when(bare, "context_only_parent")).withColumn("content", F.when(~bare, F.col("content"))).drop("legal_unit")
