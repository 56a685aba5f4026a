"""The chunker: documents with page marks to parent and child chunks and to reports, in one pass over the texts.

The pass parses a document into blocks (``structure.fold_blocks``), cuts them into sections at headings, and gives a parent for
each section and its children: items with the paragraphs they take in, packs of short bullets, and pieces of what is longer
than ``size``. It runs as an Arrow map over the documents, so no text is shuffled for it; only numbering the chunks of a
document is a window by its key.

A null, empty or blank text and a text without a page mark give no chunks but a report of severity ``error``. With
``first_page`` a text without marks is page ``first_page`` instead. Rows that repeat a key are documents by themselves only if
``key`` tells them apart: chunk numbers run over all rows of a key, in no defined order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import structure as S

SIZE, OVERLAP, ROOT = 1200, 100, "document-root"
#: The metadata of a child chunk.
METADATA = ["block_type", "item_marker", "item_level", "item_path", "logical_item_key", "logical_item_keys", "parent_item_key", "logical_table_key", "logical_code_key", "legal_unit_type", "split_index", "split_count"]
_STRINGS = pa.list_(pa.string())
_ROW = [
    ("kind", pa.string()), ("section", pa.int32()), ("child", pa.int32()), ("content", pa.string()), ("heading_path", _STRINGS), ("page_start", pa.int32()), ("page_end", pa.int32()),
    ("block_type", pa.string()), ("item_marker", pa.string()), ("item_level", pa.int32()), ("item_path", _STRINGS), ("logical_item_key", pa.string()), ("logical_item_keys", _STRINGS), ("parent_item_key", pa.string()),
    ("logical_table_key", pa.string()), ("logical_code_key", pa.string()), ("legal_unit_type", pa.string()), ("split_index", pa.int32()), ("split_count", pa.int32()),
    ("severity", pa.string()), ("code", pa.string()), ("confidence", pa.float64()),
]
_BLOCK = [f.split()[0] for f in S.BLOCK_SCHEMA.split(", ")]
_ITEMS = {"numbered_item", "lettered_item", "bullet_item"}
# What a block's problem means in a report.
PROBLEMS = {"item_level_jump": ("warning", 0.6), "unclosed_code_fence": ("error", 1.0)}


def checked_sizes(size: int, overlap: int) -> None:
    """A size above zero, and an overlap from zero to below it; anything else is an error before any job starts."""
    if size <= 0:
        raise ValueError(f"size must be above zero, not {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be from 0 to below size ({size}), not {overlap}")


def _pages(text: str, first_page: int | None) -> list[tuple[int, str]]:
    parts = re.split(S.PAGE_MARK, text)
    marked = list(zip(map(int, parts[1::2]), parts[2::2], strict=True))
    return marked or ([(first_page, text)] if first_page is not None else [])


def _sections(blocks: list[dict]) -> Iterator[list[dict]]:
    now: list[dict] = []
    for b in blocks:
        if b["block_type"] == "heading" and now:
            yield now
            now = []
        now.append(b)
    if now:
        yield now


def _unit(b: dict) -> dict:
    kind, own = b["block_type"], b["item_key"]
    return {
        "content": b["content"].strip(), "block_type": kind, "page_start": b["page_start"], "page_end": b["page_end"], "item_marker": b["item_marker"], "item_level": b["item_level"],
        "item_path": [] if kind == "heading" else b["item_path"], "logical_item_key": own if kind in _ITEMS else None, "logical_item_keys": [own] if kind in _ITEMS else [], "parent_item_key": b["parent_item_key"],
        "logical_table_key": own if kind == "table" else None, "logical_code_key": own if kind == "code" else None, "legal_unit_type": b["legal_unit"],
    }


def units(section: list[dict]) -> list[dict]:
    """What stands below a section's heading: an item takes in the paragraphs that follow it, all else is alone. A heading alone counts if it is an article."""
    out: list[dict] = []
    taking = False
    for b in section:
        if b["block_type"] == "heading":
            continue
        if taking and b["block_type"] == "paragraph":
            last = out[-1]
            last["content"] += "\n\n" + b["content"].strip()
            last["page_end"] = max(last["page_end"], b["page_end"])
            continue
        out.append(_unit(b))
        taking = b["block_type"] in _ITEMS or taking and b["block_type"] == "paragraph"
    if not out and section[0]["legal_unit"] == "article":
        out.append(_unit(section[0]))
    return out


def packed(rows: list[dict], size: int) -> Iterator[dict]:
    """Neighbouring bullets of one parent as one unit, while they and a line end for each are within ``size``."""
    pack: list[dict] = []
    used = 0

    def closed() -> Iterator[dict]:
        if len(pack) > 1:
            first = pack[0]
            yield first | {
                "content": "\n".join(u["content"] for u in pack), "block_type": "bullet_group", "page_start": min(u["page_start"] for u in pack), "page_end": max(u["page_end"] for u in pack),
                "item_marker": None, "item_level": None, "item_path": first["item_path"][:-1], "logical_item_key": None, "logical_item_keys": [k for u in pack for k in u["logical_item_keys"]],
            }
        else:
            yield from pack
        pack.clear()

    for u in rows:
        bullet = u["block_type"] == "bullet_item"
        if pack and not (bullet and u["parent_item_key"] == pack[0]["parent_item_key"] and used + len(pack) + len(u["content"]) <= size):
            yield from closed()
        if bullet:
            used = len(u["content"]) + (used if pack else 0)
            pack.append(u)
        else:
            yield u
    yield from closed()


def parts(unit: dict, size: int, overlap: int) -> list[str]:
    """A unit's pieces: tables by rows, code by lines, other text by separators."""
    text = unit["content"]
    if len(text) <= size:
        return [text]
    if unit["block_type"] == "table":
        return S.split_table(text, size)
    if unit["block_type"] == "code":
        return S.split_code(text, size)
    return S.recursive_split(text, size, overlap)


def document_rows(text: str | None, size: int, overlap: int, first_page: int | None = None) -> Iterator[dict]:
    """The parents, children and reports of one document, in order."""
    pages = _pages(text or "", first_page)
    if not (text or "").strip() or not pages:
        yield {"kind": "report", "severity": "error", "code": "no_page_mark" if (text or "").strip() else "empty_body", "confidence": 1.0}
        return
    lines = [(n, line) for n, body in pages for line in body.strip().splitlines()]
    blocks = [dict(zip(_BLOCK, b, strict=True)) for b in S.fold_blocks([x for _, x in lines], [n for n, _ in lines])]
    for b in blocks:
        if b["problem"]:
            severity, confidence = PROBLEMS[b["problem"]]
            yield {"kind": "report", "severity": severity, "code": b["problem"], "confidence": confidence} | {k: b[k] for k in ("content", "heading_path", "item_path", "page_start", "page_end", "block_type")}
    for number, section in enumerate(_sections(blocks)):
        head = section[0]
        path = [p.strip() for p in head["heading_path"] if p.strip()] if head["block_type"] == "heading" else [ROOT]
        span = {"page_start": min(b["page_start"] for b in section), "page_end": max(b["page_end"] for b in section)}
        yield {"kind": "parent", "section": number, "heading_path": path, "content": "\n\n".join(t for b in section if (t := b["content"].strip()))} | span
        below = units(section)
        if not below:
            yield {"kind": "report", "severity": "warning", "code": "context_only_parent", "confidence": 1.0, "section": number, "heading_path": path, "item_path": [], "content": head["content"], "block_type": "heading", "page_start": span["page_start"], "page_end": span["page_start"]}
        child = 0
        for unit in packed(below, size):
            pieces = parts(unit, size, overlap)
            for k, piece in enumerate(pieces):
                yield unit | {"kind": "child", "section": number, "child": child, "heading_path": path, "content": piece, "split_index": k, "split_count": len(pieces)}
                child += 1


def chunk_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, first_page: int | None = None) -> DataFrame:
    """(key, kind, section, child, ...): the pass over the documents, kinds parent, child and report."""
    checked_sizes(size, overlap)
    names = [n for n, _ in _ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at: list[int] = []
            rows: list[dict] = []
            room = 1 << 24
            for k in range(batch.num_rows):
                for row in document_rows(texts[k].as_py(), size, overlap, first_page):
                    at.append(k)
                    rows.append(row)
                    room -= len(row.get("content") or "")
                if rows and (room < 0 or k + 1 == batch.num_rows):
                    made = pa.RecordBatch.from_pylist(rows, pa.schema(_ROW))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *made.columns], [key, *names])
                    at, rows, room = [], [], 1 << 24

    kinds = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double", _STRINGS: "array<string>"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in _ROW)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def numbered(rows: DataFrame, key: str = "doc_id", version_key: str | None = None) -> DataFrame:
    """(key, chunk_key, parent_chunk_key, chunk_type, chunk_index, content, heading_path, page_start, page_end, token_count, metadata) from ``chunk_rows``.

    Chunk keys begin with the column ``version_key``, else with the key.
    """
    version = F.col(version_key or key).cast("string")
    order = Window.partitionBy(key).orderBy("section", F.col("child").isNotNull(), "child")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    parent = F.col("child").isNull()
    name = lambda mark, which: F.concat(version, F.lit(f"::{mark}::"), F.format_string("%04d", F.sum(F.when(which, 1).otherwise(0)).over(upto)))
    out = rows.where("kind <> 'report'").withColumns({"_p": name("p", parent), "_c": name("c", ~parent), "chunk_index": F.row_number().over(order) - 1})
    metadata = F.when(~parent, F.struct(*METADATA))
    return out.select(key, F.when(parent, F.col("_p")).otherwise(F.col("_c")).alias("chunk_key"), F.when(~parent, F.col("_p")).alias("parent_chunk_key"), F.col("kind").alias("chunk_type"), "chunk_index", "content", "heading_path", "page_start", "page_end", T.token_count("content").alias("token_count"), metadata.alias("metadata"))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, first_page: int | None = None) -> DataFrame:
    """The numbered chunks of all documents; see ``numbered``."""
    return numbered(chunk_rows(docs, key, text, size, overlap, first_page), key)


def chunk_reports(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, first_page: int | None = None) -> DataFrame:
    """(key, severity, code, page, content, heading_path, item_path, block_type, confidence) of all documents."""
    rows = chunk_rows(docs, key, text, size, overlap, first_page).where("kind = 'report'")
    return rows.select(key, "severity", "code", F.col("page_start").alias("page"), "content", "heading_path", "item_path", "block_type", "confidence")
