import random

import pyarrow as pa
import pytest

from docloom.operators import chunking as K
from docloom.operators import structure as S
from docloom.operators.structure import recursive_split

TEXT = """dropped
<!-- page: 1 -->
before any heading

# Điều 1. Scope
1. First
more of it

and again
a) Lettered
- one
- two
- three
<!-- page: 2 -->
| a | b |
|---|---|
| 1 | 2 |
after the table
## Empty
## Điều 2. Bare
1.2.3. Deep
```
open
"""


def chunks(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(K.chunk_documents(df, **kw).collect(), key=lambda r: (r.doc_id, r.chunk_index)), K.chunk_reports(df, **kw).collect()


def test_parents_children_and_reports(spark):
    got, reports = chunks(spark, [(7, TEXT)])
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert [(r.chunk_key, r.heading_path, r.page_start, r.page_end) for r in got if r.chunk_type == "parent"] == [
        ("7::p::0001", ["document-root"], 1, 1), ("7::p::0002", ["Điều 1. Scope"], 1, 2), ("7::p::0003", ["Điều 1. Scope", "Empty"], 2, 2), ("7::p::0004", ["Điều 1. Scope", "Điều 2. Bare"], 2, 2),
    ]
    below = [(r.parent_chunk_key, r.metadata.block_type, r.content) for r in got if r.chunk_type == "child"]
    assert below == [
        ("7::p::0001", "paragraph", "before any heading"), ("7::p::0002", "numbered_item", "1. First\n\nmore of it\n\nand again"), ("7::p::0002", "lettered_item", "a) Lettered"),
        ("7::p::0002", "bullet_group", "- one\n- two\n- three"), ("7::p::0002", "table", "| a | b |\n|---|---|\n| 1 | 2 |"), ("7::p::0002", "paragraph", "after the table"),
        ("7::p::0004", "numbered_item", "1.2.3. Deep"), ("7::p::0004", "code", "```\nopen"),
    ]
    group = next(r.metadata for r in got if r.chunk_type == "child" and r.metadata.block_type == "bullet_group")
    assert (group.item_path, group.logical_item_keys, group.parent_item_key, group.legal_unit_type, group.item_marker) == (["1. First", "a) Lettered"], ["item:000006", "item:000007", "item:000008"], "item:000005", "bullet", None)
    assert sorted((r.severity, r.code, r.page, r.confidence) for r in reports) == [("error", "unclosed_code_fence", 2, 1.0), ("warning", "context_only_parent", 2, 1.0), ("warning", "item_level_jump", 2, 0.6)]


def test_an_article_alone_is_its_own_content(spark):
    got, reports = chunks(spark, [(1, "<!-- page: 3 -->\n# Điều 9. Alone")])
    assert [(r.chunk_type, r.content) for r in got] == [("parent", "# Điều 9. Alone"), ("child", "# Điều 9. Alone")] and got[1].metadata.block_type == "heading" and reports == []


def test_sizes_split_tables_code_text_and_part_bullets(spark):
    table = "| h | i |\n|---|---|\n" + "\n".join(f"| {k} | row |" for k in range(40))
    code = "```py\n" + "\n".join(f"x = {k}" for k in range(60)) + "\n```"
    text = " ".join(f"word{k}" for k in range(200))
    bullets = "\n".join(f"- {'b' * 60}{k}" for k in range(5))
    got, _ = chunks(spark, [(1, f"<!-- page: 1 -->\n{text}\n{table}\n{code}\n{bullets}")], size=200, overlap=20)
    by: dict = {}
    for r in got:
        if r.chunk_type == "child":
            assert len(r.content) <= 200
            by.setdefault(r.metadata.block_type, []).append(r)
    assert set(by) == {"paragraph", "table", "code", "bullet_group"}
    assert [r.metadata.split_index for r in by["table"]] == list(range(by["table"][0].metadata.split_count)) and all(r.content.startswith("| h | i |\n|---|---|\n") for r in by["table"])
    assert sum(r.content.count("| row |") for r in by["table"]) == 40
    assert all(r.content.startswith("```py\n") and r.content.endswith("\n```") for r in by["code"]) and sum(r.content.count("x = ") for r in by["code"]) == 60
    assert [len(r.metadata.logical_item_keys) for r in by["bullet_group"]] == [3, 2]


def test_odd_texts_and_parameters(spark):
    got, reports = chunks(spark, [(1, None), (2, ""), (3, " \n "), (4, "no mark")])
    assert got == [] and sorted((r.doc_id, r.severity, r.code) for r in reports) == [(1, "error", "empty_body"), (2, "error", "empty_body"), (3, "error", "empty_body"), (4, "error", "no_page_mark")]
    got, reports = chunks(spark, [(4, "no mark")], first_page=1)
    assert [r.content for r in got] == ["no mark", "no mark"] and reports == []
    assert chunks(spark, []) == ([], [])
    for size, overlap in ((0, 0), (-1, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            K.checked_sizes(size, overlap)


def test_a_long_text_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "<!-- page: 1 -->\n" + "- bullet\n" * 50_000, "x", 3)], "doc_id long, text string, content string, section int")
    got = K.chunk_documents(df).where("chunk_type = 'child'")
    assert got.selectExpr("sum(size(metadata.logical_item_keys)) as n").first().n == 50_000


def test_splitter_keeps_every_word():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice([f"word{n} ", f"<{n}>", " ", " ", f"{n}. ", "\n", "\n\n", f"{n:030d}"]) for n in range(1000, 1000 + rnd.randint(1, 120)))
        if not text.strip():
            continue
        pieces = recursive_split(text, 40, 8)
        assert all(0 < len(p) <= 40 for p in pieces)
        whole, out = "".join(text.split()), ""
        for p in ("".join(p.split()) for p in pieces):  # each piece goes on where the one before ends, or up to the overlap before
            shared = [k for k in range(min(8, len(p)) + 1) if out.endswith(p[:k]) and whole.startswith(out + p[k:])]
            assert shared
            out += p[shared[0] :]
        assert out == whole


def test_blocks_are_handed_on_in_parts(spark, monkeypatch):
    lines = "\n".join(f"# h{n}\n1. a{n}\n- b{n}\n\nc{n}" for n in range(200))
    monkeypatch.setattr(S, "ROOM", 1 << 14)
    batch = pa.RecordBatch.from_pylist([{"k": k, "pages": [{"page_number": 1, "content": lines}] if k < 5 else []} for k in range(6)])
    parts = list(S.block_batches([batch], "k"))
    assert len(parts) > 20 and max(p.num_rows for p in parts) < 100 and sum(p.num_rows for p in parts) == 5 * 800
    docs = spark.createDataFrame([(k, f"<!-- page: 1 -->\n{lines}" if k < 5 else "") for k in range(6)], "k long, text string")
    got = sorted(map(tuple, S.blocks(S.pages(docs, "k"), "k").select("k", "source_order", "block_type", "content", "item_key", "parent_item_key").collect()))
    assert got == sorted((r["k"], r["source_order"], r["block_type"], r["content"], r["item_key"], r["parent_item_key"]) for p in parts for r in p.to_pylist())
    assert got[1:4] == [(0, 1, "numbered_item", "1. a0", "item:000001", None), (0, 2, "bullet_item", "- b0", "item:000002", "item:000001"), (0, 3, "paragraph", "c0", None, None)]
