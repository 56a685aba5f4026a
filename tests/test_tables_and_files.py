import re

from pyspark.sql import functions as F

from docloom.operators import structure as S
from docloom.operators import tables as B
from docloom.sources import files as X


def test_spans_and_headers():
    source = "<table><thead><tr><th>A</th><th colspan='2'>B</th></tr><tr><th>A</th><th>x</th><th></th></tr></thead><tr><td rowspan=3>12</td><td rowspan=2>p</td><td>q|r</td></tr><tr><td>s</td></tr><tr><td>t</td></tr></table>"
    assert B.page_tables(source) == [("| A | B / x | B |\n| --- | --- | --- |\n| 12 | p | q\\|r |\n|  | p | s |\n|  | t |  |", False)]
    assert B.page_tables("<table><tr><td>1</td></tr></table>") == [("| Cột 1 |\n| --- |\n| 1 |", False)]
    assert B.page_tables("no table") == B.page_tables("") == []
    assert B.page_tables("<table><tr><td>a<BR/> b&nbsp;<em>c</em><u>d</u><tr><td rowspan=99999999 colspan='3'>x</td></table>") == [("| Cột 1 | Cột 2 | Cột 3 |\n| --- | --- | --- |\n| a<br>b\xa0*c*d |  |  |\n| x | x | x |", False)]


def test_null_and_empty_pages(spark):
    rows = B.html_tables(spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td>x</td></tr></table>")], "page_id long, html string")).collect()
    assert [(r.page_id, r.place) for r in rows] == [(3, 0)]


def test_front_matter_round_trip(spark):
    text = "---\r\ntitle: 'a: b'\r\n# note\r\nlist:\r\n  - x\r\n\r\n  - \"y\"\r\nempty:\r\n---\r\n\r\nbody\r\n"
    d = X.split_front_matter(spark.createDataFrame([(1, text), (2, None), (3, "---\na: b\n---\n \n"), (4, "---\na: b")], "id int, text string"))
    got = {r.id: (r.fields, r.body, r.error) for r in d.collect()}
    assert got[1] == ({"title": ["a: b"], "list": ["x", "y"], "empty": []}, "body", None)
    assert [got[k][2] for k in (2, 3, 4)] == ["no_front_matter", "empty_body", "front_matter_not_closed"]
    again = d.where("id = 1").select(X.render_front_matter(F.col("fields"), F.col("body"), ["title", "list", "empty"]).alias("t")).first().t
    assert again == "---\ntitle: a: b\nlist:\n  - x\n  - y\nempty: []\n---\n\nbody\n"


def test_front_matter_is_read_once_and_as_its_pattern_says(spark):
    texts = [a + b + c for a in ("", "---\n", "---\r\n", " ---\n") for b in ("", "a: 1\nb: [x]\na: é\n", "\n", "---", "a: 2\r\n- x\r") for c in ("", "---\n", "---\nbody\n---\nmore \n\n", "---  \n\n\nbody  \n", "---\n \t\n", "---")]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for strict in (True, False):
        d = X.split_front_matter(docs, strict=strict)
        assert d.columns == ["id", "text", "fields", "body", "error"]
        # a step that a lambda names is done again for every key
        assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
        for r in d.collect():
            t = re.sub("\r\n?", "\n", r.text)
            t = t if strict else re.sub(r"(?m)^---[ \t]+$", "---", t)
            m = re.match(r"(?s)\A---\n(.*?)\n---\n(.*)\Z", t)
            assert (r.fields != {}) == bool(m and ":" in m[1]), r
            if m and "a: é" in m[1]:
                assert r.fields == {"b": ["[x]"], "a": ["é"]}
            if strict:
                error = "no_front_matter" if not t.startswith("---\n") else "front_matter_not_closed" if not m else "empty_body" if not m[2].strip() else None
                assert (r.error, r.body) == (error, None if error else m[2].strip()), r
            else:
                assert (r.error, r.body) == (None, m[2].lstrip("\n") if m else r.text), r


def test_whole_files_and_types(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo")
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "z.png").write_bytes(b"GIF89a")
    assert [r.text for r in X.whole_texts(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    kinds = {r.path.rsplit("/", 1)[1]: r.source_type for r in X.binaries(spark, str(tmp_path)).collect()}
    assert kinds == {"x.md": "md", "y.pdf": "pdf", "z.png": None}


def test_cases_from_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿id,answerable,reference_facts\nE1,True,"[""f, 1""]"\n', encoding="utf-8")
    r = X.read_cases(spark, str(path)).first()
    assert (r.id, r.answerable, r.reference_facts) == ("E1", True, ["f, 1"])


def test_child_units(spark):
    text = "<!-- page: 1 -->\nlead\n# A\n1. one\n\nmore\n\n```\nx\n```\n\nalone\n# B\n# Điều 7\n"
    rows = S.child_units(S.blocks(S.pages(spark.createDataFrame([(1, text)], "doc_id long, text string")))).orderBy("unit").collect()
    assert [(r.block_type, r.content, r.warning) for r in rows] == [
        ("paragraph", "lead", None), ("numbered_item", "1. one\n\nmore", None), ("code", "```\nx\n```", None), ("paragraph", "alone", None),
        ("heading", None, "context_only_parent"), ("heading", "# Điều 7", None),
    ]


def test_capital_accents(spark):
    from docloom.functions import text as T

    row = spark.createDataFrame([("Điều ĐẠI HỌC Ỹ Ÿ đ ư Ư",)], "x string").select(T.strip_accents("x").alias("y")).first()
    assert row.y == "Dieu DAI HOC Y Y d u U"
