from pyspark.sql import functions as F

from docloom.operators import forms, repair, tables

FORM = """# CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM
<u>Độc lập - Tự do - Hạnh phúc</u>
**<u>ĐƠN XIN NGHỈ HỌC</u>**
Kính gửi: Ban Giám hiệu
- **Họ và tên**: An
**Ngày sinh:** 1/1
*Mã số**: 7
**Chú ý**: giữ
- ………

* Kèm theo hồ sơ

- a
- **Lớp**: b

```
- **Họ tên**: x
```
<table><tr><td>**Lớp**: y
**Lớp**: y</td></tr></table>
| **Lớp**: z |
**Lớp**: q"""
WANT = """**CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM**
**Độc lập - Tự do - Hạnh phúc**
# ĐƠN XIN NGHỈ HỌC
**Kính gửi : Ban Giám hiệu**
Họ và tên: An
Ngày sinh: 1/1
Mã số: 7
**Chú ý**: giữ
- ………

- Kèm theo hồ sơ

- a
- Lớp: b

```
- **Họ tên**: x
```
<table><tr><td>**Lớp**: y
**Lớp**: y</td></tr></table>
| **Lớp**: z |
Lớp: q"""


def lines(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", forms.is_form(F.col("text")).alias("is_form"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    got: dict = {}
    for r in forms.form_lines(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    return {k: "\n".join(v) for k, v in got.items()}


def test_a_form_and_a_text_that_is_none(spark):
    other = "**Họ và tên**: An\n- **Lớp**: b"
    got = lines(spark, [(1, FORM), (2, other), (3, "")])
    assert got[1].split("\n") == WANT.split("\n") and got[2] == other and got[3] == ""


def test_single_bullets_of_fields_blanks_and_notes_lose_their_mark(spark):
    text = "Kính gởi: X\ntext\n- **Địa chỉ**: Y\ntext\n- ……\ntext\n- (Kèm theo bản sao)\ntext\n- a real item\ntext\n- one, lớp: 5"
    assert lines(spark, [(1, text)])[1].split("\n") == ["**Kính gởi : X**", "text", "Địa chỉ: Y", "text", "……", "text", "(Kèm theo bản sao)", "text", "- a real item", "text", "one, lớp: 5"]


def test_cues_count_in_the_first_characters_only(spark):
    df = spark.createDataFrame([("x " * 3990 + "biểu mẫu",), ("x " * 4000 + "biểu mẫu",), ("biểu\nmẫu",), ("biểumẫu",), (None,)], "t string").select(forms.is_form(F.col("t")).alias("f"))
    assert [r.f for r in df.collect()] == [True, False, True, False, False]


CHAIN = """a
<table><thead><tr><th>TT</th><th>Nội dung</th></tr></thead><tr><td>1</td><td>Truy thu, cảnh </td></tr></table>

---
<!-- page: 2 -->
2
<table><thead><tr><th>cáo toàn khu</th></tr></thead><tr><td>2</td><td>lần ba, cảnh</td></tr></table>
<!-- page: 3 -->
<table><thead><tr><th>cáo thứ hai</th></tr></thead><tr><td>3</td><td>c</td></tr></table>
real text
<table><thead><tr><th>cáo khác</th></tr></thead><tr><td>4</td></tr></table>"""
JOINED = """a
<table><thead><tr><th>TT</th><th>Nội dung</th></tr></thead><tr><td>1</td><td>Truy thu, cảnh cáo toàn khu</td></tr></table>

---
<!-- page: 2 -->
2
<table><tr><td>2</td><td>lần ba, cảnh cáo thứ hai</td></tr></table>
<!-- page: 3 -->
<table><tr><td>3</td><td>c</td></tr></table>
real text
<table><thead><tr><th>cáo khác</th></tr></thead><tr><td>4</td></tr></table>"""


def test_a_chain_of_three_pages(spark):
    df = spark.createDataFrame([(1, CHAIN), (2, "no table"), (3, None), (4, "<table></table>")], "id long, text string").select("id", tables.continued(F.col("text")).alias("t"))
    assert {r.id: r.t for r in df.collect()} == {1: JOINED, 2: "no table", 3: None, 4: "<table></table>"}


def test_tables_become_pipe_tables_in_place(spark):
    df = spark.createDataFrame([(1, JOINED), (2, "x"), (3, None)], "id long, text string")
    got = {r.id: r.text for r in tables.with_pipe_tables(df).collect()}
    assert got[2] == "x" and got[3] is None and got[1].startswith("a\n| TT | Nội dung |\n| --- | --- |\n| 1 | Truy thu, cảnh cáo toàn khu |\n\n---\n<!-- page: 2 -->") and "<table" not in got[1]


def test_postprocess_keeps_front_matter_and_every_document(spark):
    whole = "---\ntitle: x\n---\n" + FORM + "\n" + CHAIN
    df = spark.createDataFrame([(1, whole), (2, None), (3, "*\\*"), (4, ""), (5, "---\nnever closed"), (6, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in repair.postprocessed(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2] == got[3] == got[4] == "\n" and got[5] == "---\nnever closed\n" and got[6] == "plain\n"
    assert got[1].startswith("---\ntitle: x\n---\n\n**CỘNG HÒA") and "# ĐƠN XIN NGHỈ HỌC" in got[1] and "| 1 | Truy thu, cảnh cáo toàn khu |" in got[1] and "<!-- page: 2 -->" in got[1]


def test_lines_are_dealt_by_document_into_bounded_parts(spark, monkeypatch):
    from docloom.operators import repair as M
    from docloom.sources import shared

    rows = spark.createDataFrame([(k, n, line) for k in range(30) for n, line in enumerate(("# A", "### 1.1. b", "1.2. c", "### 1.3. d", "# A:"))], "doc_id long, pos int, line string")
    monkeypatch.setattr(shared, "PART_ROWS", 10)
    out = M.repaired_headings(rows)
    got = {r.doc_id: r.lines for r in out.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines")).collect()}
    assert got == dict.fromkeys(range(30), ["# A", "### 1.1. b", "### 1.2. c", "### 1.3. d", "**A:**"])
    # one shuffle, by the number of rows, serves every window
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(doc_id") == plan.count(", 15), REPARTITION_BY_NUM") > 0
