"""Registered queries over Markdown repair and structure: fixtures with their expected rows, and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import questions as Q
from docloom.operators import forms
from docloom.operators import repair as M
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.operators import tables as B
from docloom.plans.chunking import CHUNKS_SQL, marked_documents
from docloom.plans.documents import LINES_SQL, PATH_SQL, levelled
from docloom.plans.queries import ASKED_SQL, TREE_SQL, _abbrev_sql, asked, query, tree, values
from docloom.sources.shared import dealt


def _numbered(df):
    return df.selectExpr("doc_id", "cast(row_number() over (partition by doc_id order by pos) - 1 as int) as pos", "line")


RAW = """# **Rules**
**## 1. Scope**
1.1. First
### 1.2. Second
### 1.3. Third
1.4. Fourth
## 2. Terms
2.1. Alpha
2.2. Beta
```
# not a heading
2.3. nor this
```
# Rules:
#  rules
### Điều 1. A
## Điều 2. B
## Điều 3. C
Điều 4. D"""
# family 1: (1.x) has two marked ones at level 3, so 1.1 and 1.4 join; 2.x has none marked, but 2 is, and depth 2 has level 3
REPAIRED = """# **Rules**
**## 1. Scope**
### 1.1. First
### 1.2. Second
### 1.3. Third
### 1.4. Fourth
## 2. Terms
### 2.1. Alpha
### 2.2. Beta
```
# not a heading
2.3. nor this
```
# Rules:
**rules**
## Điều 1. A
## Điều 2. B
## Điều 3. C
## Điều 4. D"""


def _over_documents(read, text: str, mark: str = ". "):
    """The lines of a text for every document, its number after the ones that have the mark."""
    rows = F.transform(F.split(F.lit(text), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    out = read("documents").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.pos", "r.line")
    return out.withColumn("line", F.when(F.col("line").contains(mark), F.concat("line", F.lit(" "), "doc_id")).otherwise(F.col("line")))


def _over_documents_sql(text: str, mark: str = ". ") -> str:
    rows = values([(k, x) for k, x in enumerate(text.split(chr(10)))], "n, line")
    return f"select doc_id, n as pos, line || case when contains(line, '{mark}') then ' ' || doc_id else '' end as line from documents, {rows}"


@query(_over_documents_sql(REPAIRED))
def heading_repair(spark, read):
    return _numbered(M.repaired_headings(_over_documents(read, RAW)))


TABLES = """before
a | b
--- | ---
1 | x | |
-- | --- | |
2 | y |
after
| Điều 8 | Điều 8 | Điều 8 | | |
| | | | | |
| short | short | short | z | |
| a. Long item | a. Long item | 3 | | |

| The very same long header<br/>One | The very same long header<br>Two | Cột 3 |
|:--|--|--|
| 5 | 5 | |
<!-- page: 1 | 2 -->"""
TIDY = """before
| a | b |
| --- | --- |
| 1 | x |
| 2 | y |
after
| Điều 8 |  |  |  |
| --- | --- | --- | --- |
|  |  |  |  |
| short | short | short | z |
| a. Long item | 3 |  |  |

| One | Two |
| --- | --- |
| 5 | 5 |
<!-- page: 1 | 2 -->"""


@query(_over_documents_sql(TIDY, "before"))
def md_table(spark, read):
    return _numbered(M.repaired_tables(_over_documents(read, TABLES, "before")))


@query("select page_id, '| p' || page_id || ' | ' || case when page_id % 2 = 0 then 'b. x | 7' else 'same | same' end || ' |' as line from pages")
def cell_runs(spark, read):
    """A row for every page: section cells that repeat become one, short ones stay."""
    i = F.col("page_id")
    line = F.concat(F.lit("p"), i, F.when(i % 2 == 0, "|b. x|b. x| b. x |7").otherwise("|same|same"))
    cells = M.compacted(M.row_cells(F.col("line")))
    return read("pages").select("page_id", line.alias("line")).select("page_id", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


_MARK = "case when pos % 7 = 0 and line <> '' then '**# ' || line || '**' when pos % 7 = 1 then {0} || line when pos % 7 = 2 then {1} || line when pos % 11 = 3 then '```' else line end"
_W = "over (partition by doc_id order by pos rows between unbounded preceding and current row)"


@query(f"""with {LINES_SQL}, m as (select doc_id, pos, line, {_MARK.format("chr(92) || '- '", "'12' || chr(92) || '. '")} as raw from l), f as (select *, raw like '```%' or (sum(case when raw like '```%' then 1 else 0 end) {_W}) % 2 = 1 as in_fence from m)
  select doc_id, pos, case when in_fence then raw when pos % 7 = 0 and line <> '' then '# ' || line when pos % 7 = 1 then '- ' || line when pos % 7 = 2 then '12. ' || line else raw end as line from f""")
def md_lines(spark, read):
    raw = F.expr(_MARK.format("concat(char(92), '- ')", "concat('12', char(92), '. ')"))
    return M.unescaped(levelled(read).select("doc_id", "pos", raw.alias("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query(f"""with {LINES_SQL}, b as (select doc_id, pos, pos % 3 > 0 and pos % 5 <> 4 as bullet from l where trim(line) <> '') select doc_id, pos, coalesce(lag(bullet) over w, false) and coalesce(lead(bullet) over w, false) as inside from b window w as (partition by doc_id order by pos)""")
def bullet_run(spark, read):
    rows = levelled(read).where("trim(line) <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), F.when((F.col("pos") % 3 > 0) & (F.col("pos") % 5 != 4), F.concat(F.lit(" - "), "line")).otherwise(F.concat(F.lit("x"), "line")).alias("line"))
    return M.bullet_inside(rows).select("doc_id", "pos", "inside")


@query(f"with {LINES_SQL}, c as (select doc_id, pos % 4 as family, level, count(*) as n, min(pos) as first from l where level is not null group by all) select doc_id, family::bigint as family, level::bigint as canon, sum(n) over (partition by doc_id, family)::bigint as n from c qualify row_number() over (partition by doc_id, family order by n desc, first) = 1")
def heading_mode(spark, read):
    rows = levelled(read).where("level is not null").withColumn("family", (F.col("pos") % 4).cast("long"))
    return M.heading_modes(rows).select("doc_id", "family", F.col("canon").cast("long").alias("canon"), "n")


@query(f"""with {LINES_SQL}, k as (select doc_id, pos, 'h' || (pos % 3) as h, level from l), r as (select *, row_number() over (partition by doc_id, h, level = 1 order by pos) as n from k)
  select doc_id, pos, case when level is null then 'text' when level = 1 and n > 1 then '**' || h || '**' when level = 1 then '# ' || h else '## ' || h end as line from r""")
def h1_dedupe(spark, read):
    h = F.concat(F.lit("h"), F.col("pos") % 3)
    line = F.when(F.col("level").isNull(), "text").when(F.col("level") == 1, F.concat(F.lit("# "), h)).otherwise(F.concat(F.lit("## "), h))
    return M.repaired_headings(levelled(read).select("doc_id", "pos", line.alias("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("select doc_id, '- a' || chr(10) || '# Head ' || doc_id || chr(10) || '```' || chr(10) || chr(92) || '- kept' || chr(10) || '```' || chr(10) || '1. b' || chr(10) || chr(10) || chr(10) || '**Head ' || doc_id || '**' || chr(10) || '| x | ' || doc_id || ' |' || chr(10) || '| --- | --- |' || chr(10) as text from documents")
def postprocess(spark, read):
    i = F.col("doc_id")
    raw = F.concat(F.lit("\n\\- a\n**# Head "), i, F.lit("**\n```\n\\- kept\n```\n1\\. b\n*\\*\n\n\n\n# Head "), i, F.lit("\nx | "), i, F.lit(" | |\n--- | --- |\n\n"))
    return M.postprocessed(read("documents").select("doc_id", raw.alias("text")))


@query(f"with {CHUNKS_SQL} select doc_id, page as page_number, count(*) + 2 * count(case when k = 6 then 1 end) as n_lines from m group by doc_id, page")
def page_split(spark, read):
    p = S.pages(marked_documents(read))
    return p.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query("select doc_id, k as page_number, 'body ' || doc_id || ' of ' || k as content from documents, (values (1), (2), (3)) as p(k) where k <= 1 + doc_id % 3")
def page_split_table(spark, read):
    page = lambda k: F.concat(F.lit(f"\n<!-- page: {k} -->\n\nbody "), F.col("doc_id"), F.lit(f" of {k}\n"))
    text = F.concat(F.lit("dropped"), page(1), F.when(F.col("doc_id") % 3 > 0, page(2)).otherwise(""), F.when(F.col("doc_id") % 3 > 1, page(3)).otherwise(""))
    return S.pages(read("documents").select("doc_id", text.alias("text"))).select("doc_id", "page_number", F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")).alias("content"))


@query(f"""with {TREE_SQL} select query_id, chunk_key, count(*) as n from (select query_id, chunk_key from h group by all) group by all""")
def expand_dedupe(spark, read):
    """Every direct hit comes once, whatever else finds it again."""
    h, c = tree(read)
    n = read("lineitem").count()
    found = R.expand(h, c, rows=n).select("query_id", "chunk_key", F.lit(1).alias("found"), F.lit(False).alias("direct"))
    both = found.unionByName(h.select("query_id", "chunk_key", F.lit(0).alias("found"), F.lit(True).alias("direct")))
    each = dealt(both, "query_id", "chunk_key", rows=2 * n).groupBy("query_id", "chunk_key").agg(F.sum("found").alias("n"), F.bool_or("direct").alias("direct"))
    return each.where("direct and n > 0").select("query_id", "chunk_key", "n")


@query(f"with {ASKED_SQL}, a as (select conv_id * 1000 + turn as query_id, longer as q, {_abbrev_sql('longer')} as e from asked) select query_id, 1 as position, q as query from a where trim(q) <> '' union all select query_id, 2, e from a where trim(q) <> '' and e <> q")
def q_variants(spark, read):
    """Every variant of every question, as the stand-in rewriter gives them."""
    return Q.offline_variants(asked(read).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("longer").alias("question")))


_FORM = {0: ("'**Họ và tên**: ' || h", "'Họ và tên: ' || h"), 1: ("'**Ngày sinh:** ' || h", "'Ngày sinh: ' || h"), 2: ("'- **Địa chỉ**: ' || h", "'Địa chỉ: ' || h"), 3: ("'*Mã số**: ' || h", "'Mã số: ' || h"), 4: ("'**' || h || '**: x'", None), 5: ("'- ' || h", None), 6: ("'- **Lớp**: ' || h", "'- Lớp: ' || h"), 7: ("'Kính gửi: ' || h", "'**Kính gửi : ' || h || '**'"), 8: ("'| **Lớp**: ' || h || ' |'", None), 9: ("'<u>Đơn xin ' || h || '</u>'", "'# Đơn xin ' || h")}
_RAW = "case " + " ".join(f"when pos % 10 = {k} then {'case when doc_id % 3 = 0 then ' + raw + ' else h end' if k in (7, 9) else raw}" for k, (raw, _) in _FORM.items()) + " end"
_DONE = "case when doc_id % 3 <> 0 then raw " + " ".join(f"when pos % 10 = {k} then {done}" for k, (_, done) in _FORM.items() if done) + " else raw end"


@query(f"with {LINES_SQL}, m as (select doc_id, pos, md5(line) as h from l), r as (select *, {_RAW} as raw from m) select doc_id, pos, {_DONE} as line from r union all select doc_id, -1, 'Biểu mẫu ' || doc_id from documents where doc_id % 3 = 0")
def form_norm(spark, read):
    """Every third document a form: its labels, bullets, salutations and titles are repaired, all other texts stay."""
    title = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit(-1).alias("pos"), F.concat(F.lit("Biểu mẫu "), F.col("doc_id")).alias("line")))).otherwise(F.array().cast("array<struct<pos:int,line:string>>"))
    rows = read("documents").select("doc_id", title.alias("title"), F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.md5(x).alias("h"))).alias("rows"))
    made = rows.select("doc_id", "title", F.explode("rows").alias("r")).select("doc_id", "title", "r.pos", "r.h").select("doc_id", "title", "pos", F.expr(_RAW).alias("line"))
    whole = made.groupBy("doc_id").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows")).select("doc_id", F.concat("title", "rows").alias("rows"))
    gated = whole.withColumn("is_form", forms.is_form(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")))
    out = forms.form_lines(gated.select("doc_id", "is_form", F.explode("rows").alias("r")).select("doc_id", "is_form", "r.pos", "r.line"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("""with p as (select page_id // 3 as doc_id, page_id % 3 + 1 as n, page_id, 'cáo ' || md5(url) as rest from pages), t as (select *, lag(n) over w is null as first, lead(rest) over w as after from p window w as (partition by doc_id order by n))
  select doc_id, string_agg('<!-- page: ' || n || ' -->' || chr(10) || chr(10) || '<table>' || case when n = 1 then '<thead><tr><th>Nội dung</th></tr></thead>' when first then '<thead><tr><th>' || rest || '</th></tr></thead>' else '' end || '<tr><td>' || page_id || '</td><td>thu, cảnh' || case when after is not null then ' ' || after else '' end || '</td></tr></table>', chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) as text from t group by doc_id""")
def table_continue(spark, read):
    """Three pages each as one document: a table on every page, whose false head is the rest of the cell that the page before cut."""
    head = F.when(F.col("page_id") % 3 == 0, "Nội dung").otherwise(F.concat(F.lit("cáo "), F.md5("url")))
    table = F.concat(F.lit("<table><thead><tr><th>"), head, F.lit("</th></tr></thead><tr><td>"), F.col("page_id"), F.lit("</td><td>thu, cảnh</td></tr></table>"))
    docs = S.rendered(read("pages").select(F.floor(F.col("page_id") / 3).alias("doc_id"), (F.col("page_id") % 3 + 1).alias("page_number"), table.alias("content")))
    return docs.select("doc_id", B.continued(F.col("text")).alias("text"))


_ = PATH_SQL
