"""Registered queries over sources, front matter, tables and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import questions as Q
from docloom.functions import text as T
from docloom.operators import retrieval as R
from docloom.operators import tables as B
from docloom.plans.queries import QUERIES, QUESTIONS, TREE_SQL, collapse_sql, query, tree, values
from docloom.sources import files as X
from docloom.sources import objects
from docloom.sources.shared import shared_folder


def _binary_files(spark, sf_dir):
    return X.binaries(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


def _whole_texts(spark, sf_dir):
    """Each part file of the regions table as one text: what matters is one row a file."""
    return X.whole_texts(spark, f"{sf_dir}/region.parquet", "*.parquet").select(F.length("text").alias("n_chars"))


QUERIES["src_wholetext"] = _whole_texts
QUERIES["src_binaries"] = _binary_files


@query("""select doc_id, case doc_id % 6 when 0 then 'md' when 1 then 'pdf' when 2 then null when 3 then 'image' when 4 then null else 'docx' end as kind from documents""")
def sniff_type(spark, read):
    k = F.col("doc_id") % 6
    name = F.when(k == 0, "a.markdown").when(k <= 2, "b.PDF").when(k == 3, "c.webp").when(k == 4, "d.exe").otherwise("e.docx")
    head = F.when(k == 1, "%PDF-1.7").when(k == 3, "RIFFxxxxWEBP").when(k == 5, "PK\x03\x04[Content_Types].xml word/document.xml PK\x05\x06").otherwise("")
    return read("documents").select("doc_id", X.source_type(name, F.encode(F.concat(head, "text"), "UTF-8")).alias("kind"))


FRONT = "concat('---', chr(10), 'title: \"T ', doc_id, '\"', chr(10), 'is_latest: True', chr(10), 'notes:', chr(10), 'audience:', chr(10), '  - student', chr(10), '  - ', lang, chr(10), 'title_vi: x', chr(10), case when doc_id % 7 = 0 then '' else concat('---', chr(10)) end, case when doc_id % 5 = 0 then '' else replace(text, '---', '***') end)"
FRONT_SQL = """select doc_id, case when doc_id % 7 = 0 then null else 'T ' || doc_id end as title, case when doc_id % 7 = 0 then null else 'true' end as is_latest,
  case when doc_id % 7 = 0 then null else 'student,' || lang end as audience, case when doc_id % 7 = 0 then null else 0::bigint end as n_notes"""


def _front(read, strict):
    d = X.split_front_matter(read("documents").select("doc_id", "lang", F.expr(FRONT).alias("text")), strict=strict)
    get = lambda k: F.element_at("fields", k)
    return d, d.select("doc_id", get("title")[0].alias("title"), get("is_latest")[0].alias("is_latest"), F.array_join(get("audience"), ",").alias("audience"), F.size(get("notes")).cast("long").alias("n_notes"), *(["error"] if strict else []))


@query(f"{FRONT_SQL}, case when doc_id % 7 = 0 then 'front_matter_not_closed' when doc_id % 5 = 0 or trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 'empty_body' end as error from documents")
def fm_split(spark, read):
    return _front(read, True)[1]


@query(f"{FRONT_SQL} from documents")
def fm_lenient(spark, read):
    return _front(read, False)[1]


@query("select doc_id, '---' || chr(10) || 'title: T ' || doc_id || chr(10) || 'audience:' || chr(10) || '  - student' || chr(10) || '  - ' || lang || chr(10) || 'notes: []' || chr(10) || '---' || chr(10) || chr(10) || 'b' || doc_id || chr(10) as t from documents")
def fm_render(spark, read):
    d = X.split_front_matter(read("documents").select("doc_id", F.expr(FRONT.replace("doc_id % 7 = 0", "false")).alias("text")), strict=False)
    return d.select("doc_id", X.render_front_matter(F.col("fields"), F.concat(F.lit("\n b"), F.col("doc_id"), F.lit(" ")), ["title", "audience", "missing", "notes"]).alias("t"))


@query("""select 'R' || item_id as id, case item_id % 3 when 0 then item_id || '-' || (item_id + 2) when 2 then item_id || '-' || item_id end as pages, case item_id % 3 when 0 then 'a b|' || md5(text) when 1 then 'one ' || md5(text) || '|two' else '' end as spans,
  item_id % 2 = 0 as answerable, case item_id % 3 when 0 then 'k' || item_id when 1 then '' end as keys from benchmark""")
def bench_read(spark, read):
    """Cells as an evaluation file has them: JSON lists, spans parted by bars, truth values as words, page bounds that may be blank."""
    i, k, h = F.col("item_id").cast("string"), F.col("item_id") % 3, F.md5("text")
    cells = read("benchmark").select(
        F.concat(F.lit("R"), i).alias("id"), F.when(k == 1, "").otherwise(i).alias("page_hint_start"), F.when(k == 0, (F.col("item_id") + 2).cast("string")).otherwise(i).alias("page_hint_end"),
        F.when(k == 0, F.to_json(F.array(F.lit("a b"), h))).when(k == 1, F.concat(F.lit("one "), h, F.lit(" || two ||"))).otherwise("").alias("gold_answer_spans"),
        F.element_at(F.array(*map(F.lit, ("True", "no", "1", "false", "yes", ""))), (F.col("item_id") % 6 + 1).cast("int")).alias("answerable"), F.when(k == 0, F.to_json(F.array(F.concat(F.lit("k"), i)))).when(k == 1, "[]").alias("expected_document_keys"),
    )
    c = X.cases(cells)
    return c.select("id", F.when(F.col("page_hint").isNotNull(), F.array_join("page_hint", "-")).alias("pages"), F.array_join("gold_answer_spans", "|").alias("spans"), "answerable", F.array_join("expected_document_keys", "|").alias("keys"))


# ---- tables and child units

_PAGE = """concat('<p>x</p><table><thead><tr><th rowspan="2">No</th><th colspan=2>Who</th></tr><tr><th>First</th><th>Last &amp; more</th></tr></thead><tbody><tr><td rowspan=2>', page_id, '</td><td>a|b</td><td><b>c</b><br/>d</td></tr><tr><td>e</td></tr></tbody></table><!-- page: 2 --><table><tr><td>1</td><td>f</td><td>g</td></tr></table>')"""


@query("""select page_id, 0 as place, '| No | Who / First | Who / Last & more |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || page_id || ' | a\\|b | **c**<br>d |' || chr(10) || '| ' || case when page_id > 9999 then page_id::varchar else '' end || ' | e |  |' as "table", false as inherited from pages
  union all select page_id, 1, '| No | Who / First | Who / Last & more |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | f | g |', true from pages""")
def html_tables(spark, read):
    return B.html_tables(read("pages").select("page_id", F.expr(_PAGE).alias("html")))


# ---- metadata and small pieces


@query("select doc_id, case when lang in ('en', 'de') then lang else 'unknown' end as lang from documents")
def enum_norm(spark, read):
    return read("documents").select("doc_id", T.one_of("lang", ["en", "de"], "unknown").alias("lang"))


@query("select doc_id, 'P ' || doc_id as parser, lang as language from documents")
def ocr_meta(spark, read):
    report = F.concat(F.lit("noise\n- Parser: P "), F.col("doc_id"), F.lit("\nlanguage: "), F.col("lang"), F.lit("\nx\n"))
    m = read("documents").select("doc_id", T.report_fields(report).alias("m"))
    return m.select("doc_id", F.element_at("m", "parser").alias("parser"), F.element_at("m", "language").alias("language"))


@query(f"select item_id, lower({collapse_sql('text')}) as t from benchmark")
def norm_md(spark, read):
    return read("benchmark").select("item_id", F.lower(T.inline_markdown("text")).alias("t"))




@query(f"select doc_id, {collapse_sql("replace(lower(text), 'ß', 'ss')")} as t from documents")
def norm_text(spark, read):
    return read("documents").select("doc_id", T.comparison_text("text").alias("t"))


@query("select lang || '/' || doc_id || '.md' as path, strlen(text) as length, sha256(text) as digest from documents")
def objects_store(spark, read):
    """Every document written as an object of a new store, if absent, and read back from it."""
    objects.register(spark)
    root = shared_folder(spark, "objects")
    read("documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content")).write.format("objects").option("root", root).option("existing", "fail").mode("append").save()
    return spark.read.format("objects").option("root", root).option("suffixes", ".md").load().select("path", "length", F.sha2("content", 256).alias("digest"))
