"""Registered queries of metadata attachment: pages stand for source files, documents for recognised texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import metadata as M
from docloom.plans.queries import query

_FILE = "'/d/PDFs/g' || (page_id % 4) || '/' || md5(url) || '/SRC ' || (page_id % 30) || case page_id % 3 when 0 then '.PDF' when 1 then '.exe' else '.docx' end"
_FILES_SQL = f"f as (select {_FILE} as path, page_id, md5(html) || md5(url) as checksum from pages), s as (select page_id % 30 as n, min(path) as source from f where page_id % 3 <> 1 group by page_id % 30)"
#: every third document names its source by path: that of the page with its number
_NAMED_SQL = "m as (select d.doc_id, d.source as own, d.text, d.lang, coalesce(case when d.doc_id % 3 = 0 then f.path end, s.source) as source from documents d left join f on f.page_id = d.doc_id left join s on 'src' || s.n = d.source)"


def files(read):
    return read("pages").select(F.expr(_FILE).alias("path"), F.concat(F.md5("html"), F.md5("url")).alias("checksum"), "page_id")


def _texts(read):
    """(doc_id, path, text): front matter for documents not divisible by 4, with a version key that is automatic for some."""
    p = files(read).select(F.col("page_id").alias("doc_id"), F.col("path").alias("page_path"))
    d = read("documents").join(p, "doc_id", "left").withColumn("named", F.when(F.col("doc_id") % 3 == 0, F.col("page_path")))
    i = F.col("doc_id")
    old = F.sha2(F.concat(F.lit("old"), i), 256)
    front = F.concat(
        F.lit("---\ndocument_key: k-"), i, F.lit("\nversion_key: "), F.when(i % 2 == 0, F.concat(F.lit("k-"), i, F.lit("-"), F.substring(old, 1, 12))).otherwise("own"), F.lit("\nchecksum: "), old, F.lit("\ntitle: T "), i,
        F.lit("\nrag_status: "), F.when(i % 5 == 0, "nonsense").otherwise("indexed"), F.when(F.col("named").isNotNull(), F.concat(F.lit("\nsource_path: "), "named")).otherwise(""), F.lit("\nnotes:\n---\n"),
    )
    report = F.concat(F.lit("# PDF / Image Text Document\n\n## Metadata\n\n- Source file: "), F.coalesce("named", F.lit("none")), F.lit("\n- Parser: LlamaParse\n\n## Extracted Text\n\n"))
    text = F.concat(F.when(i % 4 != 0, front).otherwise(report), F.lit("body "), i)
    return d.select("doc_id", F.concat(F.lit("/md/"), i, F.lit("/"), F.regexp_replace("source", "src", "Src-"), F.lit("_clean.md")).alias("path"), text.alias("text"))


@query(f"with {_FILES_SQL}, {_NAMED_SQL} select doc_id, source from m where source is not null")
def source_match(spark, read):
    p = files(read).select(F.col("page_id").alias("doc_id"), F.col("path").alias("page_path"))
    d = read("documents").join(p, "doc_id", "left")
    path = F.concat(F.lit("/md/"), "doc_id", F.lit("/"), F.regexp_replace("source", "src", "Src-"), F.lit("_clean.md"))
    texts = d.select("doc_id", path.alias("path"), M.stems_of(path, F.create_map().cast("map<string,string>")).alias("stems"), F.when(F.col("doc_id") % 3 == 0, F.col("page_path")).alias("named"))
    return M.match_sources(texts, files(read), ["named"]).join(texts.select("path", "doc_id"), "path").select("doc_id", "source")


_TITLE = "case when doc_id % 4 = 0 then '' else 'T ' || doc_id end"
_OLD = "sha256('old' || doc_id)"
_SUM = f"coalesce((select f.checksum from f where f.path = m.source), case when doc_id % 4 = 0 then sha256(raw) else {_OLD} end)"
_KEY = "case when doc_id % 4 = 0 then 'doc-' || coalesce('g' || regexp_extract(source, '/g([0-9])/', 1) || '-src-' || regexp_extract(source, '/SRC ([0-9]+)', 1), replace(own, 'src', 'src-') || '-clean') else 'k-' || doc_id end"


@query(f"""with {_FILES_SQL}, {_NAMED_SQL}, r as (select *, '# PDF / Image Text Document' || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '- Source file: ' || coalesce(case when doc_id % 3 = 0 then (select path from f where page_id = doc_id) end, 'none') || chr(10) || '- Parser: LlamaParse' || chr(10) || chr(10) || '## Extracted Text' || chr(10) || chr(10) || 'body ' || doc_id as raw from m),
  x as (select m.*, {_SUM} as checksum, {_KEY} as document_key from r m)
  select doc_id, source, document_key, case when doc_id % 4 = 0 or doc_id % 2 = 0 then document_key || '-' || substring(checksum, 1, 12) else 'own' end as version_key, {_TITLE} as title, checksum,
  case when doc_id % 4 = 0 or doc_id % 5 = 0 then 'not_indexed' else 'indexed' end as rag_status, case when doc_id % 4 = 0 then 'done' else 'not_started' end as ocr_status, case when doc_id % 4 = 0 then 'llamaparse' else '' end as parser,
  case when source is null then 'md' when source like '%.docx' then 'docx' when source like '%.PDF' then 'pdf' else 'md' end as file_type,
  case when doc_id % 4 = 0 or doc_id % 2 = 0 then 'made' else 'front_matter' end as version_origin, case when source is not null then 'source' when doc_id % 4 = 0 then 'made' else 'front_matter' end as checksum_origin, 'body ' || doc_id as body from x""")
def meta_attach(spark, read):
    t = _texts(read)
    a = M.attach(t.select("path", "text"), files(read).select("path", "checksum"), F.lit("2024-01-01T00:00:00")).join(t.select("path", "doc_id"), "path")
    f = lambda n: F.array_join(F.element_at("fields", n), ",")
    names = ["document_key", "version_key", "title", "checksum", "rag_status", "ocr_status", "parser", "file_type"]
    return a.select("doc_id", "source", *[f(n).alias(n) for n in names], F.element_at("origins", "version_key").alias("version_origin"), F.element_at("origins", "checksum").alias("checksum_origin"), F.regexp_extract("text", r"(?s)\n---\n\n(.*)\n\z", 1).alias("body"))


@query("""with p as (select page_id // 3 as d, '<!-- page: ' || (page_id % 3 + 1) || ' -->' || chr(10) || chr(10) || '- ' || md5(html) as t, page_id from pages)
  select '/ocr/' || d || '/Plan.md' as path, 'doc-plan' as document_key, 'done' as ocr_status, string_agg(t, chr(10) || chr(10) order by page_id) as body from p group by d""")
def ocr_flow(spark, read):
    """Three pages each as one recognised text: joined, escapes repaired, metadata attached."""
    rows = read("pages").select(F.concat(F.lit("/ocr/"), F.floor(F.col("page_id") / 3), F.lit("/Plan.md")).alias("path"), (F.col("page_id") % 3 + 1).alias("page_number"), F.concat(F.lit("\\- "), F.md5("html")).alias("content"))
    a = M.recognised(rows, files(read).select("path", "checksum"), F.lit("2024-01-01T00:00:00"))
    f = lambda n: F.array_join(F.element_at("fields", n), ",").alias(n)
    return a.select("path", f("document_key"), f("ocr_status"), F.regexp_extract("text", r"(?s)\n---\n\n(.*)\n\z", 1).alias("body"))
