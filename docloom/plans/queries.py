"""Registered queries of the core library and their SQL counterparts, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import questions as Q
from docloom.functions import text as T
from docloom.operators import catalog as C
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.sources.shared import dealt, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, read) under its name, with SQL if there is any; read(table) gives a table."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(spark, lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


WS = r"[ \t\n\r\f\x0B]+"
WORDS = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)', 1)"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def collapse_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}', ' ', 'g'))"


NORMAL_SQL = f"regexp_replace({collapse_sql('lower({0})')}, '[?!.,;:]+$', '')"


def accents_sql(e: str) -> str:
    marked, plain = T.accent_table()
    return f"translate({e}, '{marked}', '{plain}')"


def slug_sql(e: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({accents_sql(e)}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"(case when {s} = '' then 'untitled' else {s} end)"


def tags_sql(e: str) -> str:
    return collapse_sql(f"regexp_replace(regexp_replace(regexp_replace({e}, '<br[ /]*>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;|\u00a0', ' ', 'g')")


def values(rows: list[tuple], columns: str) -> str:
    def one(v) -> str:
        if v is None:
            return "cast(null as varchar(9))"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({columns})"


# ---- text functions


@query(f"select item_id, {NORMAL_SQL.format('text')} as q from benchmark")
def q_normalize(spark, read):
    return read("benchmark").select("item_id", T.normalize_query("text").alias("q"))


QUESTIONS = values(
    [
        (1, "Hồ sơ KTX gồm gì?", None, None), (2, "BHYT là gì", None, None), (3, "  Xin   chào! ", None, None), (4, "tiếp", None, None), (5, "tiếp đi", "học bổng", None), (6, "Điều kiện là gì?", None, None),
        (7, "điều kiện là gì", "miễn giảm học phí", None), (8, "còn gì", None, "doc-1"), (9, "", None, None), (10, "?!", None, None), (11, "quyết định về học phí của phòng đào tạo", None, None), (12, "FAQ nckh và du học", None, None), (13, "ktxa bhyt, pdt ctsv", None, None),
    ],
    "query_id, question, topic, document_key",
)


def _abbrev_sql(e: str) -> str:
    for short in sorted(T.ABBREVIATIONS, key=len, reverse=True):
        e = f"regexp_replace({e}, '(^|[^\\p{{L}}\\p{{N}}_]){short}($|[^\\p{{L}}\\p{{N}}_])', '\\1{T.ABBREVIATIONS[short]}\\2', 'gi')"
    return e


#: The questions of whole conversations: two of three turns ask one of the fixed questions, the others their own text.
ASKED_SQL = f"asked as (select conv_id, turn, case when turn % 3 = 0 then text else question end as question, substring(text, 1, 60) || ' ' || question as longer, topic, document_key from conversations join {QUESTIONS} on query_id = 1 + (conv_id + turn) % 13)"


def asked(read) -> DataFrame:
    c = read("conversations")
    fixed = c.sparkSession.sql(f"select * from {QUESTIONS}")
    out = c.join(F.broadcast(fixed), F.col("query_id") == 1 + (F.col("conv_id") + F.col("turn")) % 13)
    return out.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.col("question")).alias("question"), F.concat(F.substring("text", 1, 60), F.lit(" "), "question").alias("longer"), "topic", "document_key")


@query(f"with {ASKED_SQL} select conv_id, turn, {_abbrev_sql('longer')} as expanded from asked")
def q_abbrev(spark, read):
    return asked(read).select("conv_id", "turn", T.expand_abbreviations("longer").alias("expanded"))


def _in(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


@query(
    f"""with {ASKED_SQL}, a as (select *, {NORMAL_SQL.format('question')} as n from asked), b as (select *, {_abbrev_sql('n')} as f, coalesce(topic, '') <> '' or coalesce(document_key, '') <> '' as known from a)
    select conv_id, turn, not (n = '' or n in ({_in(Q.GREETINGS)}) or (not known and f in ({_in(Q.CONTINUATIONS + Q.UNDERSPECIFIED)}))) as should_search,
      case when n = '' then '' when n in ({_in(Q.GREETINGS)}) or not known then f when f in ({_in(Q.CONTINUATIONS)}) then coalesce(topic, f) when f in ({_in(Q.UNDERSPECIFIED)}) and topic is not null then f || ' cho ' || topic else f end as query,
      case when n = '' then '{Q.ASK_QUESTION}' when n in ({_in(Q.GREETINGS)}) then '{Q.GREETING_REPLY}' end as message,
      case when n = '' or n in ({_in(Q.GREETINGS)}) or known then null when f in ({_in(Q.CONTINUATIONS)}) then '{Q.CLARIFY_FOLLOW_UP}' when f in ({_in(Q.UNDERSPECIFIED)}) then '{Q.CLARIFY_AMBIGUOUS}' end as clarification,
      n <> '' and known and f in ({_in(Q.CONTINUATIONS)}) as is_follow_up from b"""
)
def q_decide(spark, read):
    return asked(read).select("conv_id", "turn", Q.decision("question", "topic", "document_key", F.lit(None).cast("string")).alias("d")).select("conv_id", "turn", "d.*")


def _meta_sql(kind: str) -> str:
    alts = [(len(a), v, a) for v, xs in Q.ALIASES[kind].items() for a in xs]
    union = " union all ".join(f"select {n} as n, '{v}' as v, '{a}' as a" for n, v, a in alts)
    return f"(select v from ({union}) where regexp_matches(lower(longer), '(^|[^\\p{{L}}\\p{{N}}_])' || a || '($|[^\\p{{L}}\\p{{N}}_])') order by n desc, v desc limit 1)"


@query(f"with {ASKED_SQL} select conv_id, turn, {', '.join(f'{_meta_sql(k)} as {k}' for k in Q.ALIASES)} from asked")
def q_meta(spark, read):
    return asked(read).select("conv_id", "turn", *[Q.metadata_hint("longer", k).alias(k) for k in Q.ALIASES])


@query(f"with {ASKED_SQL} select conv_id, turn, {' or '.join(f'contains(lower(trim(longer)), {chr(39)}{c}{chr(39)})' for c in Q.LIST_CUES)} as wants_list from asked")
def q_list_intent(spark, read):
    return asked(read).select("conv_id", "turn", Q.wants_list("longer").alias("wants_list"))


_ANSWER = """case item_id % 4 when 0 then '{"queries": ["q ' || h || '", "Other ' || h || '", "", "Other ' || h || '", "third", "fourth"]}' when 1 then 'Sure: {"queries": ["zwei ' || h || '"]} done' when 2 then 'no json' else '{"queries": []}' end"""


@query("""with b as (select item_id, md5(text) as h from benchmark) select item_id as query_id, 1 as position, 'Q ' || h as query from b union all select item_id, 2, case item_id % 4 when 0 then 'Other ' else 'zwei ' end || h from b where item_id % 4 < 2
  union all select item_id, 3, 'third' from b where item_id % 4 = 0""")
def q_variants_parse(spark, read):
    b = read("benchmark").select("item_id", F.md5("text").alias("h"))
    return Q.variants(b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("Q "), "h").alias("question"), F.expr(_ANSWER).alias("answer")))


@query(f"select doc_id, array_to_string(list_sort(list_distinct(list_filter({WORDS.format('text')}, lambda x: length(x) >= 2 and x not in ({STOP})))), ' ') as terms from documents")
def sparse_terms(spark, read):
    return read("documents").select("doc_id", F.array_join(F.array_sort(T.search_terms("text")), " ").alias("terms"))


@query(f"select doc_id, len(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')) as n_tokens from documents")
def token_count(spark, read):
    return read("documents").select("doc_id", T.token_count("text").cast("long").alias("n_tokens"))


@query(f"select doc_id, {accents_sql('text')} as plain from documents")
def strip_accents(spark, read):
    return read("documents").select("doc_id", T.strip_accents("text").alias("plain"))


@query(f"select item_id, {slug_sql('text')} as slug from benchmark")
def slugify(spark, read):
    return read("benchmark").select("item_id", T.slugify("text").alias("slug"))


@query(f"""select page_id, {collapse_sql("regexp_replace(lower(" + accents_sql("regexp_replace(" + tags_sql("regexp_replace(html, '^#+', '')") + ", '[*_`#|]', '', 'g')") + "), '[^a-z0-9 ]+', ' ', 'g')")} as k from pages""")
def normalize_key(spark, read):
    return read("pages").select("page_id", T.normalize_key("html").alias("k"))


@query(f"select page_id, {tags_sql('html')} as plain from pages")
def html_strip(spark, read):
    return read("pages").select("page_id", T.strip_tags("html").alias("plain"))


_TAG = """case page_id % 5 when 0 then '<td colspan="' || page_id || '">' when 1 then '<td rowspan=2 COLSPAN=' || chr(39) || page_id || chr(39) || '>' when 2 then '<td>' when 3 then '<td colspan=0 id=' || page_id || '>' else '<td colspan=x' || page_id || '>' end"""


@query(f"select page_id, greatest(coalesce(try_cast(regexp_extract(tag, 'colspan\\s*=\\s*[\"'']?([0-9]+)', 1, 'i') as int), 1), 1) as n from (select page_id, {_TAG} as tag from pages)")
def html_attr(spark, read):
    i = F.col("page_id").cast("string")
    tag = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<td colspan="'), i, F.lit('">'))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("<td rowspan=2 COLSPAN='"), i, F.lit("'>")))
    tag = tag.when(F.col("page_id") % 5 == 2, F.lit("<td>")).when(F.col("page_id") % 5 == 3, F.concat(F.lit("<td colspan=0 id="), i, F.lit(">"))).otherwise(F.concat(F.lit("<td colspan=x"), i, F.lit(">")))
    return read("pages").select("page_id", T.attribute_int(tag, "colspan").alias("n"))


@query(r"select doc_id, regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10) || chr(10)), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') || chr(10) as tidy from documents")
def blank_lines(spark, read):
    return read("documents").select("doc_id", T.tidy_blank_lines(F.replace("text", F.lit("\n"), F.lit("\n" * 5))).alias("tidy"))


@query("select doc_id, case when length(text) <= 120 then text else rtrim(substring(text, 1, 119)) || '…' end as cut from documents")
def truncate(spark, read):
    return read("documents").select("doc_id", T.truncate("text", 120).alias("cut"))


@query("select doc_id, sha256(text) as digest from documents")
def checksum(spark, read):
    return read("documents").select("doc_id", T.checksum("text").alias("digest"))


@query(f"select doc_id, 'doc-' || {slug_sql('source')} || '-' || {slug_sql('substring(text, 1, 40)')} as document_key, 'doc-' || {slug_sql('source')} || '-' || {slug_sql('substring(text, 1, 40)')} || '-' || substring(sha256(text), 1, 12) as version_key from documents")
def doc_keys(spark, read):
    key = T.document_key(F.substring("text", 1, 40), "source")
    return read("documents").select("doc_id", key.alias("document_key"), T.version_key(key, T.checksum("text")).alias("version_key"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_get(spark, read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""with a as (select user_id, list(event_type order by ts, event_id) as x from events group by user_id)
    select user_id, list_contains(x, 'click') as has_click, len(list_distinct(x)) as n_kinds, array_to_string(list_slice(x, -3, -1), ',') as last_three, list_min(x) as low, list_max(x) as high from a""")
def arrays(spark, read):
    a = read("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("x"))
    return a.select("user_id", F.array_contains("x", "click").alias("has_click"), F.size(F.array_distinct("x")).cast("long").alias("n_kinds"), F.array_join(C.last_n(F.col("x"), 3), ",").alias("last_three"), F.array_min("x").alias("low"), F.array_max("x").alias("high"))


@query("select doc_id, coalesce(nullif(case when lang = 'en' then '' else lang end, ''), nullif(source, '')) as v, case when lang in ('de', 'fr') then lang else 'other' end as lang_or_other from documents")
def first_non_empty(spark, read):
    d = read("documents").withColumn("l", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")))
    return d.select("doc_id", T.first_non_empty("l", "source").alias("v"), T.one_of("lang", ["de", "fr"], "other").alias("lang_or_other"))


@query("select page_id, regexp_full_match(regexp_replace(url, '^[a-z]+://', ''), '[A-Za-z0-9][A-Za-z0-9._-]{0,250}') as safe from pages")
def safe_key(spark, read):
    return read("pages").select("page_id", T.is_safe_key(F.regexp_replace("url", "^[a-z]+://", "")).alias("safe"))


@query("select page_id, nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?', ''), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '') as name from pages")
def file_name(spark, read):
    return read("pages").select("page_id", T.file_name("url").alias("name"))


_EXTENSIONS = {".PDF": "pdf", ".docx": "docx", "": "", ".tiff": "image", ".a.md": "md", ".parquet": "parquet"}


@query("select page_id, case page_id % 6 " + " ".join(f"when {k} then '{kind}'" for k, kind in enumerate(_EXTENSIONS.values())) + " end as kind from pages")
def file_type(spark, read):
    ending = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % 6 + 1).cast("int"))
    return read("pages").select("page_id", T.file_type(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/Report"), "page_id", ending, F.lit("?y=1"))).alias("kind"))


@query("select doc_id, 'canonical/md/' || lower(upper(lang)) || '/v' || doc_id || '.md' as canonical, 'sources/md/' || lang || '/v' || doc_id || '.md' as source, 'a/v' || doc_id || '.' || md5(text) || '.md' as revision from documents")
def path_builder(spark, read):
    d = read("documents").withColumn("v", F.concat(F.lit("v"), F.col("doc_id")))
    old = F.concat(F.lit("a/"), F.col("v"), F.lit("." + "0123456789abcdef" * 2 + ".md"))
    return d.select("doc_id", T.canonical_path(F.upper("lang"), "v").alias("canonical"), T.source_path("v", "lang", F.lit(".markdown")).alias("source"), T.revision_path(old, F.md5("text")).alias("revision"))


@query("select doc_id, case doc_id % 4 when 0 then 'pymupdf_text_only+llamaparse' when 1 then 'llamaparse' when 2 then 'pymupdf_text_only' end as parser from documents")
def infer_parser(spark, read):
    named = F.element_at(F.array(F.lit("PyMuPDF text only, LlamaParse API"), F.lit("LLAMA cloud"), F.lit("pymupdf"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read("documents").select("doc_id", T.infer_parser(F.concat("source", F.lit(" "), named, F.lit(" "), "lang")).alias("parser"))


@query("select doc_id, 'b' || doc_id || ' and ' || source || ' ' || lang || ' text alt ' || md5(text) as plain from documents")
def inline_md(spark, read):
    md = F.concat(F.lit("**b"), "doc_id", F.lit("** and *"), "source", F.lit("* `"), "lang", F.lit("` [text](http://x) ![alt](img.png)  __"), F.md5("text"), F.lit("__"))
    return read("documents").select("doc_id", T.inline_markdown(md).alias("plain"))


@query("select doc_id, source || ', ' || case when doc_id % 3 = 0 then 'mục ' || lang when doc_id % 3 = 1 then 'trang ' || n_chars else 'trang ' || n_chars || '-' || (n_chars + 1) end as citation from documents")
def citation_str(spark, read):
    d = read("documents")
    a = F.when(F.col("doc_id") % 3 > 0, F.col("n_chars"))
    return d.select("doc_id", T.citation("source", a, F.when(F.col("doc_id") % 3 == 1, a).otherwise(a + 1), F.array("source", "lang")).alias("citation"))


@query("select doc_id, 'Tài liệu: ' || source || chr(10) || 'Đơn vị: a, b' || chr(10) || 'Loại: ' || lang || chr(10) || 'Mục: x > y' || chr(10) || case when doc_id % 2 = 0 then 'Page 1-2' else '' end || chr(10) || chr(10) || trim(text) as t from documents")
def embed_text(spark, read):
    page = lambda n: F.when(F.col("doc_id") % 2 == 0, n)
    both = lambda *x: F.array(*map(F.lit, x))
    return read("documents").select("doc_id", T.embedding_text(F.col("source"), both("a", "b"), F.col("lang"), both("x", "y"), page(1), page(2), F.col("text")).alias("t"))


@query("""with n as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk/v' || doc_id || '/' || source)) as h from documents)
  select doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][1 + (instr('0123456789abcdef', substring(h, 17, 1)) - 1) % 4] || substring(h, 18, 3) || '-' || substring(h, 21, 12) as point_id from n""")
def point_id(spark, read):
    return read("documents").select("doc_id", T.point_id(F.concat(F.lit("v"), F.col("doc_id")), F.col("source")).alias("point_id"))


# ---- retrieval: documents are chunks, labels say which are eligible, benchmark items are queries

ELIGIBLE_SQL = "select d.* from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1 and l.toxic = 0)"
TERMS_SQL = f"select distinct item_id as query_id, term from (select item_id, unnest({WORDS.format('text')}) as term from benchmark) where length(term) >= 2 and term not in ({STOP})"
TF_SQL = f"select term, doc_id, count(*) as tf from (select doc_id, unnest({WORDS.format('text')}) as term from e) group by term, doc_id"
SPARSE_SQL = f"""e as ({ELIGIBLE_SQL}), q as ({TERMS_SQL}), p as ({TF_SQL}),
  s as (select query_id, doc_id, round(0.1::double * sum(tf)::double, 12) as score from p join q using (term) group by query_id, doc_id),
  sparse as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 30)"""
DENSE_SQL = """dense as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (
  select b.item_id as query_id, v.vec_id as doc_id, round(list_cosine_similarity(v.embedding::double[], w.embedding::double[]), 9) as score from embeddings v join e on e.doc_id = v.vec_id, benchmark b join embeddings w on w.vec_id = b.item_id) qualify rank <= 30)"""
FUSE_SQL = """fused as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, f, r, doc_id) as rank from (
  select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score, min(branch * 1000 + rank) // 1000 as f, min(branch * 1000 + rank) % 1000 as r from (select 0 as branch, query_id, doc_id, rank from dense union all select 1, query_id, doc_id, rank from sparse) group by query_id, doc_id) qualify rank <= 20)"""


def corpus(read) -> DataFrame:
    good = read("labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, 1))).alias("ok")).where("ok = 1").select("doc_id")
    return read("documents").join(good, "doc_id", "left_semi")


def query_terms(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.search_terms("text")).alias("term"))


def sparse_hits(read, k: int = 30) -> DataFrame:
    terms = query_terms(read)
    return R.sparse_topk(R.postings(corpus(read), "doc_id", "text", terms), terms, k, "doc_id", corpus(read).select("doc_id"))


def dense_hits(read, k: int = 30) -> DataFrame:
    v = read("embeddings").withColumnRenamed("vec_id", "doc_id").join(corpus(read).select("doc_id"), "doc_id", "left_semi")
    q = read("benchmark").join(read("embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.dense_topk(v, q, k, "doc_id")


def branches(read) -> DataFrame:
    return dense_hits(read).withColumn("branch", F.lit(0)).unionByName(sparse_hits(read).withColumn("branch", F.lit(1)))


def fused_hits(read, k: int = 20) -> DataFrame:
    return R.fuse(branches(read), k, "doc_id")


@query(f"with e as ({ELIGIBLE_SQL}) select doc_id, lang, source from e")
def eligible(spark, read):
    return corpus(read).select("doc_id", "lang", "source")


STATES_SQL = "select d.doc_id, d.source, d.lang, case when l.quality = 1 then 'approved' else 'reviewing' end as review_status, case when l.toxic = 0 then 'published' else 'indexed' end as rag_status from documents d join labels l using (doc_id)"


@query(f"with v as ({STATES_SQL}) select doc_id from v where review_status = 'approved' and rag_status = 'published' and lang = 'de'")
def ctx_filter(spark, read):
    v = read("documents").join(read("labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("reviewing").alias("review_status"), F.when(F.col("toxic") == 0, "published").otherwise("indexed").alias("rag_status"), F.lit(True).alias("is_latest"), F.array("lang").alias("audience"))
    return v.where(R.eligible(audience="de")).select("doc_id")


@query(f"with {SPARSE_SQL} select query_id, doc_id, score, rank from sparse")
def sparse_topk(spark, read):
    return sparse_hits(read).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""select query_id, vec_id, score, rank from (select w.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], w.embedding::double[]), 9) as score, row_number() over (partition by w.vec_id order by score desc, v.vec_id) as rank
  from embeddings v, embeddings w where w.vec_id % 50 = 0) where rank <= 30""")
def dense_topk(spark, read):
    e = read("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.dense_topk(e, q, 30).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL} select query_id, doc_id, score, rank from fused")
def rrf_fuse(spark, read):
    return fused_hits(read).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL}, m as (select 0 as branch, query_id, doc_id, rank from fused union all select 1, query_id, doc_id, rank from sparse where rank <= 20)
  select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, f, doc_id) as rank from (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score, min(branch * 1000 + rank) as f from m group by query_id, doc_id) qualify rank <= 20""")
def rrf_multi(spark, read):
    lists = fused_hits(read).withColumn("branch", F.lit(0)).unionByName(sparse_hits(read).where("rank <= 20").withColumn("branch", F.lit(1)))
    return R.fuse(lists, 20, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query(f"with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL} select f.query_id, f.rank, f.doc_id, f.score, d.source, d.lang, t.lang_name from fused f join e d using (doc_id) left join (values ('en', 'English'), ('de', 'Deutsch')) as t(lang, lang_name) on t.lang = d.lang")
def hydrate(spark, read):
    chunks = read("documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")
    docs = read("documents").join(read("labels"), "doc_id").select(F.col("doc_id").alias("document_id"), "source", F.col("lang").alias("type_id"), F.when(F.col("quality") == 1, "approved").alias("review_status"), F.when(F.col("toxic") == 0, "published").alias("rag_status"), F.lit(True).alias("is_latest"))
    types = spark.createDataFrame([("en", "English"), ("de", "Deutsch")], "type_id string, lang_name string")
    out = R.hydrate(fused_hits(read).withColumnRenamed("doc_id", "chunk_id"), chunks, docs, types)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), "score", "source", F.col("type_id").alias("lang"), "lang_name")


@query(f"with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL} select f.query_id, f.rank, f.doc_id, f.score, d.source, d.lang, case when length(d.text) <= 200 then d.text else rtrim(substring(d.text, 1, 199)) || '…' end as preview from fused f join documents d using (doc_id) where f.rank <= 5")
def retrieve_e2e(spark, read):
    hits = fused_hits(read).where("rank <= 5")
    return hits.join(read("documents"), "doc_id").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "source", "lang", T.truncate("text", 200).alias("preview"))


@query(f"with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL} select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from fused where doc_id % 4 <> query_id % 4")
def exclude_used(spark, read):
    hits = written(fused_hits(read), "fused")  # read twice
    return R.without_used(hits, hits.where("doc_id % 4 = query_id % 4"), "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL} select query_id, doc_id, r as rank from (select query_id, doc_id, row_number() over (partition by query_id order by -n_chars desc, f.rank) as r from fused f join documents d using (doc_id)) where r <= 5")
def rerank(spark, read):
    hits = fused_hits(read).join(read("documents").select("doc_id", "n_chars"), "doc_id")
    return R.rerank(hits, -F.col("n_chars"), 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL} select 'dense_only' as config, query_id, doc_id, rank from dense where rank <= 5 union all select 'sparse_only', query_id, doc_id, rank from sparse where rank <= 5 union all select 'hybrid_rrf', query_id, doc_id, rank from fused where rank <= 5
  union all select 'hybrid_rrf_rerank', query_id, doc_id, row_number() over (partition by query_id order by -n_chars desc, f.rank) as r from fused f join documents d using (doc_id) qualify r <= 5""")
def ablation(spark, read):
    lists = written(branches(read), "branches")  # built once for all four
    fused = R.fuse(lists, 20, "doc_id")
    again = R.rerank(fused.join(read("documents").select("doc_id", "n_chars"), "doc_id"), -F.col("n_chars"), 5)
    out = None
    for name, hits in (("dense_only", lists.where("branch = 0")), ("sparse_only", lists.where("branch = 1")), ("hybrid_rrf", fused), ("hybrid_rrf_rerank", again)):
        part = hits.where("rank <= 5").select(F.lit(name).alias("config"), "query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


GOLD_SQL = f"select b.item_id as query_id, d.doc_id, length(d.text) as n from benchmark b join documents d on contains({collapse_sql('lower(d.text)')}, {collapse_sql('lower(b.text)')})"


def gold(read) -> DataFrame:
    """(query_id, doc_id, n): documents that contain an item's text. Candidates share the item's rarest inner word; items of one or two words, which have none, are a query set against all texts."""
    docs = read("documents").select("doc_id", T.collapse(F.lower("text")).alias("t"), F.length("text").alias("n"))
    items = read("benchmark").select(F.col("item_id").alias("query_id"), T.collapse(F.lower("text")).alias("q"))
    # a word at an end of the item could be part of a longer word of the document, so inner words are used where there are any
    items = items.withColumn("inner", F.array_distinct(F.expr(r"regexp_extract_all(q, '(?<=[^\\p{L}\\p{N}])([\\p{L}\\p{N}]+)(?=[^\\p{L}\\p{N}])', 1)"))).where("q <> ''")
    inner = items.select("query_id", F.explode("inner").alias("term"))
    # of the needed words alone, each text's: read once for the counts and once for the candidates
    post = docs.select("doc_id", F.explode(F.array_distinct(T.words("t"))).alias("term")).join(R.small(inner.select("term").distinct()), "term", "left_semi")
    post = written(post, "needed-words")
    best = inner.join(post.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    pairs = post.join(R.small(best), "term").select("query_id", "doc_id").distinct()
    found = pairs.join(items.select("query_id", "q"), "query_id").join(docs, "doc_id").where("contains(t, q)").select("query_id", "doc_id", "n")
    short = items.where("size(inner) = 0").select("query_id", "q")
    found = found.unionByName(docs.join(R.small(short), F.col("t").contains(F.col("q"))).select("query_id", "doc_id", "n"))
    return found.select("query_id", "doc_id", F.col("n").cast("long").alias("n"))


@query(f"select query_id, min_by(doc_id, n * 1000000000 + doc_id) as doc_id, count(*) as n_found from ({GOLD_SQL}) group by query_id")
def gold_resolve(spark, read):
    return gold(read).groupBy("query_id").agg(F.min_by("doc_id", F.struct("n", "doc_id")).alias("doc_id"), F.count("*").alias("n_found"))


@query(f"""with {SPARSE_SQL}, g as ({GOLD_SQL}), c as (select query_id, count(distinct doc_id) as n from g group by query_id), m as (select query_id, count(*) as k, min(rank) as r from sparse join g using (query_id, doc_id) where rank <= 5 group by query_id)
  select query_id, round(coalesce(k, 0) / 5, 9)::double as precision, round(coalesce(k, 0) / n, 9)::double as recall, round(coalesce(1.0::double / r, 0), 9)::double as reciprocal_rank from c left join m using (query_id)""")
def ir_metrics(spark, read):
    return R.ranking_metrics(sparse_hits(read), gold(read), 5, "doc_id")


# ---- structural expansion: an order's lines are a version's chunks

TREE_SQL = """c as (select l_orderkey as version_key, l_linenumber as chunk_index, 'c' || l_linenumber as chunk_key, 'i' || (l_linenumber - l_linenumber % 2) as item, 'i' || (l_linenumber // 2 - (l_linenumber // 2) % 2) as parent_item, case when l_linenumber % 3 = 0 then null else 'p' || (l_linenumber % 3) end as parent_chunk, l_linenumber % 2 as split_index, case when l_linenumber % 4 < 2 then 2 else 1 end as split_count, l_quantity as qty from lineitem),
  h as (select *, version_key as query_id, row_number() over (partition by version_key order by qty desc, chunk_index) as rank, version_key % 2 = 0 as wants_list from c qualify rank <= 2)"""


def _kind_sql(n: int, reason: str, on: str, where: str = "true") -> str:
    return f"""select h.query_id, h.rank as hit_rank, c.version_key, c.chunk_key, c.chunk_index, '{reason}' as reason, {n} as kind, row_number() over (partition by h.query_id, h.rank order by c.chunk_index) as place from h join c on c.version_key = h.version_key and c.chunk_key <> h.chunk_key and {on} where {where}"""


KINDS_SQL = {
    "expand_parent": ("parent", "c.item = h.parent_item"),
    "expand_children": ("children", "c.parent_item = h.item"),
    "expand_siblings": ("siblings", "c.parent_item = h.parent_item and (h.parent_chunk is null or c.parent_chunk = h.parent_chunk)"),
    "expand_neighbors": ("neighbors", "h.split_count > 1 and c.item = h.item and abs(c.split_index - h.split_index) <= 1"),
}


def tree(read) -> tuple[DataFrame, DataFrame]:
    n = F.col("l_linenumber")
    half = F.floor(n / 2)
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    c = dealt(lines, "l_orderkey").select(F.col("l_orderkey").alias("version_key"), n.alias("chunk_index"), F.concat(F.lit("c"), n).alias("chunk_key"), F.concat(F.lit("i"), n - n % 2).alias("item"), F.concat(F.lit("i"), half - half % 2).alias("parent_item"), F.when(n % 3 != 0, F.concat(F.lit("p"), n % 3)).alias("parent_chunk"), (n % 2).alias("split_index"), F.when(n % 4 < 2, 2).otherwise(1).alias("split_count"), F.col("l_quantity").alias("qty"))
    h = R.top(c.withColumn("query_id", F.col("version_key")), ["version_key"], [F.desc("qty"), F.col("chunk_index")], 2)
    return h.withColumn("wants_list", F.col("version_key") % 2 == 0), c.drop("qty")


def _register_expansions() -> None:
    for name, (reason, on) in KINDS_SQL.items():

        def run(spark, read, f=getattr(R, name)):
            return f(*tree(read)).select("query_id", F.col("hit_rank").cast("long").alias("hit_rank"), "chunk_key", "reason")

        query(f"with {TREE_SQL} select query_id, hit_rank, chunk_key, reason from ({_kind_sql(1, reason, on)})", name)(run)


_register_expansions()


@query(f"""with {TREE_SQL}, u as (select query_id, rank as hit_rank, version_key, chunk_key, chunk_index, 'direct' as reason, 0 as kind, 0 as place from h union all {_kind_sql(1, *KINDS_SQL['expand_parent'])} union all {_kind_sql(2, *KINDS_SQL['expand_children'], 'h.wants_list')} union all {_kind_sql(3, *KINDS_SQL['expand_siblings'], 'h.wants_list')} union all {_kind_sql(4, *KINDS_SQL['expand_neighbors'])}),
  o as (select *, row_number() over (partition by query_id order by kind > 0, hit_rank, kind, place) as n from u), d as (select * from o qualify row_number() over (partition by query_id, version_key, chunk_key order by n) = 1)
  select query_id, row_number() over (partition by query_id order by n) as rank, chunk_key, reason from d qualify rank <= 20""")
def expand_all(spark, read):
    return R.expand(*tree(read), rows=read("lineitem").count()).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_key", "reason")


@query(f"with {TREE_SQL} select h.query_id, h.chunk_key, p.chunk_key as parent_key from h left join c p on p.version_key = h.version_key and p.chunk_index = h.chunk_index // 2")
def parent_context(spark, read):
    h, c = tree(read)
    key = lambda v, n: F.concat(v, F.lit("-"), n)
    hits = h.withColumn("parent_chunk_id", key(F.col("version_key"), F.floor(F.col("chunk_index") / 2)))
    return R.with_parent(hits, c.select(key(F.col("version_key"), F.col("chunk_index")).alias("chunk_id"), F.col("chunk_key").alias("content"))).select("query_id", "chunk_key", F.col("parent_content").alias("parent_key"))
