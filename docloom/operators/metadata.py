"""Metadata attached to recognised texts: the source file of each, and every field from the first place that has it, with that place kept.

``match_sources`` finds a text's source by paths it names, else by its normalised stem; one join by key, of which the side of the
files has one row a key. ``attach`` fills the fields in order of precedence (what was asked for, what the front matter says, what
the report or the source implies, a default), renders the text anew, and lists what changed: run without writing, that is a dry run.

A null text is empty. Texts that repeat a path are separate rows of ``attach`` but share their source. Two files with one stem:
the one whose path sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import files as X

# Endings of a text's stem that its source's lacks, and the extensions of sources.
ENDINGS = ["_structured", "_rag_clean", "_clean", "_output"]
SOURCE_EXTENSIONS = ["pdf", "doc", "docx", "pptx", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "xlsx", "csv", "html", "txt"]
# The fields in their order.
ORDER = (
    "document_key version_key title document_type domain issuing_authority responsible_department signer_name audience code issued_date effective_date is_latest ocr_status review_status rag_status status_note "
    "source_url source_path canonical_markdown_path file_type accessed_date language checksum parser ocr_engine created_at updated_at notes"
).split()
#: What a field's value may be; another counts as its default.
ENUMS = {
    "ocr_status": ["not_started", "processing", "done", "failed", "need_review"], "review_status": ["not_reviewed", "reviewing", "need_fix", "approved", "rejected"],
    "rag_status": ["not_indexed", "chunked", "embedded", "indexed", "published", "deactivated", "failed"], "file_type": ["pdf", "doc", "docx", "pptx", "md", "html", "txt", "image", "xlsx", "csv"],
}
DEFAULTS = {"document_type": "unknown", "domain": "unknown", "audience": "student", "is_latest": "true", "review_status": "approved", "rag_status": "not_indexed", "file_type": "md", "language": "vi"}


def name_key(c: Column) -> Column:
    """A file's name for comparison: letters and digits alone."""
    return F.regexp_replace(T.slugify(c), "-", "")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def report_part(body: Column) -> Column:
    """map<string, string> of the ``- key: value`` lines of a report's metadata section, keys in lower case, the last of a key; empty without one."""
    part = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?ms)^[ \t]*## Metadata[ \t]*$(.*?)(?=^[ \t]*## |\z)", 1)
    keys, values = (F.regexp_extract_all(part, F.lit(r"(?m)^[ \t]*-[ \t]*([^:\n]+):[ \t]*([^\n]*)$"), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(F.lower(F.trim(k)).alias("k"), F.regexp_replace(F.trim(v), "^`+|`+$", "").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def match_sources(texts: DataFrame, files: DataFrame, named: list[str] | None = None) -> DataFrame:
    """(path, source): the file (``files``: path) that belongs to each text (path, stems array<string>, and columns ``named`` that hold paths, the first to count first)."""
    exact = [F.struct(F.lit(k).alias("place"), F.concat(F.lit("p:"), F.regexp_replace(F.trim(n), "^`+|`+$", "")).alias("key")) for k, n in enumerate(named or [])]
    own = F.transform("stems", lambda s: F.struct(F.lit(len(exact)).alias("place"), F.concat(F.lit("s:"), name_key(s)).alias("key")))
    wanted = texts.select("path", F.explode(F.array_distinct(F.filter(F.concat(F.array(*exact).cast("array<struct<place:int,key:string>>"), own), lambda x: x["key"].isNotNull()))).alias("w")).select("path", "w.place", "w.key")
    fit = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SOURCE_EXTENSIONS)
    keys = F.array_compact(F.array(F.concat(F.lit("p:"), "path"), F.when(fit, F.concat(F.lit("s:"), name_key(stem(F.col("path")))))))
    known = files.where("path is not null").select(F.col("path").alias("source"), F.explode(keys).alias("key")).groupBy("key").agg(F.min("source").alias("source"))
    return wanted.join(known, "key").groupBy("path").agg(F.min_by("source", F.struct("place", "source")).alias("source"))


def stems_of(path: Column, report: Column) -> Column:
    """The stems by which a text's source may be called: its own, without an ending, and those its report names."""
    own = stem(path)
    cut = F.array(*[F.when(F.lower(own).endswith(e), F.substring(own, F.lit(1), F.length(own) - len(e))) for e in ENDINGS])
    told = F.array(*[stem(F.element_at(report, k)) for k in ("source name", "source file")])
    return F.array_distinct(F.filter(F.concat(F.array(own), cut, told), lambda s: s.isNotNull() & (s != "")))


def _first(*choices: tuple[str, Column]) -> Column:
    """struct(origin, value array<string>) of the first choice with a value that is neither null, empty nor a list of nothing."""
    picked = None
    for origin, value in reversed(choices):
        clean = F.filter(value, lambda x: x.isNotNull() & (x != ""))
        here = F.struct(F.lit(origin).alias("origin"), clean.alias("value"))
        nothing = F.lit(None).cast("struct<origin:string,value:array<string>>")
        picked = F.when(F.coalesce(F.size(clean), F.lit(0)) > 0, here).otherwise(picked if picked is not None else nothing)
    return picked


def attach(texts: DataFrame, files: DataFrame, now: Column, asked: dict[str, str] | None = None, overwrite: bool = False, prefix: str = "doc", defaults: dict[str, str] | None = None) -> DataFrame:
    """(path, source, fields, origins, changed, text) of texts (path, text); ``files``: path, checksum (sha256, unique by path).

    ``fields``: map of each field to its values; ``origins``: where each came from (asked, front_matter, source, report, made, default);
    ``changed``: the fields that differ from the front matter, created and updated times aside. A version key made from the
    old checksum is made anew; with ``overwrite`` so are all version keys and the own path. A value that its list does not have
    becomes the default.
    """
    asked, defaults = asked or {}, DEFAULTS | (defaults or {})
    d = X.split_front_matter(texts.select("path", F.coalesce("text", F.lit("")).alias("text")), strict=False).withColumnRenamed("fields", "old").withColumn("report", report_part(F.col("body")))
    old = lambda *names: F.coalesce(*[F.when(F.size(F.filter(F.element_at("old", n), lambda x: x != "")) > 0, F.element_at("old", n)) for n in names])
    one = lambda c: F.array(c)
    d = d.withColumns({"stems": stems_of(F.col("path"), F.col("report")), "_named0": F.lit(asked.get("source_path")).cast("string"), "_named1": F.get(old("source_path"), 0), "_named2": F.get(old("source_file"), 0), "_named3": F.element_at("report", "source file")})
    found = match_sources(d, files, ["_named0", "_named1", "_named2", "_named3"])
    known = found.join(files.where("path is not null").groupBy(F.col("path").alias("source")).agg(F.min("checksum").alias("source_checksum")), "source")
    d = d.join(known, "path", "left")
    given = lambda f: ("asked", one(F.lit(asked.get(f)).cast("string")))
    default = lambda f: ("default", one(F.lit(defaults.get(f)).cast("string")))
    kept = lambda f, *also: ("front_matter", old(f, *also))
    group = F.regexp_extract("source", r"(?i)/(?:pdfs|docx)/([^/]+)/", 1)
    made_key = T.document_key(stem(F.coalesce("source", "path")), group, prefix)
    d = d.withColumn("_document", _first(kept("document_key", "document_id"), ("made", one(made_key))))
    checksum = _first(("source", one(F.col("source_checksum"))), ("report", one(F.element_at("report", "checksum"))), kept("checksum"), ("made", one(F.sha2("text", 256))))
    d = d.withColumn("_checksum", checksum)
    key, digest = F.get(F.col("_document")["value"], 0), F.get(F.col("_checksum")["value"], 0)
    current = F.get(old("version_key", "version_id"), 0)
    automatic = F.lit(overwrite) | F.coalesce(current == T.version_key(key, F.get(old("checksum"), 0)), F.lit(False))
    values = F.lower(F.array_join(F.map_values("report"), " "))
    recognised = (F.size("report") > 0) | F.col("body").contains("## Extracted Text") | F.col("body").contains("<!-- page:") | F.col("body").contains("<!-- extraction:")
    listed = lambda f, picked, other: F.when(picked["value"][0].isin(ENUMS[f]), picked).otherwise(other)
    status = F.when(recognised, "done").otherwise("not_started")
    made = {
        "document_key": F.col("_document"), "version_key": _first(("front_matter", F.when(~automatic, old("version_key", "version_id"))), ("made", one(T.version_key(key, digest)))),
        "document_type": _first(given("document_type"), kept("document_type"), default("document_type")), "domain": _first(kept("domain"), default("domain")), "audience": _first(kept("audience"), default("audience")),
        "is_latest": _first(("front_matter", F.when(F.get(old("is_latest"), 0).isin("true", "false"), old("is_latest"))), default("is_latest")),
        "ocr_status": listed("ocr_status", _first(given("ocr_status"), kept("ocr_status"), ("report", one(status))), _first(("report", one(status)))),
        "review_status": listed("review_status", _first(kept("review_status"), default("review_status")), _first(default("review_status"))), "rag_status": listed("rag_status", _first(kept("rag_status"), default("rag_status")), _first(default("rag_status"))),
        "source_path": _first(("source", one(F.col("source"))), kept("source_path")), "canonical_markdown_path": _first(*([] if overwrite else [kept("canonical_markdown_path")]), ("made", one(F.col("path")))),
        "file_type": listed("file_type", _first(given("file_type"), ("source", one(T.file_type("source"))), kept("file_type"), default("file_type")), _first(default("file_type"))), "language": _first(given("language"), kept("language"), default("language")),
        "checksum": F.col("_checksum"), "parser": _first(given("parser"), kept("parser"), ("report", one(T.infer_parser(values)))),
        "ocr_engine": _first(given("ocr_engine"), kept("ocr_engine"), ("report", one(F.coalesce(F.element_at("report", "ocr engine for scan/images"), F.element_at("report", "ocr engine for scan pages/images"), F.when(values.contains("llama"), "LlamaParse API"))))),
        "created_at": _first(kept("created_at"), ("made", one(now.cast("string")))), "updated_at": _first(("made", one(now.cast("string")))),
    }
    each = F.array(*[F.struct(F.lit(f).alias("field"), (made[f] if f in made else _first(kept(f), default(f))).alias("v")) for f in ORDER])
    each = F.transform(each, lambda x: F.struct(x["field"].alias("field"), F.coalesce(x["v"]["value"], F.array().cast("array<string>")).alias("value"), F.coalesce(x["v"]["origin"], F.lit("none")).alias("origin")))
    d = d.withColumn("each", each)
    fields = F.map_from_arrays(F.transform("each", lambda x: x["field"]), F.transform("each", lambda x: x["value"]))
    origins = F.map_from_arrays(F.transform("each", lambda x: x["field"]), F.transform("each", lambda x: x["origin"]))
    differs = lambda x: ~x["value"].eqNullSafe(F.coalesce(F.filter(F.element_at("old", x["field"]), lambda y: y != ""), F.array().cast("array<string>"))) & ~x["field"].isin("created_at", "updated_at")
    body = F.regexp_replace("body", r"(?s)\A\s*# PDF / Image Text Document[ \t]*\n+## Metadata[ \t]*\n+.*?(?:^|\n)[ \t]*## Extracted Text[ \t]*(?:\n|\z)\s*", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^[ \t]*<!--\s*layout_analyzer:.*?-->[ \t]*(?:\n|\z)", ""), r"\A[\r\n]+", "")
    d = d.withColumns({"fields": fields, "origins": origins, "changed": F.transform(F.filter("each", differs), lambda x: x["field"]), "clean": body})
    return d.select("path", "source", "fields", "origins", "changed", X.render_front_matter(F.col("fields"), F.col("clean"), ORDER).alias("text"))


def recognised(pages: DataFrame, files: DataFrame, now: Column, mode: str = "html-comment", repair: bool = True, **how) -> DataFrame:
    """From recognised pages (path, page_number, content) to texts with their metadata: pages joined, repaired, and attached (see ``attach``)."""
    from docloom.operators.repair import postprocessed
    from docloom.operators.retrieval import joined_pages

    texts = joined_pages(pages, mode, "path")
    return attach(postprocessed(texts, "path") if repair else texts, files, now, **how)
