"""Catalog and vector-store maintenance: every mutation is a new version of a table, next to what it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.retrieval import small
from docloom.sources.shared import dealt, written

#: The audience that has a flag of its own in the payload.
STUDENT = "sinh_vien"


def _keys(df: DataFrame, on: list[str] | str) -> DataFrame:
    return df.select(*([on] if isinstance(on, str) else on)).distinct()


# ---- vectors


def delete_points(points: DataFrame, versions: DataFrame, on: str = "version_key") -> tuple[DataFrame, DataFrame]:
    """(the points of other versions, (on, removed): the exact number removed of each given version, 0 too)."""
    gone = _keys(versions, on)
    removed = gone.join(points.groupBy(on).agg(F.count("*").alias("removed")), on, "left").select(on, F.coalesce("removed", F.lit(0)).alias("removed"))
    return points.join(gone, on, "left_anti"), removed


def patch_payload(points: DataFrame, patch: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """The points with the patch's fields where it has their key; the student flag follows a patched audience."""
    new = patch.dropDuplicates([on]).select(on, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = points.join(new, on, "left")
    values = {f: F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    out = out.withColumns(values)
    if "audience" in fields:
        out = out.withColumn("audience_student", F.coalesce(F.array_contains("audience", STUDENT), F.lit(False)))
    return out.drop("_hit", *[f"_{f}" for f in fields])


#: The payload's fields with their types, and what stands where a chunk does not say.
PAYLOAD = [
    ("document_key", "string", None), ("version_key", "string", None), ("title", "string", None), ("source_file", "string", None), ("source_url", "string", None), ("document_type", "string", None),
    ("domain", "string", None), ("audience", "array<string>", []), ("audience_student", "boolean", False), ("review_status", "string", None), ("rag_status", "string", None), ("is_latest", "boolean", None),
    ("chunk_key", "string", None), ("parent_chunk_key", "string", None), ("chunk_type", "string", None), ("heading_path", "array<string>", []), ("item_path", "array<string>", []), ("page_start", "int", None),
    ("page_end", "int", None), ("chunk_index", "int", None), ("postgres_chunk_id", "bigint", 0), ("postgres_parent_chunk_id", "bigint", None), ("block_type", "string", "paragraph"), ("legal_unit_type", "string", "none"),
    ("logical_item_key", "string", None), ("parent_item_key", "string", None), ("logical_table_key", "string", None), ("logical_code_key", "string", None), ("logical_item_keys", "array<string>", []), ("split_index", "int", 0),
    ("split_count", "int", 1), ("item_marker", "string", None), ("item_level", "int", None),
]


def payload(chunks: DataFrame) -> DataFrame:
    """The payload's fields from a frame of chunks joined with their documents; columns that it lacks take their defaults.

    The source file is the canonical path, else the source path; an empty url is none.
    """
    have = set(chunks.columns)
    pick = lambda *names: [F.nullif(F.col(n), F.lit("")) for n in names if n in have]
    made = {"source_file": F.coalesce(*pick("canonical_markdown_path", "source_path"), F.lit(None)), "source_url": F.coalesce(*pick("source_url"), F.lit(None))}
    made["audience_student"] = F.array_contains("audience", STUDENT) if "audience" in have else F.lit(None)
    out = []
    for name, kind, default in PAYLOAD:
        value = made.get(name, F.col(name) if name in have else F.lit(None)).cast(kind)
        if default is not None:
            value = F.coalesce(value, F.array().cast(kind) if default == [] else F.lit(default).cast(kind))
        out.append(value.alias(name))
    return chunks.select(*out)


def vector_drift(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """(found_dim, n): the sizes that differ from the collection's, null vectors as -1. No row: no drift."""
    return vectors.select(F.coalesce(F.size(column), F.lit(-1)).alias("found_dim")).where(F.col("found_dim") != dim).groupBy("found_dim").agg(F.count("*").alias("n"))


def schema_drift(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns that are missing or of another type than expected."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{n}: expected {t}, found {have.get(n, 'none')}" for n, t in expected.items() if have.get(n) != t]


def cache_split(chunks: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """Chunks (chunk_key, content, ...) with the cached vector and ``hit``: same key, model, content hash and size."""
    c = cache.where((F.col("model") == model) & (F.size("embedding") == dim)).dropDuplicates(["chunk_key", "content_hash"]).select("chunk_key", "content_hash", F.col("embedding").alias("vector"))
    return chunks.withColumn("content_hash", F.sha2("content", 256)).join(c, ["chunk_key", "content_hash"], "left").withColumn("hit", F.col("vector").isNotNull())


def embed_with_cache(chunks: DataFrame, cache: DataFrame, model: str, dim: int, embed) -> DataFrame:
    """(chunk_key, content_hash, vector, hit): cached vectors, and ``embed`` (a column function of the content) for the rest; another size is an error."""
    split = cache_split(chunks, cache, model, dim)
    vector = F.when(F.col("hit"), F.col("vector")).otherwise(embed(F.col("content")))
    checked = F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"vectors of {model} must have {dim} numbers")).cast("array<float>"))
    return split.withColumn("v", vector).select("chunk_key", "content_hash", checked.alias("vector"), "hit")


# ---- chunks


def _starts(sizes: DataFrame, on: str) -> DataFrame:
    """(on, _start): how many rows of (on, _n) stand before each in order of ``on``. Ranges of the order are numbered apart; one task sees one row for each of them."""
    ranged = written(sizes.repartitionByRange(on).sortWithinPartitions(on).withColumn("_part", F.spark_partition_id()), "sizes")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_n")).withColumn("_base", before(Window.orderBy("_part"))).select("_part", "_base")
    return ranged.withColumn("_own", before(Window.partitionBy("_part").orderBy(on))).join(F.broadcast(parts), "_part").select(on, (F.col("_base") + F.col("_own")).alias("_start"))


def _named(versions: DataFrame | None, wanted: DataFrame, on: str) -> DataFrame:
    """The versions that a request is about: those given, else those of its rows (which an empty list does not have)."""
    return _keys(wanted if versions is None else versions, on)


def replace_chunks(old: DataFrame, new: DataFrame, first_id: int, on: str = "version_key", versions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors): the ``versions`` (those of ``new``, if not given) lose their old chunks and get the new ones, parents first.

    Ids go on from ``first_id`` by version, parents before children, then chunk_index. A child's parent_id is its parent's
    by key; a child without such a parent is an error, and its version keeps its old chunks.
    """
    new = new.withColumn("_child", F.col("parent_chunk_key").isNotNull())
    parents = new.where("not _child").select(on, F.col("chunk_key").alias("parent_chunk_key"), F.lit(True).alias("_met")).distinct()
    named = new.join(parents, [on, "parent_chunk_key"], "left")
    errors = named.where("_child and _met is null").select(on, "chunk_key", "parent_chunk_key")
    named = named.join(_keys(errors, on), on, "left_anti")
    # ids in two steps, so that no task numbers all rows: a version's first id, then its rows
    starts = _starts(named.groupBy(on).agg(F.count("*").alias("_n")), on)
    place = F.row_number().over(Window.partitionBy(on).orderBy("_child", "chunk_index", "chunk_key"))
    named = named.join(starts, on).withColumn("id", (F.col("_start") + place + first_id - 1).cast("long"))
    ids = named.where("not _child").groupBy(on, F.col("chunk_key").alias("parent_chunk_key")).agg(F.min("id").alias("parent_id"))
    named = named.drop("_met").join(ids, [on, "parent_chunk_key"], "left")
    gone = _named(versions, named, on).join(_keys(errors, on), on, "left_anti")
    return old.join(gone, on, "left_anti").unionByName(named.select(*old.columns)), errors


def snapshot_diff(approved: DataFrame, generated: DataFrame, fields: list[str]) -> DataFrame:
    """(fields, side): rows that only one of two row sets has, counted with repeats; none if the signatures are equal."""
    a, b = approved.select(*fields), generated.select(*fields)
    return a.exceptAll(b).withColumn("side", F.lit("approved")).unionByName(b.exceptAll(a).withColumn("side", F.lit("generated")))


def chunk_report(chunks: DataFrame, on: str = "version_key") -> DataFrame:
    """(on, total, parents, children, warnings, errors) of chunks with chunk_type and severity."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return chunks.groupBy(on).agg(F.count("*").alias("total"), n(F.col("chunk_type") == "parent").alias("parents"), n(F.col("chunk_type") == "child").alias("children"), n(F.col("severity") == "warning").alias("warnings"), n(F.col("severity") == "error").alias("errors"))


def contract_errors(df: DataFrame) -> Column:
    """The rules that a chunk breaks: page order, a parent with a parent key, a child without one."""
    from docloom.operators.catalog import rule_errors

    return rule_errors({
        "page_order": F.col("page_start").isNull() | F.col("page_end").isNull() | (F.col("page_start") <= F.col("page_end")),
        "parent_has_parent": (F.col("chunk_type") != "parent") | F.col("parent_chunk_key").isNull(),
        "child_without_parent": (F.col("chunk_type") != "child") | F.col("parent_chunk_key").isNotNull(),
    })


# ---- links


def replace_assets(assets: DataFrame, links: DataFrame, wanted: DataFrame, on: str = "version_key", versions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, links, duplicates) after the ``versions`` (those of ``wanted``, if not given) get their links (on, position, url); one without any is emptied.

    An asset's key is the hash of its url, so a known url is updated and not added again. A version that names a url twice
    is refused whole and stands in the duplicates.
    """
    wanted = wanted.withColumn("asset_key", F.concat(F.lit("url-"), F.sha2("url", 256)))
    twice = wanted.groupBy(on, "url").agg(F.count("*").alias("n")).where("n > 1")
    wanted = wanted.join(_keys(twice, on), on, "left_anti")
    fresh = wanted.groupBy("asset_key").agg(F.first("url").alias("url"))
    kept = links.join(_named(versions, wanted, on).join(_keys(twice, on), on, "left_anti"), on, "left_anti")
    return assets.join(fresh.select("asset_key"), "asset_key", "left_anti").unionByName(fresh.select(*assets.columns)), kept.unionByName(wanted.select(on, "asset_key", F.col("position").alias("display_order")).select(*links.columns)), twice.select(on, "url", "n")


def replace_recipients(old: DataFrame, requested: DataFrame, versions: DataFrame, departments: DataFrame, on: str = "version_key") -> tuple[DataFrame, DataFrame]:
    """(recipients, refused): the ``versions`` (on, issued_date) get the codes asked for in place of those they had; one without any is emptied.

    Each code counts once, in order of its first place; the effective date falls back to the version's issue date. A version
    that asks for a code that is not active is refused whole, keeps what it had, and its bad codes stand in ``refused``.

    The requests are dealt by version into parts of bounded size; every step after it keeps these.
    """
    once = dealt(requested.select(on, "code", "position", "effective_date"), on).groupBy(on, "code").agg(F.min("position").alias("position"), F.min_by("effective_date", "position").alias("effective_date"))
    refused = once.join(small(departments.where("is_active").select("code").distinct()), "code", "left_anti").select(on, "code")
    good = versions.join(_keys(refused, on), on, "left_anti")
    out = once.join(good.select(on, "issued_date"), on)
    out = out.select(on, "code", F.row_number().over(Window.partitionBy(on).orderBy("position", "code")).alias("position"), F.coalesce("effective_date", "issued_date").alias("effective_date"))
    return old.join(_keys(good, on), on, "left_anti").select(on, "code", "position", "effective_date").unionByName(out), refused


def active_codes(reference: DataFrame, flag: str = "is_active") -> DataFrame:
    """Reference rows in use; a null flag is not in use."""
    return reference.where(F.coalesce(F.col(flag), F.lit(False)))


def demote_others(versions: DataFrame, latest: DataFrame, document: str = "document_id", version: str = "version_id") -> DataFrame:
    """``versions`` with is_latest false for the other versions of the documents named in ``latest`` (document, version)."""
    named = latest.groupBy(document).agg(F.max(version).alias("_version"))
    out = versions.join(named, document, "left")
    keep = F.col("_version").isNull() | (F.col("_version") == F.col(version))
    return out.withColumn("is_latest", F.col("is_latest") & keep).drop("_version")


# ---- jobs


def latest_job(jobs: DataFrame, on: str = "version_id", key: str = "job_id") -> DataFrame:
    """Each version's job with the largest id."""
    rest = [c for c in jobs.columns if c not in (on, key)]
    return jobs.groupBy(on).agg(F.max(key).alias(key), *[F.max_by(c, key).alias(c) for c in rest])


def chunks_approved(jobs: DataFrame, on: str = "version_id") -> DataFrame:
    """(on, approved): whether any ingestion job of the version has reached the step chunks_approved."""
    return jobs.groupBy(on).agg(F.bool_or(F.coalesce((F.col("job_type") == "ingestion") & (F.col("step") == "chunks_approved"), F.lit(False))).alias("approved"))


def retryable(status: Column, updated: Column, now: Column, minutes: int = 5) -> Column:
    """Failed jobs, and running ones that nobody has touched within the window."""
    return (status == "failed") | ((status == "processing") & (updated < now - F.make_dt_interval(mins=F.lit(minutes))))


# ---- metadata

# The metadata's fields by what is asked of them.
CORE = "document_key version_key title document_type domain responsible_department audience is_latest source_path canonical_markdown_path file_type language checksum ocr_status review_status rag_status".split()
AUTOMATIC = "document_key version_key document_type is_latest ocr_status review_status rag_status canonical_markdown_path file_type language checksum".split()
HUMAN = "title domain responsible_department audience".split()
OPTIONAL = "code issued_date effective_date status_note source_url source_path accessed_date parser ocr_engine notes".split()
DATES = "issued_date effective_date accessed_date".split()


def validation(fields: Column, enums: dict[str, list[str]], audiences: list[str]) -> Column:
    """struct(errors, warnings), arrays of rule:field, for a map of fields to lists of values (a scalar is a list of one)."""
    has = lambda f: F.map_contains_key(fields, f)
    values = lambda f: F.coalesce(F.element_at(fields, f), F.array().cast("array<string>"))
    one = lambda f: F.coalesce(F.get(values(f), 0), F.lit(""))
    empty = lambda f: F.forall(values(f), lambda x: x.isNull() | (F.trim(x) == ""))
    given = lambda f: has(f) & ~empty(f)
    errors = [(~has(f), f"missing:{f}") for f in CORE] + [(has(f) & empty(f), f"empty:{f}") for f in AUTOMATIC]
    errors += [(given("audience") & (F.size(F.array_except(values("audience"), F.array(*map(F.lit, audiences)))) > 0), "enum:audience"), (has("is_latest") & ~F.lower(one("is_latest")).isin("true", "false"), "boolean:is_latest")]
    errors += [(given(f) & ~one(f).isin(allowed), f"enum:{f}") for f, allowed in enums.items()]
    errors += [(given("checksum") & ~one("checksum").rlike(r"\A[0-9a-fA-F]{64}\z"), "sha256:checksum")]
    errors += [(given(f) & ~one(f).rlike(r"\A\d{4}-\d{2}-\d{2}\z"), f"date:{f}") for f in DATES]
    published = one("rag_status") == "published"
    errors += [(published & (one("ocr_status") != "done"), "published:ocr_status"), (published & (one("review_status") != "approved"), "published:review_status")]
    warnings = [(has(f) & empty(f), f"review:{f}") for f in HUMAN] + [(has(f) & empty(f), f"optional:{f}") for f in OPTIONAL] + [(one("document_type") == "unknown", "review:document_type")]
    listed = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules]))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, dict.fromkeys(CORE + OPTIONAL))))), lambda x: F.concat(F.lit("unknown:"), x))
    none = F.size(F.map_keys(fields)) <= 0
    return F.struct(F.when(none, F.array(F.lit("missing:front_matter"))).otherwise(listed(errors)).alias("errors"), F.when(none, F.array().cast("array<string>")).otherwise(F.concat(unknown, listed(warnings))).alias("warnings"))


def merged(fields: list[str], *sources: str) -> list[Column]:
    """Each field from the first source (a column prefix) that has it non-empty: what was asked for, what stood there, what was inferred."""
    return [F.coalesce(*[F.nullif(F.trim(F.col(f"{s}{f}")), F.lit("")) for s in sources]).alias(f) for f in fields]


def overlaid(front: Column, stored: Column) -> Column:
    """Front matter may be stale: the catalog's value where it has one."""
    return F.coalesce(stored, front)


def department_ok(code: Column) -> Column:
    return F.coalesce(code.rlike(r"\A[A-Za-z0-9_][A-Za-z0-9_/-]*\z"), F.lit(False))


def cleaned_list(values: Column) -> Column:
    """Trimmed values without blanks, each once in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def summary(versions: DataFrame) -> DataFrame:
    """Listing rows: the title falls back to the document's, JSON fields to defaults, dates are ISO, flags are derived."""
    json = lambda path, default: F.coalesce(F.get_json_object("meta", f"$.{path}"), F.lit(default))
    return versions.select(
        "version_id", F.coalesce(F.nullif("title", F.lit("")), F.col("document_title"), F.lit("")).alias("title"), json("language", "vi").alias("language"), F.date_format("issued_date", "yyyy-MM-dd").alias("issued"),
        F.date_format(F.coalesce("effective_date", "issued_date"), "yyyy-MM-dd").alias("effective"), (F.col("rag_status") == "published").alias("is_published"), F.col("rag_status").isin("indexed", "published").alias("is_searchable"),
    )


def with_related(rows: DataFrame, related: dict[str, DataFrame], on: str) -> DataFrame:
    """Rows with one ordered list of every relation (on, place, value); an empty list without any."""
    for name, r in related.items():
        lists = r.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias(name))
        rows = rows.join(lists, on, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
    return rows


def ocr_output_path(path: Column) -> Column:
    """Where a source's recognised text goes; DOCX sources keep the folders below their group."""
    flat = F.regexp_replace(path, r"^(.*)/02_Attachments/([^/]+)/([^/]+)/(?:.*/)?([^/]+?)(?:\.[^./]*)?$", "$1/06_Processing/01_OCR_Output/$2_$3/$4_llp.md")
    nested = F.regexp_replace(path, r"^(.*)/02_Attachments/([^/]+)/([^/]+)/(.+?)(?:\.[^./]*)?$", "$1/06_Processing/01_OCR_Output/$2_$3/$4_llp.md")
    return F.when(F.upper(F.regexp_extract(path, "/02_Attachments/([^/]+)/", 1)) == "DOCX", nested).otherwise(flat)
