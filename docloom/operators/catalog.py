"""The versioned document catalog: listings, links, mutations as new versions of a table, and the lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# States from which an event may start, and where it leads.
TRANSITIONS = [
    ("not_indexed", "review", "not_indexed"),
    ("not_indexed", "approve_chunks", "not_indexed"),
    ("failed", "approve_chunks", "failed"),
    ("not_indexed", "start_index", "chunked"),
    ("failed", "start_index", "chunked"),
    ("chunked", "job_success", "indexed"),
    ("chunked", "job_failure", "failed"),
    ("indexed", "publish", "published"),
    ("published", "unpublish", "indexed"),
    ("chunked", "deindex", "not_indexed"),
    ("embedded", "deindex", "not_indexed"),
    ("indexed", "deindex", "not_indexed"),
    ("published", "deindex", "not_indexed"),
    ("not_indexed", "delete", "removed"),
    ("failed", "delete", "removed"),
]


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "rag_status string, event string, next_status string")


#: What a guard reads where a frame of versions has no such column.
GUARDED = {"active_job": "false", "title": "'-'", "n_bytes": "1", "n_chunk_errors": "0", "snapshot_changed": "false", "signature_equal": "true", "job_processing": "true", "minutes_since_update": "0"}
RETRY_MINUTES, MOST_BYTES = 5, 20 * 1024 * 1024


def apply_events(versions: DataFrame, events: DataFrame, retry_minutes: int = RETRY_MINUTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(version_id, event, rag_status, next_status, error): each event against its version's state; a guard that fails leaves the state.

    Guards: reviews ask for a title and a text of at most ``most_bytes`` (20 MB of UTF-8); approving chunks for no chunk errors and a
    snapshot that has not changed since; indexing for chunks equal to the approved ones; a job's end for a job that is
    still processing; taking off the index for no running job, or one untouched for ``retry_minutes``.
    """
    moves = F.broadcast(transition_table(versions.sparkSession))
    versions = versions.withColumns({n: F.expr(default) for n, default in GUARDED.items() if n not in versions.columns})
    out = events.join(versions, "version_id", "left").join(moves, ["rag_status", "event"], "left")
    approved = (F.col("ocr_status") == "done") & (F.col("review_status") == "approved")
    event = F.col("event")
    error = (
        F.when(F.col("rag_status").isNull(), "unknown_version")
        .when(F.col("next_status").isNull(), "wrong_status")
        .when((event == "review") & (F.coalesce(F.trim("title"), F.lit("")) == ""), "no_title")
        .when((event == "review") & ~F.coalesce(F.col("n_bytes").between(1, most_bytes), F.lit(False)), "wrong_size")
        .when(event.isin("approve_chunks", "start_index", "publish") & ~approved, "not_approved")
        .when((event == "approve_chunks") & (F.col("n_chunk_errors") > 0), "chunk_errors")
        .when((event == "approve_chunks") & F.col("snapshot_changed"), "snapshot_changed")
        .when((event == "start_index") & ~F.col("signature_equal"), "chunks_differ")
        .when(event.isin("job_success", "job_failure") & ~F.col("job_processing"), "job_not_processing")
        .when((event == "deindex") & F.col("active_job") & (F.col("minutes_since_update") < retry_minutes), "job_running")
    )
    return out.select("version_id", "event", "rag_status", F.when(error.isNull(), F.col("next_status")).otherwise(F.col("rag_status")).alias("next_status"), error.alias("error"))


def removed_with_orphans(documents: DataFrame, versions: DataFrame, removed: DataFrame, document: str = "document_id", version: str = "version_id") -> tuple[DataFrame, DataFrame]:
    """(documents, versions) without the removed versions, and without documents that lost their last version by that."""
    left = versions.join(removed.select(version).distinct(), version, "left_anti")
    emptied = versions.join(removed.select(version).distinct(), version, "left_semi").select(document).distinct().join(left.select(document), document, "left_anti")
    return documents.join(emptied, document, "left_anti"), left


def matching(text: str | None, *columns: str) -> Column:
    """Case-insensitive containment of ``text`` in any of the columns; wildcards in it count. Without text, all rows."""
    if not (text or "").strip():
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(f"%{text.strip()}%")
    return out


def equal_where_given(**values) -> Column:
    out = F.lit(True)
    for name, v in values.items():
        if v is not None:
            out = out & (F.col(name) == v)
    return out


def having(df: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a link."""
    return df.join(links.select(*on), on, "left_semi")


def missing(requested: DataFrame, active: DataFrame, on: str) -> DataFrame:
    """Requested codes that are not active."""
    return requested.select(on).distinct().join(active.select(on), on, "left_anti")


def latest_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def cascade(tables: dict[str, DataFrame], removed: DataFrame, on: str) -> dict[str, DataFrame]:
    """Every table without the rows of removed keys."""
    return {name: t.join(removed.select(on).distinct(), on, "left_anti") for name, t in tables.items()}


def orphans(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    return parents.join(children.select(on), on, "left_anti")


def progress(total: Column, done: Column) -> tuple[Column, Column]:
    """(processed, remaining): never more than the total, never negative."""
    return F.least(done, total).alias("processed"), F.greatest(total - done, F.lit(0)).alias("remaining")


def changed(old: DataFrame, new: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """(key, changed): the names of the fields that differ, nulls compared as values."""
    pair = old.alias("o").join(new.alias("n"), on)
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), f) for f in fields]))
    return pair.select(on, names.alias("changed")).where(F.size("changed") > 0)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def last_n(c: Column, n: int) -> Column:
    """The last n items; all of a shorter array."""
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 1), n)


def rule_errors(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


# ---- updates of one version's metadata

#: Fields that what was embedded depends on, and those that may change at any time.
EMBEDDED_FIELDS = ["title", "type_id", "departments", "body", "is_latest"]
FREE_FIELDS = ["domain", "audience", "code", "issued_date", "effective_date", "expiry_date", "validity_status"]
INDEXED_STATES = ["chunked", "embedded", "indexed", "published"]


def update_plan(current: DataFrame, requested: DataFrame, on: str = "version_id") -> DataFrame:
    """(on, error, restricted, changed, whole, sync_payload, recipients_date) of each request.

    Both frames have ``EMBEDDED_FIELDS`` and ``FREE_FIELDS`` (departments and audience arrays); ``current`` also rag_status. An indexed
    version may change its free fields alone: others stand in ``restricted`` and the error is ``needs_deindex``. Otherwise the
    request is a whole edit (``whole``), to be reviewed. Departments ask for an effective or an issue date. ``sync_payload``
    says that the vectors' payload has to follow; a version without changes is left alone. Departments compare as sets, bodies trimmed.
    """
    pair = requested.alias("n").join(current.alias("o"), on, "left")
    old, new = (lambda f: F.col(f"o.{f}")), (lambda f: F.col(f"n.{f}"))
    shaped = {"departments": lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), "body": lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")}
    same = lambda f: shaped.get(f, lambda c: c)(old(f)).eqNullSafe(shaped.get(f, lambda c: c)(new(f)))
    names = lambda fields: F.array_compact(F.array(*[F.when(~same(f), f) for f in fields]))
    indexed = old("rag_status").isin(INDEXED_STATES)
    date = F.coalesce(new("effective_date"), new("issued_date"))
    restricted = F.when(indexed, names(EMBEDDED_FIELDS)).otherwise(F.array().cast("array<string>"))
    owners = F.when(indexed, old("departments")).otherwise(new("departments"))
    error = F.when(old("rag_status").isNull(), "unknown_version").when(F.size(restricted) > 0, "needs_deindex").when((F.size(F.coalesce(owners, F.array().cast("array<string>"))) > 0) & date.isNull(), "no_date")
    changed = F.when(error.isNull(), F.concat(F.when(indexed, F.array().cast("array<string>")).otherwise(names(EMBEDDED_FIELDS)), names(FREE_FIELDS))).otherwise(F.array().cast("array<string>"))
    payload = error.isNull() & ~(same("domain") & same("audience"))
    return pair.select(on, error.alias("error"), F.when(error == "needs_deindex", restricted).otherwise(F.array().cast("array<string>")).alias("restricted"), changed.alias("changed"), (error.isNull() & ~indexed).alias("whole"), payload.alias("sync_payload"), F.when(error.isNull(), date).alias("recipients_date"))


def updated(current: DataFrame, requested: DataFrame, plan: DataFrame, on: str = "version_id") -> DataFrame:
    """``current`` with the changed fields of the requests that ``plan`` accepts."""
    fields = [f for f in EMBEDDED_FIELDS + FREE_FIELDS if f in current.columns]
    r = requested.select(on, *[F.col(f).alias(f"_new_{f}") for f in fields]).join(plan.where("error is null").select(on, "changed"), on)
    out = current.join(r, on, "left")
    return out.select(*[F.when(F.array_contains(F.coalesce("changed", F.array().cast("array<string>")), c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def error_code(kind: Column, phase: Column) -> Column:
    """struct(code, status, retry) of a failed request: what kind of failure, its number for callers, and whether the same request may be sent again (only work outside may)."""
    code = F.when(kind.isin("not_found", "lookup"), "not_found").when(kind.isin("value", "invalid"), "invalid").when(kind.isin("conflict", "exists"), "conflict").otherwise("unavailable")
    status = F.when(code == "not_found", 404).when(code == "invalid", 422).when(code == "conflict", 409).otherwise(503)
    return F.struct(code.alias("code"), status.alias("status"), ((code == "unavailable") & phase.isin("store", "vectors", "model")).alias("retry"))
