"""Registered queries of the lifecycle log: the events of a user are those of a version."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import lifecycle as L
from docloom.plans.queries import query

_EVENT = "case " + " ".join(f"when event_id % 23 in ({', '.join(map(str, at))}) then '{e}'" for e, at in {"upload": (0, 1), "review": (2, 3, 4), "preview": (5, 6, 7), "approve_chunks": (8, 9, 10), "start_index": (11, 12, 13), "job_success": (14, 15), "job_failure": (16,), "publish": (17, 18), "unpublish": (19,), "deindex": (20, 21), "delete": (22,)}.items()) + " end"
#: How an event's checks follow from its row: each fails for some.
_CHECKS = {"title_given": "event_id % 17 <> 0", "size_allowed": f"value * 50000 <= {L.MOST_BYTES}", "references_active": "event_id % 13 <> 1", "date_given": "event_id % 19 <> 2", "no_chunk_errors": "event_id % 11 <> 3", "chunks_equal": "event_id % 7 <> 4", "recent": "event_id % 2 = 0"}
_OUTCOME = "case event_id % 5 when 3 then 'failed' when 4 then 'lost' else 'ok' end"

_ERROR = """case when event = 'upload' then case when rag not in ('none', 'removed') then 'version_exists' when not references_active then 'inactive_reference' when not date_given then 'no_date' end
  when rag in ('none', 'removed') then 'unknown_version'
  when event = 'review' then case when rag <> 'not_indexed' then 'wrong_status' when not title_given then 'no_title' when not size_allowed then 'wrong_size' when not references_active then 'inactive_reference' end
  when event = 'approve_chunks' then case when not no_chunk_errors then 'chunk_errors' when not (ocr = 'done' and review = 'approved') then 'not_approved' when rag not in ('not_indexed', 'failed') then 'wrong_status' when fresh = 'no' then 'snapshot_changed' end
  when event = 'start_index' then case when rag not in ('not_indexed', 'failed') then 'wrong_status' when not (ocr = 'done' and review = 'approved') then 'not_approved' when step <> 'chunks_approved' then 'chunks_not_approved' when not chunks_equal then 'chunks_differ' end
  when event = 'job_success' then case when job <> 'indexing' or rag <> 'chunked' then 'job_not_processing' end
  when event = 'job_failure' then case when job <> 'indexing' then 'job_not_processing' end
  when event = 'publish' then case when rag <> 'indexed' then 'wrong_status' when outcome <> 'ok' then 'external_failed' end
  when event = 'unpublish' then case when rag <> 'published' then 'wrong_status' when outcome <> 'ok' then 'external_failed' end
  when event = 'deindex' then case when rag not in ('chunked', 'embedded', 'indexed', 'published', 'deactivated') then 'wrong_status' when rag = 'deactivated' and job not in ('deindex', 'deindex_failed') then 'no_such_job'
    when rag <> 'deactivated' and job = 'indexing' or rag = 'deactivated' and job = 'deindex' and recent then 'job_running' when outcome <> 'ok' then 'external_' || outcome end
  when event = 'delete' then case when rag not in ('not_indexed', 'failed', 'deactivated') then 'wrong_status' when rag = 'deactivated' and job not in ('delete', 'delete_failed') then 'no_such_job'
    when rag = 'deactivated' and job = 'delete' and recent then 'job_running' when outcome <> 'ok' then 'external_' || outcome end end"""
_AWAY = "event in ('deindex', 'delete') and error like 'external%'"
LOG_SQL = f"""
e as (select user_id as version, row_number() over (partition by user_id order by ts, event_id) as n, event_id, {_EVENT} as event, {_OUTCOME} as outcome, {', '.join(f'coalesce({c}, false) as {n}' for n, c in _CHECKS.items())} from events),
s(version, n, event_id, event, was, rag, review, ocr, step, fresh, job, error) as (
  select version, 0, 0::bigint, '', '', case when version % 2 = 0 then 'not_indexed' else 'none' end, case when version % 4 = 0 then 'approved' else 'reviewing' end, case when version % 2 = 0 then 'done' else 'pending' end, 'review', 'no', 'idle', cast(null as varchar) from (select distinct version from e)
  union all
  select version, n, event_id, event, rag, case when {_AWAY} then 'deactivated' when error is not null then rag when event = 'upload' then 'not_indexed' when event = 'start_index' then 'chunked' when event = 'job_success' then 'indexed' when event = 'job_failure' then case when rag in ('chunked', 'embedded') then 'failed' else rag end when event = 'publish' then 'published' when event = 'unpublish' then 'indexed' when event = 'deindex' then 'not_indexed' when event = 'delete' then 'removed' else rag end,
    case when error is not null then review when event = 'upload' then 'reviewing' when event = 'review' then 'approved' else review end, case when error is null and event = 'upload' then 'done' else ocr end,
    case when error is not null then step when event = 'upload' then 'review' when event in ('review', 'deindex') then 'chunking' when event = 'approve_chunks' then 'chunks_approved' else step end,
    case when error is not null then fresh when event in ('upload', 'review') then 'no' when event = 'preview' then 'yes' else fresh end,
    case when {_AWAY} then event || case when outcome = 'failed' then '_failed' else '' end when error is not null then job when event in ('upload', 'job_success', 'job_failure', 'deindex', 'delete') then 'idle' when event = 'start_index' then 'indexing' else job end, error
  from (select *, {_ERROR} as error from (select e.*, s.rag, s.review, s.ocr, s.step, s.fresh, s.job from s join e on e.version = s.version and e.n = s.n + 1)))"""


def applied(read, most: int = L.MOST, span: int = L.SPAN):
    e = read("events")
    log = e.select(F.col("user_id").alias("version"), F.col("ts").alias("at"), "event_id", F.expr(_EVENT).alias("event"), L.kind_of(F.expr(_EVENT), {n: F.expr(c) for n, c in _CHECKS.items()}, F.expr(_OUTCOME)).alias("kind"))
    known = e.select(F.col("user_id").alias("version")).distinct()
    even = F.col("version") % 2 == 0
    start = L.state_code({"rag": F.when(even, "not_indexed").otherwise("none"), "review": F.when(F.col("version") % 4 == 0, "approved").otherwise("reviewing"), "ocr": F.when(even, "done").otherwise("pending"), "step": F.lit("review"), "fresh": F.lit("no"), "job": F.lit("idle")})
    return L.apply_log(log, known.select("version", start.alias("start")), most, span)


@query(f"with recursive {LOG_SQL} select version, event_id, event, was as rag_status, rag as next_status, review, ocr, step, fresh, job, error from s where n > 0")
def lifecycle_log(spark, read):
    a = applied(read)
    return a.select("version", "event_id", "event", L.named_state(F.col("before"))["rag"].alias("rag_status"), *[c.alias("next_status" if n == "rag" else n) for n, c in L.named_state(F.col("after")).items()], "error")


@query(f"with recursive {LOG_SQL} select version, rag, review, ocr, step, fresh, job from s qualify row_number() over (partition by version order by n desc) = 1")
def lifecycle_standing(spark, read):
    return L.standing(applied(read))
