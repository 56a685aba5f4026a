import datetime
import random

from pyspark.sql import functions as F

from docloom.operators import lifecycle as L

T0 = datetime.datetime(2024, 1, 1)
GOOD = {c: True for c in L.CHECKS}


def log(spark, rows):
    """rows: (version, minutes, event_id, event, checks, outcome)."""
    flat = [(v, None if m is None else T0 + datetime.timedelta(minutes=m), i, e, *[c.get(n) for n in L.CHECKS], o) for v, m, i, e, c, o in rows]
    df = spark.createDataFrame(flat, "version long, at timestamp, event_id long, event string, " + ", ".join(f"{c} boolean" for c in L.CHECKS) + ", outcome string")
    return df.select("version", "at", "event_id", "event", L.kind_of(F.col("event"), {c: F.col(c) for c in L.CHECKS}, F.col("outcome")).alias("kind"))


def none(spark):
    return spark.createDataFrame([], "version long, start int")


def run(spark, rows, versions=None, **kw):
    got = L.apply_log(log(spark, rows), versions if versions is not None else none(spark), **kw).collect()
    return {r.event_id: (L.STATES[r.before], L.STATES[r.after], r.error) for r in got}


def story(*events):
    return [(1, k, k, *(e if isinstance(e, tuple) else (e, GOOD, "ok"))) for k, e in enumerate(events)]


def test_a_version_from_upload_to_removal(spark):
    rows = story("upload", "review", "preview", "approve_chunks", "start_index", "job_success", "publish", "unpublish", "deindex", "delete", "review", "upload")
    got = run(spark, rows)
    assert [got[k][1].rag for k in range(12)] == ["not_indexed"] * 4 + ["chunked", "indexed", "published", "indexed", "not_indexed", "removed", "removed", "not_indexed"]
    assert [got[k][2] for k in range(12)] == [None] * 10 + ["unknown_version", None]
    assert got[8][1].step == "chunking" and got[1][1].review == "approved"


def test_guards_look_at_the_state_before(spark):
    bad = lambda e, *names, outcome="ok": (e, GOOD | dict.fromkeys(names, False), outcome)
    rows = story(
        bad("upload", "references_active"), bad("upload", "date_given"), "upload", "upload", "approve_chunks", bad("review", "title_given"), bad("review", "size_allowed"), "review", "approve_chunks", "preview",
        "review", "approve_chunks", "preview", bad("approve_chunks", "no_chunk_errors"), "start_index", "approve_chunks", bad("start_index", "chunks_equal"), "start_index", "deindex", "review", "job_failure", "job_success",
        "start_index", "job_success", bad("publish", outcome="failed"), bad("deindex", outcome="lost"), "deindex", bad("deindex", "recent"), "delete", bad("delete", outcome="failed"), "deindex", "delete", "publish", "nonsense",
    )
    want = ["inactive_reference", "no_date", None, "version_exists", "not_approved", "no_title", "wrong_size", None, "snapshot_changed", None, None, "snapshot_changed", None, "chunk_errors", "chunks_not_approved", None, "chunks_differ", None, "job_running", "wrong_status", None, "job_not_processing", None, None, "external_failed", "external_lost", "job_running", None, None, "unknown_version"]
    got = run(spark, rows)
    assert [got[k][2] for k in range(28)] == want[:28]
    assert got[25][1].rag == "deactivated" and got[27][1].rag == "not_indexed"
    assert [got[k][2] for k in range(28, 34)] == [None, "unknown_version", "unknown_version", "unknown_version", "unknown_version", "unknown_event"]


def test_spans_of_a_large_version_give_the_same(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(500)]), i, rnd.choice([*L.EVENTS, "other"]), {c: rnd.choice([True, True, True, False, None]) for c in L.CHECKS}, rnd.choice([*L.OUTCOMES, "ok", "ok", None])) for i in range(1500)]
    start = spark.createDataFrame([(2, L.CODE[L.State("indexed", "approved", "done", "chunks_approved", "yes", "idle")])], "version long, start int")
    whole = run(spark, rows, start)
    assert len(whole) == 1500 and len({e for _, _, e in whole.values()}) > 12
    assert run(spark, rows, start, most=100, span=600) == whole
    # and both equal a plain loop
    state = {2: L.State("indexed", "approved", "done", "chunks_approved", "yes", "idle")}
    for v, m, i, e, c, o in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        before = state.get(v, L.NOTHING)
        after, error = L.step(before, e, {n: bool(c[n]) for n in L.CHECKS}, o or "failed") if e in L.EVENTS else (before, "unknown_event")
        assert whole[i] == (before, after, error)
        state[v] = after


def test_standing_and_an_empty_log(spark):
    out = L.standing(L.apply_log(log(spark, story("upload", "review")), none(spark))).collect()
    assert [tuple(r) for r in out] == [(1, "not_indexed", "approved", "done", "chunking", "no", "idle")]
    assert L.apply_log(log(spark, []), none(spark)).count() == 0
