"""The life of document versions as an ordered log of events, every guard looking at the state that the events before it left.

A version's state is small (``State``: 1,296 combinations), so what a run of events does is a table from each state to the next.
Versions with few events are folded in order, one after the other in the sorted rows of a task. The events of a version with
more than ``most`` are cut into spans of time; each span becomes such a table in its own task, the tables are chained to find
the state that each span begins in, and then the spans are folded like versions of their own. So no version is bound to one task.

``apply_log`` gives a row for each event: what the state was, what it became, and the guard that refused it. ``standing`` gives
the last state of each version. Events of one version go by (at, event_id); a null time comes first. Rows that repeat an event
are applied again. Events without a version or with a name not listed are refused (``unknown_version``, ``unknown_event``).
Null guard values count as not met. An empty log gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class State(NamedTuple):
    rag: str
    review: str
    ocr: str
    step: str
    fresh: str
    job: str


# The states of a version, its review, its text, its chunk approval, and its job.
VALUES = State(
    ("none", "not_indexed", "chunked", "embedded", "indexed", "published", "failed", "deactivated", "removed"),
    ("reviewing", "approved"),
    ("pending", "done"),
    ("review", "chunking", "chunks_approved"),
    ("no", "yes"),
    ("idle", "indexing", "deindex", "deindex_failed", "delete", "delete_failed"),
)
STATES = [State(*x) for x in product(*VALUES)]
CODE = {s: k for k, s in enumerate(STATES)}
NOTHING = State("none", "reviewing", "pending", "review", "no", "idle")
EVENTS = ("upload", "review", "preview", "approve_chunks", "start_index", "job_success", "job_failure", "publish", "unpublish", "deindex", "delete")
#: What an event itself brings: whether each holds, and how the work outside went.
CHECKS = ("title_given", "size_allowed", "references_active", "date_given", "no_chunk_errors", "chunks_equal", "recent")
OUTCOMES = ("ok", "failed", "lost")
MOST_BYTES, RETRY_MINUTES, MOST, SPAN = 20 * 1024 * 1024, 5, 100_000, 3600
_LIVE, _OPEN, _KEPT = ("chunked", "embedded", "indexed", "published"), ("not_indexed", "failed"), ("none", "removed")


def step(s: State, event: str, met: dict[str, bool], outcome: str) -> tuple[State, str | None]:
    """(the state after an event, the guard that refused it)."""
    if event == "upload":
        refused = "version_exists" if s.rag not in _KEPT else "inactive_reference" if not met["references_active"] else None if met["date_given"] else "no_date"
        return (s, refused) if refused else (State("not_indexed", "reviewing", "done", "review", "no", "idle"), None)
    if s.rag in _KEPT:
        return s, "unknown_version"
    ready = s.ocr == "done" and s.review == "approved"
    # by event: the guards in their order, and what the event changes
    guards, after = {
        "review": ([(s.rag != "not_indexed", "wrong_status"), (not met["title_given"], "no_title"), (not met["size_allowed"], "wrong_size"), (not met["references_active"], "inactive_reference")], {"review": "approved", "step": "chunking", "fresh": "no"}),
        "preview": ([], {"fresh": "yes"}),
        "approve_chunks": ([(not met["no_chunk_errors"], "chunk_errors"), (not ready, "not_approved"), (s.rag not in _OPEN, "wrong_status"), (s.fresh == "no", "snapshot_changed")], {"step": "chunks_approved"}),
        "start_index": ([(s.rag not in _OPEN, "wrong_status"), (not ready, "not_approved"), (s.step != "chunks_approved", "chunks_not_approved"), (not met["chunks_equal"], "chunks_differ")], {"rag": "chunked", "job": "indexing"}),
        "job_success": ([(s.job != "indexing" or s.rag != "chunked", "job_not_processing")], {"rag": "indexed", "job": "idle"}),
        "job_failure": ([(s.job != "indexing", "job_not_processing")], {"rag": "failed" if s.rag in ("chunked", "embedded") else s.rag, "job": "idle"}),
        "publish": ([(s.rag != "indexed", "wrong_status"), (outcome != "ok", "external_failed")], {"rag": "published"}),
        "unpublish": ([(s.rag != "published", "wrong_status"), (outcome != "ok", "external_failed")], {"rag": "indexed"}),
        "deindex": ([(s.rag not in (*_LIVE, "deactivated"), "wrong_status"), (s.rag == "deactivated" and not s.job.startswith("deindex"), "no_such_job"), (s.rag in _LIVE and s.job == "indexing", "job_running")], {"rag": "not_indexed", "step": "chunking", "job": "idle"}),
        "delete": ([(s.rag not in (*_OPEN, "deactivated"), "wrong_status"), (s.rag == "deactivated" and not s.job.startswith("delete"), "no_such_job")], {"rag": "removed", "job": "idle"}),
    }[event]
    if event in ("deindex", "delete"):
        guards.append((s.rag == "deactivated" and s.job == event and met["recent"], "job_running"))
    for broken, name in guards:
        if broken:
            return s, name
    if event in ("deindex", "delete") and outcome != "ok":  # the version stays reserved until a later try ends it
        return s._replace(rag="deactivated", job=event if outcome == "lost" else f"{event}_failed"), "external_failed" if outcome == "failed" else "external_lost"
    return s._replace(**after), None


ERRORS = [None, "unknown_version", "unknown_event", "version_exists", "inactive_reference", "no_date", "wrong_status", "no_title", "wrong_size", "chunk_errors", "not_approved", "snapshot_changed", "chunks_not_approved", "chunks_differ", "job_not_processing", "external_failed", "external_lost", "no_such_job", "job_running"]


@lru_cache(maxsize=None)
def _table(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """For each state, the next state and the error of a kind of event (see ``kind_of``)."""
    rest, event = divmod(kind, len(EVENTS) + 1)
    outcome, bits = divmod(rest, 1 << len(CHECKS))
    if event == len(EVENTS):
        return np.arange(len(STATES)), np.full(len(STATES), ERRORS.index("unknown_event"))
    met = {name: bool(bits >> k & 1) for k, name in enumerate(CHECKS)}
    found = [step(s, EVENTS[event], met, OUTCOMES[outcome]) for s in STATES]
    return np.array([CODE[s] for s, _ in found]), np.array([ERRORS.index(e) for _, e in found])


def kind_of(event: Column, checks: dict[str, Column], outcome: Column) -> Column:
    """An event with all it brings as one number."""
    name, went = F.lit(len(EVENTS)), F.lit(1)
    for k, e in enumerate(EVENTS):
        name = F.when(event == e, k).otherwise(name)
    for k, o in enumerate(OUTCOMES):
        went = F.when(outcome == o, k).otherwise(went)
    bits = F.lit(0)
    for k, c in enumerate(CHECKS):
        bits = bits + F.when(F.coalesce(checks[c], F.lit(False)), 1 << k).otherwise(0)
    return (name + (len(EVENTS) + 1) * (bits + (1 << len(CHECKS)) * went)).cast("int")


def state_code(columns: dict[str, Column]) -> Column:
    """A state as its number, from columns named as in ``State``; values not listed count as the first."""
    out = F.lit(0)
    for name, values in zip(State._fields, VALUES, strict=True):
        at = F.lit(0)
        for k, v in enumerate(values):
            at = F.when(columns[name] == v, k).otherwise(at)
        out = out * len(values) + at
    return out.cast("int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """(part of a batch, its kinds, whether a new span begins with it), from rows (version, span, kind, ...) in order."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        version, span = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        kinds = batch.column(2).to_numpy()
        edges = [k for k in range(batch.num_rows) if k and (version[k], span[k]) != (version[k - 1], span[k - 1])]
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            now = (version[a], span[a])
            yield batch.slice(a, b - a), kinds[a:b], now != before
            before = now


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(version, span, table): what each span does to every state."""
    held, now = None, np.arange(len(STATES))

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held.column(0).slice(0, 1), held.column(1).slice(0, 1), pa.array([now.astype("<i2").tobytes()])], ["version", "span", "table"])

    for part, kinds, new in _runs(batches):
        if new and held is not None:
            yield row()
        if new:
            held, now = part, np.arange(len(STATES))
        for kind in kinds.tolist():
            now = _table(kind)[0][now]
    if held is not None:
        yield row()


def _chained(t: pa.Table) -> pa.Table:
    """(version, span, begins) of one version's spans."""
    t = t.sort_by("span")
    state, begins = t.column("start")[0].as_py(), []
    for table in t.column("table").to_pylist():
        begins.append(state)
        state = int(np.frombuffer(table, "<i2")[state])
    return t.select(["version", "span"]).append_column("begins", pa.array(begins, pa.int32()))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(version, at, event_id, event, before, after, error) by number, from rows (version, span, kind, at, event_id, event, start)."""
    state = 0
    for part, kinds, new in _runs(batches):
        if new:
            state = part.column(6)[0].as_py()
        before, after, error = [], [], []
        for kind in kinds.tolist():
            to, why = _table(kind)
            before.append(state)
            error.append(int(why[state]))
            state = int(to[state])
            after.append(state)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), part.column(5), *(pa.array(x, pa.int32()) for x in (before, after, error))], ["version", "at", "event_id", "event", "before", "after", "error"])


def apply_log(log: DataFrame, versions: DataFrame, most: int = MOST, span: int = SPAN) -> DataFrame:
    """(version, at, event_id, event, before, after, error) of each event.

    ``log``: version, at (timestamp), event_id, event, kind (``kind_of``). ``versions``: version, start (``state_code``), unique by version.
    """
    sizes = log.groupBy("version").count().where(F.col("count") > most).select("version", F.lit(True).alias("large"))
    named = log.join(versions.select("version", "start"), "version", "left").withColumn("start", F.coalesce("start", F.lit(CODE[NOTHING])))
    named = named.withColumn("span", F.lit(0).cast("long"))
    if not sizes.isEmpty():
        cut = named.join(sizes, "version", "left").withColumn("span", F.when(F.col("large"), F.coalesce(F.floor(F.unix_micros("at") / (span * 1_000_000)), F.lit(-(1 << 62)))).otherwise(0))
        done = cut.where("large").select("version", "span", "kind", "at", "event_id").repartition("version", "span").sortWithinPartitions("version", "span", "at", "event_id", "kind")
        v = log.schema["version"].dataType.simpleString()
        tables = done.mapInArrow(_spans, f"version {v}, span long, table binary").join(versions.select("version", "start"), "version", "left").withColumn("start", F.coalesce("start", F.lit(CODE[NOTHING])))
        begins = tables.groupBy("version").applyInArrow(_chained, f"version {v}, span long, begins int")
        named = cut.join(begins, ["version", "span"], "left").withColumn("start", F.coalesce("begins", "start"))
    rows = named.select("version", "span", "kind", "at", "event_id", "event", "start").repartition("version", "span").sortWithinPartitions("version", "span", "at", "event_id", "kind")
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    out = rows.mapInArrow(_folded, f"version {kinds['version']}, at {kinds['at']}, event_id {kinds['event_id']}, event {kinds['event']}, before int, after int, error int")
    return out.withColumn("error", F.element_at(F.array(*[F.lit(e).cast("string") for e in ERRORS]), F.col("error") + 1))


def named_state(code: Column) -> dict[str, Column]:
    """The columns of a state's number."""
    out, below = {}, 1
    for name, values in reversed(list(zip(State._fields, VALUES, strict=True))):
        out[name] = F.element_at(F.array(*map(F.lit, values)), (F.floor(code / below) % len(values) + 1).cast("int"))
        below *= len(values)
    return dict(reversed(out.items()))


def standing(applied: DataFrame) -> DataFrame:
    """(version, rag, review, ocr, step, fresh, job) after the last event of each version."""
    last = applied.groupBy("version").agg(F.max_by("after", F.struct("at", "event_id")).alias("after"))
    return last.select("version", *[c.alias(n) for n, c in named_state(F.col("after")).items()])
