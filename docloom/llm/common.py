"""Shared pieces of the corpus operators: inputs, shared folder, text batches, hashes.

Conventions that hold for every operator here unless its docstring says otherwise:

* only the named columns of an input are used; any further column, whatever its name, is ignored;
* a null text counts as the empty text; a row without a ``doc_id`` is left out, as no result can name it;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as '' and rows without an id left out."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with its file system spelled out; own if unset on a single machine.

    What operators write there (tables that cut lineage, token shards) must outlive the frames that read it, so nothing
    is removed here: the folder belongs to the job, and goes with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")  # one machine alone, as in tests
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so later stages never compute it twice."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitted(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], Any], most_bytes: int, most_document: int = 1 << 20) -> Any:
    """``fit(texts, labels)`` of a bounded sample (doc_id, text, label), run in one task; only its result comes to the driver.

    Documents over ``most_document`` bytes are not trained on, and in hash order of doc_id so many of the others are
    taken as ``most_bytes`` hold. A doc_id with several texts gives its largest.
    """
    rows = rows.where(F.octet_length("text") <= most_document).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    rows = rows.selectExpr("doc_id", "text", "cast(label as int) as label", "sum(octet_length(text)) over (order by xxhash64(doc_id), doc_id rows unbounded preceding) as upto")
    rows = rows.where(F.col("upto") <= most_bytes).select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("label", pa.int32())])).sort_by("doc_id")
        model = fit([x.encode() for x in t.column("text").to_pylist()], t.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit([], np.zeros(0, np.int32))


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of about ``most`` bytes from (doc_id, text, ...) batches; a longer text makes a chunk alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        col = batch.column(1)
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield ids[at:to], raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
_BASE, _POWERS = 0xD6E8FEB86659FD93, {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if _POWERS.get("n", 0) < n:
        size = max(1 << 20, n)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[i] the polynomial hash sum of the first i bytes; see ``range_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal bytes, equal hash."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64) * MULTIPLIER)


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space after each, and where each begins."""
    n = len(offs) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    for k in range(n):
        out[offs[k] + k : offs[k + 1] + k] = data[offs[k] : offs[k + 1]]
    return out, offs + np.arange(n + 1)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words between the bytes where ``separator`` (of 256 flags) holds: (hashes, first word of each text + the count, starts in the spaced bytes)."""
    text, begins = spaced(ascii_lower(data), offs)
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~separator[text]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return range_hash(prefix_hash(text), start, end), np.searchsorted(start, begins), start


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True


def rolled(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + w[i : i + n]
    return mix(h + np.uint64(k))


def binary_rows(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    parts = [np.ascontiguousarray(p) for p in parts]
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([p.nbytes for p in parts], out=offs[1:])
    body = b"".join(p.tobytes() for p in parts)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offs), pa.py_buffer(body)])


def view(column: pa.Array, dtype: str) -> Iterator[np.ndarray]:
    """The rows of a binary column as arrays."""
    for x in column:
        yield np.frombuffer(x.as_buffer() or b"", dtype=dtype)
