"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, with its file system spelled out; on a single machine without that setting, a temporary one.

    What is written there stays as long as the folder above it, which belongs to the job.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, so that what reads it twice computes it once."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task gets of what ``dealt`` deals out.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by its keys into parts of about PART_ROWS, of its own rows or of the ``rows`` that come of it: a task's memory stays as it is while the table grows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df.count() if rows is None else rows) // PART_ROWS)), *keys)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their place in the whole order from 0: written once by ranges of the order, so no task sees all rows; the window sees one row for each range."""
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    before = ranged.groupBy(part.alias("_part")).count().selectExpr("_part", "coalesce(sum(count) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    return ranged.join(F.broadcast(before), part == F.col("_part")).withColumn("at", F.expr("_before + (at & 8589934591)")).drop("_part", "_before")
