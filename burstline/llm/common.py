"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import shared_dir, written

__all__ = ["dropped", "partitions", "released", "session", "shared_dir", "table", "texts", "trim", "trimmed", "written"]

#: Rows in an Arrow batch: long texts make 10,000 rows too much for one Python worker.
BATCH_ROWS = 512


def session(spark: SparkSession) -> SparkSession:
    """Bounds what one Arrow batch can hold before a Python operator runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) with a null text read as the empty text; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished plans; the job before it makes the scheduler forget the last one."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more, and shuffle files with them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    released(tables[0].sparkSession)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def trim() -> None:
    """Gives memory that the allocators of this process hold without need back to the system, as far as they can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of Arrow batches, and trim() after its last one: workers stay beside the next stage's tasks."""

    def own(batches):
        yield from run(batches)
        trim()

    return own
