"""Working tables in the folder that all executors share, and sums over an order without a single task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmetric.session import new_work_path

SLICE_ROWS = 500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands its Python workers at most ``rows`` rows at a time; a smaller setting stays.

    By default 10,000 whole texts lie in the buffers of both the JVM and the worker, which grow by doubling and are kept.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def give_back() -> None:
    """Return freed memory of this Python worker to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Workspace:
    """A folder for tables that cut lineage; every executor reaches it, so a lost executor costs no recomputation.

    The folder lies below ``spark.checkpoint.dir``, or is ``root``. It goes when ``drop()`` is called; one below the setting
    goes at the latest when the driver's JVM ends, as results that are still lazy may read it until then.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.path = new_work_path(spark, "llm") if root is None else root.rstrip("/")
        self._count = 0

    def _hadoop_path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._hadoop_path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def new(self, label: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Write the rows and read them back."""
        path = self.new(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._fs().delete(self._hadoop_path(), True)


def running_within(parts: DataFrame, value: str, order: Sequence[str], name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows, given rows whose column ``part`` numbers ranges of the order.

    Each range is summed in one task; only the totals, one row per range, meet in one place.
    """
    totals = parts.groupBy("part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: as small as the number of partitions
    return (parts.join(F.broadcast(bases), "part")
            .withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
            .drop("_base", "part"))


def running(df: DataFrame, value: str, order: Sequence[str], name: str, work: Workspace) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before this one in the order. Ties take any order among themselves."""
    parts = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return running_within(work.table(parts, "ranges"), value, order, name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


BROADCAST_ROWS = 500_000


def small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table marked for broadcasting if it has at most ``rows`` rows; beyond that Spark joins it by shuffling."""
    return F.broadcast(written) if written.count() <= rows else written
