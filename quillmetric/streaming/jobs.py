"""Streaming jobs: capture with de-duplication, running counts, late rows.

State lives in Spark's own operators. What a batch adds to a total is a row or two in a log in the shared folder, one folder per
batch, so that a repeated batch rewrites its own folder only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Capture windows and allowed lateness.
WINDOW, EVERY, LATENESS = "10 seconds", "8 seconds", "10 minutes"

#: Registers of a sketch are two to this power: 64 KiB a kind, a standard error of 0.4 %.
SKETCH_LG = 16


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(folder)


def captures(events: DataFrame, ts: str, length: str = WINDOW, every: str = EVERY) -> DataFrame:
    """One row per event and capture window it falls into; neighbouring windows overlap."""
    return events.withColumn("capture", F.window(ts, length, every))


def first_seen(stream: DataFrame, ts: str, key: str, lateness: str = LATENESS) -> DataFrame:
    """Each key once, as first captured; state is dropped after the allowed lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything that is there now to a parquet table."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _each_batch(stream: DataFrame, checkpoint: str, handle) -> None:
    query: StreamingQuery = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
                             .trigger(availableNow=True).start())
    query.awaitTermination()


def batch_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that batches have logged so far, with their number as ``batch``; none before the first batch."""
    full = f"{schema}, batch bigint"
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def _log(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def split_late(stream: DataFrame, ts: str, checkpoint: str, newest: str, on_time, late, lateness: str = LATENESS) -> None:
    """Send rows older than the newest earlier timestamp minus the lateness to ``late``, the rest to ``on_time``.

    Both handlers take (rows, batch number). The folder ``newest`` logs the newest timestamp of every batch.
    """
    def handle(batch: DataFrame, number: int) -> None:
        before = batch_log(batch.sparkSession, newest, "newest timestamp").filter(F.col("batch") < number)
        value = before.agg(F.max("newest").alias("newest")).first()["newest"]  # one timestamp
        is_late = F.lit(False) if value is None else F.coalesce(
            F.col(ts) < F.lit(value) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        late(batch.filter(is_late), number)
        on_time(batch.filter(~is_late), number)
        _log(batch.agg(F.max(ts).alias("newest")), newest, number)

    _each_batch(stream, checkpoint, handle)


def _ids(stream: DataFrame, ids: Mapping[str, Column]) -> DataFrame:
    """kind, id: one row per known id of every row."""
    pieces = [F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("id")) for kind, value in ids.items()]
    return stream.select(F.explode(F.array(*pieces)).alias("p")).select("p.kind", "p.id").filter("id IS NOT NULL")


def running_counts(stream: DataFrame, ids: Mapping[str, Column], checkpoint: str, out: str) -> None:
    """Exact number of distinct ids of each kind so far; nulls are no ids. State holds every id, spread over the state store's partitions.

    A stateful de-duplication lets every id through once; each batch logs how many new ids it brought. ``counts_so_far`` adds them up.
    """
    def handle(batch: DataFrame, number: int) -> None:
        _log(batch.groupBy("kind").agg(F.count(F.lit(1)).alias("added")), out, number)

    _each_batch(_ids(stream, ids).dropDuplicates(["kind", "id"]), checkpoint, handle)


def counts_so_far(spark: SparkSession, out: str) -> DataFrame:
    """kind, total of a log of running counts."""
    return batch_log(spark, out, "kind string, added bigint").groupBy("kind").agg(F.sum("added").alias("total"))


def sketched_counts(stream: DataFrame, ts: str, ids: Mapping[str, Column], every: str, lateness: str = LATENESS) -> DataFrame:
    """start, kind, sketch: a HyperLogLog sketch of the ids of each kind, per interval of ``every``; for ``stateful.log_changes``.

    For streams without an end. State is one sketch of a fixed size per kind and open interval, however many ids there are; an interval
    leaves it when the watermark has passed its end. Rows that come later still, or have no time, are dropped; nulls are no ids.
    """
    pieces = [F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("id")) for kind, value in ids.items()]
    known = (stream.withWatermark(ts, lateness).select(F.col(ts), F.explode(F.array(*pieces)).alias("p"))
             .select(ts, "p.kind", "p.id").filter("id IS NOT NULL"))
    return (known.groupBy(F.window(ts, every), "kind").agg(F.hll_sketch_agg("id", F.lit(SKETCH_LG)).alias("sketch"))
            .select(F.col("window.start").alias("start"), "kind", "sketch"))


def sketched_totals(sketches: DataFrame) -> DataFrame:
    """kind, total: about as many distinct ids as the sketches of each kind have seen together.

    Sketches of intervals, of days or of earlier batches of the same interval merge alike: what one saw twice counts once.
    """
    return sketches.groupBy("kind").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("total"))
