"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "quillmetric", master: str | None = None,
                  shuffle_partitions: int | None = None, **confs: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in confs.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the session names, else (local mode only) a temporary one."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    configured = tempfile.mkdtemp(prefix="quillmetric-")
    spark.conf.set(CHECKPOINT_CONF, configured)
    return configured


def new_work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, as lazy results may read it until then."""
    folder = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)  # only what exists can be marked
    return f"{folder}/data"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that costs more than reading: a small file is read by one task or a few."""
    session = df.sparkSession
    tasks = max(session.sparkContext.defaultParallelism * 2, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows once written and read again, where they would be computed once more, as a sort does to find its ranges."""
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
