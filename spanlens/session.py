"""Session helpers: one place for session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "spanlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one; cluster settings are never overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        # One JVM runs everything here, so its heap is set before it starts.
        builder = builder.master(master).config("spark.driver.memory", "12g")
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # Capturing the Python call site of every column call costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine only, a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="spanlens-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


UNFOLD = "spark.sql.sources.fileCompressionFactor"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder of the cluster and read again, so lost executors only re-read files.

    A folder that the context already has wins, else ``shared_folder`` names it. Columns are stored apart and compressed, unlike
    those of a checkpoint, and later steps read only the ones they use. The files go when the JVM ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Such files unfold many times over; by their bare size Spark would broadcast tables of any width.
    if spark.conf.get(UNFOLD) == "1.0":
        spark.conf.set(UNFOLD, "32.0")
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


TASKS_PER_CORE = 4


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Give compute-heavy row work at least one partition per core, all of about the same number of rows.

    The splits of a scan say nothing about its rows: those of a file lie in as few splits as it has row groups, so a large file
    is dealt anew too, into several partitions per core. Rows are placed by key hash, so a repeated task sees the same rows.
    There are ``least`` partitions at least, for rows of which much more is made in their task.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(least, cores if splits < cores else max(splits, TASKS_PER_CORE * cores)), *keys)
