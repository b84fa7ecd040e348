"""Incremental scoring of a growing prediction log.

New files are picked up once. Each micro-batch keeps one row per id, drops ids stored by earlier
batches, and writes the rest under its own batch folder. A batch that runs again after a failure writes
the same folder again, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlens.operators import metrics

PREDICTION_SCHEMA = "id string, prediction string, reference string, task_name string, route string"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all finished batches, or nothing before the first one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _append_batch(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col("id").isNotNull() & F.col("prediction").isNotNull()).dropDuplicates(["id"])
        earlier = stored(spark, path)
        if earlier is not None:
            # The folder of this batch may exist from an attempt that failed; it must not hide its own rows.
            # The ids of all batches grow without bound while their files look small, so they are never broadcast.
            rows = rows.join(earlier.filter(F.col("batch") < batch_id).select("id").hint("merge"), "id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def score_stream(
    spark: SparkSession, source: str, path: str, checkpoint: str, schema: str = PREDICTION_SCHEMA, files_per_batch: int = 1000
) -> StreamingQuery:
    """Process all files that are there now and stop; run it again for new files."""
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return (
        lines.writeStream.foreachBatch(_append_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_report(spark: SparkSession, path: str) -> DataFrame:
    """Answer metrics over everything stored so far."""
    return metrics.answer_report(metrics.with_token_f1(spark.read.parquet(path).drop("batch")))
