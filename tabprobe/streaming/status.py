"""Live run status: a Structured Streaming query over the result store.

The result directory only ever receives new JSON files (one per
(dataset, method) pair), so it is a natural file stream.  The status query
keeps, per status, the number of result rows and per (dataset, method) the
number of rows and failures -- what a progress line or a status command
reports -- updated as pairs finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import RESULT_SCHEMA


def result_stream(spark: SparkSession, out_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RESULT_SCHEMA) \
        .option("maxFilesPerTrigger", max_files_per_trigger).json(out_dir)


def status_counts(stream: DataFrame) -> DataFrame:
    """Rows per status (complete-mode aggregation)."""
    return stream.groupBy(F.coalesce("status", F.lit("?")).alias("status")) \
        .agg(F.count(F.lit(1)).alias("count"))


def pair_progress(stream: DataFrame) -> DataFrame:
    """Per (dataset, method): rows, failures, mean successful score."""
    ok = (F.col("status") == "ok")
    return stream.groupBy("key", "method").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((~ok | F.col("status").isNull()).cast("long")).alias("failures"),
        F.avg(F.when(ok, F.col("value"))).alias("mean_value"))


def start_status(spark: SparkSession, out_dir: str, checkpoint: str, name: str = "tabprobe_status"):
    """Start the status query into an in-memory table ``name`` (query it with
    ``spark.table(name)``); returns the StreamingQuery."""
    q = status_counts(result_stream(spark, out_dir)).writeStream.outputMode("complete") \
        .format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    return q
