"""Usage of the store from a growing operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.oplog import parse


def tail(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Operations of a folder of JSON lines as they arrive, with `at`, their time."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path)
    return parse(lines).withColumn("at", F.timestamp_micros("ts"))


def usage_by_window(ops: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Recalls, errors and mean latency by window; operations later than `late` are dropped."""
    recall = F.col("tool") == "recall"
    return ops.withWatermark("at", late).groupBy(F.window("at", width).alias("window")).agg(
        F.count("*").alias("operations"), F.count_if(recall).alias("recalls"), F.count_if(recall & F.col("is_error")).alias("errors"), F.avg(F.when(recall, F.col("latency_ms"))).alias("mean_ms")
    )
