"""The operation log: JSON lines, appended by writers and read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "ts BIGINT, tool STRING, args STRING, ids ARRAY<STRING>, scores ARRAY<DOUBLE>, latency_ms DOUBLE, project STRING, isError BOOLEAN, error STRING"


def _parsed(line: Column) -> Column:
    return F.from_json(line, FIELDS + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def parse(lines: DataFrame, since: int = 0) -> DataFrame:
    """Operations of text lines (value). Lines that are no JSON, empty ones among them, and operations before `since` are left out."""
    ops = lines.withColumn("op", _parsed(F.col("value"))).where(F.col("op._bad").isNull() & (F.length(F.trim("value")) > 0)).select("op.*").drop("_bad")
    ops = ops.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))).withColumn("is_error", F.coalesce("isError", F.lit(False))).drop("isError")
    return ops.where(F.col("ts") >= since) if since else ops


def skipped(lines: DataFrame) -> DataFrame:
    """One row: how many lines are no JSON (empty lines are not counted)."""
    op = _parsed(F.col("value"))
    return lines.agg(F.count_if((F.length(F.trim("value")) > 0) & op["_bad"].isNotNull()).alias("skipped_lines"))


def read(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    return parse(spark.read.text(path), since)


def append(ops: DataFrame, path: str) -> None:
    """Add operations (the columns of FIELDS, or some of them) to the log."""
    ops.write.mode("append").json(path)
