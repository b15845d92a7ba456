"""Memories, vectors, relations, entity tags and an operation log read from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import I64, SCALAR, STR

START_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory a document: project is the language (none for every 11th), agent the source."""
    i = F.col("doc_id")
    none = F.lit(None)
    meta = F.create_map(
        F.lit("n_chars"), F.struct(F.lit(I64), none, F.col("n_chars"), none, none).cast(SCALAR),
        F.lit("source"), F.struct(F.lit(STR), none, none, none, F.col("source")).cast(SCALAR),
    )
    dead = i % 17 == 0
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("text").alias("content"), F.when(i % 11 != 0, F.col("lang")).alias("project"), F.col("source").alias("agent"),
        F.lit(None).cast("string").alias("session_id"), (F.lit(START_US) + i * 60_000_000).alias("created_us"), dead.alias("tombstone"), ((i % 23 == 0) & ~dead).alias("superseded"),
        meta.alias("metadata"),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory a turn of a conversation."""
    i = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        i.alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("project"), F.col("role").alias("agent"), F.col("conv_id").cast("string").alias("session_id"),
        (F.lit(START_US) + i * 1_000_000).alias("created_us"), (i % 17 == 0).alias("tombstone"), F.lit(False).alias("superseded"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors a record."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 5).cast("long").alias("id"), (v % 5).cast("int").alias("chunk_no"), F.col("embedding").alias("vec"), F.col("label"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superseding edges of documents and `follows` edges between the documents of a source."""
    docs = memories(spark, sf_dir)
    newer = docs.where("superseded").select((F.col("id") + 1).alias("src"), F.lit("supersedes").alias("kind"), F.col("id").alias("dst"))
    follows = docs.where("id % 3 = 0").select("id", F.lit("follows"), (F.col("id") + 7).alias("dst"))
    ids = docs.select("id")
    both = newer.union(follows)
    return both.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "kind", "dst")


def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    quality = marks.select(F.concat(F.lit("quality:"), F.col("quality")).alias("entity"), F.col("doc_id").alias("id"))
    return quality.union(marks.select(F.concat(F.lit("toxic:"), F.col("toxic")).alias("entity"), F.col("doc_id").alias("id")))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: ts, tool, ids, latency_ms, is_error."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    tools = {"signup": "session", "view": "recall", "error": "recall", "purchase": "remember", "click": "related"}
    tool = F.coalesce(*[F.when(kind == a, F.lit(b)) for a, b in tools.items()])
    return table(spark, sf_dir, "events").select(
        F.unix_micros("ts").alias("ts") if dict(table(spark, sf_dir, "events").dtypes)["ts"] == "timestamp" else F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        tool.alias("tool"), F.when(k % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k)).alias("ids"), F.col("value").alias("latency_ms"), (kind == "error").alias("is_error"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, whole, as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
