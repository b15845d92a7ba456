"""Usage figures from an operation log, and figures of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest argument text in a log line.
ARGUMENT = 200


def since(oplog: DataFrame, ts: int) -> DataFrame:
    return oplog.where(F.col("ts") >= ts)


def _is(tool: str, error: bool | None = None) -> Column:
    found = F.col("tool") == tool
    return found if error is None else found & (F.col("is_error") == error)


def usage(oplog: DataFrame) -> DataFrame:
    """One row: sessions, recalls with errors and empty answers, remembers with errors, forgets that succeeded, related, latency percentiles (nearest rank)."""
    good = _is("recall", False)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE tool = 'recall' AND NOT is_error)")
    return oplog.agg(
        F.count_if(_is("session")).alias("sessions"), F.count_if(_is("recall")).alias("recalls"), F.count_if(_is("recall", True)).alias("recall_errors"),
        F.count_if(good & (F.size("ids") == 0)).alias("empty_recalls"), F.count_if(_is("remember")).alias("remembers"), F.count_if(_is("remember", True)).alias("remember_errors"),
        F.count_if(_is("forget", False)).alias("forgets"), F.count_if(_is("related")).alias("related"), rank(0.5).alias("p50_ms"), rank(0.99).alias("p99_ms"),
    )


def served(oplog: DataFrame) -> DataFrame:
    """id, served: how often successful recalls returned a memory."""
    return oplog.where(_is("recall", False)).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("served"))


def top_served(oplog: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    from ..functions.text import preview

    best = served(oplog).orderBy(F.desc("served"), "id").limit(k)
    shown = memories.where(~F.col("tombstone")).select("id", preview(F.col("content")).alias("shown"))
    return best.join(shown, "id", "left").select("id", "served", F.coalesce("shown", F.lit("(forgotten since)")).alias("preview"))


def never_recalled(oplog: DataFrame, memories: DataFrame) -> DataFrame:
    """Alive, not superseded memories that no successful recall returned."""
    return memories.where(~F.col("tombstone") & ~F.col("superseded")).join(served(oplog).select("id"), "id", "left_anti")


def store_counts(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count_if(~F.col("tombstone")).alias("live"), F.count_if("tombstone").alias("forgotten"))


def by_agent(memories: DataFrame) -> DataFrame:
    """agent, live memories (superseded ones count) and distinct sessions."""
    return memories.where(~F.col("tombstone")).groupBy("agent").agg(F.count("*").alias("live"), F.count_distinct("session_id").alias("sessions"))


def index_counts(chunks: DataFrame, memories: DataFrame, entity_tags: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts of vectors, documents, entities and relations."""
    one = [
        chunks.agg(F.count("*").alias("vectors")), memories.agg(F.count("*").alias("documents")),
        entity_tags.agg(F.count_distinct("entity").alias("entities")), relations.distinct().agg(F.count("*").alias("relations")),
    ]
    out = one[0]
    for more in one[1:]:
        out = out.crossJoin(more)  # one row each
    return out


def summarize(argument: Column) -> Column:
    from ..functions.text import cut_text

    return cut_text(argument, ARGUMENT)


def mismatched_lengths(memories: DataFrame, lengths: DataFrame) -> DataFrame:
    """Documents whose stored doc_len (id, doc_len) is missing or not that of their content."""
    from ..functions.text import doc_len

    real = memories.select("id", doc_len(F.col("content")).alias("real"))
    return real.join(lengths, "id", "left").where(~F.col("real").eqNullSafe(F.col("doc_len"))).select("id", "real", "doc_len")
