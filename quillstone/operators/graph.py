"""Relations, entities and versions of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Fixed limits of names in bytes, and the kind of edge that superseding draws.
ENTITY_BYTES, KIND_BYTES, SUPERSEDES = 128, 64, "supersedes"


def live(memories: DataFrame) -> DataFrame:
    """Not forgotten; superseded memories are still there."""
    return memories.where(~F.col("tombstone"))


def related(ids: DataFrame, relations: DataFrame, memories: DataFrame) -> DataFrame:
    """id, kind, outgoing, other: edges both ways to live neighbours of the ids asked for."""
    out = relations.select(F.col("src").alias("id"), "kind", F.lit(True).alias("outgoing"), F.col("dst").alias("other"))
    both = out.union(relations.select("dst", "kind", F.lit(False), "src")).distinct()
    alive = live(memories).select(F.col("id").alias("other"))
    return both.join(ids.select("id"), "id", "left_semi").join(alive, "other", "left_semi").select("id", "kind", "outgoing", "other")


def entity_members(entity_tags: DataFrame, memories: DataFrame) -> DataFrame:
    """entity, id of live memories."""
    return entity_tags.distinct().join(live(memories).select("id"), "id", "left_semi").select("entity", "id")


def entities_of(entity_tags: DataFrame) -> DataFrame:
    """id and its sorted tags."""
    return entity_tags.groupBy("id").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def checked_tags(tags: DataFrame) -> DataFrame:
    size = F.octet_length("entity")
    return tags.distinct().withColumn("entity", F.when(size.between(1, ENTITY_BYTES), F.col("entity")).otherwise(F.raise_error(F.lit(f"an entity takes 1 to {ENTITY_BYTES} bytes"))))


def checked_relations(edges: DataFrame) -> DataFrame:
    """Distinct edges; a wrong kind or an edge to itself is an error."""
    size = F.octet_length("kind")
    ok = size.between(1, KIND_BYTES) & (F.col("src") != F.col("dst"))
    return edges.distinct().withColumn("kind", F.when(ok, F.col("kind")).otherwise(F.raise_error(F.lit(f"a relation takes a kind of 1 to {KIND_BYTES} bytes and two memories"))))


def missing_targets(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges whose target is not a live memory."""
    return edges.join(live(memories).select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "kind", "dst")


def supersede(memories: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories with the old ones flagged, new edges) for pairs (new, old). Both have to be live and of one project, else it is an error."""
    ends = live(memories).select("id", "project")
    new = ends.select(F.col("id").alias("new"), F.col("project").alias("new_project"), F.lit(True).alias("has_new"))
    old = ends.select(F.col("id").alias("old"), F.col("project").alias("old_project"), F.lit(True).alias("has_old"))
    judged = pairs.distinct().join(new, "new", "left").join(old, "old", "left")
    ok = F.col("has_new") & F.col("has_old") & F.col("new_project").eqNullSafe(F.col("old_project"))
    checked = judged.withColumn("old", F.when(F.coalesce(ok, F.lit(False)), F.col("old")).otherwise(F.raise_error(F.lit("a memory is superseded by a live one of its own project"))))
    flagged = checked.select(F.col("old").alias("id"), F.lit(True).alias("_flag")).distinct()
    out = memories.join(flagged, "id", "left").withColumn("superseded", F.col("superseded") | F.coalesce("_flag", F.lit(False))).select(memories.columns)
    return out, checked.select(F.col("new").alias("src"), F.lit(SUPERSEDES).alias("kind"), F.col("old").alias("dst")).distinct()


def newest_versions(relations: DataFrame) -> DataFrame:
    """id, newest, steps: where each superseded memory's chain of versions ends, by pointer jumping: the rounds are the logarithm of the longest chain. A circle is an error."""
    edges = cut(relations.where(F.col("kind") == SUPERSEDES).select(F.col("dst").alias("id"), F.col("src").alias("newest"), F.lit(1).cast("long").alias("steps")).distinct())
    ends = edges.select(F.col("newest").alias("id")).distinct().join(edges.select("id"), "id", "left_anti").select(F.col("id").alias("newest"))
    most, now, done = edges.count(), edges, None
    while True:
        over = now.join(ends, "newest", "left_semi").select("id", "newest", "steps")
        done = over if done is None else cut(done.unionByName(over))
        open_ = now.join(ends, "newest", "left_anti")
        if not open_.limit(1).count():
            return done.withColumn("steps", F.col("steps").cast("int"))
        if now.agg(F.max("steps")).first()[0] > most:
            raise ValueError("versions run in a circle")
        up = done.unionByName(open_.select("id", "newest", "steps")).select(F.col("id").alias("newest"), F.col("newest").alias("above"), F.col("steps").alias("more"))
        now = cut(open_.join(up, "newest").select("id", F.col("above").alias("newest"), (F.col("steps") + F.col("more")).alias("steps")))


def vacuum(memories: DataFrame, relations: DataFrame, entity_tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories that are not forgotten (superseded ones stay), edges with both ends left, tags of what is left."""
    left = live(memories)
    ids = left.select("id")
    edges = relations.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return left, edges.select(relations.columns), entity_tags.join(ids, "id", "left_semi").select(entity_tags.columns)
