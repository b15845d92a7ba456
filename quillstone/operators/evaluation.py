"""Measures of search quality and of runs against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed thresholds: score slack of a tie; drop of recall, growth of latency (and its floor in ms), size and memory that fail a run.
TIE, RECALL_DROP, LATENCY, FLOOR_MS, SIZE, MEMORY = 1e-5, 0.01, 0.15, 8.0, 0.10, 0.15

#: Percentiles of a distribution of scores.
MARKS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def overlap(exact: DataFrame, returned: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of the exact top k (query_id, id) that was returned."""
    hit = exact.join(returned.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return exact.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def tie_aware(exact: DataFrame, returned: DataFrame, k: int) -> DataFrame:
    """query_id, recall: what was returned counts if it scores as high as the exact k-th (within TIE), k at most."""
    edge = exact.groupBy("query_id").agg(F.min("score").alias("edge"), F.count("*").alias("n"))
    good = returned.join(edge, "query_id").where(F.col("score") >= F.col("edge") - TIE).groupBy("query_id").agg(F.count("*").alias("hits"))
    return edge.join(good, "query_id", "left").select("query_id", (F.least(F.coalesce("hits", F.lit(0)), F.col("n")) / F.col("n")).alias("recall"))


def summary(recalls: DataFrame) -> DataFrame:
    """One row: mean, least, 10 % and 50 % (nearest rank) of recalls."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY recall)")
    return recalls.agg(F.round(F.avg("recall"), 6).alias("mean"), F.min("recall").alias("least"), rank(0.1).alias("p10"), rank(0.5).alias("p50"))


def thresholds(scores: DataFrame, steps: list[float], pairs: DataFrame | None = None) -> DataFrame:
    """threshold, share of scores that reach it. pairs: one row (n), of how many scores, where those below all steps are left out; else all are counted."""
    marks = scores.sparkSession.createDataFrame([(float(s),) for s in steps], "threshold double")
    counts = scores.agg(F.count("*").alias("given"), *[F.count_if(F.col("score") >= s).alias(f"s{i}") for i, s in enumerate(steps)])
    counts = counts.withColumnRenamed("given", "n") if pairs is None else counts.crossJoin(pairs.select("n"))  # one row each
    each = counts.select("n", F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in steps]).alias("threshold"), F.array(*[F.col(f"s{i}") for i in range(len(steps))]).alias("hits"))).alias("x"))
    return marks.join(each.select(F.col("x.threshold"), F.round(F.col("x.hits") / F.col("n"), 6).alias("share")), "threshold")


def distribution(scores: DataFrame, by: str) -> DataFrame:
    """A row for each value of `by`: how many scores, the least, the percentiles MARKS (nearest rank) and the most."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY score)").alias(f"p{round(100 * p)}")
    return scores.groupBy(by).agg(F.count("*").alias("scores"), F.min("score").alias("least"), *map(rank, MARKS), F.max("score").alias("most"))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """metric, change, failed for metrics (metric, value): recall may not fall, latency, size and memory may not grow beyond their thresholds."""
    both = baseline.withColumnRenamed("value", "was").join(current.withColumnRenamed("value", "now"), "metric")
    grown, m = F.col("now") / F.col("was") - 1, F.col("metric")
    failed = (
        F.when(m.startswith("recall"), F.col("was") - F.col("now") > RECALL_DROP)
        .when(m.endswith("_ms"), (grown > LATENCY) & (F.col("now") - F.col("was") > FLOOR_MS))
        .when(m.endswith("_bytes"), grown > SIZE)
        .when(m.endswith("_rss"), grown > MEMORY)
        .otherwise(False)
    )
    return both.select("metric", F.round(grown, 6).alias("change"), failed.alias("failed"))
