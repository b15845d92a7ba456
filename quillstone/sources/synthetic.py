"""Seeded corpora for benchmarks and calibration, made row by row from spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECTS = ["atlas", "billing", "gateway", "search", "website"]
SUBJECTS = ["the deploy script", "the retry queue", "our cache layer", "the login page", "the nightly export", "the schema migration", "the metrics job", "the mobile build"]
ACTIONS = ["fails when", "was moved after", "depends on", "must run before", "is slower than", "was replaced by", "needs a flag for", "waits for"]
OBJECTS = ["the feature freeze", "a second worker", "the staging database", "an expired token", "the weekly backup", "a larger index", "the review meeting", "a clean checkout"]


def _pick(options: list[str], seed: int, *keys: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(len(options))) + 1).cast("int"))


def _sentence(seed: int, *keys: Column | str) -> Column:
    return F.concat_ws(" ", _pick(SUBJECTS, seed, *keys), _pick(ACTIONS, seed + 1, *keys), _pick(OBJECTS, seed + 2, *keys))


def corpus(spark: SparkSession, seed: int, count: int) -> DataFrame:
    """id, content of one to three sentences, project; uniform."""
    n = F.pmod(F.xxhash64(F.lit(seed + 9), "id"), F.lit(3)) + 1
    content = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.concat(_sentence(seed, F.col("id"), i), F.lit("."))), " ")
    return spark.range(count).select("id", content.alias("content"), _pick(PROJECTS, seed + 5, "id").alias("project"))


def session_corpus(spark: SparkSession, seed: int, count: int, session: int = 20) -> DataFrame:
    """Like corpus(), but neighbours share a session's project and subject; projects are of unequal size."""
    s = F.floor(F.col("id") / session)
    u = F.pmod(F.xxhash64(F.lit(seed), s), F.lit(1000)) / 1000
    project = F.element_at(F.array(*map(F.lit, PROJECTS)), F.least(F.lit(len(PROJECTS)), F.ceil(1 / (u + 0.2)).cast("int")))
    content = F.concat_ws(" ", _pick(SUBJECTS, seed, s), _pick(ACTIONS, seed + 1, "id"), _pick(OBJECTS, seed + 2, "id"))
    return spark.range(count).select("id", content.alias("content"), project.alias("project"), s.alias("session"))


def duplicate_pairs(spark: SparkSession, seed: int, count: int) -> DataFrame:
    """id, original, duplicate, kind: a paraphrase (another order of the parts), or a noisy copy (one word left out)."""
    subject, action, thing = _pick(SUBJECTS, seed, "id"), _pick(ACTIONS, seed + 1, "id"), _pick(OBJECTS, seed + 2, "id")
    original = F.concat_ws(" ", subject, action, thing)
    words = F.split(original, " ")
    drop = F.pmod(F.xxhash64(F.lit(seed + 3), "id"), F.size(words))
    noisy = F.array_join(F.filter(words, lambda w, i: i != drop), " ")
    even = F.col("id") % 2 == 0
    return spark.range(count).select(
        "id", original.alias("original"), F.when(even, F.concat_ws(" ", thing, F.lit("and"), subject)).otherwise(noisy).alias("duplicate"), F.when(even, "paraphrase").otherwise("noisy copy").alias("kind")
    )


def lexical_cases(spark: SparkSession, seed: int, count: int) -> DataFrame:
    """id, literal, content, project: memories that only their literal (an identifier, a flag, an error, a hash) finds."""
    h = F.hex(F.xxhash64(F.lit(seed), "id"))
    kind = F.col("id") % 4
    literal = F.when(kind == 0, F.concat(F.lit("fn_"), F.lower(h))).when(kind == 1, F.concat(F.lit("--opt"), F.lower(h))).when(kind == 2, F.concat(F.lit("E"), h)).otherwise(F.lower(F.substring(h, 1, 12)))
    return spark.range(count).select("id", literal.alias("literal"), F.concat_ws(" ", _sentence(seed + 20, "id"), F.lit("see"), literal).alias("content"), _pick(PROJECTS, seed + 5, "id").alias("project"))
