"""Sharding by sampled splitters.

Records are ordered by a hash of their text, so equal texts are neighbours. A bounded, size-weighted
sample of hashes gives quantile boundaries of many fine ranges; ranges that turn out overfull are
subdivided with a denser sample of their own. A text that alone outweighs a fine range becomes a heavy
group, subdivided by a hash of the id. The ranges' exact sizes then fill the shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, documents, unit

#: Fine ranges per run, and sampled keys per fine range: the driver holds about RANGES * PER_RANGE keys.
RANGES, PER_RANGE, ROUNDS = 4096, 16, 6


def _boundaries(keys: np.ndarray, weights: np.ndarray, parts: int) -> list[int]:
    """Up to parts - 1 keys that cut the sampled weight into equal parts."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    keys, run = keys[order], np.cumsum(weights[order])
    at = np.searchsorted(run, run[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)]).tolist()


def _range_of(bounds: list[int]):
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    return range_of


def _sample(rows: DataFrame, wanted: float, total: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with chances in proportion to weight, and what weight each stands for."""
    chance = F.least(F.lit(1.0), F.col("weight") * F.lit(wanted / total))
    drawn = rows.where(unit("key", "doc_id", seed=seed) < chance).select("key", (F.col("weight") / chance).alias("w")).toPandas()
    return drawn["key"].to_numpy(dtype=np.int64), drawn["w"].to_numpy(dtype=float)


def pack(light: list[tuple[int, int]], heavy: list[tuple[int, list[tuple[int, int]]]], shards: int) -> dict[int, int]:
    """Piece -> shard, by size. Heavy groups go whole to the emptiest shard where they fit, else piece by
    piece; the light ranges, in key order, then fill what is left of each shard's share."""
    total = sum(s for _, s in light) + sum(s for _, ps in heavy for _, s in ps)
    share, load, where = total / shards, [0] * shards, {}
    heap = [(0, i) for i in range(shards)]
    for _, pieces in sorted(heavy, key=lambda g: (-sum(s for _, s in g[1]), g[0])):
        size = sum(s for _, s in pieces)
        whole = heap[0][0] + size <= share
        for piece, s in [(None, size)] if whole else pieces:
            least, i = heapq.heappop(heap)
            heapq.heappush(heap, (least + s, i))
            load[i] += s
            for p in [p for p, _ in pieces] if piece is None else [piece]:
                where[p] = i
    i = 0
    for at, (piece, s) in enumerate(light):
        while i < shards - 1 and load[i] + s / 2 > share:
            i += 1
        where[piece] = i
        load[i] += s
    return where


def shard_by_size(docs: DataFrame, shards: int = 8, ranges: int = RANGES, per_range: int = PER_RANGE, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and piece for every row of docs (doc_id, text).

    Law `bytes`: shards get near equal sums of size (UTF-8 bytes plus 1; a null text counts as none and
    its crc32 is that of an empty text). Equal texts share a shard unless their group does not fit one.
    Null ids, repeated rows and ties are kept, each with a slot of its own; an empty table gives none.
    Other columns are not read.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("text", F.col("text").isNull()).alias("key"),
        )
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / max(n, 1)
    rows = rows.withColumn("weight", F.col("size") + F.lit(mean))
    limit = 2.0 * total / ranges  # weight that one fine range should hold

    groups = rows.groupBy("key").agg(F.sum("weight").alias("w")).where(F.col("w") > limit)
    heavy = {r.key: int(np.ceil(r.w / limit)) for r in groups.collect()}  # at most `ranges` of them
    heavy_keys = sorted(heavy)
    base = len(heavy_keys)
    first_piece = dict(zip(heavy_keys, np.cumsum([0, *(heavy[k] for k in heavy_keys)]).tolist(), strict=False))
    n_heavy = sum(heavy.values())
    heavy_df = spark.createDataFrame([(k, heavy[k], first_piece[k]) for k in heavy_keys], "key long, cuts int, first int")
    marked = rows.join(F.broadcast(heavy_df), "key", "left")  # at most `ranges` rows
    light_rows = marked.where(F.col("cuts").isNull()) if base else rows

    keys, weights = _sample(light_rows, ranges * per_range, max(2.0 * total, 1.0), seed)
    bounds = _boundaries(keys, weights, ranges)
    for again in range(1, ROUNDS):
        found = light_rows.select(_range_of(bounds)("key").alias("r"), "weight").groupBy("r").agg(F.sum("weight").alias("w")).where(F.col("w") > 2 * limit).collect()
        if not found:
            break
        over = {r.r: r.w for r in found}
        edges = [-(1 << 63), *bounds]
        inside = light_rows.withColumn("r", _range_of(bounds)("key")).where(F.col("r").isin(list(over)))
        keys, weights = _sample(inside, per_range * sum(over.values()) / limit * 4, sum(over.values()), seed + again)
        at, more = np.searchsorted(np.array(bounds, dtype=np.int64), keys, side="right"), []
        for r, w in over.items():
            more += [b for b in _boundaries(keys[at == r], weights[at == r], int(np.ceil(w / limit))) if b > edges[r]]
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})

    piece = F.when(F.col("cuts").isNotNull(), F.col("first") + F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("cuts").cast("long")).cast("int"))
    placed = cut(marked.withColumn("piece", F.coalesce(piece, _range_of(bounds)("key") + F.lit(n_heavy))).select("doc_id", "size", "text_crc32", "key", "piece"))
    sizes = {r.piece: (r.s, r.n) for r in placed.groupBy("piece").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}

    group = [(k, [(p, sizes[p][0]) for p in range(first_piece[k], first_piece[k] + heavy[k]) if p in sizes]) for k in heavy_keys]
    light = [(p, sizes[p][0]) for p in sorted(sizes) if p >= n_heavy]
    where = pack(light, group, shards)
    start, taken = {}, [0] * shards
    for p in sorted(where):
        start[p] = taken[where[p]]
        taken[where[p]] += sizes[p][1]
    table = spark.createDataFrame([(p, where[p], start[p]) for p in where], "piece int, shard int, first_slot long")
    within = F.row_number().over(W.partitionBy("piece").orderBy("key", "doc_id", "size", "text_crc32"))
    return placed.join(F.broadcast(table), "piece").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + within - 1).cast("long").alias("slot"), "piece"
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`."""
    out = shard_by_size(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
