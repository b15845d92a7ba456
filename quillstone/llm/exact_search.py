"""Exact top-k by term-at-a-time accumulation.

A vector is a sparse row: component -> integer weight. Queries go to the executors in blocks of bounded
size. Against each block of candidates, a component's postings (candidate, weight) times the queries'
weights for that component are added into a dense score array, component after component; the k
largest of each query are then picked by partitioning and merged over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, per_task

#: Queries sent at once and candidates scored at once: a broadcast holds at most QUERY_BYTES.
QUERY_BYTES, CANDIDATES, TILE = 16 << 20, 8192, 128
PARTIAL = "row long, query_id long, vec_id long, score long"


def weights(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and terms, floor(scale * x) of each component as double. Vectors null, or holding null or non-finite components, are left out."""
    sound = F.col("embedding").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )
    return vectors.where(sound).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("terms"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of weights, short ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _room(queries: np.ndarray, rows: np.ndarray) -> type:
    """The smallest integer type that holds every sum on the way to a score; Python's integers where none does."""
    if not queries.size or not rows.size:
        return np.int64
    norm = lambda m: float(np.sqrt((m.astype(float) ** 2).sum(axis=1).max()))
    bound = norm(queries) * norm(rows) * 1.001 + 1
    return next((t for t in (np.int16, np.int32, np.int64) if bound < np.iinfo(t).max), object)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, accumulated term by term over the rows' postings."""
    dims, kind = min(queries.shape[1], rows.shape[1]), _room(queries, rows)
    q, w = queries[:, :dims].T.astype(kind), np.ascontiguousarray(rows[:, :dims].T.astype(kind))
    total = np.zeros((queries.shape[0], rows.shape[0]), dtype=kind)
    product = np.empty_like(total)
    for d in range(dims):
        holders = np.flatnonzero(w[d])
        if 4 * len(holders) < 3 * w.shape[1]:  # a short list is scattered; a full one is added as it lies
            asking = np.flatnonzero(q[d])
            total[np.ix_(asking, holders)] += q[d][asking, None] * w[d][holders]
        else:
            np.multiply(q[d][:, None], w[d], out=product)
            total += product
    return total if kind is object else total.astype(np.int64)


def _best(total: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the positions of its k best candidates (all but its own), ties to smaller ids. ids ascend."""
    out, low = [], np.iinfo(np.int64).min
    for line, me in zip(total, own, strict=True):
        if line.dtype == object:
            keep = [i for i in np.argsort(-line, kind="stable") if ids[i] != me][:k]
            out.append(np.array(keep, dtype=np.int64))
            continue
        left, right = np.searchsorted(ids, me, "left"), np.searchsorted(ids, me, "right")
        line[left:right] = low
        n = len(line) - (right - left)
        if n > k:
            least = np.partition(line, len(line) - k)[len(line) - k]
            above, at = np.flatnonzero(line > least), np.flatnonzero(line == least)
            out.append(np.concatenate([above, at[: k - len(above)]]))
        else:
            out.append(np.concatenate([np.arange(left), np.arange(right, len(line))]))
    return out


def _search(found, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, query_id, queries = found.value
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by("vec_id")
            ids, rows = table["vec_id"].to_numpy(), _matrix(table["terms"])
            for at in range(0, len(row), TILE):
                tile = slice(at, at + TILE)
                total = scores(queries[tile], rows)
                best = _best(total, ids, query_id[tile], k)
                sizes = [len(b) for b in best]
                flat = np.concatenate(best) if best else np.zeros(0, np.int64)
                lines = np.repeat(np.arange(len(best)), sizes)
                got = total[lines, flat]
                if got.dtype == object:
                    got = np.array([max(min(int(x), (1 << 63) - 1), -(1 << 63)) for x in got], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"row": np.repeat(row[tile], sizes), "query_id": np.repeat(query_id[tile], sizes), "vec_id": ids[flat], "score": got})

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CANDIDATES:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest inner products over candidates of another id.

    Both sides are (vec_id, terms). A short row counts as filled with zeros; repeated rows are candidates
    each, and a repeated query is answered each time; ids that are null take no part; empty sides give no rows. Scores
    beyond 64 bits are held at the ends of that range.
    """
    spark = candidates.sparkSession
    queries, candidates = queries.where("vec_id is not null"), candidates.where("vec_id is not null")
    numbered = cut(queries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "terms"))
    n, widest = numbered.agg(F.count("*"), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    in_block = max(1, QUERY_BYTES // (8 * max(widest, 1)))
    blocks = max(1, -(-n // in_block)) + (n > in_block)
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    total = candidates.count()
    width = max(2 * per_task(spark), total // CANDIDATES + 1)
    dealt = candidates.select("vec_id", "terms").coalesce(width)
    merged = None
    for b in range(blocks):
        block = numbered.where(F.col("block") == b).toArrow() if blocks > 1 else numbered.toArrow()
        found = spark.sparkContext.broadcast((block["row"].to_numpy(), block["vec_id"].to_numpy(), _matrix(block["terms"])))
        part = dealt.mapInArrow(_search(found, k), PARTIAL)
        best = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        part = part.withColumn("rank", best).where(F.col("rank") <= k)
        part = cut(part) if blocks > 1 else part
        merged = part if merged is None else merged.unionByName(part)
    return merged.select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every vector whose id is divisible by 20."""
    rows = weights(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where("vec_id % 20 = 0"), rows, 20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.t AS DOUBLE[]), CAST(c.t AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
