"""Full-text and vector search over batches of queries, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scoring
from ..functions.text import clip_term, doc_len, raw_tokens, tokens
from .lineage import cut

#: Digits that scores are rounded to before they are ranked; query vectors sent to the executors at once; chunk rows they are multiplied with at once;
#: bytes up to which a table in few pieces is dealt out to all cores before its texts are read.
DIGITS, QUERIES_AT_ONCE, ROWS_AT_ONCE, SMALL = 6, 4096, 1024, 1 << 28
#: Distinct terms of a batch of queries that are sent to all executors; a batch of more is joined by a shuffle. Up to how many the scan of stored postings is given.
TERMS_SENT, TERMS_PUSHED = 1 << 19, 1000


@dataclass(frozen=True)
class TextIndex:
    """Stored postings (id, term, tf, doc_len), as term_rows gives them, and the documents and tokens that they stand for."""

    postings: DataFrame
    n_docs: int
    total_tokens: int


def spread(texts: DataFrame) -> DataFrame:
    """A small table over all cores, as its files may hold a single row group; a larger one as it is, without a shuffle."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return texts.repartition(texts.sparkSession.sparkContext.defaultParallelism) if size < SMALL else texts


def term_rows(memories: DataFrame) -> DataFrame:
    """id, term, tf, doc_len of every document, dead ones included."""
    toks = spread(memories.select("id", "content")).select("id", raw_tokens(F.col("content")).alias("toks"))
    rows = toks.select("id", F.size("toks").alias("doc_len"), F.explode("toks").alias("term"))
    return rows.groupBy("id", "doc_len", clip_term(F.lower("term")).alias("term")).agg(F.count("*").alias("tf"))


def corpus_stats(memories: DataFrame) -> DataFrame:
    """One row: documents and tokens, dead documents included until they are vacuumed."""
    size = doc_len(F.col("content"))
    return spread(memories.select("content")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).alias("total_tokens"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: distinct terms of each query (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("term", clip_term(F.col("term"))).distinct()


def _found_in_texts(memories: DataFrame, terms: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (id, doc_len, term, tf) of the terms in all documents and in kept ones, from the texts."""
    toks = spread(memories.select("id", keep.alias("kept"), "content")).select("id", "kept", raw_tokens(F.col("content")).alias("toks"))
    rows = toks.select("id", "kept", F.size("toks").alias("doc_len"), F.explode("toks").alias("term")).withColumn("term", clip_term(F.lower("term")))
    met = rows.join(_sent(terms), "term", "left_semi")
    tf = met.groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"), F.bool_or("kept").alias("kept"))  # kept is no key, so that both uses of tf are one plan
    return tf, tf.where("kept")


def _found_in_index(memories: DataFrame, terms: DataFrame, keep: Column, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from stored postings. Few terms go to the scan, which skips what lies outside them."""
    few = [r.term for r in terms.limit(TERMS_PUSHED + 1).collect()]
    tf = postings.where(F.col("term").isin(few)) if len(few) <= TERMS_PUSHED else postings.join(_sent(terms), "term", "left_semi")
    return tf, tf.join(memories.where(keep).select("id"), "id", "left_semi")


def _sent(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.limit(TERMS_SENT + 1).count() <= TERMS_SENT else terms


def bm25_scores(memories: DataFrame, queries: DataFrame, keep: Column, index: TextIndex | None = None) -> DataFrame:
    """query_id, id, score > 0 of kept documents, from the index if one is given. Statistics cover all documents; only rows of asked terms are shuffled."""
    asked = query_terms(queries)
    terms = asked.select("term").distinct()
    if index is None:
        (tf, kept), stats = _found_in_texts(memories, terms, keep), corpus_stats(memories)
    else:
        tf, kept = _found_in_index(memories, terms, keep, index.postings)
        stats = memories.sparkSession.range(1).select(F.lit(index.n_docs).alias("n_docs"), F.lit(index.total_tokens).alias("total_tokens"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = kept.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # stats is one row
    gain = scoring.bm25(scoring.idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("doc_len"), F.col("total_tokens") / F.col("n_docs"))
    return scored.groupBy("query_id", "id").agg(F.round(F.sum(gain), DIGITS).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (score, smaller id) with their 0-based rank."""
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", best - 1).where(F.col("rank") < k)


def bm25_top_k(memories: DataFrame, queries: DataFrame, k: int, keep: Column, index: TextIndex | None = None) -> DataFrame:
    return top_k(bm25_scores(memories, queries, keep, index), k)


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    m = m.reshape(len(rows), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m.copy(), where=norm > 0)


def similarities(chunks: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, groups: bool = False, not_self: bool = False) -> DataFrame:
    """query_id, id, score: best cosine of each record's chunks (id, vec), exact.

    Queries (query_id, vec) are sent in blocks of bounded size; each batch of chunks is multiplied with a
    block and hands on its best k records a query, or those of at least `least`. groups: only pairs of equal `grp` (nulls are
    equal); not_self: not the query's own record.
    """
    spark = chunks.sparkSession
    cols = ["query_id", "vec", *(["grp"] if groups else [])]
    schema = f"query_id long, id {dict(chunks.dtypes)['id']}, score double"
    total = queries.count()
    blocks = max(1, -(-total // QUERIES_AT_ONCE) * 2 if total > QUERIES_AT_ONCE else 1)
    dealt = queries.select(*cols, F.pmod(F.xxhash64(*cols[:2]), F.lit(blocks)).alias("block"))
    if blocks > 1:  # each block reads both anew
        dealt, chunks = cut(dealt), cut(chunks.select("id", "vec", *(["grp"] if groups else [])))
    out = None
    for b in range(blocks):
        got = dealt.where(F.col("block") == b).toArrow().to_pylist()
        if not got:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in got]), _unit([r["vec"] for r in got]), [r.get("grp") for r in got]))
        part = chunks.select("id", "vec", *(["grp"] if groups else [])).mapInArrow(_compare(sent, k, least, groups, not_self), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("query_id", "id").agg(F.round(F.max("score"), DIGITS).alias("score"))


def _compare(sent, k, least, groups, not_self):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, wanted = sent.value
        floor = np.full((len(query_ids), 1), -np.inf)
        for batch in (x.slice(at, ROWS_AT_ONCE) for x in batches for at in range(0, x.num_rows, ROWS_AT_ONCE)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")  # chunks of one record beside each other
            ids = ids[order]
            sims = vectors @ _unit(batch.column(1).to_pylist())[order].T
            ok = np.ones(sims.shape if groups or not_self or least is not None else (1, 1), dtype=bool)
            if groups:
                has = batch.column(2).to_pylist()
                codes = {g: i for i, g in enumerate({*has, *wanted})}
                ok &= np.array([codes[g] for g in wanted])[:, None] == np.array([codes[g] for g in has])[order]
            if not_self:
                ok &= query_ids[:, None] != ids
            if least is not None:
                ok &= sims >= least - 1e-9
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            records = ids[first]
            best = np.round(np.maximum.reduceat(sims if ok.size == 1 else np.where(ok, sims, -np.inf), first, axis=1), DIGITS)
            if k is not None:  # of each query the k best of any batch so far, and ties with the last of them
                if len(records) >= k:
                    floor = np.maximum(floor, np.partition(best, len(records) - k, axis=1)[:, [len(records) - k]])
                best[best < floor] = -np.inf
            q, r = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_pydict({"query_id": query_ids[q], "id": pa.array(records[r], batch.schema.field(0).type), "score": best[q, r]})

    return compare


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int, **how) -> DataFrame:
    return top_k(similarities(chunks, queries, k=k, **how), k)


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """query_id, id, score, rank: reciprocal rank fusion of lists (query_id, id, rank), an id counting once a list; ties by first list, then rank."""
    entries = None
    for i, one in enumerate(lists):
        own = one.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).withColumn("list", F.lit(i))
        entries = own if entries is None else entries.unionByName(own)
    fused = entries.groupBy("query_id", "id").agg(F.round(F.sum(scoring.rrf(F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank", "id"))
    return fused.withColumn("rank", order - 1).where(F.col("rank") < k).select("query_id", "id", "score", "rank")


def recency_list(lists: list[DataFrame], memories: DataFrame) -> DataFrame:
    """The union of the lists ranked by creation, latest first, then smaller id. It adds no id."""
    ids = None
    for one in lists:
        ids = one.select("query_id", "id") if ids is None else ids.union(one.select("query_id", "id"))
    dated = ids.distinct().join(memories.select("id", "created_us"), "id")
    return dated.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("created_us"), "id")) - 1).select("query_id", "id", "rank")


def lift(memories: DataFrame, chunks: DataFrame, cases: DataFrame, k: int, keep: Column) -> DataFrame:
    """One row: of cases (query_id, the id that should be found; text; vec) how many hybrid search and vector search alone find among k, and the difference of their shares.
    Each distinct text and each distinct vector is searched for once, and all cases that have it get its hits."""
    cases, kept = cut(cases), chunks.join(memories.where(keep).select("id"), "id", "left_semi")
    vectors, texts = _of_each(cases, "vec", lambda asked: vector_top_k(kept, asked, k)), _of_each(cases, "text", lambda asked: bm25_top_k(memories, asked, k, keep))
    found = lambda hits: hits.where("id = query_id").select("query_id").distinct()
    both, alone = found(fuse([vectors, texts], k)).withColumn("h", F.lit(1)), found(vectors).withColumn("v", F.lit(1))
    counts = cases.select("query_id").join(both, "query_id", "left").join(alone, "query_id", "left").agg(F.count("*").alias("asked"), F.count("h").alias("hybrid_found"), F.count("v").alias("vector_found"))
    return counts.withColumn("lift", F.round((F.col("hybrid_found") - F.col("vector_found")) / F.col("asked"), 6))


def _of_each(cases: DataFrame, asked: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, id, rank of a search whose hits depend on the column alone, run for one case of each of its values."""
    first = cut(cases.groupBy(asked).agg(F.min("query_id").alias("query_id")))
    hits = cut(search(first).select(F.col("query_id").alias("first"), "id", "rank"))
    return cases.join(first.withColumnRenamed("query_id", "first"), asked).join(hits, "first").select("query_id", "id", "rank")


def rarest_terms(memories: DataFrame) -> DataFrame:
    """query_id, text: the term of each document that fewest documents hold, the first of equals."""
    rows = term_rows(memories).select("id", "term")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    return rows.join(df, "term").groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("df", "term"))["term"].alias("text"))


def hybrid_recall(memories: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, keep: Column, recency: bool = False, index: TextIndex | None = None) -> DataFrame:
    """query_id, id, score, rank: full-text and vector halves, each cut to k, fused and cut to k. queries: (query_id, text, vec)."""
    text = bm25_top_k(memories, queries, k, keep, index)
    kept = chunks.join(memories.where(keep).select("id"), "id", "left_semi")
    vectors = vector_top_k(kept, queries, k)
    lists = [vectors.select("query_id", "id", "rank"), text.select("query_id", "id", "rank")]
    return fuse([*lists, recency_list(lists, memories)] if recency else lists, k)


def vector_recall(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The vector half alone, with fused scores. chunks: those of kept memories."""
    return fuse([vector_top_k(chunks, queries, k).select("query_id", "id", "rank")], k)


def expand_related(hits: DataFrame, memories: DataFrame, relations: DataFrame, keep: Column) -> DataFrame:
    """hits with kept neighbours that were not hit appended: query_id, section (hit, related), ordinal, id, score (0 for neighbours)."""
    out = relations.select(F.col("src").alias("at"), F.lit(0).alias("incoming"), "kind", F.col("dst").alias("id"))
    both = out.union(relations.select("dst", F.lit(1), "kind", "src")).distinct()
    near = hits.select("query_id", F.col("id").alias("at"), "rank").join(both, "at").groupBy("query_id", "id").agg(F.min(F.struct("rank", "incoming", "kind", "id")).alias("via"))
    new = near.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(memories.where(keep).select("id"), "id", "left_semi")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("via")) - 1
    return hits.select("query_id", F.lit("hit").alias("section"), F.col("rank").alias("ordinal"), "id", "score").unionByName(
        new.select("query_id", F.lit("related").alias("section"), order.alias("ordinal"), "id", F.lit(0.0).alias("score"))
    )


def near_duplicates(drafts: DataFrame, chunks: DataFrame, memories: DataFrame, least: float = 0.80, k: int = 5) -> DataFrame:
    """query_id, id, score, rank, snippet: alive records of exactly the same project whose best chunk is at least `least` similar to a draft."""
    from ..functions.text import snippet
    from .filters import alive

    store = chunks.join(memories.where(alive()).select("id", F.col("project").alias("grp")), "id")
    found = top_k(similarities(store, drafts, k=k, least=least, groups=True, not_self=True), k)
    return found.join(memories.select("id", snippet(F.col("content")).alias("snippet")), "id").select("query_id", "id", "score", "rank", "snippet")
