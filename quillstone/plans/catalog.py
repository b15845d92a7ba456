"""Every registered query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, filters, graph, report, search
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The sample store, in SQL as in sources.tables.
MEM = """mem AS (
  SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 11 <> 0 THEN lang END AS project, source AS agent, 1704067200000000 + doc_id * 60000000 AS created_us,
    doc_id % 17 = 0 AS tombstone, doc_id % 23 = 0 AND doc_id % 17 <> 0 AS superseded, n_chars FROM documents
)"""
KEEP = "NOT tombstone AND NOT superseded"
TOK = "tok AS (SELECT id, list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS toks FROM mem)"
CHUNK = "chunk AS (SELECT vec_id // 5 AS id, vec_id % 5 AS chunk_no, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
REL = """rel AS (
  SELECT src, kind, dst FROM (
    SELECT id + 1 AS src, 'supersedes' AS kind, id AS dst FROM mem WHERE superseded UNION ALL SELECT id, 'follows', id + 7 FROM mem WHERE id % 3 = 0
  ) AS r WHERE src IN (SELECT id FROM mem) AND dst IN (SELECT id FROM mem)
)"""
TAG = "tag AS (SELECT 'quality:' || quality AS entity, doc_id AS id FROM labels UNION ALL SELECT 'toxic:' || toxic, doc_id FROM labels)"
LOG = """oplog AS (
  SELECT epoch_us(ts) AS ts, CASE event_type WHEN 'signup' THEN 'session' WHEN 'view' THEN 'recall' WHEN 'error' THEN 'recall' WHEN 'purchase' THEN 'remember' WHEN 'click' THEN 'related' END AS tool,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS latency_ms, event_type = 'error' AS is_error FROM events
)"""
LITERAL = "the tion of thon"
SINCE = 1_704_100_000_000_000


def _bm25(queries: str, keep: str = KEEP) -> str:
    """CTEs up to `bm(query_id, id, score)` for queries (query_id, text)."""
    return f"""{MEM}, {TOK}, q AS ({queries}),
qt AS (SELECT DISTINCT query_id, unnest(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))) AS term FROM q),
flat AS (SELECT id, len(toks) AS doc_len, unnest(toks) AS term FROM tok),
tf AS (SELECT id, doc_len, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM qt) GROUP BY id, doc_len, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, sum(len(toks)) AS total FROM tok),
bm AS (
  SELECT query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / greatest(total * 1.0 / n, 1)))), 6) AS score
  FROM tf JOIN df ON tf.term = df.term JOIN qt ON tf.term = qt.term CROSS JOIN st JOIN mem ON tf.id = mem.id WHERE {keep} GROUP BY query_id, tf.id
)"""


def _top(source: str, k: int, name: str = "top") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM {source} WHERE score IS NOT NULL) AS x WHERE rank < {k})"


def _cosines(queries: str, where: str = "TRUE", extra: str = "") -> str:
    """CTEs up to `cs(query_id, id, score)`: best chunk of each record for queries (query_id, vec, grp?)."""
    return f"""{CHUNK}, unit AS (SELECT id, label, {UNIT.format(v="vec")} AS u FROM chunk), vq AS ({queries}),
vu AS (SELECT *, {UNIT.format(v="vec")} AS qu FROM vq),
cs AS (SELECT query_id, unit.id, round(max(list_sum(list_transform(list_zip(u, qu), lambda p: p[1] * p[2]))), 6) AS score FROM unit CROSS JOIN vu {extra} WHERE {where} GROUP BY query_id, unit.id)"""


def _fused(lists: list[str], k: int, name: str = "fused") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS list FROM {one}" for i, one in enumerate(lists))
    return f"""entries AS ({union}), {name} AS (
  SELECT * FROM (
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) - 1 AS INTEGER) AS rank FROM (
      SELECT query_id, id, round(sum(1.0 / (60 + rank + 1)), 9) AS score, min(list * 1000000 + rank) AS first FROM entries GROUP BY query_id, id
    ) AS f
  ) AS g WHERE rank < {k}
)"""


BENCH = "SELECT item_id AS query_id, text FROM benchmark"
#: What a score may gain when it is rounded.
ROUNDING = 1e-6
VECS = "SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM benchmark JOIN embeddings ON vec_id = item_id * 11"


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return add


def _literal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, LITERAL)], "query_id long, text string")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 11).alias("vec_id")).join(v, "vec_id").select("query_id", "vec")


def _both(spark: SparkSession, d: str) -> DataFrame:
    return T.benchmark_queries(spark, d).join(_vectors(spark, d), "query_id")


@register("tokenize_doc_len", f"WITH {MEM}, {TOK} SELECT id, len(toks) AS doc_len, array_to_string(toks[1:5], ' ') AS first_tokens FROM tok")
def _(spark, d):
    toks = T.memories(spark, d).select("id", text.tokens(F.col("content")).alias("toks"))
    return toks.select("id", F.size("toks").cast("long").alias("doc_len"), F.array_join(F.slice("toks", 1, 5), " ").alias("first_tokens"))


@register("term_freq", f"WITH {MEM}, {TOK}, flat AS (SELECT id, len(toks) AS doc_len, unnest(toks) AS term FROM tok) SELECT id, doc_len, term, count(*) AS tf FROM flat GROUP BY id, doc_len, term")
def _(spark, d):
    return search.term_rows(T.memories(spark, d)).select("id", F.col("doc_len").cast("long").alias("doc_len"), "term", "tf")


@register("doc_freq", f"WITH {MEM}, {TOK}, flat AS (SELECT DISTINCT id, unnest(toks) AS term FROM tok) SELECT term, count(*) AS df FROM flat GROUP BY term")
def _(spark, d):
    return search.term_rows(T.memories(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@register("corpus_stats", f"WITH {MEM}, {TOK} SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS total_tokens FROM tok")
def _(spark, d):
    return search.corpus_stats(T.memories(spark, d))


@register("bm25_topk", f"WITH {_bm25(f"SELECT 0 AS query_id, '{LITERAL}' AS text")}, {_top('bm', 10)} SELECT id, score, rank FROM top")
def _(spark, d):
    return search.bm25_top_k(T.memories(spark, d), _literal(spark), 10, filters.keep()).select("id", "score", "rank")


@register("bm25_batch_topk", f"WITH {_bm25(BENCH)}, {_top('bm', 8)} SELECT query_id, id, score, rank FROM top")
def _(spark, d):
    return search.bm25_top_k(T.memories(spark, d), T.benchmark_queries(spark, d), 8, filters.keep()).select("query_id", "id", "score", "rank")


@register("bm25_scoped", f"WITH {_bm25(BENCH, KEEP + " AND project = 'en' AND agent = 'src3'")}, {_top('bm', 8)} SELECT query_id, id, score, rank FROM top")
def _(spark, d):
    return search.bm25_top_k(T.memories(spark, d), T.benchmark_queries(spark, d), 8, filters.keep("en", "src3")).select("query_id", "id", "score", "rank")


@register("vector_topk", f"WITH {_cosines('SELECT 0 AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id = 33')}, {_top('cs', 10)} SELECT id, score, rank FROM top")
def _(spark, d):
    q = T.table(spark, d, "embeddings").where("vec_id = 33").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vec"))
    return search.vector_top_k(T.chunks(spark, d), q, 10).select("id", "score", "rank")


@register("vector_batch_topk", f"WITH {_cosines(VECS)}, {_top('cs', 8)} SELECT query_id, id, score, rank FROM top")
def _(spark, d):
    return search.vector_top_k(T.chunks(spark, d), _vectors(spark, d), 8).select("query_id", "id", "score", "rank")


@register("vector_dedup_chunks", f"WITH {_cosines(VECS)} SELECT query_id, id, score FROM cs WHERE score >= 0.2")
def _(spark, d):
    return search.similarities(T.chunks(spark, d), _vectors(spark, d), least=0.2 - ROUNDING).where("score >= 0.2")


@register("vector_filtered", f"WITH {MEM}, {_cosines(VECS, KEEP + " AND project = 'en'", 'JOIN mem ON mem.id = unit.id')}, {_top('cs', 8)} SELECT query_id, id, score, rank FROM top")
def _(spark, d):
    kept = T.memories(spark, d).where(filters.keep("en")).select("id")
    return search.vector_top_k(T.chunks(spark, d).join(kept, "id", "left_semi"), _vectors(spark, d), 8).select("query_id", "id", "score", "rank")


_HALVES = f"{_bm25(BENCH)}, {_top('bm', 8, 'texts')}, {_cosines(VECS, KEEP, 'JOIN mem ON mem.id = unit.id')}, {_top('cs', 8, 'vectors')}, t2 AS (SELECT * FROM texts WHERE query_id IN (SELECT query_id FROM vq))"
_RECENT = "recent AS (SELECT u.query_id, u.id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY created_us DESC, u.id) - 1 AS INTEGER) AS rank FROM (SELECT query_id, id FROM vectors UNION SELECT query_id, id FROM t2) AS u JOIN mem ON mem.id = u.id)"


@register("rrf_fuse2", f"WITH {_HALVES}, {_fused(['vectors', 't2'], 8)} SELECT query_id, id, score, rank FROM fused")
def _(spark, d):
    mem = T.memories(spark, d)
    texts = search.bm25_top_k(mem, T.benchmark_queries(spark, d), 8, filters.keep())
    kept = T.chunks(spark, d).join(mem.where(filters.keep()).select("id"), "id", "left_semi")
    vectors = search.vector_top_k(kept, _vectors(spark, d), 8)
    asked = _vectors(spark, d).select("query_id")
    return search.fuse([vectors.select("query_id", "id", "rank"), texts.join(asked, "query_id", "left_semi").select("query_id", "id", "rank")], 8)


@register("rrf_fuse3_recency", f"WITH {_HALVES}, {_RECENT}, {_fused(['vectors', 't2', 'recent'], 8)} SELECT query_id, id, score, rank FROM fused")
def _(spark, d):
    return search.hybrid_recall(T.memories(spark, d), T.chunks(spark, d), _both(spark, d), 8, filters.keep(), recency=True)


@register("hybrid_recall", f"WITH {_HALVES}, {_fused(['vectors', 't2'], 8)} SELECT query_id, f.id, score, rank, project, agent FROM fused AS f JOIN mem ON mem.id = f.id")
def _(spark, d):
    mem = T.memories(spark, d)
    hits = search.hybrid_recall(mem, T.chunks(spark, d), _both(spark, d), 8, filters.keep())
    return hits.join(mem.select("id", "project", "agent"), "id").select("query_id", "id", "score", "rank", "project", "agent")


@register("vector_recall", f"WITH {_cosines(VECS)}, {_top('cs', 8, 'vectors')}, {_fused(['vectors'], 8)} SELECT query_id, id, score, rank FROM fused")
def _(spark, d):
    return search.vector_recall(T.chunks(spark, d), _vectors(spark, d), 8)


_NEAR = """ways AS (SELECT src AS at, 0 AS incoming, kind, dst AS id FROM rel UNION SELECT dst, 1, kind, src FROM rel),
near AS (
  SELECT * FROM (
    SELECT h.query_id, w.id, h.rank, w.incoming, w.kind, row_number() OVER (PARTITION BY h.query_id, w.id ORDER BY h.rank, w.incoming, w.kind) AS n FROM fused AS h JOIN ways AS w ON w.at = h.id
  ) AS x WHERE n = 1
),
fresh AS (SELECT near.* FROM near JOIN mem ON mem.id = near.id LEFT JOIN fused AS f ON f.query_id = near.query_id AND f.id = near.id WHERE f.id IS NULL AND NOT tombstone AND NOT superseded)"""


@register(
    "hybrid_expand_related",
    f"WITH {_HALVES}, {_fused(['vectors', 't2'], 8)}, {REL}, {_NEAR} SELECT query_id, 'hit' AS section, rank AS ordinal, id, score FROM fused UNION ALL "
    "SELECT query_id, 'related', CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, incoming, kind, id) - 1 AS INTEGER), id, 0.0 FROM fresh",
)
def _(spark, d):
    mem = T.memories(spark, d)
    hits = search.hybrid_recall(mem, T.chunks(spark, d), _both(spark, d), 8, filters.keep())
    return search.expand_related(hits, mem, T.relations(spark, d), filters.keep())


@register("filter_eq", f"WITH {MEM} SELECT id, agent FROM mem WHERE {KEEP} AND agent = 'src5'")
def _(spark, d):
    return T.memories(spark, d).where(filters.keep(filters={"source": filters.Eq("src5")})).select("id", "agent")


@register("filter_range", f"WITH {MEM} SELECT id, n_chars FROM mem WHERE {KEEP} AND n_chars BETWEEN 500 AND 2000")
def _(spark, d):
    return T.memories(spark, d).where(filters.keep(filters=filters.parse_filters(["n_chars=500..2000"]))).select("id", F.col("metadata")["n_chars"]["i"].alias("n_chars"))


@register("filter_and_scope_agent", f"WITH {MEM} SELECT id FROM mem WHERE {KEEP} AND project = 'en' AND agent = 'src2' AND n_chars >= 800")
def _(spark, d):
    return T.memories(spark, d).where(filters.keep("en", "src2", {"n_chars": filters.json_filter({"min": 800}), "source": filters.python_filter("src2")})).select("id")


@register("filter_unknown_project", f"WITH {MEM} SELECT id FROM mem WHERE {KEEP} AND project = '' AND project <> ''")
def _(spark, d):
    return T.memories(spark, d).where(filters.keep("")).select("id")


@register("timeline_live", f"WITH {MEM} SELECT id, created_us, superseded FROM mem WHERE NOT tombstone ORDER BY id")
def _(spark, d):
    return graph.live(T.memories(spark, d)).select("id", "created_us", "superseded").orderBy("id")


@register("timeline_all", f"WITH {MEM} SELECT id, tombstone, superseded FROM mem ORDER BY id")
def _(spark, d):
    return T.memories(spark, d).select("id", "tombstone", "superseded").orderBy("id")


@register("point_get", f"WITH {MEM} SELECT id, content, project FROM mem WHERE id IN (23, 34, 40) AND NOT tombstone")
def _(spark, d):
    return graph.live(T.memories(spark, d)).where(F.col("id").isin(23, 34, 40)).select("id", "content", "project")


@register("forget", f"WITH {MEM} SELECT id, tombstone OR id % 10 = 3 AS tombstone, NOT tombstone AND id % 10 = 3 AS forgotten FROM mem")
def _(spark, d):
    asked = F.col("id") % 10 == 3
    return T.memories(spark, d).select("id", (F.col("tombstone") | asked).alias("tombstone"), (~F.col("tombstone") & asked).alias("forgotten"))


@register("related_both_dirs", f"WITH {MEM}, {REL} SELECT src AS id, kind, TRUE AS outgoing, dst AS other FROM rel JOIN mem ON mem.id = dst WHERE NOT tombstone UNION SELECT dst, kind, FALSE, src FROM rel JOIN mem ON mem.id = src WHERE NOT tombstone")
def _(spark, d):
    mem = T.memories(spark, d)
    return graph.related(mem, T.relations(spark, d), mem)


@register("entity_members", f"WITH {MEM}, {TAG} SELECT DISTINCT entity, tag.id FROM tag JOIN mem ON mem.id = tag.id WHERE NOT tombstone")
def _(spark, d):
    return graph.entity_members(graph.checked_tags(T.entity_tags(spark, d)), T.memories(spark, d))


@register("entities_of", f"WITH {TAG} SELECT id, string_agg(entity, ',' ORDER BY entity) AS entities FROM (SELECT DISTINCT entity, id FROM tag) AS t GROUP BY id")
def _(spark, d):
    return graph.entities_of(T.entity_tags(spark, d)).select("id", F.array_join("entities", ",").alias("entities"))


_PAIRS = "pairs AS (SELECT a.id AS new, b.id AS old FROM mem AS a JOIN mem AS b ON b.id = a.id - 2 AND a.id % 5 = 0 AND a.project IS NOT DISTINCT FROM b.project AND NOT a.tombstone AND NOT b.tombstone)"


def _pairs(mem: DataFrame) -> DataFrame:
    a, b = (graph.live(mem).select((F.col("id") - back).alias("old"), F.col("id").alias(name), F.col("project").alias(f"p{back}")) for name, back in (("new", 2), ("same", 0)))
    return a.where("new % 5 = 0").join(b, "old").where(F.col("p2").eqNullSafe(F.col("p0"))).select("new", "old")


@register("supersede_apply", f"WITH {MEM}, {_PAIRS} SELECT id, superseded OR id IN (SELECT old FROM pairs) AS superseded FROM mem")
def _(spark, d):
    mem = T.memories(spark, d)
    return graph.supersede(mem, _pairs(mem))[0].select("id", "superseded")


@register("supersede_edges", f"WITH {MEM}, {_PAIRS} SELECT new AS src, 'supersedes' AS kind, old AS dst FROM pairs")
def _(spark, d):
    mem = T.memories(spark, d)
    return graph.supersede(mem, _pairs(mem))[1]


@register(
    "supersede_chain",
    f"WITH RECURSIVE {MEM}, e AS (SELECT id, id + 4 AS newer FROM mem WHERE id % 4 = 1 AND id % 20 <> 17 AND id + 4 IN (SELECT id FROM mem)), "
    "chain AS (SELECT id, newer AS newest, 1 AS steps FROM e UNION ALL SELECT c.id, e.newer, c.steps + 1 FROM chain AS c JOIN e ON e.id = c.newest) "
    "SELECT id, newest, steps FROM chain WHERE newest NOT IN (SELECT id FROM e)",
)
def _(spark, d):
    ids = T.memories(spark, d).select("id")
    edges = ids.where("id % 4 = 1 AND id % 20 <> 17").select((F.col("id") + 4).alias("src"), F.lit(graph.SUPERSEDES).alias("kind"), F.col("id").alias("dst"))
    return graph.newest_versions(edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("src", "kind", "dst"))


_DRAFT = "SELECT vec_id // 5 AS query_id, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN (vec_id // 5) % 11 <> 0 THEN lang END AS grp FROM embeddings JOIN documents ON doc_id = vec_id // 5"


def _near(least: float) -> tuple[str, Query]:
    where = f"{KEEP} AND project IS NOT DISTINCT FROM grp AND unit.id <> query_id"
    sql = f"WITH {MEM}, {_cosines(_DRAFT, where, 'JOIN mem ON mem.id = unit.id')}, near AS (SELECT * FROM cs WHERE score >= {least}), {_top('near', 5)} SELECT query_id, top.id, score, rank, CASE WHEN length(content) > 160 THEN substring(content, 1, 160) || '…' ELSE content END AS snippet FROM top JOIN mem ON mem.id = top.id"

    def near(spark, d):
        mem, chunks = T.memories(spark, d), T.chunks(spark, d)
        drafts = chunks.join(mem.select("id", F.col("project").alias("grp")), "id").select(F.col("id").alias("query_id"), "vec", "grp")
        return search.near_duplicates(drafts, chunks, mem, least)

    return sql, near


for _name, _least in (("near_dup_join", 0.80), ("near_dup_loose", 0.25)):
    _sql, _f = _near(_least)
    register(_name, _sql)(_f)


@register(
    "chunk_windows",
    f"WITH {MEM}, {TOK}, n AS (SELECT id, toks, CASE WHEN len(toks) <= 510 THEN 1 ELSE 1 + CAST(ceil((len(toks) - 510) / 446.0) AS INTEGER) END AS n FROM tok), "
    "w AS (SELECT id, toks, unnest(range(0, n)) AS i FROM n) SELECT id, CAST(i AS INTEGER) AS chunk_no, CAST(len(toks[i * 446 + 1:i * 446 + 510]) AS INTEGER) AS n_tokens, coalesce(toks[i * 446 + 1], '') AS first_token FROM w",
)
def _(spark, d):
    toks = search.spread(T.memories(spark, d).select("id", "content")).select("id", text.tokens(F.col("content")).alias("toks"))
    each = toks.select("id", F.posexplode(text.chunk_windows(F.col("toks"))).alias("chunk_no", "w"))
    return each.select("id", "chunk_no", F.size("w").alias("n_tokens"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first_token"))


@register("stats_counts", f"WITH {MEM} SELECT count(*) FILTER (WHERE NOT tombstone) AS live, count(*) FILTER (WHERE tombstone) AS forgotten FROM mem")
def _(spark, d):
    return report.store_counts(T.memories(spark, d))


@register("stats_by_agent", "SELECT role AS agent, count(*) AS live, count(DISTINCT conv_id) AS sessions FROM conversations WHERE (conv_id * 1000 + turn) % 17 <> 0 GROUP BY role")
def _(spark, d):
    return report.by_agent(T.chat(spark, d)).orderBy(F.desc("live"), "agent")


@register("index_counts", f"WITH {MEM}, {REL}, {TAG} SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM mem) AS documents, (SELECT count(DISTINCT entity) FROM tag) AS entities, (SELECT count(*) FROM (SELECT DISTINCT * FROM rel) AS r) AS relations")
def _(spark, d):
    return report.index_counts(T.chunks(spark, d), T.memories(spark, d), T.entity_tags(spark, d), T.relations(spark, d))


_GOOD = "tool = 'recall' AND NOT is_error"


@register(
    "oplog_summary",
    f"WITH {LOG} SELECT count(*) FILTER (WHERE tool = 'session') AS sessions, count(*) FILTER (WHERE tool = 'recall') AS recalls, count(*) FILTER (WHERE tool = 'recall' AND is_error) AS recall_errors, "
    f"count(*) FILTER (WHERE {_GOOD} AND k % 10 = 0) AS empty_recalls, count(*) FILTER (WHERE tool = 'remember') AS remembers, count(*) FILTER (WHERE tool = 'remember' AND is_error) AS remember_errors, "
    f"count(*) FILTER (WHERE tool = 'forget') AS forgets, count(*) FILTER (WHERE tool = 'related') AS related FROM oplog WHERE ts >= {SINCE}",
)
def _(spark, d):
    return report.usage(report.since(T.oplog(spark, d), SINCE)).drop("p50_ms", "p99_ms")


@register(
    "oplog_percentiles",
    f"WITH {LOG}, g AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM oplog WHERE {_GOOD}) "
    "SELECT min(latency_ms) FILTER (WHERE r >= ceil(0.5 * n)) AS p50_ms, min(latency_ms) FILTER (WHERE r >= ceil(0.99 * n)) AS p99_ms FROM g",
)
def _(spark, d):
    return report.usage(T.oplog(spark, d)).select("p50_ms", "p99_ms")


_SERVED = f"served AS (SELECT k AS id, count(*) AS served FROM oplog WHERE {_GOOD} AND k % 10 <> 0 GROUP BY k)"


@register(
    "oplog_top_served",
    f"WITH {MEM}, {LOG}, {_SERVED}, best AS (SELECT * FROM served ORDER BY served DESC, id LIMIT 5), line AS (SELECT id, split_part(content, chr(10), 1) AS l, content FROM mem WHERE NOT tombstone) "
    "SELECT best.id, served, coalesce(CASE WHEN length(l) > 96 OR contains(content, chr(10)) THEN substring(l, 1, 96) || '…' ELSE l END, '(forgotten since)') AS preview FROM best LEFT JOIN line ON line.id = best.id",
)
def _(spark, d):
    return report.top_served(T.oplog(spark, d), T.memories(spark, d))


@register("oplog_never_recalled", f"WITH {MEM}, {LOG}, {_SERVED} SELECT id FROM mem WHERE {KEEP} AND id NOT IN (SELECT id FROM served)")
def _(spark, d):
    return report.never_recalled(T.oplog(spark, d), T.memories(spark, d)).select("id")


@register("vacuum_live_rows", f"WITH {MEM} SELECT id, superseded FROM mem WHERE NOT tombstone")
def _(spark, d):
    return graph.vacuum(T.memories(spark, d), T.relations(spark, d), T.entity_tags(spark, d))[0].select("id", "superseded")


@register("vacuum_graph_edges", f"WITH {MEM}, {REL} SELECT src, kind, dst FROM rel WHERE src IN (SELECT id FROM mem WHERE NOT tombstone) AND dst IN (SELECT id FROM mem WHERE NOT tombstone)")
def _(spark, d):
    return graph.vacuum(T.memories(spark, d), T.relations(spark, d), T.entity_tags(spark, d))[1]


@register("validate_relation_targets", f"WITH {MEM}, {REL} SELECT src, kind, dst FROM rel WHERE dst NOT IN (SELECT id FROM mem WHERE NOT tombstone)")
def _(spark, d):
    return graph.missing_targets(graph.checked_relations(T.relations(spark, d)), T.memories(spark, d))


@register("verify_doc_len", f"WITH {MEM}, {TOK} SELECT id, CAST(len(toks) AS BIGINT) AS real, CAST(CASE WHEN id % 9 = 0 THEN len(toks) + 1 END AS BIGINT) AS doc_len FROM tok WHERE id % 9 = 0 OR id % 10 = 0")
def _(spark, d):
    mem = T.memories(spark, d)
    stored = mem.where("id % 9 = 0 OR id % 10 <> 0").select("id", (text.doc_len(F.col("content")) + (F.col("id") % 9 == 0).cast("int")).alias("doc_len"))
    return report.mismatched_lengths(mem, stored).select("id", F.col("real").cast("long").alias("real"), F.col("doc_len").cast("long").alias("doc_len"))


_RECALL = f"{_cosines(VECS)}, {_top('cs', 10, 'exact')}, part AS (SELECT * FROM cs WHERE id % 4 <> 0), {_top('part', 10, 'got')}"


def _exact_and_got(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks, asked = T.chunks(spark, d), _vectors(spark, d)
    return search.vector_top_k(chunks, asked, 10), search.vector_top_k(chunks.where("id % 4 <> 0"), asked, 10)


@register("recall_at_k", f"WITH {_RECALL} SELECT exact.query_id, count(got.id) / 10.0 AS recall FROM exact LEFT JOIN got ON got.query_id = exact.query_id AND got.id = exact.id GROUP BY exact.query_id")
def _(spark, d):
    return evaluation.overlap(*_exact_and_got(spark, d), 10)


@register("tie_aware_recall", f"WITH {_RECALL}, edge AS (SELECT query_id, min(score) AS edge, count(*) AS n FROM exact GROUP BY query_id) SELECT edge.query_id, CAST(least(count(got.id), any_value(n)) AS DOUBLE) / any_value(n) AS recall FROM edge LEFT JOIN got ON got.query_id = edge.query_id AND got.score >= edge.edge - 1e-5 GROUP BY edge.query_id")
def _(spark, d):
    return evaluation.tie_aware(*_exact_and_got(spark, d), 10)


@register(
    "recall_summary",
    f"WITH {_RECALL}, r AS (SELECT exact.query_id, count(got.id) / 10.0 AS recall FROM exact LEFT JOIN got ON got.query_id = exact.query_id AND got.id = exact.id GROUP BY exact.query_id), "
    "o AS (SELECT recall, row_number() OVER (ORDER BY recall) AS n, count(*) OVER () AS m FROM r) "
    "SELECT round(avg(recall), 6) AS mean, min(recall) AS least, min(recall) FILTER (WHERE n >= ceil(0.1 * m)) AS p10, min(recall) FILTER (WHERE n >= ceil(0.5 * m)) AS p50 FROM o",
)
def _(spark, d):
    return evaluation.summary(evaluation.overlap(*_exact_and_got(spark, d), 10))


_CASES = f"""WITH held AS (SELECT DISTINCT id, unnest(toks) AS term FROM tok), held_by AS (SELECT term, count(*) AS df FROM held GROUP BY term),
rarest AS (SELECT id, term FROM (SELECT id, held.term, row_number() OVER (PARTITION BY id ORDER BY df, held.term) AS n FROM held JOIN held_by ON held_by.term = held.term) AS x WHERE n = 1)
SELECT rarest.id AS query_id, term AS text, CAST(embedding AS DOUBLE[]) AS vec FROM rarest JOIN mem ON mem.id = rarest.id JOIN embeddings ON vec_id = rarest.id % (SELECT count(*) FROM embeddings) WHERE {KEEP}"""


@register(
    "lexical_lift",
    f"WITH {_bm25(_CASES)}, {_top('bm', 10, 'texts')}, {_cosines('SELECT query_id, vec FROM q', KEEP, 'JOIN mem ON mem.id = unit.id')}, {_top('cs', 10, 'vectors')}, {_fused(['vectors', 'texts'], 10)}, "
    "n AS (SELECT (SELECT count(*) FROM q) AS asked, (SELECT count(*) FROM fused WHERE id = query_id) AS hybrid_found, (SELECT count(*) FROM vectors WHERE id = query_id) AS vector_found) "
    "SELECT asked, hybrid_found, vector_found, round((hybrid_found - vector_found) * 1.0 / asked, 6) AS lift FROM n",
)
def _(spark, d):
    """Every document that search may return is asked for by its rarest term, with a vector that is not its own: hybrid search against vector search alone."""
    mem, vectors = T.memories(spark, d), T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    number = vectors.agg(F.count("*").alias("n"))
    asked = search.rarest_terms(mem).join(mem.where(filters.keep()).select(F.col("id").alias("query_id")), "query_id", "left_semi")
    cases = asked.crossJoin(F.broadcast(number)).withColumn("vec_id", F.col("query_id") % F.col("n")).join(vectors, "vec_id").select("query_id", "text", "vec")  # number is one row
    return search.lift(mem, T.chunks(spark, d), cases, 10, filters.keep())


_STEPS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.8]


@register("near_dup_threshold_sweep", f"WITH {_cosines(VECS)}, t AS (SELECT unnest([{', '.join(f'CAST({s} AS DOUBLE)' for s in _STEPS)}]) AS threshold) SELECT threshold, round(count(*) FILTER (WHERE score >= threshold) * 1.0 / count(*), 6) AS share FROM cs CROSS JOIN t GROUP BY threshold")
def _(spark, d):
    chunks, asked = T.chunks(spark, d), _vectors(spark, d)
    pairs = chunks.agg(F.count_distinct("id").alias("records")).crossJoin(asked.agg(F.count("*").alias("asked"))).select((F.col("records") * F.col("asked")).alias("n"))  # one row each
    return evaluation.thresholds(search.similarities(chunks, asked, least=min(_STEPS) - ROUNDING), _STEPS, pairs)


_OWN = "SELECT CAST(item_id * 11 // 5 AS BIGINT) AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM benchmark JOIN embeddings ON vec_id = item_id * 11"
_MARKS = "".join(f", min(score) FILTER (WHERE n >= ceil({p} * m)) AS p{round(100 * p)}" for p in evaluation.MARKS)


@register(
    "near_dup_distribution",
    f"WITH {_cosines(_OWN, 'query_id <> unit.id')}, {_top('cs', 10)}, picked AS (SELECT CASE rank WHEN 0 THEN 'nearest' ELSE 'tenth' END AS kind, score FROM top WHERE rank IN (0, 9)), "
    "o AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY score) AS n, count(*) OVER (PARTITION BY kind) AS m FROM picked) "
    f"SELECT kind, count(*) AS scores, min(score) AS least{_MARKS}, max(score) AS most FROM o GROUP BY kind",
)
def _(spark, d):
    """How alike a vector is to the nearest and to the tenth nearest of the other records, over all vectors asked for."""
    asked = _vectors(spark, d).select(F.floor(F.col("query_id") * 11 / 5).cast("long").alias("query_id"), "vec")
    best = search.vector_top_k(T.chunks(spark, d), asked, 10, not_self=True).where("rank IN (0, 9)")
    return evaluation.distribution(best.withColumn("kind", F.when(F.col("rank") == 0, "nearest").otherwise("tenth")), "kind")


@register("snippet_preview", f"WITH {MEM} SELECT id, CASE WHEN length(content) > 160 THEN substring(content, 1, 160) || '…' ELSE content END AS snippet, CASE WHEN length(split_part(content, chr(10), 1)) > 96 OR contains(content, chr(10)) THEN substring(split_part(content, chr(10), 1), 1, 96) || '…' ELSE content END AS preview FROM mem")
def _(spark, d):
    c = F.col("content")
    return T.memories(spark, d).select("id", text.snippet(c).alias("snippet"), text.preview(c).alias("preview"))


@register("regression_guard", "WITH m AS (SELECT * FROM (VALUES ('recall_at_10', 1.0, 0.98), ('query_p99_ms', 100.0, 120.0), ('remember_p99_ms', 20.0, 26.0), ('file_bytes', 1000.0, 1050.0), ('query_rss', 100.0, 120.0)) AS v(metric, was, now)) SELECT metric, round(now / was - 1, 6) AS change, CASE WHEN metric = 'recall_at_10' THEN was - now > 0.01 WHEN metric LIKE '%_ms' THEN now / was - 1 > 0.15 AND now - was > 8 WHEN metric LIKE '%_bytes' THEN now / was - 1 > 0.1 ELSE now / was - 1 > 0.15 END AS failed FROM m")
def _(spark, d):
    was = {"recall_at_10": 1.0, "query_p99_ms": 100.0, "remember_p99_ms": 20.0, "file_bytes": 1000.0, "query_rss": 100.0}
    now = {"recall_at_10": 0.98, "query_p99_ms": 120.0, "remember_p99_ms": 26.0, "file_bytes": 1050.0, "query_rss": 120.0}
    one, two = (spark.createDataFrame(list(x.items()), "metric string, value double") for x in (was, now))
    return evaluation.regressions(one, two)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
