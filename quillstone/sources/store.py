"""A store of memories in snapshots.

A snapshot is a list of folders for each table. Every change writes folders of the rows it adds, then a list that names them
beside the older ones, then moves the CURRENT pointer to that list, so readers see the old store or the new one. Forgotten and superseded memories
get a mark. One writer at a time, by a lock file. Lists and pointer live on a local or mounted file system; on an object store a table format takes their place.
"""

from __future__ import annotations

import json
import os
import re
import socket
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashingEmbedder, embed, first_window
from ..functions.text import chunk_windows, is_ulid, tokens
from ..operators import filters as fl
from ..operators import graph, report, search

MEMORIES = f"id string, content string, project string, agent string, session_id string, created_us bigint, tombstone boolean, superseded boolean, metadata map<string,{fl.SCALAR}>"
TABLES = {
    "memories": MEMORIES, "marks": "id string, tombstone boolean, superseded boolean", "chunks": "id string, chunk_no int, vec array<double>",
    "postings": "id string, term string, tf bigint, doc_len int", "entity_tags": "entity string, id string", "relations": "src string, kind string, dst string",
}
#: Folders a table may have; beyond that the newest FOLDED become one.
FOLDERS, FOLDED = 64, 32
#: Digits of ids: time first, so that ids sort by time. Most entries of metadata; default number of hits.
_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
METADATA, LIMIT = 65_535, 8


class WriteLocked(RuntimeError):
    """Another writer holds the store."""


def _left_behind(lock: str) -> bool:
    """Whether a lock names a process of this machine that has ended. Locks of other machines, and empty ones, are never taken over."""
    try:
        with open(lock) as f:
            host, _, pid = f.read().partition(" ")
    except FileNotFoundError:
        return False
    if host != socket.gethostname() or not pid.isdigit():
        return False
    try:
        os.kill(int(pid), 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        return False
    return False


def new_id(at_ms: int | None = None) -> str:
    """A ULID: 48 bits of time, 80 random bits, 26 digits."""
    number = ((time.time_ns() // 1_000_000 if at_ms is None else at_ms) << 80) | int.from_bytes(os.urandom(10), "big")
    return "".join(_DIGITS[number >> 5 * i & 31] for i in reversed(range(26)))


@dataclass
class Draft:
    """A memory to be written. Of metadata keys given twice the last counts."""

    content: str
    project: str | None = None
    agent: str = ""
    session_id: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    entities: list[str] = field(default_factory=list)
    relations: list[tuple[str, str]] = field(default_factory=list)
    supersedes: list[str] = field(default_factory=list)


@dataclass
class Remembered:
    id: str
    similar: list[Row]


class Store:
    """Remember, recall, relate, forget and report. A new store takes the embedder's name; opening it with another is an error."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, create: bool | None = None):
        """create: True makes a new store, False opens one, None does either."""
        self.spark, self.path, self.embedder = spark, path, embedder or HashingEmbedder()
        there = os.path.exists(f"{path}/CURRENT")
        if create is True and there:
            raise FileExistsError(path)
        if create is False and not there:
            raise FileNotFoundError(path)
        if not there:
            os.makedirs(path, exist_ok=True)
            with self._writing():
                self._commit({})
        now = self._now()
        if (now["model_id"], now["dims"]) != (self.embedder.id, self.embedder.dims):
            raise ValueError(f"the store was made with {now['model_id']} ({now['dims']} dimensions), not {self.embedder.id} ({self.embedder.dims})")

    def _now(self) -> dict[str, Any]:
        """The current snapshot: version, model_id, dims, n_docs and total_tokens (dead memories included), and the folders of each table."""
        with open(f"{self.path}/CURRENT") as f:
            name = f.read().strip()
        with open(f"{self.path}/{name}.json") as f:
            return json.load(f)

    @property
    def version(self) -> int:
        return self._now()["version"]

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{x}" for x in folders])

    def table(self, name: str, now: dict[str, Any] | None = None) -> DataFrame:
        """A table of a snapshot, the current one if none is given; memories come with what their marks say."""
        folders = (now or self._now())["tables"]
        df = self._read(name, folders[name])
        if name != "memories" or not folders["marks"]:
            return df
        marks = self._read("marks", folders["marks"]).groupBy("id").agg(F.bool_or("tombstone").alias("gone"), F.bool_or("superseded").alias("old"))
        flags = {"tombstone": F.col("tombstone") | F.coalesce("gone", F.lit(False)), "superseded": F.col("superseded") | F.coalesce("old", F.lit(False))}
        return df.join(marks, "id", "left").select(*[flags.get(c, F.col(c)).alias(c) for c in df.columns])

    def _index(self, now: dict[str, Any]) -> search.TextIndex:
        return search.TextIndex(self.table("postings", now), now["n_docs"], now["total_tokens"])

    @contextmanager
    def _writing(self):
        lock = f"{self.path}/LOCK"
        if _left_behind(lock):  # its writer is gone
            with suppress(FileNotFoundError):
                os.remove(lock)
        try:
            handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise WriteLocked(self.path) from None
        with os.fdopen(handle, "w") as f:
            f.write(f"{socket.gethostname()} {os.getpid()}")
        try:
            yield
        finally:
            os.remove(lock)

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"data/{table}-{uuid.uuid4().hex}"
        if table == "postings":  # in order, so that a search skips row groups without its terms
            df = df.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, added: dict[str, DataFrame], n_docs: int = 0, total_tokens: int = 0, whole: bool = False) -> None:
        """A snapshot with the rows added, of so many documents and tokens; whole: with these alone."""
        empty = {"version": -1, "n_docs": 0, "total_tokens": 0, "tables": {t: [] for t in TABLES}}
        old = self._now() if os.path.exists(f"{self.path}/CURRENT") else empty
        before = empty if whole else old
        tables = {t: before["tables"][t] + ([self._write(t, added[t])] if t in added else []) for t in TABLES}
        for t, folders in tables.items():
            if len(folders) > FOLDERS:
                folders[-FOLDED:] = [self._write(t, self._read(t, folders[-FOLDED:]))]
        new = {
            "version": old["version"] + 1, "model_id": self.embedder.id, "dims": self.embedder.dims,
            "n_docs": before["n_docs"] + n_docs, "total_tokens": before["total_tokens"] + total_tokens, "tables": tables,
        }
        name = f"snap-{new['version']}"
        for file, text in ((f"{name}.json", json.dumps(new)), ("CURRENT", name)):
            with open(f"{self.path}/{file}.tmp", "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(f"{self.path}/{file}.tmp", f"{self.path}/{file}")

    def _chunks(self, rows: DataFrame) -> DataFrame:
        each = rows.select("id", F.posexplode(chunk_windows(tokens(F.col("content")))).alias("chunk_no", "window"))
        return each.select("id", "chunk_no", embed(self.embedder, F.array_join("window", " ")).alias("vec"))

    def remember(self, *drafts: Draft, similar: bool = False) -> list[Remembered]:
        """Write drafts in one change. similar: also tell which earlier memories of the same project are near copies."""
        now = time.time_ns() // 1000
        ids, rows = [new_id(now // 1000) for _ in drafts], []
        for i, d in zip(ids, drafts, strict=True):
            if len(d.metadata) > METADATA:
                raise ValueError("too much metadata")
            rows.append((i, d.content, d.project or None, d.agent, d.session_id or None, now, False, False, {k: fl.scalar(v) for k, v in d.metadata.items()}))
        fresh = self.spark.createDataFrame(rows, MEMORIES)
        tags = [(e, i) for i, d in zip(ids, drafts, strict=True) for e in d.entities]
        edges = self.spark.createDataFrame([(i, k, t) for i, d in zip(ids, drafts, strict=True) for k, t in d.relations], TABLES["relations"])
        old = self.spark.createDataFrame([(i, t) for i, d in zip(ids, drafts, strict=True) for t in d.supersedes], "new string, old string")
        with self._writing():
            state = self._now()
            known, chunks = self.table("memories", state), self._chunks(fresh)
            near = self._near(fresh, chunks, known, self.table("chunks", state)) if similar else {}
            added = {"memories": fresh, "chunks": chunks, "postings": search.term_rows(fresh).select("id", "term", "tf", "doc_len")}
            if any(d.relations for d in drafts):
                lost = graph.missing_targets(edges, known.unionByName(fresh)).limit(1).collect()
                if lost:
                    raise ValueError(f"no live memory {lost[0].dst}")
            if tags:
                added["entity_tags"] = graph.checked_tags(self.spark.createDataFrame(tags, TABLES["entity_tags"]))
            if any(d.supersedes for d in drafts):
                _, version = graph.supersede(known.unionByName(fresh), old)
                added["marks"] = version.select(F.col("dst").alias("id"), F.lit(False).alias("tombstone"), F.lit(True).alias("superseded")).distinct()
                edges = edges.unionByName(version)
            if any(d.relations or d.supersedes for d in drafts):
                added["relations"] = graph.checked_relations(edges)
            self._commit(added, **search.corpus_stats(fresh).first().asDict())
        return [Remembered(i, near.get(i, [])) for i in ids]

    def _near(self, fresh: DataFrame, chunks: DataFrame, known: DataFrame, known_chunks: DataFrame) -> dict[str, list[Row]]:
        numbers = {r.id: n for n, r in enumerate(fresh.select("id").collect())}
        numbered = self.spark.createDataFrame([(n, i) for i, n in numbers.items()], "query_id long, own string")
        drafts = numbered.join(chunks.withColumnRenamed("id", "own"), "own").join(fresh.select(F.col("id").alias("own"), F.col("project").alias("grp")), "own")
        found = search.near_duplicates(drafts.select("query_id", "vec", "grp"), known_chunks.select("id", "vec"), known).orderBy("rank").collect()
        return {i: [r for r in found if r.query_id == n] for i, n in numbers.items()}

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, text string").withColumn("vec", embed(self.embedder, first_window(F.col("text"))))

    def _shown(self, out: DataFrame, mem: DataFrame) -> list[Row]:
        shown = mem.select("id", "content", "project", "agent", "session_id", "created_us", "superseded", "metadata")
        rows = out.join(shown, "id").orderBy("section", "ordinal")
        return rows.select("id", "content", "project", "agent", "session_id", "created_us", "superseded", "metadata", "score", "section", "ordinal").collect()

    def recall(self, text: str, limit: int = LIMIT, project: str | None = None, agent: str | None = None, filters: dict[str, fl.Filter] | None = None, expand_related: bool = False, recency: bool = False) -> list[Row]:
        """Hits (id, content, score, section, ordinal) of hybrid search, best first, related memories after them. Ties fall to smaller ids."""
        now, keep = self._now(), fl.keep(project, agent, filters)
        mem = self.table("memories", now)
        hits = search.hybrid_recall(mem, self.table("chunks", now).select("id", "vec"), self._query(text), limit, keep, recency, self._index(now))
        if expand_related:
            return self._shown(search.expand_related(hits, mem, self.table("relations", now), keep), mem)
        return self._shown(hits.select("query_id", F.lit("hit").alias("section"), F.col("rank").alias("ordinal"), "id", "score"), mem)

    def search_text(self, text: str, limit: int = LIMIT, project: str | None = None, agent: str | None = None, filters: dict[str, fl.Filter] | None = None) -> list[Row]:
        """Hits of full-text search alone, with BM25 scores."""
        now, query = self._now(), self.spark.createDataFrame([(0, text)], "query_id long, text string")
        mem = self.table("memories", now)
        hits = search.bm25_top_k(mem, query, limit, fl.keep(project, agent, filters), self._index(now))
        return self._shown(hits.select(F.lit("hit").alias("section"), F.col("rank").alias("ordinal"), "id", "score"), mem)

    def recall_vector(self, text: str, limit: int = LIMIT, project: str | None = None, agent: str | None = None, filters: dict[str, fl.Filter] | None = None) -> list[Row]:
        """Hits of vector search alone, with fused scores."""
        now = self._now()
        mem = self.table("memories", now)
        kept = mem.where(fl.keep(project, agent, filters)).select("id")
        hits = search.vector_recall(self.table("chunks", now).select("id", "vec").join(kept, "id", "left_semi"), self._query(text), limit)
        return self._shown(hits.select(F.lit("hit").alias("section"), F.col("rank").alias("ordinal"), "id", "score"), mem)

    def get(self, id: str) -> Row | None:
        return graph.live(self.table("memories")).where(F.col("id") == id).first()

    def forget(self, id: str) -> bool:
        """Whether there was such a live memory."""
        if self.get(id) is None:
            return False
        with self._writing():
            self._commit({"marks": self.spark.createDataFrame([(id, True, False)], TABLES["marks"])})
        return True

    def related(self, id: str) -> list[Row]:
        mem = self.table("memories")
        asked = self.spark.createDataFrame([(id,)], "id string")
        return graph.related(asked, self.table("relations"), mem).orderBy(F.desc("outgoing"), "kind", "other").collect()

    def entity_members(self, entity: str) -> list[Row]:
        ids = graph.entity_members(self.table("entity_tags"), self.table("memories")).where(F.col("entity") == entity).select("id")
        return self.table("memories").join(ids, "id", "left_semi").orderBy("id").collect()

    def entities_of(self, id: str) -> list[str]:
        row = graph.entities_of(self.table("entity_tags").where(F.col("id") == id)).first()
        return row.entities if row else []

    def timeline(self, dead: bool = False) -> DataFrame:
        mem = self.table("memories")
        return (mem if dead else graph.live(mem)).orderBy("id")

    def stats(self) -> dict[str, Any]:
        mem, tags, edges = self.table("memories"), self.table("entity_tags"), self.table("relations")
        counts = report.index_counts(self.table("chunks"), mem, tags, edges).first().asDict()
        return report.store_counts(mem).first().asDict() | counts | {"agents": [r.asDict() for r in report.by_agent(mem).orderBy(F.desc("live"), "agent").collect()]}

    def report(self, oplog: DataFrame | None = None, since: int = 0) -> dict[str, Any]:
        """Usage since a time; without a log the store's counts alone."""
        mem = self.table("memories")
        out = report.store_counts(mem).first().asDict()
        if oplog is not None:
            ops = report.since(oplog, since)
            never = report.never_recalled(ops, mem).select("id")
            out |= report.usage(ops).first().asDict() | {"top": [r.asDict() for r in report.top_served(ops, mem).orderBy(F.desc("served"), "id").collect()]}
            out |= {"never_recalled": never.count(), "never_recalled_sample": [r.id for r in never.orderBy("id").limit(5).collect()]}
        return out

    def vacuum(self) -> None:
        """Drop what was forgotten, and edges and tags of it; what is left lies in one folder a table."""
        with self._writing():
            now = self._now()
            mem, edges, tags = graph.vacuum(self.table("memories", now), self.table("relations", now), self.table("entity_tags", now))
            left = {t: self.table(t, now).join(mem.select("id"), "id", "left_semi").select(*[c.split()[0] for c in TABLES[t].split(", ")]) for t in ("chunks", "postings")}
            self._commit({"memories": mem, "relations": edges, "entity_tags": tags, **left}, **search.corpus_stats(mem).first().asDict(), whole=True)


def checked_id(id: Any) -> str:
    """The id, if it is well formed; else an error."""
    if not isinstance(id, str) or not re.fullmatch("[0-7][0-9A-HJKMNP-TV-Z]{25}", id):
        raise ValueError(f"not an id: {id!r}")
    return id


def check_ids(ids: Iterable[str], spark: SparkSession) -> list[str]:
    """The ids that are not well formed."""
    return [r.id for r in spark.createDataFrame([(i,) for i in ids], "id string").where(~is_ulid(F.col("id"))).collect()]
