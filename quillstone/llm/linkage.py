"""Linking near copies without forming all pairs of a group.

Nodes that share a key may be linked. Each key first ties its nodes to one of them, the hub, which is the one
that shares most keys; tied pairs are verified and joined into components. Only keys whose nodes
are still in different components are looked at again, in blocks of bounded size: there a parity sketch
bounds the differences of pairs across components from below, and pairs that pass are verified. So
every pair that shares a key is verified, ruled out by its bound, or already known to be connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, per_task

#: Bits of the filter that tells which rows a second pass over the texts has to prepare; it goes to every executor.
FILTER_BITS = 1 << 23
#: Bits of it that are put together in one row.
WORD_BITS = 1 << 15
#: Least and most bits of a parity sketch; nodes of a key that are compared at once.
CELLS, MOST_CELLS, BLOCK = 256, 8192, 1024


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable by links (a, b). Distributed: in each round every
    root hooks onto its smallest neighbour, chains are shortened by pointer jumping, and links are contracted."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or edges.limit(1).count():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        moved = True
        while moved:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            again = jumped.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = cut(jumped.join(again, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("moved") & F.col("above").isNotNull()).alias("moved")))
            moved = bool(jumped.where("moved").limit(1).count())
            hooks = jumped.select("node", "root")
        labels = hooks if labels is None else _compose(labels, hooks)
        ends = edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(hooks.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        edges = cut(ends.select(F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).where("a <> b").distinct())
    return labels


def _compose(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return cut(moved.unionByName(hooks))


def _by_group(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the columns, which the rows are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        ids = np.stack([table[c].to_numpy() for c in columns])
        starts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1]).tolist() if table.num_rows else [0]
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(at, end - at)
        held = table.slice(starts[-1]).to_batches()
    if held and held[0].num_rows:
        yield pa.Table.from_batches(held)


def _across(num: int, den: int, once: bool):
    """Pairs of a block whose roots differ and whose sketches allow the similarity num / den. once: only under the smallest key that both share (all_keys ascend)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for table in _by_group(batches, ["key", "i", "j"]):
            node, root, side, n = (table[c].to_numpy() for c in ("node", "root", "block", "n"))
            i, j, hub = table["i"][0].as_py(), table["j"][0].as_py(), table["hub"][0].as_py()
            if (root == root[0]).all() or len(node) == 2 and hub in node:
                continue
            bits = aligned(table["bits"].to_pylist())
            own, key = [set(k) for k in table["all_keys"].to_pylist()] if once else [], table["key"][0].as_py()
            roots, sizes = np.unique(root, return_counts=True)
            main = roots[np.argmax(sizes)]
            for x in np.flatnonzero((root != main) & (node != hub)):
                ok = (root != root[x]) & (node != hub) & ((root == main) | (node > node[x]))
                if i != j:
                    ok &= side != side[x]
                ok &= den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x])
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[may_link(bits[at], bits[x], n[at], n[x], num, den)]
                    if once:
                        at = np.array([y for y in at.tolist() if min(own[x] & own[y]) == key], dtype=np.int64)
                    me = int(node[x])
                    out.update((me, y) if me < y else (y, me) for y in node[at].tolist())
            if len(out) > 100_000:
                yield _pairs(out)
                out = set()
        yield _pairs(out)

    return find


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"a": both[:, 0].copy(), "b": both[:, 1].copy()})


def connect(keys: DataFrame, prepare: Callable[[DataFrame], Store], num: int, den: int, central: bool = True, once: bool = False) -> DataFrame:
    """(node, root) for all nodes with a verified link of similarity num / den. keys: (key, node), repeats allowed; prepare: nodes (node) that share a key -> Store.
    central: the hub of a key is its node that shares most, else its smallest. once: nodes have few keys, so a pair is tested under one of them alone."""
    same = W.partitionBy("key")
    met = keys.select("key", "node", F.min("node").over(same).alias("hub"), F.max("node").over(same).alias("high"), F.count("*").over(same).alias("others"))
    shared = cut(met.where("hub <> high").select("key", "node", "hub", "others").distinct())
    if central:
        rank = shared.groupBy("node").agg(F.sum("others").alias("rank"))
        hubs = shared.select("key", "node").join(rank, "node").groupBy("key").agg(F.min(F.struct(-F.col("rank"), "node"))["node"].alias("hub"))
        shared = cut(shared.drop("hub").join(hubs, "key"))
    store = prepare(shared.select("node").distinct())
    tied = shared.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = cut(store.verify(tied))
    roots = components(links)
    placed = shared.where("others > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = cut(placed.join(open_keys, "key", "left_semi"))
    traits = store.traits(left.select("node").distinct())
    if once:
        traits = traits.join(left.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("all_keys")), "node")
    dealt = left.join(traits, "node")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("others") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.select("key", "i", "j", "node", "root", "hub", "block", "n", "bits", *(["all_keys"] if once else [])).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = cut(dealt.mapInArrow(_across(num, den, once), "a long, b long").distinct())
    if not across.limit(1).count():
        return roots
    return components(links.unionByName(store.verify(across)))


@dataclass
class Store:
    """What is known of nodes: traits, (node) -> (node, n, bits), the size and parity sketch of their sets; verify: pairs (a, b) -> those that are linked."""

    traits: Callable[[DataFrame], DataFrame]
    verify: Callable[[DataFrame], DataFrame]


def sketch(hashes: np.ndarray) -> bytes:
    """For each cell whether an odd number of a set's 64-bit hashes fall into it; twice the cells for sets of over CELLS / 2, and so on.
    Two sets differ in at least as many features as their sketches do in bits."""
    cells = min(MOST_CELLS, max(CELLS, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def coarser(bits: bytes, size: int) -> bytes:
    """The sketch in `size` bytes: neighbouring cells are joined."""
    if len(bits) == size:
        return bits
    cells = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).reshape(8 * size, -1)
    return np.packbits((cells.sum(axis=1) & 1).astype(bool)).tobytes()


def aligned(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, in the size of the smallest."""
    size = min(map(len, sketches))
    return np.frombuffer(b"".join(coarser(x, size) for x in sketches), dtype=np.uint64).reshape(len(sketches), -1)


def may_link(bits: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m features with such sketches may have the similarity num / den."""
    differ = np.bitwise_count(bits ^ other).sum(axis=1, dtype=np.int64)
    return (den + num) * differ <= (den - num) * (n + m)


def row_filter(rows: DataFrame, hashes: Column) -> np.ndarray:
    """Bits of a column of 64-bit hashes, packed: a filter of fixed size without false negatives. Made on the executors, so that the driver gets bits, not rows."""
    schema = "word int, bits binary"
    marked = rows.select(F.pmod(hashes, F.lit(FILTER_BITS)).alias("at")).mapInArrow(_marked, schema)
    words = marked.repartition(per_task(rows.sparkSession), "word").mapInArrow(_merged, schema)
    packed = np.zeros((FILTER_BITS // WORD_BITS, WORD_BITS // 8), dtype=np.uint8)
    for r in words.collect():
        packed[r.word] = np.frombuffer(r.bits, dtype=np.uint8)
    return packed.reshape(-1)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for batch in batches:
        bits[batch.column(0).to_numpy()] = True
    packed = np.packbits(bits).reshape(-1, WORD_BITS // 8)
    yield _words({i: packed[i] for i in np.flatnonzero(packed.any(axis=1)).tolist()})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(bits, dtype=np.uint8)
            found[word] = found[word] | new if word in found else new
    yield _words(found)


def _words(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(found, pa.int32()), "bits": pa.array([x.tobytes() for x in found.values()], pa.binary())})


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.mod(hashes, FILTER_BITS)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
