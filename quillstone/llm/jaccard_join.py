"""N-gram Jaccard join by PartEnum signatures.

Sets are grouped into bands of like size. Two sets of a Jaccard similarity t or more lie in the same or
neighbouring bands and differ in at most k features, k fixed by the band. The feature domain is cut into
first-level parts, so many that some part holds at most k2 of the differences, and each part into n2
second-level parts: among its subsets of n2 - k2 of them one is free of differences. A signature is the
features of one such subset, so similar sets share a signature. Signatures that cover no feature are
left out while the remaining ones still give that guarantee.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, slices, whole_row
from .linkage import Store, aligned, connect, may_link, passes, row_filter, sketch
from .shingles import mixed, shingle_set

#: Differences up to which parts are cut in three rather than two (longer signatures, more of them).
FINE = 40
FEATURES = "doc_id long, n_shingles long, node long, check long, bits binary, keys array<long>"


def _signed(number: int) -> int:
    """The low 64 bits as a signed number."""
    return ((number & (2**64 - 1)) ^ 2**63) - 2**63


class Bands:
    """Size bands for similarity num/den; bands[i] = (first, last)."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bands = num, den, [(1, den // num)]

    def band(self, size: int) -> int:
        while self.bands[-1][1] < size:
            first = self.bands[-1][1] + 1
            self.bands.append((first, first * self.den // self.num))
        low, high = 0, len(self.bands) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if size <= self.bands[mid][1] else (mid + 1, high)
        return low

    def differences(self, band: int) -> int:
        """Most differences of two similar sets of which the larger is in the band."""
        self.band(self.bands[-1][1] + 1 if band >= len(self.bands) else 1)
        return (self.den - self.num) * 2 * self.bands[band][1] // (self.den + self.num)


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set of at least one feature (ascending 64-bit hashes): for its band, and for the next above, whose sets it may match."""
    band, out = bands.band(len(features)), []
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(features + np.uint64(1)), dtype=np.uint64)])
    for family in (band, band + 1):
        k = bands.differences(family)
        if k == 0:
            continue  # only equal sets are similar there, and those are one node
        n2, k2 = (3, 1) if k < FINE else (2, 1)
        least = k // (k2 + 1) + 1  # of so many parts one holds at most k2 differences
        spare = max(1, least // 16)
        n1 = least + spare
        cuts = (np.arange(1, n1 * n2, dtype=np.float64) * (2.0**64 / (n1 * n2))).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(features, cuts), [len(features)]])
        sums, counts = (run[at[1:]] - run[at[:-1]]).reshape(n1, n2), np.diff(at).reshape(n1, n2)
        keys, full = [], []
        for j, chosen in enumerate(combinations(range(n2), n2 - k2)):
            part = sums[:, chosen].sum(axis=1, dtype=np.uint64)
            place = np.arange(n1, dtype=np.uint64) * np.uint64(8) + np.uint64(j) + np.uint64(family << 40)
            keys.append(mixed(part + mixed(place)))
            full.append(counts[:, chosen].sum(axis=1) > 0)
        keys, full = np.stack(keys, axis=1), np.stack(full, axis=1)
        enough = (~full).any(axis=1).sum() <= spare
        out.append(keys[full] if enough else keys.reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def features(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per row: set size, node (hash of the set; null where empty), a second hash, parity sketch and signatures (null where the task has met the set before)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, met = Bands(num, den), set()
        for batch in slices(batches):
            cols: dict = {c: [] for c in ("n", "node", "check", "bits", "keys")}
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                node = check = bits = keys = None
                if len(s):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    node, check = _signed(whole), _signed(whole >> 64)
                    bits = sketch(s)
                    if whole not in met:
                        met.add(whole)
                        keys = np.unique(signatures(s, bands)).view(np.int64)
                for c, v in zip(cols, (len(s), node, check, bits, keys), strict=True):
                    cols[c].append(v)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "n_shingles": pa.array(cols["n"], pa.int64()), "node": pa.array(cols["node"], pa.int64()), "check": pa.array(cols["check"], pa.int64()),
                    "bits": pa.array(cols["bits"], pa.binary()), "keys": pa.array(cols["keys"], pa.list_(pa.int64())),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(make, FEATURES)


def _near(num: int, den: int):
    """Pairs whose sizes and sketches allow the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(*np.split(aligned([x, y]), 2), n, m, num, den)[0] for x, y, n, m in zip(*(b[c].to_pylist() for c in ("xa", "xb", "na", "nb")), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b", "da", "db"])

    return keep


def _linked(num: int, den: int):
    """Pairs whose sets have the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = []
            for x, y in zip(b["xa"].to_pylist(), b["xb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return keep


def _sets(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """node, check and set of the documents that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chosen = batch.filter(pa.array(passes(sent.value, batch.column(0).to_numpy(zero_copy_only=False))))
            nodes, checks, sets = [], [], []
            for text in chosen.column(1).to_pylist():
                s = shingle_set(text, width)
                if len(s):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    nodes.append(_signed(whole))
                    checks.append(_signed(whole >> 64))
                    sets.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "check": pa.array(checks, pa.int64()), "features": pa.array(sets, pa.binary())})

    return docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(make, "node long, check long, features binary")


def _told_apart(rows: DataFrame, twins: DataFrame | None) -> DataFrame:
    """rows (node, check) with another node where the set shares its 64 bits with one of a smaller check. twins: (node, low)."""
    if twins is None:
        return rows
    other = F.when(F.col("check") != F.col("low"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(twins, "node", "left").withColumn("node", other).drop("low")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Rows link when den * |both| >= num * |either| of their shingle sets; component_id is the smallest doc_id
    that links reach. Equal sets link; a null, empty or blank text has no shingles and is its own component; repeated
    rows share a component; a null doc_id takes part but is never the smallest unless alone; an empty table gives none. Other
    columns are not read.
    """
    found = cut(features(docs, width, num, den))

    def sets_of(rows: DataFrame) -> DataFrame:
        return cut(rows.where("node is not null").groupBy("node").agg(
            F.min("n_shingles").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.max("bits").alias("bits"), F.min("doc_id").alias("doc")
        ))

    nodes, twins = sets_of(found), None
    if nodes.where("low <> high").limit(1).count():  # sets that share 64 of their 128 bits are told apart by the other 64
        twins = cut(nodes.where("low <> high").select("node", "low"))
        found = cut(_told_apart(found, twins))
        nodes = sets_of(found)
        if nodes.where("low <> high").limit(1).count():
            raise RuntimeError("two shingle sets share all 128 bits of their hashes")

    def verify(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("doc").alias("da"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("doc").alias("db"))
        sized = pairs.join(a, "a").join(b, "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
        near = cut(sized.select("a", "b", "na", "nb", "xa", "xb", "da", "db").mapInArrow(_near(num, den), "a long, b long, da long, db long"))
        wanted = row_filter(near.select(F.col("da").alias("d")).union(near.select("db")), F.xxhash64("d"))
        sets = _told_apart(_sets(docs, wanted, width), twins)
        ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        sets = cut(sets.join(ends, "node", "left_semi").dropDuplicates(["node"]))
        xa = sets.select(F.col("node").alias("a"), F.col("features").alias("xa"))
        xb = sets.select(F.col("node").alias("b"), F.col("features").alias("xb"))
        return near.select("a", "b").join(xa, "a").join(xb, "b").select("a", "b", "xa", "xb").mapInArrow(_linked(num, den), "a long, b long")

    keys = found.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    roots = connect(keys, lambda _: Store(lambda wanted: nodes.select("node", "n", "bits").join(wanted, "node", "left_semi"), verify), num, den)
    rows = found.where("node is not null").select("doc_id", "n_shingles", "node").join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    first = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    empty = found.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.join(first, "root").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for those linked to a row of a smaller doc_id; of rows of equal id and text one stays, whichever. All columns are returned, whatever
    their names. Rows of null id stay, as do null, empty and blank texts; an empty table gives none."""
    groups = cut(jaccard_components(docs, width, num, den))
    gone = groups.where("n_shingles > 0 and component_id < doc_id").select("doc_id").distinct()
    kept = docs.select("doc_id", F.xxhash64("text").alias("text_key"), whole_row(docs)).join(gone, "doc_id", "left_anti")
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a similarity of 0.85."""
    return jaccard_components(documents(spark, sf_dir), width=4, num=85, den=100)


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), k AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM k JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM documents AS d JOIN least ON least.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
