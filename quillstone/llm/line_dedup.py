"""Fuzzy line deduplication by MinHash.

Every distinct line gets MinHash values of its character shingles; bands of them are the keys under
which lines meet. Lines that meet are verified by exact Jaccard similarity of their shingle sets, linked
lines form components by distributed union-find, and the first line of each component stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, slices, whole_row
from .linkage import Store, connect, passes, row_filter, sketch
from .shingles import mixed

#: Characters a shingle, least similarity as num/den, bands and MinHash values a band: at a similarity of 0.8 a pair meets with a chance of 0.998, at 0.85 of 0.9999.
SHINGLE, NUM, DEN, BANDS, ROWS = 7, 80, 100, 12, 4
#: Characters of lines given on at once; of those, how many are hashed at once, so that they stay in a core's cache.
CHUNK, CACHED = 1 << 20, 1 << 17


def line_hash(line: str) -> tuple[int, int]:
    """(node, check): 64 bits that lines are linked by, and 32 more that tell equal lines from others of the same node."""
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"), seed=7)
    return (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h >> 96) - (1 << 31)


def line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and checks of lines, as line_hash gives them."""
    digests = b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"), seed=7) for x in lines])
    h = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return (h[:, 1] ^ np.uint64(1 << 63)).view(np.int64), ((h[:, 0] >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32)


def _windows(code: np.ndarray, width: int) -> np.ndarray:
    """The polynomial of each window of `width` numbers, put together from windows of 1, 2, 4 and so on."""
    whole, done, part, size = None, 0, code, 1
    while True:
        if width & size:
            n = len(code) - done - size + 1
            whole, done = part if whole is None else part[:n] * _power(done) + whole[size : size + n], done + size
        if 2 * size > width:
            return whole
        n = len(code) - 2 * size + 1
        part, size = part[:n] * _power(size) + part[size : size + n], 2 * size


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def shingle_hashes(lines: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, line after line; how many each line has). A line shorter than a shingle is one shingle."""
    padded = [x.ljust(shingle, "\0") for x in lines]
    lengths = np.array([len(x) for x in padded], dtype=np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = _windows(code, shingle)
    ends, inside = np.cumsum(lengths), np.ones(len(code), dtype=bool)
    for i in range(1, shingle):
        inside[ends - i] = False
    return mixed(h[inside[: len(h)]]), lengths - shingle + 1


def min_hash_keys(lines: list[str], shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys of each line, (lines, bands)."""
    rng = np.random.default_rng(2024)
    factors, masks = rng.integers(1 << 20, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out, ends, at = np.zeros((len(lines), bands), dtype=np.uint64), np.cumsum([len(x) for x in lines]), 0
    while at < len(lines):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CACHED, side="right")))
        hashes, counts = shingle_hashes(lines[at:end], shingle)
        small, starts = (hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
        turned = np.empty_like(small)
        for b in range(bands):
            key = np.full(end - at, b + 1, dtype=np.uint64)
            for r in range(rows):
                np.bitwise_xor(small, masks[b * rows + r], out=turned)
                np.multiply(turned, factors[b * rows + r], out=turned)
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(turned, starts))
            out[at:end, b] = key
        at = end
    return out.view(np.int64)


def shingles_of(line: str, shingle: int = SHINGLE) -> set[str]:
    return {line[i : i + shingle] for i in range(max(1, len(line) - shingle + 1))}


def similar(a: str | set[str], b: str, num: int = NUM, den: int = DEN) -> bool:
    """Whether two lines' shingle sets have the similarity; the first may be given as its set."""
    x, y = a if isinstance(a, set) else shingles_of(a), shingles_of(b)
    both = len(x & y)
    return den * both >= num * (len(x) + len(y) - both)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def surely_similar(a: str, size: int, b: str, num: int = NUM, den: int = DEN, shingle: int = SHINGLE) -> bool:
    """Whether two lines' common start and end alone give them the similarity; size: that of a's shingle set. No shingle inside these
    is other than shared, and every other one takes at least one of the places between."""
    start = _common(a, b)
    end = _common(a[start:][::-1], b[start:][::-1])
    inside = max(0, start - shingle + 1) + max(0, end - shingle + 1)
    more_a, more_b = (max(1, len(x) - shingle + 1) - inside for x in (a, b))
    return den * (size - more_a) >= num * (size + more_b)


def _doc_key() -> Column:
    """Stands for a row: rows of equal id and text are one document."""
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, line_no, node and check (hashes) of every line with a word; keys where the task meets the node for the first time."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()

        def rows(of: list[tuple], counts: list[int], places: list[int], found: list[str]) -> pa.RecordBatch:
            nodes, checks = line_hashes(found)
            fresh, new = [], np.zeros(len(found), dtype=bool)
            for i, node in enumerate(nodes.tolist()):
                if node not in met:
                    met.add(node)
                    fresh.append(found[i])
                    new[i] = True
            flat = min_hash_keys(fresh).reshape(-1) if fresh else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(new * BANDS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~new, False)), pa.array(flat))
            each = pa.array(np.repeat(np.arange(len(of)), counts))
            ids, doc_keys = (pa.array([x[i] for x in of], pa.int64()).take(each) for i in range(2))
            return pa.RecordBatch.from_arrays([ids, doc_keys, pa.array(places, pa.int32()), pa.array(nodes), pa.array(checks), keys], names=["doc_id", "doc_key", "line_no", "node", "check", "keys"])

        for batch in slices(batches):
            of, counts, places, found, chars = [], [], [], [], 0
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                of.append((doc_id, key))
                counts.append(0)
                for at, line in enumerate((text or "").split("\n")):
                    if not line or line.isspace() and not line.strip(" \t\x0b\x0c\r"):
                        continue
                    counts[-1] += 1
                    places.append(at)
                    found.append(line)
                    chars += len(line)
                    if chars > CHUNK:
                        yield rows(of, counts, places, found)
                        of, counts, places, found, chars = [(doc_id, key)], [0], [], [], 0
            if found:
                yield rows(of, counts, places, found)

    return docs.select("doc_id", _doc_key().alias("doc_key"), "text").mapInArrow(make, "doc_id long, doc_key long, line_no int, node long, check int, keys array<long>")


def _wanted(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, check and line of the lines wanted (node); where different lines share a node, one of them."""
    sent = docs.sparkSession.sparkContext.broadcast(row_filter(nodes, F.col("node")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in slices(batches):
            lines = [line for text in batch.column(0).to_pylist() for line in (text or "").split("\n")]
            nodes, checks = line_hashes(lines)
            chosen = []
            for i in np.flatnonzero(passes(sent.value, nodes)).tolist():
                if (node := int(nodes[i])) not in met:
                    met.add(node)
                    chosen.append(i)
            yield pa.RecordBatch.from_pydict({"node": nodes[chosen], "check": checks[chosen], "line": pa.array([lines[i] for i in chosen], pa.string())})

    rows = docs.select("text").mapInArrow(make, "node long, check int, line string")
    return cut(rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, bits of lines (node, line)."""
    for batch in batches:
        sizes, bits = [], []
        for line in batch.column(1).to_pylist():
            hashes = np.unique(shingle_hashes([line])[0])
            sizes.append(len(hashes))
            bits.append(sketch(hashes))
        yield pa.RecordBatch.from_pydict({"node": batch.column(0), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _store(lines: DataFrame) -> Store:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for b in batches:
            ok = []
            for x, y in zip(b["xa"].to_pylist(), b["xb"].to_pylist(), strict=True):
                if x != last:  # rows of one hub come together
                    last, known = x, shingles_of(x)
                ok.append(surely_similar(x, len(known), y) or similar(known, y))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        xa = lines.select(F.col("node").alias("a"), F.col("line").alias("xa"))
        xb = lines.select(F.col("node").alias("b"), F.col("line").alias("xb"))
        return pairs.join(xb, "b").join(xa, "a").select("a", "b", "xa", "xb").mapInArrow(judge, "a long, b long")

    return Store(lambda wanted: lines.join(wanted, "node", "left_semi").select("node", "line").mapInArrow(_traits, "node long, n long, bits binary"), verify)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, line_no, node, root of every line whose component holds more than one line, and whether it stays (`first`)."""
    lines, texts = cut(_lines(docs)), []

    def prepare(nodes: DataFrame) -> Store:
        texts.append(_wanted(docs, nodes))
        return _store(texts[0])

    keys = lines.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    roots = connect(keys, prepare, NUM, DEN, central=False, once=True)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    roots = roots.join(texts[0].select("node", "check"), "node")  # the lines that were verified; others of the same node are not linked
    placed = lines.select("doc_id", "doc_key", "line_no", "node", "check").join(roots, ["node", "check"], "left")
    group = F.when(F.col("root").isNull(), F.col("check").cast("long")).otherwise(F.lit(1 << 32))  # unlinked lines are grouped by both hashes
    placed = placed.withColumn("own", group).withColumn("root", F.coalesce("root", "node")).drop("check")
    placed = placed.withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key", "line_no"))
    first = placed.groupBy("root", "own").agg(F.min("place").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    return placed.join(first, ["root", "own"]).select("doc_id", "doc_key", "line_no", "node", "root", (F.col("place") == F.col("best")).alias("first"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that repeat an earlier one taken out of `text`, and n_dropped, how many those are.

    Of each component of similar lines the first by (doc_id, text hash, line) stays; lines without a
    word always stay. A null or empty text has no lines and is returned as it is; rows of equal id and text are one document and come out alike; an
    empty table gives none; all other columns are passed through, but for one named n_dropped.
    """
    drops = repeated_lines(docs).where("not first").groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias("drop_at"))
    drops = drops.select(F.col("doc_id").alias("of"), "doc_key", "drop_at")
    keyed = docs.select("doc_id", _doc_key().alias("doc_key"), whole_row(docs)).alias("docs")
    joined = keyed.join(drops.alias("drops"), (F.col("docs.doc_key") == F.col("drops.doc_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    text = F.col("row.text")
    kept = F.when(F.col("drop_at").isNull(), text).otherwise(
        F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("drop_at", i)), "\n")
    )
    others = [c for c in docs.columns if c != "n_dropped"]
    return joined.select(*[(kept if c == "text" else F.col("row")[c]).alias(c) for c in others], F.coalesce(F.size("drop_at"), F.lit(0)).alias("n_dropped"))


def keep_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out and n_chars, where there is one, brought up to date; documents of which no line is left go. Nulls, ties and repeated
    rows as in dedup_lines; all columns are returned, whatever their names."""
    left = dedup_lines(docs.select(F.col("doc_id"), F.col("text"), whole_row(docs))).where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return left.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document: doc_id, n_lines (with a word, before), n_dropped, and the text."""
    kept = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0))  # from a line's first word to its end
    out = dedup_lines(documents(spark, sf_dir)).withColumn("n_lines", kept + F.col("n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text")
