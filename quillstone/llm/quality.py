"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (A-Z lower-cased, hashed) and its byte 2- and 3-grams with letters, digits and other signs
folded; shares of a few surface traits stand beside them. Terms are weighted by inverse document frequency over a bounded sample of
labelled documents and projected onto the sample's leading singular vectors. Every document is compared
with all labelled vectors (exact cosines, block by block); its nearest neighbours vote for their labels,
weighted by similarity and by how rare the label is. A labelled text never votes on itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .class_lm import held_out
from .common import documents
from .shingles import mixed

#: Labelled documents of each label that are kept (chosen by a hash of the id), dimensions, neighbours, sharpness of the vote, texts compared at once.
PER_LABEL, DIMENSIONS, NEIGHBOURS, POWER, TILE = 2000, 64, 25, 8.0, 512
#: Features: hashed words, hashed grams, traits; what each kind weighs.
WORDS, GRAMS, TRAITS = 2048, 2048, 12
KINDS = ((slice(0, WORDS), 0.5), (slice(WORDS, WORDS + GRAMS), 1.0), (slice(WORDS + GRAMS, WORDS + GRAMS + TRAITS), 1.0))
WIDTH = WORDS + GRAMS + TRAITS


def _classes() -> np.ndarray:
    """Byte -> class: letters by case, digits, line ends, other white space, and each ASCII sign; bytes above 127 as small letters."""
    of = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b > 127 or c.islower():
            of[b] = 1
        elif c.isupper():
            of[b] = 2
        elif c.isdigit():
            of[b] = 3
        elif c == "\n":
            of[b] = 4
        elif c.isspace() or b < 32:
            of[b] = 5
        else:
            of[b] = b  # signs 33 to 126 keep their own number
    return of


_CLASS = _classes()


def _factors() -> np.ndarray:
    """What a byte at each place of a word is multiplied by; places beyond the last share it."""
    return np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


_FACTOR = _factors()


def word_buckets(raw: bytes) -> np.ndarray:
    """Bucket of each word, in order."""
    b = np.frombuffer(raw.lower(), dtype=np.uint8)
    inside = np.flatnonzero((b != 32) & ((b < 9) | (b > 13)))
    if not len(inside):
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
    h = np.add.reduceat((b[inside].astype(np.uint64) + np.uint64(1)) * _FACTOR[np.minimum(place, 63)], first)
    return (mixed(h) % np.uint64(WORDS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Weights of words and grams and shares of traits of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, dtype=np.float32)
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    n = len(c)
    two, three = c[:-1] * 131 + c[1:], (c[:-2] * 131 + c[1:-1]) * 131 + c[2:]
    grams = np.bincount((two * 40503 >> 4) % GRAMS, minlength=GRAMS) + np.bincount((three * 2654435761 >> 12) % GRAMS, minlength=GRAMS)
    out[WORDS : WORDS + GRAMS] = np.log1p(grams * (1000.0 / n))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    m = max(len(words), 1)
    out[:WORDS] = np.log1p(np.bincount(word_buckets(raw), minlength=WORDS) * (200.0 / m))
    kinds = np.bincount(np.minimum(c, 6), minlength=7) / n
    pairs = list(zip(words[:-1], words[1:], strict=False))
    out[WORDS + GRAMS :] = [
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6] + kinds[0], 1 - len(set(words)) / m, 1 - len(set(pairs)) / max(len(pairs), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(a == b for a, b in pairs) / m, min(n / m, 30.0) / 30, min(np.log10(m), 4) / 4,
    ]
    return out


def text_keys(texts: list[str | None]) -> np.ndarray:
    """What tells whether two texts are the same; null is an empty text."""
    return np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.uint64)


def _scaled(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted rows of unit length."""
    flat = rows * idf
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
    return flat


@dataclass
class Space:
    """idf of the features, projection, labelled vectors (unit length), the keys of their texts and the weight of each one's vote."""

    idf: np.ndarray
    basis: np.ndarray
    bank: np.ndarray
    keys: np.ndarray
    good: np.ndarray
    weight: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = _scaled(rows, self.idf) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, rows: np.ndarray, keys: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Score of each row: the share of its neighbours' votes for label 1; equal texts (keys) are no neighbours. Without neighbours 0.5."""
        if not len(self.bank):
            return np.full(len(rows), 0.5)
        near = self.project(rows) @ self.bank.T
        near[keys[:, None] == self.keys] = -np.inf
        k = min(neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(near, at, axis=1)
        votes = np.where(np.isfinite(close), np.maximum(close, 1e-3) ** POWER, 0.0) * self.weight[at]
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes * self.good[at]).sum(axis=1) / np.where(total > 0, total, 1.0), 0.5)


def leading(flat: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of rows, by subspace iteration from a fixed start."""
    wide = min(dimensions + 16, *flat.shape)
    q = np.random.default_rng(3).normal(size=(flat.shape[1], wide)).astype(np.float32)
    for _ in range(6):
        q = np.linalg.qr(flat.T @ (flat @ q))[0].astype(np.float32)
    turn = np.linalg.svd(flat @ q, full_matrices=False)[2]
    return q @ turn.T[:, :dimensions]


def fit(rows: np.ndarray, good: np.ndarray, keys: np.ndarray, share: float, dimensions: int = DIMENSIONS) -> Space:
    """share: of label 1 among all labelled documents; votes are weighted so that the sample stands for them."""
    if not len(rows):
        return Space(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), keys, good, good)
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    idf[KINDS[2][0]] *= 3.0
    for kind, weight in KINDS[:2]:
        idf[kind] *= weight
    flat = _scaled(rows, idf)
    basis = leading(flat, dimensions).astype(np.float32)
    bank = flat @ basis
    bank /= np.maximum(np.linalg.norm(bank, axis=1, keepdims=True), 1e-9)
    in_sample = good.mean()
    weight = np.where(good == 1, share / max(in_sample, 1e-9), (1 - share) / max(1 - in_sample, 1e-9))
    return Space(idf, basis, bank.astype(np.float32), keys, good.astype(np.float32), weight.astype(np.float32))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        rows = [features(t).tobytes() for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "label": batch.column(1), "key": pa.array(text_keys(texts).view(np.int64)), "features": pa.array(rows, pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Space:
    """From docs (doc_id, text) with labels (doc_id, label 0 or 1): at most per_label documents of each label, drawn by a hash of the id.
    Of ids labelled twice the higher label counts; repeated rows of an id all come into the sample; null ids and ids without a document
    have no label; without any the space is empty. Other columns are not read."""
    labels = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = docs.select("doc_id").distinct().join(labels, "doc_id").withColumn("order", F.xxhash64("doc_id", F.lit(11)))
    chosen, n = None, {}
    for label in (0, 1):
        of = labelled.where(F.col("label") == label)
        n[label] = of.count()
        some = of.orderBy("order", "doc_id").limit(per_label).select("doc_id", "label")
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label ids
    once = sample.dropDuplicates(["doc_id", "text"]) if n[0] + n[1] else sample
    got = once.select("doc_id", "label", "text").mapInArrow(_measure, "doc_id long, label int, key long, features binary").toArrow()
    keys, order = got["key"].to_numpy(), np.lexsort((got["key"].to_numpy(), got["doc_id"].to_numpy()))  # the same in every run
    good, wide = got["label"].to_numpy()[order].astype(np.float32), got["features"]
    rows = np.empty((len(order), WIDTH), np.float32)
    for to, at in enumerate(order.tolist()):
        rows[to] = np.frombuffer(wide[at].as_buffer(), dtype=np.float32)
    return fit(rows, good, keys[order].view(np.uint64), n[1] / max(n[0] + n[1], 1))


def rate(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text). A null text scores as an empty one; repeated rows score alike; null ids stay
    null; an empty table gives none; the other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                texts = part.column(1).to_pylist()
                found = sent.value.vote(np.stack([features(t) for t in texts]), text_keys(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(np.clip(found, 0, 1).astype(float))})

    return docs.select("doc_id", "text").mapInArrow(scores, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents, learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs, held = documents(spark, sf_dir), held_out(5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = rate(docs, learn(docs.where(~held), labels))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
