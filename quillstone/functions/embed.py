"""Embedders: what turns texts into vectors."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chunk_windows, tokens


class Embedder(Protocol):
    """One model per store: its name and number of dimensions are written down with the store."""

    id: str
    dims: int

    def embed(self, texts: pd.Series) -> pd.Series:
        """A vector (list of float) for each text; an empty text gives zeros."""


class HashingEmbedder:
    """Signed feature hashing of words, unit length: deterministic, without a model."""

    def __init__(self, dims: int = 64):
        self.id, self.dims = f"hashing-{dims}", dims

    def embed(self, texts: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for text in texts:
            v = np.zeros(self.dims)
            for word in (text or "").split():
                h = xxhash.xxh3_64_intdigest(word)
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            norm = np.sqrt((v * v).sum())
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out)


class PrecomputedEmbedder:
    """Vectors that are known beforehand, by text; any other text is an error. Sent to the executors with the plan, so the table has to be small."""

    def __init__(self, id: str, vectors: dict[str, list[float]]):
        self.id, self.vectors = id, vectors
        self.dims = len(next(iter(vectors.values()), []))
        if any(len(v) != self.dims for v in vectors.values()):
            raise ValueError("vectors of one embedder have one length")

    def embed(self, texts: pd.Series) -> pd.Series:
        lost = [t for t in texts if t and t not in self.vectors]
        if lost:
            raise ValueError(f"no vector for {lost[0]!r}")
        return pd.Series([self.vectors[t] if t else [0.0] * self.dims for t in texts])


def embed(self, texts: pd.Series) -> pd.Series:
        """A vector (list of float) for each text; an empty text gives zeros."""


class HashingEmbedder:
    """Signed feature hashing of words, unit length: deterministic, without a model."""

    def __init__(self, dims: int = 64):
        self.id, self.dims = f"hashing-{dims}", dims

    def embed(self, texts: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for text in texts:
            v = np.zeros(self.dims)
            for word in (text or "").split():
                h = xxhash.xxh3_64_intdigest(word)
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            norm = np.sqrt((v * v).sum())
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out)


class WordAxisEmbedder:
    """One axis per group of words that mean the same; for tests."""

    def __init__(self, groups: list[set[str]]):
        self.id, self.dims, self.groups = "word-axis", len(groups), groups

    def embed(self, texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.array([float(sum(w in g for w in (text or "").lower().split())) for g in self.groups])
            norm = np.sqrt((v * v).sum())
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out)


def embed(embedder: Embedder, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return embedder.embed(texts)

    return run(text)


def first_window(text: Column) -> Column:
    """What of a query is embedded: its first window of tokens."""
    return F.array_join(F.get(chunk_windows(tokens(text)), F.lit(0)), " ")
