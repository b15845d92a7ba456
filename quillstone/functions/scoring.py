"""Ranking functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of BM25 and of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(idf_: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    norm = 1 - B + B * doc_len / F.greatest(avg_len, F.lit(1.0))
    return idf_ * tf * (K1 + 1) / (tf + K1 * norm)


def rrf(rank0: Column) -> Column:
    """What a list gives to its entry of 0-based rank."""
    return 1.0 / (RRF_K + rank0 + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
