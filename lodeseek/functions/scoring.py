"""Scores and distances, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.schema import K1, RRF_K, B


def bm25(tf: Column, doc_len: Column, avg_doc_len: Column, n_docs: Column, doc_freq: Column) -> Column:
    """BM25 with k1 = 1.2 and b = 0.75; 0 where there is no document, or none with the term."""
    idf = F.log((n_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1.0)
    norm = (1.0 - B) + B * doc_len / avg_doc_len
    return F.when((doc_freq == 0) | (n_docs == 0), 0.0).otherwise(idf * (tf * (K1 + 1.0)) / (tf + K1 * norm))


def vector(values: Sequence[float]) -> Column:
    """A literal array of doubles."""
    return F.array(*[F.lit(float(x)) for x in values])


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def l2_squared(a: Column, b: Column) -> Column:
    """The sum of squared differences; no root is taken."""
    return _fold(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def normalized(a: Column) -> Column:
    """a over its length; a zero vector as it is."""
    v = a.cast("array<double>")
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def rrf_score(rank: Column) -> Column:
    """Of the place in a list, from 1."""
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank)
