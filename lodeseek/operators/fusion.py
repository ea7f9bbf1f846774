"""Reciprocal rank fusion, and hybrid search on top of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import rrf_score
from lodeseek.operators.ranking import ranked, top_k, top_k_by


def rrf_fuse(lists: list[DataFrame], k: int, by: str | None = None) -> DataFrame:
    """The k best of lists (doc_id, rank, and ``by`` where there are many queries), by the sum of 1 / (60 + rank).

    A union and one aggregation; a document that a list lacks adds nothing."""
    keys = [by] if by else []
    rows = reduce(DataFrame.unionByName, [x.select(*keys, "doc_id", "rank") for x in lists])
    fused = rows.groupBy(*keys, "doc_id").agg(F.sum(rrf_score(F.col("rank"))).alias("score"))
    return top_k_by(fused, by, k) if by else top_k(fused, k)


def fuse_hybrid(lexical: DataFrame, vector: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Fuses two lists of hits (doc_id, score): each is to hold its best 2 * k."""
    return rrf_fuse([ranked(lexical, by), ranked(vector, by)], k, by)
