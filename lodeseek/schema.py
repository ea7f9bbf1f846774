"""Row types, constants and errors of the retrieval engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B, RRF_K = 1.2, 0.75, 60
#: Rows that k-means trains on at most, and rows per cluster by default.
TRAIN_ROWS, ROWS_PER_CLUSTER = 10_000, 10_000
#: Rows that a cluster has in the sample at least, where the sample must grow for that.
TRAIN_ROWS_PER_CLUSTER = 40

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("attributes", ATTRIBUTES)])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("attributes", ATTRIBUTES)])
HIT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
POSTING = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("tf", T.LongType()), T.StructField("doc_len", T.LongType())])


class IndexFault(Exception):
    """Any error of an index."""


class NotFound(IndexFault):
    """No index is stored there, or it was never finished."""


class EmptyIndex(IndexFault, ValueError):
    """There is no document to index."""


class DuplicateId(IndexFault, ValueError):
    """Two documents have one id."""


class DimensionMismatch(IndexFault, ValueError):
    """Embeddings, or a query and the index, differ in length."""


class StorageFault(IndexFault, OSError):
    """The store answered with an error of its own, such as a denied access."""


class InvalidDocument(IndexFault, ValueError):
    """A document lacks an id, or its embedding is null, or holds a null or a number that isn't finite."""


def validate(docs: DataFrame, dim: int) -> int:
    """Counts docs, and raises what is wrong with them. One pass for the rows, one shuffle of ids for duplicates."""
    e = F.col("embedding")
    bad = F.col("doc_id").isNull() | e.isNull() | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = docs.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.size(e) != dim).alias("other")).first()
    if not seen["n"]:
        raise EmptyIndex("no documents to index")
    if seen["bad"]:
        raise InvalidDocument(f"{seen['bad']} documents have no id, or an embedding with a null or non-finite number")
    if seen["other"]:
        raise DimensionMismatch(f"{seen['other']} embeddings aren't of length {dim}")
    twice = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id").limit(5).collect()
    if twice:
        raise DuplicateId(f"repeated ids, such as {[r[0] for r in twice]}")
    return seen["n"]
