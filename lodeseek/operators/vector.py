"""k-means and search in its clusters.

Centroids are held on the driver and broadcast: one for about 10,000 rows, so 100,000 for a thousand million. More than
CENTROID_BYTES of them raise: ask for fewer clusters. The sample that they are trained on has 40 rows a cluster at least.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import l2_squared, similarity, vector
from lodeseek.operators.ranking import small, top_k, top_k_by
from lodeseek.schema import ROWS_PER_CLUSTER, TRAIN_ROWS, TRAIN_ROWS_PER_CLUSTER, DimensionMismatch

#: Numbers of all tasks' sums that the driver adds up at most, 16 MB.
PARTIAL_NUMBERS = 2_000_000
#: Bytes of centroids that are broadcast at most.
CENTROID_BYTES = 1 << 30


def cluster_count(n: int, per_cluster: int = ROWS_PER_CLUSTER) -> int:
    return max(-(-n // per_cluster), 2)


def training_rows(vectors: DataFrame, most: int | None = TRAIN_ROWS, seed: int = 7, k: int = 0) -> DataFrame:
    """All rows up to ``most``; beyond it the ``most`` with the least hash of their id. None: all. For k clusters, most is
    TRAIN_ROWS_PER_CLUSTER * k at least."""
    most = most and max(most, TRAIN_ROWS_PER_CLUSTER * k)
    if most is None or len(vectors.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most:
        return vectors
    return vectors.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def nearest(x: np.ndarray, centroids: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """The place of the nearest centroid of each row by the sum of squared differences; the first of equals.

    Products find the centroids that rounding leaves in question, for most rows one; the sum decides among them."""
    out = np.empty(len(x), np.int64)
    norms = (centroids**2).sum(axis=1)
    block = max(1, cells // max(1, len(centroids)))
    for at in range(0, len(x), block):
        part = x[at : at + block]
        own = (part**2).sum(axis=1)
        d = own[:, None] - 2 * part @ centroids.T + norms
        near = d <= (d.min(axis=1) + 1e-10 * (own + norms.max()))[:, None]
        to = near.argmax(axis=1)
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            some = np.flatnonzero(near[i])
            to[i] = some[((part[i] - centroids[some]) ** 2).sum(axis=1).argmin()]
        out[at : at + block] = to
    return out


def kmeans(vectors: DataFrame, k: int, iterations: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Lloyd's centroids, started from the k rows with the least doc_id.

    Ends when every centroid moved by at most ``tolerance`` (squared); one without rows stays where it was. Each task
    sends a sum and a count a cluster, whatever its rows; beyond PARTIAL_NUMBERS those are added up by cluster before the
    driver gets them."""
    if k < 1:
        raise ValueError("at least one cluster is needed")
    rows = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v")).persist()
    try:
        first = [r["v"] for r in rows.orderBy("doc_id").limit(k).collect()]
        if not first:
            return np.zeros((0, 0))
        centroids = np.array(first, float)
        if centroids.nbytes > CENTROID_BYTES:
            raise ValueError(f"{k} centroids of {centroids.shape[1]} numbers are more than is broadcast")
        # Few enough numbers from all tasks are added up by the driver; more by tasks first, so that it gets a row a cluster.
        few = rows.rdd.getNumPartitions() * centroids.size <= PARTIAL_NUMBERS
        for _ in range(iterations):
            shared = rows.sparkSession.sparkContext.broadcast(centroids)

            def sums(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                c = shared.value
                total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
                for part in parts:
                    if len(part):
                        x = np.vstack(part["v"].to_numpy())
                        to = nearest(x, c)
                        np.add.at(total, to, x)
                        count += np.bincount(to, minlength=len(c))
                some = np.flatnonzero(count)
                if len(some):
                    yield pd.DataFrame({"c": some, "n": count[some], "s": list(total[some])})

            found = rows.select("v").mapInPandas(sums, "c long, n long, s array<double>")
            if not few:
                found = found.select("c", "n", F.posexplode("s").alias("at", "x")).groupBy("c", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
                found = found.groupBy("c").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s")).select("c", "n", F.col("s.x").alias("s"))
            new, some = centroids.copy(), found.toArrow()
            if len(some):
                total, count = np.zeros(new.shape), np.zeros(len(new))
                np.add.at(total, some["c"].to_numpy(), some["s"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1))
                np.add.at(count, some["c"].to_numpy(), some["n"].to_numpy())
                new[count > 0] = total[count > 0] / count[count > 0, None]
            moved = ((new - centroids) ** 2).sum(axis=1).max()
            centroids = new
            shared.unpersist()
            if moved <= tolerance:
                break
        return centroids
    finally:
        rows.unpersist()


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with the cluster_id of the nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.vstack(v.to_numpy()), shared.value) if len(v) else [], dtype="int32")

    return vectors.withColumn("cluster_id", F.pandas_udf(run, "int")(F.col("embedding").cast("array<double>")))


def probed(query: Sequence[float], centroids: np.ndarray, n_probe: int) -> list[int]:
    """The n_probe nearest clusters, nearest first, equals by number; all if there are fewer."""
    if not len(centroids) or n_probe <= 0:
        return []
    if len(query) != centroids.shape[1]:
        raise DimensionMismatch(f"the query has {len(query)} numbers, the index {centroids.shape[1]}")
    d = ((centroids - np.asarray(query, float)) ** 2).sum(axis=1)
    return np.argsort(d, kind="stable")[:n_probe].tolist()


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, clusters: list[int] | None = None) -> DataFrame:
    """doc_id, score of the k nearest; clusters limits the search to those, which prunes a table laid out by cluster_id."""
    rows = vectors if clusters is None else vectors.filter(F.col("cluster_id").isin(clusters)) if clusters else vectors.limit(0)
    return top_k(rows.select("doc_id", similarity(l2_squared(F.col("embedding"), vector(query))).alias("score")), k)


def probes(queries: DataFrame, centroids: np.ndarray, n_probe: int) -> DataFrame:
    """queries (query_id, embedding) with a row for each cluster to search."""
    shared = queries.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(v: pd.Series) -> pd.Series:
        return pd.Series([probed(x, shared.value, n_probe) for x in v])

    near = F.pandas_udf(run, "array<int>")(F.col("embedding").cast("array<double>"))
    return queries.withColumn("cluster_id", F.explode(near))


def vector_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, centroids: np.ndarray | None = None, n_probe: int = 0, per_task: int = 4096) -> DataFrame:
    """query_id, rank, doc_id, score for queries (query_id, embedding).

    Without centroids every vector is compared, in blocks: queries are hashed into blocks that fit a task, each block is
    sent to each part of the vectors, and a task returns k rows a query. With centroids (and vectors' cluster_id) only
    vectors of the n_probe nearest clusters meet a query, by an equi-join."""
    if centroids is not None:
        asked = small(probes(queries, centroids, n_probe).select("query_id", "cluster_id", F.col("embedding").alias("q")))
        rows = vectors.join(asked, "cluster_id")
        return top_k_by(rows.select("query_id", "doc_id", similarity(l2_squared(F.col("embedding"), F.col("q"))).alias("score")), "query_id", k)
    n, m = queries.count(), vectors.count()
    blocks, parts = max(1, -(-n // per_task)), max(1, -(-m // (16 * per_task)))
    left = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    right = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values("doc_id", ignore_index=True)
            x, ids = np.vstack(v["v"].to_numpy()), v["doc_id"].to_numpy()
            for query_id, y in zip(q["query_id"], q["q"]):
                score = np.round(1 / (1 + ((x - y) ** 2).sum(axis=1)), 12)
                at = np.flatnonzero(score >= np.partition(score, -k)[-k] - 1e-6) if 0 < k < len(score) else np.arange(len(score))
                out.append(pd.DataFrame({"query_id": query_id, "doc_id": ids[at], "score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(run, "query_id long, doc_id long, score double")
    return top_k_by(found, "query_id", k)
