"""Nearest neighbours by inner product with a vantage-point tree per shard.

Largest inner product is made nearest distance by one more coordinate: with M the largest norm of all vectors, x becomes
(x, sqrt(M**2 - |x|**2)) and a query (q, 0); then |q - x|**2 = |q|**2 + M**2 - 2 q.x. A tree splits its shard at the median
distance from a vantage point, and keeps the least and largest distance of each half. By the triangle inequality a half
can't hold anything nearer than bound = max(lo - d, d - hi, 0); it is skipped if bound * factor is beyond the query's
k-th best so far. ``factor`` 1 is exact; larger ones skip more, and may lose neighbours.

Shards are skipped in the same way. Vectors go to the nearest of some pivots (a sample by hash, one for ``per_shard``
vectors, MOST_PIVOTS at most, which bounds what is broadcast); a pivot with many more is split by a hash of the id, so a
pivot's share of all rows doesn't matter. A shard keeps the least and largest distance from its pivot. A query first
searches one shard of its nearest pivot; its k-th best there then decides which others it visits. Only those pairs of query
and shard are made, in blocks of about ``per_block`` queries of a shard, each with one copy of the tree. Every vector is in
the index. Where distances say next to nothing (many unrelated dimensions), nothing can be skipped, and the work is that of
queries times rows; ``costs`` tells what was visited.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths are never compared; rows with the query's id are not its candidates; repeated
candidates each have a row; rows that share a query's id are searched for each, and its list is the best of both, a
candidate counting once for each; equal scores go to the smaller id; fewer candidates than k give all; columns of other names
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodeseek.llm.common import Scratch, shards_for

FOUND = "qrow long, query_id long, shard int, vec_id long, score double, products long"
#: Pivots at most: they are broadcast.
MOST_PIVOTS = 8192
#: Recall and the share of inner products saved are in the README.
FACTOR = 1.1


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 512, seed: int = 3, most: float = 0.0):
        """most: the largest squared norm of all vectors; that of these if they have a larger one."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norms = (self.vectors**2).sum(axis=1)
        self.most = max(most, float(norms.max()))
        self.wide = np.hstack([self.vectors, np.sqrt(np.maximum(self.most - norms, 0))[:, None]])
        rng, place = np.random.default_rng(seed), []
        self.nodes: list[tuple] = []

        def split(at: np.ndarray) -> int:
            node = len(self.nodes)
            self.nodes.append(())
            if len(at) > leaf:
                # Of a few points, the one whose distances to a few others spread most.
                some, probe = rng.choice(at, min(8, len(at)), False), self.wide[rng.choice(at, min(64, len(at)), False)]
                point = self.wide[max(some, key=lambda i: float(np.var(self.gap(probe, self.wide[i]))))]
                d = self.gap(self.wide[at], point)
                by = np.argsort(d, kind="stable")
                half = len(at) // 2
                if d[by[0]] < d[by[-1]]:
                    near, far = at[by[:half]], at[by[half:]]
                    spans = (d[by[0]], d[by[half - 1]], d[by[half]], d[by[-1]])
                    self.nodes[node] = (point, spans, split(near), split(far))
                    return node
            # Equal points can't be split: one leaf, however many.
            self.nodes[node] = (len(place), len(place) + len(at))
            place.extend(at.tolist())
            return node

        split(np.arange(len(self.ids)))
        self.ids, self.vectors, self.wide = self.ids[place], self.vectors[place], None

    @staticmethod
    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=1), 0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best found a query (-1 for none), and how many inner products that took. known: each
        query's k-th best elsewhere; what can't be as good isn't sought."""
        norms = (queries**2).sum(axis=1)
        keep = k + 8  # for scores that differ only by the order of their sums
        best = np.full((len(queries), keep), -np.inf)
        place = np.full((len(queries), keep), -1, np.int64)
        scale = np.maximum(np.sqrt(norms * self.most), 1e-300)
        start = np.full(len(queries), -np.inf) if known is None else known / scale - 1e-12
        kth, worst = start.copy(), np.full(len(queries), -np.inf)
        done = 0
        self.products = np.zeros(len(queries), np.int64)

        def reach(q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norms[q] + self.most - 2 * kth[q] * scale[q], 0))

        def visit(node: int, q: np.ndarray) -> None:
            nonlocal done
            if len(self.nodes[node]) == 2:
                a, b = self.nodes[node]
                for at in range(a, b, 4096):
                    upto = min(b, at + 4096)
                    # Relative, and rounded: equal vectors score alike, whatever the order of the sums.
                    new = np.round(queries[q] @ self.vectors[at:upto].T / scale[q][:, None], 13)
                    done += new.size
                    self.products[q] += upto - at
                    new[query_ids[q][:, None] == self.ids[None, at:upto]] = -np.inf
                    # Only queries with something better than their worst are sorted.
                    r = np.flatnonzero(new.max(axis=1) >= worst[q])
                    if not len(r):
                        continue
                    scores = np.hstack([best[q[r]], new[r]])
                    where = np.hstack([place[q[r]], np.broadcast_to(np.arange(at, upto), (len(r), upto - at))])
                    where[np.isneginf(scores)] = -1
                    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    kept = np.take_along_axis(scores, top, 1)
                    for t in np.flatnonzero((scores >= kept.min(axis=1, keepdims=True)).sum(axis=1) > keep):  # ties at the end: smaller ids
                        ids = np.where(where[t] < 0, np.iinfo(np.int64).max, self.ids[where[t]])
                        top[t] = np.lexsort((ids, -scores[t]))[:keep]
                        kept[t] = scores[t, top[t]]
                    best[q[r]], place[q[r]] = kept, np.take_along_axis(where, top, 1)
                    two = np.partition(kept, (0, keep - k), axis=1)
                    worst[q[r]], kth[q[r]] = two[:, 0], np.maximum(start[q[r]], two[:, keep - k])
                return
            point, (lo1, hi1, lo2, hi2), near, far = self.nodes[node]
            d = np.sqrt(np.maximum(norms[q] + (point**2).sum() - 2 * (queries[q] @ point[:-1]), 0))
            bound1 = np.maximum(np.maximum(lo1 - d, d - hi1), 0)
            bound2 = np.maximum(np.maximum(lo2 - d, d - hi2), 0)
            first = d - hi1 <= lo2 - d
            for child, bound, mine in ((near, bound1, first), (far, bound2, ~first), (near, bound1, ~first), (far, bound2, first)):
                go = mine.copy()
                go[mine] = bound[mine] * factor <= reach(q[mine])
                if go.any():
                    visit(child, q[go])

        if len(queries):
            visit(0, np.arange(len(queries)))
        return place, best, done


def rows_of(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> pd.DataFrame:
    """q (the query's place), query_id, vec_id, score: at most k rows a query, best first."""
    place, _, _ = tree.search(query_ids, queries, k, factor, known)
    q, c = np.nonzero(place >= 0)
    at = place[q, c]
    score = np.zeros(len(q))
    for x, y in zip(queries[q].T, tree.vectors[at].T):  # in the components' order, so that equal vectors score alike
        score += x * y
    out = pd.DataFrame({"q": q, "query_id": query_ids[q], "vec_id": tree.ids[at], "score": score})
    if known is not None:
        out = out[out["score"] >= known[q] - 1e-9 * np.abs(known[q])]
    out = out.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return out[out.groupby("q").cumcount() < k]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (doubles) of the rows that take part, and dim."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


@dataclass
class Index:
    """shards: dim, pivot, shard, lo, hi, tree; a row a shard, in the shared folder. pivots: by dim, their vectors with the
    one more coordinate; most: by dim, the largest squared norm."""

    shards: DataFrame
    pivots: dict[int, np.ndarray]
    most: dict[int, float]


def gaps(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of x, with the one more coordinate extra, from pivots."""
    d = (x**2).sum(axis=1)[:, None] + (extra**2)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(d, 0))


def by_dim(v: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, places and vectors of a batch."""
    sizes = np.array([len(x) for x in v], np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, np.vstack(v.iloc[at].to_numpy())


def build_index(vectors: DataFrame, per_shard: int = 8192, leaf: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> Index:
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "vptree")
    rows = usable(vectors, id_col, vector_col)
    norm = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    found = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()}
    most = {d: r["most"] for d, r in found.items()}
    wanted = {d: min(MOST_PIVOTS, shards_for(r["n"], per_shard)) for d, r in found.items()}
    sample = []
    if found:
        # The least hashes; all but a few times as many as are wanted are left out before they are sorted.
        share = {d: min(1.0, max(64, 4 * wanted[d]) / r["n"]) for d, r in found.items()}
        most_h = F.create_map(*[x for d in found for x in (F.lit(d), F.lit(int(share[d] * (1 << 40))).cast("long"))])
        few = rows.withColumn("h", F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.lit(1 << 40))).filter(F.col("h") <= F.element_at(most_h, F.col("dim")))
        place = F.row_number().over(W.Window.partitionBy("dim").orderBy("h", "id"))
        enough = F.create_map(*[F.lit(x) for d in found for x in (d, wanted[d])])
        sample = few.withColumn("place", place).filter(F.col("place") <= F.element_at(enough, F.col("dim"))).orderBy("dim", "place").collect()
    pivots = {}
    for d in found:
        x = np.array([r["v"] for r in sample if r["dim"] == d], float)
        pivots[d] = np.hstack([x, np.sqrt(np.maximum(most[d] - (x**2).sum(axis=1), 0))[:, None]])
    shared = spark.sparkContext.broadcast((pivots, most))

    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        pivots, most = shared.value
        out = pd.DataFrame({"pivot": np.zeros(len(v), np.int32), "gap": np.zeros(len(v))})
        for dim, at, x in by_dim(v):
            extra = np.sqrt(np.maximum(most[dim] - (x**2).sum(axis=1), 0))
            for k in range(0, len(x), 1024):
                d = gaps(x[k : k + 1024], extra[k : k + 1024], pivots[dim])
                out.loc[at[k : k + 1024], "pivot"], out.loc[at[k : k + 1024], "gap"] = d.argmin(axis=1).astype(np.int32), d.min(axis=1)
        return out

    near = F.pandas_udf(nearest_pivot, "pivot int, gap double")
    rows = scratch.save(rows.withColumn("near", near("v")).select("id", "v", "dim", "near.pivot", "near.gap"), "rows")
    parts = rows.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / per_shard).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        tree = Tree(rows["id"].to_numpy(np.int64), np.vstack(rows["v"].to_numpy()), leaf, most=most[dim])
        return pd.DataFrame({"dim": [dim], "pivot": [rows["pivot"].iloc[0]], "part": [rows["part"].iloc[0]], "lo": [rows["gap"].min()], "hi": [rows["gap"].max()], "tree": [pickle.dumps(tree.__dict__)]})

    trees = rows.groupBy("dim", "pivot", "part").applyInPandas(build, "dim int, pivot int, part int, lo double, hi double, tree binary")
    return Index(scratch.save(trees, "index"), pivots, most)


def visits(index: Index, metas: dict[int, tuple[np.ndarray, ...]], factor: float, home: bool) -> Callable[..., pd.Series]:
    """The shards that a query searches: one of its nearest pivot (home), or all others within reach of its k-th best."""
    shared_pivots, most = index.pivots, index.most

    def run(v: pd.Series, known: pd.Series) -> pd.Series:
        out: list[list[int]] = [[] for _ in range(len(v))]
        for dim, at, x in by_dim(v):
            if dim not in metas:
                continue
            shard, pivot, part, lo, hi = metas[dim]
            d = gaps(x, np.zeros(len(x)), shared_pivots[dim])
            has = np.zeros(len(shared_pivots[dim]), bool)
            has[pivot] = True
            first = np.where(has, d, np.inf).argmin(axis=1)
            at_home = (pivot == first[:, None]) & (part == np.array([part[pivot == p].min() for p in first.tolist()])[:, None])
            go = at_home
            if not home:
                own = d[:, pivot]
                bound = np.maximum(np.maximum(own - hi, lo - own), 0)
                kth = known.iloc[at].to_numpy(float)
                reach = np.sqrt(np.maximum((x**2).sum(axis=1) + most[dim] - 2 * np.where(np.isnan(kth), -np.inf, kth), 0))
                go = ~at_home & (bound * factor <= reach[:, None] * (1 + 1e-9) + 1e-9)
            for i, k in enumerate(at.tolist()):
                out[k] = shard[go[i]].tolist()
        return pd.Series(out)

    return run


def searched(index: Index, queries: DataFrame, k: int, factor: float, per_block: int, id_col: str, vector_col: str) -> DataFrame:
    """FOUND's rows; one with a null vec_id, for each query and shard, tells how many products were computed."""
    spark = queries.sparkSession
    scratch = Scratch(spark, "vpsearch")
    asked = scratch.save(usable(queries, id_col, vector_col), "asked").select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("qrow"))
    numbers = index.shards.select("dim", "pivot", "part", "lo", "hi").orderBy("dim", "pivot", "part").collect()
    metas = {}
    for d in {r["dim"] for r in numbers}:
        own = [(n, r["pivot"], r["part"], r["lo"], r["hi"]) for n, r in enumerate(numbers) if r["dim"] == d]
        metas[d] = tuple(np.array(x) for x in zip(*own))
    shard_of = F.broadcast(spark.createDataFrame([(r["dim"], r["pivot"], r["part"], n) for n, r in enumerate(numbers)], "dim int, pivot int, part int, shard int"))
    trees = index.shards.join(shard_of, ["dim", "pivot", "part"]).select("shard", "tree")

    def run(tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(rows):
            return pd.DataFrame({"qrow": [], "query_id": [], "shard": [], "vec_id": [], "score": [], "products": []})
        own = Tree.__new__(Tree)
        own.__dict__ = pickle.loads(tree["tree"].iloc[0])
        known = np.where(rows["known"].isna(), -np.inf, rows["known"].to_numpy(float))
        out = rows_of(own, rows["id"].to_numpy(np.int64), np.vstack(rows["v"].to_numpy()), k, factor, known)
        out = pd.DataFrame({"qrow": rows["qrow"].to_numpy()[out["q"]], "query_id": out["query_id"].to_numpy(), "vec_id": out["vec_id"].astype("Int64").to_numpy(), "score": out["score"].to_numpy(), "products": 0})
        told = pd.DataFrame({"qrow": rows["qrow"].to_numpy(), "query_id": rows["id"].to_numpy(), "vec_id": pd.array([None] * len(rows), "Int64"), "score": np.nan, "products": own.products})
        out = pd.concat([out.astype({"vec_id": "Int64"}), told], ignore_index=True)
        out["shard"] = tree["shard"].iloc[0]
        return out[[x.split()[0] for x in FOUND.split(", ")]]

    def over(rows: DataFrame, home: bool, name: str) -> DataFrame:
        pairs = scratch.save(rows.withColumn("shard", F.explode(F.pandas_udf(visits(index, metas, factor, home), "array<int>")("v", "known"))), f"pairs-{name}")
        blocks = pairs.groupBy("shard").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))
        mine = pairs.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "qrow"), F.col("blocks")).cast("int")).drop("blocks")
        copies = trees.join(F.broadcast(blocks), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return scratch.save(copies.groupBy("shard", "block").cogroup(mine.groupBy("shard", "block")).applyInPandas(run, FOUND), f"found-{name}")

    first = over(asked.withColumn("known", F.lit(None).cast("double")), True, "home")
    best = first.filter("vec_id is not null").groupBy("qrow").agg(F.count("*").alias("n"), F.min("score").alias("known")).filter(F.col("n") >= k).drop("n")
    rest = over(asked.join(best, "qrow", "left").select(*asked.columns, "known"), False, "rest")
    return first.union(rest)


def search(index: Index, queries: DataFrame, k: int = 20, factor: float = FACTOR, per_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each of queries."""
    found = searched(index, queries, k, factor, per_block, id_col, vector_col).filter("vec_id is not null")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def costs(index: Index, queries: DataFrame, k: int = 20, factor: float = FACTOR, per_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, shards and products: of how many shards and vectors each query met."""
    found = searched(index, queries, k, factor, per_block, id_col, vector_col).filter("vec_id is null")
    return found.groupBy("query_id").agg(F.count("*").alias("shards"), F.sum("products").alias("products"))


def nearest(vectors: DataFrame, asked: Column, k: int = 20, factor: float = FACTOR, per_shard: int = 8192, **columns) -> DataFrame:
    """Indexes every row, and searches for those that satisfy asked."""
    return search(build_index(vectors, per_shard, **columns), vectors.filter(asked), k, factor, **columns)
