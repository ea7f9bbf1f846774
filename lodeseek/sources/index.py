"""Immutable indexes as Parquet tables, and the searches on them.

Tables of an index: ``docs`` (range-partitioned by doc_id), ``postings`` (by term and doc_id, sorted, so that a filter on
terms skips row groups, and a common term spreads over files), ``vocab``, ``centroids``, ``vectors`` (a folder a cluster,
so that probing prunes), and ``manifest``, written last: without it there is no index.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek import schema as S
from lodeseek.functions import tokens
from lodeseek.operators import fusion, lexical, vector
from lodeseek.operators.ranking import BROADCAST_ROWS, small, top_k, top_k_by
from lodeseek.scratch import Scratch, delete

TABLES = ("docs", "postings", "vocab", "centroids", "vectors", "manifest")
#: Documents added one by one are held on the driver up to this many, then written out.
HELD = 50_000
#: Rows of a file of docs and of vectors, and of postings and vocab: some tens of megabytes each.
SEGMENT_ROWS, SEGMENT_POSTINGS = 50_000, 4_000_000
#: Files of a cluster's folder: its rows are spread over so many tasks, in case it holds most of them.
SPREAD = 16


@dataclass
class SearchResult:
    doc_id: int
    score: float
    text: str
    attributes: dict[str, str] = field(default_factory=dict)


class IndexBuilder:
    """Collects documents, then writes an index. train_rows bounds the sample that k-means sees; None is all rows."""

    def __init__(self, spark: SparkSession, dim: int, num_clusters: int | None = None, train_rows: int | None = S.TRAIN_ROWS):
        if num_clusters is not None and num_clusters < 1:
            raise ValueError("at least one cluster is needed")
        self.spark, self.dim, self.num_clusters, self.train_rows = spark, dim, num_clusters, train_rows
        self._frames: list[DataFrame] = []
        self._held: list[tuple] = []
        self._scratch: Scratch | None = None

    def set_num_clusters(self, n: int) -> None:
        if n < 1:
            raise ValueError("at least one cluster is needed")
        self.num_clusters = n

    def add(self, doc_id: int, text: str, embedding: Sequence[float], attributes: dict[str, str] | Iterable[tuple[str, str]] | None = None) -> IndexBuilder:
        """attributes: a dict, or pairs, of which the last with a key counts."""
        if len(embedding) != self.dim:
            raise S.DimensionMismatch(f"document {doc_id} has {len(embedding)} numbers, not {self.dim}")
        self._held.append((doc_id, text, [float(x) for x in embedding], dict(attributes or {})))
        if len(self._held) >= HELD:
            self._flush()
        return self

    def add_all(self, docs: DataFrame | Iterable[tuple]) -> IndexBuilder:
        """A DataFrame of doc_id, text, embedding and perhaps attributes (a map, or an array of pairs); or such tuples."""
        if isinstance(docs, DataFrame):
            attributes = attribute_map(docs) if "attributes" in docs.columns else F.lit(None).cast(S.ATTRIBUTES)
            self._frames.append(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("embedding").cast("array<float>"), attributes.alias("attributes")))
        else:
            for d in docs:
                self.add(*d)
        return self

    def _flush(self) -> None:
        self._scratch = self._scratch or Scratch(self.spark, "build")
        self._frames.append(self._scratch.save(self.spark.createDataFrame(self._held, S.DOCUMENT), f"held{len(self._frames)}"))
        self._held = []

    def documents(self) -> DataFrame:
        parts = [*self._frames, *([self.spark.createDataFrame(self._held, S.DOCUMENT)] if self._held else [])]
        if not parts:
            raise S.EmptyIndex("no documents to index")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def doc_count(self) -> int:
        return len(self._held) + sum(f.count() for f in self._frames)

    def build(self, path: str) -> None:
        """Writes the index to path, replacing one that is there; to anything else there it doesn't write."""
        check_free(self.spark, path)
        docs = self.documents().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = S.validate(docs, self.dim)
            k = self.num_clusters or vector.cluster_count(n)
            centroids = vector.kmeans(vector.training_rows(docs.select("doc_id", "embedding"), self.train_rows, k=k), k)

            def save(rows: DataFrame, table: str, partitionBy: str | None = None, **options) -> None:
                rows.write.mode("overwrite").options(**options).parquet(f"{path}/{table}", partitionBy=partitionBy)

            delete(self.spark, f"{path}/manifest")
            length = F.size(tokens("text")).cast("long")
            save(docs.select("doc_id", "text", "attributes", length.alias("doc_len")).repartitionByRange(files(n, SEGMENT_ROWS), "doc_id").sortWithinPartitions("doc_id"), "docs")
            stats = lexical.length_stats(self.spark.read.parquet(f"{path}/docs"))
            most = files(stats.first()["total_len"], SEGMENT_POSTINGS)
            save(lexical.postings(docs).repartitionByRange(most, "term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
            terms = lexical.vocabulary(self.spark.read.parquet(f"{path}/postings"))
            save(terms.repartitionByRange("term").sortWithinPartitions("term"), "vocab", maxRecordsPerFile=SEGMENT_POSTINGS)
            save(vector.centroid_table(self.spark, centroids).coalesce(1), "centroids")
            rows = vector.assign(docs.select("doc_id", "embedding"), centroids)
            save(rows.repartition("cluster_id", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))), "vectors", partitionBy="cluster_id", maxRecordsPerFile=SEGMENT_ROWS)
            save(stats.select("*", F.lit(self.dim).alias("dim"), F.lit(len(centroids)).alias("num_clusters")).coalesce(1), "manifest")
        finally:
            docs.unpersist()


def files(rows: int, per: int) -> int:
    return max(1, -(-int(rows) // per))


def attribute_map(docs: DataFrame) -> Column:
    """attributes as a map; of pairs that share a key the last counts."""
    c = F.col("attributes")
    if not isinstance(docs.schema["attributes"].dataType, T.ArrayType):
        return c.cast(S.ATTRIBUTES)
    pairs = c.cast("array<struct<key:string,value:string>>")
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last).cast(S.ATTRIBUTES)


def check_free(spark: SparkSession, path: str) -> None:
    """Raises if path holds something that is no index's table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and (other := {f.getPath().getName() for f in fs.listStatus(p)} - set(TABLES)):
        raise S.IndexFault(f"{path} holds {sorted(other)[:3]}, which is no index")


class IndexReader:
    """An index opened for searches. Results are DataFrames of doc_id, score, text, attributes, best first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            self.manifest: Row = spark.read.parquet(f"{path}/manifest").first()
        except AnalysisException as e:
            raise S.NotFound(f"no index in {path}") from e
        except Py4JJavaError as e:
            raise S.StorageFault(f"{path} can't be read: {e.java_exception.getMessage()}") from e
        self.docs, self.postings, self.vocab, self.vectors = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "vocab", "vectors"))
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()
        self.centroids = np.array([r["centroid"] for r in rows], float)

    @staticmethod
    def open(spark: SparkSession, path: str) -> IndexReader:
        return IndexReader(spark, path)

    def doc_count(self) -> int:
        return self.manifest["n_docs"]

    def persist(self, *tables: str) -> IndexReader:
        """Keeps tables in executors' memory or on their disks, as searches read them: vocab, or those named of docs,
        postings, vocab and vectors. A kept table is scanned rather than skipped into: keep what fits."""
        for t in tables or ("vocab",):
            if t not in ("docs", "postings", "vocab", "vectors"):
                raise ValueError(f"no such table: {t}")
            getattr(self, t).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for t in (self.docs, self.postings, self.vocab, self.vectors):
            t.unpersist()

    def _stats(self) -> DataFrame:
        return self.spark.createDataFrame([(self.manifest["n_docs"], self.manifest["total_len"], self.manifest["avg_doc_len"])], "n_docs long, total_len long, avg_doc_len double")

    def _hits(self, rows: list[Row] | list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, S.HIT)

    def fetch(self, hits: DataFrame, k: int | None = None) -> DataFrame:
        """Texts and attributes of hits, whose best are found before any text is read. Ids that aren't stored drop out.
        k bounds the hits, and a bounded list is broadcast without a count; without it they are counted first."""
        few = small(hits) if k is None else F.broadcast(hits) if k <= BROADCAST_ROWS else hits
        rows = self.docs.select("doc_id", "text", "attributes").join(few, "doc_id")
        return rows.select("doc_id", "score", "text", "attributes").orderBy(F.desc("score"), "doc_id")

    def _lexical(self, query: str, k: int) -> DataFrame:
        # The terms are literals, so that the scan of postings and vocabulary skips to them.
        counts = lexical.terms_of(self.spark, query) if k > 0 else {}
        if not counts:
            return self._hits([])
        terms = list(counts)
        asked = self.spark.createDataFrame(list(counts.items()), "term string, qtf long")
        scored = lexical.term_scores(self.postings.filter(F.col("term").isin(terms)), self.vocab.filter(F.col("term").isin(terms)), self._stats())
        hits = scored.join(F.broadcast(asked), "term").groupBy("doc_id").agg(F.sum(F.col("qtf") * F.col("score")).alias("score"))
        return top_k(hits, k)

    def _vector(self, query: Sequence[float], k: int, n_probe: int) -> DataFrame:
        if k <= 0:
            return self._hits([])
        return vector.vector_top_k(self.vectors, query, k, vector.probed(query, self.centroids, n_probe))

    def search_lexical(self, query: str, top_k: int) -> DataFrame:
        return self.fetch(self._lexical(query, top_k), top_k)

    def search_vector(self, embedding: Sequence[float], top_k: int, n_probe: int) -> DataFrame:
        return self.fetch(self._vector(embedding, top_k, n_probe), top_k)

    def search_hybrid(self, query: str, embedding: Sequence[float], top_k: int, n_probe: int) -> DataFrame:
        """Each leg finds its best 2 * top_k; the score is their reciprocal rank fusion."""
        if top_k <= 0:
            return self.fetch(self._hits([]), 0)
        legs = self._lexical(query, 2 * top_k), self._vector(embedding, 2 * top_k, n_probe)
        return self.fetch(fusion.fuse_hybrid(*legs, top_k), top_k)

    def batch_lexical(self, queries: DataFrame, top_k: int) -> DataFrame:
        """query_id, rank, doc_id, score for queries (query_id, text)."""
        return top_k_by(lexical.lexical_hits(self.postings, self.vocab, self._stats(), queries), "query_id", top_k)

    def batch_vector(self, queries: DataFrame, top_k: int, n_probe: int) -> DataFrame:
        """query_id, rank, doc_id, score for queries (query_id, embedding)."""
        return vector.vector_batch(self.vectors, queries, top_k, self.centroids, n_probe)

    def batch_hybrid(self, queries: DataFrame, top_k: int, n_probe: int) -> DataFrame:
        """query_id, rank, doc_id, score for queries (query_id, text, embedding)."""
        legs = self.batch_lexical(queries.select("query_id", "text"), 2 * top_k), self.batch_vector(queries.select("query_id", "embedding"), 2 * top_k, n_probe)
        return fusion.rrf_fuse(list(legs), top_k, "query_id")


class Index:
    """The reader for callers who want lists: ``Index(spark, folder, name)``."""

    def __init__(self, spark: SparkSession, index_dir: str, version: str):
        self.reader = IndexReader(spark, f"{index_dir.rstrip('/')}/{version}")

    @property
    def doc_count(self) -> int:
        return self.reader.doc_count()

    @staticmethod
    def _list(rows: DataFrame) -> list[SearchResult]:
        return [SearchResult(r["doc_id"], r["score"], r["text"], r["attributes"] or {}) for r in rows.collect()]

    def search_lexical(self, query: str, top_k: int) -> list[SearchResult]:
        return self._list(self.reader.search_lexical(query, top_k))

    def search_vector(self, embedding: Sequence[float], top_k: int, probes: int) -> list[SearchResult]:
        return self._list(self.reader.search_vector(embedding, top_k, probes))

    def search_hybrid(self, query: str, embedding: Sequence[float], top_k: int, probes: int) -> list[SearchResult]:
        return self._list(self.reader.search_hybrid(query, embedding, top_k, probes))
