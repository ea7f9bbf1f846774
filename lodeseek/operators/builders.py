"""Builders of one kind of index, for callers who keep their own storage: results are DataFrames, nothing is written
but batches of rows added one by one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from lodeseek.operators import lexical, vector
from lodeseek.schema import DimensionMismatch, EmptyIndex
from lodeseek.scratch import Scratch

#: Rows added one by one that the driver holds before they are written out.
HELD = 50_000


class _Rows:
    """Rows added one by one, or by the table."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self._schema = spark, schema
        self._held: list[tuple] = []
        self._frames: list[DataFrame] = []

    def _add(self, row: tuple) -> None:
        self._held.append(row)
        if len(self._held) >= HELD:
            self._frames.append(Scratch(self.spark, "builder").save(self.spark.createDataFrame(self._held, self._schema), "rows"))
            self._held = []

    def add_all(self, rows: DataFrame):
        """Rows with the builder's columns; all of them."""
        names = [c.split()[0] for c in self._schema.split(", ")]
        self._frames.append(rows.select(*names))
        return self

    def rows(self) -> DataFrame:
        out = self.spark.createDataFrame(self._held, self._schema)
        for f in self._frames:
            out = f.unionByName(out)
        return out


class LexicalIndexBuilder(_Rows):
    """An inverted index of documents of doc_id and text."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "doc_id long, text string")

    def add_document(self, doc_id: int, text: str) -> LexicalIndexBuilder:
        self._add((doc_id, text))
        return self

    def build_posting_lists(self) -> DataFrame:
        """term, doc_id, tf, doc_len, sorted by term and id within tasks' ranges of them; a term's list may be any length."""
        return lexical.postings(self.rows()).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")

    def vocabulary(self) -> DataFrame:
        return lexical.vocabulary(lexical.postings(self.rows()))

    def doc_count(self) -> int:
        return self.rows().count()

    def avg_doc_len(self) -> float:
        """Mean number of terms, repeats included; 0 if there is no document."""
        return lexical.corpus_stats(self.rows()).first()["avg_doc_len"]

    def doc_lengths(self) -> DataFrame:
        return lexical.doc_lengths(self.rows())


class VectorIndexBuilder(_Rows):
    """Clusters of vectors of one length."""

    def __init__(self, spark: SparkSession, dim: int, num_clusters: int):
        if num_clusters < 1:
            raise ValueError("at least one cluster is needed")
        super().__init__(spark, "doc_id long, embedding array<float>")
        self.dim, self.num_clusters = dim, num_clusters

    def add(self, doc_id: int, embedding: Sequence[float]) -> VectorIndexBuilder:
        if len(embedding) != self.dim:
            raise DimensionMismatch(f"document {doc_id} has {len(embedding)} numbers, not {self.dim}")
        self._add((doc_id, [float(x) for x in embedding]))
        return self

    def extend(self, rows: Iterable[tuple[int, Sequence[float]]]) -> VectorIndexBuilder:
        for doc_id, embedding in rows:
            self.add(doc_id, embedding)
        return self

    def build(self) -> tuple[DataFrame, DataFrame]:
        """centroids (cluster_id, centroid) and the vectors with their cluster_id; trained on all of them."""
        rows = self.rows()
        if rows.isEmpty():
            raise EmptyIndex("no vectors to index")
        if not rows.filter(f"embedding is null or size(embedding) <> {self.dim}").isEmpty():
            raise DimensionMismatch(f"not all vectors have {self.dim} numbers")
        centroids = vector.kmeans(rows, self.num_clusters)
        return vector.centroid_table(self.spark, centroids), vector.assign(rows, centroids)
