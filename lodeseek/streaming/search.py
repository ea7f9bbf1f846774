"""Answers a stream of queries, a micro-batch at a time, by the batch searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.sources.index import IndexReader


def answer_stream(reader: IndexReader, queries: DataFrame, output: str, checkpoint: str, top_k: int = 10, kind: str = "lexical", n_probe: int = 2, **trigger) -> StreamingQuery:
    """Starts a query that writes batch_id, query_id, rank, doc_id, score to Parquet below output.

    queries is a stream of query_id with text, embedding, or both, as kind (lexical, vector, hybrid) needs. A batch that
    is run again after a failure replaces its own folder, so each query is answered once."""
    if kind not in ("lexical", "vector", "hybrid"):
        raise ValueError(f"no such kind of search: {kind}")

    def answer(batch: DataFrame, batch_id: int) -> None:
        rows = {"lexical": lambda: reader.batch_lexical(batch, top_k), "vector": lambda: reader.batch_vector(batch, top_k, n_probe), "hybrid": lambda: reader.batch_hybrid(batch, top_k, n_probe)}[kind]()
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
