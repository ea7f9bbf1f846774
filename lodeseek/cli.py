"""python -m lodeseek.cli --input FOLDER: builds an index from a folder of Parquet files, and tries two searches."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodeseek.operators.vector import cluster_count
from lodeseek.schema import IndexFault
from lodeseek.scratch import delete
from lodeseek.sources.index import IndexBuilder, IndexReader
from lodeseek.sources.parquet import embedding_dim, read_documents


def count(text: str) -> int:
    return int(text.replace("_", ""))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True, help="folder of Parquet files with id, text and embeddings")
    p.add_argument("--output", default="./parquet-index")
    p.add_argument("--temp", help="folder, shared by all executors, for tables between steps, unless the session names one")
    p.add_argument("--index-name", default="dataset")
    p.add_argument("--limit", type=count, help="first rows to take")
    p.add_argument("--overwrite", action="store_true", help="replace an index of that name")
    a = p.parse_args(args)
    if a.temp and spark is None:
        SparkSession.builder.config("spark.checkpoint.dir", a.temp)
    spark = spark or SparkSession.builder.appName("lodeseek").getOrCreate()
    path = f"{a.output.rstrip('/')}/{a.index_name}"
    try:
        IndexReader.open(spark, path)
        if not a.overwrite:
            raise SystemExit(f"{path} holds an index; --overwrite replaces it")
        delete(spark, path)
    except IndexFault:
        pass
    docs = read_documents(spark, a.input, a.limit).persist()
    builder = IndexBuilder(spark, embedding_dim(docs), cluster_count(docs.count())).add_all(docs)
    builder.build(path)
    reader = IndexReader.open(spark, path)
    print(f"{reader.doc_count()} documents, {reader.manifest['num_clusters']} clusters in {path}")
    for r in reader.search_lexical("machine learning", 3).collect():
        print(f"lexical {r['score']:.4f} {r['attributes']['id']} {(r['text'] or '')[:80]}")
    if first := docs.orderBy("doc_id").select("embedding").first():
        for r in reader.search_vector(first["embedding"], 3, 2).collect():
            print(f"vector {r['score']:.4f} {r['attributes']['id']} {(r['text'] or '')[:80]}")
    docs.unpersist()
    return path


if __name__ == "__main__":
    main()
