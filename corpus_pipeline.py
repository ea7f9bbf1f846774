"""The corpus pipeline: from raw documents to packed training sequences, a stage for each of five operators.

Each stage works on all that its predecessor kept, and returns the columns of documents; the last one returns packed
pieces. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import langid, minhash, mixing, packing, pii
from lodeseek.llm.common import Scratch, free_name
from lodeseek.llm.queries import PII_KEY, table, tokenizer


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language is ambiguous; sets lang of the others."""
    own = free_name(docs, "_language")
    marked = langid.annotated(docs, langid.fit(docs), into=own).filter((F.col(f"{own}.lang") != langid.UND) & ~F.col(f"{own}.ambiguous"))
    return marked.select(*[F.col(f"{own}.lang").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates."""
    return minhash.deduplicated(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    out = pii.pseudonymised(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs, weight=mixing.quality())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 4096 tokens."""
    return packing.best_fit_pack(docs, tokenizer())


STAGES = [
    ("language ID", identify_languages),
    ("near-duplicate removal", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: Learned classifiers, keyed permutations and tokenisers have no SQL; tests hold run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
