"""Parquet folders of id, text and embeddings as documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.operators.ranking import numbered
from lodeseek.schema import DimensionMismatch, EmptyIndex, InvalidDocument, NotFound


#: Bytes of a table that spread() spreads at most.
SPREAD_BYTES = 64 << 20


def spread(rows: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """rows of a small Parquet table over all cores: one of fewer files than there are cores, and of at most ``most`` bytes,
    is often one row group, and would be one task. Larger tables come as they are: their row groups are spread already."""
    spark = rows.sparkSession
    cores, paths = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not 0 < len(paths) < cores:
        return rows
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return rows.repartition(cores) if sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in files) <= most else rows


def read_documents(spark: SparkSession, folder: str, limit: int | None = None, id_col: str = "id", text_col: str = "text", embedding_col: str = "embeddings") -> DataFrame:
    """Documents of the folder's own ``*.parquet`` files, numbered from 0 by file path and row.

    The file's id is kept as the attribute ``id``; double embeddings become floats. limit keeps the first so many rows,
    by number. Raises NotFound for a missing folder, InvalidDocument for a missing or mistyped column, a null id or text,
    and a file without rows."""
    try:
        raw = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(folder)
    except AnalysisException as e:
        raise NotFound(f"no Parquet files in {folder}") from e
    for name, kind in ((id_col, T.StringType), (text_col, T.StringType), (embedding_col, T.ArrayType)):
        if name not in raw.columns:
            raise InvalidDocument(f"column {name} is missing; there are {raw.columns}")
        if not isinstance(raw.schema[name].dataType, kind):
            raise InvalidDocument(f"column {name} is {raw.schema[name].dataType.simpleString()}")
    if not isinstance(raw.schema[embedding_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        raise InvalidDocument(f"column {embedding_col} must hold floats or doubles")
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(embedding_col).cast("array<float>").alias("embedding"))
    seen = rows.agg(F.count_if(F.col("_id").isNull() | F.col("text").isNull()), F.count_distinct("_file")).first()
    if seen[0]:
        raise InvalidDocument(f"{seen[0]} rows have no {id_col} or no {text_col}")
    if seen[1] < len(raw.inputFiles()):
        raise InvalidDocument(f"{len(raw.inputFiles()) - seen[1]} files have no rows")
    out = numbered(rows, ["_file", "_row"], "doc_id")
    if limit is not None:
        out = out.filter(F.col("doc_id") < limit)
    return out.select("doc_id", "text", "embedding", F.create_map(F.lit("id"), F.col("_id")).alias("attributes"))


def embedding_dim(docs: DataFrame) -> int:
    """The one length of all embeddings."""
    found = docs.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if found["lo"] is None:
        raise EmptyIndex("no documents to index")
    if found["lo"] != found["hi"]:
        raise DimensionMismatch(f"embeddings have from {found['lo']} to {found['hi']} numbers")
    if found["lo"] <= 0:
        raise InvalidDocument("empty or null embedding")
    return found["lo"]
