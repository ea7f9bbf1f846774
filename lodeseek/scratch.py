"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where it is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            at = jvm_dir.get()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodeseek-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written once in the shared folder and read back: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodeseek-{name}-{uuid.uuid4().hex[:12]}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        delete(self.spark, self.path(name) if name else self.root)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes the scratch tables of this process; call it once the results are written."""
    while _roots:
        delete(spark, _roots.pop())


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            cleanup(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


atexit.register(_at_exit)
