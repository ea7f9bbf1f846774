"""What the operators share: word patterns, and batch helpers for workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.scratch import Scratch, cleanup, delete, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: Java pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"

def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """A worker's pyarrow file system for the URI, and the path within it."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, over its tasks, until another owner asks for one.

    Operators without one ask too, so that what another left doesn't add to what they need. The package is pickled by
    value, so each task has its own copy of its modules; the dict is kept in a module of its own, which workers make."""
    import ctypes
    import gc
    import sys
    import types

    held = sys.modules.setdefault("lodeseek_worker_state", types.ModuleType("lodeseek_worker_state")).__dict__.setdefault("held", {})
    if owner not in held and held:
        held.clear()
        gc.unfreeze()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library: freed memory returns in its own time
            pass
    return held.setdefault(owner, {})


def smaller_batches(spark: SparkSession, rows: int = 2500) -> None:
    """Rows of text are large: where the session has the default, fewer of them travel to Python at once from here on. A
    batch's size can be set by session alone; one that has another value keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow: pa.Schema, max_bytes: int = 8 << 20, owner: str = "none") -> DataFrame:
    """mapInArrow over slices of at most about max_bytes (one row at least); fn gets and returns columns as lists or arrays."""

    smaller_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, int(batch.num_rows * min(1.0, max_bytes / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bytes_of(text: str = "text") -> F.Column:
    """The text's UTF-8, null kept."""
    return F.col(text).cast("binary")


def shards_for(rows: int, per: int) -> int:
    return max(1, -(-rows // per))
