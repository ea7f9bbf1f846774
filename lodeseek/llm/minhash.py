"""Near duplicates: MinHash with banding, signature verification, confirmation on full sets, connected components.

1. One Arrow pass over whole texts gives each document its number of distinct shingles, a 128-bit fingerprint of the set
   and ``HASHES`` minima of universal (multiply-shift) hashes.
2. Documents with equal sets form a class, by one aggregation on the fingerprint; only the class's least id goes on. So
   a group of exact copies costs one row, however large it is.
3. Bands of ``ROWS`` minima give bucket keys. Round one links each class to the least of every bucket it is in: as many
   candidates as bucket entries, never all pairs of a bucket.
4. Candidates whose signatures agree enough are confirmed on the full sets of both texts, and components are formed.
5. Round two takes the buckets that still hold more than one component, compares a byte of each minimum across
   components whose sizes allow a link (in blocks, where a bucket is large; tasks follow the number of comparisons), and
   confirms those that agree. After it every pair of classes that share a bucket is in one component or was compared, so
   no link that a bucket shows is lost. A pair at 85 % misses all bands with a chance of (1 - 0.85**4)**16 < 1e-5, and the
   signature's bar with about 1e-4; ``agree`` 0 confirms every candidate.

Defined results: a text with fewer words than a shingle has its whole sequence as one; a null or wordless text has no
shingle, links with nothing and is kept; a row without an id links with nothing: its component is null and it is kept;
rows that share an id are one node; columns of other names are ignored; an empty table gives no rows. ``deduplicated``
removes the other members of a node's group, and copies of a row that agree in id and text; different texts that share an
id stay with their node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import WORD, Scratch, bytes_of, free_name, map_batches, shards_for, worker_cache
from lodeseek.llm.components import connected_components

HASHES, ROWS, BANDS = 128, 4, 16
#: Minima in common from which a candidate is confirmed: 0.85 less 3.6 standard deviations.
AGREE = 94
#: Members of a bucket that are compared at a time.
BLOCK = 2048
#: Comparisons of two members, and members, that a task of round two gets about.
COMPARISONS, MEMBERS = 4_000_000, 20_000
#: Members of a family that are confirmed together, and texts that a task confirms.
FAMILY, TEXTS = 512, 1500
#: Ids, or pairs of a group and an id, that are broadcast at most: 8 MB.
BROADCAST_IDS = 500_000
SKETCH = "doc_id long, n_shingles long, fp binary, sig binary, bytes binary"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary()), ("bytes", pa.binary())])
_rng = np.random.default_rng(20240229)
A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hash() -> Callable[[bytes], int]:
    return worker_cache("word_hash").setdefault("hash", WordHash()).__getitem__


def shingle_set(text: bytes | None, width: int = 3) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hash(), words), np.uint64, len(words))
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    h = w[: len(w) - width + 1].copy()
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[k : len(w) - width + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    # The least of the upper halves is the upper half of the least; some hundred rows at a time stay in a core's cache.
    out = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    room = np.empty((min(256, len(shingles)), HASHES), np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256, None]
        h = np.multiply(part, A, out=room[: len(part)])
        h += B
        np.minimum(out, h.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch_rows(rows: dict[str, list]) -> dict[str, list]:
    n, fp, sig, low = [], [], [], []
    for text in rows["text"]:
        s = shingle_set(text)
        minima = signature(s) if len(s) else None
        n.append(len(s))
        fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        sig.append(minima.tobytes() if len(s) else None)
        low.append(minima.astype(np.uint8).tobytes() if len(s) else None)
    return {"doc_id": rows["doc_id"], "n_shingles": n, "fp": fp, "sig": sig, "bytes": low}


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), bytes_of(text_col).alias("text"))
    return map_batches(src, sketch_rows, SKETCH, SKETCH_ARROW, owner="word_hash")


def bucket_entries(classes: DataFrame) -> DataFrame:
    """key, rep for each band of each class."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    return classes.select(F.explode(band).alias("key"), "rep")


def agreeing(pairs: DataFrame, classes: DataFrame, agree: int = AGREE) -> DataFrame:
    """Of pairs (a, b) of class ids, those whose signatures agree in ``agree`` places or more."""
    sig = classes.select("rep", "sig")
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= agree))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of ids, those whose full shingle sets overlap by percent or more, as edges u, v.

    Pairs are put together by family, the least id that b is paired with, so that a text that has many pairs is sent once
    for FAMILY members of the family rather than once a pair. Tasks take families, or pairs of their blocks, by hash."""
    family = pairs.groupBy("b").agg(F.min("a").alias("family"))
    tagged = pairs.join(family, "b")
    members = tagged.select("family", F.explode(F.array("a", "b")).alias("id")).distinct()
    blocks = members.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("blocks"))
    place = [F.pmod(F.xxhash64(F.lit("block"), c), F.col("blocks")) for c in ("a", "b")]
    tagged = scratch.save(tagged.join(blocks, "family").select("a", "b", F.xxhash64("family", F.least(*place), F.greatest(*place)).alias("group")), f"pairs-{id(pairs)}")
    needs = scratch.save(tagged.select("group", F.explode(F.array("a", "b")).alias("id")).distinct(), f"needs-{id(pairs)}")
    n = needs.count()
    task = F.pmod(F.col("group"), F.lit(shards_for(n, TEXTS))).cast("int").alias("task")
    # Ids are broadcast while they are few, so that no other text is moved; beyond that a text, far larger than what the
    # tables hold on disk, is shuffled to them, and never broadcast.
    wanted = docs.filter("text is not null")
    both = wanted.join(F.broadcast(needs), F.col("id") == F.col("doc_id")) if n <= BROADCAST_IDS else needs.join(wanted.hint("shuffle_merge"), F.col("id") == F.col("doc_id"))
    texts, mine = both.select(task, "id", "text"), tagged.select(task, "a", "b")

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        worker_cache("word_hash")
        # Rows that share an id are one node: every text of it may make a link.
        sets: dict[int, list[np.ndarray]] = {}
        for i, text in zip(texts.column("id").to_pylist(), texts.column("text")):
            new = shingle_set(text.as_py())
            own = sets.setdefault(i, [])
            if not any(np.array_equal(new, x) for x in own):
                own.append(new)
        u, v = [], []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            if any(linked(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ())):
                u.append(b), v.append(a)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return texts.groupBy("task").cogroup(mine.groupBy("task")).applyInArrow(run, "u long, v long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bytes each row of x agrees with each of y."""
    if len(x) * len(y) <= 1024:
        return (x[:, None] == y[None]).sum(axis=2)
    out, columns = np.zeros((len(x), len(y)), np.uint8), np.ascontiguousarray(y.T)
    for k in range(x.shape[1]):
        out += x[:, k : k + 1] == columns[k]
    return out


def compared(percent: int, agree: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs across components whose sizes allow a link and whose bytes agree, for a task's buckets and blocks of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "i", "j"], kind="stable", ignore_index=True)
        low = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, HASHES)
        rep, comp, block, size, key, i, j = (rows[c].to_numpy() for c in ("rep", "comp", "block", "n_shingles", "key", "i", "j"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found = [np.zeros((0, 2), np.int64)]
        for start, end in zip([0, *new], [*new, len(rows)]):
            one = i[start] == j[start]
            at = np.arange(start, end)
            left = at if one else at[block[start:end] == i[start]]
            right = at if one else at[block[start:end] == j[start]]
            for k in range(0, len(left), 256):
                x = left[k : k + 256]
                good = comp[x][:, None] != comp[right]
                good &= 100 * np.minimum(size[x][:, None], size[right]) >= percent * np.maximum(size[x][:, None], size[right])
                if one:
                    good &= rep[x][:, None] < rep[right]
                if good.any():
                    good &= agreements(low[x], low[right]) >= agree
                    p, q = np.nonzero(good)
                    found.append(np.sort(np.stack([rep[x[p]], rep[right[q]]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def open_pairs(entries: DataFrame, classes: DataFrame, component: DataFrame, scratch: Scratch, percent: int = 85, agree: int = AGREE) -> DataFrame:
    """Pairs (a, b) of round two."""
    labelled = entries.join(component.select(F.col("u").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    bucket = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    bucket = scratch.save(bucket.select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    pairs, rows = bucket.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2), F.sum(F.col("n") * F.col("blocks"))).first()
    tasks = max(shards_for(int(pairs or 0), COMPARISONS), shards_for(int(rows or 0), MEMBERS))
    members = labelled.join(bucket, "key").join(classes.select("rep", "bytes", "n_shingles"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    # By number, so that AQE doesn't merge tasks that have few bytes and much to compare.
    bins = members.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(4 * tasks))).repartition(tasks, "bin")
    return bins.select("bin", "key", "i", "j", "rep", "comp", "block", "n_shingles", "bytes").groupBy("bin").applyInPandas(compared(percent, agree), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), bytes_of(text_col).alias("text"))
    sketch = scratch.save(sketches(docs, id_col, text_col), "sketch")
    able = sketch.filter("fp is not null and doc_id is not null")
    own = scratch.save(able.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "own")
    classes = scratch.save(able.join(own.select("rep", F.col("fp").alias("own_fp")), (F.col("doc_id") == F.col("rep")) & (F.col("fp") == F.col("own_fp"))).select("rep", "sig", "bytes", "n_shingles").dropDuplicates(["rep", "sig"]), "classes")
    entries = bucket_entries(classes)
    least = entries.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    stars = entries.join(least, "key").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    stars = scratch.save(agreeing(stars, classes, agree), "stars")
    links = scratch.save(confirmed(stars, texts, percent, scratch), "links")
    component = scratch.save(connected_components(links, scratch), "first")
    more = scratch.save(open_pairs(entries, classes, component, scratch, percent, agree).join(stars, ["a", "b"], "left_anti"), "open")
    if not more.isEmpty():
        more = scratch.save(confirmed(more, texts, percent, scratch), "more")
        component = scratch.save(connected_components(component.select("u", F.col("component").alias("v")).union(more), scratch), "second")
    # Copies of a class and linked classes alone are joined back.
    copies = able.select("doc_id", "fp").join(own.filter("n > 1").select("fp", "rep"), "fp").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    label = copies.join(component.select(F.col("u").alias("v"), "component"), "v", "left").select("u", F.coalesce("component", "v").alias("component"))
    label = scratch.save(label.union(component).groupBy("u").agg(F.min("component").alias("component")), "label")
    out = sketch.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("u"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that aren't kept: one document of each group stays, the one with the least id. Of rows that
    agree in id and text one stays (of those that differ elsewhere, the one whose JSON is least); rows without an id and
    wordless rows stay as they are."""
    scratch = Scratch(docs.sparkSession, "dedup")
    marked = scratch.save(near_duplicates(docs, percent, id_col, text_col), "marked")
    own = free_name(docs, "_gone")
    gone = scratch.save(marked.filter("not kept").select(F.col("doc_id").alias(own)).distinct(), "gone")
    # Few ids are broadcast, so that texts stay where they are.
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    out = docs.join(gone, F.col(id_col).cast("long") == F.col(own), "left_anti")
    ids = marked.filter("kept and doc_id is not null and n_shingles > 0")
    twice = scratch.save(ids.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(own)), "twice")
    if twice.isEmpty():
        return out
    rows = out.join(twice, (F.col(id_col).cast("long") == F.col(own)) & F.col(text_col).cast("string").rlike(WORD), "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # An aggregate, which is partial before its shuffle: a row may be there any number of times.
    first = rows.filter(F.col(own).isNotNull()).groupBy(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return rows.filter(F.col(own).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(first.select("_row.*"))
