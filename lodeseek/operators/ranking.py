"""Top-k with reproducible ties, dense numbers, and joins whose broadcast is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodeseek.scratch import Scratch

#: Decimals that decide an order: what sums differ by in their last bits doesn't.
DECIMALS = 6
#: Rows of a list that is ranked as a whole, in one task.
RANKED_ROWS = 1_000_000
#: Rows up to which a side is broadcast. Rows are ids, terms and a few numbers, or one vector.
BROADCAST_ROWS = 20_000


def small(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """side, marked for broadcast if a count of at most ``most`` + 1 of its rows finds it small; else AQE decides."""
    return F.broadcast(side) if len(side.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most else side


def rounded(score: Column) -> Column:
    return F.round(score, DECIMALS)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best of doc_id, score: by rounded score, then id. Each task keeps k rows, and only those meet."""
    rows = hits.withColumn("score", rounded(F.col("score")))
    return rows.orderBy(F.desc("score"), "doc_id").limit(max(k, 0))


def ranked(hits: DataFrame, by: str | None = None) -> DataFrame:
    """hits with rank, from 1, in each group of ``by``; equal scores have ranks of their own, by id.

    Without ``by`` hits is a list, such as top_k's, that one task sorts: more than RANKED_ROWS rows raise. For more there
    is ranked_all."""
    rows = hits.withColumn("score", rounded(F.col("score")))
    if by:
        return rows.withColumn("rank", F.row_number().over(W.Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")))
    place = F.row_number().over(W.Window.partitionBy().orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") > RANKED_ROWS, F.raise_error(F.lit("too long a list for one task: use ranked_all")).cast("int")).otherwise(F.col("rank")))


def ranked_all(hits: DataFrame) -> DataFrame:
    """hits of any number with rank, a long from 1; no task sorts more than its part."""
    rows = hits.withColumn("score", rounded(F.col("score")))
    return numbered(rows, [-F.col("score"), "doc_id"], "rank").withColumn("rank", F.col("rank") + 1)


def top_k_by(hits: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each group, with rank. The limit reaches below the shuffle, so a task sends k rows a group."""
    return ranked(hits, by).filter(F.col("rank") <= k)


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their place in the given order, from 0, as a long.

    Rows are range-partitioned and sorted, and numbered within partitions; then the sizes of partitions, a number each,
    shift them. No task sees more than its part."""
    scratch = Scratch(rows.sparkSession, "numbered")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tagged = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(keys)])
    by = [f"_o{i}" for i in range(len(keys))]
    tagged = tagged.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by).withColumn("_place", F.monotonically_increasing_id())
    saved = scratch.save(tagged, "rows")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = saved.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    shift, before = [], 0
    for r in sizes:
        shift.append((r["p"], before))
        before += r["n"]
    if not shift:
        return saved.withColumn(name, F.lit(0).cast("long")).drop("_place")
    starts = rows.sparkSession.createDataFrame(shift, "_p long, _before long")
    return saved.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, (F.col("_before") + within).cast("long")).drop("_p", "_before", "_place")
