"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w: u comes from its id by a hash, w is its quality weight. Within a source, complete epochs
take every document; the fraction left takes documents in the order of their keys, as long as taking one whole brings
the source nearer to its target.

No source is sorted as a whole, as one may hold a third of all rows. The place at which a source's budget ends is found by
narrowing: the keys that may hold it are cut into BUCKETS equal ranges, sizes are added up by range before they are
shuffled, and a prefix sum shows the range to look into next, until it holds ``per_bucket`` rows at most; those alone are
sorted. However unequal the keys are, each round divides their range by BUCKETS. Equal keys (repeated ids) are told apart
by a hash of the row's contents, and equal rows by their place in the stored table, in the same way: so a source of rows
without ids, or of one repeated row, comes near its target as any other. What comes out is one cut-off a source; the final
pass compares each row with its source's.

Targets are found by rounds too: a sum over the table of sources each, which nothing collects.

Defined results: a null text has no words and is taken for 0; a null source is a source of its own, last in order; a null
id has the key of its row's contents; of equal rows, which ones are taken isn't defined, only how many; columns of any
name pass through ``repeated`` unchanged, as a struct; an empty table gives no rows. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from lodeseek.llm.common import GAP, Scratch
from lodeseek.operators.ranking import numbered

SPACES = " \t\n\x0b\x0c\r"
#: Sources whose cut-offs are broadcast at most, about 100 bytes each; beyond that the join shuffles, and AQE splits hot sources.
BROADCAST_SOURCES = 50_000
#: Ranges that keys are cut into, each round.
BUCKETS = 1024
#: What orders a source's rows: the key, then hashes that tell equal keys apart.
ORDER = ("_key", "_tie", "_row")


def n_words(text: str = "text") -> Column:
    trimmed = F.btrim(F.col(text), F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP, -1))).cast("long")


def quality(text: str = "text") -> Column:
    """From 0.05 to 1: the eighth power of the share of characters that aren't symbols."""
    clean = F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")) / F.length(text)
    return F.greatest(F.lit(0.05), F.coalesce(F.pow(clean, F.lit(8)), F.lit(1.0)))


def sampling_key(id_col: str = "doc_id", weight: Column | None = None, seed: int = 17, otherwise: Column | None = None) -> Column:
    """-ln(u) / weight. otherwise: what stands for a null id."""
    name = F.coalesce(F.col(id_col).cast("string"), *([] if otherwise is None else [otherwise.cast("string")]), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / (F.lit(1.0) if weight is None else weight)


def contents(docs: DataFrame) -> Column:
    """A hash of 52 bits of a row's plain columns; a double holds it exactly."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, (T.AtomicType,)) and not isinstance(f.dataType, T.NullType)]
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), *plain), 12).cast("double")


def targets(sources: DataFrame, total_share: float = 1.5, most_epochs: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """source, source_size, target: shares by weight in the sources' order, stopped at most_epochs, the excess shared again.

    That ends where every source not stopped has the same target per weight, its level: each round stops the sources that
    the level is beyond, and shares what they leave."""
    d = numbered(sources, [F.col("source").isNull(), "source"], "place")
    d = d.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    d = d.withColumn("most", F.col("source_size") * F.lit(float(most_epochs)))
    level, open_ = 0.0, None
    while True:
        stopped = F.lit(False) if open_ is None else F.col("most") <= F.col("w") * F.lit(level)
        total, over, weight, n = d.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("w"))), F.count(F.when(~stopped, 1))).first()
        if n == open_ or not n:
            break
        open_, level = n, ((total or 0) * float(total_share) - (over or 0.0)) / weight
    share = F.col("most") if not n else F.least(F.col("most"), F.col("w") * F.lit(level))
    return d.select("source", "source_size", share.alias("target"))


def within(level: Column) -> Column:
    """Whether a row may be where its source's budget ends: equal to what is fixed, and between low and high."""
    here, out = {k: F.col(c) for k, c in enumerate(ORDER)}, F.lit(False)
    for k in reversed(range(len(ORDER))):
        fixed = F.lit(True)
        for i in range(k):
            fixed = fixed & (here[i] == F.col(f"fixed{i}"))
        out = F.when(level == k, fixed & here[k].between(F.col("low"), F.col("high"))).otherwise(out)
    return out


def narrowed(base: DataFrame, goal: DataFrame, per_bucket: int, scratch: Scratch) -> DataFrame:
    """goal with, by source, the rows (level, fixed0 and on, low, high) where the budget ends, and the rest of it there;
    level is null where it doesn't end. Each round is one aggregation over base."""
    state = goal.withColumn("level", F.when(F.col("rows").isNotNull() & (F.col("budget") < F.col("source_size")), 0)).withColumn("rest", F.col("budget").cast("double"))
    for i in range(len(ORDER) - 1):
        state = state.withColumn(f"fixed{i}", F.lit(None).cast("double"))
    state, k = scratch.save(state, "state-0"), 0
    while True:
        # A range of one value is gone into by the next column.
        deeper = (F.col("low") == F.col("high")) & (F.col("level") < len(ORDER) - 1)
        open_ = F.col("level").isNotNull() & (F.col("rows") > per_bucket) & (deeper | (F.col("low") < F.col("high")))
        if state.filter(open_).isEmpty():
            return state
        live = state.filter(open_).withColumns({f"fixed{i}": F.when(deeper & (F.col("level") == i), F.col("low")).otherwise(F.col(f"fixed{i}")) for i in range(len(ORDER) - 1)})
        # One column deeper, any value may be next: both hashes have 52 bits.
        live = live.select("source", *[f"fixed{i}" for i in range(len(ORDER) - 1)], "rest", (F.col("level") + deeper.cast("int")).alias("level"), F.when(deeper, F.lit(0.0)).otherwise(F.col("low")).alias("low"), F.when(deeper, F.lit(float(1 << 52))).otherwise(F.col("high")).alias("high"))
        live = scratch.save(live, f"live-{k}")
        rows = base.join(few(live), F.col("_source").eqNullSafe(F.col("source"))).filter(within(F.col("level")))
        x = F.element_at(F.array(*[F.col(c) for c in ORDER]), F.col("level") + 1)
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS)).cast("int")
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("_size").alias("n"), F.count("*").alias("rows"), F.min(x).alias("low"), F.max(x).alias("high"))
        before = F.coalesce(F.sum("n").over(W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before).join(live.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        found = sums.filter(F.col("before") + F.col("n") > F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.min_by(F.struct("low", "high", "rows", (F.col("rest") - F.col("before")).alias("rest")), "bucket").alias("found"))
        live = live.drop("low", "high", "rest").join(found, F.col("source").eqNullSafe(F.col("s")))
        new = live.select(F.col("source").alias("s"), F.struct("level", *[f"fixed{i}" for i in range(len(ORDER) - 1)], F.col("found.low"), F.col("found.high"), F.col("found.rows"), F.col("found.rest")).alias("new"))
        changed = ("level", *[f"fixed{i}" for i in range(len(ORDER) - 1)], "low", "high", "rows", "rest")
        k += 1
        state = scratch.save(state.join(new, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in changed}).drop("s", "new"), f"state-{k}")


def few(goal: DataFrame) -> DataFrame:
    """goal, to be broadcast if a count finds it small."""
    return F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal


def mixed(docs: DataFrame, weight: Column | None = None, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, per_bucket: int = 20_000, keep: bool = False, **shares) -> DataFrame:
    """id, source, size, source_size, target, taken for each row; keep adds row, a struct of all its columns.

    Sizes and keys are computed once, in the pass that stores them; with keep the rows are stored beside them."""
    scratch = Scratch(docs.sparkSession, "mix")
    tie = contents(docs)
    slim = [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), (n_words() if size is None else size).alias("_size"), sampling_key(id_col, weight, seed, tie).alias("_key"), tie.alias("_tie")]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    stored = scratch.save(docs.select(*slim, *row), "base")
    # Hidden columns: where a row is in the stored table, which is read again and again.
    place = F.shiftrightunsigned(F.xxhash64(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1), F.col("_metadata.row_index")), 12).cast("double")
    base = stored.select("*", place.alias("_row"))
    slim_base = base.drop("row")
    sums = scratch.save(slim_base.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"), F.min("_key").alias("low"), F.max("_key").alias("high")), "sums")
    goal = targets(sums.select("source", "source_size"), **shares).join(sums.select(F.col("source").alias("s"), "rows", "low", "high"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("budget", F.when(F.col("source_size") > 0, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    goal = narrowed(slim_base, scratch.save(goal, "goal"), per_bucket, scratch)
    # Only the rows among which a source's budget ends are sorted.
    ends = goal.filter("level is not null").select("source", "level", "low", "high", "rest", *[f"fixed{i}" for i in range(len(ORDER) - 1)])
    last = slim_base.join(few(ends), F.col("_source").eqNullSafe(F.col("source"))).filter(within(F.col("level")))
    run = W.Window.partitionBy("_source").orderBy(*ORDER).rowsBetween(W.Window.unboundedPreceding, -1)
    mine = F.struct(*ORDER)
    near = F.coalesce(F.sum("_size").over(run), F.lit(0)) + F.col("_size") / 2 <= F.col("rest")
    cut = last.withColumn("near", near).groupBy(F.col("_source").alias("s")).agg(F.max(F.when(F.col("near"), mine)).alias("cut"), F.min(mine).alias("first"))
    goal = scratch.save(goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(*[F.col(c).alias(f"_g_{c}") for c in ("source", "source_size", "target", "epochs", "level", "cut", "first")]), "cuts")
    out = (base if keep else slim_base).join(few(goal), F.col("_source").eqNullSafe(F.col("_g_source")))
    partly = F.when(F.col("_g_cut").isNotNull(), mine <= F.col("_g_cut")).otherwise(F.coalesce(mine < F.col("_g_first"), F.lit(False)))
    taken = F.col("_size") * (F.col("_g_epochs") + F.when(F.col("_g_level").isNotNull() & partly, 1).otherwise(0))
    named = {"_id": "id", "_source": "source", "_size": "size", "_g_source_size": "source_size", "_g_target": "target"}
    return out.select(*(["row"] if keep else []), *[F.col(x).alias(y) for x, y in named.items()], taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' columns. Rows without words never are."""
    rows = mixed(docs, keep=True, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return rows.select("row", times.alias("times")).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
