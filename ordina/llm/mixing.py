"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a digest of their id and queue up one
after another, epoch after epoch.  A document's virtual finish time is its
source's words up to and including it, divided by the source's target: at time 1
each source has been served its target and the total budget is used up, so the
global order is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.llm.common import fresh, named

#: Buckets of the shuffled order: running totals are taken within a bucket and over the buckets' sums, so no task holds a source.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(text.isNull() | (squeezed == ""), F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """sizes: source, source_size, weight.  Adds target: shares by weight of the total, each at most ``cap`` times its size.

    What a capped source leaves is shared anew by weight until none is above its
    cap: in order of cap a weight, a source is capped if the level of all that
    come no earlier reaches its cap.  One row for each source, so this window is
    small.  Sources of no words get 0.
    """
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = rest.cast("double") / F.sum("weight").over(onward)
    capped = cap * F.col("source_size").cast("double")
    leveled = sizes.withColumn("_level", level).withColumn("_cap", capped)
    # Levels rise while sources are capped and fall from the first that isn't on: the highest is the level of all that aren't.
    return leveled.withColumn("target", F.least("_cap", F.max("_level").over(every) * F.col("weight"))).drop("_level", "_cap")


def source_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last."""
    return sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, cap: int = 3, outcome: str = "mix", size_col: str | None = None) -> DataFrame:
    """The rows of docs with a struct column ``outcome``: size, source_size, target, epochs, taken and finish.

    size is the text's number of words, or ``size_col`` where that is given.  A
    serving's time is the virtual time at which half of the document has been
    served; those up to time 1 make the mix (see ``mixed_order``).  epochs counts
    them, at most ``cap``, taken is size times epochs.  finish is the virtual time
    at which the first serving ends.  ``weights`` has source and weight; by default
    weights are 1, 2, 3, repeating.

    Rows of null or empty text have size 0 and are taken 0 words, in no epoch.  A
    null source is a source of its own.  The shuffle is by md5 of the id as text,
    then id and size, so reruns agree; rows that tie in all of them are
    interchangeable.  Null ids count as ''.  Other columns pass through; the
    outcome column gets underscores appended if its name is taken.
    """
    (name,) = fresh(docs.columns, outcome)
    src, size, hashed, bucket, upto, own = fresh([*docs.columns, name], "_source", "_size", "_hash", "_bucket", "_upto", "_own")
    words = word_count(named(text_col)) if size_col is None else named(size_col).cast("bigint")
    ranked = docs.select("*", named(source_col).alias(src), words.alias(size), F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")).alias(hashed))
    ranked = ranked.withColumn(bucket, F.conv(F.substring(F.col(hashed), 1, 3), 16, 10).cast("int"))
    sums = ranked.groupBy(F.col(src).alias("source"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    weighed = source_weights(sizes) if weights is None else sizes.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("source").alias("_s"), "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    starts = ahead.join(targets(weighed, cap), F.col("_s").eqNullSafe(F.col("source"))).select(F.struct("source", "bucket", "ahead", "source_size", "target").alias(own))
    within = Window.partitionBy(src, bucket).orderBy(hashed, named(id_col).asc_nulls_last(), size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = ranked.withColumn(upto, F.sum(size).over(within))
    served = queued.join(starts, F.col(src).eqNullSafe(F.col(own)["source"]) & (F.col(bucket) == F.col(own)["bucket"]))
    at = {x: F.col(own)[x] for x in ("ahead", "source_size", "target")}
    end = at["ahead"] + F.col(upto)
    epochs = sum((_in_time(F.col(size), at["source_size"], at["target"], end, e) & (F.col(size) > 0)).cast("int") for e in range(cap))
    result = F.struct(F.col(size).alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"), epochs.alias("epochs"), (epochs * F.col(size)).alias("taken"), F.when(at["target"] > 0, end / at["target"]).alias("finish"), end.alias("upto"))
    return served.select(*map(named, docs.columns), result.alias(name))


def _in_time(size: Column, source_size: Column, target: Column, upto: Column, epoch: int | Column) -> Column:
    """Whether half of a document has been served by time 1, without the rounding of a division."""
    return 2 * (epoch * source_size + upto) - size <= 2 * target


def servings(mixed: DataFrame, outcome: str = "mix", cap: int = 3) -> DataFrame:
    """A row for each serving of ``cap`` epochs of what ``mix`` returned; its struct gets epoch, time, finish and served: whether it comes by time 1."""
    (epoch,) = fresh(mixed.columns, "_epoch")
    at, e = F.col(outcome), F.col(epoch)
    every = mixed.where((at["size"] > 0) & (at["target"] > 0)).select("*", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias(epoch))
    end = e * at["source_size"] + at["upto"]
    more = {"epoch": e, "time": (end - at["size"] / 2) / at["target"], "finish": end / at["target"], "served": _in_time(at["size"], at["source_size"], at["target"], at["upto"], e)}
    full = at
    for name, value in more.items():
        full = full.withField(name, value)
    return every.select(*(full.alias(c) if c == outcome else named(c) for c in mixed.columns))


def mixed_order(mixed: DataFrame, outcome: str = "mix", cap: int = 3) -> DataFrame:
    """The mix itself: a row for each serving, range-sorted by virtual time and cut off at time 1, when the budget is used up."""
    at = F.col(outcome)
    return servings(mixed, outcome, cap).where(at["served"]).withColumn(outcome, at.dropFields("served", "upto")).orderBy(at["time"], at["finish"])
