"""Combining datasets by position or key."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _value(df: DataFrame, pos: str) -> Column:
    values = [c for c in df.columns if c != pos]
    return F.col(values[0]) if len(values) == 1 else F.struct(*values)


def zip_positions(a: DataFrame, a_pos: str, b: DataFrame, b_pos: str) -> DataFrame:
    """Pairs of equal position; the longer side's rest is cut off."""
    left = a.select(F.col(a_pos).alias("pos"), _value(a, a_pos).alias("first"))
    return left.join(b.select(F.col(b_pos).alias("pos"), _value(b, b_pos).alias("second")), "pos")


def chain(a: DataFrame, a_pos: str, b: DataFrame, b_pos: str, n: int) -> DataFrame:
    """a's rows, then b's; n is a's length. Repeats stay."""
    moved = b.withColumn(b_pos, F.col(b_pos) + n).withColumnRenamed(b_pos, a_pos)
    return a.unionByName(moved)


def both(left: Callable[[], Any], right: Callable[[], Any]) -> tuple[Any, Any]:
    """Runs two jobs side by side and returns both results; an error of either is raised after both ended."""
    session = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(session) if session else lambda f: f
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(inherit(left)), pool.submit(inherit(right))
    return a.result(), b.result()


def task_stats(spark: SparkSession, job: Callable[[], Any]) -> tuple[int, int, int]:
    """Runs the job and counts the tasks that its stages had, those that completed and those that failed."""
    context, group = spark.sparkContext, f"stats-{uuid.uuid4().hex}"
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        job()
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    infos = [i for i in map(tracker.getStageInfo, stages) if i is not None]
    return sum(i.numTasks for i in infos), sum(i.numCompletedTasks for i in infos), sum(i.numFailedTasks for i in infos)


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each key with the table's values, null where it has none."""
    return keys.join(table, key, "left")


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The table after puts in order of ``seq``: the last value of a key wins, the table's own comes before all."""
    every = table.withColumn(seq, F.lit(None).cast(changes.schema[seq].dataType)).unionByName(changes)
    values = [c for c in table.columns if c != key]
    last = F.max_by(F.struct(*values), F.struct(F.col(seq).isNotNull(), F.col(seq)))
    return every.groupBy(key).agg(last.alias("v")).select(key, *(F.col("v")[c].alias(c) for c in values))


def previous_values(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """What each put returns: the changes with a struct ``previous``, the key's value before it, null for a new key."""
    values = [c for c in table.columns if c != key]
    every = table.withColumn(seq, F.lit(None).cast(changes.schema[seq].dataType)).unionByName(changes)
    before = F.lag(F.struct(*values)).over(Window.partitionBy(key).orderBy(F.col(seq).asc_nulls_first()))
    return every.withColumn("previous", before).where(F.col(seq).isNotNull())


def contains(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each key with ``found``: whether the table has it. A null key isn't found."""
    return keys.join(table.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def size(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("len"))


def for_each_value(table: DataFrame, key: str, f: Callable[[Column], Column]) -> DataFrame:
    """The table with f applied to each value."""
    return table.select(key, *(f(F.col(c)).alias(c) for c in table.columns if c != key))


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def merge_counts(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    return a.unionByName(b).groupBy(key).agg(F.sum(count).alias(count))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(i, k, a) times b(k, j, b) as (i, j, c)."""
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("c"))


def neighbours(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Live neighbours of each cell of a wrapped grid that has any. cells: r, c of the live ones."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    near = cells.select(F.explode(around).alias("d"), "r", "c").select(F.pmod(F.col("r") + F.col("d.i"), F.lit(rows)).alias("r"), F.pmod(F.col("c") + F.col("d.j"), F.lit(cols)).alias("c"))
    return near.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
