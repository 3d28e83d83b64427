"""Sorting and top-k, stable by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.plans.scratch import materialise


def stable_sort(df: DataFrame, pos: str, keys: list[Column], with_pos: Callable) -> DataFrame:
    """Rows by the keys, ties in their old order, with new positions."""
    old = pos + "_before"
    return with_pos(df.withColumnRenamed(pos, old), [*keys, F.col(old)], pos).drop(old)


def sort_array_by(array: Column, less: Callable[[Column, Column], Column]) -> Column:
    """Sorts an array by any less-than; elements of which neither is less keep their order."""
    return F.array_sort(array, lambda a, b: F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0))


def comparator_sort(df: DataFrame, pos: str, less: Callable[[Column, Column], Column], rows_per_part: int = 10_000, parts: int = 1024) -> DataFrame:
    """Rows by any strict less-than of row structs, ties in their old order, with new dense positions.

    A sample of some 20 rows for each part is sorted; every 20th cuts the order,
    and each part is sorted by itself as an array.  There are at most ``parts``, so
    beyond parts * rows_per_part rows the parts grow.  Ties are cut by position.
    """
    n = df.count()
    k = max(1, min(parts, -(-n // rows_per_part)))
    rows = df.select(F.col(pos).alias("p"), F.struct(*df.columns).alias("r"))
    before = lambda a, b: less(a["r"], b["r"]) | (~less(b["r"], a["r"]) & (a["p"] < b["p"]))
    arranged = lambda items: sort_array_by(items, before)
    if k > 1:
        some = rows.where(F.pmod(F.xxhash64("p"), F.lit(max(1, n // (20 * k)))) == 0)
        cuts = some.agg(arranged(F.collect_list(F.struct("p", "r"))).alias("cuts")).select(F.filter("cuts", lambda _, i: i % 20 == 19).alias("cuts"))
        part = F.size(F.filter("cuts", lambda c: ~before(F.struct("p", "r"), c)))
        rows = materialise(rows.crossJoin(F.broadcast(cuts)).select("p", "r", part.alias("part")), "parts")
    else:
        rows = rows.withColumn("part", F.lit(0))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    done = rows.groupBy("part").agg(arranged(F.collect_list(F.struct("p", "r"))).alias("items")).join(F.broadcast(starts), "part")
    placed = done.select("start", F.posexplode("items").alias("i", "item"))
    return placed.select(*((F.col("start") + F.col("i")).cast("bigint").alias(c) if c == pos else F.col("item.r")[c].alias(c) for c in df.columns))


def top_k(df: DataFrame, k: int, keys: list[Column]) -> DataFrame:
    """The first k rows in a total order: each task keeps k, one task merges them."""
    return df.orderBy(*keys).limit(k)


def merge_sorted(a: DataFrame, b: DataFrame, pos: str, keys: list[str], with_pos: Callable) -> DataFrame:
    """Two sorted datasets as one; of ties a's come first."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1))).withColumnRenamed(pos, "_old")
    return with_pos(both, [*map(F.col, keys), F.col("_side"), F.col("_old")], pos).drop("_side", "_old")
