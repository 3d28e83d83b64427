"""Folds that aggregates can't express: exact products, custom reducers, strictly ordered folds."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.functions.reducers import Reducer


def exact_product(df: DataFrame, v: Column, dtype: str) -> DataFrame:
    """Product of integers without rounding, 1 for no rows; out of range raises.

    Values are first counted, so equal ones meet before any shuffle; ones vanish
    and a zero decides.  A product within bigint has at most 63 factors beyond
    one, so the values that are multiplied, in decimals, never are more than that.
    """
    counted = df.select(v.cast("bigint").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    signs = counted.agg(
        F.coalesce(F.bool_or(F.col("x") == 0), F.lit(False)).alias("zero"),
        F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("n"))), F.lit(0)).alias("negative"),
        F.coalesce(F.sum(F.when(F.abs("x") > 1, F.col("n"))), F.lit(0)).alias("factors"),
    )
    some = counted.where(F.abs("x") > 1).limit(64).select(F.abs("x").cast("decimal(38,0)").alias("x"), F.least("n", F.lit(64)).cast("int").alias("n"))
    listed = some.agg(F.collect_list(F.struct("x", "n")).alias("xs"))
    power = F.aggregate("xs", F.lit(1).cast("decimal(38,0)"), lambda a, s: F.aggregate(F.array_repeat(s["x"], s["n"]), a, lambda b, x: (b * x).cast("decimal(38,0)")))
    size = F.when(F.col("zero"), F.lit(0).cast("decimal(38,0)")).when(F.col("factors") > 63, F.raise_error(F.lit("product out of range"))).otherwise(power)
    return signs.crossJoin(F.broadcast(listed)).select((F.when(F.col("negative") % 2 == 1, -size).otherwise(size)).cast(dtype).alias("product"))


def known_reduce(df: DataFrame, v: Column, dtype: str, reducer: Reducer) -> Any:
    """Reduces by the built-in aggregate of the reducer's kind; its identity for no rows. Nulls are skipped."""
    if reducer.kind == "product" and dtype not in ("float", "double"):
        return exact_product(df, v, dtype).first()[0]
    best = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "all": F.bool_and, "any": F.bool_or}[reducer.kind](v)
    found = df.agg(best.alias("r")).first()[0]
    return reducer.identity if found is None else found


def tree_reduce(df: DataFrame, pos: str, v: Column, reducer: Reducer) -> Any:
    """Reduces with any associative function, whether or not it commutes. Nulls are skipped; structs come as dicts.

    Partitions of the range-sorted rows fold in order, a partial result each; the
    few partial results are combined in order of their partitions.
    """
    ordered = df.select(F.col(pos).cast("bigint").alias("pos"), v.alias("v")).where("v is not null").repartitionByRange("pos").sortWithinPartitions("pos")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, reducer.identity
        for batch in batches:
            if batch.num_rows and first is None:
                first = batch.column("pos")[0].as_py()
            for x in batch.column("v").to_pylist():
                total = reducer.combine(total, x)
        if first is not None:
            yield pa.record_batch([pa.array([first], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["pos", "total"])

    partial = ordered.mapInArrow(part, "pos bigint, total binary").collect()  # a row for each partition
    return reducer.reduce_values(pickle.loads(r["total"]) for r in sorted(partial, key=lambda r: r["pos"]))


def ordered_fold(df: DataFrame, pos: str, v: Column, init: Any, f: Callable[[Any, Any], Any]) -> Any:
    """Strictly left to right; the first error of f stops it and is raised.

    The order makes this sequential.  Rows stream to the driver a partition at a
    time, so memory stays bounded by a partition.
    """
    total = init
    for r in df.select(F.col(pos).alias("pos"), v.alias("v")).orderBy("pos").toLocalIterator():
        total = f(total, r["v"])
    return total


def ordered_reduce(df: DataFrame, pos: str, v: Column, f: Callable[[Any, Any], Any]) -> Any:
    """As ordered_fold from the first element on; None for no rows."""
    rows = df.select(F.col(pos).alias("pos"), v.alias("v")).orderBy("pos").toLocalIterator()
    total = next((r["v"] for r in rows), None)
    for r in rows:
        total = f(total, r["v"])
    return total


def fold_by_group(df: DataFrame, group: list[str], pos: str, v: Column, init: Column, step: Callable[[Column, Column], Column], name: str = "folded") -> DataFrame:
    """An ordered fold within each group, as one expression. Groups must fit an array each."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), v.alias("v"))))
    return df.groupBy(*group).agg(F.aggregate(items, init, lambda a, s: step(a, s["v"])).alias(name))
