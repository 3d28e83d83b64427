"""Search operators: single-pass aggregates with map-side partial results; no sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, best: Column) -> DataFrame:
    return df.agg(best.alias("r")).where(F.col("r").isNotNull()).select("r.*")


def leftmost(df: DataFrame, pos: str, p: Column) -> DataFrame:
    return _one(df.where(p), F.min_by(F.struct(*df.columns), F.col(pos)))


def rightmost(df: DataFrame, pos: str, p: Column) -> DataFrame:
    return _one(df.where(p), F.max_by(F.struct(*df.columns), F.col(pos)))


def position(df: DataFrame, pos: str, p: Column) -> DataFrame:
    """The smallest matching position, null if there is none."""
    return df.where(p).agg(F.min(pos).alias("position"))


def find_map(df: DataFrame, pos: str, name: str, f: Column) -> DataFrame:
    """The first image that isn't null."""
    return df.select(pos, f.alias(name)).where(F.col(name).isNotNull()).agg(F.min_by(name, pos).alias(name))


def best_by_key(df: DataFrame, pos: str, key: Column, smallest: bool) -> DataFrame:
    """The row of the smallest or largest key, the first of ties; no row if the table is empty or all keys are null."""
    rows, keyed = F.struct(*df.columns), df.where(key.isNotNull())
    return _one(keyed, F.min_by(rows, F.struct(key, F.col(pos))) if smallest else F.max_by(rows, F.struct(key, -F.col(pos))))


def best_by(df: DataFrame, pos: str, better: Callable[[Column, Column], Column], group: int = 1024) -> DataFrame:
    """The first row that no other is better than, by a strict better(item, best) of row structs; no row for an empty table.

    A tournament: rows of neighbouring positions fold in order, ``group`` at most,
    and so do their winners, until one is left.
    """
    last = df.agg(F.max(pos)).first()[0]
    rows = df.select(F.col(pos).alias("p"), F.struct(*df.columns).alias("r"))
    while last is not None:
        own = F.array_sort(F.collect_list(F.struct("p", "r")), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
        items = rows.groupBy(F.floor(F.col("p") / group).cast("bigint").alias("p")).agg(own.alias("items")).withColumn("items", F.transform("items", lambda x: x["r"]))
        rows = items.select("p", F.aggregate("items", F.element_at("items", 1), lambda best, x: F.when(better(x, best), x).otherwise(best)).alias("r"))
        if last < group:
            break
        last //= group
    return rows.select("r.*")


def insert_point(df: DataFrame, v: Column, pivot: Column) -> DataFrame:
    """Lower bound of the pivot in sorted values: how many are smaller."""
    return df.agg(F.count_if(v < pivot).alias("insert_point"))
