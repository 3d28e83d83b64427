"""Row-by-row operators. All are narrow except where a total is needed, and keep the order column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, pos: str, columns: dict[str, Column]) -> DataFrame:
    return df.select(pos, *(e.alias(k) for k, e in columns.items()))


def filter_map(df: DataFrame, pos: str, name: str, f: Column) -> DataFrame:
    """Rows whose image is null are dropped."""
    return df.select(pos, f.alias(name)).where(F.col(name).isNotNull())


def flat_map(df: DataFrame, pos: str, name: str, f: Column) -> DataFrame:
    """A row for each element of the image, in order of (pos, sub); a row of no elements vanishes."""
    return df.select(pos, F.posexplode(f).alias("sub", name))


def partition(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the predicate and rows that don't; a null one isn't met."""
    met = F.coalesce(p, F.lit(False))
    return df.where(met), df.where(~met)


def enumerate_rows(df: DataFrame, pos: str, name: str) -> DataFrame:
    values = [c for c in df.columns if c != pos]
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    return df.select(F.struct(F.col(pos).alias("index"), value.alias("value")).alias(name))


def reverse(df: DataFrame, pos: str) -> DataFrame:
    """Positions from the other end. The total is a one-row aggregate that is broadcast."""
    last = df.agg(F.max(pos).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn(pos, F.col("_last") - F.col(pos)).drop("_last")


def densify(df: DataFrame, pos: str, with_pos: Callable) -> DataFrame:
    """Closes gaps in the positions, keeping their order."""
    old = pos + "_before"
    return with_pos(df.withColumnRenamed(pos, old), [F.col(old)], pos).drop(old)


def step_by(df: DataFrame, pos: str, k: int, offset: int = 0) -> DataFrame:
    """Every k-th row from ``offset`` on, renumbered; k = 0 counts as 1."""
    k = max(1, k)
    at = F.col(pos) - offset
    return df.where((at >= 0) & (at % k == 0)).withColumn(pos, F.floor(at / k).cast("bigint"))


def step_update(df: DataFrame, pos: str, k: int, columns: dict[str, Column]) -> DataFrame:
    """Replaces values at every k-th position only."""
    return df.withColumns({c: F.when(F.col(pos) % max(1, k) == 0, e).otherwise(F.col(c)) for c, e in columns.items()})


def skip(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.where(F.col(pos) >= n).withColumn(pos, F.col(pos) - n)


def take(df: DataFrame, pos: str, n: int) -> DataFrame:
    """By position, not by limit: the same rows each time, and Parquet statistics prune."""
    return df.where(F.col(pos) < n)
