"""Reducers: an identity and an associative function, with exact aggregates for the known ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest and largest value of each type: what an empty minimum or maximum is.
LIMITS = {
    "tinyint": (-(2**7), 2**7 - 1),
    "smallint": (-(2**15), 2**15 - 1),
    "int": (-(2**31), 2**31 - 1),
    "bigint": (-(2**63), 2**63 - 1),
    "float": (float("-inf"), float("inf")),
    "double": (float("-inf"), float("inf")),
}


@dataclass(frozen=True)
class Reducer:
    """``combine`` must be associative; ``identity`` is also what no rows reduce to. ``kind`` names a built-in one."""

    identity: Any
    combine: Callable[[Any, Any], Any]
    kind: str = "custom"

    def reduce_values(self, values: Iterable[Any]) -> Any:
        return reduce(self.combine, values, self.identity)

    def merge(self, a: Any, b: Any) -> Any:
        return self.combine(a, b)

    @classmethod
    def sum(cls) -> Reducer:
        return cls(0, lambda a, b: a + b, "sum")

    @classmethod
    def product(cls) -> Reducer:
        return cls(1, lambda a, b: a * b, "product")

    @classmethod
    def min(cls, dtype: str = "bigint") -> Reducer:
        return cls(LIMITS[dtype][1], min, "min")

    @classmethod
    def max(cls, dtype: str = "bigint") -> Reducer:
        return cls(LIMITS[dtype][0], max, "max")

    @classmethod
    def all(cls) -> Reducer:
        return cls(True, lambda a, b: a and b, "all")

    @classmethod
    def any(cls) -> Reducer:
        return cls(False, lambda a, b: a or b, "any")


def sum_of(v: Column, dtype: str) -> Column:
    """Sum, 0 for no rows, in the type of the elements: out of range raises under ANSI."""
    return F.coalesce(F.sum(v), F.lit(0)).cast(dtype)


def product_of(v: Column, dtype: str) -> Column:
    """Product in doubles, 1 for no rows; integers multiply exactly in operators.folds."""
    return F.coalesce(F.product(v), F.lit(1.0)).cast(dtype)


def min_of(v: Column, dtype: str) -> Column:
    return F.coalesce(F.min(v), F.lit(LIMITS[dtype][1])).cast(dtype)


def max_of(v: Column, dtype: str) -> Column:
    return F.coalesce(F.max(v), F.lit(LIMITS[dtype][0])).cast(dtype)


def any_of(p: Column) -> Column:
    return F.coalesce(F.bool_or(p), F.lit(False))


def all_of(p: Column) -> Column:
    """True for no rows; a null predicate counts as false."""
    return F.coalesce(F.bool_and(F.coalesce(p, F.lit(False))), F.lit(True))
