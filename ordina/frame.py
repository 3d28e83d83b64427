"""Ordered datasets: a DataFrame and the column that holds each row's position from 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordina.functions import reducers as R
from ordina.operators import chunks, combine, folds, ordering, rowwise, search
from ordina.operators.cursors import ChunkCursor, StepCursor
from ordina.plans.scratch import materialise
from ordina.plans.splitter import Splitter

Expr = Column | Callable[..., Column]


def with_pos(df: DataFrame, order_by: list[Column | str], pos: str = "pos") -> DataFrame:
    """Adds dense positions in the given order without a one-task window.

    Rows are range-sorted and written once, so partitions stay as they are; a
    position is the rows in earlier partitions plus the row's place in its own.
    Rows that tie in ``order_by`` go by a hash of the whole row, so that a frequent
    key is cut like any; only rows that are equal throughout share a partition, and
    which of them comes first makes no difference.  Columns of maps can't be hashed
    and leave ties as they are.
    """
    names = df.columns
    at = F.monotonically_increasing_id()
    part, place, size, offset = (n + "_" * sum(c.startswith(n) for c in names) for n in ("_part", "_place", "_size", "_offset"))
    whole = [F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in names))] if "map<" not in df.schema.simpleString() else []
    ordered = df.repartitionByRange(*order_by, *whole).sortWithinPartitions(*order_by, *whole)
    placed = materialise(ordered.select(*names, F.shiftright(at, 33).alias(part), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(place)), "placed")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    return placed.join(F.broadcast(offsets), part).select(*names, (F.col(offset) + F.col(place)).cast("bigint").alias(pos))


@dataclass(frozen=True)
class Ordered:
    """An immutable ordered dataset. Operators return new ones, terminal ones a DataFrame of one row or none.

    ``pos`` holds dense positions from 0 (see ``with_pos``).  Operators that drop
    rows leave gaps, which are closed before any operator that goes by position.  A
    predicate that is null isn't met.  Callables get the frame's Column of a name, or the position
    where they are indexed, and the context where one was given.
    """

    df: DataFrame
    pos: str = "pos"
    splitter: Splitter = field(default_factory=Splitter)
    workers: int | None = None
    context: Any = None
    pool: str | None = None
    gapped: bool = False

    # Sources.
    @classmethod
    def of(cls, df: DataFrame, pos: str = "pos") -> Ordered:
        return cls(df, pos)

    @classmethod
    def range(cls, spark: SparkSession, start: int, end: int, name: str = "v") -> Ordered:
        """The half-open range, empty if end is not above start."""
        return cls(spark.range(start, max(start, end)).select((F.col("id") - start).alias("pos"), F.col("id").alias(name)))

    @classmethod
    def values(cls, spark: SparkSession, items: list[Any], dtype: str = "bigint", name: str = "v") -> Ordered:
        return cls(spark.createDataFrame(list(enumerate(items)), f"pos bigint, {name} {dtype}"))

    # Configuration: shapes chunks and parallelism, never other results.
    def with_splitter(self, s: Splitter) -> Ordered:
        return replace(self, splitter=s)

    def with_workers(self, n: int) -> Ordered:
        return replace(self, workers=n)

    def with_pool(self, name: str) -> Ordered:
        """Runs what this object itself runs in the named scheduler pool; for actions on ``df`` see ``in_pool``."""
        return replace(self, pool=name)

    @contextmanager
    def in_pool(self) -> Iterator[None]:
        """What this thread runs meanwhile belongs to the pool; afterwards to what it belonged to before."""
        context = self.df.sparkSession.sparkContext
        before = context.getLocalProperty("spark.scheduler.pool")
        if self.pool is not None:
            context.setLocalProperty("spark.scheduler.pool", self.pool)
        try:
            yield
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)

    def with_min_chunk(self, n: int) -> Ordered:
        """Replaces the splitter; an earlier number of chunks is forgotten."""
        return replace(self, splitter=Splitter.adaptive(n))

    def with_max_chunks(self, n: int) -> Ordered:
        return replace(self, splitter=self.splitter.with_target_chunks(n))

    def with_alloc(self, _: Any = None) -> Ordered:
        return self

    def with_context(self, context: Any) -> Ordered:
        return replace(self, context=context)

    def _with(self, df: DataFrame, gapped: bool | None = None) -> Ordered:
        return replace(self, df=df, gapped=self.gapped if gapped is None else gapped)

    def _closed(self) -> Ordered:
        return self.dense() if self.gapped else self

    def _expr(self, e: Expr, *args: Column) -> Column:
        if isinstance(e, Column):
            return e
        return e(self.context, *args) if self.context is not None else e(*args)

    @property
    def _n_workers(self) -> int:
        return self.workers or self.df.sparkSession.sparkContext.defaultParallelism

    # Row by row.
    def map(self, **columns: Expr) -> Ordered:
        return self._with(rowwise.project(self.df, self.pos, {k: self._expr(e, F.col(k) if k in self.df.columns else F.col(self.values_name)) for k, e in columns.items()}))

    def map_indexed(self, **columns: Expr) -> Ordered:
        o = self._closed()
        return o._with(rowwise.project(o.df, self.pos, {k: self._expr(e, F.col(self.pos), F.col(k) if k in self.df.columns else F.col(self.values_name)) for k, e in columns.items()}))

    @property
    def values_name(self) -> str:
        return next(c for c in self.df.columns if c != self.pos)

    def for_each(self, **columns: Expr) -> Ordered:
        return self._with(self.df.withColumns({k: self._expr(e, F.col(k)) for k, e in columns.items()}))

    def for_each_indexed(self, **columns: Expr) -> Ordered:
        o = self._closed()
        return o._with(o.df.withColumns({k: self._expr(e, F.col(self.pos), F.col(k)) for k, e in columns.items()}))

    def _met(self, p: Expr) -> Column:
        return self._expr(p, F.col(self.values_name))

    def filter(self, p: Expr) -> Ordered:
        """Keeps order; positions keep their gaps until an operator needs them closed."""
        return self._with(self.df.where(self._met(p)), gapped=True)

    filter_seq = filter

    def dense(self) -> Ordered:
        """Closes gaps in the positions."""
        return self._with(rowwise.densify(self.df, self.pos, with_pos), gapped=False)

    def filter_map(self, name: str, f: Expr) -> Ordered:
        return self._with(rowwise.filter_map(self.df, self.pos, name, self._met(f)), gapped=True)

    def flat_map(self, name: str, f: Expr) -> DataFrame:
        return rowwise.flat_map(self.df, self.pos, name, self._met(f))

    def partition(self, p: Expr) -> tuple[Ordered, Ordered]:
        a, b = rowwise.partition(self.df, self._met(p))
        return self._with(a, gapped=True), self._with(b, gapped=True)

    def inspect(self, observation: Any, *metrics: Column) -> Ordered:
        return self._with(self.df.observe(observation, *metrics))

    def enumerate(self, name: str = "indexed") -> DataFrame:
        return rowwise.enumerate_rows(self._closed().df, self.pos, name)

    def cloned(self) -> Ordered:
        return self

    def rev(self) -> Ordered:
        return self._closed()._with(rowwise.reverse(self._closed().df, self.pos))

    def step_by(self, k: int, offset: int = 0) -> Ordered:
        return self._closed()._with(rowwise.step_by(self._closed().df, self.pos, k, offset))

    def step_for_each(self, k: int, **columns: Expr) -> Ordered:
        return self._closed()._with(rowwise.step_update(self._closed().df, self.pos, k, {c: self._expr(e, F.col(c)) for c, e in columns.items()}))

    def skip(self, n: int) -> Ordered:
        return self._closed()._with(rowwise.skip(self._closed().df, self.pos, n))

    def take(self, n: int) -> Ordered:
        return self._closed()._with(rowwise.take(self._closed().df, self.pos, n))

    def steps(self, k: int) -> StepCursor:
        """A cursor over every k-th row."""
        return StepCursor(self._closed().df, self.pos, k)

    def nth(self, n: int) -> DataFrame:
        return self._closed().df.where(F.col(self.pos) == n)

    def first(self) -> DataFrame:
        return search.leftmost(self.df, self.pos, F.lit(True))

    def last(self) -> DataFrame:
        return search.rightmost(self.df, self.pos, F.lit(True))

    def len(self) -> int:
        with self.in_pool():
            return self.df.count()

    def is_empty(self) -> bool:
        with self.in_pool():
            return self.df.isEmpty()

    # Reductions.
    def _type(self, name: str | None) -> tuple[Column, str]:
        name = name or self.values_name
        return F.col(name), self.df.schema[name].dataType.simpleString()

    def sum(self, name: str | None = None) -> DataFrame:
        return self.df.agg(R.sum_of(*self._type(name)).alias("sum"))

    def product(self, name: str | None = None) -> DataFrame:
        v, t = self._type(name)
        return folds.exact_product(self.df, v, t) if t not in ("float", "double") else self.df.agg(R.product_of(v, t).alias("product"))

    def min(self, name: str | None = None) -> DataFrame:
        return self.df.agg(R.min_of(*self._type(name)).alias("min"))

    def max(self, name: str | None = None) -> DataFrame:
        return self.df.agg(R.max_of(*self._type(name)).alias("max"))

    def min_by_key(self, key: Expr) -> DataFrame:
        return search.best_by_key(self.df, self.pos, self._met(key), smallest=True)

    def max_by_key(self, key: Expr) -> DataFrame:
        return search.best_by_key(self.df, self.pos, self._met(key), smallest=False)

    def _comparing(self, less: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        """less on values where a row has one value, else on rows; what is null isn't less."""
        values = [c for c in self.df.columns if c != self.pos]
        value = (lambda r: r[values[0]]) if len(values) == 1 else (lambda r: r)
        return lambda a, b: F.coalesce(less(value(a), value(b)), F.lit(False))

    def min_by(self, less: Callable[[Column, Column], Column]) -> DataFrame:
        """The first row that none is less than, by any strict less-than of two values (or rows); no row for an empty table."""
        lt = self._comparing(less)
        with self.in_pool():
            return search.best_by(self.df, self.pos, lt)

    def max_by(self, less: Callable[[Column, Column], Column]) -> DataFrame:
        """The first row that is less than none."""
        lt = self._comparing(less)
        with self.in_pool():
            return search.best_by(self.df, self.pos, lambda item, best: lt(best, item))

    def reduce(self, reducer: R.Reducer, name: str | None = None) -> Any:
        """By the built-in aggregate where the reducer is a known one; nulls are skipped."""
        v, t = self._type(name)
        with self.in_pool():
            if reducer.kind == "custom":
                return folds.tree_reduce(self.df, self.pos, v, reducer)
            return folds.known_reduce(self.df, v, t, reducer)

    def try_fold(self, init: Any, f: Callable[[Any, Any], Any], name: str | None = None) -> Any:
        v, _ = self._type(name)
        with self.in_pool():
            return folds.ordered_fold(self.df, self.pos, v, init, f)

    def try_reduce(self, f: Callable[[Any, Any], Any], name: str | None = None) -> Any:
        v, _ = self._type(name)
        with self.in_pool():
            return folds.ordered_reduce(self.df, self.pos, v, f)

    # Search.
    def count(self, p: Expr) -> DataFrame:
        return self.df.agg(F.count_if(self._met(p)).alias("count"))

    def any(self, p: Expr) -> DataFrame:
        return self.df.agg(R.any_of(self._met(p)).alias("any"))

    def all(self, p: Expr) -> DataFrame:
        return self.df.agg(R.all_of(self._met(p)).alias("all"))

    def exists(self, p: Expr) -> bool:
        """Like any(), but stops at the first match."""
        with self.in_pool():
            return not self.df.where(self._met(p)).limit(1).isEmpty()

    def find_first(self, p: Expr) -> DataFrame:
        return search.leftmost(self.df, self.pos, self._met(p))

    find = find_first

    def find_last(self, p: Expr) -> DataFrame:
        return search.rightmost(self.df, self.pos, self._met(p))

    def find_map(self, name: str, f: Expr) -> DataFrame:
        return search.find_map(self.df, self.pos, name, self._met(f))

    def position(self, p: Expr) -> DataFrame:
        return search.position(self._closed().df, self.pos, self._met(p))

    # Chunks.
    def chunk_ids(self, n: int | None = None) -> DataFrame:
        rows = self.len() if n is None else n
        return self._closed().df.withColumn("chunk_id", self.splitter.chunk_of(F.col(self.pos), rows, self._n_workers))

    def chunks(self, f: Callable[..., Any], schema: str, n: int | None = None) -> DataFrame:
        """f(chunk number, pandas frame) for each chunk; data without rows are one empty chunk 0."""
        rows = self.len() if n is None else n
        if not rows:
            return chunks.apply_empty(self.df, f, schema)
        return chunks.apply_chunks(self.chunk_ids(rows), self.pos, f, schema)

    def chunks_agg(self, *aggregates: Column, n: int | None = None) -> DataFrame:
        return self.chunk_ids(n).groupBy("chunk_id").agg(*aggregates)

    def iter_chunks(self, size: int) -> ChunkCursor:
        """A cursor over lists of at most ``size`` rows in order."""
        return ChunkCursor(self.df, self.pos, size)

    # Order and combination.
    def sort(self, *keys: Column) -> Ordered:
        return self._with(ordering.stable_sort(self.df, self.pos, list(keys), with_pos), gapped=False)

    def sort_by(self, less: Callable[[Column, Column], Column]) -> Ordered:
        """A stable sort by any strict less-than of two values (or rows)."""
        lt = self._comparing(less)
        with self.in_pool():
            return self._with(ordering.comparator_sort(self.df, self.pos, lt), gapped=False)

    def top_k(self, k: int, *keys: Column) -> DataFrame:
        return ordering.top_k(self.df, k, [*keys, F.col(self.pos)])

    def zip(self, other: Ordered) -> DataFrame:
        return combine.zip_positions(self._closed().df, self.pos, other._closed().df, other.pos)

    def chain(self, other: Ordered) -> Ordered:
        a, b = self._closed(), other._closed()
        return a._with(combine.chain(a.df, self.pos, b.df, other.pos, self.len()))
