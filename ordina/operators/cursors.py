"""Cursors that hand rows to the driver in order, a partition at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class ChunkCursor:
    """Lists of at most ``size`` rows in order; a size below 1 counts as 1."""

    def __init__(self, df: DataFrame, pos: str, size: int) -> None:
        self.df, self.pos, self.size = df, pos, max(1, size)
        self._total: int | None = None
        self.reset()

    def reset(self) -> None:
        """Starts anew at the first chunk."""
        self._rows: Iterator[Row] | None = None
        self._given = 0

    def next(self) -> list[Row] | None:
        """The next chunk, None after the last."""
        if self._rows is None:
            self._rows = self.df.orderBy(self.pos).toLocalIterator()
        chunk = [r for _, r in zip(range(self.size), self._rows, strict=False)]
        self._given += len(chunk)
        return chunk or None

    def remaining(self) -> int:
        """How many rows haven't been given yet."""
        if self._total is None:
            self._total = self.df.count()
        return self._total - self._given

    def __iter__(self) -> Iterator[list[Row]]:
        while (chunk := self.next()) is not None:
            yield chunk


class StepCursor:
    """Every k-th row of dense positions from 0; a step of 0 counts as 1."""

    def __init__(self, df: DataFrame, pos: str, k: int) -> None:
        self.df, self.pos, self.k = df, pos, max(1, k)
        self.reset()

    def reset(self) -> None:
        """Starts anew at the first row."""
        self.at = 0
        self._rows: Iterator[Row] | None = None

    def _rest(self) -> DataFrame:
        at = F.col(self.pos)
        return self.df.where((at >= self.at) & (at % self.k == 0))

    def next(self) -> Row | None:
        """The row at the cursor, which moves on by a step; None beyond the last."""
        if self._rows is None:
            self._rows = self._rest().orderBy(self.pos).toLocalIterator()
        if (row := next(self._rows, None)) is not None:
            self.at += self.k
        return row

    def collect(self) -> DataFrame:
        """The rows from the cursor on, which is exhausted by it."""
        rest = self._rest()
        self._rows = iter(())
        return rest

    def __iter__(self) -> Iterator[Row]:
        while (row := self.next()) is not None:
            yield row
