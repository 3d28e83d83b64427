"""Chunk plans: how many rows a chunk has and which chunk a position falls in."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Splitter:
    """kind is 'fixed', 'adaptive' or 'recursive'; a minimum below 1 counts as 1."""

    kind: str = "adaptive"
    min_chunk: int = 2048
    target_chunks: int | None = None

    @classmethod
    def fixed(cls, n: int) -> Splitter:
        return cls("fixed", n)

    @classmethod
    def adaptive(cls, n: int) -> Splitter:
        return cls("adaptive", n)

    @classmethod
    def recursive(cls, n: int) -> Splitter:
        return cls("recursive", n)

    def with_target_chunks(self, n: int) -> Splitter:
        return replace(self, target_chunks=n)

    def with_min_chunk(self, n: int) -> Splitter:
        return replace(self, min_chunk=n)

    def chunk_size(self, rows: int, workers: int) -> int:
        least = max(1, self.min_chunk)
        if rows == 0:
            return 0
        if self.kind != "adaptive":
            return least
        wanted = self.target_chunks or 2 * workers or 1
        return max(least, max(1, rows // wanted))

    def num_chunks(self, rows: int, workers: int) -> int:
        return -(-rows // self.chunk_size(rows, workers)) if rows else 0

    def should_split(self, rows: int, workers: int) -> bool:
        return rows >= workers * max(1, self.min_chunk)

    def chunk_of(self, pos: Column, rows: int, workers: int) -> Column:
        """Chunk number of a position; everything is chunk 0 where splitting isn't worth it."""
        if not self.should_split(rows, workers):
            return F.lit(0).cast("bigint")
        return F.floor(pos / F.lit(self.chunk_size(rows, workers))).cast("bigint")
