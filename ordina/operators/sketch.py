"""Frequency sketches as tables: a row for each used counter, built by one aggregation with partial sums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The largest prime below 2**31.
PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class CountMin:
    """depth rows of width counters. cap: counters saturate there (15 for 4 bits, 255 for 8, 65535 for 16); None: never.

    Rows hash independently, by xxhash64 or, for integer keys of less than 31 bits,
    by the universal family (a x + b) mod PRIME.
    """

    width: int = 2048
    depth: int = 4
    cap: int | None = 15
    seed: int = 0
    universal: bool = False

    def factors(self, row: int) -> tuple[int, int]:
        """a and b of a row's function in the universal family."""
        return pow(48271, self.seed * 64 + row + 1, PRIME), pow(16807, self.seed * 64 + row + 1, PRIME)

    def _hash(self, row: int, key: Column) -> Column:
        if self.universal:
            a, b = self.factors(row)
            return (F.lit(a).cast("bigint") * key + b) % F.lit(PRIME).cast("bigint")
        return F.xxhash64(F.lit(self.seed * 64 + row), key)

    def slots(self, key: Column) -> Column:
        """A struct (row, slot) for each row."""
        return F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(self._hash(r, key), F.lit(self.width).cast("bigint")).alias("slot")) for r in range(self.depth)))

    def _capped(self, count: Column) -> Column:
        return count if self.cap is None else F.least(count, F.lit(self.cap))

    def build(self, events: DataFrame, key: str, amount: Column | None = None) -> DataFrame:
        """Counters row, slot, count after all increments."""
        hit = events.select(F.explode(self.slots(F.col(key))).alias("s"), (amount if amount is not None else F.lit(1)).cast("bigint").alias("n"))
        return hit.groupBy("s.row", "s.slot").agg(self._capped(F.sum("n")).alias("count"))

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Sums of two sketches; saturating ones merge exactly."""
        return a.unionByName(b).groupBy("row", "slot").agg(self._capped(F.sum("count")).alias("count"))

    def age(self, sketch: DataFrame, shift: int = 1) -> DataFrame:
        """Halves the counters ``shift`` times."""
        return sketch.select("row", "slot", F.shiftright("count", shift).alias("count")).where("count > 0")

    def clear(self, sketch: DataFrame) -> DataFrame:
        return sketch.limit(0)

    def estimate(self, sketch: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """Each key's smallest counter, 0 if it has an unused one. Never below the true count until counters saturate."""
        wanted = keys.select(key).distinct().select(key, F.explode(self.slots(F.col(key))).alias("s")).select(key, "s.row", "s.slot")
        found = wanted.join(sketch, ["row", "slot"], "left")
        return found.groupBy(key).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))

    @classmethod
    def for_items(cls, items: int, **more: int) -> CountMin:
        """Width the power of two at or above four times the number of items."""
        return cls(width=1 << max(4, (4 * items - 1).bit_length()), **more)

    @classmethod
    def sized(cls, items: int, **more: int) -> CountMin:
        """Counters of 8 bits in three sizes: below 100,000 items, below a million, beyond."""
        depth, width = (4, 1 << 16) if items < 100_000 else (5, 1 << 17) if items < 1_000_000 else (6, 1 << 18)
        return cls(width=width, depth=depth, cap=255, **more)


def more_frequent(cms: CountMin, sketch: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with wins: whether a's estimate is strictly above b's."""
    keys = pairs.select(F.col(a).alias("k")).unionAll(pairs.select(F.col(b).alias("k")))
    est = cms.estimate(sketch, keys, "k")
    first, second = est.withColumnsRenamed({"k": a, "estimate": "ea"}), est.withColumnsRenamed({"k": b, "estimate": "eb"})
    return pairs.join(first, a).join(second, b).withColumn("wins", F.col("ea") > F.col("eb"))


class Packed:
    """A sketch in order of events: counters of 4 bits, two a byte, that saturate at 15; all halve after each 10 * width increments."""

    def __init__(self, width: int, depth: int = 4) -> None:
        self.width, self.depth = 1 << max(0, (width - 1).bit_length()), depth
        self.bytes = np.zeros((self.width * depth + 1) // 2, np.uint8)
        self.limit, self.seen = 10 * self.width, 0

    def _places(self, key: Any) -> list[int]:
        return [r * self.width + xxhash.xxh3_64_intdigest(repr(key).encode(), seed=r) % self.width for r in range(self.depth)]

    def add(self, key: Any) -> int:
        """Counts the key and returns its estimate."""
        for at in self._places(key):
            byte, shift = at >> 1, 4 * (at & 1)
            if (int(self.bytes[byte]) >> shift) & 15 < 15:
                self.bytes[byte] += 1 << shift
        self.seen += 1
        if self.seen >= self.limit:
            self.seen = 0
            self.halve()
        return self.of(key)

    def halve(self) -> None:
        """Each counter loses its lowest bit: a byte shifted, without the bit that would cross over."""
        self.bytes = (self.bytes >> 1) & 0x77

    def of(self, key: Any) -> int:
        return min((int(self.bytes[at >> 1]) >> 4 * (at & 1)) & 15 for at in self._places(key))

    def clear(self) -> None:
        self.bytes[:] = 0
        self.seen = 0


class Windowed:
    """Saturating counters that all halve when a window is full: at the first increment beyond ``factor`` * capacity.

    By default sized by capacity with 8 bits; ``wide`` has 16 bits, four rows, a
    width of four times the capacity and halves at ``factor`` * capacity.
    """

    def __init__(self, capacity: int, factor: int = 8, wide: bool = False) -> None:
        shape = CountMin.for_items(max(1, capacity)) if wide else CountMin.sized(capacity)
        self.width, self.depth, self.cap = shape.width, shape.depth, 65535 if wide else 255
        self.table = np.zeros((self.depth, self.width), np.uint16 if wide else np.uint8)
        self.rows = np.arange(self.depth)
        self.limit, self.seen, self.strict = factor * capacity, 0, wide

    def _slots(self, key: Any) -> list[int]:
        return [xxhash.xxh3_64_intdigest(repr(key).encode(), seed=r) % self.width for r in range(self.depth)]

    def add(self, key: Any) -> int:
        """Counts the key and returns its estimate."""
        slots = self._slots(key)
        for r, s in enumerate(slots):
            if self.table[r, s] < self.cap:
                self.table[r, s] += 1
        full = self.seen + 1 >= self.limit if self.strict else self.seen >= self.limit
        self.seen = 0 if full else self.seen + 1
        if full:
            self.table >>= 1
        return int(self.table[self.rows, slots].min())

    def of(self, key: Any) -> int:
        return int(self.table[self.rows, self._slots(key)].min())

    def more_frequent(self, a: Any, b: Any) -> bool:
        return self.of(a) > self.of(b)


class CountSketch:
    """Four rows of counters of 4 bits that saturate at 15 and halve on demand only; a width of ten times the capacity."""

    def __init__(self, capacity: int) -> None:
        self._packed = Packed(10 * capacity)
        self._packed.limit = float("inf")

    def add(self, key: Any) -> int:
        return self._packed.add(key)

    def of(self, key: Any) -> int:
        return self._packed.of(key)

    def halve(self) -> None:
        self._packed.halve()


def replay_sketch(events: DataFrame, make: Callable[[], Any], group: str = "sketch_id", seq: str = "seq", key: str = "key") -> DataFrame:
    """By group: the estimate of each key after all events in order, of a sketch that depends on their order.

    A group's events are sequential by nature and go through one task; groups run
    in parallel.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        sketch = make()
        keys = rows.sort_by([(seq, "ascending"), (key, "ascending")]).column(key).to_pylist()
        for k in keys:
            sketch.add(k)
        every = sorted(set(keys))
        return pa.table({group: pa.array([rows.column(group)[0].as_py()] * len(every), rows.schema.field(group).type), key: pa.array(every, rows.schema.field(key).type), "estimate": pa.array([sketch.of(k) for k in every], pa.int64())})

    whole = events.schema[group].dataType.simpleString()
    return events.select(group, seq, key).groupBy(group).applyInArrow(run, f"{group} {whole}, {key} {kind}, estimate bigint")
