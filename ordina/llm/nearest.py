"""Nearest neighbours by inner product over shifted Hilbert orderings.

Vectors are projected and put in order along several shifted Hilbert curves,
range-partitioned by key; on each curve a query meets the vectors in a window
around its own key, and the windows' merged candidates are reranked exactly.

On vectors without structure few true neighbours lie near on any curve, so an
exact completion follows: the first ordering is cut into blocks, and a query
visits each block that by its centre and radius could still hold a vector above
the query's 20th best.  In clustered data most blocks are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm.common import materialise, named

DIMS, BITS = 8, 7
#: Vectors in a block, and blocks at most: their centres go to each task.
BLOCK, BLOCKS, QUERIES = 8192, 20_000, 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows of coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the reflections and exchanges of each level
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """Vectors of a list column as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of the components: equal vectors get equal scores wherever they meet."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _best(q: np.ndarray, own: int, v: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best, ties to the smaller id; rough: approximate scores; above: a floor that k others reach."""
    margin = 1e-9 * max(1.0, float(np.abs(rough).max(initial=0)))
    some = np.flatnonzero((rough >= above - margin) & (ids != own))
    if len(some) > k:
        kth = np.partition(rough[some], len(some) - k)[len(some) - k]
        cut = some[rough[some] >= kth - margin]
        if len(np.unique(ids[cut])) < k:  # repeated ids took places: the k best ids decide, each by its best row
            by = some[np.argsort(ids[some], kind="stable")]
            each = np.maximum.reduceat(rough[by], np.flatnonzero(np.concatenate([[True], ids[by][1:] != ids[by][:-1]])))
            kth = np.partition(each, max(0, len(each) - k))[max(0, len(each) - k)]
            cut = some[rough[some] >= kth - margin]
        some = cut
    exact = products(np.broadcast_to(q, (len(some), len(q))), v[some])
    order = np.lexsort((ids[some], -exact))
    order = order[np.sort(np.unique(ids[some][order], return_index=True)[1])][:k]
    return ids[some][order], exact[order]


class Curves:
    """Random projections, scales from a bounded sample, and a shift for each curve."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(curves, dim, DIMS)) / np.sqrt(dim)
        cells = 1 << BITS
        self.low, self.step, self.shift = [], [], rng.random((curves, DIMS)) * (cells / 2)
        for axes in self.axes:
            p = sample @ axes if len(sample) else np.zeros((1, DIMS))
            low, high = np.quantile(p, 0.01, axis=0), np.quantile(p, 0.99, axis=0)
            self.low.append(low)
            self.step.append(np.maximum(high - low, 1e-12) / (cells / 2 - 1))

    def keys(self, v: np.ndarray, curve: int) -> np.ndarray:
        at = np.clip((v @ self.axes[curve] - self.low[curve]) / self.step[curve], 0, (1 << BITS) / 2 - 1)
        return hilbert(np.floor(at + self.shift[curve]).astype(np.int64), BITS)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v: vectors of the most frequent length that aren't null or zero and hold only finite numbers, of rows with an id."""
    kind = rows.schema[vec_col].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) else T.DoubleType()
    v = named(vec_col) if isinstance(element, (T.FloatType, T.DoubleType)) else named(vec_col).cast("array<double>")
    read = rows.select(named(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    read = read.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = read.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return read.where(F.size("v") == (common["n"] if common else 0))


def _windows(half: int, k: int, every: int) -> Callable:
    """For the queries among rows in curve order: the best of the 2 * half rows around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, ids, v, done = None, np.empty(0, np.int64), None, 0

        def answer(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, v, done
            stop = len(ids) if last else max(done, len(ids) - half)
            out = [[], [], []]
            for i in done + np.flatnonzero(ids[done:stop] % every == 0):
                low = max(0, min(i - half, len(ids) - 2 * half - 1))
                part = slice(low, max(i + half, 2 * half) + 1)
                found, score = _best(v[i], ids[i], v[part], ids[part], v[part] @ v[i], k, -np.inf)
                out[0].append(np.full(len(found), ids[i]))
                out[1].append(found)
                out[2].append(score)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["query", "id", "score"])
            cut = max(0, stop - 2 * half)
            ids, v, done = ids[cut:], v[cut:], stop - cut

        for batch in batches:
            if not batch.num_rows:
                continue
            c, new, vectors = batch.column("curve").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"))
            for x in np.unique(c):
                if x != curve:
                    if v is not None:
                        yield from answer(True)
                    curve, ids, v, done = x, np.empty(0, np.int64), np.empty((0, vectors.shape[1])), 0
                own = c == x
                ids, v = np.concatenate([ids, new[own]]), np.concatenate([v, vectors[own]])
                yield from answer(False)
        if v is not None:
            yield from answer(True)

    return run


def _ball_of(v: np.ndarray) -> tuple[np.ndarray, float]:
    centre = v.mean(0)
    return centre, float(np.sqrt(((v - centre) ** 2).sum(1).max()))


def _ball(table: pa.Table) -> pa.Table:
    centre, radius = _ball_of(matrix(table.column("v")))
    return pa.table({"block": table.column("block").slice(0, 1), "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius])})


def _bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By query and block: what no inner product with a vector of the block exceeds."""
    bound = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * radii
    return bound + 1e-9 * np.abs(bound) + 1e-9


def _visits(balls: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable:
    """The pairs of chunk and block of which the block could hold something above the floor of one of the chunk's queries, once a batch."""
    blocks, centres, radii = balls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, chunk = matrix(batch.column("v")), batch.column("chunk").to_numpy()
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            for c in np.unique(chunk):
                own, met = np.flatnonzero(chunk == c), np.zeros(len(blocks), bool)
                for i in range(0, len(own), 256):
                    some = own[i : i + 256]
                    met |= (_bounds(q[some], centres, radii) >= floor[some, None]).any(0)
                yield pa.record_batch([pa.array(np.full(met.sum(), c)), pa.array(blocks[met])], names=["chunk", "block"])

    return run


def _tile(k: int) -> Callable:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if rows.num_rows and queries.num_rows:
            v, ids = matrix(rows.column("v")), rows.column("id").to_numpy()
            q, own, floor = matrix(queries.column("v")), queries.column("id").to_numpy(), queries.column("floor").to_numpy()
            centre, radius = _ball_of(v)
            live = np.flatnonzero(_bounds(q, centre[None], np.array([radius]))[:, 0] >= floor)
            for i in range(0, len(live), 128):
                rough = q[live[i : i + 128]] @ v.T
                for j, x in enumerate(live[i : i + 128]):
                    found, score = _best(q[x], own[x], v, ids, rough[j], k, floor[x])
                    out[0].append(np.full(len(found), own[x]))
                    out[1].append(found)
                    out[2].append(score)
        return pa.table({c: np.concatenate(x) for c, x in zip(("query", "id", "score"), out, strict=True)})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, a pair once; a query has at most k candidates from each window or tile."""
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, curves: int = 4, half: int = 64, sample: int = 4096, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``.

    Nearest is the largest inner product in double precision; ties go to the
    smaller id.  Vectors that are null, zero, hold null or non-finite components or
    aren't of the most frequent length take no part, nor do rows without id.  Rows
    of equal id are one row, scored by the best of its vectors.  Fewer than k
    candidates are all returned; an empty table gives no rows.  Columns besides the
    two named are not read.  ``exact=False`` leaves out the completion: then only
    the curves' windows are searched.
    """
    spark = rows.sparkSession
    vectors = materialise(usable(rows, id_col, vec_col), "vectors")
    n = vectors.count()
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    dim = len(some[0]["v"]) if some else 1
    shared = spark.sparkContext.broadcast(Curves(np.array([r["v"] for r in some], float).reshape(len(some), dim), dim, curves))
    kind = vectors.schema["v"].dataType.simpleString()

    def keyed(which: list[int]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = matrix(batch.column("v"))
                    for c in which:
                        yield pa.record_batch([pa.array(np.full(len(v), c, np.int32)), pa.array(shared.value.keys(v, c)), batch.column("id"), batch.column("v")], names=["curve", "key", "id", "v"])

        return run

    order = vectors.mapInArrow(keyed(list(range(curves))), f"curve int, key bigint, id bigint, v {kind}")
    near = order.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id").mapInArrow(_windows(half, k, every), "query bigint, id bigint, score double")
    found = materialise(_ranked(near, k).select("query", "id", "score"), "windows")
    if exact and n:
        size = max(BLOCK, -(-n // BLOCKS))
        first = vectors.mapInArrow(keyed([0]), f"curve int, key bigint, id bigint, v {kind}")
        blocks = materialise(first.repartitionByRange(-(-n // size), "key", "id").select(F.spark_partition_id().alias("block"), "id", "v"), "blocks")
        balls = blocks.groupBy("block").applyInArrow(_ball, "block int, centre binary, radius double").collect()
        centres = np.array([np.frombuffer(b["centre"]) for b in balls])
        floors = found.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).where(F.col("c") == k).select(F.col("query").alias("id"), F.col("s").alias("floor"))
        # Queries go in chunks of neighbours on the curve, so that few blocks are visited by any of a chunk.
        chunk = F.floor(F.col("block") / max(1, QUERIES * every // size)).cast("bigint")
        queries = blocks.where(F.col("id") % every == 0).select(F.col("id").alias("id"), F.col("v").alias("v"), chunk.alias("chunk"))
        queries = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        shape = (np.array([b["block"] for b in balls], np.int32), centres, np.array([b["radius"] for b in balls]))
        visits = materialise(queries.mapInArrow(_visits(shape), "chunk bigint, block int").distinct(), "visits")
        # A block is copied for the chunks that visit it, a chunk for the blocks that it visits.
        tiles, callers = blocks.join(visits, "block"), queries.join(visits, "chunk")
        more = tiles.groupBy("block", "chunk").cogroup(callers.groupBy("block", "chunk")).applyInArrow(_tile(k), "query bigint, id bigint, score double")
        found = _ranked(found.unionByName(more), k)
    else:
        found = _ranked(found, k)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
