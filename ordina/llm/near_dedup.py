"""MinHash near-duplicate detection over distributed buckets.

Many universal hash minima per document, banded; every bucket member is compared
with the bucket's smallest id first (a star, never all pairs), candidates are
verified on signatures and then confirmed on full shingle sets, and components
come from alternating large-star and small-star rounds.  In buckets that still
hold several components afterwards, all members meet those outside of the largest
component, tile by tile, first by signature and then by full sets, so that a link
between two members neither of which is the star's centre is found too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import discard, lower_words, materialise, named

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
#: Ids up to this many go to the scan as a broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of signatures and shingle sets on a side of a tile of a bucket: what a task holds at once of it.
TILE = 16 << 20


@dataclass(frozen=True)
class MinHash:
    """Shingle length in words, the similarity in hundredths that links, and the number of hash minima."""

    words: int = 5
    percent: int = 80
    hashes: int = 120
    #: A linked pair is missed by all bands with at most this probability.
    miss: float = 1e-6
    #: Verification passes pairs whose signatures agree this much less than the threshold (6 standard deviations).
    slack: float = 0.2
    seed: int = 20240607

    @property
    def rows(self) -> int:
        """Hashes a band: the most that keep the miss probability at the threshold."""
        t = self.percent / 100
        return max([1, *(r for r in range(1, 9) if (1 - t**r) ** (self.hashes // r) <= self.miss)])

    @property
    def bands(self) -> int:
        return self.hashes // self.rows

    def family(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers (odd) and offsets of the universal hash functions x -> a x + b mod 2**32."""
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 2**31, self.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        return a, rng.integers(0, 2**32, self.hashes, dtype=np.uint32)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, no words none."""
    words = lower_words(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    k = min(n, len(h))
    out = h[: len(h) - k + 1] + np.uint64(k)
    for i in range(1, k):  # a polynomial in the word hashes, so order counts
        out = out * _MIX[0]
        out ^= out >> np.uint64(29)
        out = out * _MIX[1] + h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(32)
    out = out * _MIX[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):  # a block of shingles stays in cache
        np.minimum(out, (x[i : i + 512, None] * a + b).min(0), out=out)
    return out


_SKETCH = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])


def _sketcher(cfg: MinHash) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = cfg.family()
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            n, k1, k2, sig = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), cfg.words)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], schema=_SKETCH)

    return run


def sketch(docs: DataFrame, id_col: str, text_col: str, cfg: MinHash) -> DataFrame:
    """id, n_shingles, a 128-bit digest (k1, k2) of the whole shingle set, and the signature (null for an empty set)."""
    src = docs.select(named(id_col).cast("bigint").alias("id"), named(text_col).cast("binary").alias("text"))
    return src.mapInArrow(_sketcher(cfg), "id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary")


def agreement(a: str, b: str, least: float) -> Callable:
    """Keeps the pairs of which the signatures agree in at least that share of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array((x == y).mean(1) >= least)
            yield pa.record_batch([batch.column(a).filter(keep), batch.column(b).filter(keep)], names=[a, b])

    return run


def _sets(cfg: MinHash) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # sets are larger than texts
                some = batch.slice(at, 128)
                sets = [shingle_set(t.as_py(), cfg.words).tobytes() for t in some.column("text")]
                yield pa.record_batch([some.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirm(cfg: MinHash) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                keep.append(_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), cfg.percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


LEFT, RIGHT, BOTH = 0, 1, 2


class Tile:
    """Rows of one part of a bucket: those on its left side meet those on its right side. A bucket of one tile has rows on both."""

    def __init__(self, cfg: MinHash, cols: dict[str, list]) -> None:
        self.cfg, self.band, self.pivot = cfg, cols["band"][0], cols["pivot"][0]
        self.ids, self.comp, self.size = (np.array(cols[c], np.int64) for c in ("id", "comp", "n_shingles"))
        self.major, side = np.array(cols["major"], bool), np.array(cols["side"])
        self.sig = np.frombuffer(b"".join(cols["sig"]), np.uint32).reshape(len(self.ids), -1)
        other = self.ids != self.pivot  # pairs with the pivot were looked at before
        self.left, self.right = np.flatnonzero((side != RIGHT) & other), np.flatnonzero((side != LEFT) & other)
        self.least = cfg.percent / 100 - cfg.slack

    def near(self, p: int) -> np.ndarray:
        """Rows on the right, of other components, that by size and signature may link with p. A pair is looked at once: under the first band it shares, from one side."""
        q = self.right[self.comp[self.right] != self.comp[p]]
        q = q[self.major[q] | (self.ids[q] > self.ids[p])]
        q = q[100 * np.minimum(self.size[q], self.size[p]) >= self.cfg.percent * np.maximum(self.size[q], self.size[p])]
        q = q[(self.sig[q] == self.sig[p]).mean(1) >= self.least]
        if self.band and len(q):
            width = self.band * self.cfg.rows
            before = self.sig[q, :width] == self.sig[p, :width]
            q = q[~before.reshape(len(q), self.band, self.cfg.rows).all(2).any(1)]
        return q


_TILE_KEY = ("key", "i", "j")
_TILE_ROW = ("id", "comp", "n_shingles", "major", "side", "band", "pivot")


def _tiles(cfg: MinHash, found: Callable, *more: str) -> Callable:
    """Calls found(tile, columns) for each run of rows of equal key, i, j; it returns a record batch or None."""
    names = (*_TILE_KEY, *_TILE_ROW, "sig", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cols = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None and (out := found(Tile(cfg, cols), cols)) is not None:
                yield out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for row in zip(*(some.column(c).to_pylist() for c in names), strict=True):
                    if row[:3] != key:
                        yield from flush()
                        key, cols = row[:3], {c: [] for c in names}
                    for c, v in zip(names, row, strict=True):
                        cols[c].append(v)
        yield from flush()

    return run


def _candidates(cfg: MinHash) -> Callable:
    """The rows of each tile that by signature may link with one on the other side."""

    def found(tile: Tile, cols: dict[str, list]) -> pa.RecordBatch | None:
        keep: set[int] = set()
        for p in tile.left:
            if len(q := tile.near(p)):
                keep.update((int(p), *q.tolist()))
        if not keep:
            return None
        rows = sorted(keep)
        names = [*_TILE_KEY, *_TILE_ROW]
        return pa.record_batch([pa.array([cols[c][r] for r in rows], _TILE_TYPES[c]) for c in names], names=names)

    return _tiles(cfg, found)


_TILE_TYPES = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "id": pa.int64(), "comp": pa.int64(), "n_shingles": pa.int64(), "major": pa.bool_(), "side": pa.int32(), "band": pa.int32(), "pivot": pa.int64()}
_TILE_SCHEMA = "key bigint, i int, j int, id bigint, comp bigint, n_shingles bigint, major boolean, side int, band int, pivot bigint"


def _across(cfg: MinHash) -> Callable:
    """Links between different components in each tile, confirmed on full sets; none more between components that the tile has joined."""

    def found(tile: Tile, cols: dict[str, list]) -> pa.RecordBatch | None:
        u, v = [], []
        for p in tile.left:
            own = np.frombuffer(cols["shingles"][p], np.uint64)
            for q in tile.near(p):
                if tile.comp[q] != tile.comp[p] and _similar(own, np.frombuffer(cols["shingles"][q], np.uint64), cfg.percent):
                    u.append(max(tile.ids[p], tile.ids[q]))
                    v.append(min(tile.ids[p], tile.ids[q]))
                    tile.comp[tile.comp == tile.comp[q]] = tile.comp[p]
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if u else None

    return _tiles(cfg, found, "shingles")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) for every node that isn't its component's smallest: u's component is v.

    Alternates large-star and small-star until a round changes nothing.  Each
    round is written to the shared folder, the one before is deleted.  Self links
    and nulls are ignored, repeated links count once.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        then = materialise(_small_star(_large_star(now)), "links")
        mark = tuple(then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = then
        if mark == seen or not mark[0]:
            return now
        seen = mark
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: MinHash = MinHash()) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents whose shingle sets have a similarity of at least ``cfg.percent``
    hundredths are linked; component_id is the smallest id reachable.  Documents
    without words (null or empty text) have n_shingles 0 and stay alone.  Equal
    texts link without comparison, by the digest of their whole set.  A null id
    can't be linked to: its component_id is null and the row is kept.  Rows that
    share an id are one node and get one component.  Columns besides the two
    named are not read, so their names can't clash.
    """
    sketches = materialise(sketch(docs, id_col, text_col, cfg), "sketch")
    some = sketches.where("n_shingles > 0 and id is not null")
    reps = materialise(some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")

    def bands() -> DataFrame:
        width = 4 * cfg.rows
        keys = F.array(*(F.xxhash64(F.lit(i), F.substring(F.col("sig"), i * width + 1, width)) for i in range(cfg.bands)))
        return reps.select("rep", "n_shingles", F.posexplode(keys).alias("band", "key"))

    # An id with several texts joins their classes.
    repeated = some.groupBy("id").agg(F.count_distinct("k1", "k2").alias("n")).where("n > 1").select("id")
    ids = some.join(repeated, "id").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep")
    bridged = ids.join(ids.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v").where("u <> v")

    shared = bands().groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot")
    buckets = materialise(bands().join(shared, "key").select("key", "band", "pivot", "rep", "n_shingles"), "buckets")
    stars = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    signed = stars.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    likely = materialise(signed.select("a", "b", "sa", "sb").mapInArrow(agreement("a", "b", cfg.percent / 100 - cfg.slack), "a bigint, b bigint"), "likely")
    links = _confirmed(docs, id_col, text_col, likely, cfg)
    first = connected_components(links.unionAll(bridged))
    discard(likely, links)

    # Buckets that still hold several components: all members meet those outside of the largest, in tiles.
    labelled = materialise(buckets.join(first.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "labelled")
    held = F.sum(8 * F.col("n_shingles") + 4 * cfg.hashes)
    parts = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), held.alias("bytes"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "comp", "bytes")).alias("top")).where(F.col("size") > F.greatest(F.lit(2), F.col("top.n")))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    whole = whole.select("key", F.col("top.comp").alias("top"), blocks(F.col("bytes") - F.col("top.bytes")).alias("is"), blocks(F.col("bytes")).alias("js"))
    members = materialise(labelled.join(whole, "key").select("key", "band", "pivot", F.col("rep").alias("id"), "n_shingles", "comp", (F.col("comp") == F.col("top")).alias("major"), "is", "js"), "open")
    final = first
    if not members.isEmpty():
        dealt = lambda side, n: F.pmod(F.xxhash64(F.lit(side), "id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = F.col("js") == 1
        side = F.when(one & ~F.col("major"), BOTH).otherwise(RIGHT)
        row = ["id", "n_shingles", "comp", "major", "band", "pivot"]
        left = members.where(~one & ~F.col("major")).select("key", dealt(LEFT, "is").alias("i"), each("js").alias("j"), F.lit(LEFT).alias("side"), *row)
        right = members.select("key", each("is").alias("i"), dealt(RIGHT, "js").alias("j"), side.alias("side"), *row)
        known = reps.select(F.col("rep").alias("id"), "sig")
        tiled = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
        likely = materialise(tiled(left.unionAll(right).join(known, "id")).mapInArrow(_candidates(cfg), _TILE_SCHEMA), "candidates")
        sets = _shingle_sets(docs, id_col, text_col, likely.select("id").distinct(), cfg)
        full = likely.join(known, "id").join(sets, "id")
        late = materialise(tiled(full).mapInArrow(_across(cfg), "u bigint, v bigint").distinct(), "late")
        discard(sets, likely)
        if not late.isEmpty():
            final = connected_components(first.unionAll(late))
        discard(late)
    discard(buckets, labelled, members)

    comp = final.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    out = sketches.select("id", "n_shingles", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(comp, "rep", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("comp", "rep", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, cfg: MinHash) -> DataFrame:
    """id and full shingle set (64-bit hashes) of the documents of these ids."""
    src = docs.select(named(id_col).cast("bigint").alias("id"), named(text_col).cast("binary").alias("text"))
    ids = materialise(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    return materialise(src.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_sets(cfg), "id bigint, shingles binary"), "sets")


def _confirmed(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, cfg: MinHash) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as links (u, v)."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _shingle_sets(docs, id_col, text_col, ids, cfg)
    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    out = materialise(full.select("a", "b", "xa", "xb").mapInArrow(_confirm(cfg), "a bigint, b bigint").select(F.col("a").alias("u"), F.col("b").alias("v")), "confirmed")
    discard(sets)
    return out
