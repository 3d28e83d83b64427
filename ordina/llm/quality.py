"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A score is a sigmoid of a bias, linear weights and pairwise interactions of rank
``rank``; the pairs are summed in linear time by half of (sum of v x) squared
minus the sum of (v x) squared.  Many texts are read and scored at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import fold_of, fresh, named

WORDS = 1 << 15
#: Upper edges of the bins of a share, and the number of bins of any statistic.
EDGES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.85])
BINS = len(EDGES) + 1
_KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((b" ", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".", b",;:'\"()-", b"!?", b"|<>{}[]=/\\_", b"#$%&*@^~+`"), 1):
    _KINDS[list(_chars)] = _kind
_KINDS[128:] = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\t\n\x0b\x0c\r ")] = True
STATS = 19
SIZE = WORDS + STATS * BINS
#: Bytes of texts that are read at once, unless a single one is longer.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Rows:
    """Distinct feature indices and values of many texts, one after the other; starts: where each text's begin."""

    index: np.ndarray
    value: np.ndarray
    starts: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        """Some of the texts, none of which is without features."""
        ends = np.append(self.starts[1:], len(self.index))
        sizes = (ends - self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        at = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(self.starts[rows], sizes)
        return Rows(self.index[at], self.value[at], starts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of _BASE and of its inverse modulo 2**64, as many as were needed yet."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * CHUNK)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: how many different hashes it has and how often its most frequent one occurs; and the first place of each (text, hash)."""
    keyed = hashes ^ _mixed(row.astype(np.uint64) + np.uint64(1))  # equal only within a text
    order = np.argsort(keyed, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])) if len(order) else np.empty(0, np.int64)
    counts, own = np.diff(np.append(first, len(order))), row[order[first]]
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, own, counts)
    return np.bincount(own, minlength=rows), most, order[first]


def features(texts: list[bytes | None]) -> Rows:
    """Features of each text: its hashed words and bins of its statistics. Null and empty texts have statistics only."""
    parts, i = [], 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j] or b"") < CHUNK):
            held += len(texts[j] or b"")
            j += 1
        parts.append(_features([t or b"" for t in texts[i:j]]))
        i = j
    if len(parts) == 1:
        return parts[0]
    offsets = np.cumsum([0, *(len(p.index) for p in parts)])
    return Rows(*(np.concatenate([np.empty(0, t), *(getattr(p, c) for p in parts)]) for c, t in (("index", np.int32), ("value", np.float32))), np.concatenate([np.empty(0, np.int64), *(p.starts + o for p, o in zip(parts, offsets, strict=False))]))


def _features(texts: list[bytes]) -> Rows:
    rows = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # a line end closes each text, and so its last word and line
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    kind = _KINDS[data]
    chars = np.maximum(1, sizes)
    shares = [(np.add.reduceat(kind == k, begins, dtype=np.int64) - (k == 2)) / chars for k in range(1, 11)]  # without the closing line end

    power, inverse = _Powers.of(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power)])
    spelled = lambda a, b: _mixed((sums[b] - sums[a]) * inverse[a])
    inside = np.concatenate([[False], ~_BLANK[data]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    word, row = spelled(first, last), np.searchsorted(ends, first)
    n = np.bincount(row, minlength=rows)
    different, most, place = _distinct(word, row, rows)
    again = np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    stops = np.bincount(row[np.isin(data[last - 1], np.frombuffer(b".!?", np.uint8))], minlength=rows) if len(last) else np.zeros(rows)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    line, line_row = spelled(start, np.maximum(start, stop)) + (stop - start).astype(np.uint64), np.searchsorted(ends, stop)
    lines = np.bincount(line_row, minlength=rows)
    kinds_of_line = _distinct(line, line_row, rows)[0]
    words = np.maximum(1, n)
    shares += [different / words, most / words, again / words, 1 - kinds_of_line / lines, stops / words, np.minimum(1, lines / words)]
    bits = lambda x: np.frexp(x.astype(float))[1]
    scales = np.stack([bits(n) / 20, bits(sizes) / 24, np.minimum(1.0, sizes / words / 24)], 1)  # words; metadata: length, length a word
    bins = np.concatenate([np.searchsorted(EDGES, np.stack(shares, 1)), (scales * (BINS - 1)).astype(np.int64).clip(0, BINS - 1)], 1)

    # Words of a text in one slot count once.
    slot = np.unique(row[place] * WORDS + (word[place] % np.uint64(WORDS)).astype(np.int64))
    slots = np.bincount(slot // WORDS, minlength=rows)
    counts = slots + STATS
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    index, value = np.empty(counts.sum(), np.int32), np.full(counts.sum(), 0.5, np.float32)
    stat = (starts + slots)[:, None] + np.arange(STATS)
    index[stat] = WORDS + np.arange(STATS) * BINS + bins
    own = np.ones(len(index), bool)
    own[stat] = False
    index[own] = slot % WORDS
    value[own] = np.repeat(1 / np.sqrt(np.maximum(1, slots)), slots)
    return Rows(index, value, starts)


@dataclass
class Machine:
    """bias, linear weights and factors of a fitted factorisation machine; its size is fixed."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, rows: Rows) -> np.ndarray:
        vx = self.factors[rows.index] * rows.value[:, None]
        total = np.add.reduceat(vx, rows.starts)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, rows.starts)).sum(1)
        return self.bias + np.add.reduceat(self.linear[rows.index] * rows.value, rows.starts) + pairs

    def scores(self, rows: Rows) -> np.ndarray:
        return _sigmoid(self.logits(rows).astype(float)) if len(rows.starts) else np.empty(0)

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.scores(Rows(index, value, np.zeros(1, np.int64)))[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(m: Machine, rows: Rows, labels: np.ndarray, rate: float, decay: float, batch: int, rng: np.random.Generator) -> Iterator[None]:
    """Adagrad on the logistic loss; yields after each pass over the rows."""
    order = rng.permutation(len(labels))
    batches = []
    for i in range(0, len(order), batch):  # what of a batch stays the same in each pass
        some = rows.take(order[i : i + batch])
        sizes = np.diff(np.append(some.starts, len(some.index)))
        sort = np.argsort(some.index, kind="stable")
        own, at = np.unique(some.index[sort], return_index=True)
        batches.append((some, np.repeat(np.arange(len(sizes)), sizes), labels[order[i : i + batch]], sort, own, at))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6, np.float32), np.full(m.factors.shape, 1e-6, np.float32), 1e-6
    while True:
        for b in rng.permutation(len(batches)):
            some, row, y, sort, own, at = batches[b]
            value = some.value[:, None]
            vx = m.factors[some.index] * value
            total = np.add.reduceat(vx, some.starts)
            z = m.bias + np.add.reduceat(m.linear[some.index] * some.value, some.starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, some.starts)).sum(1)
            g = ((_sigmoid(z) - y) / len(y)).astype(np.float32)
            gw, gv = g[row] * some.value, g[row, None] * value * (total[row] - vx)
            gw, gv = np.add.reduceat(gw[sort], at) + decay * m.linear[own], np.add.reduceat(gv[sort], at) + decay * m.factors[own]
            seen_w[own] += gw**2
            seen_v[own] += gv**2
            seen_b += float(g.sum()) ** 2
            m.linear[own] -= rate * gw / np.sqrt(seen_w[own])
            m.factors[own] -= rate * gv / np.sqrt(seen_v[own])
            m.bias -= rate * float(g.sum()) / np.sqrt(seen_b)
        yield


def fit(rows: Rows, labels: np.ndarray, rank: int = 8, passes: int = 30, patience: int = 3, rate: float = 0.1, decay: float = 1e-5, batch: int = 128, share: float = 0.2, seed: int = 7) -> Machine:
    """A machine fitted in as many passes as serve best on a ``share`` of the rows, left out at first; then on all rows.

    Passes end when the loss there hasn't fallen for ``patience`` of them.  No rows,
    or one class only, give the constant share of label 1.
    """
    labels = np.asarray(labels, np.float32)
    p = (labels.sum() + 1) / (len(labels) + 2)
    plain = lambda: Machine(float(np.log(p / (1 - p))), np.zeros(SIZE, np.float32), np.zeros((SIZE, rank), np.float32))
    if len(set(labels.tolist())) < 2:
        return plain()

    def started() -> tuple[Machine, np.random.Generator]:
        rng = np.random.default_rng(seed)
        m = plain()
        m.factors = rng.normal(0, 0.05, (SIZE, rank)).astype(np.float32)
        return m, rng

    m, rng = started()
    order = rng.permutation(len(labels))
    aside, rest = np.split(order, [max(1, int(share * len(order)))])
    best, chosen = np.inf, 1
    if len(rest):
        away, truth = rows.take(aside), labels[aside]
        for n, _ in zip(range(1, passes + 1), _descend(m, rows.take(rest), labels[rest], rate, decay, batch, rng), strict=False):
            loss = float(np.logaddexp(0, np.where(truth > 0, -1, 1) * m.logits(away)).mean())
            if loss < best - 1e-4:
                best, chosen = loss, n
            elif n - chosen >= patience:
                break
    m, rng = started()
    for _ in zip(range(chosen), _descend(m, rows, labels, rate, decay, batch, rng), strict=False):
        pass
    return m


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features([t.as_py() for t in batch.column("text")])
        if batch.num_rows:
            index, value = (np.split(x, found.starts[1:]) for x in (found.index, found.value))
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([i.tobytes() for i in index], pa.binary()), pa.array([v.tobytes() for v in value], pa.binary())], names=["id", "label", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, sample: int = 8000) -> Machine:
    """Fits on at most ``sample`` labelled rows, those of the smallest id hashes whose fold isn't ``held_out``.

    The sample is bounded, so its ids can be broadcast and its features fit the
    driver.  Labels other than 0 and 1, and rows without id, aren't used; of
    documents that share an id, one is: that of the smallest text, null first.
    """
    some = labels.select(named(id_col).cast("bigint").alias("id"), named(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    some = some.where(fold_of("id", folds) != held_out).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.select(named(id_col).cast("bigint").alias("id"), named(text_col).cast("binary").alias("text"))
    one = texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min(F.struct("text")).alias("first"))
    rows = one.select("id", "label", F.col("first.text").alias("text")).mapInArrow(_featurise, "id bigint, label int, index binary, value binary").collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    index, value = ([np.frombuffer(r[c], t) for r in rows] for c, t in (("index", np.int32), ("value", np.float32)))
    starts = np.cumsum([0, *map(len, index)])[:-1]
    return fit(Rows(np.concatenate([np.empty(0, np.int32), *index]), np.concatenate([np.empty(0, np.float32), *value]), starts), np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text", outcome: str = "score") -> DataFrame:
    """The rows of docs with a double column ``outcome``, 0 to 1, higher where label 1 is likelier.

    Reads the text alone, all of it; null and empty texts are scored by their
    statistics.  Repeated rows score alike, but for the rounding of single
    precision.  Other columns pass through; the outcome column gets underscores
    appended if its name is taken.  One pass without a shuffle; the machine is sent
    along, a few MB whatever the corpus.
    """
    (name,) = fresh(docs.columns, outcome)
    shared = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))

    def run(texts: pa.Array) -> pa.Array:
        out = [shared.value.scores(features([t.as_py() for t in texts.slice(i, 512)])) for i in range(0, len(texts), 512)]
        return pa.array(np.concatenate([np.empty(0), *out]), pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(named(text_col).cast("binary")))
