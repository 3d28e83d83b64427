"""Replay of access traces against cache policies, in order within a cache, in parallel over caches."""

from __future__ import annotations

import pickle
from collections import OrderedDict, deque
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ordina.operators.sketch import CountSketch, Packed, Windowed

RESULT = "cache_id bigint, hits bigint, misses bigint, evictions bigint, rejected bigint, items bigint, total_weight bigint, hit_rate double"


class Policy:
    """What policies share: entries, and hit, miss and eviction counts."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.entries: dict[Any, list] = {}  # key -> [value, weight, uses, in main]
        self.hits = self.misses = self.evictions = self.rejected = 0

    def get(self, key: Any) -> Any:
        if (e := self.entries.get(key)) is None:
            self.misses += 1
            return None
        self.hits += 1
        self.touched(key, e)
        return e[0]

    def touched(self, key: Any, entry: list) -> None:
        entry[2] = min(3, entry[2] + 1)

    def put(self, key: Any, value: Any, weight: int) -> None:
        raise NotImplementedError

    def put_batch(self, keys: Sequence[Any], values: Sequence[Any], weights: Sequence[int] | None = None) -> None:
        """Puts one after the other."""
        for k, v, w in zip(keys, values, weights if weights is not None else [1] * len(keys), strict=True):
            self.put(k, v, w)

    def get_batch(self, keys: Sequence[Any]) -> list[Any]:
        """What get returns for each key."""
        return [self.get(k) for k in keys]

    def remove(self, key: Any) -> None:
        self.entries.pop(key, None)

    @property
    def weight(self) -> int:
        return sum(e[1] for e in self.entries.values())


class TwoQueue(Policy):
    """Weighted small and main queues with admission by frequency.

    New keys enter the small queue, a fifth of the limit.  Leaving it, a key used
    more than once moves to main, others are evicted; in main a key that still has
    uses loses one and queues again.  If making room evicted exactly one key and
    that one is more frequent than the new key, the new key is rejected.
    """

    share, promote_above, admission = 0.2, 1, True

    def __init__(self, limit: int) -> None:
        super().__init__(limit)
        self.small: OrderedDict = OrderedDict()
        self.main: OrderedDict = OrderedDict()
        self.load = [0, 0]
        self.seen = self.sketch(max(16, limit))

    sketch = staticmethod(Windowed)

    @property
    def small_limit(self) -> int:
        return int(self.share * self.limit) + 1

    def touched(self, key: Any, entry: list) -> None:
        super().touched(key, entry)
        self.seen.add(key)

    def put(self, key: Any, value: Any, weight: int) -> None:
        freq = self.seen.add(key)
        if (e := self.entries.get(key)) is not None:
            self.load[e[3]] += weight - e[1]
            e[0], e[1], e[2] = value, weight, min(3, e[2] + 1)
            self.make_room(0)
            return
        gone = self.make_room(weight)
        if self.admission and len(gone) == 1 and self.seen.of(gone[0]) > freq:
            self.rejected += 1
            return
        self.entries[key] = [value, weight, 0, 0]
        self.small[key] = None
        self.load[0] += weight

    def make_room(self, extra: int) -> list:
        gone = []
        while sum(self.load) + extra > self.limit:
            key = self.from_small() if self.load[0] >= self.small_limit else None
            if key is None and (key := self.from_main()) is None:
                break
            gone.append(key)
        return gone

    def from_small(self) -> Any:
        while self.small:
            key, _ = self.small.popitem(last=False)
            e = self.entries[key]
            self.load[0] -= e[1]
            if e[2] > self.promote_above:
                e[3] = 1
                self.main[key] = None
                self.load[1] += e[1]
            else:
                self.evictions += 1
                del self.entries[key]
                return key
        return None

    def from_main(self) -> Any:
        while self.main:
            key, _ = self.main.popitem(last=False)
            e = self.entries[key]
            if e[2] > 0:
                e[2] -= 1
                self.main[key] = None
                continue
            self.load[1] -= e[1]
            self.evictions += 1
            del self.entries[key]
            return key
        return None

    def remove(self, key: Any) -> None:
        if (e := self.entries.pop(key, None)) is not None:
            self.load[e[3]] -= e[1]
            del (self.main if e[3] else self.small)[key]


class CountedTwoQueue(TwoQueue):
    """The same by number of keys, a tenth small, every victim evicted and every new key admitted."""

    share, admission = 0.1, False
    sketch = staticmethod(lambda limit: Packed(10 * limit))

    def put(self, key: Any, value: Any, weight: int) -> None:
        super().put(key, value, 1)


class EagerTwoQueue(TwoQueue):
    """The first hit moves a key to main; new keys are always admitted and nothing is evicted."""

    admission = False
    sketch = staticmethod(lambda limit: Windowed(limit, wide=True))

    def touched(self, key: Any, entry: list) -> None:
        super().touched(key, entry)
        if not entry[3]:
            entry[3] = 1
            del self.small[key]
            self.load[0] -= entry[1]
            self.load[1] += entry[1]
            self.main[key] = None

    def make_room(self, extra: int) -> list:
        return []


class SmallMainFifo(Policy):
    """By number of keys: a tenth small, any use promotes, second chances in main, and a hard stop at twice the limit."""

    def __init__(self, limit: int) -> None:
        super().__init__(limit)
        self.small: deque = deque()
        self.main: deque = deque()

    def put(self, key: Any, value: Any, weight: int) -> None:
        if (e := self.entries.get(key)) is not None:
            e[0] = value
            self.touched(key, e)
            return
        if len(self.entries) >= 2 * self.limit:
            self.rejected += 1
            return
        self.entries[key] = [value, 1, 0, 0]
        self.small.append(key)
        if len(self.entries) >= self.limit:
            self.evict()

    def evict(self) -> None:
        for queue, tries in ((self.small, max(1, self.limit // 10)), (self.main, self.limit - self.limit // 10)):
            for _ in range(tries):
                if not queue:
                    break
                key = queue.popleft()
                if (e := self.entries.get(key)) is None:
                    continue
                if e[2] > 0:
                    e[2] = 0 if queue is self.small else e[2] - 1
                    e[3] = 1
                    self.main.append(key)
                    continue
                del self.entries[key]
                self.evictions += 1
                return


class Segmented(Policy):
    """Window, main and protected segments in order of last use, by number of keys, with admission by frequency.

    Every get and put counts the key in the sketch, before it is looked up; all
    counters halve after each ``reset_every`` inserts.  A new key enters the window;
    a ghost, one of the keys evicted last, enters main with one use.  A hit moves a
    window key to main and a main key of two uses to protected (half of the limit),
    whose oldest goes back to main beyond that.  At the limit a new key evicts the
    oldest of the window, of main, or of protected, the first that isn't empty; it
    is rejected instead if even with ``threshold`` added its frequency is below the
    victim's, unless forced.  Keys older than ``ttl`` operations miss and go.
    """

    threshold, ttl, reset_every, protected_share = 10, None, 10_000, 0.5

    def __init__(self, limit: int) -> None:
        super().__init__(limit)
        self.parts = [OrderedDict(), OrderedDict(), OrderedDict()]
        self.ghosts: OrderedDict = OrderedDict()
        self.seen = CountSketch(max(16, limit))
        self.clock = self.inserts = 0
        self.born: dict[Any, int] = {}

    def get(self, key: Any) -> Any:
        self.clock += 1
        self.seen.add(key)
        if self.ttl is not None and key in self.entries and self.clock - self.born[key] > self.ttl:
            self.remove(key)
        return super().get(key)

    def touched(self, key: Any, entry: list) -> None:
        entry[2] += 1
        if entry[3] == 0:
            self.move(key, 1)
        elif entry[3] == 1 and entry[2] >= 2:
            self.move(key, 2)
            if len(self.parts[2]) > max(1, int(self.protected_share * self.limit)):
                self.move(next(iter(self.parts[2])), 1)
        else:
            self.parts[entry[3]].move_to_end(key)

    def move(self, key: Any, part: int) -> None:
        entry = self.entries[key]
        del self.parts[entry[3]][key]
        entry[3] = part
        self.parts[part][key] = None

    def victim(self) -> Any:
        return next(next(iter(p)) for p in self.parts if p)

    def evict(self, key: Any) -> None:
        self.remove(key)
        self.ghosts[key] = None
        self.evictions += 1
        if len(self.ghosts) > self.limit:
            self.ghosts.popitem(last=False)

    def remove(self, key: Any) -> None:
        if key in self.entries:
            del self.parts[self.entries[key][3]][key]
            del self.entries[key], self.born[key]

    def put(self, key: Any, value: Any, weight: int, force: bool = False) -> None:
        self.clock += 1
        self.seen.add(key)
        if (e := self.entries.get(key)) is not None:
            e[0] = value
            e[2] += 1
            return
        if len(self.entries) >= self.limit:
            victim = self.victim()
            if not force and self.seen.of(key) + self.threshold < self.seen.of(victim):
                self.rejected += 1
                return
            self.evict(victim)
        ghost = key in self.ghosts
        self.ghosts.pop(key, None)
        self.entries[key] = [value, 1, int(ghost), int(ghost)]
        self.parts[int(ghost)][key] = None
        self.born[key] = self.clock
        self.inserts += 1
        if self.inserts % self.reset_every == 0:
            self.seen.halve()

    def force_put(self, key: Any, value: Any, weight: int = 1) -> None:
        """Puts without asking for admission."""
        self.put(key, value, weight, force=True)


POLICIES = {"two_queue": TwoQueue, "counted_two_queue": CountedTwoQueue, "eager_two_queue": EagerTwoQueue, "small_main_fifo": SmallMainFifo, "segmented": Segmented}


def run_trace(policy: Policy, ops: Iterator[tuple[str, Any, Any, int]]) -> Policy:
    for op, key, value, weight in ops:
        if op == "get":
            policy.get(key)
        elif op == "remove":
            policy.remove(key)
        elif op == "force":
            policy.put(key, value, int(weight), **({"force": True} if isinstance(policy, Segmented) else {}))
        else:
            policy.put(key, value, int(weight))
    return policy


def explode_batches(trace: DataFrame) -> DataFrame:
    """A trace of batches (keys, values and weights are arrays of one length) as a trace of single operations.

    A batch's operations keep their order: ``place`` counts them.
    """
    return trace.select("cache_id", "seq", "op", F.posexplode(F.arrays_zip("keys", "values", "weights")).alias("place", "x")).select("cache_id", "seq", "place", "op", F.col("x.keys").alias("key"), F.col("x.values").alias("value"), F.col("x.weights").alias("weight"))


def _row(cache: Any, p: Policy) -> tuple:
    total = p.hits + p.misses
    return cache, p.hits, p.misses, p.evictions, p.rejected, len(p.entries), p.weight, p.hits / total if total else 0.0


_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def _in_order(rows: pd.DataFrame) -> Iterator[tuple]:
    rows = rows.sort_values(["seq", "place"] if "place" in rows else ["seq", "key"], kind="stable")
    return zip(rows["op"], rows["key"], rows["value"], rows["weight"], strict=True)


def replay(trace: DataFrame, limit: int, policy: str = "two_queue") -> DataFrame:
    """trace: cache_id, seq, op (get, set, force, remove), key, value, weight. A row of statistics for each cache.

    Rows with the same seq go by place, if there is such a column, else by key.  A
    cache's trace is sequential by nature and is held by one task; caches run in
    parallel.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_row(key[0], run_trace(POLICIES[policy](limit), _in_order(rows)))], columns=_COLUMNS)

    return trace.groupBy("cache_id").applyInPandas(run, RESULT)


def replay_stream(trace: DataFrame, limit: int, policy: str = "two_queue") -> DataFrame:
    """The same of a stream: the caches are state, and each batch gives the statistics of those it met so far.

    Within a batch operations go by seq; across batches they go as they arrive.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = pickle.loads(state.get[0]) if state.exists else POLICIES[policy](limit)
        run_trace(p, _in_order(pd.concat(list(parts))))
        state.update((pickle.dumps(p),))
        yield pd.DataFrame([_row(key[0], p)], columns=_COLUMNS)

    return trace.groupBy("cache_id").applyInPandasWithState(run, RESULT, "cache binary", "update", GroupStateTimeout.NoTimeout)
