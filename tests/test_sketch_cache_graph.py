import random

import pytest
from pyspark.sql import functions as F

from ordina.operators import cache_sim, graph, sketch


def test_estimates_bound_counts(spark):
    rng = random.Random(3)
    keys = [int(rng.expovariate(0.05)) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    cms = sketch.CountMin(width=64, depth=4, cap=None)
    est = {r.k: r.estimate for r in cms.estimate(cms.build(df, "k"), df, "k").collect()}
    assert all(est[k] >= keys.count(k) for k in set(keys))
    wide = sketch.CountMin(width=1 << 20, depth=4, cap=None)
    assert {r.k: r.estimate for r in wide.estimate(wide.build(df, "k"), df, "k").collect()} == {k: keys.count(k) for k in set(keys)}


def test_saturation_age_clear(spark):
    df = spark.createDataFrame([("a",)] * 40 + [("b",)] * 3, "k string")
    cms = sketch.CountMin(width=1 << 16, depth=2, cap=15)
    s = cms.build(df, "k")
    look = lambda t: {r.k: r.estimate for r in cms.estimate(t, df, "k").collect()}
    assert look(s) == {"a": 15, "b": 3} and look(cms.age(s)) == {"a": 7, "b": 1} and look(cms.clear(s)) == {"a": 0, "b": 0}
    assert look(cms.merge(s, s)) == {"a": 15, "b": 6}


def test_two_queue_fits_and_hits():
    c = cache_sim.TwoQueue(1000)
    for k in range(3):
        c.put(k, k * 10, 100)
    assert [c.get(k) for k in range(3)] == [0, 10, 20] and c.get(9) is None
    assert (c.hits, c.misses) == (3, 1)
    c.put(1, 99, 50)
    assert c.get(1) == 99 and c.weight == 250 and sum(c.load) == 250
    for k in range(100, 140):
        c.put(k, 0, 100)
    assert c.evictions > 0 and c.weight <= 1000 and c.weight == sum(c.load)


def test_frequent_victim_keeps_its_place():
    c = cache_sim.TwoQueue(2)
    for _ in range(5):
        c.seen.add("hot")
    c.put("hot", 1, 1)
    c.put("x", 1, 1)
    c.put("new", 1, 1)
    assert c.rejected == 1 and "new" not in c.entries


def test_heavy_key_stops_where_nothing_can_go():
    """With little in the small queue and an empty main queue, making room ends and the key is stored."""
    c = cache_sim.TwoQueue(100)
    c.put("a", 1, 5)
    c.put("heavy", 2, 99)
    assert set(c.entries) == {"a", "heavy"} and c.weight == 104 and c.evictions == 0


def test_zero_weight_stays():
    c = cache_sim.TwoQueue(10)
    c.put("z", 1, 0)
    assert c.get("z") == 1


def test_policies_keep_their_limits():
    rng = random.Random(1)
    ops = [("set" if rng.random() < 0.4 else "get", int(rng.expovariate(0.1)), 0, 1) for _ in range(4000)]
    for name, policy in cache_sim.POLICIES.items():
        p = cache_sim.run_trace(policy(20), ops)
        assert p.hits + p.misses == sum(o[0] == "get" for o in ops), name
        if name == "eager_two_queue":
            assert p.evictions == 0
        else:
            assert len(p.entries) <= (40 if name == "small_main_fifo" else 21), name


def test_aging():
    f = sketch.Windowed(32, wide=True)
    for _ in range(100):
        f.add("k")
    assert f.of("k") == 100
    for _ in range(200):
        f.add("k")
    assert f.of("k") == 128 + 44  # 256 were halved once
    g = sketch.Windowed(4)  # halves at the increment beyond 32
    assert [g.add("k") for _ in range(34)][-3:] == [32, 16, 17]
    assert g.more_frequent("k", "other") and not g.more_frequent("other", "k")
    h = sketch.Windowed(1)
    assert max(h.add("k") for _ in range(50)) <= 17


def test_packed_counters():
    p = sketch.Packed(60, depth=3)
    assert p.width == 64 and len(p.bytes) == 96
    for _ in range(20):
        p.add("a")
    p.add("b")
    assert (p.of("a"), p.of("b"), p.of("never")) == (15, 1, 0)
    p.halve()
    assert (p.of("a"), p.of("b")) == (7, 0)
    for i in range(640 - 22):
        p.add(i % 2)
    assert p.seen == 639 and p.of(0) == 15
    p.add(0)
    assert p.seen == 0 and p.of(0) == 7 and p.of("a") == 3
    p.clear()
    assert p.of(0) == 0


def test_sized_estimators():
    assert [(c.depth, c.width, c.cap) for c in map(sketch.CountMin.sized, (10, 99_999, 100_000, 999_999, 1_000_000))] == [(4, 65536, 255)] * 2 + [(5, 131072, 255)] * 2 + [(6, 262144, 255)]


def test_sketch_replay_equals_a_plain_run(spark):
    rng = random.Random(6)
    events = [(g, i, int(rng.expovariate(0.2))) for g in range(3) for i in range(700)]
    df = spark.createDataFrame(rng.sample(events, len(events)), "sketch_id bigint, seq bigint, key bigint")
    got = {(r.sketch_id, r.key): r.estimate for r in sketch.replay_sketch(df, lambda: sketch.Packed(4096)).collect()}
    assert got == {(g, k): min(15, sum(e[0] == g and e[2] == k for e in events)) for g, _, k in events}  # wide and never halved: plain counts
    aged = {(r.sketch_id, r.key): r.estimate for r in sketch.replay_sketch(df, lambda: sketch.Windowed(50)).collect()}
    for g in range(3):
        counts, seen = {}, 0
        for _, _, k in (e for e in events if e[0] == g):
            counts[k] = counts.get(k, 0) + 1
            seen += 1
            if seen == 401:
                counts, seen = {x: n // 2 for x, n in counts.items()}, 0
        assert {k: n for (x, k), n in aged.items() if x == g} == {k: counts.get(k, 0) for x, k in aged if x == g}


class Counts:
    """Plain counts in place of a sketch."""

    def __init__(self, cap, every=None, by_access=True):
        self.n, self.cap, self.every, self.at = {}, cap, every, 0

    def add(self, k):
        self.n[k] = min(self.cap, self.n.get(k, 0) + 1)
        self.at += 1
        if self.every and self.at >= self.every:
            self.halve()
        return self.n[k]

    def halve(self):
        self.n, self.at = {k: c // 2 for k, c in self.n.items()}, 0

    def of(self, k):
        return self.n.get(k, 0)


def simple_queues(ops, limit, kind):
    """Keys in two lists; written without regard to speed. Hits, misses, evictions, keys held."""
    weights, uses, small, main = {}, {}, [], []
    counts = Counts(255, 8 * max(16, limit) + 1)
    hits = misses = evictions = 0
    share = 0.1 if kind == "counted_two_queue" else 0.2
    load = lambda q: sum(weights[k] for k in q)
    for op, key, _, weight in ops:
        weight = 1 if kind == "counted_two_queue" else weight
        if op == "get":
            if key not in weights:
                misses += 1
                continue
            hits += 1
            uses[key] = min(3, uses[key] + 1)
            counts.add(key)
            if kind == "eager_two_queue" and key in small:
                small.remove(key)
                main.append(key)
            continue
        if op == "remove":
            if key in weights:
                (small if key in small else main).remove(key)
                del weights[key]
            continue
        freq, gone, known = counts.add(key), [], key in weights
        if known:
            weights[key], uses[key] = weight, min(3, uses[key] + 1)
        while kind != "eager_two_queue" and load(small) + load(main) + (0 if known else weight) > limit:
            out = None
            if load(small) >= int(share * limit) + 1:
                while small and out is None:
                    k = small.pop(0)
                    if uses[k] > 1:
                        main.append(k)
                    else:
                        out = k
            while out is None and main:
                k = main.pop(0)
                if uses[k] > 0:
                    uses[k] -= 1
                    main.append(k)
                else:
                    out = k
            if out is None:
                break
            evictions += 1
            del weights[out]
            gone.append(out)
        if not known and not (kind == "two_queue" and len(gone) == 1 and counts.of(gone[0]) > freq):
            weights[key], uses[key] = weight, 0
            small.append(key)
    return hits, misses, evictions, len(weights)


def simple_fifo(ops, limit):
    uses, small, main, hits, misses, evictions = {}, [], [], 0, 0, 0
    for op, key, _, _ in ops:
        if op == "remove":
            uses.pop(key, None)  # the queues forget it when they meet it
        elif op == "get":
            hits, misses = hits + (key in uses), misses + (key not in uses)
            if key in uses:
                uses[key] = min(3, uses[key] + 1)
        elif key in uses:
            uses[key] = min(3, uses[key] + 1)
        elif len(uses) < 2 * limit:
            uses[key] = 0
            small.append(key)
            if len(uses) >= limit:
                tries, done = [small] * max(1, limit // 10) + [main] * (limit - limit // 10), False
                for q in tries:
                    if done or not q:
                        continue
                    k = q.pop(0)
                    if k in uses and uses[k] > 0:
                        uses[k] = 0 if q is small else uses[k] - 1
                        main.append(k)
                    elif k in uses:
                        del uses[k]
                        evictions, done = evictions + 1, True
    return hits, misses, evictions, len(uses)


def simple_segments(ops, limit):
    window, main, protected, uses, ghosts, counts = [], [], [], {}, [], Counts(15)
    hits = misses = evictions = 0
    for op, key, _, _ in ops:
        if op == "remove":
            for q in (window, main, protected):
                if key in q:
                    q.remove(key)
            continue
        counts.add(key)
        held = key in window + main + protected
        if op == "get":
            hits, misses = hits + held, misses + (not held)
            if held:
                uses[key] += 1
                if key in window:
                    window.remove(key)
                    main.append(key)
                elif key in protected:
                    protected.append(protected.pop(protected.index(key)))
                elif uses[key] >= 2:
                    main.remove(key)
                    protected.append(key)
                    if len(protected) > max(1, limit // 2):
                        main.append(protected.pop(0))
                else:
                    main.append(main.pop(main.index(key)))
            continue
        if held:
            uses[key] += 1
            continue
        if len(window + main + protected) >= limit:
            q = next(q for q in (window, main, protected) if q)
            if op != "force" and counts.of(key) + 10 < counts.of(q[0]):
                continue
            ghosts = (ghosts + [q.pop(0)])[-limit:]
            evictions += 1
        if key in ghosts:
            ghosts.remove(key)
            main.append(key)
            uses[key] = 1
        else:
            window.append(key)
            uses[key] = 0
    return hits, misses, evictions, len(window + main + protected)


def test_policies_equal_plain_simulations():
    rng = random.Random(11)
    for trial in range(40):
        limit = rng.choice([5, 12, 25])
        ops = [(rng.choice(["get", "get", "set", "set", "remove", "force"] if trial % 2 else ["get", "set"]), int(rng.expovariate(0.08)), i, rng.randrange(1, 4)) for i in range(900)]
        for name, policy in cache_sim.POLICIES.items():
            p = cache_sim.run_trace(policy(limit), ops)
            want = simple_segments(ops, limit) if name == "segmented" else simple_fifo(ops, limit) if name == "small_main_fifo" else simple_queues(ops, limit, name)
            assert (p.hits, p.misses, p.evictions, len(p.entries)) == want, (trial, name)


def test_segmented_counts_ghosts_and_ages():
    c = cache_sim.Segmented(3)
    for k in "abc":
        c.put(k, k, 1)
    assert c.seen.of("a") == 1  # a put counts once
    c.get("missing")
    assert c.seen.of("missing") == 1  # a miss counts too
    c.put("d", 1, 1)
    assert "a" in c.ghosts and c.entries["d"][3] == 0
    c.put("a", 1, 1)
    assert c.entries["a"][2:] == [1, 1] and "a" not in c.ghosts  # a ghost comes back into main, used once
    for _ in range(14):
        c.get("c")
    c.parts[0].clear()
    c = cache_sim.Segmented(1)
    for _ in range(15):
        c.put("old", 1, 1)
    c.put("new", 1, 1)
    assert c.rejected == 1 and "old" in c.entries
    c.force_put("new", 1)
    assert "new" in c.entries
    c.ttl = 2
    assert c.get("new") == 1 and [c.get("x"), c.get("x"), c.get("new")] == [None] * 3
    c.reset_every = 1
    before = c.seen.of("old")
    c.put("z", 1, 1)
    assert c.seen.of("old") == before // 2


def test_batches_and_their_lengths():
    c = cache_sim.TwoQueue(100)
    c.put_batch([1, 2], ["a", "b"])
    assert c.get_batch([2, 3, 1]) == ["b", None, "a"]
    with pytest.raises(ValueError):
        c.put_batch([1, 2], ["a"])


def test_stream_of_a_trace_equals_its_replay(spark, tmp_path):
    rng = random.Random(5)
    trace = [(i % 3, i, rng.choice(["get", "set"]), rng.randrange(20), i, 1) for i in range(600)]
    schema = "cache_id bigint, seq bigint, op string, key bigint, value bigint, weight int"
    for part in range(3):
        spark.createDataFrame(trace[part * 200 : part * 200 + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    cache_sim.replay_stream(stream, 8).writeStream.format("memory").queryName("caches").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.table("caches").groupBy("cache_id").agg(F.max_by(F.struct("hits", "misses", "evictions"), F.expr("hits + misses")).alias("s")).collect()
    want = {r.cache_id: (r.hits, r.misses, r.evictions) for r in cache_sim.replay(spark.createDataFrame(trace, schema), 8).collect()}
    assert spark.table("caches").count() > 3 and {r.cache_id: tuple(r.s) for r in last} == want


def test_replay_matches_a_plain_run(spark):
    rng = random.Random(2)
    trace = [(c, i, rng.choice(["get", "set", "set", "remove"]), rng.randrange(30), i, rng.randrange(4)) for c in range(3) for i in range(500)]
    shuffled = trace[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "cache_id bigint, seq bigint, op string, key bigint, value bigint, weight int")
    for name, policy in cache_sim.POLICIES.items():
        got = {r.cache_id: (r.hits, r.misses, r.evictions, r.items) for r in cache_sim.replay(df, 25, name).collect()}
        for c in range(3):
            p = cache_sim.run_trace(policy(25), [t[2:] for t in trace if t[0] == c])
            assert got[c] == (p.hits, p.misses, p.evictions, len(p.entries)), name


def test_leaks(spark):
    v = lambda *x: spark.createDataFrame(x, "id int, strong int, weak int")
    e = lambda *x: spark.createDataFrame(x, "src int, dst int")
    cycle = v((1, 1, 1), (2, 1, 1), (3, 0, 0))
    assert {r.id for r in graph.leaked(cycle, e((1, 2), (2, 1))).collect()} == {1, 2}
    held = v((1, 2, 1), (2, 1, 1), (4, 1, 1))
    assert {r.id for r in graph.leaked(held, e((1, 2), (2, 1))).collect()} == {4}
    assert graph.leaked(v((1, 0, 0)), e((1, 1))).isEmpty()
    chain = spark.range(6).selectExpr("cast(id as int) src", "cast(id + 1 as int) dst")
    assert graph.reachable(spark.createDataFrame([(3,), (None,)], "id int"), chain).count() == 4
