import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ordina.llm.common import materialise
from ordina.llm.mixing import mix, mixed_order, servings, word_count


def filled(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, capped = sum(sizes), set()
    while True:
        rest, weight = total - sum(cap * sizes[i] for i in capped), sum(w for i, w in enumerate(weights) if i not in capped)
        goal = [cap * s if i in capped else rest * weights[i] / weight if weight else 0 for i, s in enumerate(sizes)]
        over = {i for i, g in enumerate(goal) if i not in capped and g > cap * sizes[i]}
        if not over:
            return goal
        capped |= over


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    goal = dict(zip(sources, filled([own[s] for s in sources], [i % 3 + 1 for i in range(len(sources))]), strict=True))
    out = []
    for s in sources:
        order = sorted(((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i is None, i or 0, size(t)) for i, t, x in rows if x == s))
        upto = 0
        for _, none, i, n in order:
            upto += n
            k = sum(2 * (e * own[s] + upto) - n <= 2 * goal[s] and n > 0 for e in range(3))
            out.append((None if none else i, n, own[s], round(goal[s], 6), k * n))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(60))), rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", None, "tiny"])) for i in range(600)]
    rows += [(None, "x y", "a"), (5, "dup dup", "a"), (5, "dup dup", "a"), (700, None, "b"), (701, "", "b"), (702, " \t ", "void"), (703, "w " * 5000, "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit(1)).withColumn("bucket", F.lit(2))
    got = mix(df).select("doc_id", "mix.*").collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == brute(rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("source", "mix.*").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in got)


def test_order_and_servings(spark):
    rows = [(i, "w w", "few" if i < 3 else "many") for i in range(60)]
    mixed = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    served = mixed_order(mixed).collect()
    assert [r.mix.time for r in served] == sorted(r.mix.time for r in served) and len(served) == sum(r.mix.epochs for r in mixed.collect())
    assert sorted(r.mix.epoch for r in served if r.source == "few") == [0] * 3 + [1] * 3 + [2] * 3


def test_taken_is_the_sorted_sequence_cut_off(spark):
    """All servings in order of virtual time, those up to time 1, against what mix says is taken; each source gets its target but for half a document."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = materialise(mix(df), "mixed")
    order = sorted(servings(mixed).select("doc_id", "mix.time", "mix.size", "mix.target", "source").collect(), key=lambda r: r.time)
    taken, words = {}, {}
    for r in order:
        if r.time > 1 + 1e-12:
            break
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r["size"]
        words[r.source] = words.get(r.source, 0) + r["size"]
    want = {r.doc_id: r.taken for r in mixed.select("doc_id", "mix.taken").collect() if r.taken}
    assert taken == want and len(mixed_order(mixed).collect()) == sum(t // len(rows[i][1].split()) for i, t in want.items())
    goals = {r.source: r.target for r in order}
    assert all(abs(words[s] - goals[s]) <= 20 for s in goals)


def test_given_sizes_and_odd_names(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("a.b", F.lit(1)).withColumn("`x", F.lit(2))
    by_text = mix(df).select("doc_id", "mix.*").collect()
    assert {"a.b", "`x"} <= set(mix(df).columns)
    sized = df.select("doc_id", "source", word_count(F.col("text")).alias("n.words"))
    assert sorted(by_text) == sorted(mix(sized, size_col="n.words").select("doc_id", "mix.*").collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "", "b")]])
def test_no_words(spark, rows):
    assert all(r.mix.taken == 0 and r.mix.target == 0 for r in mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect())


def test_word_count(spark):
    texts = ["a b", " a\x0bb\x0cc\r\n", "", None, "\u00a0x", "one", "a\x1cb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [2, 3, 0, 0, 1, 1, 1]
