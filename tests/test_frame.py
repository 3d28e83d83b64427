"""Golden values of each operator, with empty inputs, ties and nulls."""

import pytest
from pyspark.sql import functions as F

from ordina.frame import Ordered, with_pos
from ordina.functions.reducers import Reducer
from ordina.operators import combine, folds, ordering, rowwise
from ordina.plans.scratch import materialise, scratch
from ordina.plans.splitter import Splitter


def rows(df, order="pos", column="v"):
    return [r[column] for r in df.orderBy(order).collect()]


@pytest.fixture
def ten(spark):
    return Ordered.range(spark, 1, 11)


def of(spark, items, dtype="int"):
    return Ordered.values(spark, items, dtype)


def one(df):
    r = df.first()
    return r[0] if r else None


def test_for_each_and_map(spark, ten):
    assert rows(ten.for_each(v=lambda v: v * 2).df) == list(range(2, 21, 2))
    assert rows(of(spark, [0] * 5).for_each_indexed(v=lambda i, v: i * 10).df) == [0, 10, 20, 30, 40]
    assert rows(of(spark, [1, 2, 3, 4, 5]).map(v=lambda v: v * v).df) == [1, 4, 9, 16, 25]
    assert rows(of(spark, [0] * 5).with_context(100).map_indexed(v=lambda base, i, v: F.lit(base) + i).df) == [100, 101, 102, 103, 104]


def test_filters(spark, ten):
    even = F.col("v") % 2 == 0
    assert rows(ten.filter(even).df) == [2, 4, 6, 8, 10]
    assert rows(ten.filter(even).map(v=lambda v: v * 2).df) == [4, 8, 12, 16, 20]
    assert [(r.pos, r.v) for r in ten.filter(even).dense().df.orderBy("pos").collect()] == [(0, 2), (1, 4), (2, 6), (3, 8), (4, 10)]
    assert rows(of(spark, [1, 3, 5]).filter(even).df) == []
    assert rows(of(spark, [1, 2, 3, 4, 5, 6]).filter_map("v", F.when(even, F.col("v") * 10)).df) == [20, 40, 60]
    a, b = of(spark, [1, 2, None, 4]).partition(even)
    assert (rows(a.df), rows(b.df)) == ([2, 4], [1, None])


def test_flat_map_and_enumerate(spark):
    o = of(spark, [1, 2, 3])
    flat = o.flat_map("x", F.when(F.col("v") != 2, F.array("v", "v")).otherwise(F.array().cast("array<int>")))
    assert [r.x for r in flat.orderBy("pos", "sub").collect()] == [1, 1, 3, 3]
    assert sorted((r.e["index"], r.e.value) for r in o.enumerate("e").collect()) == [(0, 1), (1, 2), (2, 3)]


def test_positions(spark):
    o = Ordered.range(spark, 0, 10)
    assert rows(o.step_by(3).df) == [0, 3, 6, 9]
    assert rows(of(spark, [1, 2, 3]).step_by(0).df) == [1, 2, 3]
    assert rows(of(spark, [0] * 6).step_for_each(2, v=F.lit(99)).df) == [99, 0, 99, 0, 99, 0]
    assert rows(o.rev().df) == list(range(9, -1, -1))
    assert rows(of(spark, [42]).rev().df) == [42]
    assert rows(of(spark, []).rev().df) == []
    assert rows(o.skip(8).df) == [8, 9] and rows(o.skip(99).df) == []
    assert rows(o.take(2).df) == [0, 1] and rows(o.take(99).df) == list(range(10))
    assert one(o.nth(4).select("v")) == 4 and o.nth(10).isEmpty()
    assert (one(o.first().select("v")), one(o.last().select("v"))) == (0, 9)
    assert of(spark, []).first().isEmpty() and of(spark, []).is_empty() and o.len() == 10


def test_reductions(spark, ten):
    assert one(ten.sum()) == 55
    assert one(of(spark, [1, 2, 3, 4, 5]).product()) == 120
    assert one(of(spark, [-1, 2, -3, -4]).product()) == -24
    assert one(of(spark, [0, 2**31 - 1] * 40, "bigint").product()) == 0
    with pytest.raises(Exception, match="out of range|OVERFLOW|cannot be"):
        of(spark, [2] * 64, "bigint").product().collect()
    o = of(spark, [5, 3, 8, 1, 9, 2])
    assert (one(o.min()), one(o.max())) == (1, 9)
    none = of(spark, [])
    assert (one(none.sum()), one(none.product()), one(none.min()), one(none.max())) == (0, 1, 2**31 - 1, -(2**31))
    assert one(of(spark, [1.5, 2.0], "double").product()) == 3.0


def test_best_by_key(spark):
    o = of(spark, [3, 1, 4, 1, 5, 9, 9])
    assert o.min_by_key(F.col("v")).first().asDict() == {"pos": 1, "v": 1}
    assert o.max_by_key(F.col("v")).first().asDict() == {"pos": 5, "v": 9}
    assert of(spark, []).min_by_key(F.col("v")).isEmpty()
    assert of(spark, [None, 2]).min_by_key(F.col("v")).first().v == 2


def test_folds(spark):
    o = of(spark, list(range(1, 6)))
    assert o.try_fold(0, lambda a, b: a + b) == 15
    assert o.try_reduce(lambda a, b: a * 10 + b) == 12345
    assert of(spark, []).try_reduce(lambda a, b: a + b) is None

    def small(a, b):
        if a + b > 5:
            raise ValueError("too big")
        return a + b

    with pytest.raises(ValueError, match="too big"):
        o.try_fold(0, small)
    letters = Ordered.values(spark, list("abcdefghij"), "string")
    assert letters.with_workers(3).reduce(Reducer("", lambda a, b: a + b)) == "abcdefghij"
    assert of(spark, []).reduce(Reducer.sum()) == 0
    grouped = folds.fold_by_group(letters.df.withColumn("g", F.col("pos") % 2), ["g"], "pos", F.col("v"), F.lit(""), F.concat)
    assert {r.g: r.folded for r in grouped.collect()} == {0: "acegi", 1: "bdfhj"}


def test_reducers():
    assert Reducer.all().reduce_values([True, False]) is False and Reducer.all().reduce_values([]) is True
    assert Reducer.any().reduce_values([False, True]) is True and Reducer.any().reduce_values([]) is False
    assert Reducer.min().reduce_values([3, 1]) == 1 and Reducer.max("int").reduce_values([]) == -(2**31)
    assert Reducer.product().merge(3, 4) == 12


def test_search(spark, ten):
    even = F.col("v") % 2 == 0
    assert one(ten.count(even)) == 5
    assert one(of(spark, [1, 3, 5, 4, 7]).find(even).select("v")) == 4
    assert of(spark, [1, 3]).find(F.col("v") < 0).isEmpty()
    o = of(spark, [1, 2, 3, 4, 5, 2, 6])
    assert (o.find_first(F.col("v") == 2).first().pos, o.find_last(F.col("v") == 2).first().pos) == (1, 5)
    assert one(of(spark, [1, 2, 3, 4, 5]).find_map("r", F.when(F.col("v") > 3, F.col("v") * 10))) == 40
    assert one(o.position(F.col("v") == 4)) == 3 and one(o.position(F.col("v") == 99)) is None
    none = of(spark, [])
    assert (one(none.any(even)), one(none.all(even)), one(none.count(even))) == (False, True, 0)
    assert one(of(spark, [2, None]).all(even)) is False and one(of(spark, [None]).any(even)) is False
    assert o.exists(even) and not none.exists(even)


def test_chunks(spark):
    import pandas as pd

    o = Ordered.range(spark, 0, 10).with_splitter(Splitter.fixed(4)).with_workers(1)
    got = o.chunks(lambda i, r: pd.DataFrame({"i": [i], "first": [int(r["v"].iloc[0])], "n": [len(r)]}), "i int, first int, n int")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    assert {r.chunk_id for r in o.with_workers(100).chunk_ids().collect()} == {0}
    assert [[r.v for r in c] for c in o.iter_chunks(4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert sorted(r.s for r in o.chunks_agg(F.sum("v").alias("s")).collect()) == [6, 17, 22]


def test_sort_is_stable(spark):
    df = spark.createDataFrame([(i, (i * 7) % 3, i) for i in range(30)], "pos bigint, k int, was int")
    got = Ordered.of(df).sort(F.col("k")).df.orderBy("pos").collect()
    assert [(r.k, r.was) for r in got] == sorted(((i * 7) % 3, i) for i in range(30))
    assert [r.pos for r in got] == list(range(30))
    assert [r.v for r in Ordered.values(spark, list(range(2000, 0, -1))).sort(F.col("v")).df.orderBy("pos").limit(2).collect()] == [1, 2]
    arr = spark.createDataFrame([([3, 1, 2],)], "a array<int>").select(ordering.sort_array_by(F.col("a"), lambda a, b: a > b).alias("a"))
    assert arr.first().a == [3, 2, 1]


def test_with_pos_is_dense(spark):
    df = spark.range(1000).repartition(7).withColumn("_part", F.lit(1))
    got = with_pos(df, [F.col("id")]).orderBy("id").collect()
    assert [r.pos for r in got] == list(range(1000)) and got[0]["_part"] == 1
    assert with_pos(spark.range(0), [F.col("id")]).isEmpty()


def test_zip_and_chain(spark):
    a, b = of(spark, [1, 2, 3]), of(spark, [10, 20], "bigint")
    assert [(r["first"], r.second) for r in a.zip(b).orderBy("pos").collect()] == [(1, 10), (2, 20)]
    assert rows(of(spark, [1, 2]).chain(of(spark, [2, 4])).df) == [1, 2, 2, 4]
    assert rows(of(spark, []).chain(of(spark, [4])).df) == [4] and rows(of(spark, [4]).chain(of(spark, [])).df) == [4]


def test_maps(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {r.k: r.v for r in combine.upsert(t, changes, "k", "seq").collect()} == {"a": 1, "b": 4, "c": 5}
    assert [r.k for r in combine.remove(t, t.where("k = 'a'").select("k"), "k").collect()] == ["b"]
    assert combine.both(lambda: 1, lambda: 2) == (1, 2)
    with pytest.raises(ZeroDivisionError):
        combine.both(lambda: 1 / 0, lambda: 2)


def test_rowwise_names_survive(spark):
    df = spark.createDataFrame([(0, 5, "x")], "pos bigint, v int, extra string")
    assert rowwise.reverse(df, "pos").columns == ["pos", "v", "extra"]


def test_positions_after_a_filter(spark, ten):
    """What goes by position sees the rows that are left as 0, 1, 2, ..."""
    even = ten.filter(F.col("v") % 2 == 0)
    assert rows(even.take(3).df) == [2, 4, 6] and rows(even.skip(3).df) == [8, 10]
    assert one(even.nth(0).select("v")) == 2 and one(even.nth(4).select("v")) == 10 and even.nth(5).isEmpty()
    assert [(r.pos, r.v) for r in even.step_by(2).df.orderBy("pos").collect()] == [(0, 2), (1, 6), (2, 10)]
    assert rows(even.step_for_each(2, v=F.lit(0).cast("bigint")).df) == [0, 4, 0, 8, 0]
    assert [(r.pos, r.v) for r in even.rev().df.orderBy("pos").collect()] == [(0, 10), (1, 8), (2, 6), (3, 4), (4, 2)]
    assert [(r.pos, r["first"], r.second) for r in even.zip(of(spark, [7, 8, 9])).orderBy("pos").collect()] == [(0, 2, 7), (1, 4, 8), (2, 6, 9)]
    assert [(r.pos, r.v) for r in even.chain(even).df.orderBy("pos").collect()] == list(enumerate([2, 4, 6, 8, 10] * 2))
    assert [(r.e["index"], r.e.value) for r in even.enumerate("e").orderBy("e.index").collect()] == list(enumerate([2, 4, 6, 8, 10]))
    assert one(even.position(F.col("v") == 6)) == 2
    assert rows(even.map_indexed(v=lambda i, v: i * 100 + v).df) == [2, 104, 206, 308, 410]
    assert {r.chunk_id: r.s for r in even.with_splitter(Splitter.fixed(2)).with_workers(1).chunks_agg(F.sum("v").alias("s")).collect()} == {0: 6, 1: 14, 2: 10}
    a, b = ten.partition(F.col("v") > 7)
    assert rows(a.take(2).df) == [8, 9] and rows(b.skip(5).df) == [6, 7]
    assert rows(ten.filter_map("v", F.when(F.col("v") > 5, F.col("v"))).take(1).df) == [6]
    assert rows(even.filter(F.col("v") > 4).take(1).df) == [6]


def test_comparators(spark):
    o = of(spark, [3, 1, 4, 1, 5, 9, 9, None])
    less = lambda a, b: a < b
    assert o.min_by(less).first().asDict() == {"pos": 1, "v": 1} and of(spark, []).min_by(less).isEmpty()
    assert of(spark, [3, 9, 9, 1]).max_by(less).first().pos == 1
    many = Ordered.range(spark, 0, 5000)
    odd_first = lambda a, b: (a % 7 > b % 7) | ((a % 7 == b % 7) & (a > b))
    want = sorted(range(5000), key=lambda v: (-(v % 7), -v))
    assert one(many.min_by(odd_first).select("v")) == want[0] and one(many.max_by(odd_first).select("v")) == want[-1]
    by_mod = lambda a, b: a % 5 < b % 5
    assert one(many.min_by(by_mod).select("v")) == 0 and one(many.max_by(by_mod).select("v")) == 4
    for per_part in (10_000, 300):
        got = ordering.comparator_sort(many.df, "pos", lambda a, b: odd_first(a["v"], b["v"]), rows_per_part=per_part).orderBy("pos").collect()
        assert [r.v for r in got] == want and [r.pos for r in got] == list(range(5000))
        ties = ordering.comparator_sort(many.df, "pos", lambda a, b: by_mod(a["v"], b["v"]), rows_per_part=per_part).orderBy("pos").collect()
        assert [r.v for r in ties] == sorted(range(5000), key=lambda v: v % 5)
    assert rows(of(spark, [5]).sort_by(less).df) == [5] and of(spark, []).sort_by(less).df.isEmpty()
    two = spark.createDataFrame([(0, 2, "b"), (1, 1, "z"), (2, 2, "a")], "pos bigint, k int, s string")
    assert [r.s for r in Ordered.of(two).sort_by(lambda a, b: (a["k"] < b["k"]) | ((a["k"] == b["k"]) & (a["s"] < b["s"]))).df.orderBy("pos").collect()] == ["z", "a", "b"]


def test_known_reducers_and_nulls(spark):
    o = of(spark, [4, None, 6])
    assert (o.reduce(Reducer.sum()), o.reduce(Reducer.product()), o.reduce(Reducer.min("int")), o.reduce(Reducer.max("int"))) == (10, 24, 4, 6)
    b = of(spark, [True, None], "boolean")
    assert (b.reduce(Reducer.all()), b.reduce(Reducer.any())) == (True, True)
    none = of(spark, [])
    assert (none.reduce(Reducer.sum()), none.reduce(Reducer.product()), none.reduce(Reducer.min("int")), of(spark, [], "boolean").reduce(Reducer.all())) == (0, 1, 2**31 - 1, True)
    assert of(spark, ["x", None, "y"], "string").reduce(Reducer("", lambda a, b: a + b)) == "xy"
    assert of(spark, [1.5, 2.0], "double").reduce(Reducer.product()) == 3.0


def test_empty_chunks_are_one_call(spark):
    import pandas as pd

    f = lambda i, r: pd.DataFrame({"i": [i], "n": [len(r)]})
    assert [tuple(r) for r in of(spark, []).chunks(f, "i int, n int").collect()] == [(0, 0)]
    assert [tuple(r) for r in Ordered.range(spark, 0, 9).filter(F.col("v") > 99).chunks(f, "i int, n int").collect()] == [(0, 0)]


def test_cursors(spark):
    c = Ordered.range(spark, 0, 10).iter_chunks(4)
    assert c.remaining() == 10 and [r.v for r in c.next()] == [0, 1, 2, 3] and c.remaining() == 6
    assert [len(x) for x in c] == [4, 2] and c.next() is None and c.remaining() == 0
    c.reset()
    assert c.remaining() == 10 and len(c.next()) == 4
    assert [len(x) for x in Ordered.range(spark, 0, 3).iter_chunks(0)] == [1, 1, 1]
    s = Ordered.range(spark, 0, 10).steps(3)
    assert (s.next().v, s.next().v) == (0, 3) and rows(s.collect()) == [6, 9] and s.next() is None
    s.reset()
    assert [r.v for r in s] == [0, 3, 6, 9] and s.next() is None
    assert [r.v for r in Ordered.range(spark, 1, 11).filter(F.col("v") % 2 == 0).steps(2)] == [2, 6, 10]


def test_pool_holds_only_meanwhile(spark):
    o = Ordered.range(spark, 0, 3).with_pool("fast")
    get = lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    before = get()
    with o.in_pool():
        assert get() == "fast"
    assert get() == before and o.len() == 3 and get() == before


def test_map_operations(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    got = {(r.k, r.seq): r.previous and r.previous.v for r in combine.previous_values(t, changes, "k", "seq").collect()}
    assert got == {("b", 1): 2, ("b", 2): 3, ("c", 1): None}
    keys = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert {r.k: r.found for r in combine.contains(keys, t, "k").collect()} == {"a": True, "z": False, None: False}
    assert one(combine.size(t)) == 2 and {r.k: r.v for r in combine.for_each_value(t, "k", lambda v: v * 10).collect()} == {"a": 10, "b": 20}


def test_ties_are_cut(spark):
    """A frequent key doesn't land in one partition if its rows differ."""
    df = spark.range(0, 20_000, 1, 8).select(F.lit(1).alias("k"), "id")
    got = with_pos(df, [F.col("k")])
    assert sorted(r.pos for r in got.select("pos").collect()) == list(range(20_000))
    sizes = [r[0] for r in df.repartitionByRange(4, "k", F.xxhash64("k", "id")).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000


def test_scratch_scope_deletes(spark):
    with scratch(spark) as keep:
        gone, kept = materialise(spark.range(3), "x"), keep(materialise(spark.range(4), "x"))
        assert gone.count() == 3
    with pytest.raises(Exception, match="FILE|exist|PATH|FAILED"):
        gone.count()
    assert kept.count() == 4
