"""The registered queries of the core engine, each with its SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.frame import Ordered, with_pos
from ordina.functions import reducers as R
from ordina.functions.scalar import ascii_lower, floor_div, gcd, ratio, thousands, unsigned_mod, wrapping_mul
from ordina.operators import cache_sim, combine, folds, graph, ordering, search, sketch
from ordina.plans.scratch import scratch_path
from ordina.plans.splitter import Splitter
from ordina.sources import files
from ordina.streaming import events as ev
from ordina.workloads import logs, numeric, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Entries where a result is one row, as in the original, and where it is a row an entry.
LOGS, LOG_ROWS = 10_000_000, 100_000
_LOGS_TEXT = """(SELECT pos, 1700000000000 + pos AS timestamp, CASE WHEN band < 50 THEN 1 WHEN band < 75 THEN 0 WHEN band < 90 THEN 2 WHEN band < 98 THEN 3 ELSE 4 END AS level,
    seed % 64 AS thread_id, seed & 4294967295 AS message_hash, seed % 2000000 + 1000 AS response_time_us, seed % 1000 < 5 AS is_security_event, seed % 100000 AS user_id
    FROM (SELECT i AS pos, i * 2654435761 AS seed, ((i * 2654435761) >> 24) % 100 AS band FROM range(0, {}) t(i)))"""
_LOGS_SQL, _LOG_ROWS_SQL = _LOGS_TEXT.format(LOGS), _LOGS_TEXT.format(LOG_ROWS)


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> Ordered:
    """event_id is dense from 0, so it is the position."""
    return Ordered.of(table(spark, sf, "events"), "event_id")


def parts(spark: SparkSession, sf: str) -> Ordered:
    return Ordered.of(table(spark, sf, "part"), "p_partkey")


def orders(spark: SparkSession, sf: str) -> Ordered:
    return Ordered.of(table(spark, sf, "orders"), "o_orderkey")


def log_entries(spark: SparkSession, n: int = LOGS) -> DataFrame:
    return logs.generate(spark, n)


# Sources and sinks.
@query("SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS pos, event_id FROM events")
def source_with_pos(spark, sf):
    return with_pos(table(spark, sf, "events").select("user_id", "event_id"), ["user_id", "event_id"]).select("pos", "event_id")


@query("SELECT i - 5 AS pos, i AS v FROM range(5, 5000) t(i)")
def range_source(spark, sf):
    return Ordered.range(spark, 5, 5000).df.select("pos", "v")


@query("SELECT event_id // 1000 AS chunk_id, min(event_id) AS start, count(*) AS rows FROM events GROUP BY 1")
def chunk_iterator(spark, sf):
    """A cursor hands the rows to the driver, a chunk at a time, by definition; only ids go."""
    cursor = Ordered.of(events(spark, sf).df.select("event_id"), "event_id").iter_chunks(1000)
    return spark.createDataFrame([(i, c[0].event_id, len(c)) for i, c in enumerate(cursor)], "chunk_id bigint, start bigint, rows bigint")


@query("SELECT p_partkey AS id, p_retailprice AS measurement, p_brand AS category, p_type AS description, p_size % 2 AS is_active FROM part")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    p = table(spark, sf, "part")
    files.write_csv(p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("measurement"), F.col("p_brand").alias("category"), F.col("p_type").alias("description"), (F.col("p_size") % 2).alias("is_active")), path)
    return files.read_csv(spark, path)


@query()
def csv_generator(spark, sf):
    return files.generate_csv_rows(spark, 10_000)


_IMAGE_SQL = "(SELECT CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y, CAST(255 * (i % 64) // 64 AS INT) AS r, CAST(255 * (i // 64) // 48 AS INT) AS g, CAST(128 * (i % 64 + i // 64) // 112 AS INT) AS b FROM range(0, 3072) t(i))"


@query(f"SELECT * FROM {_IMAGE_SQL}")
def ppm_roundtrip(spark, sf):
    path = scratch_path(spark, "ppm")
    files.write_ppm(numeric.test_image(spark, 64, 48), 64, 48, path)
    return files.read_ppm(spark, f"{path}/part-*").drop("path")


@query(f"SELECT pos, timestamp, CAST(level AS INT) AS level, CAST(thread_id AS INT) AS thread_id, message_hash, response_time_us, is_security_event, user_id FROM {_LOG_ROWS_SQL}")
def log_generator(spark, sf):
    return log_entries(spark, LOG_ROWS)


_SPANS_SQL = "(SELECT event_id AS span_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id - event_id % 5 END AS parent_id, event_type AS name, event_id * 1000 AS start_ns, event_id * 1000 + CASE WHEN event_id % 5 = 0 THEN 20000 ELSE 100 + event_id % 900 END AS end_ns FROM events)"


def _spans(spark, sf):
    i = F.col("event_id")
    root = i % 5 == 0
    return table(spark, sf, "events").select(i.alias("span_id"), F.when(~root, i - i % 5).alias("parent_id"), F.col("event_type").alias("name"), (i * 1000).alias("start_ns"), (i * 1000 + F.when(root, 20000).otherwise(100 + i % 900)).alias("end_ns"), (i % 4).alias("thread"))


@query(f"SELECT name, 'X' AS ph, start_ns / 1000.0::DOUBLE AS ts, (end_ns - start_ns) / 1000.0::DOUBLE AS dur, CAST(1 AS BIGINT) AS pid, span_id % 4 AS tid FROM {_SPANS_SQL}")
def trace_export(spark, sf):
    path = scratch_path(spark, "trace")
    files.write_text(files.trace_events(_spans(spark, sf)), path)
    event = F.from_json("line", "name string, ph string, ts double, dur double, pid bigint, tid bigint")
    return files.read_lines(spark, path).select(event.alias("e")).select("e.*")


@query("SELECT '| ' || event_type || ' | ' || n || ' |' AS value FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) UNION ALL SELECT '| ' || event_type || ' | ' || n || ' |' FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def report_sink(spark, sf):
    path = scratch_path(spark, "report")
    rows = files.markdown_rows(table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type", "n"])
    files.write_text(rows, path)
    files.write_text(rows, path, append=True)
    return files.read_lines(spark, path).withColumnRenamed("line", "value")


# Configuration.
_PLANS = [(kind, n, w, least, goal) for kind in ("fixed", "adaptive", "recursive") for n in (0, 1, 999, 2048, 100_000) for w in (1, 4, 16) for least in (0, 100, 2048) for goal in (None, 8)]
_PLAN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, {w}, {m}, {'CAST(NULL AS INT)' if g is None else g})" for k, n, w, m, g in _PLANS) + ") t(kind, n, w, least, goal)"


@query(f"""WITH p AS ({_PLAN_SQL}), s AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN kind <> 'adaptive' THEN greatest(1, least) ELSE greatest(1, least, n // coalesce(goal, 2 * w)) END AS chunk_size FROM p)
SELECT kind, n, w, least, goal, CAST(chunk_size AS INT) AS chunk_size, CAST(CASE WHEN n = 0 THEN 0 ELSE ceil(n / chunk_size) END AS INT) AS chunks, n >= w * greatest(1, least) AS splits FROM s""")
def chunk_plans(spark, sf):
    rows = []
    for kind, n, w, least, goal in _PLANS:
        s = Splitter(kind, least, goal)
        rows.append((kind, n, w, least, goal, s.chunk_size(n, w), s.num_chunks(n, w), s.should_split(n, w)))
    return spark.createDataFrame(rows, "kind string, n int, w int, least int, goal int, chunk_size int, chunks int, splits boolean")


@query("SELECT count(*) AS count FROM events WHERE value > 50")
def configured_count(spark, sf):
    o = events(spark, sf).with_splitter(Splitter.fixed(100)).with_min_chunk(10).with_max_chunks(4).with_alloc().with_workers(4).with_context(50)
    return o.count(lambda limit, _: F.col("value") > limit)


# Row by row.
@query("SELECT p_partkey, CAST(p_size AS BIGINT) * p_size AS squared FROM part")
def map_expr(spark, sf):
    return parts(spark, sf).map(squared=F.col("p_size").cast("bigint") * F.col("p_size")).df


@query("SELECT event_id, event_id + user_id AS v FROM events")
def map_indexed(spark, sf):
    return events(spark, sf).map_indexed(v=lambda i, _: i + F.col("user_id")).df


@query("SELECT p_partkey, p_size | 64 AS p_size FROM part")
def for_each_update(spark, sf):
    return parts(spark, sf).for_each(p_size=lambda v: v.bitwiseOR(F.lit(64))).df.select("p_partkey", "p_size")


@query("SELECT event_id, 100 + event_id AS user_id FROM events")
def for_each_indexed(spark, sf):
    return events(spark, sf).with_context(100).for_each_indexed(user_id=lambda base, i, _: F.lit(base) + i).df.select("event_id", "user_id")


@query("SELECT i * 3 AS tripled FROM range(0, 1000) t(i)")
def range_for_each(spark, sf):
    return Ordered.range(spark, 0, 1000).map(tripled=lambda v: v * 3).df.select("tripled")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def filter_keep_order(spark, sf):
    return orders(spark, sf).filter(F.col("o_totalprice") > 200000).df.select("o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice FROM orders WHERE o_totalprice > 200000")
def filter_dense(spark, sf):
    o = orders(spark, sf)
    return Ordered.of(o.df.select(F.col("o_orderkey").alias("pos"), "o_totalprice")).filter(F.col("o_totalprice") > 200000).dense().df.select("pos", "o_totalprice")


@query("SELECT p_partkey, p_size * 10 AS v FROM part WHERE p_size % 2 = 0")
def filter_map(spark, sf):
    return parts(spark, sf).filter_map("v", F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 10)).df


@query("SELECT p_partkey, CAST(i - 1 AS INT) AS sub, ws[i] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def flat_map(spark, sf):
    return parts(spark, sf).flat_map("word", F.split("p_name", " "))


@query("SELECT o_orderkey, coalesce(o_totalprice > 150000, false) AS matching FROM orders")
def partition_both(spark, sf):
    a, b = orders(spark, sf).partition(F.col("o_totalprice") > 150000)
    return a.df.select("o_orderkey", F.lit(True).alias("matching")).unionAll(b.df.select("o_orderkey", F.lit(False).alias("matching")))


@query("SELECT event_id, value FROM events")
def inspect_rows(spark, sf):
    from pyspark.sql import Observation

    return events(spark, sf).inspect(Observation("seen"), F.count(F.lit(1)).alias("rows")).df.select("event_id", "value")


@query("SELECT event_id AS index, user_id AS value FROM events")
def enumerate_rows(spark, sf):
    o = Ordered.of(events(spark, sf).cloned().df.select("event_id", "user_id"), "event_id")
    return o.enumerate("e").select("e.index", "e.value")


@query("SELECT (SELECT max(event_id) FROM events) - event_id AS event_id, user_id FROM events")
def rev(spark, sf):
    return events(spark, sf).rev().df.select("event_id", "user_id")


@query("SELECT event_id // 7 AS event_id, user_id FROM events WHERE event_id % 7 = 0")
def step_by(spark, sf):
    return events(spark, sf).step_by(7).df.select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 99 ELSE user_id END AS user_id FROM events")
def step_for_each(spark, sf):
    return events(spark, sf).step_for_each(2, user_id=F.lit(99).cast("bigint")).df.select("event_id", "user_id")


@query("SELECT event_id - 100 AS event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 600")
def skip_take(spark, sf):
    return events(spark, sf).skip(100).take(500).df.select("event_id", "user_id")


@query("SELECT 'first' AS what, event_id, user_id FROM events WHERE event_id = 0 UNION ALL SELECT 'nth', event_id, user_id FROM events WHERE event_id = 42 UNION ALL SELECT 'last', event_id, user_id FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def nth_first_last(spark, sf):
    o = events(spark, sf)
    rows = [(w, d.select(F.lit(w).alias("what"), "event_id", "user_id")) for w, d in (("first", o.first()), ("nth", o.nth(42)), ("last", o.last()), ("none", o.nth(-1)))]
    out = rows[0][1]
    for _, d in rows[1:]:
        out = out.unionAll(d)
    return out


@query("SELECT count(*) AS len, count(*) = 0 AS is_empty FROM events UNION ALL SELECT 0, true")
def len_is_empty(spark, sf):
    both = (events(spark, sf), events(spark, sf).filter(F.lit(False)))
    return spark.createDataFrame([(o.len(), o.is_empty()) for o in both], "len bigint, is_empty boolean")


_KEPT = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey AS v FROM orders WHERE o_totalprice > 200000)"


def _kept(spark, sf):
    """Orders beyond a price, by position; the filter leaves gaps."""
    o = Ordered.of(orders(spark, sf).df.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"), "o_totalprice"))
    return o.filter(F.col("o_totalprice") > 200000).map(v=F.col("v"))


@query(f"""SELECT 'take' AS what, pos, v FROM {_KEPT} WHERE pos < 50 UNION ALL SELECT 'skip', pos - 100, v FROM {_KEPT} WHERE pos >= 100 UNION ALL SELECT 'nth', pos, v FROM {_KEPT} WHERE pos = 7
UNION ALL SELECT 'step', pos // 3, v FROM {_KEPT} WHERE pos % 3 = 0 UNION ALL SELECT 'rev', (SELECT max(pos) FROM {_KEPT}) - pos, v FROM {_KEPT}
UNION ALL SELECT 'chain', pos, v FROM {_KEPT} UNION ALL SELECT 'chain', pos + (SELECT count(*) FROM {_KEPT}), v FROM {_KEPT}""")
def filtered_positions(spark, sf):
    """Operators that go by position on what a filter left."""
    o = _kept(spark, sf)
    found = {"take": o.take(50).df, "skip": o.skip(100).df, "nth": o.nth(7), "step": o.step_by(3).df, "rev": o.rev().df, "chain": o.chain(o).df}
    rows = [d.select(F.lit(w).alias("what"), "pos", "v") for w, d in found.items()]
    return reduce(DataFrame.unionAll, rows)


@query(f"SELECT a.pos, a.v AS first, b.v AS second FROM {_KEPT} a JOIN (SELECT p_partkey AS pos, CAST(p_size AS BIGINT) AS v FROM part) b ON a.pos = b.pos")
def filtered_zip(spark, sf):
    return _kept(spark, sf).zip(Ordered.of(parts(spark, sf).df.select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("v"))))


@query(f"SELECT pos // 64 AS chunk_id, CAST(sum(v) AS BIGINT) AS s FROM {_KEPT} GROUP BY 1")
def filtered_chunks(spark, sf):
    return _kept(spark, sf).with_splitter(Splitter.fixed(64)).with_workers(1).chunks_agg(F.sum("v").alias("s"))


@query("SELECT p_partkey AS pos, CAST(p_size AS BIGINT) AS v FROM part WHERE p_partkey % 4 = 0 AND p_partkey >= 8")
def step_cursor(spark, sf):
    """Two rows by the cursor, which then gives the rest."""
    cursor = Ordered.of(parts(spark, sf).df.select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("v"))).steps(4)
    cursor.next()
    cursor.next()
    return cursor.collect()


# Reductions.
@query("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS sum, coalesce(min(p_size), 2147483647) AS min, coalesce(max(p_size), -2147483648) AS max FROM part UNION ALL SELECT 0, 2147483647, -2147483648")
def reduce_sum_min_max(spark, sf):
    v = F.col("p_size")
    both = [d.agg(R.sum_of(v, "bigint").alias("sum"), R.min_of(v, "int").alias("min"), R.max_of(v, "int").alias("max")) for d in (parts(spark, sf).df, parts(spark, sf).df.where("false"))]
    return both[0].unionAll(both[1])


@query("SELECT CAST(CASE WHEN count(*) FILTER (WHERE p_size % 2 = 0) % 2 = 1 THEN -1 ELSE 1 END AS BIGINT) AS product FROM part UNION ALL SELECT 1")
def reduce_product(spark, sf):
    """A product of signs, which fits for any number of rows."""
    o = Ordered.of(parts(spark, sf).df.select("p_partkey", F.when(F.col("p_size") % 2 == 0, -1).otherwise(1).cast("bigint").alias("v")), "p_partkey")
    return o.product().unionAll(o.filter(F.lit(False)).product())


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, min(p_size) AS least, max(p_size) AS most, bool_and(p_size > 0) AS every, bool_or(p_size > 49) AS some, CAST(0 AS BIGINT) AS none FROM part")
def reduce_known(spark, sf):
    """Reducers that Spark has, as its aggregates."""
    o = Ordered.of(parts(spark, sf).df.select("p_partkey", "p_size", (F.col("p_size") > 0).alias("positive"), (F.col("p_size") > 49).alias("large")), "p_partkey")
    found = o.reduce(R.Reducer.sum(), "p_size"), o.reduce(R.Reducer.min("int"), "p_size"), o.reduce(R.Reducer.max("int"), "p_size"), o.reduce(R.Reducer.all(), "positive"), o.reduce(R.Reducer.any(), "large"), o.filter(F.lit(False)).reduce(R.Reducer.sum(), "p_size")
    return spark.createDataFrame([found], "total bigint, least int, most int, every boolean, some boolean, none bigint")


@query("SELECT arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last, count(*) FILTER (WHERE event_type <> before) AS changes FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS before FROM events)")
def reduce_custom(spark, sf):
    """An associative function that doesn't commute: ends and changes of a run."""
    run = F.struct(F.col("event_type").alias("first"), F.col("event_type").alias("last"), F.lit(0).alias("changes"))
    o = Ordered.of(events(spark, sf).df.select("event_id", run.alias("v")), "event_id")
    joined = lambda a, b: b if a is None else a if b is None else {"first": a["first"], "last": b["last"], "changes": a["changes"] + b["changes"] + (a["last"] != b["first"])}
    found = o.reduce(R.Reducer(None, joined)) or dict.fromkeys(("first", "last", "changes"))
    return spark.createDataFrame([(found["first"], found["last"], found["changes"])], "first string, last string, changes bigint")


@query("SELECT CAST(sum(p_size) AS BIGINT) AS folded, CAST(sum(p_size) AS BIGINT) AS reduced FROM part")
def try_fold_reduce(spark, sf):
    o = Ordered.of(parts(spark, sf).df.select("p_partkey", "p_size"), "p_partkey")
    return spark.createDataFrame([(o.try_fold(0, lambda a, b: a + b), o.try_reduce(lambda a, b: a + b))], "folded bigint, reduced bigint")


@query("SELECT coalesce(bool_and(l_quantity > 0), true) AS every, coalesce(bool_or(l_quantity > 49), false) AS some, true AS every_of_none, false AS some_of_none FROM lineitem")
def bool_reducers(spark, sf):
    q = F.col("l_quantity")
    full = table(spark, sf, "lineitem").agg(R.all_of(q > 0).alias("every"), R.any_of(q > 49).alias("some"))
    none = table(spark, sf, "lineitem").where("false").agg(R.all_of(q > 0).alias("every_of_none"), R.any_of(q > 49).alias("some_of_none"))
    return full.crossJoin(none)


@query("SELECT * FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 1)")
def min_by_key_first_tie(spark, sf):
    return parts(spark, sf).min_by_key(F.col("p_size")).select("p_partkey", "p_size")


@query("SELECT * FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1)")
def max_by_key_first_tie(spark, sf):
    return parts(spark, sf).max_by_key(F.col("p_size")).select("p_partkey", "p_size")


@query("SELECT * FROM (SELECT 'min' AS what, p_partkey, p_size FROM part ORDER BY p_size % 7, p_size, p_partkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'max', p_partkey, p_size FROM part ORDER BY p_size % 7 DESC, p_size DESC, p_partkey LIMIT 1)")
def best_by_comparator(spark, sf):
    o = Ordered.of(parts(spark, sf).df.select("p_partkey", "p_size"), "p_partkey")
    less = lambda a, b: (a % 7 < b % 7) | ((a % 7 == b % 7) & (a < b))
    return o.min_by(less).select(F.lit("min").alias("what"), "p_partkey", "p_size").unionAll(o.max_by(less).select(F.lit("max"), "p_partkey", "p_size"))


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large, count(*) FILTER (WHERE user_id % 2 = 0) AS even, count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS sales FROM events")
def count_pred_fused(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("sales"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS folded FROM orders GROUP BY o_custkey")
def fold_by_group(spark, sf):
    return folds.fold_by_group(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus"), F.lit(""), lambda a, v: F.concat(a, v))


@query("SELECT CAST(sum(s) AS BIGINT) AS total, count(*) AS chunks FROM (SELECT event_id // 512 AS c, sum(user_id) AS s FROM events GROUP BY 1)")
def chunk_local_sum(spark, sf):
    o = events(spark, sf).with_splitter(Splitter.fixed(512)).with_workers(1)
    return o.chunks_agg(F.sum("user_id").alias("s")).agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("chunks"))


# Search.
@query("SELECT coalesce(bool_or(value > 99), false) AS any, coalesce(bool_and(value >= 0), true) AS all FROM events")
def any_all(spark, sf):
    o = events(spark, sf)
    return o.any(F.col("value") > 99).crossJoin(o.all(F.col("value") >= 0))


@query("SELECT * FROM (SELECT 'first' AS what, event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'last', event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1)")
def find_first_last(spark, sf):
    o, p = events(spark, sf), F.col("event_type") == "purchase"
    return o.find_first(p).select(F.lit("first").alias("what"), "event_id", "user_id").unionAll(o.find_last(p).select(F.lit("last"), "event_id", "user_id"))


@query("SELECT * FROM (SELECT user_id * 10 AS v FROM events WHERE value > 90 ORDER BY event_id LIMIT 1)")
def find_map(spark, sf):
    return events(spark, sf).find_map("v", F.when(F.col("value") > 90, F.col("user_id") * 10))


@query("SELECT min(event_id) AS position FROM events WHERE user_id > 50 UNION ALL SELECT NULL")
def position(spark, sf):
    o = events(spark, sf)
    return o.position(F.col("user_id") > 50).unionAll(o.position(F.lit(False)))


@query("SELECT count(*) FILTER (WHERE o_totalprice < 100000) AS insert_point FROM orders")
def insert_point(spark, sf):
    return search.insert_point(table(spark, sf, "orders"), F.col("o_totalprice"), F.lit(100000))


# Chunks.
@query("SELECT event_id // 1000 AS chunk_id, CAST(sum(2 * user_id) + event_id // 1000 AS BIGINT) AS s FROM events GROUP BY event_id // 1000 UNION ALL SELECT 0, 0")
def chunks_apply(spark, sf):
    """By chunk; no rows are one empty chunk."""
    import pandas as pd

    o = Ordered.of(events(spark, sf).df.select("event_id", "user_id"), "event_id").with_splitter(Splitter.fixed(1000)).with_workers(1)
    f = lambda i, rows: pd.DataFrame({"chunk_id": [i], "s": [int((2 * rows["user_id"]).sum()) + i]})
    return o.chunks(f, "chunk_id bigint, s bigint").unionAll(o.filter(F.lit(False)).chunks(f, "chunk_id bigint, s bigint"))


@query("SELECT event_id // 1000 AS chunk_id, count(*) AS n, max(value) AS largest FROM events GROUP BY 1")
def chunks_const(spark, sf):
    return events(spark, sf).with_splitter(Splitter.fixed(1000)).with_workers(1).chunks_agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))


# Order.
@query("SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS p_partkey, p_size, p_name FROM part")
def sort_stable(spark, sf):
    return Ordered.of(parts(spark, sf).df.select("p_partkey", "p_size", "p_name"), "p_partkey").sort(F.col("p_size")).df


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY 1")
def sort_comparator(spark, sf):
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    by = ordering.sort_array_by(items, lambda a, b: a["o_totalprice"] > b["o_totalprice"])
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(by, lambda s: s["o_orderkey"].cast("string")), ",").alias("keys"))


@query("SELECT row_number() OVER (ORDER BY v, side, old) - 1 AS pos, v FROM (SELECT p_size AS v, 0 AS side, row_number() OVER (ORDER BY p_size, p_partkey) AS old FROM part UNION ALL SELECT l_linenumber, 1, row_number() OVER (ORDER BY l_linenumber, l_orderkey) FROM lineitem)")
def merge_sorted(spark, sf):
    """Line numbers are few: the rest of the key cuts them into tasks."""
    a = with_pos(table(spark, sf, "part").select(F.col("p_size").alias("v"), F.col("p_partkey").alias("k")), ["v", "k"])
    b = with_pos(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("v"), F.col("l_orderkey").alias("k")), ["v", "k"])
    return ordering.merge_sorted(a, b, "pos", ["v"], with_pos).select("pos", "v")


@query("SELECT row_number() OVER (ORDER BY p_size % 7 DESC, p_size, p_partkey) - 1 AS p_partkey, p_size, p_name FROM part")
def sort_by_comparator(spark, sf):
    o = Ordered.of(parts(spark, sf).df.select("p_partkey", "p_size", "p_name"), "p_partkey")
    less = lambda a, b: (a["p_size"] % 7 > b["p_size"] % 7) | ((a["p_size"] % 7 == b["p_size"] % 7) & (a["p_size"] < b["p_size"]))
    return o.sort_by(less).df


@query("SELECT row_number() OVER (ORDER BY v, i) - 1 AS pos, v FROM (SELECT i, (((i * 2654435 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648 AS v FROM range(0, 100000) t(i))")
def sort_integers(spark, sf):
    return Ordered.of(numeric.seeded_integers(spark, 100_000)).sort(F.col("v")).df


@query("SELECT * FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3)")
def top_k(spark, sf):
    return ordering.top_k(table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), 3, [F.desc("n"), F.col("event_type")])


# Combination.
@query("SELECT event_id AS pos, user_id AS first, o_custkey AS second FROM events JOIN orders ON event_id = o_orderkey")
def zip_truncate(spark, sf):
    return Ordered.of(events(spark, sf).df.select("event_id", "user_id"), "event_id").zip(Ordered.of(orders(spark, sf).df.select("o_orderkey", "o_custkey"), "o_orderkey"))


@query("SELECT p_partkey AS pos, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT o_orderkey + (SELECT count(*) FROM part), o_custkey FROM orders")
def chain(spark, sf):
    a = Ordered.of(parts(spark, sf).df.select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("v")))
    return a.chain(Ordered.of(orders(spark, sf).df.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v")))).df


@query("SELECT CAST((SELECT sum(p_size) FROM part) AS BIGINT) AS total, (SELECT count(*) FROM events WHERE user_id % 2 = 0) AS even")
def fork_join(spark, sf):
    a, b = combine.both(lambda: table(spark, sf, "part").agg(F.sum("p_size")).first()[0], lambda: table(spark, sf, "events").where("user_id % 2 = 0").count())
    return spark.createDataFrame([(a, b)], "total bigint, even bigint")


@query("SELECT i AS i, j AS j, CAST(sum(a * b) AS BIGINT) AS c FROM (SELECT r % 32 AS i, r // 32 AS k, r % 7 AS a FROM range(0, 1024) t(r)) JOIN (SELECT r % 32 AS k2, r // 32 AS j, r % 5 AS b FROM range(0, 1024) t(r)) ON k = k2 GROUP BY i, j")
def matrix_multiply(spark, sf):
    r = spark.range(1024)
    a = r.select((F.col("id") % 32).alias("i"), F.floor(F.col("id") / 32).alias("k"), (F.col("id") % 7).alias("a"))
    b = r.select((F.col("id") % 32).alias("k"), F.floor(F.col("id") / 32).alias("j"), (F.col("id") % 5).alias("b"))
    return combine.matrix_product(a, b)


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def map_lookup(spark, sf):
    keys = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return combine.lookup(keys, table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), "n_name"), "key").select("c_custkey", "n_name")


@query("SELECT k, arg_max(v, s) AS v FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS v, -1 AS s FROM part UNION ALL SELECT user_id, event_id, event_id FROM events) WHERE k % 10 <> 3 GROUP BY k")
def map_upsert_remove(spark, sf):
    t, changes = _part_map(spark, sf), _user_puts(spark, sf)
    gone = t.select("k").unionAll(changes.select("k")).where("k % 10 = 3").distinct()
    return combine.remove(combine.upsert(t, changes, "k", "seq"), gone, "k")


def _part_map(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("v"))


def _user_puts(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.col("event_id").alias("seq"))


@query("SELECT seq, k, v, lag(v) OVER (PARTITION BY k ORDER BY seq) AS previous FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS v, -1 AS seq FROM part UNION ALL SELECT user_id, event_id, event_id FROM events) QUALIFY seq >= 0")
def map_put_previous(spark, sf):
    return combine.previous_values(_part_map(spark, sf), _user_puts(spark, sf), "k", "seq").select("seq", "k", "v", F.col("previous.v").alias("previous"))


@query("SELECT count(*) FILTER (WHERE found) AS found, count(*) AS asked, (SELECT count(*) FROM part) AS len, (SELECT CAST(sum(p_size * 2) AS BIGINT) FROM part) AS doubled FROM (SELECT user_id IN (SELECT p_partkey FROM part) AS found FROM events)")
def map_contains_len_each(spark, sf):
    t = _part_map(spark, sf)
    asked = combine.contains(table(spark, sf, "events").select(F.col("user_id").alias("k")), t, "k").agg(F.count_if("found").alias("found"), F.count(F.lit(1)).alias("asked"))
    return asked.crossJoin(combine.size(t)).crossJoin(combine.for_each_value(t, "k", lambda v: v * 2).agg(F.sum("v").alias("doubled")))


@query("SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE event_id % 2 = 1 GROUP BY 1) GROUP BY 1")
def map_merge(spark, sf):
    e = table(spark, sf, "events")
    a, b = (e.where(f"event_id % 2 = {k}").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")) for k in (0, 1))
    return combine.merge_counts(a, b, "event_type", "n")


# Workloads.
@query(f"SELECT count(*) FILTER (WHERE level >= 3) AS errors, count(*) FILTER (WHERE level = 4) AS critical, count(*) FILTER (WHERE is_security_event) AS security, count(*) FILTER (WHERE response_time_us > 1000000) AS slow, count(*) FILTER (WHERE response_time_us > 500000) AS over_limit, count(*) FILTER (WHERE level >= 2) AS severe FROM {_LOGS_SQL}")
def log_counts(spark, sf):
    return logs.counts(log_entries(spark))


@query(f"SELECT bool_or(level = 4) AS any_critical, bool_or(is_security_event) AS any_security, bool_and(timestamp > 0) AS all_dated, bool_and(thread_id < 64) AS all_threads FROM {_LOGS_SQL}")
def log_checks(spark, sf):
    return logs.checks(log_entries(spark))


@query(f"SELECT min(pos) FILTER (WHERE level = 4) AS critical, min(pos) FILTER (WHERE is_security_event) AS security, min(pos) FILTER (WHERE user_id = 12345) AS user FROM {_LOGS_SQL}")
def log_firsts(spark, sf):
    return logs.firsts(log_entries(spark))


@query(f"SELECT min(response_time_us) AS min, max(response_time_us) AS max, CAST(sum(response_time_us) // count(*) AS BIGINT) AS avg FROM {_LOGS_SQL}")
def log_response_times(spark, sf):
    return logs.response_times(log_entries(spark))


@query(f"SELECT pos, response_time_us FROM {_LOG_ROWS_SQL} WHERE level = 4")
def log_extract_critical(spark, sf):
    return log_entries(spark, LOG_ROWS).where(logs.critical()).select("pos", "response_time_us")


@query(f"SELECT count(*) FILTER (WHERE ((message_hash | 2147483648) & 2147483648) <> 0) AS flagged FROM {_LOGS_SQL} WHERE pos < 1000000")
def log_flags(spark, sf):
    return logs.flagged(log_entries(spark))


@query(f"SELECT pos, 1000 + pos AS timestamp FROM {_LOG_ROWS_SQL}")
def log_sequence(spark, sf):
    return logs.sequenced(log_entries(spark, LOG_ROWS), 1000).select("pos", "timestamp")


@query("SELECT count(*) FILTER (WHERE i % 2 = 0) AS even, count(*) FILTER (WHERE i % 7 = 0) AS sevenths FROM range(0, 10000000) t(i)")
def range_counts(spark, sf):
    o = Ordered.range(spark, 0, 10_000_000)
    return o.count(F.col("v") % 2 == 0).withColumnRenamed("count", "even").crossJoin(o.count(F.col("v") % 7 == 0).withColumnRenamed("count", "sevenths"))


@query(f"SELECT pos, response_time_us + 250 * (level + 1) AS score FROM {_LOG_ROWS_SQL}")
def log_boost(spark, sf):
    return logs.boosted(log_entries(spark, LOG_ROWS), 250)


@query(f"SELECT pos FROM {_LOG_ROWS_SQL} WHERE level >= 2 AND response_time_us < 500000")
def log_fast_but_severe(spark, sf):
    return logs.fast_but_severe(log_entries(spark, LOG_ROWS)).select("pos")


@query(f"SELECT pos, 1000 + pos + response_time_us AS id FROM {_LOG_ROWS_SQL}")
def log_numbered(spark, sf):
    return logs.numbered(log_entries(spark, LOG_ROWS))


@query(f"SELECT CAST(sum(s + c) AS BIGINT) AS total FROM (SELECT pos // 10000 AS c, sum(2 * response_time_us) AS s FROM {_LOGS_SQL} GROUP BY 1)")
def log_chunk_sum(spark, sf):
    return logs.chunk_sum(log_entries(spark), 10_000, 2)


def _line_table(spark, sf):
    return table(spark, sf, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_brand", "p_name").alias("line"))


_LINES = "(SELECT CAST(p_partkey AS VARCHAR) || ',' || CAST(p_size AS VARCHAR) || ',' || p_brand || ',' || p_name AS line FROM part)"


@query(f"SELECT lines, commas, digits, commas // lines + 1 AS fields FROM (SELECT count(*) AS lines, CAST(sum(length(line) - length(replace(line, ',', ''))) AS BIGINT) AS commas, CAST(sum(length(line) - length(regexp_replace(line, '[0-9]', '', 'g'))) AS BIGINT) AS digits FROM {_LINES})")
def csv_byte_stats(spark, sf):
    return text.byte_stats(_line_table(spark, sf), "line")


@query("SELECT count(*) FILTER (WHERE p_size % 2 = 1) AS active, 100.0::DOUBLE * count(*) FILTER (WHERE p_size % 2 = 1) / count(*) AS percent FROM part")
def csv_active(spark, sf):
    return text.active_share(table(spark, sf, "part").select((F.col("p_size") % 2).alias("is_active")))


@query("SELECT l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY 1")
def category_counts(spark, sf):
    return text.category_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category")))


@query("SELECT count(*) FILTER (WHERE p_size > 40) AS above, count(*) FILTER (WHERE p_size < 10) AS below FROM part")
def csv_thresholds(spark, sf):
    return text.threshold_counts(_line_table(spark, sf), "line", 1, 40, 10)


@query(f"SELECT count(*) FILTER (WHERE contains(line, '1,')) AS hits, 100.0::DOUBLE * count(*) FILTER (WHERE contains(line, '1,')) / count(*) AS percent FROM {_LINES}")
def csv_contains(spark, sf):
    return text.containing(_line_table(spark, sf), "line", "1,")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents) GROUP BY word")
def word_count(spark, sf):
    return text.word_counts(table(spark, sf, "documents"), "text")


@query("SELECT * FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 10)")
def topk_words(spark, sf):
    return text.top_words(text.word_counts(table(spark, sf, "documents"), "text"))


@query("SELECT CAST(sum(i) AS BIGINT) AS sum, min(i) AS min, max(i) AS max, CAST(100000 AS BIGINT) * 100001 // 2 AS expected FROM range(1, 100001) t(i)")
def parallel_sum(spark, sf):
    v = F.col("id")
    return spark.range(1, 100_001).agg(F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.lit(100_000 * 100_001 // 2).alias("expected"))


@query("SELECT bool_or(i = 7777777) AS any, bool_and(i >= 0) AS all, min(i) FILTER (WHERE i = 7777777) AS position, count(*) FILTER (WHERE i % 2 = 0) AS count FROM range(0, 10000000) t(i)")
def parallel_find(spark, sf):
    o, v = Ordered.range(spark, 0, 10_000_000), F.col("v")
    return o.any(v == 7_777_777).crossJoin(o.all(v >= 0)).crossJoin(o.position(v == 7_777_777)).crossJoin(o.count(v % 2 == 0))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * p_size AS cube FROM part")
def map_demo(spark, sf):
    v = F.col("p_size").cast("bigint")
    return table(spark, sf, "part").select("p_partkey", (v * v * v).alias("cube"))


@query("SELECT i AS id, CAST(sqrt(CAST(i AS DOUBLE) * i + 1) * sin(i * 0.001::DOUBLE) AS FLOAT) AS v FROM range(0, 10000) t(i)")
def map_kernel_f32(spark, sf):
    return spark.range(10_000).select("id", numeric.kernel_f32(F.col("id").cast("float")).alias("v"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS sum, CAST(sum(p_size) // count(*) AS BIGINT) AS avg, min(p_size) AS min, max(p_size) AS max FROM part")
def vec_stats(spark, sf):
    s = F.sum("p_size")
    return table(spark, sf, "part").agg(s.alias("sum"), floor_div(s, F.count(F.lit(1))).alias("avg"), F.min("p_size").alias("min"), F.max("p_size").alias("max"))


@query("SELECT min(v) AS min, max(v) AS max FROM (SELECT greatest(2 * (p_size - 25), 0) AS v FROM part)")
def chunk_pipeline(spark, sf):
    v = table(spark, sf, "part").select(numeric.double_clamp(F.col("p_size") - 25, True, True).alias("v"))
    return v.agg(F.min("v").alias("min"), F.max("v").alias("max"))


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos, c_custkey FROM customer")
def sort_people(spark, sf):
    return with_pos(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")]).select("pos", "c_custkey")


@query("SELECT i AS n FROM range(2, 3001) t(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 55) u(d) WHERE d < i AND i % d = 0)")
def primes(spark, sf):
    return numeric.primes(spark, 3000)


@query("SELECT count(*) AS n FROM range(2, 100001) t(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 317) u(d) WHERE d < i AND i % d = 0)")
def primes_count(spark, sf):
    return numeric.primes(spark, 100_000).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a, b, c FROM (SELECT a, b, CAST(round(sqrt(a * a + b * b)) AS BIGINT) AS c FROM range(1, 2000) x(a), range(1, 2000) y(b) WHERE a < b) WHERE c <= 2000 AND a * a + b * b = c * c AND gcd(a, b) = 1")
def triples(spark, sf):
    return numeric.triples(spark, 2000)


@query()
def monte_carlo_pi(spark, sf):
    return numeric.monte_carlo_pi(spark, 1_000_000)


@query(f"SELECT x, y, (77 * r + 150 * g + 29 * b) >> 8 AS gray, least(255, (r * 393 + g * 769 + b * 189) // 1000) AS sepia_r, least(255, (r * 349 + g * 686 + b * 168) // 1000) AS sepia_g, least(255, (r * 272 + g * 534 + b * 131) // 1000) AS sepia_b, least(255, r + 30) AS bright_r, 255 - r AS inverted_r, (r + g + b) // 3 > 128 AS is_bright FROM {_IMAGE_SQL}")
def image_kernels(spark, sf):
    return numeric.image_kernels(numeric.test_image(spark, 64, 48))


_LIFE_STEPS = ", ".join(
    f"n{i} AS (SELECT (r + dr + 24) % 24 AS r, (c + dc + 24) % 24 AS c, count(*) AS n FROM s{i}, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) d(dr, dc) GROUP BY 1, 2), "
    f"s{i + 1} AS (SELECT n{i}.r, n{i}.c FROM n{i} LEFT JOIN s{i} ON n{i}.r = s{i}.r AND n{i}.c = s{i}.c WHERE n = 3 OR (n = 2 AND s{i}.r IS NOT NULL))"
    for i in range(6)
)


@query(f"WITH s0 AS (SELECT i // 24 AS r, i % 24 AS c FROM range(0, 576) t(i) WHERE (i * i + 5 * i) % 11 < 4), {_LIFE_STEPS} SELECT r, c FROM s6")
def game_of_life(spark, sf):
    """Six steps of a crowded grid."""
    i = F.col("id")
    return numeric.life(spark.range(576).where((i * i + 5 * i) % 11 < 4).select(F.floor(i / 24).alias("r"), (i % 24).alias("c")), 24, 24, 6)


@query("""WITH RECURSIVE b(i, k, x, y, vx, vy, m) AS (SELECT i, 0, CAST(i % 10 AS DOUBLE), 0.0::DOUBLE, CAST(i % 3 AS DOUBLE), CAST(i % 5 AS DOUBLE), (i % 7 + 1) * 1e10::DOUBLE FROM range(0, 500) t(i)
UNION ALL SELECT i, k + 1, x + (vx + 0.001 * m / 1e10) * 0.01, y + (vy + 0.001 * m / 1e10) * 0.01, vx + 0.001 * m / 1e10, vy + 0.001 * m / 1e10, m FROM b WHERE k < 10)
SELECT round(sum(0.5 * m / 1e10 * (vx * vx + vy * vy + 1e-4 * (m / 1e10) * (m / 1e10))), 6) AS energy, round(sum(x), 6) AS x, round(sum(y), 6) AS y FROM b WHERE k = 10""")
def nbody(spark, sf):
    """Ten steps of kick and drift; the third velocity starts at 0 and is ten kicks."""
    i = F.col("id")
    bodies = spark.range(500).select((i % 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (i % 3).cast("double").alias("vx"), (i % 5).cast("double").alias("vy"), F.lit(0.0).alias("vz"), ((i % 7 + 1) * 1e10).alias("mass"))
    moved = numeric.kick_drift(bodies, 10)
    energy = numeric.kinetic_energy(moved).select(F.round(F.col("energy") / 1e10, 6).alias("energy"))
    return energy.crossJoin(moved.agg(F.round(F.sum("x"), 6).alias("x"), F.round(F.sum("y"), 6).alias("y")))


@query("WITH RECURSIVE t(v, d) AS (SELECT 1::BIGINT, 1 UNION ALL SELECT 2 * v + k, d + 1 FROM t, (VALUES (0), (1)) c(k) WHERE d < 10) SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS largest, max(d) AS height FROM t")
def tree_stats(spark, sf):
    return numeric.tree_stats(spark, 10)


@query("WITH RECURSIVE t(p, seen, cost, k) AS (SELECT 0, 1, 0, 1 UNION ALL SELECT c, seen | (1 << c), cost + abs(p - c) * 10 + (p + c) % 5, k + 1 FROM t, (SELECT CAST(i AS INT) AS c FROM range(0, 5) r(i)) WHERE (seen & (1 << c)) = 0 AND k < 5) SELECT CAST(min(cost + p * 10 + p % 5) AS INT) AS cost FROM t WHERE k = 5")
def tour(spark, sf):
    return numeric.tour_cost(spark, 5).select(F.col("cost").cast("int").alias("cost"))


@query("WITH RECURSIVE f(k, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 50) SELECT k, a AS fib FROM f")
def fibonacci(spark, sf):
    return numeric.fibonacci(spark, 50)


@query("WITH RECURSIVE f(k, v) AS (SELECT 0, 1::HUGEINT UNION ALL SELECT k + 1, v * (k + 1) FROM f WHERE k < 33) SELECT k, CAST(v AS VARCHAR) AS fact FROM f")
def factorials(spark, sf):
    return numeric.factorials(spark, 33).select("k", F.col("fact").cast("string").alias("fact"))


_WRAPPED = ", ".join(f"({k}, '{math.factorial(k) % (1 << 128):032X}')" for k in range(151))


@query(f"SELECT CAST(k AS BIGINT) AS k, fact FROM (VALUES {_WRAPPED}) t(k, fact)")
def wrapped_factorials(spark, sf):
    """Python's own integers are what the values are held against."""
    return numeric.wrapped_factorials(spark, 150)


@query("SELECT CAST(10 AS BIGINT) AS tasks, CAST(10 AS BIGINT) AS completed, CAST(0 AS BIGINT) AS failed")
def pool_stats(spark, sf):
    return spark.createDataFrame([combine.task_stats(spark, lambda: spark.range(0, 10, 1, 10).write.format("noop").mode("overwrite").save())], "tasks bigint, completed bigint, failed bigint")


@query("SELECT p_partkey, translate(p_name || 'ÄÉx' || p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM part")
def ascii_lower_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ascii_lower(F.concat("p_name", F.lit("ÄÉx"), "p_brand")).alias("lowered"))


@query("SELECT i, (i::HUGEINT * 2654435761 * 4294967296 + i * 12345) % 18446744073709551616 % 1000003 AS h FROM (SELECT o_orderkey * 7919 + 1 AS i FROM orders)")
def wrapping_hash(spark, sf):
    """A product that wraps at 64 bits, read as unsigned."""
    i = F.col("o_orderkey") * 7919 + 1
    return table(spark, sf, "orders").select(i.alias("i"), unsigned_mod(wrapping_mul(i, 2654435761 * (1 << 32) + 12345), 1_000_003).alias("h"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, count(*) FILTER (WHERE p_size % 2 = 0) AS even, CAST(sum(p_size) // count(*) AS BIGINT) AS average FROM part")
def fork_join_fused(spark, sf):
    return table(spark, sf, "part").agg(F.sum("p_size").alias("total"), F.count_if(F.col("p_size") % 2 == 0).alias("even"), F.expr("sum(p_size) div count(*)").alias("average"))


@query("SELECT p_partkey, gcd(p_partkey, p_size) AS g, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE p_partkey / (p_size % 5) END AS r FROM part")
def scalar_functions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", gcd(F.col("p_partkey"), F.col("p_size").cast("bigint")).alias("g"), ratio(F.col("p_partkey").cast("double"), (F.col("p_size") % 5).cast("double")).alias("r"))


@query("SELECT format('{:,}', n) AS n FROM (SELECT count(*) * 1000 AS n FROM lineitem)")
def thousands_format(spark, sf):
    return table(spark, sf, "lineitem").agg((F.count(F.lit(1)) * 1000).alias("n")).select(thousands(F.col("n")).alias("n"))


# Sketches and caches.
def _slots_sql(cms: sketch.CountMin, key: str, source: str) -> str:
    """Counters row, slot, count of a universal sketch."""
    rows = " UNION ALL ".join(f"SELECT {r} AS row, ({a} * {key} + {b}) % {sketch.PRIME} % {cms.width} AS slot FROM {source}" for r in range(cms.depth) for a, b in [cms.factors(r)])
    return f"SELECT row, slot, {'count(*)' if cms.cap is None else f'least(count(*), {cms.cap})'} AS count FROM ({rows}) GROUP BY row, slot"


def _estimates_sql(cms: sketch.CountMin, key: str, source: str, counters: str) -> str:
    """Each key's estimate by a universal sketch."""
    rows = " UNION ALL ".join(f"SELECT DISTINCT {key} AS k, {r} AS row, ({a} * {key} + {b}) % {sketch.PRIME} % {cms.width} AS slot FROM {source}" for r in range(cms.depth) for a, b in [cms.factors(r)])
    return f"SELECT k, min(coalesce(count, 0)) AS estimate FROM ({rows}) LEFT JOIN ({counters}) USING (row, slot) GROUP BY k"


_WIDE = sketch.CountMin(width=512, depth=4, cap=None, universal=True)
_SMALL = sketch.CountMin(width=256, depth=3, cap=15, universal=True)
_SIZED = sketch.CountMin.sized(1000, universal=True)
_SPARSE = sketch.CountMin(width=1 << 16, depth=4, cap=None, universal=True)


@query(f"SELECT k AS user_id, estimate, n, estimate < n AS under FROM ({_estimates_sql(_WIDE, 'user_id', 'events', _slots_sql(_WIDE, 'user_id', 'events'))}) JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) USING (k)")
def cms_overcount_bound(spark, sf):
    """Estimates beside true counts; none is below."""
    e = table(spark, sf, "events").select("user_id")
    est = _WIDE.estimate(_WIDE.build(e, "user_id"), e, "user_id")
    true = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return true.join(est, "user_id").select("user_id", "estimate", "n", (F.col("estimate") < F.col("n")).alias("under"))


@query(f"SELECT row, slot, count, count // 2 AS aged FROM ({_slots_sql(_SMALL, 'user_id', 'events')})")
def cms_merge_age(spark, sf):
    """Two halves merged are the whole, capped; aged, each counter is halved."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    merged = _SMALL.merge(*(_SMALL.build(e.where(f"event_id % 2 = {k}"), "user_id") for k in (0, 1)))
    aged = _SMALL.age(merged).withColumnRenamed("count", "aged")
    return merged.join(aged, ["row", "slot"], "left").withColumn("aged", F.coalesce("aged", F.lit(0).cast("bigint")))


@query(f"SELECT k AS user_id, estimate FROM ({_estimates_sql(_SIZED, 'user_id', 'events', _slots_sql(_SIZED, 'user_id', 'events'))})")
def cms_estimates(spark, sf):
    e = table(spark, sf, "events").select("user_id")
    return _SIZED.estimate(_SIZED.build(e, "user_id"), e, "user_id")


@query(f"""WITH e AS ({_estimates_sql(_SPARSE, 'user_id', 'events', _slots_sql(_SPARSE, 'user_id', 'events'))}), p AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events)
SELECT a, b, x.estimate > y.estimate AS wins FROM p JOIN e x ON a = x.k JOIN e y ON b = y.k""")
def cms_compare(spark, sf):
    e = table(spark, sf, "events").select("user_id")
    pairs = e.distinct().select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).join(e.select(F.col("user_id").alias("b")).distinct(), "b", "left_semi")
    return sketch.more_frequent(_SPARSE, _SPARSE.build(e, "user_id"), pairs, "a", "b").select("a", "b", "wins")


def _keyed_events(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 8).alias("sketch_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 97).alias("key"))


@query()
def sketch_replay_packed(spark, sf):
    """Depends on the order of events; held against plain counting in the tests."""
    return sketch.replay_sketch(_keyed_events(spark, sf), lambda: sketch.Packed(16))


@query()
def sketch_replay_windowed(spark, sf):
    return sketch.replay_sketch(_keyed_events(spark, sf), lambda: sketch.Windowed(32))


def _trace(spark, sf):
    i = F.col("event_id")
    key = F.col("user_id") % 97
    return table(spark, sf, "events").select((F.col("user_id") % 8).alias("cache_id"), i.alias("seq"), F.when(i % 3 == 0, "set").otherwise("get").alias("op"), key.alias("key"), i.alias("value"), (1 + key % 5).cast("int").alias("weight"))


def _replay(policy):
    def run(spark, sf):
        return cache_sim.replay(_trace(spark, sf), 40, policy)

    run.__name__ = f"cache_replay_{policy}"
    return query()(run)


for _policy in cache_sim.POLICIES:
    _replay(_policy)


@query()
def cache_replay_batches(spark, sf):
    """A trace of batches: each operation holds three keys."""
    t, k = _trace(spark, sf), F.col("key")
    every = t.select("cache_id", "seq", "op", F.array(k, (k + 1) % 97, (k + 2) % 97).alias("keys"), F.array("value", "value", "value").alias("values"), F.array("weight", "weight", "weight").alias("weights"))
    return cache_sim.replay(cache_sim.explode_batches(every), 40)


@query()
def cache_replay_stream(spark, sf):
    """The trace as a stream; each cache's last statistics are those of the whole."""
    import uuid

    path, name = scratch_path(spark, "trace"), f"caches_{uuid.uuid4().hex}"
    t = _trace(spark, sf)
    t.write.parquet(path)
    stream = cache_sim.replay_stream(spark.readStream.schema(t.schema).parquet(path), 40)
    stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# Streams, windows and spans.
@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return ev.window_counts(table(spark, sf, "events"), "ts", "event_type")


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows_stream(spark, sf):
    """The same counts from a stream over all that is available."""
    import uuid

    name = f"counts_{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("ts", "event_type")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_dir(spark, e))
    ev.stream_window_counts(stream, "ts", "event_type", name, checkpoint=scratch_path(spark, "stream")).awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def _stream_dir(spark, df):
    path = scratch_path(spark, "events")
    df.write.parquet(path)
    return path


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') % 256 AS view, bool_or(event_type = 'purchase') AS purchase FROM events")
def event_counters(spark, sf):
    """All kinds in one pass: counts, a counter of 8 bits that wraps, and a flag."""
    return ev.counters(table(spark, sf, "events"), "event_type", flags=("purchase",), small=("view",)).select("click", "view", "purchase")


@query("SELECT CAST(2 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS click, bool_or(event_type = 'purchase') AS purchase FROM events")
def event_reset(spark, sf):
    """A reset opens a generation: counters start at zero, flags of overflow stay."""
    stats = ev.counters(table(spark, sf, "events"), "event_type", flags=("purchase",), kinds=("click", "purchase")).select(F.lit(1).cast("bigint").alias("generation"), "click", "purchase")
    return ev.reset_stats(stats, ("purchase",))


@query("SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT) AS generation, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def event_generations(spark, sf):
    return ev.generations(table(spark, sf, "events"), "ts", F.lit("2024-01-01").cast("timestamp"), 86_400).groupBy("generation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-03'")
def event_monitored(spark, sf):
    return ev.monitored(table(spark, sf, "events"), "ts", F.lit("2024-01-01").cast("timestamp"), 2 * 86_400).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN w = 0 THEN 0.0::DOUBLE ELSE r / w END AS read_write, CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * f / a END AS full_percent FROM (SELECT count(*) FILTER (WHERE event_type = 'view') AS r, count(*) FILTER (WHERE event_type = 'click') AS w, count(*) FILTER (WHERE value > 90) AS f, count(*) AS a FROM events)")
def event_ratios(spark, sf):
    c = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "view").alias("r"), F.count_if(F.col("event_type") == "click").alias("w"), F.count_if(F.col("value") > 90).alias("f"), F.count(F.lit(1)).alias("a"))
    return c.select(*ev.derived(F.col("r"), F.col("w"), F.col("f"), F.col("a")))


@query(f"""WITH s AS (SELECT *, end_ns - start_ns AS dur FROM {_SPANS_SQL}), k AS (SELECT parent_id AS id, sum(dur) AS inner_ns FROM s WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT name, count(*) AS hits, CAST(sum(dur) AS BIGINT) AS total_ns, CAST(sum(dur - coalesce(inner_ns, 0)) AS BIGINT) AS self_ns, min(dur) AS min_ns, max(dur) AS max_ns, sum(dur) / count(*) AS avg_ns, max(dur) > 2 * min(dur) AS wide FROM s LEFT JOIN k ON span_id = id GROUP BY name""")
def span_stats(spark, sf):
    return ev.span_stats(_spans(spark, sf))


@query(f"SELECT * FROM (SELECT name, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns, 100.0::DOUBLE * sum(end_ns - start_ns) / (SELECT sum(end_ns - start_ns) FROM {_SPANS_SQL} WHERE parent_id IS NULL) AS percent FROM {_SPANS_SQL} GROUP BY name ORDER BY total_ns DESC, name LIMIT 3)")
def hot_paths(spark, sf):
    spans = _spans(spark, sf)
    return ev.hot_paths(ev.span_stats(spans), spans, 3)


# Graph.
@query("""WITH RECURSIVE v AS (SELECT o_orderkey AS id, o_orderkey % 4 AS strong, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_orderkey % 4 END AS weak FROM orders),
e AS (SELECT o_orderkey AS src, o_orderkey * 7 % (SELECT count(*) FROM orders) AS dst FROM orders),
r AS (SELECT id FROM v WHERE (strong > 0 OR weak > 0) AND strong > weak UNION SELECT dst FROM r JOIN e ON r.id = e.src)
SELECT id FROM v WHERE strong > 0 AND id NOT IN (SELECT id FROM r)""")
def leaked_vertices(spark, sf):
    i, o = F.col("o_orderkey"), table(spark, sf, "orders").select("o_orderkey")
    n = o.count()
    v = o.select(i.alias("id"), (i % 4).alias("strong"), F.when(i % 50 == 0, 0).otherwise(i % 4).alias("weak"))
    return graph.leaked(v, o.select(i.alias("src"), (i * 7 % n).alias("dst")))
