from datetime import datetime

from pyspark.sql import functions as F

from ordina.streaming import events as ev

EVENTS = [(datetime(2024, 1, 1, 0, 0, s), k) for s, k in ((0, "read"), (5, "write"), (12, "read"), (25, "full"), (26, "read"))]


def frame(spark):
    return spark.createDataFrame(EVENTS, "ts timestamp, kind string")


def test_windows_batch_equals_stream(spark, tmp_path):
    df = frame(spark)
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r.start, r.kind): r.n for r in ev.window_counts(df, "ts", "kind", "10 seconds").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ev.stream_window_counts(stream, "ts", "kind", "t_counts", "10 seconds", checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert {(r.start, r.kind): r.n for r in spark.table("t_counts").collect()} == batch and sum(batch.values()) == 5


def test_counters_and_flags(spark):
    got = ev.counters(frame(spark), "kind", flags=("full",)).first()
    assert (got["full"], got["read"], got["write"]) == (True, 3, 1)


def test_generations_and_expiry(spark):
    start = F.lit("2024-01-01 00:00:05").cast("timestamp")
    assert sorted(r.generation for r in ev.generations(frame(spark), "ts", start, 10).collect()) == [0, 0, 2, 2]
    assert ev.monitored(frame(spark), "ts", start, 7).count() == 2
    left = spark.range(1).select(ev.window_remaining(F.lit("2024-01-01 00:00:08").cast("timestamp"), start, 7).alias("l"))
    assert left.first().l == 4_000_000


def test_ratios_guard_zero(spark):
    got = spark.createDataFrame([(4, 2, 1, 10), (4, 0, 1, 0)], "r int, w int, f int, a int").select(*ev.derived(F.col("r"), F.col("w"), F.col("f"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(2.0, 10.0), (0.0, 0.0)]


def test_spans(spark):
    spans = spark.createDataFrame([(1, None, "root", 0, 100), (2, 1, "a", 10, 40), (3, 1, "a", 50, 60), (4, 2, "b", 15, 20)], "span_id int, parent_id int, name string, start_ns bigint, end_ns bigint")
    stats = {r.name: r for r in ev.span_stats(spans).collect()}
    assert (stats["root"].self_ns, stats["a"].total_ns, stats["a"].self_ns, stats["a"].wide) == (60, 40, 35, True)
    top = ev.hot_paths(ev.span_stats(spans), spans, 2).orderBy(F.desc("total_ns")).collect()
    assert [(r.name, r.percent) for r in top] == [("root", 100.0), ("a", 40.0)]
