"""Event counters over windows, as batch queries and as Structured Streaming queries, and profiler spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ordina.functions.scalar import ratio


def as_timestamp(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with zone; plain ones are read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def window_counts(events: DataFrame, ts: str, kind: str, length: str = "1 day") -> DataFrame:
    """Events of each kind in each tumbling window. Works on batches and streams; partial counts come before the shuffle."""
    at = F.window(F.col(ts), length)
    return events.groupBy(at.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


#: Kinds that are looked for if none are named; more are a mistake, as each makes a column.
KINDS = 256


def counters(events: DataFrame, kind: str, flags: tuple[str, ...] = (), by: tuple[str, ...] = (), small: tuple[str, ...] = (), kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A column of counts for each kind, but whether it occurred for flags, and counts modulo 256 for small ones; one pass for all.

    Kinds that aren't named are looked up first; over KINDS of them raise.
    """
    if kinds is None:
        found = [r[0] for r in events.select(kind).where(F.col(kind).isNotNull()).distinct().limit(KINDS + 1).collect()]
        if len(found) > KINDS:
            raise ValueError("too many kinds for a column each: name those wanted")
        kinds = tuple(sorted(found))

    def counter(k: str) -> Column:
        if k in flags:
            return F.coalesce(F.bool_or(F.col(kind) == k), F.lit(False)).alias(k)
        n = F.count_if(F.col(kind) == k)
        return (n % 256 if k in small else n).alias(k)

    return events.groupBy(*by).agg(*map(counter, kinds))


def reset_stats(stats: DataFrame, keep: tuple[str, ...], generation: str = "generation") -> DataFrame:
    """A new generation with all counters at zero; the flags in ``keep`` stay as they are."""
    zero = {c: F.lit(0).cast(t) if t != "boolean" else F.lit(False) for c, t in stats.dtypes if c not in keep and c != generation}
    return stats.select(*((F.col(c) + 1).alias(c) if c == generation else zero[c].alias(c) if c in zero else F.col(c) for c in stats.columns))


def generations(events: DataFrame, ts: str, start: Column, length_s: int) -> DataFrame:
    """Numbers fixed windows from a start; what comes before it has none."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return events.withColumn("generation", F.floor(seconds / F.lit(length_s * 1_000_000)).cast("bigint")).where("generation >= 0")


def monitored(events: DataFrame, ts: str, start: Column, length_s: int) -> DataFrame:
    """Only events of the window that the start opens: collection switches itself off when it expires."""
    passed = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return events.where((passed >= 0) & (passed <= length_s * 1_000_000))


def window_remaining(now: Column, start: Column, length_s: int) -> Column:
    left = F.lit(length_s * 1_000_000) - (F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp")))
    return F.greatest(F.lit(0), left)


def derived(reads: Column, writes: Column, full: Column, attempts: Column) -> list[Column]:
    """Reads a write and the share of attempts that met a full queue in percent, 0 without any."""
    return [ratio(reads, writes).alias("read_write"), ratio(full, attempts, 100.0).alias("full_percent")]


def queue_capacity(primary: Column) -> Column:
    """A queue with overflow levels of twice and four times its size."""
    return primary * 7


def stream_window_counts(stream: DataFrame, ts: str, kind: str, name: str, length: str = "1 day", late: str = "1 day", mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Counts of a stream into an in-memory table, over all that is available now. Events later than ``late`` are dropped in append mode."""
    counted = window_counts(as_timestamp(stream, ts).withWatermark(ts, late), ts, kind, length)
    writer = counted.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def span_stats(spans: DataFrame) -> DataFrame:
    """By name: hits, total, own, smallest and largest time. spans: span_id, parent_id, name, start_ns, end_ns.

    A span's own time is without its children's.
    """
    timed = spans.withColumn("dur", F.col("end_ns") - F.col("start_ns"))
    children = timed.where("parent_id is not null").groupBy(F.col("parent_id").alias("span_id")).agg(F.sum("dur").alias("inner_ns"))
    own = timed.join(children, "span_id", "left").withColumn("own", F.col("dur") - F.coalesce("inner_ns", F.lit(0)))
    stats = own.groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.sum("dur").alias("total_ns"), F.sum("own").alias("self_ns"), F.min("dur").alias("min_ns"), F.max("dur").alias("max_ns"))
    return stats.withColumn("avg_ns", F.col("total_ns") / F.col("hits")).withColumn("wide", F.col("max_ns") > 2 * F.col("min_ns"))


def hot_paths(stats: DataFrame, spans: DataFrame, k: int = 5) -> DataFrame:
    """The k names of the most time, with their percentage of the root spans' time."""
    roots = spans.where("parent_id is null").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("root_ns"))
    top = stats.orderBy(F.desc("total_ns"), "name").limit(k)
    return top.crossJoin(F.broadcast(roots)).select("name", "total_ns", ratio(F.col("total_ns"), F.col("root_ns"), 100.0).alias("percent"))
