"""Log analytics over generated entries: every field is arithmetic on a seed that wraps at 64 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.functions.scalar import unsigned_mod, wrapping_mul

#: Fixed values of the generator and the queries.
MULTIPLIER = 2654435761
START_MS = 1700000000000
SLOW_US = 1_000_000


def generate(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """n entries by position from ``start`` on; the seed wraps at 64 bits and is read as unsigned."""
    fast, wraps = F.col("id") * F.lit(MULTIPLIER), (2**63 - 1) // MULTIPLIER
    seed = fast if start + n <= wraps else F.when(F.col("id") <= wraps, fast).otherwise(wrapping_mul(F.col("id"), MULTIPLIER))
    rest = (lambda m: F.col("seed") % m) if start + n <= wraps else (lambda m: unsigned_mod(F.col("seed"), m))
    s = spark.range(start, start + n).select(F.col("id").alias("pos"), seed.alias("seed"))
    band = F.shiftrightunsigned("seed", 24) % 100
    level = F.when(band < 50, 1).when(band < 75, 0).when(band < 90, 2).when(band < 98, 3).otherwise(4)
    return s.select(
        "pos", (F.lit(START_MS) + F.col("pos")).alias("timestamp"), level.alias("level"), rest(64).cast("int").alias("thread_id"), F.col("seed").bitwiseAND(F.lit(0xFFFFFFFF)).alias("message_hash"),
        (rest(2_000_000) + 1000).alias("response_time_us"), (rest(1000) < 5).alias("is_security_event"), rest(100_000).alias("user_id"),
    )


def critical() -> Column:
    return F.col("level") == 4


def error() -> Column:
    return F.col("level") >= 3


def slow(limit_us: int = SLOW_US) -> Column:
    return F.col("response_time_us") > limit_us


def counts(logs: DataFrame, limit_us: int = 500_000, least: int = 2) -> DataFrame:
    """All predicate counts in one pass."""
    return logs.agg(
        F.count_if(error()).alias("errors"), F.count_if(critical()).alias("critical"), F.count_if("is_security_event").alias("security"), F.count_if(slow()).alias("slow"),
        F.count_if(slow(limit_us)).alias("over_limit"), F.count_if(F.col("level") >= least).alias("severe"),
    )


def checks(logs: DataFrame) -> DataFrame:
    some, every = lambda p: F.coalesce(F.bool_or(p), F.lit(False)), lambda p: F.coalesce(F.bool_and(p), F.lit(True))
    return logs.agg(some(critical()).alias("any_critical"), some(F.col("is_security_event")).alias("any_security"), every(F.col("timestamp") > 0).alias("all_dated"), every(F.col("thread_id") < 64).alias("all_threads"))


def firsts(logs: DataFrame, user: int = 12345) -> DataFrame:
    """Positions of the first critical entry, the first security event, and the user's first entry; null where none is."""
    at = lambda p: F.min(F.when(p, F.col("pos")))
    return logs.agg(at(critical()).alias("critical"), at(F.col("is_security_event")).alias("security"), at(F.col("user_id") == user).alias("user"))


def response_times(logs: DataFrame) -> DataFrame:
    """Smallest, largest and floor mean."""
    r = F.col("response_time_us")
    return logs.agg(F.min(r).alias("min"), F.max(r).alias("max"), F.expr("sum(response_time_us) div count(*)").alias("avg"))


def flagged(logs: DataFrame, first: int = 1_000_000) -> DataFrame:
    """How many of the first entries have the top bit of the hash set after it was set."""
    top = F.lit(0x80000000)
    return logs.where(F.col("pos") < first).select(F.col("message_hash").bitwiseOR(top).alias("h")).agg(F.count_if(F.col("h").bitwiseAND(top) != 0).alias("flagged"))


def sequenced(logs: DataFrame, base: int) -> DataFrame:
    return logs.withColumn("timestamp", F.lit(base) + F.col("pos"))


def boosted(logs: DataFrame, boost: int) -> DataFrame:
    return logs.select("pos", (F.col("response_time_us") + boost * (F.col("level") + 1)).alias("score"))


def fast_but_severe(logs: DataFrame, least: int = 2, limit_us: int = 500_000) -> DataFrame:
    return logs.where((F.col("level") >= least) & (F.col("response_time_us") < limit_us))


def numbered(logs: DataFrame, base: int = 1000) -> DataFrame:
    return logs.select("pos", (F.lit(base) + F.col("pos") + F.col("response_time_us")).alias("id"))


def chunk_sum(logs: DataFrame, size: int, factor: int) -> DataFrame:
    """Sum over chunks of factor times the response time, plus each chunk's number."""
    per = logs.groupBy(F.floor(F.col("pos") / size).alias("chunk")).agg(F.sum(factor * F.col("response_time_us")).alias("s"))
    return per.agg(F.sum(F.col("s") + F.col("chunk")).alias("total"))
