"""Text and measurement-file workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.functions.scalar import count_char, count_class, nth_field, parse_double, ratio, tokens


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """Words with their number; counted by each task before they are shuffled."""
    return docs.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(k)


def byte_stats(lines: DataFrame, line: str) -> DataFrame:
    """Lines, commas, digits and mean fields a line, in one pass."""
    t = F.col(line)
    sums = lines.agg(F.count(t).alias("lines"), F.coalesce(F.sum(count_char(t, ",")), F.lit(0)).alias("commas"), F.coalesce(F.sum(count_class(t, "[0-9]")), F.lit(0)).alias("digits"))
    return sums.withColumn("fields", F.expr("coalesce(commas div nullif(lines, 0), 0) + 1"))


def active_share(rows: DataFrame, flag: str = "is_active") -> DataFrame:
    return rows.agg(F.count_if(F.col(flag) == 1).alias("active"), ratio(F.count_if(F.col(flag) == 1), F.count(F.lit(1)), 100.0).alias("percent"))


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def threshold_counts(lines: DataFrame, line: str, column: int = 1, high: float = 900, low: float = 100) -> DataFrame:
    """Lines whose field is above or below a bound; fields that are no numbers are neither."""
    v = parse_double(nth_field(F.col(line), column))
    return lines.agg(F.count_if(v > high).alias("above"), F.count_if(v < low).alias("below"))


def containing(lines: DataFrame, line: str, what: str) -> DataFrame:
    hit = F.col(line).contains(what)
    return lines.agg(F.count_if(hit).alias("hits"), ratio(F.count_if(hit), F.count(F.lit(1)), 100.0).alias("percent"))
