"""A training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
Extra columns pass through whatever their names.  An empty input gives an empty
output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordina.llm import mixing, quality
from ordina.llm.common import discard, fresh, materialise, named, table
from ordina.llm.decontaminate import find_contamination
from ordina.llm.near_dedup import near_duplicates
from ordina.llm.substring_dedup import dedup_substrings
from ordina.plans.scratch import scratch

#: A document with a lower score is rejected.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored at least LEAST_QUALITY; null and empty texts are scored by their statistics like any."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return quality.score_quality(docs, machine, outcome=score).where(F.col(score) >= LEAST_QUALITY).select(*map(named, docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id. Five-word shingles, a similarity of 0.8 or more.

    Rows without id, and of texts without words, are kept all; rows that repeat the
    kept id are one row, that of the smallest text.
    """
    (id_,) = fresh(docs.columns, "_kept")
    groups = near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where("not kept").select(F.col("doc_id").alias(id_)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(id_), "left_anti")
    repeated = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_)
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():
        return left
    rank, hit = fresh([*docs.columns, id_], "_rank", "_hit")
    flagged = left.join(repeated.withColumn(hit, F.lit(1)), F.col("doc_id") == F.col(id_), "left")
    once = flagged.where(F.col(hit) == 1).withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(rank) == 1)
    return flagged.where(F.col(hit).isNull()).select(*map(named, docs.columns)).unionAll(once.select(*map(named, docs.columns)))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages and repeated whole lines out of the texts; n_chars follows. A document all of which is repeated goes."""
    (outcome,) = fresh(docs.columns, "dedup")
    cut = dedup_substrings(docs, outcome=outcome, whole_lines=True)
    emptied = (F.col(outcome)["n_removed"] > 0) & (F.trim("text") == "")
    length = [F.when(F.col(outcome)["n_removed"] > 0, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else named(c) for c in docs.columns]
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*length)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of ten consecutive words of a benchmark item."""
    (outcome,) = fresh(docs.columns, "leak")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), outcome=outcome)
    return found.where(F.col(outcome)["n_hit"] == 0).select(*map(named, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is served, in order of virtual time; the struct ``mix`` tells size, target, epoch and time."""
    (outcome,) = fresh(docs.columns, "mix")
    return mixing.mixed_order(mixing.mix(docs, outcome=outcome), outcome)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("decontaminate", decontaminate_stage), ("mixing", mixing_stage)]

#: The quality stage is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written as Parquet and read again, and what it needed on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            then = keep(materialise(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = then
    return docs
