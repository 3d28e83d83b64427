"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local folder in local mode and one below the warehouse elsewhere."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        named = "file://" + tempfile.mkdtemp(prefix="ordina-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/ordina-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends there, and the rows stay the same however often they are read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ordina_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_ordina_path", None):
            delete_path(t.sparkSession, path)
            _written[:] = [(s, p) for s, p in _written if p != path]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was written meanwhile, but for tables given to the function it yields: for results that were read or written."""
    before, kept = {path for _, path in _written}, set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(getattr(table, "_ordina_path", None))
        return table

    try:
        yield keep
    finally:
        for own, path in [x for x in _written if x[0] is spark and x[1] not in before and x[1] not in kept]:
            delete_path(own, path)
            _written.remove((own, path))


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the JVM may be gone; the cluster's own clean-up then has the folder
            return
