"""Shared pieces of the corpus operators: names, keys and words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.plans.scratch import delete_path, discard, materialise, scratch_path, scratch_root

__all__ = ["delete_path", "discard", "fold_of", "fresh", "lower_words", "materialise", "named", "row_key", "scratch_path", "scratch_root", "table"]


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names like those given that clash with no column in ``taken``, whatever its case."""
    seen = {x.lower() for x in taken}
    out = []
    for n in names:
        while n.lower() in seen:
            n += "_"
        seen.add(n.lower())
        out.append(n)
    return out


def named(column: str, table: str = "") -> Column:
    """The column of exactly that name, which may hold dots."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{table}.{quoted}" if table else quoted)


def row_key(id_col: str, text_col: str) -> Column:
    """With the id, tells rows apart: rows of equal id and text count as one document."""
    return F.xxhash64(named(id_col), named(text_col))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text modulo folds; a null id gives null."""
    return F.pmod(F.crc32(named(id_col).cast("string").cast("binary")), F.lit(folds))


def lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased: what bytes.split() cuts at is exactly that class."""
    return text.lower().split()
