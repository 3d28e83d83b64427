"""Chunk-wise processing. A chunk is a run of positions, whatever Spark's partitions are."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


def apply_chunks(df: DataFrame, pos: str, f: Callable[..., Any], schema: str) -> DataFrame:
    """Calls f(chunk_id, pandas frame in order) for each chunk; chunk sizes bound what a task holds."""

    def run(key: tuple, rows: Any) -> Any:
        return f(int(key[0]), rows.sort_values(pos).reset_index(drop=True))

    return df.groupBy("chunk_id").applyInPandas(run, schema)


def apply_empty(df: DataFrame, f: Callable[..., Any], schema: str) -> DataFrame:
    """What f makes of chunk 0 without rows; it runs on the driver."""
    import pandas as pd

    return df.sparkSession.createDataFrame(f(0, pd.DataFrame(columns=[*df.columns, "chunk_id"])), schema)
