"""File sources and sinks: CSV by schema, PPM images, span traces, report files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the measurement files.
CSV_SCHEMA = "id BIGINT, measurement DOUBLE, category STRING, description STRING, is_active INT"
CATEGORIES = ("north", "south", "east", "west", "up", "down", "left", "right")
DESCRIPTIONS = ("lorem ipsum", "dolor sit", "amet elit", "sed do", "eiusmod", "tempor", "ut labore", "magna")


def read_csv(spark: SparkSession, path: str, schema: str = CSV_SCHEMA) -> DataFrame:
    """Splittable; the header is skipped and blank lines are dropped. Fields that don't parse are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line").where("line <> ''")


def generate_csv_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows of the measurement schema, the same for the same seed: fields are hashes of the row number."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(10_000_000))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (h(k) % len(names) + 1).cast("int"))
    return spark.range(n).select("id", (h(1) / 10_000).cast("double").alias("measurement"), pick(CATEGORIES, 2).alias("category"), pick(DESCRIPTIONS, 3).alias("description"), (h(4) % 2).cast("int").alias("is_active"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


_HEADER = re.compile(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")
MOST_BYTES = 100 * 1024 * 1024


def parse_ppm(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and the pixels as rows of r, g, b. Comments are skipped; another maximum than 255, or short data, is an error."""
    if len(data) > MOST_BYTES:
        raise ValueError("image is larger than 100 MB")
    if not (m := _HEADER.match(data)):
        raise ValueError("not a binary PPM")
    width, height, top = (int(x) for x in m.groups())
    if top != 255:
        raise ValueError(f"maximum {top}; 255 expected")
    body = data[m.end() : m.end() + 3 * width * height]
    if len(body) < 3 * width * height:
        raise ValueError("pixel data is short")
    return width, height, np.frombuffer(body, np.uint8).reshape(-1, 3)


def format_ppm(width: int, height: int, rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (width, height) + rgb.astype(np.uint8).tobytes()


_PIXELS = "path string, x int, y int, r int, g int, b int"


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """A row for each pixel of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                width, height, rgb = parse_ppm(content.as_py())
                for top in range(0, height, max(1, 1_000_000 // max(1, width))):
                    part = rgb[top * width : (top + max(1, 1_000_000 // max(1, width))) * width]
                    at = np.arange(top * width, top * width + len(part))
                    yield pa.record_batch([pa.array([name.as_py()] * len(part)), *(pa.array(a.astype(np.int32)) for a in (at % width, at // width, part[:, 0], part[:, 1], part[:, 2]))], names=["path", "x", "y", "r", "g", "b"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _PIXELS)


def write_ppm(pixels: DataFrame, width: int, height: int, path: str) -> None:
    """Writes one image (x, y, r, g, b) as an ASCII-free P6 file through Spark's text sink, so any shared file system will do.

    One image is at most 100 MB, so it fits a task.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        data = rows.sort_by([("y", "ascending"), ("x", "ascending")])
        rgb = np.stack([data.column(c).to_numpy() for c in ("r", "g", "b")], 1)
        return pa.table({"value": pa.array([format_ppm(width, height, rgb)], pa.binary())})

    image = pixels.select(F.lit(1).alias("k"), "x", "y", "r", "g", "b").groupBy("k").applyInArrow(run, "value binary")
    image.select(F.col("value").cast("string")).write.text(path)  # a line end after the last pixel is ignored by readers


def trace_events(spans: DataFrame) -> DataFrame:
    """Spans (name, thread, start_ns, end_ns) as trace events, a JSON text each."""
    event = F.struct(F.col("name").alias("name"), F.lit("X").alias("ph"), (F.col("start_ns") / 1000.0).alias("ts"), ((F.col("end_ns") - F.col("start_ns")) / 1000.0).alias("dur"), F.lit(1).alias("pid"), F.col("thread").alias("tid"))
    return spans.select(F.to_json(event).alias("value"))


def write_text(lines: DataFrame, path: str, append: bool = False) -> None:
    lines.write.mode("append" if append else "overwrite").text(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table."""
    cells: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
