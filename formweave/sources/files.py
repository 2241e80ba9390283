"""Image files, and recognised texts that are kept so that unchanged files are not read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings of images.
ENDINGS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff"]
DETAIL = "text string, token_boxes array<struct<x0:double,y0:double,x1:double,y1:double>>"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of images at any depth, whatever the case of their endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower(F.regexp_extract("path", "[.]([^.]*)$", 1)).isin(ENDINGS))


def file_key(path: Column, length: Column, modified: Column) -> Column:
    """A name for one state of a file."""
    return F.md5(F.concat_ws("/", path, length.cast("string"), modified.cast("long").cast("string")).cast("binary"))


def not_yet_done(files: DataFrame, done: DataFrame, path: str = "path", length: str = "length", modified: str = "modificationTime") -> DataFrame:
    """Files with their key of which `done` (key) has no result."""
    return files.withColumn("key", file_key(F.col(path), F.col(length), F.col(modified))).join(done.select("key"), "key", "left_anti")


def recognise(files: DataFrame, make: Callable[[], Callable[[bytes], tuple[str, list[tuple[float, float, float, float]]]]]) -> DataFrame:
    """key, path, text and token_boxes of each file by a recogniser: `make` builds one in each task, which then reads
    image after image. Blank results stay, so that an image is known to be empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        kind = pa.list_(pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")]))
        for batch in batches:
            found = [read(x) for x in batch["content"].to_pylist()]
            boxes = [[dict(zip(("x0", "y0", "x1", "y1"), b)) for b in bs] for _, bs in found]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["path"], pa.array([t for t, _ in found], pa.string()), pa.array(boxes, kind)], names=["key", "path", "text", "token_boxes"])

    return files.select("key", "path", "content").mapInArrow(run, f"key string, path string, {DETAIL}")
