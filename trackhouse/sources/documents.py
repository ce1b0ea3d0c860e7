"""Small JSON documents in and out, and images as pixel counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_document(rows: DataFrame, path: str, *, key: str | None = None) -> None:
    """Reports of one row per entry as JSON; a one-column ``value`` frame is written as text."""
    if rows.columns == ["value"]:
        rows.write.mode("overwrite").text(path)
    else:
        (rows.orderBy(key) if key else rows).write.mode("overwrite").json(path)


def read_document(
    spark: SparkSession, path: str, schema: str | None = None, *, whole_file: bool = False
) -> DataFrame:
    """JSON lines, or with ``whole_file`` documents that span lines."""
    reader = spark.read.option("multiLine", str(whole_file).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: ``path, width, height, channels, data`` (row-major, colour as BGR)."""
    return (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("image.origin").alias("path"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            F.col("image.nChannels").alias("channels"),
            F.col("image.data").alias("data"),
        )
    )


def pixel_counts(masks: DataFrame) -> DataFrame:
    """``path, level3_id, n`` for every value that occurs in a grey mask.

    Each image is folded to at most 256 counts where it is read; pixels are never shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch["path"].to_pylist(), batch["data"]):
                bins = np.bincount(np.frombuffer(blob.as_buffer(), dtype=np.uint8), minlength=256)
                ids = np.nonzero(bins)[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(ids), pa.string()),
                        pa.array(ids.astype(np.int32)),
                        pa.array(bins[ids].astype(np.int64)),
                    ],
                    names=["path", "level3_id", "n"],
                )

    return masks.select("path", "data").mapInArrow(count, "path string, level3_id int, n bigint")
