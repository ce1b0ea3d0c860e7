"""File trees and run folders as tables. Only names and sizes are read, never contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.functions.text import file_kind, file_suffix
from trackhouse.sources.storage import qualified
from trackhouse.sources.tree import walk

#: Runs that an error names.
LISTED = 20


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, rel, dir, name, suffix, kind, length, modified`` of every file below ``root``, empty ones
    and names that start with ``_`` or ``.`` among them. Files are listed by tasks and never opened."""
    base = qualified(spark, root).rstrip("/")
    rel = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    return (
        walk(spark, base)
        .withColumn("rel", rel)
        .withColumn("suffix", file_suffix(F.col("name")))
        .select(
            F.concat(F.lit(f"{base}/"), "rel").alias("path"), "rel", "dir", "name", "suffix",
            file_kind(F.col("suffix")).alias("kind"), "length", "modified",
        )
    )


def annotated_tree(files: DataFrame, top: str, key) -> DataFrame:
    """``split, sequence, frame_key, suffix`` of ``<top>/<split>/<sequence>/<file>``.

    ``key`` turns a file name into its frame key.
    """
    parts = F.split("rel", "/")
    return files.where((F.size(parts) == 4) & (parts[0] == top)).select(
        parts[1].alias("split"),
        parts[2].alias("sequence"),
        key(F.col("name")).alias("frame_key"),
        "suffix",
        "rel",
        "length",
    )


def run_catalogue(files: DataFrame) -> DataFrame:
    """``run, started, kind, tag`` from run folder names ``<stamp>_<kind>_<tag>``."""
    return run_names(files.select(F.split("rel", "/")[0].alias("run")).distinct())


def run_names(names: DataFrame, run: str = "run") -> DataFrame:
    """Decode run names; a missing kind is ``seg`` and a missing tag ``default``."""
    parts = F.split(run, "_", 3)
    return names.select(
        run,
        F.try_to_timestamp(parts[0], F.lit("yyyyMMdd-HHmmss")).cast("timestamp_ntz").alias("started"),
        F.coalesce(F.get(parts, 1), F.lit("seg")).alias("kind"),
        F.coalesce(F.get(parts, 2), F.lit("default")).alias("tag"),
    )


def find_run(runs: DataFrame, reference: str) -> str:
    """The run named ``reference``, or the newest for ``latest``; a miss lists what there is."""
    if reference == "latest":
        newest = runs.agg(F.max("run")).first()[0]
        if newest is None:
            raise FileNotFoundError("no runs")
        return newest
    if not runs.where(F.col("run") == reference).isEmpty():
        return reference
    available = [r.run for r in runs.select("run").orderBy(F.desc("run")).limit(LISTED).collect()]
    raise FileNotFoundError(f"run {reference!r} not found. Available ({runs.count()}, newest first): {available or 'none'}")
