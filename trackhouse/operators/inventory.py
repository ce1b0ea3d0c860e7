"""Counting and grouping what a file tree holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.operators.pairing import first_of
from trackhouse.operators.ranking import global_rank
from trackhouse.operators.timeline import number_rows, timeline

#: Example names of a directory; its counts are always whole.
EXAMPLE_NAMES = 3


def suffix_histogram(files: DataFrame, suffix: str = "suffix", size: str = "length") -> DataFrame:
    shown = F.when(F.col(suffix) == "", "<none>").otherwise(F.col(suffix))
    return files.groupBy(shown.alias("suffix")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    )


def directory_summary(files: DataFrame, examples: int = EXAMPLE_NAMES) -> DataFrame:
    """Per directory and kind: files, bytes and up to ``examples`` names."""
    order = Window.partitionBy("dir", "kind").orderBy("name")
    named = (
        files.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= examples)
        .groupBy("dir", "kind")
        .agg(F.sort_array(F.collect_list("name")).alias("examples"))
    )
    counts = files.groupBy("dir", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    return counts.join(named, ["dir", "kind"])


def top_levels(paths: DataFrame, first: str, second: str) -> DataFrame:
    """Every name of the second directory level below each first-level name, a row each; ``names``
    is how many there are."""
    pairs = paths.select(first, second).where(F.col(second).isNotNull()).distinct()
    counts = pairs.groupBy(first).agg(F.count(F.lit(1)).alias("names"))
    return pairs.join(counts, first)


def split_counts(files: DataFrame, split: str, sequence: str) -> DataFrame:
    """Files per (split, sequence) with subtotals and the total."""
    return files.rollup(split, sequence).agg(
        F.count(F.lit(1)).alias("files"), F.grouping_id().cast("bigint").alias("level")
    )


def members_by_route(df: DataFrame, route: str, order: str) -> DataFrame:
    """Members of each route numbered in order; ``is_first`` marks the one whose facts count.

    Kept as rows: a route's list may be as long as the data.
    """
    if isinstance(df.schema[order].dataType, T.NumericType):
        numbered = number_rows(df, timeline(df, [route], order), "position")
    else:
        # Names have no width to cut by: rank the table as a whole, then count from each route's start.
        ranked = global_rank(df, [route, order], "_at")
        starts = ranked.groupBy(route).agg(F.min("_at").alias("_start"))
        numbered = ranked.join(starts, ranked[route].eqNullSafe(starts[route])).drop(starts[route])
        numbered = numbered.withColumn("position", F.col("_at") - F.col("_start") + 1)
    return numbered.withColumn("is_first", F.col("position") == 1).select(
        *df.columns, "position", "is_first"
    )


def left_camera(dirs: DataFrame, route: str = "route") -> DataFrame:
    """The camera directory to label per route: the first left one, else the only one.

    ``state`` is ``left``, ``only`` (worth a warning) or ``ambiguous`` (no directory chosen).
    """
    chosen = first_of(
        dirs, [route], F.struct(~F.col("side").eqNullSafe(F.lit("left")), F.col("path"))
    )
    counts = dirs.groupBy(route).agg(
        F.count(F.lit(1)).alias("dirs"), F.count(F.when(F.col("side") == "left", 1)).alias("lefts")
    )
    state = (
        F.when(F.col("lefts") > 0, "left").when(F.col("dirs") == 1, "only").otherwise("ambiguous")
    )
    return (
        counts.join(chosen, route)
        .withColumn("state", state)
        .withColumn("path", F.when(F.col("state") != "ambiguous", F.col("path")))
        .drop("lefts")
    )
