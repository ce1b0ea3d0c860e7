"""Matching two inventories: pairs, misses and what is still to be done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LISTED = 20
IMAGE_PREFERENCE = (".png", ".jpg", ".jpeg")


def pair(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full pairing on ``keys`` with ``in_left`` and ``in_right`` flags."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, list(keys), "full_outer").select(
        *keys, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_left", "in_right")]
    )


def capped_listing(
    df: DataFrame, keys: Sequence[str], item: str, cap: int = LISTED
) -> DataFrame:
    """Per key the true count and the first ``cap`` items in order.

    The rank filter is applied before the shuffle too, so a huge key sends few rows.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(item) if keys else None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if order is None:
        listed = df.select(item).orderBy(item).limit(cap)
    else:
        listed = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap)
    listed = listed.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    if not keys:
        return counts.join(listed, F.lit(True), "left")
    return counts.join(listed, keys, "left")


def outstanding(wanted: DataFrame, present: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Wanted rows without a non-empty result."""
    return wanted.join(present.where(F.col(size) > 0).select(*keys), list(keys), "left_anti")


def work_plan(wanted: DataFrame, present: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """``total``, ``existing`` and ``pending`` counts of a plan."""
    done = present.where(F.col(size) > 0).select(*keys).distinct().withColumn("_done", F.lit(1))
    return (
        wanted.join(done, list(keys), "left")
        .agg(F.count(F.lit(1)).alias("total"), F.count("_done").alias("existing"))
        .withColumn("pending", F.col("total") - F.col("existing"))
    )


def preferred(
    df: DataFrame, candidates: DataFrame, keys: Sequence[str], option: str, order: Sequence[str]
) -> DataFrame:
    """The candidate whose ``option`` comes first in ``order``; other candidates do not count.

    A minimum over a rank combines before the shuffle, where ranking rows would not.
    """
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(option))
    others = [c for c in candidates.columns if c not in keys]
    best = (
        candidates.where(rank > 0)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*others), rank).alias("_best"))
        .select(*keys, "_best.*")
    )
    return df.join(best, list(keys), "left")


def misses(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys each side lacks, and whether the two are aligned."""
    both = pair(left, right, keys)
    return both.agg(
        F.count(F.when(F.col("in_left") & F.col("in_right"), 1)).alias("matched"),
        F.count(F.when(~F.col("in_right"), 1)).alias("left_only"),
        F.count(F.when(~F.col("in_left"), 1)).alias("right_only"),
    ).withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def first_of(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """One whole row per key: the one with the least ``rank``."""
    others = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_row")).select(*keys, "_row.*")
    )
