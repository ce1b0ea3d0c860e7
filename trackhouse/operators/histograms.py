"""Class histograms, frequencies, weights, and value histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackhouse.functions.scores import WEIGHT_CAP, class_weight
from trackhouse.operators.taxonomy import IGNORE_ID

# Fixed values.
LATERAL_BINS = 80
STRAIGHT_M = 0.5
SHARP_M = 5.0


def frequencies(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Share of each class among the labelled pixels of its split; 0 when there are none.

    ``counts`` has one row per split and class.
    """
    total = F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn(
        "frequency", F.coalesce(F.try_divide(F.col(n), total), F.lit(0.0))
    )


def with_classes(counts: DataFrame, column: str, classes: Sequence[int], n: str = "n") -> DataFrame:
    """``counts`` of one split with a row of 0 for every class that it lacks."""
    spark = counts.sparkSession
    kind = counts.schema[column].dataType
    every = spark.createDataFrame([(c,) for c in classes], "c int").select(F.col("c").cast(kind).alias(column))
    lacking = every.join(counts.select(column), column, "left_anti").withColumn(n, F.lit(0).cast(counts.schema[n].dataType))
    return counts.unionByName(lacking, allowMissingColumns=True)


def class_weights(
    counts: DataFrame,
    n: str = "n",
    cap: float = WEIGHT_CAP,
    column: str | None = None,
    classes: Sequence[int] | None = None,
) -> DataFrame:
    """Weight per class of one split's counts, at most ``cap`` times the least weight.

    With ``column`` and ``classes``, a class that was never seen is rare beyond measure and gets
    the capped weight.
    """
    if column is not None and classes is not None:
        counts = with_classes(counts, column, classes, n)
    everything = Window.partitionBy(F.lit(1))
    weighted = counts.withColumn("_total", F.sum(n).over(everything)).withColumn(
        "weight",
        F.when(F.col("_total") > 0, class_weight(F.col(n) / F.nullif("_total", F.lit(0)))),
    )
    return weighted.withColumn(
        "weight", F.least("weight", cap * F.min("weight").over(everything))
    ).drop("_total")


def require_pixels(counts: DataFrame, n: str = "n") -> DataFrame:
    """The counts again, or an error when nothing was labelled."""
    if not counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]:
        raise ValueError("no class has a labelled pixel, so weights have nothing to go by")
    return counts


def split_summary(per_image: DataFrame, split: str = "split") -> DataFrame:
    """Samples, sequences, labelled and ignored pixels per split.

    ``per_image`` has one row per image and class: ``split, sequence, key, train_id, n``.
    """
    labelled = F.col("train_id") != IGNORE_ID
    # Level by level, as a distinct count holds every row three times over: images, sequences, splits.
    images = per_image.groupBy(split, "sequence", "key").agg(
        F.sum(F.when(labelled, F.col("n"))).alias("labelled_pixels"), F.sum(F.when(~labelled, F.col("n"))).alias("ignore_pixels")
    )
    whole = F.col("sequence").isNotNull() & F.col("key").isNotNull()
    pixels = [F.sum(c).alias(c) for c in ("labelled_pixels", "ignore_pixels")]
    sequences = images.groupBy(split, "sequence").agg(F.count_if(whole).alias("samples"), *pixels)
    return sequences.groupBy(split).agg(
        F.sum("samples").alias("samples"),
        F.count("sequence").alias("sequences"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("labelled_pixels", "ignore_pixels")],
    )


def merged_index(fresh: DataFrame, previous: DataFrame, split: str = "split") -> DataFrame:
    """Index rows of this run plus earlier rows of splits that were not packed again."""
    kept = previous.join(fresh.select(split).distinct(), split, "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True)


def value_histogram(df: DataFrame, value: str, bins: int = LATERAL_BINS) -> DataFrame:
    """Counts in ``bins`` equal bins between the extremes; the last bin is closed."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.select(F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    if high == low:
        low, high = low - 0.5, high + 0.5
    place = F.floor((F.col(value) - low) / (high - low) * bins).cast("bigint")
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile(df: DataFrame, value: str, near: float = STRAIGHT_M, far: float = SHARP_M) -> DataFrame:
    """Range, population deviation, and the shares inside ``near`` and beyond ``far``."""
    size = F.abs(value)
    return df.agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
        F.avg((size <= near).cast("double")).alias("share_near"),
        F.avg((size > far).cast("double")).alias("share_far"),
    )
