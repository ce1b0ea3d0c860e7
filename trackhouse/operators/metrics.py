"""Segmentation and trajectory metrics, and gates that compare two models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackhouse.functions.geometry import HORIZONS_S
from trackhouse.operators.taxonomy import IGNORE_ID

# Fixed values.
MIOU_TOLERANCE = 1.0
ADE_TOLERANCE = 0.05


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (truth, pred); rows whose truth is the ignore id are left out."""
    return (
        df.where(F.col(truth) != IGNORE_ID)
        .groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IoU and recall per class; NULL when the class has no union or no truth."""
    by = list(by)
    hit = F.col("truth") == F.col("pred")
    # One pass: every cell counts once for its truth class and once for its predicted class.
    sides = F.explode(
        F.array(
            F.struct(
                F.col("truth").alias("class"),
                F.col("n").alias("truths"),
                F.lit(0).cast("bigint").alias("preds"),
                F.when(hit, F.col("n")).otherwise(0).alias("hits"),
            ),
            F.struct(
                F.col("pred").alias("class"),
                F.lit(0).cast("bigint").alias("truths"),
                F.col("n").alias("preds"),
                F.lit(0).cast("bigint").alias("hits"),
            ),
        )
    )
    sums = (
        counts.select(*by, sides.alias("s"))
        .groupBy(*by, F.col("s.class").alias("class"))
        .agg(
            F.sum("s.truths").alias("truths"),
            F.sum("s.preds").alias("preds"),
            F.sum("s.hits").alias("hits"),
        )
    )
    union = F.nullif(F.col("truths") + F.col("preds") - F.col("hits"), F.lit(0))
    return sums.withColumn("iou", F.col("hits") / union).withColumn(
        "accuracy", F.col("hits") / F.nullif("truths", F.lit(0))
    )


def mean_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mIoU, pixel and mean accuracy; classes without a value do not count."""
    return scores.groupBy(*by).agg(
        F.avg("iou").alias("miou"),
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("truths")), F.lit(0.0)).alias(
            "pixel_accuracy"
        ),
        F.avg("accuracy").alias("mean_accuracy"),
    )


def point_errors(df: DataFrame, pred: str, truth: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample and horizon with its displacement parts."""
    pairs = F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("q")))
    dx = F.col("pair.p.x") - F.col("pair.q.x")
    dy = F.col("pair.p.y") - F.col("pair.q.y")
    return df.select(*keep, pairs.alias("k", "pair")).select(
        *keep,
        "k",
        F.hypot(dx, dy).alias("error"),
        F.abs(dy).alias("lateral"),
        F.abs(dx).alias("longitudinal"),
        # The baseline keeps the true distance and drives straight on.
        F.abs("pair.q.y").alias("straight"),
    )


def horizon_scores(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return errors.groupBy(*by, "k").agg(
        *[F.avg(c).alias(c) for c in ("error", "lateral", "longitudinal", "straight")]
    )


def trajectory_scores(
    errors: DataFrame, by: Sequence[str] = (), horizons: int = len(HORIZONS_S)
) -> DataFrame:
    """ADE, FDE, lateral error at one second, the straight baseline and the comparison."""
    at = lambda k, c: F.avg(F.when(F.col("k") == k, F.col(c)))
    last = horizons - 1
    return (
        errors.groupBy(*by)
        .agg(
            F.avg("error").alias("ade"),
            at(last, "error").alias("fde"),
            at(1, "lateral").alias("lateral_1s"),
            F.avg("straight").alias("baseline_straight_ade"),
            at(last, "straight").alias("baseline_straight_fde"),
        )
        .withColumn("beats_straight_baseline", F.col("ade") < F.col("baseline_straight_ade"))
    )


def parity(a: Column, b: Column, tolerance: float) -> list[Column]:
    delta = F.abs(a - b)
    return [delta.alias("delta"), F.lit(tolerance).alias("tolerance"), (delta <= tolerance).alias("passed")]


def parity_document(checks: DataFrame) -> DataFrame:
    """All checks and whether every one passed."""
    return checks.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.max("delta").alias("worst_delta"),
    )


def compare_models(
    first: DataFrame, second: DataFrame, truth: str = "truth", pred: str = "pred", tolerance: float = MIOU_TOLERANCE
) -> DataFrame:
    """``metric, first, second, delta, tolerance, passed`` of two tables of predictions, in percent.

    Each table is scored on its own truth, so both need only hold the same samples;
    ``parity_document`` sums the rows up.
    """
    sides = []
    for name, rows in (("first", first), ("second", second)):
        scores = mean_scores(class_scores(confusion(rows, truth, pred)))
        wide = scores.select(
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("metric"), (100.0 * F.col(m)).alias(name)) for m in ("miou", "pixel_accuracy")])
            ).alias("s")
        )
        sides.append(wide.select("s.metric", f"s.{name}"))
    both = sides[0].join(sides[1], "metric")
    return both.select("metric", "first", "second", *parity(F.col("first"), F.col("second"), tolerance))


def weighted_means(df: DataFrame, metrics: Sequence[str], n: str, by: Sequence[str] = ()) -> DataFrame:
    """Means of per-batch metrics weighted by batch size."""
    return df.groupBy(*by).agg(
        *[(F.sum(F.col(m) * F.col(n)) / F.sum(n)).alias(m) for m in metrics]
    )
