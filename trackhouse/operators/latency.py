"""Latency percentiles, frame budgets and steady-state projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackhouse.functions.scores import FRAME_BUDGET_MS, budget_status
from trackhouse.operators.ranking import exact_quantiles

# Fixed values.
WARMUP_BATCHES = 8
PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def latency_profile(df: DataFrame, keys: Sequence[str], ms: str) -> DataFrame:
    """Extremes, mean, exact percentiles, throughput and coefficient of variance per key."""
    keys = list(keys)
    basics = df.groupBy(*keys).agg(
        F.count(ms).alias("samples"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.avg(ms).alias("mean_ms"),
        (100.0 * F.stddev_samp(ms) / F.avg(ms)).alias("variance_pct"),
        (1000.0 / F.avg(ms)).alias("throughput_qps"),
    )
    return basics.join(exact_quantiles(df, keys, ms, PERCENTILES), keys)


def combined_budget(engines: DataFrame, p50: str = "p50", budget: float = FRAME_BUDGET_MS) -> DataFrame:
    """Sum of the medians of all engines against one frame's budget."""
    return engines.agg(F.sum(p50).alias("total_ms")).select(
        "total_ms",
        (budget - F.col("total_ms")).alias("headroom_ms"),
        budget_status(F.col("total_ms"), budget).alias("status"),
    )


def project_rate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    secs: str,
    *,
    batches_per_epoch: int,
    epochs: int,
    warmup: int = WARMUP_BATCHES,
    timed: int | None = None,
) -> DataFrame:
    """Mean of the batches after the warm-up, scaled to an epoch and to the whole run.

    All batches count, or the first ``timed`` ones where given. The end of the warm-up is found by
    rank, which keeps a few rows per key before the shuffle; the rest is a plain aggregate.
    """
    keys = list(keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    spot = F.struct(*order)
    edges = df.select(*keys, spot.alias("_spot"), nth.alias("_nth")).where(F.col("_nth") <= warmup + (timed or 0))
    edges = edges.groupBy(*keys).agg(
        F.max(F.when(F.col("_nth") <= warmup, F.col("_spot"))).alias("_warm"), F.max("_spot").alias("_end")
    )
    steady = df.withColumn("_spot", spot).join(edges, keys).where(F.col("_spot") > F.col("_warm"))
    if timed is not None:
        steady = steady.where(F.col("_spot") <= F.col("_end"))
    return (
        steady.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("measured_batches"), F.avg(secs).alias("secs_per_batch"))
        .withColumn("secs_per_epoch", F.col("secs_per_batch") * batches_per_epoch)
        .withColumn("total_hours", F.col("secs_per_epoch") * epochs / 3600.0)
    )
