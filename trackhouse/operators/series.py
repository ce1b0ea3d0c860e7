"""Plotted series over waypoint rows: lateral offsets, speeds, residuals. One row in, rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.functions.geometry import HORIZONS_S


def lateral_series(frames: DataFrame, keep: Sequence[str] = ("route", "t"), horizons: Sequence[float] = HORIZONS_S) -> DataFrame:
    """``keep``, ``horizon`` (its number), ``horizon_s`` and ``lateral_m`` from ``wp_y0..`` columns.

    The columns are turned into rows in place: no shuffle, and a missing offset stays NULL.
    """
    points = [
        F.struct(F.lit(k).alias("horizon"), F.lit(float(s)).alias("horizon_s"), F.col(f"wp_y{k}").cast("double").alias("lateral_m"))
        for k, s in enumerate(horizons)
    ]
    return frames.select(*keep, F.explode(F.array(*points)).alias("p")).select(*keep, "p.*")


def speed_series(frames: DataFrame, keep: Sequence[str] = ("route", "t")) -> DataFrame:
    """Fused, track and bus speed of every frame."""
    return frames.select(*keep, "speed_mps", "sg_speed", "obd_speed")


def residuals(rows: DataFrame, by: Sequence[str], raw: str, smooth: str) -> DataFrame:
    """Mean and largest distance between raw and smoothed values per group."""
    off = F.abs(F.col(smooth) - F.col(raw))
    return rows.groupBy(*by).agg(F.avg(off).alias("mean_residual"), F.max(off).alias("max_residual"))
