"""Small scoring expressions shared by evaluation and label reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WEIGHT_OFFSET = 1.02
WEIGHT_CAP = 10.0
FRAME_BUDGET_MS = 33.0
AMBER_SHARE = 0.8
DRIFT_TOLERANCE = 0.10


def class_weight(frequency: Column) -> Column:
    return 1.0 / F.log(F.lit(WEIGHT_OFFSET) + frequency)


def budget_status(total_ms: Column, budget_ms: float = FRAME_BUDGET_MS) -> Column:
    return (
        F.when(total_ms <= budget_ms * AMBER_SHARE, "ok")
        .when(total_ms <= budget_ms, "warn")
        .otherwise("err")
    )


def drift(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) / expected
