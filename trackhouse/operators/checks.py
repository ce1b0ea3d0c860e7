"""Consistency checks that end up as rows ``(name, ok, detail, severity)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.functions.scores import DRIFT_TOLERANCE, drift
from trackhouse.operators.ranking import exact_quantiles
from trackhouse.operators.timeline import previous, timeline

# Fixed values.
GPS_TOLERANCE_S = 0.050
EXPECTED_IMAGES = {"train": 14000, "val": 2000, "test": 4000}
EXPECTED_TOTAL_IMAGES = 20000

#: Failing names that a verdict or an error lists; it always counts all of them.
LISTED = 20


def duplicate_keys(df: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """How many rows of each group repeat a key.

    Counting per key first keeps a large group out of any single task.
    """
    per_key = df.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*group).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def order_checks(
    df: DataFrame,
    route: str,
    t: str,
    frame: str,
    *,
    tolerance: float = GPS_TOLERANCE_S,
) -> DataFrame:
    """Per route: repeated frames, frames that step back, times that do not advance, slow rate.

    ``tolerance`` is in units of ``t``.
    """
    tl = timeline(df, [route], t, ties=[frame])
    stepped = previous(df.select(route, t, frame), tl, {t: "_t", frame: "_frame"})
    dt = F.col(t) - F.col("_t")
    flags = stepped.groupBy(route).agg(
        F.coalesce(F.bool_or(F.col(frame) < F.col("_frame")), F.lit(False)).alias("frame_steps_back"),
        F.coalesce(F.bool_or(dt <= 0), F.lit(False)).alias("time_not_advancing"),
    )
    steps = stepped.withColumn("_dt", dt).where(F.col("_dt").isNotNull())
    medians = exact_quantiles(steps, [route], "_dt", {"median_dt": 0.5}, width=tolerance / 1000)
    return (
        flags.join(medians, route, "left")
        .join(duplicate_keys(df, [route], [frame]), route)
        .withColumn("slow_rate", F.coalesce(F.col("median_dt") > tolerance * 2, F.lit(False)))
    )


def require_order(checks: DataFrame, route: str = "route") -> None:
    """Raise if fixes of any route are not a 1:1, strictly advancing sequence: says how many routes and
    names the first ``LISTED``."""
    failing = checks.where("duplicates > 0 OR frame_steps_back OR time_not_advancing")
    bad = failing.orderBy(route).limit(LISTED).collect()
    if bad:
        lines = [
            f"{r[route]}: {r.duplicates} repeated frames, steps back {r.frame_steps_back}, "
            f"stalled time {r.time_not_advancing}"
            for r in bad
        ]
        raise ValueError(f"fixes of {failing.count()} routes are not consistent:\n  - " + "\n  - ".join(lines))


def count_drift(
    counts: DataFrame, expected: DataFrame, key: str, tolerance: float = DRIFT_TOLERANCE
) -> DataFrame:
    """Compare counts ``n`` with ``expected``; a key that is absent counts as 0."""
    n = F.coalesce("n", F.lit(0))
    return (
        expected.join(counts, key, "left")
        .withColumn("n", n)
        .withColumn("drift", drift(F.col("n"), F.col("expected")))
        .withColumn("ok", F.col("drift") <= tolerance)
    )


def check_row(name, ok, detail, severity: str = "error") -> list:
    return [
        name.alias("name"), ok.alias("ok"), detail.alias("detail"), F.lit(severity).alias("severity")
    ]


def roll_up(checks: DataFrame, listed: int | None = LISTED) -> DataFrame:
    """Overall verdict: ``ok``, how many ``checks``, and the names of blocking failures and of warnings
    with their numbers ``n_blocking`` and ``n_warnings``. The first ``listed`` names are given, or all of
    them with None; ``failures`` has each as a row."""
    blocking, warning = _failed("error"), _failed("warn")
    verdict = checks.agg(
        F.coalesce(~F.bool_or(blocking), F.lit(True)).alias("ok"), F.count(F.lit(1)).alias("checks"),
        F.count_if(blocking).alias("n_blocking"), F.count_if(warning).alias("n_warnings"),
    )
    shown = lambda cond: checks.where(cond) if listed is None else checks.where(cond).orderBy("name").limit(listed)
    first = lambda cond, out: shown(cond).agg(F.sort_array(F.collect_list("name")).alias(out))
    # Three tables of one row each.
    joined = verdict.join(first(blocking, "blocking_failures"), F.lit(True)).join(first(warning, "warnings"), F.lit(True))
    return joined.select("ok", "checks", "blocking_failures", "warnings", "n_blocking", "n_warnings")


def failures(checks: DataFrame) -> DataFrame:
    """Every failing check as a row."""
    return checks.where(_failed("error") | _failed("warn")).select("name", "severity", "detail")


def _failed(severity: str):
    return F.coalesce(~F.col("ok"), F.lit(False)) & (F.col("severity") == severity)
