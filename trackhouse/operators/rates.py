"""Sample rates, clock offsets and tolerances, as proposals a person confirms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackhouse.operators.ranking import exact_quantiles
from trackhouse.operators.timeline import previous, timeline

# Fixed values; the offsets and their labels are output.
SPEC_TOLERANCE_S = 0.100
KNOWN_OFFSETS = (
    (19800, "UTC+5:30 (IST): OBD logged in UTC while GPS logged local Indian time"),
    (0, "no offset"),
    (18000, "UTC+5:00"),
    (16200, "UTC+4:30"),
    (21600, "UTC+6:00"),
)


def _in_seconds(value: Column, seconds: float) -> Column:
    # A millionth is no double, but a million is: a quotient is the double nearest to the time.
    return value / F.lit(float(round(1 / seconds))) if seconds < 1 else value * seconds


def measure_spans(df: DataFrame, keys: Sequence[str], t: str, seconds: float = 1.0) -> DataFrame:
    """How many times parsed, the first and the last of each table's time column; one time is enough."""
    return df.groupBy(*keys).agg(
        F.count(t).alias("parsed"),
        F.count(F.when(F.col(t).isNull(), 1)).alias("unparsed"),
        _in_seconds(F.min(t), seconds).alias("first"),
        _in_seconds(F.max(t), seconds).alias("last"),
    )


def measure_rates(df: DataFrame, keys: Sequence[str], t: str, seconds: float = 1.0) -> DataFrame:
    """First, last, span, median positive step and rate of each table's time column, over all rows.

    ``t`` is NULL where a time did not parse; ``seconds`` is the length of one unit of ``t``.
    The median is the upper one: the element at half the count of the sorted steps. Equal times are
    folded first, since only steps that advance count, and steps are taken per time chunk.
    """
    keys = list(keys)
    facts = measure_spans(df, keys, t, seconds)
    times = df.where(F.col(t).isNotNull()).select(*keys, t).distinct()
    stepped = previous(times, timeline(times, keys, t, least=1e-6), {t: "_before"})
    steps = stepped.select(*keys, (F.col(t) - F.col("_before")).alias("_step"))
    medians = exact_quantiles(steps, keys, "_step", {"_median": 0.5}, upper=True)
    median = _in_seconds(F.col("_median"), seconds)
    return (
        facts.join(medians, keys, "left")
        .withColumn("span_s", F.round(F.col("last") - F.col("first"), 3))
        .withColumn("median_dt_s", F.round(median, 6))
        .withColumn("hz", F.round(1.0 / median, 3))
        .withColumn(
            "error",
            F.when(F.col("parsed") < 2, "fewer than two parseable timestamps").when(
                F.col("_median").isNull(), "timestamps do not advance"
            ),
        )
        .drop("_median")
    )


def nearest_offset(raw: Column, known=KNOWN_OFFSETS) -> Column:
    """The known offset closest to ``raw`` (earlier entries win a tie) as ``(seconds, label)``."""
    options = F.array(
        *[
            F.struct(
                F.abs(raw - F.lit(s)).alias("off"),
                F.lit(i).alias("i"),
                F.lit(s).alias("seconds"),
                F.lit(label).alias("label"),
            )
            for i, (s, label) in enumerate(known)
        ]
    )
    return F.array_min(options)


def propose_offsets(gps: DataFrame, obd: DataFrame, route: str = "route") -> DataFrame:
    """Offset that brings bus times onto the position clock, from the two starts.

    Both inputs are one row per route. Of rates, a route with an error on either side has none; spans
    (``measure_spans``) are all taken as they are.
    """
    usable = lambda df: df.where(F.col("error").isNull() & F.col("first").isNotNull()) if "error" in df.columns else df
    g, o = usable(gps).alias("g"), usable(obd).alias("o")
    raw = F.col("g.first") - F.col("o.first")
    overlap = F.least("g.last", "o.last") - F.greatest("g.first", "o.first")
    return (
        g.join(o, F.col(f"g.{route}") == F.col(f"o.{route}"))
        .select(F.col(f"g.{route}").alias(route), raw.alias("_raw"), overlap.alias("_overlap"))
        .withColumn("_near", nearest_offset(F.col("_raw")))
        .select(
            route,
            F.col("_near.seconds").alias("proposed_s"),
            F.round("_raw", 3).alias("raw_offset_s"),
            F.round(F.col("_raw") - F.col("_near.seconds"), 3).alias("residual_s"),
            F.col("_near.label").alias("hypothesis"),
            F.round("_overlap", 3).alias("raw_overlap_s"),
        )
    )


def propose_tolerances(obd: DataFrame, route: str = "route") -> DataFrame:
    """One measured sampling interval as the association window."""
    return obd.where(F.col("median_dt_s").isNotNull()).select(
        route,
        F.round("median_dt_s", 3).alias("proposed_s"),
        F.lit(SPEC_TOLERANCE_S).alias("spec_s"),
        F.col("median_dt_s").alias("measured_median_dt_s"),
        F.col("hz").alias("measured_hz"),
    )
