"""Heading that survives a stop: hold the last valid one, else take the first valid one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackhouse.operators.timeline import Timeline, attach


def hold_or_backfill(df: DataFrame, tl: Timeline, value: str, out: str) -> DataFrame:
    """``value`` is NULL where it is not valid; keys without any valid value get 0.0.

    The last row of a chunk already knows the chunk's last and first valid value, so it serves as the
    chunk's summary: nothing is aggregated, and rows are exchanged once.
    """
    whole = tl.forward().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = tl.cut(df).withColumns(
        {
            "_held": F.last(value, ignorenulls=True).over(tl.upto_here()),
            "_first": F.first(value, ignorenulls=True).over(whole),
            "_edge": F.lead(F.lit(1)).over(tl.forward()).isNull(),
        }
    )
    edges = marked.where("_edge").select(*tl.group, F.col("_held").alias("_last"), "_first")
    chunks = Window.partitionBy(*tl.keys).orderBy(tl.chunk)
    every = chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = edges.select(
        *tl.group, F.last("_last", ignorenulls=True).over(tl.chunks_before()).alias("_before"),
        F.first("_first", ignorenulls=True).over(every).alias("_any"),
    )
    return (
        attach(marked.drop("_first", "_edge"), carry, tl.group)
        .withColumn(out, F.coalesce("_held", "_before", "_any", F.lit(0.0)))
        .drop("_held", "_before", "_any")
    )
