"""Gap segmentation and per-segment facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackhouse.operators.timeline import Timeline, attach


def assign_segments(
    df: DataFrame, tl: Timeline, max_gap: float, *, own: str | None = None, out: str = "segment"
) -> DataFrame:
    """Number gap-free runs per key; a step longer than ``max_gap`` starts the next number.

    Also adds ``_row``, the row's place in its chunk. ``own`` names the flag of a halo layout:
    only own rows count, copies get the number of the segment they were copied from.
    """
    df = tl.cut(df)
    mine = F.col(own) if own else F.lit(True)
    order = F.col(tl.order)
    lagged = F.lag(tl.order).over(tl.forward())
    marked = (
        df.withColumn("_lag", lagged)
        .withColumn("_row", F.row_number().over(tl.forward()).cast("bigint"))
        .withColumn(
            "_break", F.coalesce(order - F.col("_lag") > F.lit(max_gap), F.lit(False)).cast("bigint")
        )
    )
    first_own = F.when(mine, tl.position())
    summary = marked.groupBy(*tl.group).agg(
        F.sum(F.when(mine, F.col("_break"))).alias("_inside"),
        F.min_by(F.col("_lag").isNull(), first_own).alias("_open"),
        F.min(F.when(mine, F.col("_row"))).alias("_first_row"),
        F.min(F.when(mine, order)).alias("_lo"),
        F.max(F.when(mine, order)).alias("_hi"),
    )
    # A chunk made of copies alone owns nothing and is dropped by the join below.
    summary = summary.where(F.col("_lo").isNotNull())
    by_chunk = Window.partitionBy(*tl.keys).orderBy(tl.chunk)
    edge = F.col("_open") & (F.col("_lo") - F.lag("_hi").over(by_chunk) > F.lit(max_gap))
    offsets = (
        summary.withColumn("_edge", F.coalesce(edge, F.lit(False)).cast("bigint"))
        .withColumn("_so_far", F.sum(F.col("_inside") + F.col("_edge")).over(by_chunk))
        .select(
            *tl.group, "_first_row", (F.col("_so_far") - F.col("_inside")).alias("_offset")
        )
    )
    joined = marked.join(offsets, tl.group).select(*marked.columns, "_first_row", "_offset")
    if own is None:
        climbed = F.sum("_break").over(tl.upto_here())
        joined = joined.withColumn(out, (F.col("_offset") + climbed).cast("int"))
    else:
        # Breaks among the copies in front of the chunk are already in the offset.
        lead = F.sum(F.when(F.col("_row") < F.col("_first_row"), F.col("_break"))).over(
            Window.partitionBy(*tl.group)
        )
        climbed = F.sum("_break").over(tl.upto_here()) - F.coalesce(lead, F.lit(0))
        joined = joined.withColumn(out, (F.col("_offset") + climbed).cast("int"))
    return joined.drop("_lag", "_break", "_offset", "_first_row")


def segment_rows(
    df: DataFrame,
    tl: Timeline,
    *,
    own: str | None = None,
    segment: str = "segment",
    firsts: Sequence[str] = (),
    least_rows: int = 2,
    extra: DataFrame | None = None,
) -> DataFrame:
    """Add ``seg_index`` (0-based), ``seg_rows``, ``seg_end`` and the segment's first values.

    Facts are built per ``(key, chunk, segment)`` and joined on that, so a segment that spans
    most of the data is still spread over its chunks. Segments shorter than ``least_rows`` are
    dropped but keep their number. ``extra`` holds more facts per ``(key, segment)``.
    """
    mine = F.col(own) if own else F.lit(True)
    group = [*tl.group, segment]
    position = F.when(mine, tl.position())
    parts = (
        df.groupBy(*group)
        .agg(
            F.count(F.when(mine, 1)).alias("_n"),
            F.min(F.when(mine, F.col("_row"))).alias("_row0"),
            F.max(F.when(mine, F.col(tl.order))).alias("_end"),
            F.min(F.when(mine, F.col(tl.order))).alias("_start"),
            *[F.min_by(c, position).alias(f"_{c}0") for c in firsts],
        )
        .where(F.col("_n") > 0)
    )
    whole = Window.partitionBy(*tl.keys, segment)
    earlier = whole.orderBy(tl.chunk).rowsBetween(Window.unboundedPreceding, -1)
    facts = (
        parts.withColumn("seg_rows", F.sum("_n").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
        .withColumn("seg_end", F.max("_end").over(whole))
        .withColumns({f"seg_{c}0": F.min_by(f"_{c}0", "_start").over(whole) for c in firsts})
        .where(F.col("seg_rows") >= least_rows)
        .drop("_n", "_end", "_start", *[f"_{c}0" for c in firsts])
    )
    more = []
    if extra is not None:
        facts = facts.join(extra, [*tl.keys, segment], "left")
        more = [c for c in extra.columns if c not in (*tl.keys, segment)]
    joined = df.join(facts, group).withColumn(
        "seg_index", F.col("_before") + F.col("_row") - F.col("_row0")
    )
    heads = [f"seg_{c}0" for c in firsts]
    return joined.select(*df.columns, "seg_index", "seg_rows", "seg_end", *heads, *more)
