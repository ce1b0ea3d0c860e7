"""As-of interpolation: slow samples onto fast rows, and rows onto their own future."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.operators.chunked import borders, dealt, whole_groups
from trackhouse.operators.timeline import Timeline, attach, fit_width, halo_by_time


def bracket(
    rows: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    t: str,
    values: Sequence[str],
    *,
    width: float | None = None,
) -> DataFrame:
    """Add ``_left`` and ``_right``: the samples at or before and at or after each row.

    Both inputs are unioned and exchanged once on ``(keys, chunk)``. The neighbours that lie in
    other chunks come from a per-chunk summary, so they may be any distance away.
    """
    keys = list(keys)
    if width is None:
        width = fit_width(rows.select(*keys, t).unionByName(samples.select(*keys, t)), keys, t)
    tl = Timeline(tuple(keys), t, width)
    point = F.struct(F.col(t).alias("t"), *[F.col(v).alias(v) for v in values])
    points = samples.select(*keys, t, point.alias("_point"))
    both = tl.cut(rows.unionByName(points, allowMissingColumns=True))
    at_point = F.when(F.col("_point").isNotNull(), F.col(t))

    # Value by value, so that the aggregate can hash: one over structs would sort its input.
    ends = both.groupBy(*tl.group).agg(
        F.min(at_point).alias("_t0"),
        F.max(at_point).alias("_t1"),
        *[F.min_by(F.col(f"_point.{v}"), at_point).alias(f"_{v}0") for v in values],
        *[F.max_by(F.col(f"_point.{v}"), at_point).alias(f"_{v}1") for v in values],
    )

    def end(i: int) -> Column:
        parts = [F.col(f"_{v}{i}").alias(v) for v in values]
        return F.when(
            F.col(f"_t{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias("t"), *parts)
        )

    ends = ends.select(*tl.group, end(0).alias("_first"), end(1).alias("_last"))
    ends = (
        ends.withColumn("_before", F.last("_last", ignorenulls=True).over(tl.chunks_before()))
        .withColumn("_after", F.last("_first", ignorenulls=True).over(tl.chunks_after()))
        .drop("_first", "_last")
    )
    # At equal times the sample comes first in both directions, so a row on a sample sees it.
    on_point = F.col("_point").isNotNull().desc()
    up = tl.forward().orderBy(F.col(t), on_point).rowsBetween(Window.unboundedPreceding, 0)
    down = tl.backward().orderBy(F.col(t).desc(), on_point).rowsBetween(Window.unboundedPreceding, 0)
    return (
        attach(both, ends, tl.group)
        .withColumn("_left", F.coalesce(F.last("_point", True).over(up), F.col("_before")))
        .withColumn("_right", F.coalesce(F.last("_point", True).over(down), F.col("_after")))
        .where(F.col("_point").isNull())
        .select(*rows.columns, "_left", "_right")
    )


def between(t: Column, value: str) -> Column:
    """Linear value at ``t`` from ``_left`` and ``_right``; the nearer end outside the samples."""
    lt, rt = F.col("_left.t"), F.col("_right.t")
    lv, rv = F.col(f"_left.{value}"), F.col(f"_right.{value}")
    return (
        F.when(lt.isNull(), rv)
        .when(rt.isNull() | (rt == lt), lv)
        .otherwise(lv + (t - lt) * (rv - lv) / (rt - lt))
    )


def interpolate(
    rows: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    t: str,
    value: str,
    tolerance: Column | float,
    out: str,
    *,
    width: float | None = None,
) -> DataFrame:
    """The sample value at each row's time, NULL when no neighbour is within ``tolerance``.

    One neighbour inside the tolerance is enough; the value is then still taken from the line
    between both neighbours.
    """
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    found = bracket(rows, samples, keys, t, [value], width=width)
    near = F.coalesce(F.col(t) - F.col("_left.t") <= tolerance, F.lit(False)) | F.coalesce(
        F.col("_right.t") - F.col(t) <= tolerance, F.lit(False)
    )
    return found.withColumn(out, F.when(near, between(F.col(t), value))).drop("_left", "_right")


#: Rows of whole chunks that are worked on at once.
SLICE = 100_000


def look_ahead(
    rows: DataFrame,
    keys: Sequence[str],
    t: str,
    values: Sequence[str],
    horizons: Sequence[float],
    row_id: str,
    *,
    width: float | None = None,
) -> DataFrame:
    """``values`` at ``t + h`` for each horizon, NULL past the last row of the key.

    Any spacing, any chunk size. Returns one row per input row with an array ``ahead`` of structs
    ``(h, <values>)`` in horizon order. A chunk is at least as wide as the longest horizon and gets
    copies of the rows that far ahead of it, plus one pointer: the first row of its key after those,
    wherever that lies. So all horizons are looked up inside the chunk, and rows are exchanged once.
    """
    keys, values = list(keys), list(values)
    reach = max(horizons)
    if min(horizons) < 0:
        raise ValueError("a horizon lies ahead")
    if width is None:
        width = fit_width(rows.select(*keys, t), keys, t)
    tl = Timeline(tuple(keys), t, max(float(width), float(reach)))
    narrow = rows.select(*keys, row_id, t, *values)
    copies = halo_by_time(narrow, tl, behind=0, ahead=reach, own="_own")
    pointers = _next_rows(narrow, tl, values, reach)
    facts = pointers.select(
        *tl.group, F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), t, *values, F.lit(False).alias("_own")
    )
    both = copies.unionByName(facts)
    names = [f"_{v}_{k}" for k in range(len(horizons)) for v in values]
    out = T.StructType([*(both.schema[c] for c in (*keys, row_id)), *(T.StructField(n, T.DoubleType()) for n in names)])
    at_once = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, tl.group, [t], at_once):
            group = np.cumsum(borders(table, tl.group)) - 1
            at = table[t].to_numpy()
            known = [table[v].to_numpy().astype(np.float64) for v in values]
            own = np.flatnonzero(table["_own"].to_numpy(zero_copy_only=False))
            taken = table.select([*keys, row_id]).take(pa.array(own))
            for k, h in enumerate(horizons):
                target = at[own] + h
                left, right = _neighbours(group, at, group[own], target)
                lt, rt = at[left], at[np.minimum(right, len(at) - 1)]
                for v, line in zip(values, known):
                    lv, rv = line[left], line[np.minimum(right, len(at) - 1)]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        found = np.where(rt == lt, lv, lv + (target - lt) * (rv - lv) / (rt - lt))
                    gone = (right >= len(at)) | (group[np.minimum(right, len(at) - 1)] != group[own])
                    taken = taken.append_column(f"_{v}_{k}", pa.array(found, mask=gone | np.isnan(found)))
            yield from taken.to_batches()

    found = dealt(both, tl.group).mapInArrow(run, out)
    kind = lambda v: rows.schema[v].dataType if isinstance(rows.schema[v].dataType, T.DoubleType) else T.DoubleType()
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), *[F.col(f"_{v}_{k}").cast(kind(v)).alias(v) for v in values]) for k, h in sorted(enumerate(horizons), key=lambda x: x[1])])
    return found.select(*keys, row_id, ahead.alias("ahead"))


def _next_rows(rows: DataFrame, tl: Timeline, values: Sequence[str], reach: float) -> DataFrame:
    """Per chunk the first row of its key that lies more than ``reach`` beyond the chunk's end.

    It lies in the next chunk, but not at its very front, or is the first of a later one; both come
    from a row per chunk, linked by one scan per key.
    """
    at = F.col(tl.order)
    late = F.when(at - tl.chunk_of(at) * F.lit(float(tl.width)) > F.lit(reach), at)
    ends = tl.cut(rows).groupBy(*tl.group).agg(
        F.min(at).alias("_t"), *[F.min_by(v, at).alias(f"_v_{v}") for v in values],
        F.min(late).alias("_lt"), *[F.min_by(v, late).alias(f"_lv_{v}") for v in values],
    )
    after = Window.partitionBy(*tl.keys).orderBy(tl.chunk)
    first = F.struct(F.col("_t").alias("t"), *[F.col(f"_v_{v}").alias(v) for v in values])
    second = F.struct(F.col("_lt").alias("t"), *[F.col(f"_lv_{v}").alias(v) for v in values])
    linked = ends.withColumns(
        {
            "_next": F.lead(F.struct(F.col(tl.chunk).alias("c"), first.alias("f"), second.alias("s"))).over(after),
            "_then": F.lead(first, 2).over(after),
        }
    )
    # Right behind comes the next chunk: what the copies do not reach there, else the chunk after it.
    beside = F.col("_next.c") == F.col(tl.chunk) + 1
    pointer = F.when(beside, F.when(F.col("_next.s.t").isNotNull(), F.col("_next.s")).otherwise(F.col("_then"))).otherwise(F.col("_next.f"))
    return linked.select(*tl.group, pointer.alias("_p")).where(F.col("_p").isNotNull()).select(
        *tl.group, F.col("_p.t").alias(tl.order), *[F.col(f"_p.{v}").alias(v) for v in values]
    )


def _neighbours(group: np.ndarray, at: np.ndarray, of: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For targets in groups ``of``: the last row at or before, and the first at or after (one past the
    row before if there is none in the group). Rows are sorted by ``group`` and ``at``."""
    n = len(at)
    order = np.lexsort((np.append(np.zeros(n, np.int8), np.ones(len(target), np.int8)), np.append(at, target), np.append(group, of)))
    is_row = order < n
    left_of = np.maximum.accumulate(np.where(is_row, order, -1))
    left = np.empty(len(target), np.int64)
    left[order[~is_row] - n] = left_of[~is_row]
    right = np.where(at[left] == target, left, left + 1)
    return left, right
