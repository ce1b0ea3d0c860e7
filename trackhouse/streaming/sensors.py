"""Sensor streams: trips, rolling telemetry, and bus speed aligned to fixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trips(fixes: DataFrame, route: str, at: str, late: str, gap: str = "340 milliseconds") -> DataFrame:
    """One row per gap-free run of fixes, out once the watermark has passed it."""
    return (
        fixes.withWatermark(at, late)
        .groupBy(route, F.session_window(at, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("fixes"), F.min(at).alias("start"), F.max(at).alias("stop"))
        .where("fixes >= 2")
        .drop("session")
    )


def rolling_telemetry(
    samples: DataFrame, host: str, at: str, values: list[str], late: str,
    window: str = "10 minutes", slide: str = "1 minute",
) -> DataFrame:
    """Mean and peak of each reading over a sliding window."""
    aggs = [f(c).alias(f"{c}_{n}") for c in values for f, n in ((F.avg, "avg"), (F.max, "max"))]
    return (
        samples.withWatermark(at, late)
        .groupBy(host, F.window(at, window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("samples"), *aggs)
        .select(host, F.col("w.start").alias("start"), F.col("w.end").alias("stop"),
                *[c for v in values for c in (f"{v}_avg", f"{v}_max")], "samples")
    )


def align(
    fixes: DataFrame,
    samples: DataFrame,
    route: str,
    row_id: str,
    at: str,
    value: str,
    *,
    tolerance_s: float,
    late: str,
    reach_s: float | None = None,
    patience_s: float | None = None,
    slots: int = 2048,
) -> DataFrame:
    """Bus speed at every fix, by the batch rule: on the line between both neighbours, wherever they
    lie, if one of them is within ``tolerance_s``; NULL otherwise, also without a route or a time.

    Both streams are one stateful stream. A fix waits until the watermark has passed a sample at or
    after it, as no earlier one can come then. With ``patience_s`` one that has waited so long goes out
    with its left neighbour alone; with ``reach_s`` samples further away than that do not count at all,
    and fixes wait no longer. Kept of a route are its waiting fixes and the samples from the one before
    the first of them on, so rows kept and made grow with rows read.

    Routes are dealt over ``slots`` states. A call into Python costs milliseconds however few rows it
    has, so with a state for each route many short ones would cost a call each in every micro-batch.
    """
    patience = patience_s if patience_s is not None else reach_s
    us = lambda seconds: None if seconds is None else round(seconds * 1e6)
    tolerance, reach, patience = us(tolerance_s), us(reach_s), us(patience)
    kind = fixes.schema[row_id].dataType
    columns = [route, "_at", "_id", "_v", "_fix"]
    rows = fixes.select(route, F.col(at).alias("_at"), F.col(row_id).alias("_id"), F.lit(0.0).alias("_v"), F.lit(True).alias("_fix"))
    # A sample's id stands for nothing, but NULL among whole numbers would make them floats in pandas.
    points = samples.select(route, F.col(at).alias("_at"), F.lit(0).cast(kind).alias("_id"), F.col(value).cast("double").alias("_v"), F.lit(False).alias("_fix"))
    placed = F.col(route).isNotNull() & F.col("_at").isNotNull()
    both = rows.unionByName(points).where(placed).withColumn("_slot", F.pmod(F.xxhash64(route), F.lit(slots))).withWatermark("_at", late)
    out = T.StructType([fixes.schema[route], fixes.schema[row_id], T.StructField(value, T.DoubleType())])

    def pair(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [_unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            parts += [pdf[columns] for pdf in batches]
        seen = pd.concat(parts, ignore_index=True)
        # Samples first, all by route and time; equal ones stay in the order they came.
        times = seen["_at"].to_numpy("datetime64[us]").astype(np.int64)
        codes = pd.factorize(seen[route], use_na_sentinel=False)[0]
        order = np.lexsort((times, codes, seen["_fix"].to_numpy(bool)))
        seen, times, codes = seen.iloc[order], times[order], codes[order]
        n = int((~seen["_fix"].to_numpy(bool)).sum())
        waiting, values = seen.iloc[n:], seen["_v"].to_numpy(float)[:n]
        sr, st, fr, ft = codes[:n], times[:n], codes[n:], times[n:]
        now = state.getCurrentWatermarkMs() * 1000
        done, due, aligned = _between(sr, st, values, fr, ft, now, tolerance, reach, patience)
        if done.any():
            yield pd.DataFrame({route: waiting[route][done], row_id: waiting["_id"][done], value: aligned[done]})
        keep = np.concatenate([_needed(sr, st, fr[~done], ft[~done], now), ~done])
        if not keep.any():
            state.remove()
            return
        state.update((_packed(seen[keep]),))
        due = due[~done]
        if len(due) and due.min() < NEVER:
            state.setTimeoutTimestamp(int(due.min()) // 1000 + 1)

    settled = both.groupBy("_slot").applyInPandasWithState(pair, out, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    alone = rows.where(~placed).select(route, F.col("_id").alias(row_id), F.lit(None).cast("double").alias(value))
    return settled.unionByName(alone)


#: A time, in microseconds, that no watermark reaches.
NEVER = np.iinfo(np.int64).max


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, for a state that is read and written whole."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _between(
    sr: np.ndarray, st: np.ndarray, sv: np.ndarray, fr: np.ndarray, ft: np.ndarray, now: int, tolerance: int, reach: int | None, patience: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the fixes of routes ``fr`` at ``ft`` are settled at watermark ``now``, the watermark that
    settles each as far as is known, and their values. Samples are in order of route ``sr`` and time ``st``."""
    n = len(st)
    # Route and time as one number: the time's rank leaves room for the route before it.
    ranks = np.unique(np.concatenate([st, ft]), return_inverse=True)[1]
    width = len(ranks) + 1
    sk, fk = sr * width + ranks[:n], fr * width + ranks[n:]
    right = np.searchsorted(sk, fk, "left")
    left = np.searchsorted(sk, fk, "right") - 1
    at, of = np.append(st, 0), np.append(sr, -1)
    rt, lt = at[np.minimum(right, n)], at[left]
    follows = of[np.minimum(right, n)] == fr
    has_right, has_left = follows & (rt <= now), of[left] == fr
    over = np.full(len(ft), NEVER) if patience is None else ft + patience
    due = np.minimum(np.where(follows, rt, NEVER), np.maximum(ft, over))
    done = due <= now
    if reach is not None:
        has_right &= rt - ft <= reach
        has_left &= ft - lt <= reach
    rv, lv = np.append(sv, np.nan)[np.minimum(right, n)], np.append(sv, np.nan)[left]
    near = (has_left & (ft - lt <= tolerance)) | (has_right & (rt - ft <= tolerance))
    with np.errstate(invalid="ignore", divide="ignore"):
        line = np.where(rt == lt, lv, lv + (ft - lt) * (rv - lv) / (rt - lt))
    value = np.where(has_left & has_right, line, np.where(has_left, lv, rv))
    return done, due, np.where(near, value, np.nan)


def _needed(sr: np.ndarray, st: np.ndarray, fr: np.ndarray, ft: np.ndarray, now: int) -> np.ndarray:
    """Which samples a waiting fix, or one still to come, can need: of a route, those from the last one
    up to the watermark and up to its first waiting fix on. Samples and fixes are in order of route and time."""
    until = np.full(int(max(sr.max(initial=-1), fr.max(initial=-1))) + 1, now, np.int64)
    np.minimum.at(until, fr, ft)
    passed = (sr[1:] == sr[:-1]) & (st[1:] <= until[sr[1:]])
    return ~np.append(passed, np.zeros(min(len(st), 1), bool))
