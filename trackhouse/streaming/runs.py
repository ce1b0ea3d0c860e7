"""Run logs on streams: throttled heartbeats, stale runs, latest values, status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackhouse.operators.runlog import HEARTBEAT_S, STALE_S


def throttle(stream: DataFrame, run: str, ts: str, every: float = HEARTBEAT_S) -> DataFrame:
    """Let one beat per ``every`` seconds of writer time through; the state is one number per run."""
    schema = stream.select(run, ts).schema

    def passing(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        # A micro-batch of a run may come in several Arrow batches: order all of it first.
        times = np.sort(np.concatenate([pdf[ts].to_numpy(float) for pdf in batches]))
        keep = []
        at = _next_beat(times, last, every)
        while at < len(times):
            last = float(times[at])
            keep.append(last)
            at = _next_beat(times, last, every)
        if keep:
            yield pd.DataFrame({run: key[0], ts: keep})
        state.update((last,))

    return stream.select(run, ts).groupBy(run).applyInPandasWithState(
        passing, schema, "last double", "append", GroupStateTimeout.NoTimeout
    )


def _next_beat(times: np.ndarray, last: float, every: float) -> int:
    """The first of the sorted ``times`` that lies ``every`` or more after ``last``."""
    at = int(np.searchsorted(times, last + every))
    while at > 0 and times[at - 1] - last >= every:
        at -= 1
    while at < len(times) and times[at] - last < every:
        at += 1
    return at


def stale_alerts(
    stream: DataFrame, run: str, at: str, status: str, after: float = STALE_S, line: str | None = None
) -> DataFrame:
    """``(run, since, state)``: ``stale`` after a silence of a running run, ``live`` at its next event.

    ``at`` is an event-time column with a watermark; a timer per run fires when the watermark
    passes the last event plus ``after``. The latest status is that of the last line where ``line``
    names the place of a row in its log, else that of the latest time; its place is kept, so an earlier
    line that comes in a later micro-batch does not replace it.
    """
    order = line or at
    schema = f"{run} string, since timestamp, state string"

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, current, stale, spot = state.get if state.exists else (0, None, False, None)
        if state.hasTimedOut:
            state.update((last, current, True, spot))
            yield pd.DataFrame({run: [key[0]], "since": [pd.Timestamp(last, unit="ms")], "state": ["stale"]})
            return
        before, running, news = last, current == "running", []
        for pdf in batches:
            known = pdf[pdf[status].notna()]
            if len(known):
                top = known.loc[known[order].idxmax()]
                place = int(top[order].value if isinstance(top[order], pd.Timestamp) else top[order])
                if spot is None or place > spot:
                    spot, current = place, top[status]
            news.append(int(pdf[at].min().value // 1_000_000))
            last = max(last, int(pdf[at].max().value // 1_000_000))
        # The event that ends a silence may arrive before the timer of that silence fired.
        missed = running and not stale and min(news) - before > after * 1000
        rows = [(before, "stale")] if missed else []
        rows += [(last, "live")] if stale or missed else []
        if rows:
            since, what = zip(*rows)
            yield pd.DataFrame({run: key[0], "since": pd.to_datetime(since, unit="ms"), "state": what})
        state.update((last, current, False, spot))
        due = last + int(after * 1000)
        if current == "running" and due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)

    return stream.select(F.col(run).cast("string"), at, status, *([line] if line else [])).groupBy(run).applyInPandasWithState(
        watch, schema, "last long, status string, stale boolean, spot long", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def latest_values(stream: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Latest value and point count per series, for update or complete mode."""
    return stream.groupBy(*keys).agg(
        F.max_by(value, order).alias("latest"), F.count(F.lit(1)).alias("points")
    )
