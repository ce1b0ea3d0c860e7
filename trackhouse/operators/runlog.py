"""Batch views of run event logs. Rows are ordered by line, never by the writer's clock."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.operators.timeline import (
    Timeline,
    fit_width,
    halo_by_rows,
    hold_last,
    number_rows,
    running,
    timeline,
)

# Fixed values.
HEARTBEAT_S = 15.0
STALE_S = 60.0
HISTORY_ROWS = 600
#: Rows of a unit of work in Python.
UNIT_ROWS = 20_000
TERMINAL = ("interrupted", "failed", "done")


def latest_values(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The value with the greatest ``order`` per key and the number of points so far."""
    return df.groupBy(*keys).agg(
        F.max_by(value, order).alias("latest"), F.count(F.lit(1)).alias("points")
    )


def run_status(df: DataFrame, run: str, value: str, order: str) -> DataFrame:
    """The last status of a run and whether it is final."""
    last = df.groupBy(run).agg(F.max_by(value, order).alias("status"))
    return last.withColumn("terminal", F.col("status").isin(*TERMINAL))


def stale_runs(df: DataFrame, run: str, ts: str, status: str, order: str, now, after: float = STALE_S):
    """Running runs that have been silent for more than ``after``."""
    return (
        df.groupBy(run)
        .agg(F.max(ts).alias("last_ts"), F.max_by(status, F.when(F.col(status).isNotNull(), F.col(order))).alias("status"))
        .withColumn("silence", F.lit(now) - F.col("last_ts"))
        .withColumn("stale", (F.col("silence") > after) & (F.col("status") == "running"))
    )


def align_to_epochs(
    epochs: DataFrame,
    scalars: DataFrame,
    keys: Sequence[str],
    epoch: str,
    order: str,
    value: str,
    out: str,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The i-th recorded value for epoch i; epochs past the last value take the last one."""
    keys = list(keys)
    numbered = number_rows(scalars, timeline(scalars, keys, order, ties=ties), "_nth")
    points = numbered.select(
        *keys, (F.col("_nth") - 1).alias(epoch), F.col(value).alias("_value")
    ).withColumn("_side", F.lit(0))
    both = epochs.withColumn("_side", F.lit(1)).unionByName(points, allowMissingColumns=True)
    tl = timeline(both, keys, epoch, ties=["_side"])
    return (
        hold_last(both, tl, "_value", out).where(F.col("_side") == 1).select(*epochs.columns, out)
    )


def align_by_epoch(
    epochs: DataFrame, scalars: DataFrame, keys: Sequence[str], epoch: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """The last value recorded under each epoch number; NULL where the epoch recorded none."""
    on = [*keys, epoch]
    last = scalars.groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias(out))
    return epochs.join(last, on, "left").select(*epochs.columns, out)


def running_best(
    df: DataFrame, tl: Timeline, value: str, *, highest: bool = True
) -> DataFrame:
    """Add ``best_before`` and ``is_best``; only a strict improvement counts."""
    fn = "max" if highest else "min"
    out = running(df, tl, {"best_before": (fn, value)}, exclusive=True)
    better = F.col(value) > F.col("best_before") if highest else F.col(value) < F.col("best_before")
    return out.withColumn("is_best", F.coalesce(better, F.col(value).isNotNull()))


def eta_minutes(df: DataFrame, tl: Timeline, epoch: str, secs: str, epochs: int) -> DataFrame:
    """Minutes left: mean epoch time so far times the epochs that remain."""
    out = running(df, tl, {"_secs": ("sum", secs), "_n": ("count", secs)})
    left = F.lit(epochs) - F.col(epoch) - 1
    return out.withColumn("eta_min", F.col("_secs") / F.col("_n") * left / 60.0).drop("_secs", "_n")


def rolling_history(
    df: DataFrame, tl: Timeline, value: str, *, rows: int = HISTORY_ROWS, block: int = 20_000
) -> DataFrame:
    """Mean, extremes and count over the last ``rows`` samples of a series.

    A sliding frame would visit ``rows`` values per row. Cut into runs of ``rows``, the last
    ``rows`` samples are the end of one run and the start of the next, and both are running
    aggregates: one from the front, one from the back.
    """
    numbered = number_rows(df, tl, "_nth", "_of").drop(tl.chunk)
    numbered = numbered.withColumn("_index", F.col("_nth") - 1)
    laid = halo_by_rows(numbered, "_index", "_of", max(block, rows), rows - 1, "_block", "_own")
    laid = laid.withColumn("_run", F.floor(F.col("_index") / rows))
    keys = [*tl.keys, "_block"]
    fold = {"n": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    start = Window.partitionBy(*keys, "_run").orderBy("_index").rowsBetween(
        Window.unboundedPreceding, 0
    )
    end = Window.partitionBy(*keys, "_run").orderBy(F.col("_index").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ends = laid.withColumns({f"_end_{k}": f(value).over(end) for k, f in fold.items()})
    both = ends.withColumns({f"_start_{k}": f(value).over(start) for k, f in fold.items()})
    # The run before counts from the oldest row in reach on; a full run needs no other.
    back = Window.partitionBy(*keys).orderBy("_index")
    partial = F.col("_index") % rows != rows - 1
    both = both.withColumns(
        {f"_old_{k}": F.when(partial, F.lag(f"_end_{k}", rows - 1).over(back)) for k in fold}
    )
    add = lambda k: F.coalesce(F.col(f"_start_{k}") + F.col(f"_old_{k}"), f"_start_{k}", f"_old_{k}")
    history = {
        "history_n": add("n"),
        "history_avg": add("sum") / F.nullif(add("n"), F.lit(0)),
        "history_min": F.least("_start_min", "_old_min"),
        "history_max": F.greatest("_start_max", "_old_max"),
    }
    return both.where(F.col("_own")).select(
        *df.columns, *[c.alias(name) for name, c in history.items()]
    )


def non_finite(df: DataFrame, value: str) -> DataFrame:
    """Scalars that must fail their run: NaN or infinite."""
    v = F.col(value)
    return df.where(F.isnan(v) | (F.abs(v) == float("inf")))


def _next_beats(times: np.ndarray, every: float) -> np.ndarray:
    """For each of the sorted ``times`` the first one that lies ``every`` or more after it."""
    after = np.searchsorted(times, times + every)
    n = len(times)
    # Rounding of the sum may put the border one off from the difference that counts.
    back = np.maximum(after - 1, 0)
    after = np.where((after > 0) & (times[back] - times >= every), back, after)
    inside = np.minimum(after, n - 1)
    return np.where((after < n) & (times[inside] - times < every), after + 1, after)


def _exits(following: np.ndarray) -> np.ndarray:
    """The last beat of the chain that starts at each beat, by doubling the steps."""
    n = len(following)
    last, step = np.arange(n), np.append(following, n)
    while (step[:n] < n).any():
        last = np.where(step[:n] < n, np.append(last, n)[step[:n]], last)
        step = step[step]
    return last


def throttle(
    df: DataFrame, run: str, ts: str, *, every: float = HEARTBEAT_S, start: float | None = 0.0
) -> DataFrame:
    """Beats that pass a limiter letting one through per ``every``.

    The limiter is greedy, so whether a beat passes depends on all before it; but a chunk of a
    run's time depends only on the first beat that passes in it. Each chunk tells, for every beat
    that may be that one (those within ``every`` of its start and the next), which beat would pass
    last. One scan over these short tables gives each chunk its first beat, and the chunks then
    mark their beats on their own. A run of any length is spread over many tasks. Beats of one time
    are told apart by nothing: one of them passes.
    """
    width = max(fit_width(df, [run], ts), 8.0 * every)
    names = df.columns
    kind = df.schema[run].dataType
    # Many short runs share a unit of work, so a task is neither one tiny group nor one long run.
    units = max(1, -(-df.count() // UNIT_ROWS))
    unit = F.pmod(F.xxhash64(run, "_chunk"), F.lit(units)).alias("_unit")
    cut = df.withColumn("_chunk", F.floor(F.col(ts) / F.lit(width)).cast("long"))

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (name, chunk), part in pdf.groupby([run, "_chunk"], sort=False):
            times = np.sort(part[ts].to_numpy(float))
            last = _exits(_next_beats(times, every))
            n = min(len(times), int(np.searchsorted(times, chunk * width + every, "right")) + 1)
            rows.append((name, chunk, times[:n], times[last[:n]]))
        return pd.DataFrame(rows, columns=[run, "_chunk", "_first", "_last"])

    table_type = T.StructType([
        T.StructField(run, kind), T.StructField("_chunk", T.LongType()),
        T.StructField("_first", T.ArrayType(T.DoubleType())), T.StructField("_last", T.ArrayType(T.DoubleType()))])
    tables = cut.select(run, "_chunk", ts, unit).groupBy("_unit").applyInPandas(tell, table_type)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, part in pdf.sort_values("_chunk").groupby(run, sort=False):
            last = start
            for chunk, first, exits in zip(part["_chunk"], part["_first"], part["_last"]):
                passing = np.flatnonzero(first - last >= every) if last is not None else np.arange(len(first))
                if len(passing):
                    rows.append((name, chunk, float(first[passing[0]])))
                    last = exits[passing[0]]
        return pd.DataFrame(rows, columns=[run, "_chunk", "_entry"])

    entry_type = T.StructType([T.StructField(run, kind), T.StructField("_chunk", T.LongType()), T.StructField("_entry", T.DoubleType())])
    by_run = F.pmod(F.xxhash64(run), F.lit(units)).alias("_unit")
    entries = tables.select("*", by_run).groupBy("_unit").applyInPandas(scan, entry_type)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        pdf = pdf.sort_values(ts, ignore_index=True)
        for _, part in pdf.groupby([run, "_chunk"], sort=False):
            times = part[ts].to_numpy(float)
            following = _next_beats(times, every)
            at = int(np.searchsorted(times, part["_entry"].iloc[0]))
            while at < len(times):
                keep.append(part.index[at])
                at = int(following[at])
        return pdf.loc[keep, names]

    marked = cut.join(entries, [run, "_chunk"]).select("*", unit)
    return marked.groupBy("_unit").applyInPandas(mark, df.schema)
