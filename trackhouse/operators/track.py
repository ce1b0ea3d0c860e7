"""Cutting, smoothing, heading and positions ahead of a track, chunk by chunk.

A chunk is worked on with copies of its neighbours' rows around it (``halo_by_time``), so whatever
needs a bounded reach is exact inside it. What does not is carried from chunk to chunk in rows of a
few numbers: ``cut_chunks`` gives one per chunk and run, ``number_segments`` scans them once per key,
and ``shape_chunks`` does the rest in one pass over the fixes. Valid headings are held there as far as
the chunk reaches; ``carry_headings`` links what is left over the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.functions import geometry as geo
from trackhouse.operators.chunked import borders, dealt, whole_groups
from trackhouse.operators.smoothing import ORDER, WINDOW, _smallest, weights
from trackhouse.operators.timeline import Timeline

#: Rows of whole chunks that are worked on at once.
SLICE = 100_000
#: A bus speed is set against the track's where this is faster, in segments of so many fixes.
RATIO_LEAST_SPEED, RATIO_LEAST_ROWS = 2.0, 60

CUTS = "_part int, _fresh boolean, _n bigint, _lat0 double, _lon0 double, _steps array<bigint>, _counts array<bigint>"
FACTS = "_part int, segment int, seg_rows bigint, seg_lat0 double, seg_lon0 double, dt double"


class Chunks:
    """Sorted fixes of whole chunks, cut where the chunk changes (``border``) or a step is longer than
    ``max_gap``; ``own`` tells them from copies."""

    def __init__(self, border: np.ndarray, t: np.ndarray, own: np.ndarray, max_gap: int):
        self.group = np.cumsum(border) - 1
        self.t, self.own = t, own
        self.gaps = np.diff(self.t, prepend=self.t[:1])
        self.new = border | (self.gaps > max_gap)
        self.run = np.cumsum(self.new) - 1
        #: First row of each run, and one past the last row of all.
        self.heads = np.append(np.flatnonzero(self.new), len(self.t))
        # A chunk is an interval of time, so its own rows stand together, as do those of a run.
        mine = np.flatnonzero(self.own)
        runs, at, counts = np.unique(self.run[mine], return_index=True, return_counts=True)
        self.runs, self.low, self.high = runs, mine[at], mine[at] + counts
        #: Number of each such run in its chunk.
        groups = self.group[self.low]
        self.part = np.arange(len(runs)) - np.searchsorted(groups, groups)
        self.place = np.full(len(self.heads) - 1, -1, np.int64)
        self.place[runs] = np.arange(len(runs))

    @classmethod
    def of(cls, table: pa.Table, group: Sequence[str], t: str, own: str, max_gap: int) -> Chunks:
        mine = np.asarray(table[own].to_numpy(zero_copy_only=False), bool)
        return cls(borders(table, group), table[t].to_numpy(), mine, max_gap)

    def whole(self) -> np.ndarray:
        """The runs that begin and end among their chunk's own fixes."""
        return self.own[self.heads[:-1]] & self.own[self.heads[1:] - 1]


def _doubles(table: pa.Table, name: str) -> np.ndarray:
    """Values as doubles; NULL is NaN."""
    return table[name].to_numpy().astype(np.float64)


def cut_chunks(copies: DataFrame, tl: Timeline, max_gap: int, own: str) -> DataFrame:
    """One row per chunk and run of own fixes: ``_part`` counts runs in the chunk, ``_fresh`` is false
    where the run began before it; ``_steps`` and ``_counts`` are its steps and how often each occurs."""
    (key,) = tl.keys
    span, at_once = max_gap + 1, SLICE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, tl.group, [tl.order], at_once):
            chunks = Chunks.of(table, tl.group, tl.order, own, max_gap)
            lat, lon = _doubles(table, "lat"), _doubles(table, "lon")
            inside = np.flatnonzero(chunks.own & ~chunks.new)
            folded, times = np.unique(chunks.place[chunks.run[inside]] * span + chunks.gaps[inside], return_counts=True)
            cuts = pa.array(np.searchsorted(folded // span, np.arange(len(chunks.runs) + 1)).astype(np.int32))
            first = pa.array(chunks.low)
            columns = [
                table[key].take(first), table[tl.chunk].take(first), pa.array(chunks.part.astype(np.int32)),
                pa.array(chunks.new[chunks.low]), pa.array(chunks.high - chunks.low), pa.array(lat[chunks.low]), pa.array(lon[chunks.low]),
                pa.ListArray.from_arrays(cuts, pa.array(folded % span)), pa.ListArray.from_arrays(cuts, pa.array(times)),
            ]
            names = [key, tl.chunk, *(c.split()[0] for c in CUTS.split(", "))]
            yield from pa.table(columns, names=names).to_batches()

    rows = dealt(copies.select(key, tl.chunk, tl.order, "lat", "lon", own), tl.group)
    return rows.mapInArrow(cut, f"`{key}` {copies.schema[key].dataType.simpleString()}, {tl.chunk} bigint, {CUTS}")


def number_segments(cuts: DataFrame, tl: Timeline) -> DataFrame:
    """``segment, seg_rows, seg_lat0, seg_lon0, dt`` of every chunk and run.

    Numbers climb with every fresh run of the key. ``dt`` is the exact median step in seconds: equal
    steps are counted first, and there are at most as many as whole microseconds up to the gap limit.
    """
    (key,) = tl.keys
    along = Window.partitionBy(key).orderBy(tl.chunk, "_part")
    return segment_facts(cuts.withColumn("segment", (F.sum(F.col("_fresh").cast("int")).over(along) - 1).cast("int")), tl)


def segment_facts(numbered: DataFrame, tl: Timeline) -> DataFrame:
    """``number_segments`` of runs that have the number of their ``segment``."""
    (key,) = tl.keys
    folded = numbered.select(key, "segment", F.explode(F.arrays_zip("_steps", "_counts")).alias("_s")).select(
        key, "segment", F.col("_s._steps").alias("_step"), F.col("_s._counts").alias("_times")
    )
    medians = (
        folded.groupBy(key, "segment", "_step").agg(F.sum("_times").alias("_times"))
        .groupBy(key, "segment").agg((F.percentile("_step", F.lit(0.5), F.col("_times")) / 1e6).alias("dt"))
    )
    whole = Window.partitionBy(key, "segment")
    ordered = whole.orderBy(tl.chunk)
    facts = numbered.select(
        key, tl.chunk, "_part", "segment", F.sum("_n").over(whole).alias("seg_rows"),
        F.first("_lat0").over(ordered).alias("seg_lat0"), F.first("_lon0").over(ordered).alias("seg_lon0"),
    )
    return facts.join(medians, [key, "segment"], "left")


def smoothing_cases(widest: int = WINDOW, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Weights of value and rate for every window length and position, zero-padded, and the row at
    which each length starts."""
    table, starts = [], np.zeros(widest + 1, np.int64)
    for w in range(_smallest(order), widest + 1, 2):
        starts[w] = len(table)
        for value, rate in zip(weights(w, order, 0), weights(w, order, 1)):
            pad = np.zeros(widest - w)
            table.append(np.concatenate([value, pad, rate, pad]))
    return np.array(table).reshape(-1, 2, widest), starts


def smooth_runs(
    values: Sequence[np.ndarray], head: np.ndarray, size: np.ndarray, widest: int = WINDOW, order: int = ORDER
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smoothed value and change per step of every row of ``values``, whose runs start at ``head`` and
    hold ``size`` rows; NaN in runs that are too short for a fit."""
    table, starts = smoothing_cases(widest, order)
    # Full windows lie the same way around their row: one sum over shifted rows for all of them.
    place = np.arange(len(head)) - head
    half = (widest - 1) // 2
    inner = (size >= widest) & (place >= half) & (place < size - (widest - 1 - half))
    middle = [np.ascontiguousarray(x) for x in table[starts[widest] + half]]
    rows = np.flatnonzero(~inner)
    out = []
    for v, (value, rate) in zip(values, _smooth_each(values, rows, head[rows], size[rows], table, starts, widest, order)):
        whole = (np.zeros(len(head)), np.zeros(len(head)))
        for of_all, weight, of_rest in zip(whole, middle, (value, rate)):
            if len(head) >= widest:
                of_all[half : len(head) - (widest - 1 - half)] = np.correlate(v, weight, "valid")
            of_all[rows] = of_rest
        out.append(whole)
    return out


def _smooth_each(values, rows, head, size, table, starts, widest, order) -> list[tuple[np.ndarray, np.ndarray]]:
    """``smooth_runs`` of the given ``rows``, each with a window of its own."""
    width = np.minimum(widest, size - 1 + size % 2)
    start = np.clip(np.minimum(rows - head - (width - 1) // 2, size - width), 0, None)
    enough = size >= order + 2
    case = np.where(enough, starts[np.where(enough, width, 0)] + rows - head - start, 0)
    first = head + start
    out = [(np.zeros(len(rows)), np.zeros(len(rows))) for _ in values]
    for k in range(widest):
        # Weights beyond the window are 0, but a NaN there would still count.
        used = k < width
        at = np.where(used, first + k, rows)
        for v, (value, rate) in zip(values, out):
            near = np.where(used, v[at], 0.0)
            value += near * table[case, 0, k]
            rate += near * table[case, 1, k]
    return [(np.where(enough, value, np.nan), np.where(enough, rate, np.nan)) for value, rate in out]


def held_in_run(valid: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The latest valid row at or before each row of its run, -1 where there is none."""
    at = np.maximum.accumulate(np.where(valid, np.arange(len(valid)), -1))
    return np.where(at >= head, at, -1)


def run_medians(values: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that have values (not NaN), how many, and their medians."""
    there = np.flatnonzero(~np.isnan(values))
    order = there[np.lexsort((values[there], run[there]))]
    runs, first, counts = np.unique(run[order], return_index=True, return_counts=True)
    low, high = values[order[first + (counts - 1) // 2]], values[order[first + counts // 2]]
    return runs, counts, low + 0.5 * (high - low)


def motion(
    chunks: Chunks, lat: np.ndarray, lon: np.ndarray, lat0: np.ndarray, lon0: np.ndarray, dt: np.ndarray, horizons: Sequence[int]
) -> dict[str, np.ndarray]:
    """Row by row: metres from ``lat0, lon0`` as measured and smoothed, speed and ``angle`` of the motion,
    the last time of the run (``seg_end``) and the positions at each horizon, NaN past it."""
    x = (lon - lon0) * geo.METRES_PER_DEG_LON * np.cos(np.radians(lat0))
    y = (lat - lat0) * geo.METRES_PER_DEG_LAT
    # Every row that is seen is smoothed: positions ahead lie among the copies too.
    head, size = chunks.heads[chunks.run], np.diff(chunks.heads)[chunks.run]
    (sx, dx), (sy, dy) = smooth_runs([x, y], head, size)
    vx, vy = dx / dt, dy / dt
    end = chunks.t[head + size - 1]
    out = {
        "seg_end": end, "enu_x_raw": x, "enu_y_raw": y, "enu_x": sx, "enu_y": sy,
        "sg_speed": np.hypot(vx, vy), "angle": np.arctan2(vy, vx),
    }
    # Time from the start of the chunk, chunks one after the other, so that one lookup serves all.
    starts = np.flatnonzero(np.append(True, np.diff(chunks.group) > 0))
    since = chunks.t - chunks.t[starts][chunks.group]
    clock = since + chunks.group * (int(since.max()) + max(horizons, default=0) + 1)
    for k, h in enumerate(horizons):
        gone = chunks.t + h > end
        for axis, line in (("x", sx), ("y", sy)):
            out[f"enu_{axis}_{k}"] = np.where(gone, np.nan, np.interp(clock + h, clock, line))
    return out


def shape_chunks(
    copies: DataFrame, facts: DataFrame, tl: Timeline, max_gap: int, own: str, horizons: Sequence[int], scales: Sequence[float | None],
    speed: str = "obd_speed",
) -> DataFrame:
    """The own fixes of every chunk with ``enu_x_raw, enu_y_raw, enu_x, enu_y, sg_speed``, the positions
    ``enu_x_<k>, enu_y_<k>`` at each horizon (NULL past the segment's end) and, for each way ``k`` in
    which the bus speed may scale, the heading ``held_<k>`` as far as the chunk tells it.

    ``_edge`` marks the last row of a chunk and segment. It also has ``first_<k>``, the first valid
    heading, and, where the chunk holds all of the segment (``_whole``), ``ratio`` and ``ratio_rows``:
    the median of bus speed over track speed and how many fixes it is taken from. Segments of fewer
    than two fixes are left out. The facts travel with the fixes, sorted before those of their chunk.
    """
    (key,) = tl.keys
    passed = [f for f in copies.schema.fields if f.name not in (own, "lat", "lon")]
    doubles = ["enu_x_raw", "enu_y_raw", "enu_x", "enu_y", "sg_speed"]
    doubles += [f"enu_{a}_{k}" for k in range(len(horizons)) for a in "xy"]
    doubles += [f"{name}_{k}" for name in ("held", "first") for k in range(len(scales))]
    added = [("segment", T.IntegerType()), ("seg_rows", T.LongType()), ("seg_end", T.LongType()), ("_edge", T.BooleanType()), ("_whole", T.BooleanType())]
    added += [("ratio_rows", T.LongType()), ("ratio", T.DoubleType()), *((name, T.DoubleType()) for name in doubles)]
    schema = T.StructType([*passed, *(T.StructField(name, kind) for name, kind in added)])
    at_once = SLICE

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in whole_groups(batches, tl.group, ["_part", tl.order], at_once):
            is_fact = both["_part"].is_valid().to_numpy()
            groups = np.cumsum(borders(both, tl.group)) - 1
            # Numbers of chunks, shared by facts and fixes.
            known, rows = both.filter(pa.array(is_fact)), both.filter(pa.array(~is_fact))
            if known.num_rows and rows.num_rows:
                yield from _table(*_shaped(rows, known, groups[is_fact], groups[~is_fact]), passed, schema).to_batches()

    def _shaped(rows: pa.Table, known: pa.Table, fact_group: np.ndarray, row_group: np.ndarray) -> tuple[pa.Table, dict[str, np.ndarray]]:
        chunks = Chunks.of(rows, tl.group, tl.order, own, max_gap)
        fact = lambda name: known[name].to_numpy()
        # The fact of a run: the facts of its chunk begin somewhere, and it has a number among them.
        begins = np.searchsorted(fact_group, row_group)
        of_run = np.append(chunks.part, -1)[chunks.place[chunks.run]]
        at = np.clip(begins + of_run, 0, known.num_rows - 1)
        moved = motion(chunks, _doubles(rows, "lat"), _doubles(rows, "lon"), fact("seg_lat0")[at], fact("seg_lon0")[at], fact("dt")[at].astype(np.float64), horizons)
        track, angle, size = moved["sg_speed"], moved.pop("angle"), np.diff(chunks.heads)[chunks.run]
        bus = _doubles(rows, speed)
        out = {"segment": fact("segment")[at], "seg_rows": fact("seg_rows")[at], **moved}
        n = len(chunks.t)
        every = np.arange(n)
        first_own = np.append(chunks.low, n)[chunks.place[chunks.run]]
        edge = np.zeros(n, bool)
        edge[chunks.high - 1] = True
        out["_edge"] = edge
        out["_whole"] = chunks.whole()[chunks.run]
        for k, scale in enumerate(scales):
            fused = track if scale is None else np.where(np.isnan(bus), track, (1 - geo.FUSION_WEIGHT) * track + geo.FUSION_WEIGHT * (bus * scale))
            valid = (fused >= geo.HEADING_MIN_SPEED) & chunks.own
            held = held_in_run(valid, first_own)
            out[f"held_{k}"] = np.where(held >= 0, angle[held], np.nan)
            hits = np.flatnonzero(valid)
            found = np.append(hits, n)[np.searchsorted(hits, first_own)]
            there = edge & (found <= every)
            out[f"first_{k}"] = np.where(there, angle[np.minimum(found, n - 1)], np.nan)
        usable = out["_whole"] & (size >= RATIO_LEAST_ROWS) & (track > RATIO_LEAST_SPEED) & (bus > 0)
        runs, counts, medians = run_medians(np.where(usable, bus / np.where(usable, track, 1), np.nan), chunks.run)
        last = chunks.heads[runs + 1] - 1
        out["ratio_rows"], out["ratio"] = np.zeros(n, np.int64), np.full(n, np.nan)
        out["ratio_rows"][last], out["ratio"][last] = counts, medians
        keep = np.flatnonzero(chunks.own & (out["seg_rows"] >= 2))
        return rows.take(pa.array(keep)), {name: values[keep] for name, values in out.items()}

    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FACTS.split(", ")]
    fixes = copies.select(*copies.columns, *empty)
    lines = facts.select(*[facts[f.name].alias(f.name) if f.name in tl.group else F.lit(None).cast(f.dataType).alias(f.name) for f in copies.schema.fields],
                         *[F.col(c.split()[0]) for c in FACTS.split(", ")])
    return dealt(fixes.unionByName(lines), tl.group).mapInArrow(shape, schema)


def _table(rows: pa.Table, values: dict[str, np.ndarray], passed: list[T.StructField], schema: T.StructType) -> pa.Table:
    kinds = {T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}
    columns = [rows[f.name] for f in passed]
    for f in schema.fields[len(passed) :]:
        array = values[f.name]
        missing = np.isnan(array) if array.dtype.kind == "f" else None
        columns.append(pa.array(array, mask=missing).cast(kinds[f.dataType]))
    return pa.table(columns, names=[f.name for f in schema.fields])


def carry_headings(track: DataFrame, units: DataFrame | None, tl: Timeline, choices: Sequence[str | None]) -> DataFrame:
    """What every chunk and segment needs from the others: ``_before``, the latest valid heading of
    earlier chunks, and ``_first``, the segment's first; with the key's ``_way``, the place of its
    ``unit`` among ``choices``, and ``scale``. One row per chunk and segment, from its last fix."""
    (key,) = tl.keys
    edges = track.where("_edge").select(
        *tl.group, "segment", *[f"{name}_{k}" for name in ("held", "first") for k in range(len(choices))]
    )
    if units is None:
        edges = edges.withColumn("_way", F.lit(1)).withColumn("scale", F.lit(1.0))
    else:
        way = F.lit(0)
        for k, unit in enumerate(choices):
            way = F.when(F.col("unit") == unit, k).otherwise(way) if unit else way
        edges = edges.join(units.select(key, "unit", "scale"), key, "left").withColumn("_way", way).drop("unit")
    whole = Window.partitionBy(key, "segment").orderBy(tl.chunk)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return edges.select(
        *tl.group, "segment", "_way", "scale",
        F.last(chosen("held", len(choices)), ignorenulls=True).over(earlier).alias("_before"),
        F.first(chosen("first", len(choices)), ignorenulls=True).over(every).alias("_first"),
    )


def chosen(name: str, ways: int) -> Column:
    """``<name>_<k>`` for the ``_way`` of the row."""
    out = F.col(f"{name}_0")
    for k in range(1, ways):
        out = F.when(F.col("_way") == k, F.col(f"{name}_{k}")).otherwise(out)
    return out
