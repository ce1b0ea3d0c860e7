"""A track as one row per chunk, with its fixes in arrays.

Fixes and bus samples are gathered once, on ``(key, chunk)``, and every chunk becomes one row that also
holds the copies around it: single rows would cost more to hand to Python than all that is done there. What a chunk needs from others is scanned over rows without the arrays;
every later pass reads the packed rows, works on many chunks at once (``operators/track.py``) and
exchanges no fix again. What a run inside one chunk needs is told from its fixes; only runs that cross
a border are linked (``wide``: at most two a chunk).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.functions import geometry as geo
from trackhouse.operators.smoothing import SHORTEST
from trackhouse.operators.timeline import Timeline
from trackhouse.operators.track import RATIO_LEAST_ROWS, RATIO_LEAST_SPEED, Chunks, held_in_run, motion, run_medians, segment_facts

#: Rows, and fixes of whole chunks, that are worked on at once.
SLICE = 100_000

WIDE = "_part int, _n bigint, _lat0 double, _lon0 double, _steps array<bigint>, _counts array<bigint>"
ENDS = ("_t0", "_v0", "_t1", "_v1")


def whole_us(seconds: np.ndarray) -> np.ndarray:
    """Microseconds, halves away from zero."""
    return np.copysign(np.floor(np.abs(seconds * 1e6) + 0.5), seconds).astype(np.int64)


def on_line(t, lt, lv, rt, rv, tolerance) -> np.ndarray:
    """The value at ``t`` between a left and a right sample, the only one's where one is missing (its time
    NaN); NaN unless one of them is within ``tolerance``."""
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(np.isnan(rt) | (rt == lt), lv, lv + (t - lt) * (rv - lv) / (rt - lt))
        near = (t - lt <= tolerance) | (rt - t <= tolerance)
    return np.where(near, np.where(np.isnan(lt), rv, value), np.nan)


def pack_chunks(fixes: DataFrame, samples: DataFrame | None, tl: Timeline, max_gap: int, behind: float, ahead: float) -> DataFrame:
    """One row per chunk: ``t, lat, lon, frame, bus`` as arrays in order of time, of which those from
    ``_lo`` up to ``_hi`` are the chunk's own, and what the scan over chunks reads.

    ``fixes``: key, ``t, lat, lon, frame`` and ``obd_speed``, or ``_tol`` with ``samples`` (key, ``t, speed``;
    the largest of equal times counts). A fix between two samples of its chunk gets its bus speed here.
    Fixes without key or time belong to no track.
    """
    (key,) = tl.keys
    at = F.col("t").cast("double")
    seen = F.explode(F.sequence(tl.chunk_of(at - F.lit(ahead)), tl.chunk_of(at + F.lit(behind))))
    number = lambda c: F.col(c).cast("double").alias(c)
    none = lambda name, kind="double": F.lit(None).cast(kind).alias(name)
    there = lambda df: df.where(F.col(key).isNotNull() & F.col("t").isNotNull())
    rows = there(fixes).select(
        key, number("t"), number("lat"), number("lon"), "frame",
        none("_value") if samples is not None else F.col("obd_speed").cast("double").alias("_value"),
        none("_tol") if samples is None else number("_tol"), F.lit(1).alias("_fix"), seen.alias(tl.chunk),
    )
    if samples is not None:
        kind = fixes.schema["frame"].dataType
        rows = rows.unionByName(there(samples).select(
            key, number("t"), none("lat"), none("lon"), none("frame", kind), F.col("speed").cast("double").alias("_value"),
            none("_tol"), F.lit(0).alias("_fix"), tl.chunk_of(at).alias(tl.chunk),
        ))
    row = ("t", "lat", "lon", "frame", "_value", "_tol", "_fix")
    gathered = rows.groupBy(*tl.group).agg(F.collect_list(F.struct(*row)).alias("_rows"))
    arrays = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("t", "lat", "lon", "frame")]
    out = T.StructType([
        rows.schema[key], rows.schema[tl.chunk], *arrays, T.StructField("bus", T.ArrayType(T.DoubleType())),
        *(T.StructField(c, T.IntegerType()) for c in ("_lo", "_hi", "_runs")), T.StructField("_fresh", T.BooleanType()),
        *(T.StructField(c, T.DoubleType()) for c in ("_tol", *ENDS)), T.StructField("_wide", T.ArrayType(T.StructType.fromDDL(WIDE))),
    ])
    width, sampled, at_once = float(tl.width), samples is not None, SLICE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sliced(batches, "_rows", at_once):
            yield from pa.table(packed(table), names=out.names).to_batches()

    def packed(table: pa.Table) -> list[pa.Array]:
        lists, n = table["_rows"].combine_chunks(), table.num_rows
        group = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        table_rows = pa.Table.from_struct_array(lists.flatten())
        order = np.lexsort((table_rows["_fix"].to_numpy(), table_rows["t"].to_numpy(), group))
        table_rows = table_rows.take(pa.array(order))
        is_fix, t = table_rows["_fix"].to_numpy() == 1, table_rows["t"].to_numpy()
        fix = np.flatnonzero(is_fix)
        g, rows = group[fix], table_rows.filter(pa.array(is_fix))
        own = np.floor(t[fix] / width).astype(np.int64) == table[tl.chunk].to_numpy()[g]
        bus, ends = _floats(rows["_value"]), np.full((4, n), np.nan)
        if sampled:
            s = np.flatnonzero(~is_fix)
            value, fresh = _floats(table_rows["_value"])[s], np.ones(len(s), bool)
            fresh[1:] = (np.diff(t[s]) != 0) | (np.diff(group[s]) != 0)
            value = np.fmax.reduceat(value, np.flatnonzero(fresh)) if len(s) else value
            s = s[fresh]
            bus, ends = _between(t, fix, group, s, value, _floats(rows["_tol"]), n)
        offsets = np.searchsorted(g, np.arange(n + 1))
        lows = offsets[:-1] + _first_true(own, offsets)
        counts = np.bincount(g[own], minlength=n)
        first = np.minimum(offsets[:-1], max(len(fix) - 1, 0))
        tol = np.where(offsets[1:] > offsets[:-1], _floats(rows["_tol"])[first], np.nan) if len(fix) else np.full(n, np.nan)
        runs, starts_fresh, wide = _cut(rows, g, own, n)
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows[c].combine_chunks()) for c in ("t", "lat", "lon", "frame")]
        lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _nullable(bus)))
        columns = [table[key].combine_chunks(), table[tl.chunk].combine_chunks(), *lists, *(pa.array(x.astype(np.int32)) for x in (lows - offsets[:-1], lows - offsets[:-1] + counts, runs)),
                   pa.array(starts_fresh), _nullable(tol), *(_nullable(x) for x in ends), wide]
        # Copies alone tell nothing.
        used = pa.array(np.flatnonzero((counts > 0) | ~np.isnan(ends[0])))
        return [c.take(used) for c in columns]

    def _cut(rows: pa.Table, g: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        chunks = Chunks(np.append(True, np.diff(g) > 0)[: len(g)], whole_us(rows["t"].to_numpy()), own, max_gap)
        groups = g[chunks.low]
        fresh = np.ones(n, bool)
        fresh[groups[chunks.part == 0]] = chunks.new[chunks.low[chunks.part == 0]]
        wide = np.flatnonzero(~chunks.whole()[chunks.runs])
        low, lat, lon = chunks.low[wide], _floats(rows["lat"]), _floats(rows["lon"])
        inside = np.flatnonzero(own & ~chunks.new)
        place = np.full(len(chunks.runs) + 1, -1, np.int64)
        place[wide] = np.arange(len(wide))
        of = place[chunks.place[chunks.run[inside]]]
        span = max_gap + 1
        folded, times = np.unique(of[of >= 0] * span + chunks.gaps[inside][of >= 0], return_counts=True)
        cuts = pa.array(np.searchsorted(folded // span, np.arange(len(wide) + 1)).astype(np.int32))
        parts = [
            pa.array(chunks.part[wide].astype(np.int32)), pa.array(chunks.high[wide] - low), pa.array(lat[low]), pa.array(lon[low]),
            pa.ListArray.from_arrays(cuts, pa.array(folded % span)), pa.ListArray.from_arrays(cuts, pa.array(times)),
        ]
        ends = np.searchsorted(groups[wide], np.arange(n + 1)).astype(np.int32)
        return np.bincount(groups, minlength=n), fresh, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=[c.split()[0] for c in WIDE.split(", ")]))

    return gathered.mapInArrow(pack, out)


def _between(t, fix, group, s, value, tolerance, n) -> tuple[np.ndarray, np.ndarray]:
    """Bus speeds of the fixes that lie between samples of their chunk, and time and value of the first
    and the last sample of every chunk. ``fix`` and ``s`` are rows in order of chunk and time, a sample
    before the fixes at its time."""
    ends = np.full((4, n), np.nan)
    bus = np.full(len(fix), np.nan)
    if not len(s):
        return bus, ends
    g, of, st = group[fix], group[s], t[s]
    firsts = np.flatnonzero(np.append(True, np.diff(of) > 0))
    lasts = np.append(firsts[1:], len(s)) - 1
    ends[:, of[firsts]] = st[firsts], value[firsts], st[lasts], value[lasts]
    passed = np.zeros(len(t), np.int64)
    passed[s] = 1
    right = np.cumsum(passed)[fix]
    left = np.maximum(right - 1, 0)
    has_left = (right > 0) & (of[left] == g)
    right = np.where(has_left & (st[left] == t[fix]), left, right)
    inside = np.flatnonzero(has_left & (right < len(s)) & (of[np.minimum(right, len(s) - 1)] == g))
    a, b = left[inside], right[inside]
    bus[inside] = on_line(t[fix][inside], st[a], value[a], st[b], value[b], tolerance[inside])
    return bus, ends


def link_chunks(packed: DataFrame, tl: Timeline) -> DataFrame:
    """What every chunk needs from the others of its key, one row each: ``_base``, the number of its first
    segment; the sample ``_before`` and the one ``_after``; and in ``_lines`` the facts of wide runs."""
    (key,) = tl.keys
    before, after = tl.chunks_before(), tl.chunks_after()
    joins = F.when((F.col("_runs") > 0) & ~F.col("_fresh"), 1).otherwise(0)
    sample = lambda k: F.when(F.col(f"_t{k}").isNotNull(), F.struct(F.col(f"_t{k}").alias("t"), F.col(f"_v{k}").alias("v")))
    linked = packed.select(
        *tl.group, "_wide", (F.coalesce(F.sum(F.col("_runs") - joins).over(before), F.lit(0)) - joins).cast("int").alias("_base"),
        F.last(sample(1), ignorenulls=True).over(before).alias("_before"), F.last(sample(0), ignorenulls=True).over(after).alias("_after"),
    )
    wide = linked.select(*tl.group, "_base", F.explode("_wide").alias("_w")).select(*tl.group, "_w.*", (F.col("_base") + F.col("_w._part")).alias("segment"))
    line = F.struct("segment", "seg_rows", "seg_lat0", "seg_lon0", "dt")
    lines = segment_facts(wide, tl).groupBy(*tl.group).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("_before", "_after") for c in "tv"]
    return linked.select(*tl.group, "_base", *flat).join(lines, tl.group, "left")


class Opened:
    """Fixes of packed rows, one after the other: cut, with their bus speeds and the facts of their runs."""

    def __init__(self, table: pa.Table, max_gap: int, sampled: bool):
        arrays = {c: table[c].combine_chunks() for c in ("t", "lat", "lon", "bus")}
        sizes = np.diff(arrays["t"].offsets.to_numpy())
        self.starts = np.append(0, np.cumsum(sizes))
        self.chunk = np.repeat(np.arange(table.num_rows), sizes)
        self.t, self.lat, self.lon, self.bus = (_floats(a.flatten()) for a in arrays.values())
        self.t_us = whole_us(self.t)
        low, high = (self.starts[:-1] + table[c].to_numpy() for c in ("_lo", "_hi"))
        rows = np.arange(len(self.t))
        self.own = (rows >= low[self.chunk]) & (rows < high[self.chunk])
        self.runs = runs = Chunks(np.append(True, np.diff(self.chunk) > 0)[: len(rows)], self.t_us, self.own, max_gap)
        if sampled:
            self._fill(table)
        head, size = runs.heads[:-1], np.diff(runs.heads)
        self.seg_rows, self.lat0, self.lon0 = size.copy(), self.lat[head], self.lon[head]
        self.dt = np.full(len(head), np.nan)
        stepped, _, medians = run_medians(np.where(runs.new, np.nan, runs.gaps), runs.run)
        self.dt[stepped] = medians / 1e6
        base = table["_base"].to_numpy()
        self.segment = np.full(len(head), -1, np.int64)
        self.segment[runs.runs] = base[self.chunk[runs.low]] + runs.part
        lines = table["_lines"].combine_chunks()
        at, told = self.runs_of(lines, base)
        self.seg_rows[at], self.lat0[at], self.lon0[at], self.dt[at] = (_floats(told.field(c)) for c in ("seg_rows", "seg_lat0", "seg_lon0", "dt"))
        self.whole = runs.whole()

    def runs_of(self, lists: pa.ListArray, base: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
        """The runs that the structs of ``lists`` tell about, by their ``segment``, and the structs."""
        offsets = np.diff(lists.offsets.to_numpy())
        told = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), offsets, 0))
        first = np.searchsorted(self.chunk[self.runs.low], row)
        return self.runs.runs[first + told.field("segment").to_numpy() - base[row]], told

    def _fill(self, table: pa.Table) -> None:
        """Bus speeds of own fixes before the chunk's first sample or after its last."""
        facts = {c: _floats(table[c]) for c in ("_tol", *ENDS, "_before_t", "_before_v", "_after_t", "_after_v")}
        of = self.chunk
        with np.errstate(invalid="ignore"):
            early, late = ~(self.t >= facts["_t0"][of]), ~(self.t <= facts["_t1"][of])
        at = np.flatnonzero(self.own & (early | late))
        # Without samples of its own a chunk looks to both sides; else to one.
        c, early, late = of[at], early[at], late[at]
        pick = lambda here, yes, no: np.where(here, facts[yes][c], facts[no][c])
        self.bus[at] = on_line(
            self.t[at], pick(early, "_before_t", "_t1"), pick(early, "_before_v", "_v1"),
            pick(late, "_after_t", "_t0"), pick(late, "_after_v", "_v0"), facts["_tol"][c],
        )

    def each(self, of_run: np.ndarray) -> np.ndarray:
        return of_run[self.runs.run]


def sliced(batches: Iterator[pa.RecordBatch], array: str, at_once: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``at_once`` elements in ``array``, one row at least."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(np.diff(table[array].combine_chunks().offsets.to_numpy()))
        row = 0
        while row < table.num_rows:
            until = max(int(np.searchsorted(ends, (ends[row - 1] if row else 0) + at_once, "right")), row + 1)
            yield table.slice(row, until - row).combine_chunks()
            row = until


def _opened(batches: Iterator[pa.RecordBatch], max_gap: int, sampled: bool, at_once: int) -> Iterator[tuple[pa.Table, Opened]]:
    for table in sliced(batches, "t", at_once):
        if table["_hi"].to_numpy().any():
            yield table, Opened(table, max_gap, sampled)


def survey(packed: DataFrame, tl: Timeline, max_gap: int, scales: Sequence[float | None], sampled: bool) -> DataFrame:
    """What units and headings are told from, one row per chunk: ``_ratios`` of whole segments (the median
    of bus speed over track speed, from ``n`` fixes), ``_wide_ratios`` fix by fix of wide ones, ``_edges``
    of wide ones as in ``shape_chunks``, and ``obd_speed``, any there is. ``packed`` comes with its links."""
    (key,) = tl.keys
    turns = [f"{name}_{k}" for name in ("held", "first") for k in range(len(scales))]
    out = T.StructType([packed.schema[key], packed.schema[tl.chunk]] + T.StructType.fromDDL(
        "_ratios array<struct<segment int, size bigint, n bigint, median double>>, _wide_ratios array<struct<segment int, size bigint, ratio double>>, "
        f"_edges array<struct<segment int, {', '.join(f'{c} double' for c in turns)}>>, obd_speed double").fields)
    at_once = SLICE

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, o in _opened(batches, max_gap, sampled, at_once):
            runs, n = o.runs, table.num_rows
            m = motion(runs, o.lat, o.lon, o.each(o.lat0), o.each(o.lon0), o.each(o.dt), ())
            size, whole = o.each(o.seg_rows), o.each(o.whole)
            usable = o.own & (size >= RATIO_LEAST_ROWS) & (m["sg_speed"] > RATIO_LEAST_SPEED) & (o.bus > 0)
            ratio = np.where(usable, o.bus / np.where(usable, m["sg_speed"], 1), np.nan)
            found, counts, medians = run_medians(np.where(whole, ratio, np.nan), runs.run)
            ratios = _lists(n, o.chunk[runs.heads[found]], {"segment": o.segment[found].astype(np.int32), "size": o.seg_rows[found], "n": counts, "median": medians})
            wide = np.flatnonzero(usable & ~whole)
            wide_ratios = _lists(n, o.chunk[wide], {"segment": o.each(o.segment)[wide].astype(np.int32), "size": size[wide], "ratio": ratio[wide]})
            # The last own fix of every wide run.
            crossing = np.flatnonzero(~o.whole[runs.runs])
            last, low = runs.high[crossing] - 1, runs.low[crossing]
            edges = {"segment": o.segment[runs.runs[crossing]].astype(np.int32)}
            held_by, first_by = {}, {}
            for k, scale in enumerate(scales):
                held, first = _turns(o, m, _fused(m["sg_speed"], o.bus, scale), low, last)
                held_by[f"held_{k}"], first_by[f"first_{k}"] = _nullable(held), _nullable(first)
            seen = np.where(o.own & (size >= 2), o.bus, np.nan)
            any_bus = np.fmax.reduceat(np.append(seen, np.nan), np.minimum(o.starts[:-1], len(seen)))
            any_bus = np.where(np.diff(o.starts) > 0, any_bus, np.nan)
            columns = [table[key], table[tl.chunk], ratios, wide_ratios, _lists(n, o.chunk[low], edges | held_by | first_by), _nullable(any_bus)]
            yield from pa.table(columns, names=out.names).to_batches()

    return packed.mapInArrow(look, out)


def label_chunks(
    packed: DataFrame, tl: Timeline, max_gap: int, horizons: Sequence[int], sampled: bool, columns: Sequence[str] | None = None
) -> DataFrame:
    """The labels of all own fixes in segments of two fixes and more: see ``labelling.label``. Of each,
    ``columns`` are given out, or all.

    ``packed`` comes with its links, the ``scale`` of the bus speed and, in ``_held``, the headings that
    wide segments take from other chunks."""
    (key,) = tl.keys
    points = [f"wp_{a}{k}" for a in "xy" for k in range(len(horizons))]
    floats = ["speed_mps", "enu_x", "enu_y", "enu_x_raw", "enu_y_raw", "heading_rad", *points, "sg_speed"]
    every = [
        T.StructField("t", T.DoubleType()), packed.schema[key], T.StructField("segment", T.IntegerType()),
        *(T.StructField(c, T.DoubleType()) for c in floats), T.StructField("frame", packed.schema["frame"].dataType.elementType),
        T.StructField("obd_speed", T.DoubleType()), T.StructField("drop_reason", T.StringType()),
    ]
    out = T.StructType([f for f in every if columns is None or f.name in columns])
    at_once, furthest = SLICE, max(horizons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, o in _opened(batches, max_gap, sampled, at_once):
            runs = o.runs
            m = motion(runs, o.lat, o.lon, o.each(o.lat0), o.each(o.lon0), o.each(o.dt), horizons)
            speed = _fused(m["sg_speed"], o.bus, _floats(table["scale"])[o.chunk])
            heading = _headings(o, m, speed, table)
            cos, sin = np.cos(heading), np.sin(heading)
            size = o.each(o.seg_rows)
            keep = np.flatnonzero(o.own & (size >= 2))
            values = {"speed_mps": speed, "heading_rad": heading, **{c: m[c] for c in ("enu_x", "enu_y", "enu_x_raw", "enu_y_raw", "sg_speed")}}
            for k in range(len(horizons)):
                dx, dy = m[f"enu_x_{k}"] - m["enu_x"], m[f"enu_y_{k}"] - m["enu_y"]
                values[f"wp_x{k}"], values[f"wp_y{k}"] = dx * cos + dy * sin, -dx * sin + dy * cos
            side = values[f"wp_y{len(horizons) - 1}"]
            # The first rule that a fix breaks; what is not known breaks none.
            with np.errstate(invalid="ignore"):
                rules = (size < SHORTEST, speed < geo.FRAME_MIN_SPEED, o.t_us + furthest > m["seg_end"], np.abs(side) > geo.MAX_LATERAL_M)
            broken = np.select(rules, range(len(rules)), -1)[keep].astype(np.int8)
            names = pa.array(["segment_too_short", "slow", "target_past_segment_end", "lateral_over_limit"])
            reason = pa.DictionaryArray.from_arrays(pa.array(broken, mask=broken < 0), names).cast(pa.string())
            given = {
                "t": lambda: pa.array(o.t[keep]), key: lambda: table[key].combine_chunks().take(pa.array(o.chunk[keep])),
                "segment": lambda: pa.array(o.each(o.segment)[keep].astype(np.int32)),
                "frame": lambda: table["frame"].combine_chunks().flatten().take(pa.array(keep)),
                "obd_speed": lambda: _nullable(o.bus[keep]), "drop_reason": lambda: reason,
            }
            columns = [given[c]() if c in given else _nullable(values[c][keep]) for c in out.names]
            yield from pa.table(columns, names=out.names).to_batches(max_chunksize=20_000)

    return packed.mapInArrow(run, out)


def _fused(track: np.ndarray, bus: np.ndarray, scale) -> np.ndarray:
    """Track speed with the bus speed blended in where both are known, as ``geometry.fuse_speed``."""
    if scale is None:
        return track
    both = (1 - geo.FUSION_WEIGHT) * track + geo.FUSION_WEIGHT * (bus * scale)
    return np.where(np.isnan(both), track, both)


def _turns(o: Opened, m: dict, speed: np.ndarray, low: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The latest valid heading up to the rows ``last`` and the first from ``low`` on, runs' own fixes."""
    with np.errstate(invalid="ignore"):
        valid = (speed >= geo.HEADING_MIN_SPEED) & o.own
    angle = np.append(m["angle"], np.nan)
    held = np.maximum.accumulate(np.where(valid, np.arange(len(valid)), -1))[last]
    hits = np.append(np.flatnonzero(valid), len(valid))
    first = hits[np.searchsorted(hits, low)]
    return np.where(held >= low, angle[held], np.nan), np.where(first <= last, angle[first], np.nan)


def _headings(o: Opened, m: dict, speed: np.ndarray, table: pa.Table) -> np.ndarray:
    """The heading held from the latest valid one of the segment, else its first, else 0."""
    runs = o.runs
    with np.errstate(invalid="ignore"):
        valid = (speed >= geo.HEADING_MIN_SPEED) & o.own
    before = np.full(len(runs.heads) - 1, np.nan)
    first = before.copy()
    first[runs.runs] = _turns(o, m, speed, runs.low, runs.high - 1)[1]
    at, told = o.runs_of(table["_held"].combine_chunks(), table["_base"].to_numpy())
    before[at], first[at] = _floats(told.field("_before")), _floats(told.field("_first"))
    fallback = np.where(np.isnan(before), np.where(np.isnan(first), 0.0, first), before)
    held = held_in_run(valid, runs.heads[runs.run])
    found = m["angle"][held]
    return np.where((held < 0) | np.isnan(found), o.each(fallback), found)


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Values as doubles; NULL is NaN."""
    return column.to_numpy(**({} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False})).astype(np.float64)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def _lists(n: int, row: np.ndarray, values: dict) -> pa.ListArray:
    """For each of ``n`` rows the structs whose ``row``, which ascends, it is."""
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in values.values()]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(arrays, names=list(values)))


def _first_true(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per stretch between ``offsets`` the place of its first true flag, 0 if it has none."""
    hits = np.append(np.flatnonzero(flags), np.iinfo(np.int64).max)
    found = hits[np.searchsorted(hits, offsets[:-1])]
    return np.where(found < offsets[1:], found - offsets[:-1], 0)
