"""From synchronised fixes to waypoint labels.

Fixes near a border of ``(route, chunk)`` are copied into the neighbour before the exchange. ``run`` and
``run_tables`` exchange fixes and bus samples once and go on with one row per chunk (``operators/packed.py``):
a scan over these rows numbers the segments, one pass tells units and headings, another writes the labels.
``smoothed_track`` and ``label`` are the same steps on rows: one Arrow pass counts the breaks of every chunk,
a second smooths, holds headings and looks ahead (``operators/track.py``). A route of any length is spread
over its chunks either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.functions import geometry as geo
from trackhouse.functions.text import frame_path
from trackhouse.operators.asof import interpolate
from trackhouse.operators.packed import label_chunks, link_chunks, pack_chunks, survey
from trackhouse.operators.ranking import exact_quantiles
from trackhouse.operators.smoothing import REACH, SHORTEST
from trackhouse.operators.timeline import Timeline, halo_by_time
from trackhouse.operators.track import RATIO_LEAST_ROWS, RATIO_LEAST_SPEED, carry_headings, chosen, cut_chunks, number_segments, shape_chunks
from trackhouse.session import durable, released, stored

# Fixed values.
MAX_GAP_S = 0.34
VAL_FRACTION = 0.15
UNIT_LEAST_ROWS = 20
#: Seconds of a route whose kept fixes are counted together, to tell where its split lies.
SPLIT_CHUNK_S = 60.0
#: Value chunk for the exact median of speed ratios, which lie around 1 or 3.6.
RATIO_CHUNK = 1e-5
UNIT_BANDS = (("m/s", 0.7, 1.4, 1.0), ("km/h", 2.9, 4.3, geo.KMH_TO_MPS))
#: What the split and the totals of labels are told from.
KEYS = ("route", "segment", "t", "drop_reason")
#: The ways in which a bus speed may count: not at all, or in one of the units.
UNITS = (None, *(name for name, *_ in UNIT_BANDS))
SCALES = (None, *(factor for *_, factor in UNIT_BANDS))


@dataclass(frozen=True)
class Rules:
    """Limits of the labelling run."""

    max_gap_s: float = MAX_GAP_S
    horizons_s: tuple[float, ...] = geo.HORIZONS_S
    chunk_s: float = 900.0
    val_fraction: float = VAL_FRACTION

    def us(self, seconds: float) -> int:
        return round(seconds * 1e6)

    @property
    def timeline(self) -> Timeline:
        return Timeline(("route",), "t_us", self.chunk_s * 1e6)


def synchronise(gps: DataFrame, obd: DataFrame, tolerances: DataFrame | None, rules=Rules(),
                default_tolerance_s: float = 0.1) -> DataFrame:
    """Fixes with ``obd_speed`` interpolated onto them (NULL where no sample is near)."""
    rows = _with_tolerance(gps, tolerances, default_tolerance_s)
    samples = obd.groupBy("route", "t").agg(F.max("speed").alias("speed"))
    return interpolate(
        rows, samples, ["route"], "t", "speed", F.col("_tol"), "obd_speed", width=rules.chunk_s
    ).drop("_tol")


def _with_tolerance(gps: DataFrame, tolerances: DataFrame | None, default_s: float) -> DataFrame:
    rows = gps.withColumn("_tol", F.lit(default_s))
    if tolerances is None:
        return rows
    # A tolerance of 0 counts as not set.
    given = tolerances.select("route", F.nullif("tolerance_s", F.lit(0.0)).alias("_given"))
    return rows.join(given, "route", "left").withColumn("_tol", F.coalesce("_given", "_tol")).drop("_given")


def smoothed_track(synced: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Segments, local metres, smoothed position and velocity, positions ahead, and the headings that
    every chunk can tell for itself.

    Input: ``route, frame, t, lat, lon, obd_speed``; it is read twice.
    """
    tl = rules.timeline
    base = synced.withColumn("t_us", F.round(F.col("t") * 1e6).cast("bigint"))
    gap = rules.us(rules.max_gap_s)
    reach = REACH * gap
    copies = halo_by_time(base, tl, behind=reach, ahead=rules.us(max(rules.horizons_s)) + gap + reach, own="_own")
    facts = number_segments(durable(cut_chunks(copies, tl, gap, "_own")), tl)
    horizons = [rules.us(h) for h in rules.horizons_s]
    return shape_chunks(copies, facts, tl, gap, "_own", horizons, SCALES)


def speed_units(track: DataFrame) -> DataFrame:
    """Per route: the unit of the bus speed, told from its ratio to the track speed.

    The longest segment that gives a clear answer decides; ``unit`` is NULL when none does. Segments
    inside one chunk come with their median ratio; those that span chunks are measured here.
    """
    whole = track.where(F.col("_edge") & F.col("_whole") & (F.col("ratio_rows") > 0)).select(
        "route", "segment", F.col("ratio").alias("median"), F.col("ratio_rows").alias("n"), F.col("seg_rows").alias("size")
    )
    usable = (F.col("sg_speed") > RATIO_LEAST_SPEED) & (F.col("obd_speed") > 0)
    wide = track.where(~F.col("_whole") & (F.col("seg_rows") >= RATIO_LEAST_ROWS) & usable)
    wide = wide.withColumn("ratio", F.col("obd_speed") / F.col("sg_speed"))
    return judge_units(whole.unionByName(segment_ratios(wide, "route", "segment", "seg_rows", "ratio")), "route", "segment")


def decide_units(df: DataFrame, route: str, segment: str, size: str, ratio: str) -> DataFrame:
    """``unit`` and ``scale`` per route from the median ratio of its segments."""
    return judge_units(segment_ratios(df.where(F.col(ratio).isNotNull()), route, segment, size, ratio), route, segment)


def segment_ratios(usable: DataFrame, route: str, segment: str, size: str, ratio: str) -> DataFrame:
    """The exact ``median`` ratio of every segment, from how many rows ``n``, and its ``size``."""
    medians = exact_quantiles(usable, [route, segment], ratio, {"median": 0.5}, width=RATIO_CHUNK)
    counts = usable.groupBy(route, segment).agg(
        F.count(F.lit(1)).alias("n"), F.max(size).alias("size")
    )
    return medians.join(counts, [route, segment])


def judge_units(ratios: DataFrame, route: str, segment: str) -> DataFrame:
    """``unit`` and ``scale`` of every route from rows as ``segment_ratios`` gives them."""
    unit, scale = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, low, high, factor in UNIT_BANDS:
        inside = F.col("median").between(low, high)
        unit = F.when(inside, F.lit(name)).otherwise(unit)
        scale = F.when(inside, F.lit(factor)).otherwise(scale)
    judged = ratios.where(F.col("n") >= UNIT_LEAST_ROWS).withColumn("unit", unit).withColumn("scale", scale)
    # Longest first; the earlier segment wins a tie, as a stable sort would have it.
    rank = F.when(F.col("unit").isNotNull(), F.struct(F.col("size"), -F.col(segment)))
    return judged.groupBy(route).agg(
        F.max_by("unit", rank).alias("unit"), F.max_by("scale", rank).alias("scale")
    )


def label(
    track: DataFrame, units: DataFrame | None = None, rules: Rules = Rules(), cameras: DataFrame | None = None
) -> DataFrame:
    """Every fix with its frame's path, speed, heading, waypoints and the reason it is dropped, if any.

    What depends on route, unit or other chunks comes with one row per chunk and segment. ``cameras``
    has one row per route: ``path`` of the camera folder and the ``example`` name of a file in it, which
    fixes padding and suffix; a route without a camera has NULL paths. Without ``units`` bus speeds are
    metres per second.
    """
    tl = rules.timeline
    carry = carry_headings(track, units, tl, UNITS)
    if cameras is None:
        carry = carry.withColumns({"_dir": F.lit(None).cast("string"), "_example": F.lit(None).cast("string")})
    else:
        place = cameras.select("route", F.col("path").alias("_dir"), F.col("example").alias("_example"))
        carry = carry.join(place, "route", "left")
    # Written, so that Spark knows its size and shuffles the fixes only where it is too large to broadcast.
    carry = stored(carry)
    rows = track.join(carry, [*tl.group, "segment"], "left")
    rows = rows.withColumn("speed_mps", geo.fuse_speed(F.col("sg_speed"), F.col("obd_speed") * F.col("scale")))
    rows = rows.withColumn("heading_rad", F.coalesce(chosen("held", len(UNITS)), "_before", "_first", F.lit(0.0)))
    points = [
        geo.to_ego(F.col(f"enu_x_{k}") - F.col("enu_x"), F.col(f"enu_y_{k}") - F.col("enu_y"), F.col("heading_rad"))
        for k in range(len(rules.horizons_s))
    ]
    last = len(points) - 1
    past_end = F.col("t_us") + rules.us(max(rules.horizons_s)) > F.col("seg_end")
    reason = F.when(F.col("seg_rows") < SHORTEST, "segment_too_short").otherwise(
        geo.drop_reason(F.col("speed_mps"), past_end, points[last][1])
    )
    waypoints = [p[0].alias(f"wp_x{k}") for k, p in enumerate(points)] + [
        p[1].alias(f"wp_y{k}") for k, p in enumerate(points)
    ]
    return rows.select(
        frame_path(F.col("_dir"), F.col("frame"), F.col("_example")).alias("frame_path"),
        "t", "speed_mps", "route", "segment", "enu_x", "enu_y", "enu_x_raw", "enu_y_raw", "heading_rad", *waypoints,
        "frame", "sg_speed", "obd_speed", reason.alias("drop_reason"),
    )


def with_frame_paths(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """``frames`` with ``frame_path``, the key that features and stored waypoints go by.

    ``cameras`` has one row per route: ``path`` of the camera folder and the ``example`` name of a
    file in it, which fixes padding and suffix. A route without a camera has NULL paths.
    """
    place = cameras.select("route", F.col("path").alias("_dir"), F.col("example").alias("_example"))
    named = frames.join(place, "route", "left")
    return named.withColumn("frame_path", frame_path(F.col("_dir"), F.col("frame"), F.col("_example"))).drop("_dir", "_example")


def temporal_split(
    kept: DataFrame,
    keys: list[str],
    t: str,
    fraction: float = VAL_FRACTION,
    width: float | None = None,
    fold: bool = True,
) -> DataFrame:
    """Add ``cutoff`` and ``split``: the last ``fraction`` of each key by time is ``val``."""
    cutoffs = stored(exact_quantiles(kept, keys, t, {"cutoff": 1.0 - fraction}, width=width, fold=fold))
    return kept.join(cutoffs, keys).withColumn(
        "split", F.when(F.col(t) >= F.col("cutoff"), "val").otherwise("train")
    )


#: Routes that an error names; it always tells how many there are.
LISTED = 20


@dataclass(frozen=True)
class Labelled:
    """Result of a labelling run; both tables are already written once."""

    fixes: DataFrame
    frames: DataFrame
    units: DataFrame

    def release(self) -> None:
        """Delete the tables of this run, once nothing is read from them any more."""
        released(self.fixes, self.units)


def unknown_units(track: DataFrame, units: DataFrame, bus_routes: DataFrame | None = None) -> DataFrame:
    """Routes that have bus data but no unit for its speed; most often their clock offset is wrong.

    ``bus_routes`` names the routes that have bus tables, matched or not; without it only routes
    with matched samples are known to have bus data.
    """
    had = track.where(F.col("obd_speed").isNotNull()).select("route")
    if bus_routes is not None:
        had = had.unionByName(bus_routes.select("route"))
    return had.distinct().join(units.where("unit IS NOT NULL"), "route", "left_anti")


def run(
    synced: DataFrame, rules: Rules = Rules(), *, cameras: DataFrame | None = None, bus_routes: DataFrame | None = None,
    require_units: bool = True, columns: Sequence[str] | None = None,
) -> Labelled:
    """The whole plan on fixes with ``obd_speed``. ``cameras`` gives the paths of frames (see ``label``).

    With ``require_units``, bus speeds whose unit cannot be told stop the run rather than vanish. All labels
    are made; of their columns all are written, or those in ``columns`` (at least ``KEYS``).
    """
    return _labelled(synced, None, rules, cameras, bus_routes, require_units, columns)


def run_tables(
    gps: DataFrame, obd: DataFrame, tolerances: DataFrame | None = None, rules: Rules = Rules(), *, default_tolerance_s: float = 0.1,
    cameras: DataFrame | None = None, bus_routes: DataFrame | None = None, require_units: bool = True, columns: Sequence[str] | None = None,
) -> Labelled:
    """``synchronise`` and ``run`` in one: the bus speeds are found where the fixes are dealt anyway."""
    return _labelled(_with_tolerance(gps, tolerances, default_tolerance_s), obd, rules, cameras, bus_routes, require_units, columns)


def _labelled(
    fixes: DataFrame, samples: DataFrame | None, rules: Rules, cameras: DataFrame | None, bus_routes: DataFrame | None, require_units: bool,
    columns: Sequence[str] | None,
) -> Labelled:
    """The packed chunks, the units and the labels are each written once; the chunks are deleted as soon as
    the labels are written."""
    tl, gap, sampled = Timeline(("route",), "t", rules.chunk_s), rules.us(rules.max_gap_s), samples is not None
    # A thousandth of a second more than is needed: times are rounded to microseconds only in the chunk.
    behind = REACH * rules.max_gap_s + 1e-3
    ahead = max(rules.horizons_s) + rules.max_gap_s + behind
    packed = stored(pack_chunks(fixes, samples, tl, gap, behind, ahead))
    links = stored(link_chunks(packed, tl))
    chunks = packed.drop("_wide", "_runs", "_fresh")
    seen = stored(survey(chunks.drop("frame").join(links, tl.group), tl, gap, SCALES, sampled))
    units = stored(chunk_units(seen))
    if require_units:
        open_routes = unknown_units(seen, units, bus_routes)
        first = [r.route for r in open_routes.orderBy("route").limit(LISTED).collect()]
        if first:
            raise ValueError(
                f"{open_routes.count()} routes have bus speeds in no known unit (check their clock offset), e.g. {first}"
            )
    edges = seen.select(*tl.group, F.explode("_edges").alias("_e")).select(*tl.group, "_e.*", F.lit(True).alias("_edge"))
    held = carry_headings(edges, units, tl, UNITS).groupBy(*tl.group).agg(F.sort_array(F.collect_list(F.struct("segment", "_before", "_first"))).alias("_held"))
    known = stored(links.join(units.select("route", "scale"), "route", "left").join(held, tl.group, "left"))
    paths = columns is None or "frame_path" in columns
    made = None if columns is None else {*columns, *KEYS, *(("frame",) if paths else ())}
    labels = label_chunks(chunks.join(known, tl.group), tl, gap, [rules.us(h) for h in rules.horizons_s], sampled, made)
    if paths and cameras is not None:
        labels = with_frame_paths(labels, cameras)
    elif paths:
        labels = labels.withColumn("frame_path", F.lit(None).cast("string"))
    first = [c for c in ("frame_path",) if paths]
    done = stored(labels.select(*first, *[c for c in labels.columns if c not in first]))
    released(packed, links, seen, known)
    kept = done.where(F.col("drop_reason").isNull()).drop("drop_reason")
    frames = temporal_split(kept, ["route"], "t", rules.val_fraction, SPLIT_CHUNK_S, fold=False)
    return Labelled(done, frames, units)


def chunk_units(seen: DataFrame) -> DataFrame:
    """``speed_units`` from what ``survey`` found in the chunks."""
    whole = seen.select("route", F.explode("_ratios").alias("_r")).select("route", "_r.segment", "_r.median", "_r.n", "_r.size")
    wide = seen.select("route", F.explode("_wide_ratios").alias("_r")).select("route", "_r.*")
    return judge_units(whole.unionByName(segment_ratios(wide, "route", "segment", "size", "ratio")), "route", "segment")


def drop_totals(fixes: DataFrame, by: list[str], reason: str = "drop_reason") -> DataFrame:
    return (
        fixes.where(F.col(reason).isNotNull())
        .groupBy(*by, reason)
        .agg(F.count(F.lit(1)).alias("dropped"))
    )


def route_report(done: Labelled) -> DataFrame:
    """One row per route plus the grand total (``route`` NULL, percentages averaged)."""
    return with_total(route_rows(done))


def route_rows(done: Labelled) -> DataFrame:
    """The report's row of every route."""
    count = lambda cond: F.count(F.when(cond, 1))
    kept = F.col("drop_reason").isNull()
    per_fix = done.fixes.groupBy("route").agg(
        count(kept).alias("frames"),
        F.count(F.lit(1)).alias("gps_fixes"),
        F.count_distinct("segment").alias("segments"),
        F.count("obd_speed").alias("obd_matched"),
    )
    per_split = done.frames.groupBy("route").agg(
        count(F.col("split") == "train").alias("train"),
        count(F.col("split") == "val").alias("val"),
        F.first("cutoff").alias("val_cutoff_t"),
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.col("gps_fixes"), 2)
    return (
        per_fix.join(per_split, "route", "left")
        .join(done.units.select("route", "unit"), "route", "left")
        .withColumn("retained_pct", share("frames"))
        .withColumn("obd_matched_pct", share("obd_matched"))
    )


def with_total(rows: DataFrame) -> DataFrame:
    """``route_rows`` of all routes and the grand total."""
    sums = ["frames", "train", "val", "segments", "gps_fixes", "obd_matched"]
    total = rows.agg(
        *[F.sum(c).alias(c) for c in sums],
        F.avg("retained_pct").alias("retained_pct"),
        F.avg("obd_matched_pct").alias("obd_matched_pct"),
    )
    return rows.unionByName(total, allowMissingColumns=True)
