"""End-to-end gates on tracks with a closed form."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackhouse import session
from trackhouse.operators import timeline
from trackhouse.operators import track as track_ops
from trackhouse.operators.smoothing import weights
from trackhouse.plans import labelling as plan

LAT0, LON0 = 17.4962518306, 78.4156015873


def track(east, north, t, route="r0"):
    lat = LAT0 + np.asarray(north) / 111132
    lon = LON0 + np.asarray(east) / (111320 * math.cos(math.radians(LAT0)))
    return pd.DataFrame(
        {"route": route, "frame": np.arange(len(t)), "t": t, "lat": lat, "lon": lon}
    )


def circle(r=50.0, v=10.0, hz=15.0, secs=40.0, route="c", w=None):
    w = v / r if w is None else w
    t = np.arange(int(secs * hz)) / hz + 100.0
    a = w * (t - 100.0)
    return track(r * np.sin(a), r * (1 - np.cos(a)), t, route)


def labelled(spark, pdf, chunk_s=900.0, obd=None):
    df = spark.createDataFrame(pdf)
    if "obd_speed" not in pdf:
        df = df.withColumn("obd_speed", F.lit(None).cast("double"))
    rules = plan.Rules(chunk_s=chunk_s)
    return plan.label(plan.smoothed_track(df, rules), None, rules)


@pytest.mark.parametrize("chunk_s", [900.0, 7.0, 2.0])
def test_circle(spark, chunk_s):
    out = labelled(spark, circle(), chunk_s).toPandas().sort_values("t")
    assert len(out) == 600
    assert set(out.segment) == {0}
    kept = out[out.drop_reason.isna()]
    assert len(kept) == 600 - 38 + 0 or len(kept) == 562
    inner = kept.iloc[10:]
    assert np.allclose(inner.speed_mps, 10, atol=0.02)
    for k, h in enumerate((0.5, 1.0, 1.5, 2.0, 2.5)):
        a = 10 / 50 * h
        assert np.abs(inner[f"wp_x{k}"] - 50 * math.sin(a)).max() < 0.05
        assert np.abs(inner[f"wp_y{k}"] - 50 * (1 - math.cos(a))).max() < 0.05


def test_chunking_does_not_change_anything(spark):
    rng = np.random.default_rng(3)
    pdf = circle(secs=30)
    pdf["lat"] += rng.normal(0, 2e-7, len(pdf))
    stop = (pdf.t > 108) & (pdf.t < 116)
    pdf.loc[stop, ["lat", "lon"]] = pdf.loc[stop, ["lat", "lon"]].iloc[0].to_numpy()
    pdf = pdf[(pdf.frame < 200) | (pdf.frame > 230)]
    whole = labelled(spark, pdf, 900.0).toPandas().sort_values("t").reset_index(drop=True)
    cut = labelled(spark, pdf, 3.0).toPandas().sort_values("t").reset_index(drop=True)
    assert list(whole.segment.unique()) == [0, 1]
    same = whole.drop_reason.isna()
    pd.testing.assert_frame_equal(whole[same], cut[same], atol=1e-9)
    assert (whole.drop_reason.fillna("") == cut.drop_reason.fillna("")).all()
    assert np.allclose(whole.heading_rad, cut.heading_rad)


def test_straight_crawl_and_turnaround(spark):
    t = np.arange(400) / 15.0
    east = labelled(spark, track(12 * t, 0 * t, t)).toPandas()
    kept = east[east.drop_reason.isna()]
    assert np.abs(kept.wp_y4).max() < 0.01
    assert np.abs(kept.wp_x4 - 30).max() < 0.05

    crawl = labelled(spark, circle(v=0.4)).toPandas()
    assert crawl.drop_reason.notna().all() and (crawl.drop_reason == "slow").sum() > 0

    turn = labelled(spark, circle(r=20.0, w=math.pi / 2.5)).toPandas()
    assert (turn.drop_reason == "lateral_over_limit").sum() > 0

    short = labelled(spark, circle(secs=10)).toPandas()
    assert (short.drop_reason == "target_past_segment_end").sum() > 0


def test_short_segments_are_counted_not_lost(spark):
    few = labelled(spark, circle(secs=0.2)).toPandas()
    assert list(few.drop_reason) == ["segment_too_short"] * 3
    seven = labelled(spark, circle(secs=7 / 15)).toPandas()
    assert np.isfinite(seven.speed_mps).all()


def test_weights_match_a_polynomial_fit():
    rng = np.random.default_rng(0)
    for w in (5, 7, 9, 11, 13, 15):
        y = rng.normal(size=w)
        x = np.arange(w)
        p = np.polyfit(x, y, 3)
        assert np.allclose(weights(w, 3, 0) @ y, np.polyval(p, x))
        assert np.allclose(weights(w, 3, 1) @ y, np.polyval(np.polyder(p), x))


def test_units_and_split(spark):
    pdf = circle(secs=30)
    pdf["obd_speed"] = 36.0
    done = plan.run(spark.createDataFrame(pdf), plan.Rules(chunk_s=5.0))
    assert [r.unit for r in done.units.collect()] == ["km/h"]
    frames = done.frames.toPandas()
    cutoff = frames.t.quantile(0.85)
    assert np.isclose(frames.cutoff.iloc[0], cutoff)
    assert ((frames.t >= cutoff) == (frames.split == "val")).all()
    report = plan.route_report(done).toPandas()
    assert len(report) == 2
    assert report.frames.iloc[0] == report.train.iloc[0] + report.val.iloc[0]


def exchanges(df, what):
    """Exchanges by ``what`` in the plan that Spark would run."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({what}")


def test_fixes_are_exchanged_once_per_pass(spark):
    rules = plan.Rules(chunk_s=5.0)
    pdf = circle(secs=30)
    pdf["obd_speed"] = 36.0
    synced = spark.createDataFrame(pdf)
    track = plan.smoothed_track(synced, rules)
    # The counts of breaks are written by then; what is left is the one exchange of fixes and facts.
    assert exchanges(track, "_hash") == 1
    tl = rules.timeline
    cuts = track_ops.cut_chunks(timeline.halo_by_time(
        synced.withColumn("t_us", F.round(F.col("t") * 1e6).cast("bigint")), tl, 5_000_000, 8_000_000, "_own"), tl, 340_000, "_own")
    assert exchanges(cuts, "_hash") == 1 and exchanges(cuts, "") == 1
    stored_track = session.stored(track)
    labels = plan.label(stored_track, session.stored(plan.speed_units(stored_track)), rules)
    assert exchanges(labels, "") == 0 and "BroadcastHashJoin" in labels._jdf.queryExecution().executedPlan().toString()


def test_kernel_in_tiny_slices_and_many_routes(spark, monkeypatch):
    """Routes, chunks and stops that share slices give what each gives alone; bus speeds in three units."""
    rng = np.random.default_rng(5)
    parts = []
    for k, unit in enumerate((None, 1.0, 3.6, 3.6)):
        pdf = circle(secs=25 + k, route=f"r{k}", v=8.0 + k)
        stop = (pdf.t > 104) & (pdf.t < 112)
        pdf.loc[stop, ["lat", "lon"]] = pdf.loc[stop, ["lat", "lon"]].iloc[0].to_numpy()
        pdf = pdf[(pdf.frame < 250) | (pdf.frame > 262)]
        pdf["obd_speed"] = np.nan if unit is None else np.where(rng.random(len(pdf)) < 0.7, (8.0 + k) * unit, np.nan)
        parts.append(pdf)
    both = pd.concat(parts)
    rows = lambda pdf: spark.createDataFrame(pdf).withColumn("obd_speed", F.nanvl("obd_speed", F.lit(None).cast("double")))
    done = {}
    for slice_rows, chunk_s in ((100_000, 900.0), (1, 2.0)):
        monkeypatch.setattr(track_ops, "SLICE", slice_rows)
        out = plan.run(rows(both), plan.Rules(chunk_s=chunk_s), require_units=False)
        done[chunk_s] = out.fixes.toPandas().sort_values(["route", "t"]).reset_index(drop=True)
        assert {r.route: r.unit for r in out.units.collect()} == {"r1": "m/s", "r2": "km/h", "r3": "km/h"}
    alone = pd.concat([plan.run(rows(p), plan.Rules(chunk_s=4.0), require_units=False).fixes.toPandas() for p in parts[1:2]])
    alone = alone.sort_values(["route", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(done[900.0], done[2.0], atol=1e-9)
    pd.testing.assert_frame_equal(done[900.0].query("route == 'r1'").reset_index(drop=True), alone, atol=1e-9)
    assert set(done[900.0].segment) == {0, 1}


def test_frame_paths_come_with_the_labels(spark):
    pdf = circle(secs=20)
    pdf["obd_speed"] = 36.0
    cameras = spark.createDataFrame([("c", "primary/leftCamImgs", "0000000.jpg")], "route string, path string, example string")
    done = plan.run(spark.createDataFrame(pdf), cameras=cameras)
    row = done.frames.orderBy("t").first()
    assert row.frame_path == f"primary/leftCamImgs/{row.frame:07d}.jpg"
    assert done.frames.where("frame_path IS NULL").isEmpty()
    without = plan.run(spark.createDataFrame(pdf))
    assert without.frames.where("frame_path IS NOT NULL").isEmpty() and without.frames.columns == done.frames.columns


def test_shares_of_routes_leave_only_their_summaries(spark, monkeypatch):
    """Any number of shares gives the same rows, and no table of fixes, track or labels is left on disk."""
    from trackhouse.catalog import tracks
    from trackhouse.session import ensure_checkpoint_dir

    place, data = ensure_checkpoint_dir(spark).removeprefix("file:"), "/root/testdata/sf0.001"
    before = set(os.listdir(place))
    once = sorted(tracks.route_report(spark, data).collect(), key=str)
    monkeypatch.setattr(tracks, "BATCH_EVENTS", 600)
    assert sorted(tracks.route_report(spark, data).collect(), key=str) == once
    left = [n for n in set(os.listdir(place)) - before if n.startswith("table-")]
    names = {c for n in left for c in spark.read.parquet(f"{place}/{n}").columns}
    assert left and not names & {"lat", "enu_x", "t"}


def drives(rng):
    """Routes with stops, gaps, a route that crosses many chunks, bus samples that are sparse, late, doubled or missing."""
    fixes, bus = [], []
    for k, factor in enumerate((None, 1.0, 3.6, 3.6)):
        pdf = circle(secs=25 + k, route=f"r{k}", v=8.0 + k)
        stop = (pdf.t > 104) & (pdf.t < 112)
        pdf.loc[stop, ["lat", "lon"]] = pdf.loc[stop, ["lat", "lon"]].iloc[0].to_numpy()
        fixes.append(pdf[(pdf.frame < 250) | (pdf.frame > 262)])
        if factor:
            t = np.sort(np.append(rng.choice(pdf.t, 9, replace=False), [95.0, 108.25, 108.25]))
            bus.append(pd.DataFrame({"route": f"r{k}", "t": t, "speed": (8.0 + k) * factor + rng.normal(0, 0.01, len(t))}))
    return pd.concat(fixes), pd.concat(bus)


@pytest.mark.parametrize("chunk_s, slice_rows", [(900.0, 100_000), (3.0, 1), (1.0, 100)])
def test_packed_chunks_label_as_rows_do(spark, monkeypatch, chunk_s, slice_rows):
    """Gathered by chunk, with bus speeds found there, the labels are those of the steps on rows."""
    from trackhouse.operators import packed

    monkeypatch.setattr(packed, "SLICE", slice_rows)
    gps, obd = (spark.createDataFrame(p) for p in drives(np.random.default_rng(7)))
    near = spark.createDataFrame([("r2", 0.4), ("r3", 0.0)], "route string, tolerance_s double")
    rules = plan.Rules(chunk_s=chunk_s)
    done = plan.run_tables(gps, obd, near, rules, default_tolerance_s=2.0)
    synced = session.durable(plan.synchronise(gps, obd, near, rules, default_tolerance_s=2.0))
    track = session.durable(plan.smoothed_track(synced, rules))
    units = session.durable(plan.speed_units(track))
    want = plan.label(track, units, rules)
    assert sorted(done.units.collect(), key=str) == sorted(units.collect(), key=str)
    assert {r.unit for r in done.units.collect()} == {"m/s", "km/h"}
    order = lambda df: df.toPandas().sort_values(["route", "t"]).reset_index(drop=True)[want.columns]
    pd.testing.assert_frame_equal(order(done.fixes), order(want), atol=1e-9)
    pd.testing.assert_frame_equal(order(plan.run(synced, rules).fixes), order(want), atol=1e-9)
    few = plan.run_tables(gps, obd, near, rules, default_tolerance_s=2.0, columns=["wp_x4"])
    assert set(few.fixes.columns) == {*plan.KEYS, "wp_x4"} and few.fixes.count() == want.count()


def test_tables_reach_python_chunk_by_chunk(spark):
    """One exchange of fixes and samples; Python gets one row per chunk, not one per fix."""
    gps, obd = (spark.createDataFrame(p) for p in drives(np.random.default_rng(7)))
    from trackhouse.operators.packed import pack_chunks

    tl = timeline.Timeline(("route",), "t", 5.0)
    packed = pack_chunks(gps.withColumn("_tol", F.lit(1.0)), obd, tl, 340_000, 5.0, 8.0)
    assert exchanges(packed, "") == 1
    lost = pd.DataFrame({"route": [None, "r9"], "frame": [0, 0], "t": [1.0, None], "lat": [LAT0] * 2, "lon": [LON0] * 2})
    chunks = session.durable(pack_chunks(gps.unionByName(spark.createDataFrame(lost, gps.schema)).withColumn("_tol", F.lit(1.0)), obd, tl, 340_000, 5.0, 8.0))
    assert chunks.count() < 40 < gps.count() and chunks.agg(F.sum(F.col("_hi") - F.col("_lo"))).first()[0] == gps.count()
    assert chunks.groupBy("route", "_chunk").count().where("count > 1").isEmpty()


def test_quantiles_without_folding_move_only_wanted_chunks(spark):
    from trackhouse.operators.ranking import exact_quantiles

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 500), "v": np.round(rng.exponential(30, 500), 1)})
    rows = spark.createDataFrame(pdf)
    for width in (None, 5.0):
        got = exact_quantiles(rows, ["k"], "v", {"q": 0.85}, width=width, fold=False).toPandas().set_index("k").q
        for k, part in pdf.groupby("k"):
            assert got[k] == pytest.approx(part.v.quantile(0.85))
