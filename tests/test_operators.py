"""Operators forced into tiny chunks, against plain loops and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackhouse.functions import text
from trackhouse.operators import (
    asof, checks, hard_examples, histograms, latency, metrics, pairing, ranking, rates, runlog,
)
from trackhouse.operators.heading import hold_or_backfill
from trackhouse.operators.segments import assign_segments, segment_rows
from trackhouse.operators.timeline import Timeline, fit_width, number_rows, previous, running
from trackhouse.plans import labelling


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    # One hot key holds most rows; values repeat; times cluster.
    n = 400
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    t = np.round(np.cumsum(rng.exponential(1.0, n) * rng.choice([0.1, 3], n)), 3)
    v = np.round(rng.normal(size=n), 1)
    return pd.DataFrame({"k": key, "t": t, "v": v, "id": np.arange(n)})


TL = Timeline(("k",), "t", 2.0, ("id",))


def by_id(df, *cols):
    pdf = df.select("id", *cols).toPandas().set_index("id").sort_index()
    return pdf if len(cols) > 1 else pdf[cols[0]]


def test_ordered_primitives_across_chunks(spark, rows):
    df = spark.createDataFrame(rows)
    g = rows.sort_values(["k", "t", "id"]).groupby("k")
    num = by_id(number_rows(df, TL, "n", "of"), "n", "of")
    assert (num.n == g.cumcount().sort_index() + 1).all()
    assert (num.of == g.id.transform("size").sort_index()).all()
    prev = by_id(previous(df, TL, {"v": "p"}), "p")
    assert np.allclose(prev, g.v.shift().sort_index(), equal_nan=True)
    run = by_id(running(df, TL, {"s": ("sum", "v"), "m": ("max", "v")}), "s", "m")
    assert np.allclose(run.s, g.v.cumsum().sort_index())
    assert np.allclose(run.m, g.v.cummax().sort_index())
    best = by_id(runlog.running_best(df, TL, "v"), "best_before", "is_best")
    assert np.allclose(best.best_before, g.v.transform(lambda s: s.cummax().shift()).sort_index(), equal_nan=True)


def test_hold_and_backfill(spark, rows):
    df = spark.createDataFrame(rows).withColumn("h", F.when(F.col("v") > 0.8, F.col("v")))
    got = by_id(hold_or_backfill(df, TL, "h", "out"), "out")
    pdf = rows.assign(h=rows.v.where(rows.v > 0.8)).sort_values(["k", "t", "id"])
    want = pdf.groupby("k").h.transform(lambda s: s.ffill().bfill()).fillna(0.0).sort_index()
    assert np.allclose(got, want)


def test_segments_across_chunks(spark, rows):
    df = spark.createDataFrame(rows)
    got = segment_rows(assign_segments(df, TL, 1.5), TL, firsts=["v"], least_rows=1).toPandas().set_index("id").sort_index()
    pdf = rows.sort_values(["k", "t", "id"])
    seg = pdf.groupby("k").t.transform(lambda s: (s.diff() > 1.5).cumsum())
    pdf = pdf.assign(seg=seg.astype(int))
    assert (got.segment == pdf.seg.sort_index()).all()
    g = pdf.groupby(["k", "seg"])
    assert (got.seg_index == g.cumcount().sort_index()).all()
    assert (got.seg_rows == g.id.transform("size").sort_index()).all()
    assert np.allclose(got.seg_v0, g.v.transform("first").sort_index())


@pytest.mark.parametrize("frames,samples,tol,want", [
    ([10], [(10, 5), (20, 15)], 1, [5]),
    ([15], [(10, 0), (20, 10)], 10, [5]),
    ([6], [(0, 0), (10, 100)], 10, [60]),
    ([50], [(0, 5), (100, 15)], 1, [None]),
    ([1.0, 1.001], [(0, 7)], 1, [7, None]),
    ([9.5], [(10, 5), (20, 15)], 1, [5]),
    ([20.5, 25], [(10, 5), (20, 15)], 1, [15, None]),
    ([1], [(0, 0), (100, 100)], 1.5, [1]),
    ([1, 2], [], 1, [None, None]),
])
def test_asof_cases(spark, frames, samples, tol, want):
    f = spark.createDataFrame([("r", float(t)) for t in frames], "k string, t double")
    s = spark.createDataFrame([("r", float(t), float(v)) for t, v in samples], "k string, t double, v double")
    out = asof.interpolate(f, s, ["k"], "t", "v", float(tol), "o", width=3.0).orderBy("t").collect()
    assert [r.o for r in out] == pytest.approx(want) if None not in want else [r.o for r in out] == want


def test_quantiles_and_ranks(spark, rows):
    df = spark.createDataFrame(rows)
    for width in (None, 0.05):
        got = ranking.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.85, "c": 1.0}, width=width).toPandas().set_index("k")
        for k, s in rows.groupby("k").v:
            assert np.allclose(got.loc[k], [s.quantile(q) for q in (0.5, 0.85, 1.0)])
    upper = ranking.exact_quantiles(df, ["k"], "v", {"a": 0.5}, upper=True).toPandas().set_index("k").a
    for k, s in rows.groupby("k").v:
        assert upper[k] == sorted(s)[len(s) // 2]
    ranked = ranking.global_rank(df, ["v", "id"], "at").toPandas().sort_values("at")
    assert list(ranked["at"]) == list(range(400))
    assert list(ranked.id) == list(rows.sort_values(["v", "id"]).id)
    picks = ranking.evenly_spaced(df, ["id"], 7).toPandas().id.sort_values()
    assert list(picks) == list(np.linspace(0, 399, 7).astype(int))
    assert ranking.evenly_spaced(df, ["id"], 1).first().id == 0


def test_chunks_fit_a_burst(spark):
    pdf = pd.DataFrame({"k": "r", "t": np.r_[np.linspace(0, 1, 3000), np.arange(2.0, 1e6, 1e3)]})
    df = spark.createDataFrame(pdf)
    width = fit_width(df, ["k"], "t", target_rows=100, least=1e-6)
    peak = pdf.groupby(np.floor(pdf.t / width)).size().max()
    assert peak <= 400


def test_rolling_history_blocks(spark, rows):
    got = by_id(runlog.rolling_history(spark.createDataFrame(rows), TL, "v", rows=9, block=10), "history_avg", "history_n")
    pdf = rows.sort_values(["k", "t", "id"])
    want = pdf.groupby("k").v.transform(lambda s: s.rolling(9, min_periods=1).mean()).sort_index()
    assert np.allclose(got.history_avg, want)


def test_hard_examples(spark, rows):
    pdf = rows.assign(p=(rows.v - rows.v.min()) / 6, loss=-rows.v, label=np.where(rows.id % 9 == 0, 255, 1))
    df = spark.createDataFrame(pdf)
    valid = pdf[pdf.label != 255]
    for kept in (3, 60):
        got = hard_examples.select_hard(df, ["k"], "p", "loss", "label", "id", threshold=0.3, min_kept=kept, width=0.3)
        want = []
        for _, g in valid.groupby("k"):
            hard = g[g.p < 0.3]
            top = g.sort_values(["loss", "id"], ascending=[False, True]).head(kept)
            want += list((hard if len(hard) >= kept else top).id)
        assert sorted(r.id for r in got.collect()) == sorted(want)


def test_hard_examples_with_one_common_loss(spark):
    """Nine of ten rows of a batch share the loss at which it is cut: exact, and ranked in small chunks."""
    n = 4000
    pdf = pd.DataFrame({"k": "hot", "id": np.random.default_rng(0).permutation(n), "p": 1.0, "label": 1})
    pdf["loss"] = np.where(pdf.id % 10 == 0, 2.0 + pdf.id % 7, 1.0)
    df = spark.createDataFrame(pdf)
    got = hard_examples.select_hard(df, ["k"], "p", "loss", "label", "id", min_kept=1500)
    want = pdf.sort_values(["loss", "id"], ascending=[False, True]).head(1500)
    assert sorted(r.id for r in got.collect()) == sorted(want.id)
    tied = hard_examples.border_ranks(df.where("loss = 1.0"), ["k"], "id", target_rows=200)
    assert tied.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 4 * 200
    ranks = tied.select("id", "_rank").toPandas().sort_values("id")
    assert list(ranks._rank) == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("width", [3.0, 50.0, None])
def test_look_ahead_pointers(spark, width, monkeypatch):
    """Neighbours in the same, the next and far later chunks, gaps of many chunks, and the last rows."""
    rng = np.random.default_rng(11)
    parts = []
    for key, n in (("a", 200), ("b", 3), ("c", 1)):
        t = np.cumsum(rng.choice([0.2, 1.0, 40.0], n, p=[0.6, 0.35, 0.05]))
        parts.append(pd.DataFrame({"k": key, "t": t, "v": rng.normal(size=n), "w": rng.normal(size=n)}))
    pdf = pd.concat(parts, ignore_index=True).assign(id=lambda d: np.arange(len(d)))
    hs = [0.5, 2.5, 0.0, 7.0]
    monkeypatch.setattr(asof, "SLICE", 20)
    out = asof.look_ahead(spark.createDataFrame(pdf), ["k"], "t", ["v", "w"], hs, "id", width=width)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_hash") == 1
    got = {r.id: r.ahead for r in out.collect()}
    assert len(got) == len(pdf)
    for _, g in pdf.groupby("k"):
        for r in g.itertuples():
            assert [x.h for x in got[r.id]] == sorted(hs)
            for x in got[r.id]:
                for c in ("v", "w"):
                    want = np.interp(r.t + x.h, g.t, g[c]) if r.t + x.h <= g.t.max() else None
                    assert (x[c] is None and want is None) or x[c] == pytest.approx(want)


def test_order_errors_and_verdicts_name_a_few_and_count_all(spark):
    rows = [(f"r{i:02d}", i % 2, False, False) for i in range(60)]
    found = spark.createDataFrame(rows, "route string, duplicates int, frame_steps_back boolean, time_not_advancing boolean")
    with pytest.raises(ValueError, match="fixes of 30 routes") as error:
        checks.require_order(found)
    assert str(error.value).count("repeated frames") == checks.LISTED and "r01" in str(error.value)
    checks.require_order(found.where("duplicates = 0"))
    names = [(f"c{i:02d}", i % 3 != 0, "d", "warn" if i % 2 else "error") for i in range(90)]
    rules = spark.createDataFrame(names, "name string, ok boolean, detail string, severity string")
    verdict = checks.roll_up(rules).first()
    assert (verdict.ok, verdict.checks, verdict.n_blocking, verdict.n_warnings) == (False, 90, 15, 15)
    assert verdict.blocking_failures == [f"c{i:02d}" for i in range(0, 90, 6)] and checks.failures(rules).count() == 30
    many = rules.withColumn("ok", F.lit(False))
    assert len(checks.roll_up(many).first().warnings) == checks.LISTED and checks.roll_up(many).first().n_warnings == 45


def test_weights_and_scores(spark):
    counts = spark.createDataFrame([(i, 1000) for i in range(8)], "train_id int, n bigint")
    w = [r.weight for r in histograms.class_weights(counts).collect()]
    assert np.allclose(w, 1 / np.log(1.02 + 0.125))
    skew = spark.createDataFrame([(0, 10_000_000)] + [(i, 1) for i in range(1, 8)], "train_id int, n bigint")
    w = [r.weight for r in histograms.class_weights(skew).collect()]
    assert max(w) <= 10 * min(w) + 1e-9
    part = skew.where("train_id < 5")
    w = {r.train_id: r.weight for r in histograms.class_weights(part, column="train_id", classes=range(8)).collect()}
    assert sorted(w) == list(range(8)) and w[7] == pytest.approx(10 * min(w.values()))
    with pytest.raises(ValueError):
        histograms.require_pixels(counts.where("false"))
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (255, 1), (2, 2)], "t int, p int")
    mean = metrics.mean_scores(metrics.class_scores(metrics.confusion(pred, "t", "p"))).first()
    assert mean.miou == pytest.approx((0.5 + 0.5 + 1) / 3) and mean.pixel_accuracy == 0.75


def test_rates_offsets_and_text(spark):
    rows = [("g", i, 32400 + i / 15) for i in range(50)] + [("e", 0, None)]
    r = rates.measure_rates(spark.createDataFrame(rows, "k string, p long, t double"), ["k"], "t").toPandas().set_index("k")
    assert r.loc["g"].hz == pytest.approx(15, abs=0.01) and r.loc["g"].error is None
    assert r.loc["e"].error == "fewer than two parseable timestamps"
    # All rows count: the step changes after the first four thousand.
    long = [("k", float(i if i < 4000 else 4000 + (i - 4000) * 3)) for i in range(10_000)]
    late = rates.measure_rates(spark.createDataFrame(long, "k string, t double"), ["k"], "t").first()
    assert (late.parsed, late.median_dt_s, late["last"]) == (10_000, 3.0, 4000 + 5999 * 3)
    only = spark.createDataFrame([("x(y",), ("XB",), ("nothing",)], "line string")
    kept = lambda wanted: {r.line for r in only.where(text.log_matches(F.col("line"), wanted)).collect()}
    assert kept("/x(?=b)/") == {"XB"} and kept("/(?P<x>b)/") == set() and kept("x(") == {"x(y"}
    cases = {"09-00-31-289685": 32431.289685, "00-00-01-5": 1.5, "00-00-01-500000": 1.5, "01:02:03": 3723.0,
             "01:02:03.5": 3723.5, "1234.5": 1234.5, "": None, "  ": None, "not a time": None, "nan": None}
    df = spark.createDataFrame(list(cases.items()), "s string, want double")
    for row in df.select("want", text.clock_seconds(F.col("s")).alias("got")).collect():
        assert row.got == pytest.approx(row.want) if row.want is not None else row.got is None
    assert spark.range(1).select(text.magnitude(F.lit(1234567).cast("bigint"))).first()[0] == "1.23 M"


def test_listing_limits_before_the_shuffle(spark, rows):
    out = pairing.capped_listing(spark.createDataFrame(rows), ["k"], "id", cap=3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    hot = out.where("k = 'hot'").first()
    assert hot.n == (rows.k == "hot").sum() and len(hot["items"]) == 3
    rate = latency.project_rate(spark.createDataFrame(rows), ["k"], ["t"], "v", batches_per_epoch=2, epochs=3)
    assert "WindowGroupLimit" in rate._jdf.queryExecution().toString()


def test_segmentation_refuses_unknown_ids(spark):
    from trackhouse.plans import segmentation

    lut = spark.createDataFrame([(0, 0), (7, 1)], "level3_id int, train_id int")
    rows = [("train", "s", 1, 0, 10), ("train", "s", 2, 7, 4), ("val", "s", 3, 7, 1)]
    schema = "split string, sequence string, key long, level3_id int, n long"
    index = {(r.split, r.train_id): r for r in segmentation.shard_index(spark.createDataFrame(rows, schema), lut, range(3), per_shard=1).collect()}
    assert len(index) == 6 and index["train", 2].pixels == 0 and index["train", 0].shards == 2
    assert index["val", 2].weight == pytest.approx(10 * min(r.weight for r in index.values()))
    with pytest.raises(ValueError, match="1 images hold ids outside the taxonomy, e.g. 9: 99"):
        segmentation.shard_index(spark.createDataFrame([*rows, ("val", "s", 9, 99, 1)], schema), lut, range(3))


def test_bus_routes_without_a_unit_stop_the_run(spark):
    track = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "route string, obd_speed double")
    units = spark.createDataFrame([("a", "m/s"), ("b", None)], "route string, unit string")
    names = lambda df: sorted(r.route for r in df.collect())
    assert names(labelling.unknown_units(track, units)) == ["b"]
    tables = spark.createDataFrame([("c",), ("a",)], "route string")
    assert names(labelling.unknown_units(track, units, tables)) == ["b", "c"]


def test_rates_give_the_double_nearest_to_a_time(spark):
    """A time in microseconds times 1e-6 is off by one step of a double for some; over 1e6 it never is."""
    from trackhouse.operators.rates import measure_rates

    times = [(k, 1_700_000_000_000_000 + 7_654_321 * k + j) for k in range(200) for j in (0, 500)]
    got = measure_rates(spark.createDataFrame(times, "k long, t long"), ["k"], "t", seconds=1e-6).collect()
    assert all(r["first"] == (1_700_000_000_000_000 + 7_654_321 * r.k) / 1e6 for r in got) and len(got) == 200


def test_clock_offset_of_users_with_a_single_time(spark, tmp_path):
    """As in SQL: one click or one view is enough for an offset, equal times and a missing one too."""
    import duckdb
    import oracle

    from trackhouse import catalog

    rows = [("click", 1, "00:10:00"), ("view", 1, "00:00:00.0625"), ("view", 1, "00:30:00"), ("click", 2, "05:30:00"), ("click", 2, "05:30:00"),
            ("view", 2, "00:00:00"), ("click", 3, None), ("view", 3, "00:00:01"), ("click", 4, "00:00:01"), ("click", None, "00:00:01"),
            ("view", None, "00:00:01"), ("click", 5, "00:00:01"), ("click", 5, "00:00:03"), ("view", 5, "00:00:01"), ("view", 5, "00:00:09")]
    values = ", ".join(f"({i}, {f'TIMESTAMP {chr(39)}2024-01-01 {t}{chr(39)}' if t else 'NULL'}, {u if u else 'NULL'}, '{k}', 1.0)" for i, (k, u, t) in enumerate(rows))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT v.id::BIGINT AS event_id, v.ts::TIMESTAMP AS ts, v.u::BIGINT AS user_id, v.k AS event_type, v.x::DOUBLE AS value FROM (VALUES {values}) AS v(id, ts, u, k, x)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = catalog.all_queries()["d19_clock_offset"](spark, str(tmp_path))
    assert found.count() == 4 and oracle.compare(found, con, catalog.all_oracles()["d19_clock_offset"]) is None


def test_roll_up_names_every_failure_when_asked(spark):
    from trackhouse import catalog
    from trackhouse.operators import checks

    many = spark.createDataFrame([(f"c{i:02d}", False, "", "warn") for i in range(45)], "name string, ok boolean, detail string, severity string")
    assert checks.roll_up(many, listed=None).first().warnings == [f"c{i:02d}" for i in range(45)]
    assert "<= 20" not in catalog.all_oracles()["d18_check_rollup"]


def test_telemetry_evaluates_each_pattern_once(spark):
    from trackhouse.catalog.scalars import telemetry_derived

    plan = telemetry_derived(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Cores, and names and values of temperatures and of rails.
    assert plan.count("get_json_object(") == 1 and plan.count("regexp_extract_all(") == 5


def test_split_summary_counts_without_expanding_rows(spark):
    rows = [("a", "s", "k1", 1, 5), ("a", "s", "k1", 255, 2), ("a", "t", "k1", 1, 1), ("a", None, "k2", 255, 3), ("b", "s", "k1", 1, 4)]
    found = histograms.split_summary(spark.createDataFrame(rows, "split string, sequence string, key string, train_id int, n long"))
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", 2, 2, 6, 5), ("b", 1, 1, 4, 0)]
