"""Streams give what their batch twins give."""

import datetime
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackhouse.operators import asof, runlog
from trackhouse.sources.tail import TailSource, complete_bytes
from trackhouse.streaming import runs, sensors


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(df, mode="append"):
    name = "out_" + os.path.basename(scratch()).replace("-", "_")
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", scratch()).start()
    )
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).toPandas()


def stream_of(spark, *frames):
    """A file stream that sees each frame as one micro-batch."""
    folder = scratch()
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(folder)
        if i == 0:
            schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_tail_source_appends_torn_lines_and_replacement(spark):
    spark.dataSource.register(TailSource)
    folder, state, out = scratch(), scratch(), scratch()
    path = os.path.join(folder, "events.jsonl")

    def run():
        q = (
            spark.readStream.format("tail").option("path", folder + "/*.jsonl").load()
            .writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(once=True).start()
        )
        q.awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    with open(path, "w") as f:
        f.write('{"a":1}\n{"a":2}\n{"a":')
    assert run() == ['{"a":1}', '{"a":2}']
    with open(path, "a") as f:
        f.write("3}\n")
    assert run() == ['{"a":1}', '{"a":2}', '{"a":3}']
    with open(path, "w") as f:
        f.write("new\n")
    assert run() == sorted(["new", '{"a":1}', '{"a":2}', '{"a":3}'])


def test_tail_slices_cover_every_line_once(tmp_path, monkeypatch):
    from trackhouse.sources import tail

    monkeypatch.setattr(tail, "SLICE", 7)
    path = tmp_path / "x.jsonl"
    lines = [f"line {i}" + "x" * (i % 9) for i in range(50)]
    path.write_text("\n".join(lines) + "\ntorn")
    reader = tail.TailReader(str(path))
    end = reader.latestOffset()
    assert end[str(path)]["at"] == complete_bytes(str(path))
    got = []
    for part in reader.partitions({}, end):
        for batch in reader.read(part):
            got += batch["line"].to_pylist()
    assert got == lines


def test_tail_knows_a_replaced_file_that_is_longer(spark):
    """Shorter, longer and equally long files in place of an old one; appends; the availableNow trigger."""
    spark.dataSource.register(TailSource)
    folder, state, out = scratch(), scratch(), scratch()
    path = os.path.join(folder, "run1", "events.jsonl")
    os.makedirs(os.path.dirname(path))

    def run(text, mode="w"):
        with open(path, mode) as f:
            f.write(text)
        q = (
            spark.readStream.format("tail").option("path", f"file:{folder}/*/*.jsonl").load()
            .writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    want = ["a1", "a2"]
    assert run("a1\na2\ntorn") == want
    want = sorted([*want, "torn now"])
    assert run(" now\n", "a") == want
    long = [f"b{i}" for i in range(3000)]
    want = sorted([*want, *long])
    assert run("\n".join(long) + "\n") == want  # replaced by a longer file
    want = sorted([*want, "end"])
    assert run("end\n", "a") == want
    want = sorted([*want, "c1"])
    assert run("c1\n") == want  # replaced by a shorter file
    want = sorted([*want, "d1"])
    assert run("d1\n") == want  # replaced by one of the same length


def test_tail_budget_cuts_at_lines(tmp_path):
    from trackhouse.sources import tail

    lines = {f"{n}.log": [f"{n} line {i} " + "x" * (i % 40) for i in range(60)] for n in "ab"}
    for name, text in lines.items():
        (tmp_path / name).write_text("\n".join(text) + "\ntorn")
    reader = tail.TailReader(f"{tmp_path}/*.log", 150)
    start, got, batches = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        assert sum(p.stop - p.start for p in parts) <= 150
        got += [line for p in parts for b in reader.read(p) for line in b["line"].to_pylist()]
        start, batches = end, batches + 1
    assert sorted(got) == sorted(sum(lines.values(), [])) and batches > 20
    # A line longer than the budget still goes through, alone.
    (tmp_path / "c.log").write_text("y" * 1000 + "\nshort\n")
    reader = tail.TailReader(f"{tmp_path}/c.log", 150)
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert [p.stop for p in reader.partitions(start, first)] == [1001]
    assert [p.stop for p in reader.partitions(first, reader.latestOffset())] == [1007]


def test_throttle_stream_equals_batch(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 600, 300)).round(3)
    pdf = pd.DataFrame({"run": ["a", "b"] * 150, "ts": t})
    got = drain(runs.throttle(stream_of(spark, pdf[:100], pdf[100:]), "run", "ts"))
    want = runlog.throttle(spark.createDataFrame(pdf), "run", "ts").toPandas()
    key = lambda d: sorted(map(tuple, d[["run", "ts"]].to_numpy().tolist()))
    assert key(got) == key(want)
    # The limiter written out as a loop.
    for run in ("a", "b"):
        last, kept = 0.0, []
        for x in pdf[pdf.run == run].ts:
            if x - last >= 15:
                last = x
                kept.append(x)
        assert sorted(want[want.run == run].ts) == kept


def test_throttle_splits_a_hot_run(spark, monkeypatch):
    monkeypatch.setattr(runlog, "fit_width", lambda *a, **k: 1.0)
    rng = np.random.default_rng(2)
    beats = np.sort(np.concatenate([rng.uniform(0, 3000, 6000), np.arange(0, 3000, 15.0)]))
    pdf = pd.DataFrame({"run": ["hot"] * len(beats) + ["b"] * 3, "ts": [*beats, 3.0, 20.0, 20.0]})
    want = runlog.throttle(spark.createDataFrame(pdf), "run", "ts").toPandas()
    last, kept = 0.0, []
    for x in beats:
        if x - last >= 15:
            last = x
            kept.append(x)
    assert sorted(want[want.run == "hot"].ts) == kept and list(want[want.run == "b"].ts) == [20.0]


def test_throttle_stream_orders_the_whole_micro_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        pdf = pd.DataFrame({"run": "a", "ts": [80.0, 60.0, 20.0, 40.0, 30.0, 16.0]})
        got = drain(runs.throttle(stream_of(spark, pdf), "run", "ts"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got.ts) == [16.0, 40.0, 60.0, 80.0]


def test_stale_alert_and_recovery(spark):
    base = pd.Timestamp("2024-01-01")
    at = lambda *s: [base + pd.Timedelta(seconds=x) for x in s]
    first = pd.DataFrame({"run": ["a", "b"], "at": at(0, 0), "status": ["running", "done"]})
    later = pd.DataFrame({"run": ["c"], "at": at(200), "status": ["running"]})
    back = pd.DataFrame({"run": ["a"], "at": at(300), "status": ["running"]})
    src = stream_of(spark, first, later, back).withColumn("at", F.col("at").cast("timestamp"))
    got = drain(runs.stale_alerts(src.withWatermark("at", "1 second"), "run", "at", "status"))
    assert [tuple(r) for r in got[got.run == "a"][["run", "state"]].to_numpy()] == [("a", "stale"), ("a", "live")]
    assert "b" not in set(got.run)


def test_trips_merge_at_the_gap_limit(spark):
    base = pd.Timestamp("2024-01-01")
    ms = [0, 340, 680, 1021, 1100, 9000]
    pdf = pd.DataFrame({"route": "r", "at": [base + pd.Timedelta(milliseconds=m) for m in ms]})
    end = pd.DataFrame({"route": ["r"], "at": [base + pd.Timedelta(hours=1)]})
    src = stream_of(spark, pdf, end).withColumn("at", F.col("at").cast("timestamp"))
    got = drain(sensors.trips(src, "route", "at", "1 second"))
    assert sorted(got.fixes) == [2, 3]


def test_rolling_telemetry(spark):
    base = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"host": "h", "at": [base + pd.Timedelta(minutes=m) for m in range(20)], "gpu": range(20)})
    end = pd.DataFrame({"host": ["h"], "at": [base + pd.Timedelta(hours=5)], "gpu": [0]})
    src = stream_of(spark, pdf, end).withColumn("at", F.col("at").cast("timestamp"))
    got = drain(sensors.rolling_telemetry(src, "host", "at", ["gpu"], "1 minute"))
    row = got[got.start == base + pd.Timedelta(minutes=5)].iloc[0]
    assert row.samples == 10 and row.gpu_avg == 9.5 and row.gpu_max == 14


def test_stream_alignment_equals_batch(spark):
    base = pd.Timestamp("2024-01-01")
    ft, st = np.arange(0, 20, 0.7), np.array([0.0, 1.5, 3.0, 9.0, 10.5, 12.0])
    when = lambda a: [base + pd.Timedelta(seconds=float(x)) for x in a]
    fixes = pd.DataFrame({"route": "r", "frame": range(len(ft)), "at": when(ft)})
    obd = pd.DataFrame({"route": "r", "at": when(st), "v": st * 10})
    far_f = pd.DataFrame({"route": ["r"], "frame": [999], "at": when([4000])})
    far_s = pd.DataFrame({"route": ["r"], "at": when([4000]), "v": [0.0]})
    cast = lambda d: d.withColumn("at", F.col("at").cast("timestamp"))
    got = drain(
        sensors.align(
            cast(stream_of(spark, fixes, far_f)), cast(stream_of(spark, obd, far_s)), "route", "frame",
            "at", "v", tolerance_s=1.6, reach_s=60, late="1 second",
        )
    )
    got = got[got.frame != 999].sort_values("frame")
    rows = spark.createDataFrame(pd.DataFrame({"route": "r", "frame": range(len(ft)), "t": ft}))
    samples = spark.createDataFrame(pd.DataFrame({"route": "r", "t": st, "v": st * 10}))
    want = asof.interpolate(rows, samples, ["route"], "t", "v", 1.6, "out", width=5.0).toPandas().sort_values("frame")
    assert len(got) == len(want)
    assert np.allclose(got.v.to_numpy(float), want.out.to_numpy(float), equal_nan=True)


def test_alignment_waits_for_far_neighbours(spark):
    """Rows out of order over micro-batches, neighbours hours away, no reach: what the batch form gives."""
    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-01-01")
    st = np.sort(np.concatenate([rng.uniform(0, 100, 20), rng.uniform(20_000, 20_050, 10)])).round(3)
    ft = np.concatenate([rng.uniform(-5, 130, 60), rng.uniform(19_990, 20_060, 30)]).round(3)
    when = lambda a: [base + pd.Timedelta(seconds=float(x)) for x in a]
    obd = pd.DataFrame({"route": ["a", "b"] * 15, "at": when(st), "v": st * 3})
    fixes = pd.DataFrame({"route": ["a", "a", "b"] * 30, "frame": range(90), "at": when(ft)})
    cuts = lambda d, n: [d.iloc[i::n] for i in range(n)]
    far = pd.DataFrame({"route": ["end"], "frame": [999], "at": when([9e6])})
    cast = lambda d: d.withColumn("at", F.col("at").cast("timestamp"))
    got = drain(
        sensors.align(
            cast(stream_of(spark, *cuts(fixes, 3), far)), cast(stream_of(spark, *cuts(obd, 3))), "route", "frame", "at", "v",
            tolerance_s=2.0, late="10 hours", patience_s=1e6,
        )
    )
    got = got[got.frame != 999].sort_values("frame")
    rows = spark.createDataFrame(pd.DataFrame({"route": fixes.route, "frame": fixes.frame, "t": ft}))
    samples = spark.createDataFrame(pd.DataFrame({"route": obd.route, "t": st, "v": obd.v}))
    want = asof.interpolate(rows, samples, ["route"], "t", "v", 2.0, "out", width=5.0).toPandas().sort_values("frame")
    assert list(got.frame) == list(want.frame)
    assert np.allclose(got.v.to_numpy(float), want.out.to_numpy(float), equal_nan=True, atol=1e-6)


def test_alignment_deals_many_routes_over_few_states(spark):
    """A call costs the same for one row as for thousands: states must not grow with the routes."""
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    when = lambda a: [base + pd.Timedelta(seconds=float(x)) for x in a]
    names = [f"r{i}" for i in range(300)]
    ft, st = rng.uniform(0, 3000, 900).round(3), rng.uniform(0, 3000, 1500).round(3)
    fixes = pd.DataFrame({"route": rng.permutation(names * 3), "frame": [f"f{i}" for i in range(900)], "at": when(ft)})
    obd = pd.DataFrame({"route": rng.choice(names, 1500), "at": when(st), "v": st * 3})
    cuts = lambda d, n: [d.iloc[i::n] for i in range(n)]
    far = pd.DataFrame({"route": ["end"], "frame": ["end"], "at": when([9e6])})
    cast = lambda d: d.withColumn("at", F.col("at").cast("timestamp"))
    aligned = sensors.align(
        cast(stream_of(spark, *cuts(fixes, 2), far)), cast(stream_of(spark, *cuts(obd, 3))), "route", "frame", "at", "v",
        tolerance_s=200.0, late="10 hours", patience_s=1e6, slots=16,
    )
    q = aligned.writeStream.format("memory").queryName("few_states").option("checkpointLocation", scratch()).start()
    q.processAllAvailable()
    states = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    q.stop()
    assert 1 <= max(states) <= 16
    got = spark.table("few_states").where("frame <> 'end'").toPandas().sort_values("frame")
    rows = spark.createDataFrame(pd.DataFrame({"route": fixes.route, "frame": fixes.frame, "t": ft}))
    samples = spark.createDataFrame(pd.DataFrame({"route": obd.route, "t": st, "v": obd.v}))
    want = asof.interpolate(rows, samples, ["route"], "t", "v", 200.0, "out", width=5.0).toPandas().sort_values("frame")
    assert list(got.frame) == list(want.frame) and list(got.route) == list(want.route)
    assert 0 < want.out.notna().sum() < 900
    assert np.allclose(got.v.to_numpy(float), want.out.to_numpy(float), equal_nan=True, atol=1e-6)


def test_alignment_keeps_fixes_without_route_or_time(spark):
    schema = "route bigint, frame bigint, at timestamp, v double"
    base = datetime.datetime(2024, 1, 1)
    folder = scratch()
    big = 2**53 + 1  # not a float
    fixes = [(big, big, base, None), (None, 1, base, None), (big, 2, None, None), (-1, 3, base + datetime.timedelta(days=99), None)]
    points = [(big, None, base, 5.0), (None, None, base, 7.0)]
    spark.createDataFrame(fixes + points, schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).parquet(folder)
    got = drain(sensors.align(source.where("v is null"), source.where("v is not null"), "route", "frame", "at", "v", tolerance_s=1, late="1 day", patience_s=60))
    plain = lambda x: None if pd.isna(x) else x
    assert {int(f): plain(v) for f, v in zip(got.frame, got.v) if f != 3} == {big: 5.0, 1: None, 2: None}


def test_latest_values_stream(spark):
    pdf = pd.DataFrame({"run": "r", "name": ["l", "l", "m"], "value": [1.0, 2.0, 5.0], "pos": [0, 1, 2]})
    got = drain(runs.latest_values(stream_of(spark, pdf), ["run", "name"], "value", "pos"), "complete")
    assert dict(zip(got.name, got.latest)) == {"l": 2.0, "m": 5.0}


