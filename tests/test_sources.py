"""Sources on small generated trees."""

import io
import os
import struct
import tarfile
import tempfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackhouse.operators import governance as gov
from trackhouse.operators import taxonomy
from trackhouse.plans import inventory, labelling
from trackhouse.sources import documents, files, logs, manifest, shards, tables, tree, waypoints


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(root, rel, text=""):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def clock(t):
    s = int(t)
    return f"{s // 3600:02d}-{s // 60 % 60:02d}-{s % 60:02d}-{round((t - s) * 1e6):06d}"


def sensor_tree():
    """One route: GPS split over two tables (comma and semicolon), OBD in km/h 19800 s behind."""
    root = scratch()
    t0, n = 32400.0, 900
    t = t0 + np.arange(n) / 15
    lat, lon = np.full(n, 17.5), 78.4 + 10 * np.arange(n) / 15 / 106170
    head = ["timestamp", "image_idx", "latitude", "longitude"]
    rows = [[clock(x), f"{i:07d}", repr(float(a)), repr(float(b))] for i, (x, a, b) in enumerate(zip(t, lat, lon))]
    rows[5][2] = "bad"
    text = lambda rs, sep: "\n".join(sep.join(r) for r in rs) + "\n"
    put(root, "primary/d0/train.csv", text([head, *rows[:600]], ","))
    put(root, "primary/d0/val.csv", text([[" " + h for h in head], *rows[600:]], ";"))
    put(root, "primary/d0/test.csv", "timestamp,image_idx\n09-00-00-1,1\n")
    ot = t0 - 19800 + 20 + np.arange(0, 38, 1.5)
    obd = [["timestamp", "speed", "rpm"], *[[clock(x), "36.0", "900"] for x in ot]]
    put(root, "obd/d0/obd.csv", text(obd, ","))
    for i in range(3):
        put(root, f"primary/d0/leftCamImgs/{i:07d}.jpg", b"x")
    put(root, "primary/d0/rightCamImgs/0000000.jpg", b"x")
    put(root, "lidar/d0/0.npy", b"xx")
    put(root, "primary/d0/empty.csv", "")
    return root


def test_discover_confirm_and_label(spark):
    root = sensor_tree()
    found = inventory.discover(spark, root)
    got = {os.path.basename(r.path): (r.kind, r.route, r.delimiter, r.rows) for r in found.tables.collect()}
    assert got["train.csv"] == ("gps", "d0", ",", 600)
    assert got["val.csv"] == ("gps", "d0", ";", 300)
    assert got["test.csv"][0] == "unknown"
    assert got["obd.csv"][:2] == ("obd", "d0")
    assert [r.error for r in tables.empty_tables(spark, root, found.tables, inventory.TABLE_GLOB).collect()] == ["file is empty"]
    assert {(r.path, r.side) for r in found.image_dirs.collect()} == {
        ("primary/d0/leftCamImgs", "left"), ("primary/d0/rightCamImgs", "right")
    }
    assert found.lidar_dirs.count() == 1

    fields = inventory.propose_field_map(found)
    rows = {r.field: r for r in fields.collect()}
    assert rows["gps.lat"].proposed == "latitude" and rows["gps.lat"].confidence == "exact"
    assert rows["clock_offset"].proposed == "19800"
    assert rows["obd_tolerance"].proposed == "1.5"
    assert gov.pending(fields).count() == 8
    with pytest.raises(ValueError, match="gps.time"):
        gov.require_confirmed(fields)
    confirmed, changed = gov.confirm_all(fields)
    assert changed.count() == fields.count()
    gov.require_confirmed(confirmed)
    with pytest.raises(ValueError, match="Known routes"):
        gov.require_confirmed(confirmed, "d9")

    recs = tables.records(found.lines, found.tables)
    gps = tables.gps_rows(recs, inventory.mappings(confirmed, found, "gps"))
    assert gps.count() == 899
    obd_map = inventory.mappings(confirmed, found, "obd")
    obd = tables.obd_rows(recs, obd_map)
    assert obd.agg(F.min("t")).first()[0] == pytest.approx(32420.0)
    synced = labelling.synchronise(
        gps.select("route", "frame", "t", "lat", "lon"), obd,
        obd_map.select("route", "tolerance_s").distinct(),
    )
    done = labelling.run(synced)
    assert done.units.first().unit == "km/h"
    frames = done.frames.toPandas()
    assert len(frames) == 899 - 38
    # The dropped row leaves an uneven step near the start.
    assert np.allclose(frames[frames.frame > 30].speed_mps, 10, atol=0.05)

    out = scratch() + "/wp"
    waypoints.write_waypoints(done.frames, out)
    assert waypoints.read_waypoints(spark, out, "d0").count() == len(frames)
    assert waypoints.read_waypoints(spark, out).schema["route"].dataType.simpleString() == "string"

    def score(pdf):
        return pd.Series([[float(v)] for v in pdf.speed_mps])

    def torn(pdf):
        return pd.Series([None] * len(pdf))

    withpath = waypoints.read_waypoints(spark, out).withColumn("frame_path", F.col("frame").cast("string"))
    place = scratch() + "/c"
    for _ in range(2):  # a failed build leaves nothing that a second call would take
        with pytest.raises(ValueError, match="could not be read"):
            waypoints.feature_cache(withpath, place, torn, ["speed_mps"])
    cache = waypoints.feature_cache(withpath, place, score, ["speed_mps"])
    assert cache.count() == len(frames) and cache.where("features IS NULL").isEmpty()
    # A second call reads what the first wrote; other frames and other scorers do not.
    assert waypoints.feature_cache(withpath, place, torn, ["speed_mps"]).count() == len(frames)
    fewer = withpath.where("frame > 40")
    assert waypoints.feature_cache(fewer, place, score, ["speed_mps"]).count() == fewer.count()
    with pytest.raises(ValueError, match="could not be read"):
        waypoints.feature_cache(withpath, place, torn, ["speed_mps"], version="2")


def test_confirmations_survive_only_unchanged(spark):
    root = sensor_tree()
    fields = inventory.propose_field_map(inventory.discover(spark, root))
    confirmed, _ = gov.confirm_all(fields)
    moved = fields.withColumn(
        "proposed", F.when(F.col("field") == "gps.lat", "lat2").otherwise(F.col("proposed"))
    )
    after = {r.field: r.state for r in gov.carry_forward(moved, confirmed).collect()}
    assert after.pop("gps.lat") == "unconfirmed" and set(after.values()) == {"confirmed"}
    edited = gov.set_field(fields, "d0", "gps.time", column="image_idx")
    row = edited.where("field = 'gps.time'").first()
    assert (row.proposed, row.confidence, row.state) == ("image_idx", "manual", "confirmed")
    with pytest.raises(ValueError, match="the columns are"):
        gov.set_field(fields, "d0", "gps.time", column="nope")


def test_manifest_versions(spark):
    """Nested documents read back, edits and re-scans keep confirmations, and late writers are told."""
    root, folder = sensor_tree(), scratch()
    found = inventory.discover(spark, root)
    fields = inventory.propose_field_map(found)
    tabs = found.tables.select("path", "route", "kind", "rows", "columns")
    with pytest.raises(FileNotFoundError):
        manifest.read(spark, folder)
    assert manifest.save(fields, folder, tabs) == 1
    documents, version = manifest.read(spark, folder)
    assert version == 1 and {r.kind for r in documents.collect()} == {"route", "table"}
    key = lambda df: sorted((r.route, r.field, r.proposed or "", r.state, str(r.columns)) for r in df.collect())
    assert key(manifest.field_map(documents)) == key(fields)
    assert manifest.tables(documents).count() == tabs.count()

    assert manifest.edit(spark, folder, lambda f: gov.confirm_all(f)[0]) == 2
    gov.require_confirmed(manifest.field_map(manifest.read(spark, folder)[0]))
    moved = fields.withColumn("proposed", F.when(F.col("field") == "gps.lat", "lat2").otherwise(F.col("proposed")))
    assert manifest.save(moved, folder, tabs) == 3
    states = {r.field: r.state for r in manifest.field_map(manifest.read(spark, folder)[0]).collect()}
    assert states.pop("gps.lat") == "unconfirmed" and set(states.values()) == {"confirmed"}
    assert key(manifest.field_map(manifest.read(spark, folder, 1)[0])) == key(fields)

    # Two who read version 3: the second is told, and what the first wrote stays.
    late = manifest.compose(fields, tabs)
    assert manifest.edit(spark, folder, lambda f: gov.set_field(f, "d0", "gps.lat", column="longitude")) == 4
    with pytest.raises(manifest.ManifestConflict, match="not the latest"):
        manifest.write(late, folder, 3)
    # A number that is taken but not filled: not read, not overwritten, but cleared once its writer is long gone.
    claim = put(folder, "00000005.version", "")
    assert manifest.current(spark, folder) == 4
    with pytest.raises(manifest.ManifestConflict, match="being published"):
        manifest.write(late, folder, 4)
    os.utime(claim, (1, 1))
    assert manifest.write(late, folder, 4) == 5 and manifest.current(spark, folder) == 5


def test_annotated_tree(spark):
    root = scratch()
    for i in range(30):
        put(root, f"leftImg8bit/train/s{i % 3}/{i:04d}_leftImg8bit.{'png' if i % 2 else 'jpg'}", b"x")
        if i < 5:
            put(root, f"gtFine/train/s{i % 3}/{i:04d}_gtFine_polygons.json", "{}")
    put(root, "gtFine/val/s0/0001_gtFine_polygons.json", "{}")
    put(root, "leftImg8bit/test/s9/0001_leftImg8bit.png", b"x")
    report, checks = inventory.annotated_report(spark, root)
    rows = {r.split: r for r in report.collect()}
    assert (rows["train"].images, rows["train"].polygons, rows["train"].sequences) == (30, 5, 3)
    assert rows["train"].n_without_polygons == 25 and len(rows["train"].without_polygons) == 20
    assert rows["val"].n_without_images == 1
    from trackhouse.operators.checks import roll_up

    verdict = roll_up(checks).first()
    assert not verdict.ok and set(verdict.blocking_failures) == {"pairing.train", "pairing.val"}
    assert len(verdict.warnings) == 3


def png(grey):
    h, w = grey.shape
    raw = b"".join(b"\0" + row.tobytes() for row in grey)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(
        b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_masks_shards_and_lut(spark):
    root = scratch()
    grey = np.array([[0, 1, 1], [255, 7, 0]], np.uint8)
    put(root, "a.png", png(grey))
    counts = {r.level3_id: r.n for r in documents.pixel_counts(documents.images(spark, root)).collect()}
    assert counts == {0: 2, 1: 2, 7: 1, 255: 1}

    rows = [(f"s_{i:03d}", f"s{i % 2}", b"j%d" % i, b"p%d" % i) for i in range(23)]
    samples = spark.createDataFrame(rows, "key string, sequence string, image binary, mask binary")
    out = scratch()
    stats = shards.pack(samples, "train", out, per_shard=10).toPandas().sort_values("shard")
    assert list(stats.samples) == [10, 10, 3]
    assert sorted(os.listdir(out + "/train")) == [f"train-{i:05d}.tar" for i in range(3)]
    back = {r.key: (bytes(r.image), bytes(r["mask"])) for r in shards.read_samples(spark, out).collect()}
    assert back == {k: (i, m) for k, _, i, m in rows}
    index = shards.read_samples(spark, out, with_data=False)
    assert index.where("image.size > 0 AND mask.offset > 0").count() == 23

    odd = scratch()
    with tarfile.open(odd + "/x.tar", "w") as tar:
        info = tarfile.TarInfo("k.jpg")
        info.size = 1
        tar.addfile(info, io.BytesIO(b"1"))
    with pytest.raises(ValueError, match="unpaired"):
        shards.read_samples(spark, odd)

    groups = taxonomy.group_table(spark)
    names = [m for _, ms in taxonomy.GROUPS for m in ms]
    ids = {m: i for i, m in enumerate(names)}
    labels = spark.createDataFrame(
        [(n.upper(), ids[n]) for n in names] + [(n, 255) for n in taxonomy.IGNORE_NAMES], "name string, level3_id int"
    )
    lut = taxonomy.build_lut(labels, groups)
    assert lut.count() == len(names) + 1
    assert '"num_classes":8' in taxonomy.lut_document(lut, labels, groups).first().value
    with pytest.raises(ValueError, match="do not resolve"):
        taxonomy.build_lut(labels.where("name <> 'ROAD'"), groups)
    with pytest.raises(ValueError, match="no group"):
        taxonomy.build_lut(labels.union(spark.sql("SELECT 'boat', 99")), groups)


def test_event_log_rules(spark):
    root = scratch()
    lines = [
        "", "garbage", "[1]", '{"type":5}', '{"type":"sc', '{"ts":1}', '{"type":"x","ts":"late"}',
        '{"type":"scalar","name":"l","value":NaN,"step":3,"ts":1.5}', '{"type":"new","extra":1,"ts":true}',
        '{"type":"epoch","epoch":2,"secs":4.5,"eta_min":1,"ts":9}',
    ]
    put(root, "20240101-000000_seg_a/events.jsonl", "\n".join(lines))
    got = logs.read_events(spark, root).orderBy("pos").collect()
    assert [(r.type, r.ts) for r in got] == [("x", 0.0), ("scalar", 1.5), ("new", 1.0), ("epoch", 9.0)]
    assert got[1].value == "NaN" and got[1].step == 3 and got[3].secs == 4.5 and "extra" in got[2].raw
    assert {r.run for r in got} == {"20240101-000000_seg_a"}
    runs = files.run_catalogue(files.file_tree(spark, root))
    row = runs.first()
    assert (row.kind, row.tag, str(row.started)) == ("seg", "a", "2024-01-01 00:00:00")
    assert files.find_run(runs, "latest") == "20240101-000000_seg_a"
    with pytest.raises(FileNotFoundError, match="Available"):
        files.find_run(runs, "zzz")


def test_telemetry_and_latency_reports(spark):
    root = scratch()
    put(root, "t.log", "RAM 8192/65536MB CPU [18%@729,12%@729] GR3D_FREQ 5% soc0@49.25C tj@51.5C VDD 3588mW/1mW/2mW VIN 12mW/1mW/1mW\njunk\n")
    rows = logs.read_telemetry(spark, root).orderBy("pos").collect()
    assert (rows[0].gpu_pct, rows[0].ram_used_mb, rows[0].cpu_pct) == (5, 8192, [18, 12])
    assert rows[0].temps_c == {"soc0": 49.25, "tj": 51.5} and rows[0].power_mw == {"VDD": 3588, "VIN": 12}
    assert rows[1].gpu_pct is None and rows[1].temps_c == {}

    good = (
        "[I] Throughput: 258.5 qps\n"
        "[I] Latency: min = 1.5 ms, max = 9 ms, mean = 4.4 ms, median = 4.3 ms, percentile(90%) = 4.6 ms, percentile(99%) = 6.6 ms\n"
        "[I] GPU Compute Time: min = 1 ms, max = 8 ms, mean = 4 ms, median = 4.1 ms\n"
        "[I] D2H Latency: min = 0.005 ms, max = 0.1 ms, mean = 0.01 ms, median = 0.01 ms, percentile(99%) = 0.025 ms\n"
        "[I] Total GPU Compute Time: 3.0 s\n[W] coefficient of variance = 28.1%\n"
    )
    put(root, "bench/a.txt", good)
    summary = logs.latency_summary(logs.read_latency_reports(spark, root + "/bench"))
    r = summary.first()
    assert (r.p50_ms, r.p99_ms, r.gpu_compute_ms, r.throughput_qps, r.compute_variance_pct) == (4.3, 6.6, 4.1, 258.5, 28.1)
    logs.require_monotonic(summary)
    put(root, "bad/b.txt", good.replace("percentile(90%) = 4.6", "percentile(90%) = 1.6"))
    with pytest.raises(ValueError, match="monotonic"):
        logs.require_monotonic(logs.latency_summary(logs.read_latency_reports(spark, root + "/bad")))


def test_tree_lists_every_file(spark, monkeypatch):
    """Empty files, names that Spark hides, odd names, links, and branches of all shapes, in shares of 1."""
    root = scratch()
    want = {}
    for i in range(60):
        rel = f"{'_h' if i % 3 == 0 else '.d' if i % 3 == 1 else 'p'}{i % 4}/s {i % 5}#%/" * (i % 4) + f"{['', '_', '.'][i % 3]}f{i}{['.JPG', '', '.csv'][i % 3]}"
        want[rel] = i % 6
        put(root, rel, b"x" * (i % 6))
    deep = "/".join("d" * 30)
    want[f"{deep}/end.bin"] = 1
    put(root, f"{deep}/end.bin", b"x")
    os.makedirs(os.path.join(root, "empty/inner"))
    os.symlink(root, os.path.join(root, "empty/loop"))
    for first, later in ((32, 512), (1, 1), (2, 3)):
        monkeypatch.setattr(tree, "FIRST_ROUND", first)
        monkeypatch.setattr(tree, "LATER_ROUNDS", later)
        rows = files.file_tree(spark, root).collect()
        assert len(rows) == len(want) and {r.rel: r.length for r in rows} == want
    by_rel = {r.rel: r for r in rows}
    r = by_rel[f"{deep}/end.bin"]
    assert (r.dir, r.name, r.suffix, r.kind) == (deep, "end.bin", ".bin", "lidar")
    assert open(r.path.removeprefix("file:"), "rb").read() == b"x" and abs(r.modified.timestamp() - os.path.getmtime(r.path.removeprefix("file:"))) < 86400
    assert files.file_tree(spark, os.path.join(root, "empty")).collect() == []
    with pytest.raises(FileNotFoundError):
        files.file_tree(spark, root + "/none")


class Counting(io.FileIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        Counting.read_bytes += len(data)
        return data


def test_shard_index_reads_headers_only():
    path = scratch() + "/big.tar"
    rng = np.random.default_rng(0)
    with tarfile.open(path, "w") as tar:
        for i in range(40):
            for ext in ("png", "jpg"):
                info = tarfile.TarInfo(f"s{i:03d}.{ext}" if i else "long/" * 40 + f"name.{ext}")
                info.size = 150_000
                tar.addfile(info, io.BytesIO(rng.bytes(150_000)))
    with Counting(path) as stream:
        found = shards.tar_places(stream)
    assert len(found) == 40 and Counting.read_bytes < 0.01 * os.path.getsize(path)
    with open(path, "rb") as f, tarfile.open(path) as tar:
        place = found["s007"]["png"]
        f.seek(place["offset"])
        assert f.read(place["size"]) == tar.extractfile("s007.png").read()


def test_pack_gates_collapses_and_counts(spark):
    rng = np.random.default_rng(1)
    masks = {f"a_{i:03d}": rng.choice([0, 1, 5, 255], (3 + i % 4, 5)).astype(np.uint8) for i in range(23)}
    rows = [(k, f"s{i % 3}", b"j%d" % i, m.tobytes(), m.shape[1], m.shape[0]) for i, (k, m) in enumerate(masks.items())]
    samples = spark.createDataFrame(rows, "key string, sequence string, image binary, mask binary, width int, height int").repartition(3)
    lut = spark.createDataFrame([(0, 0), (1, 1), (5, 1), (255, 255)], "level3_id int, train_id int")
    out = scratch()
    stats = shards.pack(samples, "train", out, per_shard=10, lut=lut, classes=range(3)).toPandas().sort_values("shard")
    every = np.concatenate([m.ravel() for m in masks.values()])
    assert np.sum(stats.class_pixels.tolist(), axis=0).tolist() == [(every == 0).sum(), np.isin(every, (1, 5)).sum(), 0]
    assert stats.ignore_pixels.sum() == (every == 255).sum() and list(stats.samples) == [10, 10, 3]
    assert list(stats.bytes) == [os.path.getsize(f"{out}/train/{n}") for n in stats.shard]
    got = {r.key: bytes(r["mask"]) for r in shards.read_samples(spark, out).collect()}
    put(out, "png/x.png", got["a_004"])
    shown = documents.images(spark, out + "/png").first()
    want = np.where(masks["a_004"] == 5, 1, masks["a_004"])
    assert (np.frombuffer(shown.data, np.uint8).reshape(shown.height, shown.width) == want).all()

    # An unknown id stops the run: nothing is published, and what was packed before stays.
    before = sorted(os.listdir(out + "/train"))
    with pytest.raises(Exception, match=r"a_0.*outside the taxonomy: \[5\]"):
        shards.pack(samples, "train", out, per_shard=10, lut=lut.where("level3_id <> 5"))
    assert sorted(os.listdir(out + "/train")) == before
    with pytest.raises(Exception, match="two samples have the key"):
        shards.pack(samples.union(samples.where("key = 'a_001'")), "val", out, per_shard=10)
    assert os.listdir(out + "/val") == [] if os.path.isdir(out + "/val") else True
    # Packing anew replaces the shards of the split.
    assert shards.pack(samples.where("key < 'a_010'"), "train", out, per_shard=4).count() == 3
    assert sorted(os.listdir(out + "/train")) == [f"train-{i:05d}.tar" for i in range(3)]


def test_runs_of_many_shards(spark, monkeypatch):
    """Few runs of several shards each number and fill shards just the same."""
    monkeypatch.setattr(shards, "MOST_RUNS", 3)
    rows = [(f"k{i:03d}", None, b"j%d" % i, b"p%d" % i) for i in range(47)]
    samples = spark.createDataFrame(rows, "key string, sequence string, image binary, mask binary").repartition(4)
    out = scratch()
    stats = shards.pack(samples, "t", out, per_shard=5).toPandas().sort_values("shard")
    assert list(stats.samples) == [5] * 9 + [2] and list(stats.shard) == [f"t-{i:05d}.tar" for i in range(10)]
    where = {r.key: os.path.basename(r.shard) for r in shards.read_samples(spark, out, with_data=False).collect()}
    assert where == {f"k{i:03d}": f"t-{i // 5:05d}.tar" for i in range(47)}


def test_governance_joins_no_tables_of_routes(spark):
    """Open fields are told from each route's own rows; an edit looks at its own route alone."""
    rows = [
        ("a", "gps.time", "t", "confirmed"), ("a", "gps.lat", "lat", "unconfirmed"), ("a", "gps.lat", "lat2", "unconfirmed"),
        ("a", "gps.lon", "lon", None), ("a", "obd.time", "t", "confirmed"), ("a", "clock_offset", "0", "unconfirmed"),
        ("a", "obd_tolerance", "1", None), ("b", "gps.time", "t", "unconfirmed"), ("b", "clock_offset", "0", "unconfirmed"), ("c", "obd.time", "t", "unconfirmed"),
    ]
    fields = spark.createDataFrame(rows, "route string, field string, proposed string, state string")
    found = gov.pending(fields)
    assert sorted((r.route, r.field, r.proposed or "") for r in found.collect()) == sorted(
        [("a", "gps.lat", "lat"), ("a", "gps.lat", "lat2"), ("a", "gps.lon", "lon"), ("a", "gps.frame", ""), ("a", "obd.speed", ""), ("a", "clock_offset", "0")]
        + [("b", "gps.time", "t"), ("b", "gps.lat", ""), ("b", "gps.lon", ""), ("b", "gps.frame", "")]
    )
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(found)
    edits = spark.createDataFrame([("a", "gps.time", "nope")], "route string, field string, column string")
    problems = gov.edit_problems(fields.withColumn("columns", F.array(F.lit("t"))), edits)
    assert plan(problems).count("LeftSemi") == 3 and problems.first().problem == "unknown column; the columns are t"


def test_confirmation_gate_joins_nothing(spark):
    from trackhouse.catalog.files import confirmation_gate

    assert "Join" not in confirmation_gate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_waypoint_files_do_not_grow_with_routes(spark):
    """Files are as many as there are tasks, and a second write replaces only the routes that it has."""
    place = scratch() + "/many"
    rows = spark.range(1200).select(F.concat(F.lit("0"), F.col("id") % 300).alias("route"), F.col("id").cast("double").alias("t"), "id")
    waypoints.write_waypoints(rows, place)
    files = [f for _, _, names in os.walk(place) for f in names if f.endswith(".parquet")]
    assert len(files) <= 8 and waypoints.read_waypoints(spark, place).count() == 1200
    waypoints.write_waypoints(rows.where("route = '07'").limit(1).withColumn("id", F.lit(-1).cast("long")), place)
    assert [r.id for r in waypoints.read_waypoints(spark, place, "07").collect()] == [-1]
    both = waypoints.read_waypoints(spark, place)
    assert both.count() == 1197 and both.columns == ["route", "t", "id"]


def test_a_line_is_parsed_once(spark):
    """One parse of a line for every delimiter, however many columns it has."""
    path = put(scratch(), "one.csv", "a,b,c,d\n1,2,3,4\n")
    lines = tables.raw_lines(spark, path)
    rows = tables.records(lines, tables.sniff(lines))
    assert optimized(rows).count("from_csv(") == 3 and rows.first().cells == ["1", "2", "3", "4"]


def test_latency_reports_are_read_once(spark):
    from trackhouse.sources import logs

    report = "Throughput: 5 qps\nLatency: min = 1 ms, max = 4 ms, median = 2 ms\nLatency: min = 2 ms, max = 4 ms\nThroughput: 7 qps\nLatency: none\n"
    found = logs.read_latency_reports(spark, put(scratch(), "r.txt", report))
    assert optimized(found).count("Relation [") == 1
    (row,) = found.collect()
    assert (row.section, row.stats, row.throughput_qps, row.compute_variance_pct) == ("Latency", {"min": 2.0, "max": 4.0}, 5.0, None)


def test_files_are_written_by_the_tasks(spark):
    from trackhouse.catalog.files import _write_files

    root = scratch()
    _write_files(spark.createDataFrame([(f"d{i % 3}/_f{i}", b"x" * i) for i in range(20)], "rel string, data binary"), root)
    assert sorted((n, os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(root) for n in names) == sorted((f"_f{i}", i) for i in range(20))
