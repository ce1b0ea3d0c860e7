"""Sources and sinks (A series) and governance (J series).

Each query writes files from the given tables into the shared scratch folder and reads them back
through the source under test, so its work grows with the tables.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trackhouse.catalog.base import events, query, table
from trackhouse.functions.text import frame_path
from trackhouse.operators import governance as gov
from trackhouse.operators import roles
from trackhouse.plans import segmentation
from trackhouse.session import ensure_checkpoint_dir
from trackhouse.sources import documents, files, logs, manifest, shards, storage, tables, waypoints
from trackhouse.sources.tail import TailSource
from trackhouse.streaming import sensors


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write_csv(df, path: str) -> str:
    """The same rows as three sets of files, one per delimiter."""
    for i, sep in enumerate((",", ";", "\t")):
        part = df.where(F.col("_set") == i).drop("_set")
        part.write.option("header", "true").option("sep", sep).csv(f"{path}/set{i}")
    return path


def _gps(spark, sf_dir):
    ntz = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.date_format(ntz, "HH-mm-ss-SSSSSS").alias("timestamp"),
        F.when(F.col("event_id") % 17 == 0, "none").otherwise(F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("image_idx"),
        F.col("value").alias("latitude"),
        (F.col("value") * 2).alias("longitude"),
        (F.col("event_id") % 3).alias("_set"),
    )


@query(
    "a1_sniffed_tables",
    """SELECT CASE event_id % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter, count(*) AS rows,
       4 AS columns FROM events GROUP BY event_id % 3""",
)
def sniffed_tables(spark, sf_dir):
    root = _write_csv(_gps(spark, sf_dir), scratch(spark, "csv"))
    found = tables.sniff(tables.raw_lines(spark, root))
    return found.groupBy("delimiter").agg(
        F.sum("rows").alias("rows"), F.max(F.size("columns")).alias("columns")
    )


@query(
    "b7_column_roles",
    """SELECT DISTINCT event_id % 3 AS set, r.* FROM events, (VALUES ('time', 'timestamp', 'exact'), ('lat', 'latitude', 'exact'),
       ('lon', 'longitude', 'exact'), ('frame', 'image_idx', 'exact')) AS r(role, "column", confidence)""",
)
def column_roles(spark, sf_dir):
    root = _write_csv(_gps(spark, sf_dir), scratch(spark, "csv"))
    found = tables.sniff(tables.raw_lines(spark, root))
    matched, _ = tables.describe(found)
    part = F.regexp_extract("path", r"/set(\d)/", 1).cast("bigint")
    return matched.select(part.alias("set"), "role", "column", "confidence").distinct()


@query(
    "b7_role_of_names",
    """SELECT doc_id, CASE WHEN regexp_matches(lower(source), '^src1') THEN 'one' WHEN regexp_matches(lower(source), '^.*2.*') THEN 'two' END AS role,
       CASE WHEN regexp_matches(lower(source), '^src1$') OR regexp_matches(lower(source), '^src2$') THEN 'exact' ELSE 'fuzzy' END AS confidence
       FROM documents WHERE regexp_matches(lower(source), '^src1') OR regexp_matches(lower(source), '^.*2.*')
         AND NOT regexp_matches(lower(source), '^src1')""",
)
def role_of_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("pos"))
    patterns = {"one": (r"^src1$", r"^$", r"^src1.*"), "two": (r"^src2$", r"^$", r"^(?!src1).*2.*")}
    return roles.match_roles(docs, "doc_id", "pos", "source", patterns).select("doc_id", "role", "confidence")


@query(
    "b8_table_kind",
    """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'gps'
       WHEN bool_or(o_orderstatus = 'P') THEN 'obd' ELSE 'unknown' END AS kind FROM orders GROUP BY 1""",
)
def table_kind(spark, sf_dir):
    role = F.when(F.col("o_orderstatus") == "F", "lat").when(F.col("o_orderstatus") == "O", "lon").otherwise("speed")
    rows = table(spark, sf_dir, "orders").select("o_custkey", role.alias("role"))
    return roles.table_kinds(rows, "o_custkey")


@query(
    "a2_gps_rows",
    """SELECT event_id AS frame, round((epoch_us(ts) % 86400000000) / 1e6::DOUBLE, 6) AS t, value AS lat, value * 2 AS lon
       FROM events WHERE event_id % 17 <> 0""",
)
def gps_rows(spark, sf_dir):
    root = _write_csv(_gps(spark, sf_dir), scratch(spark, "gps"))
    lines = tables.raw_lines(spark, root)
    found = tables.sniff(lines)
    names = {"time": "timestamp", "lat": "latitude", "lon": "longitude", "frame": "image_idx"}
    mapping = found.select("path", F.lit("r").alias("route"), *[F.lit(c).alias(r) for r, c in names.items()])
    out = tables.gps_rows(tables.records(lines, found), mapping)
    return out.select("frame", F.round("t", 6).alias("t"), "lat", "lon")


@query(
    "a3_obd_rows",
    "SELECT round((epoch_us(ts) % 86400000000) / 1e6::DOUBLE + 19800, 6) AS t, value AS speed FROM events",
)
def obd_rows(spark, sf_dir):
    rows = _gps(spark, sf_dir).select("timestamp", F.col("latitude").alias("speed"), "_set")
    root = _write_csv(rows, scratch(spark, "obd"))
    lines = tables.raw_lines(spark, root)
    found = tables.sniff(lines)
    mapping = found.select(
        "path", F.lit("r").alias("route"), F.lit("timestamp").alias("time"), F.lit("speed").alias("speed"),
        F.lit(19800.0).alias("offset_s"),
    )
    out = tables.obd_rows(tables.records(lines, found), mapping.withColumnRenamed("speed", "speed"))
    return out.select(F.round("t", 6).alias("t"), "speed")


@query(
    "a4_file_tree",
    """WITH p AS (SELECT *, 'm' || p_size % 5 || '/' || p_brand AS dir, p_partkey % 3 AS h, p_partkey % 4 AS s FROM part),
       n AS (SELECT *, CASE h WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || 'f' || p_partkey || CASE s WHEN 0 THEN '.JPG' WHEN 1 THEN '.csv' WHEN 2 THEN '.npy' ELSE '' END AS name FROM p)
       SELECT dir || '/' || name AS rel, dir, name, CASE s WHEN 0 THEN '.jpg' WHEN 1 THEN '.csv' WHEN 2 THEN '.npy' ELSE '' END AS suffix,
         CASE s WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'lidar' ELSE 'other' END AS kind,
         CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS length FROM n""",
)
def file_tree(spark, sf_dir):
    """A file per part: a third of the names start with ``_``, a third with ``.``, and a seventh is empty."""
    return files.file_tree(spark, _part_files(spark, sf_dir)).drop("path", "modified")


def _part_files(spark, sf_dir) -> str:
    root = scratch(spark, "tree")
    key = F.col("p_partkey")
    head = F.when(key % 3 == 0, "_").when(key % 3 == 1, ".").otherwise("")
    tail = F.when(key % 4 == 0, ".JPG").when(key % 4 == 1, ".csv").when(key % 4 == 2, ".npy").otherwise("")
    rel = F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"), F.lit("/"), "p_brand", F.lit("/"), head, F.lit("f"), key.cast("string"), tail)
    length = F.when(key % 7 == 0, 0).otherwise(F.col("p_size")).cast("bigint")
    data = F.encode(F.repeat(F.lit("x"), length.cast("int")), "utf-8")
    _write_files(table(spark, sf_dir, "part").select(rel.alias("rel"), data.alias("data")), root)
    return root


def _write_files(rows, root: str) -> None:
    """A file below ``root`` for every row ``rel, data``; read only when the job is done, so a file that is
    written again by a repeated task is the same."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 20_000))

    def put(batches):
        made = set()
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = storage.filesystem(storage.below(root, path))
                folder = place.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(place, compression=None) as out:
                    out.write(data)
            yield batch.slice(0, 0)

    rows.repartition(tasks, "rel").mapInArrow(put, rows.schema).write.format("noop").mode("overwrite").save()


_PATH_SQL = "'cam/' || CASE WHEN length(CAST(event_id AS VARCHAR)) >= 7 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR), 7, '0') END || '.jpg'"


def _frames(spark, sf_dir):
    return events(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("route"),
        (F.col("ts_us") / 1e6).alias("t"),
        "event_id",
        "value",
        frame_path(F.lit("cam"), F.col("event_id"), F.lit("0000000.jpg")).alias("frame_path"),
        F.when(F.col("event_id") % 7 == 0, "val").otherwise("train").alias("split"),
    )


@query(
    "a5_waypoint_sink",
    f"""SELECT 'u' || user_id AS route, count(*) AS frames, round(sum(value), 2) AS total, min({_PATH_SQL}) AS first_path, max({_PATH_SQL}) AS last_path
        FROM events GROUP BY 1""",
)
def waypoint_sink(spark, sf_dir):
    path = scratch(spark, "waypoints")
    waypoints.write_waypoints(_frames(spark, sf_dir), path)
    return waypoints.read_waypoints(spark, path).groupBy("route").agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 2).alias("total"),
        F.min("frame_path").alias("first_path"), F.max("frame_path").alias("last_path"),
    )


@query("a6_waypoint_source", f"SELECT event_id, value, {_PATH_SQL} AS frame_path FROM events WHERE user_id = 3")
def waypoint_source(spark, sf_dir):
    path = scratch(spark, "waypoints")
    waypoints.write_waypoints(_frames(spark, sf_dir), path)
    return waypoints.read_waypoints(spark, path, "u3").select("event_id", "value", "frame_path")


@query(
    "a8_shard_round_trip",
    """SELECT lang || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, md5(text) AS image, md5(source) AS mask,
       'train-' || lpad(CAST((row_number() OVER (ORDER BY lang || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) - 1) // 500 AS VARCHAR), 5, '0') || '.tar' AS shard
       FROM documents""",
)
def shard_round_trip(spark, sf_dir):
    out = scratch(spark, "shards")
    samples = table(spark, sf_dir, "documents").select(
        F.concat("lang", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"),
        F.encode("text", "utf-8").alias("image"),
        F.encode("source", "utf-8").alias("mask"),
    )
    shards.pack(samples, "train", out)
    name = F.element_at(F.split("shard", "/"), -1)
    return shards.read_samples(spark, out).select(
        "key", F.md5("image").alias("image"), F.md5("mask").alias("mask"), name.alias("shard")
    )


@query(
    "a9_json_document",
    "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1",
)
def json_document(spark, sf_dir):
    path = scratch(spark, "report")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )
    documents.write_document(rows, path, key="l_returnflag")
    return documents.read_document(spark, path, "l_returnflag string, n bigint, quantity bigint")


def _event_lines(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_type"))
    line = F.to_json(
        F.struct(
            kind.alias("type"), F.concat(F.lit("s"), "user_id").alias("name"), "value",
            F.col("event_id").alias("step"), F.col("props").alias("extra"),
        )
    )
    torn = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line)
    return events(spark, sf_dir, "event_id", "event_type", "user_id", "value", "props").select(torn.alias("value"))


@query(
    "a10_event_log",
    """SELECT event_type AS type, 's' || user_id AS name, event_id AS step, 0.0::DOUBLE AS ts FROM events
       WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""",
)
def event_log(spark, sf_dir):
    path = scratch(spark, "log")
    _event_lines(spark, sf_dir).write.text(path)
    return logs.read_events(spark, path).select("type", "name", "step", "ts")


@query(
    "a11_tail_stream",
    """SELECT event_type AS type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS steps FROM events
       WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1""",
)
def tail_stream(spark, sf_dir):
    path, out, state = (scratch(spark, n) for n in ("tail", "tailed", "state"))
    _event_lines(spark, sf_dir).write.text(path)
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("tail").option("path", f"{path}/*.txt").load()
    (
        logs.parse_events(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps")
    )


@query(
    "a12_telemetry_log",
    """SELECT CAST(user_id AS INTEGER) AS gpu_pct, CAST(event_id AS INTEGER) AS ram_used_mb, value AS gpu_temp, 2 AS cores FROM events""",
)
def telemetry_log(spark, sf_dir):
    path = scratch(spark, "telemetry")
    line = F.format_string(
        "RAM %d/62817MB CPU [%d%%@729,5%%@1190] GR3D_FREQ %d%% gpu@%sC VDD_IN 10mW/11mW/12mW",
        "event_id", "user_id", "user_id", F.col("value").cast("string"),
    )
    events(spark, sf_dir).select(line.alias("value")).write.text(path)
    return logs.read_telemetry(spark, path).select(
        "gpu_pct", "ram_used_mb", F.try_element_at("temps_c", F.lit("gpu")).alias("gpu_temp"),
        F.size("cpu_pct").alias("cores"),
    )


@query(
    "a13_latency_reports",
    """SELECT user_id, min(value) AS min_ms, max(value) AS max_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
       round(quantile_cont(value, 0.99), 6) AS p99_ms, count(*) / 2.0::DOUBLE AS throughput_qps, true AS monotonic FROM events GROUP BY user_id""",
)
def latency_reports(spark, sf_dir):
    from trackhouse.operators.latency import latency_profile

    path = scratch(spark, "bench")
    p = latency_profile(events(spark, sf_dir), ["user_id"], "value")
    num = lambda c: F.round(c, 6).cast("string")
    report = F.concat(
        F.lit("Throughput: "), num(F.col("samples") / 2), F.lit(" qps\nLatency: min = "), num("min_ms"),
        F.lit(" ms, max = "), num("max_ms"), F.lit(" ms, mean = "), num("mean_ms"), F.lit(" ms, median = "),
        num("p50"), F.lit(" ms, percentile(90%) = "), num("p90"), F.lit(" ms, percentile(99%) = "), num("p99"),
        F.lit(" ms\nTotal GPU Compute Time: 3 s"),
    )
    # A report is a file: written by the tasks themselves, as Spark's writer moves every file once more on the driver.
    name = F.concat(F.lpad((F.col("user_id") % 256).cast("string"), 3, "0"), F.lit("/user_id="), "user_id", F.lit(".txt"))
    _write_files(p.select(name.alias("rel"), F.encode(F.concat(report, F.lit("\n")), "utf-8").alias("data")), path)
    out = logs.latency_summary(logs.read_latency_reports(spark, path))
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("bigint")
    return out.select(
        user.alias("user_id"), "min_ms", "max_ms", "p50_ms", "p99_ms", "throughput_qps", "monotonic"
    )


@query(
    "a15_feature_cache",
    "SELECT CAST(event_id AS VARCHAR) AS frame_path, event_id % 7 = 0 AS is_val, round(value * 2, 2) AS feature FROM events",
)
def feature_cache(spark, sf_dir):
    frames = _frames(spark, sf_dir).withColumn("frame_path", F.col("event_id").cast("string"))

    def score(pdf):
        return pdf["value"].map(lambda v: [v * 2.0])

    cache = waypoints.feature_cache(frames, scratch(spark, "features"), score, ["value"])
    feature = F.round(F.col("features")[0].cast("double"), 2)
    return cache.select("frame_path", "is_val", feature.alias("feature"))


@query(
    "a16_run_catalogue",
    """SELECT DISTINCT strftime(ts, '%Y%m%d-%H%M%S') || '_' || event_type || '_a_b' AS run, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started,
       event_type AS kind, 'a_b' AS tag FROM events""",
)
def run_catalogue(spark, sf_dir):
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMdd-HHmmss")
    names = table(spark, sf_dir, "events").select(F.concat(stamp, F.lit("_"), "event_type", F.lit("_a_b")).alias("run"))
    return files.run_names(names.distinct()).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


_MAP_SQL = """
    WITH f AS (SELECT 'c' || c_custkey AS route, unnest(['gps.time', 'gps.lat', 'gps.lon', 'gps.frame', 'obd.time', 'obd.speed', 'clock_offset', 'obd_tolerance']) AS field,
                      c_custkey FROM customer),
    m AS (SELECT route, field, 'p' || c_custkey AS proposed, CASE WHEN (c_custkey + length(field)) % 3 = 0 THEN 'unconfirmed' ELSE 'confirmed' END AS state
          FROM f WHERE NOT (c_custkey % 5 = 0 AND field LIKE 'ob%') AND NOT (c_custkey % 5 = 0 AND field = 'clock_offset') AND NOT (c_custkey % 11 = 0 AND field = 'gps.lat'))
"""


def _field_map(spark, sf_dir):
    names = gov.GPS_FIELDS + gov.OBD_FIELDS + gov.SCALAR_FIELDS
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("route"),
        "c_custkey",
        F.explode(F.array(*[F.lit(n) for n in names])).alias("field"),
    )
    bus = F.col("field").isin("obd.time", "obd.speed", "clock_offset", "obd_tolerance")
    kept = rows.where(~((c % 5 == 0) & bus) & ~((c % 11 == 0) & (F.col("field") == "gps.lat")))
    open_ = (c + F.length("field")) % 3 == 0
    return kept.select(
        "route", "field",
        F.when(F.contains("field", F.lit(".")), "column").otherwise("scalar").alias("kind"),
        F.concat(F.lit("p"), "c_custkey").alias("proposed"),
        F.when(open_, "unconfirmed").otherwise("confirmed").alias("state"),
        F.lit(None).cast("double").alias("confirmed_s"),
    )


@query(
    "a9_manifest_store",
    _MAP_SQL
    + """SELECT route, field, CASE WHEN c_custkey % 7 = 0 THEN 'q' ELSE 'p' END || c_custkey AS proposed,
         CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN (c_custkey + length(field)) % 3 = 0 THEN 'unconfirmed' ELSE 'confirmed' END ELSE 'confirmed' END AS state, 3 AS version
         FROM m JOIN (SELECT 'c' || c_custkey AS route, c_custkey FROM customer) USING (route)""",
)
def manifest_store(spark, sf_dir):
    """Written, confirmed as a whole, scanned again with other proposals for every seventh route, and read back."""
    folder = scratch(spark, "manifest")
    none = F.array().cast("array<string>")
    first = _field_map(spark, sf_dir).withColumns(
        {"confidence": F.lit("exact"), "candidates": none, "columns": none, "evidence": F.lit("")}
    ).select(*[c.split(" ")[0] for c in gov.FIELD_MAP_SCHEMA.split(", ")])
    manifest.save(first, folder)
    manifest.edit(spark, folder, lambda fields: gov.confirm_all(fields)[0])
    moved = F.regexp_extract("route", r"(\d+)", 1).cast("long") % 7 == 0
    again = first.withColumn("proposed", F.when(moved, F.regexp_replace("proposed", "^p", "q")).otherwise(F.col("proposed")))
    manifest.save(again, folder)
    documents, version = manifest.read(spark, folder)
    return manifest.field_map(documents).select("route", "field", "proposed", "state", F.lit(version).alias("version"))


@query(
    "j2_pending_fields",
    _MAP_SQL
    + """, r AS (SELECT 'c' || c_custkey AS route, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['gps.time', 'gps.lat', 'gps.lon', 'gps.frame']
              ELSE ['gps.time', 'gps.lat', 'gps.lon', 'gps.frame', 'obd.time', 'obd.speed'] END) AS field FROM customer)
    SELECT r.route, r.field, m.proposed FROM r LEFT JOIN m USING (route, field) WHERE m.state IS NULL OR m.state <> 'confirmed'
    UNION ALL SELECT route, field, proposed FROM m WHERE field IN ('clock_offset', 'obd_tolerance') AND state <> 'confirmed'""",
)
def pending_fields(spark, sf_dir):
    return gov.pending(_field_map(spark, sf_dir))


@query(
    "j3_set_field",
    _MAP_SQL
    + """SELECT route, field, CASE WHEN route = 'c7' AND field = 'clock_offset' THEN 'confirmed' ELSE state END AS state,
         CASE WHEN route = 'c7' AND field = 'clock_offset' THEN 19800.0::DOUBLE END AS confirmed_s FROM m""",
)
def set_field(spark, sf_dir):
    fields = _field_map(spark, sf_dir).withColumn("columns", F.array(F.lit("a")))
    return gov.set_field(fields, "c7", "clock_offset", value=19800.0).select("route", "field", "state", "confirmed_s")


@query("j4_confirm_all", _MAP_SQL + "SELECT route, field, proposed FROM m WHERE state <> 'confirmed'")
def confirm_all(spark, sf_dir):
    return gov.confirm_all(_field_map(spark, sf_dir))[1]


@query(
    "h7_trips",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(*) AS fixes, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us FROM s GROUP BY user_id, k HAVING count(*) >= 2
    """,
)
def trips(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("at", F.timestamp_micros("ts_us"))
    out = sensors.trips(rows, "user_id", "at", "1 minute", gap="12 hours")
    return out.select(
        "user_id", "fixes", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us")
    )


@query(
    "h6_rolling_telemetry",
    """
    WITH w AS (SELECT event_type, value, epoch_us(ts) // 21600000000 - k AS w FROM events, (SELECT unnest(range(4)) AS k))
    SELECT event_type, CAST(w * 21600000000 AS BIGINT) AS start_us, round(avg(value), 4) AS value_avg, max(value) AS value_max, count(*) AS samples
    FROM w GROUP BY event_type, w
    """,
)
def rolling_telemetry(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("at", F.timestamp_micros("ts_us"))
    out = sensors.rolling_telemetry(rows, "event_type", "at", ["value"], "1 minute", "24 hours", "6 hours")
    return out.select(
        "event_type", F.unix_micros("start").alias("start_us"), F.round("value_avg", 4).alias("value_avg"),
        "value_max", "samples",
    )


@query(
    "h8_stream_alignment",
    """
    WITH e AS (SELECT *, epoch_us(ts) AS t FROM events),
    f AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'), s AS (SELECT user_id, t AS st, value AS v FROM e WHERE event_type = 'view'),
    l AS (SELECT f.*, st AS lt, v AS lv FROM f ASOF LEFT JOIN s ON f.user_id = s.user_id AND f.t >= s.st),
    b AS (SELECT l.*, st AS rt, v AS rv FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t <= s.st)
    SELECT event_id, user_id, round(CASE WHEN coalesce(t - lt <= 86400000000, false) OR coalesce(rt - t <= 86400000000, false) THEN
        CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL OR rt = lt THEN lv ELSE lv + (t - lt) * (rv - lv) / (rt - lt) END END, 5) AS value FROM b
    """,
)
def stream_alignment(spark, sf_dir):
    """A stream of events in files: clicks take the value between the views around them, however far.
    One row far ahead closes the stream, so that what still waits for a right neighbour goes out."""
    place, out, state = (scratch(spark, n) for n in ("aligned-in", "aligned", "state"))
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", F.timestamp_micros("ts_us").alias("at"))
    e.repartition("event_id").write.parquet(place)
    end = spark.range(1).select(
        (-F.col("id") - 1).alias("event_id"), F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(0.0).cast(e.schema["value"].dataType).alias("value"), F.timestamp_seconds(F.lit(4102444800)).alias("at"),
    )
    end.coalesce(1).write.mode("append").parquet(place)
    rows = spark.readStream.schema(e.schema).parquet(place)
    got = sensors.align(
        rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "user_id", "event_id", "at", "value",
        tolerance_s=86400, late="3650 days", patience_s=86400.0 * 365,
    )
    (
        got.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start().awaitTermination()
    )
    done = spark.read.schema(got.schema).parquet(out)
    return done.where("event_id >= 0").select("event_id", "user_id", F.round(F.nanvl("value", F.lit(None).cast("double")), 5).alias("value"))


@query(
    "a14_image_masks",
    """SELECT l_suppkey AS image, CAST(l_linenumber * 30 AS INTEGER) AS level3_id, CAST(sum(l_quantity) AS BIGINT) AS n
       FROM lineitem GROUP BY ALL""",
)
def image_masks(spark, sf_dir):
    """One grey mask per supplier: every line paints as many pixels as its quantity."""
    counts = documents.pixel_counts(documents.images(spark, _painted_masks(spark, sf_dir)))
    image = F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("bigint")
    return counts.select(image.alias("image"), "level3_id", "n")


def _painted_masks(spark, sf_dir) -> str:
    folder = scratch(spark, "masks")

    def paint(group: pa.Table) -> pa.Table:
        ids = group["l_linenumber"].to_numpy().astype(np.uint8) * 30
        row = np.repeat(ids, group["l_quantity"].to_numpy().astype(int)).tobytes()
        name = f"{folder}/{group['l_suppkey'][0].as_py()}.png"
        storage.write_whole(name, shards.grey_png(row, len(row), 1))
        return pa.table({"name": [name]})

    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity")
    lines.groupBy("l_suppkey").applyInArrow(paint, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query(
    "seg_packed_index",
    """
    WITH i AS (SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'val' ELSE 'train' END AS split, l_suppkey, l_suppkey % 7 AS sequence,
                 CASE WHEN l_linenumber = 7 THEN 255 ELSE l_linenumber // 2 END AS train_id, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
    s AS (SELECT split, count(DISTINCT l_suppkey) AS samples, count(DISTINCT sequence) AS sequences, CAST(ceil(count(DISTINCT l_suppkey) / 16.0) AS BIGINT) AS shards,
            CAST(coalesce(sum(n) FILTER (train_id = 255), 0) AS BIGINT) AS ignore_pixels FROM i GROUP BY split),
    f AS (SELECT s.split, CAST(k.c AS INTEGER) AS train_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS pixels FROM s CROSS JOIN (SELECT unnest(range(8)) AS c) k
          LEFT JOIN i ON i.split = s.split AND i.train_id = k.c GROUP BY ALL),
    w AS (SELECT train_id, 1.0 / ln(1.02 + pixels / (SELECT sum(pixels) FROM f WHERE split = 'train')) AS w FROM f WHERE split = 'train')
    SELECT split, train_id, pixels, round(pixels / sum(pixels) OVER (PARTITION BY split), 6) AS frequency, round(least(w, 10 * (SELECT min(w) FROM w)), 6) AS weight,
           samples, sequences, shards, true AS whole_blocks, split || '/' || split || '-{00000..' || lpad(CAST(shards - 1 AS VARCHAR), 5, '0') || '}.tar' AS pattern, ignore_pixels
    FROM f JOIN w USING (train_id) JOIN s USING (split)
    """,
)
def seg_packed_index(spark, sf_dir):
    """Masks read back as images, gated, collapsed, counted, packed, and indexed from what was packed.
    Tar bytes depend on the PNG encoder, so the twin holds them only to be whole tar blocks."""
    masks = documents.images(spark, _painted_masks(spark, sf_dir))
    number = F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("bigint")
    samples = masks.select(
        F.when(number % 4 == 0, "val").otherwise("train").alias("split"), F.lpad(number.cast("string"), 9, "0").alias("key"),
        (number % 7).cast("string").alias("sequence"), F.encode("path", "utf-8").alias("image"), F.col("data").alias("mask"), "width", "height",
    )
    lut = spark.createDataFrame([(30 * k, 255 if k == 7 else k // 2) for k in range(1, 8)], "level3_id int, train_id int")
    index = segmentation.pack_and_index(samples, lut, scratch(spark, "packed"), ("train", "val"), range(8), per_shard=16)
    whole = (F.col("bytes") > 0) & (F.col("bytes") % 10240 == 0)
    rounded = {c: F.round(c, 6) for c in ("frequency", "weight")}
    return index.withColumns(rounded).withColumn("whole_blocks", whole).drop("bytes")


@query(
    "a7_shard_index",
    """SELECT lang || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, CAST(octet_length(encode(text)) AS BIGINT) AS image_size,
       CAST(octet_length(encode(source)) AS BIGINT) AS mask_size FROM documents""",
)
def shard_index(spark, sf_dir):
    out = scratch(spark, "shards")
    samples = table(spark, sf_dir, "documents").select(
        F.concat("lang", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"),
        F.encode("text", "utf-8").alias("image"),
        F.encode("source", "utf-8").alias("mask"),
    )
    shards.pack(samples, "val", out)
    return shards.read_samples(spark, out, with_data=False).select(
        "key", F.col("image.size").alias("image_size"), F.col("mask.size").alias("mask_size")
    )


@query(
    "j1_field_rows",
    """SELECT 'r' || event_id % 3 AS route, 'gps.' || role AS field, name AS proposed, 'exact' AS confidence, 'unconfirmed' AS state
       FROM (SELECT DISTINCT event_id % 3 AS event_id FROM events),
       (VALUES ('time', 'timestamp'), ('lat', 'latitude'), ('lon', 'longitude'), ('frame', 'image_idx')) AS v(role, name)""",
)
def field_rows(spark, sf_dir):
    from trackhouse.plans import inventory

    root = scratch(spark, "tree").removeprefix("file:")
    for i in range(3):
        part = _gps(spark, sf_dir).where(F.col("_set") == i).drop("_set")
        part.write.option("header", "true").csv(f"{root}/primary/r{i}")
    fields = inventory.propose_field_map(inventory.discover(spark, root))
    return fields.select("route", "field", "proposed", "confidence", "state")


@query(
    "j5_confirmation_gate",
    _MAP_SQL
    + """, r AS (SELECT 'c' || c_custkey AS route, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['gps.time', 'gps.lat', 'gps.lon', 'gps.frame']
              ELSE ['gps.time', 'gps.lat', 'gps.lon', 'gps.frame', 'obd.time', 'obd.speed', 'clock_offset', 'obd_tolerance'] END) AS field FROM customer),
    p AS (SELECT r.route, count(*) AS open FROM r LEFT JOIN m USING (route, field) WHERE m.state IS NULL OR m.state <> 'confirmed' GROUP BY r.route)
    SELECT 'c' || c_custkey AS route, coalesce(open, 0) AS open_fields, open IS NULL AS may_label
    FROM customer LEFT JOIN p ON p.route = 'c' || c_custkey""",
)
def confirmation_gate(spark, sf_dir):
    fields = _field_map(spark, sf_dir)
    # Counted together, so that no table of routes is joined to another.
    known = fields.groupBy("route").agg(F.lit(0).cast("bigint").alias("n"))
    counted = known.unionByName(gov.pending(fields).select("route", F.lit(1).cast("bigint").alias("n"))).groupBy("route").agg(F.sum("n").alias("n"))
    return counted.select("route", F.col("n").alias("open_fields"), (F.col("n") == 0).alias("may_label"))
