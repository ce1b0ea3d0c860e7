"""Column functions (B series) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackhouse.catalog.base import events, query, table
from trackhouse.functions import geometry as geo
from trackhouse.functions import scores, text


def r6(col):
    return F.round(col, 6)


@query(
    "b1_parse_timestamp",
    """
    SELECT event_id, round((epoch_us(ts) % 86400000000) / 1000000.0, 6) AS t,
           CAST(CAST(floor((epoch_us(ts) % 86400000000) / 1000000) AS BIGINT) AS DOUBLE) AS t_colon,
           value AS t_number, CAST(NULL AS DOUBLE) AS t_bad
    FROM events
    """,
)
def parse_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    ntz = F.col("ts").cast("timestamp_ntz")
    return e.select(
        "event_id",
        r6(text.clock_seconds(F.date_format(ntz, "HH-mm-ss-SSSSSS"))).alias("t"),
        text.clock_seconds(F.concat(F.lit(" "), F.date_format(ntz, "H:mm:ss"))).alias("t_colon"),
        text.clock_seconds(F.col("value").cast("string")).alias("t_number"),
        text.clock_seconds(F.col("event_type")).alias("t_bad"),
    )


@query(
    "b2_normalize_name",
    "SELECT p_partkey, lower(translate(p_brand || '-' || p_name || '_' || p_type, ' -_', '')) AS normalized "
    "FROM part",
)
def normalize_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat("p_brand", F.lit("-"), "p_name", F.lit("_"), "p_type")
    return p.select("p_partkey", text.normalize_name(name).alias("normalized"))


@query(
    "b3_frame_key",
    """
    SELECT doc_id, source || '_' || doc_id AS image_key, source || '_' || doc_id AS polygon_key,
           source || '_' || doc_id AS mask_key, source || '_' || doc_id AS bare_key FROM documents
    """,
)
def frame_key(spark, sf_dir):
    stem = F.concat_ws("_", "source", "doc_id")
    ext = F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".JPG")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.image_frame_key(F.concat(stem, F.lit("_leftImg8bit"), ext)).alias("image_key"),
        text.polygon_frame_key(F.concat(stem, F.lit("_gtFine_polygons.json"))).alias("polygon_key"),
        text.mask_frame_key(F.concat(stem, F.lit("_gtFine_labellevel3Ids.png"))).alias("mask_key"),
        text.image_frame_key(F.concat(stem, ext)).alias("bare_key"),
    )


_SUFFIX_SQL = """
    WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS leaf,
                      CASE WHEN page_id % 4 = 0 THEN '.png' WHEN page_id % 4 = 1 THEN '.CSV'
                           WHEN page_id % 4 = 2 THEN '.bin' ELSE '' END AS extra FROM pages),
    s AS (SELECT page_id, lower(regexp_extract(leaf || extra, '.(\\.[^.]+)$', 1)) AS suffix FROM u)
"""


@query(
    "b4_file_kind",
    _SUFFIX_SQL
    + """SELECT page_id, suffix, CASE WHEN suffix IN ('.jpg','.jpeg','.png') THEN 'image'
         WHEN suffix IN ('.csv','.txt','.tsv') THEN 'table'
         WHEN suffix IN ('.npy','.bin','.pcd','.ply') THEN 'lidar' ELSE 'other' END AS kind FROM s""",
)
def file_kind(spark, sf_dir):
    extra = (
        F.when(F.col("page_id") % 4 == 0, ".png")
        .when(F.col("page_id") % 4 == 1, ".CSV")
        .when(F.col("page_id") % 4 == 2, ".bin")
        .otherwise("")
    )
    leaf = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^.*/", "")
    suffix = text.file_suffix(F.concat(leaf, extra))
    return table(spark, sf_dir, "pages").select(
        "page_id", suffix.alias("suffix"), text.file_kind(suffix).alias("kind")
    )


_SIDE = "CASE page_id % 5 WHEN 0 THEN 'leftCamImgs' WHEN 1 THEN 'RightCam' WHEN 2 THEN 'left_right' WHEN 3 THEN 'd' || page_id ELSE 'obd' END"


def _side_name():
    k = F.col("page_id") % 5
    return (
        F.when(k == 0, "leftCamImgs")
        .when(k == 1, "RightCam")
        .when(k == 2, "left_right")
        .when(k == 3, F.concat(F.lit("d"), "page_id"))
        .otherwise("obd")
    )


@query(
    "b5_stereo_side",
    f"""SELECT page_id, CASE WHEN contains(lower(n), 'left') AND NOT contains(lower(n), 'right') THEN 'left'
        WHEN contains(lower(n), 'right') AND NOT contains(lower(n), 'left') THEN 'right' END AS side
        FROM (SELECT page_id, url || {_SIDE} AS n FROM pages)""",
)
def stereo_side(spark, sf_dir):
    name = F.concat("url", _side_name())
    return table(spark, sf_dir, "pages").select("page_id", text.stereo_side(name).alias("side"))


@query(
    "b6_route_from_path",
    f"""
    WITH d AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')
                 || '/' || {_SIDE}, '/') AS parts FROM pages)
    SELECT page_id, list_filter(parts, lambda x: x <> '' AND lower(x) NOT IN ('primary','secondary','supplement','lidar','obd')
        AND NOT contains(lower(x), 'cam') AND NOT contains(lower(x), 'img')
        AND NOT ((contains(lower(x), 'left') AND NOT contains(lower(x), 'right'))
              OR (contains(lower(x), 'right') AND NOT contains(lower(x), 'left'))))[-1] AS route FROM d
    """,
)
def route_from_path(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    full = F.concat(path, F.lit("/"), _side_name())
    return table(spark, sf_dir, "pages").select("page_id", text.route_of(full).alias("route"))


@query(
    "b9_guarded_cast",
    """
    WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type
                      WHEN event_id % 7 = 1 THEN '' ELSE ' ' || json_extract_string(props, '$.k') END AS raw FROM events)
    SELECT event_id, CAST(trim(raw) AS BIGINT) AS frame, CAST(trim(raw) AS DOUBLE) AS number
    FROM r WHERE regexp_matches(trim(raw), '^[+-]?[0-9]+$')
    """,
)
def guarded_cast(spark, sf_dir):
    raw = (
        F.when(F.col("event_id") % 7 == 0, F.col("event_type"))
        .when(F.col("event_id") % 7 == 1, "")
        .otherwise(F.concat(F.lit(" "), F.get_json_object("props", "$.k")))
    )
    rows = events(spark, sf_dir, "event_id", "event_type", "props").withColumn("raw", raw)
    return rows.select(
        "event_id", text.integer(F.col("raw")).alias("frame"), text.number(F.col("raw")).alias("number")
    ).dropna()


@query(
    "b10_frame_path",
    """SELECT p_partkey, 'cam/' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 3 THEN CAST(p_partkey AS VARCHAR)
         ELSE lpad(CAST(p_partkey AS VARCHAR), 3, '0') END || '.jpg' AS path FROM part""",
)
def frame_path(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.frame_path(F.lit("cam"), F.col("p_partkey"), F.lit("000.jpg")).alias("path"),
    )


def _vectors(spark, sf_dir, n):
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *cols)


_VEC = "(SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(10)
) + " FROM embeddings)"


@query(
    "b11_local_metres",
    f"""SELECT vec_id, round((78.4 + e1 - 78.4156) * 111320 * cos(radians(17.4962)), 6) AS east,
        round((17.5 + e0 - 17.4962) * 111132, 6) AS north FROM {_VEC}""",
)
def local_metres(spark, sf_dir):
    east, north = geo.local_metres(
        F.lit(17.5) + F.col("e0"), F.lit(78.4) + F.col("e1"), F.lit(17.4962), F.lit(78.4156)
    )
    return _vectors(spark, sf_dir, 2).select("vec_id", r6(east).alias("east"), r6(north).alias("north"))


@query("b12_speed", f"SELECT vec_id, round(sqrt(e0 * e0 + e1 * e1), 6) AS speed FROM {_VEC}")
def speed(spark, sf_dir):
    return _vectors(spark, sf_dir, 2).select("vec_id", r6(F.hypot("e0", "e1")).alias("speed"))


@query(
    "b13_fuse_speed",
    """SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value ELSE 0.5 * value + 0.5 * event_id / 100.0 END, 6)
       AS fused FROM events""",
)
def fuse_speed(spark, sf_dir):
    bus = F.when(F.col("event_id") % 3 != 0, F.col("event_id") / 100.0)
    return events(spark, sf_dir).select(
        "event_id", r6(geo.fuse_speed(F.col("value"), bus)).alias("fused")
    )


@query("b14_heading", f"SELECT vec_id, round(atan2(e1, e0), 6) AS heading FROM {_VEC}")
def heading(spark, sf_dir):
    return _vectors(spark, sf_dir, 2).select(
        "vec_id", r6(geo.heading(F.col("e0"), F.col("e1"))).alias("heading")
    )


@query(
    "b15_ego_rotation",
    f"""SELECT vec_id, round(e0 * cos(e2) + e1 * sin(e2), 6) AS forward,
        round(-e0 * sin(e2) + e1 * cos(e2), 6) AS lateral FROM {_VEC}""",
)
def ego_rotation(spark, sf_dir):
    forward, left = geo.to_ego(F.col("e0"), F.col("e1"), F.col("e2"))
    return _vectors(spark, sf_dir, 3).select(
        "vec_id", r6(forward).alias("forward"), r6(left).alias("lateral")
    )


@query(
    "b16_drop_reason",
    """SELECT event_id, CASE WHEN NOT value >= 1.0 THEN 'slow' WHEN event_id % 11 = 0 THEN 'target_past_segment_end'
        WHEN NOT abs(value) <= 25 THEN 'lateral_over_limit' END AS drop_reason FROM events""",
)
def drop_reason(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        geo.drop_reason(F.col("value"), F.col("event_id") % 11 == 0, F.col("value")).alias(
            "drop_reason"
        ),
    )


@query("b17_unit_scale", "SELECT event_id, round(value * (1.0::DOUBLE / 3.6), 6) AS mps FROM events")
def unit_scale(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", r6(F.col("value") * geo.KMH_TO_MPS).alias("mps")
    )


@query(
    "b18_pinhole",
    f"""SELECT vec_id, e0 * 40 > 0.5 AS visible,
        round(CASE WHEN e0 * 40 > 0.5 THEN 320.0 / tan(radians(70.0) / 2) * (-e1 * 5) / (e0 * 40) + 320 END, 6) AS u,
        round(CASE WHEN e0 * 40 > 0.5 THEN 320.0 / tan(radians(70.0) / 2) * 1.4 / (e0 * 40) + 180 END, 6) AS v
        FROM {_VEC}""",
)
def pinhole(spark, sf_dir):
    u, v, visible = geo.project(F.col("e0") * 40, F.col("e1") * 5, 640, 360)
    return _vectors(spark, sf_dir, 2).select(
        "vec_id", visible.alias("visible"), r6(u).alias("u"), r6(v).alias("v")
    )


@query("b19_sample_key", "SELECT doc_id, source || '_' || lang || doc_id AS key FROM documents")
def sample_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.sample_key(F.col("source"), F.concat("lang", "doc_id")).alias("key")
    )


@query(
    "b20_log_filter",
    """SELECT doc_id, contains(lower(text), 'the') AS plain, regexp_matches(text, '(?i)\\bth[ae]n?\\b') AS regex,
        contains(lower(text), '/th(/') AS broken FROM documents""",
)
def log_filter(spark, sf_dir):
    line = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.log_matches(line, " THE ").alias("plain"),
        text.log_matches(line, r"/\bth[ae]n?\b/").alias("regex"),
        text.log_matches(line, "/th(/").alias("broken"),
    )


@query(
    "b21_class_weight",
    "SELECT l_orderkey, l_linenumber, round(1.0 / ln(1.02 + l_discount), 6) AS weight FROM lineitem",
)
def class_weight(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(scores.class_weight(F.col("l_discount"))).alias("weight")
    )


@query(
    "b22_budget_status",
    """SELECT event_id, CASE WHEN value <= 33.0::DOUBLE * 0.8::DOUBLE THEN 'ok' WHEN value <= 33 THEN 'warn' ELSE 'err' END
       AS status FROM events""",
)
def budget_status(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", scores.budget_status(F.col("value")).alias("status")
    )


@query(
    "b23_telemetry_derived",
    """
    WITH t AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
    SELECT event_id, round(k * 100 / 1024.0, 6) AS ram_used_gb, round((k + (k + 3) % 100 + 7) / 3.0, 6) AS cpu_avg_pct,
           CASE WHEN event_id % 2 = 0 THEN greatest(k + 0.5::DOUBLE, (k * 7 % 90) + 0.25::DOUBLE) ELSE (k + 2.5)::DOUBLE END AS soc_temp_c,
           round((k * 10 + 250) / 1000.0, 6) AS total_power_w
    FROM t
    """,
)
def telemetry_derived(spark, sf_dir):
    from trackhouse.functions.devices import derived_columns, telemetry_columns

    # Number and line are columns of their own, so that each is made once a row.
    e = events(spark, sf_dir, "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    soc = F.concat(
        F.lit("soc0@"), k + 0.5, F.lit("C soc1@"), k * 7 % 90 + 0.25, F.lit("C tj@"), k + 2.5, F.lit("C")
    )
    tj = F.concat(F.lit("gpu@40.0C tj@"), k + 2.5, F.lit("C"))
    line = F.concat(
        F.lit("RAM "), k * 100, F.lit("/62817MB CPU ["), k, F.lit("%@729,"), (k + 3) % 100,
        F.lit("%@729,7%@1190] GR3D_FREQ 5% "), F.when(F.col("event_id") % 2 == 0, soc).otherwise(tj),
        F.lit(" VDD_GPU "), k * 10, F.lit("mW/1mW/2mW VIN 250mW/1mW/2mW"),
    )
    parsed = e.select("event_id", line.alias("line")).select("event_id", *telemetry_columns(F.col("line")))
    return parsed.select("event_id", *derived_columns()).select(
        "event_id",
        r6(F.col("ram_used_gb")).alias("ram_used_gb"),
        r6(F.col("cpu_avg_pct")).alias("cpu_avg_pct"),
        "soc_temp_c",
        r6(F.col("total_power_w")).alias("total_power_w"),
    )


@query(
    "b24_magnitude",
    """
    WITH c AS (SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN floor(o_totalprice)
                 WHEN 2 THEN floor(o_totalprice * 997) ELSE floor(o_totalprice * 99991) END AS BIGINT) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.2f G', n / 1e9::DOUBLE) WHEN n >= 1000000 THEN printf('%.2f M', n / 1e6::DOUBLE)
           WHEN n >= 1000 THEN printf('%.2f K', n / 1e3::DOUBLE) ELSE CAST(n AS VARCHAR) END AS shown FROM c
    """,
)
def magnitude(spark, sf_dir):
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    n = (
        F.when(k == 0, F.col("o_orderkey") % 1000)
        .when(k == 1, F.floor(price))
        .when(k == 2, F.floor(price * 997))
        .otherwise(F.floor(price * 99991))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.cast("bigint").alias("n"))
    return rows.select("o_orderkey", text.magnitude(F.col("n")).alias("shown"))


@query(
    "b26_safe_tag",
    "SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}_-]', '-', 'g') AS tag FROM documents",
)
def safe_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_tag(F.col("text")).alias("tag"))


@query(
    "b27_waypoint_array",
    f"SELECT vec_id, round(e0 + e2 + e4 + e6 + e8, 6) AS sum_x, round(e1 + e3 + e5 + e7 + e9, 6) AS sum_y FROM {_VEC}",
)
def waypoint_array(spark, sf_dir):
    v = _vectors(spark, sf_dir, 10)
    points = geo.waypoint_array([f"e{i}" for i in range(0, 10, 2)], [f"e{i}" for i in range(1, 10, 2)])
    total = lambda axis: r6(F.aggregate("wp", F.lit(0.0), lambda a, p: a + p[axis]))
    return v.select("vec_id", points.alias("wp")).select(
        "vec_id", total("x").alias("sum_x"), total("y").alias("sum_y")
    )
