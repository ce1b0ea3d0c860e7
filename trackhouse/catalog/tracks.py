"""The labelling plan on tracks that Spark derives from the event table.

Every event becomes a drive of 64 fixes at 15 Hz on its user's route, with a start direction, a
speed and a curvature of its own, and bus speed samples once a second in km/h. Positions are
rounded to 1e-7 degrees, as a logger writes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackhouse.catalog.base import events, query
from trackhouse.catalog.ordered import _weights_sql
from trackhouse.operators.timeline import number_rows, timeline
from trackhouse.plans import labelling
from trackhouse.session import ensure_checkpoint_dir, released, stored

FIXES = 64
#: Events whose routes are labelled at once: what is on disk between the steps does not grow beyond theirs.
BATCH_EVENTS = 1_000_000


def drives(spark, sf_dir, part=0, parts=1):
    """The drive of every event of all routes, or of one of ``parts`` shares of the routes; an event without
    a user has no route."""
    e = events(spark, sf_dir, "event_id", "user_id").where(F.pmod(F.xxhash64("user_id"), F.lit(parts)) == part).where("user_id IS NOT NULL")
    e = number_rows(e, timeline(e, ["user_id"], "ts_us", ties=["event_id"]), "k")
    angle = F.radians((F.col("event_id") % 360).cast("double"))
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("route"),
        "k",
        (F.col("event_id") % 12).cast("double").alias("v"),
        ((F.col("event_id") % 7 - 3) * F.lit(0.3)).alias("c"),
        F.cos(angle).alias("cos_a"),
        F.sin(angle).alias("sin_a"),
    )


def rounded(value, digits):
    """``value``, not negative, to so many decimals: the double nearest to the whole number of such steps."""
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def fixes(drive):
    """The 64 fixes of every drive."""
    rows = drive.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(FIXES - 1))))
    tau = F.col("i") / 15.0
    along, side = F.col("v") * tau, F.col("c") * tau * tau
    east = along * F.col("cos_a") - side * F.col("sin_a")
    north = along * F.col("sin_a") + side * F.col("cos_a")
    return rows.select(
        "route",
        ((F.col("k") - 1) * FIXES + F.col("i")).alias("frame"),
        rounded(F.col("k") * 6 + tau, 6).alias("t"),
        rounded(17.4962 + north / 111132.0, 7).alias("lat"),
        rounded(78.4156 + east / 106170.0, 7).alias("lon"),
    )


def samples(drive):
    """The bus speeds of every drive, at each fifteenth fix."""
    rows = drive.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(FIXES - 1), F.lit(15))))
    tau = F.col("i") / 15.0
    speed = 3.6 * F.sqrt(F.col("v") * F.col("v") + 4 * F.col("c") * F.col("c") * tau * tau)
    return rows.select("route", rounded(F.col("k") * 6 + tau, 6).alias("t"), rounded(speed, 1).alias("speed"))


def labelled(spark, sf_dir, part=0, parts=1, columns=None):
    # A drive becomes 64 fixes: spread the few drives first.
    found = drives(spark, sf_dir, part, parts)
    drive = stored(found.repartition(spark.sparkContext.defaultParallelism))
    done = labelling.run_tables(fixes(drive), samples(drive), default_tolerance_s=1.0, columns=columns)
    released(drive)
    return done


def by_routes(spark, sf_dir, summary, columns):
    """``summary`` of every labelling run, which reads ``columns`` of the labels: routes are labelled share by share, all of them, and only the
    summaries of a share stay when the next begins."""
    parts = max(1, -(-events(spark, sf_dir, "user_id").count() // BATCH_EVENTS))
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/summaries-{uuid.uuid4().hex}"
    for part in range(parts):
        done = labelled(spark, sf_dir, part, parts, columns)
        rows = stored(summary(done), place)
        done.release()
    return rows


TRACK_SQL = f"""
    WITH ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    dr AS (SELECT 'u' || user_id AS route, k, (event_id % 12)::DOUBLE AS v, ((event_id % 7) - 3) * 0.3::DOUBLE AS c,
                  radians((event_id % 360)::DOUBLE) AS a FROM ev),
    tu AS (SELECT *, i / 15.0::DOUBLE AS tau FROM (SELECT *, unnest(range({FIXES})) AS i FROM dr)),
    en AS (SELECT *, v * tau * cos(a) - c * tau * tau * sin(a) AS east, v * tau * sin(a) + c * tau * tau * cos(a) AS north FROM tu),
    fx AS (SELECT route, round(k * 6 + tau, 6) AS t, round(17.4962::DOUBLE + north / 111132.0::DOUBLE, 7) AS lat,
                  round(78.4156::DOUBLE + east / 106170.0::DOUBLE, 7) AS lon,
                  CASE WHEN i % 15 = 0 THEN round(3.6::DOUBLE * sqrt(v * v + 4 * c * c * tau * tau), 1) END AS speed FROM en),
    ob AS (SELECT route, t AS ot, speed FROM fx WHERE speed IS NOT NULL),
    o1 AS (SELECT fx.route, fx.t, lat, lon, ob.ot AS lt, ob.speed AS lv FROM fx ASOF LEFT JOIN ob ON fx.route = ob.route AND fx.t >= ob.ot),
    o2 AS (SELECT o1.*, ob.ot AS rt, ob.speed AS rv FROM o1 ASOF LEFT JOIN ob ON o1.route = ob.route AND o1.t <= ob.ot),
    sy AS (SELECT route, t, CAST(round(t * 1e6) AS BIGINT) AS tu, lat, lon, CASE WHEN coalesce(t - lt <= 1.0, false) OR coalesce(rt - t <= 1.0, false) THEN
             CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL OR rt = lt THEN lv ELSE lv + (t - lt) * (rv - lv) / (rt - lt) END END AS obd FROM o2),
    g1 AS (SELECT *, tu - lag(tu) OVER (PARTITION BY route ORDER BY tu) AS d FROM sy),
    g2 AS (SELECT *, CAST(sum(CASE WHEN d > 340000 THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY tu ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment FROM g1),
    g3 AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY route, segment) AS n, first_value(lat) OVER w AS lat0,
                  first_value(lon) OVER w AS lon0, max(tu) OVER (PARTITION BY route, segment) AS tend FROM g2 WINDOW w AS (PARTITION BY route, segment ORDER BY tu)),
    g4 AS (SELECT *, (lon - lon0) * 111320 * cos(radians(lat0)) AS x, (lat - lat0) * 111132 AS y FROM g3 WHERE n >= 2),
    ls AS (SELECT route, segment, list(x ORDER BY tu) AS xs, list(y ORDER BY tu) AS ys, median(CASE WHEN d <= 340000 THEN d END) / 1e6::DOUBLE AS dt FROM g4 GROUP BY ALL),
    g5 AS (SELECT g4.*, xs, ys, dt, CAST(least(15, n - 1 + n % 2) AS INTEGER) AS w FROM g4 JOIN ls USING (route, segment)),
    g6 AS (SELECT *, CAST(greatest(0, least(idx - (w - 1) // 2, n - w)) AS INTEGER) AS s0 FROM g5),
    sm AS (SELECT g6.* EXCLUDE (xs, ys), list_inner_product(list_slice(xs, s0 + 1, s0 + g6.w), wt.a) AS sx, list_inner_product(list_slice(ys, s0 + 1, s0 + g6.w), wt.a) AS sy,
             list_inner_product(list_slice(xs, s0 + 1, s0 + g6.w), wt.b) / dt AS vx, list_inner_product(list_slice(ys, s0 + 1, s0 + g6.w), wt.b) / dt AS vy
           FROM g6 JOIN {_weights_sql()} ON wt.w = g6.w AND wt.p = g6.idx - g6.s0),
    s2 AS (SELECT *, sqrt(vx * vx + vy * vy) AS sg FROM sm),
    um AS (SELECT route, segment, median(obd / sg) AS m, count(*) AS c, any_value(n) AS n FROM s2 WHERE n >= 60 AND sg > 2 AND obd > 0 GROUP BY ALL),
    uu AS (SELECT route, CASE WHEN m BETWEEN 0.7 AND 1.4 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3.6 END AS scale FROM um
           WHERE c >= 20 AND (m BETWEEN 0.7 AND 1.4 OR m BETWEEN 2.9 AND 4.3) QUALIFY row_number() OVER (PARTITION BY route ORDER BY n DESC, segment) = 1),
    s3 AS (SELECT s2.*, coalesce(0.5 * sg + 0.5 * (obd * scale), sg) AS speed FROM s2 LEFT JOIN uu USING (route)),
    s4 AS (SELECT *, CASE WHEN speed >= 1.5 THEN atan2(vy, vx) END AS h FROM s3),
    s5 AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING),
                 first_value(h IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS heading
           FROM s4 WINDOW w AS (PARTITION BY route, segment ORDER BY tu)),
    hz AS (SELECT route, segment, tu, sx, sy, heading, tu + hh AS target, hh FROM s5, (VALUES (500000), (2500000)) AS v(hh)),
    pt AS (SELECT route, segment, tu AS pu, sx AS px, sy AS py, lag(tu) OVER w AS qu, lag(sx) OVER w AS qx, lag(sy) OVER w AS qy FROM s5
           WINDOW w AS (PARTITION BY route, segment ORDER BY tu)),
    hj AS (SELECT hz.*, pu, px, py, qu, qx, qy FROM hz ASOF LEFT JOIN pt ON hz.route = pt.route AND hz.segment = pt.segment AND hz.target <= pt.pu),
    hp AS (SELECT route, segment, tu, hh, heading, CASE WHEN pu = target THEN px ELSE qx + (target - qu) / (pu - qu) * (px - qx) END - sx AS dx,
                  CASE WHEN pu = target THEN py ELSE qy + (target - qu) / (pu - qu) * (py - qy) END - sy AS dy FROM hj),
    wp AS (SELECT route, segment, tu, max(CASE WHEN hh = 500000 THEN dx * cos(heading) + dy * sin(heading) END) AS wp_x0,
                  max(CASE WHEN hh = 2500000 THEN dx * cos(heading) + dy * sin(heading) END) AS wp_x4,
                  max(CASE WHEN hh = 2500000 THEN -dx * sin(heading) + dy * cos(heading) END) AS wp_y4 FROM hp GROUP BY ALL),
    rs AS (SELECT s5.*, wp_x0, wp_x4, wp_y4, CASE WHEN NOT speed >= 1.0 THEN 'slow' WHEN tu + 2500000 > tend THEN 'target_past_segment_end'
                  WHEN NOT abs(wp_y4) <= 25 THEN 'lateral_over_limit' END AS drop_reason FROM s5 JOIN wp USING (route, segment, tu)),
    co AS (SELECT route, quantile_cont(t, 0.85) AS cutoff FROM rs WHERE drop_reason IS NULL GROUP BY route)
"""


@query(
    "waypoint_labels",
    TRACK_SQL
    + """SELECT rs.route, rs.segment, count(*) AS frames, count(*) FILTER (t >= cutoff) AS val, round(avg(speed), 4) AS speed_mps,
         round(avg(cos(heading)), 4) AS heading_cos, round(avg(sin(heading)), 4) AS heading_sin, round(avg(wp_x0), 4) AS wp_x0, round(avg(wp_x4), 4) AS wp_x4, round(avg(wp_y4), 4) AS wp_y4
         FROM rs JOIN co USING (route) WHERE drop_reason IS NULL GROUP BY ALL""",
)
def waypoint_labels(spark, sf_dir):
    """Per route and segment: kept frames, validation frames, mean speed, heading, waypoints."""
    # A heading of exactly half a turn may carry either sign; its sine and cosine do not.
    angle, means = F.col("heading_rad"), ("speed_mps", "wp_x0", "wp_x4", "wp_y4")
    return by_routes(spark, sf_dir, lambda done: done.frames.groupBy("route", "segment").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("split") == "val").alias("val"),
        F.round(F.avg(F.cos(angle)), 4).alias("heading_cos"),
        F.round(F.avg(F.sin(angle)), 4).alias("heading_sin"),
        *[F.round(F.avg(c), 4).alias(c) for c in means],
    ), ["heading_rad", *means])


@query(
    "d14_route_report",
    TRACK_SQL
    + """, a AS (SELECT rs.route, count(*) FILTER (drop_reason IS NULL) AS frames, count(*) FILTER (drop_reason IS NULL AND t < cutoff) AS train,
           count(*) FILTER (drop_reason IS NULL AND t >= cutoff) AS val, count(DISTINCT segment) AS segments, count(*) AS gps_fixes, count(obd) AS obd_matched,
           round(any_value(cutoff), 4) AS val_cutoff_t FROM rs LEFT JOIN co USING (route) GROUP BY rs.route),
         b AS (SELECT a.*, CASE WHEN scale < 1 THEN 'km/h' WHEN scale = 1 THEN 'm/s' END AS unit, round(100.0::DOUBLE * frames / gps_fixes, 2) AS retained_pct,
           round(100.0::DOUBLE * obd_matched / gps_fixes, 2) AS obd_matched_pct FROM a LEFT JOIN uu USING (route))
         SELECT route, frames, train, val, segments, gps_fixes, obd_matched, val_cutoff_t, unit, retained_pct, obd_matched_pct FROM b
         UNION ALL SELECT NULL, CAST(sum(frames) AS BIGINT), CAST(sum(train) AS BIGINT), CAST(sum(val) AS BIGINT), CAST(sum(segments) AS BIGINT),
           CAST(sum(gps_fixes) AS BIGINT), CAST(sum(obd_matched) AS BIGINT), NULL, NULL, round(avg(retained_pct), 6), round(avg(obd_matched_pct), 6) FROM b""",
)
def route_report(spark, sf_dir):
    report = labelling.with_total(by_routes(spark, sf_dir, labelling.route_rows, ["obd_speed"]))
    return report.withColumns(
        {
            "val_cutoff_t": F.round("val_cutoff_t", 4),
            "retained_pct": F.round("retained_pct", 6),
            "obd_matched_pct": F.round("obd_matched_pct", 6),
        }
    )
