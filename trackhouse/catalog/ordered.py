"""Window and selection operators (E and F series), and the batch side of the run logs (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackhouse.catalog.alignment import GAP_US, SEGMENT_SQL, segmented, segmented_timeline
from trackhouse.catalog.base import events, query, table
from trackhouse.operators import hard_examples, inventory, pairing, ranking, runlog, series
from trackhouse.operators.ranking import exact_quantiles
from trackhouse.operators.smoothing import REACH, WINDOW, smooth, weights
from trackhouse.operators.timeline import halo_by_rows, number_rows, previous, renamed, timeline
from trackhouse.plans import labelling


def r6(col):
    return F.round(col, 6)


def _weights_sql() -> str:
    """The fixed weight rows for windows 5 to 15 as a DuckDB table."""
    rows = []
    for w in range(5, WINDOW + 1, 2):
        for p, (a, b) in enumerate(zip(weights(w, 3, 0), weights(w, 3, 1))):
            lists = ["[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in x) + "]" for x in (a, b)]
            rows.append(f"({w}, {p}, {lists[0]}, {lists[1]})")
    return "(VALUES " + ", ".join(rows) + ") AS wt(w, p, a, b)"


SMOOTH_SQL = (
    SEGMENT_SQL
    + f""",
    g0 AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id, segment ORDER BY ts_us, event_id) AS d
           FROM n WHERE seg_rows >= 5),
    l AS (SELECT user_id, segment, list(value ORDER BY ts_us, event_id) AS vs, median(d) / 1e6::DOUBLE AS dt FROM g0 GROUP BY ALL),
    q AS (SELECT g0.*, l.vs, l.dt, CAST(least(15, seg_rows - 1 + seg_rows % 2) AS INTEGER) AS w FROM g0 JOIN l USING (user_id, segment)),
    z AS (SELECT *, CAST(greatest(0, least(seg_index - (w - 1) // 2, seg_rows - w)) AS INTEGER) AS start FROM q),
    m AS (SELECT z.*, list_inner_product(list_slice(vs, start + 1, start + z.w), wt.a) AS smooth,
             list_inner_product(list_slice(vs, start + 1, start + z.w), wt.b) / dt AS rate
          FROM z JOIN {_weights_sql()} ON wt.w = z.w AND wt.p = z.seg_index - z.start)
"""
)


def smoothed(spark, sf_dir):
    rows, tl = segmented_timeline(spark, sf_dir)
    rows = rows.where("seg_rows >= 5")
    tl = renamed(tl, keys=("user_id", "segment"))
    steps = previous(rows.select(*tl.group, "ts_us", "event_id"), tl, {"ts_us": "_p"})
    steps = steps.withColumn("_d", F.col("ts_us") - F.col("_p"))
    # Steps inside a segment lie between 0 and the gap limit: a million value chunks at most.
    dt = exact_quantiles(steps, ["user_id", "segment"], "_d", {"dt": 0.5}, width=GAP_US / 1e6)
    rows = rows.join(dt.withColumn("dt", F.col("dt") / 1e6), ["user_id", "segment"])
    laid = halo_by_rows(rows, "seg_index", "seg_rows", 20_000, REACH, "_block", "_own")
    out = smooth(
        laid, ["user_id", "segment", "_block"], "seg_index", {"value": ("smooth", "rate")}, "dt"
    )
    return out.where(F.col("_own")).drop("_own", "_block", "_chunk", "dt")


@query(
    "e2_smoothing",
    SMOOTH_SQL + "SELECT event_id, round(smooth, 6) AS smooth FROM m",
)
def smoothing(spark, sf_dir):
    return smoothed(spark, sf_dir).select("event_id", r6(F.col("smooth")).alias("smooth"))


@query(
    "e3_smoothed_derivative",
    SMOOTH_SQL + "SELECT event_id, round(rate * 1000, 6) AS per_ks FROM m",
)
def smoothed_derivative(spark, sf_dir):
    return smoothed(spark, sf_dir).select("event_id", r6(F.col("rate") * 1000).alias("per_ks"))


@query(
    "e6_segment_origin",
    SEGMENT_SQL + "SELECT event_id, seg_value0, seg_end FROM n WHERE seg_rows >= 2",
)
def segment_origin(spark, sf_dir):
    return segmented(spark, sf_dir).select("event_id", "seg_value0", "seg_end")


@query(
    "e9_running_best",
    """
    WITH w AS (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events)
    SELECT event_id, best_before, coalesce(value > best_before, true) AS is_best FROM w
    """,
)
def running_best(spark, sf_dir):
    e = events(spark, sf_dir)
    tl = timeline(e, ["user_id"], "ts_us", ties=["event_id"])
    return runlog.running_best(e, tl, "value").select("event_id", "best_before", "is_best")


@query(
    "e10_eta",
    """
    WITH w AS (SELECT event_id, row_number() OVER w - 1 AS epoch, avg(value) OVER (w ROWS UNBOUNDED PRECEDING) AS mean
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(mean * (epoch + 1) * (1000 - epoch - 1), 2) AS scaled FROM w
    """,
)
def eta(spark, sf_dir):
    e = events(spark, sf_dir)
    tl = timeline(e, ["user_id"], "ts_us", ties=["event_id"])
    numbered = number_rows(e, tl, "nth").withColumn("epoch", F.col("nth") - 1)
    out = runlog.eta_minutes(numbered, tl, "epoch", "value", 1000)
    # Scaled back to the sum of seconds, which has two decimals and so no rounding ties.
    scaled = F.col("eta_min") * 60 * (F.col("epoch") + 1)
    return out.select("event_id", F.round(scaled, 2).alias("scaled"))


@query(
    "e11_rolling_history",
    """
    SELECT event_id, count(value) OVER w AS history_n, round(sum(value) OVER w, 2) AS history_sum,
           min(value) OVER w AS history_min, max(value) OVER w AS history_max
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 599 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_history(spark, sf_dir):
    e = events(spark, sf_dir)
    tl = timeline(e, ["event_type"], "ts_us", ties=["event_id"])
    out = runlog.rolling_history(e, tl, "value")
    total = F.round(F.col("history_avg") * F.col("history_n"), 2).alias("history_sum")
    return out.select("event_id", "history_n", total, "history_min", "history_max")


@query(
    "e12_residuals",
    SMOOTH_SQL
    + """SELECT user_id, segment, round(avg(abs(smooth - value)), 6) AS mean_residual, round(max(abs(smooth - value)), 6) AS max_residual
         FROM m GROUP BY ALL""",
)
def residuals(spark, sf_dir):
    out = series.residuals(smoothed(spark, sf_dir), ["user_id", "segment"], "value", "smooth")
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_residual", "max_residual")})


@query(
    "e13_lateral_series",
    """WITH v AS (SELECT vec_id, label, embedding[2] AS y0, embedding[4] AS y1, embedding[6] AS y2, embedding[8] AS y3, embedding[10] AS y4 FROM embeddings)
       SELECT vec_id, CAST(substr(k, 2) AS INTEGER) AS horizon, lat::DOUBLE AS lateral_m FROM (UNPIVOT v ON y0, y1, y2, y3, y4 INTO NAME k VALUE lat)""",
)
def lateral_series(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    frames = e.select("vec_id", *[F.col("embedding")[2 * k + 1].alias(f"wp_y{k}") for k in range(5)])
    return series.lateral_series(frames, ["vec_id"]).drop("horizon_s")


@query(
    "b10_frame_paths",
    """
    WITH d AS (SELECT user_id AS route, event_type || '/' || event_id AS path, event_type = 'click' AS is_left FROM events),
    c AS (SELECT route, min(path) AS dir FROM d WHERE is_left GROUP BY route)
    SELECT event_id, dir || '/' || CASE WHEN length(CAST(event_id AS VARCHAR)) >= 6 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR), 6, '0') END || '.png' AS frame_path
    FROM events LEFT JOIN c ON user_id = route
    """,
)
def frame_paths(spark, sf_dir):
    e = events(spark, sf_dir)
    side = F.when(F.col("event_type") == "click", "left").otherwise("right")
    dirs = e.select(F.col("user_id").alias("route"), F.concat("event_type", F.lit("/"), "event_id").alias("path"), side.alias("side"))
    cameras = inventory.left_camera(dirs).where("state = 'left'").withColumn("example", F.lit("000000.png"))
    frames = e.select("event_id", F.col("user_id").alias("route"), F.col("event_id").alias("frame"))
    return labelling.with_frame_paths(frames, cameras).select("event_id", "frame_path")


@query(
    "f1_sort_by_time",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events",
)
def sort_by_time(spark, sf_dir):
    e = events(spark, sf_dir)
    return number_rows(e, timeline(e, ["user_id"], "ts_us", ties=["event_id"]), "nth").select("event_id", "nth")


@query(
    "f2_capped_listing",
    """
    WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items FROM r WHERE r <= 20 GROUP BY user_id, n
    """,
)
def capped_listing(spark, sf_dir):
    out = pairing.capped_listing(events(spark, sf_dir), ["user_id"], "event_id")
    return out.select("user_id", "n", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(
    "f3_evenly_spaced",
    """
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM r WHERE i IN (SELECT CAST(floor(k * ((n - 1) / 23.0::DOUBLE)) AS BIGINT) FROM (SELECT unnest(range(24)) AS k), (SELECT count(*) AS n FROM documents))
    """,
)
def evenly_spaced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ranking.evenly_spaced(docs, ["source", "doc_id"], 24).select("doc_id")


@query(
    "f4_seeded_sample",
    "SELECT event_id, value FROM events ORDER BY md5('216:' || event_id), event_id LIMIT 20",
)
def seeded_sample(spark, sf_dir):
    return ranking.seeded_sample(events(spark, sf_dir).select("event_id", "value"), ["event_id"], 20, 216)


@query(
    "f5_longest_first",
    SEGMENT_SQL
    + """, z AS (SELECT DISTINCT user_id, segment, seg_rows FROM n WHERE seg_rows >= 2)
    SELECT user_id, segment, seg_rows FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seg_rows DESC, segment) = 1""",
)
def longest_first(spark, sf_dir):
    sizes = segmented(spark, sf_dir).groupBy("user_id", "segment").agg(F.first("seg_rows").alias("seg_rows"))
    return pairing.first_of(sizes, ["user_id"], F.struct(-F.col("seg_rows"), F.col("segment")))


@query(
    "f6_latest_run",
    "SELECT event_type AS kind, max(strftime(ts, '%Y%m%d-%H%M%S') || '_' || event_type || '_u' || user_id) AS run FROM events GROUP BY 1",
)
def latest_run(spark, sf_dir):
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMdd-HHmmss")
    name = F.concat(stamp, F.lit("_"), "event_type", F.lit("_u"), "user_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max(name).alias("run"))


@query("f7_first_n", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 100")
def first_n(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(100)


@query(
    "f8_hard_examples",
    """
    WITH s AS (SELECT l_returnflag AS batch, l_orderkey * 10 + l_linenumber AS id, l_discount * 12 AS p, l_extendedprice AS loss,
                 CASE WHEN l_linenumber = 7 THEN 255 ELSE 0 END AS label FROM lineitem),
    v AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY loss DESC, id) AS r,
             count(*) FILTER (p < CASE batch WHEN 'A' THEN 0.9 ELSE 0.9 END) OVER (PARTITION BY batch) AS hard FROM s WHERE label <> 255)
    SELECT batch, id FROM v WHERE CASE WHEN hard >= 12000 THEN p < 0.9 ELSE r <= 12000 END
    """,
)
def hard_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("batch"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_discount") * 12).alias("p"),
        F.col("l_extendedprice").alias("loss"),
        F.when(F.col("l_linenumber") == 7, 255).otherwise(0).alias("label"),
    )
    return hard_examples.select_hard(rows, ["batch"], "p", "loss", "label", "id", min_kept=12000).select("batch", "id")


@query(
    "b25_left_camera",
    """
    WITH d AS (SELECT user_id AS route, event_id, event_type || event_id AS path, CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'right' END AS side
               FROM events),
    c AS (SELECT route, count(*) AS dirs, count(*) FILTER (side = 'left') AS lefts, min(path) FILTER (side = 'left') AS l, min(path) AS any FROM d GROUP BY 1)
    SELECT route, dirs, CASE WHEN lefts > 0 THEN 'left' WHEN dirs = 1 THEN 'only' ELSE 'ambiguous' END AS state,
           CASE WHEN lefts > 0 THEN l WHEN dirs = 1 THEN "any" END AS path FROM c
    """,
)
def left_camera(spark, sf_dir):
    side = F.when(F.col("event_type") == "click", "left").when(F.col("event_type") == "view", "right")
    dirs = events(spark, sf_dir).select(
        F.col("user_id").alias("route"), F.concat("event_type", "event_id").alias("path"), side.alias("side")
    )
    return inventory.left_camera(dirs).select("route", "dirs", "state", "path")


@query(
    "e8_shard_numbering",
    """SELECT doc_id, CAST((row_number() OVER (ORDER BY source, doc_id) - 1) // 500 AS BIGINT) AS shard FROM documents""",
)
def shard_numbering(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ranked = ranking.global_rank(docs, ["source", "doc_id"], "at")
    return ranked.select("doc_id", F.floor(F.col("at") / 500).cast("bigint").alias("shard"))


@query(
    "h2_latest_values",
    """SELECT user_id, event_type, arg_max(value, epoch_us(ts)) AS latest, count(*) AS points FROM events GROUP BY ALL""",
)
def latest_values(spark, sf_dir):
    return runlog.latest_values(events(spark, sf_dir), ["user_id", "event_type"], "value", "ts_us")


_STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' END"


def _status():
    t = F.col("event_type")
    return F.when(t == "signup", "running").when(t == "error", "failed").when(t == "purchase", "done")


@query(
    "h5_run_status",
    f"""WITH s AS (SELECT user_id, event_id, {_STATUS_SQL} AS status FROM events)
        SELECT user_id, arg_max(status, event_id) AS status, arg_max(status, event_id) IN ('interrupted', 'failed', 'done') AS terminal
        FROM s WHERE status IS NOT NULL GROUP BY user_id""",
)
def run_status(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("status", _status()).where("status IS NOT NULL")
    return runlog.run_status(rows, "user_id", "status", "event_id")


@query(
    "h4_stale_runs",
    f"""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS t, {_STATUS_SQL} AS status FROM events),
        g AS (SELECT user_id, max(t) AS last_ts, arg_max(status, event_id) FILTER (status IS NOT NULL) AS status FROM s GROUP BY user_id)
        SELECT user_id, status, 1706659200000000 - last_ts AS silence, 1706659200000000 - last_ts > 21600000000 AND status = 'running' AS stale FROM g""",
)
def stale_runs(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("status", _status())
    now = 1706659200000000
    out = runlog.stale_runs(rows, "user_id", "ts_us", "status", "event_id", now, after=6 * 3_600_000_000)
    return out.select("user_id", "status", "silence", "stale")


@query(
    "h3_throttle",
    """
    WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) - 1704067200000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    x AS (SELECT user_id, t, r, CASE WHEN t >= 21600000000 THEN t ELSE 0 END AS last, t >= 21600000000 AS ok FROM o WHERE r = 1
          UNION ALL SELECT o.user_id, o.t, o.r, CASE WHEN o.t - x.last >= 21600000000 THEN o.t ELSE x.last END, o.t - x.last >= 21600000000
          FROM x JOIN o ON o.user_id = x.user_id AND o.r = x.r + 1)
    SELECT user_id, t FROM x WHERE ok
    """,
)
def throttle(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", (F.col("ts_us") - 1704067200000000).alias("t"))
    return runlog.throttle(rows, "user_id", "t", every=6 * 3_600_000_000)


@query(
    "h9_non_finite",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0 OR l_tax = 0""",
)
def non_finite(spark, sf_dir):
    # NaN where the discount is 0 and infinity where the tax is 0: values a failed step would log.
    value = (
        F.when(F.col("l_discount") == 0, F.lit(float("nan")))
        .when(F.col("l_tax") == 0, F.lit(float("-inf")))
        .otherwise(F.col("l_quantity"))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))
    return runlog.non_finite(rows, "value").select("l_orderkey", "l_linenumber")
