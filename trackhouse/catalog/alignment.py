"""Alignment, segmentation and order statistics on the event table (users stand for routes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackhouse.catalog.base import HOUR_US, events, query
from trackhouse.operators import asof
from trackhouse.operators.segments import assign_segments, segment_rows
from trackhouse.operators.timeline import Timeline, hold_last, timeline

DAY_US = 24 * HOUR_US
GAP_US = 12 * HOUR_US


def r6(col):
    return F.round(col, 6)


@query(
    "c1_asof_interpolate",
    """
    WITH e AS (SELECT *, epoch_us(ts) AS ts_us FROM events),
    f AS (SELECT event_id, user_id, ts_us FROM e WHERE event_type = 'click'),
    s AS (SELECT user_id, ts_us, max(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL),
    l AS (SELECT f.*, s.ts_us AS lt, s.v AS lv FROM f ASOF LEFT JOIN s
          ON f.user_id = s.user_id AND f.ts_us >= s.ts_us),
    b AS (SELECT l.*, s.ts_us AS rt, s.v AS rv FROM l ASOF LEFT JOIN s
          ON l.user_id = s.user_id AND l.ts_us <= s.ts_us)
    SELECT event_id, user_id, round(CASE
        WHEN coalesce(ts_us - lt <= 86400000000, false) OR coalesce(rt - ts_us <= 86400000000, false)
        THEN CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL OR rt = lt THEN lv
             ELSE lv + (ts_us - lt) * (rv - lv) / (rt - lt) END END, 6) AS aligned
    FROM b
    """,
)
def asof_interpolate(spark, sf_dir):
    e = events(spark, sf_dir)
    frames = e.where("event_type = 'click'").select("event_id", "user_id", "ts_us")
    samples = (
        e.where("event_type = 'view'")
        .groupBy("user_id", "ts_us")
        .agg(F.max("value").alias("value"))
    )
    return asof.interpolate(
        frames, samples, ["user_id"], "ts_us", "value", DAY_US, "aligned"
    ).select("event_id", "user_id", r6(F.col("aligned")).alias("aligned"))


SEGMENT_SQL = """
    WITH e AS (SELECT *, epoch_us(ts) AS ts_us FROM events),
    g AS (SELECT *, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS p FROM e),
    s AS (SELECT *, CAST(sum(CASE WHEN ts_us - p > 43200000000 THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts_us, event_id
                    ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment FROM g),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, segment) AS seg_rows,
              row_number() OVER (PARTITION BY user_id, segment ORDER BY ts_us, event_id) - 1
                  AS seg_index,
              max(ts_us) OVER (PARTITION BY user_id, segment) AS seg_end,
              first_value(value) OVER (PARTITION BY user_id, segment ORDER BY ts_us, event_id)
                  AS seg_value0 FROM s)
"""


def segmented_timeline(spark, sf_dir):
    """Segmented events and the timeline they were cut by."""
    e = events(spark, sf_dir)
    tl = timeline(e, ["user_id"], "ts_us", ties=["event_id"])
    return segment_rows(assign_segments(e, tl, GAP_US), tl, firsts=["value"]), tl


def segmented(spark, sf_dir):
    return segmented_timeline(spark, sf_dir)[0]


@query(
    "e1_gap_segments",
    SEGMENT_SQL
    + "SELECT event_id, user_id, segment, seg_index, seg_rows FROM n WHERE seg_rows >= 2",
)
def gap_segments(spark, sf_dir):
    return segmented(spark, sf_dir).select(
        "event_id", "user_id", "segment", "seg_index", "seg_rows"
    )


@query(
    "e4_hold_heading",
    """
    WITH e AS (SELECT *, epoch_us(ts) AS ts_us, CASE WHEN value >= 20 THEN value END AS h FROM events),
    w AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_us, event_id
              ROWS UNBOUNDED PRECEDING) AS held,
              first_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_us, event_id
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM e)
    SELECT event_id, user_id, coalesce(held, next, 0.0) AS heading FROM w
    """,
)
def hold_heading(spark, sf_dir):
    from trackhouse.operators.heading import hold_or_backfill

    e = events(spark, sf_dir).withColumn("h", F.when(F.col("value") >= 20, F.col("value")))
    tl = timeline(e, ["user_id"], "ts_us", ties=["event_id"])
    return hold_or_backfill(e, tl, "h", "heading").select("event_id", "user_id", "heading")
