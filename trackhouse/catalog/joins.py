"""Joins, sets and label taxonomy (C, G series and D15-D16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackhouse.catalog.alignment import SEGMENT_SQL, segmented, segmented_timeline
from trackhouse.catalog.base import HOUR_US, events, query, table
from trackhouse.operators import asof, governance, metrics, pairing, rates, roles, runlog, taxonomy
from trackhouse.operators.checks import duplicate_keys


def r6(col):
    return F.round(col, 6)


@query(
    "c2_horizon_lookup",
    SEGMENT_SQL
    + """,
    k AS (SELECT * FROM n WHERE seg_rows >= 2),
    p AS (SELECT user_id, segment, ts_us, max(value) AS v FROM k GROUP BY ALL),
    w AS (SELECT event_id, user_id, segment, ts_us + h * 3600000000 AS t, h
          FROM k, (VALUES (1), (2), (4)) AS hs(h)),
    l AS (SELECT w.*, p.ts_us AS lt, p.v AS lv FROM w ASOF LEFT JOIN p
          ON w.user_id = p.user_id AND w.segment = p.segment AND w.t >= p.ts_us),
    b AS (SELECT l.*, p.ts_us AS rt, p.v AS rv FROM l ASOF LEFT JOIN p
          ON l.user_id = p.user_id AND l.segment = p.segment AND l.t <= p.ts_us),
    i AS (SELECT *, CASE WHEN rt IS NULL THEN NULL WHEN rt = lt THEN lv
                 ELSE lv + (t - lt) * (rv - lv) / (rt - lt) END AS reached FROM b)
    SELECT event_id, round(max(CASE WHEN h = 1 THEN reached END), 6) AS h1,
           round(max(CASE WHEN h = 2 THEN reached END), 6) AS h2,
           round(max(CASE WHEN h = 4 THEN reached END), 6) AS h4 FROM i GROUP BY event_id
    """,
)
def horizon_lookup(spark, sf_dir):
    rows, tl = segmented_timeline(spark, sf_dir)
    rows = rows.select("user_id", "segment", "ts_us", "event_id", "value")
    hours = [h * HOUR_US for h in (1, 2, 4)]
    ahead = asof.look_ahead(rows, ["user_id", "segment"], "ts_us", ["value"], hours, "event_id", width=tl.width)
    return ahead.select(
        "event_id", *[r6(F.col("ahead")[i]["value"]).alias(f"h{h}") for i, h in enumerate((1, 2, 4))]
    )


@query(
    "c3_pair_both_ways",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_left, l.doc_id IS NOT NULL AS in_right
       FROM documents d FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL
            SELECT doc_id + 1000000 FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""",
)
def pair_both_ways(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels")
    stray = labels.where("toxic = 1").select((F.col("doc_id") + 1000000).alias("doc_id"))
    return pairing.pair(docs, labels.where("quality = 1").select("doc_id").union(stray), ["doc_id"])


@query(
    "c4_outstanding_plan",
    """SELECT count(*) AS total, count(l.doc_id) AS existing, count(*) - count(l.doc_id) AS pending
       FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality > 0) l ON d.doc_id = l.doc_id""",
)
def outstanding_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return pairing.work_plan(docs, table(spark, sf_dir, "labels"), ["doc_id"], "quality")


@query(
    "c4_outstanding_rows",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)",
)
def outstanding_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return pairing.outstanding(docs, table(spark, sf_dir, "labels"), ["doc_id"], "quality")


@query(
    "c5_preferred_match",
    """
    WITH r AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END AS k,
                      event_id % 50 AS slot, event_id FROM events),
    b AS (SELECT user_id, slot, min(k) AS k FROM r WHERE k IS NOT NULL GROUP BY ALL),
    m AS (SELECT b.user_id, b.slot, b.k, min(r.event_id) AS event_id FROM b JOIN r USING (user_id, slot, k) GROUP BY ALL)
    SELECT u.user_id, u.slot, CASE m.k WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'error' END AS event_type, m.event_id
    FROM (SELECT DISTINCT user_id, slot FROM r) u LEFT JOIN m ON u.user_id = m.user_id AND u.slot = m.slot
    """,
)
def preferred_match(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("slot", F.col("event_id") % 50)
    wanted = rows.select("user_id", "slot").distinct()
    candidates = rows.groupBy("user_id", "slot", "event_type").agg(F.min("event_id").alias("event_id"))
    return pairing.preferred(wanted, candidates, ["user_id", "slot"], "event_type", ["view", "click", "error"])


_LUT_SQL = """
    WITH lut AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 2), (4, 255)) AS v(level3_id, train_id)),
    c AS (SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
             + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END * 3 AS INTEGER) AS level3_id, year(l_shipdate) AS year FROM lineitem)
"""


def _class_rows(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "O", 3).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (flag + status).alias("level3_id"),
        F.year("l_shipdate").cast("bigint").alias("year"),
    )


def _small_lut(spark):
    return spark.createDataFrame(
        [(0, 0), (1, 1), (2, 2), (3, 2), (4, 255)], "level3_id int, train_id int"
    )


@query(
    "c6_lut_apply",
    _LUT_SQL
    + """SELECT l_orderkey, l_linenumber, level3_id, coalesce(train_id, 255) AS train_id
         FROM c LEFT JOIN lut USING (level3_id)""",
)
def lut_apply(spark, sf_dir):
    rows = taxonomy.apply_lut(_class_rows(spark, sf_dir), _small_lut(spark))
    return rows.select("l_orderkey", "l_linenumber", "level3_id", "train_id")


@query(
    "g4_unknown_ids",
    _LUT_SQL + "SELECT DISTINCT year AS path, level3_id FROM c WHERE level3_id NOT IN (SELECT level3_id FROM lut)",
)
def unknown_ids(spark, sf_dir):
    rows = _class_rows(spark, sf_dir).withColumnRenamed("year", "path")
    return taxonomy.unknown_ids(rows, _small_lut(spark), "path")


_LABELS_SQL = """
    WITH labels_ AS (SELECT DISTINCT p_name AS name, CAST(length(p_name) AS INTEGER) AS level3_id FROM part),
    groups_ AS (SELECT DISTINCT CAST(p_size % 4 AS INTEGER) AS train_id,
                       replace(upper(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || p_name END), ' ', '-') AS member FROM part
                UNION SELECT 9, 'no such-' || p_brand FROM part),
    n AS (SELECT *, lower(translate(name, ' -_', '')) AS normalized FROM labels_),
    w AS (SELECT *, lower(translate(member, ' -_', '')) AS normalized FROM groups_),
    r AS (SELECT n.name, n.level3_id, w.train_id, w.member FROM n JOIN w USING (normalized))
"""


def _labels_and_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    labels = p.select(
        F.col("p_name").alias("name"), F.length("p_name").alias("level3_id")
    ).distinct()
    named = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_brand", "p_name"))
    member = F.replace(F.upper(named), F.lit(" "), F.lit("-"))
    groups = (
        p.select((F.col("p_size") % 4).alias("train_id"), member.alias("member"))
        .union(p.select(F.lit(9).alias("train_id"), F.concat(F.lit("no such-"), "p_brand").alias("member")))
        .distinct()
        .withColumn("group", F.concat(F.lit("g"), "train_id"))
    )
    return labels, groups


@query("c7_resolve_names", _LABELS_SQL + "SELECT name, level3_id, train_id, member FROM r")
def resolve_names(spark, sf_dir):
    found = taxonomy.resolve(*_labels_and_groups(spark, sf_dir))
    return found.select("name", "level3_id", "train_id", "member")


@query(
    "c7_unresolved_names",
    _LABELS_SQL + "SELECT train_id, member FROM w WHERE normalized NOT IN (SELECT normalized FROM n)",
)
def unresolved_names(spark, sf_dir):
    return taxonomy.unresolved(*_labels_and_groups(spark, sf_dir)).select("train_id", "member")


@query(
    "d16_group_conflicts",
    _LABELS_SQL
    + """SELECT level3_id, count(DISTINCT train_id) AS groups FROM r GROUP BY level3_id
         HAVING count(DISTINCT train_id) > 1""",
)
def group_conflicts(spark, sf_dir):
    return taxonomy.conflicts(taxonomy.resolve(*_labels_and_groups(spark, sf_dir)))


@query(
    "g3_orphan_ids",
    _LABELS_SQL + "SELECT level3_id FROM labels_ EXCEPT SELECT level3_id FROM r WHERE train_id < 2",
)
def orphan_ids(spark, sf_dir):
    labels, groups = _labels_and_groups(spark, sf_dir)
    return taxonomy.orphans(labels, taxonomy.resolve(labels, groups).where("train_id < 2"))


_FIELD_SQL = """
    WITH old AS (SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS proposed,
                        CASE WHEN n_nationkey % 3 = 0 THEN 'unconfirmed' ELSE 'confirmed' END AS state FROM nation),
    fresh AS (SELECT c.c_custkey, n.n_nationkey, CAST(CASE WHEN c_custkey % 4 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS VARCHAR)
                     AS proposed FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


@query(
    "c8_carry_confirmations",
    _FIELD_SQL
    + """SELECT c_custkey, n_nationkey, f.proposed,
         CASE WHEN o.state = 'confirmed' AND o.proposed = f.proposed THEN 'confirmed' ELSE 'unconfirmed' END AS state
         FROM fresh f LEFT JOIN old o USING (n_nationkey)""",
)
def carry_confirmations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    old = nation.select(
        "n_nationkey",
        F.col("n_regionkey").cast("string").alias("proposed"),
        F.when(F.col("n_nationkey") % 3 == 0, "unconfirmed").otherwise("confirmed").alias("state"),
    )
    moved = F.when(F.col("c_custkey") % 4 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey"))
    fresh = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_nationkey", moved.cast("string").alias("proposed"), F.lit("unconfirmed").alias("state"))
    )
    return governance.carry_forward(fresh, old, keys=["n_nationkey"])


@query(
    "c9_nearest_offset",
    """
    WITH k AS (SELECT * FROM (VALUES (0, 19800), (1, 0), (2, 18000), (3, 16200), (4, 21600)) AS v(i, s)),
    r AS (SELECT event_id, value * 100 - 5000 AS raw FROM events),
    j AS (SELECT event_id, raw, s, row_number() OVER (PARTITION BY event_id ORDER BY abs(raw - s), i) AS rn FROM r, k)
    SELECT event_id, s AS offset_s, round(raw - s, 6) AS residual FROM j WHERE rn = 1
    """,
)
def nearest_offset(spark, sf_dir):
    raw = F.col("value") * 100 - 5000
    near = events(spark, sf_dir).select("event_id", raw.alias("raw"), rates.nearest_offset(raw).alias("near"))
    return near.select(
        "event_id", F.col("near.seconds").alias("offset_s"), r6(F.col("raw") - F.col("near.seconds")).alias("residual")
    )


@query(
    "c10_prediction_truth",
    """
    WITH p AS (SELECT doc_id FROM labels), t AS (SELECT doc_id FROM documents)
    SELECT (SELECT count(*) FROM p JOIN t USING (doc_id)) AS matched,
           (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM t)) AS left_only,
           (SELECT count(*) FROM t WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS right_only,
           false AS aligned
    """,
)
def prediction_truth(spark, sf_dir):
    truth = table(spark, sf_dir, "documents").select("doc_id")
    return pairing.misses(table(spark, sf_dir, "labels").select("doc_id"), truth, ["doc_id"])


@query(
    "c11_epoch_alignment",
    """
    WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch
               FROM events WHERE event_type = 'purchase'),
    s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
                 count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view')
    SELECT e.event_id, e.user_id, e.epoch, s.value AS aligned FROM e LEFT JOIN s
    ON e.user_id = s.user_id AND s.i = least(e.epoch, s.n - 1)
    """,
)
def epoch_alignment(spark, sf_dir):
    from trackhouse.operators.timeline import number_rows, timeline

    e = events(spark, sf_dir)
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts_us")
    numbered = number_rows(buys, timeline(buys, ["user_id"], "ts_us", ties=["event_id"]), "n")
    epochs = numbered.select("event_id", "user_id", (F.col("n") - 1).alias("epoch"))
    views = e.where("event_type = 'view'")
    return runlog.align_to_epochs(epochs, views, ["user_id"], "epoch", "ts_us", "value", "aligned", ties=["event_id"])


@query(
    "c11_carried_epoch",
    """
    WITH s AS (SELECT user_id, epoch_us(ts) // 3600000000 AS epoch, arg_max(value, (ts, event_id)) AS aligned
               FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT e.event_id, e.user_id, epoch_us(e.ts) // 3600000000 AS epoch, s.aligned
    FROM events e LEFT JOIN s ON e.user_id = s.user_id AND epoch_us(e.ts) // 3600000000 = s.epoch WHERE event_type = 'purchase'
    """,
)
def carried_epoch(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("epoch", F.floor(F.col("ts_us") / 3_600_000_000))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "epoch")
    views = e.where("event_type = 'view'")
    return runlog.align_by_epoch(buys, views, ["user_id"], "epoch", ["ts_us", "event_id"], "value", "aligned")


@query(
    "c12_segment_members",
    SEGMENT_SQL
    + """SELECT event_id FROM events WHERE event_id IN (SELECT event_id FROM n WHERE seg_rows >= 5)""",
)
def segment_members(spark, sf_dir):
    members = segmented(spark, sf_dir).where("seg_rows >= 5").select("event_id")
    return events(spark, sf_dir, "event_id").select("event_id").join(members, "event_id", "left_semi")


@query(
    "c13_model_comparison",
    """
    WITH s AS (SELECT doc_id, quality AS truth, toxic AS a, CAST(doc_id % 2 AS INTEGER) AS b FROM labels)
    SELECT truth, a, b, count(*) AS n FROM s GROUP BY ALL
    """,
)
def model_comparison(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    first = labels.select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("a"))
    second = labels.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("b"))
    return first.join(second, "doc_id").groupBy("truth", "a", "b").agg(F.count(F.lit(1)).alias("n"))


_PARITY_SQL = """
    WITH s AS (SELECT quality AS t, toxic AS a, doc_id % 2 AS b FROM labels),
    k AS (SELECT unnest([0, 1]) AS c),
    h AS (SELECT c, (SELECT count(*) FROM s WHERE t = c)::DOUBLE AS t, (SELECT count(*) FROM s WHERE a = c) AS pa, (SELECT count(*) FROM s WHERE b = c) AS pb,
                 (SELECT count(*) FROM s WHERE t = c AND a = c) AS ha, (SELECT count(*) FROM s WHERE t = c AND b = c) AS hb FROM k),
    m AS (SELECT 'miou' AS metric, 100 * avg(ha / (t + pa - ha)) AS x, 100 * avg(hb / (t + pb - hb)) AS y FROM h
          UNION ALL SELECT 'pixel_accuracy', 100 * sum(ha) / sum(t), 100 * sum(hb) / sum(t) FROM h)
"""


def _two_models(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    truth = F.col("quality").alias("truth")
    other = (F.col("doc_id") % 2).cast("int").alias("pred")
    return metrics.compare_models(labels.select(truth, F.col("toxic").alias("pred")), labels.select(truth, other))


@query(
    "c13_model_parity",
    _PARITY_SQL
    + """SELECT metric, round(x, 6) AS first, round(y, 6) AS second, round(abs(x - y), 6) AS delta, 1.0::DOUBLE AS tolerance, abs(x - y) <= 1.0 AS passed FROM m""",
)
def model_parity(spark, sf_dir):
    return _two_models(spark, sf_dir).withColumns({c: r6(F.col(c)) for c in ("first", "second", "delta")})


@query(
    "d24_parity_document",
    _PARITY_SQL + "SELECT bool_and(abs(x - y) <= 1.0) AS passed, count(*) AS checks, round(max(abs(x - y)), 6) AS worst_delta FROM m",
)
def parity_document(spark, sf_dir):
    return metrics.parity_document(_two_models(spark, sf_dir)).withColumn("worst_delta", r6(F.col("worst_delta")))


@query(
    "d15_duplicate_keys",
    """SELECT l_returnflag, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates
       FROM lineitem GROUP BY l_returnflag""",
)
def duplicate_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return duplicate_keys(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber"])


@query(
    "g1_union_all",
    """SELECT o_custkey AS k, count(*) AS n, count(o_totalprice) AS priced, count(acct) AS with_account FROM (
         SELECT o_custkey, o_totalprice FROM orders UNION ALL BY NAME SELECT c_custkey AS o_custkey, c_acctbal AS acct FROM customer)
       GROUP BY o_custkey""",
)
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    b = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("acct")
    )
    return a.unionByName(b, allowMissingColumns=True).groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("o_totalprice").alias("priced"),
        F.count("acct").alias("with_account"),
    )


@query(
    "g2_set_difference",
    """SELECT 'unlabelled' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT 'unlabelled_page', page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""",
)
def set_difference(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    a = docs.select("doc_id").subtract(labels)
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).subtract(labels)
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "doc_id")
    return tag(a, "unlabelled").union(tag(b, "unlabelled_page"))


@query(
    "g5_first_seen_columns",
    """
    WITH s AS (SELECT lang, source, min(doc_id) AS seen FROM documents GROUP BY ALL)
    SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY seen, source) AS ordinal FROM s
    """,
)
def first_seen_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.lit(0).alias("t"))
    return roles.first_seen_columns(docs, "lang", "t", "doc_id", "source")


@query(
    "g6_distinct_sequences",
    "SELECT lang, count(DISTINCT source) AS sequences FROM documents GROUP BY lang",
)
def distinct_sequences(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_distinct("source").alias("sequences")
    )
