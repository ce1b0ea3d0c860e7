"""Which column of a discovered table plays which role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Header patterns per role, most specific first.
ROLE_PATTERNS = {
    "time": (r"^timestamp$", r"^time$", r"^ts$", r"^t$", r".*time.*", r".*stamp.*"),
    "lat": (r"^latitude$", r"^lat$", r".*latitude.*", r".*\blat\b.*"),
    "lon": (r"^longitude$", r"^lon$", r"^lng$", r".*longitude.*", r".*\blon\b.*"),
    "speed": (r"^speed$", r"^velocity$", r"^vel$", r".*speed.*", r".*velocity.*"),
    "frame": (r"^image_idx$", r"^frame$", r"^frame_idx$", r".*image.*idx.*", r".*frame.*"),
}


def match_roles(
    headers: DataFrame, table: str, position: str, name: str, patterns=None
) -> DataFrame:
    """``(table, role, column, confidence, candidates)`` from one row per table column.

    Every pattern is a column expression over the header, so no pattern table is joined. The
    groups are the columns of one table.
    """
    patterns = patterns or ROLE_PATTERNS
    text = F.lower(F.trim(name))
    ranks = []
    for role, options in patterns.items():
        rank = F.lit(None).cast("int")
        for i in reversed(range(len(options))):
            rank = F.when(text.rlike(options[i]), F.lit(i)).otherwise(rank)
        ranks.append(F.struct(F.lit(role).alias("role"), rank.alias("rank")))
    hits = headers.withColumn("_hit", F.explode(F.array(*ranks))).where("_hit.rank IS NOT NULL")
    # The same header may occur twice in a table; it is one candidate.
    hits = hits.groupBy(table, F.col("_hit.role").alias("role"), name).agg(
        F.min(F.struct(F.col("_hit.rank").alias("rank"), F.col(position).alias("pos"))).alias("_at")
    )
    listed = F.sort_array(F.collect_list(F.struct("_at", F.col(name).alias("c"))))
    return (
        hits.groupBy(table, "role")
        .agg(listed.alias("_all"))
        .select(
            table,
            "role",
            F.col("_all")[0]["c"].alias("column"),
            F.when(F.col("_all")[0]["_at"]["rank"] <= 1, "exact").otherwise("fuzzy").alias(
                "confidence"
            ),
            F.transform("_all", lambda x: x["c"]).alias("candidates"),
        )
    )


def table_kinds(roles: DataFrame, table: str) -> DataFrame:
    """``gps`` with a position, else ``obd`` with a speed, else ``unknown``."""
    has = lambda r: F.max(F.col("role") == r)
    kind = (
        F.when(F.col("lat") & F.col("lon"), "gps").when(F.col("speed"), "obd").otherwise("unknown")
    )
    return (
        roles.groupBy(table)
        .agg(has("lat").alias("lat"), has("lon").alias("lon"), has("speed").alias("speed"))
        .select(table, kind.alias("kind"))
    )


def first_seen_columns(
    headers: DataFrame, key: str, table: str, position: str, name: str
) -> DataFrame:
    """Distinct column names of a key in first-seen order, as ``(key, name, ordinal)``."""
    seen = headers.groupBy(key, name).agg(F.min(F.struct(table, position)).alias("_at"))
    order = Window.partitionBy(key).orderBy("_at", name)
    return seen.select(key, name, F.row_number().over(order).cast("bigint").alias("ordinal"))
