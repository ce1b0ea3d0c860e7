"""Collapsing a label taxonomy: name resolution, conflicts, orphans, the lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.functions.text import normalize_name

# The eight classes, their member labels, and the labels to ignore.
IGNORE_ID = 255
GROUPS = (
    ("drivable", ("road",)),
    ("alt_drivable", ("parking", "drivablefallback")),
    ("nondrivable", ("sidewalk", "railtrack", "nondrivablefallback", "curb")),
    ("vru", ("person", "rider", "animal")),
    ("twowheeler", ("motorcycle", "bicycle")),
    ("vehicle", ("car", "truck", "bus", "autorickshaw", "caravan", "trailer", "train",
                 "vehiclefallback")),
    ("structure", ("wall", "fence", "guardrail", "billboard", "trafficsign", "trafficlight",
                   "pole", "polegroup", "obsstrbarfallback", "building", "bridge", "tunnel")),
    ("background", ("vegetation", "sky", "fallbackbackground")),
)
IGNORE_NAMES = ("unlabeled", "egovehicle", "rectificationborder", "outofroi", "licenseplate")


def group_table(spark) -> DataFrame:
    """``train_id, group, member`` for the eight classes and the ignored labels."""
    rows = [(i, g, m) for i, (g, members) in enumerate(GROUPS) for m in members]
    rows += [(IGNORE_ID, "ignore", m) for m in IGNORE_NAMES]
    return spark.createDataFrame(rows, "train_id int, group string, member string")


def resolve(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels joined to their group by normalised name."""
    named = labels.withColumn("normalized", normalize_name(F.col("name")))
    wanted = groups.withColumn("normalized", normalize_name(F.col("member")))
    return named.join(wanted, "normalized")


def unresolved(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Group members that name no label."""
    known = labels.select(normalize_name(F.col("name")).alias("normalized"))
    wanted = groups.withColumn("normalized", normalize_name(F.col("member")))
    return wanted.join(known, "normalized", "left_anti").drop("normalized")


def conflicts(resolved: DataFrame) -> DataFrame:
    """Ids claimed by more than one group."""
    return (
        resolved.groupBy("level3_id")
        .agg(F.count_distinct("train_id").alias("groups"))
        .where(F.col("groups") > 1)
    )


def orphans(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """Ids that no group covers."""
    return labels.select("level3_id").subtract(resolved.select("level3_id"))


def build_lut(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """``level3_id, train_id, group``, or an error that names every problem.

    The tables hold one row per label name; the checks bring back only offending names.
    """
    missing = [f"{r.member} ({r.group})" for r in unresolved(labels, groups).collect()]
    if missing:
        raise ValueError(f"label names do not resolve: {', '.join(sorted(missing))}")
    found = resolve(labels, groups)
    clashing = sorted(r.level3_id for r in conflicts(found).collect())
    if clashing:
        raise ValueError(f"ids in more than one group: {clashing}")
    left = sorted(r.level3_id for r in orphans(labels, found).collect())
    if left:
        raise ValueError(f"ids in no group and not ignored: {left}")
    return found.select("level3_id", "train_id", "group").distinct()


def apply_lut(df: DataFrame, lut: DataFrame, id_col: str = "level3_id") -> DataFrame:
    """Add ``train_id``; an id outside the table becomes the ignore id.

    A lookup table has at most 256 ids, so Spark broadcasts it by its size.
    """
    table = lut.select(F.col("level3_id").alias(id_col), "train_id")
    return df.join(table, id_col, "left").withColumn(
        "train_id", F.coalesce("train_id", F.lit(IGNORE_ID))
    )


def unknown_ids(df: DataFrame, lut: DataFrame, path: str, id_col: str = "level3_id") -> DataFrame:
    """Distinct ``(path, id)`` pairs that the table does not know."""
    table = lut.select(F.col("level3_id").alias(id_col))
    return df.select(path, id_col).distinct().join(table, id_col, "left_anti").select(path, id_col)


def lut_document(lut: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """The lookup table as one JSON document (one row, column ``value``)."""
    ids = lut.groupBy("train_id", "group").agg(
        F.sort_array(F.collect_set("level3_id")).alias("level3_ids")
    )
    members = groups.groupBy("train_id").agg(F.sort_array(F.collect_list("member")).alias("members"))
    per_group = ids.join(members, "train_id")
    names = resolve(labels, groups).select(
        "train_id", "level3_id", "name", "normalized", "group"
    )
    one = per_group.agg(
        F.sort_array(
            F.collect_list(F.struct("train_id", "group", "members", "level3_ids"))
        ).alias("groups")
    )
    table = lut.agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("level3_id").cast("string"), "train_id")))
        ).alias("id_to_train_id")
    )
    listed = names.agg(F.sort_array(F.collect_list(F.struct(*names.columns))).alias("name_table"))
    # Three one-row tables about at most 256 ids.
    joined = one.join(table, F.lit(True)).join(listed, F.lit(True))
    return joined.select(
        F.to_json(
            F.struct(
                F.size(F.filter("groups", lambda g: g["train_id"] != IGNORE_ID)).alias("num_classes"),
                F.lit(IGNORE_ID).alias("ignore_id"),
                "groups",
                "id_to_train_id",
                "name_table",
            )
        ).alias("value")
    )
