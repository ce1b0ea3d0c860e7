"""Discover a sensor tree, check an annotated image tree, and propose the field map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.functions.text import (
    clock_seconds,
    image_frame_key,
    polygon_frame_key,
    route_of,
    stereo_side,
)
from trackhouse.operators import checks as chk
from trackhouse.operators import inventory as inv
from trackhouse.operators import rates
from trackhouse.operators.governance import UNCONFIRMED
from trackhouse.operators.pairing import capped_listing, first_of, pair
from trackhouse.operators.roles import first_seen_columns
from trackhouse.session import durable
from trackhouse.sources import tables as tab
from trackhouse.sources.files import annotated_tree, file_tree

# Fixed values.
ANNOTATED_SPLITS = ("train", "val")
IMAGE_TOP, POLYGON_TOP = "leftImg8bit", "gtFine"
TABLE_GLOB = "*.{csv,txt,tsv,CSV,TXT,TSV}"


@dataclass(frozen=True)
class Discovery:
    """What a tree holds; every member is a DataFrame."""

    files: DataFrame
    lines: DataFrame
    tables: DataFrame
    roles: DataFrame
    rates: DataFrame
    image_dirs: DataFrame
    lidar_dirs: DataFrame
    unassigned: DataFrame


def discover(spark: SparkSession, root: str) -> Discovery:
    """Tables with their kind, roles and rate; image and lidar directories; all by route."""
    files = file_tree(spark, root)
    base = root.rstrip("/").removeprefix("file:")

    def place(path: Column) -> Column:
        rel = F.regexp_replace(path, r"^file:/*", "/")
        return F.regexp_replace(F.regexp_replace(rel, r"^\Q" + base + r"\E/", ""), r"/?[^/]*$", "")

    lines = tab.raw_lines(spark, root, glob=TABLE_GLOB)
    # One row per table, read by every later step, at the cost of a pass over all lines.
    sniffed = durable(tab.sniff(lines))
    roles, kinds = tab.describe(sniffed)
    tables = sniffed.join(kinds, "path", "left").withColumn("route", route_of(place(F.col("path"))))
    times = roles.where("role = 'time'").select("path", F.col("column").alias("_time"))
    rows = tab.records(lines, sniffed).join(times, "path")
    stamped = durable(rows.select("path", clock_seconds(tab.field(F.col("_time"))).alias("t")))
    measured = durable(rates.measure_rates(stamped, ["path"], "t"))
    dirs = inv.directory_summary(files).withColumn("route", route_of(F.col("dir")))
    images = dirs.where("kind = 'image'").withColumn(
        "side", stereo_side(F.element_at(F.split("dir", "/"), -1))
    )
    return Discovery(
        files,
        lines,
        tables,
        roles,
        measured,
        images.withColumnRenamed("dir", "path"),
        dirs.where("kind = 'lidar'").withColumnRenamed("dir", "path"),
        tables.where("route IS NULL").select("path", "kind"),
    )


def _first_tables(found: Discovery, kind: str) -> DataFrame:
    """The first table of each route, whose roles and rate speak for the route."""
    of_kind = found.tables.where(
        (F.col("kind") == kind) & F.col("route").isNotNull() & F.col("error").isNull()
    )
    return first_of(of_kind.select("route", "path"), ["route"], F.col("path"))


def route_rates(found: Discovery, kind: str) -> DataFrame:
    return _first_tables(found, kind).join(found.rates, "path")


def propose_field_map(found: Discovery) -> DataFrame:
    """One row per route and field with its evidence; everything starts unconfirmed."""
    rows = []
    for kind in ("gps", "obd"):
        of_kind = found.tables.where((F.col("kind") == kind) & F.col("route").isNotNull())
        names = of_kind.select("route", "path", F.posexplode("columns").alias("pos", "name"))
        # Names are folded before they are listed, so a list is as long as there are different names.
        seen = first_seen_columns(names, "route", "path", "pos", "name").groupBy("route").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("columns")
        )
        columns = of_kind.groupBy("route").agg(F.count(F.lit(1)).alias("_tables")).join(seen, "route", "left")
        hz = F.coalesce(F.col("hz").cast("string"), F.lit("?"))
        rows.append(
            _first_tables(found, kind)
            .join(found.roles, "path")
            .join(found.rates.select("path", "hz"), "path", "left")
            .join(columns, "route")
            .select(
                "route",
                F.concat(F.lit(f"{kind}."), "role").alias("field"),
                F.lit("column").alias("kind"),
                F.col("column").alias("proposed"),
                "confidence",
                "candidates",
                "columns",
                F.concat(
                    F.col("_tables").cast("string"), F.lit(" table(s), "), hz,
                    F.lit(" Hz, columns: "), F.array_join("columns", ", "),
                ).alias("evidence"),
            )
        )
    gps, obd = route_rates(found, "gps"), route_rates(found, "obd")
    none = F.array().cast("array<string>")

    def scalar(df: DataFrame, name: str, evidence: Column) -> DataFrame:
        return df.select(
            "route",
            F.lit(name).alias("field"),
            F.lit("scalar").alias("kind"),
            F.col("proposed_s").cast("string").alias("proposed"),
            F.lit("measured").alias("confidence"),
            none.alias("candidates"),
            none.alias("columns"),
            evidence.alias("evidence"),
        )

    offset_note = F.format_string(
        "%s; raw offset %.3f s, residual %.3f s", "hypothesis", "raw_offset_s", "residual_s"
    )
    tolerance_note = F.format_string(
        "one measured interval of %.3f s at %.3f Hz", "measured_median_dt_s", "measured_hz"
    )
    rows.append(scalar(rates.propose_offsets(gps, obd), "clock_offset", offset_note))
    rows.append(scalar(rates.propose_tolerances(obd), "obd_tolerance", tolerance_note))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.withColumns(
        {"state": F.lit(UNCONFIRMED), "confirmed_s": F.lit(None).cast("double")}
    )


def mappings(field_map: DataFrame, found: Discovery, kind: str) -> DataFrame:
    """Per table: its route, the confirmed column of each role, and the clock offset."""
    fields = {"gps": ("time", "lat", "lon", "frame"), "obd": ("time", "speed")}[kind]
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    offset = F.coalesce("confirmed_s", F.col("proposed").try_cast("double"))
    per_route = field_map.withColumn("_s", offset).groupBy("route").agg(
        *[pick(f"{kind}.{f}", "proposed").alias(f) for f in fields],
        pick("clock_offset", "_s").alias("offset_s"),
        pick("obd_tolerance", "_s").alias("tolerance_s"),
    )
    return found.tables.where(F.col("kind") == kind).select("path", "route").join(per_route, "route")


def annotated_report(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Per-split counts with capped miss lists, and the check rows they lead to."""
    files = file_tree(spark, root)
    images = annotated_tree(files, IMAGE_TOP, image_frame_key).where("suffix IN ('.png','.jpg','.jpeg')")
    polygons = annotated_tree(files, POLYGON_TOP, polygon_frame_key).where("suffix = '.json'")
    keys = ["split", "sequence", "frame_key"]
    both = pair(images, polygons.where(F.col("split").isin(*ANNOTATED_SPLITS)), keys)
    name = F.concat_ws("/", *keys)
    lists = {}
    annotated = both.where(F.col("split").isin(*ANNOTATED_SPLITS))
    for out, cond in (("without_polygons", ~F.col("in_right")), ("without_images", ~F.col("in_left"))):
        lists[out] = capped_listing(annotated.where(cond).select("split", name.alias("item")), ["split"], "item")
        lists[out] = lists[out].select("split", F.col("n").alias(f"n_{out}"), F.col("items").alias(out))
    per_split = both.groupBy("split").agg(
        F.count_if("in_left").alias("images"),
        F.count_if("in_right").alias("polygons"),
        F.count_distinct(F.when(F.col("in_left"), F.col("sequence"))).alias("sequences"),
    )
    report = per_split
    for out, listed in lists.items():
        report = report.join(listed, "split", "left").fillna({f"n_{out}": 0})
    pairing_checks = report.where(F.col("split").isin(*ANNOTATED_SPLITS)).select(
        *chk.check_row(
            F.concat(F.lit("pairing."), "split"),
            (F.col("n_without_polygons") == 0) & (F.col("n_without_images") == 0),
            F.format_string(
                "%d images, %d polygons, %d without polygons, %d without images",
                "images", "polygons", "n_without_polygons", "n_without_images",
            ),
        )
    )
    expected = spark.sql(
        "VALUES " + ", ".join(f"('{k}', {v})" for k, v in chk.EXPECTED_IMAGES.items())
    ).toDF("split", "expected")
    drifts = chk.count_drift(report.select("split", F.col("images").alias("n")), expected, "split")
    count_checks = drifts.select(
        *chk.check_row(
            F.concat(F.lit("count."), "split"),
            F.col("ok"),
            F.format_string("%d images, about %d expected", "n", "expected"),
            "warn",
        )
    )
    return report, pairing_checks.unionByName(count_checks)
