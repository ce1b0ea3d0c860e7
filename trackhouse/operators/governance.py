"""Proposed mappings and their confirmation: nothing is labelled on an unconfirmed guess.

A field map has one row per route and field:
``route, field, kind, proposed, confidence, candidates, columns, state, confirmed_s, evidence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
CONFIRMED, UNCONFIRMED = "confirmed", "unconfirmed"
GPS_FIELDS = ("gps.time", "gps.lat", "gps.lon", "gps.frame")
OBD_FIELDS = ("obd.time", "obd.speed")
SCALAR_FIELDS = ("clock_offset", "obd_tolerance")
#: Open fields and routes that an error names; it always tells how many there are.
LISTED = 50
FIELD_MAP_SCHEMA = (
    "route string, field string, kind string, proposed string, confidence string, "
    "candidates array<string>, columns array<string>, state string, confirmed_s double, "
    "evidence string"
)


def carry_forward(fresh: DataFrame, old: DataFrame, keys=("route", "field"), value="proposed") -> DataFrame:
    """A confirmation survives a re-scan only if it still means the same proposal."""
    keys = list(keys)
    before = old.select(
        *keys,
        F.col(value).alias("_value"),
        F.col("state").alias("_state"),
        *([F.col("confirmed_s").alias("_confirmed_s")] if "confirmed_s" in old.columns else []),
    )
    same = (F.col("_state") == CONFIRMED) & F.col("_value").eqNullSafe(F.col(value))
    out = fresh.join(before, keys, "left").withColumn(
        "state", F.when(same, CONFIRMED).otherwise(F.col("state"))
    )
    if "confirmed_s" in old.columns:
        out = out.withColumn(
            "confirmed_s", F.when(same, F.coalesce("_confirmed_s", "confirmed_s")).otherwise(F.col("confirmed_s"))
        )
    return out.select(*fresh.columns)


def _wanted(gps, obd):
    """The fields a route must have: position always, bus fields when it has any."""
    names = lambda fields: F.array(*[F.lit(f) for f in fields])
    return F.when(gps & obd, names(GPS_FIELDS + OBD_FIELDS)).when(gps, names(GPS_FIELDS))


def pending(field_map: DataFrame) -> DataFrame:
    """Every required field that is missing or not confirmed, one row each.

    A scalar field that was never measured is not listed here; the gate below asks for it. A route's
    rows are gathered once and judged together: nothing is joined, so no table of routes is ever
    broadcast, whatever Spark takes its size for.
    """
    asked = F.col("field").isin(*GPS_FIELDS, *OBD_FIELDS, *SCALAR_FIELDS)
    has = lambda prefix: F.bool_or(F.startswith("field", F.lit(prefix)))
    routes = field_map.groupBy("route").agg(
        has("gps.").alias("_gps"), has("obd.").alias("_obd"),
        F.collect_list(F.when(asked, F.struct("field", "proposed", "state"))).alias("_rows"),
    ).where("_gps").withColumn("_wanted", _wanted(F.col("_gps"), F.col("_obd")))
    scalar = lambda r: F.col("_obd") & r["field"].isin(*SCALAR_FIELDS) & r["state"].isNotNull()
    unsettled = F.filter(
        "_rows",
        lambda r: (r["state"].isNull() | (r["state"] != CONFIRMED)) & (F.array_contains("_wanted", r["field"]) | scalar(r)),
    )
    given = F.transform(unsettled, lambda r: F.struct(r["field"].alias("field"), r["proposed"].alias("proposed")))
    lacking = F.transform(
        F.array_except("_wanted", F.transform("_rows", lambda r: r["field"])),
        lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("proposed")),
    )
    return routes.select("route", F.explode(F.concat(given, lacking)).alias("_open")).select("route", "_open.field", "_open.proposed")


def edit_problems(field_map: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (route, field, column) that cannot be made, each with its ``problem``.

    A field of a block (``gps.time``) may be new if the block is there, and takes only columns of
    the block's tables; any other field must exist.
    """
    block = F.split_part("field", F.lit("."), F.lit(1))
    # Only the routes that are edited: what is joined below is as small as the edits.
    field_map = field_map.join(edits.select("route").distinct(), "route", "left_semi")
    blocks = field_map.withColumn("_block", block).groupBy("route", "_block").agg(
        F.flatten(F.collect_set(F.coalesce("columns", F.array().cast("array<string>")))).alias("_columns")
    )
    routes = field_map.select("route").distinct().withColumn("_route", F.lit(True))
    names = field_map.select("route", "field").distinct().withColumn("_known", F.lit(True))
    asked = (
        edits.withColumn("_block", block)
        .join(routes, "route", "left")
        .join(blocks, ["route", "_block"], "left")
        .join(names, ["route", "field"], "left")
    )
    of_block = F.contains("field", F.lit("."))
    stray = F.col("column").isNotNull() & of_block & ~F.array_contains("_columns", F.col("column"))
    problem = (
        F.when(F.col("_route").isNull(), "no such route")
        .when(of_block & F.col("_columns").isNull(), "no table of this kind on the route")
        .when(~of_block & F.col("_known").isNull(), "no such field on the route")
        .when(stray, F.concat(F.lit("unknown column; the columns are "), F.array_join(F.array_sort("_columns"), ", ")))
    )
    return asked.select("route", "field", "column", problem.alias("problem")).where("problem IS NOT NULL")


def set_field(
    field_map: DataFrame,
    route: str,
    field: str,
    *,
    column: str | None = None,
    value: float | None = None,
    confirmed: bool = True,
) -> DataFrame:
    """Confirm or override one field; naming a column confirms it. An edit that cannot be made raises."""
    edit = field_map.sparkSession.createDataFrame([(route, field, column)], "route string, field string, column string")
    wrong = edit_problems(field_map, edit).first()
    if wrong:
        raise ValueError(f"cannot set {field!r} of route {route!r}: {wrong.problem}")
    state = CONFIRMED if confirmed else UNCONFIRMED
    hit = (F.col("route") == route) & (F.col("field") == field)
    changes = {"state": F.lit(state)}
    if column is not None:
        changes |= {"proposed": F.lit(column), "confidence": F.lit("manual")}
    if value is not None:
        changes["confirmed_s"] = F.lit(float(value))
    edited = field_map.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()})
    # A new field of a block starts from the block's columns.
    block = F.split_part("field", F.lit("."), F.lit(1))
    here = field_map.where((F.col("route") == route) & (block == field.split(".")[0]))
    columns = here.agg(F.first("columns", ignorenulls=True).alias("columns"), F.bool_or(F.col("field") == field).alias("_known"))
    blank = field_map.sparkSession.createDataFrame(
        [(route, field, "column", column, "manual", [], [], state, None, "")], FIELD_MAP_SCHEMA
    ).drop("columns")
    added = blank.crossJoin(columns.where("NOT _known").drop("_known"))  # one row at most on either side
    return edited.unionByName(added.select(*field_map.columns))


def confirm_all(field_map: DataFrame, route: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Confirm every proposal; returns the new map and the rows that changed."""
    due = (F.col("state") != CONFIRMED) & F.col("proposed").isNotNull()
    if route is not None:
        due = due & (F.col("route") == route)
    scalar = F.col("kind") == "scalar"
    changed = field_map.where(due).select("route", "field", "proposed")
    confirmed_s = F.when(due & scalar, F.col("proposed").try_cast("double"))
    after = field_map.withColumns(
        {
            "state": F.when(due, CONFIRMED).otherwise(F.col("state")),
            "confirmed_s": F.coalesce(confirmed_s, "confirmed_s"),
        }
    )
    return after, changed


def require_confirmed(field_map: DataFrame, route: str | None = None) -> None:
    """Refuse to label while a required mapping is open: says how many are and names the first ``LISTED``;
    ``pending`` has them all as rows."""
    scope = field_map if route is None else field_map.where(F.col("route") == route)
    if route is not None and scope.isEmpty():
        routes = field_map.select("route").distinct()
        known = [r.route for r in routes.orderBy("route").limit(LISTED).collect()]
        raise ValueError(f"route {route!r} is not in the field map. Known routes ({routes.count()}): {known}")
    open_rows = pending(scope)
    facts = scope.groupBy("route").agg(
        F.bool_or(F.startswith("field", F.lit("obd."))).alias("_obd"), F.bool_or(F.col("field") == "clock_offset").alias("_measured")
    )
    unmeasured = facts.where("_obd AND NOT _measured").select(
        "route", F.lit("clock_offset").alias("field"), F.lit(None).cast("string").alias("proposed")
    )
    every = open_rows.unionByName(unmeasured)
    rows = every.orderBy("route", "field").limit(LISTED).collect()
    if rows:
        lines = [
            f"{r.route}.{r.field} ({r.proposed})" if r.proposed is not None
            else f"{r.route}.{r.field}: nothing proposed"
            for r in rows
        ]
        raise ValueError(f"{every.count()} required mappings are unconfirmed:\n  - " + "\n  - ".join(lines))
