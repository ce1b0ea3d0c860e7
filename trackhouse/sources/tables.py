"""Delimited sensor tables: sniffing, roles, and typed position and bus rows."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.functions.text import clock_seconds, integer, number
from trackhouse.operators.roles import match_roles, table_kinds
from trackhouse.session import durable
from trackhouse.sources.storage import filesystem, qualified
from trackhouse.sources.tree import walk

DELIMITERS = (",", ";", "\t")
#: Bytes read at once in search of the end of a header.
HEADER_BLOCK = 8192


def raw_lines(
    spark: SparkSession, paths: str | list[str], *, glob: str | None = None
) -> DataFrame:
    """Every line with its file, its place in the file and whether it is the first.

    ``pos`` grows with the place of the line: the block's offset in the file, in steps of 64 KiB, then
    the order inside the block, packed into one number.
    """
    meta = "_metadata"
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (
        reader.text(paths)
        .select(
            F.col(f"{meta}.file_path").alias("path"),
            F.col(f"{meta}.file_block_start").alias("_block"),
            (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_nth"),
            F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"),
        )
        .withColumn("pos", F.shiftleft(F.shiftright("_block", 16), 33) + F.col("_nth"))
        .drop("_nth")
    )


def first_line(path: str) -> str:
    """The first line of a text file, compressed or not; ``path`` is a URL as Spark's scans give it."""
    store, place = filesystem(unquote(path))
    with store.open_input_stream(place) as stream, io.BufferedReader(stream, HEADER_BLOCK) as f:
        line = f.readline().decode("utf-8", "replace").rstrip("\n")
    return line.partition("\r")[0].removeprefix("\ufeff")


def _with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path, at, rows = batch.columns
        header = pa.array([first_line(p) for p in path.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([path, header, at, rows], names=["path", "header", "header_pos", "rows"])


def sniff(lines: DataFrame) -> DataFrame:
    """Per table: delimiter, stripped header columns and row count.

    The delimiter is the one the header holds most of; comma when it holds none. Lines are only counted,
    by hash; the header itself is read from the start of each file, no further than its first line.
    """
    counts = [
        F.struct(
            F.regexp_count("header", F.lit("\\t" if d == "\t" else d)).alias("n"),
            F.lit(-i).alias("i"),
            F.lit(d).alias("d"),
        )
        for i, d in enumerate(DELIMITERS)
    ]
    best = F.array_max(F.array(*counts))
    counted = lines.groupBy("path").agg(
        F.min("pos").alias("header_pos"), (F.count_if(F.trim("line") != "") - 1).alias("rows")
    )
    tables = counted.mapInArrow(_with_header, "path string, header string, header_pos bigint, rows bigint")
    return (
        tables.withColumn("delimiter", best["d"])
        .withColumn(
            "columns",
            F.transform(
                F.split("header", F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E"))),
                lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")),
            ),
        )
        .withColumn("error", F.when(F.trim("header") == "", "file is empty"))
    )


def empty_tables(spark: SparkSession, root: str, tables: DataFrame, glob: str) -> DataFrame:
    """Tables of length 0, which Spark's scans skip: they are told from the file tree. ``glob`` is a
    pattern of names such as ``*.{csv,txt}``."""
    base = qualified(spark, root).rstrip("/")
    alternatives = re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".").replace(r"\{", "(").replace(r"\}", ")").replace(",", "|")
    name = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    found = walk(spark, base).where((F.col("length") == 0) & F.col("name").rlike(f"^{alternatives}$") & ~F.col("name").rlike("^[._]"))
    return found.select(F.concat(F.lit(f"{base}/"), name).alias("path"), F.lit("file is empty").alias("error"))


def headers(tables: DataFrame) -> DataFrame:
    return tables.where("error IS NULL").select("path", F.posexplode("columns").alias("pos", "name"))


def describe(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Role guesses per table and the kind that follows from them."""
    roles = match_roles(headers(tables), "path", "pos", "name")
    kinds = tables.select("path").join(table_kinds(roles, "path"), "path", "left")
    return roles, kinds.withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def records(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per data line: ``path, pos, values`` as a map from column name to text.

    The delimiter and the stripped header found by the sniff are used here too, so tables with
    any of the delimiters read the same. Table facts are one row per file.
    """
    # Written, as it is read twice and each time stands for a pass over all lines.
    known = durable(tables.where("error IS NULL").select("path", "header_pos", "delimiter", "columns"))
    # from_csv takes its separator as a literal: one branch per possible delimiter.
    widest = known.agg(F.max(F.size("columns"))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(widest))
    parsed = None
    for d in DELIMITERS:
        cells = F.from_csv("line", schema, {"sep": d, "ignoreLeadingWhiteSpace": "false"})
        # Bound to a lambda, so that a line is parsed once and not once for every column.
        row = F.get(F.transform(F.array(cells), lambda c: F.array(*[c[f"c{i}"] for i in range(widest)])), 0)
        parsed = F.when(F.col("delimiter") == d, row) if parsed is None else parsed.when(
            F.col("delimiter") == d, row
        )
    # A repeated header name keeps its last column, as a dict reader does.
    # Only the first line is the header; a later line that repeats it is data, as the count has it.
    body = lines.join(known, "path").where((F.col("pos") != F.col("header_pos")) & (F.trim("line") != ""))
    return body.select("path", "pos", "columns", parsed.alias("cells"))


def field(name: Column) -> Column:
    """Text of the column called ``name`` in a record row."""
    at = F.size("columns") - F.array_position(F.reverse("columns"), name)
    return F.when(F.array_contains("columns", name), F.get("cells", at.cast("int")))


def gps_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``route, path, frame, t, lat, lon``; rows with any unreadable part are dropped.

    ``mapping`` has one row per table: ``path, route, time, lat, lon, frame`` (column names).
    """
    joined = rows.join(mapping, "path")
    return joined.select(
        "route",
        "path",
        integer(field(F.col("frame"))).alias("frame"),
        clock_seconds(field(F.col("time"))).alias("t"),
        number(field(F.col("lat"))).alias("lat"),
        number(field(F.col("lon"))).alias("lon"),
    ).dropna(subset=["frame", "t", "lat", "lon"])


def obd_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``route, t, speed`` on the position clock; ``mapping`` also carries ``offset_s``."""
    joined = rows.join(mapping, "path")
    shift = F.coalesce("offset_s", F.lit(0.0))
    return joined.select(
        "route",
        (clock_seconds(field(F.col("time"))) + shift).alias("t"),
        number(field(F.col("speed"))).alias("speed"),
    ).dropna(subset=["t", "speed"])
