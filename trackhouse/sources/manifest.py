"""The manifest: what was found per route and what a person confirmed of it, in numbered versions.

A version is a folder of JSON documents, one per route (with its fields nested) and one per table. It
is written under a name of its own and becomes a version when its number is taken: a small file that
is created only if it does not exist yet. So a reader sees whole versions, and of two writers who
started from the same version one is told so.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackhouse.operators.governance import FIELD_MAP_SCHEMA, carry_forward
from trackhouse.sources.storage import below, listed, qualified, read_whole

#: A number that was taken but not filled for so long belongs to a writer that died.
ABANDONED_S = 600
FORMAT = 1
_FIELD = FIELD_MAP_SCHEMA.removeprefix("route string, ")
#: ``kind`` is ``route`` or ``table``; a table without a route is unassigned.
SCHEMA = (
    f"kind string, route string, fields array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in _FIELD.split(', '))}>>, "
    "path string, table_kind string, rows bigint, columns array<string>"
)


class ManifestConflict(RuntimeError):
    """Someone else published a version after the one that was read."""


def compose(fields: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Documents from a field map and, if given, tables (``path, route, kind, rows, columns``). A route
    has a handful of fields, so nesting them is bounded; tables, however many, are documents of their own."""
    names = [f.split(" ")[0] for f in _FIELD.split(", ")]
    routes = fields.groupBy("route").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("fields"))
    blank = lambda *skip: [F.lit(None).cast(t).alias(n) for n, t in _typed() if n not in skip]
    order = [n for n, _ in _typed()]
    out = routes.select(F.lit("route").alias("kind"), "route", "fields", *blank("kind", "route", "fields")).select(*order)
    if tables is not None:
        rows = tables.select(F.lit("table").alias("kind"), "route", "path", F.col("kind").alias("table_kind"), "rows", "columns", *blank(*"kind route path table_kind rows columns".split()))
        out = out.unionByName(rows.select(*order))
    return out


def _typed() -> list[tuple[str, str]]:
    from pyspark.sql.types import _parse_datatype_string

    return [(f.name, f.dataType.simpleString()) for f in _parse_datatype_string(SCHEMA)]


def field_map(documents: DataFrame) -> DataFrame:
    """The field map that ``compose`` nested."""
    inner = documents.where("kind = 'route'").select("route", F.explode("fields").alias("f"))
    return inner.select("route", *[F.col(f"f.{c.split(' ')[0]}") for c in _FIELD.split(", ")])


def tables(documents: DataFrame) -> DataFrame:
    return documents.where("kind = 'table'").select("path", "route", F.col("table_kind").alias("kind"), "rows", "columns")


def versions(folder: str) -> dict[int, str | None]:
    """Numbers that were taken and the folder of each version, None while it is being published."""
    out: dict[int, str | None] = {}
    for name in listed(folder, ".version"):
        held = read_whole(below(folder, name))
        out[int(name.removesuffix(".version"))] = json.loads(held)["data"] if held else None
    return out


def current(spark: SparkSession, folder: str) -> int:
    """The number of the latest whole version, 0 if there is none."""
    return max((n for n, data in versions(qualified(spark, folder)).items() if data), default=0)


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, int]:
    """The documents of a version, by default the latest, and its number."""
    place = qualified(spark, folder)
    known = versions(place)
    number = max((n for n, data in known.items() if data), default=0) if version is None else version
    if not known.get(number):
        raise FileNotFoundError(f"no manifest version {number or ''} in {folder}; discover and save it first")
    return spark.read.schema(SCHEMA).json(below(place, known[number])), number


def write(documents: DataFrame, folder: str, expected: int) -> int:
    """Publish ``documents`` as the version after ``expected`` (0: the first) and return its number."""
    spark = documents.sparkSession
    place = qualified(spark, folder)
    data = f"data-{uuid.uuid4().hex}"
    documents.write.json(below(place, data))
    number = expected + 1
    known = versions(place)
    if max((n for n, held in known.items() if held), default=0) != expected:
        raise ManifestConflict(f"version {expected} of {folder} is not the latest: {max(known)} is")
    hadoop = spark._jvm.org.apache.hadoop.fs
    claim = hadoop.Path(below(place, f"{number:08d}.version"))
    fs = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    if number in known and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > ABANDONED_S:
        fs.delete(claim, False)
    try:
        out = fs.create(claim, False)
    except Py4JJavaError as exc:
        raise ManifestConflict(f"version {number} of {folder} is being published by someone else") from exc
    out.write(bytearray(json.dumps({"format": FORMAT, "version": number, "data": data}).encode()))
    out.close()
    return number


def save(fields: DataFrame, folder: str, tables: DataFrame | None = None) -> int:
    """Publish what a scan proposes. Confirmations of the latest version survive where they still mean
    the same proposal."""
    spark = fields.sparkSession
    before = current(spark, folder)
    if before:
        fields = carry_forward(fields, field_map(read(spark, folder, before)[0]))
    return write(compose(fields, tables), folder, before)


def edit(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Publish the latest version with its field map changed; a version that came in between is a
    ``ManifestConflict``."""
    documents, before = read(spark, folder)
    return write(compose(change(field_map(documents)), tables(documents)), folder, before)
