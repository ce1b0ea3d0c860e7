"""Column functions over names, paths, clock strings and log lines."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Suffixes, markers and words the data sets use.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
TABLE_SUFFIXES = (".csv", ".txt", ".tsv")
LIDAR_SUFFIXES = (".npy", ".bin", ".pcd", ".ply")
IMAGE_MARKER = "_leftImg8bit"
POLYGON_MARKER = "_gtFine_polygons"
MASK_SUFFIX = "_labellevel3Ids.png"
ANNOTATION_MARKER = "_gtFine"
MODALITY_WORDS = ("primary", "secondary", "supplement", "lidar", "obd")
CLOCK_DASHED = r"^(\d{1,2})-(\d{2})-(\d{2})-(\d+)$"
CLOCK_COLON = r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)$"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"


def _part(value: Column, pattern: str, group: int, kind: str = "double") -> Column:
    return F.regexp_extract(value, pattern, group).try_cast(kind)


def number(value: Column) -> Column:
    """A finite number, or NULL."""
    text = F.trim(value)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def integer(value: Column) -> Column:
    """A whole number, or NULL."""
    text = F.trim(value)
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def clock_seconds(value: Column) -> Column:
    """Seconds since midnight from a clock string, a bare number as it stands, else NULL."""
    text = F.trim(value)
    whole = lambda p: _part(text, p, 1) * 3600 + _part(text, p, 2) * 60
    fraction = F.concat(F.lit("0."), F.regexp_extract(text, CLOCK_DASHED, 4)).try_cast("double")
    return (
        F.when(
            text.rlike(CLOCK_DASHED),
            whole(CLOCK_DASHED) + _part(text, CLOCK_DASHED, 3) + fraction,
        )
        .when(text.rlike(CLOCK_COLON), whole(CLOCK_COLON) + _part(text, CLOCK_COLON, 3))
        .otherwise(number(text))
    )


def normalize_name(name: Column) -> Column:
    return F.translate(F.lower(name), " -_", "")


def file_suffix(name: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def file_kind(suffix: Column) -> Column:
    return (
        F.when(suffix.isin(*IMAGE_SUFFIXES), "image")
        .when(suffix.isin(*TABLE_SUFFIXES), "table")
        .when(suffix.isin(*LIDAR_SUFFIXES), "lidar")
        .otherwise("other")
    )


def _without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(json|png|jpg|jpeg)$", "")


def image_frame_key(name: Column) -> Column:
    return F.regexp_replace(_without_extension(name), IMAGE_MARKER + "$", "")


def polygon_frame_key(name: Column) -> Column:
    return F.regexp_replace(_without_extension(name), POLYGON_MARKER + "$", "")


def mask_frame_key(name: Column) -> Column:
    bare = F.regexp_replace(name, re.escape(MASK_SUFFIX) + "$", "")
    return F.regexp_replace(bare, ANNOTATION_MARKER + "$", "")


def stereo_side(name: Column) -> Column:
    """``left`` or ``right`` when the name says exactly one of them."""
    left, right = F.contains(F.lower(name), F.lit("left")), F.contains(F.lower(name), F.lit("right"))
    return F.when(left & ~right, "left").when(right & ~left, "right")


def route_of(directory: Column) -> Column:
    """The deepest path component that is no modality, side, camera or image folder."""

    def usable(part: Column) -> Column:
        word = F.lower(part)
        skipped = (
            (part == "")
            | word.isin(*MODALITY_WORDS)
            | stereo_side(part).isNotNull()
            | F.contains(word, F.lit("cam"))
            | F.contains(word, F.lit("img"))
        )
        return ~skipped

    return F.try_element_at(F.filter(F.split(directory, "/"), usable), F.lit(-1))


def frame_path(directory: Column, frame: Column, example: Column) -> Column:
    """Path of a frame: zero-padded to the width of an example name, with its suffix."""
    stem = F.regexp_replace(example, r"(?<=.)\.[^.]*$", "")
    suffix = F.regexp_extract(example, r".(\.[^.]*)$", 1)
    digits = frame.cast("string")
    # Padding must never cut a number that is wider than the example.
    padded = F.lpad(digits, F.greatest(F.length(stem), F.length(digits)), F.lit("0"))
    return F.concat(directory, F.lit("/"), padded, suffix)


def sample_key(sequence: Column, frame: Column) -> Column:
    return F.concat_ws("_", sequence, frame)


def safe_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, r"[^\p{L}\p{N}_-]", "-")


def _valid_pattern(pattern: str) -> bool:
    """Whether the engine that will run ``pattern`` takes it: Java's, not Python's."""
    session = SparkSession.active()
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def log_matches(line: Column, wanted: str) -> Column:
    """A log filter: ``/regex/``, else a case-insensitive substring; empty keeps all."""
    wanted = wanted.strip()
    if not wanted:
        return F.lit(True)
    if len(wanted) >= 2 and wanted.startswith("/") and wanted.endswith("/"):
        if _valid_pattern(wanted[1:-1]):
            return line.rlike("(?i)" + wanted[1:-1])
    return F.contains(F.lower(line), F.lit(wanted.lower()))


def magnitude(count: Column) -> Column:
    """``1234567`` -> ``1.23 M``: two decimals at the count's own scale, plain below 1000.

    Rounds as printf does: by the double nearest to the quotient, even digit on an exact half.
    """

    def scaled(limit: int, unit: str) -> Column:
        step = limit // 100
        cents, rest = (count / step).cast("bigint"), count % step
        quotient = count / F.lit(float(limit))
        # Split the double in two halves so that its product with the limit is exact.
        big = quotient * F.lit(134217729.0)
        high = big - (big - quotient)
        error = (high * limit - count) + (quotient - high) * limit
        up = (rest * 2 > step) | (
            (rest * 2 == step) & ((error > 0) | ((error == 0) & (cents % 2 == 1)))
        )
        shown = F.floor(count / step).cast("bigint") + up.cast("bigint")
        return F.concat(
            F.floor(shown / 100).cast("string"),
            F.lit("."),
            F.lpad((shown % 100).cast("string"), 2, "0"),
            F.lit(f" {unit}"),
        )

    return (
        F.when(count >= 10**9, scaled(10**9, "G"))
        .when(count >= 10**6, scaled(10**6, "M"))
        .when(count >= 10**3, scaled(10**3, "K"))
        .otherwise(count.cast("string"))
    )
