"""Column arithmetic for tracks: local metres, speed, heading, ego frame, camera."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRES_PER_DEG_LON = 111320.0
METRES_PER_DEG_LAT = 111132.0
HORIZONS_S = (0.5, 1.0, 1.5, 2.0, 2.5)
FUSION_WEIGHT = 0.5
HEADING_MIN_SPEED = 1.5
FRAME_MIN_SPEED = 1.0
MAX_LATERAL_M = 25.0
KMH_TO_MPS = 1.0 / 3.6
HFOV_DEG = 70.0
CAMERA_HEIGHT_M = 1.4
MIN_DEPTH_M = 0.5


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres on the tangent plane at ``(lat0, lon0)``."""
    east = (lon - lon0) * METRES_PER_DEG_LON * F.cos(F.radians(lat0))
    north = (lat - lat0) * METRES_PER_DEG_LAT
    return east, north


def fuse_speed(track: Column, bus: Column, weight: float = FUSION_WEIGHT) -> Column:
    """Blend in the bus speed where there is one."""
    return F.coalesce((1.0 - weight) * track + weight * bus, track)


def heading(v_east: Column, v_north: Column) -> Column:
    return F.atan2(v_north, v_east)


def to_ego(dx: Column, dy: Column, angle: Column) -> tuple[Column, Column]:
    """World offset -> forward and left of a vehicle heading along ``angle``."""
    return (
        dx * F.cos(angle) + dy * F.sin(angle),
        -dx * F.sin(angle) + dy * F.cos(angle),
    )


def drop_reason(speed: Column, past_end: Column, lateral: Column) -> Column:
    """The first rule a frame breaks, or NULL for a kept frame."""
    return (
        F.when(~(speed >= FRAME_MIN_SPEED), "slow")
        .when(past_end, "target_past_segment_end")
        .when(~(F.abs(lateral) <= MAX_LATERAL_M), "lateral_over_limit")
    )


def focal_length(width: int, hfov_deg: float = HFOV_DEG) -> float:
    return (width / 2.0) / math.tan(math.radians(hfov_deg) / 2.0)


def project(
    forward: Column,
    left: Column,
    width: int,
    height: int,
    *,
    hfov_deg: float = HFOV_DEG,
    camera_height: float = CAMERA_HEIGHT_M,
) -> tuple[Column, Column, Column]:
    """Ground point -> pixel ``(u, v, visible)``; u and v are NULL when it is not in front."""
    f = focal_length(width, hfov_deg)
    visible = forward > MIN_DEPTH_M
    u = F.when(visible, f * -left / forward + width / 2.0)
    v = F.when(visible, f * camera_height / forward + height / 2.0)
    return u, v, visible


def waypoint_array(xs: Sequence[str], ys: Sequence[str]) -> Column:
    """Wide waypoint columns as ``ARRAY<STRUCT<x, y>>``."""
    return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in zip(xs, ys)])
