"""Telemetry lines and latency report lines as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line grammar of the device log and of the latency report.
RAM = r"\bRAM\s+(\d+)/(\d+)MB"
GPU = r"\bGR3D_FREQ\s+(\d+)%"
CPU_BLOCK = r"\bCPU\s+\[([^\]]*)\]"
CPU_CORE = r"(\d+)%@(\d+)"
TEMPERATURE = r"\b([a-zA-Z][a-zA-Z0-9_]*)@(-?[\d.]+)C"
POWER = r"\b([A-Z][A-Z0-9_]+)\s+(\d+)mW/(\d+)mW/(\d+)mW"
SECTION = (
    r"\b(Latency|Enqueue Time|H2D Latency|GPU Compute Time|D2H Latency):\s*(.*)$"
)
STAT = r"(?i)\b(min|max|mean|median)\s*=\s*([\d.eE+-]+)\s*ms"
PERCENTILE = r"(?i)percentile\((\d+(?:\.\d+)?)%\)\s*=\s*([\d.eE+-]+)\s*ms"
THROUGHPUT = r"(?i)Throughput:\s*([\d.]+)\s*qps"
VARIANCE = r"(?i)coefficient of variance\s*=\s*([\d.]+)%"


def _first(line: Column, pattern: str, group: int = 1, kind: str = "int") -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit("")).try_cast(kind)


def _all(line: Column, pattern: str, group: int, kind: str) -> Column:
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda x: x.try_cast(kind))


def last_wins(keys: Column, values: Column) -> Column:
    """A map of parallel arrays in which a repeated key keeps its last value."""

    def build(p: Column) -> Column:
        names = F.array_distinct(p["k"])
        return F.map_from_arrays(names, F.transform(names, lambda k: F.get(p["v"], F.array_position(p["k"], k).cast("int") - 1)))

    # Both arrays are made once and then bound: what stands inside a lambda is worked out for every element.
    later_first = F.struct(F.reverse(keys).alias("k"), F.reverse(values).alias("v"))
    return F.get(F.transform(F.array(later_first), build), 0)


def telemetry_columns(line: Column) -> list[Column]:
    """Scalars, the core list and both maps of one line; absent parts are NULL or empty."""
    block = F.regexp_extract(line, CPU_BLOCK, 1)
    # A core's "18%@729" must never be read as a sensor.
    outside = F.regexp_replace(line, CPU_BLOCK, "")
    return [
        _first(line, GPU).alias("gpu_pct"),
        _first(line, RAM, 1).alias("ram_used_mb"),
        _first(line, RAM, 2).alias("ram_total_mb"),
        _all(block, CPU_CORE, 1, "int").alias("cpu_pct"),
        last_wins(
            F.regexp_extract_all(outside, F.lit(TEMPERATURE), F.lit(1)),
            _all(outside, TEMPERATURE, 2, "double"),
        ).alias("temps_c"),
        last_wins(
            F.regexp_extract_all(line, F.lit(POWER), F.lit(1)), _all(line, POWER, 2, "int")
        ).alias("power_mw"),
        F.trim(line).alias("raw"),
    ]


def hottest_soc(temps: Column) -> Column:
    """The hottest ``soc*`` sensor, else the junction sensor."""
    soc = F.map_filter(temps, lambda k, _: F.startswith(k, F.lit("soc")))
    return F.coalesce(F.array_max(F.map_values(soc)), F.try_element_at(temps, F.lit("tj")))


def derived_columns() -> list[Column]:
    """RAM in GB, mean core load, hottest sensor and total watts of a telemetry row."""
    cores = F.col("cpu_pct")
    load = F.aggregate(cores, F.lit(0.0), lambda a, x: a + x)
    rails = F.map_values("power_mw")
    watts = F.aggregate(rails, F.lit(0).cast("bigint"), lambda a, x: a + x) / 1000.0
    return [
        (F.col("ram_used_mb") / 1024).alias("ram_used_gb"),
        (F.col("ram_total_mb") / 1024).alias("ram_total_gb"),
        F.when(F.size(cores) > 0, load / F.size(cores)).alias("cpu_avg_pct"),
        hottest_soc(F.col("temps_c")).alias("soc_temp_c"),
        F.try_element_at("temps_c", F.lit("gpu")).alias("gpu_temp_c"),
        F.when(F.size(rails) > 0, watts).alias("total_power_w"),
    ]
