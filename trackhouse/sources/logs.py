"""Run event logs, device telemetry and latency reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackhouse.functions.devices import (
    PERCENTILE,
    SECTION,
    STAT,
    THROUGHPUT,
    VARIANCE,
    last_wins,
    telemetry_columns,
)
from trackhouse.sources.tables import raw_lines

EVENT_FIELDS = (
    "type string, ts double, name string, value string, step bigint, epoch bigint, secs double, "
    "eta_min double, detail string, path string, _corrupt string"
)


def parse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed columns of JSON lines; ``raw`` keeps every field of the line.

    Blank, torn and non-object lines go, and so do lines whose ``type`` is no string. A ``ts``
    that is no number counts as 0.
    """
    text = F.trim(line)
    tree = F.try_parse_json(text)
    # Python's reader takes NaN and infinities where the JSON standard does not.
    lenient = F.try_parse_json(
        F.regexp_replace(text, r'(:\s*)(-?Infinity|NaN)(?=\s*[,}])', '$1"$2"')
    )
    kind = lambda path: F.schema_of_variant(
        F.try_variant_get(F.coalesce("_tree", "_lenient"), path, "variant")
    )
    parsed = (
        lines.withColumns({"_tree": tree, "_lenient": lenient})
        .withColumn("_e", F.from_json(text, EVENT_FIELDS, {"columnNameOfCorruptRecord": "_corrupt"}))
        .where(F.startswith(text, F.lit("{")) & F.coalesce("_tree", "_lenient").isNotNull())
        .where(kind("$.type") == "STRING")
    )
    both = F.coalesce("_tree", "_lenient")
    get = lambda path, t: F.try_variant_get(both, path, t)
    ts_kind = kind("$.ts")
    ts = F.when(ts_kind == "BOOLEAN", get("$.ts", "boolean").cast("double")).when(
        ts_kind != "STRING", get("$.ts", "double")
    )
    others = [c for c in lines.columns if c != line]
    return parsed.select(
        *others,
        get("$.type", "string").alias("type"),
        F.coalesce(ts, F.lit(0.0)).alias("ts"),
        get("$.name", "string").alias("name"),
        get("$.value", "string").alias("value"),
        get("$.step", "bigint").alias("step"),
        get("$.epoch", "bigint").alias("epoch"),
        get("$.secs", "double").alias("secs"),
        get("$.eta_min", "double").alias("eta_min"),
        get("$.detail", "string").alias("detail"),
        get("$.path", "string").alias("image_path"),
        text.alias("raw"),
    )


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All events below ``path``; ``run`` is the folder of the file, ``pos`` orders its lines."""
    lines = raw_lines(spark, path).withColumn("run", F.element_at(F.split("path", "/"), -2))
    return parse_events(lines)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """One row per telemetry line; unknown lines give empty fields."""
    return raw_lines(spark, path).select("path", "pos", *telemetry_columns(F.col("line")))


def _number_map(body: Column, pattern: str, key: Column | None = None) -> Column:
    names = F.regexp_extract_all(body, F.lit(pattern), F.lit(1)) if key is None else key
    values = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    return last_wins(names, F.transform(values, lambda x: x.try_cast("double")))


def read_latency_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report and timing section, with the report's throughput and variance.

    Lines without statistics are no section; a section named twice keeps its last line.
    """
    lines = raw_lines(spark, path)
    body = F.regexp_extract("line", SECTION, 2)
    stats = _number_map(F.col("body"), STAT, None)
    levels = F.transform(
        F.regexp_extract_all("body", F.lit(PERCENTILE), F.lit(1)),
        lambda p: p.cast("double").cast("int"),
    )
    number = lambda pattern: F.regexp_extract("line", pattern, 1).try_cast("double")
    at = lambda pattern: F.when(F.regexp_extract("line", pattern, 1) != "", F.col("pos"))
    # Lines are read once: folded by report and section, those of no section under an empty name, and
    # what holds for the whole report is then taken from these few rows.
    parsed = (
        lines.withColumn("section", F.regexp_extract("line", SECTION, 1))
        .withColumn("body", body)
        .withColumn("stats", F.when(F.col("section") != "", F.transform_keys(stats, lambda k, _: F.lower(k))))
        .withColumn("percentiles", F.when(F.col("section") != "", _number_map(F.col("body"), PERCENTILE, levels)))
        .withColumns({"_tv": number(THROUGHPUT), "_tp": at(THROUGHPUT), "_vv": number(VARIANCE), "_vp": at(VARIANCE)})
    )
    first = lambda c: F.min_by(F.struct(f"_{c}v"), f"_{c}p").alias(f"_{c}")
    folded = parsed.groupBy("path", "section").agg(
        F.max_by(F.struct("stats", "percentiles"), F.when(F.size("stats") > 0, F.col("pos"))).alias("s"),
        F.min("_tp").alias("_tp"), first("t"), F.min("_vp").alias("_vp"), first("v"),
    )
    report = Window.partitionBy("path")
    whole = lambda c: F.min_by(f"_{c}", f"_{c}p").over(report)[f"_{c}v"]
    overall = folded.withColumn("throughput_qps", whole("t")).withColumn("compute_variance_pct", whole("v"))
    return overall.where((F.col("section") != "") & F.col("s").isNotNull()).select(
        "path", "section", "s.*", "throughput_qps", "compute_variance_pct"
    )


def latency_summary(sections: DataFrame) -> DataFrame:
    """Per report: end-to-end latency, compute median, and whether percentiles are ordered."""
    of = lambda section, c: F.max(F.when(F.col("section") == section, c))
    stat = lambda k: F.try_element_at("stats", F.lit(k))
    ordered = F.transform(
        F.array_sort(F.map_entries("percentiles")), lambda e: e["value"]
    )
    level = lambda *ks: F.coalesce(*[F.try_element_at("percentiles", F.lit(k)) for k in ks], stat("max"))
    monotonic = (F.size(ordered) == 0) | (
        (ordered == F.array_sort(ordered)) & (stat("median") <= F.get(ordered, 0))
    )
    return sections.groupBy("path").agg(
        *[of("Latency", stat(k)).alias(f"{k}_ms") for k in ("min", "max", "mean")],
        of("Latency", stat("median")).alias("p50_ms"),
        of("Latency", level(95, 99)).alias("p95_ms"),
        of("Latency", level(99)).alias("p99_ms"),
        of("GPU Compute Time", stat("median")).alias("gpu_compute_ms"),
        F.first("throughput_qps").alias("throughput_qps"),
        F.first("compute_variance_pct").alias("compute_variance_pct"),
        F.coalesce(F.bool_and(F.when(F.col("section") == "Latency", monotonic)), F.lit(True)).alias("monotonic"),
    )


def require_monotonic(summary: DataFrame) -> DataFrame:
    bad = [r.path for r in summary.where("NOT monotonic").select("path").limit(3).collect()]
    if bad:
        raise ValueError(f"percentiles are not monotonic in {bad}; the report format may have changed")
    return summary
