"""Ordered work on keys of any size.

``Window.partitionBy(route)`` puts a whole route into one task. Here a route's ordered rows are
cut into chunks and the window runs per ``(route, chunk)``; what a row needs from outside its
chunk comes from a summary with one row per chunk. A summary is thousands of times smaller than
the data, so the only window that still spans a whole route runs over chunk summaries.

Two layouts copy neighbouring rows across chunk borders instead, for work with a bounded reach:
``halo_by_time`` (reach in order units) and ``halo_by_rows`` (reach in rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows a chunk should hold; well inside one task's memory even for wide rows.
TARGET_ROWS = 200_000


@dataclass(frozen=True)
class Timeline:
    """How rows are keyed, ordered and cut into chunks."""

    keys: tuple[str, ...]
    order: str
    width: float
    ties: tuple[str, ...] = ()
    chunk: str = "_chunk"

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.chunk]

    def chunk_of(self, value: Column) -> Column:
        return F.floor(value / F.lit(float(self.width))).cast("bigint")

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the chunk number, unless a halo layout already did."""
        if self.chunk in df.columns:
            return df
        return df.withColumn(self.chunk, self.chunk_of(F.col(self.order)))

    def position(self) -> Column:
        """A comparable value that orders rows inside a key.

        Without ties it is the plain column: aggregates over structs cannot hash and sort instead.
        """
        return F.struct(self.order, *self.ties) if self.ties else F.col(self.order)

    def forward(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.order, *self.ties)

    def backward(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(
            F.col(self.order).desc(), *[F.col(c).desc() for c in self.ties]
        )

    def upto_here(self) -> WindowSpec:
        return self.forward().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def chunks_before(self) -> WindowSpec:
        return (
            Window.partitionBy(*self.keys)
            .orderBy(self.chunk)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def chunks_after(self) -> WindowSpec:
        # Descending order keeps the frame growing from the front: a frame that ends at
        # UNBOUNDED FOLLOWING is recomputed for every row.
        return (
            Window.partitionBy(*self.keys)
            .orderBy(F.col(self.chunk).desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )


def fit_width(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    target_rows: int = TARGET_ROWS,
    least: float = 1.0,
) -> float:
    """A chunk width under which no ``(key, chunk)`` holds many more than ``target_rows``.

    Starts from the densest key, then measures the fullest chunk and narrows until it fits, so a
    burst inside one key is split too. Each round is one column-pruned count with map-side
    combine; the driver sees one row per round.
    """
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(order) - F.min(order)).cast("double").alias("span"),
    )
    row = per_key.agg(
        F.max("n").alias("n"),
        F.max("span").alias("span"),
        F.max(F.col("n") / F.greatest("span", F.lit(least))).alias("density"),
    ).first()
    if row is None or row["n"] is None:
        return float(least)
    if row["n"] <= target_rows:
        return float(max(row["span"] + least, least))
    width = max(target_rows / row["density"], least)
    while width > least:
        chunk = F.floor(F.col(order) / F.lit(width))
        peak = df.groupBy(*keys, chunk.alias("c")).count().agg(F.max("count")).first()[0]
        if peak <= 4 * target_rows:
            break
        width = max(width * target_rows / peak, least)
    return float(width)


def timeline(
    df: DataFrame, keys: Sequence[str], order: str, *, ties: Sequence[str] = (), **fit: float
) -> Timeline:
    """A timeline whose chunk width is measured on ``df``."""
    return Timeline(tuple(keys), order, fit_width(df, keys, order, **fit), tuple(ties))


def attach(df: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join per-chunk facts back, keeping the column order of ``df`` first."""
    extra = [c for c in summary.columns if c not in on]
    return df.join(summary, list(on), "left").select(*df.columns, *extra)


def hold_last(df: DataFrame, tl: Timeline, value: str, out: str) -> DataFrame:
    """``out`` = the latest non-null ``value`` at or before the row, however far back."""
    df = tl.cut(df)
    when_set = F.when(F.col(value).isNotNull(), tl.position())
    carry = (
        df.groupBy(*tl.group)
        .agg(F.max_by(value, when_set).alias("_own"))
        .withColumn("_carry", F.last("_own", ignorenulls=True).over(tl.chunks_before()))
        .drop("_own")
    )
    held = F.last(value, ignorenulls=True).over(tl.upto_here())
    return (
        attach(df, carry, tl.group)
        .withColumn(out, F.coalesce(held, F.col("_carry")))
        .drop("_carry")
    )


def first_set(df: DataFrame, tl: Timeline, value: str, out: str) -> DataFrame:
    """``out`` = the first non-null ``value`` of the row's key, the same for every row."""
    df = tl.cut(df)
    when_set = F.when(F.col(value).isNotNull(), tl.position())
    whole = Window.partitionBy(*tl.keys)
    facts = (
        df.groupBy(*tl.group)
        .agg(F.min_by(value, when_set).alias("_own"), F.min(when_set).alias("_at"))
        .withColumn(out, F.min_by("_own", "_at").over(whole))
        .drop("_own", "_at")
    )
    return attach(df, facts, tl.group)


def previous(df: DataFrame, tl: Timeline, values: dict[str, str]) -> DataFrame:
    """``lag`` that reaches across chunk borders; ``values`` maps column -> output name."""
    df = tl.cut(df)
    cols = list(values)
    # A one-field struct tells "no earlier row" from "an earlier row holding NULL".
    carry = (
        df.groupBy(*tl.group)
        .agg(F.max_by(F.struct(*cols), tl.position()).alias("_own"))
        .withColumn("_carry", F.lag("_own").over(Window.partitionBy(*tl.keys).orderBy(tl.chunk)))
        .drop("_own")
    )
    lagged = F.lag(F.struct(*cols)).over(tl.forward())
    out = attach(df, carry, tl.group).withColumn("_prev", F.coalesce(lagged, F.col("_carry")))
    for col, name in values.items():
        out = out.withColumn(name, F.col("_prev")[col])
    return out.drop("_prev", "_carry")


def number_rows(df: DataFrame, tl: Timeline, out: str, total: str | None = None) -> DataFrame:
    """``out`` = 1-based position inside the key; ``total`` = rows of the key."""
    df = tl.cut(df)
    counts = df.groupBy(*tl.group).agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(tl.chunks_before()), F.lit(0)))
    if total:
        facts = facts.withColumn(total, F.sum("_n").over(Window.partitionBy(*tl.keys)))
    row = F.row_number().over(tl.forward()).cast("bigint")
    return (
        attach(df, facts.drop("_n"), tl.group)
        .withColumn(out, row + F.col("_before"))
        .drop("_before")
    )


def running(
    df: DataFrame,
    tl: Timeline,
    aggregates: dict[str, tuple[str, str]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``count`` from the first row of the key to this one.

    ``aggregates`` maps output -> (function, column). ``exclusive`` leaves the row itself out.
    """
    df = tl.cut(df)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    base = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    parts = df.groupBy(*tl.group).agg(
        *[base[fn](col).alias(f"_{out}") for out, (fn, col) in aggregates.items()]
    )
    for out, (fn, _) in aggregates.items():
        parts = parts.withColumn(f"_before_{out}", merge[fn](f"_{out}").over(tl.chunks_before()))
    parts = parts.drop(*[f"_{out}" for out in aggregates])
    result = attach(df, parts, tl.group)
    frame = tl.forward().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    for out, (fn, col) in aggregates.items():
        here, before = base[fn](col).over(frame), F.col(f"_before_{out}")
        if fn in ("sum", "count"):
            both = F.coalesce(here + before, here, before)
        else:
            both = F.greatest(here, before) if fn == "max" else F.least(here, before)
        result = result.withColumn(out, both)
    return result.drop(*[f"_before_{out}" for out in aggregates])


def halo_by_time(df: DataFrame, tl: Timeline, behind: float, ahead: float, own: str) -> DataFrame:
    """Copy rows into every chunk that looks at them.

    A chunk sees rows from ``behind`` before its first to ``ahead`` after its last moment.
    ``own`` marks the copy that belongs to the chunk. No shuffle of its own: the copies are made
    before the exchange on ``(key, chunk)`` that the windows need anyway.
    """
    at = F.col(tl.order)
    home = tl.chunk_of(at)
    targets = F.sequence(tl.chunk_of(at - F.lit(ahead)), tl.chunk_of(at + F.lit(behind)))
    return df.withColumn(tl.chunk, F.explode(targets)).withColumn(own, F.col(tl.chunk) == home)


def halo_by_rows(
    df: DataFrame, index: str, total: str, size: int, reach: int, block: str, own: str
) -> DataFrame:
    """Cut a numbered sequence into blocks of ``size`` rows with ``reach`` copied rows around.

    ``index`` is 0-based inside the sequence and ``total`` its length, so blocks are even
    whatever the spacing in time.
    """
    if reach >= size:
        raise ValueError("a block must be longer than its reach")
    home = F.floor(F.col(index) / size).cast("bigint")
    offset = F.col(index) % size
    last = F.floor((F.col(total) - 1) / size).cast("bigint")
    low = F.when((offset < reach) & (home > 0), home - 1).otherwise(home)
    high = F.when((offset >= size - reach) & (home < last), home + 1).otherwise(home)
    return df.withColumn(block, F.explode(F.sequence(low, high))).withColumn(
        own, F.col(block) == home
    )


def renamed(tl: Timeline, **changes) -> Timeline:
    return replace(tl, **changes)
