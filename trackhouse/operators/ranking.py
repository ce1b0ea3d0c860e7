"""Exact ranks and quantiles without putting a key, or the table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackhouse.operators.timeline import Timeline, fit_width
from trackhouse.session import durable


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    upper: bool = False,
    width: float | None = None,
    fold: bool = True,
) -> DataFrame:
    """Exact quantiles per key; ``probabilities`` maps output name -> p.

    Linear interpolation between the two nearest ranks, or with ``upper`` the element at index
    ``floor(p * n)`` of the sorted values (for p = 0.5 the upper median).

    Equal values are first folded into one row with a count. The folded rows are cut into value
    chunks, chunk counts give every chunk's starting rank, and only the chunks that hold a wanted
    rank are read again. Values that hardly repeat need no folding (``fold``): then rows are only
    counted, and no others than those of such chunks are moved. ``df`` is read twice.
    """
    keys = list(keys)
    there = df.where(F.col(value).isNotNull())
    folded = there.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")) if fold else there.select(*keys, value, F.lit(1).cast("bigint").alias("_n"))
    if width is None:
        width = fit_width(folded, keys, value, least=1e-9)
    tl = Timeline(tuple(keys), value, width)
    folded = tl.cut(folded)
    counts = folded.groupBy(*tl.group).agg(F.sum("_n").alias("_in"))
    ranked = counts.withColumn(
        "_before", F.coalesce(F.sum("_in").over(tl.chunks_before()), F.lit(0).cast("bigint"))
    ).withColumn("_total", F.sum("_in").over(Window.partitionBy(*keys)))

    wanted = []
    for name, p in probabilities.items():
        if upper:
            at = F.least(F.floor(F.lit(p) * F.col("_total")), F.col("_total") - 1)
            low = high = at.cast("bigint")
            share = F.lit(0.0)
        else:
            exact = F.lit(float(p)) * (F.col("_total") - 1)
            low, high = F.floor(exact).cast("bigint"), F.ceil(exact).cast("bigint")
            share = exact - F.floor(exact)
        wanted += [
            F.struct(
                F.lit(name).alias("name"),
                rank.alias("rank"),
                F.lit(side).alias("side"),
                share.alias("share"),
            )
            for side, rank in (("low", low), ("high", high))
        ]
    targets = (
        ranked.withColumn("_want", F.explode(F.array(*wanted)))
        .where(
            (F.col("_want.rank") >= F.col("_before"))
            & (F.col("_want.rank") < F.col("_before") + F.col("_in"))
        )
        .groupBy(*tl.group, "_before")
        .agg(F.collect_list("_want").alias("_wants"))
    )
    inside = folded.join(targets, tl.group)
    reached = F.col("_before") + F.sum("_n").over(tl.upto_here())
    hits = (
        inside.withColumn("_end", reached)
        .withColumn(
            "_hit",
            F.explode(
                F.filter(
                    "_wants",
                    lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_n")),
                )
            ),
        )
        .select(*keys, value, "_hit.*")
    )
    # At most two rows per key and quantile are left here.
    results = []
    for name in probabilities:
        at_side = lambda side, n=name: F.max(
            F.when((F.col("name") == n) & (F.col("side") == side), F.col(value))
        )
        weight = F.max(F.when(F.col("name") == name, F.col("share")))
        span = at_side("high") - at_side("low")
        # Without a share the element itself is the answer, in its own type's precision.
        results.append((at_side("low") + weight * span).alias(name))
    return hits.groupBy(*keys).agg(*results)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Contiguous 0-based positions over the whole table in ``order``.

    A range exchange sorts the table in parallel; partition sizes give each partition its first
    number. The sorted copy is written out before it is counted: range borders are sampled, so a
    second run of the same plan could cut elsewhere.
    """
    spot = F.monotonically_increasing_id()
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_spot", spot)
    )
    part, local = F.shiftright("_spot", 33), F.col("_spot").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_part", part).withColumn("_local", local).drop("_spot")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per shuffle partition: bounded by the partition count, not by the data.
    starts = sizes.withColumn(
        "_start",
        F.coalesce(
            F.sum("_size").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_size")
    ranked = placed.join(F.broadcast(starts), "_part")
    return ranked.withColumn(out, F.col("_start") + F.col("_local")).select(*df.columns, out)


def evenly_spaced(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows at evenly spaced positions of the sorted table, first and last included."""
    ranked = global_rank(df, order, "_at")
    n = ranked.count()
    picks = min(k, n)
    if picks <= 0:
        return ranked.limit(0).drop("_at")
    step = (n - 1) / (picks - 1) if picks > 1 else 0.0
    wanted = sorted({int(i * step) for i in range(picks)})
    return ranked.where(F.col("_at").isin(wanted)).drop("_at")


def seeded_sample(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """``k`` pseudo-random rows that depend only on the key and the seed, in key order."""
    return (
        df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), *key).limit(k).orderBy(*key)
    )

