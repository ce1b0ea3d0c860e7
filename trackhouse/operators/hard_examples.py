"""Hard-example selection over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.operators.taxonomy import IGNORE_ID
from trackhouse.operators.timeline import TARGET_ROWS, Timeline, fit_width, number_rows, running
from trackhouse.session import durable, stored

# Fixed values.
THRESHOLD = 0.9
MIN_KEPT = 26000


def select_hard(
    df: DataFrame,
    batch: Sequence[str],
    probability: str,
    loss: str,
    label: str,
    row_id: str,
    *,
    threshold: float = THRESHOLD,
    min_kept: int = MIN_KEPT,
    width: float | None = None,
) -> DataFrame:
    """All rows below ``threshold``; where a batch has too few, its ``min_kept`` largest losses, of equal
    ones the smallest row ids first. Rows with the ignore label are never taken.

    Equal losses are folded to counts before they are ranked, so the loss at which a batch is cut off
    is found from one row per distinct loss. Only the rows at that very loss are ranked one by one, by
    row id, in chunks of their own: no value, however common, lands in one task.
    """
    batch = list(batch)
    valid = df.where(F.col(label) != IGNORE_ID).withColumn("_easy", -F.col(loss))
    hard = F.coalesce(F.col(probability) < threshold, F.lit(False))
    folded = durable(valid.groupBy(*batch, "_easy").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(hard, 1)).alias("_h")))
    enough = folded.groupBy(*batch).agg((F.sum("_h") >= min_kept).alias("_enough"))
    short = folded.join(enough.where(~F.col("_enough")), batch)
    if width is None:
        width = fit_width(short, batch, "_easy", target_rows=TARGET_ROWS, least=1e-9)
    summed = running(short, Timeline(tuple(batch), "_easy", width), {"_upto": ("sum", "_n")})
    cut = summed.where(F.col("_upto") >= min_kept).groupBy(*batch).agg(
        F.min("_easy").alias("_border"), (F.min_by("_upto", "_easy") - F.min_by("_n", "_easy")).alias("_above")
    )
    # One row per batch, written so that Spark knows its size and broadcasts it where it is small.
    rules = stored(enough.join(cut, batch, "left"))
    judged = valid.join(rules, batch)
    sure = judged.where(F.when(F.col("_enough"), hard).otherwise(F.col("_border").isNull() | (F.col("_easy") < F.col("_border"))))
    tied = judged.where(~F.col("_enough") & (F.col("_easy") == F.col("_border")))
    chosen = border_ranks(tied, batch, row_id).where(F.col("_above") + F.col("_rank") <= min_kept)
    return sure.select(*df.columns).unionByName(chosen.select(*df.columns))


def border_ranks(tied: DataFrame, batch: Sequence[str], row_id: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``tied`` with ``_rank`` by row id inside its batch, in chunks of about ``target_rows``. Ids that are
    no numbers are ranked by their hash."""
    at = row_id
    if not isinstance(tied.schema[row_id].dataType, T.NumericType):
        tied, at = tied.withColumn("_at", F.xxhash64(row_id)), "_at"
    tl = Timeline(tuple(batch), at, fit_width(tied, list(batch), at, target_rows=target_rows), () if at == row_id else (row_id,))
    return number_rows(tied, tl, "_rank")
