"""Savitzky-Golay smoothing and its derivative as one weighted sum of neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
WINDOW = 15
ORDER = 3

#: A row may look this many rows to either side (at a segment edge the window is one-sided).
REACH = WINDOW - 1
SHORTEST = ORDER + 2


@lru_cache(maxsize=None)
def weights(window: int, order: int, derivative: int) -> np.ndarray:
    """``[position, neighbour]``: least-squares polynomial over the window, read at a position."""
    x = np.arange(window) - (window - 1) / 2
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    if derivative:
        read = np.vander(x, order, increasing=True) * np.arange(1, order + 1)
        read = np.hstack([np.zeros((window, 1)), read])
    else:
        read = np.vander(x, order + 1, increasing=True)
    return read @ fit


def weight_table(spark, widest: int = WINDOW, order: int = ORDER) -> DataFrame:
    """``_case, _w0.., _d0..``: the weights of every window length and position, zero-padded.

    Its size is fixed by ``widest`` (75 rows at 15, one more for "too short"), so it may always
    be broadcast. Scalar, non-null columns keep the generated code of the sums small.
    """
    span = 2 * widest - 1
    rows = [np.zeros(2 * span)]
    for w in range(_smallest(order), widest + 1, 2):
        values, rates = weights(w, order, 0), weights(w, order, 1)
        for position in range(w):
            at = widest - 1 - position
            padded = np.zeros(2 * span)
            padded[at : at + w] = values[position]
            padded[span + at : span + at + w] = rates[position]
            rows.append(padded)
    table = np.array(rows)
    names = [f"_w{j}" for j in range(span)] + [f"_d{j}" for j in range(span)]
    fields = [pa.field("_case", pa.int32(), False), *[pa.field(n, pa.float64(), False) for n in names]]
    columns = [np.arange(-1, len(rows) - 1, dtype=np.int32), *table.T]
    return spark.createDataFrame(pa.table(columns, schema=pa.schema(fields)))


def _smallest(order: int) -> int:
    """The shortest odd window that is longer than the order."""
    return order + 2 - (order + 1) % 2


def smooth(
    df: DataFrame,
    partition: Sequence[str],
    at: str,
    values: dict[str, tuple[str, str]],
    dt: str,
    *,
    index: str = "seg_index",
    total: str = "seg_rows",
    widest: int = WINDOW,
    order: int = ORDER,
) -> DataFrame:
    """Add the smoothed value and its rate of change for each entry of ``values``.

    ``values`` maps column -> (smoothed, derivative). ``index`` and ``total`` place the row in
    its segment. Rows are read in order of ``at`` inside ``partition``, which must hold every
    row's neighbours, from a halo layout if need be. Segments too short for a fit give NULL.
    """
    n, i = F.col(total), F.col(index)
    width = F.least(F.lit(widest), n - 1 + n % 2).cast("int")
    start = F.greatest(F.lit(0), F.least(i - F.floor((width - 1) / 2), n - width))
    # Rows of the weight table before window length w: smallest + (smallest + 2) + ... + (w - 2).
    earlier = F.floor(((width - 1) * (width - 1) - (_smallest(order) - 1) ** 2) / 4)
    enough = n >= order + 2
    case = F.when(enough, earlier + i - start).otherwise(-1).cast("int")

    over = f"over (partition by {', '.join(f'`{c}`' for c in partition)} order by `{at}`)"
    offsets = range(-(widest - 1), widest)
    neighbours, names = [], {}
    for c in values:
        names[c] = [f"_{c}{j}" for j in range(len(offsets))]
        for k, name in zip(offsets, names[c]):
            there = f"coalesce(`{c}`, 0.0D)"
            shift = f"{'lead' if k > 0 else 'lag'}({there}, {abs(k)}, 0.0D) {over}"
            neighbours.append(F.expr(shift if k else there).alias(name))
    # The weights join after the windows, so that window buffers do not carry them.
    wide = df.select("*", *neighbours, case.alias("_case")).join(
        F.broadcast(weight_table(df.sparkSession, widest, order)), "_case"
    )
    results = []
    for c, (smoothed, rate) in values.items():
        terms = list(enumerate(names[c]))
        value = " + ".join(f"_w{j} * `{name}`" for j, name in terms)
        slope = " + ".join(f"_d{j} * `{name}`" for j, name in terms)
        results += [
            F.when(enough, F.expr(value)).alias(smoothed),
            F.when(enough, F.expr(slope) / F.col(dt)).alias(rate),
        ]
    return wide.select(*df.columns, *results)
