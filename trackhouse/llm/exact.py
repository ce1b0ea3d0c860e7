"""Vectors in whole numbers, exact sums over tasks, and facts joined to rows whatever the key's skew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm.columns import quoted

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Whole components stay below this, so that squared distances of some thousand fit 64 bits.
LARGEST = 1 << 26
#: A table of facts with at most so many rows is broadcast.
SMALL = 100_000
#: A key is hot from one row in so many on, so there are at most so many hot keys.
HOT = 1000


def finite(vector: str) -> Column:
    """True where the vector is present and none of its components is null, NaN or infinite."""
    fine = F.forall(quoted(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(quoted(vector).isNotNull() & fine, F.lit(False))


def as_stored(df: DataFrame, vector: str) -> Column:
    """The vector in single precision if it came so, else in double precision."""
    kind = df.select(quoted(vector)).schema[0].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return quoted(vector) if single else quoted(vector).cast("array<double>")


def whole(column: pa.Array, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of a column of finite vectors of one width, one row each."""
    flat = np.floor(SCALE * np.asarray(column.flatten()).astype(np.float64))
    if flat.size and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} give distances that do not fit 64 bits")
    return flat.astype(np.int64).reshape(-1, width)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``rows``, none of them empty."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def totals(partial: DataFrame, keys: list[str], value: str) -> dict[tuple, int]:
    """The exact sums of ``value`` by ``keys``, for keys whose number the caller bounds."""
    summed = partial.groupBy(*keys).agg(F.sum(F.col(value).cast("decimal(20,0)")).alias("total"))
    return {tuple(r[k] for k in keys): int(r["total"]) for r in summed.collect()}


def attach(rows: DataFrame, facts: DataFrame, key: str, n_rows: str, fact: str) -> DataFrame:
    """``rows`` with the column ``fact`` of the ``facts`` of their ``key``, null where there is none.

    ``facts`` (written, so that counting it is cheap) has a row per key, with the number of rows of
    that key in ``n_rows``; a null key meets a null key. Up to ``SMALL`` facts are broadcast. Of more,
    those of hot keys (at most ``HOT``, as each has one row in ``HOT``) are broadcast, and only rows of
    other keys, none of which is large, are shuffled.
    """
    same = lambda table: rows[key].eqNullSafe(table["__key"])
    named = facts.select(F.col(key).alias("__key"), F.col(fact), F.col(n_rows).alias("__n"))
    if named.limit(SMALL + 1).count() <= SMALL:
        light = named.drop("__n")
        return rows.join(F.broadcast(light), same(light), "left").drop("__key")
    least = F.lit(facts.agg(F.sum(n_rows)).first()[0] / HOT)
    hot = named.where(F.col("__n") >= least).select("__key", F.col(fact).alias("__hot"))
    cold = named.where(F.col("__n") < least).drop("__n")
    marked = rows.join(F.broadcast(hot), same(hot), "left").drop("__key")
    done = marked.where("`__hot` is not null").withColumnRenamed("__hot", fact)
    rest = marked.where("`__hot` is null").drop("__hot")
    return done.unionByName(rest.join(cold, rest[key].eqNullSafe(cold["__key"]), "left").drop("__key"))
