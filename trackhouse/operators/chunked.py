"""Python work on whole chunks of rows, many at a time.

Rows are dealt by a hash of their group and sorted by it alone, which Spark does by radix. A task then
puts many whole groups in order and works on them at once, so the cost does not depend on how many
short ones there are, and no group is parted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The column that rows are dealt and sorted by.
HASH = "_hash"


def dealt(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """``df`` with ``HASH``, the rows of a group together."""
    return df.withColumn(HASH, F.xxhash64(*group)).repartition(HASH).sortWithinPartitions(HASH)


def borders(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """True where a row differs from the one before in any of ``names``; the first row does."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        column = table[name].combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        new[1:] |= pc.fill_null(differs, False).to_numpy(zero_copy_only=False)
        if column.null_count:
            gone = column.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= gone[1:] != gone[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], group: Sequence[str], order: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by ``HASH`` as tables of about ``rows``, in order of ``group`` and then ``order``
    (numbers, NULL last), that never part rows equal in ``group``."""
    held, n = [], 0

    def ordered(table: pa.Table) -> pa.Table:
        keys = []
        for name in (HASH, *group, *order):
            column = table[name].combine_chunks()
            if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
                column = column.dictionary_encode(null_encoding="encode").indices
            values = column.to_numpy(zero_copy_only=False)
            keys.append(values if not column.null_count else np.where(np.isnan(values), np.inf, values))
        return table.take(pa.array(np.lexsort(keys[::-1]))).drop_columns([HASH])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(borders(table, [HASH]))[-1])
            if last:
                yield ordered(table.slice(0, last))
            held, n = table.slice(last).to_batches(), table.num_rows - last
    if n:
        yield ordered(pa.Table.from_batches(held).combine_chunks())
