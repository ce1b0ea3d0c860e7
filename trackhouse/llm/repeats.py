"""Removal of passages that stand earlier in the corpus, by fixed-block anchors.

A passage of ``window`` words always holds a whole block of ``window // 2`` words of any grid of
such blocks. So every document gives its non-overlapping blocks to an index and probes the index
with every rolling run of that length; runs that meet a block elsewhere are anchors. Windows
around anchors are then told apart by exact first occurrence, and overlapping repeated windows
join into maximal repeats.

Layout: documents are dealt to slices by a hash; a slice sends each distinct run once, packed per
bucket of hash values, and gets one bit per run back. A passage in every document therefore costs
one entry per slice, and no task holds more than a slice or a bucket, both of fixed mean size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm import words as W
from trackhouse.llm.columns import batch_with, buckets_for, fresh, quoted, schema_with, text_bytes, utf8

#: Bytes of text in a slice and in a bucket of runs, on average. Fixed, so their number grows.
SLICE_BYTES = 2_500_000
BUCKET_BYTES = 12_000_000
LOW = np.uint64(40)
LAST_ID = 2**63 - 1


def _planes(values: np.ndarray, width: int) -> bytes:
    """Bytes of equal weight together: high bytes of small numbers then compress away."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _keyed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 24 bits, 40 bits of the hash below."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return (bucket << LOW) | (h & np.uint64((1 << 40) - 1))


def _cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in sorted keys, and the bounds of each."""
    buckets = (keys >> LOW).astype(np.int64)
    firsts = np.flatnonzero(np.diff(buckets, prepend=-1))
    return buckets[firsts], np.append(firsts, len(keys))


@dataclass
class _Slice:
    """Texts of one slice in the corpus order, with their words."""

    table: pa.RecordBatch
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    ties: np.ndarray
    window: int
    buckets: int

    @classmethod
    def of(cls, table: pa.Table, names: dict, window: int, buckets: int) -> _Slice:
        batch = table.combine_chunks().to_batches()[0]
        ids = batch.column(batch.schema.names.index(names["id"])).cast(pa.int64()).fill_null(LAST_ID)
        ids = np.asarray(ids)
        ties = np.asarray(batch.column(batch.schema.names.index(names["tie"])), np.int64)
        order = np.lexsort((ties, ids))
        batch = batch.take(pa.array(order))
        data, bounds = utf8(batch.column(batch.schema.names.index(names["text"])))
        starts, ends, firsts = W.spans(data, bounds, W.SPACED)
        hashes = W.word_hashes(data, starts, ends)
        return cls(batch, data, bounds, starts, ends, firsts, hashes, ids[order], ties[order], window, buckets)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all rolling runs of half a window, and their keys."""
        length = self.window // 2
        at = np.flatnonzero(W.run_starts(self.firsts, length))
        return at, _keyed(W.run_hashes(self.hashes, length)[at], self.buckets)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, at, "right") - 1

    def candidates(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that hold an anchor, in order, with two independent hashes."""
        length = self.window // 2
        hit = np.zeros(len(self.hashes) + 1, np.int32)
        # An anchor at p lies in the windows that start from p - (window - length) to p.
        np.add.at(hit, np.maximum(near - (self.window - length), 0), 1)
        np.add.at(hit, near + 1, -1)
        at = np.flatnonzero((np.cumsum(hit[:-1]) > 0) & W.run_starts(self.firsts, self.window))
        first = W.run_hashes(self.hashes, self.window)[at]
        second = W.run_hashes(W.mixed(self.hashes + np.uint64(0x5851F42D4C957F2D)), self.window)[at]
        return at, first, second & np.uint64(0xFFFFFFFF)


def _emit_runs(state: _Slice, number: int) -> list[tuple]:
    at, keys = state.runs()
    ordered = np.sort(keys)
    new = np.flatnonzero(np.diff(ordered, prepend=np.uint64(0)) != 0) if len(ordered) else np.zeros(0, np.int64)
    if len(ordered) and ordered[0] == 0:
        new = np.concatenate([[0], new])
    distinct = ordered[new]
    several = np.diff(np.append(new, len(ordered))) > 1
    block = np.zeros(len(distinct), bool)
    grid = (at - state.firsts[state.doc_of(at)]) % (state.window // 2) == 0
    block[np.searchsorted(distinct, keys[grid])] = True
    rows = []
    for bucket, first, last in zip(*(lambda b, c: (b, c[:-1], c[1:]))(*_cut(distinct))):
        low = distinct[first:last] & np.uint64((1 << 40) - 1)
        rows.append((int(bucket), number, _planes(np.diff(low, prepend=np.uint64(0)), 5),
                     np.packbits(block[first:last]).tobytes(), np.packbits(several[first:last]).tobytes()))
    return rows


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _answer_runs(table: pa.Table) -> list[tuple]:
    """Per slice of a bucket, one bit for each of its runs: the run occurs again somewhere, and one
    of its occurrences is a block of the index."""
    slices, packed = table.column("slice").to_pylist(), table.column("runs").to_pylist()
    parts = [np.cumsum(_from_planes(raw, 5), dtype=np.uint64) for raw in packed]
    sizes = [len(p) for p in parts]
    keys = np.concatenate(parts)
    order = np.argsort(keys)
    ordered = keys[order]
    group = np.cumsum(np.diff(ordered, prepend=ordered[0]) != 0)
    block = np.concatenate([_bits(r, n) for r, n in zip(table.column("block").to_pylist(), sizes)])[order]
    several = np.concatenate([_bits(r, n) for r, n in zip(table.column("several").to_pylist(), sizes)])[order]
    times = np.bincount(group)
    has_block = np.bincount(group, weights=block) > 0
    again = (times > 1) | (np.bincount(group, weights=several) > 0)
    hit = np.empty(len(keys), bool)
    hit[order] = (again & has_block)[group]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return [(s, np.packbits(hit[a:b]).tobytes()) for s, a, b in zip(slices, bounds[:-1], bounds[1:]) if hit[a:b].any()]


def _anchors(state: _Slice, answers: dict[int, bytes]) -> np.ndarray:
    """Places of the runs that the index answered."""
    at, keys = state.runs()
    distinct = np.unique(keys)
    chosen = []
    buckets, bounds = _cut(distinct)
    for bucket, first, last in zip(buckets.tolist(), bounds[:-1], bounds[1:]):
        if bucket in answers:
            chosen.append(distinct[first:last][_bits(answers[bucket], last - first)])
    if not chosen:
        return np.zeros(0, np.int64)
    chosen = np.concatenate(chosen)
    slot = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
    return at[chosen[slot] == keys]


def _window_order(first: np.ndarray, second: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows by bucket and hashes, earliest first; group numbers in that order; group starts."""
    bucket = ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.lexsort((second, first, bucket))  # stable: the earliest stays first
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _emit_windows(state: _Slice, number: int, answers: dict[int, bytes]) -> list[tuple]:
    at, first, second = state.candidates(_anchors(state, answers))
    if not len(at):
        return []
    order, _, heads = _window_order(first, second, state.buckets)
    chosen = order[heads]
    doc = state.doc_of(at[chosen])
    bucket = (((first[chosen] >> np.uint64(32)) * np.uint64(state.buckets)) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        used, local = np.unique(doc[a:b], return_inverse=True)
        rows.append((int(bucket[a]), number, first[chosen[a:b]].tobytes(), _planes(second[chosen[a:b]], 4),
                     _planes(local.ravel(), 4), state.ids[used].tobytes(), state.ties[used].tobytes()))
    return rows


def _answer_windows(table: pa.Table) -> list[tuple]:
    """Per slice of a bucket, one bit for each of its windows: another slice has it earlier."""
    slices = table.column("slice").to_pylist()
    parts = [np.frombuffer(x, np.uint64) for x in table.column("runs").to_pylist()]
    sizes = [len(p) for p in parts]
    first = np.concatenate(parts)
    second = np.concatenate([_from_planes(x, 4) for x in table.column("second").to_pylist()])
    ids, ties = [], []
    for local, own, tie in zip(*(table.column(c).to_pylist() for c in ("doc", "ids", "ties"))):
        doc = _from_planes(local, 4).astype(np.int64)
        ids.append(np.frombuffer(own, np.int64)[doc])
        ties.append(np.frombuffer(tie, np.int64)[doc])
    order = np.lexsort((np.concatenate(ties), np.concatenate(ids), second, first))
    a, b = first[order], second[order]
    later = np.zeros(len(order), bool)
    later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    bit = np.empty(len(order), bool)
    bit[order] = later
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return [(s, np.packbits(bit[x:y]).tobytes()) for s, x, y in zip(slices, bounds[:-1], bounds[1:]) if bit[x:y].any()]


def _removed(state: _Slice, runs: dict[int, bytes], windows: dict[int, bytes]) -> np.ndarray:
    """For every word, whether a repeated window covers it."""
    at, first, second = state.candidates(_anchors(state, runs))
    marks = np.zeros(len(state.hashes) + 1, np.int32)
    if len(at):
        order, group, heads = _window_order(first, second, state.buckets)
        chosen = order[heads]
        bucket = (((first[chosen] >> np.uint64(32)) * np.uint64(state.buckets)) >> np.uint64(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        earlier = np.zeros(len(heads), bool)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if int(bucket[a]) in windows:
                earlier[a:b] = _bits(windows[int(bucket[a])], b - a)
        flagged = np.ones(len(order), bool)
        flagged[heads] = False  # the first here stays, unless another slice is earlier
        flagged |= earlier[group]
        begin = at[order[flagged]]
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + state.window, -1)
    return np.cumsum(marks[:-1]) > 0


def _rebuilt(state: _Slice, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts of the words that stay, one space between them, and the number of removed words."""
    counts = np.concatenate([[0], np.cumsum(gone)])
    n_removed = counts[state.firsts[1:]] - counts[state.firsts[:-1]]
    stay = np.flatnonzero(~gone)
    depth = np.zeros(len(state.data) + 1, np.int8)
    depth[state.starts[stay]] += 1
    depth[state.ends[stay]] -= 1
    mask = np.cumsum(depth[:-1], dtype=np.int8) > 0
    data = state.data.copy()
    doc = state.doc_of(stay)
    inner = state.ends[stay[:-1][doc[:-1] == doc[1:]]]
    data[inner] = 0x20
    mask[inner] = True
    sizes = np.concatenate([[0], np.cumsum(mask)])[state.bounds]
    out = pa.Array.from_buffers(pa.large_utf8(), len(state.bounds) - 1,
                                [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[mask])])
    return out.cast(pa.string()), n_removed


def _spans_of(state: _Slice, gone: np.ndarray) -> pa.Array:
    """Per text the runs of removed words, as word numbers from 0, end exclusive."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[state.firsts] = True
    begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    doc = state.doc_of(begin)
    cuts = np.searchsorted(doc, np.arange(len(state.bounds)))
    base = state.firsts[doc]
    pairs = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())],
                                       names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with the words gone that stand in a window of ``window`` words seen earlier.

    Words are parted by white space and compared unchanged. A window goes if the same words start
    earlier: in a smaller id, or further up in the same document; all windows are judged on the
    input. Adds ``n_words``, ``n_removed`` and ``removed`` (word spans) and puts the remaining
    words, joined by one space, into ``text``. Columns of these names are replaced.

    Null text stays null with no words; an empty text stays empty. Ids are whole numbers; a null id
    counts as the last. Rows that share an id are ordered by a hash of the text; of rows equal in
    both, one keeps its words. An empty table gives an empty result.
    """
    if window % 2:
        raise ValueError("window must be even")
    size = text_bytes(docs, text)
    n_slices, n_buckets = buckets_for(size, SLICE_BYTES), buckets_for(size, BUCKET_BYTES)
    slice_col, tie = fresh(docs, "slice_no"), fresh(docs, "text_hash")
    names = {"id": id_col, "text": text, "tie": tie}
    dealt = docs.withColumn(tie, F.xxhash64(quoted(text))).withColumn(
        slice_col, F.pmod(F.xxhash64(quoted(id_col), quoted(text)), F.lit(n_slices))
    )
    fields = [T.StructField("bucket", T.LongType()), T.StructField("slice", T.LongType())]
    blob = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    run_schema = T.StructType(fields + blob("runs", "block", "several"))
    window_schema = T.StructType(fields + blob("runs", "second", "doc", "ids", "ties"))
    answer_schema = T.StructType([*fields, T.StructField("bits", T.BinaryType()), T.StructField("kind", T.IntegerType())])

    def arrow(schema: T.StructType) -> pa.Schema:
        kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
        return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])

    run_arrow, window_arrow, answer_arrow = arrow(run_schema), arrow(window_schema), arrow(answer_schema)

    def emit_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _columns(_emit_runs(_Slice.of(table, names, window, n_buckets), key[0].as_py()), run_arrow)

    def answer(kind: int, solve):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            bucket = key[0].as_py()
            return _columns([(bucket, s, bits, kind) for s, bits in solve(table)], answer_arrow)

        return run

    def answers_of(table: pa.Table, kind: int) -> dict[int, bytes]:
        columns = (table.column(c).to_pylist() for c in ("bucket", "bits", "kind"))
        return {bucket: bits for bucket, bits, k in zip(*columns) if k == kind}

    def emit_windows(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _columns([], window_arrow)
        state = _Slice.of(left, names, window, n_buckets)
        return _columns(_emit_windows(state, key[0].as_py(), answers_of(right, 0)), window_arrow)

    out_schema = schema_with(
        docs,
        {
            text: T.StringType(),
            "n_words": T.LongType(),
            "n_removed": T.LongType(),
            "removed": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        },
    )

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        state = _Slice.of(left, names, window, n_buckets)
        gone = _removed(state, answers_of(right, 0), answers_of(right, 1)) if right.num_rows else np.zeros(len(state.hashes), bool)
        texts, n_removed = _rebuilt(state, gone)
        old = state.table.column(state.table.schema.names.index(text))
        if old.null_count:
            texts = pa.compute.if_else(pa.compute.is_valid(old), texts, pa.scalar(None, pa.string()))
        batch = state.table.drop_columns([slice_col, tie])
        batch = batch_with(batch, {text: texts, "n_words": pa.array(np.diff(state.firsts)),
                                   "n_removed": pa.array(n_removed), "removed": _spans_of(state, gone)})
        return pa.Table.from_batches([batch])

    by_slice = dealt.groupBy(quoted(slice_col))
    runs = by_slice.applyInArrow(emit_runs, run_schema)
    met = runs.groupBy("bucket").applyInArrow(answer(0, _answer_runs), answer_schema)
    windows = by_slice.cogroup(met.groupBy("slice")).applyInArrow(emit_windows, window_schema)
    earlier = windows.groupBy("bucket").applyInArrow(answer(1, _answer_windows), answer_schema)
    both = met.unionByName(earlier)
    return by_slice.cogroup(both.groupBy("slice")).applyInArrow(finish, out_schema)
