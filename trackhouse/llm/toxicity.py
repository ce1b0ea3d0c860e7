"""Toxicity by compression distance.

One zstandard dictionary is built for toxic and one for ordinary text, from the words of a bounded
sample of each class, the most frequent nearest to the text. A word or stem goes missing from the
dictionary of a class only where that class has it ``FAR`` times as rarely as the other and a
likelihood-ratio test on its document counts bears that out; its place is filled, so that what both
dictionaries hold lies equally far in both. What one lacks stands nearest. A window that becomes
shorter beside the toxic dictionary than beside the ordinary one is suspect. A logistic calibration
of the savings, on documents the dictionaries have not seen, gives the score; they also tell how
sure the test has to be.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm.columns import batch_slices, batch_with, quoted, schema_with
from trackhouse.llm.compression import FOLD, THOROUGH, bounded_sample, compressor, logistic, unlike, windows

#: Bounds of the training sample: documents taken of label 1 and of label 0.
MOST = {1: 3000, 0: 6000}
WINDOW = 96
#: A stretch of the shared words before each window: the compressor then never falls back to
#: storing a short window as it is, which would hide small savings.
CARRIER = 48
#: zstandard does not index the last bytes of a dictionary; these take their place.
TAIL = b"\0" * 16
SETTINGS = THOROUGH | {"min_match": 4}
#: Bytes of a dictionary: what the search settings index.
DICTIONARY = 32_000
#: How much rarer a class must have a word than the other for its dictionary to lack it.
FAR = 8
#: The test values to choose from (chi-squared with one degree of freedom; 0.1 % by chance, and far
#: less): few texts with many rare marks need the first, large samples the last.
SURE = (10.83, 15.0, 20.0)
FEATURES = 4


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration; small enough to travel with the tasks."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _stems(words: list[str]) -> set[str]:
    out = set()
    for word in set(words):
        word = " " + word
        out.add(word)
        out.update(word[:n] for n in range(5, min(len(word), 12)))
    return out


def evidence(k: int, n: int, m: int, other: int) -> float:
    """Twice the log-likelihood ratio that a word in ``k`` of ``n`` documents of a class is more
    common there than with ``m`` of ``other``; 0 unless it is ``FAR`` times as common."""
    if k / n < FAR * (m + 0.5) / other:
        return 0.0
    rate = (k + m) / (n + other)
    return 2 * sum(x * math.log(x / (size * rate)) for x, size in ((k, n), (m, other)) if x)


def _own(found: dict[str, float], mine: Counter, least: float) -> dict[str, float]:
    """Words and stems that the other class lacks, with their evidence; the surest of each family, in
    the longest form that nearly all of its documents have."""
    sure = {w: e for w, e in found.items() if e > least}
    chosen: dict[str, float] = {}
    for w in sorted(sure, key=lambda w: (-sure[w], len(w), w)):
        if not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen[max((x for x in sure if x.startswith(w) and mine[x] >= 0.8 * mine[w]), key=lambda x: (len(x), x))] = sure[w]
    return chosen


def dictionaries(toxic: list[str], ordinary: list[str], levels: tuple[float, ...] = SURE) -> list[tuple[bytes, bytes]]:
    """The two dictionaries from folded texts, for every test value. Near copies of a text count once."""
    words, stems, sizes = [Counter(), Counter()], [Counter(), Counter()], [1, 1]
    for i, texts in enumerate((toxic, ordinary)):
        for own in unlike(texts):
            words[i].update({" " + w for w in own})
            stems[i].update(_stems(own))
            sizes[i] += 1
    found = [{w: e for w, k in stems[i].items() if (e := evidence(k, sizes[i], stems[1 - i][w], sizes[1 - i])) > min(levels)} for i in (0, 1)]
    shared = sorted(words[0] | words[1], key=lambda w: (-max(words[0][w] / sizes[0], words[1][w] / sizes[1]), w))
    return [_aligned([_own(found[i], stems[i], least) for i in (0, 1)], shared) for least in levels]


def _aligned(own: list[dict[str, float]], shared: list[str]) -> tuple[bytes, bytes]:
    """Both dictionaries: what only one holds nearest, then the shared words, at equal places."""
    marks = sorted(((-e, w, i) for i in (0, 1) for w, e in own[i].items()))
    barred = tuple(w for _, w, _ in marks)
    out, size = ([], []), 0
    for word, only in [(w, i) for _, w, i in marks] + [(w, None) for w in shared if not w.startswith(barred)]:
        raw = word.encode()
        size += len(raw)
        if size > DICTIONARY:
            break
        for i in (0, 1):
            out[i].append(raw if only in (None, i) else b"\0" * len(raw))
    return tuple(b"".join(reversed(parts)) + TAIL for parts in out)


@lru_cache(maxsize=2)
def _pair(toxic: bytes, ordinary: bytes):
    return compressor(toxic, SETTINGS), compressor(ordinary, SETTINGS)


def measure(raw: bytes, toxic: bytes, ordinary: bytes) -> list[float]:
    """Lengths saved by the toxic dictionary: the most in a window, how many windows save clearly,
    what all save together, and the share of clear ones."""
    one, two = _pair(toxic, ordinary)
    carrier = ordinary[:CARRIER]
    most = total = 0.0
    clear = n = 0
    for window in windows(raw.translate(FOLD), WINDOW):
        n += 1
        window = carrier + window
        saved = len(two.compress(window)) - len(one.compress(window))
        if saved > 0:
            most = max(most, saved)
            total += saved
            clear += saved > 1
    return [min(most, 12.0), np.log1p(clear), np.log1p(total), clear / max(1, n)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the documents that ``labels`` marks 0 or 1; the caller leaves out held-out ones.

    At most about ``MOST`` documents of each label go to the driver, chosen by a hash of their id,
    with whole texts. Three fifths give the dictionaries, the others the calibration. Of rows that
    share an id the text with the least hash stands for all; an id with both labels counts in both,
    null ids teach nothing. Without both labels the score is one constant.
    """
    # Only short rows are counted and chosen; the texts follow for the chosen ones alone.
    marked = labels.where(quoted(label).isin(0, 1)).select(quoted(id_col).alias("id"), quoted(label).cast("int").alias("label"))
    chosen = bounded_sample(marked, "id", "label", MOST).distinct()
    # The chosen ids are bounded by ``MOST``, so they are sent to the texts, not the texts to them.
    texts = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.select("label", "text", F.pmod(F.xxhash64("id"), F.lit(5)).alias("part")).orderBy("id", "label").collect()
    return fit([(r.label, (r.text or "").encode().translate(FOLD), r.part) for r in rows])


def fit(folded: list[tuple[int, bytes, int]]) -> Model:
    """A model from ``(label, folded text, part)``: parts 0 and 1 calibrate, others give the dictionaries."""
    base = (sum(y for y, _, _ in folded) + 0.5) / (len(folded) + 1)
    if len({y for y, _, _ in folded}) < 2:
        return Model(b"", b"", (float(np.log(base / (1 - base))),) + (0.0,) * FEATURES)
    split = {y: [t.decode() for label, t, part in folded if label == y and part > 1] for y in (0, 1)}
    rest = [(y, t) for y, t, part in folded if part <= 1]
    if len({y for y, _ in rest}) < 2:
        rest = [(y, t) for y, t, _ in folded]
    truth = np.array([y for y, _ in rest], float)
    best, least = None, np.inf
    for toxic, ordinary in dictionaries(split[1], split[0]):
        features = np.array([measure(t, toxic, ordinary) for _, t in rest])
        weights = logistic(features, truth)
        value = np.clip(weights[0] + features @ weights[1:], -30, 30)
        loss = float(np.mean(np.log1p(np.exp(value)) - truth * value))
        if loss < least:
            best, least = Model(toxic, ordinary, tuple(weights.tolist())), loss
    return best


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Whole texts in windows; null and empty texts save nothing and get the score of that. Every row
    is kept, columns of these names are replaced. No shuffle.
    """
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, text, 4 << 20):
                column = part.column(part.schema.names.index(text)).cast(pa.binary()).to_pylist()
                found = np.array([measure(x or b"", model.toxic, model.ordinary) for x in column]).reshape(-1, FEATURES)
                value = 1 / (1 + np.exp(-np.clip(weights[0] + found @ weights[1:], -30, 30)))
                yield batch_with(part, {"score": pa.array(value), "predicted": pa.array((value >= threshold).astype(np.int32))})

    return docs.mapInArrow(run, schema_with(docs, {"score": T.DoubleType(), "predicted": T.IntegerType()}))
