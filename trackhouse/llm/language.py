"""Language by compression: the dictionary beside which a text becomes shortest.

One raw-content dictionary per language is taken from a bounded sample of documents. A text is
compressed window by window beside each, in one way at every length; the sums decide. Where the best two lie close together,
or a text has no letter, the guess is rejected.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackhouse.llm.columns import batch_slices, batch_with, quoted, schema_with, unused
from trackhouse.llm.compression import FOLD, THOROUGH, bounded_sample, compressor, unlike, windows

#: Bound of the sample: documents taken of each language.
MOST = 400
#: Bytes of a dictionary.
DICTIONARY = 24_000
#: Words of a stretch of running text in a dictionary.
STRETCH = 40
#: Bytes of a window.
WINDOW = 96
#: What begins every dictionary and every window: the compressor then never stores a window as it
#: is, which would make all languages equal.
CARRIER = b"0123456789-=+*/0123456789(carrier)0123456789"
#: A guess whose lead over the next language is below this share of the length is rejected.
MARGIN = 0.001
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def dictionary(texts: list[str]) -> bytes:
    """Half running text, then half the most frequent words, which stand nearest; near copies count once.

    The running text is one stretch each of texts spaced evenly over all, from a place that a hash
    of the text gives.
    """
    words, kept = Counter(), []
    for own in unlike(texts):
        words.update(own)
        at = zlib.crc32(" ".join(own).encode()) % max(1, len(own) - STRETCH + 1)
        kept.append(" ".join(own[at : at + STRETCH]).encode())
    half = DICTIONARY // 2
    n = min(len(kept), max(1, half * len(kept) // max(1, sum(map(len, kept)))))
    running = b" ".join(kept[i * len(kept) // n] for i in range(n))
    frequent, size = [], 0
    for word in sorted(words, key=lambda w: (-words[w], w)):
        size += len(word.encode()) + 1
        if size > half:
            break
        frequent.append(word)
    return CARRIER + running + (" " + " ".join(reversed(frequent))).encode()


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model from the documents with a language; the caller leaves out held-out ones. About
    ``MOST`` documents of each language go to the driver, chosen by a hash of the id, with whole
    texts. Null texts, languages and ids teach nothing; repeated rows count once."""
    known = docs.where(quoted(label).isNotNull() & quoted(text).isNotNull())
    rows = bounded_sample(known, id_col, label, {"*": MOST}).select(
        quoted(label).alias("label"), quoted(text).alias("text"), quoted(id_col).alias("id")
    ).collect()
    by_label: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (str(r.id), r.text)):
        by_label.setdefault(r.label, []).append(r.text.encode().translate(FOLD).decode())
    # Ties go to the language with more sampled text, then by name.
    order = sorted(by_label, key=lambda k: (-sum(map(len, by_label[k])), k))
    return Model(tuple(order), tuple(dictionary(by_label[k]) for k in order))


@lru_cache(maxsize=2)
def _compressors(model: Model):
    return tuple(compressor(d, THOROUGH) for d in model.dictionaries)


def lengths(raw: bytes, model: Model) -> np.ndarray:
    """Compressed length of the whole text beside each dictionary."""
    parts = [CARRIER + p for p in windows(raw.translate(FOLD), WINDOW)]
    return np.array([sum(len(c.compress(p)) for p in parts) for c in _compressors(model)], float)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``.

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no letter or
    nothing was learned (score 0). ``margin`` is the lead over the next language as a share of the
    compressed length; below ``MARGIN`` the guess stands but is ``rejected``, as ``und`` is. A
    model of one language has margin 1. Every row is kept, columns of these names are replaced. No
    shuffle.
    """
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "margin": T.DoubleType(), "rejected": T.BooleanType()}
    flag = unused("__has_letter", docs.columns)
    flagged = docs.withColumn(flag, F.coalesce(quoted(text).rlike(r"\p{L}"), F.lit(False)))
    schema = schema_with(docs, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, text, 4 << 20):
                names = part.schema.names
                texts = part.column(names.index(text)).cast(pa.binary()).to_pylist()
                letters = part.column(names.index(flag)).to_pylist()
                guess, score, margin = [], [], []
                for raw, has in zip(texts, letters):
                    if not has or not model.languages:
                        guess.append(UNKNOWN)
                        score.append(0.0)
                        margin.append(0.0)
                        continue
                    found = lengths(raw, model)
                    order = np.argsort(found, kind="stable")
                    best = found[order[0]]
                    lead = (found[order[1]] - best) / best if len(found) > 1 else 1.0
                    weight = np.exp(-(found - best) / max(1.0, best) * 40)
                    guess.append(model.languages[order[0]])
                    score.append(float(1 / weight.sum()))
                    margin.append(float(lead))
                values = {"lang_pred": pa.array(guess, pa.string()), "score": pa.array(score, pa.float64()),
                          "margin": pa.array(margin, pa.float64()),
                          "rejected": pa.array([g == UNKNOWN or m < MARGIN for g, m in zip(guess, margin)])}
                yield batch_with(part.drop_columns([flag]), values)

    return flagged.mapInArrow(run, schema)
