"""Byte-level BPE with the tokenizers library, each distinct piece of text encoded once.

A byte-level vocabulary never merges over the borders that the split pattern draws, so a text's
ids are its pieces' ids in order. ``PieceEncoder`` finds the pieces of a whole slice of texts in
numpy, gives the library only the pieces it has not seen lately, and gathers ids from a table.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

from trackhouse.llm.words import mixed, powers

#: Classes of code points in the split pattern.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Endings that the pattern splits off after an apostrophe. Fixed values of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Known pieces kept per worker; beyond it the table starts anew.
KEPT_PIECES = 1_500_000
#: Code points handled at once.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, from the pattern library's own properties."""
    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    points = np.frombuffer(everything.encode("utf-32-le"), np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[points[m.start() : m.end()]] = kind
    return table


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces begin in the joined texts; text borders always begin one.

    A run of letters, of numbers or of other signs is a piece and takes one space before it; white
    space before a run leaves its last sign to it (or alone, where that is no space).
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kinds = _classes()[points]
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    edge = np.zeros(n, bool)
    edge[bounds[:-1][bounds[:-1] < n]] = True
    begins |= edge
    # Last white space sign before a run of another kind in the same text.
    last = np.zeros(n, bool)
    last[:-1] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~edge[1:]
    at = np.flatnonzero(last)
    begins[at] = True
    joined = at[points[at] == 0x20] + 1
    begins[joined] = False
    # A contraction: a piece that starts with a lone apostrophe before one of the endings.
    quotes = np.flatnonzero((points == 0x27) & begins)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kinds[quotes + 1] == LETTER) & ~edge[quotes + 1]]
    if len(quotes):
        ends = np.append(bounds[1:], n)[np.searchsorted(bounds[1:], quotes, "right")]
        first = points[quotes + 1]
        second = np.where(quotes + 2 < ends, points[np.minimum(quotes + 2, n - 1)], 0)
        width = np.zeros(len(quotes), np.int64)
        for ending in CONTRACTIONS:
            fits = first == ord(ending[0])
            if len(ending) == 2:
                fits &= second == ord(ending[1])
            width[fits & (width == 0)] = len(ending)
        quotes, width, ends = quotes[width > 0], width[width > 0], ends[width > 0]
        begins[quotes + 1] = False
        after = quotes + width + 1
        # What follows the ending begins a piece, but for a sign that a space already began.
        begins[after[after < ends]] = True
    return np.flatnonzero(begins)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 signs
    for themselves, the rest from U+0100 on in order."""
    out, extra = [], 0x100
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            out.append(chr(byte))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merges below its own rank leave of a token."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            raise ValueError(f"rank {limit} cannot be reached by merging pairs")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer_from_ranks(path: str) -> Tokenizer:
    """A tokenizer of the library with the merges that a rank file implies."""
    ranks = read_ranks(path)
    letters = byte_letters()
    spelled = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            left, right = _merge(token, ranks)
            merges.append((spelled[left], spelled[right]))
    built = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges))
    built.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return built


@lru_cache(maxsize=4)
def tokenizer_from_json(path: str) -> Tokenizer:
    """A tokenizer file, special strings in a text taken as ordinary text."""
    built = Tokenizer.from_file(path)
    built.encode_special_tokens = True
    return built


@dataclass
class Encoded:
    """Ids of some texts: ``ids[bounds[i]:bounds[i + 1]]`` are those of text ``i``."""

    ids: np.ndarray
    bounds: np.ndarray


class PieceEncoder:
    """Encodes slices of texts; keeps the ids of pieces it has met."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.arena = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Add pieces, sorted by hash, with the ids that the library gives each of them alone."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.fromiter(found.word_ids, np.int64, len(found)), minlength=len(pieces))
        first = len(self.arena) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.arena = np.concatenate([self.arena, np.array(found.ids, np.uint32)])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, counts)

    def encode(self, texts: list[str]) -> Encoded:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = piece_starts(points, bounds)
        if not len(starts):
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        ends = np.append(starts[1:], len(points))
        up, down = powers(_BASE, len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_values()[points] * up[: len(points)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(distinct, (joined, starts[example], ends[example]))[inverse]
        counts = self.count[slots]
        closes = np.cumsum(counts)
        total = int(closes[-1])
        ids = self.arena[np.repeat(self.first[slots] - (closes - counts), counts) + np.arange(total)]
        by_text = np.concatenate([[0], closes])[np.searchsorted(starts, bounds)]
        return Encoded(ids, by_text)

    def _slots(self, distinct: np.ndarray, where: tuple) -> np.ndarray:
        """The table rows of pieces, after learning those that are new."""
        joined, starts, ends = where
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > KEPT_PIECES and len(self.known):
                self._reset()  # the table starts anew with what this slice needs
                return self._slots(distinct, where)
            pieces = [joined[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            self._learn(distinct[new], pieces)
            at = np.searchsorted(self.known, distinct)
        return at


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file (``.tiktoken`` ranks or a tokenizer's JSON)."""
    built = tokenizer_from_ranks(path) if path.endswith(".tiktoken") else tokenizer_from_json(path)
    return PieceEncoder(built)
