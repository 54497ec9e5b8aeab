"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All
functions work on UTF-8 bytes, so no Python string is made per word. Word
identity is a 64-bit polynomial hash of the bytes: two different words of one
corpus share a hash with probability about ``n**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_CODE = BYTE_CODE[FOLD]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the polynomial's base."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(grown)
    return _powers


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        h = h + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """The words of rows first..last-1; doc_at[i]:doc_at[i+1] are row i's words."""

    first: int
    last: int
    raw: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    doc_at: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.hashes[self.doc_at[i] : self.doc_at[i + 1]]

    def ends(self) -> np.ndarray:
        """The byte after each word."""
        space = IS_SPACE[self.raw]
        stop = np.concatenate([space[1:], [True]]) if len(space) else space
        inner = self.offsets[1:-1]
        stop[inner[(inner > 0) & (inner < len(stop) + 1)] - 1] = True
        return np.flatnonzero(stop & ~space) + 1


def scan_words(raw: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, word index of each row) of one chunk."""
    n_rows = len(offsets) - 1
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
    space = IS_SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    doc_at = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, doc_at
    place = np.zeros(len(raw), np.int64)
    place[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(raw)) - np.cumsum(place)
    place[: starts[0]] = 0
    place[space] = 0
    code = (FOLDED_CODE if fold else BYTE_CODE)[raw]
    code[space] = 0
    with np.errstate(over="ignore"):
        code *= powers(int(place.max()) + 1)[place]
        hashes = mix(np.add.reduceat(code, starts))
    return hashes, starts, doc_at


def chunks(column: pa.Array, fold: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a column in chunks of whole rows; a longer row is a chunk of its own."""
    raw, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1)
        part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield Words(i, j, part, offs, *scan_words(part, offs, fold))
        i = j


_STEP = [_U(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one row, in order."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:m] * _STEP[0]
        for j in range(1, n):
            total = total + hashes[j : j + m] * _STEP[j]
    return mix(total)
