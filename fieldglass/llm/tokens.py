"""Words of many texts at once, as byte ranges and 64-bit hashes.

A group of texts is one byte buffer. Word borders come from one comparison of neighbouring
bytes and word hashes from one running sum over the buffer, so the cost per byte is a few
array operations, however many words there are. Buffers are bounded; only a single text
longer than the bound makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text worked on at a time.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers, so that all bits depend on all bits."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: One random-looking number per byte value.
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes inside words: everything but space and \x09-\x0D.
NOT_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes inside words of digits, lower-case letters and characters outside ASCII.
ALPHANUMERIC = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Tokens:
    """Words of consecutive texts; text t has words first[t] to first[t + 1]."""

    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]

    def words(self, i: int, j: int) -> list[bytes]:
        return [self.buffer[s:e] for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist())]


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n or len(_powers[0]) > 4 * max(n, CHUNK_BYTES):
        size = max(n, CHUNK_BYTES + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def tokenize(texts: list[bytes], inside: np.ndarray = NOT_SPACE) -> Tokens:
    buffer = b"\n".join([*texts, b""])
    data = np.frombuffer(buffer, np.uint8)
    within = inside[data]
    step = np.diff(within.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    up, down = _powers_upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return Tokens(buffer, starts, ends, mix(raw + (ends - starts).astype(_U)), first)


def chunks(column, lower: bool = True) -> Iterator[tuple[slice, list[bytes]]]:
    """Consecutive ranges of an Arrow string column, of about CHUNK_BYTES each, as UTF-8.

    A-Z are lower-cased on request; null counts as empty. Only one range at a time is
    turned into Python objects.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().tolist()
    begin = size = 0
    for i, more in enumerate([*sizes, CHUNK_BYTES + 1]):
        if i > begin and (size + more > CHUNK_BYTES or i == len(sizes)):
            texts = [x or b"" for x in column.slice(begin, i - begin).to_pylist()]
            yield slice(begin, i), [t.lower() for t in texts] if lower else texts
            begin, size = i, 0
        size += more


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashed parts in order."""
    return mix(a * _U(0xD6E8FEB86659FD93) + b)


_word_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
_WORD_BASE = 0xD1342543DE82EF95


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; one fewer than that many at the end are missing."""
    n = len(hashes)
    if n < size:
        return np.empty(0, _U)
    if len(_word_powers[0]) < n + 1:
        for k, base in enumerate((_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, _U)
            steps[0] = 1
            _word_powers[k] = np.multiply.accumulate(steps)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * _word_powers[0][:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _word_powers[1][: n - size + 1])
