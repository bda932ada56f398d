"""Periodic runs of words, found by internal pattern matching, and texts without their repetitions.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends keeping the period.

1. Words are numbered by hash. Periods 1 and 2 show in direct comparisons of blocks of one
   and two words.
2. For longer periods, factors of 4, 8, 16, ... words are told apart by prefix doubling,
   which sorts the positions of repeated factors into a suffix array; the suffixes that
   share a factor are a range of it. Suffixes whose first four words are unique in their
   text can hold no such run and are left out of the array.
3. The dyadic blocks (words i to i + B - 1, where B = 2^k divides i) whose factor occurs again
   query their range: a wavelet tree over the suffix array gives the next and the previous
   occurrence, by counting the smaller positions in the range and then selecting the
   neighbours. An occurrence at a distance in (B / 2, B] continues a progression, and its
   difference is a candidate period.
4. A candidate is extended word by word in both directions. Of equal stretches the smallest
   period stays, as its multiples are periods too.

No run is missed: with B in [q, 2q), a run of 4q words or more holds a whole block, and the
block q words later or q words earlier as well. As B >= q, no occurrence inside the run is
closer than q.

Tasks work on about half a megabyte of text at a time; a longer text is one piece of its own,
and what it needs is in proportion to its words. Nothing is shuffled.

Defined results for odd input: null and empty texts have no runs and collapse to an empty
text. Repeated rows get a result each. Rows without an id are texts like any other. An empty
table gives an empty result. ``find`` reads id and text only; ``collapse`` keeps all other
columns, whatever their names. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Tokens, chunks, mix, tokenize, window_hashes

#: A run has so many words at least, and its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words of the first factors that are sorted; shorter blocks are compared directly.
FIRST = 4

Run = tuple[int, int, int]


def _short_periods(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """(position, period) of repeated neighbouring blocks of one and two words."""
    n, found = len(words), []
    for q in (1, 2):
        at = np.arange(0, n, q)
        ahead = at[at + 2 * q <= end[at]]
        same = np.ones(len(ahead), bool)
        for k in range(q):
            same &= words[ahead + k] == words[ahead + k + q]
        back = at[(at - q >= begin[at]) & (at + q <= end[at])]
        again = np.ones(len(back), bool)
        for k in range(q):
            again &= words[back + k] == words[back + k - q]
        spots = np.unique(np.concatenate((ahead[same], back[again] - q)))
        # one block of a row of them is enough
        found += [(p, q) for p in spots[np.append(True, np.diff(spots) > q)[: len(spots)]].tolist()]
    return found


class _Suffixes:
    """Suffix array of the positions whose first words repeat in their text, and its block queries.

    ``blocks`` has rows (position, from, to, size): the suffixes from..to share the block's words.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, end: np.ndarray):
        keys = window_hashes(words, FIRST)
        spots = np.flatnonzero(np.arange(len(keys)) + FIRST <= end[: len(keys)])
        keys = mix(keys[spots] + text[spots].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = np.append(False, keys[1:] == keys[:-1])[: len(keys)]
        repeated = same | np.append(same[1:], False)[: len(keys)]
        self.array = spots[order[repeated]]
        group = np.flatnonzero(~same[repeated])
        m = len(self.array)
        slots = np.arange(m)
        group = np.repeat(group, np.diff(np.append(group, m)))
        rank = np.full(len(words), -1, np.int64)
        size, found = FIRST, []
        while len(slots):
            at = self.array[slots]
            rank[at] = group
            block = np.flatnonzero(at % size == 0)
            last = np.searchsorted(group, group[block], side="right") - 1
            found.append(np.stack([at[block], group[block], slots[last] + 1, np.full(len(block), size)], 1))
            # the second half of the next factor; where it is unique or cut off, so is the factor
            half = at + size
            ranks = rank[np.minimum(half, len(words) - 1)]
            alone = (at + 2 * size > end[at]) | (ranks < 0)
            second = np.where(alone, m + slots, ranks)
            order = np.lexsort((second, group))
            self.array[slots] = at[order]
            second, group = second[order], group[order]
            new = np.append(True, (second[1:] != second[:-1]) | (group[1:] != group[:-1]))
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(slots)))
            rank[self.array[slots]] = np.repeat(slots[heads], counts)
            going = np.repeat(counts > 1, counts)
            group = np.repeat(slots[heads], counts)[going]
            slots = slots[going]
            size *= 2
        self.blocks = np.concatenate(found) if found else np.empty((0, 4), np.int64)


class _Wavelet:
    """Levels of a wavelet tree over numbers 0..m-1, laid out bit by bit; built again at each pass."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.bits = max(1, int(len(numbers) - 1).bit_length()) if len(numbers) else 0

    def levels(self) -> Iterator[tuple[int, np.ndarray]]:
        now = self.numbers
        for bit in range(self.bits - 1, -1, -1):
            ones = (now >> bit) & 1 == 1
            zeros = np.zeros(len(now) + 1, np.int64)
            np.cumsum(~ones, out=zeros[1:])
            yield bit, zeros
            now = np.concatenate((now[~ones], now[ones]))

    def below(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many entries of low..high are smaller than ``number``."""
        total = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels():
            a, b = zeros[low], zeros[high]
            one = (number >> bit) & 1 == 1
            total += np.where(one, b - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return total

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The entry of low..high with k smaller ones."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels():
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << bit
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return value


def _long_periods(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """(position, period) for blocks of four words or more that occur again a period later."""
    suffixes = _Suffixes(words, text, end)
    blocks = suffixes.blocks
    if not len(blocks):
        return []
    places = np.sort(suffixes.array)
    tree = _Wavelet(np.searchsorted(places, suffixes.array))
    at, low, high, size = blocks.T
    smaller = tree.below(low, high, np.searchsorted(places, at))
    found = []
    for step in (1, -1):
        ask = np.flatnonzero((smaller + step >= 0) & (smaller + step < high - low))
        other = places[tree.select(low[ask], high[ask], smaller[ask] + step)]
        distance = np.abs(other - at[ask])
        good = (2 * distance > size[ask]) & (distance <= size[ask])
        found.append(np.stack([np.minimum(other, at[ask])[good], distance[good]], 1))
    return list(map(tuple, np.unique(np.concatenate(found), axis=0).tolist()))


def _same_from(words: np.ndarray, i: int, j: int, stop: int) -> int:
    """Number of equal words of i.. and j.., where j runs to ``stop``."""
    size, step = 0, 64
    while j + size < stop:
        more = min(step, stop - j - size)
        differ = words[i + size : i + size + more] != words[j + size : j + size + more]
        if differ.any():
            return size + int(differ.argmax())
        size, step = size + more, step * 2
    return size


def _same_before(words: np.ndarray, i: int, j: int, stop: int) -> int:
    """Number of equal words that end before i and before j, where i runs down to ``stop``."""
    size, step = 0, 64
    while i - size > stop:
        more = min(step, i - size - stop)
        differ = words[i - size - more : i - size] != words[j - size - more : j - size]
        if differ.any():
            return size + int(differ[::-1].argmax())
        size, step = size + more, step * 2
    return size


def runs_of(found: Tokens) -> list[list[Run]]:
    """(start, length, period) of every text's runs, by start and period."""
    words, first = found.hashes, found.first
    out: list[list[Run]] = [[] for _ in range(len(first) - 1)]
    if not len(words):
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1][text], first[1:][text]
    candidates = _short_periods(words, begin, end) + _long_periods(words, text, end)
    candidates.sort(key=lambda c: (c[1], c[0]))
    stretches: dict[tuple[int, int], int] = {}
    covered = (0, -1)
    for at, q in candidates:
        if covered[0] == q and at < covered[1]:
            continue
        low, high = int(begin[at]), int(end[at])
        start = at - _same_before(words, at, at + q, low)
        stop = at + _same_from(words, at, at + q, high)
        covered = (q, stop)
        length = stop + q - start
        if length >= max(LEAST_WORDS, LEAST_TIMES * q):
            stretches.setdefault((start, length), q)
    for (start, length), q in stretches.items():
        t = int(text[start])
        out[t].append((start - int(first[t]), length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed_text(text: bytes, runs: list[Run]) -> bytes:
    """Words joined by one space, without those after the first period of a run."""
    words = text.split()
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _searching(batches, column: int) -> Iterator:
    """(rows, texts, runs) of a task's texts, a bounded part at a time."""
    for batch in batches:
        for part, texts in chunks(batch.column(column), lower=False):
            yield batch.slice(part.start, part.stop - part.start), texts, runs_of(tokenize(texts))


def _finding(batches) -> Iterator:
    import pyarrow as pa

    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
    for rows, texts, runs in _searching(batches, 1):
        flat = np.array([r for one in runs for r in one], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(one) for one in runs]))).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(*f) for f in fields])
        short = pa.array([collapsed_text(t, r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), structs), short], names=["doc_id", "runs", "collapsed"]
        )


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (an array of start, length, period by word number) and the collapsed text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _finding, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each run cut to its first period; texts without runs stay as they are."""
    at = docs.columns.index(text)

    def cutting(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for rows, texts, runs in _searching(batches, at):
            new = pa.array([collapsed_text(t, r) if r else None for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            old = rows.column(at).cast(pa.string())
            yield rows.set_column(at, text, pc.coalesce(new, old))

    return docs.mapInArrow(cutting, docs.schema)
