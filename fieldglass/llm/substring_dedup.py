"""Substring dedup by collinear chaining of shared k-mer seeds.

1. Seeds are minimizers: of every ``spread`` consecutive k-mers of words the one with the
   smallest hash. Any passage of ``k + spread - 1`` equal words (23) gives the same seeds in
   every document that holds it.
2. A seed that several documents share links each of them with the first and the last of
   those documents, not with all others. A passage that thousands share gives two links each.
3. The seeds that two linked documents share are chained: an ordered run of matches that
   rises in both documents, scored by matched words less a cost per skipped word. The best
   predecessor of a match is a prefix maximum, which a Fenwick tree over the positions in the
   other document keeps.
4. Chains are aligned word by word: equal stretches and edits between matches are counted,
   and the ends are extended while that pays. Passages of ``least`` words or more (40) in
   both documents that agree in ``identity`` of their words are reported. A chain that agrees
   less as a whole, as with a rewritten paragraph inside, is split into the parts that do.
5. What the links of step 2 miss is found exactly: in stretches whose seeds lie in several
   places, every window of ``least`` words meets the first place with the same words. Windows
   that hold a word not reported yet are chained and aligned like the rest. So every word of
   an exact passage of ``least`` words that lies somewhere before is reported.
6. Edited copies that met no other holder in step 2: two seeds that lie close enough to begin a
   chain, one of them with a word not reported yet, meet every earlier place of the same two
   seeds, in all documents that hold them. What is reported is left out, so the many copies of
   a passage are not compared with each other. Of two seeds with many places, as in a line too
   short to be a passage, only those meet that agree again around it (``_promising``).

A passage is reported for the later document, with the earlier one as its origin, once for
each of its places there. A passage that recurs inside one document is reported at its later
places with the document itself as its origin; a later place may overlap the first. Words are
compared after lower-casing A-Z.

Defined results for odd input: null, empty and short texts share nothing; rows without an id
are left out. Rows that repeat an id with the same text are one document. Of rows that repeat
an id with other texts each text is a document of its own, all but one of them later than
every other document; ``version``, the hash of the text, says which one a passage lies in, and
is null where an id has one text. An empty table gives no passages. Other columns are not
read by ``passages`` and stay as they are in ``without_repeats``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import bitmap_of, hit, join_some, slot_of
from .graph import kept_table
from .tokens import NOT_SPACE, chunks, join_hash, tokenize, window_hashes

K, SPREAD, LEAST, IDENTITY = 8, 16, 40, 0.8
#: Words beyond a chain in which its ends are extended.
MARGIN = 64
GAP_COST = 0.15
#: Score of a differing word and loss of score that ends an extension.
MISMATCH, DROP = -2, 8

_U = np.uint64


def seeds_of(hashes: np.ndarray, first: np.ndarray, k: int, spread: int):
    """(text, position, key, words back to the key's first place in the text, lead) of the seeds of consecutive texts.

    Of places of a key that lie closer together than ``spread``, as in a text of one repeated
    word, one in ``spread`` words leads; all others do.
    """
    keys = window_hashes(hashes, k)
    if len(keys) < spread:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, _U), np.empty(0, np.int64), np.empty(0, bool))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(len(keys) - spread + 1)
    whole = owner[starts] == owner[starts + spread + k - 2]
    starts = starts[whole]
    windows = np.lib.stride_tricks.sliding_window_view(keys, spread)[whole]
    at = np.unique(starts + windows.argmin(axis=1)) if len(starts) else starts
    order = np.lexsort((at, keys[at], owner[at]))
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = (keys[at][1:] != keys[at][:-1]) | (owner[at][1:] != owner[at][:-1])
    back = at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
    lead = new.copy()
    lead[1:] |= back[1:] // spread != back[:-1] // spread
    return owner[at], at - first[owner[at]], keys[at], back, lead


def _seeding(k: int, spread: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part, texts in chunks(batch.column(1)):
                found = tokenize(texts, NOT_SPACE)
                text, at, keys, back, lead = seeds_of(found.hashes, found.first, k, spread)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part][text]), pa.array(keys.view(np.int64)), pa.array(at.astype(np.int32)),
                        pa.array(back.astype(np.int32)), pa.array(lead),
                    ],
                    names=["doc_id", "key", "pos", "back", "lead"],
                )

    return run


def chain(i: list[int], j: list[int], weight: float, gap: float = GAP_COST) -> list[list[int]]:
    """Best local chains of the matches (i, j); indices in rising order.

    With costs linear in the skipped words, score - gap * ((i - i') + (j - j')) splits into
    a part of the predecessor, whose maximum over smaller j a Fenwick tree holds, and a part
    of the match itself.
    """
    n = len(i)
    order = sorted(range(n), key=lambda x: (i[x], -j[x]))
    ranks = {v: r + 1 for r, v in enumerate(sorted(set(j)))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, before = [0.0] * n, [-1] * n
    for x in order:
        r = ranks[j[x]] - 1
        best = (float("-inf"), -1)
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - gap * (i[x] + j[x])
        score[x] = weight
        if gain > 0:
            score[x], before[x] = weight + gain, best[1]
        entry = (score[x] + gap * (i[x] + j[x]), x)
        r = ranks[j[x]]
        while r < len(tree):
            if entry > tree[r]:
                tree[r] = entry
            r += r & -r
    used = [False] * n
    chains = []
    for x in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(x)
            x = before[x]
        if path:
            chains.append(path[::-1])
    return chains


def _chaining(k: int, spread: int):
    """Per pair of documents: chains of two matches or more, or of one beside a match of another chain.

    A passage has two seeds at least; where one of them occurs earlier in the origin too, its
    match may lie in another chain.
    """

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for a, b, i, j in zip(frame["a"], frame["b"], frame["i"], frame["j"]):
                places = np.unique(i)
                i, j = i.tolist(), j.tolist()
                for path in chain(i, j, float(k)):
                    x = i[path[0]]
                    if len(path) > 1 or np.searchsorted(places, x + spread, "right") - np.searchsorted(places, x - spread) > 1:
                        out.append((a, b, [i[x] for x in path], [j[x] for x in path]))
            yield pd.DataFrame(out, columns=["a", "b", "i", "j"])

    return run


def _extended(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far two sequences go on together without gaps, and how many words agree there."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, MISMATCH))
    top = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(top - score > DROP)
    reach = int(stop[0]) if len(stop) else n
    if not reach or score[:reach].max() <= 0:
        return 0, 0
    length = int(score[:reach].argmax()) + 1
    return length, int(same[:length].sum())


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Words that agree in the best alignment of two stretches between matches."""
    if len(x) == len(y):
        plain = int((x == y).sum())
        if plain >= len(x) - 2:
            return plain
    if not len(x) or not len(y):
        return 0
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        diagonal = row[:-1] + (y == v)
        row[1:] = np.maximum(diagonal, row[1:])
        row = np.maximum.accumulate(row)
    return int(row[-1])


def _equal_start(x: np.ndarray, y: np.ndarray) -> int:
    """Words that two sequences have in common before the first that differs."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _rows(i: list[int], j: list[int], x: np.ndarray, y: np.ndarray, k: int) -> list[list[int]]:
    """[start, other start, end, other end, agreeing words, columns] of the equal runs of a chain and of what lies between them, in turn."""
    first_a, first_b = i[0], j[0]
    less = _equal_start(x[:first_a][::-1], y[:first_b][::-1])
    rows = [[first_a - less, first_b - less, first_a, first_b, less, less]]

    def run(length: int) -> None:
        a, b = rows[-1][2], rows[-1][3]
        if rows[-1][4] < rows[-1][5]:
            rows.append([a, b, a, b, 0, 0])
        rows[-1][2:] = [a + length, b + length, rows[-1][4] + length, rows[-1][5] + length]

    for a, b in zip(i, j):
        end_a, end_b = rows[-1][2], rows[-1][3]
        length = k
        if a < end_a or b < end_b:  # overlaps the match before
            cut = max(end_a - a, end_b - b)
            if cut >= k:
                continue
            a, b, length = a + cut, b + cut, k - cut
        gap_a, gap_b = x[end_a:a], y[end_b:b]
        head = _equal_start(gap_a, gap_b)
        gap_a, gap_b = gap_a[head:], gap_b[head:]
        tail = _equal_start(gap_a[::-1], gap_b[::-1])
        gap_a, gap_b = gap_a[: len(gap_a) - tail], gap_b[: len(gap_b) - tail]
        if head:
            run(head)
        if len(gap_a) or len(gap_b):
            end_a, end_b = rows[-1][2], rows[-1][3]
            rows.append([end_a, end_b, end_a + len(gap_a), end_b + len(gap_b), _agreeing(gap_a, gap_b), max(len(gap_a), len(gap_b))])
        run(tail + length)
    run(_equal_start(x[rows[-1][2] :], y[rows[-1][3] :]))
    return rows


def _longest(rows: list[list[int]], low: int, high: int, identity: float) -> tuple[int, int]:
    """First and last of the rows low..high (equal runs at both ends) that make the longest part of enough agreement."""
    total, starts, sums = 0.0, [], []
    best = (-1, low, low)
    for n in range(low, high + 1):
        run = rows[n][4] == rows[n][5]
        if run and (not sums or total < sums[-1]):
            starts.append(n)
            sums.append(total)
        total += rows[n][4] - identity * rows[n][5]
        if run:  # the sums fall: the first that is not above the total is the farthest start
            begin = starts[bisect.bisect_left(sums, -total - 1e-9, key=lambda v: -v)]
            best = max(best, (rows[n][2] - rows[begin][0], begin, n))
    return best[1], best[2]


def align(i: list[int], j: list[int], x: np.ndarray, y: np.ndarray, x0: int, y0: int, k: int, least: int, identity: float):
    """(start, end, other start, other end, share of agreeing words) of every part of a chain that is long and equal enough.

    ``x`` and ``y`` are the words around the chain, beginning at positions x0 and y0. A chain
    that agrees as a whole is one part. Otherwise the longest part that agrees is taken out,
    then the longest of what is left before and after it, until no run is left.
    """
    rows = _rows([v - x0 for v in i], [v - y0 for v in j], x, y, k)

    def part(low: int, high: int, from_a: int, from_b: int, to_a: int, to_b: int):
        s, s2, e, e2 = *rows[low][:2], *rows[high][2:4]
        equal, columns = (sum(r[c] for r in rows[low : high + 1]) for c in (4, 5))
        more, same = _extended(x[e:to_a], y[e2:to_b])
        less, same2 = _extended(x[from_a:s][::-1], y[from_b:s2][::-1])
        for right, left, agree in ((more, less, same + same2), (more, 0, same), (0, less, same2), (0, 0, 0)):
            share = (equal + agree) / (columns + right + left)
            if share >= identity:
                break
        return s - left, e + right, s2 - left, e2 + right, share

    found = [part(0, len(rows) - 1, 0, 0, len(x), len(y))]
    if found[0][4] < identity:
        chosen, todo = [], [(0, len(rows) - 1)]
        while todo:
            low, high = todo.pop()
            if low <= high:
                s, t = _longest(rows, low, high, identity)
                chosen.append((s, t))
                todo += [(low, s - 2), (t + 2, high)]
        chosen.sort()
        found, from_a, from_b = [], 0, 0
        for n, (s, t) in enumerate(chosen):
            to_a, to_b = rows[chosen[n + 1][0]][:2] if n + 1 < len(chosen) else (len(x), len(y))
            found.append(part(s, t, from_a, from_b, to_a, to_b))
            if min(found[-1][1] - found[-1][0], found[-1][3] - found[-1][2]) >= least:
                from_a, from_b = found[-1][1], found[-1][3]
            else:
                from_a, from_b = rows[t][2], rows[t][3]
    return [
        (s + x0, e + x0, s2 + y0, e2 + y0, share) for s, e, s2, e2, share in found
        if min(e - s, e2 - s2) >= least and share >= identity
    ]


def _aligning(k: int, least: int, identity: float):
    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for a, b, i, j, x, y, x0, y0 in zip(*(frame[c] for c in ("a", "b", "i", "j", "x", "y", "x0", "y0"))):
                for s, e, s2, e2, share in align(i.tolist(), j.tolist(), x, y, x0, y0, k, least, identity):
                    out.append((a, s, e, b, s2, e2, share))
            yield pd.DataFrame(out, columns=[f.name for f in PASSAGES.fields])

    return run


CHAINS = "a bigint, b bigint, i array<int>, j array<int>"
PASSAGES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("origin_id", T.LongType()), T.StructField("origin_start", T.IntegerType()),
    T.StructField("origin_end", T.IntegerType()), T.StructField("identity", T.DoubleType()),
])


def _words_of(bitmap):
    """Word hashes, cut to 32 bits, of the documents whose slot is in the filter."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            slots = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(hit(bitmap.value, slots)))
            if not batch.num_rows:
                continue
            for part, texts in chunks(batch.column(1)):
                found = tokenize(texts)
                words = (found.hashes >> _U(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), pa.array(words)),
                    ],
                    names=["doc_id", "ws"],
                )

    return run


def _regions(k: int, spread: int, width: int):
    """Per document: where windows of ``width`` words may start that lie in several places, and the words reported already.

    Every ``spread`` k-mers of such a window have their seed in several places too.
    """

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for doc, places, spans in zip(frame["doc_id"], frame["places"], frame["spans"]):
                at = np.sort(np.asarray(places, np.int64))
                cut = np.flatnonzero(np.diff(at) > spread) + 1
                low = at[np.concatenate(([0], cut))] - spread + 1
                high = at[np.concatenate((cut - 1, [len(at) - 1]))] + spread - 1 - (width - k)
                low = np.maximum(low, 0)
                some = low <= high
                if some.any():
                    spans = [] if spans is None else [(x["start"], x["end"]) for x in spans]
                    out.append((doc, low[some], high[some], [x for x, _ in spans], [x for _, x in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "low", "high", "start", "end"])

    return run


def _windows_of(width: int):
    """Hashes of the windows that the regions ask for; open are those with a word not reported yet."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            low, high, start, end = (batch.column(c) for c in ("low", "high", "start", "end"))
            for part, texts in chunks(batch.column("text")):
                found = tokenize(texts)
                ids, ats, keys, backs, opens = [], [], [], [], []
                for n, t in enumerate(range(part.start, part.stop)):
                    words = found.hashes[found.first[n] : found.first[n + 1]]
                    key = window_hashes(words, width)
                    wanted = np.zeros(len(key) + 1, np.int32)
                    for x, y in zip(low[t].as_py(), high[t].as_py()):
                        wanted[min(x, len(key))] += 1
                        wanted[min(y + 1, len(key))] -= 1
                    at = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                    if not len(at):
                        continue
                    covered = np.zeros(len(words) + 1, np.int32)
                    for x, y in zip(start[t].as_py(), end[t].as_py()):
                        covered[min(x, len(words))] += 1
                        covered[min(y, len(words))] -= 1
                    bare = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] <= 0)))
                    _, first, which = np.unique(key[at], return_index=True, return_inverse=True)
                    ids.append(np.full(len(at), batch.column("doc_id")[t].as_py()))
                    ats.append(at)
                    keys.append(key[at])
                    backs.append(at - at[first[which]])
                    opens.append(bare[at + width] > bare[at])
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64)),
                            pa.array(np.concatenate(ats).astype(np.int32)), pa.array(np.concatenate(backs).astype(np.int32)),
                            pa.array(np.concatenate(opens)),
                        ],
                        names=["doc_id", "key", "pos", "back", "open"],
                    )

    return run


def _running(k: int, width: int):
    """Per document: its matching windows as chains of k-mers, one for every run of windows that go on together."""

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for a, b, i, j in zip(frame["a"], frame["b"], frame["i"], frame["j"]):
                order = np.lexsort((i, i - j, b))
                b, i, j = b[order], i[order], j[order]
                new = np.flatnonzero((np.diff(b) != 0) | (np.diff(i) != 1) | (np.diff(j) != 1)) + 1
                for x, y in zip([0, *new], [*new - 1, len(i) - 1]):
                    last = int(i[y]) + width - k
                    path = np.array([*range(int(i[x]), last, k), last])
                    out.append((a, int(b[x]), path, path - int(i[x]) + int(j[x])))
            yield pd.DataFrame(out, columns=["a", "b", "i", "j"])

    return run


def _missed(texts: DataFrame, seeds: DataFrame, many: DataFrame, found: DataFrame, k: int, spread: int, least: int) -> DataFrame:
    """Chains for every exact passage of which a word is not reported yet, with the first document that holds it.

    Each window of ``least`` words meets the first place that has the same words, whatever
    else holds its seeds. ``many`` are the keys with more than one place.
    """
    width = max(least, k + spread - 1)
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    places = seeds.join(many, "key").groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    regions = kept_table(places.join(spans, "doc_id", "left").mapInPandas(
        _regions(k, spread, width), "doc_id bigint, low array<bigint>, high array<bigint>, start array<int>, end array<int>"
    ), "regions")
    some, _ = join_some(texts, regions.select("doc_id"), "doc_id", lambda few: few.join(regions, "doc_id"))
    windows = kept_table(
        some.mapInArrow(_windows_of(width), "doc_id bigint, key bigint, pos int, back int, open boolean"), "windows"
    )
    first = windows.filter("back = 0").groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    own = F.col("doc_id") == F.col("first.doc_id")
    links = windows.filter("open").join(first, "key").filter(~own | (F.col("back") > 0)).select(
        F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b"), F.col("pos").alias("i"),
        F.when(own, F.col("pos") - F.col("back")).otherwise(F.col("first.pos")).alias("j"),
    )
    lists = links.groupBy("a").agg(F.collect_set(F.struct("b", "i", "j")).alias("m")).select(
        "a", F.col("m.b").alias("b"), F.col("m.i").alias("i"), F.col("m.j").alias("j")
    )
    return kept_table(lists.mapInPandas(_running(k, width), CHAINS), "chains")


#: Rows that a Python task gathers before it hands them on.
ROWS_AT_A_TIME = 100_000


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator:
    """Frames of about ROWS_AT_A_TIME rows from tuples of columns of equal length."""
    import pandas as pd

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= ROWS_AT_A_TIME:
            yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*held))})
            held, size = [], 0
    if held:
        yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*held))})


def _free_seeds(k: int):
    """The seeds of a document one by one; free are those with a word not reported yet, late those of which an earlier document holds the key."""

    def parts(frames) -> Iterator:
        for frame in frames:
            for doc, pos, keys, los, spans in zip(*(frame[c] for c in ("doc_id", "pos", "keys", "los", "spans"))):
                at = np.asarray(pos, np.int64)
                covered = np.zeros(int(at.max()) + k + 1, np.int32)
                for x in [] if spans is None else spans:
                    covered[min(x["start"], len(covered) - 1)] += 1
                    covered[min(x["end"], len(covered) - 1)] -= 1
                bare = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] <= 0)))
                yield np.full(len(at), doc), np.asarray(keys), at.astype(np.int32), bare[at + k] > bare[at], np.asarray(los) < doc

    return lambda frames: _gathered(parts(frames), ["doc_id", "key", "pos", "free", "late"])


def _close_seeds(k: int):
    """Per document: pairs of its seeds that may follow each other at the start of a chain, one of them live; open are those with a word not reported yet."""
    limit = k / GAP_COST

    def parts(frames) -> Iterator:
        for frame in frames:
            for doc, pos, keys, free, live in zip(*(frame[c] for c in ("doc_id", "pos", "keys", "free", "live"))):
                order = np.argsort(pos, kind="stable")
                at, key = np.asarray(pos, np.int64)[order], np.asarray(keys, np.int64)[order]
                free, live = np.asarray(free, bool)[order], np.asarray(live, bool)[order]
                for step in range(1, len(at)):
                    gap = at[step:] - at[:-step]
                    close = gap + 1 < limit
                    if not close.any():
                        break
                    near = np.flatnonzero(close & (live[step:] | live[:-step]))
                    yield (
                        np.full(len(near), doc), key[near], key[near + step], at[near].astype(np.int32),
                        gap[near].astype(np.int32), free[near] | free[near + step],
                    )

    return lambda frames: _gathered(parts(frames), ["doc_id", "k1", "k2", "pos", "gap", "open"])


def _around(k: int):
    """The words of a pair of seeds with what lies between them, and up to MARGIN words before and after."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 3 + [pa.bool_()] + [pa.list_(pa.int32())] * 3
        for batch in batches:
            pairs = batch.column("m")
            for part, texts in chunks(batch.column("text")):
                found = tokenize(texts)
                words = (found.hashes >> _U(32)).astype(np.uint32).view(np.int32)
                for n, t in enumerate(range(part.start, part.stop)):
                    rows = []
                    doc, own = batch.column("doc_id")[t].as_py(), words[found.first[n] : found.first[n + 1]]
                    for x in pairs[t].as_py():
                        i, e = x["pos"], x["pos"] + x["gap"] + k
                        rows.append({
                            "doc_id": doc, "k1": x["k1"], "k2": x["k2"], "open": x["open"], "core": own[i:e],
                            "before": own[max(i - MARGIN, 0) : i], "after": own[e : e + MARGIN],
                        })
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[c] for r in rows], kind) for c, kind in zip(rows[0], types)], names=list(rows[0])
                        )

    return run


def _marks(k: int):
    """What two places of a pair of seeds have in common where they agree again before or after the seeds.

    Equal marks with different ``other`` are equal words behind a word that differs: three at
    the same distance, or ``k`` at any that a chain can skip. An extension without gaps has
    the first (it gains by one word and loses by two), a further match of a chain the second.
    """
    reach = int(np.ceil(k / GAP_COST)) - 2 * k

    def parts(frames) -> Iterator:
        for frame in frames:
            for doc, k1, k2, mine, before, after in zip(*(frame[c] for c in ("doc_id", "k1", "k2", "mine", "before", "after"))):
                pair = join_hash(np.array([k1], np.int64).view(_U), np.array([k2], np.int64).view(_U))
                for side, words in enumerate((np.asarray(before)[::-1], np.asarray(after))):
                    hashes = words.astype(np.int32).view(np.uint32).astype(_U)
                    three, many = window_hashes(hashes, 3)[1:], window_hashes(hashes[: reach + k], k)
                    at = np.arange(1, len(three) + 1)
                    many, first = np.unique(many, return_index=True)
                    before_it = np.concatenate(([0], words))[first]  # beside the seeds the same for all
                    marks = np.concatenate((join_hash(three, at.astype(_U) * _U(4) + _U(side)), join_hash(many, np.full(len(many), 2 + side, _U))))
                    others = np.concatenate((words[: len(three)], before_it)).astype(np.int32)
                    yield join_hash(marks, np.full(len(marks), pair[0], _U)).view(np.int64), others, np.full(len(marks), doc), np.full(len(marks), mine)

    return lambda frames: _gathered(parts(frames), ["mark", "other", "doc_id", "mine"])


def _lacking(least: int, identity: float):
    """Equal words that two different stretches between the same seeds need around them to be a passage."""

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for k1, k2, c1, c2, x, y in zip(*(frame[c] for c in ("k1", "k2", "c1", "c2", "core", "core2"))):
                columns = max(len(x), len(y))
                total = int(np.ceil((columns - _agreeing(np.asarray(x), np.asarray(y))) / (1 - identity) - 1e-9))
                more = max(least, total) - columns
                if more <= MARGIN:
                    out.append((k1, k2, c1, c2, max(more, 0)))
            yield pd.DataFrame(out, columns=["k1", "k2", "c1", "c2", "more"])

    return run


#: Places of a pair of seeds up to which all of them meet.
FEW = 64


def _promising(texts: DataFrame, pairs: DataFrame, k: int, least: int, identity: float) -> DataFrame:
    """(a, b) of the documents that can share an edited passage around a pair of seeds that many places have.

    A place with the same words around it as an earlier one is left to that. With the same
    words between the seeds (an exact passage is known already) a passage has to go on behind
    words that differ, see ``_marks``. With other words between them it does that too, or the
    words beside the seeds are equal far enough; then the first such place is met.
    """
    lists = pairs.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2", "pos", "gap", "open")).alias("m"))
    some, _ = join_some(texts, lists.select("doc_id"), "doc_id", lambda few: few.join(lists, "doc_id"))
    around = kept_table(some.mapInArrow(
        _around(k), "doc_id bigint, k1 bigint, k2 bigint, open boolean, core array<int>, before array<int>, after array<int>"
    ), "surroundings").withColumn("c", F.xxhash64("core"))
    same = ["k1", "k2", "c", "core", "before", "after"]
    mine = around.filter("open").select(*same, "doc_id").distinct().withColumn("mine", F.lit(True))
    theirs = around.groupBy(*same).agg(F.min("doc_id").alias("doc_id")).withColumn("mine", F.lit(False))

    marks = kept_table(mine.unionByName(theirs).select("doc_id", "k1", "k2", "mine", "before", "after").mapInPandas(
        _marks(k), "mark bigint, other int, doc_id bigint, mine boolean"
    ), "marks")
    later = marks.filter("mine").select("mark", F.col("other").alias("x"), F.col("doc_id").alias("a")).distinct()
    asked = later.groupBy("mark").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max("a").alias("last"))
    earlier = marks.filter("not mine").join(asked, "mark").filter("doc_id < last and (other <> low or other <> high)")
    earlier = kept_table(earlier.select("mark", F.col("other").alias("y"), F.col("doc_id").alias("b")).distinct(), "shared-marks")
    going_on = later.join(earlier, "mark").filter("x <> y and a > b").select("a", "b")

    cores = around.groupBy("k1", "k2", "c", "core").agg(
        F.max(F.when(F.col("open"), F.col("doc_id"))).alias("hi"), F.min("doc_id").alias("lo")
    )
    one = cores.filter("hi is not null").select("k1", "k2", F.col("c").alias("c1"), "core", "hi")
    two = cores.select("k1", "k2", F.col("c").alias("c2"), F.col("core").alias("core2"), "lo")
    gaps = F.size("core") + F.size("core2") - 2 * k
    need = kept_table(one.join(two, ["k1", "k2"]).filter((F.col("c1") != F.col("c2")) & (F.col("hi") > F.col("lo")) & (gaps < k / GAP_COST)).mapInPandas(
        _lacking(least, identity), "k1 bigint, k2 bigint, c1 bigint, c2 bigint, more int"
    ), "lacking")
    key = ["k1", "k2", "c1", "c2", "left", "beside"]

    def beside(places: DataFrame, c: str) -> DataFrame:
        cut = places.withColumnRenamed("c", c).join(need, ["k1", "k2", c]).withColumn("left", F.explode(F.sequence(F.lit(0), "more")))
        right = F.col("more") - F.col("left")
        cut = cut.filter((F.size("before") >= F.col("left")) & (F.size("after") >= right))
        begin = F.size("before") - F.col("left") + 1
        return cut.withColumn("beside", F.xxhash64(F.slice("before", begin, F.col("left")), F.slice("after", F.lit(1), right)))

    first = beside(theirs, "c2").groupBy(*key).agg(F.min("doc_id").alias("b"))
    equal = beside(mine, "c1").select(*key, F.col("doc_id").alias("a")).join(first, key).filter("a > b").select("a", "b")
    return going_on.unionByName(equal).distinct()


def _between(texts: DataFrame, hits: DataFrame, found: DataFrame, k: int, spread: int, least: int, identity: float) -> DataFrame:
    """Chains of what is not reported yet with every earlier document that can share an edited passage there.

    Keys of two documents are left out: these have met already.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    places = hits.filter("lead and docs > 2").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "key", "lo")).alias("m"))
    listed = places.join(spans, "doc_id", "left").select(
        "doc_id", F.col("m.pos").alias("pos"), F.col("m.key").alias("keys"), F.col("m.lo").alias("los"), "spans"
    )
    seeds = kept_table(listed.mapInPandas(_free_seeds(k), "doc_id bigint, key bigint, pos int, free boolean, late boolean"), "free-seeds")
    live = seeds.filter("free and late").select("key").distinct().withColumn("live", F.lit(True))
    marked = seeds.join(live, "key", "left").select("doc_id", "pos", "key", "free", F.coalesce("live", F.lit(False)).alias("live"))
    again = marked.groupBy("doc_id").agg(F.max("live").alias("some"), F.collect_set(F.struct("pos", "key", "free", "live")).alias("m")).filter("some")
    again = again.select("doc_id", F.col("m.pos").alias("pos"), F.col("m.key").alias("keys"), F.col("m.free").alias("free"), F.col("m.live").alias("live"))
    close = kept_table(
        again.mapInPandas(_close_seeds(k), "doc_id bigint, k1 bigint, k2 bigint, pos int, gap int, open boolean"), "close-seeds"
    )
    ends = close.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("lo"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("hi"), F.count(F.lit(1)).alias("n")
    ).filter("hi > lo")
    pairs = kept_table(close.join(ends, ["k1", "k2"]).filter("doc_id < hi or (open and doc_id > lo)"), "pairs")

    def sides(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        mine = some.filter("open").select(F.col("doc_id").alias("a"), "k1", "k2", F.col("pos").alias("i"), F.col("gap").alias("di"))
        return mine, some.select(F.col("doc_id").alias("b"), "k1", "k2", F.col("pos").alias("j"), F.col("gap").alias("dj"))

    near = (F.col("a") > F.col("b")) & (F.col("di") + F.col("dj") < k / GAP_COST)
    mine, theirs = sides(pairs.filter(F.col("n") <= FEW))
    met = kept_table(mine.join(theirs, ["k1", "k2"]).filter(near).select("a", "b", "i", "di", "j", "dj"), "met")
    many = pairs.filter(F.col("n") > FEW)
    if many.take(1):
        docs = met.select("a", "b").unionByName(_promising(texts, many, k, least, identity)).distinct()
        mine, theirs = sides(many)
        more = docs.join(mine, "a").join(theirs, ["b", "k1", "k2"]).filter(near)
        met = met.unionByName(more.select("a", "b", "i", "di", "j", "dj"))
    second = F.struct((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    matches = met.select("a", "b", F.explode(F.array(F.struct("i", "j"), second)).alias("m"))
    lists = matches.groupBy("a", "b").agg(F.collect_set("m").alias("m")).select(
        "a", "b", F.col("m.i").alias("i"), F.col("m.j").alias("j")
    )
    return kept_table(lists.mapInPandas(_chaining(k, spread), CHAINS), "chains")


#: Keys of the further texts of repeated ids begin here.
FURTHER = 1 << 62


def _versions(texts: DataFrame) -> DataFrame | None:
    """(doc_id, version, key) of the texts of ids that have several; None where no id has."""
    twice = kept_table(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    if not twice.take(1):
        return None
    few, _ = join_some(texts, twice, "doc_id", lambda some: some.join(twice, "doc_id", "left_semi"))
    kinds = few.select("doc_id", F.xxhash64("text").alias("version")).distinct()
    least = kinds.groupBy("doc_id").agg(F.min("version").alias("least"), F.count(F.lit(1)).alias("n"))
    several = kinds.join(least.filter("n > 1"), "doc_id")
    key = F.when(F.col("version") == F.col("least"), F.col("doc_id")).otherwise(F.lit(FURTHER) + F.monotonically_increasing_id())
    return kept_table(several.select("doc_id", "version", key.alias("key")), "versions")


def _by_version(texts: DataFrame, versions: DataFrame) -> DataFrame:
    """The texts with one row for each document, under the key of its version."""

    def keyed(some: DataFrame) -> DataFrame:
        with_key = some.withColumn("version", F.xxhash64("text")).join(versions, ["doc_id", "version"], "left")
        return with_key.select(F.coalesce("key", "doc_id").alias("doc_id"), "text", F.col("key").isNotNull().alias("known"))

    some, rest = join_some(texts, versions, "doc_id", keyed)
    once = some.filter("known").dropDuplicates(["doc_id"])
    return once.unionByName(some.filter("not known")).drop("known").unionByName(rest)


def _with_ids(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Passages of keyed documents under their ids, with the version of the later document."""
    names = versions.select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), F.col("version").alias("version"))
    later = found.join(names, found["doc_id"] == names["__key"], "left")
    later = later.withColumn("doc_id", F.coalesce("__id", "doc_id")).drop("__key", "__id")
    origins = names.select(F.col("__key").alias("__key2"), F.col("__id").alias("__id2"))
    both = later.join(origins, F.col("origin_id") == F.col("__key2"), "left")
    return both.withColumn("origin_id", F.coalesce("__id2", "origin_id")).drop("__key2", "__id2")


def passages(
    docs: DataFrame, k: int = K, spread: int = SPREAD, least: int = LEAST, identity: float = IDENTITY, text: str = "text",
) -> DataFrame:
    """Passages that a document shares with an earlier one (by id), as word ranges."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    versions = _versions(texts)
    if versions is None:
        return _passages(texts, k, spread, least, identity).withColumn("version", F.lit(None).cast("long"))
    return _with_ids(_passages(_by_version(texts, versions), k, spread, least, identity), versions)


def _passages(texts: DataFrame, k: int, spread: int, least: int, identity: float) -> DataFrame:
    """Passages of documents that have an id each."""
    seeds = kept_table(
        texts.mapInArrow(_seeding(k, spread), "doc_id bigint, key bigint, pos int, back int, lead boolean"), "seeds"
    )
    ends = kept_table(seeds.groupBy("key").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("back") == 0).alias("docs"),
    ).filter("n > 1"), "ends")
    hits = kept_table(seeds.join(ends.filter("lo <> hi").drop("n"), "key"), "hits")
    # every place in the later document against the first place in the earlier one; the last
    # document meets the others with its first places only, all of its places meet the first document
    mine = hits.filter("lead").withColumn("mate", F.explode(F.array_distinct(F.array("lo", "hi")))).filter(
        "mate <> doc_id and (mate = lo or back = 0)"
    )
    theirs = hits.filter("back = 0 and (doc_id = lo or doc_id = hi)").select(
        "key", F.col("doc_id").alias("mate"), F.col("pos").alias("mate_pos")
    )
    later = F.col("doc_id") > F.col("mate")
    matches = mine.join(theirs, ["key", "mate"]).select(
        F.greatest("doc_id", "mate").alias("a"), F.least("doc_id", "mate").alias("b"),
        F.when(later, F.col("pos")).otherwise(F.col("mate_pos")).alias("i"),
        F.when(later, F.col("mate_pos")).otherwise(F.col("pos")).alias("j"),
    )
    matches = matches.unionByName(seeds.filter("lead and back > 0").select(
        F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("pos").alias("i"), (F.col("pos") - F.col("back")).alias("j")
    ))
    # one list per pair of documents, no longer than the seeds of a text
    pairs = matches.groupBy("a", "b").agg(F.collect_set(F.struct("i", "j")).alias("m")).filter(F.size("m") > 1).select(
        "a", "b", F.col("m.i").alias("i"), F.col("m.j").alias("j")
    )
    chains = kept_table(pairs.mapInPandas(_chaining(k, spread), CHAINS), "chains")

    found = kept_table(_aligned(texts, chains, k, least, identity), "passages")
    rest = _missed(texts, seeds, ends.select("key"), found, k, spread, least)
    found = kept_table(found.unionByName(_aligned(texts, rest, k, least, identity)), "passages")
    return found.unionByName(_aligned(texts, _between(texts, hits, found, k, spread, least, identity), k, least, identity))


def _aligned(texts: DataFrame, chains: DataFrame, k: int, least: int, identity: float) -> DataFrame:
    """The passages of chains, whose words are fetched from both documents."""
    spark = texts.sparkSession
    ids = chains.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bitmap = spark.sparkContext.broadcast(bitmap_of(ids, "doc_id"))
    slotted = texts.withColumn("slot", slot_of("doc_id"))
    words = slotted.mapInArrow(_words_of(bitmap), "doc_id bigint, ws array<int>")

    def near(at: str, name: str, begin: str):
        start = F.greatest(F.element_at(at, 1) - MARGIN, F.lit(0))
        stop = F.element_at(at, -1) + k + MARGIN
        return {name: F.slice("ws", start + 1, stop - start), begin: start}

    around = chains.join(words.withColumnRenamed("doc_id", "a"), "a").withColumns(near("i", "x", "x0"))
    same = around.filter("a = b").withColumns(near("j", "y", "y0")).drop("ws")
    around = around.filter("a <> b").drop("ws")
    around = around.join(words.withColumnRenamed("doc_id", "b"), "b").withColumns(near("j", "y", "y0")).drop("ws")
    return around.unionByName(same).mapInPandas(_aligning(k, least, identity), PASSAGES)


def _cutting(columns: list[str], text: str):
    """Takes the given word ranges out of the texts."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for whole, spans in zip(batch.column(text).to_pylist(), batch.column("__cut").to_pylist()):
                if not spans:
                    out.append(whole)
                    continue
                raw = whole.encode()
                found = tokenize([raw.lower()])
                covered = np.zeros(len(found.starts) + 1, np.int32)
                for s in spans:
                    covered[min(s["start"], len(covered) - 1)] += 1
                    covered[min(s["end"], len(covered) - 1)] -= 1
                keep = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
                parts: list[bytes] = []
                for run_ in np.split(keep, np.flatnonzero(np.diff(keep) != 1) + 1):
                    if len(run_):
                        parts.append(raw[found.starts[run_[0]] : found.ends[run_[-1]]])
                out.append(b"\n".join(parts).decode())
            arrays = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def without_repeats(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every later copy of a passage cut out; the first copy stays."""
    spans = kept_table(
        found.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end")).alias("__cut")), "cuts"
    ).withColumnsRenamed({"doc_id": "__id", "version": "__version"})

    def cut(few: DataFrame) -> DataFrame:
        same = spans["__version"].isNull() | (spans["__version"] == F.xxhash64(few[text]))
        joined = few.join(spans, (few["doc_id"] == spans["__id"]) & same, "left").drop("__id", "__version")
        return joined.mapInArrow(_cutting(docs.columns, text), docs.schema)

    some, rest = join_some(docs, spans.select(F.col("__id").alias("doc_id")), "doc_id", cut)
    return some.unionByName(rest)
