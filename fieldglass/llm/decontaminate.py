"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of ``window`` consecutive words of every benchmark item; an
item of fewer words is one test string. Strings of one length share a search: a shift
table over blocks of two words tells how far the search may jump, a block with shift zero
leads to the bucket of the test strings that end in it, and comparing the words themselves
confirms an occurrence.

The benchmark is read in blocks of bounded size and every block meets all documents in one
more pass over them; documents are never shuffled, grouped or sent to the driver.

Defined results for odd input: null or empty texts have no words and no hits, null item ids
are written as an empty string, items without words are ignored, repeated items count once
by id, repeated documents are marked one by one, an empty benchmark marks nothing. Columns
of the input with the names of the result are replaced by it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import shielded
from .tokens import ALPHANUMERIC, chunks, join_hash, tokenize

WINDOW = 10
#: Bytes of benchmark text whose tables are sent to every executor at once.
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPANS),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]


@dataclass
class Search:
    """Tables for test strings of ``length`` words."""

    length: int
    shifts: np.ndarray
    buckets: dict[int, dict[bytes, tuple[str, ...]]]

    @property
    def block(self) -> int:
        return min(2, self.length)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each word; the first of a pair has no meaning."""
    if size == 1:
        return hashes
    out = np.zeros_like(hashes)
    out[1:] = join_hash(hashes[:-1], hashes[1:])
    return out


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Search]:
    """Search tables of some benchmark items, one search per string length."""
    texts = [(text or "").encode().lower() for _, text in items]
    found = tokenize(texts, ALPHANUMERIC)
    owners: dict[int, dict[tuple[bytes, int], set[str]]] = defaultdict(lambda: defaultdict(set))
    ends_at: dict[int, set[int]] = defaultdict(set)
    for t, (name, _) in enumerate(items):
        a, b = int(found.first[t]), int(found.first[t + 1])
        length = min(window, b - a)
        for i in range(a, b - length + 1) if length else ():
            owners[length][b" ".join(found.words(i, i + length)), i + length - 1].add(name)
            ends_at[length].add(i + length - 1)
    searches = []
    for length, strings in sorted(owners.items()):
        block = min(2, length)
        keys = _blocks(found.hashes, block)
        size = 1 << max(12, (16 * len(ends_at[length])).bit_length())
        shifts = np.full(size, length - block + 1, np.uint8 if length < 250 else np.int32)
        last = np.fromiter(sorted(ends_at[length]), np.int64)
        for back in range(length - block + 1):
            np.minimum.at(shifts, (keys[last - back] & np.uint64(size - 1)).astype(np.int64), back)
        buckets: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for (string, end), names in strings.items():
            buckets[int(keys[end])][string] |= names
        searches.append(
            Search(length, shifts, {k: {s: tuple(sorted(n)) for s, n in v.items()} for k, v in buckets.items()})
        )
    return searches


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": s, "end": e} for s, e in out]


def _scan(column, searches: list[Search]):
    """Per text: number of words, spans of occurrences and their items."""
    for _, texts in chunks(column):
        found = tokenize(texts, ALPHANUMERIC)
        bounds = found.first.tolist()
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        names: dict[int, set[str]] = defaultdict(set)
        for search in searches:
            keys = _blocks(found.hashes, search.block)
            shifts = search.shifts[(keys & np.uint64(len(search.shifts) - 1)).astype(np.int64)].tolist()
            m, buckets = search.length, search.buckets
            for t in range(len(bounds) - 1):
                a, b = bounds[t], bounds[t + 1]
                i = a + m - 1
                while i < b:
                    jump = shifts[i]
                    if jump:
                        i += jump
                        continue
                    bucket = buckets.get(int(keys[i]))
                    if bucket:
                        items = bucket.get(b" ".join(found.words(i - m + 1, i + 1)))
                        if items:
                            spans[t].append((i - m + 1 - a, i + 1 - a))
                            names[t].update(items)
                    i += 1
        for t, n in enumerate(found.counts.tolist()):
            yield n, spans.get(t, ()), names.get(t, ())


def _pass(searches, first: bool, columns: list[str], text: str):
    """Task that adds the occurrences of one block of the benchmark to every row."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = [
            pa.int64(),
            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
            pa.list_(pa.string()),
        ]
        for batch in batches:
            n_words, spans, names = [], [], []
            old = [()] * batch.num_rows if first else list(
                zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist())
            )
            for (n, hits, items), before in zip(_scan(batch.column(text), searches.value), old):
                n_words.append(n)
                if before:
                    hits = [*hits, *((s["start"], s["end"]) for s in before[0])]
                    items = {*items, *before[1]}
                spans.append(_merged(hits) if hits else [])
                names.append(sorted(items))
            new = [pa.array(v, k) for v, k in zip((n_words, spans, names), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + new, names=columns + [f.name for f in RESULT]
            )

    return run


def mark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds ``n_words``, merged ``hit_spans`` (word ranges, end exclusive) and sorted ``item_ids``."""
    names = [f.name for f in RESULT]
    out = docs.drop(*names)
    columns = out.columns
    schema = T.StructType([*out.schema.fields, *RESULT])
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    spark = docs.sparkSession
    for k in range(blocks):
        rows = [tuple(r) for r in items.filter(slot == k).collect()]
        tables = spark.sparkContext.broadcast(build(rows, window))
        out = out.mapInArrow(_pass(tables, k == 0, columns, text), schema)
    return out


def summary(marked: DataFrame) -> DataFrame:
    """Counts and digests of marked documents, natively."""
    spans = F.col("hit_spans")
    return marked.select(
        "doc_id", "n_words",
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without any occurrence, with all their columns."""
    aside, back = shielded(docs, [f.name for f in RESULT])
    return back(mark(aside, benchmark, window, text).filter(F.size("hit_spans") == 0))
