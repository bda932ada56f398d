"""Divergence of sources within a language: priced term counts, compared pair by pair.

1. Whole texts are counted where they lie: a task adds up (language, source, term) before
   anything is shuffled, then one aggregation gives the counts and document frequencies.
2. A language keeps the terms found in enough of its documents. Its vocabulary is cut into
   blocks of bounded size, and the sources of a language into tiles of bounded size.
3. A group's kept terms in one block are a row: its sorted (term id, count) arrays. Groups
   without terms there have an empty row, because every kept term has a price everywhere.
4. A task is two tiles and one block. It co-groups the arrays of both tiles and merges those of
   every unordered pair once: a galloping intersection prices the overlap, the terms of one
   side meet the other's price of no occurrence, and terms that neither has meet both such
   prices. Only one number per pair and block leaves the task.
5. Over-used terms of a group against its language need no pairs: counts are priced in the
   JVM and ranked, and only the first ranks of each task are shuffled.

A term with c occurrences among N in a language of V kept terms has the price
1 + floor(10^9 (c + 5) / (N + 5 V)). It is worked out by long division in base 1000, exact
while N + 5 V stays below 9e15.

Defined results for odd input: null text, language and source count as empty. A text of any
length is counted whole. A group without terms has all its pairs; a language without kept
terms gives pairs of value 0 and no term rows; a language with one source gives no pairs.
Repeated rows are documents of their own. Equal values are ranked by item in byte order. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept_table
from .tokens import _class, chunks, mix, tokenize

#: Bytes inside terms, after A-Z are lower-cased: letters and characters outside ASCII.
LETTERS = _class((0x61, 0x7A), (0x80, 0xFF))
#: Documents that a kept term is found in, and ranks of the term report.
LEAST_DOCUMENTS, TOP = 30, 50
SCALE, EXTRA = 1_000_000_000, 5
#: Expected terms of a vocabulary block and sources of a tile.
BLOCK, TILE = 8192, 16
#: Rows of counts that a task holds before it adds them up and hands on what is left.
HELD = 300_000

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counting(batches) -> Iterator:
    """Counts of (lang, source, term) over a task's documents, and every (lang, source) it saw."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["lang", "source", "term", "n", "docs"]
    types = pa.schema([("g", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    groups: dict[tuple[str, str], int] = {}
    held: list = []
    rows = 0

    def added() -> pa.Table:
        table = pa.Table.from_batches(held, types)
        return table.group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])

    def handed(table: pa.Table) -> Iterator:
        if not groups:
            return
        keys = list(groups)
        langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
        zero = pa.array([0] * len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(keys), pa.string()), zero, zero], names=names)
        for part in table.to_batches(max_chunksize=50_000):
            g = part.column("g")
            yield pa.RecordBatch.from_arrays(
                [pc.take(langs, g), pc.take(sources, g), part.column("term"), part.column("n_sum"), part.column("docs_sum")],
                names=names,
            )

    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        of_row = np.array([groups.setdefault((a or "", b or ""), len(groups)) for a, b in pairs], np.int64)
        for part, texts in chunks(batch.column(2)):
            found = tokenize(texts, LETTERS)
            owner = np.repeat(np.arange(len(texts)), found.counts)
            group = of_row[part][owner]
            keys = mix(found.hashes + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            begins = np.flatnonzero(new)
            if not len(begins):
                continue
            in_new_doc = new | np.append(True, owner[1:] != owner[:-1])
            at = order[begins]
            words = [found.buffer[s:e] for s, e in zip(found.starts[at].tolist(), found.ends[at].tolist())]
            held.append(pa.RecordBatch.from_arrays(
                [
                    pa.array(group[at]), pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(np.diff(np.append(begins, len(keys)))), pa.array(np.add.reduceat(in_new_doc.astype(np.int64), begins)),
                ],
                schema=types,
            ))
            rows += len(begins)
            if rows > HELD:
                table = added()
                if table.num_rows > HELD // 2:
                    yield from handed(table)
                    held, rows = [], 0
                else:
                    table = table.select(["g", "term", "n_sum", "docs_sum"]).rename_columns(types.names)
                    held, rows = table.to_batches(), table.num_rows
    yield from handed(added())


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) of all documents; a row with a null term names each group."""
    columns = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return columns.mapInArrow(_counting, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def price_column(counts: str, total: str) -> Column:
    """Price of a count, where ``total`` is N + 5 V; both columns are bigints."""
    digits = [f"({counts} + {EXTRA}) div {total}"]
    rest = f"(({counts} + {EXTRA}) % {total})"
    for _ in range(3):
        digits.append(f"({rest} * 1000) div {total}")
        rest = f"(({rest} * 1000) % {total})"
    return F.expr("1" + "".join(f" + ({d}) * {1000 ** (3 - i)}" for i, d in enumerate(digits)))


def prices(counts: np.ndarray, total: int) -> np.ndarray:
    """The same for an array of counts."""
    if not total:
        return np.ones(len(counts), np.int64)
    whole, rest = np.divmod(counts.astype(np.int64) + EXTRA, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def gallop(few: np.ndarray, many: np.ndarray, run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal ids in two sorted arrays.

    A run of the shorter array at a time: doubling steps find how far the longer array has to
    be looked at, binary search does the rest there, and the next run starts behind it.
    """
    left, right, cursor = [], [], 0
    for begin in range(0, len(few), run):
        part = few[begin : begin + run]
        step, end = run, cursor
        while end < len(many) and many[end] <= part[-1]:
            end += step
            step *= 2
        window = many[cursor : end + 1]
        at = np.searchsorted(window, part)
        same = np.flatnonzero(window[np.minimum(at, len(window) - 1)] == part) if len(window) else at[:0]
        left.append(begin + same)
        right.append(cursor + at[same])
        cursor += int(at[-1])
        if cursor >= len(many):
            break
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _merging(key, left, right):
    """Values of all unordered pairs of two tiles in one block of terms."""
    import pyarrow as pa

    def described(table) -> list:
        table = table.combine_chunks()
        arrays = []
        for column in ("ids", "counts"):
            lists = table.column(column).combine_chunks()
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            arrays.append([values[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
        rows = []
        for source, total, ids, counts in zip(table.column("source").to_pylist(), table.column("total").to_pylist(), *arrays):
            p, none = prices(counts, total), int(prices(np.zeros(1, np.int64), total)[0])
            rows.append((source, ids, p, none, int(np.abs(p - none).sum())))
        return rows

    lang, block, t, u = [k.as_py() for k in key]
    size = left.column("block_terms")[0].as_py() if left.num_rows else 0
    mine, other = described(left), described(right)
    found = []
    for a, ids_a, p_a, none_a, _ in mine:
        for b, ids_b, p_b, none_b, _ in other:
            if t == u and a >= b:
                continue
            if len(ids_a) <= len(ids_b):
                i, j = gallop(ids_a, ids_b)
            else:
                j, i = gallop(ids_b, ids_a)
            both = int(np.abs(p_a[i] - p_b[j]).sum())
            only_a = int(np.abs(p_a - none_b).sum() - np.abs(p_a[i] - none_b).sum())
            only_b = int(np.abs(p_b - none_a).sum() - np.abs(p_b[j] - none_a).sum())
            neither = size - len(ids_a) - len(ids_b) + len(i)
            found.append((a, b, both + only_a + only_b + neither * abs(none_a - none_b)))
    a, b, values = zip(*found) if found else ((), (), ())
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
        "value": pa.array(values, pa.int64()),
    })


def pair_values(groups: DataFrame, slices: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of a language's groups, a < b or by tile.

    ``groups``: lang, source, total, n_blocks, n_tiles; ``slices``: lang, source, block, ids,
    counts; ``blocks``: lang, block, block_terms.
    """
    empty = F.array().cast("array<bigint>")
    every = (
        groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .join(blocks, ["lang", "block"], "left").join(slices, ["lang", "source", "block"], "left")
        .select(
            "lang", "block", "source", "total", "n_tiles", F.coalesce("block_terms", F.lit(0)).alias("block_terms"),
            F.pmod(F.xxhash64("source"), "n_tiles").cast("int").alias("tile"),
            F.coalesce("ids", empty).alias("ids"), F.coalesce("counts", empty).alias("counts"),
        )
    )
    every = kept_table(every, "slices")
    left = every.withColumn("u", F.explode(F.sequence(F.col("tile"), (F.col("n_tiles") - 1).cast("int")))).withColumnRenamed("tile", "t")
    right = every.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "u")
    keys = ["lang", "block", "t", "u"]
    merged = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_merging, "lang string, a string, b string, value bigint")
    return merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS,
    top: int = TOP, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a group with each other
    one of its language, part ``term`` lists the terms it uses more than its language does."""
    counts = kept_table(term_counts(docs, lang, source, text), "term-counts")
    terms = counts.filter("term is not null")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    vocabulary = kept_table(vocabulary.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id")), "vocabulary")
    named = counts.select("lang", "source").distinct()
    sizes = (
        named.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
        .join(vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
        .select(
            "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / block)).cast("int").alias("n_blocks"),
            F.ceil(F.col("n_groups") / tile).cast("int").alias("n_tiles"),
        )
    )
    sizes = kept_table(sizes, "languages")
    kept = terms.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]).join(sizes.select("lang", "n_blocks"), "lang")
    kept = kept_table(
        kept.select("lang", "source", "term", "n", "lang_n", "id", F.pmod(F.xxhash64("term"), "n_blocks").cast("int").alias("block")),
        "kept-terms",
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = kept_table(
        named.join(sizes, "lang").join(totals, ["lang", "source"], "left")
        .withColumn("total", F.coalesce("n", F.lit(0)) + EXTRA * F.col("v")).drop("n"),
        "groups",
    )
    cells = F.array_sort(F.collect_list(F.struct("id", "n")))
    slices = kept.groupBy("lang", "source", "block").agg(cells.alias("cells")).select(
        "lang", "source", "block", F.col("cells.id").alias("ids"), F.col("cells.n").alias("counts")
    )
    blocks = vocabulary.join(sizes.select("lang", "n_blocks"), "lang").groupBy(
        "lang", F.pmod(F.xxhash64("term"), "n_blocks").cast("int").alias("block")
    ).agg(F.count(F.lit(1)).alias("block_terms"))
    once = kept_table(pair_values(groups.select("lang", "source", "total", "n_blocks", "n_tiles"), slices, blocks), "pairs")
    pairs = once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        once.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    priced = (
        kept.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
        .withColumn("whole", F.col("lang_total") + EXTRA * F.col("v"))
        .withColumns({"p": price_column("n", "total"), "q": price_column("lang_n", "whole")})
        .filter("p > q")
    )
    over = priced.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(over, "term", top))
