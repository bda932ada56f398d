"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Every text becomes the set of hashes of its word shingles and a SuperMinHash signature:
   each element visits the registers in the order of its own random permutation, the j-th
   visit offering a value in [j, j + 1). The values of one element are correlated over the
   registers, which lowers the variance of the estimate, and levels that cannot lower any
   register of a document are never computed.
2. Documents with equal sets are one class, which its smallest id represents; everything
   after works on classes.
3. Signatures are cut into bands. A band's bucket compares its classes with a pivot, not
   with each other: links to the pivot join most of a group of copies at once. A second
   pivot is taken from what is left of each bucket.
4. Buckets that still hold several components compare the classes outside the largest
   component with the rest of the bucket: small buckets as a list of distinct pairs, large
   ones in blocks of bounded size and in the first band that a pair shares, so that only
   links are emitted. Every pair that shares a bucket and whose set sizes allow the similarity
   is compared.
5. Links are confirmed on the full sets; components are found by union-find and star
   contraction.

With 32 bands of 4 registers, two sets of similarity 0.8 share no band with probability
5e-8. Sets are compared by 64-bit hashes of their shingles. What is joined with many rows of
one class or bucket is written first, so that Spark can split such rows among tasks.

Defined results for odd input: a text without words (or null) has an empty set, is linked
with nothing and kept. A row without an id is linked with nothing, its component is null
and it is kept. Rows that repeat an id are one document with all the links of its rows, and
each row gets a result. Ties do not matter: a component is named by its smallest id. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import bitmap_of, hit, join_some, slot_of
from .graph import components, kept_table
from .tokens import Tokens, chunks, join_hash, mix, tokenize

REGISTERS, BAND = 128, 4
PERCENT = 80
#: Classes of a bucket that meet in one task, and classes of a bucket whose pairs are listed.
BLOCK, SMALL = 512, 64

_U = np.uint64


def shingle_sets(found: Tokens, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer words than a shingle make one."""
    keys = found.hashes
    for k in range(1, size):
        longer = np.empty(max(0, len(found.hashes) - k), _U)
        longer[:] = join_hash(keys[: len(longer)], found.hashes[k:])
        keys = longer
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(keys[a : b - size + 1]))
        elif b > a:
            whole = found.hashes[a : a + 1]
            for i in range(a + 1, b):
                whole = join_hash(whole, found.hashes[i : i + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, _U))
    return out


def superminhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Signatures, one row of m registers per set; a register is level * 2^32 + 32 random bits.

    All sets go through the levels together. A set is done when its largest register lies
    below the next level, so a long document needs one or two levels.
    """
    n = len(sets)
    elements = np.concatenate(sets) if n else np.empty(0, _U)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    registers = np.full((n, m), np.iinfo(np.uint64).max, _U)
    flat = registers.reshape(-1)
    order = None
    for level in range(m):
        random = mix(elements + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        low = random & _U(0xFFFFFFFF)
        pick = level + ((random >> _U(32)) * _U(m - level) >> _U(32)).astype(np.int64)
        if level == 0:
            chosen = pick
        else:
            rows = np.arange(len(elements))
            chosen = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, level]
        np.minimum.at(flat, owner * m + chosen, (_U(level) << _U(32)) | low)
        open_sets = registers.max(axis=1) >= _U(level + 1) << _U(32)
        going = open_sets[owner]
        if not going.any():
            break
        elements, owner, pick = elements[going], owner[going], pick[going]
        if level == 0:
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(elements), 1))
            order[np.arange(len(elements)), pick] = 0
        else:
            order = order[going]
    return registers


def band_keys(registers: np.ndarray, rows: int = BAND) -> np.ndarray:
    n, m = registers.shape
    bands = registers.reshape(n, m // rows, rows)
    keys = np.broadcast_to(np.arange(m // rows, dtype=_U), (n, m // rows))
    for k in range(rows):
        keys = join_hash(keys, bands[:, :, k])
    return keys


def _lists(arrays: list[np.ndarray]):
    """Arrow list column of bigint arrays."""
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, _U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(_U).view(np.int64)))


def _signing(shingle: int, m: int, rows: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, texts in chunks(batch.column(1)):
                sets = shingle_sets(tokenize(texts), shingle)
                keys = band_keys(superminhash(sets, m), rows)
                first = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], _U)
                second = np.array([np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], _U)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                        _lists([k if len(s) else k[:0] for k, s in zip(keys, sets)]),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def _sets_of(shingle: int, bitmap):
    """Sets of the documents whose slot is in the filter."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            slots = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(hit(bitmap.value, slots)))
            if not batch.num_rows:
                continue
            for part, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        _lists(shingle_sets(tokenize(texts), shingle)),
                    ],
                    names=["doc_id", "items"],
                )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; all of it stays in the JVM."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumns({"common": common, "all": F.size("x") + F.size("y")})
        .filter(100 * F.col("common") >= percent * (F.col("all") - F.col("common")))
        .select("a", "b")
    )


def _block_links(percent: int):
    """Links between the members of two blocks of one bucket.

    A row is a member: side 0 holds the classes outside the bucket's largest component,
    side 1 all classes of the bucket.
    """

    def run(frame):
        import pandas as pd

        mine, all_ = frame[frame["side"] == 0], frame[frame["side"] == 1]
        other = list(zip(all_["rep"], all_["comp"], all_["n"], all_["bands"], all_["items"]))
        links = []
        for rep, comp, n, bands, items in zip(mine["rep"], mine["comp"], mine["n"], mine["bands"], mine["items"]):
            joined = set()
            for rep2, comp2, n2, bands2, items2 in other:
                if comp2 == comp or comp2 in joined or 100 * min(n, n2) < percent * max(n, n2):
                    continue
                if (bands == bands2).argmax() != frame["band"].iat[0]:
                    continue
                common = len(np.intersect1d(items, items2, assume_unique=True))
                if 100 * common >= percent * (n + n2 - common):
                    joined.add(comp2)
                    links.append((rep, rep2))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _labelled(shared: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).select(F.col("node").alias("rep"), "component")
    return shared.join(labels, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _listed(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of small buckets: every pair of different components once, whatever buckets it shares."""
    left = rest.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = rest.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fit).select("a", "b").distinct()
    return _confirmed(pairs, sets, percent)


def _in_blocks(rest: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large buckets, block by block."""
    rest = rest.withColumns({
        "rights": F.ceil(F.col("size") / BLOCK).cast("int"), "lefts": F.ceil(F.col("out") / BLOCK).cast("int"),
    })
    hashed = F.xxhash64("rep")
    left_rows = rest.filter("comp <> top").withColumn("i", F.pmod(hashed, "lefts")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))
    ).withColumn("side", F.lit(0))
    right_rows = rest.withColumn("j", F.pmod(hashed, "rights")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))
    ).withColumn("side", F.lit(1))
    keep = ["key", "band", "side", "rep", "comp", "n", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")]
    blocks = left_rows.select(*keep).unionByName(right_rows.select(*keep))
    described = blocks.join(bands, "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return described.groupBy("key", "i", "j").applyInPandas(_block_links(percent), "a bigint, b bigint")


def group(
    docs: DataFrame, shingle: int = 5, percent: int = PERCENT, registers: int = REGISTERS, rows: int = BAND,
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = kept_table(
        texts.mapInArrow(
            _signing(shingle, registers, rows), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"
        ),
        "signatures",
    )
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    classes = kept_table(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    placed = usable.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "rep")
    heads = usable.join(classes.select("rep").withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    members = heads.select(
        F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key")
    )
    pivots = members.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot <> last").drop("last")
    pivots = kept_table(pivots, "pivots")
    shared = kept_table(members.join(pivots, "key"), "buckets")

    bitmap = spark.sparkContext.broadcast(bitmap_of(shared.select("rep").distinct(), "rep"))
    slotted = texts.filter("doc_id is not null").withColumn("slot", slot_of("doc_id"))
    sets = kept_table(
        slotted.mapInArrow(_sets_of(shingle, bitmap), "doc_id bigint, items array<bigint>").join(
            shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"
        ),
        "sets",
    )

    def fits(first: str, second: str):
        return 100 * F.least(first, second) >= percent * F.greatest(first, second)

    sizes = shared.groupBy("rep").agg(F.max("n").alias("pn")).withColumnRenamed("rep", "pivot")
    pairs = shared.filter("rep <> pivot").select("pivot", "rep", "n").distinct().join(sizes, "pivot").filter(fits("n", "pn"))
    links = kept_table(_confirmed(pairs.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), sets, percent), "links")

    # a second pivot from what the first did not join
    now = _labelled(shared, links)
    own = now.filter("rep = pivot").select("key", F.col("comp").alias("pivot_comp"))
    left = now.join(own.distinct(), "key")
    second = kept_table(left.filter("comp <> pivot_comp").groupBy("key").agg(F.min(F.struct("rep", "n", "comp")).alias("p")), "second-pivots")
    pairs = left.join(second, "key").filter((F.col("comp") != F.col("p.comp")) & (F.col("rep") != F.col("pivot")) & fits("n", "p.n"))
    pairs = pairs.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = kept_table(links.unionByName(_confirmed(pairs, sets, percent)), "links")

    # the rest of each bucket, exactly
    now = kept_table(_labelled(shared, links), "labels")
    counts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("key").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.max("c").alias("c")
    ).filter("c < size").select("key", "top", "size", (F.col("size") - F.col("c")).alias("out"))
    largest = kept_table(largest, "largest")
    rest = kept_table(now.select("key", "band", "rep", "n", "comp").join(largest, "key"), "rest")
    bands = heads.select(F.col("doc_id").alias("rep"), "bands")
    more = _listed(rest.filter(F.col("size") <= SMALL), sets, percent).unionByName(
        _in_blocks(rest.filter(F.col("size") > SMALL), bands, sets, percent)
    )
    links = kept_table(links.unionByName(more), "links")

    labels = components(links).select(F.col("node").alias("rep"), "component")
    component = placed.distinct().join(labels, "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id")
    )
    return (
        signed.select("doc_id", "n_shingles").join(component, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_copies(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The documents that ``group`` keeps, with all their columns; only copies meet a join."""
    copies = kept_table(group(docs, shingle, percent, text=text).filter("not kept").select("doc_id").distinct(), "copies")
    some, rest = join_some(docs, copies, "doc_id", lambda few: few.join(copies, "doc_id", "left_anti"))
    return some.select(*docs.columns).unionByName(rest)
