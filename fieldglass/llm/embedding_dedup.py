"""Near-duplicate embeddings by collision counting on one-dimensional projections.

1. Rows with the same vector are one class; everything after works on classes.
2. A table projects every vector on the lines of a few random rotations. At each rotation a
   vector stands at the end of some line: the one where its projection is most extreme. The
   lines and ends it stands at name its cell, so vectors meet only at the ends of sorted
   lines, where unrelated vectors are few.
3. A cell is sorted by the projection on its first line. Every vector is a query: a window
   centred at its projection is scanned, and for each pair in it the lines of one more
   rotation are asked how often a window centred at the query holds the other vector.
4. Pairs whose collision count passes are verified: cosine in double precision on the whole
   vectors. A pair is counted in the first table where it meets.
5. A task returns, per class, its number of links and the root of its component there, never
   pairs. Cells above a block's size are split into blocks, and each two blocks of a cell are
   one task's work, so no group is held in one task. Components are joined by union-find.

The number of rotations of a table grows with the logarithm of the classes, so a cell keeps a
bounded expected size; the number of tables and the least count are then calibrated on
simulated pairs at the threshold itself, so that recall there is the same at any size. Pairs
closer than the threshold are found more often.

What grows: vectors of one dense group, all within the threshold but none equal, are compared
pair by pair, as their numbers of links ask for; equal vectors are not.

Defined results for odd input: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing and are kept; so do rows without an id, whose
component is null. Vectors of different length never link. Rows that repeat an id are
vectors of their own that share a component. Ties do not matter: a component is named by its
smallest id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import join_some
from .graph import components, kept_table
from .tokens import mix

COSINE = 0.9
#: Share of pairs at the threshold that meet in some table, and share of them that the least count lets pass.
RECALL, PASSING = 0.99, 0.9995
#: Lines of a rotation at most, expected classes of a cell, classes of a block.
LINES, CELL, BLOCK = 64, 512, 2048
#: Simulated pairs of the calibration.
PAIRS = 4000
#: Projections are kept in units of 1 / UNIT standard deviations; half widths of the windows that count and of the scan.
UNIT, LIMIT = 512, 16_000
COUNTED, SCANNED = round(0.6 * UNIT), round(1.35 * UNIT)
#: Pairs that are looked at together.
AT_ONCE = 100_000

_SPOT = "cell bigint, pos int, cid bigint, rep bigint, copies bigint, codes binary, places binary, vector binary"


@dataclass
class Lines:
    """Random lines for vectors of one length: rotations of every table, lines that count, the least count."""

    tables: np.ndarray  # table, rotation, line, component
    counting: np.ndarray  # line, component
    least: int

    def spots(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, places): cell of each vector in every table and its place on the cell's first line."""
        t, k, lines, d = self.tables.shape
        values = (unit @ self.tables.reshape(-1, d).T).reshape(len(unit), t, k, lines)
        at = np.abs(values).argmax(3)
        ends = np.take_along_axis(values, at[..., None], 3)[..., 0]
        codes = np.zeros((len(unit), t), np.int32)
        for r in range(k):
            codes = codes * np.int32(2 * lines) + (2 * at[:, :, r] + (ends[:, :, r] < 0)).astype(np.int32)
        return codes, scaled(np.abs(ends[:, :, 0]), d)

    def counted(self, unit: np.ndarray) -> np.ndarray:
        return scaled(unit @ self.counting.T, unit.shape[1])


def scaled(values: np.ndarray, d: int) -> np.ndarray:
    return np.clip(np.rint(values * (math.sqrt(d) * UNIT)), -LIMIT, LIMIT).astype(np.int16)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many lines the window centred at a holds b."""
    return (np.abs(a - b) <= COUNTED).sum(1)


def calibrated(d: int, n: int, cosine: float, recall: float, seed: int = 13) -> Lines:
    """Lines for n vectors of length d, calibrated on simulated pairs with exactly that cosine."""
    random = np.random.default_rng([seed, d])
    lines = min(LINES, d)

    def rotation() -> np.ndarray:
        return np.linalg.qr(random.standard_normal((d, lines)))[0].T

    counting = rotation()
    u, other = random.standard_normal((2, PAIRS, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other -= (other * u).sum(1, keepdims=True) * u
    size = np.linalg.norm(other, axis=1, keepdims=True)
    v = cosine * u + math.sqrt(max(0.0, 1 - cosine**2)) * np.divide(other, size, out=np.zeros_like(other), where=size > 1e-9)
    rotations = max(1, math.ceil(math.log(max(n, 1) / CELL) / math.log(2 * lines)))
    trial = Lines(np.stack([np.stack([rotation() for _ in range(rotations)]) for _ in range(8)]), counting, 0)
    met = together(*trial.spots(u), *trial.spots(v)).mean()
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(met, 0.99)))) if met else 1
    counts = np.sort(collisions(trial.counted(u), trial.counted(v)))
    more = [np.stack([rotation() for _ in range(rotations)]) for _ in range(tables)]
    return Lines(np.stack(more), counting, int(counts[int((1 - PASSING) * len(counts))]))


def together(codes: np.ndarray, places: np.ndarray, codes2: np.ndarray, places2: np.ndarray) -> np.ndarray:
    """In which tables the pairs meet: the same cell, and within the window that is scanned."""
    return (codes == codes2) & (np.abs(places - places2) <= SCANNED)


def units(vectors: np.ndarray) -> np.ndarray:
    scale = vectors / np.abs(vectors).max(1, keepdims=True)
    return scale / np.linalg.norm(scale, axis=1, keepdims=True)


def _by_length(column, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each length of the list column."""
    offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, values[offsets[rows][:, None] + np.arange(d)]


def _cell_keys(codes: np.ndarray, d: int) -> np.ndarray:
    tables = np.arange(codes.shape[1], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(d)
    return mix(mix(codes.astype(np.uint64)) + tables).view(np.int64)


def _cells(lines):
    """Only the cells of every vector, to count them."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows, vectors in _by_length(batch.column("vector"), np.float64):
                for begin in range(0, len(rows), 512):
                    codes, _ = lines.value[vectors.shape[1]].spots(units(vectors[begin : begin + 512]))
                    yield pa.RecordBatch.from_arrays([pa.array(_cell_keys(codes, vectors.shape[1]).reshape(-1))], names=["cell"])

    return run


def _spots(lines, kind):
    """A row for every vector and table, with what a pair needs to be judged."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = [batch.column(c).to_numpy() for c in ("cid", "rep", "copies")]
            for rows, vectors in _by_length(batch.column("vector"), kind):
                d = vectors.shape[1]
                for begin in range(0, len(rows), 512):
                    part, here = vectors[begin : begin + 512], rows[begin : begin + 512]
                    codes, places = lines.value[d].spots(units(part.astype(np.float64)))
                    t = codes.shape[1]
                    again = lambda a: np.repeat(a, t, axis=0)
                    wide = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                    every = pa.array(np.repeat(np.arange(len(here)), t))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(_cell_keys(codes, d).reshape(-1)), pa.array(places.reshape(-1).astype(np.int32)),
                            *[pa.array(again(o[here])) for o in own],
                            *[wide(a).take(every) for a in (codes, places, part)],
                        ],
                        names=["cell", "pos", "cid", "rep", "copies", "codes", "places", "vector"],
                    )

    return run


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of rows after joining a with b; a label is the smallest row of its component."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _linked(rows: dict, lines: Lines, kind, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of links, component label) of the rows of whole groups, sorted by group and place."""
    n = len(rows["group"])
    group, pos, side, same_block, copies = (rows[c] for c in ("group", "pos", "side", "same", "copies"))
    d = len(rows["vector"][0]) // np.dtype(kind).itemsize
    t = len(rows["codes"][0]) // 4
    read = lambda c, dtype, width: np.frombuffer(b"".join(rows[c]), dtype).reshape(n, width)
    vectors = read("vector", kind, d).astype(np.float64)
    codes, places = read("codes", np.int32, t), read("places", np.int16, t)
    keys = _cell_keys(codes, d)
    table = (keys == rows["cell"][:, None]).argmax(1)
    unit = units(vectors)
    counted = lines.counted(unit)
    links, parent = np.zeros(n), np.arange(n)

    def judge(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal links, parent
        ok = collisions(counted[i], counted[j]) >= lines.least
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[ok], j[ok]
        earlier = together(codes[i], places[i], codes[j], places[j]) & (np.arange(t) < table[i][:, None])
        ok = ~earlier.any(1)
        i, j = i[ok], j[ok]
        links += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        parent = _united(parent, i, j)

    alive, step, held, waiting = np.arange(n), 0, [], 0
    while len(alive):
        step += 1
        alive = alive[alive + step < n]
        other = alive + step
        near = (group[other] == group[alive]) & (pos[other] - pos[alive] <= SCANNED)
        alive, other = alive[near], other[near]
        asked = same_block[alive] | (side[alive] != side[other])
        held.append((alive[asked], other[asked]))
        waiting += int(asked.sum())
        if waiting >= AT_ONCE or (waiting and not len(alive)):
            judge(*(np.concatenate(x) for x in zip(*held)))
            held, waiting = [], 0
    return links.astype(np.int64), parent


def _linking(lines, kind, cosine: float):
    columns = ["cell", "i", "j", "side", "pos", "cid", "rep", "copies", "codes", "places", "vector"]

    def done(table) -> Iterator:
        import pyarrow as pa

        sizes = np.array([len(v) for v in table.column("vector").to_pylist()]) // np.dtype(kind).itemsize
        for d in np.unique(sizes).tolist():
            part = table.filter(pa.array(sizes == d))
            plain = {c: part.column(c).to_numpy() for c in columns[:8]}
            rows = {c: part.column(c).to_pylist() for c in columns[8:]}
            border = np.zeros(part.num_rows, bool)
            for c in ("cell", "i", "j"):
                border[1:] |= plain[c][1:] != plain[c][:-1]
            rows |= {"group": np.cumsum(border), "same": plain["i"] == plain["j"]} | {c: plain[c] for c in ("cell", "pos", "side", "copies")}
            links, root = _linked(rows, lines.value[d], kind, cosine)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(plain["cid"][some]), pa.array(plain["rep"][some]), pa.array(plain["rep"][root[some]]), pa.array(links[some])],
                names=["cid", "a", "b", "n"],
            )

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, new]) if held is not None else new
            # all but the last group are whole
            last = [table.column(c)[-1].as_py() for c in ("cell", "i", "j")]
            open_rows = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("cell", "i", "j"), last)])
            whole = table.num_rows - int(open_rows.sum())
            held = table.slice(whole)
            if whole:
                yield from done(table.slice(0, whole))
        if held is not None:
            yield from done(held)

    return run


def group(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("usable", usable).withColumns({
        "k1": F.when(F.col("usable"), F.xxhash64("vector")), "k2": F.when(F.col("usable"), F.xxhash64(F.lit(7), "vector")),
    })
    classes = keyed.filter("usable").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")
    )
    classes = kept_table(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    lengths = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = spark.sparkContext.broadcast({d: calibrated(d, n, cosine, recall) for d, n in lengths.items()})

    sizes = classes.select("vector").mapInArrow(_cells(lines), "cell bigint").groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    large = kept_table(sizes.filter(F.col("size") > BLOCK), "large-cells")
    spots = classes.select("cid", "rep", "copies", "vector").mapInArrow(_spots(lines, kind), _SPOT)
    some, rest = join_some(spots, large, "cell", lambda few: few.join(large, "cell", "left"))
    mine = F.pmod(F.xxhash64("cid"), F.ceil(F.coalesce("size", F.lit(1)) / BLOCK)).cast("int")
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")
    split = some.withColumn("mine", mine).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({
        "i": F.least("mine", "o"), "j": F.greatest("mine", "o"), "side": (F.col("mine") > F.col("o")).cast("int"),
    })
    columns = ["cell", "i", "j", "side", "pos", "cid", "rep", "copies", "codes", "places", "vector"]
    zero = F.lit(0)
    dealt = split.select(*columns).unionByName(rest.withColumns({"i": zero, "j": zero, "side": zero}).select(*columns))
    linked = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "pos").mapInArrow(
        _linking(lines, kind, cosine), "cid bigint, a bigint, b bigint, n bigint"
    )
    found = kept_table(linked, "vector-links")

    numbers = classes.select("k1", "k2", "cid", "copies", "rep").join(found.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left")
    numbers = kept_table(
        numbers.select("k1", "k2", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "link-numbers"
    )
    named = kept_table(keyed.select("vec_id", "k1", "k2").join(numbers, ["k1", "k2"], "left").select("vec_id", "rep", "n_links"), "linked-vectors")
    edges = found.select("a", "b").unionByName(named.filter("rep <> vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges).select(F.col("node").alias("vec_id"), "component")
    return named.join(labels, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def without_copies(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """The vectors that ``group`` keeps, with all their columns; only copies meet a join."""
    key = "__vec_id"
    copies = kept_table(group(vectors, vec_id, embedding, cosine).filter("not kept").select(F.col("vec_id").alias(key)).distinct(), "copies")
    some, rest = join_some(vectors.withColumn(key, F.col(vec_id).cast("long")), copies, key, lambda few: few.join(copies, key, "left_anti"))
    return some.select(*vectors.columns).unionByName(rest.select(*vectors.columns))
