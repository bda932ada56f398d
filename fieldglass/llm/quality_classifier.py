"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing gives every unit of text a sparse random index vector and sums, over the
whole corpus, the index vectors of its neighbours; the sums are word vectors. Units are
words, hashed into a fixed number of rows, and the sets of character kinds that words are
made of (capitals, digits, marks ...), so that a word never seen before still has a vector.
The table has a fixed size, whatever the size of the corpus.

A document is the mean and spread of its word vectors and the agreement of neighbouring
ones. A network with one hidden layer, trained in numpy on a bounded sample of labelled rows, maps it to
a logit, which a temperature fitted on a part of the sample that is kept apart turns into a
probability.

Defined results for odd input: null and empty texts are scored as documents without words.
Labels that are null or of held-out rows are not read; with labels of one class or none all scores
are the share of good labels (0.5 without any). Repeated rows are scored one by one, null
ids count as held in. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import ROWS_PER_CLASS, held_out, training_rows
from .tokens import Tokens, chunks, mix, tokenize

DIM, NONZERO = 32, 4
WORD_ROWS = 1 << 13
_U = np.uint64


def _kinds() -> np.ndarray:
    """Bit of the kind of each byte: capital, other letter, digit, or one of the marks."""
    kind = np.full(256, 1 << 11, np.uint16)
    kind[0x41:0x5B] = 1
    kind[0x61:0x7B] = 2
    kind[0x80:] = 2
    kind[0x30:0x3A] = 4
    for bit, marks in enumerate((".,;:", "!?", "*", "$", "%", "&", "#", "|"), 3):
        for m in marks:
            kind[ord(m)] = 1 << bit
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    return kind


KINDS = _kinds()
ROWS = WORD_ROWS + (1 << 12)


def index_vectors() -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, one per unit."""
    out = np.zeros((ROWS, DIM), np.float32)
    for k in range(NONZERO):
        h = mix(np.arange(ROWS, dtype=_U) * _U(NONZERO) + _U(k + 1))
        np.add.at(out, (np.arange(ROWS), (h % _U(DIM)).astype(int)), np.where(h >> _U(63), 1, -1))
    return out


def units(found: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and of their kinds."""
    word = (found.hashes % _U(WORD_ROWS)).astype(np.int64)
    if not len(word):
        return word, word
    kinds = np.bitwise_or.reduceat(KINDS[np.frombuffer(found.buffer, np.uint8)], found.starts)
    return word, WORD_ROWS + kinds.astype(np.int64)


def _contexts(batches) -> Iterator:
    """Sums of neighbours' index vectors and number of tokens per unit, for one partition."""
    import pyarrow as pa

    index = index_vectors()
    sums = np.zeros((ROWS, DIM + 1), np.float64)
    for batch in batches:
        for _, texts in chunks(batch.column(0), lower=False):
            found = tokenize(texts)
            word, kind = units(found)
            if len(word) < 2:
                continue
            owner = np.repeat(np.arange(len(found.first) - 1), found.counts)
            own = index[word] + index[kind]
            near = np.zeros((len(word), DIM + 1), np.float32)
            near[:, DIM] = 1
            for step in (1, 2):
                same = (owner[step:] == owner[:-step])[:, None]
                near[step:, :DIM] += own[:-step] * same
                near[:-step, :DIM] += own[step:] * same
            for rows in (word, kind):
                order = np.argsort(rows, kind="stable")
                ranked = rows[order]
                begins = np.flatnonzero(np.diff(ranked, prepend=-1))
                sums[ranked[begins]] += np.add.reduceat(near[order], begins, axis=0)
    used = np.flatnonzero(sums[:, DIM])
    offsets = np.arange(len(used) + 1, dtype=np.int32) * (DIM + 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[used].ravel()))],
        names=["unit", "v"],
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One vector per unit from all documents; a table of fixed size."""
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_contexts, "unit int, v array<double>")
    summed = parts.groupBy("unit").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM + 1)]).toPandas()
    out = np.zeros((ROWS, DIM), np.float32)
    if len(summed):
        values = summed[[f"v{i}" for i in range(DIM + 1)]].to_numpy()
        mean = values[:, :DIM] / values[:, DIM:]
        mean -= values[:, :DIM].sum(0) / values[:, DIM].sum()
        out[summed["unit"].to_numpy()] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    return out


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean, spread and agreement of neighbours of its word vectors."""
    out = np.zeros((len(column), 3 * DIM + 2), np.float32)
    row = 0
    for _, texts in chunks(column, lower=False):
        found = tokenize(texts)
        word, kind = units(found)
        n = found.counts
        some = np.flatnonzero(n)
        if len(some):
            begins = found.first[:-1][some]
            v = vectors[word] + vectors[kind]
            size = n[some][:, None].astype(np.float32)
            mean = np.add.reduceat(v, begins, axis=0) / size
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, begins, axis=0) / size - mean * mean, 0))
            side = np.zeros_like(v)
            side[:-1] = v[:-1] * v[1:]
            side[found.first[1:][some] - 1] = 0  # the last word of a text has no next one
            steps = np.maximum(size - 1, 1)
            agreement = np.add.reduceat(side, begins, axis=0) / steps
            same = np.zeros((len(word), 1), np.float32)
            same[:-1, 0] = found.hashes[:-1] == found.hashes[1:]
            same[found.first[1:][some] - 1] = 0
            repeated = np.add.reduceat(same, begins, axis=0) / steps
            out[row + some] = np.concatenate([mean, spread, agreement, repeated, agreement.sum(1, keepdims=True)], axis=1)
        row += len(n)
    return out


@dataclass
class Network:
    """Standardised features -> tanh layer -> logit / temperature."""

    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on the weighted log loss with weight decay; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    apart, rest = order[: len(x) // 5], order[len(x) // 5 :]
    center, scale = x[rest].mean(0), x[rest].std(0) + 1e-3
    z, target, importance = np.clip((x - center) / scale, -8, 8), y.astype(np.float32), (weight / weight.mean()).astype(np.float32)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for k in range(0, len(rest), 128):
            rows = rest[k : k + 128]
            h = np.tanh(z[rows] @ p[0] + p[1])
            q = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            d = importance[rows] * (q - target[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(vectors, center, scale, p[0], p[1], p[2], float(p[3][0]))
    logits, truth, w = net.logits(x[apart]), target[apart], importance[apart]

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float((w * (np.logaddexp(0, s) - truth * s)).mean()) if len(s) else 0.0

    net.temperature = min(np.geomspace(0.25, 8, 60), key=loss) if len(apart) > 20 else 1.0
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Network:
    """Word vectors from all documents, the network from at most ``per_class`` rows of each class."""
    vectors = word_vectors(docs)
    rows, totals = training_rows(docs, labels, "quality", per_class)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = pooled(batch.column(0), shared.value)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], names=["y", "h", "x"])

    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    found = rows.select("text", "y", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "y int, h bigint, x array<float>").toPandas()
    found = found.sort_values("h", ignore_index=True)  # the network sees the rows in the same order in every run
    y = found["y"].to_numpy(int) if len(found) else np.empty(0, int)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        one = np.zeros(1)
        return Network(vectors, one, one, one, one, one, 0.0, constant=share)
    seen = np.bincount(y, minlength=2)
    weight = np.array([totals.get(0, 1) / seen[0], totals.get(1, 1) / seen[1]])[y]
    return train(np.stack(found["x"].to_numpy()), y, weight, vectors)


def score(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = pooled(batch.column(2), shared.value.vectors)
            p = shared.value.probabilities(x).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "held_out", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
