"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Counts of all training tokens come first: they give the smoothed unigram base, and the
model's units. The most frequent tokens are units of their own, all others share units by
their last two bytes; a token's probability is that of its unit in context times its
smoothed share of the unit, so probabilities of all tokens add up to one.

The model predicts the vector of the next unit as a sum of position matrices times the
vectors of the three units before, and scores units by a product with it. Training compares the
true unit with noise drawn from the unigram distribution. Every partition trains on its own
documents, and the parameters are averaged, weighted by tokens; a first round over an eighth of the
documents gives the second, over the rest, its start. Scores use batched matrix products
over all units, so they are normalised exactly.

Words of the ``frequent`` table, of bounded size, are looked up inside the tasks; counts of
all other words are joined by hash, so the vocabulary is never collected, and frequent
words, which would be hot keys, never shuffled. Words are told apart by 64-bit hashes.

Defined results for odd input: a null or empty text is one end token. With no training
documents N, V and all counts are 0, the base is that of an unseen token, and the score
uses units of equal probability. Repeated rows are counted and scored one by one; null ids
are held in or out by the crc of an empty text. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frequent import most_frequent
from .graph import kept_table
from .labelled import held_out
from .tokens import Tokens, chunks, tokenize

HEADS, TAILS, DIM, ORDER = 64, 64, 16, 3
UNITS = HEADS + TAILS
#: Words whose counts are sent to every task.
FREQUENT = 1 << 16
NOISE, BATCH, RATE = 32, 4096, 0.1
SMOOTHING = 0.1
#: Hash that stands for the end of a text (fixed value, as good as any).
END = 0x7EC0_DE5E_0FF5_1DE5
_U = np.uint64


def tail_units(found: Tokens) -> np.ndarray:
    """Unit that each word has if it is not frequent enough for its own: by its last two bytes."""
    data = np.frombuffer(found.buffer, np.uint8).astype(np.int64)
    last = data[found.ends - 1]
    before = np.where(found.ends - found.starts > 1, data[found.ends - 2], 0)
    return HEADS + (last * 131 + before * 31) % TAILS


END_TAIL = HEADS


def with_ends(found: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and tail units with an end after each text, and where the texts begin."""
    at = found.first[1:]
    hashes = np.insert(found.hashes, at, _U(END))
    tails = np.insert(tail_units(found), at, END_TAIL)
    return hashes, tails, found.first + np.arange(len(found.first))


def _counting(batches) -> Iterator:
    """Counts of the tokens of one partition; merged whenever they pile up."""
    import pyarrow as pa

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        hashes, tails, counts = (np.concatenate(x) for x in zip(*kept))
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        return keys, tails[first], np.bincount(back, weights=counts).astype(np.int64)

    for batch in batches:
        for _, texts in chunks(batch.column(0)):
            hashes, tails, _ = with_ends(tokenize(texts))
            keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            kept.append((keys, tails[first], counts))
            if sum(len(k[0]) for k in kept) > 2_000_000:
                kept = [merged()]
                if len(kept[0][0]) > 1_000_000:
                    yield _rows(pa, kept.pop())
    if kept:
        yield _rows(pa, merged())


def _rows(pa, counted):
    keys, tails, counts = counted
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(tails.astype(np.int32)), pa.array(counts)], names=["word", "tail", "c"]
    )


def token_counts(texts: DataFrame) -> DataFrame:
    """(word hash, tail unit, count) of all tokens of ``texts``, one column of texts, kept in a table."""
    parts = texts.mapInArrow(_counting, "word bigint, tail int, c bigint")
    return kept_table(parts.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("c").alias("c")), "counts")


@dataclass
class Vocabulary:
    """Bounded part of the counts, and what the whole of them adds up to."""

    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    units: np.ndarray  # unit of each frequent word
    tokens: int
    types: int
    unit_tokens: np.ndarray
    unit_types: np.ndarray

    def places(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each token among the frequent words (-1: not there) and its unit."""
        if not len(self.words):
            return np.full(len(hashes), -1), tails
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        there = self.words[at] == hashes
        return np.where(there, at, -1), np.where(there, self.units[at], tails)

    @property
    def unigram(self) -> np.ndarray:
        return (self.unit_tokens + 1) / (self.unit_tokens + 1).sum()

    def log_share_divisor(self) -> np.ndarray:
        """log10 of the mass that the words of a shared unit divide."""
        return np.log10(self.unit_tokens + SMOOTHING * (self.unit_types + 1))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    top = most_frequent(counts, "c", frequent).toPandas()
    sums = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    unit_tokens, unit_types = np.zeros(UNITS), np.zeros(UNITS)
    unit_tokens[sums["tail"].to_numpy(int)] = sums["c"]
    unit_types[sums["tail"].to_numpy(int)] = sums["n"]
    total, types = int(unit_tokens.sum()), int(unit_types.sum())
    top = top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    units = top["tail"].to_numpy(np.int64).copy()
    heads = min(HEADS, len(top))
    for k in range(heads):
        unit_tokens[units[k]] -= top["c"][k]
        unit_types[units[k]] -= 1
        unit_tokens[k], unit_types[k], units[k] = top["c"][k], 1, k
    words = top["word"].to_numpy(np.int64).view(_U)
    order = np.argsort(words)
    return Vocabulary(words[order], top["c"].to_numpy(np.int64)[order], units[order], total, types, unit_tokens, unit_types)


@dataclass
class LogBilinear:
    r: np.ndarray  # vectors of units as context
    c: np.ndarray  # one matrix per position
    q: np.ndarray  # vectors of units as prediction
    b: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        k = len(unigram)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        matrices = np.stack([np.eye(DIM, dtype=np.float32)] * ORDER) + draw(ORDER, DIM, DIM)
        return LogBilinear(draw(k, DIM), matrices, draw(k, DIM), np.log(unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.r, self.c, self.q, self.b)])

    @staticmethod
    def shaped(flat: np.ndarray, k: int = UNITS) -> LogBilinear:
        sizes = [(k, DIM), (ORDER, DIM, DIM), (k, DIM), (k,)]
        parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in sizes])[:-1])
        return LogBilinear(*(p.reshape(s) for p, s in zip(parts, sizes)))

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of each target after its context."""
        tables = [self.r @ m for m in self.c]
        out = np.empty(len(target))
        for k in range(0, len(target), BATCH):
            rows = slice(k, k + BATCH)
            wanted = sum(t[context[j, rows]] for j, t in enumerate(tables))
            scores = wanted @ self.q.T + self.b
            own = scores[np.arange(len(scores)), target[rows]].astype(np.float64)
            top = scores.max(axis=1, keepdims=True)
            np.exp(scores - top, out=scores)
            out[rows] = own - top[:, 0] - np.log(scores.sum(axis=1, dtype=np.float64))
        return out


def contexts(units: np.ndarray, first: np.ndarray, before: int) -> np.ndarray:
    """Units one, two and three places before each token; ``before`` stands in front of a text."""
    place = np.arange(len(units)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((ORDER, len(units)), before, np.int64)
    for j in range(ORDER):
        inside = place > j
        out[j, inside] = units[np.flatnonzero(inside) - j - 1]
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad over minibatches."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int = 11):
        self.m = LogBilinear(*(a.copy() for a in (model.r, model.c, model.q, model.b)))
        self.noise = unigram
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.sums = [np.full_like(a, 1e-6) for a in (model.r, model.c, model.q, model.b)]

    @staticmethod
    def _scatter(rows: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
        flat = (rows[:, None] * DIM + np.arange(DIM)).ravel()
        return np.bincount(flat, values.ravel(), k * DIM).reshape(k, DIM).astype(np.float32)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        m, n, k = self.m, len(target), len(self.noise)
        false = self.rng.choice(k, NOISE, p=self.noise)
        r = [m.r[context[j]] for j in range(ORDER)]
        wanted = sum(r[j] @ m.c[j] for j in range(ORDER))
        own, others = m.q[target], m.q[false]
        true = np.einsum("ij,ij->i", wanted, own) + m.b[target] - self.log_noise[target]
        wrong = wanted @ others.T + m.b[false] - self.log_noise[false]
        d_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        d_wrong = 1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
        d_wanted = d_true[:, None] * own + d_wrong @ others
        g_q = self._scatter(target, d_true[:, None] * wanted, k)
        np.add.at(g_q, false, d_wrong.T @ wanted)
        g_b = np.bincount(target, d_true, k).astype(np.float32)
        np.add.at(g_b, false, d_wrong.sum(axis=0))
        g_r = self._scatter(np.concatenate(list(context)), np.concatenate([d_wanted @ m.c[j].T for j in range(ORDER)]), k)
        g_c = np.stack([r[j].T @ d_wanted for j in range(ORDER)])
        for a, s, g in zip((m.r, m.c, m.q, m.b), self.sums, (g_r, g_c, g_q, g_b)):
            g /= n
            s += g * g
            a -= RATE * g / np.sqrt(s)


def _training(vocab, start):
    def run(batches) -> Iterator:
        import pyarrow as pa

        v = vocab.value
        trainer = Trainer(LogBilinear.shaped(start.value), v.unigram)
        before = int(v.places(np.array([END], _U), np.array([END_TAIL]))[1][0])
        seen = 0
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                hashes, tails, first = with_ends(tokenize(texts))
                _, units = v.places(hashes, tails)
                context = contexts(units, first, before)
                for k in range(0, len(units), BATCH):
                    trainer.step(context[:, k : k + BATCH], units[k : k + BATCH])
                seen += len(units)
        if seen:
            flat = trainer.m.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen]), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["n", "p"]
            )

    return run


def train(texts: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """The model after one pass over all of ``texts`` (text, slice 0 to 7)."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(vocab)
    flat = LogBilinear.start(vocab.unigram).flat()
    for chosen in (F.col("slice") == 0, F.col("slice") > 0):
        start = context.broadcast(flat)
        parts = texts.filter(chosen).select("text").mapInArrow(_training(shared, start), "n bigint, p array<double>")
        mean = (
            parts.select("n", F.posexplode("p").alias("i", "v")).groupBy("i")
            .agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).toPandas()
        )
        if len(mean):
            flat = flat.astype(np.float64)
            flat[mean["i"].to_numpy(int)] = mean["v"]
    return LogBilinear.shaped(flat)


def _scoring(vocab, model):
    def run(batches) -> Iterator:
        import pyarrow as pa

        v, m = vocab.value, LogBilinear.shaped(model.value)
        divisor = v.log_share_divisor()
        all_divisor = np.log10(v.tokens + SMOOTHING * (v.types + 1))
        before = int(v.places(np.array([END], _U), np.array([END_TAIL]))[1][0])
        log_counts = np.log10(np.append(v.counts, 0) + SMOOTHING)
        for batch in batches:
            for part, texts in chunks(batch.column(2)):
                hashes, tails, first = with_ends(tokenize(texts))
                at, units = v.places(hashes, tails)
                model_part = m.log_probabilities(contexts(units, first, before), units) / np.log(10)
                known = at >= 0
                own = np.where(known, log_counts[at], 0.0)
                shared = units >= HEADS  # a token with a unit of its own needs no share of it
                # log10(c + 0.1) of rare tokens is added later, to both sums
                base = own - all_divisor
                scored = model_part + np.where(shared, own - divisor[units], 0.0)
                begins = first[:-1]
                rare = ~known
                offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(rare.astype(np.int32), begins)))).astype(np.int32)
                rows = slice(part.start, part.stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(rows.start, rows.stop - rows.start),
                        batch.column(1).slice(rows.start, rows.stop - rows.start),
                        pa.array(np.diff(first)), pa.array(np.add.reduceat(known.astype(np.int64), begins)),
                        pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(scored, begins)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[rare].view(np.int64))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"],
                )

    return run


def score(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Counts, base and model scores of every document, learned from those not held out."""
    spark = docs.sparkSession
    out = held_out(F.col("doc_id"), 10, 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    learn = texts.filter("not held_out").select("text", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(8)).alias("slice"))
    counts = token_counts(learn.select("text"))
    vocab = vocabulary(counts, frequent)
    model = train(learn, vocab)
    context = spark.sparkContext
    first = kept_table(
        texts.mapInArrow(
            _scoring(context.broadcast(vocab), context.broadcast(model.flat())),
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    rare = first.select("row", F.explode("rare").alias("word")).join(counts.select("word", "c"), "word", "left")
    late = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING))).alias("late"), F.count("c").alias("found")
    )
    zero = F.lit(0.0)
    return first.drop("rare").join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late", zero)).alias("base_score"), (F.col("model") + F.coalesce("late", zero)).alias("score"),
    )
