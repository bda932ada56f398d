"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded texts.

Folding undoes disguises: look-alikes of other scripts, digits and signs that stand for
letters become those letters, marks inside words vanish, and letters lose accents that none
of the four languages writes. i, l and 1 cannot be told apart, so they are one letter.

The lexicon holds word stems, found in the labelled rows: beginnings of words that are far
more frequent in toxic documents than in others, by the lower end of the confidence interval of
their log odds, which are their weights. Phrases in which a stem is innocent are exceptions: a
match inside one does not count. They are given, or learned as word pairs that only clean
documents hold.

A document's evidence is the weight of its matches, both as a sum and per word of its
length; a logistic function of the two, fitted on the same rows, gives the probability.

Defined results for odd input: a null or empty text has no evidence and a low score. Labels
that are null or of held-out rows are not read; without any toxic label nothing is toxic
and all scores are 0. Repeated rows are scored one by one, null ids count as held in. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .frequent import most_frequent
from .graph import kept_table
from .labelled import ROWS_PER_CLASS, held_out, training_rows
from .native import words

#: Look-alikes of Latin letters in Cyrillic and Greek (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs written for letters (fixed values).
SIGNS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "i"}
#: Accented letters that are letters of their own (fixed values).
OWN_LETTERS = frozenset("éèêçàùâôûäöüßñáíóú")
STEM_LENGTHS = range(3, 13)
THRESHOLD = 0.7
#: Stems and phrases of the labelled sample that are looked at, at most; the sample bounds them too.
CANDIDATES = 50_000


class _Folding(dict):
    """Character table for str.translate, filled as characters appear."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char.isspace():
            out = " "
        else:
            plain = unicodedata.normalize("NFKC", char).lower()
            letters = [plain] if plain in OWN_LETTERS else [
                c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)
            ]
            mapped = (LOOKALIKES.get(c) or SIGNS.get(c) or c for c in letters)
            out = "".join("i" if c == "l" else c for c in mapped if c.isalnum())
        self[code] = out
        return out


_FOLDING = _Folding()


def folded(text: str) -> str:
    """Folded words, each between single spaces, one also at both ends."""
    return f" {' '.join(text.translate(_FOLDING).split())} "


@dataclass
class Lexicon:
    stems: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-50.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
            for stem, weight in self.stems.items():
                made.add_word(f" {stem}", (weight, len(stem) + 1))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def evidence(self, text: str) -> tuple[float, int]:
        """Weight of all matches outside exceptions, and number of words."""
        line = folded(text)
        n = line.count(" ") - 1
        if not self.stems:
            return 0.0, n
        hits, innocent = [], []
        for end, (weight, length) in self.automaton().iter(line):
            (hits if weight else innocent).append((end - length + 1, end, weight))
        if innocent:
            hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in innocent)]
        return sum(h[2] for h in hits), n

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}


def features(evidence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Total evidence and evidence per hundred words, both damped."""
    density = 100 * evidence / np.maximum(n_words, 20)
    return np.stack([np.ones(len(evidence)), np.log1p(evidence), np.log1p(density)], 1)


def probabilities(lexicon: Lexicon, evidence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    z = features(evidence, n_words) @ np.array(lexicon.coefficients)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _stems(words: Iterable[str]) -> set[str]:
    return {w[:k] for w in set(words) for k in STEM_LENGTHS if len(w) >= k}


def _counting(wanted):
    """Documents of each class that hold a stem, or a pair of words around a chosen stem."""

    def run(frames) -> Iterator:
        import pandas as pd

        counts = {0: Counter(), 1: Counter()}
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"]):
                counts[y].update(wanted(folded(text).split()))
        rows = [(k, counts[1][k], counts[0][k]) for k in counts[0].keys() | counts[1].keys()]
        yield pd.DataFrame(rows, columns=["text", "pos", "neg"])

    return run


def _pairs(words: list[str], stems: dict[str, float]) -> set[str]:
    touched = [any(w[:k] in stems for k in STEM_LENGTHS) for w in words]
    return {f"{a} {b}" for a, b, p, q in zip(words, words[1:], touched, touched[1:]) if p or q}


def _summed(rows: DataFrame, wanted) -> DataFrame:
    counted = rows.mapInPandas(_counting(wanted), "text string, pos long, neg long")
    return counted.groupBy("text").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def chosen_stems(counts: dict[str, tuple[int, int]], n_pos: int, n_neg: int, least: float = 0.7) -> dict[str, float]:
    """Stems whose log odds are certain, the surest first, none a beginning of another.

    A stem all of whose documents hold a longer one too gives way to it.
    """
    longer: dict[str, int] = {}
    for stem, (pos, _) in counts.items():
        longer[stem[:-1]] = max(longer.get(stem[:-1], 0), pos)
    ranked = []
    for stem, (pos, neg) in counts.items():
        weight = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
        sure = weight - 2.5 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        if sure >= least and longer.get(stem, 0) < pos:
            ranked.append((-sure, stem, weight))
    out: dict[str, float] = {}
    begins: set[str] = set()
    for _, stem, weight in sorted(ranked):
        if stem not in begins and not any(stem[:k] in out for k in STEM_LENGTHS if k < len(stem)):
            out[stem] = weight
            begins.update(stem[:k] for k in STEM_LENGTHS if k < len(stem))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton steps with halving."""
    weight = weight / weight.sum()
    keep = ridge * np.array([0.0, 1.0, 1.0])

    def loss(b):
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * keep @ (b * b))

    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + keep * b
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(b.tolist())


def _evidence_of(lexicon):
    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            found = [lexicon.value.evidence(t) for t in frame["text"]]
            yield pd.DataFrame({"e": [f[0] for f in found], "n": [f[1] for f in found], "y": frame["y"]})

    return run


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Leaves one or few of each group of copies, which would pass for independent evidence.

    Copies mostly agree in the smallest hash of their three-word shingles; two hashes in turn.
    """
    for seed in (1, 2):
        w = words(F.col("text"))
        shingle = let(w, lambda a: F.array_min(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(a) - 2, F.lit(1))),
            lambda i: F.xxhash64(F.lit(seed), F.get(a, i - 1), F.get(a, i), F.get(a, i + 1)),
        )))
        rows = rows.withColumn("__k", shingle).dropDuplicates(["__k", "y"]).drop("__k")
    return rows


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), per_class: int = ROWS_PER_CLASS) -> Lexicon:
    """Lexicon and coefficients from at most ``per_class`` labelled rows of each class."""
    rows, totals = training_rows(docs, labels, "toxic", per_class)
    distinct = kept_table(_one_of_each(rows), "distinct")
    seen = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen.get(1) or not seen.get(0):
        return Lexicon({})
    first = kept_table(_summed(distinct.filter("y = 1"), _stems).filter("pos >= 3"), "stems")
    candidates = frozenset(r["text"] for r in most_frequent(first, "pos", CANDIDATES).select("text").collect())
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(candidates)
    second = _summed(distinct, lambda words: _stems(words) & shared.value).collect()
    stems = chosen_stems({r["text"]: (r["pos"], r["neg"]) for r in second}, seen[1], seen[0])
    phrases = _summed(distinct, lambda words: _pairs(words, stems)).filter("pos = 0 and neg >= 3")
    innocent = sorted(r["text"] for r in most_frequent(phrases, "neg", CANDIDATES).collect())
    lexicon = Lexicon(stems, tuple(dict.fromkeys([*(folded(e).strip() for e in exceptions), *innocent])))
    found = distinct.mapInPandas(_evidence_of(spark.sparkContext.broadcast(lexicon)), "e double, n long, y int").toPandas()
    y = found["y"].to_numpy(float)
    weight = np.where(y == 1, totals.get(1, 1) / seen[1], totals.get(0, 1) / seen[0])
    x = features(found["e"].to_numpy(float), found["n"].to_numpy(float))
    lexicon.coefficients = _logistic(x, y, weight)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, n_words, evidence, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            found = [shared.value.evidence(t or "") for t in frame["text"]]
            e, n = np.array([f[0] for f in found], float), np.array([f[1] for f in found], float)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_words": n.astype(np.int64), "evidence": e,
                "score": probabilities(shared.value, e, n) if len(e) else e,
            })

    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(run, "doc_id bigint, held_out boolean, n_words bigint, evidence double, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
