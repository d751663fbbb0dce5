"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic documents (P) and
unlabelled documents (U).  With class prior p, the risk is

    p * R_P(+) + max(0, R_U(-) - p * R_P(-))

the class-prior-corrected estimator whose second term, the negatives' risk,
may not fall below zero; where it would, the step goes uphill on that term
instead, which keeps a flexible model from overfitting P.

A document's features are its distinct words, the stems (first 4 to 6 letters)
of its words, and whether 2 or 3 of its distinct words share a stem.  The
sampled texts are written once to the shared folder and their features are
counted where they lie; a feature is used if at least `SEEN` sampled positives
have it and its rate among them exceeds that among the unlabelled by `EXCESS`
standard errors.  The weight decay is chosen among `DECAYS` by the risk of the
decisions at the threshold on folds of the sampled documents, all of them
inside the learning rows.

Defined results: null, empty and wordless texts have no feature and get the
score of the bias alone; texts of any length are scored whole; ties in the
choice of samples go by hash and id; labels of documents that are not in the
table teach nothing, and without a confirmed toxic document in it every score
is the prior; an id counts once however many label rows it has, and of
contradicting ones toxic wins; rows that repeat an id come out once each; an
empty table gives no rows; other columns are not read.  Bounds on what is
learned from: `POSITIVES` and `UNLABELLED` documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import fold
from .storage import materialise, python_ready
from .vocab import WordTable, resident

POSITIVES, UNLABELLED = 2_000, 4_000
#: Sampled positives that a feature needs, and standard errors of its excess among them.
SEEN, EXCESS = 3, 5.0
DECAYS, FOLDS = (1e-3, 3e-4, 1e-4), 3
THRESHOLD = 0.7
#: Words in one generation of what a process remembers; most share one value.
WORDS = 150_000
NOTHING: tuple[float, tuple[str, ...]] = (0.0, ())
STEMS = (4, 5, 6)
#: Distinct words of one stem that make a feature of their own.
SHARED = (2, 3)

words_of = regex.compile(r"\p{L}+").findall


def stems(word: str) -> tuple[str, ...]:
    return tuple(word[:k] + "-" for k in STEMS if len(word) > k)


def features(text: str | None) -> set[str]:
    """The features of a whole text."""
    words = set(words_of(text.lower())) if text else set()
    shared = Counter(s for w in words for s in stems(w))
    out = words | set(shared)
    out.update(f"{s}{k}" for s, n in shared.items() for k in SHARED if n >= k)
    return out


class Model:
    """Weights of the chosen features."""

    def __init__(self, weights: tuple[tuple[str, float], ...], bias: float):
        self.weights, self.bias = dict(weights), bias
        # Of a word: its own weight, and those of its stems that any feature uses.
        used = {f.partition("-")[0] + "-" for f in self.weights if "-" in f}
        self.used = used
        self.table = WordTable(self._word, WORDS)

    def _word(self, word: str) -> tuple[float, tuple[str, ...]]:
        own, more = self.weights.get(word, 0.0), tuple(s for s in stems(word) if s in self.used)
        return (own, more) if own or more else NOTHING

    def score(self, text: str | None) -> float:
        """Probability that a text is toxic."""
        total, shared, at = self.bias, Counter(), self.table.__getitem__
        for w in set(words_of(text.lower())) if text else ():
            own, more = at(w)
            total += own
            if more:
                shared.update(more)
        for s, n in shared.items():
            total += self.weights.get(s, 0.0)
            for k in SHARED:
                if n >= k:
                    total += self.weights.get(f"{s}{k}", 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def model(weights: tuple[tuple[str, float], ...], bias: float) -> Model:
    return resident(("toxicity", weights, bias), lambda: Model(weights, bias))


Rows = list[list[int]]


def _sparse(rows: Rows) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, feature, number of documents) of the ones in a table of features."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], dtype=np.int64), len(rows)


def _scores(x: tuple[np.ndarray, np.ndarray, int], w: np.ndarray, b: float) -> np.ndarray:
    doc, col, n = x
    return 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], n) + b, -40, 40)))


def _minus(s: np.ndarray) -> float:
    """Mean loss of taking documents as not toxic."""
    return float(-np.log1p(-np.clip(s, 0, 1 - 1e-12)).mean())


def decision_risk(p: Rows, u: Rows, w: np.ndarray, b: float, prior: float) -> float:
    """The non-negative risk of the decisions: toxic documents missed, and other ones taken."""
    found, taken = ((_scores(_sparse(x), w, b) >= THRESHOLD).mean() for x in (p, u))
    return float(prior * (1 - found) + max(0.0, taken - prior * found))


def fit_nnpu(rows: Rows, positive: list[bool], size: int, prior: float, rounds: int = 600, rate: float = 0.05, decay: float = 3e-4, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; rows hold the features of each document.

    Without documents of both kinds there is no risk to minimise: all weights
    are zero and the bias is the prior's.
    """
    p, u = (_sparse([r for r, y in zip(rows, positive) if y == kind]) for kind in (True, False))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not p[2] or not u[2]:
        return w, b
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def grad(x: tuple[np.ndarray, np.ndarray, int], slope: np.ndarray) -> np.ndarray:
        doc, col, n = x
        return np.r_[np.bincount(col, slope[doc], size), slope.sum()] / n

    for step in range(1, rounds + 1):
        # Losses: -log s for +, -log(1 - s) for -; slopes with respect to the score are s - 1 and s.
        sp, su = _scores(p, w, b), _scores(u, w, b)
        negative = grad(u, su) - prior * grad(p, sp)
        g = prior * grad(p, sp - 1) + negative if _minus(su) >= prior * _minus(sp) else -gamma * negative
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def chosen_decay(p: Rows, u: Rows, size: int, prior: float, decays: tuple[float, ...] = DECAYS, folds: int = FOLDS) -> float:
    """The decay of least risk over folds of the sampled documents; the first of equal ones, and where there are too few to fold."""
    if min(len(p), len(u)) < folds:
        return decays[0]

    def risk_of(decay: float) -> float:
        total = 0.0
        for k in range(folds):
            own_p, own_u = ([r for i, r in enumerate(x) if i % folds != k] for x in (p, u))
            w, b = fit_nnpu(own_p + own_u, [True] * len(own_p) + [False] * len(own_u), size, prior, rounds=300, decay=decay)
            total += decision_risk(p[k::folds], u[k::folds], w, b, prior)
        return total

    return min(decays, key=risk_of)


def _sampled(df: DataFrame, labels: DataFrame, where: Column | None, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int, int]:
    """(kind, text and a key of the sampled documents; labelled ids in the table; toxic ones of them).

    Kinds: 1 confirmed, 2 unlabelled sample, 3 both, as the estimator has it.
    """
    told = labels.select(F.col(id_col).cast("long").alias(id_col), (F.col(label_col) == 1).cast("int").alias("y")).filter(F.col(id_col).isNotNull() & F.col("y").isNotNull())
    told = told.groupBy(id_col).agg(F.max("y").alias("y"))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).filter(F.col(id_col).isNotNull())
    rows = rows.filter(where) if where is not None else rows
    keyed = rows.select(id_col).distinct().join(told, id_col, "left").select(F.col(id_col).alias("k"), "y", F.xxhash64(id_col, F.lit(9)).alias("h"))
    keyed = materialise(keyed, "keyed")
    n, toxic = keyed.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()

    def least(own: DataFrame, size: int, kind: int) -> DataFrame:
        return own.orderBy("h", "k").limit(size).select("k", F.lit(kind).alias("kind"))

    chosen = least(keyed.filter("y = 1"), POSITIVES, 1).unionByName(least(keyed, UNLABELLED, 2)).groupBy("k").agg(F.sum("kind").cast("int").alias("kind"))
    # As few ids as the bounds allow; an id on many rows is held to the bounds by the last limit.
    texts = rows.join(F.broadcast(chosen), rows[id_col] == F.col("k")).select("kind", "text", F.xxhash64("k", "text", F.lit(9)).alias("h"))
    return texts.orderBy("h", "kind").limit(POSITIVES + UNLABELLED), n, toxic


def learn(df: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[tuple[tuple[str, float], ...], float]:
    """(weights, bias) from the documents and labels whose rows satisfy `where` (a condition on the id column)."""
    python_ready(df.sparkSession)
    texts, n, toxic = _sampled(df, labels, where, id_col, text_col, label_col)
    prior = min(0.5, max(0.01, toxic / n)) if n else 0.01
    if not toxic:
        return (), float(np.log(prior / (1 - prior)))
    texts = materialise(texts, "sampled")
    n_p, n_u = (x or 0 for x in texts.agg(F.sum(F.col("kind").bitwiseAND(F.lit(1))), F.sum(F.shiftright("kind", 1))).first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, u = Counter(), Counter()
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = features(t.as_py())
                if k & 1:
                    p.update(found)
                if k & 2:
                    u.update(found)
            # Every count of the batch: what is rare here may not be so in the sum.
            names = list(p | u)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()), pa.array([u[f] for f in names], pa.int64())], ["f", "p", "u"])

    dealt = texts.repartition(32, "h")  # as many tasks as the bounds call for, however large the table
    counts = dealt.select("kind", "text").mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    excess = (F.col("p") / F.lit(n_p) - F.col("u") / F.lit(n_u)) / F.sqrt(both * (1 - both) * F.lit(1 / n_p + 1 / n_u) + F.lit(1e-12))
    best = sorted(r["f"] for r in counts.filter((F.col("p") >= SEEN) & (excess >= EXCESS)).select("f").collect())
    place = {f: k for k, f in enumerate(best)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(place[f] for f in features(t.as_py()) if f in place) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["h", "kind", "at"])

    got = sorted((r["h"], r["kind"], r["at"]) for r in dealt.select("h", "kind", "text").mapInArrow(rows_of, "h long, kind int, at array<int>").collect())
    p, u = [at for _, k, at in got if k & 1], [at for _, k, at in got if k & 2]
    w, b = fit_nnpu(p + u, [True] * len(p) + [False] * len(u), len(best), prior, decay=chosen_decay(p, u, len(best), prior))
    return tuple((f, float(a)) for f, a in zip(best, w) if abs(a) > 1e-4), b


def score(df: DataFrame, weights: tuple[tuple[str, float], ...], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row; a narrow map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(weights, bias)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    python_ready(df.sparkSession)
    scored = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the rows that are not held out."""
    weights, bias = learn(df, labels, fold(id_col, 3) != 1, id_col, text_col)
    return score(df, weights, bias, id_col, text_col).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(df: DataFrame, weights: tuple[tuple[str, float], ...], bias: float, text_col: str = "text") -> DataFrame:
    """The rows of `df` that are not predicted toxic, with all their columns; a narrow map without a shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(weights, bias)
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < THRESHOLD for t in b.column(at)], pa.bool_()))

    python_ready(df.sparkSession)
    return df.mapInArrow(run, df.schema)
