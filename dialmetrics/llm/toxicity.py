"""Toxicity by cumulative-link ordinal regression.

A document has a severity grade 0..K. One weight vector over sparse text
features (which words and beginnings of words a text holds) is shared by K ordered thresholds:

    P(grade > j) = sigmoid(w . x - theta_j),  theta_0 < theta_1 < ...

and a document's expected severity is the sum of these probabilities.

``fit`` takes any ordered grades. ``labels`` only says toxic or not; so of the toxic
documents of the sample those with more wording that goes with toxic labels than
the median of them has are grade 2, the others 1, and documents that are not
toxic 0.

Fitting. The classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents,
those with the smallest hash of doc_id. Spark counts in how many of them each
feature stands, by grade, and keeps those that part the grades by more than
chance would, the ``FEATURES`` best of them at most; the tasks then pick these from the
sample (its rows are kept in the checkpoint folder, so documents are read once), and only
their places, at most SAMPLE_ROWS * FEATURES numbers, come to the driver, where the likelihood is maximised. Scoring covers every document
and every word, as a map without shuffle; the model is FEATURES weights at most.

Defined results: null and empty texts have no features (their severity is the
base rate's); labels that repeat a doc_id count with the highest grade; without
usable labels, or with one grade only, the severity is 0 for all; repeated rows
score alike; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import need, spare

SAMPLE_ROWS = 10_000
FEATURES = 2_048
MIN_ROWS = 3            # labelled documents that a word must stand in
LEAST_Z = 5.0           # deviations from chance by which its documents' grades must differ
L2 = 0.05
STEPS = 400
REJECT = 0.5            # expected severity from which a document is toxic (see tests: held-out rows)
SEED = "toxicity-1"

WORD = re.compile(r"[^\W_]+")


PREFIXES = (4, 5, 6)    # lengths of the word beginnings that are features as well


def counts(text: str | None) -> Counter:
    """How often each word of a text occurs, lower-cased."""
    return Counter(WORD.findall((text or "").lower()))


def features(text: str | None) -> dict[str, float]:
    """The features of a text: its words, and the beginnings of longer ones (``begin*``); log(1 + occurrences)."""
    found = counts(text)
    total = Counter(found)
    for w, n in found.items():
        for k in PREFIXES:
            if len(w) > k:
                total[w[:k] + "*"] += n
    return {f: math.log1p(n) for f, n in total.items()}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def exceed(self, text: str | None) -> list[float]:
        """P(grade > j) for each threshold j."""
        if not self.thresholds:
            return []
        held: dict[str, int] = {}
        for w, n in counts(text).items():
            if w in self.weights:
                held[w] = held.get(w, 0) + n
            for k in PREFIXES:
                if len(w) > k and (f := w[:k] + "*") in self.weights:
                    held[f] = held.get(f, 0) + n
        z = sum(self.weights[f] * math.log1p(held[f]) for f in sorted(held))
        return [1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z - t)))) for t in self.thresholds]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def maximise(doc: np.ndarray, feature: np.ndarray, x: np.ndarray, grade: np.ndarray, n_features: int,
             l2: float = L2, steps: int = STEPS, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalised cumulative-link likelihood (Adam on all rows).

    ``doc, feature, x`` list the entries of the feature matrix. Thresholds are the first
    one and the logarithms of their gaps, so they stay in order. Grades are 0..K,
    each of them present.
    """
    n, k = len(grade), int(grade.max())
    share = np.clip([(grade > j).mean() for j in range(k)], 1e-6, 1 - 1e-6)
    start = np.log((1 - share) / share)
    par = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = par[:n_features], np.exp(par[n_features + 1:])
        theta = par[n_features] + np.r_[0.0, np.cumsum(gaps)]
        z = np.bincount(doc, weights=w[feature] * x, minlength=n)
        above = sigmoid(z[:, None] - theta[None, :])                # P(grade > j)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        dz = (slope[rows, grade] - slope[rows, grade + 1]) / p
        d_theta = np.zeros(k)
        np.add.at(d_theta, np.maximum(grade - 1, 0), -(slope[rows, grade] / p) * (grade > 0))
        np.add.at(d_theta, np.minimum(grade, k - 1), (slope[rows, grade + 1] / p) * (grade < k))
        g = np.empty_like(par)
        g[:n_features] = np.bincount(feature, weights=dz[doc] * x, minlength=n_features) - l2 * w
        g[n_features] = d_theta.sum()
        g[n_features + 1:] = gaps * (np.cumsum(d_theta[::-1])[::-1][1:])
        # the gradient shrinks by orders as the fit improves: a short memory of its size keeps the pace
        m, v = 0.9 * m + 0.1 * g, 0.95 * v + 0.05 * g * g
        pace = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
        par = par + pace * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.95 ** t)) + 1e-6)
    gaps = np.exp(par[n_features + 1:])
    return par[:n_features], par[n_features] + np.r_[0.0, np.cumsum(gaps)]


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` (0, 1) from ``doc_id, toxic``; rows without an id or a toxic label are left out."""
    need(labels, "doc_id", "toxic")
    grade = F.when(F.col("toxic") == 0, 0).otherwise(1)
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade).alias("grade")))


def fit(docs: DataFrame, graded: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = FEATURES,
        min_rows: int = MIN_ROWS, least_z: float = LEAST_Z, seed: str = SEED) -> Model:
    """The model of ``graded`` (doc_id, grade) and the texts of ``docs``."""
    sample = (graded.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
              .withColumn("row", F.row_number().over(Window.orderBy("doc_id"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # sample_rows rows of two numbers: bounded, so broadcast
    ensure_checkpoint_dir(docs.sparkSession)
    rows = texts.join(F.broadcast(sample), "doc_id").select("row", "grade", "text").checkpoint()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grade, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = features(text)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(found), pa.int32()), pa.array([grade] * len(found), pa.int32()),
                    pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())],
                    names=["row", "grade", "word", "x"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of the chosen features alone, by number; -1 stands for the document itself."""
        for batch in batches:
            for row, grade, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = {index[w]: x for w, x in features(text).items() if w in index} | {-1: 1.0}
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(found), pa.int32()), pa.array([grade] * len(found), pa.int32()),
                    pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())],
                    names=["row", "grade", "i", "x"])

    held = (rows.mapInArrow(explode, "row int, grade int, word string, x double")
            .groupBy("row", "grade", "word").agg(F.max("x").alias("x")))
    per_word = held.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("x2"), F.sum(F.col("x") * F.col("grade")).alias("xg"))
    whole = (rows.select("row", "grade").distinct()
             .agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("g"), F.sum(F.col("grade") * F.col("grade")).alias("g2")).first())
    if not whole["n"]:
        return Model({}, ())
    n, mean = whole["n"], whole["g"] / whole["n"]
    spread = whole["g2"] / n - mean * mean
    if spread <= 0:
        return Model({}, ())
    # how far the grades where a feature is are from what chance would give, in deviations
    score = F.abs(F.col("xg") - F.col("x") * mean) / F.sqrt(F.col("x2") * spread)
    kept = (per_word.where((F.col("n") >= min_rows) & (score >= least_z))
            .orderBy(score.desc(), "word").limit(most)
            .select("word", (F.col("xg") > F.col("x") * mean).alias("up")).collect())
    index = {r["word"]: i for i, r in enumerate(kept)}
    up = np.array([r["up"] for r in kept] + [False])
    # at most sample_rows x most entries
    entries = (rows.mapInArrow(pick, "row int, grade int, i int, x double")
               .groupBy("row", "grade", "i").agg(F.max("x").alias("x")).toArrow())
    row, grade, i, x = (entries.column(c).to_numpy() for c in ("row", "grade", "i", "x"))
    ids, doc = np.unique(row, return_inverse=True)
    of = np.zeros(len(ids), np.int64)
    of[doc] = grade
    present, of = np.unique(of, return_inverse=True)
    if len(present) < 2:
        return Model({}, ())
    at = i >= 0
    if len(present) == 2:       # two grades: the upper one is parted by the amount of its wording
        amount = np.bincount(doc, weights=x * up[i] * at, minlength=len(ids))
        present, of = np.unique(of + (of == 1) * (amount > np.median(amount[of == 1])), return_inverse=True)
    order = np.lexsort((i[at], doc[at]))
    w, theta = maximise(doc[at][order], i[at][order], x[at][order], of, len(index))
    # a grade that the sample lacks shares the threshold of the next lower one
    full = [theta[min(int(np.searchsorted(present, j + 1)) - 1, len(theta) - 1)] for j in range(int(present.max()))]
    return Model({name: float(w[k]) for name, k in index.items() if abs(w[k]) > 1e-3}, tuple(map(float, full)))


def score(docs: DataFrame, model: Model, out: str = "severity") -> DataFrame:
    """``docs`` plus its expected severity (0 to the highest grade)."""
    need(docs, "text")
    name = out if out not in docs.columns else spare(docs, out)
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for batch in batches:
            found = [float(sum(own.exceed(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def screen(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``doc_id, severity, toxic`` of every document of ``doc_id, text``."""
    need(docs, "doc_id", "text")
    model = fit(docs, grades(labels))
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", "severity")
    return scored.withColumn("toxic", F.col("severity") >= F.lit(reject))


def keep_clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents whose expected severity is below ``reject``, with their columns."""
    need(docs, "doc_id", "text")
    name = spare(docs, "severity")
    scored = score(docs, fit(docs, grades(labels)), name)
    return scored.where(F.col(name) < F.lit(reject)).select(*docs.columns)
