"""Text quality by a regularised quadratic discriminant.

A document is described by a few transformed statistics.  For either class the
statistics' mean and covariance are summed up by Spark; the covariance is
shrunk towards that of both classes and towards a sphere, and factored once.
A score is the logistic function of the difference of the two Gaussian log
densities, from Mahalanobis distances by the cached Cholesky factors, plus the
log ratio of the classes' shares.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.storage import materialize
from loopweave.llm.toxicity import labelled

NAMES = ("symbols", "bars", "capitals", "exclamations", "repeats", "variety", "word length", "short words")
#: Shares of the pooled covariance and of the sphere in a class's covariance.
POOLED, SPHERE = 0.2, 0.02

_PUNCTUATION = [ord(c) for c in "#$%&*<>=+~^_{}[]\\@/"]


def _angle(part: float, whole: float, usual: float, weight: float) -> float:
    """A share's arcsine root, with ``weight`` units of the usual share added, so that short texts tell little."""
    return math.asin(math.sqrt(min(1.0, (part + weight * usual) / (whole + weight))))


def statistics(text: str) -> list[float]:
    """A document's transformed statistics, as many as NAMES."""
    data = text.encode()
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    capitals = of[65:91].sum()
    letters = capitals + of[97:123].sum() + of[128:].sum()
    visible = len(data) - of[[9, 10, 11, 12, 13, 32]].sum()
    words = data.lower().split()
    n = len(words)
    return [
        _angle(of[_PUNCTUATION].sum(), visible, 0.001, 60),
        _angle(of[124], visible, 0.001, 60),
        _angle(capitals, letters, 0.03, 60),
        _angle(of[33], visible, 0.001, 60),
        _angle(sum(map(eq, words, words[1:])), n, 0.005, 20),
        _angle(len(set(words)), n, 0.8, 20) + 0.1 * math.log(n + 20),
        math.log((visible + 120) / (n + 20)),
        _angle(sum(1 for w in words if len(w) <= 3), n, 0.35, 20),
    ]


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``y`` with ``factor @ y = b`` for a lower triangle, by forward substitution over all columns at once."""
    y = np.empty_like(b)
    for i in range(len(b)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


@dataclass
class Discriminant:
    """Means, Cholesky factors, log determinants and log shares of classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True):
            y = forward(factor, (x - mean).T)
            density.append(log - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant:
    """The discriminant of two classes' counts, sums and sums of products."""
    d = sums.shape[1]
    n = np.maximum(n, 0.0)
    means = sums / np.maximum(n, 1)[:, None]
    spread = np.array([s - c * np.outer(m, m) for s, c, m in zip(squares, n, means, strict=True)])
    both = spread.sum(axis=0) / max(n.sum() - 2, 1)
    factors, logs = [], []
    for k in (0, 1):
        own = spread[k] / (n[k] - 1) if n[k] > d else both
        mixed = (1 - pooled) * own + pooled * both
        mixed = (1 - sphere) * mixed + (sphere * np.trace(mixed) / d + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        factors.append(factor)
        logs.append(math.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(logs))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Learned from all rows of ``labels`` whose ``crc32(doc_id) % folds`` isn't
    ``held``, and from the text alone.  Null texts are scored as empty ones; rows
    without a ``doc_id`` aren't held out, as they have no label.  Without labels
    of both classes the classes' Gaussians are alike or nearly so, and the score
    is the share of class 1.  Other columns are ignored, repeated rows each get
    a row.
    """
    d = len(NAMES)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            found = [statistics(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = materialize(docs.select("doc_id", "text").mapInArrow(describe, f"doc_id {kind}, x array<double>"), "quality-statistics")
    known = rows.join(labelled(labels, "quality", folds, held), "doc_id")
    x = [F.get("x", F.lit(i)) for i in range(d)]
    at = [(i, j) for i in range(d) for j in range(i, d)]
    sums = known.groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in at)).alias("ss"))
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums.collect():
        k = r["label"]
        n[k], s[k] = r["n"], r["s"]
        for (i, j), v in zip(at, r["ss"], strict=True):
            ss[k, i, j] = ss[k, j, i] = v
    if not n.all():
        s[n == 0], ss[n == 0] = s.sum(axis=0) / max(n.sum(), 1), 0
        model = Discriminant(np.zeros((2, d)), np.array([np.eye(d)] * 2), np.log((n + 1) / (n.sum() + 2)))
    else:
        model = fit(n, s, ss)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(flat) if len(flat) else [], pa.float64())], ["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    scored = rows.mapInArrow(judge, f"doc_id {kind}, score double").select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
