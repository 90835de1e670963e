"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of the whole text (no ids, labels, source or language) are standardised;
each class gets a Gaussian whose covariance is shrunk towards the pooled one and
towards a multiple of the identity. A score is the difference of the two
log-densities, whose Mahalanobis terms use the inverse Cholesky factors, computed once
at fitting; a one-variable logistic map, fitted on the same sample, turns it into a
probability. The fit takes at most ``SAMPLE`` labelled rows; every document is scored
in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_type, labelled_sample, per_document
from .features import statistics

SAMPLE = 20_000                # labelled rows at most
TO_POOLED, TO_IDENTITY = 0.2, 0.05
CUTOFF = 0.3


class Discriminant:
    """With fewer than ``dim`` rows of a class its covariance leans on the pooled one;
    with rows of one class only, the score is that class; without rows, 0.5."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None if 0 < y.sum() < len(y) else (float(y[0]) if len(y) else 0.5)
        if self.constant is not None:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        centred = [z[y == c] - z[y == c].mean(0) for c in (0, 1)]
        pooled = sum(c.T @ c for c in centred) / len(z)
        self.parts = []
        for c in (0, 1):
            n, own = len(centred[c]), centred[c].T @ centred[c] / len(centred[c])
            lean = max(TO_POOLED, x.shape[1] / (x.shape[1] + n))
            cov = (1 - lean) * own + lean * pooled
            cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * np.trace(pooled) / len(cov) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((z[y == c].mean(0), np.linalg.inv(factor), np.log(np.diag(factor)).sum() - np.log(n / len(z))))
        self.line = self._calibrate(self.margin(x), y)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        logs = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - rest for m, inv, rest in self.parts]
        return np.arcsinh(logs[1] - logs[0])

    @staticmethod
    def _calibrate(m: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Logistic regression on the margin by Newton steps, with softened labels."""
        n1 = y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        d, beta = np.column_stack([m, np.ones_like(m)]), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
            step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), d.T @ (t - p))
            beta += np.clip(step, -1, 1)
        return beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) * self.line[0] + self.line[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    rows = per_document(labelled_sample(docs, labels, "quality", sample),
                        lambda texts, y: [(statistics(t), int(c)) for t, c in zip(texts, y)],
                        "x array<double>, y int", ("text", "label")).collect()       # at most ``sample`` rows
    return Discriminant(np.array([r.x for r in rows]), np.array([r.y for r in rows], int))


def score_column(model: Discriminant, text: Column) -> Column:
    """Probability of label 1 for each whole text; null counts as empty."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts])))
    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Further
    columns are ignored, null and empty texts are scored as empty."""
    model = fit(docs, labels)
    scored = per_document(docs, lambda ids, texts: list(zip(ids, map(float, model.score(
        np.array([statistics(t or "") for t in texts]))))), f"doc_id {id_type(docs)}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good."""
    return docs.filter(score_column(fit(docs, labels), F.col("text")) >= CUTOFF)
