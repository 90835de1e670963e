"""Mixing by soft domain membership.

A classifier learned from a labelled table gives every document its probabilities p of
the domains; the document's tokens t count towards each domain in these shares. Rates
0 <= r <= MOST are sought for which the expected tokens of the domains, the sums of
r * t * p, match the target weights of the same total, staying near 1 otherwise:

    minimise |sums of r t p - T|^2 / (2 total) + STAY / 2 * sum of t (r - 1)^2

The optimum has r = 1 - p . (S - T) / (total STAY) within 0 and MOST, S being the domain
totals under these rates: all rates follow from one number per domain, the pull
(S - T) / total. It is found by Newton's method on these few equations, whose slope is made
of domain shares, so that a rare domain takes no more steps than a frequent one. A rate
depends on a document's p alone, so p is rounded to a grid of 1 / GRID and documents are
summed up by grid cell (tokens, and exact domain totals) before: each step is one
distributed sum over the cells, for several step lengths at once. It ends when every
domain's equation holds within TOLERANCE of the domain's own target.
A target that no rates can reach (a domain that hardly occurs) is missed by as much as
that costs least; the others are still met.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, labelled_sample, per_document, staged
from .features import contrast_words, statistics, words

SAMPLE = 20_000                    # labelled rows at most
WORDS = 200                        # words at most that mark a domain
MOST = 4.0                         # largest rate
STAY = 1e-4                        # pull towards rate 1
GRID = 500                         # cells per unit of probability
TOLERANCE = 1e-6                   # of a domain's own target
LENGTHS = 4.0 ** -np.arange(10)    # of a step, tried at once
STALL = 30                         # steps without progress: rounding is all that is left
# Domains of the labels table and their default weights.
DOMAINS = {"clean": 0.96, "junk": 0.015, "toxic": 0.025}


def label_domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> (doc_id, domain number): toxic documents, of
    the others junk (quality 0) and clean ones; rows with a null label have none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1)
                         .when((F.col("toxic") == 0) & (F.col("quality") == 1), 0).alias("domain"))


class Softmax:
    """Multinomial logistic regression on standardised inputs, by Newton-like descent.
    A domain without rows gets probability 0; without any rows all are alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, steps: int = 300, ridge: float = 1e-2):
        self.k, self.present = k, np.unique(y)
        if len(self.present) < 2:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        target = (y[:, None] == self.present[None, :]).astype(float)
        self.w = np.zeros((z.shape[1], len(self.present)))
        # Boehning's bound on the curvature gives a fixed, safe step
        bound = np.linalg.inv(0.5 * z.T @ z / len(z) + ridge * np.eye(z.shape[1]))
        for _ in range(steps):
            self.w -= bound @ (z.T @ (self._soft(z) - target) / len(z) + ridge * self.w)

    def _soft(self, z: np.ndarray) -> np.ndarray:
        a = z @ self.w
        e = np.exp(a - a.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.k))
        if not len(self.present):
            out[:] = 1.0 / self.k
        elif len(self.present) == 1:
            out[:, self.present[0]] = 1.0
        else:
            out[:, self.present] = self._soft(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]))
        return out


def _inputs(text: str, marks: list[frozenset]) -> list[float]:
    ws = words(text)
    kinds = set(ws)
    return statistics(text) + [float(np.log1p(len(kinds & m))) for m in marks]


def fit_domains(docs: DataFrame, labelled: DataFrame, k: int, sample: int = SAMPLE):
    """A function from a list of texts to their domain probabilities, learned from
    ``labelled`` (doc_id, domain) outside the held-out fifth."""
    rows = staged(labelled_sample(docs, labelled, "domain", sample), "domain-sample")
    marks = [frozenset(r.word.encode() for r in contrast_words(rows, d, WORDS).collect()) for d in range(k)]
    got = per_document(rows, lambda texts, y: [(_inputs(t, marks), int(c)) for t, c in zip(texts, y)],
                       "x array<double>, y int", ("text", "label")).collect()       # at most ``sample`` rows
    model = Softmax(np.array([r.x for r in got]), np.array([r.y for r in got], int), k)
    return lambda texts: model.predict(np.array([_inputs(t or "", marks) for t in texts])) if len(texts) else np.zeros((0, k))


def _cell(p: np.ndarray) -> np.ndarray:
    return np.round(p * GRID) / GRID


def rates(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Rates of documents with probabilities p under the domains' pulls."""
    return np.clip(1.0 - _cell(p) @ pull / STAY, 0.0, MOST)


def _sums(table: DataFrame, k: int, pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the pulls the domain totals (pull, domain) and their falling with
    each pull, times STAY (pull, domain, domain): one row from each task, added up."""
    def run(p, sums):
        cell, sums = np.array(p).reshape(-1, k), np.array(sums).reshape(-1, k)
        out = []
        for pull in pulls:
            r = rates(cell, pull)
            out += [r @ sums, (sums.T @ (cell * ((r > 0) & (r < MOST))[:, None])).ravel()]
        return [(np.concatenate(out).tolist(),)]
    parts = per_document(table, run, "s array<double>", ("cell", "sums"))
    row = parts.agg(*[F.sum(F.get("s", F.lit(i))) for i in range(len(pulls) * (k + k * k))]).first()
    got = np.array([x or 0.0 for x in row]).reshape(len(pulls), k + k * k)
    return got[:, :k], got[:, k:].reshape(-1, k, k)


def fit_rates(table: DataFrame, weights: list[float]) -> np.ndarray:
    """The domains' pulls from (tokens, p). Weights of domains without tokens go to the
    others in proportion."""
    k = len(weights)
    cells = staged(table.groupBy(F.transform("p", lambda x: F.round(x * GRID) / GRID).alias("cell")).agg(
        F.array(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(k)]).alias("sums")), "cells")
    pull = np.zeros(k)
    sums, falls = _sums(cells, k, pull[None])
    now, fall = sums[0], falls[0]
    total = now.sum()
    if not total:
        return pull
    goal = np.where(now > 0, weights, 0.0)
    goal = goal / goal.sum() * total if goal.sum() else now
    scale = np.where(goal > 0, goal, np.where(now > 0, now, total)) / total
    off = pull - (now - goal) / total
    best, idle = np.inf, 0
    while (worst := np.abs(off / scale).max()) > TOLERANCE and idle < STALL:
        best, idle = (worst, 0) if worst < best else (best, idle + 1)
        step = -np.linalg.solve(np.eye(k) + fall / (STAY * total), off)
        tried = pull + LENGTHS[:, None] * step
        sums, falls = _sums(cells, k, tried)
        offs = tried - (sums - goal) / total
        # what is minimised still falls (or hardly rises) at the end of the longest good step
        good = np.flatnonzero(offs @ step <= 0.01 * abs(off @ step))
        at = good[0] if len(good) else len(LENGTHS) - 1
        pull, off, fall = tried[at], offs[at], falls[at]
    if worst > TOLERANCE:
        warnings.warn(f"mixing: a domain's total is off its equation by {worst:.2g} of its target", stacklevel=2)
    return pull


def _columns(names: list[str], tokens: Column, p: Column, rate: Column, doc_id: Column) -> dict[str, Column]:
    toss = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = F.slice(p, 1, len(names))
    best = F.get(F.array(*map(F.lit, names)), (F.array_position(shares, F.array_max(shares)) - 1).cast("int"))
    return {"n_tokens": tokens.cast("long"), "domain": best, **{f"p_{n}": F.get(p, F.lit(i)) for i, n in enumerate(names)}, "rate": rate,
            "copies": (F.floor(rate) + F.when(toss < rate - F.floor(rate), 1).otherwise(0)).cast("long")}


def _fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]):
    """(classifier, (doc_id, tokens, p) of every document, pulls)."""
    predict = fit_domains(docs, labelled, len(weights))

    def run(ids, texts):
        return [(i, float(len((t or "").encode("utf-8", "replace").split())), p.tolist()) for i, t, p in zip(ids, texts, predict(texts))]
    table = staged(per_document(docs, run, f"doc_id {id_type(docs)}, tokens double, p array<double>"), "domains")
    return predict, table, fit_rates(table, list(weights.values()))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, domain, one probability p_<domain>
    for each, rate, copies. ``copies`` is the rate rounded up or down by a hash of the id,
    so that its mean is the rate. Null and empty texts have 0 tokens and count for
    nothing. Further columns are ignored."""
    weights = weights or DOMAINS
    _, table, pull = _fit(docs, label_domains(labels), weights)
    k = len(weights)

    def run(ids, tokens, p):
        return list(zip(ids, tokens, p, rates(np.array(p).reshape(-1, k), pull).tolist()))
    out = per_document(table, run, f"doc_id {id_type(docs)}, tokens double, p array<double>, rate double", ("doc_id", "tokens", "p"))
    cols = _columns(list(weights), F.col("tokens"), F.col("p"), F.col("rate"), F.col("doc_id"))
    return out.select("doc_id", *[c.alias(n) for n, c in cols.items()])


def draw(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` with at least one copy in the mixture, all columns, beside
    ``domain``, ``rate`` and ``copies`` (mix_... where such a name is taken)."""
    weights = weights or DOMAINS
    predict, _, pull = _fit(docs, label_domains(labels), weights)

    @F.pandas_udf("array<double>")
    def shares_and_rate(texts: pd.Series) -> pd.Series:
        p = predict(texts)
        return pd.Series(list(np.column_stack([p, rates(p, pull)])))
    # else Spark pushes the filter on copies below and scores every text twice, by two Python workers a task
    shares_and_rate = shares_and_rate.asNondeterministic()
    name = "_mix"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, shares_and_rate(F.col("text")))
    cols = _columns(list(weights), F.lit(0), F.col(name), F.get(name, F.lit(len(weights))), F.col("doc_id"))
    names = {n: f"mix_{n}" if n in docs.columns else n for n in ("domain", "rate", "copies")}
    out = out.select(*docs.columns, *[cols[n].alias(names[n]) for n in names])
    return out.filter(F.col(names["copies"]) > 0)
