"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with words of the learned lexicon is
toxic with probability sigmoid(bias + sum of its words' weights); a document is toxic
if a sentence is, or by a leak (which takes up label noise): noisy-or,
1 - (1 - leak) * product of (1 - p). Weights, bias and leak are learned from document
labels alone by gradient ascent on the likelihood; sentences over one half are the
located offences. The lexicon is the words that stand out in distinct sentences of
toxic documents. The fit takes at most ``SAMPLE`` labelled rows; every document is
scored in one pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_type, labelled_sample, per_document, staged
from .features import contrast_words, words

SAMPLE = 20_000
LEXICON = 500
STEPS, RATE, DECAY = 400, 0.05, 1e-4
CUTOFF = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")


def instances(text: str, lexicon: dict[bytes, int]) -> list[tuple[int, int, list[int]]]:
    """(start, end, lexicon ids) of the sentences that have lexicon words."""
    if lexicon.keys().isdisjoint(words(text)):
        return []
    out = []
    for m in SENTENCE.finditer(text):
        if ids := sorted({lexicon[w] for w in words(m[0]) if w in lexicon}):
            out.append((m.start(), m.end(), ids))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class NoisyOr:
    """Without labelled rows, or with one class only, no word is known and each score
    is the leak: the share of label 1, at most 0.49."""

    def __init__(self, lexicon: list[str], bags: list[list[list[int]]], y: np.ndarray):
        self.lexicon = {w.encode(): i for i, w in enumerate(lexicon)}
        full = [i for i, bag in enumerate(bags) if bag]
        none = np.array([not bag for bag in bags], bool)
        self.leak = min(0.49, (y[none].sum() + 0.5) / (none.sum() + 1.0))
        self.weights, self.bias = np.full(len(lexicon), 2.0), 0.0
        if not full:
            return
        sentence = [(d, s) for d, i in enumerate(full) for s in bags[i]]
        doc = np.array([d for d, _ in sentence])
        at = np.repeat(np.arange(len(sentence)), [len(s) for _, s in sentence])
        ids = np.concatenate([s for _, s in sentence]).astype(int)
        label, moment, scale = y[full], 0.0, 0.0
        theta = np.append(self.weights, self.bias)
        for t in range(1, STEPS + 1):
            p = _sigmoid(theta[-1] + np.bincount(at, theta[ids], len(sentence)))
            clean = np.log1p(-self.leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(full))
            toxic = -np.expm1(clean)
            # d logL / d logit of a sentence
            g = np.where(label[doc] == 1, p * np.exp(clean)[doc] / np.maximum(toxic[doc], 1e-9), -p)
            grad = np.append(np.bincount(ids, g[at], len(lexicon)), g.sum()) / len(full) - DECAY * theta
            moment, scale = 0.9 * moment + 0.1 * grad, 0.999 * scale + 0.001 * grad ** 2
            theta = theta + RATE * (moment / (1 - 0.9 ** t)) / (np.sqrt(scale / (1 - 0.999 ** t)) + 1e-8)
        self.weights, self.bias = theta[:-1], theta[-1]

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """(probability, spans of offending sentences in code points)."""
        stay, bad = 1.0 - self.leak, []
        for start, end, ids in instances(text, self.lexicon):
            p = float(_sigmoid(self.bias + self.weights[ids].sum()))
            stay *= 1.0 - p
            if p >= CUTOFF:
                bad.append((start, end))
        return 1.0 - stay, bad


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NoisyOr:
    rows = staged(labelled_sample(docs, labels, "toxic", sample), "toxic-sample")
    lexicon = [r.word for r in contrast_words(rows, 1, LEXICON).collect()]      # at most LEXICON words
    index = {w.encode(): i for i, w in enumerate(lexicon)}
    bags = per_document(rows, lambda texts, y: [([ids for _, _, ids in instances(t, index)], int(c)) for t, c in zip(texts, y)],
                        "bag array<array<int>>, y int", ("text", "label")).collect()   # lexicon words of the sample only
    return NoisyOr(lexicon, [r.bag for r in bags], np.array([r.y for r in bags], int))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted and offending
    (start:end of the offending sentences, comma-joined). Null and empty texts have
    no sentence; their score is the leak."""
    model = fit(docs, labels)

    def run(ids, texts):
        out = []
        for i, t in zip(ids, texts):
            p, bad = model.score(t or "")
            out.append((i, float(p), ",".join(f"{a}:{b}" for a, b in bad)))
        return out
    return per_document(docs, run, f"doc_id {id_type(docs)}, score double, offending string").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "offending")
