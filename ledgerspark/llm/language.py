"""Language identification by interpolated Kneser-Ney character models.

Every learned language has a character model of order 4: counts of all runs of four
characters in the training documents (letters; everything else is one blank), absolute
discounting, and continuation counts below the top order. The models live in sorted
arrays of packed runs with one column per language, looked up by binary search; a run
unknown to all languages backs off. A text gets the language of the lowest cross-entropy
per character; ``rejected`` marks texts whose cross-entropy lies beyond the range of
their language, which all of its training documents fix. Counting covers all training documents: each task sums its
own runs before the shuffle, and every counted run is kept. Where there are more than
``SLICE_RUNS``, the model is cut into slices by the last letter but one, which all orders
but the lowest share with their contexts; the lowest, a row per letter, is in each slice.
A text's log-likelihood is the sum of those that the slices give to their own runs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import at_ranks, value_counts
from .common import held_out, id_type, per_document, staged

ORDER, DISCOUNT = 4, 0.75
SLICE_RUNS = 2_000_000         # runs of all languages in a slice of the model, unless one letter has more
REJECT_SHARE = 0.001           # of a language's training documents, beyond its rejection range
UNKNOWN = "und"
MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER)]

_letters: list[np.ndarray] = []


def characters(text: str) -> np.ndarray:
    """Letters in lower case as 16-bit codes, runs of anything else as one 0, with a
    0 before and after; empty if there is no letter. Letters beyond the basic plane
    share the codes of their low 16 bits."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where(_letters[0][code], np.maximum(code & 0xFFFF, 1), 0).astype(np.uint64)
    if not a.any():
        return a[:0]
    a = np.concatenate([[np.uint64(0)], a, [np.uint64(0)]])
    return a[np.append(True, (a[1:] != 0) | (a[:-1] != 0))]


def runs(text: str) -> np.ndarray:
    """Packed runs of four characters, one for each character after the first blank."""
    a = characters(text)
    if not len(a):
        return a
    pad = np.concatenate([np.zeros(ORDER - 2, np.uint64), a])
    n = len(a) - 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | pad[k:k + n]
    return out


def count_runs(docs: DataFrame) -> DataFrame:
    """(lang, run, n) over documents with a language outside the held-out fifth."""
    def tally(langs, texts):
        by = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(runs(text))
        out = []
        for lang, parts in by.items():
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            out += zip([lang] * len(values), values.view(np.int64).tolist(), n.tolist())
        return out
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    return (per_document(train, tally, "lang string, run bigint, n bigint", ("lang", "text"))
            .groupBy("lang", "run").agg(F.sum("n").alias("n")))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _taken(values: np.ndarray, at: np.ndarray, known: np.ndarray, other: float) -> np.ndarray:
    return np.where(known, values[at], other) if len(values) else np.full(len(at), other)


class _Level:
    """One order of one language: sorted runs with discounted shares, sorted contexts
    with the mass left to the next order."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, n = codes[order], n[order].astype(float)
        self.contexts, first = np.unique(self.codes >> np.uint64(16), return_index=True)
        total = np.add.reduceat(n, first) if len(n) else n
        kinds = np.diff(np.append(first, len(n)))
        self.share = np.maximum(n - DISCOUNT, 0) / np.repeat(total, kinds)
        self.left = DISCOUNT * kinds / total


class LanguageModel:
    """Tables over all languages. Without training runs nothing can be predicted. A slice
    gets the runs of some letters, and of the whole the lowest order: (letters, numbers
    of kinds of letters before them) by language."""

    def __init__(self, lang: np.ndarray, run: np.ndarray, n: np.ndarray,
                 lowest: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        self.langs = sorted(set(lang.tolist()) if lowest is None else lowest)
        self.limits: dict[str, tuple[float, float]] = {}
        self.tables = []
        if not self.langs:
            return
        levels = []
        for name in self.langs:
            own, codes = [], run[lang == name]
            counts = n[lang == name]
            for k in range(ORDER, 0, -1):
                if k == 1 and lowest is not None:
                    codes, counts = lowest[name]
                own.append(_Level(codes, counts))
                codes, counts = np.unique(codes & MASK[k - 1], return_counts=True)   # continuation counts
            levels.append(own)
        alphabet = max(len(own[-1].codes) for own in levels) + 1
        for k in range(ORDER):
            keys = np.unique(np.concatenate([own[k].codes for own in levels]))
            contexts = np.unique(np.concatenate([own[k].contexts for own in levels]))
            logp = np.column_stack([np.log(self._prob(own, k, keys, alphabet)) for own in levels]).astype(np.float32)
            left = np.column_stack([np.log(self._left(own[k], contexts)) for own in levels]).astype(np.float32)
            self.tables.append((keys, logp, contexts, left))
        self.floor = np.float32(-np.log(alphabet))

    @staticmethod
    def _left(level: _Level, contexts: np.ndarray) -> np.ndarray:
        at, known = _find(level.contexts, contexts)
        return _taken(level.left, at, known, 1.0)

    @classmethod
    def _prob(cls, own: list[_Level], k: int, codes: np.ndarray, alphabet: int) -> np.ndarray:
        if k == ORDER:
            return np.full(len(codes), 1.0 / alphabet)
        at, known = _find(own[k].codes, codes)
        low = cls._prob(own, k + 1, codes & MASK[ORDER - 1 - k], alphabet)
        return _taken(own[k].share, at, known, 0.0) + cls._left(own[k], codes >> np.uint64(16)) * low

    def log_probabilities(self, codes: np.ndarray, k: int = 0) -> np.ndarray:
        """(run, language): natural logarithms; runs no language knows back off."""
        if k == ORDER:
            return np.full((len(codes), len(self.langs)), self.floor, np.float32)
        keys, logp, contexts, left = self.tables[k]
        at, known = _find(keys, codes)
        out = logp[at] if len(keys) else np.zeros((len(codes), len(self.langs)), np.float32)
        if not known.all():
            miss = codes[~known]
            c, there = _find(contexts, miss >> np.uint64(16))
            out[~known] = (np.where(there[:, None], left[c], 0) if len(contexts) else 0) + self.log_probabilities(miss & MASK[ORDER - 1 - k], k + 1)
        return out

    def cross_entropy(self, text: str | None) -> tuple[np.ndarray, int]:
        codes = runs(text or "") if self.langs else np.zeros(0, np.uint64)
        if not len(codes):
            return np.zeros(0), 0
        return -self.log_probabilities(codes).mean(0, dtype=float), len(codes)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, share of its likelihood at the root of the length, cross-entropy, rejected)."""
        return self.decide(*self.cross_entropy(text))

    def decide(self, h: np.ndarray, n: int) -> tuple[str, float, float, bool]:
        if not n:
            return UNKNOWN, 0.0, 0.0, True
        best = int(h.argmin())
        score = 1.0 / np.exp((h[best] - h) * n ** 0.5).sum()
        mean, most = self.limits.get(self.langs[best], (0.0, np.inf))
        return self.langs[best], float(score), float(h[best]), bool((h[best] - mean) * min(n, 400) ** 0.5 > most)


class SlicedModel(LanguageModel):
    """The whole of a model in slices: languages and limits, the letters of each slice,
    and the counts that the slices are built from, one at a time."""

    def __init__(self, counts: DataFrame, slices: list[list[int]], lowest: dict):
        self.langs, self.limits = sorted(lowest), {}
        self.counts, self.slices, self.lowest = counts, slices, lowest

    def cross_entropies(self, docs: DataFrame) -> DataFrame:
        """(key, h, n) of the distinct texts with a letter: sums over the slices' own runs."""
        parts = None
        texts = staged(docs.filter("text is not null").select("text").distinct(), "language-texts")
        for k, letters in enumerate(self.slices):
            model = LanguageModel(*_arrays(self.counts.filter(_before_last().isin(letters))), self.lowest)
            # the first slice also takes runs whose letter no slice has
            some = np.array(letters if k else sum(self.slices[1:], []), np.uint64)

            def score(texts, model=model, some=some, own=bool(k)):
                for text in texts:
                    codes = runs(text)
                    codes = codes[np.isin((codes >> np.uint64(16)) & MASK[1], some) == own]
                    if len(codes):
                        yield text, (-model.log_probabilities(codes).sum(0, dtype=float)).tolist(), len(codes)
            got = staged(per_document(texts, score, "text string, h array<double>, n long", ("text",)).select(
                F.sha2("text", 256).alias("key"), "h", "n"), "language-part")      # the model is gone before the next
            parts = got if parts is None else parts.unionByName(got)
        sums = parts.groupBy("key").agg(F.sum("n").alias("n"), F.array(
            *[F.sum(F.get("h", F.lit(i))) for i in range(len(self.langs))]).alias("h"))
        return sums.select("key", F.transform("h", lambda x: x / F.col("n")).alias("h"), "n")

    def scored(self, docs: DataFrame, *cols: str) -> DataFrame:
        """The columns of every row of docs, with h and n; null where no letter is."""
        rows = docs.select(*cols, F.sha2("text", 256).alias("key"))
        return rows.join(self.cross_entropies(docs), "key", "left").select(*cols, "h", "n")


def _before_last():
    return F.shiftrightunsigned("run", 16).bitwiseAND(F.lit(0xFFFF))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = counts.select("lang", "run", "n").toArrow()
    return np.array(got["lang"].to_pylist(), object), got["run"].to_numpy().view(np.uint64), got["n"].to_numpy()


def _slices(counts: DataFrame) -> list[list[int]]:
    """Letters in groups of at most ``SLICE_RUNS`` runs, or of one letter."""
    out, room = [], -1
    for letter, n in counts.groupBy(_before_last().alias("c")).count().orderBy("c").collect():     # a row per letter
        if n > room:
            out.append([])
            room = SLICE_RUNS
        out[-1].append(letter)
        room -= n
    return out


def _count_model(docs: DataFrame) -> LanguageModel:
    counts = staged(count_runs(docs), "language-runs")
    if counts.count() <= SLICE_RUNS:
        return LanguageModel(*_arrays(counts))
    pairs = counts.select("lang", F.col("run").bitwiseAND(F.lit(0xFFFF)).alias("c"), _before_last().alias("b")).distinct()
    lowest = {}
    for lang, c, n in pairs.groupBy("lang", "c").count().orderBy("lang", "c").collect():            # a row per letter and language
        lowest.setdefault(lang, ([], []))
        lowest[lang][0].append(c)
        lowest[lang][1].append(n)
    return SlicedModel(counts, _slices(counts), {k: (np.array(c, np.uint64), np.array(n)) for k, (c, n) in lowest.items()})


def _scored(model: LanguageModel, docs: DataFrame) -> DataFrame:
    """(doc_id, lang, h, n) of every row of docs, written once: cross-entropies in the
    order of the languages, and the length; nothing or null where no letter is."""
    if isinstance(model, SlicedModel):
        return staged(model.scored(docs, "doc_id", "lang"), "language-scores")

    def score(ids, langs, texts):
        for i, lang, text in zip(ids, langs, texts):
            h, n = model.cross_entropy(text)
            yield i, lang, h.tolist(), n
    return staged(per_document(docs, score, f"doc_id {id_type(docs)}, lang string, h array<double>, n long",
                               ("doc_id", "lang", "text")), "language-scores")


def _limits(langs: list[str], scored: DataFrame) -> dict[str, tuple[float, float]]:
    """For each language the mean cross-entropy of all its training documents, and the
    exact quantile of their deviations from it, weighted as in ``decide``."""
    if not langs:
        return {}
    own = F.get("h", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1)
    rows = scored.filter(F.col("lang").isin(langs) & ~held_out(F.col("doc_id")) & (F.col("n") > 0)).select("lang", own.alias("h"), "n")
    # decimal sums are the same in any order of the rows
    means = rows.groupBy("lang").agg(F.avg(F.col("h").cast("decimal(20,12)")).cast("double").alias("mean"), F.count(F.lit(1)).alias("rows"))
    mean = {r.lang: (r.mean, r.rows) for r in means.collect()}                                       # a row per language
    if not mean:
        return {}
    center = F.create_map(*[F.lit(x) for lang, (m, _) in mean.items() for x in (lang, m)])
    apart = rows.select("lang", ((F.col("h") - center[F.col("lang")]) * F.sqrt(F.least("n", F.lit(400)))).alias("apart"))
    counts = value_counts(apart, ["lang"], "apart", lambda v: F.floor(v * 64))
    at = (F.col("tot") - 1) * (1 - REJECT_SHARE)
    ends = at_ranks(counts, ["lang"], "apart", {"lo": F.floor(at), "hi": F.ceil(at)})
    out = {}
    for r in ends.collect():                                                                         # a row per language
        m, n = mean[r.lang]
        out[r.lang] = (m, r.lo + (r.hi - r.lo) * ((n - 1) * (1 - REJECT_SHARE) % 1))
    return out


def fit(docs: DataFrame) -> LanguageModel:
    model = _count_model(docs)
    train = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    model.limits = _limits(model.langs, _scored(model, train))
    return model


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy,
    rejected. Null texts and texts without a letter are ``und`` with score 0, and so is
    every text when no training document has a language. Every text is scored once, for
    the rejection ranges and the predictions."""
    model = _count_model(docs)
    scored = _scored(model, docs)
    whole = LanguageModel(np.array([], object), np.array([], np.uint64), np.array([], int))          # langs and limits only
    whole.langs, whole.limits = model.langs, _limits(model.langs, scored)
    fields = f"doc_id {id_type(docs)}, lang_pred string, score double, cross_entropy double, rejected boolean"
    out = per_document(scored, lambda ids, hs, ns: [
        (i, *whole.decide(np.array(h or []), n or 0)) for i, h, n in zip(ids, hs, ns)], fields, ("doc_id", "h", "n"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
