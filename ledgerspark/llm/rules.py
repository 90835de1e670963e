"""Quality rules with risk-controlled cutoffs (native: DataFrame functions only).

Each rule is a statistic of the text that is large for bad documents. Documents
fall into four fixed strata by length. Labelled holdout documents (quality 1) fix
each rule's cutoff per stratum: of a fixed grid, the lowest cutoff for which an exact
binomial test shows a false-rejection rate of at most ``RISK / rules``: with n good
documents and k of them rejected, P(Binomial(n, rate) <= k) <= level. The level is
``LEVEL`` divided by all rules, strata and cutoffs tested (Bonferroni), so with
probability 1 - LEVEL at least every chosen cutoff keeps its promise, and the rules
together reject at most ``RISK`` of a stratum's good documents. A rule for which no
cutoff can be shown safe (few labels) rejects nothing in that stratum.

The documents are read once for the labelled counts and once for the verdicts; only
(stratum, rule, cutoff) counts and the four rows of cutoffs move between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BREAK, let, split_words, staged

RUN = 8                                    # words of a repeated window, fixed by the contract
SYMBOLS = r"[#*$%&|<>]+"
RISK, LEVEL = 0.03, 0.05
STRATA = [50, 200, 1000]                   # words; four strata
GRID = [0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.14, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RULES = ["symbols", "dup_lines", "repeats", "few_kinds", "shout"]


def _repeated_words(ws: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more. Windows are
    compared by 64-bit hash; only texts with a repeated window are sorted."""
    def cover(h):
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s):
            n = F.size(s)
            twin = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (
                (j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])) | (
                (j < n - 1) & F.coalesce(F.get(s, j + 1)["h"] == F.get(s, j)["h"], F.lit(False))))
            return F.array_sort(F.transform(twin, lambda j: F.get(s, j)["i"]))

        def covered(at):
            gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(RUN), F.coalesce(b - a, F.lit(RUN))))
            return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
        return let(let(order, starts), covered)

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - RUN),
                                    lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(RUN)]))
    return F.when(F.size(ws) > RUN, let(let(hashes, windows), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), cover(h)).otherwise(0))).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, the stratum (0 to 3) and one share
    (0 to 1) per rule. Null and empty texts count 0 everywhere and fail the base."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), split_words(text, SPACE_BREAK).alias("ws"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", F.size("ws").cast("long").alias("n_words"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                                      F.size(x).alias("all"))).alias("lines"),
        _repeated_words(F.col("ws")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("ws")).alias("kinds"),
        F.char_length(F.regexp_replace("text", r"[^A-Z!]+", "")).alias("loud"))
    n = F.greatest(F.lit(1.0), F.col("n_words").cast("double"))
    chars = F.greatest(F.lit(1.0), F.col("word_chars").cast("double"))
    share = {
        "symbols": F.col("n_symbols") / chars, "dup_lines": F.col("lines.dup") / F.greatest(F.lit(1.0), F.col("lines.all").cast("double")),
        "repeats": F.col("n_repeat_words") / n,
        # distinct words fall with length: against the square root, as a share of the words
        "few_kinds": F.greatest(F.lit(0.0), 1.0 - F.col("kinds") / F.least(n, 4.0 * F.sqrt(n))),
        "shout": F.col("loud") / chars}
    stratum = F.lit(0)
    for edge in STRATA:
        stratum = stratum + F.when(F.col("n_words") >= edge, 1).otherwise(0)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words",
                    ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
                    stratum.alias("stratum"), *[share[r].alias(f"r_{r}") for r in RULES])


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms."""
    first = n * F.log(F.lit(1.0 - p))
    odds = F.log(F.lit(p / (1.0 - p)))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1.0) / i) + odds
        high = F.greatest(acc["total"], term)
        total = high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))
        return F.struct(term.alias("term"), total.alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: F.exp(acc["total"]))


def safe_cutoffs(good: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, and per rule the chosen cutoff (null: none is safe), from the
    measured good documents. At most four rows."""
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).cast("double").alias("n"), *[
        F.count_if(F.col(f"r_{r}") > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)])
    tests = len(RULES) * (len(STRATA) + 1) * len(GRID)
    rate = risk / len(RULES)

    def lowest(rule):
        # testing stops being needed beyond n * rate: more rejections than that never pass
        safe = [F.when((F.col(f"{rule}_{i}") <= F.col("n") * rate) & (
            binomial_cdf(F.col(f"{rule}_{i}"), F.col("n"), rate) <= level / tests), F.lit(c)) for i, c in enumerate(GRID)]
        return F.coalesce(*safe)
    return counts.select(F.col("stratum").alias("_stratum"), "n", *[lowest(r).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed and kept, plus the
    rules that rejected it. Labels are read only where quality is 1; a document with
    several labels counts once if any is 1."""
    m = staged(measure(docs), "rules")
    lab = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    cuts = safe_cutoffs(m.filter(~F.col("base_failed")).join(lab, F.col("doc_id") == F.col("_id"), "left_semi"))
    d = m.join(F.broadcast(cuts), F.col("stratum") == F.col("_stratum"), "left")   # four rows at most
    broken = F.filter(F.array(*[F.when(F.col(f"r_{r}") > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"),
                    F.array_join(broken, ",").alias("broken_rules"))
