"""Secrets by pattern and by randomness (native: DataFrame functions only).

Base patterns find assignments, access keys and long hexadecimal runs. The method
adds other tokens (kind ``random``) that look like key material:

* the token's encoding is inferred from its characters (a token without a letter is no
  secret);
* a battery tests uniform randomness over that alphabet: chi-squared of the symbol
  counts (Wilson-Hilferty), runs above and below the middle of the alphabet, and
  lag-1 serial correlation. The three two-sided p-values are combined by Fisher's
  method; a token that the battery rejects at ``BATTERY_P`` is no random string;
* the evidence against running text is the likelihood ratio of the uniform alphabet
  to a fixed text model, which reads words of capitals alone as if they were small.
  Its reciprocal bounds a p-value (Markov), so short tokens
  need more surprising characters than long ones. Benjamini-Hochberg over the
  document's tokens then controls false discoveries at ``FDR``.

Every row is handled on its own: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, clear_of, let, match_spans, span_list

#: kind -> (cheap test, pattern). Equal to the contract's patterns with their length rules.
BASE = {
    "assign": (r"(?i)passw|secret|token|api_?key",
               r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]++)"""),
    "access": (r"AKIA", r"AKIA[A-Z0-9]{16,}+"),
    "hex": (r"[0-9a-f]{24}", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
}
#: Padding belongs to a token only at its end, so that '=' after a name starts a new one.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?+"
TOKEN_TEST = r"[A-Za-z0-9+/_-]{20}"
LEAST_ASSIGNED = 6
BATTERY_P = 1e-3
FDR = 1e-3

DIGITS = "0123456789"
#: encoding -> (test of the token without padding, alphabet); the first that fits holds.
ENCODINGS = [
    ("hex", "[0-9a-f]+", DIGITS + "abcdef"), ("HEX", "[0-9A-F]+", DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+", UPPER + "234567"), ("base36", "[0-9a-z]+", DIGITS + LOWER),
    ("BASE36", "[0-9A-Z]+", DIGITS + UPPER), ("base62", "[0-9A-Za-z]+", UPPER + LOWER + DIGITS),
    ("base64", "[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"), ("url64", ".+", UPPER + LOWER + DIGITS + "-_+/"),
]
#: The text model: share of a character class in running text / number of its characters.
TEXT_MODEL = [("[aeiou]", 0.40 / 5), ("[nrtslhd]", 0.34 / 7), ("[bcfgjkmpqvwxyz]", 0.16 / 14),
              ("[A-Z]", 0.05 / 26), ("[0-9]", 0.03 / 10), ("[+/_-]", 0.02 / 4)]
SPANS = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def _pick(values: list, token: Column) -> Column:
    """The literal of the first encoding that fits the token."""
    out = F.lit(values[-1])
    for (_, test, _), v in list(zip(ENCODINGS, values))[-2::-1]:
        out = F.when(token.rlike(f"^{test}$"), F.lit(v)).otherwise(out)
    return out


def encoding(token: Column) -> Column:
    return _pick([e[0] for e in ENCODINGS], F.regexp_replace(token, "=+$", ""))


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|), by the rational approximation 7.1.26 of the error function."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def chi_squared_z(codes: Column, k: Column) -> Column:
    """Normal score of the chi-squared statistic of the symbol counts."""
    n = F.size(codes).cast("double")
    squares = _sum(F.transform(F.array_distinct(codes), lambda v: F.pow(
        F.size(F.filter(codes, lambda c: c == v)).cast("double"), 2.0)))
    df = k.cast("double") - 1.0
    chi2 = F.greatest(F.lit(0.0), k / n * squares - n)
    return (F.pow(chi2 / df, 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))


def _pairs(codes: Column) -> Column:
    n = F.size(codes)
    return F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def runs_z(codes: Column, k: Column) -> Column:
    """Wald-Wolfowitz runs above and below the middle of the alphabet."""
    def score(high):
        n = F.size(high).cast("double")
        n1 = F.size(F.filter(high, lambda x: x)).cast("double")
        runs = 1.0 + F.size(F.filter(_pairs(high), lambda p: p["a"] != p["b"]))
        mean = 2.0 * n1 * (n - n1) / n + 1.0
        # all on one side: as far out as n coin tosses can be
        return F.when(mean > 2.0, (runs - mean) / F.sqrt((mean - 1.0) * (mean - 2.0) / (n - 1.0))).otherwise(F.sqrt(n))
    return let(F.transform(codes, lambda c: c * 2 >= k), score)


def serial_z(codes: Column) -> Column:
    """Lag-1 serial correlation of the symbol indexes."""
    def score(x):
        n = F.size(x).cast("double")
        var = _sum(F.transform(x, lambda v: v * v))
        r = _sum(F.transform(_pairs(x), lambda p: p["a"] * p["b"])) / var
        return F.when(var > 0, (r + 1.0 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    mean = lambda c: _sum(F.transform(c, lambda v: v.cast("double"))) / F.size(c)
    return let(codes, lambda c: let(mean(c), lambda m: let(F.transform(c, lambda v: v.cast("double") - m), score)))


def battery_p(token: Column) -> Column:
    """Fisher's combination of the three tests: small for a string that is not
    uniformly random over its alphabet."""
    def run(body, alphabet):
        codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1)
        k = F.length(alphabet)
        return let(codes, lambda c: let(
            -(F.log(two_sided(chi_squared_z(c, k))) + F.log(two_sided(runs_z(c, k))) + F.log(two_sided(serial_z(c)))),
            lambda half: F.exp(-half) * (1.0 + half + half * half / 2.0)))
    return let(F.regexp_replace(token, "=+$", ""), lambda body: let(
        _pick([e[2] for e in ENCODINGS], body), lambda alphabet: run(body, alphabet)))


def text_p(token: Column) -> Column:
    """Bound on the p-value of the token under the text model."""
    def bound(body):
        size = F.log(F.length(_pick([e[2] for e in ENCODINGS], body)).cast("double"))
        log_ratio = F.lit(0.0)
        for chars, share in TEXT_MODEL:
            n = F.length(body) - F.length(F.regexp_replace(body, chars, ""))
            log_ratio = log_ratio + n * (-size - F.log(F.lit(share)))
        return F.exp(-F.greatest(F.lit(0.0), log_ratio))
    def cased(body):
        # capitals without small letters and digits: a heading or a constant's name in text
        return F.when(body.rlike("[a-z0-9]"), body).otherwise(F.lower(body))
    return let(F.regexp_replace(token, "=+$", ""), lambda body: let(cased(body), bound))


def _base(text: Column, kind: str) -> Column:
    test, pattern = BASE[kind]
    hits = match_spans(text, pattern)
    if kind == "assign":
        hits = F.filter(hits, lambda s: F.length(F.regexp_extract(s["hit"], pattern, 1)) >= LEAST_ASSIGNED)
    spans = F.transform(hits, lambda s: F.struct(
        s["start"].alias("start"), F.lit(list(BASE).index(kind)).alias("ord"), s["end"].alias("end"),
        F.lit(kind).alias("kind"), F.lit(1.0).alias("score")))
    return F.when(text.rlike(test), spans).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _random(text: Column, base: Column) -> Column:
    """Tokens outside the base spans that pass the battery and, within their
    document, the false-discovery control."""
    lettered = F.filter(match_spans(text, TOKEN), lambda s: s["hit"].rlike("[A-Za-z]"))
    free = let(lettered, lambda spans: clear_of(spans, base))
    tested = F.transform(free, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), text_p(s["hit"]).alias("p"), battery_p(s["hit"]).alias("battery")))

    def control(t):
        ps = F.array_sort(F.transform(t, lambda s: s["p"]))
        steps = F.transform(ps, lambda p, i: F.when(p <= FDR * (i + 1) / F.size(ps), p))
        cut = F.coalesce(F.array_max(steps), F.lit(-1.0))
        return let(cut, lambda c: F.transform(
            F.filter(t, lambda s: (s["p"] <= c) & (s["battery"] >= BATTERY_P)),
            lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("ord"), s["end"].alias("end"),
                               F.lit("random").alias("kind"), (1.0 - s["p"]).alias("score"))))
    return F.when(text.rlike(TOKEN_TEST), let(tested, control)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), base and spans: arrays of struct(start, ord, end,
    kind, score) by start, then kind. One row per input row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.array_sort(F.concat(*[_base(F.col("text"), k) for k in BASE])).alias("base"))
    return d.select("doc_id", "text", "base", F.array_sort(F.concat(
        "base", let(F.col("base"), lambda b: _random(F.col("text"), b)))).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans and
    all spans as text. Null and empty texts have none."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
