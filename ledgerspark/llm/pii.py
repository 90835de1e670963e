"""Personal data by pattern, checksum and context (native: DataFrame functions only).

Regular expressions propose spans; validators confirm them (Luhn for payment
cards, mod-97 for bank account numbers, octet range for addresses, digit counts
for phone numbers); context words within the 40 characters before a span raise its
score. The four base kinds keep every validated span. ``iban`` and ``ssn`` are the
method's own: an account number needs mod-97, a social security number, which has
no checksum, needs context.

The patterns are written so that the search is linear: possessive repeats, and no
start inside a run whose start has already failed (``\\G`` lets a search go on
right after the previous match). Every row is handled on its own: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, clear_of, let, match_spans, piece, running, span_list

LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (cheap test, pattern, score, context words); order breaks ties of start.
KINDS = {
    "email": (r"@[A-Za-z0-9-]", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
              r"mail|contact|write"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|host|server|addr"),
    # base matches with fewer than 14 digits never pass, so 13 repeats are asked for at once
    "card": (r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9]){13,}+", 0.8,
             r"card|visa|credit|payment"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"phone|tel|call|mobile|fax"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
             0.9, r"iban|account|bank"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3,
            r"ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS, CONTEXT_GAIN, LEAST_SCORE = 40, 0.2, 0.5
SPANS = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(rev, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)
    rev = F.reverse(digits)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 check of an account number without spaces."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban) - 4), F.substring(iban, F.lit(1), F.lit(4)))

    def add(acc, c):
        v = F.ascii(c)
        return F.when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def _octet(part: Column) -> Column:
    value = F.regexp_replace(part, r"^0+(?=[0-9])", "")
    return F.when(F.length(value) <= 3, value.cast("int") <= 255).otherwise(False)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _octet)
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "iban":
        return let(F.regexp_replace(hit, " ", ""), lambda s: F.when(F.length(s).between(15, 34), mod97(s)).otherwise(False))
    return F.lit(True)


def _scored(text: Column, kind: str) -> Column:
    test, pattern, score, context = KINDS[kind]
    order = F.lit(list(KINDS).index(kind))

    def span(s, chunks):
        near = F.lower(piece(chunks, F.greatest(F.lit(0), s["start"] - CONTEXT_CHARS), s["start"])).rlike(context)
        return F.struct(s["start"].alias("start"), order.alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                        F.least(F.lit(1.0), F.lit(score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"))

    valid = F.filter(match_spans(text, pattern), lambda s: _valid(kind, s["hit"]))
    ok = let(chunked(text), lambda chunks: F.transform(valid, lambda s: span(s, chunks)))
    if kind not in BASE:
        ok = F.filter(ok, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(test), ok).otherwise(F.expr(f"cast(array() as {SPANS})"))


def pii_spans(text: Column) -> tuple[Column, Column]:
    """(validated base spans, the method's further spans); the latter overlap no
    base span."""
    base = F.concat(*[_scored(text, k) for k in BASE])
    return base, F.concat(*[_scored(text, k) for k in KINDS if k not in BASE])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), base and spans: arrays of struct(start, ord, end,
    kind, score) by start, then kind. One row per input row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base, more = pii_spans(F.col("text"))
    d = d.select("doc_id", "text", F.array_sort(base).alias("base"), more.alias("more"))
    return d.select("doc_id", "text", "base",
                    F.array_sort(F.concat("base", clear_of(F.col("more"), F.col("base")))).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans and
    all spans as text. Null and empty texts have none."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find_pii(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by <KIND>; of overlapping spans the first
    names the replacement and all their characters go."""
    reach = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

    def rebuilt(chunks):
        # the tail of a span that overlaps an earlier one is dropped without a mark
        parts = F.zip_with(spans, reach, lambda s, at: F.when(s["start"] >= at, F.concat(
            piece(chunks, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(chunks, last, F.char_length(text)))

    return let(chunked(text), rebuilt)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, with all personal data in ``text`` replaced; ``n_chars``,
    where there is one, follows. A null text stays null."""
    base, more = pii_spans(F.col("text"))
    name = "_pii_spans"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, F.when(F.col("text").isNotNull(), F.array_sort(F.concat(base, more))))
    out = out.withColumn("text", F.when(F.size(name) > 0, redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
