"""Document statistics and label-contrasting words, shared by the learned operators."""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BREAK, ascii_lower, split_words

NAMES = ["size", "upper", "digit", "space", "newline", "stop", "pipe", "symbol", "bang", "punct", "wide",
         "word_size", "kinds", "stutter", "top_word", "dup_lines", "sentence"]


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_GROUPS = [np.arange(65, 91), np.arange(48, 58), _bytes(" \t\r\n"), _bytes("\n"), _bytes(".,;:"), _bytes("|"),
           _bytes("#*$%&<>~^"), _bytes("!?"), _bytes("\"'()[]{}/\\=+-_@`"), np.arange(128, 256)]
#: Bytes that separate words of lower-cased text: ASCII other than a-z and 0-9.
BLANKS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The lower-cased words of letters and digits; lone surrogates become '?'."""
    return text.encode("utf-8", "replace").lower().translate(BLANKS).split()


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, all finite, also for ''."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [float(np.sqrt(count[g].sum() / n)) for g in _GROUPS]
    ws = raw.split()
    nw = max(1, len(ws))
    tally = Counter(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [float(np.log1p(len(raw))), *shares, float(np.log(n / nw)),
            float(np.log((1 + len(tally)) / (1 + min(nw, 4 * nw ** 0.5)))),
            float(np.sqrt(sum(map(operator.eq, ws, ws[1:])) / nw)),
            float(np.sqrt(max(tally.values(), default=0) / nw)),
            float(np.sqrt((len(lines) - len(set(lines))) / max(1, len(lines)))),
            float(np.log1p(nw / (1 + count[46] + count[33] + count[63])))]


def contrast_words(sample: DataFrame, value, most: int, least_z: float = 5.0) -> DataFrame:
    """(word, z): words that stand in more of the distinct sentences of documents
    labelled ``value`` than of the others, by a two-proportion score. Counting
    distinct sentences keeps groups of copies from making words of their own."""
    s = (sample.select((F.col("label") == value).alias("hit"),
                       F.explode(F.split(ascii_lower(F.col("text")), r"[.!?\n]+")).alias("sentence"))
         .filter("sentence <> ''").groupBy(F.xxhash64("sentence").alias("s"), "hit").agg(F.first("sentence").alias("sentence")))
    total = s.agg(F.count_if("hit").alias("n1"), F.count_if(~F.col("hit")).alias("n0"))
    w = (s.select("hit", F.explode(F.array_distinct(split_words(F.col("sentence"), ALNUM_BREAK))).alias("word"))
         .groupBy("word").agg(F.count_if("hit").alias("k1"), F.count_if(~F.col("hit")).alias("k0")).filter("k1 >= 5"))
    # ``total`` is one row
    w = w.join(F.broadcast(total), F.lit(True)).filter("n1 > 0 and n0 > 0")
    pool = (F.col("k1") + F.col("k0")) / (F.col("n1") + F.col("n0"))
    gap = F.col("k1") / F.col("n1") - (F.col("k0") + 0.5) / F.col("n0")
    z = gap / F.sqrt(pool * (1.0 - pool) * (1.0 / F.col("n1") + 1.0 / F.col("n0")) + 1e-12)
    return w.select("word", z.alias("z")).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(most)
