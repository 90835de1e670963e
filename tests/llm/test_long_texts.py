"""Texts with very many matches: same results as the plain rule, time in proportion."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerspark.llm import licenses, pii
from ledgerspark.llm.common import CHUNK, chunked, clear_of, match_spans, piece, running


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{n} {t}" for n, (_, t) in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_running_combines_all_before(spark):
    r = random.Random(1)
    for n in (0, 1, 63, 64, 65, 128, 5000):
        a = [r.randrange(100) for _ in range(n)]
        plain = [sum(a[:i]) if n < 200 else None for i in range(n)]
        got = _one(spark, running(F.col("a"), F.lit(0), lambda x, y: x + y), a=(a, "array<int>"))
        assert len(got) == n and (n >= 200 or got == plain) and (n < 200 or got[-1] == sum(a[:-1]))
        top = _one(spark, running(F.col("a"), F.lit(0), lambda x, y: F.greatest(x, y)), a=(a, "array<int>"))
        assert top == [max(a[:i], default=0) for i in range(n)]


def test_match_spans_equal_plain_search(spark):
    r = random.Random(2)
    for n in (0, 5, 700):
        text = "".join(r.choice(["ab1", "22", "é", "\U0001F600", " ", "\n"]) for _ in range(n))
        got = _one(spark, match_spans(F.col("t"), "[0-9]+"), t=(text, "string"))
        assert [tuple(s) for s in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_piece_of_chunked_text(spark):
    text = "".join(random.Random(3).choice("aé\U0001F600\n") for _ in range(3 * CHUNK))
    for a, b in ((0, 0), (0, 5), (CHUNK - 2, CHUNK + 2), (CHUNK, 2 * CHUNK), (10, 3 * CHUNK), (3 * CHUNK, 3 * CHUNK)):
        assert _one(spark, piece(chunked(F.col("t")), F.lit(a), F.lit(b)), t=(text, "string")) == text[a:b]


def test_clear_of_equals_comparing_all(spark):
    r = random.Random(4)
    span = "array<struct<start:int,end:int>>"
    for n, m in ((0, 3), (3, 0), (1, 1), (40, 40), (300, 90)):
        spans, others = ([(s, s + r.randrange(1, 9)) for s in (r.randrange(900) for _ in range(k))] for k in (n, m))
        got = _one(spark, clear_of(F.col("a"), F.col("b")), a=(spans, span), b=(others, span))
        assert [tuple(s) for s in got] == [s for s in spans if not any(o[0] < s[1] and s[0] < o[1] for o in others)]


def test_suppress_equals_comparing_all():
    r = random.Random(5)
    for n in (0, 1, 30, 400):
        found = [(r.choice([40, 60, 90]), s, s + r.randrange(1, 30), r.choice("abc")) for s in (r.randrange(200) for _ in range(n))]
        kept = []
        for d in sorted(set(found), key=lambda d: (-d[0], d[1] - d[2], d[3], d[1])):
            if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
                kept.append(d)
        assert sorted(licenses.suppress(found)) == sorted(kept)


def test_licences_of_a_long_text_take_time_in_proportion():
    def seconds(n):
        text = "Licensed under the MIT License. SPDX-License-Identifier: Apache-2.0\n" * n
        start = time.perf_counter()
        assert licenses.scan(text)[1] == n
        return time.perf_counter() - start
    seconds(100)
    assert seconds(16_000) < 3.5 * min(seconds(8_000), seconds(8_000))      # 0.5 and 1 MB


def test_pii_of_a_long_text_is_found_and_removed(spark):
    n = 60_000                                                                # 1.2 MB
    text = "".join(f"bob.{i}@example.com, " for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    assert pii.pii_digest(docs).first()["n_email"] == n
    assert pii.redact_documents(docs).first()["text"] == "<EMAIL>, " * n
    assert time.perf_counter() - start < 100        # before: minutes, four times per doubling
