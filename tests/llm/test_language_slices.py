"""A model cut into slices predicts as the whole one, and keeps rare languages."""
import random

import pytest

from ledgerspark.llm import language


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_slices_equal_the_whole_model(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, words(rng, "abcdefghijklmnop", 120), "hot") for i in range(120)]
    rows += [(200 + i, words(rng, "mnopqrstuvwxyz", 3), "rare") for i in range(12)]
    rows += [(300 + i, words(rng, [chr(0x4E00 + j) for j in range(300)], 40), "han") for i in range(20)]
    rows += [(400, None, "hot"), (401, "", None), (402, "12 !", "rare"), (403, "qrst unseen Ω", None), (None, rows[0][1], None), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, language.identify(df).collect()), key=str)
    monkeypatch.setattr(language, "SLICE_RUNS", 3000)
    assert len(language.fit(df).slices) > 2
    sliced = sorted(map(tuple, language.identify(df).collect()), key=str)
    assert len(whole) == len(sliced) == len(rows)
    for a, b in zip(whole, sliced):
        assert a[:3] == b[:3] and a[5] == b[5] and a[3:5] == pytest.approx(b[3:5], rel=1e-4, abs=1e-6), (a, b)
    assert {r[2] for r in sliced if r[0] and 200 <= r[0] < 212} == {"rare"}
