"""All training documents fix the rejection ranges, however many there are."""
import random

import numpy as np
import pytest

from ledgerspark.llm import common, language


def test_ranges_come_from_all_training_documents(spark):
    rng = random.Random(8)
    letters = {"x": "abcdefghij", "y": "fghijklmnop"}
    rows = []
    for i in range(7000):                               # more than the 4,000 that once were taken
        lang = "x" if i % 3 else "y"
        words = ["".join(rng.choices(letters[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(3, 9))]
        rows.append((i, " ".join(words), lang))
    rows += [(8000, None, "x"), (8001, "12 !", "x"), (8002, "abc def", None), rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    held = {r.doc_id for r in df.filter(common.held_out(df["doc_id"])).collect()}
    far = set()
    for lang in ("x", "y"):
        own = [(i, *model.cross_entropy(text)) for i, text, la in rows if la == lang]
        at = model.langs.index(lang)
        train = np.array([(h[at], n) for i, h, n in own if n and i not in held])
        mean, most = train[:, 0].mean(), None
        apart = (train[:, 0] - mean) * np.minimum(train[:, 1], 400) ** 0.5
        most = np.quantile(apart, 1 - language.REJECT_SHARE)
        assert model.limits[lang] == pytest.approx((mean, most), abs=1e-9)
        far |= {i for i, h, n in own if n and (h.min() - model.limits[model.langs[int(h.argmin())]][0]) * min(n, 400) ** 0.5
                > model.limits[model.langs[int(h.argmin())]][1]}
    got = language.identify(df)
    assert got.count() == len(rows)
    assert {r.doc_id for r in got.filter("rejected and doc_id < 8000").collect()} == far
