"""The mixture's classifier reads each text once to fit the rates and once to draw."""
import numpy as np

from ledgerspark.llm import mixing


def test_draw_scores_each_text_once(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    def predict(texts):
        scored.add(len(texts))
        return np.full((len(texts), 2), 0.5)
    monkeypatch.setattr(mixing, "fit_domains", lambda *args: predict)
    monkeypatch.setattr(mixing, "label_domains", lambda labels: labels)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    out = mixing.draw(docs, None, {"a": 0.5, "b": 0.5})
    scored.value = 0
    assert out.count() <= 52 and {"domain", "rate", "copies"} <= set(out.columns)
    rows = out.collect()
    scored.value = 0
    assert out.collect() == rows
    assert scored.value == 52
