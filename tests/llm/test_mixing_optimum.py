"""Rates on skewed domains against a plain solver run to its end."""
import numpy as np
import pytest

from ledgerspark.llm import mixing


def plain(tokens, p, weights):
    """Accelerated projected gradient with all documents in memory, 6000 steps."""
    total = tokens.sum()
    goal = np.array(weights) / sum(weights) * total
    r = last = np.ones(len(p))
    q = mixing.STAY ** 0.5
    for _ in range(6000):
        at = r + (1 - q) / (1 + q) * (r - last)
        slope = p @ (((at * tokens) @ p - goal) / total) + mixing.STAY * (at - 1)
        last, r = r, np.clip(at - slope / (1 + mixing.STAY), 0, mixing.MOST)
    return (r * tokens) @ p


@pytest.mark.parametrize("rare,weights", [(0.002, [0.96, 0.0399, 0.0001]), (0.0005, [0.9, 0.0985, 0.0015]), (0.3, [0.96, 0.015, 0.025]),
                                          (0.004, [0.5, 0.0, 0.5])])
def test_rates_reach_the_optimum_on_skewed_domains(spark, rare, weights):
    rng = np.random.default_rng(3)
    main = np.where(rng.random(4000) < rare, 2, np.where(rng.random(4000) < 0.02, 1, 0))
    p = 0.04 * rng.dirichlet([1.0, 1.0, 1.0], 4000) * rng.random(4000)[:, None]
    p[np.arange(4000), main] += 1 - p.sum(1)
    p = mixing._cell(p)
    tokens = rng.integers(1, 900, 4000).astype(float)
    table = spark.createDataFrame([(float(t), x.tolist()) for t, x in zip(tokens, p)], "tokens double, p array<double>")
    got = (mixing.rates(p, mixing.fit_rates(table, weights)) * tokens) @ p
    assert got == pytest.approx(plain(tokens, p, weights), rel=1e-4)
