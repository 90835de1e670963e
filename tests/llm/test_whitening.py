"""Whitening against Python's exact integers and numpy."""
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def plain(rows, components=4):
    """vec_id -> (deviation, whitened) of the kept rows, and the eigenvalues' shares."""
    xs = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(col) for col in zip(*fit)]
    y = [[n * a - b for a, b in zip(x, s)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for i, x in xs:
        c = [n * a - b for a, b in zip(x, s)]
        out.append((i, sum(a * a for a in c), (np.array([a / n for a in c]) @ u) / np.sqrt(e)))
    return n, out, e / np.trace(v)


def make(spark, rng, n, d, scale=1.0):
    mix = rng.normal(size=(d, d)) * np.linspace(3, 0.5, d)
    return [(k, (rng.normal(size=d) @ mix * scale).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("scale", [0.3, 1e6, 1e15])
def test_whiten_equals_plain(spark, scale):
    rng = np.random.default_rng(4)
    good = make(spark, rng, 300, 6, scale)
    good += [(1000 + k, good[3][1]) for k in range(150)] + [good[5], (None, good[7][1])]       # a third are copies
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6),
           (2004, [float("inf")] + [0.0] * 5), (2005, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in good + bad], SCHEMA).repartition(5)
    out = whitening.whiten(df).collect()
    n, want, shares = plain(good)
    assert len(out) == 4 * len(good) and {r.n for r in out} == {n}
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    got = {}
    for r in out:
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    sign = None
    for i, deviation, w in want:
        values = got[(i, deviation if deviation < 1 << 63 else None)]
        if sign is None:
            sign = [np.sign(values[k + 1][0] * w[k]) for k in range(4)]
        if deviation < 1 << 63:
            assert [values[k + 1][0] for k in range(4)] == pytest.approx((w * sign).tolist(), abs=1e-7)


def test_square_sums_are_exact_at_every_size():
    rng = np.random.default_rng(6)
    for bits in (3, 20, 31, 40, 52, 61):
        z = rng.integers(-(1 << bits), 1 << bits, (500, 4))
        z[0] = [(1 << bits) - 1, -(1 << bits), 0, 1]
        want = [sum(int(a) ** 2 for a in col) for col in z.T]
        assert list(whitening.square_sums(z)) == want == list(whitening.square_sums(z.astype(object)))
    x = rng.integers(-(1 << 40), 1 << 40, (50, 5))
    y = whitening.centred(x, 7, [3] * 5)
    v = whitening.covariance(list(whitening.pair_squares(y)), 7, 5)
    exact = [[float(Fraction(sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])), 343)) for j in range(5)] for i in range(5)]
    assert v.tolist() == exact
    big = whitening.centred(np.array([[1 << 62, 0]]), 5, [1, -1])
    assert big.dtype == object and big.tolist() == [[5 * (1 << 62) - 1, 1]]


def test_little_and_flat_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [1.0, 2.0], 0, "", 0)], SCHEMA)
    assert whitening.whiten(df).count() == 0                          # no variance
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0], 0, "", 0) for k in range(5)], SCHEMA)
    out = whitening.whiten(line).collect()
    assert len(out) == 5 and {r.component for r in out} == {1}        # one direction of variance
    assert all(r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in out)
    huge = spark.createDataFrame([(k, [3e38 * (-1) ** k, float(k)], 0, "", 0) for k in range(4)], SCHEMA)
    assert whitening.whiten(huge).filter("deviation is null").count() >= 4
