"""Whitening against a dense eigensolver over exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import whitening as W

from ..conftest import SF001


def usable(vec):
    return bool(vec) and all(c is not None and math.isfinite(c) for c in vec)


def check(df, rows, k=8):
    """rows: (id, vector) that remain. The result of ``whitened`` against numpy's eigensolver."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    got = df.collect()
    assert {r.component for r in got} == set(range(1, k + 1)) and len(got) == k * n
    deviation = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums))) for (i, _), v in zip(rows, x))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == deviation
    share = values / (centred ** 2).sum() * n
    for r in got:
        assert r.n == n and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    if len({i for i, _ in rows}) == n:
        z = centred @ vectors / np.sqrt(values)
        at = {i: j for j, (i, _) in enumerate(rows)}
        for c in range(k):
            own = np.zeros(n)
            for r in got:
                if r.component == c + 1:
                    own[at[r.vec_id]] = r.whitened
            sign = np.sign(own @ z[:, c])
            assert np.abs(own - sign * z[:, c]).max() < 1e-9


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(W.whitened(df.repartition(5)), [r for r in rows if usable(r[1])])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=12)]) for i in range(60)]
    good += [(None, good[0][1]), (5, good[5][1]), (5, good[5][1])]
    bad = [(100, None), (101, []), (102, [None] * 12), (103, [math.nan] + [0.0] * 11), (104, [math.inf] + [0.0] * 11), (105, [1e30] * 12), (106, [1.0] * 11)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    for c in ("id", "vector", "size", "z", "component", "n", "deviation"):
        df = df.withColumn(c, F.lit("x"))
    check(W.whitened(df.repartition(4)), good)
    first = sorted(map(str, W.whitened(df.repartition(1)).select("vec_id", "component", "n", "deviation", "explained").collect()))
    assert first == sorted(map(str, W.whitened(df.repartition(9)).select("vec_id", "component", "n", "deviation", "explained").collect()))
    for none in (df.limit(0), df.filter("vec_id >= 100"), df.filter("vec_id = 7")):
        out = W.whitened(none)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), float(-i), float(i * i)]) for i in range(9)]  # two directions only
    out = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.component for r in out.collect()} == {1, 2}


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [1e9 * i, 3.0]) for i in range(3)]
    out = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: r.deviation for r in out.collect()}[0] is None


def symmetric(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = q * np.array(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1e8, 1e4, 1, 1e-3, 1e-4], [3, 3, 3, 1, 1], [7] * 6, [9, 8.9999, 8.9998, 1, 0, 0], list(range(1, 40)), [1 + 1e-3 * i for i in range(50)],
    [2.0 ** -i for i in range(25)], [4, 0, 0], [1 + 1e-9, 1, 0.5]])
def test_components(values):
    rng = np.random.default_rng(len(values))
    v = symmetric(rng, values)
    e, u = W.components(v)
    want = sorted([x for x in values if x > 1e-9 * max(values)], reverse=True)[:8]
    e = e[:len(want)]
    assert np.allclose(e, want, rtol=1e-6, atol=1e-11 * max(values))
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-8)
    assert np.abs(v @ u[:, :len(want)] - u[:, :len(want)] * e).max() < 1e-10 * max(values)


@pytest.mark.parametrize("values", [[0.438, 0.145] + [0.0744 - 0.0002 * i for i in range(62)], [1] + [0.01 - 1e-6 * i for i in range(63)]])
def test_components_with_close_values_beyond_a_wide_interval(values):
    """One circle doesn't part the eighth value from the ninth; circles by gaps do, and the parts' vectors stay at right angles."""
    v = symmetric(np.random.default_rng(1), values)
    e, u = W.components(v)
    assert np.allclose(e, values[:8], rtol=0, atol=1e-12)
    assert np.allclose(u.T @ u, np.eye(8), atol=1e-12) and np.abs(v @ u - u * e).max() < 1e-12


def test_inertia():
    rng = np.random.default_rng(8)
    for dims in (1, 2, 5, 20):
        for _ in range(20):
            a = rng.standard_normal((dims, dims))
            a = a + a.T
            assert W.positive_count(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert W.positive_count(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and W.positive_count(np.zeros((3, 3))) == 0


def test_gram_is_exact():
    c = np.array([[1 << 40, 3], [-(1 << 40), 5], [7, 1]])
    assert W.gram(c).tolist() == [[sum(int(r[i]) * int(r[j]) for r in c) for j in range(2)] for i in range(2)]
