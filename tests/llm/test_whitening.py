"""Whitening: exact polynomial and roots, components against numpy and a brute-force version, odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from socspan.llm import whitening as w

FIELDS = "vec_id long, embedding array<double>, label string"


def exact_polynomial(m):
    """Faddeev and LeVerrier in fractions."""
    n = len(m)
    a, c, out = np.array(m, object), np.zeros((n, n), object), [Fraction(1)]
    for k in range(1, n + 1):
        c = a.dot(c) + out[-1] * np.eye(n, dtype=int).astype(object)
        out.append(-Fraction(int(np.trace(a.dot(c)))) / k if k else 0)
        c = np.array([[Fraction(v) for v in row] for row in c], object)
    return [int(x) for x in reversed(out)]


@pytest.mark.parametrize("rows, d", [(3, 1), (40, 2), (40, 7), (3, 6), (500, 12)])
def test_polynomial(spark, rows, d):
    x = np.random.default_rng(d).integers(-40, 40, (rows, d))
    x[:, 0] = 3 * x[:, -1]  # singular
    m = w.products(x)
    assert (m == x.astype(object).T.dot(x.astype(object))).all()
    assert w.characteristic_polynomial(spark, m) == exact_polynomial(m)


def test_products_of_large_entries():
    x = np.random.default_rng(0).integers(-(1 << 61), 1 << 61, (50, 4))
    assert (w.products(x) == x.astype(object).T.dot(x.astype(object))).all()


def test_roots_with_multiplicity():
    poly = [1]
    for r in (7, 7, 7, 1000, 3, 0, 0, 10**9, 10**9 + 1):
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    got = [(Fraction(r.value, 1 << r.shift), r.times) for r in w.largest_roots(poly, 9)]
    assert [(round(v), t) for v, t in got] == [(10**9 + 1, 1), (10**9, 1), (1000, 1), (7, 3), (3, 1)]
    assert all(abs(v - round(v)) < Fraction(round(v), 1 << 60) for v, _ in got)
    assert len(w.largest_roots(poly, 2)) == 2 and w.largest_roots([0, 0, 1], 3) == []


def test_null_space_of_equal_roots():
    q, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(6, 6)))
    m = np.zeros((6, 6), object)
    for i in range(6):
        m[i, i] = [50, 9, 9, 9, 2, 0][i]
    basis = w.null_space(m, w.Root(9, 0, 3))
    assert np.allclose(basis @ basis.T, np.eye(3), atol=1e-15) and np.allclose(basis[:, [0, 4, 5]], 0, atol=1e-15)


def brute(rows):
    """Deviations and a check of components, by the contract's words, from the usable vectors."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    v = (n * x.T.dot(x) - np.outer(s, s)).astype(float) / n**2
    e, u = np.linalg.eigh(v)
    return n, s, [(i, int(((n * r - s) ** 2).sum())) for (i, _), r in zip(rows, x, strict=True)], e[::-1], u[:, ::-1], v, (x - np.array([Fraction(int(a), n) for a in s])).astype(float)


def test_whitening(spark, tmp_path):
    r = np.random.default_rng(1)
    good = [(i, (r.normal(size=40) * np.linspace(0.5, 3, 40)).tolist()) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(200)] + [(None, good[3][1])]
    bad = [(2000, None), (2001, [None, *good[0][1][1:]]), (2002, [math.nan, *good[0][1][1:]]), (2003, [math.inf, *good[0][1][1:]]), (2004, []), (2005, [1.0, 2.0]), (2006, [1e300] * 40)]
    spark.createDataFrame([(*x, "a") for x in good + bad], FIELDS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = w.op11_whitening(spark, str(tmp_path)).toPandas()
    n, _, deviations, e, u, v, off = brute(good)
    assert len(got) == len(good) * 32 and set(got.component) == set(range(1, 33)) and (got.n == n).all()
    first = got[got.component == 1]
    assert sorted(zip(first.vec_id.fillna(-1), first.deviation, strict=True)) == sorted((-1 if i is None else i, d) for i, d in deviations)
    assert np.allclose(got.groupby("component").explained.first(), e[:32] / e.sum(), rtol=1e-12) and got.identity_error.max() < 1e-10
    z = off @ u[:, :32] / np.sqrt(e[:32])
    have = got[(got.vec_id >= 0) & (got.vec_id < 300)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((have * z[:300]).sum(axis=0))
    assert np.abs(have - z[:300] * sign).max() < 1e-9
    same = got[(got.vec_id >= 1000) | (got.vec_id == 7)].groupby("component").whitened
    assert (same.max() - same.min()).max() < 1e-13


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, [1.0, 2.0], "a")], [(i, [0.5, 0.25], "a") for i in range(9)], [(1, [], "a"), (2, [], "b")]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = w.op11_whitening(spark, str(tmp_path))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


def test_few_dimensions_large_entries_and_names(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) * 1e12, float(x) * 1e12 + float(y), 5.0], "a") for i, (x, y) in enumerate(r.normal(size=(60, 2)))]
    df = spark.createDataFrame([(*x, 7) for x in rows], FIELDS + ", whitened int")
    m = w.fit(df)
    assert m.components.shape == (2, 3)  # the third dimension is constant
    out = w.whiten(df, m)
    assert out.columns == [*df.columns, "_white"] and w.identity_error(out) < 1e-4  # of entries of 1e12 that nearly cancel
    assert out.filter("_white.deviation is null").count() == out.count()
    with pytest.raises(ValueError, match="_White"):
        w.whiten(df.withColumnRenamed("label", "_White"), m)
    few = w.fit(df, components=1)
    assert few.components.shape == (1, 3) and np.allclose(few.components[0], m.components[0])
