"""Iterative workloads against NumPy."""

import math

import numpy as np

from sparkarray.array import SparkArray
from sparkarray.plans import workloads

RNG = np.random.default_rng(12)


def test_kmeans(spark):
    x = np.concatenate([RNG.normal(size=(40, 3)) + c for c in ([0, 0, 0], [6, 0, 0], [0, 6, 6])])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    centres, out = workloads.kmeans(rows, "v", x[[0, 40, 80]], 10)
    c = x[[0, 40, 80]]
    for _ in range(10):
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == k].mean(axis=0) for k in range(3)])
    np.testing.assert_allclose(centres, c)
    assert [r.cluster for r in out.orderBy("id").collect()] == near.tolist()


def test_regressions(spark):
    x = RNG.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 0.5 + RNG.normal(size=300) * 0.1
    label = (x @ [1.5, -2.0] + 0.3 + RNG.logistic(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), float(t), int(l)) for (a, b), t, l in zip(x, y, label)], "a double, b double, y double, l int")
    design = np.column_stack([x, np.ones(300)])
    np.testing.assert_allclose(workloads.linear_regression(rows, ["a", "b"], "y"), np.linalg.lstsq(design, y, rcond=None)[0])
    w = workloads.logistic_regression(rows, ["a", "b"], "l")
    np.testing.assert_allclose(design.T @ (1 / (1 + np.exp(-design @ w)) - label), 0, atol=1e-6)


def test_conjugate_gradient(spark):
    m = RNG.normal(size=(6, 6))
    a, b = m @ m.T + 6 * np.eye(6), RNG.normal(size=6)
    got = workloads.conjugate_gradient(SparkArray.from_numpy(spark, a), SparkArray.from_numpy(spark, b), 7)
    np.testing.assert_allclose(got.to_numpy(), np.linalg.solve(a, b), rtol=1e-6, atol=1e-8)


def test_jacobi(spark):
    g = RNG.normal(size=(6, 7))
    got = workloads.jacobi(SparkArray.from_numpy(spark, g), 3, 2).to_numpy()
    for _ in range(3):
        new = g.copy()
        new[1:-1, 1:-1] = (g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:]) / 4
        g = new
    np.testing.assert_allclose(got, g)


def test_richardson_lucy(spark):
    image, kernel = RNG.random((6, 6)) + 0.5, np.array([[0.0, 0.1, 0.0], [0.2, 0.4, 0.1], [0.0, 0.2, 0.0]])

    def filtered(x, k):
        p = np.pad(x, 1)
        return sum(k[i, j] * p[2 - i : 8 - i, 2 - j : 8 - j] for i in range(3) for j in range(3))

    want = np.full((6, 6), 0.5)
    for _ in range(2):
        want = want * filtered(image / filtered(want, kernel), kernel[::-1, ::-1])
    np.testing.assert_allclose(workloads.richardson_lucy(SparkArray.from_numpy(spark, image), kernel, 2).to_numpy(), want)


def test_black_scholes(spark):
    row = workloads.black_scholes(spark.createDataFrame([(25.0, 30.0, 2.0)], "s double, x double, t double")).first()
    d1 = (math.log(25 / 30) + (0.02 + 0.045) * 2) / (0.3 * math.sqrt(2))
    cnd = lambda d: 0.5 * (1 + math.erf(d / math.sqrt(2)))
    call = 25 * cnd(d1) - 30 * math.exp(-0.04) * cnd(d1 - 0.3 * math.sqrt(2))
    assert abs(row.call - call) < 1e-5 and abs(row.put - (call - 25 + 30 * math.exp(-0.04))) < 1e-5
