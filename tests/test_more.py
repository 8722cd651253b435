"""Whole numbers, lineage without joins, keywords of ufuncs, advanced indexing, windows over ranges, blocks, tasks, habits."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_arrays import same

from sparkarray import namespace as np_
from sparkarray.array import SparkArray
from sparkarray.operators import creation, indexing, linalg, ordering, products, scans, signal, tasks
from sparkarray.plans import catalogue, doctor
from sparkarray.plans.lint import plan_text

RNG = np.random.default_rng(21)
BIG = 2**53


@pytest.fixture(scope="module")
def A(spark):
    return lambda x: SparkArray.from_numpy(spark, np.asarray(x))


def exact(got: SparkArray, want) -> None:
    x = got.to_numpy()
    assert x.dtype.kind in "iub" and x.tolist() == np.asarray(want).tolist()


def test_whole_numbers_beyond_doubles(A):
    a, b = np.array([BIG, BIG + 1, -BIG - 1, 2**60 + 1, -7, 7, 0]), np.array([BIG + 1, 1, 3, 10, 3, -3, 0])
    x, y = A(a), A(b)
    for name in ("equal", "not_equal", "less", "greater_equal", "maximum", "minimum", "fmax", "fmin"):
        exact(x.ufunc(name, y), getattr(np, name)(a, b))
    with np.errstate(all="ignore"):
        for name in ("remainder", "floor_divide", "fmod"):
            exact(x.ufunc(name, y), getattr(np, name)(a, b))
    exact(x % 10, a % 10)
    exact(x // 1000, a // 1000)
    exact(A([3, -3, 2, 1, 0, -1]) ** A([39, 3, 62, 4000, 5, 4001]), [3**39, -27, 2**62, 1, 0, -1])
    exact(x.ufunc("sign"), np.sign(a))
    exact(scans.cumprod(A([3, 3, 3, 3, 7])), [3, 9, 27, 81, 567])
    exact(scans.cumprod(A(np.array([[3] * 35, [-1] * 35])), 1), np.cumprod([[3] * 35, [-1] * 35], 1))
    t, u = np.array([True, True, False]), np.array([True, False, False])
    for name in ("add", "multiply", "bitwise_and", "bitwise_xor", "maximum", "less", "equal"):
        exact(A(t).ufunc(name, A(u)), getattr(np, name)(t, u))
    exact(~A(t), ~t)
    exact(A(t) + 2, t + 2)


def test_large_doubles_and_wide_types(A):
    v = np.array([1e20, -1e20, 2.0**52 + 1, -2.5, 2.5, 9.3e18])
    for name in ("floor", "ceil", "trunc"):
        same(A(v).ufunc(name), getattr(np, name)(v), 0)
    wide = np.array([2**64 - 1, 2**63, 0, 7], "u8")
    x = A(wide)
    assert x.dtype == "decimal(20,0)" and x.to_numpy().tolist() == wide.tolist()
    exact(x > A(np.array([2**63, 2**63, 1, 1], "u8")), wide > np.array([2**63, 2**63, 1, 1], "u8"))
    assert A(np.array([250], "u1")).dtype == "smallint" and A(np.array([1.5], "f2")).dtype == "float"
    nan = np.array([1.0, np.nan, 3.0])
    exact(ordering.isin(A(nan), A([1.0, np.nan])), [True, False, False])
    exact(ordering.isin(A(nan), A([1.0, np.nan]), True), [False, False, True])


def joins(df) -> int:
    return plan_text(df).count("Join")


def test_one_origin_needs_no_join(spark, A):
    v = RNG.normal(size=20)
    a = A(v)
    got = a * a + a
    same(got, v * v + v)
    c = np_.clip(a, -0.5, 0.5) * 2.0 + (a > 0.0).ufunc("multiply", a)
    same(c, np.clip(v, -0.5, 0.5) * 2 + (v > 0) * v)
    r = creation.arange(spark, 20)
    same(a * r + creation.full(spark, 20, 2.0), v * np.arange(20) + 2)
    g = np_.random.RandomState(3)
    p, q = g.rand(1000), g.rand(1000)
    dot = products.dot(p, q)
    same(dot, (p.to_numpy() * q.to_numpy()).sum())
    for x in (got, c, a * r, dot, p + q):
        assert not joins(x.df) and "Exchange hash" not in plan_text((a * a).df)
    m = A(RNG.normal(size=(3, 4)))
    same(m + creation.arange(spark, 4), m.to_numpy() + np.arange(4))
    same(creation.arange(spark, 4).reshape(4) + m, m.to_numpy() + np.arange(4))
    grown = a
    for _ in range(12):
        grown = grown * grown
    same(grown, v**4096)


def test_ufunc_keywords_and_methods(A):
    v, w = RNG.normal(size=6), RNG.normal(size=6)
    a, b = A(v), A(w)
    out = A(np.zeros(6))
    assert np_.add(a, b, out=out) is out
    same(out, v + w)
    np.multiply(a, b, out=out, where=A(v > 0))
    same(out, np.where(v > 0, v * w, v + w))
    same(np_.sqrt(a, where=a > 0.0), np.where(v > 0, np.sqrt(np.abs(v)), 0))
    m = RNG.normal(size=(3, 4))
    for f in ("add", "multiply", "maximum", "minimum", "logical_and", "logical_or"):
        same(getattr(np_, f).reduce(A(m)), getattr(np, f).reduce(m))
        same(getattr(np_, f).reduce(A(m), 1, keepdims=True), getattr(np, f).reduce(m, 1, keepdims=True))
    same(np.add.reduce(A(m), axis=None), m.sum())
    exact(np_.bitwise_xor.reduce(A([5, 9, 12])), np.bitwise_xor.reduce([5, 9, 12]))
    same(np_.add.accumulate(A(m), 1), np.add.accumulate(m, 1))
    same(np_.subtract.outer(a, b), np.subtract.outer(v, w))
    x, y = v.copy(), A(v)
    np.add.at(x, [1, 1, -1], 2.0)
    np_.add.at(y, [1, 1, -1], 2.0)
    same(y, x)
    with pytest.raises(NotImplementedError):
        np_.arctan2.reduce(a)


def test_names_that_had_no_way(A):
    v = np.array([1.25, -3.7, np.nan, 2.5])
    same(np.clip(A(v), -1, 2), np.clip(v, -1, 2))
    same(np_.round(A(v), 1), np.round(v, 1))
    same(np_.nan_to_num(A(v)), np.nan_to_num(v))
    same(np_.copy(A(v)), v)
    exact(np_.in1d(A([1, 2, 3]), A([3, 1])), [True, False, True])
    m = np.arange(9.0).reshape(3, 3)
    same(np_.trilu(A(m), -1), np.tril(m, -1))
    same(np_.trilu(A(m), 1, False), np.triu(m, 1))
    assert A(m).tobytes() == m.tobytes() == A(m).tostring()
    np_.random.seed(4)
    one, two = np_.random.rand(5).to_numpy(), np_.random.rand(5).to_numpy()
    np_.random.seed(4)
    assert (np_.random.rand(5).to_numpy() == one).all() and (one != two).all()
    assert (np_.random.RandomState(4).rand(5).to_numpy() == one).all()


def test_advanced_indexing(A):
    t = RNG.normal(size=(3, 4, 5))
    a, i, j = A(t), np.array([[0, 2], [1, 1]]), np.array([3, -1])
    flag = np.array([True, False, True, True, False])
    for key in ((i, slice(1, 3), j), (slice(None), i, j), (i, j), (0, slice(None), j), (i, 1), (slice(0, 2), j, 2), (None, i, slice(None), j), (..., i, j), (slice(None), np.array([1, 2, 0]), flag)):
        spark_key = tuple(A(k) if isinstance(k, np.ndarray) else k for k in key)
        same(a[spark_key], t[key])
    same(a[A(i)], t[i])
    same(a[:, :, A(flag)], t[:, :, flag])


@pytest.mark.parametrize("how", ["mean", "max", "min", "sum"])
def test_windows_are_the_same_on_either_side_of_a_range(spark, how):
    import pandas as pd

    n, width = (1 << 16) + 40, 5
    v = RNG.normal(size=n).round(3)
    df = spark.range(n).selectExpr("id as i0").join(spark.createDataFrame(pd.DataFrame({"i0": np.arange(n), "v": v})), "i0")
    want = getattr(pd.Series(v).rolling(width, center=True, min_periods=1), how)().to_numpy()
    got = scans.moving(SparkArray(df, (n,)), width, how=how).to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_long_lines_in_ranges(A, monkeypatch):
    monkeypatch.setattr(ordering, "LINE", 3)
    monkeypatch.setattr(scans, "RANGE", 3)
    m = RNG.normal(size=(3, 8)).round(2)
    m[1, 2] = m[1, 5]
    same(ordering.sort(A(m), 1), np.sort(m, 1))
    exact(ordering.argsort(A(m), 1), np.argsort(m, 1, kind="stable"))
    same(ordering.quantile(A(m), 0.3, 1), np.quantile(m, 0.3, 1))
    k = RNG.integers(-4, 5, size=(2, 9))
    exact(scans.cumprod(A(k), 1), np.cumprod(k, 1))
    exact(scans.cumprod(A(k[0])), np.cumprod(k[0]))


def test_kernels_that_are_arrays(A, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 16)
    v, w = RNG.normal(size=50), RNG.normal(size=21)
    for mode in ("same", "full", "valid"):
        same(scans.convolve(A(v), A(w), mode), np.convolve(v, w, mode))


@pytest.mark.parametrize("kind", ["double", "whole", "complex", "batch"])
def test_contractions_by_tiles(A, monkeypatch, kind):
    monkeypatch.setattr(products, "TILE_WORK", 1)
    monkeypatch.setattr(products, "SIDE", 4)
    monkeypatch.setattr(products, "TILE", 16)
    x, y = RNG.normal(size=(2, 6, 9)), RNG.normal(size=(2, 9, 7))
    if kind == "whole":
        x, y = (x * 9).astype("i8"), (y * 9).astype("i8")
    if kind == "complex":
        x = x + 1j * RNG.normal(size=x.shape)
    if kind == "batch":
        same(products.matmul(A(x), A(y)), x @ y)
        return
    same(products.matmul(A(x[0]), A(y[0])), x[0] @ y[0])
    same(products.tensordot(A(x), A(y), ([0, 2], [0, 1])), np.tensordot(x, y, ([0, 2], [0, 1])))
    same(products.einsum("aij,ajk->ki", A(x), A(y)), np.einsum("aij,ajk->ki", x, y))


def test_tiled_products_are_dealt_over_tasks(A, monkeypatch):
    """One block of the summed mode is not one task."""
    a = RNG.normal(size=(1100, 6))
    got = linalg.tiled_matmul(A(a), A(a.T), 64)
    shares = [r["count"] for r in got.df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 1100**2 and max(shares) < 0.9 * 1100**2
    same(got, a @ a.T)
    for name, value in (("TILE_WORK", 1), ("SIDE", 2), ("TILE", 4), ("LEAST_PATCH", 1), ("PANEL", 12)):
        monkeypatch.setattr(products, name, value)
    for x, y in ((RNG.normal(size=(2, 7, 5)), RNG.normal(size=(2, 5, 9))), (RNG.integers(-9, 9, (7, 5)), RNG.integers(-9, 9, (5, 1))), (RNG.normal(size=(1, 5)) * 1j, RNG.normal(size=(5, 9)))):
        for most in (1, 12, 100):
            monkeypatch.setattr(products, "PATCH", most)
            same(products.matmul(A(x), A(y)), x @ y)


def test_rounding_as_in_sql(spark):
    x = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.0, 2.0**53, 1e306, -1e306, 3e301, float("inf"), float("nan"), 0.0078125, -0.0234375, 1.0000005, 2.675e-6, *RNG.normal(size=3000), *(RNG.integers(-(10**6), 10**6, 3000) / 128)]
    for digits in (0, 6):
        got = spark.createDataFrame(pa.table({"x": x})).select("x", catalogue.rounded(F.col("x"), digits).alias("r")).toArrow()
        want = duckdb.sql(f"SELECT round(x, {digits}) AS r FROM got").to_arrow_table()
        assert [repr(v) for v in got["r"].to_pylist()] == [repr(v) for v in want["r"].to_pylist()]


def test_factorizations_by_blocks(A, monkeypatch):
    m = RNG.normal(size=(11, 7))
    g = m.T @ m + np.eye(7)
    same(linalg.blocked_cholesky(A(g), 3), np.linalg.cholesky(g))
    low, b = np.linalg.cholesky(g), RNG.normal(size=(7, 2))
    same(linalg.blocked_triangular(A(low), A(b), True, side=3), np.linalg.solve(low, b))
    same(linalg.blocked_triangular(A(low.T), A(b[:, 0]), False, side=2), np.linalg.solve(low.T, b[:, 0]))
    q, r = (x.to_numpy() for x in linalg.gram_qr(A(m)))
    np.testing.assert_allclose(q @ r, m, atol=1e-9)
    np.testing.assert_allclose(q.T @ q, np.eye(7), atol=1e-9)
    monkeypatch.setattr(linalg, "KERNEL_CELLS", 50)
    sq = RNG.normal(size=(7, 7)) + 4 * np.eye(7)
    same(linalg.gram(A(m)), m.T @ m)
    monkeypatch.setattr(linalg, "KERNEL_CELLS", 49)
    same(linalg.solve(A(sq), A(b)), np.linalg.solve(sq, b), 1e-7)


def test_planes_at_once(A, monkeypatch):
    t = RNG.normal(size=(2, 4, 6))
    z = t + 1j * RNG.normal(size=t.shape)
    for most in (4_000_000, 1):
        monkeypatch.setattr(signal, "PLANE_CELLS", most)
        same(signal.fft2(A(t)), np.fft.fft2(t))
        same(signal.ifftn(A(z)), np.fft.ifftn(z))
        same(signal.rfft2(A(t)), np.fft.rfft2(t))
        same(signal.irfft2(A(z)), np.fft.irfft2(z))
        same(signal.fftn(A(t), (3, 5), (0, 2)), np.fft.fftn(t, (3, 5), (0, 2)))


def test_tasks(A):
    m, v = RNG.normal(size=(5, 4)), RNG.normal(size=4)
    same(tasks.apply(lambda x, y, w: x * y + w.sum(), A(m), A(v), whole=[A(v)]), m * v + v.sum())
    got = tasks.fold(lambda x: np.histogram(x, 4, (-2, 2))[0], A(m))
    assert got.tolist() == np.histogram(m, 4, (-2, 2))[0].tolist()
    assert tasks.fold(lambda x: np.array([x.max()]), A(m), combine=np.maximum).tolist() == [m.max()]
    rows = tasks.emit(lambda at, x: {"i": at[0][x > 0], "x": x[x > 0]}, A(m), schema="i long, x double").collect()
    assert sorted((r.i, r.x) for r in rows) == sorted((i, x) for (i, _), x in np.ndenumerate(m) if x > 0)


def test_habits_are_named(A):
    a = A([1.0, 0.0, 3.0])
    with doctor.watch() as seen:
        for _ in range(doctor.REPEATED):
            a[0].item()
        indexing.nonzero(a)
        list(a)
        max(a)
    assert {f.rule for f in doctor.findings(seen)} == {"repeated items", "nonzero", "iteration", "builtin reduction"}
    with doctor.watch() as seen:
        a.sum()
        a[0].item()
    assert doctor.findings(seen) == []


def test_files_of_slices(spark, A, tmp_path):
    from sparkarray.sources import arrays

    m = RNG.normal(size=(7, 3))
    arrays.save_npy(A(m), f"{tmp_path}/m")
    same(arrays.load(spark, f"{tmp_path}/m"), m)
    z = m + 1j * m
    np.save(f"{tmp_path}/z.npy", z)
    same(arrays.load(spark, f"{tmp_path}/z.npy"), z)
