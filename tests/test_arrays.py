"""Arrays against NumPy."""

import numpy as np
import pytest

from sparkarray.array import SparkArray
from sparkarray.functions import ufuncs as U
from sparkarray.operators import creation, hist, indexing, linalg, ordering, products, reductions, scans, shaping, signal

RNG = np.random.default_rng(4)
M = np.round(RNG.normal(size=(4, 5)), 3)
T = np.round(RNG.normal(size=(2, 3, 4)), 3)
V = np.array([3.0, -1.0, 2.5, 0.0, 7.0, 2.5, -4.0])


def same(got, want, tol=1e-9):
    got = got.to_numpy() if isinstance(got, SparkArray) else np.asarray(got)
    if got.dtype == object:
        got = np.array([complex(x["re"], x["im"]) for x in got.ravel()]).reshape(got.shape)
    assert got.shape == np.asarray(want).shape, (got.shape, np.asarray(want).shape)
    np.testing.assert_allclose(got.astype(complex), np.asarray(want).astype(complex), rtol=tol, atol=tol)


@pytest.fixture(scope="module")
def A(spark):
    return lambda x: SparkArray.from_numpy(spark, np.asarray(x))


EDGE = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 2.5, 3.5, -7.5, 0.3, -0.4, 1.0])
SKIP_UNARY = {"invert", "logical_not", "isfinite", "isinf", "isnan", "signbit", "isneginf", "isposinf", "real", "imag", "isreal", "iscomplex"}


def test_unary_ufuncs(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(EDGE)], "i long, x double")
    names = [n for n in U.UNARY if n not in ("invert",)]
    from pyspark.sql import functions as F

    rows = df.select("i", *[U.UNARY[n](F.col("x")).alias(n) for n in names]).orderBy("i").toPandas()
    with np.errstate(all="ignore"):
        for n in names:
            want = getattr(np, n)(EDGE)
            got = rows[n].to_numpy(dtype=float)
            np.testing.assert_allclose(got, want.astype(float), rtol=1e-12, atol=1e-12, err_msg=n)


def test_binary_ufuncs(spark):
    from pyspark.sql import functions as F

    pairs = [(a, b) for a in EDGE for b in EDGE]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "i long, a double, b double")
    whole = {"gcd", "lcm", "bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift", "ldexp"}
    names = [n for n in U.BINARY if n not in whole]
    rows = df.select("i", *[U.BINARY[n](F.col("a"), F.col("b")).alias(n) for n in names]).orderBy("i").toPandas()
    a, b = (np.array(x) for x in zip(*pairs))
    with np.errstate(all="ignore"):
        for n in names:
            want = getattr(np, n)(a, b).astype(float)
            got = rows[n].to_numpy(dtype=float)
            keep = np.ones(len(a), bool)
            if n in ("floor_divide", "remainder", "fmod"):
                keep = np.isfinite(a) & np.isfinite(b) & (b != 0)
            np.testing.assert_allclose(got[keep], want[keep], rtol=1e-12, atol=1e-12, err_msg=n)
    ints = [(12, 18), (-7, 3), (0, 5), (2**40, 6), (17, 2)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ints)], "i long, a long, b long")
    rows = df.select("i", *[U.BINARY[n](F.col("a"), F.col("b")).alias(n) for n in whole]).orderBy("i").toPandas()
    a, b = (np.array(x) for x in zip(*ints))
    for n in whole:
        np.testing.assert_allclose(rows[n].to_numpy(dtype=float), getattr(np, n)(a, b).astype(float), err_msg=n)
    parts = spark.createDataFrame([(float(x),) for x in (2.5, -7.5, 8.0, 0.0, 1e-300)], "x double")
    rows = parts.select(*[c.alias(n) for n, c in zip("abcd", (*U.modf(F.col("x")), *U.frexp(F.col("x"))))]).toPandas()
    x = np.array([2.5, -7.5, 8.0, 0.0, 1e-300])
    for n, want in zip("abcd", (*np.modf(x), *np.frexp(x))):
        np.testing.assert_allclose(rows[n], want)


def test_reductions(A):
    t = T.copy()
    for name in ("sum", "prod", "max", "min", "mean", "var", "std", "all", "any", "argmax", "argmin"):
        for axis in (None, 0, 2):
            same(getattr(A(t), name)(axis=axis), getattr(t, name)(axis=axis))
    same(reductions.sum(A(t), (0, 2), keepdims=True), t.sum((0, 2), keepdims=True))
    same(reductions.sum(A(t), initial=3.0), t.sum(initial=3.0))
    same(reductions.count_nonzero(A(V)), np.count_nonzero(V))
    n = t.copy()
    n[0, 1, 2] = np.nan
    for name in ("nansum", "nanprod", "nanmax", "nanmin", "nanmean", "nanargmax", "nanargmin", "nanmedian"):
        same(getattr(A(n), name)(axis=2) if name != "nanmedian" else ordering.nanmedian(A(n), 2), getattr(np, name)(n, axis=2))
    same(reductions.average(A(M), 1, A(np.arange(5.0) + 1)), np.average(M, 1, np.arange(5.0) + 1))
    same(reductions.cov(A(M)), np.cov(M))
    same(reductions.amin(A(np.array([1.0, np.nan]))), np.nan)
    assert reductions.array_equal(A(M), A(M))
    same(reductions.sum(A(M), where=A(M > 0)), M.sum(where=M > 0))


def test_ordering(A):
    same(ordering.sort(A(M), 0), np.sort(M, 0))
    same(ordering.argsort(A(M), 1), np.argsort(M, 1, kind="stable"))
    same(ordering.sort(A(V)), np.sort(V))
    same(ordering.sort(A(M), None), np.sort(M, None))
    same(ordering.lexsort([A(np.arange(7.0)), A(V)]), np.lexsort([np.arange(7.0), V]))
    same(ordering.topk(A(V), 3), np.sort(V)[::-1][:3])
    s = np.sort(V)
    for side in ("left", "right"):
        same(ordering.searchsorted(A(s), A(np.array([2.5, -9, 9, 0.1])), side), np.searchsorted(s, [2.5, -9, 9, 0.1], side))
    old, ordering.LOOKUP_VALUES = ordering.LOOKUP_VALUES, 1
    for side in ("left", "right"):
        same(ordering.searchsorted(A(s), A(np.array([2.5, -9, 9, 0.1])), side), np.searchsorted(s, [2.5, -9, 9, 0.1], side))
    ordering.LOOKUP_VALUES = old
    u, i, c = ordering.unique(A(V), True, True)
    for got, want in zip((u, i, c), np.unique(V, return_index=True, return_counts=True)):
        same(got, want)
    same(ordering.isin(A(V), A(np.array([2.5, 7.0]))), np.isin(V, [2.5, 7.0]))
    same(ordering.isin(A(V), A(np.array([2.5, 7.0])), invert=True), np.isin(V, [2.5, 7.0], invert=True))


@pytest.mark.parametrize("method", ordering.METHODS_OF_QUANTILE)
def test_quantiles(A, method):
    for x, axis in ((V, None), (M, 1), (M, 0)):
        q = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
        same(ordering.quantile(A(x), q, axis, method), np.quantile(x, q, axis, method=method))


def test_scans(A):
    for axis in (None, 0, 1):
        same(scans.cumsum(A(M), axis), np.cumsum(M, axis))
        same(scans.cumprod(A(M), axis), np.cumprod(M, axis))
    n = M.copy()
    n[1, 2] = np.nan
    same(scans.nancumsum(A(n), 1), np.nancumsum(n, 1))
    same(scans.nancumprod(A(n), 0), np.nancumprod(n, 0))
    same(scans.diff(A(M), 2, 1), np.diff(M, 2, 1))
    for edge in (1, 2):
        for got, want in zip(scans.gradient(A(M), 0.5, None, edge), np.gradient(M, 0.5, edge_order=edge)):
            same(got, want)
    p, q = RNG.normal(size=(3, 3)), RNG.normal(size=(3, 3))
    same(scans.cross(A(p), A(q)), np.cross(p, q))
    for mode in ("same", "full", "valid"):
        same(scans.convolve(A(V), [1.0, 2.0, 0.5], mode), np.convolve(V, [1.0, 2.0, 0.5], mode))
    same(scans.roots([1, -3, 2]), [2, 1])


def test_hist(A):
    x = np.array([2, 3, 3, 5, 2, 7, 6, 4])
    same(hist.bincount(A(x)), np.bincount(x))
    same(hist.bincount(A(x), A(np.arange(8.0)), 12), np.bincount(x, np.arange(8.0), 12))
    for bins in (4, [1, 5, 8], [1, 2, 3, 4, 5, 6, 7]):
        for density in (False, True):
            got, edges = hist.histogram(A(x), bins, density=density)
            want, we = np.histogram(x, bins, density=density)
            same(got, want)
            same(edges, we)
    got, *_ = hist.histogram2d(A(V), A(V[::-1].copy()), 3)
    same(got, np.histogram2d(V, V[::-1], 3)[0])
    for bins in ([0.0, 2.5, 7.0], [7.0, 2.5, 0.0]):
        for right in (False, True):
            same(hist.digitize(A(V), bins, right), np.digitize(V, bins, right))


def test_indexing(A, spark):
    a = A(T)
    for key in (1, (slice(None), 2), (Ellipsis, slice(3, None, -2)), (0, slice(0, 2), None), (slice(1, 1),)):
        same(a[key], T[key])
    same(a[A(T > 0)], T[T > 0])
    same(A(M)[A(np.array([1, 0, -1]))], M[[1, 0, -1]])
    same(indexing.gather(A(M), [A(np.array([[0], [2]])), A(np.array([1, -1]))]), M[[[0], [2]], [1, -1]])
    same(indexing.take(a, A(np.array([[0, 2], [3, 1]])), 2), np.take(T, [[0, 2], [3, 1]], 2))
    same(indexing.take(A(V), A(np.array([9, -1])), mode="wrap"), np.take(V, [9, -1], mode="wrap"))
    i = np.argsort(M, 1)
    same(indexing.take_along_axis(A(M), A(i), 1), np.take_along_axis(M, i, 1))
    w = M.copy()
    np.put_along_axis(w, i[:, :1], -9.0, 1)
    same(indexing.put_along_axis(A(M), A(i[:, :1]), A(np.full((4, 1), -9.0)), 1), w)
    w = M.copy()
    np.put(w, [1, 7, -1], [5.0, 6.0])
    same(indexing.put(A(M), A(np.array([1, 7, -1])), A(np.array([5.0, 6.0]))), w)
    w = M.copy()
    np.place(w, M > 0, [1.0, 2.0])
    same(indexing.place(A(M), A(M > 0), A(np.array([1.0, 2.0]))), w)
    w = M.copy()
    np.putmask(w, M > 0, [1.0, 2.0, 3.0])
    same(indexing.putmask(A(M), A(M > 0), A(np.array([1.0, 2.0, 3.0]))), w)
    for got, want in zip(indexing.nonzero(A(M > 0)), np.nonzero(M > 0)):
        same(got, want)
    same(indexing.argwhere(A(M > 0)), np.argwhere(M > 0))
    same(indexing.compress(A(np.array([True, False, True, True])), A(M), 0), np.compress([1, 0, 1, 1], M, 0))
    same(indexing.diagonal(a, 1, 1, 2), np.diagonal(T, 1, 1, 2))
    w = np.zeros((7, 3))
    np.fill_diagonal(w, 4.0, wrap=True)
    same(indexing.fill_diagonal(A(np.zeros((7, 3))), 4.0, True), w)
    c = np.array([0, 1, 1, 0, 2])
    same(indexing.choose(A(c), [A(M[k]) for k in range(3)]), np.choose(c, M[:3]))
    same(indexing.select([A(V > 2), A(V < 0)], [A(V), A(-V)], 9.0), np.select([V > 2, V < 0], [V, -V], 9.0))
    same(indexing.where(A(M > 0), A(M), 0.0), np.where(M > 0, M, 0.0))
    flat = np.array([3, 11, 19])
    for got, want in zip(indexing.unravel_index(A(flat), (4, 5)), np.unravel_index(flat, (4, 5))):
        same(got, want)
    same(indexing.ravel_multi_index([A(np.array([0, 3])), A(np.array([4, 1]))], (4, 5)), np.ravel_multi_index(([0, 3], [4, 1]), (4, 5)))
    same(indexing.indices(spark, (2, 3)), np.indices((2, 3)))
    for got, want in zip(indexing.tril_indices(spark, 3, 0, 4), np.tril_indices(3, 0, 4)):
        same(got, want)
    for got, want in zip(indexing.triu_indices(spark, 3, 1, 4), np.triu_indices(3, 1, 4)):
        same(got, want)


def test_shaping(A):
    a, m = A(T), A(M)
    same(a.reshape(4, -1), T.reshape(4, -1))
    same(a.reshape(6, 4, order="F"), T.reshape(6, 4, order="F"))
    same(a.transpose((2, 0, 1)), T.transpose(2, 0, 1))
    same(shaping.moveaxis(a, 0, -1), np.moveaxis(T, 0, -1))
    same(shaping.swapaxes(a, 0, 2), np.swapaxes(T, 0, 2))
    same(shaping.squeeze(shaping.expand_dims(a, (0, 2))), T)
    same(m.broadcast_to((2, 4, 5)), np.broadcast_to(M, (2, 4, 5)))
    for f in ("vstack", "hstack", "dstack", "column_stack"):
        same(getattr(shaping, f)([m, m]), getattr(np, f)([M, M]))
    same(shaping.stack([m, m], 1), np.stack([M, M], 1))
    same(shaping.block([[m, m], [m, m]]), np.block([[M, M], [M, M]]))
    same(shaping.append(A(V), A(V)), np.append(V, V))
    for got, want in zip(shaping.array_split(A(V), 3), np.array_split(V, 3)):
        same(got, want)
    for got, want in zip(shaping.hsplit(m, [2, 3]), np.hsplit(M, [2, 3])):
        same(got, want)
    same(shaping.tile(m, (2, 1, 3)), np.tile(M, (2, 1, 3)))
    same(shaping.repeat(m, 2, 1), np.repeat(M, 2, 1))
    same(shaping.repeat(A(V), A(np.array([0, 1, 2, 0, 3, 1, 1]))), np.repeat(V, [0, 1, 2, 0, 3, 1, 1]))
    same(shaping.flip(a, (0, 2)), np.flip(T, (0, 2)))
    for k in range(4):
        same(shaping.rot90(m, k), np.rot90(M, k))
    same(shaping.roll(m, 3), np.roll(M, 3))
    same(shaping.roll(m, (1, -2), (0, 1)), np.roll(M, (1, -2), (0, 1)))
    same(shaping.delete(m, [1, -1], 1), np.delete(M, [1, -1], 1))
    same(shaping.insert(A(V), [0, 3, -1], [7.0, 8.0, 9.0]), np.insert(V, [0, 3, -1], [7.0, 8.0, 9.0]))
    for mode in ("constant", "edge", "reflect", "symmetric", "wrap", "maximum", "minimum", "mean", "linear_ramp"):
        same(shaping.pad(m, ((1, 2), (3, 1)), mode), np.pad(M, ((1, 2), (3, 1)), mode))
    b = (RNG.random(19) > 0.5).astype(int)
    for order in ("big", "little"):
        same(shaping.packbits(A(b), bitorder=order), np.packbits(b, bitorder=order))
        same(shaping.unpackbits(A(np.array([200, 3])), bitorder=order), np.unpackbits(np.array([200, 3], "u1"), bitorder=order))
    same(a + A(T[0]), T + T[0])
    same(2.0 - m, 2.0 - M)
    same(abs(-m) // 2.0, np.abs(M) // 2.0)


def test_creation(A, spark):
    c = creation
    same(c.arange(spark, 2, 11, 3), np.arange(2, 11, 3))
    same(c.linspace(spark, 0, 1, 7), np.linspace(0, 1, 7))
    same(c.logspace(spark, 0, 2, 5), np.logspace(0, 2, 5))
    same(c.eye(spark, 3, 4, 1), np.eye(3, 4, 1))
    same(c.tri(spark, 3, 4, 1), np.tri(3, 4, 1))
    same(c.tril(A(M), 1), np.tril(M, 1))
    same(c.triu(A(M)), np.triu(M))
    same(c.diag(A(V), -1), np.diag(V, -1))
    same(c.diag(A(M), 1), np.diag(M, 1))
    same(c.vander(A(V), 3), np.vander(V, 3))
    same(c.full(spark, (2, 2), 7), np.full((2, 2), 7))
    for got, want in zip(c.meshgrid(A(V), A(V[:3])), np.meshgrid(V, V[:3])):
        same(got, want)
    same(c.mgrid(spark, slice(0, 2), slice(1, 4)), np.mgrid[0:2, 1:4])


def test_products(A):
    n = RNG.normal(size=(5, 3))
    same(products.matmul(A(M), A(n)), M @ n)
    same(products.dot(A(V), A(V)), V @ V)
    same(products.outer(A(V), A(V)), np.outer(V, V))
    same(products.inner(A(M), A(M)), np.inner(M, M))
    same(products.tensordot(A(T), A(T), ([0, 2], [0, 2])), np.tensordot(T, T, ([0, 2], [0, 2])))
    for e, ops in (("ij,jk->ik", (M, n)), ("ij->j", (M,)), ("ii->i", (M[:, :4],)), ("ij,jk,kl->il", (M, n, n.T)), ("ijk,ik->j", (T, T[:, 0]))):
        same(products.einsum(e, *[A(x) for x in ops]), np.einsum(e, *ops))
    same(products.trace(A(M), 1), np.trace(M, 1))
    same(products.multi_dot([A(M), A(n), A(n.T)]), M @ n @ n.T)
    s = M[:, :4]
    same(products.matrix_power(A(s), 5), np.linalg.matrix_power(s, 5), 1e-7)
    b = RNG.normal(size=(2, 4, 3))
    same(products.matmul(A(T), A(b)), T @ b)
    same(linalg.tiled_matmul(A(M), A(n), 2), M @ n)


def test_linalg(A):
    s = M[:, :4] @ M[:, :4].T + 4 * np.eye(4)
    same(linalg.cholesky(A(s)), np.linalg.cholesky(s))
    same(linalg.inv(A(s)), np.linalg.inv(s))
    same(linalg.solve(A(s), A(V[:4])), np.linalg.solve(s, V[:4]))
    same(linalg.cho_solve(linalg.cho_factor(A(s), True), A(V[:4])), np.linalg.solve(s, V[:4]))
    q, r = linalg.qr(A(M))
    same(q.to_numpy() @ r.to_numpy(), M)
    u, w, v = linalg.svd(A(M), False)
    same((u.to_numpy() * w.to_numpy()) @ v.to_numpy(), M)
    w, v = linalg.eigh(A(s))
    same(w, np.linalg.eigvalsh(s))
    same(linalg.pinv(A(M)), np.linalg.pinv(M))
    same(linalg.gram(A(M.T)), M @ M.T)
    u, w, v = linalg.tssvd(A(M.T))
    same(w, np.linalg.svd(M)[1], 1e-6)
    for o in (None, 1, np.inf, -np.inf, 0, 3):
        same(linalg.norm(A(V), o), np.linalg.norm(V, o))
    for o in (None, 1, -1, np.inf, -np.inf, "fro", 2, "nuc"):
        same(linalg.norm(A(M), o), np.linalg.norm(M, o))
    small = s / 8
    k, want, term = 1, np.eye(4), np.eye(4)
    for k in range(1, 40):
        term = term @ small / k
        want = want + term
    same(linalg.expm(A(small)), want)
    stack = np.stack([s, s + np.eye(4)])
    same(linalg.inv(A(stack)), np.linalg.inv(stack))
    same(linalg.solve_triangular(A(np.tril(s)), A(V[:4]), lower=True), np.linalg.solve(np.tril(s), V[:4]))


def test_signal(A, spark):
    for k in ("fft", "ifft", "rfft", "hfft", "ihfft"):
        same(signal.transform(A(V), k), getattr(np.fft, k)(V))
    same(signal.irfft(signal.rfft(A(V[:6]))), V[:6])
    same(signal.fft2(A(M)), np.fft.fft2(M))
    same(signal.rfftn(A(T)), np.fft.rfftn(T))
    same(signal.irfftn(signal.rfftn(A(T))), T)
    same(signal.fftshift(A(V)), np.fft.fftshift(V))
    same(signal.ifftshift(A(M)), np.fft.ifftshift(M))
    for f in ("bartlett", "blackman", "hamming", "hanning"):
        same(getattr(signal, f)(spark, 7), getattr(np, f)(7))
    same(signal.kaiser(spark, 8, 5.0), np.kaiser(8, 5.0))
    w = [1.0, 2.0, 4.0]
    padded = np.concatenate([[V[0]], V, [V[-1]]])
    same(signal.ndimage_convolve(A(V), w, "nearest"), np.convolve(padded, w, "valid"))
    same(signal.ndimage_convolve(A(V), w, "constant"), np.convolve(V, w, "same"))
    x = signal.fourier_gaussian(signal.fft(A(V)), 1.5)
    same(x, np.fft.fft(V) * np.exp(-2 * (np.pi * 1.5) ** 2 * np.fft.fftfreq(7) ** 2))


Z = np.array([1 + 2j, -1.5 + 0j, -2j, 3 - 4j, 0.5 + 0.5j, -0.25 - 0.75j])
W = np.array([2 - 1j, 1 + 1j, 0.5j, -1 + 0j, 4 + 0j, -3 + 2j])


def test_complex_ufuncs(A):
    z, w = A(Z), A(W)
    for name in ("negative", "conjugate", "square", "reciprocal", "exp", "exp2", "expm1", "log", "log2", "log10", "log1p", "sqrt", "sin", "cos", "tan", "sinh", "cosh", "tanh", "arcsin", "arccos", "arctan", "arcsinh", "arccosh", "arctanh", "absolute", "real", "imag", "isfinite", "isnan"):
        same(z.ufunc(name), getattr(np, name)(Z), 1e-8)
    same(z.ufunc("angle"), np.angle(Z))
    for name in ("add", "subtract", "multiply", "true_divide", "power", "equal", "not_equal"):
        same(z.ufunc(name, w), getattr(np, name)(Z, W), 1e-8)
    same(2.0 - z, 2.0 - Z)
    same((1 + 1j) * z, (1 + 1j) * Z)
    same(A(np.arange(6.0)) * z, np.arange(6.0) * Z)
    same(z > w, np.greater(Z, W))


def test_complex_sums_and_products(A):
    z = Z.reshape(2, 3)
    same(reductions.sum(A(z), 0), z.sum(0))
    same(reductions.mean(A(z)), z.mean())
    same(products.matmul(A(z), A(z.T)), z @ z.T)
    same(products.einsum("ij,j->i", A(z), A(np.array([1.0, 2.0, 3.0]))), np.einsum("ij,j->i", z, [1.0, 2.0, 3.0]))
    same(products.vdot(A(Z), A(W)), np.vdot(Z, W))
    from sparkarray.operators import misc

    same(misc.sort_complex(A(Z)), np.sort_complex(Z))
    same(misc.real_if_close(A(Z.real + 0j)), Z.real)


def test_transforms_of_lines(A):
    t = T.copy()
    for name in ("fft", "ifft", "rfft", "ihfft"):
        for axis in (0, 1, 2):
            same(getattr(signal, name)(A(t), axis=axis), getattr(np.fft, name)(t, axis=axis))
    z = np.fft.fft(t)
    same(signal.irfft(A(z), 5), np.fft.irfft(z, 5))
    same(signal.hfft(A(z)), np.fft.hfft(z))
    same(signal.fft(A(t), 6, 1, "ortho"), np.fft.fft(t, 6, 1, "ortho"))


def test_tiled_products(A):
    a, b = RNG.normal(size=(13, 9)), RNG.normal(size=(9, 11))
    for block in (4, 16):
        same(linalg.tiled_matmul(A(a), A(b), block), a @ b)


def test_even_bins(A):
    x = np.concatenate([np.linspace(0, 1, 31), RNG.random(50), [0.1, 0.3, 0.7, 1.0, -0.5, 2.0]])
    for bins, lo, hi in ((10, 0.0, 1.0), (7, -0.3, 0.9), (3, 0.1, 0.4)):
        got, edges = hist.histogram(A(x), bins, (lo, hi))
        step = (hi - lo) / bins
        own = [lo + k * step for k in range(bins)] + [hi]
        assert edges == own
        same(got, np.histogram(x, own)[0])


def test_namespace(spark, A):
    from sparkarray import namespace as np_

    same(np_.add(A(M), 1.0), M + 1)
    same(np_.sum(A(M), 0), M.sum(0))
    same(np_.zeros((2, 3)), np.zeros((2, 3)))
    same(np_.linalg.norm(A(V)), np.linalg.norm(V))
    same(np_.fft.fft(A(V)), np.fft.fft(V))
    same(np_.arange(5), np.arange(5))
    same(np_.astype(A(V), "complex128"), V.astype(complex))
    assert np_.random.rand(3, 2).shape == (3, 2)
    assert np_.broadcast_shapes((3, 1), (1, 4)) == (3, 4) and np_.isscalar(3) and np_.iscomplexobj(A(Z))
    assert np_.pi == np.pi and np_.isdtype("double", "real floating")
    with pytest.raises(AttributeError):
        np_.no_such_function  # noqa: B018


def test_attributes(A):
    a = A(T)
    same(a.mT, T.swapaxes(-1, -2))
    same(a.flat, T.ravel())
    same(a.fill(2.0), np.full(T.shape, 2.0))
    assert a.itemsize == 8 and a.nbytes == T.nbytes and a.strides == T.strides and a.base is None and a.view() is a
    import io

    np.testing.assert_array_equal(np.load(io.BytesIO(a.dumps())), T)


def test_index_helpers(A):
    from sparkarray.operators import misc

    for got, want in zip(misc.ix_(A(np.array([0, 2])), A(np.array([1, 3, 4]))), np.ix_([0, 2], [1, 3, 4])):
        same(got, want)
    same(A(M)[misc.ix_(A(np.array([0, 2])), A(np.array([1, 3, 4])))], M[np.ix_([0, 2], [1, 3, 4])])
    for got, want in zip(misc.tril_indices_from(A(M), -1), np.tril_indices_from(M, -1)):
        same(got, want)
    b = misc.broadcast(A(M), A(M[0]))
    assert b.shape == M.shape and b.numiter == 2 and b.size == M.size
    with pytest.raises(ValueError):
        misc.normalize_axis_tuple((0, 0), 2)


def test_lint(spark):
    from sparkarray.plans import lint

    wide = spark.range(10).crossJoin(spark.range(10).withColumnRenamed("id", "b"))
    assert "every-pair join" in {f.rule for f in lint.lint(wide)}
    assert lint.report(spark.range(5)) == "nothing found"
    assert lint.report(wide, "csv").startswith("rule,count,meaning") and lint.report(wide, "json").startswith("[")


def test_setting_cells(A):
    def held(key, value, own=None):
        a, m = A(T.copy()), T.copy()
        a[key] = value
        m[key if own is None else own] = value.to_numpy() if isinstance(value, SparkArray) else value
        same(a, m)

    held((0, slice(None), 1), 7.0)
    held((slice(None), 1), A(np.arange(4.0)))
    held((Ellipsis, slice(None, None, 2)), [[1.0, 2.0]])
    held(A(T > 0), 0.0, T > 0)
    idx = np.array([1, 0, 1])
    held(A(idx), 5.0, idx)
    a, m = A(V.copy()), V.copy()
    a[A(np.array([1, 3, 1]))] = A(np.array([10.0, 20.0, 30.0]))
    m[[1, 3, 1]] = [10.0, 20.0, 30.0]
    same(a, m)


def test_python_protocols(A):
    a = A(M)
    assert float(a[0, 0]) == M[0, 0] and int(A(np.array([3]))) == 3 and bool(A(np.array([0.0]))) is False and 2.5 in A(V) and 9.5 not in A(V)
    for got, want in zip(a, M):
        same(got, want)
    same(np.add(a, 1.0), M + 1)
    same(np.multiply(2.0, a), 2 * M)
    same(np.sum(a, 1), M.sum(1))
    np.testing.assert_array_equal(np.asarray(a), M)
    for got, want in zip(divmod(a, 0.7), divmod(M, 0.7)):
        same(got, want)
    assert repr(a) == "SparkArray(shape=(4, 5), dtype=double)"
    with pytest.raises(TypeError):
        float(a)
