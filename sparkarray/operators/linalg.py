"""Dense factorizations. Tall matrices go through Gram matrices (an aggregate); a small matrix is one grouped Arrow kernel.

The kernels work on whole matrices of at most ``KERNEL_CELLS`` cells, checked by shape; stacks of matrices are one group
each. Larger ones are factorized by blocks (``cholesky``, triangular systems) or through their Gram matrix (``qr``, ``solve``,
``tssvd``), whose condition is the square of theirs.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, norm_axis
from sparkarray.operators.products import _tiled, einsum, matmul
from sparkarray.session import cut
from sparkarray.operators.reductions import amax, amin, count_nonzero, reduce, sum as total

KERNEL_CELLS = 16_000_000


def kernel(a: SparkArray, f: Callable[[np.ndarray], tuple[np.ndarray, ...] | np.ndarray], outs: list[tuple], others: list[SparkArray] = ()) -> list[SparkArray]:
    """f on every matrix of the last two axes (and on its partners in ``others``); each out is its trailing shape."""
    lead = a.ndim - 2
    if a.shape[-1] * a.shape[-2] > KERNEL_CELLS:
        raise ValueError(f"a matrix of more than {KERNEL_CELLS} cells needs a tiled or Gram form")
    batch = [f"i{k}" for k in range(lead)]
    rows = None
    ranks = []
    for n, x in enumerate([a, *others]):
        own = x.ndim - lead
        ranks.append((own, x.shape[lead:]))
        part = x.df.select(*batch, F.lit(n).alias("_n"), F.col(f"i{lead}").alias("_r"), (F.col(f"i{lead + 1}") if own > 1 else F.lit(0).cast("long")).alias("_c"), F.col("v").cast("double").alias("v"))
        rows = part if rows is None else rows.unionByName(part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        args = []
        for n, (own, shape) in enumerate(ranks):
            m = np.zeros(shape if own > 1 else (*shape, 1))
            part = pdf[pdf["_n"] == n]
            m[part["_r"].to_numpy(), part["_c"].to_numpy()] = part["v"].to_numpy()
            args.append(m if own > 1 else m[:, 0])
        got = f(*args)
        got = got if isinstance(got, tuple) else (got,)
        frames = []
        for n, g in enumerate(got):
            g = np.asarray(g)
            g2 = g.reshape(g.shape[0], -1) if g.ndim else g.reshape(1, 1)
            r, c = np.indices(g2.shape)
            frames.append(pd.DataFrame({"_n": n, "_r": r.ravel(), "_c": c.ravel(), "re": g2.real.ravel().astype("f8"), "im": g2.imag.ravel().astype("f8")}))
        out = pd.concat(frames)
        for b in batch:
            out[b] = pdf[b].iloc[0]
        return out[[*batch, "_n", "_r", "_c", "re", "im"]]

    schema = ", ".join([*(f"{b} long" for b in batch), "_n long, _r long, _c long, re double, im double"])
    got = (rows.groupBy(*batch) if batch else rows.groupBy(F.lit(0).alias("_one"))).applyInPandas(run, schema)
    result = []
    for n, shape in enumerate(outs):
        complex_ = shape and shape[0] == "complex"
        shape = tuple(s for s in shape if s != "complex")
        v = F.struct("re", "im") if complex_ else F.col("re")
        axes = [F.col("_r"), F.col("_c")][: len(shape)]
        result.append(SparkArray(got.filter(F.col("_n") == n).select(*batch, *[x.alias(f"i{lead + k}") for k, x in enumerate(axes)], v.alias("v")), (*a.shape[:lead], *shape)))
    return result


def _square(a):
    if a.shape[-1] != a.shape[-2]:
        raise ValueError("matrix must be square")
    return a.shape[-1]


def cholesky(a, upper=False):
    n = _square(a)
    if a.ndim == 2 and n * n > KERNEL_CELLS:
        low = blocked_cholesky(a)
        return low.T if upper else low
    return kernel(a, lambda m: np.linalg.cholesky(m).T if upper else np.linalg.cholesky(m), [(n, n)])[0]


def cho_factor(a, lower=False):
    return cholesky(a, not lower), lower


def qr(a):
    """Reduced. A matrix too large for one kernel, at least as tall as wide, goes through its Gram matrix, twice."""
    m, n = a.shape[-2:]
    k = min(m, n)
    if a.ndim == 2 and m * n > KERNEL_CELLS and m >= n:
        return gram_qr(a)
    return kernel(a, lambda x: tuple(np.linalg.qr(x)), [(m, k), (k, n)])


def svd(a, full_matrices=True):
    m, n = a.shape[-2:]
    k = min(m, n)
    return kernel(a, lambda x: tuple(np.linalg.svd(x, full_matrices)), [(m, m if full_matrices else k), (k,), (n if full_matrices else k, n)])


def eig(a):
    n = _square(a)
    return kernel(a, lambda x: tuple(y.astype(complex) for y in np.linalg.eig(x)), [("complex", n), ("complex", n, n)])


def eigvals(a):
    return kernel(a, lambda x: np.linalg.eigvals(x).astype(complex), [("complex", _square(a))])[0]


def eigh(a, uplo="L"):
    n = _square(a)
    return kernel(a, lambda x: tuple(np.linalg.eigh(x, uplo)), [(n,), (n, n)])


def eigvalsh(a, uplo="L"):
    return kernel(a, lambda x: np.linalg.eigvalsh(x, uplo), [(_square(a),)])[0]


def solve(a, b):
    """A matrix too large for one kernel is solved by its Q and R."""
    if a.ndim == 2 and a.size > KERNEL_CELLS:
        q, r = gram_qr(a)
        return solve_triangular(r, matmul(q.T, b))
    return kernel(a, np.linalg.solve, [b.shape[a.ndim - 2 :]], [b])[0]


def cho_solve(factor, b):
    c, lower = factor

    def run(m, y):
        low = m if lower else m.T
        return np.linalg.solve(low.T, np.linalg.solve(low, y))

    return kernel(c, run, [b.shape[c.ndim - 2 :]], [b])[0]


cholesky_solve = cho_solve


def solve_triangular(a, b, trans=0, lower=False, unit_diagonal=False):
    if a.ndim == 2 and a.size > KERNEL_CELLS:
        t = a.T if trans else a
        return blocked_triangular(t, b, lower != bool(trans), unit_diagonal)

    def run(m, y):
        m = np.tril(m) if lower else np.triu(m)
        if unit_diagonal:
            np.fill_diagonal(m, 1)
        return np.linalg.solve(m.T if trans else m, y)

    return kernel(a, run, [b.shape[a.ndim - 2 :]], [b])[0]


def inv(a):
    n = _square(a)
    return kernel(a, np.linalg.inv, [(n, n)])[0]


def pinv(a, rtol=1e-5):
    m, n = a.shape[-2:]
    return kernel(a, lambda x: np.linalg.pinv(x, rcond=rtol), [(n, m)])[0]


def det(a):
    return kernel(a, lambda x: np.array([np.linalg.det(x)]), [(1,)])[0]


def expm(a):
    """Scaling and squaring with a Pade approximant."""
    n = _square(a)

    def run(x):
        s = max(0, int(np.ceil(np.log2(max(np.linalg.norm(x, 1), 1e-300)))) + 1)
        x = x / 2.0**s
        term, up, down, c = np.eye(n), np.eye(n), np.eye(n), 1.0
        for k in range(1, 9):
            c *= (9 - k) / (k * (17 - k))
            term = term @ x
            up, down = up + c * term, down + (-1) ** k * c * term
        out = np.linalg.solve(down, up)
        for _ in range(s):
            out = out @ out
        return out

    return kernel(a, run, [(n, n)])[0]


def gram(a):
    """A'A of a tall matrix: rows are gathered once, every task sums the products of its rows, the sums are added."""
    d = a.shape[1]
    if d * d > KERNEL_CELLS:
        return matmul(a.T, a)
    rows = a.df.select("i0", F.struct(F.col("i1").cast("int").alias("k"), F.col("v").cast("double").alias("v")).alias("x")).groupBy("i0").agg(F.collect_list("x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            most = max(1, 4_000_000 // max(d, 1))
            for part in (b.slice(k, most) for k in range(0, b.num_rows, most)):
                cells = part.column(0).flatten()
                m = np.zeros((part.num_rows, d))
                m[np.repeat(np.arange(part.num_rows), np.diff(part.column(0).offsets.to_numpy())), cells.field(0).to_numpy()] = cells.field(1).to_numpy()
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))], ["i0", "row"])

    parts = rows.select("x").mapInArrow(run, "i0 long, row array<double>").select("i0", F.posexplode("row").alias("p", "v"))
    return SparkArray(parts.groupBy("i0", "p").agg(F.sum("v").alias("v")).select("i0", F.col("p").cast("long").alias("i1"), "v"), (d, d))


def tssvd(a):
    """Of a tall matrix: eigenvalues of its Gram matrix, largest first; U = A V / s."""
    w, v = eigh(gram(a))
    n = a.shape[1]
    s = SparkArray(w.df.select((F.lit(n - 1) - F.col("i0")).alias("i0"), F.sqrt(F.greatest(F.col("v"), F.lit(0.0))).alias("v")), (n,))
    v = SparkArray(v.df.select("i0", (F.lit(n - 1) - F.col("i1")).alias("i1"), "v"), (n, n))
    u = matmul(a, v).binary(s, lambda x, y: x / y)
    return u, s, v.transpose()


def norm(x, ord=None, axis=None, keepdims=False):  # noqa: A002
    """Vector norms along an axis; for two axes the matrix norms 1, inf, -1, -inf, fro, 2, -2, nuc."""
    if axis is None and (ord is None or x.ndim == 1):
        axis, x, ord = 0, x.ravel(), ord if x.ndim == 1 else None  # noqa: A001
    if axis is None:
        axis = (0, 1)
    if isinstance(axis, int):
        v = F.abs(F.col("v").cast("double"))
        aggs = {float("inf"): F.max(v), float("-inf"): F.min(v), 0: F.sum((v != 0).cast("double")), 1: F.sum(v)}
        agg = aggs[ord] if ord in aggs else F.sqrt(F.sum(v * v)) if ord in (None, 2) else F.pow(F.sum(F.pow(v, F.lit(float(ord)))), F.lit(1.0 / ord))
        return reduce(x, agg, axis, keepdims)
    p, q = (norm_axis(k, x.ndim) for k in axis)
    a = x.map(lambda v: F.abs(v.cast("double")))
    if ord in (None, "fro"):
        return reduce(a, F.sqrt(F.sum(F.col("v") * F.col("v"))), (p, q), keepdims)
    if ord in (2, -2, "nuc"):
        s = svd(x, False)[1]
        return {2: amax, -2: amin, "nuc": total}[ord](s, -1)
    sums = total(a, p if abs(ord) == 1 else q, True)
    return (amax if ord > 0 else amin)(sums, (p, q), keepdims)


#: Side of the blocks of a factorization that no kernel holds whole.
BLOCK = 2048


def _block(a: SparkArray, i: int, j: int, rows: int, cols: int, n: int, m: int) -> SparkArray:
    """The block (i, j) as a matrix of its own."""
    h, w = min(rows, n - i * rows), min(cols, m - j * cols)
    lo, left = i * rows, j * cols
    df = a.df.filter((F.col("i0") >= lo) & (F.col("i0") < lo + h) & (F.col("i1") >= left) & (F.col("i1") < left + w))
    return SparkArray(df.select((F.col("i0") - lo).alias("i0"), (F.col("i1") - left).alias("i1"), "v"), (h, w))


def _rows_below(a: SparkArray, lo: int, left: int, right: int) -> SparkArray:
    df = a.df.filter((F.col("i0") >= lo) & (F.col("i1") >= left) & (F.col("i1") < right))
    return SparkArray(df.select((F.col("i0") - lo).alias("i0"), (F.col("i1") - left).alias("i1"), "v"), (a.shape[0] - lo, right - left))


def blocked_cholesky(a: SparkArray, side: int = BLOCK) -> SparkArray:
    """Right-looking, by block columns: the diagonal block is one kernel, the panel below it a product with its inverse, what
    is left loses the panel's product with itself (by tiles) and is cut, so plans don't grow with the number of blocks.
    """
    n, done, rest = a.shape[0], None, a.astype("double")
    for k in range(0, n, side):
        h = min(side, n - k)
        local = SparkArray(rest.df, (n - k, n - k))
        low = SparkArray(cut(cholesky(_block(local, 0, 0, h, h, h, h)).df), (h, h))
        parts = [low.df.select((F.col("i0") + k).alias("i0"), (F.col("i1") + k).alias("i1"), "v")]
        if k + h < n:
            panel = _rows_below(local, h, 0, h)
            panel = SparkArray(cut(matmul(panel, inv(low).T).df), panel.shape)
            parts.append(panel.df.select((F.col("i0") + k + h).alias("i0"), (F.col("i1") + k).alias("i1"), "v"))
            rest = SparkArray(cut((_rows_below(local, h, h, n - k) - matmul(panel, panel.T)).df), (n - k - h, n - k - h))
        for p in parts:
            done = p if done is None else done.unionByName(p)
    from sparkarray.operators.creation import grid

    full = grid(a.spark, (n, n)).join(done.filter("i1 <= i0"), ["i0", "i1"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return SparkArray(full, (n, n))


def blocked_triangular(a: SparkArray, b: SparkArray, lower: bool, unit_diagonal: bool = False, side: int = BLOCK) -> SparkArray:
    """Block by block along the diagonal; each block's solution is taken off the right side of those that follow."""
    n, vector = a.shape[0], b.ndim == 1
    right = b.reshape(n, 1) if vector else b
    right, found = right.astype("double"), None
    steps = range(0, n, side)
    for k in steps if lower else reversed(steps):
        h = min(side, n - k)
        own = SparkArray(a.df.filter((F.col("i0") >= k) & (F.col("i0") < k + h) & (F.col("i1") >= k) & (F.col("i1") < k + h)).select((F.col("i0") - k).alias("i0"), (F.col("i1") - k).alias("i1"), "v"), (h, h))
        mine = SparkArray(right.df.filter((F.col("i0") >= k) & (F.col("i0") < k + h)).select((F.col("i0") - k).alias("i0"), "i1", "v"), (h, right.shape[1]))
        x = SparkArray(cut(solve_triangular(own, mine, 0, lower, unit_diagonal).df), mine.shape)
        part = x.df.select((F.col("i0") + k).alias("i0"), "i1", "v")
        found = part if found is None else found.unionByName(part)
        others = F.col("i0") >= k + h if lower else F.col("i0") < k
        column = SparkArray(a.df.filter(others & (F.col("i1") >= k) & (F.col("i1") < k + h)).select("i0", (F.col("i1") - k).alias("i1"), "v"), (n, h))
        if (k + h < n) if lower else k:
            less = matmul(column, x).df.withColumnRenamed("v", "w")
            new = right.df.filter(others).join(less, ["i0", "i1"], "left").withColumn("v", F.col("v") - F.coalesce("w", F.lit(0.0)))
            right = SparkArray(cut(new), right.shape)
    out = SparkArray(found, right.shape)
    return out.reshape(n) if vector else out


def gram_qr(a: SparkArray) -> list[SparkArray]:
    """Q = A R^-1 with R from the Gram matrix's Cholesky factor; done twice, which restores what the square loses."""
    q, r = SparkArray(a.astype("double").df, a.shape), None
    for _ in range(2):
        up = cholesky(gram(q), True)
        up = SparkArray(cut(up.df), up.shape)
        inverse = solve_triangular(up, _identity(a, up.shape[0]))
        q = SparkArray(cut(matmul(q, inverse).df), a.shape)
        r = up if r is None else matmul(up, r)
    return [q, r]


def _identity(a: SparkArray, n: int) -> SparkArray:
    from sparkarray.operators.creation import identity

    return identity(a.spark, n)


def matrix_rank(a, tol=1e-10):
    return count_nonzero(svd(a, False)[1].map(lambda v: v > tol))


def tiled_matmul(a, b, block: int = 512):
    """The product of two matrices by tiles of a given side, whatever their size."""
    extent = {"i": a.shape[0], "k": a.shape[1], "j": b.shape[1]}
    named = lambda x, p, q: x.df.select(F.col("i0").alias(f"m_{p}"), F.col("i1").alias(f"m_{q}"), "v")
    _, df, _ = _tiled(["i", "k"], named(a, "i", "k"), ["k", "j"], named(b, "k", "j"), {"i", "j"}, extent, block)
    return SparkArray(df.select(F.col("m_i").alias("i0"), F.col("m_j").alias("i1"), "v"), (a.shape[0], b.shape[1]))


METHODS = {f.__name__: f for f in (cholesky, qr, svd, eig, eigvals, eigh, eigvalsh, solve, inv, pinv, det, expm, gram, tssvd, norm)}
METHODS |= {"einsum": lambda a, expr, *o: einsum(expr, a, *o)}
