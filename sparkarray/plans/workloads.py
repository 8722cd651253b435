"""Iterative workloads: state that is small stays in the plan as literals, state that is large is cut by checkpoints.

Rows are read in each round by one aggregate; what comes back to the driver is the model (a few numbers), never the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkarray.array import SparkArray
from sparkarray.operators import products, signal
from sparkarray.session import cut


def _vector(x: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(a)) for a in x])


def _dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)


def kmeans(rows: DataFrame, vector: str, centres: np.ndarray, rounds: int = 10, tolerance: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
    """Lloyd's rounds over an array column. Gives the centres, and the rows with ``cluster``.

    A round is one aggregate by cluster and dimension; an empty cluster keeps its centre.
    """
    v = F.transform(vector, lambda x: x.cast("double"))

    def near(c: np.ndarray) -> Column:
        far = [F.named_struct(F.lit("d"), float(x @ x) - 2 * _dot(v, _vector(x)), F.lit("k"), F.lit(k)) for k, x in enumerate(c)]
        return F.array_min(F.array(*far))["k"]

    for _ in range(rounds):
        cells = rows.select(near(centres).alias("cluster"), F.posexplode(v).alias("p", "x"))
        new = centres.copy()
        for r in cells.groupBy("cluster", "p").agg(F.avg("x").alias("x")).collect():  # centres x dimensions numbers
            new[r.cluster, r.p] = r.x
        moved = np.abs(new - centres).max()
        centres = new
        if moved <= tolerance:
            break
    return centres, rows.withColumn("cluster", near(centres))


def linear_regression(rows: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    """Least squares with an intercept (last) by the normal equations: one aggregate of sums of products."""
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    n, y = len(x), F.col(target).cast("double")
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i + 1)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(n)]
    got = rows.agg(*sums).first()
    a = np.array([[got[f"a{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
    return np.linalg.lstsq(a, np.array([got[f"b{i}"] for i in range(n)]), rcond=None)[0]


def logistic_regression(rows: DataFrame, features: Sequence[str], target: str, rounds: int = 20, tolerance: float = 1e-9) -> np.ndarray:
    """Newton's rounds with an intercept (last); each is one aggregate of the gradient and the curvature."""
    x = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    n, w = len(x), np.zeros(len(x))
    for _ in range(rounds):
        z = sum((x[i] * float(w[i]) for i in range(1, n)), x[0] * float(w[0]))
        p = F.col("_p")
        seen = rows.withColumn("_p", 1 / (1 + F.exp(-z))).agg(
            *[F.sum((p - F.col(target).cast("double")) * x[i]).alias(f"g{i}") for i in range(n)],
            *[F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i + 1)],
        )
        got = seen.first()
        h = np.array([[got[f"h{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
        step = np.linalg.lstsq(h, np.array([got[f"g{i}"] for i in range(n)]), rcond=None)[0]
        w = w - step
        if np.abs(step).max() <= tolerance:
            break
    return w


def conjugate_gradient(a: SparkArray, b: SparkArray, rounds: int | None = None, tolerance: float = 1e-10) -> SparkArray:
    """Solves a x = b for a symmetric positive matrix; each round is one product with the matrix. Vectors are cut every round."""
    a = SparkArray(cut(a.df), a.shape)
    square = lambda v: float(v.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)
    x, r = b.map(lambda v: F.lit(0.0)), SparkArray(cut(b.astype("double").df), b.shape)
    p, rr = r, square(r)
    first = rr
    for _ in range(rounds or b.size):
        if rr <= tolerance * tolerance * max(first, 1e-300):
            break
        q = SparkArray(cut(products.matmul(a, p).df), b.shape)
        step = rr / float(products.dot(p, q).item())
        x, r = SparkArray(cut((x + p * step).df), b.shape), SparkArray(cut((r - q * step).df), b.shape)
        new = square(r)
        p, rr = SparkArray(cut((r + p * (new / rr)).df), b.shape), new
    return x


def jacobi(grid: SparkArray, rounds: int, every: int = 4) -> SparkArray:
    """Means of the four neighbours inside a fixed border; lineage is cut every few rounds."""
    n, m = grid.shape
    inside = (F.col("i0") > 0) & (F.col("i0") < n - 1) & (F.col("i1") > 0) & (F.col("i1") < m - 1)
    cross = [[0.0, 0.25, 0.0], [0.25, 0.0, 0.25], [0.0, 0.25, 0.0]]
    for k in range(rounds):
        new = signal.ndimage_convolve(grid, cross, "nearest")
        both = grid.df.join(new.df.withColumnRenamed("v", "w"), grid.axes)
        grid = SparkArray(both.withColumn("v", F.when(inside, F.col("w")).otherwise(F.col("v"))), grid.shape)
        if (k + 1) % every == 0:
            grid = SparkArray(cut(grid.df), grid.shape)
    return grid


def richardson_lucy(image: SparkArray, kernel, rounds: int) -> SparkArray:
    """Deconvolution: two filters and two elementwise steps a round, cut after each."""
    kernel = np.asarray(kernel, "f8")
    out = image.map(lambda v: F.lit(0.5))
    for _ in range(rounds):
        seen = signal.ndimage_convolve(out, kernel, "constant")
        back = signal.ndimage_convolve(image / seen, kernel[::-1, ::-1], "constant")
        out = SparkArray(cut((out * back).df), image.shape)
    return out


def black_scholes(options: DataFrame, rate: float = 0.02, volatility: float = 0.3) -> DataFrame:
    """Adds ``call`` and ``put`` to rows of s (price), x (strike) and t (years): one projection."""
    d1 = (F.log(F.col("s") / F.col("x")) + (rate + volatility * volatility / 2) * F.col("t")) / (volatility * F.sqrt("t"))
    k = lambda d: 1 / (1 + 0.2316419 * F.abs(d))
    # The five coefficients of the usual polynomial for the normal distribution.
    poly = lambda d: k(d) * (0.31938153 + k(d) * (-0.356563782 + k(d) * (1.781477937 + k(d) * (-1.821255978 + k(d) * 1.330274429))))
    low = lambda d: 0.3989422804014327 * F.exp(-0.5 * d * d) * poly(d)
    cnd = lambda d: F.when(d > 0, 1 - low(d)).otherwise(low(d))
    df = options.withColumn("_d1", d1).withColumn("_d2", F.col("_d1") - volatility * F.sqrt("t"))
    worth = F.col("x") * F.exp(-rate * F.col("t"))
    df = df.withColumn("call", F.col("s") * cnd(F.col("_d1")) - worth * cnd(F.col("_d2")))
    return df.withColumn("put", F.col("call") - F.col("s") + worth).drop("_d1", "_d2")
