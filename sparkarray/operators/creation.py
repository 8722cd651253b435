"""Sources: arrays made from ranges, all by index arithmetic on ``spark.range``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, strides


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All coordinates of a shape, one row each, from a single range."""
    f = spark.range(math.prod(shape))
    return f.select(*[(F.expr(f"id div {max(st, 1)}") % max(s, 1)).alias(f"i{k}") for k, (s, st) in enumerate(zip(shape, strides(shape)))])


def full(spark, shape, value) -> SparkArray:
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    return SparkArray.generated(spark, shape, lambda *i: F.lit(value))


def zeros(spark, shape) -> SparkArray:
    return full(spark, shape, 0.0)


def ones(spark, shape) -> SparkArray:
    return full(spark, shape, 1.0)


empty = zeros


def full_like(a: SparkArray, value) -> SparkArray:
    return a.map(lambda v: F.lit(value))


def zeros_like(a):
    return full_like(a, 0.0)


def ones_like(a):
    return full_like(a, 1.0)


empty_like = zeros_like


def array(spark, data) -> SparkArray:
    return SparkArray.from_numpy(spark, data)


def arange(spark, start, stop=None, step=1) -> SparkArray:
    if stop is None:
        start, stop = 0, start
    n = max(0, math.ceil((stop - start) / step))
    return SparkArray.generated(spark, (n,), lambda i: F.lit(start) + i * step)


def linspace(spark, start, stop, num=50, endpoint=True, retstep=False):
    gaps = num - 1 if endpoint else num
    step = (stop - start) / gaps if gaps > 0 else float("nan")

    def v(i):
        even = F.lit(float(start)) + i * (step if gaps > 0 else 0.0)
        return F.when(i == num - 1, F.lit(float(stop))).otherwise(even) if endpoint and num > 1 else even

    out = SparkArray.generated(spark, (num,), v)
    return (out, step) if retstep else out


def logspace(spark, start, stop, num=50, endpoint=True, base=10.0) -> SparkArray:
    return linspace(spark, start, stop, num, endpoint).map(lambda v: F.pow(F.lit(float(base)), v))


def eye(spark, n, m=None, k=0) -> SparkArray:
    m = n if m is None else m
    return SparkArray.generated(spark, (n, m), lambda i, j: (j - i == k).cast("double"))


def identity(spark, n) -> SparkArray:
    return eye(spark, n)


def tri(spark, n, m=None, k=0) -> SparkArray:
    m = n if m is None else m
    return SparkArray.generated(spark, (n, m), lambda i, j: (j <= i + k).cast("double"))


def _triangle(a: SparkArray, keep: Column) -> SparkArray:
    return SparkArray(a.df.withColumn("v", F.when(keep, F.col("v")).otherwise(F.lit(0).cast(a.dtype))), a.shape)


def tril(a, k=0):
    p, q = a.axes[-2:]
    return _triangle(a, F.col(q) <= F.col(p) + k)


def triu(a, k=0):
    p, q = a.axes[-2:]
    return _triangle(a, F.col(q) >= F.col(p) + k)


def trilu(m, k=0, lower=True):
    """The lower or the upper triangle."""
    return tril(m, k) if lower else triu(m, k)


def diag(a, k=0):
    """A vector's matrix, or a matrix's diagonal."""
    from sparkarray.operators.indexing import diagonal

    if a.ndim == 2:
        return diagonal(a, k)
    n = a.shape[0] + abs(k)
    cells = a.df.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), "v")
    df = grid(a.spark, (n, n)).join(cells, ["i0", "i1"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast(a.dtype)))
    return SparkArray(df, (n, n))


def diagflat(a, k=0):
    return diag(a.ravel(), k)


def vander(x, n=None, increasing=False):
    n = x.shape[0] if n is None else n
    p = F.col("i1") if increasing else F.lit(n - 1) - F.col("i1")
    df = x.df.withColumn("i1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return SparkArray(df.withColumn("v", F.pow(F.col("v").cast("double"), p)), (x.shape[0], n))


def meshgrid(*xs: SparkArray, indexing: str = "xy", sparse: bool = False) -> list[SparkArray]:
    n = len(xs)
    order = list(range(n))
    if indexing == "xy" and n > 1:
        order[0], order[1] = 1, 0
    shape = [0] * n
    for k, x in enumerate(xs):
        shape[order[k]] = x.shape[0]
    thin = [x.reshape([x.shape[0] if d == order[k] else 1 for d in range(n)]) for k, x in enumerate(xs)]
    return thin if sparse else [t.broadcast_to(shape) for t in thin]


def mgrid(spark, *slices: slice) -> SparkArray:
    """Dense grids of the ranges, with a leading axis for the dimension."""
    from sparkarray.operators.shaping import stack

    ranges = [arange(spark, s.start or 0, s.stop, s.step or 1) for s in slices]
    return stack(meshgrid(*ranges, indexing="ij"), 0)


def asarray(spark, a) -> SparkArray:
    return a if isinstance(a, SparkArray) else array(spark, np.asarray(a))
