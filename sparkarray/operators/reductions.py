"""Reductions over axes: partial and final aggregates, one shuffle by the axes that stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, norm_axis
from sparkarray.functions import ufuncs as U

Axis = int | Sequence[int] | None


def split_axes(a: SparkArray, axis: Axis) -> tuple[list[int], list[int]]:
    gone = list(range(a.ndim)) if axis is None else sorted({norm_axis(k, a.ndim) for k in ([axis] if isinstance(axis, int) else axis)})
    return gone, [k for k in range(a.ndim) if k not in gone]


def reduce(a: SparkArray, agg: Column, axis: Axis = None, keepdims: bool = False, where: SparkArray | None = None, initial=None, merge=None) -> SparkArray:
    """``agg`` is over column ``v``, null where the mask is false."""
    if where is not None:
        a = a.binary(where, lambda v, m: F.when(m, v))
    gone, stay = split_axes(a, axis)
    df = a.df.groupBy(*[f"i{k}" for k in stay]).agg(agg.alias("v"))
    if initial is not None:
        df = df.withColumn("v", merge(F.col("v"), F.lit(initial)))
    if keepdims:
        shape = [1 if k in gone else s for k, s in enumerate(a.shape)]
        df = df.select(*[F.col(f"i{k}") if k in stay else F.lit(0).cast("long").alias(f"i{k}") for k in range(a.ndim)], "v")
    else:
        shape = [a.shape[k] for k in stay]
        df = df.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(stay)], "v")
    return SparkArray(df, shape)


V = F.col


def _v() -> Column:
    return F.col("v")


def _num(a: SparkArray) -> SparkArray:
    return a.map(lambda v: v.cast("long")) if a.dtype == "boolean" else a


def _real(v: Column) -> Column:
    return F.when(~F.isnan(v.cast("double")), v)


def _largest(v: Column) -> Column:
    return F.max(v)


def _least(v: Column) -> Column:
    """NaN wins, as in array programming."""
    x = v.cast("double")
    return F.when(F.bool_or(F.isnan(x)), U.NAN).otherwise(F.min(v))


def sum(a, axis=None, keepdims=False, initial=None, where=None):  # noqa: A001
    if a.is_complex:
        return reduce(a, F.struct(F.coalesce(F.sum("v.re"), F.lit(0.0)).alias("re"), F.coalesce(F.sum("v.im"), F.lit(0.0)).alias("im")), axis, keepdims, where)
    return reduce(_num(a), F.coalesce(F.sum(_v()), F.lit(0)), axis, keepdims, where, initial, lambda x, y: x + y)


def prod(a, axis=None, keepdims=False, initial=None, where=None):
    return reduce(_num(a), F.coalesce(F.product(_v()), F.lit(1.0)), axis, keepdims, where, initial, lambda x, y: x * y)


def amax(a, axis=None, keepdims=False, initial=None, where=None):
    return reduce(a, _largest(_v()), axis, keepdims, where, initial, F.greatest)


def amin(a, axis=None, keepdims=False, initial=None, where=None):
    return reduce(a, _least(_v()), axis, keepdims, where, initial, lambda x, y: U.extreme(F.least)(x, y))


def all(a, axis=None, keepdims=False, where=None):  # noqa: A001
    return reduce(a.map(U.truth), F.coalesce(F.bool_and(_v()), F.lit(True)), axis, keepdims, where)


def any(a, axis=None, keepdims=False, where=None):  # noqa: A001
    return reduce(a.map(U.truth), F.coalesce(F.bool_or(_v()), F.lit(False)), axis, keepdims, where)


def count_nonzero(a, axis=None, keepdims=False):
    return reduce(a.map(U.truth), F.count_if(_v()), axis, keepdims)


def mean(a, axis=None, keepdims=False, where=None):
    if a.is_complex:
        return reduce(a, F.struct(F.avg("v.re").alias("re"), F.avg("v.im").alias("im")), axis, keepdims, where)
    return reduce(_num(a), F.avg(_v()), axis, keepdims, where)


def var(a, axis=None, ddof=0, keepdims=False, where=None):
    n = F.count(_v())
    return reduce(_num(a), F.var_pop(_v()) * n / F.when(n > ddof, n - ddof), axis, keepdims, where)


def std(a, axis=None, ddof=0, keepdims=False, where=None):
    return var(a, axis, ddof, keepdims, where).ufunc("sqrt")


def nansum(a, axis=None, keepdims=False):
    return reduce(a, F.coalesce(F.sum(_real(_v())), F.lit(0.0)), axis, keepdims)


def nanprod(a, axis=None, keepdims=False):
    return reduce(a, F.coalesce(F.product(_real(_v())), F.lit(1.0)), axis, keepdims)


def nanmax(a, axis=None, keepdims=False):
    return reduce(a, F.coalesce(F.max(_real(_v())), F.lit(U.NAN)), axis, keepdims)


def nanmin(a, axis=None, keepdims=False):
    return reduce(a, F.coalesce(F.min(_real(_v())), F.lit(U.NAN)), axis, keepdims)


def nanmean(a, axis=None, keepdims=False):
    return reduce(a, F.coalesce(F.avg(_real(_v())), F.lit(U.NAN)), axis, keepdims)


def _position(a: SparkArray, axis: int | None) -> tuple[SparkArray, Column]:
    if axis is None:
        return a.ravel(), F.col("i0")
    return a, F.col(f"i{norm_axis(axis, a.ndim)}")


def argmax(a, axis=None, keepdims=False):
    """The first index of the largest; NaN is largest."""
    a, i = _position(a, axis)
    return reduce(a, F.max_by(i, F.struct(_v(), -i)), axis, keepdims)


def argmin(a, axis=None, keepdims=False):
    a, i = _position(a, axis)
    return reduce(a, F.min_by(i, F.struct(~F.isnan(_v().cast("double")), _v(), i)), axis, keepdims)


def nanargmax(a, axis=None, keepdims=False):
    a, i = _position(a, axis)
    return reduce(SparkArray(a.df.filter(~F.isnan(_v().cast("double"))), a.shape), F.max_by(i, F.struct(_v(), -i)), axis, keepdims)


def nanargmin(a, axis=None, keepdims=False):
    a, i = _position(a, axis)
    return reduce(SparkArray(a.df.filter(~F.isnan(_v().cast("double"))), a.shape), F.min_by(i, F.struct(_v(), i)), axis, keepdims)


def average(a, axis=None, weights=None, returned=False, keepdims=False):
    if weights is None:
        out = mean(a, axis, keepdims)
        count = reduce(a, F.count(_v()).cast("double"), axis, keepdims)
        return (out, count) if returned else out
    if weights.ndim == 1 and a.ndim > 1:
        k = norm_axis(axis, a.ndim)
        weights = weights.reshape([-1 if n == k else 1 for n in range(a.ndim)])
    pair = a.binary(weights, lambda v, w: F.struct(v.cast("double").alias("x"), w.cast("double").alias("w")))
    out = reduce(pair, F.sum(F.col("v.x") * F.col("v.w")) / F.sum("v.w"), axis, keepdims)
    return (out, reduce(pair, F.sum("v.w"), axis, keepdims)) if returned else out


def cov(m, y=None, rowvar=True, bias=False, ddof=None):
    """The covariance matrix; variables are rows unless ``rowvar`` is false."""
    x = m if m.ndim == 2 else m.reshape(1, -1)
    if not rowvar:
        x = x.transpose()
    if y is not None:
        from sparkarray.operators.shaping import concatenate

        x = concatenate([x, y if y.ndim == 2 else y.reshape(1, -1)], 0)
    n = x.shape[1]
    ddof = (0 if bias else 1) if ddof is None else ddof
    from sparkarray.operators.linalg import gram

    # Centred first: sums of squares of large values would lose the small differences.
    centred = x.astype("double").binary(mean(x, 1, True), lambda v, m: v - m)
    return gram(centred.transpose()).map(lambda v: v / max(n - ddof, 1))


def contains(a, value):
    return any(a.ufunc("equal", value))


def allclose(a, b, rtol=1e-5, atol=1e-8, equal_nan=False):
    return all(a.binary(b, lambda x, y: U.isclose(x, y, rtol, atol, equal_nan)))


def isclose(a, b, rtol=1e-5, atol=1e-8, equal_nan=False):
    return a.binary(b, lambda x, y: U.isclose(x, y, rtol, atol, equal_nan))


def array_equal(a, b, equal_nan=False):
    if a.shape != b.shape:
        return False
    return bool(all(a.binary(b, lambda x, y: U.isclose(x, y, 0.0, 0.0, equal_nan))).item())


METHODS = {f.__name__: f for f in (sum, prod, amax, amin, all, any, count_nonzero, mean, var, std, nansum, nanprod, nanmax, nanmin, nanmean, argmax, argmin, nanargmax, nanargmin, average, cov, contains, allclose, isclose, array_equal)}
METHODS |= {"max": amax, "min": amin, "clip": lambda a, lo=None, hi=None: a.map(lambda v: U.clip(v, lo, hi)), "round": lambda a, decimals=0: a.map(lambda v: U.around(v, decimals)), "nan_to_num": lambda a, **k: a.map(lambda v: U.nan_to_num(v, **k))}
