"""Sorting, searching, sets and order statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, dense_ids, norm_axis, running
from sparkarray.operators.reductions import split_axes

#: Longer lines are ranked in two phases over ranges, so that no task holds one.
LINE = 1_000_000
#: A sorted table of at most so many values is looked up as an array; a longer one by a merged scan.
LOOKUP_VALUES = 10_000


def _ranked(a: SparkArray, axis: int) -> tuple:
    """Each line's cells with their rank (NaN last; equal values in order of position)."""
    k = norm_axis(axis, a.ndim)
    rest = [f"i{n}" for n in range(a.ndim) if n != k]
    if not rest:
        return dense_ids(a.df, ["v", f"i{k}"], "r"), k
    if a.shape[k] > LINE:
        return running(a.df, ["v", f"i{k}"], F.lit(1), "r", rest, exclusive=True), k
    return a.df.withColumn("r", F.row_number().over(W.partitionBy(*rest).orderBy("v", f"i{k}")).cast("long") - 1), k


def sort(a, axis: int | None = -1):
    if axis is None:
        a, axis = a.ravel(), 0
    df, k = _ranked(a, axis)
    return SparkArray(df.drop(f"i{k}").withColumnRenamed("r", f"i{k}"), a.shape)


def argsort(a, axis: int | None = -1):
    if axis is None:
        a, axis = a.ravel(), 0
    df, k = _ranked(a, axis)
    return SparkArray(df.withColumn("v", F.col(f"i{k}")).drop(f"i{k}").withColumnRenamed("r", f"i{k}"), a.shape)


def partition(a, kth, axis: int | None = -1):
    return sort(a, axis)


def argpartition(a, kth, axis: int | None = -1):
    return argsort(a, axis)


def topk(a, k: int, largest: bool = True) -> SparkArray:
    """The k extreme values of all, in order: no full sort."""
    top = a.df.orderBy(F.desc("v") if largest else F.asc("v")).limit(k)
    order = W.orderBy(F.desc("v") if largest else F.asc("v"))
    return SparkArray(top.select((F.row_number().over(order) - 1).cast("long").alias("i0"), "v"), (min(k, a.size),))


def lexsort(keys: Sequence[SparkArray]) -> SparkArray:
    """Permutation by several keys, the last one first."""
    df = keys[0].df.withColumnRenamed("v", "k0")
    for n, key in enumerate(keys[1:], 1):
        df = df.join(key.df.withColumnRenamed("v", f"k{n}"), "i0")
    ranked = dense_ids(df, [f"k{n}" for n in range(len(keys))][::-1] + ["i0"], "r")
    return SparkArray(ranked.select(F.col("r").alias("i0"), F.col("i0").alias("v")), keys[0].shape)


def searchsorted(a: SparkArray, v: SparkArray, side: str = "left") -> SparkArray:
    """Insertion points of v in sorted a."""
    if a.size <= LOOKUP_VALUES:
        table = a.df.groupBy().agg(F.sort_array(F.collect_list("v")).alias("t"))
        test = (lambda x, q: x < q) if side == "left" else (lambda x, q: x <= q)
        df = v.df.crossJoin(F.broadcast(table)).withColumn("v", F.size(F.filter("t", lambda x: test(x, F.col("v")))).cast("long"))
        return SparkArray(df.drop("t"), v.shape)
    # A repeated value is one row with its number.
    own = a.df.groupBy("v").agg(F.count("*").alias("n")).select(F.col("v").alias("x"), F.lit(0 if side == "right" else 1).alias("o"), "n", *[F.lit(None).cast("long").alias(c) for c in v.axes])
    asked = v.df.select(F.col("v").alias("x"), F.lit(1 if side == "right" else 0).alias("o"), F.lit(0).cast("long").alias("n"), *[F.col(c) for c in v.axes])
    got = running(own.unionByName(asked), ["x", "o"], F.col("n"), "r").filter("n = 0")
    return SparkArray(got.select(*v.axes, F.col("r").alias("v")), v.shape)


def unique(a, return_counts: bool = False, return_index: bool = False):
    """Sorted distinct values, with the first flat position and the number of each if asked."""
    g = a.df.withColumn("f", a.flat_id()).groupBy("v").agg(F.count("*").alias("n"), F.min("f").alias("f"))
    g = dense_ids(g, ["v"], "i0")
    n = g.count()
    out = [SparkArray(g, (n,))]
    if return_index:
        out.append(SparkArray(g.select("i0", F.col("f").alias("v")), (n,)))
    if return_counts:
        out.append(SparkArray(g.select("i0", F.col("n").alias("v")), (n,)))
    return out[0] if len(out) == 1 else tuple(out)


def isin(a, test: SparkArray, invert: bool = False) -> SparkArray:
    """NaN is no member of anything, nor a stranger to anything."""
    members = test.df.select(F.col("v").alias("t")).distinct()
    if test.dtype in ("double", "float"):
        members = members.filter(~F.isnan("t"))
    df = a.df.join(members, a.df["v"] == members["t"], "left")
    hit = F.col("t").isNotNull()
    hit = ~hit if invert else hit
    if a.dtype in ("double", "float"):
        hit = ~F.isnan("v") & hit
    return SparkArray(df.withColumn("v", hit), a.shape)


def _virtual(method: str, q: Column, n: Column) -> tuple[Column, Column]:
    """0-based left position and the weight of its right neighbour."""
    at = {
        "inverted_cdf": q * n, "averaged_inverted_cdf": q * n, "interpolated_inverted_cdf": q * n, "hazen": q * n + 0.5, "weibull": q * (n + 1), "linear": q * (n - 1) + 1,
        "median_unbiased": q * (n + F.lit(1.0) / 3) + F.lit(1.0) / 3, "normal_unbiased": q * (n + 0.25) + 0.375,
    }
    if method in at:
        pos = at[method]
        frac = pos - F.floor(pos)
        gamma = F.when(frac > 0, 1.0).otherwise(0.0) if method == "inverted_cdf" else F.when(frac > 0, 1.0).otherwise(0.5) if method == "averaged_inverted_cdf" else frac
        return F.floor(pos) - 1, gamma
    last = q * (n - 1)
    if method == "lower":
        return F.floor(last), F.lit(0.0)
    if method == "higher":
        return F.ceil(last), F.lit(0.0)
    if method == "nearest":
        return F.rint(last).cast("long"), F.lit(0.0)
    if method == "midpoint":
        return F.floor(last), F.when(last > F.floor(last), 0.5).otherwise(0.0)
    if method == "closest_observation":  # of two equally near the one with an even rank, from 1
        at0 = q * n - 1.5
        low = F.floor(at0)
        return F.greatest(F.when((at0 == low) & (F.pmod(low, F.lit(2)) == 1), low).otherwise(low + 1), F.lit(0)), F.lit(0.0)
    raise ValueError(method)


METHODS_OF_QUANTILE = ("inverted_cdf", "averaged_inverted_cdf", "closest_observation", "interpolated_inverted_cdf", "hazen", "weibull", "linear", "median_unbiased", "normal_unbiased", "lower", "higher", "midpoint", "nearest")


def quantile(a, q, axis=None, method: str = "linear", ignore_nan: bool = False) -> SparkArray:
    """Order statistics of every line; several q give a leading axis."""
    gone, stay = split_axes(a, axis)
    by = [f"i{k}" for k in stay]
    df = a.df.filter(~F.isnan(F.col("v").cast("double"))) if ignore_nan else a.df
    if by and math.prod(a.shape[k] for k in gone) > LINE:
        ranked = running(df.withColumn("f", a.flat_id()), ["v", "f"], F.lit(1), "r", by, exclusive=True)
    elif by:
        ranked = df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("v")) - 1)
    else:
        ranked = dense_ids(df.withColumn("f", a.flat_id()), ["v", "f"], "r")
    n = df.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    qs = [q] if np.isscalar(q) else list(q)
    points = n.withColumn("q", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(x)).alias("x")) for k, x in enumerate(qs)])))
    left, gamma = _virtual(method, F.col("q.x"), F.col("n"))
    top = F.col("n") - 1
    points = points.withColumn("g", gamma).withColumn("l", left.cast("long"))
    points = points.withColumn("lo", F.greatest(F.least("l", top.cast("long")), F.lit(0))).withColumn("hi", F.when(F.col("l") < 0, 0).otherwise(F.greatest(F.least(F.col("l") + 1, top.cast("long")), F.lit(0))))
    points = points.select(*[F.col(b).alias(f"p_{b}") for b in by], F.col("q.k").alias("k"), "lo", "hi", "g")
    cond = (F.col("r") == F.col("lo")) | (F.col("r") == F.col("hi"))
    for b in by:
        cond = cond & (F.col(b) == F.col(f"p_{b}"))
    both = ranked.join(F.broadcast(points) if not by else points, cond)
    got = both.groupBy(*by, "k").agg(F.max(F.when(F.col("r") == F.col("lo"), F.col("v").cast("double"))).alias("x"), F.max(F.when(F.col("r") == F.col("hi"), F.col("v").cast("double"))).alias("y"), F.first("g").alias("g"))
    got = got.withColumn("v", F.when(F.col("g") == 0, F.col("x")).otherwise((1 - F.col("g")) * F.col("x") + F.col("g") * F.col("y")))
    shape = [a.shape[k] for k in stay]
    if np.isscalar(q):
        return SparkArray(got.select(*[F.col(f"i{k}").alias(f"j{m}") for m, k in enumerate(stay)], "v").withColumnsRenamed({f"j{m}": f"i{m}" for m in range(len(stay))}), shape)
    return SparkArray(got.select(F.col("k").alias("j0"), *[F.col(f"i{k}").alias(f"j{m + 1}") for m, k in enumerate(stay)], "v").withColumnsRenamed({f"j{m}": f"i{m}" for m in range(len(stay) + 1)}), [len(qs), *shape])


def percentile(a, q, axis=None, method="linear"):
    return quantile(a, q / 100 if np.isscalar(q) else [x / 100 for x in q], axis, method)


def nanquantile(a, q, axis=None, method="linear"):
    return quantile(a, q, axis, method, True)


def nanpercentile(a, q, axis=None, method="linear"):
    return nanquantile(a, q / 100 if np.isscalar(q) else [x / 100 for x in q], axis, method)


def median(a, axis=None):
    return quantile(a, 0.5, axis, "midpoint")


def nanmedian(a, axis=None):
    return quantile(a, 0.5, axis, "midpoint", True)


METHODS = {f.__name__: f for f in (sort, argsort, partition, argpartition, topk, searchsorted, unique, isin, quantile, percentile, nanquantile, nanpercentile, median, nanmedian)}
METHODS |= {"in1d": lambda a, t, invert=False: isin(a.ravel(), t, invert)}
