"""Histograms and binning: the grouping of array programming."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkarray.array import SparkArray
from sparkarray.operators.ordering import searchsorted


def _filled(df, n: int) -> SparkArray:
    """Counts by bin with zeros for empty bins."""
    grid = df.sparkSession.range(n).select(F.col("id").alias("i0"))
    return SparkArray(grid.join(df, "i0", "left").withColumn("v", F.coalesce("v", F.lit(0))), (n,))


def bincount(x, weights=None, minlength: int = 0) -> SparkArray:
    if weights is not None:
        x = x.binary(weights, lambda v, w: F.struct(v.cast("long").alias("b"), w.cast("double").alias("w")))
        g = x.df.groupBy(F.col("v.b").alias("i0")).agg(F.sum("v.w").alias("v"))
    else:
        g = x.df.groupBy(F.col("v").cast("long").alias("i0")).agg(F.count("*").alias("v"))
    top = g.agg(F.max("i0")).first()[0]
    return _filled(g, max(minlength, 0 if top is None else top + 1))


def edges_of(x: SparkArray, bins, range_=None) -> list[float]:
    if not np.isscalar(bins):
        return [float(b) for b in bins]
    lo, hi = range_ if range_ is not None else x.df.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + k * step for k in range(bins)] + [hi]


def bin_of(v: Column, edges: Sequence[float]) -> Column:
    """Half-open bins, the last closed; null outside. Exact at the edges: compared with them, not computed.

    Where the edges are evenly spaced, a quotient names a bin and its edges correct that: no loop for each cell.
    """
    inside = ~F.isnan(v.cast("double")) & (v >= edges[0]) & (v <= edges[-1])
    lo, n = edges[0], len(edges) - 1
    step = (edges[-1] - lo) / n
    if step > 0 and edges == [*(lo + k * step for k in range(n)), edges[-1]]:
        edge = lambda k: F.lit(lo) + k * F.lit(step)
        at = F.least(F.floor((v.cast("double") - lo) / step), F.lit(n - 1))
        return F.when(inside, F.when((at > 0) & (v < edge(at)), at - 1).when((at < n - 1) & (v >= edge(at + 1)), at + 1).otherwise(at))
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: e <= v)) - 1
    return F.when(inside, at.cast("long"))


def histogram(x, bins=10, range=None, weights=None, density: bool = False) -> tuple[SparkArray, list[float]]:  # noqa: A002
    edges = edges_of(x, bins, range)
    if weights is not None:
        x = x.binary(weights, lambda v, w: F.struct(v.alias("x"), w.cast("double").alias("w")))
        g = x.df.select(bin_of(F.col("v.x"), edges).alias("i0"), F.col("v.w").alias("w")).groupBy("i0").agg(F.sum("w").alias("v"))
    else:
        g = x.df.select(bin_of(F.col("v"), edges).alias("i0")).groupBy("i0").agg(F.count("*").alias("v"))
    out = _filled(g.filter("i0 is not null"), len(edges) - 1)
    if density:
        total = out.df.agg(F.sum("v").alias("t"))
        widths = F.element_at(F.array(*[F.lit(b - a) for a, b in zip(edges, edges[1:])]), (F.col("i0") + 1).cast("int"))
        out = SparkArray(out.df.crossJoin(F.broadcast(total)).withColumn("v", F.col("v") / F.col("t") / widths), out.shape)
    return out, edges


def histogramdd(columns: Sequence[SparkArray], bins=10, range=None, density: bool = False) -> tuple[SparkArray, list[list[float]]]:  # noqa: A002
    n = len(columns)
    bins = [bins] * n if np.isscalar(bins) else list(bins)
    edges = [edges_of(c, b, range[k] if range else None) for k, (c, b) in enumerate(zip(columns, bins))]
    df = columns[0].df.withColumnRenamed("v", "c0")
    for k, c in enumerate(columns[1:], 1):
        df = df.join(c.df.withColumnRenamed("v", f"c{k}"), "i0")
    binned = df.select(*[bin_of(F.col(f"c{k}"), e).alias(f"b{k}") for k, e in enumerate(edges)]).dropna()
    shape = [len(e) - 1 for e in edges]
    flat = F.lit(0).cast("long")
    for k, s in enumerate(shape):
        flat = flat * s + F.col(f"b{k}")
    out = _filled(binned.groupBy(flat.alias("i0")).agg(F.count("*").alias("v")), int(np.prod(shape))).reshape(shape)
    if density:
        total = out.df.agg(F.sum("v").alias("t"))
        volume = F.lit(1.0)
        for k, e in enumerate(edges):
            volume = volume * F.element_at(F.array(*[F.lit(b - a) for a, b in zip(e, e[1:])]), (F.col(f"i{k}") + 1).cast("int"))
        out = SparkArray(out.df.crossJoin(F.broadcast(total)).withColumn("v", F.col("v") / F.col("t") / volume), out.shape)
    return out, edges


def histogram2d(x, y, bins=10, range=None, density: bool = False):  # noqa: A002
    out, edges = histogramdd([x, y], bins, range, density)
    return out, edges[0], edges[1]


def digitize(x, bins: Sequence[float], right: bool = False) -> SparkArray:
    bins = [float(b) for b in bins]
    table = sorted(bins)
    test = (lambda e, v: e < v) if right else (lambda e, v: e <= v)
    if bins != table:
        if bins != table[::-1]:
            raise ValueError("bins must be monotonic")
        other = (lambda e, v: e <= v) if right is False else (lambda e, v: e < v)
        return x.map(lambda v: (F.lit(len(bins)) - F.size(F.filter(F.array(*[F.lit(b) for b in table]), lambda e: other(e, v)))).cast("long"))
    return x.map(lambda v: F.size(F.filter(F.array(*[F.lit(b) for b in table]), lambda e: test(e, v))).cast("long"))


METHODS = {f.__name__: f for f in (bincount, histogram, histogram2d, digitize)}
METHODS["searchsorted"] = searchsorted
