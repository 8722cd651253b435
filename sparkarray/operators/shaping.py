"""Shapes: index arithmetic and unions; nothing here sorts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import functions as F

from sparkarray.array import SparkArray, norm_axis, running
from sparkarray.operators.creation import diag, diagflat, full_like, ones_like, tril, triu, vander, zeros_like


def expand_dims(a, axis):
    axis = [axis] if isinstance(axis, int) else list(axis)
    n = a.ndim + len(axis)
    at = {norm_axis(k, n) for k in axis}
    shape, rest = [], iter(a.shape)
    for k in range(n):
        shape.append(1 if k in at else next(rest))
    return a.reshape(shape)


def squeeze(a, axis=None):
    gone = {k for k, s in enumerate(a.shape) if s == 1} if axis is None else {norm_axis(k, a.ndim) for k in ([axis] if isinstance(axis, int) else axis)}
    if any(a.shape[k] != 1 for k in gone):
        raise ValueError("cannot squeeze an axis longer than one")
    stay = [k for k in range(a.ndim) if k not in gone]
    return SparkArray(a.df.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(stay)], "v"), [a.shape[k] for k in stay])


def swapaxes(a, p, q):
    order = list(range(a.ndim))
    p, q = norm_axis(p, a.ndim), norm_axis(q, a.ndim)
    order[p], order[q] = order[q], order[p]
    return a.transpose(order)


def moveaxis(a, source, destination):
    source = [source] if isinstance(source, int) else list(source)
    destination = [destination] if isinstance(destination, int) else list(destination)
    order = [k for k in range(a.ndim) if k not in {norm_axis(s, a.ndim) for s in source}]
    for d, s in sorted((norm_axis(d, a.ndim), norm_axis(s, a.ndim)) for d, s in zip(destination, source)):
        order.insert(d, s)
    return a.transpose(order)


def matrix_transpose(a):
    return swapaxes(a, -1, -2)


def atleast_1d(a):
    return a if a.ndim else a.reshape(1)


def atleast_2d(a):
    return a if a.ndim >= 2 else a.reshape(1, a.size)


def atleast_3d(a):
    return a if a.ndim >= 3 else a.reshape(1, a.size, 1) if a.ndim < 2 else a.reshape(*a.shape, 1)


def concatenate(arrays: Sequence[SparkArray], axis: int | None = 0) -> SparkArray:
    if axis is None:
        arrays, axis = [a.ravel() for a in arrays], 0
    k = norm_axis(axis, arrays[0].ndim)
    kinds = {a.dtype for a in arrays}
    kind = kinds.pop() if len(kinds) == 1 else "double" if kinds & {"double", "float"} else "bigint"
    out, at = None, 0
    for a in arrays:
        part = a.df.withColumn(f"i{k}", F.col(f"i{k}") + at).withColumn("v", F.col("v").cast(kind))
        out = part if out is None else out.unionByName(part)
        at += a.shape[k]
    shape = list(arrays[0].shape)
    shape[k] = at
    return SparkArray(out, shape)


def stack(arrays, axis=0):
    k = norm_axis(axis, arrays[0].ndim + 1)
    return concatenate([expand_dims(a, k) for a in arrays], k)


def vstack(arrays):
    return concatenate([atleast_2d(a) for a in arrays], 0)


def hstack(arrays):
    return concatenate([atleast_1d(a) for a in arrays], 0 if arrays[0].ndim < 2 else 1)


def dstack(arrays):
    return concatenate([atleast_3d(a) for a in arrays], 2)


def column_stack(arrays):
    return concatenate([a if a.ndim > 1 else a.reshape(a.size, 1) for a in arrays], 1)


row_stack = vstack


def append(a, values, axis=None):
    return concatenate([a, values], axis)


def block(nested):
    """Nested lists of arrays; the innermost level joins the last axis."""

    def depth(x):
        return 1 + depth(x[0]) if isinstance(x, list) else 0

    n = depth(nested)

    def build(x, level):
        if not isinstance(x, list):
            return x if x.ndim >= n else x.reshape((1,) * (n - x.ndim) + x.shape)
        return concatenate([build(y, level - 1) for y in x], -level)

    return build(nested, n)


def array_split(a, parts, axis=0):
    k = norm_axis(axis, a.ndim)
    n = a.shape[k]
    if isinstance(parts, int):
        size, extra = divmod(n, parts)
        cuts = [0]
        for j in range(parts):
            cuts.append(cuts[-1] + size + (j < extra))
    else:
        cuts = [0, *[min(max(p if p >= 0 else p + n, 0), n) for p in parts], n]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        df = a.df.filter((F.col(f"i{k}") >= lo) & (F.col(f"i{k}") < hi)).withColumn(f"i{k}", F.col(f"i{k}") - lo)
        out.append(SparkArray(df, [max(hi - lo, 0) if m == k else s for m, s in enumerate(a.shape)]))
    return out


def split(a, parts, axis=0):
    if isinstance(parts, int) and a.shape[norm_axis(axis, a.ndim)] % parts:
        raise ValueError("array split does not result in an equal division")
    return array_split(a, parts, axis)


def hsplit(a, parts):
    return split(a, parts, 0 if a.ndim == 1 else 1)


def vsplit(a, parts):
    return split(a, parts, 0)


def dsplit(a, parts):
    return split(a, parts, 2)


def tile(a, reps):
    reps = [reps] if isinstance(reps, int) else list(reps)
    n = max(a.ndim, len(reps))
    a = a.reshape((1,) * (n - a.ndim) + a.shape)
    reps = [1] * (n - len(reps)) + reps
    df = a.df
    for k, (r, s) in enumerate(zip(reps, a.shape)):
        if r != 1:
            df = df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(r - 1)) if r else F.array().cast("array<int>"))).withColumn(f"i{k}", F.col(f"i{k}") + F.col("_r") * s).drop("_r")
    return SparkArray(df, [r * s for r, s in zip(reps, a.shape)])


def repeat(a, repeats, axis=None):
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    if isinstance(repeats, int):
        df = a.df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)) if repeats else F.array().cast("array<int>")))
        return SparkArray(df.withColumn(f"i{k}", F.col(f"i{k}") * repeats + F.col("_r")), [s * repeats if m == k else s for m, s in enumerate(a.shape)])
    at = running(repeats.df, ["i0"], F.col("v"), "end").select(F.col("i0").alias("_i"), (F.col("end") - F.col("v")).alias("_b"), F.col("v").alias("_n"))
    total = int(repeats.df.agg(F.sum("v")).first()[0] or 0)
    df = a.df.join(at, F.col(f"i{k}") == F.col("_i")).filter("_n > 0").withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return SparkArray(df.withColumn(f"i{k}", F.col("_b") + F.col("_r")), [total if m == k else s for m, s in enumerate(a.shape)])


def flip(a, axis=None):
    ks = range(a.ndim) if axis is None else [norm_axis(k, a.ndim) for k in ([axis] if isinstance(axis, int) else axis)]
    df = a.df
    for k in ks:
        df = df.withColumn(f"i{k}", F.lit(a.shape[k] - 1) - F.col(f"i{k}"))
    return SparkArray(df, a.shape)


def flipud(a):
    return flip(a, 0)


def fliplr(a):
    return flip(a, 1)


def rot90(a, k=1, axes=(0, 1)):
    p, q = (norm_axis(x, a.ndim) for x in axes)
    for _ in range(k % 4):
        a = swapaxes(flip(a, q), p, q)
    return a


def roll(a, shift, axis=None):
    if axis is None:
        return roll(a.ravel(), shift, 0).reshape(a.shape)
    pairs = zip([shift] if isinstance(shift, int) else shift, [axis] if isinstance(axis, int) else axis)
    df = a.df
    for s, k in pairs:
        k = norm_axis(k, a.ndim)
        df = df.withColumn(f"i{k}", F.pmod(F.col(f"i{k}") + s, F.lit(a.shape[k])))
    return SparkArray(df, a.shape)


def delete(a, positions, axis=None):
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    n = a.shape[k]
    gone = sorted({p % n for p in ([positions] if isinstance(positions, int) else positions)})
    i = F.col(f"i{k}")
    if not gone:
        return a
    table = F.array(*[F.lit(g).cast("long") for g in gone])
    df = a.df.filter(~F.array_contains(table, i)).withColumn(f"i{k}", i - F.size(F.filter(table, lambda g: g < i)))
    return SparkArray(df, [n - len(gone) if m == k else s for m, s in enumerate(a.shape)])


def insert(a, positions, values, axis=None):
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    n = a.shape[k]
    where = [positions] if isinstance(positions, int) else list(positions)
    where = [p + n if p < 0 else p for p in where]
    order = sorted(range(len(where)), key=lambda j: where[j])
    new = [0] * len(where)
    for shift, j in enumerate(order):
        new[j] = where[j] + shift
    i = F.col(f"i{k}")
    table = F.array(*[F.lit(p).cast("long") for p in where])
    old = a.df.withColumn(f"i{k}", i + F.size(F.filter(table, lambda p: p <= i)))
    shape = [n + len(where) if m == k else s for m, s in enumerate(a.shape)]
    if not isinstance(values, SparkArray):
        rest = a.df.filter(i == 0)
        vals = [values] * len(where) if not isinstance(values, (list, tuple)) else list(values)
        put = F.array(*[F.struct(F.lit(at).cast("long").alias("at"), F.lit(v).cast(a.dtype).alias("v")) for at, v in zip(new, vals)])
        add = rest.drop("v").withColumn("_x", F.explode(put)).withColumn(f"i{k}", F.col("_x.at")).withColumn("v", F.col("_x.v")).drop("_x")
    else:
        vals = values if values.ndim == a.ndim else values.reshape([len(where) if m == k else 1 for m in range(a.ndim)])
        vals = vals.broadcast_to([len(where) if m == k else s for m, s in enumerate(a.shape)])
        add = vals.df.withColumn(f"i{k}", F.get(F.array(*[F.lit(x).cast("long") for x in new]), i.cast("int")))
    return SparkArray(old.unionByName(add), shape)


def pad(a, width, mode="constant", value=0):
    """Constant, edge, reflect, symmetric, wrap: every output cell names the source cell it shows; one join."""
    width = [(width, width)] * a.ndim if isinstance(width, int) else [tuple(w) if not isinstance(w, int) else (w, w) for w in width]
    if len(width) == 1:
        width = width * a.ndim
    shape = [s + b + e for s, (b, e) in zip(a.shape, width)]
    if mode in ("constant", "empty", "linear_ramp", "maximum", "minimum", "mean") and mode not in ("constant", "empty"):
        return _pad_statistic(a, width, mode, value)
    df = a.df
    for k, (s, (b, e)) in enumerate(zip(a.shape, width)):
        i = F.col(f"i{k}")
        if mode in ("constant", "empty"):
            df = df.withColumn(f"i{k}", i + b)
            continue
        outs = []
        for o in [*range(-b, 0), *range(s, s + e)]:
            if mode == "edge":
                src = 0 if o < 0 else s - 1
            elif mode == "wrap":
                src = o % s
            elif mode == "symmetric":
                src = o % (2 * s)
                src = src if src < s else 2 * s - 1 - src
            elif mode == "reflect":
                period = max(2 * s - 2, 1)
                src = o % period
                src = src if src < s else period - src
            else:
                raise ValueError(mode)
            outs.append((src, o + b))
        table = F.array(*[F.struct(F.lit(x).cast("long").alias("s"), F.lit(y).cast("long").alias("o")) for x, y in outs]) if outs else F.array().cast("array<struct<s:bigint,o:bigint>>")
        places = F.concat(F.array(i + b), F.transform(F.filter(table, lambda t: t["s"] == i), lambda t: t["o"]))
        df = df.withColumn(f"i{k}", F.explode(places))
    if mode in ("constant", "empty"):
        from sparkarray.operators.creation import grid

        df = grid(a.spark, shape).join(df, a.axes, "left").withColumn("v", F.coalesce("v", F.lit(value).cast(a.dtype)))
    return SparkArray(df, shape)


def _pad_statistic(a, width, mode, value):
    from sparkarray.operators.reductions import amax, amin, mean

    for k, (b, e) in enumerate(width):
        parts = []
        if mode == "linear_ramp":
            def ramp(cell, n, down, k=k):
                df = cell.df.drop(f"i{k}").withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
                step = (F.lit(n) - F.col(f"i{k}")) if down else (F.col(f"i{k}") + 1)
                return SparkArray(df.withColumn("v", F.col("v") + (F.lit(value) - F.col("v")) * step / n), [n if m == k else s for m, s in enumerate(cell.shape)])

            first, *_ = array_split(a, [1], k)
            last = array_split(a, [a.shape[k] - 1], k)[1]
            parts = ([ramp(first, b, True)] if b else []) + [a] + ([ramp(last, e, False)] if e else [])
        else:
            stat = {"maximum": amax, "minimum": amin, "mean": mean}[mode](a, k, True)
            one = lambda n: stat.broadcast_to([n if m == k else s for m, s in enumerate(stat.shape)])
            parts = ([one(b)] if b else []) + [a] + ([one(e)] if e else [])
        a = concatenate(parts, k)
    return a


def packbits(a, axis=None, bitorder="big"):
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    pos = F.col(f"i{k}") % 8
    bit = F.when(F.col("v").cast("double") != 0, F.pow(F.lit(2), 7 - pos if bitorder == "big" else pos)).otherwise(0).cast("long")
    df = a.df.withColumn("b", bit).withColumn(f"i{k}", F.expr(f"i{k} div 8")).groupBy(*a.axes).agg(F.sum("b").alias("v"))
    return SparkArray(df, [math.ceil(s / 8) if m == k else s for m, s in enumerate(a.shape)])


def unpackbits(a, axis=None, count=None, bitorder="big"):
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.getbit(F.col("v").cast("long"), (7 - p) if bitorder == "big" else p).cast("long"))
    df = a.df.select(*a.axes, F.posexplode(bits).alias("p", "v")).withColumn(f"i{k}", F.col(f"i{k}") * 8 + F.col("p"))
    n = a.shape[k] * 8 if count is None else count if count >= 0 else a.shape[k] * 8 + count
    return SparkArray(df.filter(F.col(f"i{k}") < n), [n if m == k else s for m, s in enumerate(a.shape)])


METHODS = {f.__name__: f for f in (expand_dims, squeeze, swapaxes, moveaxis, matrix_transpose, append, array_split, split, hsplit, vsplit, dsplit, tile, repeat, flip, flipud, fliplr, rot90, roll, delete, insert, pad, packbits, unpackbits)}
METHODS |= {f.__name__: f for f in (diag, diagflat, full_like, ones_like, tril, triu, vander, zeros_like)}
METHODS |= {"permute_dims": SparkArray.transpose, "copy": lambda a: a}
