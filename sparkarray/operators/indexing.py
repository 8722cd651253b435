"""Reading and writing by index: filters, shifts of coordinates and joins on them. Writing gives a new array."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from sparkarray.array import BROADCAST_CELLS, SparkArray, axes, dense_ids, norm_axis, note, strides


def _small(df, n: int):
    return F.broadcast(df) if n <= BROADCAST_CELLS else df


def get(a: SparkArray, key):
    """Integers, slices of any step, None, Ellipsis, masks and index arrays, in any mixture."""
    if isinstance(key, SparkArray):
        return mask(a, key) if key.dtype == "boolean" else take(a, key, 0)
    key = [SparkArray.from_numpy(a.spark, k) if isinstance(k, (list, np.ndarray)) else k for k in (key if isinstance(key, tuple) else (key,))]
    # A mask stands for the index arrays of its true cells.
    if len(key) > 1 and any(isinstance(k, SparkArray) and k.dtype == "boolean" for k in key):
        key = [x for k in key for x in (nonzero(k) if isinstance(k, SparkArray) and k.dtype == "boolean" else (k,))]
    used = sum(k is not None and k is not Ellipsis for k in key)
    if used > a.ndim:
        raise IndexError("too many indices")
    fill = [slice(None)] * (a.ndim - used)
    at = next((n for n, k in enumerate(key) if k is Ellipsis), None)
    key = key + fill if at is None else key[:at] + fill + key[at + 1 :]
    arrays = sum(isinstance(k, SparkArray) for k in key)
    if arrays > 1 or (arrays and any(isinstance(k, int) for k in key)):
        return _several(a, key)
    df, shape, cols, n, later = a.df, [], [], 0, []
    for k in key:
        if k is None:
            cols.append(F.lit(0).cast("long"))
            shape.append(1)
            continue
        i, size = F.col(f"i{n}"), a.shape[n]
        if isinstance(k, int):
            if not -size <= k < size:
                raise IndexError(k)
            df = df.filter(i == k % size)
        elif isinstance(k, slice):
            start, stop, step = k.indices(size)
            count = len(range(start, stop, step))
            lo, hi = (start, stop - 1) if step > 0 else (stop + 1, start)
            df = df.filter((i >= lo) & (i <= hi) & ((i - start) % step == 0)) if count else df.filter(F.lit(False))
            cols.append(F.expr(f"(i{n} - {start}) div {step}"))
            shape.append(count)
        else:
            later.append((len(shape), k))
            cols.append(i)
            shape.append(size)
        n += 1
    out = SparkArray(df.select(*[c.cast("long").alias(f"j{m}") for m, c in enumerate(cols)], "v").withColumnsRenamed({f"j{m}": f"i{m}" for m in range(len(cols))}), shape)
    for axis, k in later:
        out = take(out, k, axis) if k.dtype != "boolean" else compress(k, out, axis)
    return out


def _several(a: SparkArray, key: list) -> SparkArray:
    """Index arrays (and integers) on some axes, broadcast against each other: their axes stand where the first of them is
    if they are neighbours, else in front.
    """
    special = [isinstance(k, (int, SparkArray)) for k in key]
    b = get(a, tuple(slice(None) if x else k for k, x in zip(key, special)))
    dims = [n for n, x in enumerate(special) if x]
    apart = dims != list(range(dims[0], dims[-1] + 1))
    packed, plain = None, []
    for n in dims:
        k, size = key[n], b.shape[n]
        if isinstance(k, int):
            if not -size <= k < size:
                raise IndexError(k)
            plain.append((n, k % size))
            continue
        one = _index(k, size).map(lambda v: F.array(v))
        packed = one if packed is None else packed.binary(one, lambda x, y: F.concat(x, y))
    own = [n for n in dims if isinstance(key[n], SparkArray)]
    want = packed.df.select(*[F.col(c).alias(f"o{m}") for m, c in enumerate(packed.axes)], *[F.get("v", F.lit(m)).alias(f"p{n}") for m, n in enumerate(own)])
    rows = b.df
    for n, k in plain:
        rows = rows.filter(F.col(f"i{n}") == k)
    on = F.lit(True)
    for m, n in enumerate(own):
        on = (F.col(f"i{n}") == F.col(f"p{n}")) if not m else on & (F.col(f"i{n}") == F.col(f"p{n}"))
    rows = rows.join(_small(want, packed.size), on)
    new = [(F.col(f"o{m}"), s) for m, s in enumerate(packed.shape)]
    rest = [(n, (F.col(f"i{n}"), b.shape[n])) for n in range(b.ndim) if n not in dims]
    first = 0 if apart else dims[0]
    out = [x for n, x in rest if n < first] + new + [x for n, x in rest if n >= first]
    df = rows.select(*[c.alias(f"j{m}") for m, (c, _) in enumerate(out)], "v").withColumnsRenamed({f"j{m}": f"i{m}" for m in range(len(out))})
    return SparkArray(df, [s for _, s in out])


def mask(a: SparkArray, m: SparkArray) -> SparkArray:
    """The cells where the mask is true, in order."""
    kept = a.df.join(m.df.filter("v").drop("v"), [f"i{k}" for k in range(m.ndim)])
    rest = [f"i{k}" for k in range(m.ndim, a.ndim)]
    lead = SparkArray(m.df, m.shape)
    ids = dense_ids(lead.df.filter("v").drop("v"), lead.axes, "o")
    n = ids.count()
    df = kept.join(_small(ids, n), lead.axes).select(F.col("o").alias("j0"), *[F.col(r).alias(f"j{k + 1}") for k, r in enumerate(rest)], "v")
    return SparkArray(df.withColumnsRenamed({f"j{k}": f"i{k}" for k in range(1 + len(rest))}), (n, *a.shape[m.ndim :]))


def extract(condition: SparkArray, a: SparkArray) -> SparkArray:
    return mask(a.ravel(), condition.ravel())


def nonzero(a: SparkArray) -> tuple[SparkArray, ...]:
    note("nonzero")
    hits = dense_ids(a.df.filter(F.col("v").cast("double") != 0).drop("v"), a.axes, "o")
    n = hits.count()
    return tuple(SparkArray(hits.select(F.col("o").alias("i_"), F.col(c).alias("v")).withColumnRenamed("i_", "i0"), (n,)) for c in a.axes)


def argwhere(a: SparkArray) -> SparkArray:
    hits = dense_ids(a.df.filter(F.col("v").cast("double") != 0).drop("v"), a.axes, "o")
    n = hits.count()
    df = hits.select(F.col("o"), F.posexplode(F.array(*a.axes)).alias("p", "v"))
    return SparkArray(df.select(F.col("o").alias("i0"), F.col("p").cast("long").alias("i1"), "v"), (n, a.ndim))


def flatnonzero(a: SparkArray) -> SparkArray:
    return nonzero(a.ravel())[0]


def _index(idx: SparkArray, n: int, mode: str = "raise") -> SparkArray:
    if mode == "wrap":
        return idx.map(lambda v: F.pmod(v.cast("long"), F.lit(n)))
    if mode == "clip":
        return idx.map(lambda v: F.greatest(F.least(v.cast("long"), F.lit(n - 1)), F.lit(0)).cast("long"))
    return idx.map(lambda v: F.when((v < -n) | (v >= n), F.raise_error(F.lit("index is out of bounds"))).otherwise(F.when(v < 0, v + n).otherwise(v)).cast("long"))


def take(a: SparkArray, indices: SparkArray, axis: int | None = None, mode: str = "raise") -> SparkArray:
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    idx = _index(indices, a.shape[k], mode)
    m = idx.ndim
    want = idx.df.select(*[F.col(c).alias(f"o{n}") for n, c in enumerate(idx.axes)], F.col("v").alias("at"))
    df = a.df.join(_small(want, idx.size), F.col(f"i{k}") == F.col("at"))
    cols = [F.col(f"i{n}") for n in range(k)] + [F.col(f"o{n}") for n in range(m)] + [F.col(f"i{n}") for n in range(k + 1, a.ndim)]
    df = df.select(*[c.alias(f"j{n}") for n, c in enumerate(cols)], "v").withColumnsRenamed({f"j{n}": f"i{n}" for n in range(len(cols))})
    return SparkArray(df, (*a.shape[:k], *idx.shape, *a.shape[k + 1 :]))


def gather(a: SparkArray, indices: Sequence[SparkArray]) -> SparkArray:
    """One index array for each axis, broadcast against each other."""
    packed = None
    for k, idx in enumerate(indices):
        one = _index(idx, a.shape[k]).map(lambda v: F.array(v))
        packed = one if packed is None else packed.binary(one, lambda x, y: F.concat(x, y))
    at = packed.df.select(*[F.col(c).alias(f"o{n}") for n, c in enumerate(packed.axes)], *[F.get("v", F.lit(k)).alias(f"i{k}") for k in range(a.ndim)])
    df = a.df.join(_small(at, packed.size), a.axes).select(*[F.col(f"o{n}").alias(f"j{n}") for n in range(packed.ndim)], "v")
    return SparkArray(df.withColumnsRenamed({f"j{n}": f"i{n}" for n in range(packed.ndim)}), packed.shape)


def take_along_axis(a: SparkArray, indices: SparkArray, axis: int) -> SparkArray:
    k = norm_axis(axis, a.ndim)
    idx = _index(indices, a.shape[k])
    rest = [f"i{n}" for n in range(a.ndim) if n != k]
    want = idx.df.select(*rest, F.col(f"i{k}").alias("o"), F.col("v").alias("at"))
    df = a.df.withColumnRenamed(f"i{k}", "at").join(_small(want, idx.size), [*rest, "at"]).drop("at").withColumnRenamed("o", f"i{k}")
    return SparkArray(df, idx.shape)


def scatter(a: SparkArray, updates) -> SparkArray:
    """updates: the axes, ``new``, ``nth``; of several for one cell the last (by nth) wins."""
    last = updates.groupBy(*a.axes).agg(F.max_by("new", "nth").alias("new"), F.lit(True).alias("hit"))
    return SparkArray(a.df.join(last, a.axes, "left").withColumn("v", F.when(F.col("hit"), F.col("new")).otherwise(F.col("v"))), a.shape)


def put(a: SparkArray, indices: SparkArray, values: SparkArray, mode: str = "raise") -> SparkArray:
    """Flat positions; values are cycled."""
    idx = _index(indices.ravel(), a.size, mode)
    vals = values.ravel()
    df = idx.df.withColumnRenamed("v", "f").withColumn("c", F.col("i0") % vals.size).join(_small(vals.df.select(F.col("i0").alias("c"), F.col("v").alias("new")), vals.size), "c")
    at = [(F.expr(f"f div {st}") % s).alias(f"i{k}") for k, (s, st) in enumerate(zip(a.shape, strides(a.shape)))]
    return scatter(a, df.select(F.col("i0").alias("nth"), "new", "f").select(*at, "new", "nth"))


def put_along_axis(a: SparkArray, indices: SparkArray, values: SparkArray, axis: int) -> SparkArray:
    k = norm_axis(axis, a.ndim)
    both = _index(indices, a.shape[k]).binary(values, lambda i, v: F.struct(i.alias("at"), v.alias("new")))
    rest = [f"i{n}" for n in range(a.ndim) if n != k]
    return scatter(a, both.df.select(*rest, F.col(f"i{k}").alias("nth"), F.col("v.at").alias(f"i{k}"), F.col("v.new").alias("new")))


def putmask(a: SparkArray, m: SparkArray, values) -> SparkArray:
    if not isinstance(values, SparkArray):
        return a.binary(m, lambda v, x: F.when(x, F.lit(values)).otherwise(v))
    vals = values.ravel()
    df = a.df.join(m.df.withColumnRenamed("v", "m"), a.axes).withColumn("c", a.flat_id() % vals.size)
    df = df.join(_small(vals.df.select(F.col("i0").alias("c"), F.col("v").alias("new")), vals.size), "c")
    return SparkArray(df.withColumn("v", F.when(F.col("m"), F.col("new")).otherwise(F.col("v"))), a.shape)


def place(a: SparkArray, m: SparkArray, vals: SparkArray) -> SparkArray:
    """The true cells in order take the values, cycled."""
    hits = dense_ids(m.df.filter("v").drop("v"), m.axes, "nth").withColumn("c", F.col("nth") % vals.size)
    return scatter(a, hits.join(_small(vals.ravel().df.select(F.col("i0").alias("c"), F.col("v").alias("new")), vals.size), "c").select(*a.axes, "new", "nth"))


def copyto(dst: SparkArray, src, where: SparkArray | None = None) -> SparkArray:
    new = dst.binary(src, lambda d, s: s) if isinstance(src, SparkArray) else dst.map(lambda v: F.lit(src))
    if where is None:
        return new
    both = dst.binary(new, lambda d, s: F.struct(d.alias("d"), s.alias("s")))
    return both.binary(where, lambda p, m: F.when(m, p["s"]).otherwise(p["d"]))


def compress(condition: SparkArray, a: SparkArray, axis: int | None = None) -> SparkArray:
    return take(a, flatnonzero(condition), axis)


def diagonal(a: SparkArray, offset: int = 0, axis1: int = 0, axis2: int = 1) -> SparkArray:
    p, q = norm_axis(axis1, a.ndim), norm_axis(axis2, a.ndim)
    rest = [k for k in range(a.ndim) if k not in (p, q)]
    i = F.col(f"i{p}") if offset >= 0 else F.col(f"i{q}")
    df = a.df.filter(F.col(f"i{q}") - F.col(f"i{p}") == offset).select(*[F.col(f"i{k}").alias(f"j{n}") for n, k in enumerate(rest)], i.alias(f"j{len(rest)}"), "v")
    n = max(0, min(a.shape[p], a.shape[q] - offset) if offset >= 0 else min(a.shape[p] + offset, a.shape[q]))
    return SparkArray(df.withColumnsRenamed({f"j{k}": f"i{k}" for k in range(len(rest) + 1)}), [*[a.shape[k] for k in rest], n])


def fill_diagonal(a: SparkArray, value, wrap: bool = False) -> SparkArray:
    if wrap and a.ndim == 2:
        return SparkArray(a.df.withColumn("v", F.when(a.flat_id() % (a.shape[1] + 1) == 0, F.lit(value)).otherwise(F.col("v"))), a.shape)
    same = F.lit(True)
    for k in range(1, a.ndim):
        same = same & (F.col("i0") == F.col(f"i{k}"))
    return SparkArray(a.df.withColumn("v", F.when(same, F.lit(value)).otherwise(F.col("v"))), a.shape)


def choose(a: SparkArray, choices: Sequence[SparkArray], mode: str = "raise") -> SparkArray:
    """choices[a] cell by cell."""
    packed = None
    for c in choices:
        one = c.map(lambda v: F.array(v))
        packed = one if packed is None else packed.binary(one, lambda x, y: F.concat(x, y))
    return _index(a, len(choices), mode).binary(packed, lambda i, xs: F.get(xs, i.cast("int")))


def select(conditions: Sequence[SparkArray], choices: Sequence, default=0) -> SparkArray:
    """The first true condition decides."""
    out = None
    for c, x in zip(reversed(conditions), reversed(choices)):
        if out is None:
            out = where(c, x, default)
        else:
            out = where(c, x, out)
    return out


def where(c: SparkArray, x, y) -> SparkArray:
    take_x = c.binary(x, lambda m, v: F.struct(m.alias("m"), F.lit(v).alias("x") if not hasattr(v, "alias") else v.alias("x")))
    return take_x.binary(y, lambda p, v: F.when(p["m"], p["x"]).otherwise(v))


def unravel_index(idx: SparkArray, shape: Sequence[int]) -> tuple[SparkArray, ...]:
    return tuple(idx.map(lambda v, s=s, st=st: (F.floor(v / st).cast("long") % s)) for s, st in zip(shape, strides(shape)))


def ravel_multi_index(parts: Sequence[SparkArray], shape: Sequence[int], mode: str = "raise") -> SparkArray:
    out = None
    for p, s, st in zip(parts, shape, strides(shape)):
        one = _index(p, s, mode).map(lambda v, st=st: v * st)
        out = one if out is None else out.binary(one, lambda x, y: x + y)
    return out


def indices(spark, shape: Sequence[int]) -> SparkArray:
    from sparkarray.operators.creation import grid

    g = grid(spark, shape)
    n = len(shape)
    df = g.select(F.posexplode(F.array(*axes(n))).alias("p", "v"), *[F.col(f"i{k}").alias(f"j{k + 1}") for k in range(n)])
    return SparkArray(df.withColumn("j0", F.col("p").cast("long")).select("v", *[F.col(f"j{k}").alias(f"i{k}") for k in range(n + 1)]), (n, *shape))


def tril_indices(spark, n: int, k: int = 0, m: int | None = None) -> tuple[SparkArray, ...]:
    from sparkarray.operators.creation import tri

    return nonzero(tri(spark, n, m, k))


def triu_indices(spark, n: int, k: int = 0, m: int | None = None) -> tuple[SparkArray, ...]:
    from sparkarray.operators.creation import tri

    return nonzero(tri(spark, n, m, k - 1).map(lambda v: 1 - v))


def diag_indices(spark, n: int, ndim: int = 2) -> tuple[SparkArray, ...]:
    from sparkarray.operators.creation import arange

    return (arange(spark, n),) * ndim


def mask_indices(spark, n: int, f, k: int = 0) -> tuple[SparkArray, ...]:
    from sparkarray.operators.creation import ones

    return nonzero(f(ones(spark, (n, n)), k))


METHODS = {f.__name__: f for f in (nonzero, argwhere, flatnonzero, take, take_along_axis, put, put_along_axis, putmask, place, diagonal, fill_diagonal, choose)}
METHODS |= {"compress": lambda a, c, axis=None: compress(c, a, axis), "extract": lambda a, c: extract(c, a)}
