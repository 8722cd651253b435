"""Ufuncs as objects: calls with ``out`` and ``where``, and the methods reduce, accumulate, outer and at."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkarray.array import SparkArray
from sparkarray.functions import ufuncs as U

#: The reduction that a function of two operands is.
REDUCTIONS = {"add": "sum", "multiply": "prod", "maximum": "amax", "minimum": "amin", "fmax": "nanmax", "fmin": "nanmin", "logical_and": "all", "logical_or": "any"}
BITS = {"bitwise_and": F.bit_and, "bitwise_or": F.bit_or, "bitwise_xor": F.bit_xor}


def _array(x) -> SparkArray:
    from sparkarray.session import session

    return x if isinstance(x, SparkArray) else SparkArray.from_numpy(SparkSession.getActiveSession() or session(), x)


class Ufunc:
    def __init__(self, name: str):
        self.name = U.ALIASES.get(name, name)
        self.__name__ = name

    @property
    def nin(self) -> int:
        return 2 if self.name in U.BINARY else 1

    @property
    def nout(self) -> int:
        return 2 if self.name in U.MULTI else 1

    def __repr__(self) -> str:
        return f"<ufunc '{self.__name__}'>"

    def __call__(self, *inputs, out=None, where=True, dtype: str | None = None, casting: str = "same_kind"):
        """``out`` is an array whose handle takes the result (cast to its type); cells where ``where`` is false keep what
        ``out`` has there, or are zero without one.
        """
        first, *others = inputs
        got = _array(first).ufunc(self.name, *others)
        if self.nout == 2:
            if out is not None:
                for o, g in zip(out, got):
                    _put(o, g, where)
                return tuple(out)
            return got
        if dtype is not None:
            got = got.astype(dtype)
        if out is not None:
            return _put(out, got, where)
        if where is True:
            return got
        return got.binary(_array(where), lambda v, m: F.when(m, v).otherwise(F.lit(0).cast(got.dtype)))

    def reduce(self, a, axis=0, dtype: str | None = None, out=None, keepdims: bool = False, initial=None, where=None) -> SparkArray:
        """Over an axis (the first, by default), several, or all (None)."""
        from sparkarray.operators import reductions

        a = _array(a)
        if self.name in BITS:
            got = reductions.reduce(a, BITS[self.name](F.col("v")), axis, keepdims, where, initial, lambda x, y: U.BINARY[self.name](x, y))
        elif self.name == "logical_xor":
            got = reductions.count_nonzero(a, axis, keepdims).map(lambda v: v % 2 == 1)
        elif self.name in REDUCTIONS:
            more = {k: v for k, v in (("initial", initial), ("where", where)) if v is not None}
            got = getattr(reductions, REDUCTIONS[self.name])(a, axis, keepdims, **more)
        else:
            raise NotImplementedError(f"{self.__name__} has no reduction: its order would matter")
        if dtype is not None:
            got = got.astype(dtype)
        return got if out is None else _put(out, got, True)

    def accumulate(self, a, axis: int = 0, out=None) -> SparkArray:
        from sparkarray.operators import scans

        table = {"add": scans.cumsum, "multiply": scans.cumprod}
        if self.name not in table:
            raise NotImplementedError(f"{self.__name__} has no running form")
        got = table[self.name](_array(a), axis)
        return got if out is None else _put(out, got, True)

    def outer(self, a, b) -> SparkArray:
        a, b = _array(a), _array(b)
        return a.reshape([*a.shape, *[1] * b.ndim]).ufunc(self.name, b)

    def at(self, a: SparkArray, indices, *values) -> None:
        """The handle takes a plan in which the named cells of a vector have gone through the function; repeats count for add."""
        from sparkarray.operators import indexing

        idx = _array(indices).ravel()
        if self.name in ("add", "subtract") and values:
            v = values[0] if isinstance(values[0], SparkArray) else None
            pairs = idx.binary(v.ravel(), lambda i, x: F.struct(i.alias("i"), x.alias("x"))) if v is not None else idx.map(lambda i: F.struct(i.alias("i"), F.lit(values[0]).alias("x")))
            sums = pairs.df.select(F.when(F.col("v.i") < 0, F.col("v.i") + a.shape[0]).otherwise(F.col("v.i")).alias("i0"), F.col("v.x").alias("x")).groupBy("i0").agg(F.sum("x").alias("x"))
            joined = a.df.join(sums, "i0", "left")
            step = F.coalesce("x", F.lit(0))
            new = SparkArray(joined.withColumn("v", (F.col("v") + step if self.name == "add" else F.col("v") - step).cast(a.dtype)), a.shape)
        else:
            own = indexing.take(a, idx)
            new = indexing.put(a, idx, own.ufunc(self.name, *values))
        a._become(new)


def _put(out: SparkArray, got: SparkArray, where) -> SparkArray:
    got = got.broadcast_to(out.shape).astype("complex" if out.is_complex else out.dtype)
    if where is not True:
        mask = _array(where)
        old = out.binary(got, lambda o, g: F.struct(o.alias("o"), g.alias("g")))
        got = old.binary(mask, lambda p, m: F.when(m, p["g"]).otherwise(p["o"]))
    out._become(got)
    return out
