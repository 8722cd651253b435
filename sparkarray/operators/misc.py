"""Shapes and kinds of arrays, index helpers: mostly facts about metadata."""

from __future__ import annotations

import numbers
from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, norm_axis
from sparkarray.operators import indexing, ordering

broadcast_shapes = np.broadcast_shapes


def broadcast_arrays(*arrays: SparkArray) -> list[SparkArray]:
    shape = np.broadcast_shapes(*(a.shape for a in arrays))
    return [a.broadcast_to(shape) for a in arrays]


class broadcast:  # noqa: N801
    """What broadcasting arrays against each other gives, without doing it."""

    def __init__(self, *arrays: SparkArray):
        self.arrays, self.shape = arrays, np.broadcast_shapes(*(a.shape for a in arrays))
        self.numiter, self.ndim, self.nd, self.index = len(arrays), len(self.shape), len(self.shape), 0
        self.size = int(np.prod(self.shape))

    @property
    def iters(self) -> tuple[SparkArray, ...]:
        return tuple(a.ravel() for a in broadcast_arrays(*self.arrays))

    def reset(self) -> None:
        self.index = 0


def shape(a) -> tuple[int, ...]:
    return a.shape if isinstance(a, SparkArray) else np.shape(a)


def ndim(a) -> int:
    return len(shape(a))


def size(a, axis: int | None = None) -> int:
    s = shape(a)
    return int(np.prod(s)) if axis is None else s[axis]


def isscalar(x) -> bool:
    return isinstance(x, (numbers.Number, np.generic, str, bytes))


def iscomplexobj(x) -> bool:
    return x.is_complex if isinstance(x, SparkArray) else np.iscomplexobj(x)


def isrealobj(x) -> bool:
    return not iscomplexobj(x)


def real_if_close(a: SparkArray, tol: float = 100) -> SparkArray:
    """The real parts if no imaginary part exceeds ``tol`` (in units of the smallest step at one, if above one)."""
    if not a.is_complex:
        return a
    most = tol * float(np.finfo("f8").eps) if tol > 1 else tol
    far = a.df.filter(F.abs("v.im") >= most).limit(1).count()
    return a if far else a.ufunc("real")


#: The kinds of types by Spark's names.
KINDS = {
    "bool": {"boolean"}, "signed integer": {"tinyint", "smallint", "int", "bigint"}, "unsigned integer": set(), "integral": {"tinyint", "smallint", "int", "bigint"},
    "real floating": {"float", "double"}, "complex floating": {"struct<re:double,im:double>"},
}
KINDS["numeric"] = KINDS["integral"] | KINDS["real floating"] | KINDS["complex floating"]


def isdtype(dtype: str, kind: str | tuple[str, ...]) -> bool:
    return any(dtype in KINDS.get(k, {k}) for k in ([kind] if isinstance(kind, str) else kind))


def normalize_axis_index(axis: int, ndim: int) -> int:
    return norm_axis(axis, ndim)


def normalize_axis_tuple(axis: int | Sequence[int], ndim: int, argname: str | None = None, allow_duplicate: bool = False) -> tuple[int, ...]:
    out = tuple(norm_axis(k, ndim) for k in ([axis] if isinstance(axis, int) else axis))
    if len(set(out)) < len(out) and not allow_duplicate:
        raise ValueError(f"repeated axis{f' in `{argname}`' if argname else ''}")
    return out


def sort_complex(a: SparkArray) -> SparkArray:
    """By real part, then imaginary part; always complex."""
    return ordering.sort(a.astype("complex"))


def ix_(*lists: SparkArray) -> tuple[SparkArray, ...]:
    """Index arrays that together name the cells of a grid."""
    lists = tuple(indexing.flatnonzero(x) if x.dtype == "boolean" else x for x in lists)
    return tuple(x.reshape([x.size if n == k else 1 for n in range(len(lists))]) for k, x in enumerate(lists))


def diag_indices_from(a: SparkArray) -> tuple[SparkArray, ...]:
    if len(set(a.shape)) != 1:
        raise ValueError("all dimensions must be of equal length")
    return indexing.diag_indices(a.spark, a.shape[0], a.ndim)


def tril_indices_from(a: SparkArray, k: int = 0) -> tuple[SparkArray, ...]:
    return indexing.tril_indices(a.spark, a.shape[-2], k, a.shape[-1])


def triu_indices_from(a: SparkArray, k: int = 0) -> tuple[SparkArray, ...]:
    return indexing.triu_indices(a.spark, a.shape[-2], k, a.shape[-1])


METHODS = {f.__name__: f for f in (real_if_close,)}
