"""The array handle: a coordinate table (i0, i1, ..., v) with a known shape; every operation is a lazy DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkarray.functions import complexes as C
from sparkarray.functions import ufuncs as U
from sparkarray.session import cut

#: A side of a broadcasting join is hinted small up to so many cells; beyond it Spark decides by its own sizes.
BROADCAST_CELLS = 200_000
#: Steps of a root; further ones begin a new one. Grids that are remembered.
MOST_STEPS, MOST_GRIDS = 48, 16
#: Steps up to which an expression of coordinates can be written out anew.
MOST_MADE = 64
#: Bytes that the driver takes as one NumPy array.
DRIVER_BYTES = 4_000_000_000

#: Counters of those who watch how arrays are used (plans/doctor.py).
watchers: list = []


def note(kind: str) -> None:
    for w in watchers:
        w(kind)


def axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def strides(shape: Sequence[int]) -> list[int]:
    out, n = [], 1
    for s in reversed(shape):
        out.append(n)
        n *= s
    return out[::-1]


def norm_axis(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise ValueError(f"axis {axis} is out of bounds for {ndim} dimensions")
    return axis % ndim


class Root:
    """Rows that elementwise results share: each step is one more column, so operands with one root need no join.

    What an array does not use is pruned from its plan; steps are columns by name, so nothing is computed twice or nested.
    """

    def __init__(self, rows: DataFrame):
        self.rows, self.steps = rows, 0

    def add(self, value: Column) -> str:
        self.steps += 1
        name = f"_e{self.steps}"
        self.rows = self.rows.withColumn(name, value)
        return name


#: The grids of generated arrays, by session and shape; of late the last few.
_grids: dict[tuple, Root] = {}


class SparkArray:
    """A dense array. Index columns are long and count from 0 in each axis.

    Elementwise steps keep what they come from: ``root`` is shared rows and a column's name. ``made`` gives a cell as an
    expression of its coordinates (ranges, constants, random draws), which any other array's rows can take on.
    """

    def __init__(self, df: DataFrame, shape: Sequence[int], made: Callable[..., Column] | None = None, root: tuple[Root, str] | None = None, size: int = 1):
        self.shape = tuple(int(s) for s in shape)
        self.df = df.select(*axes(len(self.shape)), "v")
        self._made, self._root, self._size = made if size <= MOST_MADE else None, root, size

    @classmethod
    def generated(cls, spark: SparkSession, shape: Sequence[int], made: Callable[..., Column], size: int = 1) -> SparkArray:
        """All cells of a shape by an expression of their coordinates."""
        shape = tuple(int(s) for s in shape)
        key = (spark.sparkContext.applicationId, id(spark), shape)
        root = _grids.pop(key, None)
        if root is None or root.steps >= MOST_STEPS:
            f = spark.range(math.prod(shape))
            root = Root(f.select(*[(F.expr(f"id div {max(st, 1)}") % max(s, 1)).alias(f"i{k}") for k, (s, st) in enumerate(zip(shape, strides(shape)))]))
        _grids[key] = root
        while len(_grids) > MOST_GRIDS:
            del _grids[next(iter(_grids))]
        return cls._in(root, root.add(made(*[F.col(a) for a in axes(len(shape))])), shape, made, size)

    @classmethod
    def _in(cls, root: Root, name: str, shape: Sequence[int], made: Callable[..., Column] | None = None, size: int = 1) -> SparkArray:
        return cls(root.rows.select(*axes(len(shape)), F.col(name).alias("v")), shape, made, (root, name), size)

    @property
    def root(self) -> tuple[Root, str]:
        if self._root is None or self._root[0].steps >= MOST_STEPS:
            self._root = Root(self.df), "v"
        return self._root

    def _together(self, other: SparkArray) -> tuple[Root, str, str] | None:
        """The root that both have, or None."""
        if self is other:
            root, name = self.root
            return root, name, name
        if self.shape != other.shape or self._root is None or other._root is None or self._root[0] is not other._root[0]:
            return None
        root, one, two = self._root[0], self._root[1], other._root[1]
        if root.steps >= MOST_STEPS:  # both go on in fresh rows
            root = Root(root.rows.select(*self.axes, F.col(one).alias("_a"), F.col(two).alias("_b")))
            self._root, other._root, one, two = (root, "_a"), (root, "_b"), "_a", "_b"
        return root, one, two

    # --- handle ---
    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def axes(self) -> list[str]:
        return axes(self.ndim)

    @property
    def dtype(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    @property
    def T(self) -> SparkArray:  # noqa: N802
        return self.transpose()

    @property
    def mT(self) -> SparkArray:  # noqa: N802
        return self.transpose([*range(self.ndim - 2), self.ndim - 1, self.ndim - 2])

    @property
    def flat(self) -> SparkArray:
        return self.ravel()

    @property
    def itemsize(self) -> int:
        return {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}.get(self.dtype, 16 if self.is_complex else 8)

    @property
    def nbytes(self) -> int:
        return self.itemsize * self.size

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(s * self.itemsize for s in strides(self.shape))

    #: Cells live in a DataFrame: there is no owner, buffer, device or writable flag to speak of.
    base = device = None

    def to_device(self, device=None, *, stream=None) -> SparkArray:
        if device is not None:
            raise ValueError("arrays have no device")
        return self

    def view(self, kind: str | None = None) -> SparkArray:
        if kind not in (None, self.dtype):
            raise NotImplementedError("cells can't be read as another type; use astype")
        return self

    def fill(self, value) -> SparkArray:
        """A new array; arrays don't change."""
        return self.map(lambda v: F.lit(value).cast(self.dtype))

    def dumps(self) -> bytes:
        import io

        out = io.BytesIO()
        np.save(out, self.to_numpy(), allow_pickle=False)
        return out.getvalue()

    def stencil_hint(self, *_) -> None:
        """Nothing to fetch ahead of time: the planner sees the joins."""

    @classmethod
    def from_numpy(cls, spark: SparkSession, a) -> SparkArray:
        a = np.asarray(a)
        if a.dtype.kind == "c":
            both = cls.from_numpy(spark, a.real.astype("f8")), cls.from_numpy(spark, a.imag.astype("f8"))
            return both[0].binary(both[1], lambda re, im: C.cell((re, im)))
        if a.dtype.kind == "u" and a.itemsize == 8:
            v = pa.array([Decimal(x) for x in a.reshape(-1).tolist()], pa.decimal128(20, 0))
        else:
            # Unsigned types in the next larger signed one, half precision in single.
            v = pa.array(a.reshape(-1).astype({"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}.get(a.dtype.kind + str(a.itemsize), a.dtype)))
        grid = np.indices(a.shape).reshape(a.ndim, -1) if a.ndim else np.zeros((0, 1), "i8")
        return cls(spark.createDataFrame(pa.table([*(pa.array(g.astype("i8")) for g in grid), v], [*axes(a.ndim), "v"])), a.shape)

    @classmethod
    def from_column(cls, df: DataFrame, value: str | Column, order: Sequence[str | Column]) -> SparkArray:
        """A column as a vector in the order of a unique key; ids are dense by two phases, no window over all rows."""
        value = F.col(value) if isinstance(value, str) else value
        keys = [F.col(k) if isinstance(k, str) else k for k in order]
        rows = dense_ids(df.select(value.alias("v"), *[k.alias(f"k{n}") for n, k in enumerate(keys)]), [f"k{n}" for n in range(len(keys))])
        return cls(rows.select(F.col("id").alias("i0"), "v"), (df.count(),))

    def to_numpy(self) -> np.ndarray:
        if self.nbytes > DRIVER_BYTES:
            raise MemoryError(f"{self.nbytes} bytes are too much for the driver; write the array with save")
        if self.is_complex:
            return self.ufunc("real").to_numpy() + 1j * self.ufunc("imag").to_numpy()
        rows = self.df.toArrow()
        v = rows["v"].to_numpy()
        if self.dtype == "decimal(20,0)":
            v = np.array([int(x) for x in v], "u8")
        out = np.empty(self.shape, dtype=v.dtype)
        out[tuple(rows[a].to_numpy() for a in self.axes)] = v if self.ndim else v[0]
        return out

    def tobytes(self, order: str = "C") -> bytes:
        return self.to_numpy().tobytes(order)

    tostring = tobytes

    def tofile(self, path: str, sep: str = "", format: str = "%s") -> None:  # noqa: A002
        self.to_numpy().tofile(path, sep=sep, format=format)

    def dump(self, path: str) -> None:
        np.save(path, self.to_numpy(), allow_pickle=False)

    def item(self):
        note("item")
        return self.df.first()["v"]

    def tolist(self):
        return self.to_numpy().tolist()

    def flat_id(self) -> Column:
        out = F.lit(0).cast("long")
        for a, s in zip(self.axes, strides(self.shape)):
            out = out + F.col(a) * s
        return out

    # --- elementwise ---
    def map(self, f) -> SparkArray:
        root, name = self.root
        made = self._made
        return SparkArray._in(root, root.add(f(F.col(name))), self.shape, (lambda *i: f(made(*i))) if made else None, self._size + 1)

    def astype(self, kind: str) -> SparkArray:
        """To a Spark type's name; ``complex`` is (re, im)."""
        if kind == "complex":
            return self if self.is_complex else self.map(lambda v: C.cell(C.parts(v, False)))
        if self.is_complex:
            return self.ufunc("real").astype(kind)
        return self.map(lambda v: (U.trunc(v) if kind in ("int", "long", "short", "byte") and self.dtype in ("double", "float") else v).cast(kind))

    def broadcast_to(self, shape: Sequence[int]) -> SparkArray:
        pad = len(shape) - self.ndim
        df = self.df.select(*[F.lit(0).cast("long").alias(f"i{k}") for k in range(pad)], *[F.col(a).alias(f"i{k + pad}") for k, a in enumerate(self.axes)], "v")
        have = (1,) * pad + self.shape
        for k, (h, s) in enumerate(zip(have, shape)):
            if h != s:
                if h != 1:
                    raise ValueError("shapes do not broadcast")
                df = df.drop(f"i{k}").withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s - 1).cast("long"))) if s else F.explode(F.array().cast("array<long>")))
        return SparkArray(df, shape)

    def binary(self, other, f) -> SparkArray:
        """f on aligned cells; axes of length 1 are left out of the join, so nothing is repeated before it."""
        if not isinstance(other, SparkArray):
            return self.map(lambda v: f(v, other))
        shape = np.broadcast_shapes(self.shape, other.shape)
        common = self._together(other)
        # Sides that are expressions of their coordinates need no rows of their own.
        pick = lambda x, i: [i[k + len(shape) - x.ndim] if s != 1 else F.lit(0).cast("long") for k, s in enumerate(x.shape)]
        one, two, size = self._made, other._made, self._size + other._size
        made = (lambda *i: f(one(*pick(self, i)), two(*pick(other, i)))) if one and two else None
        if common is not None:
            root, a, b = common
            return SparkArray._in(root, root.add(f(F.col(a), F.col(b))), shape, made, size)
        if made:
            return SparkArray.generated(self.spark, shape, made, size)
        i = [F.col(c) for c in axes(len(shape))]
        if two and shape == self.shape:
            root, name = self.root
            return SparkArray._in(root, root.add(f(F.col(name), two(*pick(other, i)))), shape)
        if one and shape == other.shape:
            root, name = other.root
            return SparkArray._in(root, root.add(f(one(*pick(self, i)), F.col(name))), shape)
        n = len(shape)
        sides = []
        for x, name in ((self, "a"), (other, "b")):
            pad = n - x.ndim
            own = [k for k in range(n) if k >= pad and x.shape[k - pad] == shape[k]]
            sides.append((x.df.select(*[F.col(f"i{k - pad}").alias(f"i{k}") for k in own], F.col("v").alias(name)), own, x.size))
        (l, la, ls), (r, ra, rs) = sides
        on = [f"i{k}" for k in la if k in ra]
        if rs <= BROADCAST_CELLS:
            r = F.broadcast(r)
        elif ls <= BROADCAST_CELLS:
            l = F.broadcast(l)
        df = l.join(r, on) if on else l.crossJoin(r)
        have = set(la) | set(ra)
        df = df.select(*[F.col(f"i{k}") if k in have else F.lit(0).cast("long").alias(f"i{k}") for k in range(n)], f(F.col("a"), F.col("b")).alias("v"))
        return SparkArray(df, shape)

    @property
    def is_complex(self) -> bool:
        return self.dtype.startswith("struct<re:")

    def ufunc(self, name: str, *others):
        name = U.ALIASES.get(name, name)
        other = others[0] if others else None
        if self.is_complex or isinstance(other, complex) or (isinstance(other, SparkArray) and other.is_complex):
            mine = lambda v: C.parts(v, self.is_complex)
            if not others:
                return self.map(lambda v: C.UNARY[name](mine(v)))
            theirs = lambda v: C.parts(v, isinstance(other, SparkArray) and other.is_complex)
            return self.binary(other, lambda a, b: C.BINARY[name](mine(a), theirs(b)))
        if not others:
            f = U.ufunc(name, [self.dtype])
            if name in U.MULTI:
                return tuple(self.map(lambda v, k=k: f(v)[k]) for k in range(2))
            return self.map(f)
        return self.binary(other, U.ufunc(name, [self.dtype, other.dtype if isinstance(other, SparkArray) else U.kind_of(other)]))

    def __getattr__(self, name: str):
        table = {**U.UNARY, **U.BINARY, **U.MULTI, **U.ALIASES}
        if name in table and name not in ("real", "imag"):
            return lambda *others: self.ufunc(name, *others)
        from sparkarray import operators

        found = operators.method(name)
        if found is None:
            raise AttributeError(name)
        return lambda *a, **k: found(self, *a, **k)

    # --- shape: index arithmetic only, no shuffle ---
    def transpose(self, order: Sequence[int] | None = None) -> SparkArray:
        order = list(order) if order is not None else list(range(self.ndim))[::-1]
        order = [norm_axis(k, self.ndim) for k in order]
        return SparkArray(self.df.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(order)], "v"), [self.shape[k] for k in order])

    def reshape(self, *shape, order: str = "C") -> SparkArray:
        shape = list(shape[0] if len(shape) == 1 and not isinstance(shape[0], int) else shape)
        if -1 in shape:
            shape[shape.index(-1)] = self.size // max(math.prod(s for s in shape if s != -1), 1)
        if math.prod(shape) != self.size:
            raise ValueError("cannot reshape")
        if order == "F":
            return self.transpose().reshape(shape[::-1]).transpose()
        flat = self.df.select(self.flat_id().alias("f"), "v")
        out = [(F.expr(f"f div {max(st, 1)}") % max(s, 1)).cast("long").alias(f"i{k}") for k, (s, st) in enumerate(zip(shape, strides(shape)))]
        return SparkArray(flat.select(*out, "v"), shape)

    def ravel(self, order: str = "C") -> SparkArray:
        return self.reshape(self.size, order=order)

    flatten = ravel

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, key):
        from sparkarray.operators import indexing

        return indexing.get(self, key)

    def __setitem__(self, key, value) -> None:
        """The handle takes a new plan in which the named cells have new values; of several for one cell the last wins."""
        from sparkarray.operators import indexing

        spots = indexing.get(SparkArray(self.df.withColumn("v", self.flat_id()), self.shape), key)
        cast = lambda v: F.lit(v).cast(self.df.schema["v"].dataType)
        if isinstance(value, (list, np.ndarray)):
            value = SparkArray.from_numpy(self.spark, value)
        if isinstance(value, SparkArray):
            pairs = spots.binary(value.broadcast_to(spots.shape), lambda f, v: F.struct(f.alias("f"), cast(v).alias("new")))
        else:
            pairs = spots.map(lambda f: F.struct(f.alias("f"), cast(value).alias("new")))
        at = [(F.expr(f"v.f div {max(st, 1)}") % max(s, 1)).alias(f"p{k}") for k, (s, st) in enumerate(zip(self.shape, strides(self.shape)))]
        updates = pairs.df.select(*at, F.col("v.new").alias("new"), pairs.flat_id().alias("nth")).withColumnsRenamed({f"p{k}": f"i{k}" for k in range(self.ndim)})
        self._become(indexing.scatter(self, updates))

    def _become(self, other: SparkArray) -> None:
        """This handle stands for another array of its shape from now on."""
        self.df, self._made, self._root = other.df, other._made, other._root
        self._size = other._size

    def __iter__(self):
        """Slices along the first axis, each a plan of its own; for whole arrays prefer operators."""
        note("iteration")
        if not self.ndim:
            raise TypeError("iteration over a 0-d array")
        return (self[k] for k in range(self.shape[0]))

    def _scalar(self):
        if self.size != 1:
            raise TypeError("only arrays of one cell are numbers")
        x = self.df.first()["v"]
        return complex(x["re"], x["im"]) if self.is_complex else x

    def __bool__(self) -> bool:
        return bool(self._scalar())

    def __int__(self) -> int:
        return int(self._scalar())

    def __float__(self) -> float:
        return float(self._scalar())

    def __complex__(self) -> complex:
        return complex(self._scalar())

    def __index__(self) -> int:
        if self.dtype not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError("only whole numbers are indices")
        return int(self._scalar())

    def __contains__(self, value) -> bool:
        return bool(self.df.filter(U.ufunc("equal", [self.dtype, U.kind_of(value)])(F.col("v"), value)).limit(1).count())

    def __copy__(self) -> SparkArray:
        return SparkArray(self.df, self.shape)

    def __deepcopy__(self, memo) -> SparkArray:
        return SparkArray(self.df, self.shape)

    def __repr__(self) -> str:
        return f"SparkArray(shape={self.shape}, dtype={self.dtype})"

    def __divmod__(self, other):
        return self // other, self % other

    def __pos__(self):
        return self.ufunc("positive")

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self.to_numpy() if dtype is None else self.to_numpy().astype(dtype)

    def __array_namespace__(self, *, api_version=None):
        from sparkarray import namespace

        return namespace

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        """NumPy's ufuncs on these arrays, their methods and keywords become plans."""
        from sparkarray.functions.callable import Ufunc

        f = Ufunc(ufunc.__name__)
        out = kwargs.pop("out", None)
        if out is not None:
            kwargs["out"] = out[0] if len(out) == 1 else out
        return (f if method == "__call__" else getattr(f, method))(*inputs, **kwargs)

    def __array_function__(self, func, types, args, kwargs):
        from sparkarray import namespace

        return getattr(namespace, func.__name__)(*args, **kwargs)

    def __neg__(self):
        return self.ufunc("negative")

    def __abs__(self):
        return self.ufunc("absolute")

    def __invert__(self):
        return self.ufunc("invert")

    def __matmul__(self, other):
        from sparkarray.operators import products

        return products.matmul(self, other)


def _operator(name: str, swap: bool = False):
    def run(self, other):
        if self.is_complex or isinstance(other, complex) or (isinstance(other, SparkArray) and other.is_complex):
            if not swap:
                return self.ufunc(name, other)
            return self.binary(other, lambda a, b: C.BINARY[name](C.parts(b, False), C.parts(a, self.is_complex)))
        kinds = [self.dtype, other.dtype if isinstance(other, SparkArray) else U.kind_of(other)]
        f = U.ufunc(name, kinds[::-1] if swap else kinds)
        return self.binary(other, (lambda a, b: f(b, a)) if swap else f)

    return run


for _dunder, _name in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "true_divide", "floordiv": "floor_divide", "mod": "remainder", "pow": "power", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift"}.items():
    setattr(SparkArray, f"__{_dunder}__", _operator(_name))
    setattr(SparkArray, f"__r{_dunder}__", _operator(_name, True))
for _dunder, _name in {"gt": "greater", "ge": "greater_equal", "lt": "less", "le": "less_equal", "eq": "equal", "ne": "not_equal"}.items():
    setattr(SparkArray, f"__{_dunder}__", _operator(_name))
SparkArray.__hash__ = object.__hash__


def dense_ids(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Adds 0..n-1 in the order of the keys: one range shuffle, a window within each range, offsets of the ranges."""
    return running(df, keys, F.lit(1), name, exclusive=True)


def running(df: DataFrame, keys: list[str], value: Column, name: str, by: Sequence[str] = (), product: bool = False, exclusive: bool = False) -> DataFrame:
    """Adds a running sum (or product) in the order of the keys, for each group ``by``, in two phases.

    The rows are dealt by range and cut there, so that both phases see the same ranges; what the driver sees is a row for
    each range (and group in it).
    """
    by = list(by)
    ranged = cut(df.repartitionByRange(*by, *keys).withColumn("_p", F.spark_partition_id()).withColumn("_x", value))
    own = W.partitionBy("_p", *by).orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce(F.product("_x"), F.lit(1.0)) if product else F.coalesce(F.sum("_x"), F.lit(0))
    parts = ranged.groupBy("_p", *by).agg(total.alias("_t"))
    # Ranges are few: the sums before each are a window over them.
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    prefix = F.coalesce(F.product("_t").over(before) if product else F.sum("_t").over(before), F.lit(1.0) if product else F.lit(0))
    parts = parts.select(F.col("_p").alias("_q"), *[F.col(b).alias(f"_g_{b}") for b in by], prefix.alias("_b"))
    on = F.col("_p") == F.col("_q")
    for b in by:
        on = on & (F.col(b) == F.col(f"_g_{b}"))
    out = ranged.join(parts, on)
    run = F.product("_x").over(own) if product else F.sum("_x").over(own)
    whole = F.col("_b") * run if product else F.col("_b") + run - (F.col("_x") if exclusive else F.lit(0))
    return out.withColumn(name, whole).select(*df.columns, name)
