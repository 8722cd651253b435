"""The array vocabulary as one namespace over the active session: ``from sparkarray import namespace as np``.

Creating functions take the active Spark session (or start one); ufuncs and operators are looked up by name.
"""

from __future__ import annotations

import inspect
from importlib import import_module

from pyspark.sql import SparkSession

from sparkarray import operators
from sparkarray.array import SparkArray
from sparkarray.functions import complexes as C
from sparkarray.functions import ufuncs as U
from sparkarray.functions.callable import Ufunc
from sparkarray.session import session

MODULES = ("creation", "reductions", "ordering", "scans", "hist", "indexing", "shaping", "products", "linalg", "signal", "misc", "tasks")

pi, e, euler_gamma = 3.141592653589793, 2.718281828459045, 0.5772156649015329
inf, nan, newaxis = U.INF, U.NAN, None
#: Types by the names of array programming; unsigned ones are held in the next larger signed type.
DTYPES = {
    "bool_": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "complex64": "complex", "complex128": "complex",
}
#: Functions that array programming also offers in submodules.
SUBMODULES = {"fft": "signal", "linalg": "linalg"}
ndarray = SparkArray


def spark() -> SparkSession:
    return SparkSession.getActiveSession() or session()


def _bound(f):
    """A function whose first parameter is the session, with the active one put in when it is called."""
    first = next(iter(inspect.signature(f).parameters), None) if inspect.isfunction(f) else None
    return (lambda *a, **k: f(spark(), *a, **k)) if first == "spark" else f


def _asarray(x) -> SparkArray:
    return x if isinstance(x, SparkArray) else SparkArray.from_numpy(spark(), x)


def ufunc(name: str) -> Ufunc:
    return Ufunc(name)


def astype(x: SparkArray, dtype: str) -> SparkArray:
    return x.astype(DTYPES.get(dtype, dtype))


def is_supported_dtype(dtype: str) -> bool:
    return dtype in DTYPES or dtype in DTYPES.values()


class _Submodule:
    def __init__(self, name: str):
        self._module = import_module(f"sparkarray.operators.{name}")

    def __getattr__(self, name: str):
        return _bound(getattr(self._module, name))


class _Random:
    """Draws from one generator for each session; ``seed`` begins it anew."""

    def __init__(self):
        self._of: dict = {}

    def _generator(self):
        from sparkarray.operators.random import Generator

        s = spark()
        key = s.sparkContext.applicationId
        if key not in self._of:
            self._of = {key: Generator(s)}
        return self._of[key]

    def seed(self, value: int | None = None) -> None:
        from sparkarray.operators.random import Generator

        s = spark()
        self._of = {s.sparkContext.applicationId: Generator(s, value or 0)}

    def RandomState(self, seed: int | None = None):  # noqa: N802
        """A generator of its own."""
        from sparkarray.operators.random import Generator

        return Generator(spark(), seed or 0)

    default_rng = Generator = RandomState

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._generator(), name)


_random = _Random()


def __getattr__(name: str):
    if name.startswith("__"):
        raise AttributeError(name)
    if name in DTYPES:
        return DTYPES[name]
    if name == "random":
        return _random
    if name in SUBMODULES:
        return _Submodule(SUBMODULES[name])
    for m in MODULES:
        module = import_module(f"sparkarray.operators.{m}")
        f = vars(module).get(name)
        if f is not None and getattr(f, "__module__", m) in (module.__name__, "numpy") or callable(f) and name in ("broadcast_shapes",):
            return _bound(f)
    if name in {"load", "save", "save_npy", "from_table", "from_rows", "open_saved"}:
        return _bound(getattr(import_module("sparkarray.sources.arrays"), name))
    found = operators.method(name)
    if found is not None:
        return lambda a, *args, **kw: found(_asarray(a), *args, **kw)
    if U.ALIASES.get(name, name) in {**U.UNARY, **U.BINARY, **U.MULTI, **C.UNARY}:
        return ufunc(name)
    if hasattr(SparkArray, name):
        return lambda a, *args, **kw: getattr(a, name)(*args, **kw)
    raise AttributeError(f"no array function named {name}")
