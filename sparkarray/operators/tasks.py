"""Functions of one's own over blocks of cells, as NumPy arrays in Arrow batches.

``apply`` is a function of aligned arrays (cells of one place come together, smaller shapes are broadcast); ``whole`` arrays
are given to every call as they are, up to ``WHOLE_CELLS`` cells. ``fold`` gives each batch's partial result and adds them
up, or combines them with a function; ``emit`` turns batches into rows of any number.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkarray.array import SparkArray

WHOLE_CELLS = 1_000_000


def _aligned(arrays: Sequence[SparkArray]) -> SparkArray:
    """One array whose cells are structs of the arrays' cells."""
    packed = arrays[0].map(lambda v: F.struct(v.alias("a0")))
    for n, x in enumerate(arrays[1:], 1):
        packed = packed.binary(x, lambda p, v, n=n: F.struct(*[p[f"a{k}"].alias(f"a{k}") for k in range(n)], v.alias(f"a{n}")))
    return packed


def _given(whole: Sequence[SparkArray]) -> list[np.ndarray]:
    for x in whole:
        if x.size > WHOLE_CELLS:
            raise ValueError(f"an array of more than {WHOLE_CELLS} cells can't be given whole; align it instead")
    return [x.to_numpy() for x in whole]


def apply(f: Callable[..., np.ndarray], *arrays: SparkArray, whole: Sequence[SparkArray] = (), dtype: str = "double") -> SparkArray:
    """f(cells of each array in a block, ..., whole arrays) gives as many cells; cells come in no order."""
    packed, given = _aligned(arrays), _given(whole)
    n, names = packed.ndim, [*packed.axes, "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(n).flatten()
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(np.asarray(f(*[c.to_numpy(zero_copy_only=False) for c in cells], *given)))], names)

    got = packed.df.mapInArrow(run, ", ".join([*(f"{a} long" for a in packed.axes), f"v {dtype}"]))
    return SparkArray(got, packed.shape)


def fold(f: Callable[..., np.ndarray], *arrays: SparkArray, whole: Sequence[SparkArray] = (), combine: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Partial results (NumPy arrays of one shape, doubles) of all blocks, added up or combined.

    Sums are aggregates; a function combines within tasks first, then on the driver a result for each task.
    """
    packed, given = _aligned(arrays), _given(whole)
    n = packed.ndim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(f(*[c.to_numpy(zero_copy_only=False) for c in b.column(n).flatten()], *given), "f8")
                total = x if total is None else combine(total, x) if combine else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([list(total.shape)], pa.list_(pa.int64())), pa.array([total.reshape(-1)], pa.list_(pa.float64()))], ["shape", "x"])

    parts = packed.df.mapInArrow(run, "shape array<long>, x array<double>")
    if combine is None:
        rows = parts.select("shape", F.posexplode("x").alias("p", "v")).groupBy("shape", "p").agg(F.sum("v").alias("v")).collect()
        if not rows:
            return np.zeros(())
        out = np.zeros(int(np.prod(rows[0]["shape"])))
        for r in rows:
            out[r["p"]] = r["v"]
        return out.reshape(rows[0]["shape"])
    total = None
    for r in parts.toLocalIterator():
        x = np.array(r["x"]).reshape(r["shape"])
        total = x if total is None else combine(total, x)
    return np.zeros(()) if total is None else total


def emit(f: Callable[..., dict[str, np.ndarray]], *arrays: SparkArray, schema: str, whole: Sequence[SparkArray] = ()) -> DataFrame:
    """f(coordinates as a tuple, cells of each array, ..., whole arrays) gives columns of rows, as many as it likes."""
    packed, given = _aligned(arrays), _given(whole)
    n = packed.ndim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f(tuple(c.to_numpy() for c in b.columns[:n]), *[c.to_numpy(zero_copy_only=False) for c in b.column(n).flatten()], *given)
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    return packed.df.mapInArrow(run, schema)


METHODS = {"apply": lambda a, f, *others, **k: apply(f, a, *others, **k)}
