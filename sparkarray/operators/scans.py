"""Scans, differences and neighbourhoods along an axis."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, norm_axis, running
from sparkarray.functions import ufuncs as U


def _line(a: SparkArray, axis: int | None) -> tuple[SparkArray, int, list[str]]:
    if axis is None:
        a, axis = a.ravel(), 0
    k = norm_axis(axis, a.ndim)
    return a, k, [f"i{n}" for n in range(a.ndim) if n != k]


def scan(a: SparkArray, axis: int | None, product: bool = False, skip_nan: bool = False) -> SparkArray:
    """Two phases: within ranges of the axis, then the ranges' totals before each."""
    a, k, by = _line(a, axis)
    if product and not skip_nan and a.dtype in (*U.WHOLE_KINDS, "boolean"):
        return _whole_products(a, k, by)
    v = F.col("v").cast("double") if product or a.dtype in ("double", "float") else F.col("v").cast("long")
    if skip_nan:
        v = F.when(F.isnan(F.col("v").cast("double")), 1.0 if product else 0.0).otherwise(F.col("v").cast("double"))
    df = running(a.df, [f"i{k}"], v, "s", by, product)
    return SparkArray(df.drop("v").withColumnRenamed("s", "v"), a.shape)


#: Cells of a line that go through a kernel together.
RANGE = 1 << 20


def _whole_products(a: SparkArray, k: int, by: list[str]) -> SparkArray:
    """Running products of whole numbers, in 64 bits: of ranges of a line, then of the ranges before each."""
    cells = a.df.select(*a.axes, F.col("v").cast("long").alias("v"), F.expr(f"i{k} div {RANGE}").alias("_p"))
    names = [*a.axes, "v"]

    def within(t: pa.Table) -> pa.Table:
        t = t.sort_by(f"i{k}")
        return t.set_column(t.schema.get_field_index("v"), "v", pa.array(np.cumprod(t["v"].to_numpy().astype("i8")))).select(names)

    def totals(t: pa.Table) -> pa.Table:
        return pa.table({**{b: t[b].slice(0, 1) for b in [*by, "_p"]}, "_t": pa.array([np.prod(t["v"].to_numpy().astype("i8"))], pa.int64())})

    run = cells.groupBy(*by, "_p").applyInArrow(within, ", ".join(f"{n} long" for n in names))
    if a.shape[k] <= RANGE:
        return SparkArray(run, a.shape)

    def before(t: pa.Table) -> pa.Table:  # a row for each range of a line
        t = t.sort_by("_p")
        x = np.cumprod(np.concatenate([[1], t["_t"].to_numpy()[:-1].astype("i8")]))
        return t.set_column(t.schema.get_field_index("_t"), "_t", pa.array(x, pa.int64()))

    keys = ", ".join(f"{n} long" for n in [*by, "_p"])
    parts = cells.groupBy(*by, "_p").applyInArrow(totals, f"{keys}, _t long")
    parts = (parts.groupBy(*by) if by else parts.groupBy(F.lit(0).alias("_one"))).applyInArrow((lambda t: before(t)) if by else (lambda t: before(t.select(["_p", "_t"]))), f"{keys}, _t long")
    out = run.withColumn("_p", F.expr(f"i{k} div {RANGE}")).join(parts, [*by, "_p"])
    return SparkArray(out.withColumn("v", F.col("v") * F.col("_t")), a.shape)


def cumsum(a, axis=None):
    return scan(a, axis)


def cumprod(a, axis=None):
    return scan(a, axis, product=True)


def nancumsum(a, axis=None):
    return scan(a, axis, skip_nan=True)


def nancumprod(a, axis=None):
    return scan(a, axis, product=True, skip_nan=True)


def shifted(a: SparkArray, k: int, by: int, name: str):
    """The cell ``by`` places behind each on axis k, as a column; a join on coordinates."""
    return a.df.select(*[(F.col(f"i{n}") + by if n == k else F.col(f"i{n}")).alias(f"i{n}") for n in range(a.ndim)], F.col("v").alias(name))


def diff(a, n=1, axis=-1):
    for _ in range(n):
        k = norm_axis(axis, a.ndim)
        before = shifted(a, k, 1, "p")
        value = (F.col("v") != F.col("p")) if a.dtype == "boolean" else F.col("v") - F.col("p")
        df = a.df.join(before, a.axes).withColumn("v", value).withColumn(f"i{k}", F.col(f"i{k}") - 1)
        a = SparkArray(df, [max(s - 1, 0) if m == k else s for m, s in enumerate(a.shape)])
    return a


def gradient(a, spacing: float = 1.0, axis: int | None = None, edge_order: int = 1):
    """Central differences inside, one-sided at the edges; a list over the axes if none is named."""
    if axis is None and a.ndim > 1:
        return [gradient(a, spacing, k, edge_order) for k in range(a.ndim)]
    k = norm_axis(axis or 0, a.ndim)
    n, i = a.shape[k], F.col(f"i{k}")
    df = a.df
    for by in (1, -1, 2, -2):
        df = df.join(shifted(a, k, by, f"n{by}"), a.axes, "left") if abs(by) == 1 or edge_order == 2 else df
    v = lambda by: F.col(f"`n{by}`")
    if edge_order == 1:
        lo, hi = (v(-1) - F.col("v")) / spacing, (F.col("v") - v(1)) / spacing
    else:
        lo = (-1.5 * F.col("v") + 2.0 * v(-1) - 0.5 * v(-2)) / spacing
        hi = (1.5 * F.col("v") - 2.0 * v(1) + 0.5 * v(2)) / spacing
    out = F.when(i == 0, lo).when(i == n - 1, hi).otherwise((v(-1) - v(1)) / (2.0 * spacing))
    return SparkArray(df.withColumn("v", out), a.shape)


def cross(a, b):
    """Products of three-vectors on the last axis."""
    k = a.ndim - 1
    rest = [f"i{n}" for n in range(k)]
    wide = lambda x, p: x.df.groupBy(*rest).agg(*[F.max(F.when(F.col(f"i{k}") == c, F.col("v"))).alias(f"{p}{c}") for c in range(3)])
    both = wide(a, "a").join(wide(b, "b"), rest) if rest else wide(a, "a").crossJoin(wide(b, "b"))
    c = lambda x: F.col(x)
    parts = [c("a1") * c("b2") - c("a2") * c("b1"), c("a2") * c("b0") - c("a0") * c("b2"), c("a0") * c("b1") - c("a1") * c("b0")]
    return SparkArray(both.select(*rest, F.posexplode(F.array(*parts)).alias("p", "v")).withColumn(f"i{k}", F.col("p").cast("long")), a.shape)


def moving(a, width: int, axis: int = -1, how: str = "mean"):
    """A centred window of odd width, cut off at the edges: mean, sum, min or max.

    Lines are dealt by ranges; cells within half a width of a border are in both, so no window holds a long line.
    """
    a, k, by = _line(a, axis)
    half = width // 2
    block = max(1 << 16, 4 * half)
    i = F.col(f"i{k}")
    near = F.sequence(F.greatest(F.floor((i - half) / block), F.lit(0)), F.least(F.floor((i + half) / block), F.lit((a.shape[k] - 1) // block)))
    dealt = a.df.withColumn("_b", F.explode(near)) if a.shape[k] > block else a.df.withColumn("_b", F.lit(0).cast("long"))
    window = W.partitionBy(*by, "_b").orderBy(f"i{k}").rowsBetween(-half, half)
    out = dealt.withColumn("v", getattr(F, {"mean": "avg"}.get(how, how))("v").over(window)).filter(F.floor(i / block) == F.col("_b"))
    return SparkArray(out, a.shape)


def convolve(a, kernel, mode: str = "same"):
    """Discrete convolution: every offset of a small kernel is a shifted copy, summed by cell.

    A kernel that is an array of this engine, or has more than ``TAPS`` cells, meets the cells in a join with its rows.
    """
    if isinstance(kernel, SparkArray) or np.size(kernel) > TAPS:
        return _convolve_rows(a, kernel if isinstance(kernel, SparkArray) else SparkArray.from_numpy(a.spark, np.asarray(kernel, "f8")), mode)
    w = np.asarray(kernel, "f8")
    offsets = [(idx, float(w[idx])) for idx in itertools.product(*[range(s) for s in w.shape])]
    centre = [(s - 1) // 2 if mode == "same" else 0 for s in w.shape]
    taps = F.array(*[F.struct(*[F.lit(int(o - c)).cast("long").alias(f"d{n}") for n, (o, c) in enumerate(zip(idx, centre))], F.lit(x).alias("w")) for idx, x in offsets])
    df = a.df.withColumn("t", F.explode(taps)).select(*[(F.col(f"i{n}") + F.col(f"t.d{n}")).alias(f"i{n}") for n in range(a.ndim)], (F.col("v") * F.col("t.w")).alias("v"))
    return _cropped(df, a, w.shape, mode)


def _cropped(df, a: SparkArray, width, mode: str) -> SparkArray:
    lo = [0 if mode != "valid" else s - 1 for s in width]
    shape = [n if mode == "same" else n + s - 1 if mode == "full" else n - s + 1 for n, s in zip(a.shape, width)]
    for n, (s, l) in enumerate(zip(shape, lo)):
        df = df.filter((F.col(f"i{n}") >= l) & (F.col(f"i{n}") < l + s)).withColumn(f"i{n}", F.col(f"i{n}") - l)
    return SparkArray(df.groupBy(*[f"i{n}" for n in range(a.ndim)]).agg(F.sum("v").alias("v")), shape)


#: A kernel of more cells is no literal of the plan.
TAPS = 4096
#: Cells of a line that meet a long kernel in one task, with the kernel's part beside them.
PIECE = 1 << 16


def _convolve_rows(a: SparkArray, kernel: SparkArray, mode: str) -> SparkArray:
    """A long kernel: pieces of the line and of the kernel meet by pairs of pieces; each pair is one transform-free product."""
    if a.ndim != 1 or kernel.ndim != 1:
        w = kernel.df.select(*[F.col(f"i{n}").alias(f"d{n}") for n in range(kernel.ndim)], F.col("v").cast("double").alias("w"))
        centre = [(s - 1) // 2 if mode == "same" else 0 for s in kernel.shape]
        both = a.df.crossJoin(F.broadcast(w) if kernel.size <= 1_000_000 else w)
        df = both.select(*[(F.col(f"i{n}") + F.col(f"d{n}") - centre[n]).alias(f"i{n}") for n in range(a.ndim)], (F.col("v") * F.col("w")).alias("v"))
        return _cropped(df, a, kernel.shape, mode)
    pieces = lambda x, p, name: x.df.select(F.expr(f"i0 div {PIECE}").alias(p), F.struct((F.col("i0") % PIECE).cast("int").alias("k"), F.col("v").cast("double").alias("v")).alias("x")).groupBy(p).agg(F.collect_list("x").alias(name))
    centre = (kernel.shape[0] - 1) // 2 if mode == "same" else 0

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                sides = []
                for c in (1, 3):
                    cells = b.column(c)[r].values
                    x = np.zeros(PIECE)
                    x[cells.field(0).to_numpy()] = cells.field(1).to_numpy()
                    sides.append(x)
                n = 2 * PIECE
                y = np.fft.irfft(np.fft.rfft(sides[0], n) * np.fft.rfft(sides[1], n), n)
                start = (b.column(0)[r].as_py() + b.column(2)[r].as_py()) * PIECE - centre
                yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(n)), pa.array(y)], ["i0", "v"])

    # Pieces of the line times pieces of the kernel: the product that a convolution is, by blocks.
    pairs = pieces(a, "p", "x").crossJoin(pieces(kernel, "q", "y")).select("p", "x", "q", "y")
    return _cropped(pairs.mapInArrow(run, "i0 long, v double"), a, kernel.shape, mode)


def roots(p):
    """Of a polynomial with given coefficients, highest first (a small driver-side problem)."""
    return np.roots(np.asarray(p, "f8"))


METHODS = {f.__name__: f for f in (cumsum, cumprod, nancumsum, nancumprod, diff, gradient, cross, moving, convolve)}
