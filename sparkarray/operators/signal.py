"""Fourier transforms along an axis, filters with boundary rules, tapers."""

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, norm_axis
from sparkarray.operators.shaping import roll

LINE_CELLS = 16_000_000


def transform(a: SparkArray, kind: str, n: int | None = None, axis: int = -1, norm: str | None = None) -> SparkArray:
    """numpy.fft on lines of at most ``LINE_CELLS`` cells. Values are (re, im).

    A line is gathered by one aggregate on the other axes; a batch of lines is then one matrix and one call.
    """
    k = norm_axis(axis, a.ndim)
    size = a.shape[k]
    if size > LINE_CELLS:
        raise ValueError("line too long for one kernel")
    rest = [f"i{m}" for m in range(a.ndim) if m != k]
    complex_in = a.dtype.startswith("struct")
    parts = [F.col("v.re").cast("double").alias("re"), F.col("v.im").cast("double").alias("im")] if complex_in else [F.col("v").cast("double").alias("re")]
    real_out = kind in ("irfft", "hfft")
    m = n if n is not None else {"irfft": 2 * (size - 1), "hfft": 2 * (size - 1)}.get(kind, size)
    length = m // 2 + 1 if kind in ("rfft", "ihfft") else m
    lines = a.df.select(*rest, F.struct(F.col(f"i{k}").cast("int").alias("k"), *parts).alias("x")).groupBy(*rest).agg(F.collect_list("x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, 2_000_000 // max(size, length, 1))
        for b in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
            cells = b.column(len(rest)).flatten()
            x = np.zeros((b.num_rows, size), complex if complex_in else float)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(len(rest)).offsets.to_numpy()))
            at = cells.field(0).to_numpy()
            x[row, at] = cells.field(1).to_numpy() + (1j * cells.field(2).to_numpy() if complex_in else 0)
            y = getattr(np.fft, kind)(x.real if kind in ("rfft", "ihfft") else x, n, axis=1, norm=norm)
            ends = pa.array(np.arange(b.num_rows + 1) * length, pa.int32())
            out = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(p).reshape(-1), pa.float64())) for p in ((y,) if real_out else (y.real, y.imag))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *out], [*rest, "re", "im"][: len(rest) + len(out)])

    got = lines.mapInArrow(run, ", ".join([*(f"{r} long" for r in rest), "re array<double>", *([] if real_out else ["im array<double>"])]))
    got = got.select(*rest, F.posexplode("re" if real_out else F.arrays_zip("re", "im")).alias("p", "v"))
    return SparkArray(got.select(*rest, F.col("p").cast("long").alias(f"i{k}"), "v"), [length if j == k else s for j, s in enumerate(a.shape)])


def _one(kind):
    def run(a, n=None, axis=-1, norm=None):
        return transform(a, kind, n, axis, norm)

    return run


fft, ifft, rfft, irfft, hfft, ihfft = (_one(k) for k in ("fft", "ifft", "rfft", "irfft", "hfft", "ihfft"))


#: Cells of a plane or block that one kernel transforms along several axes.
PLANE_CELLS = 4_000_000


def _block_transform(a: SparkArray, kind: str, s: list, axes: list[int], norm: str | None) -> SparkArray:
    """Several axes at once: the cells of each block are gathered by one aggregate on the other axes."""
    axes = [norm_axis(k, a.ndim) for k in axes]
    rest = [f"i{m}" for m in range(a.ndim) if m not in axes]
    sizes = [a.shape[k] for k in axes]
    wide = math.prod(sizes)
    complex_in, real_out = a.is_complex, kind == "irfftn"
    want = [n if n is not None else z for n, z in zip(s, sizes)]
    if kind == "irfftn" and s[-1] is None:
        want[-1] = 2 * (sizes[-1] - 1)
    lengths = [*want[:-1], want[-1] // 2 + 1] if kind == "rfftn" else want
    out_cells = math.prod(lengths)
    at = F.lit(0).cast("int")
    for k, z in zip(axes, sizes):
        at = at * z + F.col(f"i{k}").cast("int")
    parts = [F.col("v.re").cast("double").alias("re"), F.col("v.im").cast("double").alias("im")] if complex_in else [F.col("v").cast("double").alias("re")]
    cells = a.df.select(*rest, F.struct(at.alias("k"), *parts).alias("x"))
    lines = (cells.groupBy(*rest) if rest else cells.groupBy(F.lit(0).alias("_one"))).agg(F.collect_list("x").alias("x")).select(*rest, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, 2_000_000 // max(wide, out_cells, 1))
        for b in (b.slice(q, most) for b in batches for q in range(0, b.num_rows, most)):
            cells = b.column(len(rest)).flatten()
            x = np.zeros((b.num_rows, wide), complex if complex_in else float)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(len(rest)).offsets.to_numpy()))
            x[row, cells.field(0).to_numpy()] = cells.field(1).to_numpy() + (1j * cells.field(2).to_numpy() if complex_in else 0)
            x = x.reshape(-1, *sizes)
            y = getattr(np.fft, kind)(x.real if kind == "rfftn" else x, want, axes=range(1, 1 + len(axes)), norm=norm)
            ends = pa.array(np.arange(b.num_rows + 1) * out_cells, pa.int32())
            out = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(p).reshape(-1), pa.float64())) for p in ((y,) if real_out else (y.real, y.imag))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *out], [*rest, "re", "im"][: len(rest) + len(out)])

    got = lines.mapInArrow(run, ", ".join([*(f"{r} long" for r in rest), "re array<double>", *([] if real_out else ["im array<double>"])]))
    got = got.select(*rest, F.posexplode("re" if real_out else F.arrays_zip("re", "im")).alias("p", "v"))
    cols, step = {}, 1
    for k, z in list(zip(axes, lengths))[::-1]:
        cols[k] = (F.expr(f"p div {step}") % z).cast("long").alias(f"i{k}")
        step *= z
    return SparkArray(got.select(*rest, *cols.values(), "v"), [lengths[axes.index(j)] if j in axes else z for j, z in enumerate(a.shape)])


def _many(first, others, last_first=True):
    def run(a, s=None, axes=None, norm=None):
        axes = list(range(a.ndim)) if axes is None else list(axes)
        s = [None] * len(axes) if s is None else list(s)
        if len(axes) > 1 and len({norm_axis(k, a.ndim) for k in axes}) == len(axes) and math.prod(max(a.shape[k], n or 0) for k, n in zip(axes, s)) <= PLANE_CELLS:
            return _block_transform(a, first + "n", s, axes, norm)
        pairs = list(zip(axes, s))[::-1]
        if not last_first:
            pairs = pairs[1:][::-1] + pairs[:1]
        for j, (k, n) in enumerate(pairs):
            special = j == 0 if last_first else j == len(pairs) - 1
            a = transform(a, first if special else others, n, k, norm)
        return a

    return run


fftn, ifftn, rfftn = _many("fft", "fft"), _many("ifft", "ifft"), _many("rfft", "fft")
irfftn = _many("irfft", "ifft", last_first=False)


def _two(f):
    return lambda a, s=None, axes=(-2, -1), norm=None: f(a, s, axes, norm)


fft2, ifft2, rfft2, irfft2 = (_two(f) for f in (fftn, ifftn, rfftn, irfftn))


def fftshift(a, axes=None):
    axes = range(a.ndim) if axes is None else [axes] if isinstance(axes, int) else axes
    return roll(a, [a.shape[k] // 2 for k in axes], list(axes))


def ifftshift(a, axes=None):
    axes = range(a.ndim) if axes is None else [axes] if isinstance(axes, int) else axes
    return roll(a, [-(a.shape[k] // 2) for k in axes], list(axes))


def _source(i, n: int, mode: str):
    """The cell that a position outside stands for; null for constant."""
    if mode == "reflect":
        p = F.pmod(i, F.lit(2 * n))
        return F.when(p < n, p).otherwise(2 * n - 1 - p)
    if mode == "mirror":
        p = F.pmod(i, F.lit(max(2 * n - 2, 1)))
        return F.when(p < n, p).otherwise(2 * n - 2 - p)
    if mode == "nearest":
        return F.greatest(F.least(i, F.lit(n - 1)), F.lit(0))
    if mode == "wrap":
        return F.pmod(i, F.lit(n))
    return F.when((i >= 0) & (i < n), i)


def ndimage_convolve(a, weights, mode: str = "reflect", cval: float = 0.0, origin: int = 0):
    """Convolution with boundary rules: each cell asks for its taps' sources, one join on coordinates."""
    w = np.asarray(weights, "f8")
    taps = []
    for idx in itertools.product(*[range(s) for s in w.shape]):
        taps.append(F.struct(*[F.lit(s // 2 - j - origin + 0).cast("long").alias(f"d{k}") for k, (j, s) in enumerate(zip(idx, w.shape))], F.lit(float(w[idx])).alias("w")))
    asks = a.df.drop("v").withColumn("t", F.explode(F.array(*taps)))
    asks = asks.select(*[F.col(c).alias(f"o{k}") for k, c in enumerate(a.axes)], F.col("t.w").alias("w"), *[_source(F.col(c) + F.col(f"t.d{k}"), n, mode).alias(c) for k, (c, n) in enumerate(zip(a.axes, a.shape))])
    got = asks.join(a.df, a.axes, "left").withColumn("x", F.coalesce(F.col("v").cast("double"), F.lit(cval)) * F.col("w"))
    df = got.groupBy(*[f"o{k}" for k in range(a.ndim)]).agg(F.sum("x").alias("v"))
    return SparkArray(df.withColumnsRenamed({f"o{k}": f"i{k}" for k in range(a.ndim)}), a.shape)


def batched_convolve(a, weights, mode="reflect", cval=0.0):
    """The last axes with the weights' rank are filtered, the leading ones are a batch."""
    w = np.asarray(weights, "f8")
    return ndimage_convolve(a, w.reshape((1,) * (a.ndim - w.ndim) + w.shape), mode, cval)


def _fourier(a, factor):

    f = F.lit(1.0)
    for k, n in enumerate(a.shape):
        i = F.col(f"i{k}")
        freq = F.when(i < (n + 1) // 2, i).otherwise(i - n) / n
        f = f * factor(k, freq)
    v = F.struct((F.col("v.re") * f).alias("re"), (F.col("v.im") * f).alias("im")) if a.dtype.startswith("struct") else F.col("v") * f
    return SparkArray(a.df.withColumn("v", v), a.shape)


def fourier_gaussian(a, sigma: float | Sequence[float]):
    s = [sigma] * a.ndim if np.isscalar(sigma) else sigma
    return _fourier(a, lambda k, f: F.exp(-2.0 * (math.pi * s[k]) ** 2 * f * f))


def fourier_uniform(a, size: float | Sequence[float]):
    s = [size] * a.ndim if np.isscalar(size) else size
    return _fourier(a, lambda k, f: F.when(f == 0, 1.0).otherwise(F.sin(math.pi * s[k] * f) / F.when(f == 0, 1.0).otherwise(math.pi * s[k] * f)))


def _taper(spark: SparkSession, m: int, f) -> SparkArray:
    v = F.lit(1.0) if m == 1 else f(F.col("id").cast("double"), float(m - 1))
    return SparkArray(spark.range(m).select(F.col("id").alias("i0"), v.alias("v")), (m,))


def bartlett(spark, m):
    return _taper(spark, m, lambda i, n: F.when(i <= n / 2, 2 * i / n).otherwise(2 - 2 * i / n))


def blackman(spark, m):
    return _taper(spark, m, lambda i, n: 0.42 - 0.5 * F.cos(2 * math.pi * i / n) + 0.08 * F.cos(4 * math.pi * i / n))


def hamming(spark, m):
    return _taper(spark, m, lambda i, n: 0.54 - 0.46 * F.cos(2 * math.pi * i / n))


def hanning(spark, m):
    return _taper(spark, m, lambda i, n: 0.5 - 0.5 * F.cos(2 * math.pi * i / n))


def kaiser(spark, m, beta: float):
    """Bessel I0 by its power series."""
    def i0(x):
        q = x * x / 4
        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * q / (k * k)).alias("t"), (a["s"] + a["t"] * q / (k * k)).alias("s")), lambda a: a["s"])

    return _taper(spark, m, lambda i, n: i0(beta * F.sqrt(F.greatest(1 - ((i - n / 2) / (n / 2)) * ((i - n / 2) / (n / 2)), F.lit(0.0)))) / i0(F.lit(float(beta))))


METHODS = {"fft": fft, "ifft": ifft, "rfft": rfft, "irfft": irfft, "hfft": hfft, "ihfft": ihfft, "fftn": fftn, "ifftn": ifftn, "rfftn": rfftn, "irfftn": irfftn, "fft2": fft2, "ifft2": ifft2, "rfft2": rfft2, "irfft2": irfft2, "fftshift": fftshift, "ifftshift": ifftshift, "ndimage_convolve": ndimage_convolve, "batched_convolve": batched_convolve, "fourier_gaussian": fourier_gaussian, "fourier_uniform": fourier_uniform}
