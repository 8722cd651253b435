"""Products and contractions: a join on the shared modes, an aggregate over the summed ones.

Where a join of cells would have ``TILE_WORK`` rows or more, both sides are packed into tiles by an aggregate each and the
join is of tiles, whose product is one kernel call: whatever the types and the number of modes.
"""

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkarray.array import BROADCAST_CELLS, SparkArray, norm_axis
from sparkarray.functions import complexes as C


def einsum(expr: str, *operands: SparkArray, optimize: bool | str | list = True) -> SparkArray:
    """Any number of operands; a mode that only one operand has and the output lacks is summed before the join."""
    expr = expr.replace(" ", "")
    left, arrow, out = expr.partition("->")
    terms = left.split(",")
    if not arrow:
        letters = re.findall("[A-Za-z]", left)
        out = "".join(sorted(c for c in set(letters) if letters.count(c) == 1))
    extent: dict[str, int] = {}
    for t, a in zip(terms, operands):
        for c, s in zip(t, a.shape):
            extent[c] = s if extent.get(c, 1) == 1 else extent[c]
    order = einsum_path(expr, *operands)[0] if len(operands) > 2 and optimize else [tuple(range(2))] * (len(operands) - 1)
    work = [_single(t, a, set(out) | {c for k, u in enumerate(terms) if k != n for c in u}) for n, (t, a) in enumerate(zip(terms, operands))]
    for i, j in order:
        i, j = sorted((i, j))
        q, p = work.pop(j), work.pop(i)
        keep = set(out) | {c for modes, _, _ in work for c in modes}
        work.append(_pair(p, q, keep, extent))
    modes, df, _ = work[0]
    gone = [c for c in modes if c not in out]
    if gone:
        df = df.groupBy(*[f"m_{c}" for c in out]).agg(_added(df))
    return SparkArray(df.select(*[F.col(f"m_{c}").alias(f"i{k}") for k, c in enumerate(out)], "v"), [extent[c] for c in out])


def einsum_path(expr: str, *operands: SparkArray, optimize: str = "greedy"):
    """A greedy order: the pair with the smallest result first."""
    terms = [set(t) for t in expr.replace(" ", "").partition("->")[0].split(",")]
    out = set(expr.partition("->")[2])
    size = {}
    for t, a in zip(expr.replace(" ", "").partition("->")[0].split(","), operands):
        size.update({c: max(size.get(c, 1), s) for c, s in zip(t, a.shape)})
    path = []
    while len(terms) > 1:
        best = None
        for i in range(len(terms)):
            for j in range(i + 1, len(terms)):
                rest = out.union(*[t for k, t in enumerate(terms) if k not in (i, j)])
                cost = 1
                for c in (terms[i] | terms[j]) & rest:
                    cost *= size[c]
                best = min(best or (cost, i, j), (cost, i, j))
        _, i, j = best
        rest = out.union(*[t for k, t in enumerate(terms) if k not in (i, j)])
        joined = (terms[i] | terms[j]) & rest
        terms = [t for k, t in enumerate(terms) if k not in (i, j)] + [joined]
        path.append((i, j))
    return path, expr


def _added(df):
    """The sum of a column ``v`` of real or complex cells."""
    if df.schema["v"].dataType.typeName() == "struct":
        return F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im")).alias("v")
    return F.sum("v").alias("v")


def _times(df):
    """``v`` times ``w``."""
    kinds = [df.schema[c].dataType.typeName() == "struct" for c in "vw"]
    if not any(kinds):
        return F.col("v") * F.col("w")
    return C.cell(C.multiply(*(C.parts(F.col(c), k) for c, k in zip("vw", kinds))))


def _single(t: str, a: SparkArray, keep: set[str]):
    df = a.df
    names: dict[str, str] = {}
    for k, c in enumerate(t):
        if c in names:
            df = df.filter(F.col(f"i{k}") == F.col(names[c]))
        else:
            names[c] = f"i{k}"
    df = df.select(*[F.col(i).alias(f"m_{c}") for c, i in names.items()], "v")
    modes = list(names)
    own = [c for c in modes if c in keep]
    if len(own) < len(modes):
        df = df.groupBy(*[f"m_{c}" for c in own]).agg(_added(df))
    return own, df, a.size


def _pair(p, q, keep: set[str], extent: dict[str, int]):
    (pm, pd, ps), (qm, qd, qs) = p, q
    shared = [c for c in pm if c in qm]
    if set(shared) - keep and math.prod(extent[c] for c in {*pm, *qm}) >= TILE_WORK:
        return _tiled(pm, pd, qm, qd, keep, extent)
    qd = qd.withColumnRenamed("v", "w")
    if qs <= BROADCAST_CELLS:
        qd = F.broadcast(qd)
    elif ps <= BROADCAST_CELLS:
        pd = F.broadcast(pd)
    df = pd.join(qd, [f"m_{c}" for c in shared]) if shared else pd.crossJoin(qd)
    modes = pm + [c for c in qm if c not in pm]
    own = [c for c in modes if c in keep]
    df = df.withColumn("v", _times(df)).drop("w")
    if len(own) < len(modes):
        df = df.groupBy(*[f"m_{c}" for c in own]).agg(_added(df))
    return own, df, max(ps, qs)


#: Cells of a tile's side at most, and of a tile.
SIDE, TILE = 512, 512 * 512
#: A patch is the part of a product that one task makes at a time: its cells at least and at most, the patches that a product
#: of many cells has at least, cells of the first matrix that are held for one. Tasks at most.
LEAST_PATCH, PATCH, PATCHES, PANEL, MOST_TASKS = 2**18, 2**24, 64, 2**23, 10_000


def _patches(n: int, ni: int, nk: int, nj: int, side: int) -> tuple[int, int, int, int, int]:
    """Of n products: the sides of the tiles (rows, summed, columns) and a patch's tiles down and across."""
    bi, bj = max(1, min(side, ni)), max(1, min(side, nj))
    bk = max(1, min(nk, max(side, TILE // max(bi, bj))))
    cells = min(PATCH, max(LEAST_PATCH, n * math.ceil(nk / bk) * ni * nj // PATCHES))
    rows = min(ni, max(math.isqrt(cells), cells // max(1, nj)), PANEL // bk)
    down = max(1, rows // bi)
    return bi, bk, bj, down, max(1, cells // (down * bi * bj))


def _tiled(pm: list[str], pd, qm: list[str], qd, keep: set[str], extent: dict[str, int], side: int = SIDE):
    """Modes that both have and the output keeps are a batch. The product is made by patches: a tile goes to each patch that it
    has a part in, so the work is dealt over many tasks even where the summed modes are one block.
    """
    batch, gone = [c for c in pm if c in qm and c in keep], [c for c in pm if c in qm and c not in keep]
    left, right = [c for c in pm if c not in qm], [c for c in qm if c not in pm]
    size = lambda modes: math.prod(extent[c] for c in modes)
    ni, nk, nj = size(left), size(gone), size(right)
    bi, bk, bj, mi, mj = _patches(size(batch), ni, nk, nj, side)
    kinds = [d.schema["v"].dataType.typeName() for d in (pd, qd)]
    kind = "complex" if "struct" in kinds else "i8" if all(k in ("long", "integer", "short", "byte") for k in kinds) else "f8"
    blocks, down, across = (max(1, math.ceil(n / k)) for n, k in ((nk, bk), (ni, bi * mi), (nj, bj * mj)))

    def flat(modes: list[str]):
        out = F.lit(0).cast("long")
        for c in modes:
            out = out * extent[c] + F.col(f"m_{c}")
        return out

    def pack(shape: tuple[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                data = []
                for x in rows.column(3):
                    d, cells = np.zeros(shape[0] * shape[1], kind), x.values
                    v = cells.field(1).to_numpy()
                    d[cells.field(0).to_numpy()] = v + 1j * cells.field(2).to_numpy() if cells.type.num_fields == 3 else v
                    data.append(d.tobytes())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(3)), pa.array(data, pa.binary())], ["b", "tk", "t", "data"])

        return run

    def tiles(df, rows, r, row_name, cols, c, col_name):
        value = [F.col("v.re").alias("re"), F.col("v.im").alias("im")] if df.schema["v"].dataType.typeName() == "struct" else [F.col("v").cast("long" if kind == "i8" else "double").alias("re")]
        cells = df.select(flat(batch).alias("b"), flat(rows).alias("r"), flat(cols).alias("c"), *value)
        at = ((F.col("r") % r) * c + F.col("c") % c).cast("int").alias("at")
        x = F.struct(at, *(["re", "im"] if len(value) == 2 else ["re"])).alias("x")
        grouped = cells.select("b", F.expr(f"r div {r}").alias(row_name), F.expr(f"c div {c}").alias(col_name), x).groupBy("b", "tk", "t").agg(F.collect_list("x").alias("x"))
        return grouped.mapInArrow(pack((r, c)), "b long, tk long, t long, data binary")

    def dealt(df, second: int, own: int, others: int):
        """Each tile to all patches of its rows or, of the second matrix, of its columns."""
        df = df.select("b", "tk", "t", "data", F.expr(f"t div {own}").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias("o"))
        at = ("o", "m") if second else ("m", "o")
        return df.select((((F.col("b") * blocks + F.col("tk")) * down + F.col(at[0])) * across + F.col(at[1])).alias("g"), F.lit(second).alias("second"), "t", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patch, panel, whole = None, [], None  # whole: the panel as one matrix and its rows' numbers, from its first partner on
        for got in batches:
            for r in range(got.num_rows):
                g, second, t = (got.column(c)[r].as_py() for c in range(3))
                data = np.frombuffer(got.column(3)[r].as_buffer(), kind)
                if g != patch:
                    patch, panel, whole = g, [], None
                if not second:
                    h = min(bi, ni - t * bi)
                    panel.append((t * bi + np.arange(h), data.reshape(bi, bk)[:h].copy()))
                    continue
                if panel:
                    whole, panel = [np.concatenate(z) for z in zip(*panel)], []
                if whole is None:
                    continue
                rows, x = whole
                w = min(bj, nj - t * bj)
                p = x @ data.reshape(bk, bj)[:, :w]
                ends = pa.array(np.arange(len(rows) + 1) * w, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(z).reshape(-1))) for z in ((p.real, p.imag) if kind == "complex" else (p,))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g // (blocks * down * across))), pa.array(rows), pa.array(np.full(len(rows), t * bj)), *lists], ["b", "i", "j", "re", "im"][: 3 + len(lists)])

    both = dealt(tiles(pd, left, bi, "t", gone, bk, "tk"), 0, mi, across).union(dealt(tiles(qd, gone, bk, "tk", right, bj, "t"), 1, mj, down))
    both = both.repartition(max(1, min(MOST_TASKS, size(batch) * blocks * down * across)), "g").sortWithinPartitions("g", "second", "t")
    element = "long" if kind == "i8" else "double"
    parts = both.mapInArrow(run, f"b long, i long, j long, re array<{element}>" + f", im array<{element}>" * (kind == "complex"))
    cells = parts.select("b", "i", "j", F.posexplode(F.arrays_zip("re", "im") if kind == "complex" else "re").alias("p", "v"))
    cells = cells.select("b", "i", (F.col("j") + F.col("p")).alias("j"), "v")
    if nk > bk:
        cells = cells.groupBy("b", "i", "j").agg(_added(cells))

    def apart(column: str, modes: list[str]):
        out, step = [], 1
        for n, c in reversed(list(enumerate(modes))):
            at = F.expr(f"{column} div {step}") if step > 1 else F.col(column)
            out.append((at % extent[c] if n else at).cast("long").alias(f"m_{c}"))
            step *= extent[c]
        return out

    return [*batch, *left, *right], cells.select(*apart("b", batch), *apart("i", left), *apart("j", right), "v"), size(batch) * ni * nj


def tensordot(a, b, axes=2):
    if isinstance(axes, int):
        pa, pb = list(range(a.ndim - axes, a.ndim)), list(range(axes))
    else:
        pa, pb = ([x] if isinstance(x, int) else list(x) for x in axes)
    pa, pb = [norm_axis(x, a.ndim) for x in pa], [norm_axis(x, b.ndim) for x in pb]
    la = "abcdefghijklm"[: a.ndim]
    lb = list("nopqrstuvwxyz"[: b.ndim])
    for x, y in zip(pa, pb):
        lb[y] = la[x]
    out = "".join(c for k, c in enumerate(la) if k not in pa) + "".join(c for k, c in enumerate(lb) if k not in pb)
    return einsum(f"{la},{''.join(lb)}->{out}", a, b)


def dot(a, b):
    if not isinstance(b, SparkArray) or a.ndim == 0 or b.ndim == 0:
        return a.ufunc("multiply", b)
    if a.ndim == b.ndim == 1:
        if a.shape != b.shape:
            raise ValueError("shapes are not aligned")
        # Vectors of one origin need no join.
        from sparkarray.operators.reductions import sum as total

        return total(a.ufunc("multiply", b))
    return tensordot(a, b, ([a.ndim - 1], [max(b.ndim - 2, 0)]))


def inner(a, b):
    return dot(a, b) if a.ndim == b.ndim == 1 else tensordot(a, b, ([a.ndim - 1], [b.ndim - 1]))


def vdot(a, b):
    return dot(a.ufunc("conjugate").ravel() if a.is_complex else a.ravel(), b.ravel())


def outer(a, b):
    return einsum("a,b->ab", a.ravel(), b.ravel())


#: Contractions with so many multiplications go by tiles: a join of cells would have as many rows.
TILE_WORK = 50_000_000


def matmul(a, b):
    if a.ndim <= 2 and b.ndim <= 2:
        return dot(a, b)
    batch = "abcdefgh"
    n = max(a.ndim, b.ndim) - 2
    la, lb = batch[n - (a.ndim - 2) : n] + "xy", batch[n - (b.ndim - 2) : n] + "yz"
    return einsum(f"{la},{lb}->{batch[:n]}xz", a, b)


def trace(a, offset=0):
    return SparkArray(a.df.filter(F.col("i1") - F.col("i0") == offset).groupBy(*[f"i{k}" for k in range(2, a.ndim)]).agg(F.sum("v").alias("v")).select(*[F.col(f"i{k}").alias(f"i{k - 2}") for k in range(2, a.ndim)], "v"), a.shape[2:])


def multi_dot(arrays: Sequence[SparkArray]):
    """Matrices in a row; the order of products comes from the contraction planner."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms, at = [], 0
    for a in arrays:
        terms.append(letters[at : at + a.ndim])
        at += a.ndim - 1
    first, last = terms[0][:-1], terms[-1][1:]
    return einsum(",".join(terms) + "->" + first + last, *arrays)


def matrix_power(a, n: int):
    from sparkarray.operators.creation import identity
    from sparkarray.operators.linalg import inv

    if n == 0:
        return identity(a.spark, a.shape[0])
    if n < 0:
        return matrix_power(inv(a), -n)
    out = None
    while n:
        if n & 1:
            out = a if out is None else matmul(out, a)
        n >>= 1
        a = matmul(a, a) if n else a
    return out


METHODS = {f.__name__: f for f in (tensordot, dot, inner, vdot, outer, matmul, trace, matrix_power)}
