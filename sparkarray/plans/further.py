"""More queries: operators that the first list leaves out, each with the SQL that says the same."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sparkarray import namespace
from sparkarray.array import SparkArray
from sparkarray.functions import complexes as C
from sparkarray.operators import creation, hist, indexing, linalg, misc, ordering, products, random, reductions, scans, shaping, signal
from sparkarray.plans.catalogue import CELLS, ORACLE, PRICES, QUERIES, _sel, _shape, nations, out, prices, query, read, vectors


# --- whole numbers and wide doubles ---
_K = "9007199254740992 + o_orderkey"


@query("whole_numbers", f"""SELECT o_orderkey AS i, ({_K}) % 7 AS mod_, CAST(floor((o_orderkey - 900.0) / 7) AS BIGINT) AS floor_, ({_K}) = ({_K} + 1) AS equal_, greatest({_K}, 9007199254740993 + 3000) AS most,
    ({_K}) < 9007199254740993 + 3000 AS less_, CAST(o_custkey AS BIGINT) * o_custkey * o_custkey AS cube, CAST(sign(o_custkey - 500) AS BIGINT) AS sign_ FROM orders""")
def whole_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i0"), F.col("o_orderkey").cast("long").alias("v"), F.col("o_custkey").cast("long").alias("c"))
    a, c = SparkArray(rows, (1,)), SparkArray(rows.select("i0", F.col("c").alias("v")), (1,))
    k = a + 2**53
    parts = {"mod_": k % 7, "floor_": (a - 900) // 7, "equal_": k.ufunc("equal", k + 1), "most": k.ufunc("maximum", 2**53 + 3001), "less_": k < 2**53 + 3001, "cube": c**3, "sign_": (c - 500).ufunc("sign")}
    df = None
    for n, x in parts.items():
        one = x.df.select(F.col("i0").alias("i"), F.col("v").alias(n))
        df = one if df is None else df.join(one, "i")
    return df


@query("wide_doubles", "SELECT o_orderkey AS i, floor(o_totalprice * 1e20) AS floor_, ceil(o_totalprice * -1e20) AS ceil_, trunc(o_totalprice * 1e15) AS trunc_ FROM orders")
def wide_doubles(spark, sf_dir):
    from sparkarray.functions import ufuncs as U

    v = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), U.floor(v * 1e20).alias("floor_"), U.ceil(v * -1e20).alias("ceil_"), U.trunc(v * 1e15).alias("trunc_"))


@query("cumprod_whole", "SELECT n_nationkey::BIGINT AS i, CAST(1 << CAST(n_nationkey + 1 AS INTEGER) AS BIGINT) AS value FROM nation")
def cumprod_whole(spark, sf_dir):
    return out(scans.cumprod(SparkArray(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i0"), F.lit(2).cast("long").alias("v")), (25,))), "i")


@query("isin_nan", "SELECT o_orderkey AS i, o_custkey % 3 <> 0 AND o_custkey % 2 <> 0 AS value FROM orders")
def isin_nan(spark, sf_dir):
    """NaN (for every third customer) is not outside either."""
    v = F.when(F.col("o_custkey") % 3 == 0, float("nan")).otherwise((F.col("o_custkey") % 2).cast("double"))
    a = SparkArray(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i0"), v.alias("v")), (1,))
    return out(ordering.isin(a, SparkArray.from_numpy(spark, [0.0, float("nan")]), True), "i")


@query("ufunc_where_out", f"WITH {PRICES} SELECT i, CASE WHEN v > 150000 THEN round(v * 2, 6) ELSE 1.0::DOUBLE END AS value FROM p")
def ufunc_where_out(spark, sf_dir):
    a = prices(spark, sf_dir)
    to = a.map(lambda v: F.lit(1.0))
    namespace.multiply(a, 2.0, out=to, where=a > 150000.0)
    return out(to, "i", digits=6)


for _f, _sql in (("add", "round(sum(v), 6)"), ("maximum", "round(max(v), 6)"), ("minimum", "round(min(v), 6)"), ("logical_and", "bool_and(v <> 0)"), ("logical_or", "bool_or(v <> 0)")):
    query(f"reduce_{_f}", f"WITH {CELLS} SELECT i, {_sql} AS value FROM e GROUP BY i")(lambda spark, sf_dir, f=_f: out(getattr(namespace, f).reduce(vectors(spark, sf_dir), 1), "i", digits=None if f.startswith("logical") else 6))
query("accumulate_add", f"WITH {CELLS} SELECT i, j, round(sum(v) OVER (PARTITION BY i ORDER BY j), 6) AS value FROM e")(lambda spark, sf_dir: out(namespace.add.accumulate(vectors(spark, sf_dir), 1), "i", "j", digits=6))
query("same_origin", f"WITH {CELLS} SELECT i, j, round(v * v + v - 2 * j, 9) AS value FROM e")(lambda spark, sf_dir: (lambda a: out(a * a + a - creation.arange(spark, a.shape[1]) * 2.0, "i", "j", digits=9))(vectors(spark, sf_dir)))

# --- shapes and creation over the 5 by 5 matrix of nations ---
_two = "m, range(0, 2) t(k)"
_shape("vstack", lambda a: shaping.vstack([a, a]), f"{_sel('i + 5 * k', 'j')} FROM {_two}")
_shape("dstack", lambda a: shaping.dstack([a, a + 1]).reshape(25, 2), f"{_sel('i * 5 + j', 'k', 'v + k')} FROM {_two}")
_shape("column_stack", lambda a: shaping.column_stack([a[:, 3], a[:, 1]]), f"{_sel('i', 'CASE WHEN j = 3 THEN 0 ELSE 1 END')} FROM m WHERE j IN (1, 3)")
_shape("append", lambda a: shaping.append(a, a[0:1], 0), f"{_sel('i', 'j')} FROM m UNION ALL {_sel('5', 'j')} FROM m WHERE i = 0")
_shape("block", lambda a: shaping.block([[a, a], [a, a]]), f"{_sel('i + 5 * p', 'j + 5 * q')} FROM m, range(0, 2) s(p), range(0, 2) u(q)")
_shape("vsplit", lambda a: shaping.vsplit(a, 5)[2], f"{_sel('0', 'j')} FROM m WHERE i = 2")
_shape("hsplit", lambda a: shaping.hsplit(a, 5)[1], f"{_sel('i', '0')} FROM m WHERE j = 1")
_shape("dsplit", lambda a: shaping.dsplit(a.reshape(5, 1, 5), 5)[3].reshape(5, 1), f"{_sel('i', '0')} FROM m WHERE j = 3")
_shape("split_even", lambda a: shaping.split(a, 5, 0)[4], f"{_sel('0', 'j')} FROM m WHERE i = 4")
_shape("flipud", shaping.flipud, f"{_sel('4 - i', 'j')} FROM m")
_shape("fliplr", shaping.fliplr, f"{_sel('i', '4 - j')} FROM m")
_shape("moveaxis", lambda a: shaping.moveaxis(a.reshape(5, 5, 1), 0, 2).reshape(5, 5), f"{_sel('j', 'i')} FROM m")
_shape("matrix_transpose", shaping.matrix_transpose, f"{_sel('j', 'i')} FROM m")
_shape("expand_squeeze", lambda a: shaping.squeeze(shaping.expand_dims(a, 1)), f"{_sel('i', 'j')} FROM m")
_shape("atleast", lambda a: shaping.atleast_2d(shaping.atleast_1d(shaping.atleast_3d(a)[:, 2, 0])), f"{_sel('0', 'i')} FROM m WHERE j = 2")
_shape("broadcast_arrays", lambda a: misc.broadcast_arrays(a, a[1])[1], f"{_sel('a.i', 'a.j', 'b.v')} FROM m a JOIN m b ON b.i = 1 AND b.j = a.j")
_shape("broadcast_iters", lambda a: misc.broadcast(a, a[1]).iters[1].reshape(5, 5), f"{_sel('a.i', 'a.j', 'b.v')} FROM m a JOIN m b ON b.i = 1 AND b.j = a.j")
_shape("copyto", lambda a: indexing.copyto(a, 7, a > 2), f"{_sel('i', 'j', 'CASE WHEN v > 2 THEN 7 ELSE v END')} FROM m")
_shape("copy", lambda a: namespace.copy(a), f"{_sel('i', 'j')} FROM m")
_shape("ones_like", creation.ones_like, f"{_sel('i', 'j', '1')} FROM m")
_shape("zeros_like", creation.zeros_like, f"{_sel('i', 'j', '0')} FROM m")
_shape("full_like", lambda a: creation.full_like(a, 3), f"{_sel('i', 'j', '3')} FROM m")
_shape("empty", lambda a: creation.empty(a.spark, (5, 5)) + creation.empty_like(a), f"{_sel('i', 'j', '0')} FROM m")
_shape("zeros", lambda a: creation.zeros(a.spark, (5, 5)) + a, f"{_sel('i', 'j')} FROM m")
_shape("identity", lambda a: creation.identity(a.spark, 5), f"{_sel('i', 'j', 'CASE WHEN i = j THEN 1 ELSE 0 END')} FROM m")
_shape("tri", lambda a: creation.tri(a.spark, 5, 5, 1), f"{_sel('i', 'j', 'CASE WHEN j <= i + 1 THEN 1 ELSE 0 END')} FROM m")
_shape("trilu", lambda a: namespace.trilu(a, -1, False), f"{_sel('i', 'j', 'CASE WHEN j >= i - 1 THEN v ELSE 0 END')} FROM m")
_shape("diagflat", lambda a: creation.diagflat(a[2], 1), f"{_sel('p', 'q', 'CASE WHEN q = p + 1 THEN v ELSE 0 END')} FROM range(0, 6) s(p), range(0, 6) u(q) LEFT JOIN m ON i = 2 AND j = p")
ORACLE["diagflat"] = ORACLE["diagflat"].replace("THEN v", "THEN coalesce(v, 0)")
_shape("meshgrid", lambda a: creation.meshgrid(a[0], a[1])[1], f"{_sel('x.j', 'y.j', 'x.v')} FROM m x, m y WHERE x.i = 1 AND y.i = 0")
_pairs = "CASE WHEN k = 0 THEN i ELSE j END"
_shape("mgrid", lambda a: creation.mgrid(a.spark, slice(0, 5), slice(0, 5)).reshape(2, 25), f"{_sel('k', 'i * 5 + j', _pairs)} FROM {_two}")
_shape("indices", lambda a: indexing.indices(a.spark, (5, 5)).reshape(2, 25), f"{_sel('k', 'i * 5 + j', _pairs)} FROM {_two}")
_shape("array", lambda a: creation.array(a.spark, [[1, 2], [3, 4]]), f"{_sel('i', 'j', '1 + 2 * i + j')} FROM m WHERE i < 2 AND j < 2")
_shape("asarray", lambda a: creation.asarray(a.spark, creation.asarray(a.spark, [[1, 2], [3, 4]])), f"{_sel('i', 'j', '1 + 2 * i + j')} FROM m WHERE i < 2 AND j < 2")
_shape("astype", lambda a: (a + 0.75).astype("long"), f"{_sel('i', 'j')} FROM m")
_shape("clip", lambda a: namespace.clip(a, 1, 3), f"{_sel('i', 'j', 'greatest(1, least(v, 3))')} FROM m")
_shape("round", lambda a: namespace.round(a + 0.5), f"{_sel('i', 'j', 'round_even(v + 0.5, 0)')} FROM m")
_shape("nan_to_num", lambda a: namespace.nan_to_num(a.map(lambda v: F.when(v == 2, float("nan")).otherwise(v.cast("double"))), nan=9.0), f"{_sel('i', 'j', 'CASE WHEN v = 2 THEN 9 ELSE v END')} FROM m")


def _places(name: str, f, condition: str) -> None:
    """Index arrays of cells, one row for each axis."""
    sql = f"h AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS r, i, j FROM m WHERE {condition}) SELECT CAST(0 AS BIGINT) AS i, r AS j, CAST(i AS BIGINT) AS value FROM h UNION ALL SELECT 1, r, CAST(j AS BIGINT) FROM h"
    _shape(name, lambda a: shaping.stack(list(f(a)), 0), sql)
    ORACLE[name] = ORACLE[name].replace(f" {sql}", f", {sql}")


_places("tril_indices", lambda a: indexing.tril_indices(a.spark, 5, -1), "j <= i - 1")
_places("triu_indices", lambda a: indexing.triu_indices(a.spark, 5, 1), "j >= i + 1")
_places("diag_indices", lambda a: indexing.diag_indices(a.spark, 5), "i = j")
_places("tril_indices_from", misc.tril_indices_from, "j <= i")
_places("triu_indices_from", misc.triu_indices_from, "j >= i")
_places("diag_indices_from", misc.diag_indices_from, "i = j")
_places("mask_indices", lambda a: indexing.mask_indices(a.spark, 5, creation.triu, 2), "j >= i + 2")


def _given(a: SparkArray, *values) -> list[SparkArray]:
    return [SparkArray.from_numpy(a.spark, np.array(v)) for v in values]


_shape("ix_", lambda a: a[misc.ix_(*_given(a, [0, 3], [4, 1, 2]))], f"{_sel('p', 'q')} FROM (VALUES (0, 0), (1, 3)) s(p, x), (VALUES (0, 4), (1, 1), (2, 2)) u(q, y) JOIN m ON i = x AND j = y")
_shape("index_arrays", lambda a: a.reshape(5, 1, 5)[tuple([_given(a, [[3, 0], [1, 1]])[0], slice(None), _given(a, [2, -1])[0]])].reshape(2, 2), f"{_sel('p', 'q')} FROM (VALUES (0, 0, 3, 2), (0, 1, 0, 4), (1, 0, 1, 2), (1, 1, 1, 4)) s(p, q, x, y) JOIN m ON i = x AND j = y")
_shape("index_array_and_slice", lambda a: a[1:4, _given(a, [4, 0, 0])[0]], f"{_sel('i - 1', 'q')} FROM (VALUES (0, 4), (1, 0), (2, 0)) u(q, y) JOIN m ON i BETWEEN 1 AND 3 AND j = y")
_shape("put_along_axis", lambda a: indexing.put_along_axis(a, reductions.argmax(a, 1, keepdims=True), creation.full(a.spark, (5, 1), -1).astype("long"), 1), f"{_sel('i', 'j', 'CASE WHEN j = (SELECT min(j) FROM m b WHERE b.i = m.i AND b.v = (SELECT max(v) FROM m c WHERE c.i = m.i)) THEN -1 ELSE v END')} FROM m")
_shape("ravel_multi_index", lambda a: indexing.ravel_multi_index([a, a], (6, 7)), f"{_sel('i', 'j', 'v * 8')} FROM m")
_shape("extract", lambda a: indexing.extract(a > 2, a).reshape(-1, 1), f"{_sel('row_number() OVER (ORDER BY i, j) - 1', '0')} FROM m WHERE v > 2")
_shape("in1d", lambda a: namespace.in1d(a, _given(a, [0, 4])[0]).reshape(5, 5), f"{_sel('i', 'j', 'CASE WHEN v IN (0, 4) THEN 1 ELSE 0 END')} FROM m")
_shape("partition", lambda a: ordering.partition(a, 2, 1), f"{_sel('i', 'row_number() OVER (PARTITION BY i ORDER BY v, j) - 1')} FROM m")
_shape("argpartition", lambda a: ordering.argpartition(a, 2, 1), f"{_sel('i', 'row_number() OVER (PARTITION BY i ORDER BY v, j) - 1', 'j')} FROM m")
_shape("sort_complex", lambda a: misc.sort_complex(a.ravel()).ufunc("real").reshape(25, 1), f"{_sel('row_number() OVER (ORDER BY v, i, j) - 1', '0')} FROM m")
_shape("multi_dot", lambda a: products.multi_dot([a, a, a]), "SELECT CAST(a.i AS BIGINT) AS i, CAST(c.j AS BIGINT) AS j, CAST(sum(a.v * b.v * c.v) AS BIGINT) AS value FROM m a JOIN m b ON a.j = b.i JOIN m c ON b.j = c.i GROUP BY 1, 2")
_shape("einsum_path", lambda a: products.einsum("ij,jk,kl->il", a, a, a, optimize=products.einsum_path("ij,jk,kl->il", a, a, a)[0]), ORACLE["multi_dot"].split(" FROM nation) ", 1)[1])


# --- NaN-skipping over the vectors, negative cells being NaN ---
def holes(spark, sf_dir) -> SparkArray:
    return vectors(spark, sf_dir).map(lambda v: F.when(v < 0, float("nan")).otherwise(v))


for _name, _f, _sql in (
    ("nanargmax", lambda a: reductions.nanargmax(a, 1), "arg_max(j, v)"), ("nanargmin", lambda a: reductions.nanargmin(a, 1), "arg_min(j, v)"), ("nanprod", lambda a: reductions.nanprod(a + 1.0, 1), "round(product(v + 1.0), 6)"),
    ("nanmedian", lambda a: ordering.nanmedian(a, 1), "round(median(v), 6)"), ("nanquantile", lambda a: ordering.nanquantile(a, 0.3, 1), "round(quantile_cont(v, 0.3), 6)"), ("nanpercentile", lambda a: ordering.nanpercentile(a, 70.0, 1), "round(quantile_cont(v, 0.7), 6)"),
):
    query(_name, f"WITH {CELLS} SELECT i, {_sql} AS value FROM (SELECT * FROM e WHERE v >= 0 ORDER BY j) GROUP BY i")(lambda spark, sf_dir, f=_f, n=_name: out(f(holes(spark, sf_dir)), "i", digits=None if n.startswith("nanarg") else 6))
query("nancumprod", f"WITH {CELLS} SELECT i, j, round(product(CASE WHEN v < 0 THEN 1.0 ELSE v + 1.0 END) OVER (PARTITION BY i ORDER BY j), 6) AS value FROM e")(lambda spark, sf_dir: out(scans.nancumprod(holes(spark, sf_dir) + 1.0, 1), "i", "j", digits=6))


# --- scans and bins ---
@query("cross", "SELECT p_partkey AS i, p_size * p_retailprice - 2.0 AS c0, 1.0 - p_size * p_size AS c1, 2.0 * p_size - p_retailprice AS c2 FROM part")
def cross(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    line = lambda *cells: SparkArray(p.select(F.col("p_partkey").cast("long").alias("i0"), F.posexplode(F.array(*cells)).alias("i1", "v")).withColumn("i1", F.col("i1").cast("long")), (1, 3))
    got = scans.cross(line("s", "r", F.lit(1.0)), line(F.lit(1.0), F.lit(2.0), "s"))
    return got.df.groupBy(F.col("i0").alias("i")).agg(*[F.max(F.when(F.col("i1") == k, F.col("v"))).alias(f"c{k}") for k in range(3)])


@query("roots", "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 2.0), (2, 3.0)) t(i, value)")
def roots(spark, sf_dir):
    found = sorted(scans.roots([1.0, -6.0, 11.0, -6.0]).real.round(6).tolist())
    return spark.createDataFrame(list(enumerate(found)), "i long, value double")


@query("histogramdd", """SELECT x AS i, y AS j, count(c) AS value FROM range(0, 3) a(x), range(0, 2) b(y) LEFT JOIN (SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS p,
    CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END AS q, 1 AS c FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000) ON p = x AND q = y GROUP BY 1, 2""")
def histogramdd(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    column = lambda v: SparkArray(c.select(F.col("c_custkey").cast("long").alias("i0"), F.col(v).cast("double").alias("v")), (1,))
    return out(hist.histogramdd([column("c_acctbal"), column("c_nationkey")], [[-1000.0, 0.0, 5000.0, 10000.0], [0.0, 12.0, 25.0]])[0], "i", "j")


query("moving_max", f"WITH {PRICES} SELECT i, max(v) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS value FROM p")(lambda spark, sf_dir: out(scans.moving(prices(spark, sf_dir), 7, how="max"), "i"))
query("logspace", "SELECT i, round(pow(10.0, 0.5 * i), 6) AS value FROM range(0, 7) t(i)")(lambda spark, sf_dir: out(creation.logspace(spark, 0.0, 3.0, 7), "i", digits=6))
query("vdot", f"WITH {PRICES} SELECT round(sum(v * v) / 1e6, 4) AS value FROM p")(lambda spark, sf_dir: out(products.vdot(prices(spark, sf_dir), prices(spark, sf_dir)) / 1e6, digits=4))


# --- predicates and facts that are no tables ---
@query("complex_predicates", """WITH z AS (SELECT p_partkey AS i, p_retailprice / 1000.0 AS x, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_size / 50.0 END AS y FROM part)
    SELECT i, x AS re, y AS im, -y + 0.0 AS conj_im, y <> 0 AS iscomplex, y = 0 AS isreal FROM z""")
def complex_predicates(spark, sf_dir):
    y = F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(F.col("p_size") / 50.0)
    a = SparkArray(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i0"), C.cell((F.col("p_retailprice") / 1000.0, y)).alias("v")), (1,))
    parts = {"re": a.ufunc("real"), "im": a.ufunc("imag"), "conj_im": a.ufunc("conjugate").ufunc("imag") + 0.0, "iscomplex": a.ufunc("iscomplex"), "isreal": a.ufunc("isreal")}
    df = None
    for n, x in parts.items():
        one = x.df.select(F.col("i0").alias("i"), F.col("v").alias(n))
        df = one if df is None else df.join(one, "i")
    return df


@query("nextafter", "SELECT o_orderkey AS i, true AS up, true AS near FROM orders")
def nextafter(spark, sf_dir):
    from sparkarray.functions import ufuncs as U

    v = F.col("o_totalprice")
    n = U.nextafter(v, float("inf"))
    half = v / 2 + n / 2  # nothing lies between
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), (n > v).alias("up"), ((half == v) | (half == n)).alias("near"))


_FACTS = {
    "broadcast_shapes": ("(5, 3, 4)", lambda a: misc.broadcast_shapes((5, 1, 4), (3, 1))), "ndim": ("2", lambda a: a.ndim), "shape": ("(5, 5)", lambda a: misc.shape(a)), "size": ("25", lambda a: a.size), "dtype": ("bigint", lambda a: a.dtype),
    "itemsize": ("8", lambda a: a.itemsize), "nbytes": ("200", lambda a: a.nbytes), "strides": ("(40, 8)", lambda a: a.strides), "isscalar": ("True", lambda a: misc.isscalar(3.5)), "iscomplexobj": ("False", lambda a: misc.iscomplexobj(a)),
    "isrealobj": ("True", lambda a: misc.isrealobj(a)), "isdtype": ("True", lambda a: misc.isdtype(a.dtype, "integral")), "real_if_close": ("bigint", lambda a: misc.real_if_close(a).dtype), "normalize_axis_index": ("1", lambda a: misc.normalize_axis_index(-1, 2)),
    "normalize_axis_tuple": ("(1, 0)", lambda a: misc.normalize_axis_tuple((-1, 0), 2)), "allclose": ("True", lambda a: reductions.allclose(a, a + 1e-12).item()), "array_equal": ("False", lambda a: reductions.array_equal(a, a + 1)), "item": ("0", lambda a: a[0, 0].item()),
    "tolist": ("[0, 1, 2, 3, 4]", lambda a: a[0].tolist()), "broadcast_object": ("2 (5, 5) 25 2", lambda a: (lambda b: f"{b.numiter} {b.shape} {b.size} {b.nd}")(misc.broadcast(a, a[0]))), "einsum_path": ("[(0, 1), (0, 1)]", lambda a: products.einsum_path("ij,jk,kl->il", a, a, a)[0]),
    "flat": ("(25,)", lambda a: a.flat.shape), "fill": ("175", lambda a: reductions.sum(a.fill(7)).item()), "view": ("(5, 5)", lambda a: a.view().shape), "dumps": ("True", lambda a: len(a.dumps()) > 200), "tobytes": ("200", lambda a: len(a.tobytes())),
}


@query("array_facts", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, (v, _) in _FACTS.items()) + ") t(fact, value)")
def array_facts(spark, sf_dir):
    a = nations(spark, sf_dir)
    return spark.createDataFrame([(n, str(f(a))) for n, (_, f) in _FACTS.items()], "fact string, value string")


# --- random sources: the mean of many draws is where theory has it ---
_EULER = 0.5772156649015329
#: Parameters and the mean (of the arctangent where there is no mean).
_LAWS = {
    "beta": ((2.0, 3.0), 0.4), "binomial": ((20, 0.3), 6.0), "chisquare": ((3.0,), 3.0), "exponential": ((2.0,), 2.0), "f": ((5.0, 20.0), 20 / 18), "gamma": ((2.0, 1.5), 3.0), "geometric": ((0.25,), 4.0), "gumbel": ((1.0, 2.0), 1 + 2 * _EULER), "hypergeometric": ((20, 30, 10), 4.0),
    "laplace": ((1.0, 2.0), 1.0), "logistic": ((1.0, 2.0), 1.0), "lognormal": ((0.0, 0.5), math.exp(0.125)), "logseries": ((0.5,), -0.5 / (0.5 * math.log(0.5))), "negative_binomial": ((5, 0.5), 5.0), "noncentral_chisquare": ((3.0, 2.0), 5.0), "noncentral_f": ((3.0, 20.0, 2.0), 100 / 54),
    "normal": ((3.0, 2.0), 3.0), "pareto": ((5.0,), 0.25), "poisson": ((3.0,), 3.0), "power": ((3.0,), 0.75), "random": ((), 0.5), "integers": ((0, 11), 5.0), "rayleigh": ((2.0,), 2 * math.sqrt(math.pi / 2)), "standard_cauchy": ((), 0.0), "standard_exponential": ((), 1.0), "standard_gamma": ((2.0,), 2.0),
    "standard_normal": ((), 0.0), "standard_t": ((8.0,), 0.0), "triangular": ((0.0, 1.0, 5.0), 2.0), "uniform": ((1.0, 4.0), 2.5), "vonmises": ((0.0, 4.0), 0.0), "wald": ((1.0, 2.0), 1.0), "weibull": ((2.0,), math.gamma(1.5)), "zipf": ((6.0,), 1.0369277551433699 / 1.0173430619844491),
}
_PLAIN = {"rand": (lambda g, n: g.rand(n), 0.5), "randn": (lambda g, n: g.randn(n), 0.0), "randint": (lambda g, n: g.randint(0, 11, n), 5.0), "random_integers": (lambda g, n: g.random_integers(1, 9, n), 5.0), "random_sample": (lambda g, n: g.random_sample(n), 0.5)}


@query("random_laws", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in sorted({*_LAWS, *_PLAIN})) + ") t(name, near)")
def random_laws(spark, sf_dir):
    g, n, df = random.Generator(spark, 11), 65_536, None
    draws = {k: (getattr(g, k)(*args, size=n), mean) for k, (args, mean) in _LAWS.items()} | {k: (f(g, n), mean) for k, (f, mean) in _PLAIN.items()}
    for name, (a, mean) in draws.items():
        v = F.atan("v") if name == "standard_cauchy" else F.col("v").cast("double")
        one = a.df.agg((F.abs(F.avg(v) - mean) < 5 * F.stddev(v) / math.sqrt(n)).alias("near")).select(F.lit(name).alias("name"), "near")
        df = one if df is None else df.unionByName(one)
    return df


# --- transforms there and back, filters ---
def _back(name: str, f) -> None:
    def run(spark, sf_dir):
        got = f(vectors(spark, sf_dir))
        got = got.ufunc("real") if got.is_complex else got
        return out(got, "i", "j", digits=6).withColumn("value", F.col("value") + 0.0)

    query(name, f"WITH {CELLS} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS value FROM e")(run)


s_ = signal
_back("ifft", lambda a: s_.ifft(s_.fft(a)))
_back("irfft", lambda a: s_.irfft(s_.rfft(a)))
_back("hfft", lambda a: s_.hfft(s_.ihfft(a)))
_back("ifft2", lambda a: s_.ifft2(s_.fft2(a)))
_back("irfft2", lambda a: s_.irfft2(s_.rfft2(a)))
_back("ifftn", lambda a: s_.ifftn(s_.fftn(a)))
_back("irfftn", lambda a: s_.irfftn(s_.rfftn(a)))
_back("fftshift", lambda a: s_.ifftshift(s_.fftshift(a)))
_DFT = f"""WITH {CELLS}, k AS (SELECT unnest(range(0, 33)) AS k) SELECT i, k AS j, round(sum(v * cos(2 * pi() * ((k * j) % 64) / 64)), 6) + 0.0::DOUBLE AS re,
    round(-sum(v * sin(2 * pi() * ((k * j) % 64) / 64)), 6) + 0.0::DOUBLE AS im FROM e, k GROUP BY i, k"""


@query("rfft_rows", _DFT)
def rfft_rows(spark, sf_dir):
    return signal.rfft(vectors(spark, sf_dir)).df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


query("fftshift_rows", f"WITH {CELLS} SELECT i, (j + 32) % 64 AS j, round(v, 9) AS value FROM e")(lambda spark, sf_dir: out(signal.fftshift(vectors(spark, sf_dir), 1), "i", "j", digits=9))
query("batched_convolve", f"WITH {CELLS} SELECT i, j, round(0.25 * coalesce(lag(v) OVER w, v) + 0.5 * v + 0.25 * coalesce(lead(v) OVER w, v), 9) AS value FROM e WINDOW w AS (PARTITION BY i ORDER BY j)")(
    lambda spark, sf_dir: out(signal.batched_convolve(vectors(spark, sf_dir), [0.25, 0.5, 0.25]), "i", "j", digits=9)
)
_FREQ = "f AS (SELECT i, j, v, CASE WHEN i < (n + 1) // 2 THEN i ELSE i - n END / n::DOUBLE AS fi, CASE WHEN j < 32 THEN j ELSE j - 64 END / 64.0::DOUBLE AS fj FROM e, (SELECT count(*) AS n FROM embeddings))"
query("fourier_gaussian", f"WITH {CELLS}, {_FREQ} SELECT i, j, round(v * exp(-2 * pow(pi() * 1.5, 2) * fi * fi) * exp(-2 * pow(pi() * 0.5, 2) * fj * fj), 9) + 0.0::DOUBLE AS value FROM f")(
    lambda spark, sf_dir: out(signal.fourier_gaussian(vectors(spark, sf_dir), (1.5, 0.5)), "i", "j", digits=9).withColumn("value", F.col("value") + 0.0)
)
query("fourier_uniform", f"WITH {CELLS}, {_FREQ} SELECT i, j, round(v * CASE WHEN fi = 0 THEN 1 ELSE sin(pi() * 3 * fi) / (pi() * 3 * fi) END * CASE WHEN fj = 0 THEN 1 ELSE sin(pi() * 5 * fj) / (pi() * 5 * fj) END, 9) + 0.0::DOUBLE AS value FROM f")(
    lambda spark, sf_dir: out(signal.fourier_uniform(vectors(spark, sf_dir), (3, 5)), "i", "j", digits=9).withColumn("value", F.col("value") + 0.0)
)


@query("taper_kaiser", "SELECT i, round(sum(pow(3.0 * sqrt(greatest(1 - pow((i - 24.5) / 24.5, 2), 0)) / 2, 2 * k) / pow(gamma(k + 1), 2)) / (SELECT sum(pow(1.5, 2 * k) / pow(gamma(k + 1), 2)) FROM range(0, 40) u(k)), 9) AS value FROM range(0, 50) t(i), range(0, 40) s(k) GROUP BY i")
def taper_kaiser(spark, sf_dir):
    return out(signal.kaiser(spark, 50, 3.0), "i", digits=9)


# --- factorizations, by what they give when put together ---
_EYE = "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(0, 64) a(i), range(0, 64) b(j)"
_ONES = "SELECT i, 1.0::DOUBLE AS value FROM range(0, 64) a(i)"
_SQUARES = f"WITH {CELLS} SELECT round(sum(v * v), 6) AS value FROM e"


def _gram(spark, sf_dir) -> SparkArray:
    return linalg.gram(vectors(spark, sf_dir))


def _round0(a: SparkArray, *names: str, digits: int = 6):
    return out(a, *names, digits=digits).withColumn("value", F.col("value") + 0.0)


query("pinv", _EYE)(lambda spark, sf_dir: (lambda g: _round0(products.matmul(linalg.pinv(g), g), "i", "j"))(_gram(spark, sf_dir)))
query("solve_triangular", _ONES)(lambda spark, sf_dir: (lambda low: _round0(products.matmul(low, linalg.solve_triangular(low, creation.ones(spark, 64), lower=True)), "i"))(linalg.cholesky(_gram(spark, sf_dir))))
query("cho_solve", _ONES)(lambda spark, sf_dir: (lambda g: _round0(products.matmul(g, linalg.cho_solve(linalg.cho_factor(g), creation.ones(spark, 64))), "i"))(_gram(spark, sf_dir)))
query("eigvals", _SQUARES)(lambda spark, sf_dir: out(reductions.sum(linalg.eigvals(_gram(spark, sf_dir)).ufunc("real")), digits=6))
query("eigvalsh", _SQUARES)(lambda spark, sf_dir: out(reductions.sum(linalg.eigvalsh(_gram(spark, sf_dir))), digits=6))
query("blocked_cholesky", f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS value FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2")(lambda spark, sf_dir: (lambda low: out(products.matmul(low, low.T), "i", "j", digits=6))(linalg.blocked_cholesky(_gram(spark, sf_dir), 24)))


@query("gram_qr", f"WITH {CELLS} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS value FROM e")
def gram_qr(spark, sf_dir):
    q, r = linalg.gram_qr(vectors(spark, sf_dir))
    return _round0(products.matmul(q, r), "i", "j")


@query("eig", "SELECT i, j, 0.0::DOUBLE AS value FROM range(0, 64) a(i), range(0, 64) b(j)")
def eig(spark, sf_dir):
    """A V - V diag(w), which is zero."""
    g = _gram(spark, sf_dir)
    w, v = linalg.eig(g)
    return _round0((products.matmul(g.astype("complex"), v) - v * w).ufunc("absolute"), "i", "j", digits=5)


@query("expm", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, round(cos(0.3), 9)), (0, 1, round(-sin(0.3), 9)), (1, 0, round(sin(0.3), 9)), (1, 1, round(cos(0.3), 9))) t(i, j, value)")
def expm(spark, sf_dir):
    return out(linalg.expm(SparkArray.from_numpy(spark, [[0.0, -0.3], [0.3, 0.0]])), "i", "j", digits=9)


# The four that have no SQL of their own get what theory says of them.
for _name, _f, _sql in (
    ("tssvd_energy", lambda spark, sf_dir: out(reductions.sum(linalg.tssvd(vectors(spark, sf_dir))[1].ufunc("square")), digits=5), f"WITH {CELLS} SELECT round(sum(v * v), 5) AS value FROM e"),
    ("det_sign", lambda spark, sf_dir: linalg.det(_gram(spark, sf_dir)).df.select((F.col("v") > 0).alias("value")), "SELECT true AS value"),
):
    query(_name, _sql)(_f)
