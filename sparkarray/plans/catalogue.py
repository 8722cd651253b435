"""Queries by name and the SQL that says the same. Values are rounded on both sides where many numbers are added up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkarray.array import SparkArray
from sparkarray.functions import complexes as C
from sparkarray.functions import ufuncs as U
from sparkarray.operators import creation, hist, indexing, linalg, ordering, products, reductions, scans, shaping, signal
from sparkarray.sources import arrays as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out(a: SparkArray, *names: str, value: str = "value", digits: int | None = None) -> DataFrame:
    v = F.col("v") if digits is None else F.round(F.col("v").cast("double"), digits)
    return a.df.select(*[F.col(i).alias(n) for i, n in zip(a.axes, names)], v.alias(value))


def rounded(v: Column, digits: int) -> Column:
    """SQL's rounding of doubles, halves away from zero, without F.round's way through decimals: for results of very many cells."""
    y = v * 10.0**digits
    whole = F.rint(y)
    return F.when(F.abs(v) > 1e300, v).when(F.abs(y - whole) == 0.5, (y + F.signum(y) * 0.5) / 10.0**digits).otherwise(whole / 10.0**digits)


# --- elementwise: a query for each family; every column is one function ---
def _columns(name: str, table: str, keys: Sequence[str], parts: dict[str, tuple[Callable[[], Column], str]], source: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(*keys, *[f().alias(n) for n, (f, _) in parts.items()])

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {n}' for n, (_, sql) in parts.items())} FROM {source or table}"


def _u(name: str, *cols: str | float, digits: int | None = 9) -> Callable[[], Column]:
    def f() -> Column:
        got = U.ufunc(name)(*[F.col(c) if isinstance(c, str) else F.lit(c) for c in cols])
        return got if digits is None else F.round(got.cast("double"), digits)

    return f


_T, _P, _D = "o_totalprice", "p_retailprice", "CAST(p_size AS DOUBLE)"
R = lambda sql, k=9: f"round({sql}, {k})"

_columns("ufunc_arith", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], {
    "u_add": (_u("add", "l_quantity", "l_tax"), R("l_quantity + l_tax")), "u_subtract": (_u("subtract", "l_extendedprice", "l_quantity"), R("l_extendedprice - l_quantity")),
    "u_multiply": (_u("multiply", "l_extendedprice", "l_discount", digits=6), R("l_extendedprice * l_discount", 6)), "u_true_divide": (_u("true_divide", "l_extendedprice", "l_quantity", digits=6), R("l_extendedprice / l_quantity", 6)),
    "u_negative": (_u("negative", "l_tax"), R("-l_tax")), "u_positive": (_u("positive", "l_tax"), R("l_tax")), "u_square": (_u("square", "l_quantity"), R("l_quantity * l_quantity")), "u_reciprocal": (_u("reciprocal", "l_quantity"), R("1.0 / l_quantity")),
    "u_power": (_u("power", "l_tax", 2.0), R("pow(l_tax, 2)")), "u_float_power": (_u("float_power", "l_quantity", 0.5), R("pow(l_quantity, 0.5)")), "u_absolute": (_u("absolute", "l_tax"), R("abs(l_tax)")), "u_fabs": (_u("fabs", "l_tax"), R("abs(l_tax)")),
})
_columns("ufunc_floor_mod", "orders", ["o_orderkey"], {
    "u_floor_divide": (_u("floor_divide", _T, -700.0), R(f"floor({_T} / -700.0)")), "u_remainder": (_u("remainder", _T, 700.0, digits=6), R(f"{_T} % 700.0", 6)), "u_fmod": (_u("fmod", _T, 700.0, digits=6), R(f"{_T} % 700.0", 6)),
    "u_modf_part": (lambda: F.round(U.modf(F.col(_T))[0], 6), R(f"{_T} - trunc({_T})", 6)), "u_modf_whole": (lambda: U.modf(F.col(_T))[1], f"trunc({_T})"),
    "u_frexp": (lambda: F.round(U.frexp(F.col(_T))[0] * F.pow(F.lit(2.0), U.frexp(F.col(_T))[1]), 6), R(_T, 6)), "u_ldexp": (_u("ldexp", _T, 3.0, digits=6), R(f"{_T} * 8", 6)),
})
_S = "(p_retailprice / 2000.0 - 0.5)"
_s = lambda: F.col("p_retailprice") / 2000.0 - 0.5
_columns("ufunc_trig", "part", ["p_partkey"], {
    **{f"u_{n}": ((lambda n=n: F.round(U.ufunc(n)(_s()), 9)), R(f"{sql}({_S})")) for n, sql in {"sin": "sin", "cos": "cos", "tan": "tan", "arcsin": "asin", "arccos": "acos", "arctan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "arcsinh": "asinh", "arctanh": "atanh", "deg2rad": "radians", "rad2deg": "degrees"}.items()},
    "u_arccosh": (lambda: F.round(U.ufunc("arccosh")(F.col("p_retailprice")), 9), R("acosh(p_retailprice)")), "u_arctan2": (_u("arctan2", "p_retailprice", "p_size"), R("atan2(p_retailprice, p_size)")), "u_hypot": (_u("hypot", "p_retailprice", "p_size", digits=6), R("sqrt(p_retailprice * p_retailprice + p_size * p_size)", 6)),
})
_columns("ufunc_explog", "part", ["p_partkey"], {
    **{f"u_{n}": ((lambda n=n: F.round(U.ufunc(n)(F.col("p_retailprice")), 9)), R(f"{sql}(p_retailprice)")) for n, sql in {"log": "ln", "log2": "log2", "log10": "log10", "sqrt": "sqrt", "cbrt": "cbrt"}.items()},
    "u_log1p": (_u("log1p", "p_retailprice"), R("ln(1 + p_retailprice)")), "u_exp": (lambda: F.round(U.ufunc("exp")(_s()), 9), R(f"exp({_S})")), "u_exp2": (lambda: F.round(U.ufunc("exp2")(_s()), 9), R(f"pow(2, {_S})")), "u_expm1": (lambda: F.round(U.ufunc("expm1")(_s()), 9), R(f"exp({_S}) - 1")),
    "u_logaddexp": (lambda: F.round(U.logaddexp(_s(), 0.25), 9), R(f"ln(exp({_S}) + exp(0.25))")), "u_logaddexp2": (lambda: F.round(U.logaddexp2(_s(), 0.25), 9), R(f"log2(pow(2, {_S}) + pow(2, 0.25))")),
})
_columns("ufunc_compare_logical", "orders", ["o_orderkey"], {
    **{f"u_{n}": (_u(n, _T, 150000.0, digits=None), f"{_T} {op} 150000.0") for n, op in {"greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<=", "equal": "=", "not_equal": "<>"}.items()},
    "u_logical_and": (lambda: U.ufunc("logical_and")(F.col("o_custkey") % 2, F.col("o_orderkey") % 3), "(o_custkey % 2 <> 0) AND (o_orderkey % 3 <> 0)"), "u_logical_or": (lambda: U.ufunc("logical_or")(F.col("o_custkey") % 2, F.col("o_orderkey") % 3), "(o_custkey % 2 <> 0) OR (o_orderkey % 3 <> 0)"),
    "u_logical_xor": (lambda: U.ufunc("logical_xor")(F.col("o_custkey") % 2, F.col("o_orderkey") % 3), "(o_custkey % 2 <> 0) <> (o_orderkey % 3 <> 0)"), "u_logical_not": (lambda: U.ufunc("logical_not")(F.col("o_custkey") % 2), "o_custkey % 2 = 0"),
    "u_maximum": (_u("maximum", _T, 150000.0), R(f"greatest({_T}, 150000.0)")), "u_minimum": (_u("minimum", _T, 150000.0), R(f"least({_T}, 150000.0)")), "u_fmax": (_u("fmax", _T, 150000.0), R(f"greatest({_T}, 150000.0)")), "u_fmin": (_u("fmin", _T, 150000.0), R(f"least({_T}, 150000.0)")),
    "u_isfinite": (_u("isfinite", _T, digits=None), f"isfinite({_T})"), "u_isinf": (_u("isinf", _T, digits=None), f"isinf({_T})"), "u_isnan": (_u("isnan", _T, digits=None), f"isnan({_T})"), "u_isneginf": (_u("isneginf", _T, digits=None), "false"), "u_isposinf": (_u("isposinf", _T, digits=None), "false"),
    "u_isclose": (lambda: U.isclose(F.col(_T), 150000.0, 0.01, 0.0), f"abs({_T} - 150000.0) <= 1500.0"),
})
_columns("ufunc_bits", "orders", ["o_orderkey"], {
    "u_and": (_u("bitwise_and", "o_orderkey", "o_custkey", digits=None), "o_orderkey & o_custkey"), "u_or": (_u("bitwise_or", "o_orderkey", "o_custkey", digits=None), "o_orderkey | o_custkey"), "u_xor": (_u("bitwise_xor", "o_orderkey", "o_custkey", digits=None), "xor(o_orderkey, o_custkey)"),
    "u_invert": (_u("invert", "o_orderkey", digits=None), "~o_orderkey"), "u_left": (lambda: U.shift_left(F.col("o_orderkey"), 5), "o_orderkey << 5"), "u_right": (lambda: U.shift_right(F.col("o_orderkey"), 2), "o_orderkey >> 2"),
    "u_gcd": (_u("gcd", "o_orderkey", "o_custkey", digits=None), "CAST(gcd(o_orderkey, o_custkey) AS BIGINT)"), "u_lcm": (_u("lcm", "o_orderkey", "o_custkey", digits=None), "CAST(lcm(o_orderkey, o_custkey) AS BIGINT)"),
})
_columns("ufunc_float_parts", "supplier", ["s_suppkey"], {
    "u_sign": (_u("sign", "s_acctbal"), "CAST(sign(s_acctbal) AS DOUBLE)"), "u_trunc": (_u("trunc", "s_acctbal"), "trunc(s_acctbal)"), "u_floor": (_u("floor", "s_acctbal"), "floor(s_acctbal)"), "u_ceil": (_u("ceil", "s_acctbal"), "ceil(s_acctbal)"), "u_rint": (_u("rint", "s_acctbal"), "round_even(s_acctbal, 0)"),
    "u_signbit": (_u("signbit", "s_acctbal", digits=None), "signbit(s_acctbal)"), "u_copysign": (lambda: U.copysign(F.lit(2.0), F.col("s_acctbal")), "CASE WHEN signbit(s_acctbal) THEN -2.0::DOUBLE ELSE 2.0::DOUBLE END"), "u_round": (lambda: U.around(F.col("s_acctbal"), 1), "round_even(s_acctbal, 1)"),
    "u_clip": (lambda: U.clip(F.col("s_acctbal"), 0.0, 5000.0), "greatest(0.0, least(s_acctbal, 5000.0))::DOUBLE"), "u_nan_to_num": (lambda: U.nan_to_num(F.col("s_acctbal")), "s_acctbal"),
    "u_where": (lambda: U.where(F.col("s_acctbal") > 0, F.col("s_acctbal"), 0.0), "CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0::DOUBLE END"), "u_select": (lambda: U.select([F.col("s_acctbal") > 5000, F.col("s_acctbal") > 0], [2, 1], 0), "CASE WHEN s_acctbal > 5000 THEN 2 WHEN s_acctbal > 0 THEN 1 ELSE 0 END"),
    "u_choose": (lambda: U.choose(F.col("s_nationkey") % 3, [10, 20, 30]), "CASE s_nationkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END"),
})


# --- arrays taken from tables ---
def prices(spark: SparkSession, sf_dir: str) -> SparkArray:
    """orders.o_totalprice in the order of o_orderkey."""
    return SparkArray.from_column(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"])


PRICES = "p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v, o_custkey FROM orders)"


def customers(spark: SparkSession, sf_dir: str) -> SparkArray:
    return SparkArray.from_column(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"])


def vectors(spark: SparkSession, sf_dir: str) -> SparkArray:
    """The embeddings as a matrix of cells."""
    return sources.from_rows(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").astype("double")


CELLS = "e AS (SELECT vec_id AS i, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("revenue_by_priority", """SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS o_month, count(*) AS n_lines,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def revenue_by_priority(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.month("o_orderdate").alias("o_month"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderpriority", "o_month").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _all(a: SparkArray, fs: dict[str, Callable[[SparkArray], SparkArray]]) -> DataFrame:
    """Reductions to a cell, one column each."""
    df = None
    for n, f in fs.items():
        one = f(a).df.select(F.col("v").alias(n))
        df = one if df is None else df.crossJoin(one)
    return df


@query("red_full", f"""WITH {PRICES} SELECT round(sum(v), 2) AS r_sum, min(v) AS r_min, max(v) AS r_max, round(avg(v), 6) AS r_mean, round(var_pop(v), 2) AS r_var, round(stddev_pop(v), 6) AS r_std,
    count(*) FILTER (WHERE v <> 0) AS r_count_nonzero, bool_and(v <> 0) AS r_all, bool_or(v <> 0) AS r_any FROM p""")
def red_full(spark, sf_dir):
    r = reductions
    rnd = lambda f, k: lambda a: f(a).map(lambda v: F.round(v, k))
    return _all(SparkArray(read(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("i0"), F.col("o_totalprice").alias("v")), (1,)), {"r_sum": rnd(r.sum, 2), "r_min": r.amin, "r_max": r.amax, "r_mean": rnd(r.mean, 6), "r_var": rnd(r.var, 2), "r_std": rnd(r.std, 6), "r_count_nonzero": r.count_nonzero, "r_all": r.all, "r_any": r.any})


for _name, _f, _sql in (("sum", "sum", "round(sum(v), 6)"), ("max", "amax", "round(max(v), 6)"), ("min", "amin", "round(min(v), 6)"), ("mean", "mean", "round(avg(v), 6)"), ("var", "var", "round(var_pop(v), 6)"), ("prod", "prod", "round(product(v + 1.0), 9)")):
    def _axis(spark, sf_dir, f=_f):
        a = vectors(spark, sf_dir)
        if f == "prod":
            return out(reductions.prod(a + 1.0, 1), "i", digits=9)
        return out(getattr(reductions, f)(a, 1), "i", digits=6)

    query(f"red_axis_{_name}", f"WITH {CELLS} SELECT i, {_sql} AS value FROM e GROUP BY i")(_axis)


@query("red_keepdims", f"WITH {CELLS} SELECT CAST(0 AS BIGINT) AS i, j, round(sum(v), 5) AS value FROM e GROUP BY j")
def red_keepdims(spark, sf_dir):
    return out(reductions.sum(vectors(spark, sf_dir), 0, keepdims=True), "i", "j", digits=5)


@query("red_where_initial", f"WITH {CELLS} SELECT i, round(coalesce(sum(v) FILTER (WHERE v > 0), 0) + 10, 6) AS value FROM e GROUP BY i")
def red_where_initial(spark, sf_dir):
    a = vectors(spark, sf_dir)
    return out(reductions.sum(a, 1, where=a > 0.0, initial=10.0), "i", digits=6)


_NAN = "n AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)"


@query("red_nan", f"WITH {_NAN} SELECT user_id, round(coalesce(sum(v), 0), 4) AS r_nansum, min(v) AS r_nanmin, max(v) AS r_nanmax, round(avg(v), 6) AS r_nanmean FROM n GROUP BY user_id HAVING count(v) > 0")
def red_nan(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("i0"), F.col("event_id").alias("i1"), F.when(F.col("event_id") % 7 == 0, U.NAN).otherwise(F.col("value")).alias("v"))
    a = SparkArray(e, (1, 1))
    parts = {"r_nansum": (reductions.nansum, 4), "r_nanmin": (reductions.nanmin, None), "r_nanmax": (reductions.nanmax, None), "r_nanmean": (reductions.nanmean, 6)}
    df = None
    for n, (f, k) in parts.items():
        one = out(f(a, 1), "user_id", value=n, digits=k)
        df = one if df is None else df.join(one, "user_id")
    return df.filter(~F.isnan("r_nanmin"))


@query("argmax_axis", f"WITH {CELLS} SELECT i, arg_max(j, v) AS value FROM (SELECT * FROM e ORDER BY j) GROUP BY i")
def argmax_axis(spark, sf_dir):
    return out(reductions.argmax(vectors(spark, sf_dir), 1), "i")


@query("argmin_axis", f"WITH {CELLS} SELECT i, arg_min(j, v) AS value FROM (SELECT * FROM e ORDER BY j) GROUP BY i")
def argmin_axis(spark, sf_dir):
    return out(reductions.argmin(vectors(spark, sf_dir), 1), "i")


@query("average_weighted", f"WITH {CELLS} SELECT i, round(sum(v * (j + 1)) / sum(j + 1), 9) AS value FROM e GROUP BY i")
def average_weighted(spark, sf_dir):
    a = vectors(spark, sf_dir)
    return out(reductions.average(a, 1, creation.arange(spark, 1.0, a.shape[1] + 1.0)), "i", digits=9)


@query("cov_matrix", f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 8) AS value FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2")
def cov_matrix(spark, sf_dir):
    return out(reductions.cov(vectors(spark, sf_dir), rowvar=False), "i", "j", digits=8)


# --- histograms ---
@query("bincount", "SELECT g.i, count(o_custkey) AS value FROM (SELECT unnest(range(0, (SELECT max(o_custkey) + 1 FROM orders))) AS i) g LEFT JOIN orders ON o_custkey = g.i GROUP BY g.i")
def bincount(spark, sf_dir):
    return out(hist.bincount(_column(spark, sf_dir, "orders", "o_custkey")), "i")


def _column(spark, sf_dir, table: str, value: str) -> SparkArray:
    """For operators that ignore order: all cells under one index."""
    return SparkArray(read(spark, sf_dir, table).select(F.lit(0).cast("long").alias("i0"), F.col(value).alias("v")), (1,))


@query("bincount_weights", "SELECT g.i, round(coalesce(sum(l_tax), 0), 6) AS value FROM (SELECT unnest(range(0, (SELECT CAST(max(l_quantity) AS BIGINT) + 1 FROM lineitem))) AS i) g LEFT JOIN lineitem ON CAST(l_quantity AS BIGINT) = g.i GROUP BY g.i")
def bincount_weights(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i0")).agg(F.sum("l_tax").alias("v"))
    top = rows.agg(F.max("i0")).first()[0]
    return out(hist._filled(rows, top + 1), "i", digits=6)


@query("hist_uniform", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), s AS (SELECT lo, hi, (hi - lo) / 20 AS st FROM b),
    e AS (SELECT k, lo + k * st AS l, CASE WHEN k = 19 THEN hi ELSE lo + (k + 1) * st END AS h FROM s, range(0, 20) r(k))
    SELECT k AS i, count(l_extendedprice) AS value FROM e LEFT JOIN lineitem ON l_extendedprice >= l AND (l_extendedprice < h OR (k = 19 AND l_extendedprice = h)) GROUP BY k""")
def hist_uniform(spark, sf_dir):
    return out(hist.histogram(_column(spark, sf_dir, "lineitem", "l_extendedprice"), 20)[0], "i")


_EDGES = [0.0, 0.02, 0.04, 0.05, 0.10]
_BIN = "CASE WHEN l_discount < 0 OR l_discount > 0.10 THEN NULL WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.04 THEN 1 WHEN l_discount < 0.05 THEN 2 ELSE 3 END"


@query("hist_edges", f"SELECT g.i, count(b) AS value FROM (SELECT unnest(range(0, 4)) AS i) g LEFT JOIN (SELECT {_BIN} AS b FROM lineitem) ON b = g.i GROUP BY g.i")
def hist_edges(spark, sf_dir):
    return out(hist.histogram(_column(spark, sf_dir, "lineitem", "l_discount"), _EDGES)[0], "i")


@query("hist_density", f"SELECT g.i, round(count(b) / (SELECT count(*) FROM lineitem WHERE {_BIN} IS NOT NULL) / CASE g.i WHEN 2 THEN 0.01 WHEN 3 THEN 0.05 ELSE 0.02 END, 6) AS value FROM (SELECT unnest(range(0, 4)) AS i) g LEFT JOIN (SELECT {_BIN} AS b FROM lineitem) ON b = g.i GROUP BY g.i")
def hist_density(spark, sf_dir):
    return out(hist.histogram(_column(spark, sf_dir, "lineitem", "l_discount"), _EDGES, density=True)[0], "i", digits=6)


@query("hist_2d", """SELECT x AS i, y AS j, count(c) AS value FROM range(0, 3) a(x), range(0, 2) b(y) LEFT JOIN (SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS p,
    CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END AS q, 1 AS c FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000) ON p = x AND q = y GROUP BY 1, 2""")
def hist_2d(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    x = SparkArray(c.select(F.col("c_custkey").alias("i0"), F.col("c_acctbal").alias("v")), (1,))
    y = SparkArray(c.select(F.col("c_custkey").alias("i0"), F.col("c_nationkey").cast("double").alias("v")), (1,))
    return out(hist.histogram2d(x, y, [[-1000.0, 0.0, 5000.0, 10000.0], [0.0, 12.0, 25.0]])[0], "i", "j")


@query("digitize", "SELECT p_partkey AS i, CAST((p_retailprice >= 1000)::INT + (p_retailprice >= 1200)::INT + (p_retailprice >= 1500)::INT AS BIGINT) AS value FROM part")
def digitize(spark, sf_dir):
    a = SparkArray(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0"), F.col("p_retailprice").alias("v")), (1,))
    return out(hist.digitize(a, [1000.0, 1200.0, 1500.0]), "i")


# --- ordering ---
for _side, _op in (("left", "<"), ("right", "<=")):
    def _search(spark, sf_dir, side=_side):
        a = ordering.sort(SparkArray.from_column(read(spark, sf_dir, "supplier"), "s_acctbal", ["s_suppkey"]))
        v = SparkArray(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i0"), F.col("c_acctbal").alias("v")), (1,))
        return out(ordering.searchsorted(a, v, side), "i")

    query(f"searchsorted_{_side}", f"SELECT c_custkey AS i, (SELECT count(*) FROM supplier WHERE s_acctbal {_op} c_acctbal) AS value FROM customer")(_search)


@query("unique", "SELECT row_number() OVER (ORDER BY v) - 1 AS i, v AS value FROM (SELECT DISTINCT l_quantity AS v FROM lineitem)")
def unique(spark, sf_dir):
    return out(ordering.unique(_column(spark, sf_dir, "lineitem", "l_quantity")), "i")


@query("unique_counts", "SELECT row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) AS value FROM lineitem GROUP BY l_quantity")
def unique_counts(spark, sf_dir):
    return out(ordering.unique(_column(spark, sf_dir, "lineitem", "l_quantity"), return_counts=True)[1], "i")


for _name, _inv in (("isin", False), ("isin_invert", True)):
    def _isin(spark, sf_dir, invert=_inv):
        a = SparkArray(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i0"), F.col("o_custkey").alias("v")), (1,))
        t = SparkArray(read(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.lit(0).cast("long").alias("i0"), F.col("c_custkey").alias("v")), (1,))
        return out(ordering.isin(a, t, invert), "i")

    query(_name, f"SELECT o_orderkey AS i, o_custkey {'NOT ' if _inv else ''}IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS value FROM orders")(_isin)


@query("sort_flat", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, o_totalprice AS value FROM orders")
def sort_flat(spark, sf_dir):
    return out(ordering.sort(prices(spark, sf_dir)), "i")


@query("argsort", f"WITH {PRICES} SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, i AS value FROM p")
def argsort(spark, sf_dir):
    return out(ordering.argsort(prices(spark, sf_dir)), "i")


@query("sort_axis", f"WITH {CELLS} SELECT i, row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS j, round(v, 9) AS value FROM e")
def sort_axis(spark, sf_dir):
    return out(ordering.sort(vectors(spark, sf_dir), 1), "i", "j", digits=9)


@query("lexsort", f"WITH {PRICES} SELECT row_number() OVER (ORDER BY o_custkey, v, i) - 1 AS i, i AS value FROM p")
def lexsort(spark, sf_dir):
    return out(ordering.lexsort([prices(spark, sf_dir), customers(spark, sf_dir)]), "i")


@query("topk_partition", "SELECT row_number() OVER (ORDER BY o_totalprice DESC) - 1 AS i, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC LIMIT 25")
def topk_partition(spark, sf_dir):
    return out(ordering.topk(_column(spark, sf_dir, "orders", "o_totalprice"), 25), "i")


_POS = {"inverted_cdf": "0.3 * n", "averaged_inverted_cdf": "0.3 * n", "interpolated_inverted_cdf": "0.3 * n", "hazen": "0.3 * n + 0.5", "weibull": "0.3 * (n + 1)", "linear": "0.3 * (n - 1) + 1", "median_unbiased": "0.3 * (n + 1.0 / 3) + 1.0 / 3", "normal_unbiased": "0.3 * (n + 0.25) + 0.375"}
_IDX = {"lower": "floor(0.3 * (n - 1))", "higher": "ceil(0.3 * (n - 1))", "nearest": "round_even(0.3 * (n - 1), 0)", "midpoint": "floor(0.3 * (n - 1))", "closest_observation": "CASE WHEN 0.3 * n - 1.5 = floor(0.3 * n - 1.5) AND floor(0.3 * n - 1.5) % 2 = 1 THEN floor(0.3 * n - 1.5) ELSE floor(0.3 * n - 1.5) + 1 END"}
for _m in ordering.METHODS_OF_QUANTILE:
    def _quantile(spark, sf_dir, m=_m):
        return out(ordering.quantile(vectors(spark, sf_dir), 0.3, 1, m), "i", digits=9)

    if _m in _POS:
        _g = {"inverted_cdf": "CASE WHEN pos > floor(pos) THEN 1.0 ELSE 0.0 END", "averaged_inverted_cdf": "CASE WHEN pos > floor(pos) THEN 1.0 ELSE 0.5 END"}.get(_m, "pos - floor(pos)")
        _left, _gamma = "floor(pos) - 1", _g
        _at = f"CAST({_POS[_m]} AS DOUBLE)"
    else:
        _left, _at = "pos", f"CAST({_IDX[_m]} AS DOUBLE)"
        _gamma = "CASE WHEN 0.3 * (n - 1) > floor(0.3 * (n - 1)) THEN 0.5 ELSE 0.0 END" if _m == "midpoint" else "0.0"
    query(f"quantile_{_m}", f"""WITH {CELLS}, r AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY i) AS n FROM e),
        q AS (SELECT *, {_left} AS l, {_gamma} AS g FROM (SELECT *, {_at} AS pos FROM r))
        SELECT i, round((1 - any_value(g)) * max(v) FILTER (WHERE k = greatest(l, 0)) + any_value(g) * max(v) FILTER (WHERE k = least(greatest(l + 1, 0), n - 1)), 9) AS value FROM q GROUP BY i""")(_quantile)


@query("median", f"WITH {CELLS} SELECT i, round(median(v), 9) AS value FROM e GROUP BY i")
def median(spark, sf_dir):
    return out(ordering.median(vectors(spark, sf_dir), 1), "i", digits=9)


@query("percentile_flat", "SELECT quantile_cont(o_totalprice, 0.9) AS value FROM orders")
def percentile_flat(spark, sf_dir):
    return out(ordering.percentile(prices(spark, sf_dir), 90.0), digits=6).withColumn("value", F.round("value", 6))


ORACLE["percentile_flat"] = "SELECT round(quantile_cont(o_totalprice, 0.9), 6) AS value FROM orders"


# --- scans ---
@query("cumsum", f"WITH {PRICES} SELECT i, round(sum(v) OVER (ORDER BY i), 2) AS value FROM p")
def cumsum(spark, sf_dir):
    return out(scans.cumsum(prices(spark, sf_dir)), "i", digits=2)


@query("cumsum_axis", f"WITH {CELLS} SELECT i, j, round(sum(v) OVER (PARTITION BY i ORDER BY j), 6) AS value FROM e")
def cumsum_axis(spark, sf_dir):
    return out(scans.cumsum(vectors(spark, sf_dir), 1), "i", "j", digits=6)


@query("cumprod", f"WITH {CELLS} SELECT i, j, round(product(v + 1.0) OVER (PARTITION BY i ORDER BY j), 9) AS value FROM e")
def cumprod(spark, sf_dir):
    return out(scans.cumprod(vectors(spark, sf_dir) + 1.0, 1), "i", "j", digits=9)


@query("nancumsum", "SELECT event_id AS i, round(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END) OVER (ORDER BY event_id), 3) AS value FROM events")
def nancumsum(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), F.when(F.col("event_id") % 7 == 0, U.NAN).otherwise(F.col("value")).alias("v"))
    return out(scans.nancumsum(SparkArray(e, (1,)), 0), "i", digits=3)


@query("diff", f"WITH {PRICES} SELECT i - 1 AS i, round(v - w, 6) AS value FROM (SELECT i, v, lag(v) OVER (ORDER BY i) AS w FROM p) WHERE i > 0")
def diff(spark, sf_dir):
    return out(scans.diff(prices(spark, sf_dir)), "i", digits=6)


@query("gradient", f"WITH {PRICES} SELECT i, round(CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END, 6) AS value FROM (SELECT i, v, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM p)")
def gradient(spark, sf_dir):
    return out(scans.gradient(prices(spark, sf_dir)), "i", digits=6)


@query("roll", f"WITH {PRICES} SELECT (i + 17) % (SELECT count(*) FROM p) AS i, v AS value FROM p")
def roll(spark, sf_dir):
    return out(shaping.roll(prices(spark, sf_dir), 17), "i")


@query("convolve_same", f"WITH {PRICES} SELECT i, round(0.25 * coalesce(lead(v) OVER w, 0) + 0.5 * v + 0.25 * coalesce(lag(v) OVER w, 0), 6) AS value FROM p WINDOW w AS (ORDER BY i)")
def convolve_same(spark, sf_dir):
    return out(scans.convolve(prices(spark, sf_dir), [0.25, 0.5, 0.25]), "i", digits=6)


@query("stencil_nearest", f"WITH {PRICES} SELECT i, round((coalesce(lead(v) OVER w, v) + v + coalesce(lag(v) OVER w, v)) / 3, 6) AS value FROM p WINDOW w AS (ORDER BY i)")
def stencil_nearest(spark, sf_dir):
    return out(signal.ndimage_convolve(prices(spark, sf_dir), [1 / 3, 1 / 3, 1 / 3], "nearest"), "i", digits=6)


@query("moving_mean_axis", f"WITH {CELLS} SELECT i, j, round(avg(v) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS value FROM e")
def moving_mean_axis(spark, sf_dir):
    return out(scans.moving(vectors(spark, sf_dir), 5, 1), "i", "j", digits=9)


# --- indexing ---
@query("take", f"WITH {PRICES} SELECT r AS i, v AS value FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS r, p_size AS k FROM part) JOIN p ON p.i = k")
def take(spark, sf_dir):
    idx = SparkArray.from_column(read(spark, sf_dir, "part"), F.col("p_size").cast("long"), ["p_partkey"])
    return out(indexing.take(prices(spark, sf_dir), idx), "i")


@query("take_along_axis", f"WITH {CELLS} SELECT i, CAST(0 AS BIGINT) AS j, round(max(v), 9) AS value FROM e GROUP BY i")
def take_along_axis(spark, sf_dir):
    a = vectors(spark, sf_dir)
    return out(indexing.take_along_axis(a, reductions.argmax(a, 1, keepdims=True), 1), "i", "j", digits=9)


@query("put", f"WITH {PRICES} SELECT i, CASE WHEN i < 100 AND i % 2 = 0 THEN -1.0::DOUBLE ELSE v END AS value FROM p")
def put(spark, sf_dir):
    return out(indexing.put(prices(spark, sf_dir), creation.arange(spark, 0, 100, 2), creation.full(spark, 1, -1.0)), "i")


@query("compress", f"WITH {PRICES} SELECT row_number() OVER (ORDER BY i) - 1 AS i, v AS value FROM p WHERE v > 150000")
def compress(spark, sf_dir):
    a = prices(spark, sf_dir)
    return out(indexing.compress(a > 150000.0, a), "i")


@query("boolean_mask", f"WITH {CELLS} SELECT row_number() OVER (ORDER BY i, j) - 1 AS i, round(v, 9) AS value FROM e WHERE v > 0.2")
def boolean_mask(spark, sf_dir):
    a = vectors(spark, sf_dir)
    return out(a[a > 0.2], "i", digits=9)


@query("nonzero", f"WITH {PRICES} SELECT row_number() OVER (ORDER BY i) - 1 AS i, i AS value FROM p WHERE o_custkey % 5 = 0")
def nonzero(spark, sf_dir):
    return out(indexing.flatnonzero(customers(spark, sf_dir).map(lambda v: v % 5 == 0)), "i")


@query("argwhere", f"WITH {CELLS}, h AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS r, i, j FROM e WHERE v > 0.25) SELECT r AS i, CAST(0 AS BIGINT) AS j, i AS value FROM h UNION ALL SELECT r, 1, j FROM h")
def argwhere(spark, sf_dir):
    return out(indexing.argwhere(vectors(spark, sf_dir) > 0.25), "i", "j")


@query("basic_slice", f"WITH {CELLS} SELECT (i - 10) // 3 AS i, (40 - j) // 2 AS j, round(v, 9) AS value FROM e WHERE i >= 10 AND i < 200 AND (i - 10) % 3 = 0 AND j <= 40 AND j > 20 AND (40 - j) % 2 = 0")
def basic_slice(spark, sf_dir):
    return out(vectors(spark, sf_dir)[10:200:3, 40:20:-2], "i", "j", digits=9)


@query("putmask_place", f"WITH {PRICES} SELECT i, CASE WHEN o_custkey % 4 = 0 THEN CAST((row_number() OVER (PARTITION BY o_custkey % 4 = 0 ORDER BY i) - 1) % 3 AS DOUBLE) ELSE v END AS value FROM p")
def putmask_place(spark, sf_dir):
    return out(indexing.place(prices(spark, sf_dir), customers(spark, sf_dir).map(lambda v: v % 4 == 0), SparkArray.from_numpy(spark, [0.0, 1.0, 2.0])), "i")


@query("ravel_unravel", f"WITH {CELLS} SELECT i * 64 + j AS f, (i * 64 + j) // 32 AS i, (i * 64 + j) % 32 AS j, round(v, 9) AS value FROM e")
def ravel_unravel(spark, sf_dir):
    a = vectors(spark, sf_dir).reshape(-1, 32)
    return a.df.select(a.flat_id().alias("f"), F.col("i0").alias("i"), F.col("i1").alias("j"), F.round("v", 9).alias("value"))


# --- shapes ---
_NATIONS = "m AS (SELECT n_nationkey // 5 AS i, n_nationkey % 5 AS j, n_regionkey AS v FROM nation)"


def nations(spark, sf_dir) -> SparkArray:
    """n_regionkey by n_nationkey as a 5 by 5 matrix."""
    return SparkArray(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i0"), F.col("n_regionkey").cast("long").alias("v")), (25,)).reshape(5, 5)


def _shape(name: str, f: Callable[[SparkArray], SparkArray], sql: str) -> None:
    query(name, f"WITH {_NATIONS} {sql}")(lambda spark, sf_dir: out(f(nations(spark, sf_dir)).astype("long"), "i", "j"))


_c = "CAST({} AS BIGINT) AS {}"
_sel = lambda i, j, v="v": f"SELECT {_c.format(i, 'i')}, {_c.format(j, 'j')}, {_c.format(v, 'value')}"
_shape("concat", lambda a: shaping.concatenate([a, a], 0), f"{_sel('i', 'j')} FROM m UNION ALL {_sel('i + 5', 'j')} FROM m")
_shape("hstack", lambda a: shaping.hstack([a, a]), f"{_sel('i', 'j')} FROM m UNION ALL {_sel('i', 'j + 5')} FROM m")
_shape("stack", lambda a: shaping.stack([a[0], a[1]], 1), f"{_sel('j', 'i')} FROM m WHERE i < 2")
_shape("split", lambda a: shaping.array_split(a, [2, 4], 1)[1], f"{_sel('i', 'j - 2')} FROM m WHERE j >= 2 AND j < 4")
_shape("repeat", lambda a: shaping.repeat(a, 3, 1), f"{_sel('i', 'j * 3 + r')} FROM m, range(0, 3) t(r)")
_shape("tile", lambda a: shaping.tile(a, (2, 3)), f"{_sel('i + 5 * p', 'j + 5 * q')} FROM m, range(0, 2) t(p), range(0, 3) u(q)")
_shape("pad_edge", lambda a: shaping.pad(a, 1, "edge"), f"SELECT CAST(x AS BIGINT) AS i, CAST(y AS BIGINT) AS j, CAST(v AS BIGINT) AS value FROM range(0, 7) s(x), range(0, 7) t(y) JOIN m ON m.i = least(greatest(x - 1, 0), 4) AND m.j = least(greatest(y - 1, 0), 4)")
_shape("flip", lambda a: shaping.flip(a), f"{_sel('4 - i', '4 - j')} FROM m")
_shape("rot90", lambda a: shaping.rot90(a), f"{_sel('4 - j', 'i')} FROM m")
_shape("transpose", lambda a: a.transpose(), f"{_sel('j', 'i')} FROM m")
_shape("reshape", lambda a: a.reshape(25, 1), f"{_sel('i * 5 + j', '0')} FROM m")
_shape("tril", lambda a: creation.tril(a), f"{_sel('i', 'j', 'CASE WHEN j <= i THEN v ELSE 0 END')} FROM m")
_shape("triu", lambda a: creation.triu(a, 1), f"{_sel('i', 'j', 'CASE WHEN j >= i + 1 THEN v ELSE 0 END')} FROM m")
_shape("fill_diagonal", lambda a: indexing.fill_diagonal(a, 9), f"{_sel('i', 'j', 'CASE WHEN i = j THEN 9 ELSE v END')} FROM m")
_shape("delete", lambda a: shaping.delete(a, [0, 3], 0), f"{_sel('i - CASE WHEN i > 3 THEN 2 ELSE 1 END', 'j')} FROM m WHERE i NOT IN (0, 3)")
_shape("insert", lambda a: shaping.insert(a, [2], -1, 1), f"{_sel('i', 'CASE WHEN j >= 2 THEN j + 1 ELSE j END')} FROM m UNION ALL SELECT DISTINCT CAST(i AS BIGINT), CAST(2 AS BIGINT), CAST(-1 AS BIGINT) FROM m")
_shape("roll_axes", lambda a: shaping.roll(a, (1, 2), (0, 1)), f"{_sel('(i + 1) % 5', '(j + 2) % 5')} FROM m")
_shape("broadcast_add", lambda a: a + a[0], f"SELECT CAST(m.i AS BIGINT) AS i, CAST(m.j AS BIGINT) AS j, CAST(m.v + z.v AS BIGINT) AS value FROM m JOIN m z ON z.i = 0 AND z.j = m.j")
_shape("diag", lambda a: creation.diag(indexing.diagonal(a)), f"{_sel('i', 'j', 'CASE WHEN i = j THEN v ELSE 0 END')} FROM m")


@query("packbits", "SELECT i // 8 AS i, CAST(sum(CASE WHEN s THEN (1 << CAST(7 - i % 8 AS INTEGER)) ELSE 0 END) AS BIGINT) AS value FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus = 'F' AS s FROM orders) GROUP BY 1")
def packbits(spark, sf_dir):
    return out(shaping.packbits(SparkArray.from_column(read(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "F").cast("long"), ["o_orderkey"])), "i")


@query("unpackbits", "SELECT n_nationkey * 8 + k AS i, CAST((n_nationkey >> CAST(7 - k AS INTEGER)) & 1 AS BIGINT) AS value FROM nation, range(0, 8) t(k)")
def unpackbits(spark, sf_dir):
    return out(shaping.unpackbits(SparkArray(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i0"), F.col("n_nationkey").cast("long").alias("v")), (25,))), "i")


@query("eye", "SELECT i, j, CAST(j - i = 1 AS INTEGER)::DOUBLE AS value FROM range(0, 40) a(i), range(0, 30) b(j)")
def eye(spark, sf_dir):
    return out(creation.eye(spark, 40, 30, 1), "i", "j")


@query("linspace", "SELECT i, round(-1.0::DOUBLE + i * 0.03::DOUBLE, 9) AS value FROM range(0, 101) t(i)")
def linspace(spark, sf_dir):
    return out(creation.linspace(spark, -1.0, 2.0, 101), "i", digits=9)


@query("vander", "SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS i, j, round(pow(p_size, 3 - j), 6) AS value FROM part, range(0, 4) t(j)")
def vander(spark, sf_dir):
    return out(creation.vander(SparkArray.from_column(read(spark, sf_dir, "part"), "p_size", ["p_partkey"]), 4), "i", "j", digits=6)


for _w, _sql in (("bartlett", "CASE WHEN i <= 24.5 THEN 2 * i / 49.0 ELSE 2 - 2 * i / 49.0 END"), ("blackman", "0.42 - 0.5 * cos(2 * pi() * i / 49) + 0.08 * cos(4 * pi() * i / 49)"), ("hamming", "0.54 - 0.46 * cos(2 * pi() * i / 49)"), ("hanning", "0.5 - 0.5 * cos(2 * pi() * i / 49)")):
    query(f"taper_{_w}", f"SELECT i, round({_sql}, 9) + 0.0::DOUBLE AS value FROM range(0, 50) t(i)")(lambda spark, sf_dir, w=_w: out(getattr(signal, w)(spark, 50), "i", digits=9).withColumn("value", F.col("value") + 0.0))


# --- products ---
@query("dot", f"WITH {PRICES} SELECT round(sum(v * o_custkey), 1) AS value FROM p")
def dot(spark, sf_dir):
    return out(products.dot(prices(spark, sf_dir), customers(spark, sf_dir).map(lambda v: v.cast("double"))), digits=1)


@query("outer", "SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, (a.n_regionkey * b.n_nationkey)::BIGINT AS value FROM nation a, nation b")
def outer(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    v = lambda c: SparkArray(n.select(F.col("n_nationkey").cast("long").alias("i0"), F.col(c).cast("long").alias("v")), (25,))
    return out(products.outer(v("n_regionkey"), v("n_nationkey")), "i", "j")


_shape("matmul", lambda a: products.matmul(a, a), "SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, CAST(sum(a.v * b.v) AS BIGINT) AS value FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2")
_shape("einsum_ij_kj", lambda a: products.einsum("ij,kj->ik", a, a), "SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, CAST(sum(a.v * b.v) AS BIGINT) AS value FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2")
_shape("tensordot", lambda a: products.tensordot(a, a, ([0], [0])), "SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, CAST(sum(a.v * b.v) AS BIGINT) AS value FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
_shape("matrix_power", lambda a: products.matrix_power(a, 3), "SELECT CAST(a.i AS BIGINT) AS i, CAST(c.j AS BIGINT) AS j, CAST(sum(a.v * b.v * c.v) AS BIGINT) AS value FROM m a JOIN m b ON a.j = b.i JOIN m c ON b.j = c.i GROUP BY 1, 2")


@query("trace", f"WITH {_NATIONS} SELECT CAST(sum(v) AS BIGINT) AS value FROM m WHERE i = j")
def trace(spark, sf_dir):
    return out(products.trace(nations(spark, sf_dir)))


@query("norm", f"WITH {CELLS} SELECT i, round(sqrt(sum(v * v)), 9) AS value FROM e GROUP BY i")
def norm(spark, sf_dir):
    return out(linalg.norm(vectors(spark, sf_dir), axis=1), "i", digits=9)


@query("gram_matrix", f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 7) AS value FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    return out(linalg.gram(vectors(spark, sf_dir)), "i", "j", digits=7)


_DFT = f"""WITH {CELLS}, k AS (SELECT unnest(range(0, 64)) AS k) SELECT i, k AS j, round(sum(v * cos(2 * pi() * ((k * j) % 64) / 64)), 6) + 0.0::DOUBLE AS re,
    round(-sum(v * sin(2 * pi() * ((k * j) % 64) / 64)), 6) + 0.0::DOUBLE AS im FROM e, k GROUP BY i, k"""


@query("fft_rows", _DFT)
def fft_rows(spark, sf_dir):
    a = signal.fft(vectors(spark, sf_dir))
    return a.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


# Factorizations, by what their factors give when multiplied.
_GRAM = f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS value FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2"


@query("cholesky_product", _GRAM)
def cholesky_product(spark, sf_dir):
    low = linalg.cholesky(linalg.gram(vectors(spark, sf_dir)))
    return out(products.matmul(low, low.T), "i", "j", digits=6)


@query("qr_product", _GRAM)
def qr_product(spark, sf_dir):
    q, r = linalg.qr(linalg.gram(vectors(spark, sf_dir)))
    return out(products.matmul(q, r), "i", "j", digits=6)


@query("eigh_product", _GRAM)
def eigh_product(spark, sf_dir):
    w, v = linalg.eigh(linalg.gram(vectors(spark, sf_dir)))
    return out(products.matmul(v * w, v.T), "i", "j", digits=6)


@query("svd_product", _GRAM)
def svd_product(spark, sf_dir):
    u, s, v = linalg.svd(linalg.gram(vectors(spark, sf_dir)))
    return out(products.matmul(u * s, v), "i", "j", digits=6)


@query("inv_product", "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(0, 64) a(i), range(0, 64) b(j)")
def inv_product(spark, sf_dir):
    g = linalg.gram(vectors(spark, sf_dir))
    return out(products.matmul(linalg.inv(g), g), "i", "j", digits=6).withColumn("value", F.col("value") + 0.0)


@query("solve_product", "SELECT i, 1.0::DOUBLE AS value FROM range(0, 64) a(i)")
def solve_product(spark, sf_dir):
    g = linalg.gram(vectors(spark, sf_dir))
    return out(products.matmul(g, linalg.solve(g, creation.ones(spark, g.shape[0]))), "i", digits=6)


@query("tssvd_product", f"WITH {CELLS} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS value FROM e")
def tssvd_product(spark, sf_dir):
    u, s, v = linalg.tssvd(vectors(spark, sf_dir))
    return out(products.matmul(u * s, v), "i", "j", digits=6).withColumn("value", F.col("value") + 0.0)


@query("tiled_matmul", f"WITH {CELLS} SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS value FROM e a JOIN e b ON a.j = b.j GROUP BY 1, 2")
def tiled_matmul(spark, sf_dir):
    a = vectors(spark, sf_dir)
    return out(linalg.tiled_matmul(a, a.T, 128).map(lambda v: rounded(v, 6)), "i", "j").withColumn("value", F.col("value") + 0.0)


_Z = "z AS (SELECT p_partkey AS i, p_retailprice / 1000.0 AS x, p_size / 50.0 AS y FROM part)"


@query("complex_arith", f"""WITH {_Z} SELECT i, round(x * x - y * y, 9) AS square_re, round(2 * x * y, 9) AS square_im, round(x / (x * x + y * y), 9) AS inverse_re, round(-y / (x * x + y * y), 9) AS inverse_im,
    round(sqrt(x * x + y * y), 9) AS size, round(atan2(y, x), 9) AS angle, round(exp(x) * cos(y), 9) AS exp_re, round(exp(x) * sin(y), 9) AS exp_im, round(ln(sqrt(x * x + y * y)), 9) AS log_re FROM z""")
def complex_arith(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), C.cell((F.col("p_retailprice") / 1000.0, F.col("p_size") / 50.0)).alias("z"))
    z = C.parts(F.col("z"), True)
    f = lambda name: C.UNARY[name](z)
    parts = {"square_re": f("square")["re"], "square_im": f("square")["im"], "inverse_re": f("reciprocal")["re"], "inverse_im": f("reciprocal")["im"], "size": f("absolute"), "angle": f("angle"), "exp_re": f("exp")["re"], "exp_im": f("exp")["im"], "log_re": f("log")["re"]}
    return p.select("i", *[F.round(c, 9).alias(n) for n, c in parts.items()])


@query("unravel_index", "SELECT o_orderkey AS f, (o_orderkey // 32) % 1000 AS i, o_orderkey % 32 AS j FROM orders")
def unravel_index(spark, sf_dir):
    idx = SparkArray(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i0"), F.col("o_orderkey").alias("v")), (1,))
    i, j = indexing.unravel_index(idx, (1000, 32))
    return i.df.select(F.col("i0").alias("f"), F.col("v").alias("i")).join(j.df.select(F.col("i0").alias("f"), F.col("v").alias("j")), "f")


_shape("filter_2d_wrap", lambda a: signal.ndimage_convolve(a, [[1.0, 2.0], [3.0, 4.0]], "wrap"), """SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, CAST(sum(b.v * w) AS BIGINT) AS value
    FROM m a, (VALUES (1, 1, 1), (1, 0, 2), (0, 1, 3), (0, 0, 4)) t(di, dj, w) JOIN m b ON b.i = (a.i + di) % 5 AND b.j = (a.j + dj) % 5 GROUP BY 1, 2""")
_shape("inner", lambda a: products.inner(a, a), "SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, CAST(sum(a.v * b.v) AS BIGINT) AS value FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2")
_shape("swapaxes", lambda a: shaping.swapaxes(a, 0, 1), f"{_sel('j', 'i')} FROM m")


@query("cosine_topk", """WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id AS i, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM q)), 7) AS value
    FROM embeddings WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM q)) DESC LIMIT 20""")
def cosine_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = e.filter("vec_id = 0").select(F.col("e").alias("q"))
    dot_ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    s = e.filter("vec_id <> 0").crossJoin(F.broadcast(q)).withColumn("s", dot_("e", "q") / F.sqrt(dot_("e", "e")) / F.sqrt(dot_("q", "q")))
    return s.orderBy(F.desc("s")).limit(20).select(F.col("vec_id").alias("i"), F.round("s", 7).alias("value"))


# --- workloads ---
@query("kmeans_step", """WITH c AS (SELECT vec_id AS k, embedding AS ce FROM embeddings WHERE vec_id < 8), d AS (SELECT e.vec_id, k, list_distance(e.embedding::DOUBLE[], ce::DOUBLE[]) AS d FROM embeddings e, c)
    SELECT k AS i, count(*) AS value FROM (SELECT vec_id, arg_min(k, d) AS k FROM (SELECT * FROM d ORDER BY k) GROUP BY vec_id) GROUP BY k""")
def kmeans_step(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    c = e.filter("vec_id < 8").select(F.col("vec_id").alias("k"), F.col("e").alias("c"))
    d = F.aggregate(F.zip_with("e", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = e.crossJoin(F.broadcast(c)).groupBy("vec_id").agg(F.min_by("k", F.struct(d, "k")).alias("k"))
    return near.groupBy(F.col("k").alias("i")).agg(F.count("*").alias("value"))


@query("linreg_step", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linreg_step(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


@query("logreg_step", "SELECT round(avg((1 / (1 + exp(-(l_quantity / 50 - 0.5))) - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * l_quantity / 50), 9) AS gradient FROM lineitem")
def logreg_step(spark, sf_dir):
    x = F.col("l_quantity") / 50
    y = (F.col("l_returnflag") == "R").cast("double")
    return read(spark, sf_dir, "lineitem").agg(F.round(F.avg((1 / (1 + F.exp(-(x - 0.5))) - y) * x), 9).alias("gradient"))


@query("black_scholes", """WITH o AS (SELECT p_partkey AS i, p_retailprice / 100 AS s, 10.0 + p_size AS x, 1.0 AS t, 0.02 AS r, 0.3 AS sg FROM part),
    d AS (SELECT *, (ln(s / x) + (r + sg * sg / 2) * t) / (sg * sqrt(t)) AS d1 FROM o), e AS (SELECT *, d1 - sg * sqrt(t) AS d2 FROM d),
    n AS (SELECT *, 1 / (1 + exp(-1.5976 * d1 - 0.070566 * d1 * d1 * d1)) AS n1, 1 / (1 + exp(-1.5976 * d2 - 0.070566 * d2 * d2 * d2)) AS n2 FROM e) SELECT i, round(s * n1 - x * exp(-r * t) * n2, 6) AS value FROM n""")
def black_scholes(spark, sf_dir):
    s, x, t, r, sg = F.col("p_retailprice") / 100, F.lit(10.0) + F.col("p_size"), 1.0, 0.02, 0.3
    d1 = (F.log(s / x) + (r + sg * sg / 2) * t) / (sg * t**0.5)
    d2 = d1 - sg * t**0.5
    n = lambda d: 1 / (1 + F.exp(-1.5976 * d - 0.070566 * d * d * d))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(s * n(d1) - x * F.exp(F.lit(-r * t)) * n(d2), 6).alias("value"))


_shape("jacobi_step", lambda a: (lambda p: sum((p[i : i + 5, j : j + 5] for i, j in ((0, 1), (2, 1), (1, 0))), p[1:6, 2:7]))(shaping.pad(a, 1)), "SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, CAST(coalesce(sum(b.v), 0) AS BIGINT) AS value FROM m a LEFT JOIN m b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY 1, 2")


@query("windowed_events", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    from sparkarray.streaming.reductions import windowed

    got = windowed(read(spark, sf_dir, "events"), "ts", "value", "1 day", by=("event_type",))
    return got.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


import sparkarray.plans.further  # noqa: E402, F401  registers more queries
