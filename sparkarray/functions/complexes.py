"""Elementwise functions of complex values, which are structs (re, im) of doubles; real operands are promoted.

All of them are Catalyst expressions over the two parts. Branch cuts are those of the principal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkarray.functions.ufuncs import INF, NAN, true_divide

Pair = tuple[Column, Column]


def parts(x, is_complex: bool) -> Pair:
    """Real and imaginary part of a cell or a Python number."""
    if isinstance(x, complex):
        return F.lit(x.real), F.lit(x.imag)
    if not isinstance(x, Column):
        return F.lit(float(x)), F.lit(0.0)
    return (x["re"], x["im"]) if is_complex else (x.cast("double"), F.lit(0.0))


def cell(p: Pair) -> Column:
    return F.struct(p[0].alias("re"), p[1].alias("im"))


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Pair, b: Pair) -> Pair:
    return a[0] - b[0], a[1] - b[1]


def multiply(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def divide(a: Pair, b: Pair) -> Pair:
    """Scaled by the larger part of the divisor, so that nothing overflows on the way."""
    wide = F.abs(b[0]) >= F.abs(b[1])
    big, small = F.when(wide, b[0]).otherwise(b[1]), F.when(wide, b[1]).otherwise(b[0])
    r = true_divide(small, big)
    low = big + small * r
    re = F.when(wide, a[0] + a[1] * r).otherwise(a[0] * r + a[1])
    im = F.when(wide, a[1] - a[0] * r).otherwise(a[1] * r - a[0])
    zero = (b[0] == 0) & (b[1] == 0)
    return F.when(zero, true_divide(a[0], F.lit(0.0))).otherwise(true_divide(re, low)), F.when(zero, true_divide(a[1], F.lit(0.0))).otherwise(true_divide(im, low))


def absolute(a: Pair) -> Column:
    return F.hypot(a[0], a[1])


def angle(a: Pair) -> Column:
    return F.atan2(a[1], a[0])


def exp(a: Pair) -> Pair:
    return F.exp(a[0]) * F.cos(a[1]), F.exp(a[0]) * F.sin(a[1])


def log(a: Pair) -> Pair:
    size = absolute(a)
    return F.when(size == 0, -INF).when(F.isnan(size), NAN).otherwise(F.log(size)), angle(a)


def _scaled_log(base: float) -> Callable[[Pair], Pair]:
    def run(a: Pair) -> Pair:
        re, im = log(a)
        return re / F.log(F.lit(base)), im / F.log(F.lit(base))

    return run


def sqrt(a: Pair) -> Pair:
    size = absolute(a)
    re, im = F.sqrt((size + F.abs(a[0])) / 2), F.sqrt((size - F.abs(a[0])) / 2)
    side = F.when(a[1] < 0, -1.0).otherwise(1.0)
    left = a[0] < 0
    return F.when(left, im).otherwise(re), F.when(left, re).otherwise(im) * side


def power(a: Pair, b: Pair) -> Pair:
    """exp(b log a); zero to a positive power is zero, anything to the power zero is one."""
    zero, one = (a[0] == 0) & (a[1] == 0), (b[0] == 0) & (b[1] == 0)
    safe = F.when(zero, 1.0).otherwise(a[0]), F.when(zero, 0.0).otherwise(a[1])
    re, im = exp(multiply(b, log(safe)))
    return F.when(one, 1.0).when(zero, 0.0).otherwise(re), F.when(one | zero, 0.0).otherwise(im)


def sin(a: Pair) -> Pair:
    return F.sin(a[0]) * F.cosh(a[1]), F.cos(a[0]) * F.sinh(a[1])


def cos(a: Pair) -> Pair:
    return F.cos(a[0]) * F.cosh(a[1]), -F.sin(a[0]) * F.sinh(a[1])


def sinh(a: Pair) -> Pair:
    return F.sinh(a[0]) * F.cos(a[1]), F.cosh(a[0]) * F.sin(a[1])


def cosh(a: Pair) -> Pair:
    return F.cosh(a[0]) * F.cos(a[1]), F.sinh(a[0]) * F.sin(a[1])


def _over(f, g) -> Callable[[Pair], Pair]:
    return lambda a: divide(f(a), g(a))


def _const(re: float, im: float = 0.0) -> Pair:
    return F.lit(re), F.lit(im)


def arcsin(a: Pair) -> Pair:
    ia = multiply(_const(0, 1), a)
    return multiply(_const(0, -1), log(add(ia, sqrt(subtract(_const(1), multiply(a, a))))))


def arccos(a: Pair) -> Pair:
    re, im = arcsin(a)
    return F.lit(1.5707963267948966) - re, -im


def arctan(a: Pair) -> Pair:
    ia = multiply(_const(0, 1), a)
    return multiply(_const(0, 0.5), subtract(log(subtract(_const(1), ia)), log(add(_const(1), ia))))


def _turned(f) -> Callable[[Pair], Pair]:
    """The hyperbolic inverse of a circular one: -i f(i z) ."""
    return lambda a: multiply(_const(0, -1), f(multiply(_const(0, 1), a)))


def arccosh(a: Pair) -> Pair:
    return log(add(a, multiply(sqrt(add(a, _const(1))), sqrt(subtract(a, _const(1))))))


def _to_cell(f):
    return lambda a: cell(f(a))


#: Functions of one complex value; some give a real or boolean one.
UNARY: dict[str, Callable[[Pair], Column]] = {
    n: _to_cell(f)
    for n, f in {
        "negative": lambda a: (-a[0], -a[1]), "positive": lambda a: a, "conjugate": lambda a: (a[0], -a[1]), "square": lambda a: multiply(a, a), "reciprocal": lambda a: divide(_const(1), a),
        "exp": exp, "exp2": lambda a: exp((a[0] * F.log(F.lit(2.0)), a[1] * F.log(F.lit(2.0)))), "expm1": lambda a: subtract(exp(a), _const(1)), "log": log, "log2": _scaled_log(2.0), "log10": _scaled_log(10.0),
        "log1p": lambda a: log(add(a, _const(1))), "sqrt": sqrt, "sin": sin, "cos": cos, "tan": _over(sin, cos), "sinh": sinh, "cosh": cosh, "tanh": _over(sinh, cosh),
        "arcsin": arcsin, "arccos": arccos, "arctan": arctan, "arcsinh": _turned(arcsin), "arccosh": arccosh, "arctanh": _turned(arctan), "rint": lambda a: (F.rint(a[0]), F.rint(a[1])),
    }.items()
} | {
    "absolute": absolute, "angle": angle, "real": lambda a: a[0], "imag": lambda a: a[1], "iscomplex": lambda a: a[1] != 0, "isreal": lambda a: a[1] == 0,
    "isfinite": lambda a: ~F.isnan(a[0]) & ~F.isnan(a[1]) & (F.abs(a[0]) < INF) & (F.abs(a[1]) < INF), "isinf": lambda a: (F.abs(a[0]) == INF) | (F.abs(a[1]) == INF), "isnan": lambda a: F.isnan(a[0]) | F.isnan(a[1]),
    "logical_not": lambda a: (a[0] == 0) & (a[1] == 0),
}


def _ordered(op: str) -> Callable[[Pair, Pair], Column]:
    """By real part, then imaginary part."""
    strict = {"greater": lambda x, y: x > y, "greater_equal": lambda x, y: x > y, "less": lambda x, y: x < y, "less_equal": lambda x, y: x < y}[op]
    last = {"greater": lambda x, y: x > y, "greater_equal": lambda x, y: x >= y, "less": lambda x, y: x < y, "less_equal": lambda x, y: x <= y}[op]
    nan = lambda a, b: F.isnan(a[0]) | F.isnan(a[1]) | F.isnan(b[0]) | F.isnan(b[1])
    return lambda a, b: ~nan(a, b) & (strict(a[0], b[0]) | ((a[0] == b[0]) & last(a[1], b[1])))


BINARY: dict[str, Callable[[Pair, Pair], Column]] = {
    **{n: (lambda a, b, f=f: cell(f(a, b))) for n, f in {"add": add, "subtract": subtract, "multiply": multiply, "true_divide": divide, "power": power, "float_power": power}.items()},
    "equal": lambda a, b: ~(F.isnan(a[0]) | F.isnan(a[1])) & (a[0] == b[0]) & (a[1] == b[1]),
    "not_equal": lambda a, b: F.isnan(a[0]) | F.isnan(a[1]) | (a[0] != b[0]) | (a[1] != b[1]),
    **{n: _ordered(n) for n in ("greater", "greater_equal", "less", "less_equal")},
    "logical_and": lambda a, b: ((a[0] != 0) | (a[1] != 0)) & ((b[0] != 0) | (b[1] != 0)),
    "logical_or": lambda a, b: (a[0] != 0) | (a[1] != 0) | (b[0] != 0) | (b[1] != 0),
    "logical_xor": lambda a, b: ((a[0] != 0) | (a[1] != 0)) != ((b[0] != 0) | (b[1] != 0)),
}
