"""Elementwise functions as builders of Catalyst expressions, with the edge rules of array programming.

Division by zero gives infinities, logarithms of non-positive numbers give -inf or NaN, comparisons with NaN are false,
integer division rounds down, remainders take the divisor's sign, rounding is half to even. ``ufunc`` takes the operands'
types: whole numbers are compared, divided and raised as whole numbers (by zero: zero), truth values as truth values. A
result that 64 bits can't hold is an error, as Spark's arithmetic has it, not a wrapped number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def d(x) -> Column:
    return lit(x).cast("double")


def _nan(*xs: Column) -> Column:
    out = F.isnan(xs[0])
    for x in xs[1:]:
        out = out | F.isnan(x)
    return out


def true_divide(a, b) -> Column:
    a, b = d(a), d(b)
    return F.when(b != 0, a / F.when(b != 0, b).otherwise(1.0)).when((a == 0) | F.isnan(a), NAN).otherwise(F.when((a > 0) == ~signbit(b), INF).otherwise(-INF))


#: Doubles from here on are whole.
WHOLE = 2.0**52


def floor(x) -> Column:
    x = d(x)
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.floor(x).cast("double"))


def ceil(x) -> Column:
    x = d(x)
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.ceil(x).cast("double"))


def floor_divide(a, b) -> Column:
    """By way of the remainder, so that a quotient next to a whole number rounds the right way."""
    a, b = d(a), d(b)
    safe = F.when(b != 0, b).otherwise(1.0)
    mod = a % safe
    div = (a - mod) / safe
    div = F.when((mod != 0) & ((safe < 0) != (mod < 0)), div - 1.0).otherwise(div)
    low = floor(div)
    return F.when(b == 0, true_divide(a, b)).otherwise(F.when(div - low > 0.5, low + 1.0).otherwise(low))


def remainder(a, b) -> Column:
    a, b = d(a), d(b)
    safe = F.when(b != 0, b).otherwise(1.0)
    mod = a % safe
    return F.when(b == 0, NAN).otherwise(F.when((mod != 0) & ((safe < 0) != (mod < 0)), mod + safe).otherwise(mod))


def fmod(a, b) -> Column:
    a, b = d(a), d(b)
    return F.when(b == 0, NAN).otherwise(a % F.when(b != 0, b).otherwise(1.0))


def log_of(f: Callable[[Column], Column]) -> Callable:
    def run(x) -> Column:
        x = d(x)
        return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(f(x))

    return run


def log1p(x) -> Column:
    x = d(x)
    return F.when(F.isnan(x) | (x < -1), NAN).when(x == -1, -INF).otherwise(F.log1p(x))


def logaddexp(a, b) -> Column:
    a, b = d(a), d(b)
    top = F.greatest(a, b)
    return F.when(F.abs(top) == INF, top).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def logaddexp2(a, b) -> Column:
    a, b = d(a), d(b)
    top = F.greatest(a, b)
    return F.when(F.abs(top) == INF, top).otherwise(top + F.log1p(F.pow(F.lit(2.0), -F.abs(a - b))) / F.log(F.lit(2.0)))


def signbit(x) -> Column:
    x = d(x)
    return F.when(x == 0, F.startswith(x.cast("string"), F.lit("-"))).otherwise(x < 0)


def arctan2(a, b) -> Column:
    """The sign of zeros counts."""
    flat = F.when(signbit(b), 3.141592653589793).otherwise(0.0)
    return F.when((d(a) == 0) & ~F.isnan(d(b)), F.when(signbit(a), -flat).otherwise(flat)).otherwise(F.atan2(d(a), d(b)))


def copysign(a, b) -> Column:
    return F.when(signbit(b), -F.abs(d(a))).otherwise(F.abs(d(a)))


def trunc(x) -> Column:
    x = d(x)
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def compare(op: Callable[[Column, Column], Column], other: bool = False) -> Callable:
    """NaN compares as unequal to all."""

    def run(a, b) -> Column:
        a, b = d(a), d(b)
        return F.when(_nan(a, b), F.lit(other)).otherwise(op(a, b))

    return run


def truth(x) -> Column:
    return lit(x).cast("double") != 0


def extreme(pick: Callable) -> Callable:
    def run(a, b) -> Column:
        a, b = d(a), d(b)
        return F.when(_nan(a, b), NAN).otherwise(pick(a, b))

    return run


def power(a, b) -> Column:
    a, b = d(a), d(b)
    return F.when((a == 1) | ((a == -1) & (F.abs(b) == INF)), 1.0).otherwise(F.pow(a, b))


def sign(x) -> Column:
    x = d(x)
    return F.when(F.isnan(x), NAN).otherwise(F.signum(x))


def cbrt(x) -> Column:
    return F.cbrt(d(x))


def gcd(a, b) -> Column:
    """Euclid's steps as a fold; 92 steps reach any pair of 64-bit integers."""
    start = F.struct(F.abs(lit(a)).cast("long").alias("x"), F.abs(lit(b)).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a, b) -> Column:
    g = gcd(a, b)
    return F.when((lit(a) == 0) | (lit(b) == 0), F.lit(0).cast("long")).otherwise(F.floor(F.abs(lit(a)) / F.when(g == 0, 1).otherwise(g)).cast("long") * F.abs(lit(b)).cast("long"))


def modf(x) -> tuple[Column, Column]:
    whole = trunc(x)
    return F.when(F.abs(d(x)) == INF, copysign(0.0, x)).otherwise(d(x) - whole), F.when(F.abs(d(x)) == INF, d(x)).otherwise(whole)


def frexp(x) -> tuple[Column, Column]:
    """Mantissa in [0.5, 1) and exponent."""
    x = d(x)
    plain = (x != 0) & (F.abs(x) != INF) & ~F.isnan(x)
    e = F.floor(F.log2(F.when(plain, F.abs(x)).otherwise(1.0))) + 1
    m = x / F.pow(F.lit(2.0), e)
    # The logarithm may be off by one step next to a power of two.
    e = F.when(F.abs(m) >= 1, e + 1).when(F.abs(m) < 0.5, e - 1).otherwise(e)
    return F.when(plain, x / F.pow(F.lit(2.0), e)).otherwise(x), F.when(plain, e.cast("int")).otherwise(0)


def ldexp(m, e) -> Column:
    return d(m) * F.pow(F.lit(2.0), d(e))


def nextafter(a, b) -> Column:
    """The next double after a towards b, by the virtual machine's own method."""
    got = F.reflect(F.lit("java.lang.Math"), F.lit("nextAfter"), d(a), d(b)).cast("double")
    return F.when(_nan(d(a), d(b)), NAN).otherwise(got)


def shift_left(a, b) -> Column:
    a, b = lit(a).cast("long"), lit(b).cast("int")
    return F.when(b >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, b))


def shift_right(a, b) -> Column:
    a, b = lit(a).cast("long"), lit(b).cast("int")
    return F.call_function("shiftright", a, F.least(b, F.lit(63)))


def outside(f: Callable[[Column], Column], bad: Callable[[Column], Column]) -> Callable:
    def run(x) -> Column:
        x = d(x)
        return F.when(F.isnan(x) | bad(x), NAN).otherwise(f(x))

    return run


UNARY: dict[str, Callable] = {
    "negative": lambda x: -lit(x), "positive": lambda x: lit(x), "absolute": lambda x: F.abs(lit(x)), "fabs": lambda x: F.abs(d(x)),
    "rint": lambda x: F.rint(d(x)), "sign": sign, "conjugate": lambda x: lit(x), "exp": lambda x: F.exp(d(x)), "exp2": lambda x: F.pow(F.lit(2.0), d(x)),
    "log": log_of(F.log), "log2": log_of(F.log2), "log10": log_of(F.log10), "expm1": lambda x: F.expm1(d(x)), "log1p": log1p,
    "square": lambda x: lit(x) * lit(x), "sqrt": lambda x: F.sqrt(d(x)), "cbrt": cbrt, "reciprocal": lambda x: true_divide(1.0, x),
    "sin": lambda x: F.sin(d(x)), "cos": lambda x: F.cos(d(x)), "tan": lambda x: F.tan(d(x)),
    "arcsin": lambda x: F.asin(d(x)), "arccos": lambda x: F.acos(d(x)), "arctan": lambda x: F.atan(d(x)),
    "sinh": lambda x: F.sinh(d(x)), "cosh": lambda x: F.cosh(d(x)), "tanh": lambda x: F.tanh(d(x)),
    "arcsinh": lambda x: F.asinh(d(x)), "arccosh": outside(F.acosh, lambda x: x < 1),
    "arctanh": lambda x: F.when(F.abs(d(x)) == 1, copysign(INF, x)).when(F.abs(d(x)) > 1, NAN).otherwise(F.atanh(F.when(F.abs(d(x)) < 1, d(x)))),
    "deg2rad": lambda x: F.radians(d(x)), "rad2deg": lambda x: F.degrees(d(x)),
    "logical_not": lambda x: ~truth(x), "isfinite": lambda x: ~F.isnan(d(x)) & (F.abs(d(x)) < INF), "isinf": lambda x: F.abs(d(x)) == INF, "isnan": lambda x: F.isnan(d(x)),
    "signbit": signbit, "floor": floor, "ceil": ceil, "trunc": trunc,
    "invert": lambda x: F.bitwise_not(lit(x)), "isneginf": lambda x: d(x) == -INF, "isposinf": lambda x: (d(x) == INF), "real": lambda x: lit(x), "imag": lambda x: F.when(lit(x).isNotNull(), F.lit(0.0)), "isreal": lambda x: F.lit(True), "iscomplex": lambda x: F.lit(False),
    "angle": lambda x: F.when(F.isnan(d(x)), NAN).when(signbit(x), F.lit(3.141592653589793)).otherwise(0.0),
}
BINARY: dict[str, Callable] = {
    "add": lambda a, b: lit(a) + lit(b), "subtract": lambda a, b: lit(a) - lit(b), "multiply": lambda a, b: lit(a) * lit(b), "true_divide": true_divide,
    "floor_divide": floor_divide, "remainder": remainder, "fmod": fmod, "power": power, "float_power": power,
    "logaddexp": logaddexp, "logaddexp2": logaddexp2, "gcd": gcd, "lcm": lcm, "arctan2": arctan2, "hypot": lambda a, b: F.hypot(d(a), d(b)),
    "greater": compare(lambda a, b: a > b), "greater_equal": compare(lambda a, b: a >= b), "less": compare(lambda a, b: a < b), "less_equal": compare(lambda a, b: a <= b),
    "equal": compare(lambda a, b: a == b), "not_equal": compare(lambda a, b: a != b, True),
    "logical_and": lambda a, b: truth(a) & truth(b), "logical_or": lambda a, b: truth(a) | truth(b), "logical_xor": lambda a, b: truth(a) != truth(b),
    "maximum": extreme(F.greatest), "minimum": extreme(F.least), "fmax": lambda a, b: F.nanvl(extreme(F.greatest)(a, b), F.nanvl(d(a), d(b))), "fmin": lambda a, b: F.nanvl(extreme(F.least)(a, b), F.nanvl(d(a), d(b))),
    "copysign": copysign, "ldexp": ldexp, "bitwise_and": lambda a, b: lit(a).bitwiseAND(lit(b)), "bitwise_or": lambda a, b: lit(a).bitwiseOR(lit(b)), "bitwise_xor": lambda a, b: lit(a).bitwiseXOR(lit(b)),
    "left_shift": shift_left, "right_shift": shift_right, "nextafter": nextafter,
}
MULTI: dict[str, Callable] = {"modf": modf, "frexp": frexp}
ALIASES = {"divide": "true_divide", "mod": "remainder", "abs": "absolute", "conj": "conjugate", "degrees": "rad2deg", "radians": "deg2rad", "bitwise_not": "invert", "acos": "arccos", "asin": "arcsin", "atan": "arctan", "atan2": "arctan2", "acosh": "arccosh", "asinh": "arcsinh", "atanh": "arctanh", "pow": "power", "concat": "concatenate"}


def _whole(x) -> Column:
    return lit(x).cast("long")


def whole_floor_divide(a, b) -> Column:
    a, b = _whole(a), _whole(b)
    safe = F.when(b != 0, b).otherwise(F.lit(1).cast("long"))
    down = F.when((a % safe != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, safe) - down)


def whole_remainder(a, b) -> Column:
    a, b = _whole(a), _whole(b)
    mod = a % F.when(b != 0, b).otherwise(F.lit(1).cast("long"))
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.when((mod != 0) & ((mod < 0) != (b < 0)), mod + b).otherwise(mod))


def whole_fmod(a, b) -> Column:
    a, b = _whole(a), _whole(b)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(a % F.when(b != 0, b).otherwise(F.lit(1).cast("long")))


def whole_power(a, b) -> Column:
    """By squaring; a base is squared only while bits of the exponent are left, so nothing overflows before the result does."""
    start = F.struct(F.lit(1).cast("long").alias("r"), _whole(a).alias("b"), _whole(b).alias("e"))

    def step(s, _):
        rest = F.shiftright(s["e"], 1)
        return F.struct(F.when(s["e"] % 2 == 1, s["r"] * s["b"]).otherwise(s["r"]).alias("r"), F.when(rest > 0, s["b"] * s["b"]).otherwise(s["b"]).alias("b"), rest.alias("e"))

    # A base of 0, 1 or -1 takes any exponent; others overflow long before 2^6 bits are used up.
    got = F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda s: s["r"])
    return F.when(_whole(b) < 0, F.raise_error(F.lit("whole numbers can't be raised to negative powers")).cast("long")).otherwise(got)


WHOLE_UNARY: dict[str, Callable] = {"sign": lambda x: F.signum(lit(x)).cast("long"), "floor": lit, "ceil": lit, "trunc": lit, "signbit": lambda x: lit(x) < 0, "isnan": lambda x: F.lit(False), "isinf": lambda x: F.lit(False), "isfinite": lambda x: F.lit(True)}
#: What a comparison is where both sides are whole, or both are truth values (as 0 and 1).
COMPARE: dict[str, Callable] = {"greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b}
WHOLE_BINARY: dict[str, Callable] = {n: (lambda a, b, f=f: f(lit(a), lit(b))) for n, f in COMPARE.items()} | {
    "maximum": lambda a, b: F.greatest(lit(a), lit(b)), "minimum": lambda a, b: F.least(lit(a), lit(b)), "fmax": lambda a, b: F.greatest(lit(a), lit(b)), "fmin": lambda a, b: F.least(lit(a), lit(b)),
    "floor_divide": whole_floor_divide, "remainder": whole_remainder, "fmod": whole_fmod, "power": whole_power,
}
TRUTH_UNARY: dict[str, Callable] = {"invert": lambda x: ~lit(x), "absolute": lit, "square": lit}
TRUTH_BINARY: dict[str, Callable] = {n: (lambda a, b, f=f: f(lit(a).cast("int"), lit(b).cast("int"))) for n, f in COMPARE.items()} | {
    **{n: (lambda a, b: lit(a) | lit(b)) for n in ("add", "bitwise_or", "maximum", "fmax")}, **{n: (lambda a, b: lit(a) & lit(b)) for n in ("multiply", "bitwise_and", "minimum", "fmin")}, "bitwise_xor": lambda a, b: lit(a) != lit(b),
}
WHOLE_KINDS = ("tinyint", "smallint", "int", "bigint", "decimal(20,0)")


def kind_of(x) -> str:
    """The type's name of an operand that is no array."""
    if isinstance(x, (bool, np.bool_)):
        return "boolean"
    return "bigint" if isinstance(x, (int, np.integer)) else "double"


def ufunc(name: str, kinds: Sequence[str] = ()) -> Callable:
    """The function by name; ``kinds`` are the operands' types, where they are known."""
    name = ALIASES.get(name, name)
    if kinds:
        truth_, whole = all(k == "boolean" for k in kinds), all(k in ("boolean", *WHOLE_KINDS) for k in kinds)
        special = (TRUTH_UNARY | TRUTH_BINARY).get(name) if truth_ else (WHOLE_UNARY | WHOLE_BINARY).get(name) if whole and "boolean" not in kinds else None
        if special is not None:
            return special
        if whole and not truth_ and name in BINARY:
            # Truth values among whole numbers are 0 and 1.
            f = WHOLE_BINARY.get(name, BINARY[name])
            return lambda a, b: f(*(lit(x).cast("long") if k == "boolean" else x for x, k in zip((a, b), kinds)))
        if "boolean" in kinds and name in ("add", "subtract", "multiply"):
            f = BINARY[name]
            return lambda a, b: f(*(lit(x).cast("long") if k == "boolean" else x for x, k in zip((a, b), kinds)))
    for table in (UNARY, BINARY, MULTI):
        if name in table:
            return table[name]
    raise KeyError(name)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = d(a), d(b)
    both = F.isnan(a) & F.isnan(b)
    near = F.when(_nan(a, b), F.lit(False)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    return (both | near) if equal_nan else near


def clip(x, low=None, high=None) -> Column:
    out = d(x)
    if low is not None:
        out = extreme(F.greatest)(out, low)
    return out if high is None else extreme(F.least)(out, high)


def nan_to_num(x, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    x = d(x)
    return F.when(F.isnan(x), nan).when(x == INF, posinf).when(x == -INF, neginf).otherwise(x)


def around(x, decimals: int = 0) -> Column:
    """Half to even."""
    return F.bround(d(x), decimals)


def where(cond: Column, x, y) -> Column:
    return F.when(cond, lit(x)).otherwise(lit(y))


def select(conds: list[Column], choices: list, default=0) -> Column:
    out = F
    for c, v in zip(conds, choices):
        out = out.when(c, lit(v))
    return out.otherwise(lit(default))


def choose(index: Column, choices: list, mode: str = "raise") -> Column:
    n = len(choices)
    if mode == "wrap":
        index = F.pmod(index, F.lit(n))
    elif mode == "clip":
        index = F.greatest(F.least(index, F.lit(n - 1)), F.lit(0))
    return F.element_at(F.array(*[lit(c) for c in choices]), (index + 1).cast("int"))
