"""Random sources: counter-based, so a value depends on seed, draw and position, never on partitioning.

Blocks of ``BLOCK`` positions are independent Philox streams; uniform and normal values also come as pure expressions.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkarray.array import SparkArray, strides

BLOCK = 65_536
#: Distribution: numpy's name for it and whether its values are whole numbers.
DISTRIBUTIONS = {
    "beta": ("beta", False), "binomial": ("binomial", True), "chisquare": ("chisquare", False), "exponential": ("exponential", False), "f": ("f", False), "gamma": ("gamma", False),
    "geometric": ("geometric", True), "gumbel": ("gumbel", False), "hypergeometric": ("hypergeometric", True), "laplace": ("laplace", False), "logistic": ("logistic", False),
    "lognormal": ("lognormal", False), "logseries": ("logseries", True), "negative_binomial": ("negative_binomial", True), "noncentral_chisquare": ("noncentral_chisquare", False),
    "noncentral_f": ("noncentral_f", False), "normal": ("normal", False), "pareto": ("pareto", False), "poisson": ("poisson", True), "power": ("power", False), "rayleigh": ("rayleigh", False),
    "standard_cauchy": ("standard_cauchy", False), "standard_exponential": ("standard_exponential", False), "standard_gamma": ("standard_gamma", False), "standard_t": ("standard_t", False),
    "triangular": ("triangular", False), "uniform": ("uniform", False), "vonmises": ("vonmises", False), "wald": ("wald", False), "weibull": ("weibull", False), "zipf": ("zipf", True),
    "random": ("random", False), "integers": ("integers", True), "standard_normal": ("standard_normal", False),
}


def unit(seed: int, draw: int, flat: Column) -> Column:
    """Uniform in (0, 1) from a hash of seed, draw and position."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), flat), 11).cast("double") + 0.5) / float(2**53)


class Generator:
    """Draws arrays; every call is the next draw of the seed."""

    def __init__(self, spark: SparkSession, seed: int = 0):
        self.spark, self.seed, self.draw = spark, seed, 0

    def _next(self) -> int:
        self.draw += 1
        return self.draw

    def _shape(self, size) -> tuple[int, ...]:
        return () if size is None else (size,) if isinstance(size, int) else tuple(size)

    def kernel(self, name: str, size, *args) -> SparkArray:
        shape, (method, whole) = self._shape(size), DISTRIBUTIONS[name]
        n, seed, draw = math.prod(shape), self.seed, self._next()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for b in pdf["id"]:
                    rng = np.random.Generator(np.random.Philox(key=[seed, draw], counter=[0, 0, 0, int(b)]))
                    v = getattr(rng, method)(*args, size=BLOCK)[: n - b * BLOCK]
                    yield pd.DataFrame({"f": np.arange(b * BLOCK, b * BLOCK + len(v)), "v": v.astype("i8" if whole else "f8")})

        df = self.spark.range(-(-n // BLOCK)).mapInPandas(run, f"f long, v {'long' if whole else 'double'}")
        return SparkArray(df.select(*[(F.expr(f"f div {max(st, 1)}") % max(s, 1)).alias(f"i{k}") for k, (s, st) in enumerate(zip(shape, strides(shape)))], "v"), shape)

    def __getattr__(self, name: str):
        if name in DISTRIBUTIONS:
            return lambda *args, size=None: self.kernel(name, size, *args)
        raise AttributeError(name)

    def _expression(self, size, f) -> SparkArray:
        shape, draw = self._shape(size), self._next()
        steps = strides(shape)
        made = lambda *i: f(sum((x * s for x, s in zip(i, steps)), F.lit(0).cast("long")), draw)
        return SparkArray.generated(self.spark, shape, made)

    def rand(self, *shape: int) -> SparkArray:
        return self._expression(shape, lambda i, d: unit(self.seed, d, i))

    random_sample = rand

    def randn(self, *shape: int) -> SparkArray:
        """Box and Muller's pair, one of the two."""
        return self._expression(shape, lambda i, d: F.sqrt(-2 * F.log(unit(self.seed, 2 * d, i))) * F.cos(2 * math.pi * unit(self.seed, 2 * d + 1, i)))

    def randint(self, low: int, high: int | None = None, size=None) -> SparkArray:
        low, high = (0, low) if high is None else (low, high)
        return self._expression(size, lambda i, d: (F.lit(low) + F.floor(unit(self.seed, d, i) * (high - low))).cast("long"))

    def random_integers(self, low: int, high: int | None = None, size=None) -> SparkArray:
        low, high = (1, low) if high is None else (low, high)
        return self.randint(low, high + 1, size)

    def bytes(self, length: int) -> bytes:
        return np.random.Generator(np.random.Philox(key=[self.seed, self._next()])).bytes(length)

    def permutation(self, a: SparkArray) -> SparkArray:
        from sparkarray.array import dense_ids

        draw = self._next()
        shuffled = dense_ids(a.df.withColumn("u", unit(self.seed, draw, F.col("i0"))), ["u", "i0"], "r")
        return SparkArray(shuffled.select(F.col("r").alias("i0"), "v"), a.shape)


def seed(spark: SparkSession, value: int = 0) -> Generator:
    return Generator(spark, value)


def sample_moments(a: SparkArray) -> Sequence[float]:
    return tuple(a.df.agg(F.avg("v"), F.stddev_pop("v")).first())
