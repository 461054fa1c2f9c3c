"""Random numbers: a seeded generator for numbers and arrays, and columns whose values depend on the seed and the row's key alone."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class RandomGenerator:
    """Draws from one seed, in order."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def uniform(self, low: float = 0.0, high: float = 1.0, size=None):
        """Between ``low`` and ``high``, never either."""
        draw = (self.rng.integers(0, 1 << 23, size) + 0.5) / (1 << 23)
        return low + (high - low) * draw

    def normal(self, mean: float = 0.0, deviation: float = 1.0, size=None):
        return self.rng.normal(mean, deviation, size)

    def exponential(self, rate: float = 1.0, size=None):
        return -np.log(self.uniform(size=size)) / rate

    def poisson(self, mean: float, size=None):
        return self.rng.poisson(mean, size)


def uniform(seed: int, *keys: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The same value for the same key, wherever and however often a row is worked out."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 41)
    return F.lit(low) + F.lit(high - low) * (bits + 0.5) / float(1 << 23)


def normal(seed: int, *keys: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit("radius"))))
    return F.lit(mean) + F.lit(deviation) * radius * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("angle")))


def exponential(seed: int, *keys: Column, rate: float = 1.0) -> Column:
    return -F.log(uniform(seed, *keys)) / F.lit(rate)


def poisson(seed: int, *keys: Column, mean: float) -> Column:
    """Counts of a Poisson distribution with a mean of up to 500, by adding up its probabilities."""
    if not 0 <= mean <= 500:
        raise ValueError("a mean between 0 and 500")
    most = int(mean + 12 * math.sqrt(mean) + 20)
    odds = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean else float(k == 0) for k in range(most)])
    table = F.array(*[F.lit(float(p)) for p in odds])
    return F.size(F.filter(table, lambda p: p < uniform(seed, *keys))).cast("long")
