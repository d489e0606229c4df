"""Tails of distributions as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

# Lanczos' approximation of the gamma function with g = 7 and nine terms.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
#: Steps of the continued fraction. It converges in about the root of the larger parameter.
STEPS = 400


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 0.5 or more."""
    y = x - 1
    total = reduce(Column.__add__, [F.lit(c) / (y + i) for i, c in enumerate(LANCZOS[1:], 1)], F.lit(LANCZOS[0]))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front, by Lentz' method.

    A fold over the steps with the state (c, d, h); a factor that is 1 leaves h as it is, so steps
    after convergence change nothing.
    """
    tiny = 1e-300
    apart = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def half(state: Column, term: Column) -> Column:
        d = 1 / apart(1 + term * state["d"])
        c = apart(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # bound by name, as each half reads the state several times
        first = F.transform(F.array(state), lambda s: half(s, even))
        return F.element_at(F.transform(first, lambda s: half(s, odd)), 1)

    d = 1 / apart(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for x from 0 to 1 and a, b of 0.5 or more."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    small = x < (a + 1) / (a + b + 2)
    value = F.when(small, front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(1 - x, b, a) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def student_tail(t: Column, df: Column) -> Column:
    """P(T > t) with ``df`` degrees of freedom, 1 or more; null for null or NaN arguments and fewer degrees."""
    x = df / (df + t * t)
    tail = incomplete_beta(x, df / 2.0, F.lit(0.5)) / 2
    infinite = F.abs(t) == float("inf")
    value = F.when(infinite, F.when(t > 0, 0.0).otherwise(1.0)).when(t >= 0, tail).otherwise(1 - tail)
    return F.when((df >= 1) & ~F.isnan(t), value)
