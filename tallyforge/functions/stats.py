"""Statistics as Column functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import let

Z = 1.96


def accuracy(k: Column, n: Column) -> Column:
    """k / n to three places; 0 when n is 0."""
    return F.round(F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0)), 3)


def wilson_bounds(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval to three places; (0, 0) when n is 0."""
    total = F.nullif(n, F.lit(0)).cast("double")
    p = k.cast("double") / total
    denominator = 1 + z * z / total
    center = (p + z * z / (2 * total)) / denominator
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denominator
    bound = lambda x: F.coalesce(F.round(x, 3), F.lit(0.0))
    return bound(center - half), bound(center + half)


def _nodes(panels: int = 10, points: int = 20) -> list[tuple[float, float]]:
    """Gauss-Legendre nodes and weights of the unit interval, panel by panel."""
    x, w = np.polynomial.legendre.leggauss(points)
    return [((i + (float(t) + 1) / 2) / panels, float(v) / 2 / panels) for i in range(panels) for t, v in zip(x, w, strict=True)]


def _stirling_rest(n: Column) -> Column:
    """ln n! without the leading terms of Stirling's formula, for n of 1 or more."""
    x = n.cast("double")
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    small = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double")) - (x + 0.5) * F.log(x) + x - 0.5 * math.log(2 * math.pi)
    return F.when(n <= 20, small).otherwise(series)


#: Throws up to which the tail is a sum of whole numbers, all below 2 ** 53.
EXACT = 56


def _whole_tail(k: Column, n: Column) -> Column:
    """The tail for few throws, exact: at most EXACT / 2 terms."""

    def add(state: Column, i: Column) -> Column:
        term = F.call_function("div", state["term"] * (n - i + 1), i)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    one = F.lit(1).cast("long")
    steps = F.filter(F.sequence(one, F.greatest(one, F.least(k, F.lit(EXACT // 2).cast("long")))), lambda i: i <= k)
    return F.aggregate(steps, F.struct(one.alias("term"), one.alias("sum")), add, lambda s: s["sum"]) * F.pow(F.lit(0.5), n.cast("double"))


def fair_coin_tail(k: Column, n: Column) -> Column:
    """The chance of at most ``k`` heads in ``n`` throws of a fair coin, for 0 <= k <= n / 2, to about 12 digits; exact for few throws.

    It is the regularized incomplete beta function at a half: its integrand,
    scaled to 1 at a half, is summed over a fixed number of nodes below it, as
    far as it is not negligible. So the work is the same for any ``n``.
    """
    n, k = n.cast("long"), k.cast("long")
    a, x = (n - k - 1).cast("double"), k.cast("double")
    # the integrand falls like a normal curve of width 1 / (2 sqrt(n)), and no slower than exp(-2 (n - 1 - 2 k) s)
    reach = F.least(F.lit(0.5), 7 / F.sqrt(n.cast("double")), F.coalesce(F.try_divide(F.lit(25.0), a - x), F.lit(0.5)))

    def integral(end: Column) -> Column:
        def add(total: Column, node: Column) -> Column:
            s = 2 * end * node["at"]
            return total + node["weight"] * F.exp(a * F.log1p(-s) + x * F.log1p(s))

        nodes = F.array(*(F.struct(F.lit(t).alias("at"), F.lit(w).alias("weight")) for t, w in _nodes()))
        return end * F.aggregate(nodes, F.lit(0.0), add)

    d = (n - 2 * k).cast("double") / n
    deviance = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    top = F.sqrt(n / (2 * math.pi * x * (n - k))) * F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - deviance)
    return F.when(k == 0, F.pow(F.lit(0.5), n.cast("double"))).when(n <= EXACT, _whole_tail(k, n)).otherwise(2 * (n - k) * top * let(reach, integral))


def mcnemar_exact_p(b: Column, c: Column, places: int | None = 4) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs, to four places (``None``: not rounded); 1 when there are none. Constant work for any number of pairs."""
    known = b.isNotNull() & c.isNotNull()
    p = F.when(b == c, F.lit(1.0)).when(known, F.least(F.lit(1.0), 2 * fair_coin_tail(F.least(b, c), b + c)))
    return p if places is None else F.round(p, places)
