"""Tail probabilities as column expressions: series and continued fractions of a fixed number of steps, inside ``aggregate``.

Each has the same in DuckDB SQL beside it. Fractions are taken from their far end, so that one number is all the state.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

STEPS = 400  # of the incomplete gamma function: enough for shapes up to some thousands
BETA_STEPS = 1000
HALVINGS = 64


def _fold(steps: int, body: Callable[[Column, Column], Column], first: Column | float = 1.0) -> Column:
    """``body(so far, i)`` for i from ``steps`` down to 1."""
    start = first if isinstance(first, Column) else F.lit(first)
    return F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), start, lambda f, i: body(f, i.cast("double")))


def _fold_sql(steps: int, body: str, first: str = "1.0") -> str:
    """The same over f and i."""
    return f"list_reduce(list_prepend(CAST({first} AS DOUBLE), CAST(range({steps}, 0, -1) AS DOUBLE[])), lambda f, i: {body})"


def ln_gamma(x: Column) -> Column:
    """Stirling's series for x + 8, less the logarithm of what lies between."""

    def series(v: Column) -> Column:
        between = v
        for k in range(1, 8):
            between = between * (v + k)
        tail = lambda y: 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
        return let(v + 8, lambda y: (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + tail(y)) - F.ln(between)

    return let(x.cast("double"), series)


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function; 1 for x up to 0."""

    def both(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = a * F.ln(x) - x
        below = F.exp(front - ln_gamma(a + 1)) * _fold(STEPS, lambda s, i: 1 + x / (a + i) * s)
        above = F.exp(front - ln_gamma(a)) / _fold(STEPS, lambda f, i: x + 2 * i - 1 - a + i * (a - i) / f, x + (2 * STEPS + 1) - a)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - below).otherwise(above)

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), lambda v: F.when(v["a"].isNotNull() & v["x"].isNotNull(), both(v)))


def gamma_upper_sql(a: str, x: str) -> str:
    front = f"({a}) * ln({x}) - ({x})"
    below = f"exp({front} - lgamma(({a}) + 1)) * {_fold_sql(STEPS, f'1 + ({x}) / (({a}) + i) * f')}"
    above = f"exp({front} - lgamma({a})) / {_fold_sql(STEPS, f'({x}) + 2 * i - 1 - ({a}) + i * (({a}) - i) / f', f'({x}) + {2 * STEPS + 1} - ({a})')}"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) < ({a}) + 1 THEN 1 - {below} ELSE {above} END)"


def p_normal(z: Column | str) -> Column:
    """Two-sided."""
    z = F.col(z) if isinstance(z, str) else z
    return gamma_upper(F.lit(0.5), z * z / 2)


def p_normal_sql(z: str) -> str:
    return gamma_upper_sql("0.5", f"(({z}) * ({z}) / 2)")


def p_chi2(x: Column | str, df: Column) -> Column:
    """Upper tail."""
    return gamma_upper(df / 2, (F.col(x) if isinstance(x, str) else x) / 2)


def p_chi2_sql(x: str, df: str) -> str:
    return gamma_upper_sql(f"(({df}) / 2.0)", f"(({x}) / 2.0)")


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function; step 2m takes m(b-m)x / ((a+2m-1)(a+2m)), step 2m+1 -(a+m)(a+b+m)x / ((a+2m)(a+2m+1))."""

    def step(f: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / f

    return _fold(BETA_STEPS, step)


def _beta_fraction_sql(a: str, b: str, x: str) -> str:
    m = "floor(i / 2)"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    return _fold_sql(BETA_STEPS, f"1 + (CASE WHEN i % 2 = 0 THEN {even} ELSE {odd} END) / f")


def p_t(t: Column, df: Column) -> Column:
    """Two-sided; NaN without a degree of freedom. The prefactor is taken in logarithms, so tiny tails keep their digits."""

    def tail(v: Column) -> Column:
        a, b, square, n = v["n"] / 2, F.lit(0.5), v["t"] * v["t"], v["n"]
        x, rest = n / (n + square), square / (n + square)
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) - a * F.log1p(square / n) + b * F.ln(rest))
        near = 1 - front / (b * _beta_fraction(b, a, rest))
        far = front / (a * _beta_fraction(a, b, x))
        return F.when(n <= 0, F.lit(math.nan)).when(square == 0, 1.0).when(x < (a + 1) / (a + b + 2), far).otherwise(near)

    return let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("n")), lambda v: F.when(v["t"].isNotNull() & v["n"].isNotNull(), tail(v)))


def p_t_sql(t: str, df: str) -> str:
    a, b, square = f"(({df}) / 2.0)", "0.5", f"(({t}) * ({t}))"
    x, rest = f"(({df}) / (({df}) + {square}))", f"({square} / (({df}) + {square}))"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) - {a} * ln(1 + {square} / ({df})) + {b} * ln({rest}))"
    near, far = f"1 - {front} / ({b} * {_beta_fraction_sql(b, a, rest)})", f"{front} / ({a} * {_beta_fraction_sql(a, b, x)})"
    return f"(CASE WHEN ({df}) <= 0 THEN CAST('nan' AS DOUBLE) WHEN {square} = 0 THEN 1.0 WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {far} ELSE {near} END)"


def t_quantile(p: Column, df: Column) -> Column:
    """Quantile for p of one half and more, by halving an interval of u with t = u / (1 - u)."""

    def halve(v: Column) -> Callable[[Column, Column], Column]:
        def step(s: Column, _: Column) -> Column:
            def choose(u: Column) -> Column:
                low = 1 - p_t(u / (1 - u), v["n"]) / 2 < v["p"]
                return F.struct(F.when(low, u).otherwise(s["low"]).alias("low"), F.when(low, s["high"]).otherwise(u).alias("high"))

            return let((s["low"] + s["high"]) / 2, choose)

        return step

    def found(v: Column) -> Column:
        ends = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve(v))
        return let((ends["low"] + ends["high"]) / 2, lambda u: u / (1 - u))

    return let(F.struct(p.cast("double").alias("p"), df.cast("double").alias("n")), lambda v: F.when(v["p"].isNotNull() & v["n"].isNotNull(), found(v)))


def t_quantile_sql(p: str, df: str) -> str:
    u = "((s[1] + s[2]) / 2)"
    step = f"CASE WHEN 1 - {p_t_sql(f'({u} / (1 - {u}))', df)} / 2 < {p} THEN [{u}, s[2]] ELSE [s[1], {u}] END"
    ends = f"list_reduce(list_prepend([CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)], list_transform(range({HALVINGS}), lambda j: [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)])), lambda s, j: {step})"
    return f"list_extract(list_transform([{ends}], lambda e: (e[1] + e[2]) / 2 / (1 - (e[1] + e[2]) / 2)), 1)"
