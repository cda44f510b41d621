"""Two-sided p-value of Student's t as a SQL expression.

P(|T| >= |t|) is the regularised incomplete beta function I_x(dof/2, 1/2) at
x = dof / (dof + t^2), evaluated by its continued fraction.  It stays inside
the JVM: test tables have a handful of rows, and no Python worker starts for them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_TERMS = 1000
GAMMA_SHIFT = 50
MOST_DOF = 1e6
TINY = "1e-300D"


def two_sided_p(t: str, dof: str) -> Column:
    """p-value of a t statistic, from column names; NULL where either is NULL."""
    # Beyond MOST_DOF the distribution is all but normal and the fraction would cancel:
    # go over to the t value with the same normal score at MOST_DOF degrees of freedom.
    score = f"({dof} - 0.5D) * log1p({t} * {t} / {dof}) / {MOST_DOF - 0.5!r}D"
    odds = (
        f"if({dof} > {MOST_DOF!r}D, expm1(least({score}, 700D)), {t} * {t} / {dof})"
    )
    given = f"named_struct('a', least({dof}, {MOST_DOF!r}D) / 2D, 'odds', {odds})"
    # A one-element array is SQL's way to name an intermediate result.
    p = f"transform(array({given}), g -> {_beta_p('g.a', 'g.odds')})[0]"
    return F.expr(f"CASE WHEN {t} = 0 THEN 1D WHEN {t} IS NOT NULL AND {dof} > 0 THEN {p} END")


def _beta_p(a: str, odds: str) -> str:
    """I_x(a, 1/2) where y = 1 - x = odds / (1 + odds), taken so without cancellation."""
    y = f"({odds} / (1D + {odds}))"
    log_x = f"(-log1p({odds}))"
    front = f"(exp({a} * {log_x} + 0.5D * ln({y}) + {_log_gamma_step(a)}) / {math.sqrt(math.pi)!r}D)"
    # The fraction converges fast on one side of the mean of the beta distribution.
    direct = f"({y} > 1D - ({a} + 1D) / ({a} + 2.5D))"
    fraction = _beta_fraction(
        f"if({direct}, {a}, 0.5D)", f"if({direct}, 0.5D, {a})", f"if({direct}, exp({log_x}), {y})"
    )
    return f"if({direct}, {front} * {fraction} / {a}, 1D - 2D * {front} * {fraction})"


def _log_gamma_step(a: str) -> str:
    """ln(Gamma(a + 1/2) / Gamma(a)): a series far from zero, reached by recursion."""
    far = f"({a} + {GAMMA_SHIFT}D)"
    series = (
        f"0.5D * ln({far}) - 1D / (8D * {far}) + 1D / (192D * power({far}, 3))"
        f" - 1D / (640D * power({far}, 5))"
    )
    steps = (
        f"aggregate(sequence(0, {GAMMA_SHIFT - 1}), 0D,"
        f" (total, k) -> total + ln(({a} + k) / ({a} + k + 0.5D)))"
    )
    return f"({series} + {steps})"


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta function by modified Lentz steps.

    The state carries the arguments, and in ``e`` the coefficient of the next step.
    """

    def coefficient(s: str, j: str) -> str:
        m = f"floor({j} / 2)"
        even = f"{m} * ({s}.b - {m}) * {s}.x / (({s}.a + 2 * {m} - 1) * ({s}.a + 2 * {m}))"
        odd = (
            f"-({s}.a + {m}) * ({s}.a + {s}.b + {m}) * {s}.x"
            f" / (({s}.a + 2 * {m}) * ({s}.a + 2 * {m} + 1))"
        )
        return f"if({j} % 2 = 0, {even}, {odd})"

    def state(c: str, d: str, v: str, e: str, s: str) -> str:
        return (
            f"named_struct('c', {c}, 'd', {d}, 'v', {v}, 'e', CAST({e} AS DOUBLE),"
            f" 'a', {s}.a, 'b', {s}.b, 'x', {s}.x)"
        )

    def nonzero(z: str) -> str:
        return f"if(abs({z}) < {TINY}, {TINY}, {z})"

    d = f"(1D / {nonzero('(1D + s.e * s.d)')})"
    c = nonzero("(1D + s.e / s.c)")
    step = state(c, d, f"s.v * {c} * {d}", coefficient("s", "(j + 1)"), "s")
    start = state("1e300D", "1D", "1D", coefficient("u", "1"), "u")
    arguments = f"named_struct('a', {a}, 'b', {b}, 'x', {x})"
    return (
        f"aggregate(sequence(1, {FRACTION_TERMS}), transform(array({arguments}), u -> {start})[0],"
        f" (s, j) -> {step}, s -> s.v)"
    )
