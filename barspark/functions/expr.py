"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, the only missing value used here."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-300, a / b)


def float_div(a: Column, b: Column) -> Column:
    """a / b of doubles as DuckDB divides: by zero to an infinity with the sign of ``a``, 0 / 0 and NaN to NaN; NULL stays NULL."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1): first 8 hex digits of md5('a:b:c') over 2^32.

    A function of its arguments only, so draws survive repartitioning and lost
    executors, and DuckDB computes the same number.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *cols)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sql_uniform(*parts: str) -> str:
    """The DuckDB text of :func:`hash_uniform`; parts are SQL expressions."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF, Abramowitz & Stegun 7.1.26 (error below 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (
        0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.signum(x) * erf)


def sql_norm_cdf(x: str) -> str:
    t = f"(1.0/(1.0+0.3275911*abs({x})/sqrt(2.0)))"
    poly = f"{t}*(0.254829592+{t}*(-0.284496736+{t}*(1.421413741+{t}*(-1.453152027+{t}*1.061405429))))"
    return f"(0.5*(1.0+sign({x})*(1.0-({poly})*exp(-({x})*({x})/2.0))))"


def norm_ppf(p: float) -> float:
    """Normal quantile of a literal; ``statistics.NormalDist`` is exact to 1e-9."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def student_t_ppf(q: float, dof: Column) -> Column:
    """Student-t quantile for a fixed ``q`` by the Cornish-Fisher expansion in 1/dof."""
    z = norm_ppf(q)
    g1 = (z**3 + z) / 4.0
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
    return z + g1 / dof + g2 / dof**2 + g3 / dof**3
