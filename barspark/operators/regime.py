"""Regime evidence and hazard as column work; the filter itself is a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.series import REGIME_INPUTS, beta_terms
from .rolling import ewma


def log_likelihood(x: DataFrame, inputs=REGIME_INPUTS) -> DataFrame:
    """l0..l3: sum of Beta log densities of the present inputs, and how many there are.

    The 4 x 8 design is 32 literals in one projection, so no row is multiplied.
    """
    shapes = beta_terms()

    def term(name: str, a: float, b: float, z: float) -> Column:
        v = F.least(F.greatest(F.col(name), F.lit(1e-6)), F.lit(1.0 - 1e-6))
        return F.when(F.col(name).isNotNull(), a * F.log(v) + b * F.log1p(-v) - z).otherwise(0.0)

    cols = {f"l{k}": sum((term(n, *shapes[k][j]) for j, n in enumerate(inputs)), F.lit(0.0)) for k in range(4)}
    cols["usable"] = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in inputs), F.lit(0)).cast("long")
    return x.withColumns(cols)


def hazard(post: DataFrame, halflife: float = 20.0) -> DataFrame:
    """Half the L1 distance to the posterior's own running mean, and what is left to doubt."""
    p = [f"p{k}" for k in range(4)]
    x = ewma(post, {f"_e{k}": F.col(p[k]) for k in range(4)}, halflife)
    tot = sum((F.col(f"_e{k}") for k in range(1, 4)), F.col("_e0"))
    drift = 0.5 * sum((F.abs(F.col(p[k]) - F.col(f"_e{k}") / tot) for k in range(4)), F.lit(0.0))
    x = x.withColumns({"drift": drift, "ambiguity": 1.0 - F.greatest(*p)})
    return x.withColumn("hazard", F.greatest("drift", "ambiguity")).drop(*[f"_e{k}" for k in range(4)])


