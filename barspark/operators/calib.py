"""Calibration maps and probability scores."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip
from ..kernels.calib import knots as window_knots
from ..kernels.calib import steps
from ..session import checkpoint
from .metrics import number_trades, wilson

MIN_FIT = 20
_GRID = 1024


def isotonic_fit(pairs: DataFrame, p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """Knots (x, y) of the pooled monotone map, fitted by the ML estimator.

    Equal probabilities are merged first (a partial aggregate), so the estimator
    sees at most one row per distinct probability.
    """
    spark = pairs.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight)
    ok = present(pairs, p, y)
    rows = ok.groupBy(F.col(p).alias("p")).agg(
        F.sum(w).alias("w"), (F.sum(w * F.col(y)) / F.sum(w)).alias("label"), F.count(F.lit(1)).alias("n")
    )
    size = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    if size < MIN_FIT:
        return spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    data = VectorAssembler(inputCols=["p"], outputCol="features").transform(rows)
    m = IsotonicRegression(weightCol="w").fit(data)
    xs, ys = np.array(m.boundaries), np.array(m.predictions)
    zero_end = float(xs[ys > 1e-12][0]) if (ys > 1e-12).any() else 2.0
    one_start = float(xs[ys >= 1.0 - 1e-12][0]) if ys[-1] >= 1.0 - 1e-12 else 2.0
    n_low, n_high = rows.agg(
        F.coalesce(F.sum(F.when(F.col("p") < zero_end, F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("p") >= one_start, F.col("n"))), F.lit(0)),
    ).first()
    return spark.createDataFrame(steps(xs.tolist(), ys, n_low, n_high), "x double, y double")


def isotonic_apply(rows: DataFrame, knots: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
    """Piecewise-linear read of the map.

    A missing (NULL or NaN) probability reads NULL.  Segments are listed per 1/1024 of [0, 1], so the range join is an equi-join
    with a residual and its table has at most 1024 + segments rows.
    """
    from pyspark.sql import Window

    w = Window.orderBy("x")  # the knots are a map's few corners, one row each
    seg = knots.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).filter("x1 IS NOT NULL")
    last = F.max("x1").over(Window.partitionBy())
    seg = seg.withColumn("_end", F.col("x1") == last)
    seg = seg.withColumn(
        "_g", F.explode(F.sequence(F.floor(F.col("x") * _GRID), F.least(F.floor(F.col("x1") * _GRID), F.lit(_GRID - 1))))
    ).withColumnsRenamed({"x": "_x0", "y": "_y0", "x1": "_x1", "y1": "_y1"})
    v = clip(F.when(~F.isnan(F.col(p).cast("double")), F.col(p)), 0.0, 1.0)  # missing stays missing
    x = rows.withColumns({"_v": v, "_g": F.least(F.floor(v * _GRID), F.lit(_GRID - 1))})
    inside = (F.col("_v") >= F.col("_x0")) & ((F.col("_v") < F.col("_x1")) | (F.col("_end") & (F.col("_v") <= F.col("_x1"))))
    j = x.join(seg, "_g", "left").filter(inside | F.col("_v").isNull())
    y = F.col("_y0") + (F.col("_v") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    return j.withColumn(out, clip(y, 1e-6, 1.0 - 1e-6)).drop("_g", "_v", "_x0", "_y0", "_x1", "_y1", "_end")


def platt_fit(pairs: DataFrame, score: str = "score", y: str = "y", max_iter: int = 100) -> tuple[float, float]:
    """(T, b) of sigmoid(T x + b) by Newton steps; each step is one 5-sum aggregate."""
    x, t = F.col(score), F.col(y)
    d = checkpoint(pairs.filter(x.isNotNull() & t.isNotNull()).select(x.alias("x"), t.alias("t")))
    if d.limit(30).count() < 30:
        return 1.0, 0.0
    scale, bias = 1.0, 0.0
    for _ in range(max_iter):
        z = F.least(F.greatest(scale * F.col("x") + bias, F.lit(-60.0)), F.lit(60.0))
        p = 1.0 / (1.0 + F.exp(-z))
        g, w = p - F.col("t"), p * (1.0 - p) + 1e-12
        g1, g0, h11, h10, h00 = d.agg(
            F.sum(g * F.col("x")), F.sum(g), F.sum(w * F.col("x") ** 2), F.sum(w * F.col("x")), F.sum(w)
        ).first()
        h11, h00 = h11 + 1e-9, h00 + 1e-9
        det = h11 * h00 - h10 * h10
        if det == 0:
            break
        s1, s0 = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        scale, bias = scale - s1, bias - s0
        if max(abs(s1), abs(s0)) < 1e-9:
            break
    return max(scale, 1e-3), bias


def calibration_refit(outcomes: DataFrame, every: int = 50, first: int = 200, capacity: int = 5000) -> DataFrame:
    """Map in force after each refit: one fit per (instrument, version) on its last ``capacity`` pairs.

    outcomes: instrument, pos (resolution order), p, y.  A pair belongs to at most
    capacity/every versions and a version holds at most ``capacity`` pairs.
    """
    x = number_trades(outcomes, order="pos")
    n = x.groupBy("instrument").agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, "instrument")
    lo = F.greatest(F.ceil((F.col("k") + 1) / every), F.lit(-(-first // every)))
    hi = F.least(F.floor((F.col("k") + capacity) / every), F.floor(F.col("_n") / every))
    x = x.filter(lo <= hi).withColumn("version", F.explode(F.sequence(lo, hi)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        ks = window_knots(pdf["p"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame(
            {
                "instrument": pdf["instrument"].iloc[0], "version": pdf["version"].iloc[0], "n": len(pdf),
                "x": [a for a, _ in ks], "y": [b for _, b in ks],
            }
        )

    return x.select("instrument", "version", "k", "p", "y").groupBy("instrument", "version").applyInPandas(
        fit, "instrument string, version long, n long, x double, y double"
    )


# --------------------------------------------------------------------------- #
# scores of probabilities


def present(pairs: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Pairs whose probability and outcome are both there: neither NULL nor NaN."""
    here = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (p, y)]
    return pairs.filter(here[0] & here[1])


def bin_of(p: Column, bins: int) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.least(F.floor(p * bins), F.lit(bins - 1)), F.lit(0)))


def binned(pairs: DataFrame, bins: int, keys=()) -> DataFrame:
    return present(pairs).groupBy(*keys, bin_of(F.col("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"),
        F.sum((F.col("p") - F.col("y")) ** 2).alias("_sq"),
    )


def brier(pairs: DataFrame, keys=()) -> DataFrame:
    return present(pairs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def brier_decomposition(pairs: DataFrame, bins: int = 15, keys=(), alike: float | None = None) -> DataFrame:
    """reliability - resolution + uncertainty, plus what binning leaves over; ``alike`` is the skill where all outcomes are the same."""
    b = binned(pairs, bins, keys)
    n = F.sum("n")
    a = b.groupBy(*keys).agg(
        n.alias("n"), (F.sum("_sq") / n).alias("brier"), (F.sum(F.col("n") * F.col("observed")) / n).alias("_base"),
        (F.sum(F.col("n") * (F.col("predicted") - F.col("observed")) ** 2) / n).alias("reliability"),
        (F.sum(F.col("n") * F.col("observed") ** 2) / n).alias("_o2"),
        (F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / n).alias("ece"),
        F.count(F.lit(1)).alias("bins_used"),
    )
    base = F.col("_base")
    x = a.withColumns({"resolution": F.col("_o2") - base * base, "uncertainty": base * (1.0 - base)})
    skill = F.when(F.col("uncertainty") > 0, 1.0 - F.col("brier") / F.col("uncertainty")).when(F.col("uncertainty") == 0, F.lit(alike).cast("double"))
    left = F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty"))
    return x.withColumns({"skill": skill, "residual": left}).drop("_base", "_o2")


def reliability_table(pairs: DataFrame, bins: int = 10, keys=()) -> DataFrame:
    b = binned(pairs, bins, keys)
    lo, hi = wilson(F.col("n"), F.col("observed") * F.col("n"))
    return b.select(
        *keys, (F.col("bin") / bins).alias("bin_low"), ((F.col("bin") + 1) / bins).alias("bin_high"), "n", "predicted",
        "observed", lo.alias("ci_low"), hi.alias("ci_high"),
    )


def ece(pairs: DataFrame, bins: int = 15, keys=()) -> DataFrame:
    return brier_decomposition(pairs, bins, keys).select(*keys, "n", "ece")


def calibration_health(pairs: DataFrame, bins: int = 15, keys=(), min_n: int = 30) -> DataFrame:
    d = brier_decomposition(pairs, bins, keys)
    cols = ("brier", "reliability", "resolution", "uncertainty", "skill", "ece")
    return d.select(*keys, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in cols])


