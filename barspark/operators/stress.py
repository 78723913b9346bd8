"""Stress: perturbed inputs, shifted signals, parameter scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_uniform


def noise_injection(bars: DataFrame, spread: float, seed: int = 0) -> DataFrame:
    """Jitter each price within half a spread and re-bracket high and low."""

    def px(c: str):
        u = 2.0 * hash_uniform(seed, F.lit(c), F.col("instrument"), F.col("bar_index")) - 1.0
        return F.col(c) * F.exp(u * (spread / 2.0))

    p = [px(c) for c in ("open", "high", "low", "close")]
    return bars.withColumns({"open": p[0], "high": F.greatest(*p), "low": F.least(*p), "close": p[3]})


def timing_shift(signals: DataFrame, bars: DataFrame, shifts: Sequence[int] = range(-5, 6)) -> DataFrame:
    """Every signal moved by every shift; those outside the series drop out."""
    last = bars.groupBy("instrument").agg(F.max("bar_index").alias("_last"))
    x = signals.withColumn("shift", F.explode(F.array(*[F.lit(s).cast("long") for s in shifts])))
    x = x.withColumn("bar_index", F.col("bar_index") + F.col("shift")).join(last, "instrument")
    x = x.filter((F.col("bar_index") >= 0) & (F.col("bar_index") <= F.col("_last"))).drop("_last")
    return x.withColumn("candidate_id", F.concat_ws("@", "candidate_id", F.col("shift").cast("string")))


def timing_profile(scores: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """scores(keys, shift, score): is the peak at zero, does it fall on both sides, how fast."""
    keys = list(keys)
    s, v = F.col("shift"), F.col("score")
    base = scores.filter(s == 0).select(*keys, v.alias("baseline"))
    out = Window.partitionBy(*keys, "_side").orderBy(F.abs("shift"))
    x = scores.join(base, keys).withColumn("_side", F.signum(s))
    x = x.withColumn("_in", F.coalesce(F.lag("score").over(out), F.col("baseline")))
    a = x.groupBy(*keys).agg(
        F.first("baseline").alias("baseline"),
        F.bool_and(v <= F.col("baseline") + tol).alias("peak_at_zero"),
        F.bool_and((s == 0) | (v <= F.col("_in") + tol)).alias("monotone"),
        F.min(F.when((s != 0) & (F.col("baseline") > 0) & (v <= 0.5 * F.col("baseline")), F.abs(s))).alias("_h"),
    )
    verdict = F.when(~F.col("peak_at_zero"), "improves-off-bar").when(F.col("monotone"), "smooth-decay").otherwise("discontinuous")
    half = F.coalesce(F.col("_h").cast("double"), F.lit(float("inf")))
    return a.select(*keys, "baseline", "peak_at_zero", "monotone", half.alias("half_life_bars"), verdict.alias("verdict"))


def bar_dropout(bars: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Drop bars with probability ``p``; the first bar of a series stays."""
    u = hash_uniform(seed, F.lit("d"), F.col("instrument"), F.col("bar_index"))
    return bars.filter((F.col("bar_index") == 0) | (u >= p))


def latency_shift(decisions: DataFrame, extra: int) -> DataFrame:
    if extra < 0:
        raise ValueError("extra must not be negative")
    return decisions.withColumn("execute_at", F.col("execute_at") + extra)


def scan_grid(lo: float, hi: float, n: int = 7) -> list[float]:
    """Geometric multipliers with 1.0 among them."""
    if not 0 < lo < hi or n < 3:
        raise ValueError("need 0 < lo < hi and three points")
    step = (hi / lo) ** (1.0 / (n - 1))
    return sorted({round(lo * step**i, 12) for i in range(n)} | {1.0})


def parameter_scan(scores: DataFrame, keys: Sequence[str], max_ratio: float = 1.5, min_support: float = 0.6) -> DataFrame:
    """scores(keys, multiplier, score): plateau, spike, edge or degenerate."""
    keys = list(keys)
    m, s = F.col("multiplier"), F.col("score")
    at = scores.groupBy(*keys).agg(F.min_by(F.struct(m.alias("m"), s.alias("s")), F.struct(F.abs(m - 1.0), m)).alias("_c"))
    x = scores.join(at, keys)
    cm, cs = F.col("_c.m"), F.col("_c.s")
    a = x.groupBy(*keys).agg(
        F.count(s).alias("_n"), F.first(cs).alias("chosen_score"), F.percentile(s, F.lit(0.5)).alias("median_score"),
        F.avg(F.when(s > 0, 1.0).otherwise(0.0)).alias("fraction_positive"),
        F.max(F.when(m < cm, s)).alias("_l"), F.max(F.when(m > cm, s)).alias("_r"),
        F.bool_and(s <= cs + 1e-12).alias("_best"),
    )
    c = F.col("chosen_score")
    sup = lambda k: F.when(c > 0, F.col(k) / c)
    edge = F.col("_l").isNull() | F.col("_r").isNull()
    ratio = F.when(c > 0, F.when(F.col("median_score") > 0, c / F.col("median_score")).otherwise(float("inf")))
    a = a.withColumns({"left_support": sup("_l"), "right_support": sup("_r"), "interior": ~(F.col("_best") & edge), "plateau_ratio": ratio})
    thin = F.coalesce(F.col("left_support") < min_support, F.lit(False)) | F.coalesce(F.col("right_support") < min_support, F.lit(False))
    verdict = (
        F.when((F.col("_n") < 3) | c.isNull() | (c <= 0), "degenerate").when(~F.col("interior"), "edge")
        .when((F.col("plateau_ratio") > max_ratio) | thin, "spike").otherwise("plateau")
    )
    return a.withColumn("verdict", verdict).drop("_n", "_l", "_r", "_best")
