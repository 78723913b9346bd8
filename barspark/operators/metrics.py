"""Performance and significance metrics of return and trade tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import norm_cdf, norm_ppf
from ..session import checkpoint
from .sequence import framed, quantiles, running, w_last

INF = float("inf")
EULER = 0.5772156649015329
YEAR = 252.0


def moments(value: str, keys=("instrument",)):
    v = F.col(value)
    return [
        F.count(v).alias("n"), F.sum(v).alias("_sum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.skewness(v).alias("skew"), (F.kurtosis(v) + 3.0).alias("kurtosis"),
        F.sqrt(F.avg(F.least(v, F.lit(0.0)) ** 2)).alias("_down"),
    ]


def sharpe_se(n: Column, sr: Column, skew: Column, kurt: Column) -> Column:
    var = 1.0 - skew * sr + 0.25 * (kurt - 1.0) * sr * sr
    return F.when((n >= 2) & (var > 0), F.sqrt(var / (n - 1)))


def return_summary(rets: DataFrame, value: str = "ret", keys=("instrument",)) -> DataFrame:
    """Return, risk and tail figures per key; needs ``bar_index`` for the drawdown."""
    keys = list(keys)
    a = rets.filter(F.col(value).isNotNull()).groupBy(*keys).agg(*moments(value))
    q = quantiles(rets, keys, value, [0.05, 0.95])
    dd = drawdown(rets, value, keys).select(*keys, "max_drawdown")
    x = a.join(q, keys).join(dd, keys)
    sr = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))
    annual = F.expm1(F.col("mean") * YEAR)
    return x.select(
        *keys,
        "n",
        F.expm1("_sum").alias("total_return"),
        annual.alias("annualized_return"),
        (F.col("sd") * math.sqrt(YEAR)).alias("annualized_vol"),
        sr.alias("sharpe"),
        (sr * math.sqrt(YEAR)).alias("sharpe_annualized"),
        sharpe_se(F.col("n"), sr, F.col("skew"), F.col("kurtosis")).alias("sharpe_se"),
        (F.try_divide("mean", "_down") * math.sqrt(YEAR)).alias("sortino_annualized"),
        F.when(F.col("max_drawdown") > 0, annual / F.col("max_drawdown")).otherwise(INF).alias("calmar"),
        "skew",
        "kurtosis",
        F.when(F.abs("q_0") > 0, F.abs("q_1") / F.abs("q_0")).alias("tail_ratio"),
    )


def drawdown(rets: DataFrame, value: str = "ret", keys=("instrument",), order: str = "bar_index") -> DataFrame:
    """Largest fall from a running peak, when, for how long, and the longest time under water."""
    keys = list(keys)
    x = rets.select(*keys, order, F.coalesce(F.col(value), F.lit(0.0)).alias("_r"))
    # three dependent scans: each reads its input twice, so the chain is cut once
    x = checkpoint(running(x, {"_cum": ("sum", F.col("_r"))}, keys, order).withColumn("eq", F.exp("_cum")))
    x = running(x, {"_pk": ("max", F.struct(F.col("eq").alias("e"), (-F.col(order)).alias("i")))}, keys, order)
    x = checkpoint(x.withColumn("dd", 1.0 - F.col("eq") / F.col("_pk.e")))
    x = running(x, {"_isl": ("sum", F.when(F.col("dd") > 0, 0).otherwise(1))}, keys, order)
    top = x.groupBy(*keys).agg(
        F.max_by(F.struct("dd", F.col(order).alias("t"), F.col("_pk").alias("p")), F.struct("dd", -F.col(order))).alias("m")
    )
    top = top.select(
        *keys, F.col("m.dd").alias("max_drawdown"), (-F.col("m.p.i")).alias("peak_index"),
        F.col("m.t").alias("trough_index"), F.col("m.p.e").alias("_top"),
    )
    back = x.join(top, keys).filter((F.col(order) >= F.col("trough_index")) & (F.col("eq") >= F.col("_top")))
    back = back.groupBy(*keys).agg(F.min(order).alias("_back"))
    under = x.groupBy(*keys, "_isl").agg(F.sum(F.when(F.col("dd") > 0, 1).otherwise(0)).alias("_len"))
    under = under.groupBy(*keys).agg(F.max("_len").alias("max_underwater"))
    return (
        top.join(back, keys, "left")
        .join(under, keys)
        .select(
            *keys, "max_drawdown", "peak_index", "trough_index",
            (F.col("trough_index") - F.col("peak_index")).alias("duration"),
            F.coalesce((F.col("_back") - F.col("trough_index")).cast("double"), F.lit(INF)).alias("time_to_recover"),
            "max_underwater",
        )
    )


def number_trades(trades: DataFrame, keys=("instrument",), order: str = "bar_index") -> DataFrame:
    """Dense trade number ``k`` in entry order."""
    return running(trades, {"_k": ("sum", F.lit(1))}, keys, order).withColumn("k", F.col("_k") - 1).drop("_k")


def worst_streak(trades: DataFrame, n: int, value: str = "ret_sigma", keys=("instrument",)) -> DataFrame:
    """Smallest sum of any ``n`` consecutive trades (of all, where fewer)."""
    keys = list(keys)
    x = framed(
        number_trades(trades.filter(F.col(value).isNotNull()), keys), n, {"_s": F.sum(value).over(w_last(n, keys, "k"))}, order="k"
    )
    full = F.when(F.col("k") >= n - 1, F.col("_s"))
    return x.groupBy(*keys).agg(F.coalesce(F.min(full), F.sum(value)).alias("worst_streak"))


def loss_streak(trades: DataFrame, value: str = "ret_sigma", keys=("instrument",)) -> DataFrame:
    """Longest run of non-positive trades."""
    keys = list(keys)
    lost = F.col(value) <= 0
    x = trades.filter(F.col(value).isNotNull())
    x = running(x, {"_isl": ("sum", F.when(lost, 0).otherwise(1))}, keys)
    runs = x.groupBy(*keys, "_isl").agg(F.sum(F.when(lost, 1).otherwise(0)).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("max_consecutive_losses"))


def trade_summary(trades: DataFrame, value: str = "ret_log", sigma: str = "ret_sigma", keys=("instrument",)) -> DataFrame:
    keys = list(keys)
    v, s = F.col(value), F.col(sigma)
    win, loss = F.when(v > 0, v), F.when(v < 0, v)
    a = trades.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n_trades"),
        F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.sum(win).alias("_w"), F.sum(loss).alias("_l"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.avg(v).alias("mean_trade"), F.avg(s).alias("expectancy_sigma"), F.stddev_samp(s).alias("_sd"),
        F.count(s).alias("_ns"),
    )
    med = quantiles(trades, keys, value, [0.5]).withColumnRenamed("q_0", "median_trade")
    p, n = F.col("hit_rate"), F.col("n_trades")
    se = F.col("_sd") / F.sqrt("_ns")
    return a.join(med, keys).select(
        *keys, "n_trades", "hit_rate", F.sqrt(p * (1 - p) / n).alias("hit_rate_se"),
        F.when(F.col("_l") < 0, F.coalesce(F.col("_w"), F.lit(0.0)) / -F.col("_l")).when(F.col("_w") > 0, INF).alias("profit_factor"),
        "avg_win", "avg_loss",
        F.when(F.col("avg_loss") != 0, F.abs(F.col("avg_win") / F.col("avg_loss"))).otherwise(INF).alias("win_loss_ratio"),
        "mean_trade", "median_trade", "expectancy_sigma", se.alias("expectancy_se"),
        F.when(F.col("_sd") > 0, F.col("expectancy_sigma") / se).alias("expectancy_t"),
    )


def sharpe_inputs(rets: DataFrame, value: str = "ret", keys=("instrument",)) -> DataFrame:
    a = rets.filter(F.col(value).isNotNull()).groupBy(*keys).agg(*moments(value))
    return a.select(*keys, "n", F.try_divide("mean", "sd").alias("sr"), "skew", "kurtosis")


def _var_term() -> Column:
    sr = F.col("sr")
    return 1.0 - F.col("skew") * sr + 0.25 * (F.col("kurtosis") - 1.0) * sr * sr


def psr(benchmark: float = 0.0) -> Column:
    """Probability that the true Sharpe ratio exceeds the benchmark."""
    var = _var_term()
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(var)
    return F.when((F.col("n") >= 2) & (var > 0), norm_cdf(z))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    if n_trials <= 1 or variance <= 0:
        return 0.0
    a, b = norm_ppf(1.0 - 1.0 / n_trials), norm_ppf(1.0 - 1.0 / (n_trials * math.e))
    return math.sqrt(variance) * ((1.0 - EULER) * a + EULER * b)


def dsr(n_trials: int, variance: float) -> Column:
    return psr(expected_max_sharpe(n_trials, variance))


def min_track_record(confidence: float = 0.95, benchmark: float = 0.0) -> Column:
    edge = F.col("sr") - benchmark
    var = _var_term()
    return F.when((edge > 0) & (var > 0), 1.0 + var * (norm_ppf(confidence) / edge) ** 2).otherwise(INF)


def wilson(n: Column, wins: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = norm_ppf(0.5 * (1.0 + confidence))
    p, den = wins / n, 1.0 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def win_rate_ci(trades: DataFrame, value: str = "ret_sigma", keys=("instrument",), confidence: float = 0.95) -> DataFrame:
    a = trades.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).alias("wins")
    )
    p = F.col("wins") / F.col("n")
    lo, hi = wilson(F.col("n"), F.col("wins"), confidence)
    return a.select(*keys, "n", "wins", F.sqrt(p * (1 - p) / F.col("n")).alias("se"), lo.alias("ci_low"), hi.alias("ci_high"))


def trades_needed(p0: Column, p1: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """Sample size to tell two win rates apart (two-sided)."""
    num = norm_ppf(1.0 - alpha / 2.0) * F.sqrt(p0 * (1 - p0)) + norm_ppf(power) * F.sqrt(p1 * (1 - p1))
    return F.when(p0 != p1, F.ceil(num * num / (p1 - p0) ** 2)).otherwise(2**31 - 1)


def regime_breakdown(rets: DataFrame, value: str = "ret_sigma", regime: str = "regime", keys=("instrument",)) -> DataFrame:
    keys = list(keys)
    total = rets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    v = F.col(value)
    a = rets.groupBy(*keys, regime).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.stddev_samp(v).alias("_sd"),
        F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    sr = F.when(F.col("_sd") > 0, F.col("mean") / F.col("_sd"))
    return a.join(total, keys).select(
        *keys, regime, "n", (F.col("n") / F.col("_all")).alias("share"), "mean", "total", F.col("_sd").alias("std"), sr.alias("sharpe"),
        (sr * math.sqrt(YEAR)).alias("sharpe_annualized"), "hit_rate",
    )


def fold_stability(folds: DataFrame, value: str, keys=("instrument",)) -> DataFrame:
    """Spread of a metric over folds; folds per key are few."""
    v = F.col(value)
    a = folds.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n_folds"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("fraction_positive"), F.min(v).alias("minimum"),
        F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("_q"), F.max(v).alias("maximum"),
    )
    t = F.when((F.col("n_folds") > 1) & (F.col("std") > 0), F.col("mean") / (F.col("std") / F.sqrt("n_folds")))
    return a.select(
        *keys, "n_folds", "mean", "std", t.alias("t_stat"), "fraction_positive", "minimum",
        F.col("_q")[1].alias("median"), "maximum", (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
    )
