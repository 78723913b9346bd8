"""Causal rolling statistics: JVM window frames, array functions for order statistics.

Frames count rows.  Where NULLs can occur inside a series use :func:`dense`
first, which numbers the non-missing rows, so that "the last k" means the last
k values seen.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import windows as K
from .sequence import framed, framed_apply, own_rows, running, w_block, w_last, with_lookback

# weights below 2^-64 of the newest change no bit of a double sum
EW_HALFLIVES = 64


def dense(df: DataFrame, value: Column, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """Rows where ``value`` is present, numbered densely in ``obs``."""
    x = running(df, {"_seen": ("sum", F.when(value.isNotNull(), 1).otherwise(0))}, keys=keys)
    return x.filter(value.isNotNull()).withColumn("obs", F.col("_seen") - 1).drop("_seen")


def moments(value: Column, k: int, **w) -> dict[str, Column]:
    """mean, sample var/std, population skew and excess kurtosis over ``k`` rows."""
    win = w_last(k, **w)
    n = F.count(value).over(win)
    spread = F.var_pop(value).over(win)
    flat = spread <= 1e-300
    return {
        "mean": F.avg(value).over(win),
        "var": F.when(n >= 2, F.var_samp(value).over(win)),
        "std": F.when(n >= 2, F.stddev_samp(value).over(win)),
        "skew": F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(F.skewness(value).over(win))),
        "kurt": F.when(n >= 4, F.when(flat, F.lit(0.0)).otherwise(F.kurtosis(value).over(win))),
    }


def ew_weight(halflife: float, block: int, order: str = "bar_index") -> Column:
    """2^(i/h) counted from the start of the block."""
    return F.pow(F.lit(2.0), (F.col(order) - F.col("blk") * block) / float(halflife))


def ew_block(halflife: float) -> int:
    """Block length that keeps 2^(i/h) inside double range."""
    rows = int(EW_HALFLIVES * halflife) + 1
    return max(rows, min(4096, int(400 * halflife)))


def ew_mean(value: Column, weight: Column, win) -> Column:
    """Bias-corrected mean with weights doubling every half-life, over a block prefix."""
    return F.sum(value * weight).over(win) / F.sum(F.when(value.isNotNull(), weight)).over(win)


def ewma(
    df: DataFrame, cols: dict[str, Column], halflife: float, keys: Sequence[str] = ("instrument",), order: str = "bar_index"
) -> DataFrame:
    """Exponential means of series without inner gaps (see :func:`dense`)."""
    block = ew_block(halflife)
    x = with_lookback(df, int(EW_HALFLIVES * halflife) + 1, block, order)
    win = w_block(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    w = ew_weight(halflife, block, order)
    return own_rows(x.withColumns({n: ew_mean(v, w, win) for n, v in cols.items()}))


def ewma_sparse(df: DataFrame, value: Column, halflife: float, name: str) -> DataFrame:
    """Missing rows neither enter nor decay the mean and show the last reading."""
    seen = ewma(dense(df, value), {name: value}, halflife, order="obs").select("instrument", "bar_index", name)
    x = df.join(seen, ["instrument", "bar_index"], "left")
    return running(x, {name + "_held": ("last", F.col(name))}).drop(name).withColumnRenamed(name + "_held", name)


def ewvar(df: DataFrame, value: Column, halflife: float) -> DataFrame:
    """Variance about the previous exponential mean (the first value about itself)."""
    rows, block = 2 * int(EW_HALFLIVES * halflife) + 2, 2 * ew_block(halflife)
    x = with_lookback(df, rows, block)
    win = w_block().rowsBetween(Window.unboundedPreceding, 0)
    w = ew_weight(halflife, block)
    x = x.withColumn("_v", value).withColumn("ew_mean", ew_mean(F.col("_v"), w, win))
    ref = F.coalesce(F.lag("ew_mean").over(w_block()), F.col("_v"))
    x = x.withColumn("_d2", (F.col("_v") - ref) ** 2)
    return own_rows(x.withColumn("ew_var", ew_mean(F.col("_d2"), w, win)).drop("_v", "_d2"))


def ew_corr(df: DataFrame, cols: Sequence[str], halflife: float, keys=("instrument",), order="bar_index") -> DataFrame:
    """Exponentially weighted correlation of every pair, in long form.

    Rows with a missing member are skipped; number the rest with :func:`dense`.
    E[xy] - E[x]E[y] with weights 2^(i/h) equals the recursion about running means.
    """
    full = df
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    want = {f"m_{c}": F.col(c) for c in cols} | {f"q_{a}_{b}": F.col(a) * F.col(b) for a, b in pairs}
    want |= {f"s_{c}": F.col(c) * F.col(c) for c in cols}
    x = ewma(full, want, halflife, keys, order)

    def var(c: str) -> Column:
        return F.greatest(F.col(f"s_{c}") - F.col(f"m_{c}") ** 2, F.lit(1e-300))

    def corr(a: str, b: str) -> Column:
        c = (F.col(f"q_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) / (F.sqrt(var(a)) * F.sqrt(var(b)))
        return F.least(F.greatest(c, F.lit(-0.999)), F.lit(0.999))

    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr")) for a, b in pairs])
    return x.select(*keys, "bar_index", F.inline(items))


def order_stats(df: DataFrame, value: str, spec: dict[str, tuple], keys=("instrument",), order="bar_index") -> DataFrame:
    """Rank, quantile, MAD and robust z columns of one series.

    spec: ``{name: ("rank", w, min_obs) | ("quantile", w, q) | ("mad", w) | ("robust_z", w)}``
    """
    fns = {"rank": K.rank, "quantile": K.quantile, "mad": K.mad, "robust_z": K.robust_z}
    rows = max(s[1] for s in spec.values())
    src = dict(df.dtypes)
    head = [*keys, order] if order == "bar_index" else [*keys, order, "bar_index"]
    schema = ", ".join(f"{c} {src[c]}" for c in head) + "".join(f", {n} double" for n in spec)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].to_numpy(dtype=float)
        return pdf[head].assign(**{n: fns[s[0]](v, *s[1:]) for n, s in spec.items()})

    return framed_apply(df.select(*head, value), rows, fn, schema, keys, order)


def bucketed_median(df: DataFrame, value: str, bucket: str, window: int, min_obs: int = 5) -> DataFrame:
    """Ratio of a value to its own bucket's trailing median (itself included)."""
    keys = ("instrument", bucket)
    x = dense(df.select(*keys, "bar_index", value), F.col(value), keys)
    m = order_stats(x, value, {"median": ("quantile", window, 0.5, min_obs)}, keys, "obs")
    m = m.join(x, ["instrument", "bar_index", bucket, "obs"])
    return m.select(
        "instrument", "bar_index", bucket, F.when(F.col("median") > 0, F.col(value) / F.col("median")).alias("ratio")
    )


def extremes(df: DataFrame, value: str, k: int) -> DataFrame:
    win = w_last(k)
    return framed(df, k, {"min": F.min(value).over(win), "max": F.max(value).over(win)})
