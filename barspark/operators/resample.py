"""Resampling nulls: paths are rows, draws are hashes of (seed, path, t).

Every builder takes a return table with a dense ``t`` per key and gives rows
``(key, path, t, value)``; nothing is held per path, so paths times length
spreads over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_uniform
from .sequence import framed, number_rows, own_rows, quantiles, running, w_block, with_lookback  # noqa: F401


def series(rets: DataFrame, value: str = "ret") -> DataFrame:
    """(instrument, t, value, n) with missing values dropped and ``t`` dense."""
    x = rets.filter(F.col(value).isNotNull())
    x = running(x, {"_k": ("sum", F.lit(1))}).select(
        "instrument", (F.col("_k") - 1).cast("long").alias("t"), F.col(value).alias("value")
    )
    n = x.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))
    return x.join(n, "instrument")


def _paths(s: DataFrame, n_paths: int) -> DataFrame:
    return s.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_paths - 1).cast("long"))))


def _u(tag: str, seed: int) -> Column:
    return hash_uniform(seed, F.lit(tag), F.col("instrument"), F.col("path"), F.col("t"))


def _pick(idx: DataFrame, s: DataFrame) -> DataFrame:
    src = s.select("instrument", F.col("t").alias("idx"), "value")
    return idx.join(src, ["instrument", "idx"]).select("instrument", "path", "t", "idx", "value")


def bootstrap_iid(s: DataFrame, n_paths: int, seed: int = 0) -> DataFrame:
    idx = _paths(s.drop("value"), n_paths).withColumn("idx", F.floor(F.col("n") * _u("i", seed)))
    return _pick(idx, s)


def bootstrap_stationary(s: DataFrame, n_paths: int, block_len: float = 60.0, seed: int = 0) -> DataFrame:
    """Blocks of geometric length, wrapping at the end of the series."""
    x = _paths(s.drop("value"), n_paths)
    fresh = (F.col("t") == 0) | (_u("r", seed) < 1.0 / block_len)
    start = F.when(fresh, F.struct(F.floor(F.col("n") * _u("s", seed)).alias("at"), F.col("t").alias("t0")))
    x = running(x, {"_st": ("last", start)}, ("instrument", "path"), "t")
    return _pick(x.withColumn("idx", (F.col("_st.at") + F.col("t") - F.col("_st.t0")) % F.col("n")), s)


def permute_trades(s: DataFrame, n_paths: int, seed: int = 0) -> DataFrame:
    """Random order of the same multiset; ranks of uniforms are counted in slots of ~4096."""
    x = _paths(s, n_paths).withColumn("_u", _u("p", seed))
    slot = F.floor(F.col("_u") * (F.floor(F.col("n") / 4096) + 1))
    return number_rows(x, slot, ("_u", "t"), ("instrument", "path"), "pos").select(
        "instrument", "path", F.col("pos").alias("t"), F.col("t").alias("idx"), "value"
    )


def sign_scramble(s: DataFrame, n_paths: int, block_len: int = 60, within: bool = False, seed: int = 0) -> DataFrame:
    """Random signs, optionally after shuffling inside blocks of ``block_len``."""
    x = _paths(s, n_paths)
    if within:
        blk = F.floor(F.col("t") / block_len)
        w = Window.partitionBy("instrument", "path", "_b").orderBy("_u", "t")
        x = x.withColumn("_b", blk).withColumn("_u", _u("w", seed))
        x = x.withColumn("_to", F.col("_b") * block_len + F.row_number().over(w) - 1)
        x = x.withColumns({"idx": F.col("t"), "t": F.col("_to")}).drop("_b", "_u", "_to")
    else:
        x = x.withColumn("idx", F.col("t"))
    sign = F.when(_u("g", seed) < 0.5, -1.0).otherwise(1.0)
    return x.select("instrument", "path", F.col("t").cast("long"), F.col("idx").cast("long"), (sign * F.col("value")).alias("value"))


def path_stat(paths: DataFrame, *stats: Column, keys=("instrument",)) -> DataFrame:
    """Any aggregate per path."""
    return paths.groupBy(*keys, "path").agg(*stats)


def mc_pvalue(stats: DataFrame, observed: DataFrame, value: str = "stat", alternative: str = "greater", keys=("instrument",)) -> DataFrame:
    """(1 + hits) / (1 + paths) against ``observed(keys, observed)``."""
    keys = list(keys)
    x = stats.filter(F.col(value).isNotNull()).join(observed, keys)
    v, o = F.col(value), F.col("observed")
    if alternative == "two-sided":
        x = x.join(quantiles(stats, keys, value, [0.5]), keys)
        hit = F.abs(v - F.col("q_0")) >= F.abs(o - F.col("q_0"))
    else:
        hit = v >= o if alternative == "greater" else v <= o
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ((1.0 + F.sum(F.when(hit, 1).otherwise(0))) / (1.0 + F.count(F.lit(1)))).alias("p_value"),
    )


def bootstrap_ci(stats: DataFrame, value: str = "stat", alpha: float = 0.05, observed: DataFrame | None = None, keys=("instrument",)) -> DataFrame:
    """Percentile interval, or the basic one when ``observed`` is given."""
    keys = list(keys)
    q = quantiles(stats, keys, value, [alpha / 2.0, 1.0 - alpha / 2.0])
    if observed is None:
        return q.select(*keys, F.col("q_0").alias("low"), F.col("q_1").alias("high"))
    o = 2.0 * F.col("observed")
    return q.join(observed, keys).select(*keys, (o - F.col("q_1")).alias("low"), (o - F.col("q_0")).alias("high"))


def autocorrelation(s: DataFrame, max_lag: int = 10) -> DataFrame:
    """Biased autocorrelations at lags 1..max_lag from one windowed pass."""
    mean = s.groupBy("instrument").agg(F.avg("value").alias("_m"))
    d = s.join(mean, "instrument").withColumn("_d", F.col("value") - F.col("_m"))
    w = w_block(order="t")
    x = framed(d, max_lag, {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)}, order="t")
    a = x.groupBy("instrument").agg(
        F.sum(F.col("_d") ** 2).alias("_v"),
        *[F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_c{k}") for k in range(1, max_lag + 1)],
    )
    items = [F.struct(F.lit(k).alias("lag"), F.when(F.col("_v") > 0, F.col(f"_c{k}") / F.col("_v")).otherwise(0.0).alias("acf")) for k in range(1, max_lag + 1)]
    return a.select("instrument", F.inline(F.array(*items)))


# --------------------------------------------------------------------------- #
# GARCH(1,1) by a variance-targeted grid

MAX_PERSISTENCE = 0.9995
_GARCH_LOOKBACK = 45000  # 0.999^45000 is below 2^-64


def _likelihoods(rows: pd.DataFrame, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gaussian log likelihood of the block's own rows for every grid point."""
    e2 = rows["_e"].to_numpy(dtype=float) ** 2
    own = ~rows["halo"].to_numpy()
    h = np.full(omega.size, float(rows["_v"].iloc[0]))
    total = np.zeros(omega.size)
    for x, mine in zip(e2, own):
        if mine:
            total -= 0.5 * (np.log(2.0 * np.pi) + np.log(h) + x / h)
        h = omega + alpha * x + beta * h
    return total


def _search(d: DataFrame, grid, keep: list[str]) -> DataFrame:
    """Best (omega, alpha, beta) per instrument; blocks add their likelihoods."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        om, al, be = grid(pdf.iloc[0])
        ok = (om > 0) & (al >= 0) & (be >= 0) & (al + be < MAX_PERSISTENCE)
        om, al, be = om[ok], al[ok], be[ok]
        return pd.DataFrame(
            {"instrument": pdf["instrument"].iloc[0], "omega": om, "alpha": al, "beta": be, "ll": _likelihoods(pdf, om, al, be)}
        )

    x = with_lookback(d, _GARCH_LOOKBACK, order="t")
    # blocks with look-back rows only have nothing to add
    parts = x.groupBy("instrument", "blk").applyInPandas(
        run, "instrument string, omega double, alpha double, beta double, ll double"
    )
    tot = parts.groupBy("instrument", "omega", "alpha", "beta").agg(F.sum("ll").alias("ll"))
    best = tot.groupBy("instrument").agg(
        F.max_by(F.struct("omega", "alpha", "beta", "ll"), F.struct("ll", -F.col("alpha"), -F.col("beta"))).alias("b")
    )
    return best.select("instrument", "b.*")


def garch_fit(s: DataFrame) -> DataFrame:
    """mu, omega, alpha, beta and log likelihood: coarse grid, fine grid, then omega.

    Every grid point of every block of every instrument is one task's vector; a
    block starts 45,000 rows early, where the start value has decayed away.
    """
    m = s.groupBy("instrument").agg(F.avg("value").alias("mu"))
    d = s.join(m, "instrument").withColumn("_e", F.col("value") - F.col("mu"))
    v = d.groupBy("instrument").agg(F.avg(F.col("_e") ** 2).alias("_v"))
    d = d.join(v, "instrument").select("instrument", "t", "_e", "_v", "mu")

    # The parameter grids of the search.
    def coarse(r):
        a, b = (g.ravel() for g in np.meshgrid(np.linspace(0.005, 0.4, 24), np.linspace(0.3, 0.99, 36), indexing="ij"))
        return r["_v"] * (1.0 - a - b), a, b

    def fine(r):
        ga = np.clip(np.linspace(r["a0"] - 0.02, r["a0"] + 0.02, 9), 0.0, 0.95)
        gb = np.clip(np.linspace(r["b0"] - 0.03, r["b0"] + 0.03, 13), 0.0, 0.999)
        a, b = (g.ravel() for g in np.meshgrid(ga, gb, indexing="ij"))
        a, b = np.append(a, r["a0"]), np.append(b, r["b0"])
        return r["_v"] * (1.0 - a - b), a, b

    def scale(r):
        k = np.array([0.6, 0.8, 0.9, 1.0, 1.1, 1.25, 1.6])
        return r["o0"] * k, np.full(7, r["a0"]), np.full(7, r["b0"])

    def around(best):
        return d.join(best.select("instrument", F.col("omega").alias("o0"), F.col("alpha").alias("a0"), F.col("beta").alias("b0")), "instrument")

    from ..session import checkpoint

    one = checkpoint(_search(d, coarse, []))
    two = checkpoint(_search(around(one), fine, []))
    three = _search(around(two), scale, [])
    return three.join(m, "instrument").withColumn("persistence", F.col("alpha") + F.col("beta"))
