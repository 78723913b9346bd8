"""Pooling of correlated scores.

While the score correlation is the equicorrelated prior (the default until more
than 60 complete bars are seen), the inverse has a closed form and pooling is one
``groupBy`` with four sums.  With an estimated correlation it is a small linear
solve per bar, done in array batches inside a fold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import dense, ew_corr


PRIOR, SHRINK, EVIDENCE_SD, ALIGN, CLAMP = 0.35, 0.15, 0.6, 0.05, 0.999
Z90 = 1.6448536269514722
c = F.col


def prior_rho(prior: float = PRIOR, shrink: float = SHRINK) -> float:
    return (1.0 - shrink) * prior


def evidence(score: Column) -> Column:
    """2 atanh of the clamped score."""
    return 2.0 * F.atanh(F.least(F.greatest(score, F.lit(-CLAMP)), F.lit(CLAMP)))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def quad(s_dd: Column, s_d: Column, s_de: Column, m: Column | int, rho: float) -> Column:
    """d' C^-1 v for an equicorrelated C: (sum(d v) - k sum(d) sum(v)) / (1 - rho)."""
    k = rho / (1.0 + (m - 1) * rho)
    return (s_dd - k * s_d * s_de) / (1.0 - rho)


def probabilities(temperature: float = 1.0, bias: float = 0.0, calibrate=None) -> dict[str, Column]:
    """From ``log_odds`` and ``ebe_full``: direction, se, probability and 90% band for that direction."""
    lo_ = c("log_odds")
    var = EVIDENCE_SD**2 * c("ebe_full")
    se = F.sqrt(var)
    kappa = 1.0 / F.sqrt(1.0 + math.pi / 8.0 * temperature**2 * var)

    def up(x):
        p = logistic((temperature * x + bias) * kappa)
        return p if calibrate is None else calibrate(p)

    d = F.signum(lo_).cast("long")
    mid, low, high = up(lo_), up(lo_ - Z90 * se), up(lo_ + Z90 * se)
    fwd = d >= 0
    p = F.when(fwd, mid).otherwise(1.0 - mid)
    a, b = F.when(fwd, low).otherwise(1.0 - high), F.when(fwd, high).otherwise(1.0 - low)
    live = c("n_live") > 0

    def clip01(x, e=0.0):
        return F.least(F.greatest(x, F.lit(e)), F.lit(1.0 - e))

    return {
        "direction": F.when(live, d).otherwise(0).cast("long"),
        "log_odds_se": F.when(live, se).otherwise(float("inf")),
        "p_success": F.when(live, clip01(p, 1e-6)).otherwise(0.5),
        "p_low": F.when(live, clip01(F.least(a, b))).otherwise(0.0),
        "p_high": F.when(live, clip01(F.greatest(a, b))).otherwise(1.0),
    }


def pool_log_odds(scores: DataFrame, n_engines: int, keys=("instrument", "bar_index"), rho: float | None = None, **kw) -> DataFrame:
    """Pooled log-odds of every bar under the equicorrelated prior.

    Engines that abstain have zero weight but still count in the matrix.
    """
    rho = prior_rho() if rho is None else rho
    live = c("valid") & (c("reliability") > 0)
    d = F.when(live, F.sqrt("reliability")).otherwise(0.0)
    e = F.when(live, evidence(c("score"))).otherwise(0.0)
    keys = list(keys)
    x = scores.withColumns({"_d": d, "_e": e, "_live": live})
    sign = F.signum("score")
    heavy = c("_live") & (F.abs("score") * c("reliability") > ALIGN)
    sums = {}
    for tag, side in (("u", sign > 0), ("n", sign < 0), ("z", F.lit(True))):
        ok = heavy & side
        sums[f"_m{tag}"] = F.sum(F.when(ok, 1).otherwise(0))
        sums[f"_q{tag}"] = F.sum(F.when(ok, c("reliability")).otherwise(0.0))
        sums[f"_s{tag}"] = F.sum(F.when(ok, c("_d")).otherwise(0.0))
    a = x.groupBy(*keys).agg(
        F.sum(F.when(c("_live"), 1).otherwise(0)).alias("n_live"),
        F.sum(c("_d") * c("_d")).alias("_dd"), F.sum("_d").alias("_sd"), F.sum(c("_d") * c("_d") * c("_e")).alias("_dde"),
        F.sum(c("_d") * c("_e")).alias("_de"), *[v.alias(k) for k, v in sums.items()],
    )
    return _finish(a, n_engines, rho, kw).select(*keys, *FUSED)


FUSED = ("n_live", "log_odds", "log_odds_se", "p_success", "p_low", "p_high", "ebe_full", "ebe", "direction")


def pool_array(x: DataFrame, col: str, n_engines: int, rho: float | None = None, **kw) -> DataFrame:
    """The same sums over an array of score structs on the bar's own row: no shuffle."""
    rho = prior_rho() if rho is None else rho
    live = F.filter(col, lambda e: e["valid"] & (e["reliability"] > 0))
    y = x.withColumn(
        "_p", F.transform(live, lambda e: F.struct(e["score"].alias("s"), e["reliability"].alias("r"), F.sqrt(e["reliability"]).alias("d"), evidence(e["score"]).alias("v")))
    )

    def total(f, arr="_p"):
        return F.aggregate(arr, F.lit(0.0), lambda a, e: a + f(e))

    heavy = lambda e: F.abs(e["s"]) * e["r"] > ALIGN
    y = y.withColumns(
        {
            "n_live": F.size("_p").cast("long"), "_dd": total(lambda e: e["r"]), "_sd": total(lambda e: e["d"]),
            "_dde": total(lambda e: e["r"] * e["v"]), "_de": total(lambda e: e["d"] * e["v"]),
            "_au": F.filter("_p", lambda e: heavy(e) & (e["s"] > 0)), "_an": F.filter("_p", lambda e: heavy(e) & (e["s"] < 0)),
            "_az": F.filter("_p", heavy),
        }
    )
    for t in "unz":
        y = y.withColumns({f"_m{t}": F.size(f"_a{t}"), f"_q{t}": total(lambda e: e["r"], f"_a{t}"), f"_s{t}": total(lambda e: e["d"], f"_a{t}")})
    return _finish(y, n_engines, rho, kw).drop(*[f"_{k}" for k in ("p", "dd", "sd", "dde", "de")], *[f"_{k}{t}" for k in "amqs" for t in "unz"])


def _finish(a: DataFrame, n_engines: int, rho: float, kw: dict) -> DataFrame:
    lo_ = quad(c("_dde"), c("_sd"), c("_de"), n_engines, rho)
    a = a.withColumns(
        {
            "log_odds": F.when(c("n_live") > 0, lo_).otherwise(0.0),
            "ebe_full": F.greatest(quad(c("_dd"), c("_sd"), c("_sd"), n_engines, rho), F.lit(1e-9)),
        }
    )

    def aligned(t):
        m = c(f"_m{t}")
        return F.when(m > 0, F.greatest(quad(c(f"_q{t}"), c(f"_s{t}"), c(f"_s{t}"), m, rho), F.lit(0.0))).otherwise(0.0)

    ebe = F.when(c("log_odds") > 0, aligned("u")).when(c("log_odds") < 0, aligned("n")).otherwise(aligned("z"))
    return a.withColumn("ebe", F.when(c("n_live") > 0, ebe).otherwise(0.0)).withColumns(probabilities(**kw))


def pool_weights(scores: DataFrame, n_engines: int, keys=("instrument", "bar_index"), rho: float | None = None) -> DataFrame:
    """Weight share and contribution of each engine, as maps per bar."""
    rho = prior_rho() if rho is None else rho
    live = c("valid") & (c("reliability") > 0)
    d = F.when(live, F.sqrt("reliability")).otherwise(0.0)
    e = F.when(live, evidence(c("score"))).otherwise(0.0)
    w = Window.partitionBy(*keys)  # nine rows per bar
    x = scores.withColumns({"_d": d, "_e": e})
    x = x.withColumns({"_sd": F.sum("_d").over(w), "_de": F.sum(c("_d") * c("_e")).over(w), "_dd": F.sum(c("_d") * c("_d")).over(w)})
    k = rho / (1.0 + (n_engines - 1) * rho)
    cd, cde = (c("_d") - k * c("_sd")) / (1.0 - rho), (c("_d") * c("_e") - k * c("_de")) / (1.0 - rho)
    ebe = F.greatest((c("_dd") - k * c("_sd") * c("_sd")) / (1.0 - rho), F.lit(1e-9))
    x = x.withColumns({"weight": c("_d") * cd / ebe, "contribution": c("_d") * cde})
    return x.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("engine", "weight"))).alias("weights"),
        F.map_from_entries(F.collect_list(F.struct("engine", "contribution"))).alias("contributions"),
    )


def complete_scores(scores: DataFrame, engines: list[str]) -> DataFrame:
    """Wide score columns of the bars on which every engine is valid, numbered in ``obs``."""
    x = scores.filter(c("valid") & c("engine").isin(*engines)).groupBy("instrument", "bar_index").pivot("engine", engines).agg(F.first("score"))
    whole = x.dropna(subset=engines)
    return dense(whole, F.lit(1))


def score_corr(scores: DataFrame, engines: list[str], halflife: float = 250.0, need: int = 60) -> DataFrame:
    """Pairwise score correlation in force on each complete bar: prior until more than ``need``."""
    x = complete_scores(scores, engines)
    r = ew_corr(x, engines, halflife, order="obs").join(x.select("instrument", "bar_index", "obs"), ["instrument", "bar_index"])
    return r.select(
        "instrument", "bar_index", "a", "b", (c("obs") + 1).alias("samples"),
        F.when(c("obs") + 1 > need, (1.0 - SHRINK) * c("corr")).otherwise(prior_rho()).alias("corr"),
    )


def fused_general(scores: DataFrame, engines: list[str], halflife: float = 250.0, need: int = 60) -> DataFrame:
    """Pooling with the estimated correlation, one ordered pass."""
    from .features import as_fold

    n = len(engines)
    x = scores.filter(c("engine").isin(*engines)).groupBy("instrument", "bar_index").pivot("engine", engines).agg(
        F.first("score").alias("s"), F.first("reliability").alias("r"), F.first(c("valid").cast("int")).alias("v")
    )
    lam = 2.0 ** (-1.0 / halflife)
    base = np.full((n, n), prior_rho())
    np.fill_diagonal(base, 1.0)

    def step(state, rows: pd.DataFrame):
        st = state or {"mean": [0.0] * n, "cov": np.eye(n).tolist(), "w": 0.0, "n": 0}
        mean, cov, w, seen = np.array(st["mean"]), np.array(st["cov"]), st["w"], st["n"]
        s = rows[[f"{e}_s" for e in engines]].to_numpy(dtype=float)
        rel = rows[[f"{e}_r" for e in engines]].to_numpy(dtype=float)
        ok = rows[[f"{e}_v" for e in engines]].to_numpy(dtype=float) > 0
        mats, count = np.empty((len(rows), n, n)), np.empty(len(rows), dtype=int)
        for i in range(len(rows)):
            if ok[i].all():
                w = lam * w + 1.0
                gap = s[i] - mean
                mean = mean + gap / w
                cov = (1.0 - 1.0 / w) * (cov + np.outer(gap, gap) / w)
                seen = min(seen + 1, need + 1)
            count[i] = seen
            if seen > need:
                dev = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
                m = np.clip(cov / np.outer(dev, dev), -0.999, 0.999) * (1.0 - SHRINK)
                np.fill_diagonal(m, 1.0)
                mats[i] = m
            else:
                mats[i] = base
        live = ok & (rel > 0)
        d = np.where(live, np.sqrt(np.where(live, rel, 0.0)), 0.0)
        e = np.where(live, 2.0 * np.arctanh(np.clip(np.where(live, s, 0.0), -CLAMP, CLAMP)), 0.0)
        sol = np.linalg.solve(mats, np.stack([d, d * e], axis=2))
        log_odds, ebe = (d * sol[:, :, 1]).sum(1), np.maximum((d * sol[:, :, 0]).sum(1), 1e-9)
        side = np.sign(log_odds)[:, None]
        near = live & (np.abs(np.where(live, s * rel, 0.0)) > ALIGN) & ((side == 0) | (np.sign(np.where(live, s, 0.0)) == side))
        # rows outside the aligned set become identity rows with zero load
        mask = near[:, :, None] & near[:, None, :]
        sub = np.where(mask, mats, 0.0) + np.where(near, 0.0, 1.0)[:, :, None] * np.eye(n)
        da = np.where(near, d, 0.0)
        breadth = np.maximum((da * np.linalg.solve(sub, da[:, :, None])[:, :, 0]).sum(1), 0.0)
        eig = np.linalg.eigvalsh(mats)
        off = np.abs(mats[:, ~np.eye(n, dtype=bool)])
        cols = {
            "n_live": live.sum(1), "log_odds": log_odds, "ebe_full": ebe, "ebe": breadth, "samples": count,
            "mean_abs_corr": off.mean(1), "max_abs_corr": off.max(1),
            "ebe_unit": np.linalg.solve(mats, np.ones((len(rows), n, 1))).sum(axis=(1, 2)), "condition": eig[:, -1] / eig[:, 0],
        }
        return {"mean": mean.tolist(), "cov": cov.tolist(), "w": w, "n": seen}, cols

    outs = {"n_live": "long", "samples": "long"} | {
        k: "double" for k in ("log_odds", "ebe_full", "ebe", "mean_abs_corr", "max_abs_corr", "ebe_unit", "condition")
    }
    return as_fold(x, {"pool": step}, ["instrument", "bar_index"], outs).withColumns(probabilities())


def breadth_diagnostics(fused: DataFrame) -> DataFrame:
    """Last state of the correlation per instrument."""
    cols = ("samples", "mean_abs_corr", "max_abs_corr", "ebe_unit", "condition")
    return fused.groupBy("instrument").agg(*[F.max_by(k, "bar_index").alias(k) for k in cols])


