"""The causal feature table.

One pass of block windows (``block_features``) gives everything with a bounded
look-back; one fold (``kernels.series``) gives the recursions.  All windows
share the partition and order of the block, so the plan has one shuffle and one
sort for the first part and one shuffle for the second.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, safe_div
from ..kernels import series as S
from ..kernels import windows as K
from ..session import checkpoint
from .bars import bar_columns, htf_bars, session_tag
from .rolling import ew_mean, ew_weight
from .sequence import fold, own_rows, w_block, w_last, with_lookback

BLOCK = 4096
# 252-row ranks of a 120-row statistic, and 64 half-lives of 10: the longest chains
LOOKBACK = 1024
GK = 2.0 * math.log(2.0) - 1.0
CS_K = 3.0 - 2.0 * math.sqrt(2.0)
MU_43 = 2.0 ** (2.0 / 3.0) * math.gamma(7.0 / 6.0) / math.gamma(0.5)
BNS_THETA = math.pi**2 / 4.0 + math.pi - 5.0
WARMUP = 100


def _log_of(a: Column | str, b: Column | str) -> Column:
    """Log of a price ratio; missing where a price is zero."""
    return F.log(F.try_divide(a, b))


def with_returns(x: DataFrame) -> DataFrame:
    w = w_block()
    x = x.withColumn("ret", _log_of("close", F.lag("close").over(w)))
    return x.withColumns({"r2": F.col("ret") ** 2, "aret": F.abs("ret")}).withColumns(
        {"a1": F.lag("aret").over(w), "a2": F.lag("aret", 2).over(w)}
    ).withColumn("bpv", F.col("aret") * F.col("a1"))


def volatility(
    x: DataFrame, n: int = 22, short: int = 5, long: int = 66, halflife: float = 10.0, block: int = BLOCK,
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2),
) -> DataFrame:
    """Volatility columns of a look-back frame that has ``with_returns`` columns."""
    c, wn, ws, wl = F.col, w_last(n), w_last(short), w_last(long)
    lo_c, hi_c = _log_of("low", "close"), _log_of("high", "close")
    hi_o, lo_o = _log_of("high", "open"), _log_of("low", "open")
    hl, co = _log_of("high", "low"), _log_of("close", "open")
    x = x.withColumns({"_rs": hi_c * hi_o + lo_c * lo_o, "_gk": 0.5 * hl * hl - GK * co * co})
    prefix = w_block().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns(
        {
            "_ok": (F.count("r2").over(wn) >= 2) & (F.count("r2").over(wl) >= min(long, 20)),
            "_rv": F.sqrt(F.avg("r2").over(wn)),
            "_bpn": F.count("bpv").over(wn),
            "_bp": F.sqrt(F.avg("bpv").over(wn) * (math.pi / 2.0)),
            "_rsm": F.when(F.count("_rs").over(wn) >= 2, F.sqrt(F.greatest(F.avg("_rs").over(wn), F.lit(0.0)))),
            "_gkm": F.when(F.count("_gk").over(wn) >= 2, F.sqrt(F.greatest(F.avg("_gk").over(wn), F.lit(0.0)))),
            "_ss": F.when(F.count("r2").over(ws) >= 2, F.sqrt(F.avg("r2").over(ws))),
            "_sl": F.when(F.count("r2").over(wl) >= 3, F.sqrt(F.avg("r2").over(wl))),
            "_ew": F.sqrt(ew_mean(c("r2"), ew_weight(halflife, block), prefix)),
        }
    )
    ok = lambda e: F.when(c("_ok"), e)
    raw_bp = F.when(c("_bpn") >= 2, c("_bp")).otherwise(c("_rv"))
    x = x.withColumns(
        {
            "sigma_rv": ok(c("_rv")),
            "sigma_bp": ok(F.when(raw_bp > 0, raw_bp).otherwise(F.greatest(c("_rv"), F.lit(1e-8)))),
            "sigma_rs": ok(c("_rsm")),
            "sigma_gk": ok(c("_gkm")),
            "sigma_ew": ok(c("_ew")),
            "sigma_short": ok(c("_ss")),
            "sigma_long": ok(c("_sl")),
        }
    )
    rv2 = c("sigma_rv") ** 2
    parts = list(zip(("sigma_short", "sigma_rv", "sigma_long"), weights))
    have = [F.when(c(p) > 0, F.lit(w)).otherwise(0.0) for p, w in parts]
    logs = [F.when(c(p) > 0, F.log(c(p)) * w).otherwise(0.0) for p, w in parts]
    fallback = F.array_min(F.filter(F.array("sigma_rs", "sigma_gk", "sigma_bp"), lambda v: v > 0))
    blend = F.when(sum(have[1:], have[0]) > 0, F.exp(sum(logs[1:], logs[0]) / sum(have[1:], have[0])))
    x = x.withColumns(
        {
            "jump_share": F.when(rv2 <= 0, 0.0).otherwise(clip((rv2 - c("sigma_bp") ** 2) / rv2, 0, 1)),
            "sigma_fcst": ok(F.greatest(F.coalesce(blend, fallback, F.lit(1e-6)), F.lit(1e-6))),
            "_logss": F.when(c("sigma_short") > 0, F.log("sigma_short")),
        }
    )
    x = x.withColumns(
        {
            "vol_ratio": safe_div(c("sigma_ew"), c("sigma_fcst")),
            "range_over_sigma": safe_div(hl, c("sigma_fcst")),
            "_comp": F.when(c("sigma_long") > 0, c("sigma_short") / c("sigma_long")),
            "_logf": F.log("sigma_fcst"),
        }
    )
    return x.drop("_ok", "_rv", "_bpn", "_bp", "_rsm", "_gkm", "_ss", "_sl", "_ew", "_rs", "_gk")


def jump_test(x: DataFrame, n: int = 22) -> DataFrame:
    """Ratio jump statistic with tripower quarticity."""
    c, wn = F.col, w_last(n)
    p = lambda a: F.pow(c(a), F.lit(4.0 / 3.0))
    x = x.withColumn("_tp", p("aret") * p("a1") * p("a2"))
    nbp, ntp = F.count("bpv").over(wn), F.count("_tp").over(wn)
    x = x.withColumns(
        {
            "_nbp": nbp, "_ntp": ntp, "_srv": F.sum("r2").over(wn), "_sbp": F.sum("bpv").over(wn),
            "_stp": F.sum("_tp").over(wn),
        }
    )
    bpv = math.pi / 2.0 * c("_sbp") * (c("_nbp") + 1) / c("_nbp")
    tq = c("_ntp") * MU_43 ** (-3.0) * c("_stp")
    ratio = F.greatest(F.lit(1.0), tq / (bpv * bpv))
    z = (1.0 - bpv / c("_srv")) / F.sqrt(BNS_THETA * ratio / c("_nbp"))
    usable = (c("_ntp") >= max(10, n // 3)) & (c("_srv") > 0) & (bpv > 0)
    x = x.withColumn("jump_z", F.when(usable, z))
    return x.drop("_tp", "_nbp", "_ntp", "_srv", "_sbp", "_stp")


def spread_terms(x: DataFrame) -> DataFrame:
    """Two-bar high-low and close-range spread estimates of bars t-1 and t."""
    c, w = F.col, w_block()
    x = x.withColumns({f"_p{k}": F.lag(k).over(w) for k in ("high", "low", "close")})
    hp, hn = _log_of("_phigh", "_plow"), _log_of("high", "low")
    h2 = _log_of(F.greatest("_phigh", "high"), F.least("_plow", "low"))
    beta, gamma = hp * hp + hn * hn, h2 * h2
    alpha = (F.sqrt(2.0 * beta) - F.sqrt(beta)) / CS_K - F.sqrt(gamma / CS_K)
    cs = 2.0 * (F.exp(alpha) - 1.0) / (1.0 + F.exp(alpha))
    eta_p, eta = 0.5 * (F.log("_phigh") + F.log("_plow")), 0.5 * (F.log("high") + F.log("low"))
    cov = (F.log("_pclose") - eta_p) * (F.log("_pclose") - eta)
    has = c("_phigh").isNotNull()
    x = x.withColumns(
        {
            "_cs": F.when(has, F.greatest(cs, F.lit(0.0))),
            "_ar": F.when(has, F.when(cov > 0, 2.0 * F.sqrt(cov)).otherwise(0.0)),
        }
    )
    return x.drop("_phigh", "_plow", "_pclose")


def path_efficiency(k: int = 22) -> tuple[Column, Column]:
    w = w_last(k)
    signed = F.when(F.count("ret").over(w) >= 5, safe_div(F.sum("ret").over(w), F.sum("aret").over(w)))
    return F.abs(signed), signed


def horizon_agreement(horizons=(5, 10, 20, 40, 80)) -> Column:
    w = w_block()
    signs = F.array(*[F.signum(F.log("close") - F.log(F.lag("close", h).over(w))) for h in horizons])
    have = F.array_compact(signs)
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have))


def ordinal_pattern() -> Column:
    """Pattern id 0..5 of three closes, ties by age."""
    w = w_block()
    a, b, c = F.lag("close", 2).over(w), F.lag("close", 1).over(w), F.col("close")
    return F.when(
        a.isNotNull(), F.when(b < a, 1).otherwise(0) + 2 * (F.when(c < a, 1).otherwise(0) + F.when(c < b, 1).otherwise(0))
    )


def perm_entropy(x: DataFrame, k: int = 60) -> DataFrame:
    w = w_last(k)
    x = x.withColumn("_pat", ordinal_pattern())
    x = x.withColumn("_n", F.count("_pat").over(w))
    # (b<a, number of later-below pairs) names all six orders: 0,1,2,3,4,5
    terms = None
    for i in range(6):
        p = F.sum(F.when(F.col("_pat") == i, 1).otherwise(0)).over(w) / F.col("_n")
        t = F.when(p > 0, -p * F.log(p)).otherwise(0.0)
        terms = t if terms is None else terms + t
    return x.withColumn("perm_entropy", F.when(F.col("_n") >= max(20, k // 3), terms / math.log(6.0))).drop("_pat", "_n")


# --------------------------------------------------------------------------- #
# order statistics of the block, as one Arrow pass

RANKED = (
    "participation", "participation_rank", "ladr", "ladr_rank", "absorption", "absorption_rank", "amihud",
    "amihud_rank", "kyle_lambda", "delta_norm", "spread", "spread_ar", "vol_rank", "compression", "vr_z",
    "hurst_implied", "vr_rank", "ret_kurtosis", "vol_of_vol",
)


def rank_columns(pdf: pd.DataFrame, ratio: str | None = None, w: int = 252, min_obs: int = 60, before: dict | None = None, level: int = 0) -> dict:
    """Participation, impact, absorption and rank columns of one sorted block.

    Windows hold the last present values, however far back those lie: ``before`` has, per input series, the last ``w`` present
    values in front of the block. A ``level`` above 0 gives the block's own last present values of the inputs that become exact
    with the carries of the levels below: 1 what a row alone decides, 2 what needs windows over level 1, 3 ranked readings.
    """
    import numpy as np

    f = {k: pdf[k].to_numpy(dtype=float) for k in ("ret", "sigma_bp", "dollar_volume", "volume", "delta", "_cs", "_ar", "_logf", "_comp", "_logss")}
    before = {k: np.array(v, dtype=float) for k, v in (before or {}).items()}
    none = np.zeros(0)

    def on(fn, name: str, x: np.ndarray, *args) -> np.ndarray:
        old = before.get(name, none)
        return fn(np.concatenate([old, x]), *args)[old.size :]

    def last(**series: np.ndarray) -> dict:
        return {k: v[~np.isnan(v)][-w:].tolist() for k, v in series.items()}

    with np.errstate(all="ignore"):
        dv = f["dollar_volume"]
        live = ~np.isnan(f["ret"]) & (f["sigma_bp"] > 0)
        paid = live & (dv > 0)
        amihud = np.where(paid, np.abs(f["ret"]) / dv, np.nan)
        share = np.where(live & (f["volume"] > 0), f["delta"] / f["volume"], np.nan)
        if level == 1:
            return last(
                dv=dv, amihud=np.log(amihud + 1e-300), share=np.abs(share), cs=f["_cs"], ar=f["_ar"], logf=f["_logf"], comp=f["_comp"], logss=f["_logss"], ret=f["ret"]
            )
        if ratio is None:
            med = on(K.quantile, "dv", dv, 60, 0.5, 5)
            part = np.where(med > 0, dv / med, np.nan)
        else:
            part = pdf[ratio].to_numpy(dtype=float)
        d = np.where(live, f["ret"] / f["sigma_bp"], np.nan)
        pos = np.where(part > 0, part, np.nan)
        mag = np.abs(d) / np.sqrt(pos)
        absorb = pos / (np.abs(d) + 1e-6)
        old = before.get("ret", none)
        vr_z, hurst = (v[old.size :] for v in K.variance_ratio(np.concatenate([old, f["ret"]])))
        if level == 2:
            return last(pos=pos, mag=mag, absorb=np.log1p(absorb), z=vr_z, h=hurst)
        # a reading holds until the next one, across blocks as well
        vr_z, hurst = on(K.hold, "z", vr_z), on(K.hold, "h", hurst)
        if level == 3:
            return last(vr=vr_z)
        scale = on(K.mad, "share", np.abs(share), 60)
        out = {
            "participation": part,
            "participation_rank": on(K.rank, "pos", pos, w, min_obs),
            "ladr": np.sign(f["ret"]) * mag,
            "ladr_rank": on(K.rank, "mag", mag, w, min_obs),
            "absorption": absorb,
            "absorption_rank": on(K.rank, "absorb", np.log1p(absorb), w, min_obs),
            "amihud": amihud,
            "amihud_rank": on(K.rank, "amihud", np.log(amihud + 1e-300), w, min_obs),
            "kyle_lambda": np.where(paid, np.abs(f["ret"]) / np.sqrt(dv), np.nan),
            "delta_norm": np.where(scale > 1e-12, share / scale, share),
            "spread": on(K.quantile, "cs", f["_cs"], 22, 0.5, 5),
            "spread_ar": on(K.quantile, "ar", f["_ar"], 22, 0.5, 5),
            "vol_rank": on(K.rank, "logf", f["_logf"], w, min_obs),
            "compression": 1.0 - on(K.rank, "comp", f["_comp"], w, min_obs),
            "vr_z": vr_z,
            "hurst_implied": hurst,
            "vr_rank": on(K.rank, "vr", vr_z, w, min_obs),
            "ret_kurtosis": on(K.kurtosis, "ret", f["ret"], 126, 31),
            "vol_of_vol": on(K.std, "logss", f["_logss"], 60, 10),
        }
    return out


LEVELS = 3


def carried(x: DataFrame, ratio: str | None, w: int = 252) -> DataFrame:
    """(instrument, blk, carries): the last ``w`` present values of every windowed series in front of each block, as JSON parts.

    A block gives its own last values; a fold over the blocks' short lists puts them together. Three levels, since what is
    ranked depends on medians of what came before. ``x`` is stored: own rows with ``blk``.
    """
    need = ["instrument", "blk", "bar_index", "ret", "sigma_bp", "dollar_volume", "volume", "delta", "_cs", "_ar", "_logf", "_comp", "_logss"] + ([ratio] if ratio else [])
    rows, known = x.select(*need), None

    def put_together(state, lists: pd.DataFrame):
        have, out = dict(state or {}), []
        for own in map(json.loads, lists["own"]):
            out.append(json.dumps(have))
            have = have | {k: (have.get(k, []) + v)[-w:] for k, v in own.items()}
        return have, lists[["instrument"]].assign(no=lists["seq"], carry=out)

    for level in range(1, LEVELS + 1):
        own = _with_carries(rows, known, _own_last(ratio, w, level), "instrument string, no long, own string")
        lists = own.select("instrument", "own", F.col("no").alias("seq"))
        new = fold(lists, put_together, "instrument string, no long, carry string", order="seq", block=256)
        new = new.select("instrument", F.col("no").alias("blk"), F.array("carry").alias("carries"))
        if known is not None:
            new = known.withColumnRenamed("carries", "old").join(new, ["instrument", "blk"]).select("instrument", "blk", F.concat("old", "carries").alias("carries"))
        known = checkpoint(new)
    return known


def _own_last(ratio: str | None, w: int, level: int):
    def run(group, pdf: pd.DataFrame, before: dict) -> pd.DataFrame:
        own = rank_columns(pdf, ratio, w, before=before, level=level)
        return pd.DataFrame({"instrument": [group[0]], "no": [group[1]], "own": [json.dumps(own)]})

    return run


def _with_carries(rows: DataFrame, carries: DataFrame | None, fn, schema: str) -> DataFrame:
    """``fn(key, sorted block, carry)`` for each (instrument, blk); ``carries`` has the block's JSON parts."""
    names = [k.split()[0] for k in schema.split(",")]

    def run(group, pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=names)
        before = {k: v for part in (given["carries"].iloc[0] if len(given) else ()) for k, v in json.loads(part).items()}
        return fn(group, pdf.sort_values("bar_index", kind="stable").reset_index(drop=True), before)

    by = rows.groupBy("instrument", "blk")
    if carries is None:
        return by.applyInPandas(lambda g, p: run(g, p, pd.DataFrame()), schema)
    return by.cogroup(carries.groupBy("instrument", "blk")).applyInPandas(run, schema)


BASE = (
    "open", "high", "low", "close", "volume", "delta", "ret", "dollar_volume", "clv", "sigma_bp", "sigma_rv",
    "sigma_rs", "sigma_gk", "sigma_ew", "sigma_short", "sigma_long", "sigma_fcst", "jump_share",
    "vol_ratio", "range_over_sigma", "ret_norm", "clv_ema", "jump_z", "efficiency", "trend_agree", "perm_entropy",
)
SESSION = ("dow", "phase", "tod_frac", "tod_bucket", "bars_since_open", "overnight_ret")


def block_frame(bars: DataFrame, lookback: int = LOOKBACK, block: int = BLOCK) -> DataFrame:
    """JVM part: every bounded-window feature, look-back rows still present."""
    x = with_lookback(bar_columns(bars), lookback, block)
    x = volatility(with_returns(x), block=block)
    x = spread_terms(jump_test(x))
    eff, _ = path_efficiency()
    prefix = w_block().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns(
        {
            "efficiency": eff,
            "trend_agree": horizon_agreement(),
            "clv_ema": ew_mean(F.col("clv"), ew_weight(5.0, block), prefix),
            "ret_norm": F.col("ret") / F.col("sigma_bp"),
        }
    )
    return perm_entropy(x)


def block_features(bars: DataFrame, profile: str = "daily", lookback: int = LOOKBACK, block: int = BLOCK) -> DataFrame:
    """All features with a bounded look-back, one row per bar."""
    tagged = session_tag(bars, profile)
    ratio = None
    if profile != "daily":
        from .rolling import bucketed_median

        dv = bar_columns(tagged).select("instrument", "bar_index", "tod_bucket", "dollar_volume")
        part = bucketed_median(dv, "dollar_volume", "tod_bucket", 60)
        tagged = tagged.join(part.select("instrument", "bar_index", F.col("ratio").alias("_part")), ["instrument", "bar_index"])
        ratio = "_part"
    x = block_frame(tagged, lookback, block)
    need = ["_cs", "_ar", "_logf", "_comp", "_logss"] + ([ratio] if ratio else [])
    types = dict(x.dtypes)
    keep = ["instrument", "ts", "bar_index", *SESSION, *BASE]
    x = x.filter("NOT halo").select(*keep, *need, "blk")
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + "".join(f", {k} double" for k in RANKED)

    def run(group, pdf: pd.DataFrame, before: dict) -> pd.DataFrame:
        return pdf[keep].assign(**rank_columns(pdf, ratio, before=before))

    longest = bars.agg(F.max("bar_index")).first()[0]
    if longest is None or longest < max(block, lookback):  # a block is a whole series: nothing lies in front of it
        return _with_carries(x, None, run, schema)
    x = checkpoint(x)
    return _with_carries(x, carried(x, ratio), run, schema)


# --------------------------------------------------------------------------- #
# recursions


def as_fold(df: DataFrame, steps: dict, keep: list[str], outs: dict[str, str], **kw):
    """Run several recursions in one ordered pass.

    ``steps`` maps a name to ``step(state, rows) -> (state, columns)``; later steps
    see the columns of earlier ones.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + "".join(f", {k} {t}" for k, t in outs.items())

    def kernel(state, rows: pd.DataFrame):
        state, nxt = state or {}, {}
        cols = {}
        for name, step in steps.items():
            nxt[name], got = step(state.get(name), rows)
            cols.update(got)
            rows = rows.assign(**got)
        return nxt, rows[keep + list(outs)]

    return fold(df, kernel, schema, **kw)


TREND_OUT = {"kalman_level": "double", "kalman_slope": "double", "kalman_slope_t": "double"}
PIVOT_OUT = {
    "pivot_high": "double", "pivot_low": "double", "pivot_high_age": "double", "pivot_low_age": "double",
    "structure_bias": "double", "range_pos": "double", "range_sigma": "double", "pivot_kind": "string",
    "pivot_index": "long", "pivot_price": "double", "retrace_sigma": "double",
}
SWEEP_OUT = {
    "swept_low": "double", "swept_high": "double", "sweep_level": "double", "penetration_index": "long",
    "penetration_sigma": "double",
}
RUN_OUT = {"run_asym": "double", "current_run": "long"}
REGIME_OUT = {
    "p0": "double", "p1": "double", "p2": "double", "p3": "double", "dominant": "long", "drift": "double",
    "ambiguity": "double", "hazard": "double", "temper": "double", "regime_valid": "boolean",
}


def htf_table(bars: DataFrame, multiple: int = 5, block: int = BLOCK) -> DataFrame:
    """Slope and range readings of completed higher-timeframe bars."""
    h = htf_bars(bars, multiple).withColumn("bar_index", F.col("htf_index"))
    x = volatility(with_returns(with_lookback(h, 512, block)), 11, 5, 33, 5.0, block)
    x = own_rows(x).select("instrument", "bar_index", "high", "low", "close", "sigma_bp")
    steps = {"kalman": S.kalman(), "pivots": S.pivots()}
    out = as_fold(x, steps, ["instrument", "bar_index"], TREND_OUT | PIVOT_OUT)
    return out.select(
        "instrument", F.col("bar_index").alias("htf_index"), F.col("kalman_slope_t").alias("htf_slope_t"),
        F.col("range_pos").alias("htf_range_pos"), F.col("structure_bias").alias("htf_structure_bias"),
    )


def htf_view(bars: DataFrame, multiple: int = 5) -> DataFrame:
    """Last completed higher-timeframe reading on every base bar."""
    last = F.floor((F.col("bar_index") + 1) / multiple) - 1
    return bars.withColumn("htf_index", last).join(htf_table(bars, multiple), ["instrument", "htf_index"], "left").drop("htf_index")


def feature_table(
    bars: DataFrame, profile: str = "daily", lookback: int = LOOKBACK, block: int = BLOCK, fold_block: int | None = None,
    regime: bool = True,
) -> DataFrame:
    """Every feature, plus the regime posterior, one row per bar."""
    x = block_features(bars, profile, lookback, block)
    x = x.withColumn("htf_index", F.floor((F.col("bar_index") + 1) / 5) - 1)
    x = x.join(htf_table(bars, 5), ["instrument", "htf_index"], "left").drop("htf_index")
    keep = x.columns
    steps = {"kalman": S.kalman(), "pivots": S.pivots(), "sweeps": S.sweeps(), "runs": S.run_asymmetry()}
    outs = TREND_OUT | PIVOT_OUT | SWEEP_OUT | RUN_OUT
    if regime:
        steps["regime"] = S.regime()
        outs = outs | REGIME_OUT
    kw = {} if fold_block is None else {"block": fold_block}
    x = as_fold(x, steps, keep, outs, **kw)
    x = nan_to_null(x)
    n = F.col("bar_index") + 1
    return x.withColumns(
        {
            "warmup_remaining": F.greatest(F.lit(0).cast("long"), WARMUP - n),
            "valid": (n >= WARMUP) & F.col("vol_rank").isNotNull() & F.col("ladr_rank").isNotNull() & F.col("sigma_fcst").isNotNull(),
        }
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t == "double"})


FEATURES = (
    "sigma_bp", "sigma_rv", "sigma_rs", "sigma_ew", "sigma_fcst", "jump_share", "vol_of_vol", "vol_rank", "vol_ratio",
    "compression", "range_over_sigma", "ret", "ret_norm", "participation", "ladr", "ladr_rank", "absorption",
    "absorption_rank", "amihud", "kyle_lambda", "clv_ema", "delta_norm", "kalman_level", "kalman_slope",
    "kalman_slope_t", "vr_z", "hurst_implied", "efficiency", "trend_agree", "pivot_high", "pivot_low",
    "pivot_high_age", "pivot_low_age", "range_pos", "htf_slope_t", "htf_range_pos", "swept_high", "swept_low",
    "perm_entropy", "ret_kurtosis", "run_asym", "tod_frac", "overnight_ret",
)


def feature_unpivot(features: DataFrame) -> DataFrame:
    """(feature, value) rows of present values."""
    long = features.unpivot(["instrument", "bar_index"], list(FEATURES), "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
