"""Queries of scores, pooling, targets, costs, sizing and the ledger.

The logic queries read ``score_inputs``: per-bar inputs of every branch, derived
from the bars by one set of expressions that both engines understand.  The
end-to-end queries read the real feature table.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.expr import sql_uniform
from ..operators import decide as D
from ..operators import label as L
from ..operators import pool as P
from ..operators import scores as S
from ..operators.features import REGIME_OUT, as_fold, nan_to_null
from ..kernels import series as K
from ..session import stored
from ..sources import fixtures as X
from .edge import tb_sql
from .features import CHAIN, PART, features
from .metrics import rr
from .registry import query

INPUTS = {
    "kalman_slope_t": "CASE WHEN U(kn) >= 0.1 THEN 6 * U(k) - 3 END",
    "htf_slope_t": "CASE WHEN U(hn) >= 0.2 THEN 6 * U(h) - 3 END",
    "trend_agree": "2 * U(ta) - 1",
    "vr_z": "6 * U(vz) - 3",
    "efficiency": "U(ef)",
    "ladr_rank": "CASE WHEN U(ln) >= 0.05 THEN U(lr) END",
    "ladr": "2 * U(la) - 1",
    "absorption_rank": "U(ar)",
    "participation": "3 * U(pa)",
    "vol_rank": "U(vr)",
    "vol_ratio": "0.8 + 0.6 * U(vo)",
    "vol_of_vol": "U(vv)",
    "compression": "U(co)",
    "range_pos": "CASE WHEN U(rn) >= 0.1 THEN U(rp) END",
    "htf_range_pos": "CASE WHEN U(gn) >= 0.3 THEN U(gp) END",
    "structure_bias": "CASE WHEN U(sn) >= 0.2 THEN floor(3 * U(sb)) - 1 END",
    "pivot_high_age": "floor(150 * U(ha))",
    "pivot_low_age": "floor(150 * U(lw))",
    "pivot_high": "CASE WHEN U(pn) >= 0.1 THEN close * (1 + 0.03 * U(ph)) END",
    "pivot_low": "CASE WHEN U(pm) >= 0.1 THEN close * (1 - 0.03 * U(pl)) END",
    "swept_low": "CASE WHEN U(sl) < 0.04 THEN 1 ELSE 0 END",
    "swept_high": "CASE WHEN U(sh) < 0.04 THEN 1 ELSE 0 END",
    "_w0": "0.05 + U(w0)", "_w1": "0.05 + U(w1)", "_w2": "0.05 + 0.5 * U(w2)", "_w3": "0.05 + U(w3)",
    "hazard": "0.5 * U(hz)",
    "phase": "floor(9 * U(fa))",
    "bars_since_open": "floor(10 * U(bo)) - 1",
    "tod_frac": "U(tf)",
    "dow": "floor(7 * U(dw))",
    "days_to_event": "CASE WHEN U(dn) >= 0.3 THEN 4 * U(de) - 0.5 END",
    "gamma_imbalance": "CASE WHEN U(gi) >= 0.3 THEN 2.4 * U(ga) - 1.2 END",
    "oi_change": "CASE WHEN bar_index % 2 = 0 THEN U(oi) END",
    "spread_feed": "CASE WHEN U(fn) >= 0.5 THEN 0.002 * U(fs) END",
    "spread": "0.001 * U(sp)",
    "range_over_sigma": "CASE WHEN U(on) >= 0.1 THEN 6 * U(os) END",
    "mean": "0.6 * U(me) - 0.1",
    "_lo": "0.3 * U(lc)",
    "outcome_var": "1 + 4 * U(ov)",
    "var_mean": "0.1 * U(vm)",
    "n_eff": "60 * U(ne)",
    "brier": "0.2 + 0.1 * U(br)",
    "psi": "0.4 * U(ps)",
    "slippage_ratio": "1 + 1.5 * U(sr)",
    "stale_bars": "floor(6 * U(st))",
    "loss_streak": "floor(16 * U(ls))",
    "n_trades": "floor(200 * U(nt))",
    "drawdown": "0.35 * U(dd)",
    "_rv": "U(rv)", "_va": "U(va)",
}


def _text(e, u):
    return re.sub(r"U\((\w+)\)", lambda m: u(m.group(1)), e)


def _spark_u(t):
    return f"(CAST(conv(substring(md5(concat_ws(':', '{t}', instrument, CAST(bar_index AS STRING))), 1, 8), 16, 10) AS DOUBLE) / 4294967296D)"


def _duck_u(t):
    return sql_uniform(f"'{t}'", "instrument", "bar_index")


def _inputs(spark, sf):
    f = features(spark, sf).select(
        "instrument", "bar_index", "open", "high", "low", "close", F.round("ret", 12).alias("ret"), F.round("ret_norm", 9).alias("ret_norm"),
        F.round("jump_share", 9).alias("jump_share"), F.round("sigma_fcst", 10).alias("sigma_fcst"), F.round("clv_ema", 9).alias("clv_ema"),
        F.round("sigma_bp", 10).alias("sigma_bp"), "ts",
    )
    x = f.withColumns({k: F.expr(f"round(CAST({_text(e, _spark_u)} AS DOUBLE), 6)") for k, e in INPUTS.items()})
    tot = F.col("_w0") + F.col("_w1") + F.col("_w2") + F.col("_w3")
    x = x.withColumns({f"p{i}": F.round(F.col(f"_w{i}") / tot, 6) for i in range(3)})
    x = x.withColumn("p3", F.round(1.0 - F.col("p0") - F.col("p1") - F.col("p2"), 6))
    top = F.greatest("p0", "p1", "p2", "p3")
    dom = F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).when(F.col("p2") == top, 2).otherwise(3)
    return x.withColumns(
        {
            "dominant": dom.cast("long"), "ambiguity": F.round(1.0 - top, 6), "lcb": F.round(F.col("mean") - F.col("_lo"), 6),
            "regime_valid": F.col("_rv") > 0.05, "valid": (F.col("bar_index") >= 100) & (F.col("_va") > 0.02),
        }
    ).drop("_w0", "_w1", "_w2", "_w3", "_lo", "_rv", "_va")


def inputs(spark, sf):
    return stored(lambda: _inputs(spark, sf), spark, X._name("score_inputs", sf))


SI = f"""{CHAIN}, si0 AS (SELECT instrument, bar_index, ts, open, high, low, close, round(ret, 12) AS ret, round(d, 9) AS ret_norm, round(jump_share, 9) AS jump_share, round(sigma_fcst, 10) AS sigma_fcst,
   round(clv_ema, 9) AS clv_ema, round(sigma_bp, 10) AS sigma_bp, {", ".join(f"round(CAST({_text(e, _duck_u)} AS DOUBLE), 6) AS {k}" for k, e in INPUTS.items())} FROM v3),
  si1 AS (SELECT *, round(_w0 / (_w0 + _w1 + _w2 + _w3), 6) AS p0, round(_w1 / (_w0 + _w1 + _w2 + _w3), 6) AS p1, round(_w2 / (_w0 + _w1 + _w2 + _w3), 6) AS p2 FROM si0),
  si2 AS (SELECT *, round(1.0 - p0 - p1 - p2, 6) AS p3 FROM si1), si3 AS (SELECT *, greatest(p0, p1, p2, p3) AS top FROM si2),
  si AS (SELECT *, CASE top WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END::BIGINT AS dominant, round(1.0 - top, 6) AS ambiguity, round(mean - _lo, 6) AS lcb, _rv > 0.05 AS regime_valid,
    bar_index >= 100 AND _va > 0.02 AS valid FROM si3)"""
KEYS = ["instrument", "bar_index"]


def clip(e, lo, hi):
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, {lo}), {hi}) END"


def scored(score, rel, abstain="false", frm="si"):
    """Contract wrapped around a score and a reliability."""
    return f"""SELECT instrument, bar_index, round(CASE WHEN ok THEN least(greatest(s, -1), 1) ELSE 0 END, 7) AS score, round(CASE WHEN ok THEN least(greatest(rl, 0), 1) ELSE 0 END, 7) AS reliability, ok AS valid
     FROM (SELECT instrument, bar_index, s, rl, coalesce(valid AND NOT ({abstain}) AND s IS NOT NULL AND rl IS NOT NULL, false) AS ok FROM (SELECT *, CAST({score} AS DOUBLE) AS s, CAST({rel} AS DOUBLE) AS rl FROM {frm}))"""


def one(x, fn):
    y = x.select(*KEYS, fn().alias("s"))
    return y.select(*KEYS, F.round("s.score", 7).alias("score"), F.round("s.reliability", 7).alias("reliability"), F.col("s.valid").alias("valid"))


_TP = [("tanh(kalman_slope_t / 2)", "kalman_slope_t", 0.45), ("trend_agree", "trend_agree", 0.25), ("tanh(htf_slope_t / 2)", "htf_slope_t", 0.3)]
TREND_S = "(" + " + ".join(f"coalesce({v} * {w}, 0)" for v, _, w in _TP) + ") / nullif(" + " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0 END" for _, n, w in _TP) + ", 0)"
TREND_R = f"""({clip('0.25 + 0.75 * p0', 0, 1)}) * ({clip(f"0.15 + 0.85 * coalesce({clip('0.5 + vr_z / 4', 0, 1)}, 0.5)", 0, 1)}) * ({clip('0.45 + 0.55 * coalesce(efficiency, 0.3)', 0, 1)})
  * CASE WHEN htf_slope_t IS NOT NULL AND kalman_slope_t IS NOT NULL AND (htf_slope_t >= 0) <> (kalman_slope_t >= 0) THEN 0.45 ELSE 1 END * (1 - 0.6 * p1)"""


@query("score_trend", f"{SI} {scored(TREND_S, TREND_R)}")
def score_trend(spark, sf):
    return one(inputs(spark, sf), S.trend)


MOM = f"""{SI}, mo0 AS (SELECT *, CASE WHEN valid AND ladr_rank IS NOT NULL THEN sign(ladr) * greatest(2 * ladr_rank - 1, 0) END AS inst FROM si),
  mo1 AS (SELECT *, count(inst) OVER ({PART}) AS n, list(inst) OVER ({PART} ROWS 160 PRECEDING) AS xs FROM mo0),
  mo AS (SELECT *, CASE WHEN inst IS NOT NULL THEN list_reduce(list_filter(xs, lambda x: x IS NOT NULL), lambda a, v: 0.65::DOUBLE * a + 0.35::DOUBLE * v) END AS ema FROM mo1)"""
MOM_S = f"(0.5 * inst + 0.3 * ema + coalesce(0.2 * ({clip('clv_ema', -1, 1)}), 0)) / (0.8 + CASE WHEN clv_ema IS NOT NULL THEN 0.2 ELSE 0 END)"
MOM_R = f"""({clip('0.2 + 0.8 * greatest(2 * ladr_rank - 1, 0)', 0, 1)}) * ({clip('0.35 + 0.65 * p0', 0, 1)}) * (1 - 0.5 * p1) * (1 - 0.7 * p3) * coalesce({clip('1 - 0.5 * jump_share', 0.4, 1)}, 1)"""


@query("score_momentum", f"{MOM} {scored(MOM_S, MOM_R, 'ladr_rank IS NULL', 'mo')}")
def score_momentum(spark, sf):
    return one(S.with_state(inputs(spark, sf)), S.momentum)


LIQ = f"""{SI}, lq0 AS (SELECT *, sum(valid::INT) OVER ({PART}) AS vn, CASE WHEN valid THEN CASE WHEN swept_low > 0 THEN 1 WHEN swept_high > 0 THEN -1 END END AS sw FROM si),
  lq1 AS (SELECT *, last_value(CASE WHEN sw IS NOT NULL THEN {{'vn': vn, 'd': sw, 'p': participation}} END IGNORE NULLS) OVER ({PART}) AS l FROM lq0),
  lq2 AS (SELECT *, least(coalesce(vn - l.vn, 999), 999) AS age FROM lq1),
  lq3 AS (SELECT *, CASE WHEN age <= 4 THEN l.d * ({clip('0.45 + 0.25 * ln(1 + greatest(coalesce(l.p, 1) - 1, 0))', 0, 1)}) * (1 - age / 5.0::DOUBLE) ELSE 0 END AS ss,
    coalesce(absorption_rank > 0.65 AND abs(range_pos - 0.5) * 2 > 0.5, false) AS ab FROM lq2),
  lq4 AS (SELECT *, CASE WHEN ab THEN -sign(range_pos - 0.5) * ({clip('(absorption_rank - 0.65) / 0.35 * abs(range_pos - 0.5) * 2', 0, 1)}) ELSE 0 END AS ac FROM lq3),
  lq AS (SELECT *, CASE WHEN ss <> 0 AND ac <> 0 THEN 0.7 * ss + 0.3 * ac ELSE ss + ac END AS sc, ss <> 0 OR ab AS seen FROM lq4)"""
LIQ_R = f"CASE WHEN seen THEN ({clip('0.3 + 0.7 * abs(sc)', 0, 1)}) * ({clip('0.4 + 0.6 * (p1 + 0.6 * p2)', 0, 1)}) * (1 - 0.35 * p0) ELSE 0.35 END"


@query("score_liquidity", f"{LIQ} {scored('CASE WHEN seen THEN sc ELSE 0 END', LIQ_R, 'false', 'lq')}")
def score_liquidity(spark, sf):
    return one(S.with_state(inputs(spark, sf)), S.liquidity)


VOL_S = f"CASE WHEN vol_ratio > 1.15 AND abs(ret_norm) > 0.5 THEN {clip('0.35 * tanh(ret_norm / 2)', -0.4, 0.4)} ELSE 0 END"
FAV = f"coalesce({clip('1 - 2 * greatest(0.25 - vol_rank, vol_rank - 0.8, 0) / 0.55', -1, 1)}, 0)"
VOL_R = f"({clip(f'0.35 + 0.45 * ({clip(f'({FAV} + 1) / 2', 0, 1)})', 0, 1)}) * coalesce({clip(f'1 - 0.8 * ({clip('vol_of_vol / 0.7', 0, 1)})', 0.3, 1)}, 1) * (1 - 0.4 * p2)"


@query("score_volatility", f"{SI} {scored(VOL_S, VOL_R)}")
def score_volatility(spark, sf):
    return one(inputs(spark, sf), S.volatility)


STRUCT = f"""{SI}, sr0 AS (SELECT *, (p0 - p1) / (p0 + p1 + 2e-9) AS lean, 2 * range_pos - 1 AS pos FROM si),
  sr1 AS (SELECT *, CASE WHEN htf_range_pos IS NOT NULL THEN 0.7 * lean * pos + 0.3 * ({clip('lean * (2 * htf_range_pos - 1)', -1, 1)}) ELSE lean * pos END AS q FROM sr0),
  sr AS (SELECT *, CASE WHEN structure_bias IS NOT NULL THEN 0.75 * q + 0.25 * structure_bias ELSE q END AS sc FROM sr1)"""
STRUCT_R = f"({clip('0.25 + 0.75 * abs(pos)', 0, 1)}) * ({clip('0.35 + 0.65 * abs(p0 - p1) / greatest(p0 + p1, 1e-9)', 0, 1)}) * ({clip('1 - (greatest(pivot_high_age, pivot_low_age) - 20) / 120', 0.25, 1)})"


@query("score_structure", f"{STRUCT} {scored('sc', STRUCT_R, 'range_pos IS NULL', 'sr')}")
def score_structure(spark, sf):
    return one(inputs(spark, sf), S.structure)


TRUST = "[1.0, 0.0, 0.0, 0.95, 0.7, 0.9, 0.0, 0.0, 0.25][CAST(phase AS INT) + 1]"
BEH_S = f"CASE WHEN phase = 4 AND range_pos IS NOT NULL THEN {clip('-0.3 * (2 * range_pos - 1)', -0.3, 0.3)} ELSE 0 END"
BEH_R = clip(f"{TRUST} * CASE WHEN days_to_event <= 0 THEN 0 WHEN days_to_event < 1 THEN 0.25 WHEN days_to_event < 2 THEN 0.65 ELSE 1 END * CASE WHEN bars_since_open >= 0 AND bars_since_open < 3 THEN 0.5 + 0.15 * bars_since_open ELSE 1 END", 0, 1)


@query("score_behavioral", f"{SI} {scored(BEH_S, BEH_R)}")
def score_behavioral(spark, sf):
    return one(inputs(spark, sf), S.behavioral)


REG_S = f"{clip('0.5 * (coalesce(p0 * tanh(kalman_slope_t / 2), 0) + coalesce(p1 * (0.5 - range_pos) * 2, 0))', -1, 1)}"


@query("score_regime", f"{SI} {scored(REG_S, clip('(1 - ambiguity) * (1 - hazard)', 0, 1), 'NOT regime_valid')}")
def score_regime(spark, sf):
    return one(inputs(spark, sf), S.regime)


POS = f"""{SI}, po0 AS (SELECT *, {clip('gamma_imbalance', -1, 1)} AS g, list(CASE WHEN valid THEN oi_change END) OVER ({PART} ROWS 1023 PRECEDING) AS l0 FROM si),
  po1 AS (SELECT *, list_filter(l0, lambda x: x IS NOT NULL) AS l1 FROM po0), po2 AS (SELECT *, l1[greatest(len(l1) - 251, 1):] AS l2 FROM po1),
  po3 AS (SELECT *, CASE WHEN valid AND oi_change IS NOT NULL AND len(l2) >= 40 THEN (len(list_filter(l2, lambda x: x < oi_change)) + 0.5::DOUBLE * len(list_filter(l2, lambda x: x = oi_change))) / len(l2) END AS oir FROM po2),
  po4 AS (SELECT *, g IS NOT NULL AND ret_norm IS NOT NULL AS hg, coalesce(oir > 0.75 AND ret <> 0, false) AS ho FROM po3),
  po AS (SELECT *, CASE WHEN hg THEN -g * tanh(ret_norm / 2) * 0.7 ELSE 0 END + CASE WHEN ho THEN sign(ret) * 0.3 * (oir - 0.75) / 0.25 ELSE 0 END AS s0, CASE WHEN hg THEN 0.7 ELSE 0 END + CASE WHEN ho THEN 0.3 ELSE 0 END AS w FROM po4)"""
POS_S, POS_R = f"CASE WHEN w > 0 THEN {clip('s0 / nullif(w, 0)', -1, 1)} ELSE 0 END", f"CASE WHEN w > 0 THEN {clip('0.15 + 0.35 * w', 0, 0.45)} ELSE 0.1 END"


@query("score_positioning", f"{POS} {scored(POS_S, POS_R, 'gamma_imbalance IS NULL AND oi_change IS NULL', 'po')}")
def score_positioning(spark, sf):
    return one(S.with_side_data(inputs(spark, sf), peers=False), S.positioning)


def with_peers(spark, sf, x):
    from ..operators import bars as B

    r = B.returns(X.lineitem_bars(spark, sf)).select("instrument", "ts", "bar_index", "ret")
    p = B.peer_returns(r).select("instrument", "bar_index", "peers")
    return x.join(p, KEYS)


_EWS = {"ea": "own", "eb": "m", "eaa": "own*own", "ebb": "m*m", "eab": "own*m"}
CROSS = f"""{SI}, pr0 AS (SELECT a.instrument, a.bar_index, a.ret / a.sigma_bp AS own, b.instrument AS peer, ln_b.ret AS m, row_number() OVER (PARTITION BY a.instrument, a.bar_index ORDER BY b.instrument) AS k
    FROM si a JOIN bars b ON a.ts = b.ts AND a.instrument <> b.instrument JOIN r ln_b ON ln_b.instrument = b.instrument AND ln_b.bar_index = b.bar_index
    WHERE a.valid AND a.ret IS NOT NULL AND a.sigma_bp > 0 AND ln_b.ret IS NOT NULL),
  ps0 AS (SELECT instrument, bar_index, any_value(own) AS own, string_agg(peer, '|' ORDER BY peer) AS st FROM pr0 WHERE k <= 8 GROUP BY 1, 2),
  ps1 AS (SELECT *, CASE WHEN lag(st) OVER ({PART}) IS DISTINCT FROM st THEN 1 ELSE 0 END AS ch FROM ps0),
  ps2 AS (SELECT *, sum(ch) OVER ({PART}) AS run FROM ps1), ps3 AS (SELECT *, row_number() OVER (PARTITION BY instrument, run ORDER BY bar_index) AS seen FROM ps2),
  pl AS (SELECT p.*, run, seen FROM pr0 p JOIN ps3 USING (instrument, bar_index) WHERE k <= 8),
  pe AS (SELECT *, {", ".join(f"sum({e} * pow(2.0::DOUBLE, seen / 120.0::DOUBLE)) OVER w / sum(pow(2.0::DOUBLE, seen / 120.0::DOUBLE)) OVER w AS {n}" for n, e in _EWS.items())} FROM pl WINDOW w AS (PARTITION BY instrument, run, peer ORDER BY seen)),
  px AS (SELECT instrument, bar_index, count(*) AS n_peers, any_value(own) AS own, any_value(seen) AS seen, avg(0.95 * least(greatest((eab - ea*eb) / sqrt(greatest(eaa - ea*ea, 1e-300) * greatest(ebb - eb*eb, 1e-300)), -0.999), 0.999) * m) AS ex FROM pe GROUP BY 1, 2)"""


@query("score_crossasset", f"{CROSS} SELECT instrument, bar_index, n_peers, round(CASE WHEN seen > 40 THEN ex END, 9) AS expected, round(CASE WHEN seen > 40 THEN -tanh((own - ex) / 2) ELSE 0 END, 6) AS score, round(CASE WHEN seen > 40 THEN {clip('0.2 + 0.45 * least(n_peers / 4.0, 1)', 0, 0.65)} ELSE 0.15 END, 7) AS reliability FROM px")
def score_crossasset(spark, sf):
    x = with_peers(spark, sf, inputs(spark, sf))
    y = S.with_side_data(x).filter("valid AND _n_peers > 0 AND ret IS NOT NULL AND sigma_bp > 0")
    z = y.select(*KEYS, F.col("_n_peers").cast("long").alias("n_peers"), F.round("_expected", 9).alias("expected"), S.crossasset().alias("s"))
    return z.select(*KEYS, "n_peers", "expected", F.round("s.score", 6).alias("score"), F.round("s.reliability", 7).alias("reliability"))


@query(
    "score_contract",
    f"""{SI} SELECT instrument, bar_index, round(coalesce(tanh(vr_z / 2), 0), 8) AS squash, round(coalesce({clip('2 * (vol_rank - 0.2) / 0.6 - 1', -1, 1)}, 0), 8) AS linear, round({FAV}, 8) AS band,
      CASE WHEN bar_index < 4 THEN 'warmup' WHEN NOT valid THEN 'features invalid' WHEN kalman_slope_t IS NULL THEN 'non-finite score' ELSE 'ok' END AS state, round(CASE WHEN valid AND kalman_slope_t IS NOT NULL THEN least(greatest(kalman_slope_t, -1), 1) ELSE 0 END, 7) AS score FROM si""",
)
def score_contract(spark, sf):
    e = S.engine("probe", 5, F.col("kalman_slope_t"), F.lit(0.5))
    x = inputs(spark, sf).withColumn("e", e)
    return x.select(
        *KEYS, F.round(S.squash(F.col("vr_z"), 2.0), 8).alias("squash"), F.round(S.linear_score(F.col("vol_rank"), 0.2, 0.8), 8).alias("linear"),
        F.round(S.band_score(F.col("vol_rank"), 0.25, 0.8), 8).alias("band"),
        F.when(F.col("e.valid"), "ok").otherwise(F.col("e.notes")[0]).alias("state"), F.round("e.score", 7).alias("score"),
    )


# all engines that need no peers, as one long table
CORE = ("regime", "trend", "momentum", "liquidity", "volatility", "structure", "behavioral")


def _scores(spark, sf):
    return S.score_table(S.with_state(inputs(spark, sf)), CORE)


def scores(spark, sf):
    return stored(lambda: _scores(spark, sf), spark, X._name("scores", sf))


def _arm(name, chain_end, score, rel, abstain="false"):
    return f"SELECT '{name}' AS engine, * FROM ({scored(score, rel, abstain, chain_end).replace('round(CASE WHEN ok THEN least(greatest(s, -1), 1) ELSE 0 END, 7)', 'CASE WHEN ok THEN least(greatest(s, -1), 1) ELSE 0 END').replace('round(CASE WHEN ok THEN least(greatest(rl, 0), 1) ELSE 0 END, 7)', 'CASE WHEN ok THEN least(greatest(rl, 0), 1) ELSE 0 END')})"


def _tail(chain):
    return chain[len(SI):]


SC = f"""{SI}{_tail(MOM)}{_tail(LIQ)}{_tail(STRUCT)}, sco AS (
  {_arm('regime', 'si', REG_S, clip('(1 - ambiguity) * (1 - hazard)', 0, 1), 'NOT regime_valid')} UNION ALL {_arm('trend', 'si', TREND_S, TREND_R)} UNION ALL {_arm('momentum', 'mo', MOM_S, MOM_R, 'ladr_rank IS NULL')}
  UNION ALL {_arm('liquidity', 'lq', 'CASE WHEN seen THEN sc ELSE 0 END', LIQ_R)} UNION ALL {_arm('volatility', 'si', VOL_S, VOL_R)} UNION ALL {_arm('structure', 'sr', 'sc', STRUCT_R, 'range_pos IS NULL')} UNION ALL {_arm('behavioral', 'si', BEH_S, BEH_R)})"""
RHO = repr(P.prior_rho())
NE = 9


def _quad(dv, sd, sv, m):
    return f"(({dv}) - {RHO} / (1 + ({m} - 1) * {RHO}) * ({sd}) * ({sv})) / (1 - {RHO})"


POOL = f"""{SC}, se0 AS (SELECT *, valid AND reliability > 0 AS live, CASE WHEN valid AND reliability > 0 THEN sqrt(reliability) ELSE 0 END AS dd, CASE WHEN valid AND reliability > 0 THEN 2 * atanh(least(greatest(score, -0.999), 0.999)) ELSE 0 END AS ev FROM sco),
  pa AS (SELECT instrument, bar_index, CAST(sum(live::INT) AS BIGINT) AS n_live, sum(dd*dd) AS dd2, sum(dd) AS sd, sum(dd*dd*ev) AS dde, sum(dd*ev) AS de FROM se0 GROUP BY 1, 2),
  pb AS (SELECT *, CASE WHEN n_live > 0 THEN {_quad('dde', 'sd', 'de', NE)} ELSE 0 END AS log_odds, greatest({_quad('dd2', 'sd', 'sd', NE)}, 1e-9) AS ebe_full FROM pa),
  al AS (SELECT b.instrument, b.bar_index, count(*) AS m, sum(dd*dd) AS q, sum(dd) AS s FROM pb b JOIN se0 e ON e.instrument = b.instrument AND e.bar_index = b.bar_index AND live AND abs(score) * reliability > 0.05 AND (log_odds = 0 OR sign(score) = sign(log_odds)) GROUP BY 1, 2),
  pc AS (SELECT pb.*, coalesce(greatest({_quad('q', 's', 's', 'm')}, 0), 0) AS ebe, 0.36::DOUBLE * ebe_full AS var FROM pb LEFT JOIN al USING (instrument, bar_index)),
  pd AS (SELECT *, sqrt(var) AS se, 1 / sqrt(1 + pi() / 8 * var) AS kp, CAST(sign(log_odds) AS BIGINT) AS dir FROM pc),
  pf AS (SELECT *, 1 / (1 + exp(-log_odds * kp)) AS pm, 1 / (1 + exp(-(log_odds - {P.Z90!r} * se) * kp)) AS pl, 1 / (1 + exp(-(log_odds + {P.Z90!r} * se) * kp)) AS ph FROM pd),
  fused AS (SELECT instrument, bar_index, n_live, log_odds, CASE WHEN n_live > 0 THEN se ELSE 'infinity'::DOUBLE END AS log_odds_se, ebe_full, CASE WHEN n_live > 0 THEN ebe ELSE 0 END AS ebe, CASE WHEN n_live > 0 THEN dir ELSE 0 END AS direction,
    CASE WHEN n_live > 0 THEN least(greatest(CASE WHEN dir >= 0 THEN pm ELSE 1 - pm END, 1e-6), 1 - 1e-6) ELSE 0.5 END AS p_success, CASE WHEN n_live > 0 THEN CASE WHEN dir >= 0 THEN pl ELSE 1 - ph END ELSE 0 END AS p_low,
    CASE WHEN n_live > 0 THEN CASE WHEN dir >= 0 THEN ph ELSE 1 - pl END ELSE 1 END AS p_high FROM pf)"""


@query("pool_log_odds", f"{POOL} SELECT instrument, bar_index, n_live, round(log_odds, 7) AS log_odds, CASE WHEN n_live > 0 THEN round(log_odds_se, 7) END AS log_odds_se, round(p_success, 7) AS p_success, round(p_low, 7) AS p_low, round(p_high, 7) AS p_high, direction FROM fused")
def pool_log_odds(spark, sf):
    x = P.pool_log_odds(scores(spark, sf), NE)
    x = x.withColumn("log_odds_se", F.when(F.col("n_live") > 0, F.col("log_odds_se")))
    return rr(x, 7, [*KEYS, "n_live", "direction"], "log_odds", "log_odds_se", "p_success", "p_low", "p_high")


@query("aligned_breadth", f"{POOL} SELECT instrument, bar_index, round(ebe, 6) AS ebe, round(ebe_full, 6) AS ebe_full FROM fused")
def aligned_breadth(spark, sf):
    return rr(P.pool_log_odds(scores(spark, sf), NE), 6, KEYS, "ebe", "ebe_full")


_K = f"{RHO} / (1 + 8 * {RHO})"


@query(
    "pool_weights",
    f"""{POOL} SELECT instrument, bar_index, engine, round(dd * (dd - {_K} * sd) / (1 - {RHO}) / ebe_full, 7) + 0.0 AS weight, round(dd * (dd * ev - {_K} * de) / (1 - {RHO}), 7) + 0.0 AS contribution
     FROM se0 JOIN pb USING (instrument, bar_index)""",
)
def pool_weights(spark, sf):
    w = P.pool_weights(scores(spark, sf), NE)
    x = w.select(*KEYS, F.explode("weights").alias("engine", "weight"), "contributions")
    return x.select(*KEYS, "engine", (F.round("weight", 7) + 0.0).alias("weight"), (F.round(F.col("contributions")[F.col("engine")], 7) + 0.0).alias("contribution"))


SCC = ["regime", "trend", "structure"]
_SW = {"m0": "x0", "m1": "x1", "m2": "x2", "q00": "x0*x0", "q11": "x1*x1", "q22": "x2*x2", "q01": "x0*x1", "q02": "x0*x2", "q12": "x1*x2"}
_PAIR = lambda i, j: f"CASE WHEN k > 60 THEN 0.85 * least(greatest((q{i}{j} - m{i}*m{j}) / sqrt(greatest(q{i}{i} - m{i}*m{i}, 1e-300) * greatest(q{j}{j} - m{j}*m{j}, 1e-300)), -0.999), 0.999) ELSE {RHO} END"


@query(
    "score_corr",
    f"""{SC}, wd AS (SELECT instrument, bar_index, {", ".join(f"max(CASE WHEN engine = '{e}' AND valid THEN score END) AS x{i}" for i, e in enumerate(SCC))} FROM sco GROUP BY 1, 2),
    wk AS (SELECT *, row_number() OVER ({PART}) AS k FROM wd WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
    we AS (SELECT *, {", ".join(f"sum({e} * pow(2.0::DOUBLE, k / 250.0::DOUBLE)) OVER w / sum(pow(2.0::DOUBLE, k / 250.0::DOUBLE)) OVER w AS {n}" for n, e in _SW.items())} FROM wk WINDOW w AS ({PART})),
    pr AS (SELECT instrument, bar_index, k AS samples, unnest([{", ".join(f"{{'a': '{SCC[i]}', 'b': '{SCC[j]}', 'c': {_PAIR(i, j)}}}" for i, j in ((0, 1), (0, 2), (1, 2)))}]) AS s FROM we)
    SELECT instrument, bar_index, samples, s.a AS a, s.b AS b, round(s.c, 6) AS corr FROM pr""",
)
def score_corr(spark, sf):
    return P.score_corr(scores(spark, sf), SCC).withColumn("corr", F.round("corr", 6))


@query("breadth_diagnostics")
def breadth_diagnostics(spark, sf):
    return P.breadth_diagnostics(P.fused_general(scores(spark, sf), list(CORE)))


@query("fused_general")
def fused_general(spark, sf):
    return P.fused_general(scores(spark, sf), list(CORE))


# --------------------------------------------------------------------------- #
# regime filter

SHAPES = K.beta_terms()
RIN = {"vol_rank": "vol_rank", "vr_rank": "efficiency", "ladr_rank": "ladr_rank", "absorption_rank": "absorption_rank", "participation_rank": "compression", "perm_entropy": "vol_of_vol", "jump_share": "jump_share", "efficiency": "range_pos"}


def regime_inputs(spark, sf):
    x = inputs(spark, sf)
    return x.select(*KEYS, *[F.col(src).alias(dst) for dst, src in RIN.items()])


def _ll(k):
    terms = []
    for (name, src), (a, b, z) in zip(RIN.items(), SHAPES[k]):
        v = f"least(greatest({src}, 1e-6), 1 - 1e-6)"
        terms.append(f"coalesce({a!r}::DOUBLE * ln({v}) + {b!r}::DOUBLE * ln(1 - {v}) - ({z!r}::DOUBLE) + 0 * {src}, 0)")
    return " + ".join(terms)


LOGLIK = f"{SI}, rl AS (SELECT instrument, bar_index, {', '.join(f'{_ll(k)} AS l{k}' for k in range(4))}, {' + '.join(f'({s} IS NOT NULL)::INT' for s in RIN.values())} AS usable FROM si)"


@query("regime_loglik", f"{LOGLIK} SELECT instrument, bar_index, {', '.join(f'round(l{k}, 6) AS l{k}' for k in range(4))}, CAST(usable AS BIGINT) AS usable FROM rl")
def regime_loglik(spark, sf):
    from ..operators.regime import log_likelihood

    x = log_likelihood(regime_inputs(spark, sf))
    return rr(x, 6, [*KEYS, "usable"], "l0", "l1", "l2", "l3")


_OFF = repr(0.015 / 3)
_STEP = ", ".join(f"exp(z.l{k} - z.mx) * ({_OFF}::DOUBLE + (0.985::DOUBLE - {_OFF}::DOUBLE) * f.p{k}) AS a{k}" for k in range(4))


@query(
    "regime_posterior",
    f"""{LOGLIK.replace('WITH ', 'WITH RECURSIVE ', 1)}, z AS MATERIALIZED (SELECT *, greatest(l0, l1, l2, l3) AS mx, row_number() OVER ({PART}) AS k FROM rl WHERE usable >= 4),
    f AS (SELECT instrument, 0::BIGINT AS k, -1::BIGINT AS bar_index, 0.25::DOUBLE AS p0, 0.25::DOUBLE AS p1, 0.25::DOUBLE AS p2, 0.25::DOUBLE AS p3 FROM z WHERE k = 1
      UNION ALL SELECT instrument, k, bar_index, a0 / t, a1 / t, a2 / t, a3 / t FROM (SELECT *, a0 + a1 + a2 + a3 AS t FROM (SELECT z.instrument, z.k, z.bar_index, {_STEP} FROM f JOIN z ON z.instrument = f.instrument AND z.k = f.k + 1)))
    SELECT instrument, bar_index, round(p0, 7) AS p0, round(p1, 7) AS p1, round(p2, 7) AS p2, round(p3, 7) AS p3 FROM f WHERE k > 0""",
)
def regime_posterior(spark, sf):
    x = as_fold(regime_inputs(spark, sf), {"r": K.regime(temper=False)}, KEYS, REGIME_OUT)
    return rr(x.filter("regime_valid"), 7, KEYS, "p0", "p1", "p2", "p3")


@query("regime_temper")
def regime_temper(spark, sf):
    return nan_to_null(as_fold(regime_inputs(spark, sf), {"r": K.regime()}, KEYS, REGIME_OUT))


HZ = ", ".join(f"sum(p{k} * pow(2.0::DOUBLE, bar_index / 20.0::DOUBLE)) OVER w / sum(pow(2.0::DOUBLE, bar_index / 20.0::DOUBLE)) OVER w AS e{k}" for k in range(4))


@query(
    "regime_hazard",
    f"""{SI}, hz AS (SELECT instrument, bar_index, p0, p1, p2, p3, top, {HZ} FROM si3 WINDOW w AS ({PART})),
    hd AS (SELECT *, 0.5 * ({" + ".join(f"abs(p{k} - e{k} / (e0 + e1 + e2 + e3))" for k in range(4))}) AS drift, 1 - top AS ambiguity FROM hz)
    SELECT instrument, bar_index, round(drift, 7) AS drift, round(ambiguity, 7) AS ambiguity, round(greatest(drift, ambiguity), 7) AS hazard FROM hd""",
)
def regime_hazard(spark, sf):
    from ..operators.regime import hazard

    x = hazard(inputs(spark, sf).select(*KEYS, "p0", "p1", "p2", "p3"))
    return rr(x, 7, KEYS, "drift", "ambiguity", "hazard")


# --------------------------------------------------------------------------- #
# targets, costs, sizing, limits


def fused_inputs(spark, sf):
    f = P.pool_log_odds(scores(spark, sf), NE).select(*KEYS, "log_odds", "p_success", "p_low", "p_high", "ebe", "direction")
    make = lambda: inputs(spark, sf).join(f, KEYS)
    return stored(make, spark, X._name("fused_inputs", sf))


def planned(spark, sf):
    x = fused_inputs(spark, sf)
    return x.withColumns(D.barrier_plan())


FI = f"{POOL}, fi AS (SELECT si.*, log_odds, p_success, p_low, p_high, ebe, direction FROM si JOIN fused USING (instrument, bar_index))"
PLAN = f"""{FI}, b0 AS (SELECT *, 1.6 * CASE WHEN p2 > 0.2 THEN 1 + 0.6 * p2 ELSE 1 END * CASE WHEN jump_share > 0.4 THEN 1 + 0.4 * (jump_share - 0.4) / 0.6 ELSE 1 END AS s0,
    2.6 * CASE WHEN p1 > p0 THEN 1 - 0.25 * (p1 - p0) ELSE 1 + 0.2 * (p0 - p1) END AS t0, CASE WHEN p1 > p0 THEN floor(30 * (1 - 0.3 * (p1 - p0))) ELSE 30 END AS h0,
    ln(CASE WHEN direction > 0 THEN pivot_high ELSE pivot_low END / close) * direction / sigma_fcst AS dist FROM fi),
  b1 AS (SELECT *, CASE WHEN dist > 0.3 AND dist < t0 THEN greatest(0.8 * dist, 0.6 * s0) ELSE t0 END AS t1, sigma_fcst > 0 AND direction <> 0 AS okp FROM b0),
  pl AS (SELECT *, CASE WHEN okp THEN least(greatest(s0, 0.4), 8) END AS stop_sigma, CASE WHEN okp THEN least(greatest(t1, 0.4), 12) END AS target_sigma, CASE WHEN okp THEN CAST(least(greatest(h0, 3), 500) AS BIGINT) END AS max_holding FROM b1)"""


@query("barrier_plan", f"{PLAN} SELECT instrument, bar_index, round(stop_sigma, 9) AS stop_sigma, round(target_sigma, 9) AS target_sigma, max_holding, round(close * exp(-direction * stop_sigma * sigma_fcst), 5) AS stop_price, round(close * exp(direction * target_sigma * sigma_fcst), 5) AS target_price FROM pl")
def barrier_plan(spark, sf):
    x = planned(spark, sf)
    return x.select(
        *KEYS, F.round("stop_sigma", 9).alias("stop_sigma"), F.round("target_sigma", 9).alias("target_sigma"), "max_holding",
        F.round("stop_price", 5).alias("stop_price"), F.round("target_price", 5).alias("target_price"),
    )


@query("naive_expectancy", f"{PLAN} SELECT instrument, bar_index, round(p_success * target_sigma - (1 - p_success) * stop_sigma, 6) AS expectancy FROM pl")
def naive_expectancy(spark, sf):
    return rr(planned(spark, sf).withColumn("expectancy", D.naive_expectancy()), 6, KEYS, "expectancy")


COST = f"""{PLAN}, c0 AS (SELECT *, CASE WHEN spread_feed >= 0 THEN spread_feed ELSE spread END AS spr, 1 + 1.5 * p2 AS kx FROM pl),
  c1 AS (SELECT *, 0.5 * CASE WHEN spr > 0 THEN spr ELSE 0.0005 END / sigma_fcst AS hs FROM c0),
  co AS (SELECT *, CASE WHEN hs > 0.2 THEN NULL ELSE hs * kx END AS half_spread_sigma, 0.6 * sqrt(0.002) * kx AS impact_sigma, 0.02 * least(CASE WHEN range_over_sigma > 0 THEN range_over_sigma ELSE 1.3 END, 5) * kx AS slippage_sigma, 1e-4 / sigma_fcst AS fee_sigma FROM c1)"""


def costed(spark, sf):
    spread = D.spread_used()
    return planned(spark, sf).withColumns(D.cost_estimate(spread, stress=D.stress_multiplier()))


@query(
    "cost_estimate",
    f"""{COST} SELECT instrument, bar_index, sigma_fcst > 0 AND half_spread_sigma IS NOT NULL AS finite, round(half_spread_sigma, 7) AS half_spread_sigma, round(slippage_sigma, 8) AS slippage_sigma, round(fee_sigma, 7) AS fee_sigma,
      round(2 * (half_spread_sigma + impact_sigma + slippage_sigma + fee_sigma), 6) AS cost_sigma FROM co WHERE sigma_fcst > 0""",
)
def cost_estimate(spark, sf):
    x = costed(spark, sf).filter("sigma_fcst > 0")
    fin = lambda k: F.when(F.col(k) < float("inf"), F.col(k))
    return x.select(
        *KEYS, (F.col("cost_sigma") < float("inf")).alias("finite"), F.round(fin("half_spread_sigma"), 7).alias("half_spread_sigma"),
        F.round("slippage_sigma", 8).alias("slippage_sigma"), F.round("fee_sigma", 7).alias("fee_sigma"), F.round(fin("cost_sigma"), 6).alias("cost_sigma"),
    )


@query("capacity", f"{SI} SELECT instrument, bar_index, round(CASE WHEN mean > 0 THEN pow(mean / 1.2, 2) ELSE 0 END, 8) AS capacity FROM si")
def capacity(spark, sf):
    return rr(inputs(spark, sf).withColumn("capacity", D.capacity(F.col("mean"))), 8, KEYS, "capacity")


THR = "CASE WHEN drawdown <= 0.04 THEN 1 WHEN drawdown >= 0.25 THEN 0 WHEN drawdown >= 0.15 THEN 0.25 * (1 - (drawdown - 0.15) / (0.25 - 0.15)) ELSE 1 - (drawdown - 0.04) / (0.15 - 0.04) * 0.75 END"
SIZE = f"""{COST}, z0 AS (SELECT *, coalesce(2 * (half_spread_sigma + impact_sigma + slippage_sigma + fee_sigma), 'infinity'::DOUBLE) AS cost_sigma, {THR} AS thr FROM co),
  z1 AS (SELECT *, mean - cost_sigma AS net, lcb - cost_sigma AS low_ FROM z0),
  sz AS (SELECT *, coalesce(low_ > 0 AND stop_sigma > 0, false) AS okz, CASE WHEN low_ > 0 AND stop_sigma > 0 THEN greatest(net, 0) / (outcome_var + var_mean) * 0.25 * least(greatest(low_ / greatest(net, 1e-9), 0), 1) * least(greatest(n_eff / 30, 0.15), 1) ELSE 0 END AS risk_raw FROM z1)"""


def sized(spark, sf):
    x = costed(spark, sf)  # bars without a plan stay: their size is 0 and their gate says why
    return x.withColumns(D.position_size(D.throttle(F.col("drawdown"))))


@query("position_size", f"{SIZE} SELECT instrument, bar_index, round(risk_raw, 7) AS risk_raw, round(least(greatest(risk_raw * thr, 0), 0.02), 7) AS risk_fraction, CASE WHEN okz THEN round(least(greatest(risk_raw * thr, 0), 0.02) / abs(close * (1 - exp(-stop_sigma * sigma_fcst))), 6) ELSE 0 END AS units FROM sz")
def position_size(spark, sf):
    x = sized(spark, sf)
    return x.select(*KEYS, F.round("risk_raw", 7).alias("risk_raw"), F.round("risk_fraction", 7).alias("risk_fraction"), F.round("units", 6).alias("units"))


@query("vol_target", f"{SI} SELECT instrument, bar_index, round(CASE WHEN sigma_fcst > 0 THEN least(greatest(0.15 / (sigma_fcst * sqrt(252)), 0.1), 3) ELSE 1 END, 7) AS scale FROM si")
def vol_target(spark, sf):
    return rr(inputs(spark, sf).withColumn("scale", D.vol_target(F.col("sigma_fcst"))), 7, KEYS, "scale")


@query(
    "drawdown_throttle",
    f"""{CHAIN}, q AS (SELECT instrument, bar_index, exp(3 * ln(close / 100)) AS equity FROM v3), m AS (SELECT *, greatest(1.0::DOUBLE, max(equity) OVER ({PART})) AS peak FROM q),
    x AS (SELECT *, greatest(1 - equity / peak, 0) AS drawdown FROM m) SELECT instrument, bar_index, round(peak, 7) AS peak, round(drawdown, 7) AS drawdown, round({THR}, 6) AS throttle, drawdown >= 0.25 AS killed FROM x""",
)
def drawdown_throttle(spark, sf):
    e = X.lineitem_bars(spark, sf).select(*KEYS, F.exp(3 * F.log(F.col("close") / 100)).alias("equity"))
    x = D.drawdown_throttle(e)
    return x.select(*KEYS, F.round("peak", 7).alias("peak"), F.round("drawdown", 7).alias("drawdown"), F.round("throttle", 6).alias("throttle"), "killed")


@query(
    "limit_checks",
    f"""{SI} SELECT instrument, bar_index, array_to_string(list_filter([CASE WHEN drawdown >= 0.25 THEN 'drawdown' END, CASE WHEN brier > 0.27 THEN 'brier' END, CASE WHEN psi > 0.25 THEN 'psi' END, CASE WHEN slippage_ratio > 2 THEN 'slippage' END, CASE WHEN stale_bars > 3 THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS kills,
      loss_streak >= ceil(log2(greatest(n_trades, 8))) + 3 AS warned FROM si""",
)
def limit_checks(spark, sf):
    k, w = D.limit_checks()
    return inputs(spark, sf).select(*KEYS, F.array_join(k, ",").alias("kills"), (F.size(w) > 0).alias("warned"))


GATE = f"""{SIZE}, g0 AS (SELECT *, CASE WHEN NOT valid THEN 'features not valid' WHEN direction = 0 THEN 'no directional evidence' WHEN stop_sigma IS NULL THEN 'no volatility forecast for barriers' WHEN phase IN (1, 7, 8, 2, 6) THEN 'session phase' END AS f1,
   list_filter([CASE WHEN dominant = 3 THEN 'quiet regime' END, CASE WHEN hazard > 0.35 THEN 'transition hazard' END, CASE WHEN NOT coalesce(lcb - cost_sigma > 0.05, false) THEN 'expectancy lower bound' END, CASE WHEN NOT p_success >= 0.58 THEN 'probability' END,
     CASE WHEN NOT ebe >= 1.25 THEN 'effective breadth' END, CASE WHEN stale_bars > 3 THEN 'engines invalid' END], lambda x: x IS NOT NULL) AS rest FROM sz)"""


def gated(spark, sf):
    return sized(spark, sf).withColumn("n_invalid", F.col("stale_bars")).withColumn("veto", D.gate())


@query("gate", f"{GATE} SELECT instrument, bar_index, CASE WHEN f1 IS NOT NULL THEN f1 ELSE array_to_string(rest, ',') END AS veto, f1 IS NULL AND len(rest) = 0 AS passed FROM g0")
def gate(spark, sf):
    return gated(spark, sf).select(*KEYS, F.array_join("veto", ",").alias("veto"), (F.size("veto") == 0).alias("passed"))


@query(
    "classify_setup",
    f"""{SC}, cv AS (SELECT instrument, bar_index, bool_or(engine = 'liquidity' AND valid) AS lv, bool_or(engine = 'volatility' AND valid) AS vv FROM sco GROUP BY 1, 2)
    SELECT lq.instrument, lq.bar_index, CAST(CASE WHEN lv AND age <= 4 AND abs(ss) > 0.05 THEN 1 WHEN vv AND compression > 0.7 AND vol_ratio > 1.1 THEN 2 WHEN dominant = 1 OR p1 > p0 THEN 3 ELSE 0 END AS BIGINT) AS setup FROM lq JOIN cv USING (instrument, bar_index)""",
)
def classify_setup(spark, sf):
    w = S.wide_scores(scores(spark, sf))
    return inputs(spark, sf).join(w, KEYS).select(*KEYS, S.classify_setup().alias("setup"))


#: The hashed scores are nearly independent of each other and weak, so their pooled breadth stays below the gate's usual 1.25: the
#: ledger's queries run a gate of lower thresholds, with all its conditions.
LEDGER_GATE = {"p_min": 0.5, "ebe_min": 0.25, "lcb_min": 0.0}


def ledger_rows(spark, sf):
    """Per-bar signals with the gate's whole verdict, the modelled cost and the size of the cell, as they are."""
    return gated(spark, sf).withColumn("veto", D.gate(**LEDGER_GATE)).select(
        *KEYS, "open", "high", "low", "close", "direction", "p_success", "ebe", (F.size("veto") == 0).alias("gate_ok"), "stop_sigma", "target_sigma",
        F.col("sigma_fcst").alias("sigma"), "max_holding", "cost_sigma", "risk_raw",
        (~F.col("phase").isin(1, 7, 8)).alias("tradeable"), F.concat_ws(":", "dominant", F.lit(0), F.lit(0)).alias("cell"),
    )


def ledger(spark, sf):
    return stored(lambda: D.position_ledger(ledger_rows(spark, sf)), spark, X._name("ledger", sf))


@query("position_ledger")
def position_ledger(spark, sf):
    return D.position_ledger(ledger_rows(spark, sf))


@query(
    "trade_net",
    f"""{SIZE}, pn AS (SELECT instrument, instrument || ':' || bar_index AS candidate_id, bar_index, CAST(direction AS BIGINT) AS direction, sigma_fcst AS sigma, stop_sigma AS ss_, target_sigma AS ts_, max_holding AS hold, cost_sigma
    FROM sz WHERE stop_sigma IS NOT NULL), {tb_sql('pn')}
    SELECT sz.instrument, sz.bar_index, round(CASE WHEN sz.cost_sigma < 'infinity'::DOUBLE THEN ret_sigma - sz.cost_sigma END, 6) AS net_sigma FROM sz LEFT JOIN lab ON lab.instrument = sz.instrument AND lab.bar_index = sz.bar_index""",
)
def trade_net(spark, sf):
    """Every bar: what its planned trade returned, net of the modelled cost; without a plan, a fill or a finite cost there is none."""
    plan = sized(spark, sf).filter("stop_sigma IS NOT NULL").select(
        "instrument", F.concat_ws(":", *KEYS).alias("candidate_id"), "bar_index", F.col("direction").cast("long").alias("direction"), F.col("sigma_fcst").alias("sigma"),
        "stop_sigma", "target_sigma", "max_holding", "cost_sigma",
    )
    net = D.trade_net(L.triple_barrier(X.lineitem_bars(spark, sf), plan)).filter(F.col("cost_sigma") < float("inf"))
    return inputs(spark, sf).select(*KEYS).join(net.select(*KEYS, F.round("net_sigma", 6).alias("net_sigma")), KEYS, "left")


@query("trades")
def trades(spark, sf):
    return D.trades(ledger(spark, sf))


@query("run_summary")
def run_summary(spark, sf):
    lg = ledger(spark, sf)
    return D.run_summary(lg, D.trades(lg))


def carded(spark, sf):
    x = gated(spark, sf).join(S.wide_scores(scores(spark, sf)), KEYS)
    return x.withColumn("setup", S.classify_setup()).withColumn("action", F.when(F.size("veto") == 0, F.when(F.col("direction") > 0, "BUY").otherwise("SHORT")).otherwise("NO TRADE"))


@query("explain_card")
def explain_card(spark, sf):
    return carded(spark, sf).select(*KEYS, F.inline(S.explain_card()))
