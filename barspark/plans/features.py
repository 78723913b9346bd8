"""Queries of volatility, microstructure, trend, structure and regime features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..kernels import series as S
from ..operators import bars as B
from ..operators import features as E
from ..operators.rolling import ew_mean, ew_weight
from ..operators.sequence import own_rows, w_block, w_last, with_lookback
from ..session import stored
from ..sources import fixtures as X
from .registry import query
from .rolling import RET, rounded

PART = "PARTITION BY instrument ORDER BY bar_index"
PI2 = repr(math.pi / 2)
# one chain of CTEs from bars to every bounded feature
CHAIN = RET + f""", r1 AS (SELECT *, ret * ret AS r2, abs(ret) AS aret, lag(abs(ret)) OVER w AS a1, lag(abs(ret), 2) OVER w AS a2,
   (high + low + close) / 3.0 * volume AS dv, CASE WHEN high > low THEN (2 * close - high - low) / (high - low) ELSE 0 END AS clv,
   lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc,
   ln(high/close)*ln(high/open) + ln(low/close)*ln(low/open) AS rs,
   0.5*ln(high/low)*ln(high/low) - {E.GK!r}*ln(close/open)*ln(close/open) AS gk FROM r WINDOW w AS ({PART})),
 r2 AS (SELECT *, aret * a1 AS bpv, pow(aret, 4.0::DOUBLE/3) * pow(a1, 4.0::DOUBLE/3) * pow(a2, 4.0::DOUBLE/3) AS tp,
   ln(ph/pl) AS hp, ln(high/low) AS hn, ln(greatest(ph, high)/least(pl, low)) AS h2 FROM r1),
 v1 AS (SELECT *, count(r2) OVER w22 >= 2 AND count(r2) OVER w66 >= 20 AS ok, sqrt(avg(r2) OVER w22) AS rv,
   count(bpv) OVER w22 AS nbp, sum(bpv) OVER w22 AS sbp, sum(r2) OVER w22 AS srv, count(tp) OVER w22 AS ntp, sum(tp) OVER w22 AS stp,
   sqrt(greatest(avg(rs) OVER w22, 0)) AS rsm, sqrt(greatest(avg(gk) OVER w22, 0)) AS gkm,
   CASE WHEN count(r2) OVER w5 >= 2 THEN sqrt(avg(r2) OVER w5) END AS ss, CASE WHEN count(r2) OVER w66 >= 3 THEN sqrt(avg(r2) OVER w66) END AS sl,
   sqrt(sum(r2 * pow(2.0::DOUBLE, bar_index / 10.0::DOUBLE)) OVER wa / sum(CASE WHEN r2 IS NOT NULL THEN pow(2.0::DOUBLE, bar_index / 10.0::DOUBLE) END) OVER wa) AS ew,
   sum(clv * pow(2.0::DOUBLE, bar_index / 5.0::DOUBLE)) OVER wa / sum(pow(2.0::DOUBLE, bar_index / 5.0::DOUBLE)) OVER wa AS clv_ema
   FROM r2 WINDOW w22 AS ({PART} ROWS 21 PRECEDING), w66 AS ({PART} ROWS 65 PRECEDING), w5 AS ({PART} ROWS 4 PRECEDING), wa AS ({PART})),
 v2 AS (SELECT *, CASE WHEN ok THEN rv END AS sigma_rv, CASE WHEN ok THEN CASE WHEN sqrt({PI2} * sbp / nbp) > 0 THEN sqrt({PI2} * sbp / nbp) ELSE greatest(rv, 1e-8) END END AS sigma_bp,
   CASE WHEN ok THEN rsm END AS sigma_rs, CASE WHEN ok THEN gkm END AS sigma_gk, CASE WHEN ok THEN ew END AS sigma_ew,
   CASE WHEN ok THEN ss END AS sigma_short, CASE WHEN ok THEN sl END AS sigma_long FROM v1),
 v3 AS (SELECT *, CASE WHEN sigma_rv > 0 THEN least(greatest((sigma_rv*sigma_rv - sigma_bp*sigma_bp)/(sigma_rv*sigma_rv), 0), 1) WHEN sigma_rv = 0 THEN 0 END AS jump_share,
   CASE WHEN ok THEN greatest(coalesce(exp((CASE WHEN sigma_short > 0 THEN 0.5*ln(sigma_short) ELSE 0 END + CASE WHEN sigma_rv > 0 THEN 0.3*ln(sigma_rv) ELSE 0 END
     + CASE WHEN sigma_long > 0 THEN 0.2*ln(sigma_long) ELSE 0 END) / nullif(CASE WHEN sigma_short > 0 THEN 0.5 ELSE 0 END + CASE WHEN sigma_rv > 0 THEN 0.3 ELSE 0 END + CASE WHEN sigma_long > 0 THEN 0.2 ELSE 0 END, 0)), 1e-6), 1e-6) END AS sigma_fcst,
   CASE WHEN sigma_short > 0 THEN ln(sigma_short) END AS logss, ret / sigma_bp AS d FROM v2)"""


def srank(col, w=252, need=60):
    """Mid-rank in a trailing window of a series whose NULLs are at the head."""
    xs = f"list({col}) OVER ({PART} ROWS {w - 1} PRECEDING)"
    f = f"list_filter({xs}, lambda x: x IS NOT NULL)"
    return f"""CASE WHEN {col} IS NOT NULL AND len({f}) >= {need} THEN (len(list_filter({xs}, lambda x: x < {col}))
      + 0.5::DOUBLE * len(list_filter({xs}, lambda x: x = {col}))) / len({f}) END"""


def r(e, n, digits=8):
    return f"round({e}, {digits}) AS {n}"


def base(spark, sf):
    """The block frame, look-back rows dropped."""
    return own_rows(E.block_frame(X.lineitem_bars(spark, sf)))


def ranked(spark, sf):
    make = lambda: E.nan_to_null(E.block_features(X.lineitem_bars(spark, sf)))
    return stored(make, spark, X._name("block_features", sf))


def features(spark, sf):
    """The full feature table, written once and read by everything downstream."""
    make = lambda: E.feature_table(X.lineitem_bars(spark, sf))
    return stored(make, spark, X._name("features", sf))


SEL = "SELECT instrument, bar_index, "


@query("vol_realized", f"{CHAIN} {SEL} {r('sigma_rv', 'sigma_rv', 10)}, {r('sigma_short', 'sigma_short', 10)}, {r('sigma_long', 'sigma_long', 10)} FROM v3")
def vol_realized(spark, sf):
    bars = X.lineitem_bars(spark, sf)
    x = own_rows(E.volatility(E.with_returns(with_lookback(bars, 700))))
    return rounded(x, 10, "sigma_rv", "sigma_short", "sigma_long")


@query("vol_bipower", f"{CHAIN} {SEL} {r('sigma_bp', 'sigma_bp', 10)} FROM v3")
def vol_bipower(spark, sf):
    return rounded(base(spark, sf), 10, "sigma_bp")


@query("vol_rogers_satchell", f"{CHAIN} {SEL} {r('sigma_rs', 'sigma_rs', 10)} FROM v3")
def vol_rs(spark, sf):
    return rounded(base(spark, sf), 10, "sigma_rs")


@query("vol_garman_klass", f"{CHAIN} {SEL} {r('sigma_gk', 'sigma_gk', 10)} FROM v3")
def vol_gk(spark, sf):
    return rounded(base(spark, sf), 10, "sigma_gk")


@query("vol_ewma", f"{CHAIN} {SEL} {r('sigma_ew', 'sigma_ew', 10)} FROM v3")
def vol_ewma(spark, sf):
    return rounded(base(spark, sf), 10, "sigma_ew")


@query("jump_share", f"{CHAIN} {SEL} {r('jump_share', 'jump_share', 7)} FROM v3")
def jump_share(spark, sf):
    return rounded(base(spark, sf), 7, "jump_share")


@query("vol_forecast", f"{CHAIN} {SEL} {r('sigma_fcst', 'sigma_fcst', 10)} FROM v3")
def vol_forecast(spark, sf):
    return rounded(base(spark, sf), 10, "sigma_fcst")


@query(
    "vol_state",
    f"""{CHAIN}, q AS (SELECT *, ln(sigma_fcst) AS lf, sigma_short / sigma_long AS cr FROM v3)
    {SEL} {r(f"CASE WHEN logss IS NOT NULL AND count(logss) OVER ({PART} ROWS 59 PRECEDING) >= 10 THEN stddev_samp(logss) OVER ({PART} ROWS 59 PRECEDING) END", "vol_of_vol", 7)},
     {r("sigma_ew / sigma_fcst", "vol_ratio")}, {r(srank("lf"), "vol_rank")}, {r("1 - " + srank("cr"), "compression")}, {r("ln(high / low) / sigma_fcst", "range_over_sigma")} FROM q""",
)
def vol_state(spark, sf):
    x = ranked(spark, sf)
    return x.select(
        "instrument", "bar_index", F.round("vol_of_vol", 7).alias("vol_of_vol"),
        *[F.round(c, 8).alias(c) for c in ("vol_ratio", "vol_rank", "compression", "range_over_sigma")],
    )


@query(
    "jump_test",
    f"""{CHAIN}, z AS (SELECT *, {PI2} * sbp * (nbp + 1) / nbp AS bv FROM v3), y AS (SELECT *, CASE WHEN ntp >= 10 AND srv > 0 AND bv > 0 THEN
     (1 - bv / srv) / sqrt({E.BNS_THETA!r} * greatest(1.0, ntp * {E.MU_43 ** -3.0!r} * stp / (bv * bv)) / nbp) END AS z FROM z)
    {SEL} {r('z', 'jump_z', 7)}, z > 2.326 AS significant FROM y""",
)
def jump_test(spark, sf):
    x = base(spark, sf)
    return x.select("instrument", "bar_index", F.round("jump_z", 7).alias("jump_z"), (F.col("jump_z") > 2.326).alias("significant"))


@query("jump_bar", f"{CHAIN} {SEL} {r('aret / sigma_bp', 'size', 7)} FROM v3 WHERE aret / sigma_bp > 4")
def jump_bar(spark, sf):
    x = base(spark, sf).withColumn("size", F.col("aret") / F.col("sigma_bp"))
    return rounded(x.filter("size > 4"), 7, "size")


DAILY_PART = f"{CHAIN}, p AS (SELECT *, CASE WHEN count(dv) OVER w >= 5 AND median(dv) OVER w > 0 THEN dv / median(dv) OVER w END AS part FROM v3 WINDOW w AS ({PART} ROWS 59 PRECEDING))"
MICRO = f"""{DAILY_PART}, m AS (SELECT *, abs(d) / sqrt(part) AS mag, part / (abs(d) + 1e-6) AS absorb, CASE WHEN d IS NOT NULL THEN aret / dv END AS am,
   CASE WHEN d IS NOT NULL THEN delta / volume END AS share FROM p)"""


@query("participation", f"{DAILY_PART} {SEL} {r('part', 'participation', 7)}, {r(srank('part'), 'participation_rank')} FROM p")
def participation(spark, sf):
    x = ranked(spark, sf)
    return x.select("instrument", "bar_index", F.round("participation", 7).alias("participation"), F.round("participation_rank", 8).alias("participation_rank"))


@query("ladr", f"{MICRO} {SEL} {r('sign(ret) * mag', 'ladr', 7)}, {r(srank('mag'), 'ladr_rank')} FROM m")
def ladr(spark, sf):
    x = ranked(spark, sf)
    return x.select("instrument", "bar_index", F.round("ladr", 7).alias("ladr"), F.round("ladr_rank", 8).alias("ladr_rank"))


@query("absorption", f"{MICRO}, n AS (SELECT *, ln(1 + absorb) AS la FROM m) {SEL} {r('ln(absorb)', 'log_absorption', 7)}, {r(srank('la'), 'absorption_rank')} FROM n")
def absorption(spark, sf):
    x = ranked(spark, sf)
    return x.select("instrument", "bar_index", F.round(F.log("absorption"), 7).alias("log_absorption"), F.round("absorption_rank", 8).alias("absorption_rank"))


@query("amihud_kyle", f"{MICRO}, n AS (SELECT *, ln(am + 1e-300) AS la FROM m) {SEL} {r('am * 1e6', 'amihud_e6', 7)}, {r(srank('la'), 'amihud_rank')}, {r('CASE WHEN d IS NOT NULL THEN aret / sqrt(dv) END', 'kyle_lambda', 10)} FROM n")
def amihud_kyle(spark, sf):
    x = ranked(spark, sf)
    return x.select(
        "instrument", "bar_index", F.round(F.col("amihud") * 1e6, 7).alias("amihud_e6"), F.round("amihud_rank", 8).alias("amihud_rank"),
        F.round("kyle_lambda", 10).alias("kyle_lambda"),
    )


@query("clv_ema", f"{CHAIN} {SEL} {r('clv_ema', 'clv_ema', 7)} FROM v3")
def clv_ema(spark, sf):
    return rounded(base(spark, sf), 7, "clv_ema")


@query(
    "delta_norm",
    f"""{MICRO}, n AS (SELECT *, 1.4826 * mad(abs(share)) OVER ({PART} ROWS 59 PRECEDING) AS sc FROM m)
    {SEL} {r('CASE WHEN sc > 1e-12 THEN share / sc ELSE share END', 'delta_norm', 6)} FROM n""",
)
def delta_norm(spark, sf):
    return rounded(ranked(spark, sf), 6, "delta_norm")


SPREAD = f"""{CHAIN}, t AS (SELECT *, (sqrt(2*(hp*hp+hn*hn)) - sqrt(hp*hp+hn*hn)) / {E.CS_K!r} - sqrt(h2*h2 / {E.CS_K!r}) AS al,
    (ln(pc) - 0.5*(ln(ph)+ln(pl))) * (ln(pc) - 0.5*(ln(high)+ln(low))) AS cov FROM v3),
  u AS (SELECT *, CASE WHEN ph IS NOT NULL THEN greatest(2*(exp(al)-1)/(1+exp(al)), 0) END AS cs,
    CASE WHEN ph IS NOT NULL THEN CASE WHEN cov > 0 THEN 2*sqrt(cov) ELSE 0 END END AS ar FROM t)"""
MED22 = "CASE WHEN count({c}) OVER w >= 5 THEN median({c}) OVER w END"


@query("spread_cs", f"{SPREAD} {SEL} {r(MED22.format(c='cs'), 'spread', 9)} FROM u WINDOW w AS ({PART} ROWS 21 PRECEDING)")
def spread_cs(spark, sf):
    return rounded(ranked(spark, sf), 9, "spread")


@query("spread_ar", f"{SPREAD} {SEL} {r(MED22.format(c='ar'), 'spread_ar', 9)} FROM u WINDOW w AS ({PART} ROWS 21 PRECEDING)")
def spread_ar(spark, sf):
    return rounded(ranked(spark, sf), 9, "spread_ar")


@query(
    "kalman_trend",
    f"""{CHAIN.replace('WITH ', 'WITH RECURSIVE ', 1)}, z AS MATERIALIZED (SELECT instrument, bar_index, ln(close) AS y, sigma_bp * sigma_bp AS s,
       row_number() OVER ({PART}) AS k FROM v3 WHERE sigma_bp > 0),
    f AS (SELECT instrument, k, bar_index, y AS lv, 0.0::DOUBLE AS sl, 100 * s AS p0, 0.0::DOUBLE AS p1, s AS p2 FROM z WHERE k = 1
      UNION ALL SELECT z.instrument, z.k, z.bar_index, lv + sl + (p0 + 2*p1 + p2 + 0.02*s) / (p0 + 2*p1 + p2 + 1.02*s) * (y - lv - sl),
        sl + (p1 + p2) / (p0 + 2*p1 + p2 + 1.02*s) * (y - lv - sl),
        (p0 + 2*p1 + p2 + 0.02*s) * s / (p0 + 2*p1 + p2 + 1.02*s), (p1 + p2) * s / (p0 + 2*p1 + p2 + 1.02*s),
        p2 + 0.002*s - (p1 + p2) * (p1 + p2) / (p0 + 2*p1 + p2 + 1.02*s) FROM f JOIN z ON z.instrument = f.instrument AND z.k = f.k + 1)
    {SEL} {r('lv', 'level', 7)}, {r('sl', 'slope', 9)}, {r('CASE WHEN k >= 5 THEN sl / sqrt(p2) END', 'slope_t', 6)} FROM f""",
)
def kalman_trend(spark, sf):
    x = base(spark, sf).select("instrument", "bar_index", "close", "sigma_bp")
    k = E.nan_to_null(E.as_fold(x, {"k": S.kalman()}, ["instrument", "bar_index"], E.TREND_OUT)).filter("kalman_level IS NOT NULL")
    return k.select(
        "instrument", "bar_index", F.round("kalman_level", 7).alias("level"), F.round("kalman_slope", 9).alias("slope"),
        F.round("kalman_slope_t", 6).alias("slope_t"),
    )


def _vr_sql():
    qs = (2, 4, 8, 16)
    xs = "v"
    n = f"len({xs})"
    stats = f"""b AS (SELECT instrument, bar_index, list_filter(list(ret) OVER ({PART} ROWS 119 PRECEDING), lambda x: x IS NOT NULL) AS v FROM r),
    c AS (SELECT *, list_avg(v) AS mu FROM b WHERE len(v) >= 48),
    d AS (SELECT *, list_transform(v, lambda x: (x - mu) * (x - mu)) AS d2 FROM c),
    e AS (SELECT *, list_sum(d2) AS s2, {", ".join(f"list_sum(list_transform(range(1, len(v) - {j} + 1), lambda i: d2[i] * d2[i + {j}])) AS e{j}" for j in range(1, 16))} FROM d)"""
    zs, hs = [], []
    for q in qs:
        var = f"list_sum(list_transform(range(1, {n} - {q} + 2), lambda i: pow(list_sum(v[i:i + {q - 1}]) - {q} * mu, 2))) / ({q} * ({n} - {q} + 1) * (1 - {q}::DOUBLE / {n})) / (s2 / ({n} - 1))"
        theta = "(" + " + ".join(f"{(2 * (q - j) / q) ** 2!r} * e{j}" for j in range(1, q)) + ") / (s2 * s2)"
        zs.append(f"({var} - 1) / sqrt({theta})")
        hs.append(f"0.5 + ln({var}) / (2 * ln({q}))")
    return stats, "(" + " + ".join(zs) + ") / 4", "(" + " + ".join(hs) + ") / 4"


_VR = _vr_sql()


@query("variance_ratio", f"{RET}, {_VR[0]} {SEL} {r(_VR[1], 'vr_z', 6)} FROM e")
def variance_ratio(spark, sf):
    return rounded(ranked(spark, sf).filter("vr_z IS NOT NULL"), 6, "vr_z")


@query("hurst", f"{RET}, {_VR[0]} {SEL} {r(_VR[2], 'hurst_implied', 6)} FROM e")
def hurst(spark, sf):
    return rounded(ranked(spark, sf).filter("hurst_implied IS NOT NULL"), 6, "hurst_implied")


@query(
    "path_efficiency",
    f"{CHAIN} {SEL} {r('CASE WHEN count(ret) OVER w >= 5 THEN abs(sum(ret) OVER w / sum(aret) OVER w) END', 'efficiency', 7)}, {r('CASE WHEN count(ret) OVER w >= 5 THEN sum(ret) OVER w / sum(aret) OVER w END', 'signed', 7)} FROM v3 WINDOW w AS ({PART} ROWS 21 PRECEDING)",
)
def path_efficiency(spark, sf):
    x = E.with_returns(with_lookback(X.lineitem_bars(spark, sf), 24))
    eff, signed = E.path_efficiency()
    return rounded(own_rows(x.withColumns({"efficiency": eff, "signed": signed})), 7, "efficiency", "signed")


@query(
    "horizon_agreement",
    f"{CHAIN}, h AS (SELECT instrument, bar_index, list_filter([{', '.join(f'sign(ln(close) - ln(lag(close, {h}) OVER ({PART})))' for h in (5, 10, 20, 40, 80))}], lambda x: x IS NOT NULL) AS s FROM v3) {SEL} {r('list_avg(s)', 'trend_agree')} FROM h",
)
def horizon_agreement(spark, sf):
    return rounded(base(spark, sf), 8, "trend_agree")


@query(
    "perm_entropy",
    f"""{RET}, l AS (SELECT instrument, bar_index, close AS c, lag(close) OVER w AS b, lag(close, 2) OVER w AS a FROM r WINDOW w AS ({PART})),
    k AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN c < a AND a <= b THEN 2
      WHEN b < a AND a <= c THEN 3 WHEN b <= c AND c < a THEN 4 ELSE 5 END AS p FROM l),
    g AS (SELECT instrument, bar_index, {", ".join(f"count(CASE WHEN p = {i} THEN 1 END) OVER w60 AS n{i}" for i in range(6))}, count(p) OVER w60 AS n FROM k WINDOW w60 AS ({PART} ROWS 59 PRECEDING))
    {SEL} {r("CASE WHEN n >= 20 THEN -(" + " + ".join(f"CASE WHEN n{i} > 0 THEN n{i}::DOUBLE/n * ln(n{i}::DOUBLE/n) ELSE 0 END" for i in range(6)) + ") / ln(6) END", 'perm_entropy', 7)},
      {r("1 - CASE WHEN n >= 20 THEN -(" + " + ".join(f"CASE WHEN n{i} > 0 THEN n{i}::DOUBLE/n * ln(n{i}::DOUBLE/n) ELSE 0 END" for i in range(6)) + ") / ln(6) END", 'complexity', 7)} FROM g""",
)
def perm_entropy(spark, sf):
    x = E.perm_entropy(with_lookback(X.lineitem_bars(spark, sf), 64))
    return rounded(own_rows(x).withColumn("complexity", 1.0 - F.col("perm_entropy")), 7, "perm_entropy", "complexity")


@query(
    "run_asymmetry",
    f"""{RET}, s AS (SELECT instrument, bar_index, sign(ret) AS g, row_number() OVER ({PART}) - row_number() OVER (PARTITION BY instrument, sign(ret) ORDER BY bar_index) AS isl FROM r WHERE ret <> 0),
    runs AS (SELECT instrument, g, isl, count(*) AS len, max(bar_index) AS last FROM s GROUP BY 1, 2, 3),
    done AS (SELECT *, lead(last - len + 1) OVER (PARTITION BY instrument ORDER BY last) AS nxt FROM runs),
    known AS (SELECT d.instrument, g, len, (SELECT min(bar_index) FROM s WHERE s.instrument = d.instrument AND s.bar_index > d.last) AS seen, row_number() OVER (PARTITION BY d.instrument, g ORDER BY last) AS k FROM done d),
    m AS (SELECT instrument, g, seen, k, avg(len) OVER (PARTITION BY instrument, g ORDER BY k ROWS 39 PRECEDING) AS mu FROM known WHERE seen IS NOT NULL)
    {SEL} {r('(u.mu - d.mu) / (u.mu + d.mu)', 'run_asym', 7)} FROM (SELECT instrument, bar_index FROM r) b
      ASOF JOIN (SELECT * FROM m WHERE g > 0 AND k >= 5) u ON b.instrument = u.instrument AND b.bar_index >= u.seen
      ASOF JOIN (SELECT * FROM m WHERE g < 0 AND k >= 5) d ON b.instrument = d.instrument AND b.bar_index >= d.seen""".replace("SELECT instrument, bar_index,  round", "SELECT b.instrument AS instrument, b.bar_index AS bar_index, round"),
)
def run_asymmetry(spark, sf):
    x = B.returns(X.lineitem_bars(spark, sf)).select("instrument", "bar_index", "ret")
    k = E.nan_to_null(E.as_fold(x, {"runs": S.run_asymmetry()}, ["instrument", "bar_index"], E.RUN_OUT))
    return rounded(k.filter("run_asym IS NOT NULL"), 7, "run_asym")


@query(
    "ret_kurtosis",
    f"""{RET}, b AS (SELECT instrument, bar_index, list_filter(list(ret) OVER ({PART} ROWS 125 PRECEDING), lambda x: x IS NOT NULL) AS v FROM r),
    c AS (SELECT *, list_avg(v) AS mu FROM b WHERE len(v) > 30)
    {SEL} {r("list_avg(list_transform(v, lambda x: pow(x - mu, 4))) / pow(list_avg(list_transform(v, lambda x: pow(x - mu, 2))), 2) - 3", 'ret_kurtosis', 6)} FROM c""",
)
def ret_kurtosis(spark, sf):
    return rounded(ranked(spark, sf).filter("ret_kurtosis IS NOT NULL"), 6, "ret_kurtosis")


@query("feature_table")
def feature_table(spark, sf):
    return E.feature_table(X.lineitem_bars(spark, sf)).drop("ts")


@query(
    "warmup_valid",
    f"""{MICRO}, n AS (SELECT *, ln(sigma_fcst) AS lf FROM m), q AS (SELECT instrument, bar_index, {srank('lf')} AS vr, {srank('mag')} AS lr FROM n)
    {SEL} greatest(0, 100 - (bar_index + 1)) AS warmup_remaining, bar_index + 1 >= 100 AND vr IS NOT NULL AND lr IS NOT NULL AS valid FROM q""",
)
def warmup_valid(spark, sf):
    return features(spark, sf).select("instrument", "bar_index", "warmup_remaining", "valid")


@query("feature_unpivot")
def feature_unpivot(spark, sf):
    return E.feature_unpivot(features(spark, sf)).withColumn("value", F.round("value", 9))


@query("regime_features")
def regime_features(spark, sf):
    """Inputs of the regime filter and what it makes of them, for every bar."""
    return features(spark, sf).select("instrument", "bar_index", *E.REGIME_OUT)


@query("htf_view")
def htf_view(spark, sf):
    return E.htf_view(X.lineitem_bars(spark, sf)).drop("ts")
