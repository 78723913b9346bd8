"""Queries of the rolling primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import rolling as R
from ..operators.sequence import framed, w_block, w_last
from ..sources import fixtures as X
from .bars import HOURLY, hourly
from .registry import query

RET = f"""WITH {X.LINEITEM_BARS}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY bar_index)) AS ret FROM bars)"""


def rounded(df, digits, *cols):
    return df.select("instrument", "bar_index", *[F.round(c, digits).alias(c) for c in cols])


def rets(spark, sf):
    return B.returns(X.lineitem_bars(spark, sf))


@query(
    "roll_moments",
    RET + """, m AS (SELECT instrument, bar_index, count(ret) OVER w n, avg(ret) OVER w AS m1, var_pop(ret) OVER w AS v,
      var_samp(ret) OVER w AS vs, list(ret) OVER w AS xs FROM r WINDOW w AS (PARTITION BY instrument ORDER BY bar_index ROWS 21 PRECEDING)),
    c AS (SELECT *, list_avg(list_transform(list_filter(xs, lambda x: x IS NOT NULL), lambda x: pow(x - m1, 3))) m3,
      list_avg(list_transform(list_filter(xs, lambda x: x IS NOT NULL), lambda x: pow(x - m1, 4))) m4 FROM m)
    SELECT instrument, bar_index, round(m1, 9) AS mean, round(CASE WHEN n >= 2 THEN vs END, 10) AS var,
     round(CASE WHEN n >= 2 THEN sqrt(vs) END, 9) AS std, round(CASE WHEN n >= 3 THEN CASE WHEN v <= 1e-300 THEN 0 ELSE m3 / pow(v, 1.5) END END, 5) AS skew,
     round(CASE WHEN n >= 4 THEN CASE WHEN v <= 1e-300 THEN 0 ELSE m4 / (v * v) - 3 END END, 5) AS kurt FROM c""",
)
def roll_moments(spark, sf):
    x = framed(rets(spark, sf).select("instrument", "bar_index", "ret"), 22, R.moments(F.col("ret"), 22))
    return x.select(
        "instrument", "bar_index", F.round("mean", 9).alias("mean"), F.round("var", 10).alias("var"),
        F.round("std", 9).alias("std"), F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"),
    )


@query(
    "roll_sum",
    f"""WITH {X.LINEITEM_BARS} SELECT instrument, bar_index, sum(volume) OVER w AS total, round(avg(volume) OVER w, 6) AS mean
     FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_index ROWS 21 PRECEDING)""",
)
def roll_sum(spark, sf):
    w = w_last(22)
    x = framed(X.lineitem_bars(spark, sf), 22, {"total": F.sum("volume").over(w), "mean": F.avg("volume").over(w)})
    return x.select("instrument", "bar_index", "total", F.round("mean", 6).alias("mean"))


EW = "sum({x} * pow(2.0::DOUBLE, bar_index / {h}::DOUBLE)) OVER w / sum(CASE WHEN {x} IS NOT NULL THEN pow(2.0::DOUBLE, bar_index / {h}::DOUBLE) END) OVER w"
WALL = "WINDOW w AS (PARTITION BY instrument ORDER BY bar_index)"


@query(
    "ewma",
    f"""WITH {X.LINEITEM_BARS}, g AS (SELECT *, CASE WHEN delta > 0 THEN volume END AS x FROM bars),
     d AS (SELECT *, count(x) OVER (PARTITION BY instrument ORDER BY bar_index) AS k FROM g),
     e AS (SELECT instrument, bar_index, sum(x * pow(2.0::DOUBLE, k / 10.0::DOUBLE)) OVER {WALL[12:]} / sum(CASE WHEN x IS NOT NULL THEN pow(2.0::DOUBLE, k / 10.0::DOUBLE) END) OVER {WALL[12:]} AS ew FROM d)
     SELECT instrument, bar_index, round(ew, 6) AS ew FROM e""".replace("OVER (PARTITION BY instrument ORDER BY bar_index) /", "OVER w /").replace("END) OVER (PARTITION BY instrument ORDER BY bar_index) AS ew FROM d", f"END) OVER w AS ew FROM d {WALL}"),
)
def ewma(spark, sf):
    # volume of up-delta bars only, so that missing rows occur inside the series
    x = X.lineitem_bars(spark, sf).withColumn("x", F.when(F.col("delta") > 0, F.col("volume")))
    return rounded(R.ewma_sparse(x.select("instrument", "bar_index", "x"), F.col("x"), 10.0, "ew"), 6, "ew")


@query(
    "ewvar",
    RET + f""", m AS (SELECT instrument, bar_index, ret, {EW.format(x='ret', h=10)} AS ew_mean FROM r {WALL}),
    d AS (SELECT *, pow(ret - coalesce(lag(ew_mean) OVER {WALL[12:]}, ret), 2) AS d2 FROM m)
    SELECT instrument, bar_index, round(ew_mean, 9) AS ew_mean, round({EW.format(x='d2', h=10)}, 11) AS ew_var FROM d {WALL}""".replace("OVER (PARTITION BY instrument ORDER BY bar_index), ret), 2)", "OVER (PARTITION BY instrument ORDER BY bar_index), ret), 2)"),
)
def ewvar(spark, sf):
    x = R.ewvar(rets(spark, sf).select("instrument", "bar_index", "ret"), F.col("ret"), 10.0)
    return x.select("instrument", "bar_index", F.round("ew_mean", 9).alias("ew_mean"), F.round("ew_var", 11).alias("ew_var"))


W60 = "WINDOW w AS (PARTITION BY instrument ORDER BY bar_index ROWS 59 PRECEDING)"


@query(
    "roll_quantile",
    f"""WITH {X.LINEITEM_BARS} SELECT instrument, bar_index, round(quantile_cont(volume, 0.25) OVER w, 6) AS q25, round(quantile_cont(volume, 0.5) OVER w, 6) AS q50,
     round(quantile_cont(volume, 0.9) OVER w, 6) AS q90 FROM bars {W60}""",
)
def roll_quantile(spark, sf):
    spec = {f"q{int(q * 100)}": ("quantile", 60, q) for q in (0.25, 0.5, 0.9)}
    return rounded(R.order_stats(X.lineitem_bars(spark, sf), "volume", spec), 6, *spec)


@query("roll_mad", f"WITH {X.LINEITEM_BARS} SELECT instrument, bar_index, round(1.4826 * mad(volume) OVER w, 6) AS mad FROM bars {W60}")
def roll_mad(spark, sf):
    return rounded(R.order_stats(X.lineitem_bars(spark, sf), "volume", {"mad": ("mad", 60)}), 6, "mad")


@query(
    "causal_rank",
    f"""WITH {X.LINEITEM_BARS}, l AS (SELECT *, list(volume) OVER (PARTITION BY instrument ORDER BY bar_index ROWS 251 PRECEDING) AS xs FROM bars)
    SELECT instrument, bar_index, round(CASE WHEN len(xs) >= 60 THEN (len(list_filter(xs, lambda x: x < volume))
      + 0.5::DOUBLE * len(list_filter(xs, lambda x: x = volume))) / len(xs) END, 8) AS rank FROM l""",
)
def causal_rank(spark, sf):
    return rounded(R.order_stats(X.lineitem_bars(spark, sf), "volume", {"rank": ("rank", 252, 60)}), 8, "rank")


@query(
    "roll_extreme",
    f"""WITH {X.LINEITEM_BARS} SELECT instrument, bar_index, min(close) OVER w AS min, max(close) OVER w AS max
     FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_index ROWS 21 PRECEDING)""",
)
def roll_extreme(spark, sf):
    return R.extremes(X.lineitem_bars(spark, sf), "close", 22).select("instrument", "bar_index", "min", "max")


@query(
    "robust_z",
    f"""WITH {X.LINEITEM_BARS}, m AS (SELECT *, count(*) OVER w AS n, median(volume) OVER w AS med, 1.4826 * mad(volume) OVER w AS s FROM bars {W60})
    SELECT instrument, bar_index, round(CASE WHEN n >= 10 THEN CASE WHEN s <= 1e-300 THEN 0 ELSE (volume - med) / s END END, 6) AS z FROM m""",
)
def robust_z(spark, sf):
    return rounded(R.order_stats(X.lineitem_bars(spark, sf), "volume", {"z": ("robust_z", 60)}), 6, "z")


@query(
    "bucketed_median",
    f"""WITH {HOURLY}, b AS (SELECT *, least(floor((hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE * 13), 12) AS k, volume AS v FROM hb),
    m AS (SELECT *, count(*) OVER w AS n, median(v) OVER w AS med FROM b WINDOW w AS (PARTITION BY instrument, k ORDER BY bar_index ROWS 19 PRECEDING))
    SELECT instrument, bar_index, CAST(k AS BIGINT) AS tod_bucket, round(CASE WHEN n >= 5 AND med > 0 THEN v / med END, 6) AS ratio FROM m""",
)
def bucketed_median(spark, sf):
    x = B.session_tag(hourly(spark, sf), "crypto")
    m = R.bucketed_median(x, "volume", "tod_bucket", 20)
    return m.withColumn("ratio", F.round("ratio", 6))


@query(
    "ew_corr",
    RET + f""", v AS (SELECT instrument, bar_index, ret AS x, (2 * close - high - low) / (high - low) AS y, volume AS z FROM r WHERE ret IS NOT NULL),
    e AS (SELECT instrument, bar_index, {", ".join(f"{EW.format(x=e, h=60)} AS {n}" for n, e in dict(mx='x', my='y', mz='z', xx='x*x', yy='y*y', zz='z*z', xy='x*y', xz='x*z', yz='y*z').items())} FROM v {WALL}),
    c AS (SELECT instrument, bar_index, unnest([{{'a': 'ret', 'b': 'clv', 'c': (xy - mx*my) / sqrt(greatest(xx - mx*mx, 1e-300) * greatest(yy - my*my, 1e-300))}},
      {{'a': 'ret', 'b': 'volume', 'c': (xz - mx*mz) / sqrt(greatest(xx - mx*mx, 1e-300) * greatest(zz - mz*mz, 1e-300))}},
      {{'a': 'clv', 'b': 'volume', 'c': (yz - my*mz) / sqrt(greatest(yy - my*my, 1e-300) * greatest(zz - mz*mz, 1e-300))}}]) AS s FROM e WHERE bar_index >= 5)
    SELECT instrument, bar_index, s.a AS a, s.b AS b, round(least(greatest(s.c, -0.999), 0.999), 6) AS corr FROM c""",
)
def ew_corr(spark, sf):
    x = rets(spark, sf).filter(F.col("ret").isNotNull()).withColumn("clv", B.clv()).select("instrument", "bar_index", "ret", "clv", "volume")
    c = R.ew_corr(x, ["ret", "clv", "volume"], 60.0)
    # two observations or fewer give 0/0 up to rounding noise
    return c.filter("bar_index >= 5").withColumn("corr", F.round("corr", 6))
