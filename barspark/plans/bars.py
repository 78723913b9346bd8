"""Queries of bar building, validation, sessions and side tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import sql_uniform  # noqa: F401
from ..operators import bars as B
from ..operators.sequence import index_bars
from ..sources import fixtures as X
from .registry import query

HOURLY = """ev AS (SELECT event_type AS instrument, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  sum(value) AS volume, CAST(count(*) AS DOUBLE) AS trades FROM events GROUP BY 1, 2),
hb AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS BIGINT) bar_index FROM ev)"""


def hourly(spark, sf):
    return index_bars(B.ohlcv_tumbling(X.event_ticks(spark, sf)))


def ntz(c="ts"):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query(
    "ohlcv_tumbling",
    f"WITH {HOURLY} SELECT instrument, ts, open, high, low, close, round(volume, 6) AS volume, trades FROM ev",
)
def ohlcv_tumbling(spark, sf):
    b = B.ohlcv_tumbling(X.event_ticks(spark, sf))
    return b.select("instrument", ntz(), "open", "high", "low", "close", F.round("volume", 6).alias("volume"), "trades")


@query(
    "bar_consistency",
    f"""WITH {HOURLY}, x AS (SELECT instrument, low <= open AND open <= high AND low <= close AND close <= high AND low > 0
      AND volume >= 0 AS ok FROM hb) SELECT instrument, ok, count(*) AS n FROM x GROUP BY 1, 2""",
)
def bar_consistency(spark, sf):
    b = hourly(spark, sf)
    ok = B.is_consistent() & (F.col("low") > 0)
    return b.groupBy("instrument", ok.alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bar_columns",
    f"""WITH {X.LINEITEM_BARS} SELECT instrument, bar_index, round((high + low + close) / 3.0, 6) AS typical,
      round(ln(high / low), 8) AS log_range,
      round(CASE WHEN high - low <= 0 THEN 0 ELSE (2 * close - high - low) / (high - low) END, 6) AS clv,
      (high + low + close) / 3.0 * volume AS dollar_volume FROM bars""",
)
def bar_columns(spark, sf):
    b = B.bar_columns(X.lineitem_bars(spark, sf))
    return b.select(
        "instrument", "bar_index", F.round("typical", 6).alias("typical"), F.round("log_range", 8).alias("log_range"),
        F.round("clv", 6).alias("clv"), "dollar_volume",
    )


RATIOS = "[" + ", ".join(f"{n}/{d}" for n, d in B.SPLIT_RATIOS) + "]"


@query("bar_validate")
def bar_validate(spark, sf):
    return B.bar_validate(hourly(spark, sf)).select("instrument", "bar_index", "issues", "fatal")


VAL_LAG = f"""{HOURLY}, d AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS dt, lag(close) OVER w AS pc FROM hb
    WINDOW w AS (PARTITION BY instrument ORDER BY bar_index)),
  e AS (SELECT *, list(CASE WHEN bar_index = 1 THEN 2 ELSE 1 END * dt) OVER (PARTITION BY instrument ORDER BY bar_index
    ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS dts FROM d),
  f AS (SELECT *, list_sum(list_transform(list_reverse(list_filter(dts, lambda x: x IS NOT NULL)), lambda x, i: x * pow(0.5::DOUBLE, i))) AS run FROM e),
  g AS (SELECT *, CASE WHEN pc > 0 AND abs(ln(close / pc)) > 0.75 THEN
     CASE WHEN len(list_filter({RATIOS}, lambda t: abs(close / pc / t - 1) < 0.02)) > 0 THEN 'probable_split' ELSE 'extreme_return' END END AS fk FROM f),
  iss AS (SELECT instrument, bar_index, fk IS NOT NULL AS fatal, unnest(list_filter([CASE WHEN dt > 20 * run THEN 'large_time_gap' END, fk,
     CASE WHEN fk IS NULL AND volume <= 0 THEN 'zero_volume' END, CASE WHEN fk IS NULL AND high = low THEN 'zero_range' END], lambda x: x IS NOT NULL)) AS kind FROM g)"""


@query("bar_validate_lag", f"WITH {VAL_LAG} SELECT instrument, bar_index, fatal, kind FROM iss")
def bar_validate_lag(spark, sf):
    return B.issue_rows(B.bar_validate_lag(hourly(spark, sf)))


@query(
    "split_ratio",
    f"""WITH {HOURLY}, d AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY bar_index) AS r FROM hb)
    SELECT instrument, bar_index, CASE WHEN len(list_filter({RATIOS}, lambda t: abs(r / t - 1) < 0.02)) > 0 THEN 'probable_split'
      ELSE 'extreme_return' END AS kind FROM d WHERE abs(ln(r)) > 0.75""",
)
def split_ratio(spark, sf):
    r = F.exp(F.col("ret"))
    x = B.returns(hourly(spark, sf)).filter(F.abs("ret") > 0.75)
    return x.select("instrument", "bar_index", B.split_kind(r).alias("kind"))


@query(
    "validation_report",
    f"""WITH {VAL_LAG}, t AS (SELECT count(*) AS seen, CAST(count(fk) AS BIGINT) AS rejected FROM g)
    SELECT kind, count(*) AS n, any_value(seen) AS seen, any_value(rejected) AS rejected,
      any_value(seen) - any_value(rejected) AS accepted,
      round((any_value(seen) - any_value(rejected)) / any_value(seen), 8) AS acceptance_rate FROM iss, t GROUP BY kind""",
)
def validation_report(spark, sf):
    r = B.validation_report(B.bar_validate_lag(hourly(spark, sf)))
    return r.withColumn("acceptance_rate", F.round("acceptance_rate", 8))


@query("clean_bars")
def clean_bars(spark, sf):
    return B.clean_bars(hourly(spark, sf)).select("instrument", ntz(), "bar_index", "open", "high", "low", "close", "volume", "issues")


@query(
    "returns",
    f"""WITH {X.LINEITEM_BARS} SELECT instrument, bar_index,
     round(ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY bar_index)), 9) AS ret FROM bars""",
)
def returns(spark, sf):
    return B.returns(X.lineitem_bars(spark, sf)).select("instrument", "bar_index", F.round("ret", 9).alias("ret"))


@query(
    "htf_bars",
    f"""WITH {X.LINEITEM_BARS} SELECT instrument, bar_index // 5 AS htf_index, max(ts) AS ts, arg_min(open, bar_index) AS open,
     max(high) AS high, min(low) AS low, arg_max(close, bar_index) AS close, sum(volume) AS volume
     FROM bars GROUP BY 1, 2 HAVING count(*) = 5""",
)
def htf_bars(spark, sf):
    h = B.htf_bars(X.lineitem_bars(spark, sf), 5)
    return h.select("instrument", "htf_index", ntz(), "open", "high", "low", "close", "volume")


@query("activity_bars")
def activity_bars(spark, sf):
    a = B.activity_bars(X.lineitem_bars(spark, sf), "dollar", k=3.0)
    return a.select("instrument", ntz(), "open", "high", "low", "close", "volume", "trades", "delta")


def _session_sql(offset, phase, frac):
    return f"""WITH {HOURLY}, l AS (SELECT *, ts + INTERVAL '{offset} hours' AS lt FROM hb),
    m AS (SELECT *, hour(lt) * 60 + minute(lt) AS mi, CAST(lt AS DATE) AS day FROM l),
    p AS (SELECT *, mi - 570 AS rel, lag(day) OVER w AS pday, lag(close) OVER w AS pc FROM m WINDOW w AS (PARTITION BY instrument ORDER BY bar_index))
    SELECT instrument, bar_index, CAST(isodow(lt) - 1 AS BIGINT) AS dow, CAST({phase} AS BIGINT) AS phase, round({frac}, 8) AS tod_frac,
      CAST(least(floor(({frac}) * 13), 12) AS BIGINT) AS tod_bucket, coalesce(day <> pday, false) AS new_session,
      round(CASE WHEN day <> pday THEN ln(open / pc) END, 8) AS overnight_ret,
      CAST(row_number() OVER (PARTITION BY instrument, day ORDER BY bar_index) - 1 AS BIGINT) AS bars_since_open FROM p"""


PHASE_EQ = """CASE WHEN rel < -5 THEN 1 WHEN rel < 5 THEN 2 WHEN rel > 395 THEN 7 WHEN rel > 385 THEN 6
  WHEN rel / 390.0::DOUBLE < 0.3 THEN 3 WHEN rel / 390.0::DOUBLE < 0.65 THEN 4 ELSE 5 END"""
PHASE_24 = """CASE WHEN mi / 60.0::DOUBLE >= 9.5 AND mi / 60.0::DOUBLE < 10 THEN 2 WHEN mi BETWEEN 600 AND 719 THEN 3
  WHEN mi BETWEEN 720 AND 839 THEN 4 WHEN mi BETWEEN 840 AND 944 THEN 5 WHEN mi BETWEEN 945 AND 974 THEN 6 ELSE 8 END"""
SESSION_COLS = ("dow", "phase", "tod_bucket", "new_session", "bars_since_open")


def _session(spark, sf, profile):
    x = B.session_tag(hourly(spark, sf), profile)
    return x.select(
        "instrument", "bar_index", *SESSION_COLS, F.round("tod_frac", 8).alias("tod_frac"),
        F.round("overnight_ret", 8).alias("overnight_ret"),
    )


@query("session_tag", _session_sql(-5, PHASE_EQ, "least(greatest(rel / 390.0::DOUBLE, 0), 1)"))
def session_tag(spark, sf):
    return _session(spark, sf, "us_equity")


@query(
    "session_phase",
    f"""WITH {HOURLY}, m AS (SELECT instrument, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts) - 570 AS rel FROM hb)
    SELECT instrument, CAST({PHASE_EQ} AS BIGINT) AS phase, count(*) AS n FROM m GROUP BY 1, 2""",
)
def session_phase(spark, sf):
    return B.session_tag(hourly(spark, sf), "us_equity").groupBy("instrument", "phase").agg(F.count(F.lit(1)).alias("n"))


@query("continuous_phase", _session_sql(0, PHASE_24, "mi / 1440.0::DOUBLE"))
def continuous_phase(spark, sf):
    return _session(spark, sf, "crypto")


@query(
    "exog_align",
    f"""WITH {X.LINEITEM_BARS}, {X.EXOG} SELECT instrument, bar_index, round(spread, 8) AS spread, round(implied_vol, 6) AS implied_vol,
      days_to_event FROM bars LEFT JOIN exog USING (instrument, ts)""",
)
def exog_align(spark, sf):
    b = X.lineitem_bars(spark, sf)
    return B.exog_align(b, X.exog(b)).select(
        "instrument", "bar_index", F.round("spread", 8).alias("spread"), F.round("implied_vol", 6).alias("implied_vol"),
        "days_to_event",
    )


@query(
    "exog_asof",
    f"""WITH {X.LINEITEM_BARS}, {X.EXOG} SELECT b.instrument, bar_index, round(spread, 8) AS spread, round(implied_vol, 6) AS implied_vol
      FROM bars b ASOF LEFT JOIN exog e ON b.instrument = e.instrument AND b.ts >= e.ts""",
)
def exog_asof(spark, sf):
    b = X.lineitem_bars(spark, sf)
    x = B.exog_asof(b, X.exog(b), ["spread", "implied_vol"])
    return x.select(
        "instrument", "bar_index", F.round("spread", 8).alias("spread"), F.round("implied_vol", 6).alias("implied_vol")
    )


@query(
    "peer_returns",
    f"""WITH {X.LINEITEM_BARS}, r AS (SELECT instrument, ts, bar_index, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY bar_index)) AS ret FROM bars),
    p AS (SELECT a.instrument, a.bar_index, b.instrument AS peer, b.ret, row_number() OVER (PARTITION BY a.instrument, a.bar_index ORDER BY b.instrument) AS k
      FROM r a JOIN r b ON a.ts = b.ts AND a.instrument <> b.instrument WHERE b.ret IS NOT NULL)
    SELECT instrument, bar_index, peer, round(ret, 9) AS ret FROM p WHERE k <= 8""",
)
def peer_returns(spark, sf):
    x = B.peer_returns(B.returns(X.lineitem_bars(spark, sf)).select("instrument", "ts", "bar_index", "ret"))
    return x.select("instrument", "bar_index", F.explode("peers").alias("peer", "ret")).withColumn("ret", F.round("ret", 9))
