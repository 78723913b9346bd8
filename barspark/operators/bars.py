"""Bar building, cleaning, sessions and side tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..kernels.data import SPLIT_RATIOS, activity_clock, validate
from .sequence import fold, framed, index_bars, running, w_block, w_last


def ohlcv_tumbling(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Ticks (instrument, ts, event_id, price, size) to close-stamped bars."""
    at = F.struct("ts", "event_id")
    return (
        ticks.groupBy("instrument", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).cast("double").alias("trades"),
        )
        .select(
            "instrument", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume", "trades",
            F.lit(None).cast("double").alias("delta"), F.lit(False).alias("partial"),
        )
    )


def is_consistent() -> Column:
    """low <= open, close <= high; low > 0; volume >= 0; NULL counts as broken."""
    c = F.col
    ok = (
        (c("low") <= c("open")) & (c("open") <= c("high")) & (c("low") <= c("close")) & (c("close") <= c("high"))
        & (c("low") > 0) & (c("volume") >= 0)
    )
    return F.coalesce(ok, F.lit(False))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def clv() -> Column:
    span = F.col("high") - F.col("low")
    return F.when(span <= 0, F.lit(0.0)).otherwise((2.0 * F.col("close") - F.col("high") - F.col("low")) / span)


def bar_columns(bars: DataFrame) -> DataFrame:
    return bars.withColumns(
        {
            "typical": typical(),
            "log_range": F.log(F.col("high") / F.col("low")),
            "clv": clv(),
            "dollar_volume": typical() * F.col("volume"),
        }
    )


def split_kind(ratio: Column, tol: float = 0.02) -> Column:
    near = F.exists(
        F.array(*[F.lit(n / d) for n, d in SPLIT_RATIOS]), lambda t: F.abs(ratio / t - 1.0) < tol
    )
    return F.when(near, "probable_split").otherwise("extreme_return")


def bar_validate(bars: DataFrame, **kw) -> DataFrame:
    """Issues against the last accepted bar; ``bar_index`` is arrival order."""
    rows = bars.select(
        "instrument", "bar_index", "partial", "open", "high", "low", "close", "volume",
        (F.unix_micros(F.col("ts")) / 1e6).alias("sec"),
    )
    return fold(rows, validate(**kw), "instrument string, bar_index long, issues array<string>, fatal boolean")


def bar_validate_lag(bars: DataFrame, max_abs_return: float = 0.75, gap_multiple: float = 20.0) -> DataFrame:
    """Relational form: each bar against the row before it, accepted or not."""
    sec = F.unix_micros(F.col("ts")) / 1e6
    x = bars.withColumn("sec", sec)
    x = framed(
        x, 1, {"psec": F.lag("sec").over(w_block()), "pclose": F.lag("close").over(w_block())}
    ).withColumn("dt", F.col("sec") - F.col("psec"))
    # running gap = mean of itself and the new gap: weights 2^-k, 64 terms are exact in double
    pos = F.pmod(F.col("bar_index"), F.lit(512)) + 512 * F.col("halo_shift")
    first_twice = F.when(F.col("bar_index") == 1, 2.0).otherwise(1.0) * F.col("dt")
    from .sequence import own_rows, with_lookback

    y = with_lookback(x, 64, block=512)
    y = y.withColumn("halo_shift", F.when(F.col("halo"), 0).otherwise(1))
    y = y.withColumn("pos", pos.cast("double"))
    y = y.withColumn("wd", first_twice * F.pow(F.lit(2.0), F.col("pos") - 512.0))
    before = w_block().rowsBetween(-64, -1)
    y = y.withColumn("run_dt", F.sum("wd").over(before) / F.pow(F.lit(2.0), F.col("pos") - 512.0))
    y = own_rows(y)
    bad = F.lit(False)
    for c in ("open", "high", "low", "close", "volume"):
        bad = bad | finite(F.col(c)).isNull()
    ret = F.log(F.try_divide("close", "pclose"))
    extreme = (F.col("pclose") > 0) & (F.abs(ret) > max_abs_return)
    fatal = (
        F.when(F.col("partial"), "partial_bar")
        .when(bad, "non_finite")
        .when(F.col("dt") < 0, "time_reversal")
        .when(F.col("dt") == 0, "duplicate_timestamp")
        .when(extreme, split_kind(F.col("close") / F.col("pclose")))
    )
    y = y.withColumn("fatal_kind", fatal)
    soft = F.col("fatal_kind").isNull()
    issues = F.array_compact(
        F.array(
            F.when((F.col("dt") > 0) & (F.col("dt") > gap_multiple * F.col("run_dt")), "large_time_gap"),
            F.col("fatal_kind"),
            F.when(soft & (F.col("volume") <= 0), "zero_volume"),
            F.when(soft & (F.col("high") == F.col("low")), "zero_range"),
        )
    )
    return y.select("instrument", "bar_index", issues.alias("issues"), F.col("fatal_kind").isNotNull().alias("fatal"))


def issue_rows(checked: DataFrame) -> DataFrame:
    return checked.select("instrument", "bar_index", F.explode("issues").alias("kind"), "fatal")


def validation_report(checked: DataFrame) -> DataFrame:
    """Counts by kind, largest first, beside the totals."""
    total = checked.agg(
        F.count(F.lit(1)).alias("seen"), F.sum(F.col("fatal").cast("long")).alias("rejected")
    )
    counts = issue_rows(checked).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    one_row = F.broadcast(total)  # an ungrouped aggregate: always one row
    return (
        counts.join(one_row)
        .select(
            "kind", "n", "seen", "rejected", (F.col("seen") - F.col("rejected")).alias("accepted"),
            ((F.col("seen") - F.col("rejected")) / F.col("seen")).alias("acceptance_rate"),
        )
        .orderBy(F.desc("n"), "kind")
    )


def clean_bars(bars: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Drop fatal bars; keep the other issues beside the bar."""
    checked = bar_validate(bars) if checked is None else checked
    keep = checked.filter(~F.col("fatal")).select("instrument", "bar_index", "issues")
    return bars.join(keep, ["instrument", "bar_index"])


def returns(bars: DataFrame) -> DataFrame:
    return framed(bars, 1, {"ret": F.log(F.try_divide("close", F.lag("close").over(w_block())))})


def htf_bars(bars: DataFrame, multiple: int = 5) -> DataFrame:
    """Every ``multiple`` bars make one; an incomplete tail is not emitted."""
    b = F.col("bar_index")
    return (
        bars.groupBy("instrument", F.floor(b / multiple).alias("htf_index"))
        .agg(
            F.max("ts").alias("ts"),
            F.max("bar_index").alias("last_index"),
            F.min_by("open", b).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", b).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") == multiple)
        .drop("n")
    )


def activity_bars(bars: DataFrame, mode: str = "dollar", **kw) -> DataFrame:
    """Bars closed by traded activity; an unfinished tail is discarded."""
    act = {"dollar": typical() * F.col("volume"), "volume": F.col("volume")}.get(
        mode, F.coalesce(F.col("trades"), F.lit(1.0))
    )
    groups = fold(
        bars.select("instrument", "bar_index", act.cast("double").alias("act")),
        activity_clock(**kw),
        "instrument string, bar_index long, first_index long, closes boolean",
    )
    b = F.col("bar_index")
    return (
        bars.join(groups, ["instrument", "bar_index"])
        .groupBy("instrument", "first_index")
        .agg(
            F.max("ts").alias("ts"),
            F.max(b).alias("last_index"),
            F.min_by("open", b).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", b).alias("close"),
            F.sum("volume").alias("volume"),
            F.when(F.sum("trades") > 0, F.sum("trades")).alias("trades"),
            F.when(F.count("delta") == F.count(F.lit(1)), F.sum("delta")).alias("delta"),
            F.max("closes").alias("closed"),
        )
        .filter("closed")
        .drop("closed")
    )


# --------------------------------------------------------------------------- #
# sessions


@dataclass(frozen=True)
class Session:
    utc_offset_hours: float
    open_minute: int
    close_minute: int
    continuous: bool = False
    daily: bool = False
    auction_minutes: int = 5


# Session profiles (offset hours, open minute, close minute).
SESSIONS = {
    "us_equity": Session(-5.0, 570, 960),
    "us_futures": Session(-5.0, 0, 1440, continuous=True),
    "crypto": Session(0.0, 0, 1440, continuous=True),
    "fx": Session(0.0, 0, 1440, continuous=True),
    "daily": Session(0.0, 0, 1440, continuous=True, daily=True),
}
# Phase codes.
PHASES = (
    "all_day", "pre_open", "opening_auction", "morning", "midday", "afternoon", "closing_auction", "post_close",
    "overnight",
)


def session_phase(rel: Column, span: int, auction: int = 5) -> Column:
    frac = rel / span
    return (
        F.when(rel < -auction, 1)
        .when(rel < auction, 2)
        .when(rel > span + auction, 7)
        .when(rel > span - auction, 6)
        .when(frac < 0.3, 3)
        .when(frac < 0.65, 4)
        .otherwise(5)
    )


def continuous_phase(minute: Column) -> Column:
    cuts = ((570, 8), (600, 2), (720, 3), (840, 4), (945, 5), (975, 6))
    out = None
    for edge, code in cuts:
        out = F.when(minute < edge, code) if out is None else out.when(minute < edge, code)
    return out.otherwise(8)


def phase_label(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHASES]), code + 1)


def session_tag(bars: DataFrame, profile: str = "daily", n_buckets: int = 13) -> DataFrame:
    """Local clock columns; the day is the partition of the in-session count."""
    s = SESSIONS[profile]
    local = F.timestamp_seconds(F.unix_micros(F.col("ts")) / 1e6 + s.utc_offset_hours * 3600.0)
    x = bars.withColumn("_local", local).withColumn("_day", F.to_date("_local"))
    x = framed(
        x, 1, {"_pday": F.lag("_day").over(w_block()), "_pclose": F.lag("close").over(w_block())}
    )
    new = F.col("_pday").isNotNull() & (F.col("_day") != F.col("_pday"))
    minute = F.hour("_local") * 60 + F.minute("_local")
    if s.daily:
        phase, frac = F.lit(0), F.lit(0.5)
    elif s.continuous:
        phase, frac = continuous_phase(minute), minute / 1440.0
    else:
        rel, span = minute - s.open_minute, s.close_minute - s.open_minute
        phase = session_phase(rel, span, s.auction_minutes)
        frac = F.least(F.greatest(rel / span, F.lit(0.0)), F.lit(1.0))
    bucket = F.lit(0) if s.daily else F.least(F.floor(frac * n_buckets), F.lit(n_buckets - 1))
    in_day = Window.partitionBy("instrument", "_day").orderBy("bar_index")
    return (
        x.withColumns(
            {
                "dow": F.weekday("_local").cast("long"),
                "phase": phase.cast("long"),
                "tod_frac": frac.cast("double"),
                "tod_bucket": bucket.cast("long"),
                "new_session": new,
                "overnight_ret": F.when(new & (F.col("_pclose") > 0), F.log(F.col("open") / F.col("_pclose"))),
                "bars_since_open": (F.row_number().over(in_day) - 1).cast("long"),
            }
        )
        .drop("_local", "_day", "_pday", "_pclose")
    )


# --------------------------------------------------------------------------- #
# side tables


def exog_align(bars: DataFrame, feed: DataFrame) -> DataFrame:
    return bars.join(feed, ["instrument", "ts"], "left")


def exog_asof(bars: DataFrame, feed: DataFrame, cols: list[str]) -> DataFrame:
    """Latest feed row at or before each bar's close."""
    return asof(bars.select("instrument", "ts", "bar_index"), feed, cols)


def asof(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """As-of join on (instrument, ts): one union, one prefix scan of last-known values."""
    types = dict(right.dtypes)
    a = right.select("instrument", "ts", F.lit(0).alias("_k"), F.struct(*cols).alias("_r"), F.lit(None).cast("long").alias("bar_index"))
    row_type = "struct<" + ",".join(f"{c}:{types[c]}" for c in cols) + ">"
    b = left.select("instrument", "ts", F.lit(1).alias("_k"), F.lit(None).cast(row_type).alias("_r"), "bar_index")
    u = index_bars(a.unionByName(b), order=("ts", "_k"), name="_i")
    u = running(u, {"_last": ("last", F.col("_r"))}, order="_i")
    return u.filter("_k = 1").select("instrument", "ts", "bar_index", *[F.col(f"_last.{c}").alias(c) for c in cols])


def peer_returns(rets: DataFrame, peer_sets: DataFrame | None = None) -> DataFrame:
    """Map of the peers' returns at the same time, by peer.

    ``peer_sets`` holds (instrument, peer); without it all other instruments are peers.  A map lists each of them,
    so its size is that of the peer set.
    """
    have = rets.filter(F.col("ret").isNotNull()).select("ts", F.col("instrument").alias("peer"), F.col("ret").alias("_ret"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    if peer_sets is None:
        sets = have.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("peer", "_ret"))).alias("_all"))
        others = F.filter("_all", lambda e: e["peer"] != F.col("instrument"))
        return rets.join(sets, "ts", "left").withColumn("peers", F.coalesce(F.map_from_entries(others), empty)).drop("_all")
    wanted = rets.select("ts", "instrument").distinct().join(peer_sets.select("instrument", "peer").filter("peer <> instrument").distinct(), "instrument")
    found = wanted.join(have, ["peer", "ts"]).groupBy("ts", "instrument").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("peer", "_ret")))).alias("_peers"))
    return rets.join(found, ["ts", "instrument"], "left").withColumn("peers", F.coalesce("_peers", empty)).drop("_peers")
