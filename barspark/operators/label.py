"""Triple-barrier labels, overlap and decay weights, effective sample size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .sequence import framed, running, w_block

# labels look at most this many rows per join bucket; spans touch one or two
BUCKET = 64
ID = ["instrument", "candidate_id"]


def opens_from_closes(bars: DataFrame) -> DataFrame:
    """Open = previous close (the first bar opens at its own close)."""
    return framed(bars, 1, {"open": F.coalesce(F.lag("close").over(w_block()), F.col("close"))})


def triple_barrier(
    bars: DataFrame, candidates: DataFrame, lag: int = 1, prefer_stop: bool = True, credit_target_gap: bool = False
) -> DataFrame:
    """First of gap-stop, gap-target, stop, target, else timeout at the close.

    candidates: instrument, candidate_id, bar_index, direction, stop_sigma,
    target_sigma, sigma, max_holding (>= lag).  Fill is the open of
    ``bar_index + lag``; candidates without a fill bar or a usable sigma drop out.
    The span join is an equi-join on (instrument, bucket of 64 bars) with the
    range as a residual, and the scan of a span is a partial aggregate.
    """
    if lag < 1:
        raise ValueError("lag must be at least 1")
    c = F.col
    px = bars.select("instrument", c("bar_index").alias("i"), "open", "high", "low", "close")
    x = candidates.filter((c("sigma") > 0) & ~F.isnan("sigma") & (c("sigma") < float("inf")))
    x = x.withColumns({"fill_index": c("bar_index") + lag, "vertical": c("bar_index") + c("max_holding")})
    fills = px.select("instrument", c("i").alias("fill_index"), c("open").alias("entry_price"))
    x = x.join(fills, ["instrument", "fill_index"])
    d = c("direction").cast("double")
    x = x.withColumns(
        {
            "stop_price": c("entry_price") * F.exp(-d * c("stop_sigma") * c("sigma")),
            "target_price": c("entry_price") * F.exp(d * c("target_sigma") * c("sigma")),
        }
    )
    x = x.withColumn(
        "bkt", F.explode(F.sequence(F.floor(c("fill_index") / BUCKET), F.floor(c("vertical") / BUCKET)))
    )
    span = px.withColumn("bkt", F.floor(c("i") / BUCKET)).join(x, ["instrument", "bkt"]).filter(
        (c("i") >= c("fill_index")) & (c("i") <= c("vertical"))
    )
    up, sp, tp = c("direction") > 0, c("stop_price"), c("target_price")
    later = c("i") > c("fill_index")
    gap_stop = later & F.when(up, c("open") <= sp).otherwise(c("open") >= sp)
    gap_tgt = later & F.when(up, c("open") >= tp).otherwise(c("open") <= tp)
    hit_stop = F.when(up, c("low") <= sp).otherwise(c("high") >= sp)
    hit_tgt = F.when(up, c("high") >= tp).otherwise(c("low") <= tp)
    same_bar = F.lit(-1 if prefer_stop else 1)
    outcome = (
        F.when(gap_stop, -1).when(gap_tgt, 1).when(hit_stop & hit_tgt, same_bar).when(hit_stop, -1).when(hit_tgt, 1)
    )
    price = (
        F.when(gap_stop, F.when(up, F.least(sp, c("open"))).otherwise(F.greatest(sp, c("open"))))
        .when(gap_tgt, c("open") if credit_target_gap else tp)
        .when(outcome < 0, sp)
        .when(outcome > 0, tp)
    )
    span = span.withColumns({"_o": outcome, "_p": price})
    hit_at = F.when(c("_o").isNotNull(), c("i"))
    keep = [k for k in candidates.columns if k not in ID] + [
        "fill_index", "vertical", "entry_price", "stop_price", "target_price",
    ]
    out = span.groupBy(*ID).agg(
        *[F.first(k).alias(k) for k in keep],
        F.min_by(F.struct("_o", "_p", "i"), hit_at).alias("_hit"),
        F.max_by(F.struct(c("close").alias("_p"), "i"), c("i")).alias("_end"),
    )
    exit_price = F.coalesce(c("_hit._p"), c("_end._p"))
    out = out.withColumns(
        {
            "exit_index": F.coalesce(c("_hit.i"), c("_end.i")),
            "exit_price": exit_price,
            "outcome": F.coalesce(c("_hit._o"), F.lit(0)).cast("long"),
            "ret_log": c("direction") * F.log(F.try_divide(exit_price, "entry_price")),
        }
    )
    # the span ends early only where the series does; a hit hides how far it ran
    last = bars.groupBy("instrument").agg(F.max("bar_index").alias("_last"))
    out = out.join(last, "instrument").withColumns(
        {
            "ret_sigma": c("ret_log") / c("sigma"),
            "holding_bars": c("exit_index") - c("fill_index"),
            "truncated": c("vertical") > c("_last"),
        }
    )
    return out.drop("_hit", "_end", "_last", "vertical")


def label_binary(timeout: str = "sign") -> Column:
    won = F.col("outcome") > 0
    if timeout == "sign":
        won = won | ((F.col("outcome") == 0) & (F.col("ret_sigma") > 0))
    return won.cast("double")


def label_counts(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    n = candidates.groupBy("instrument").agg(F.count(F.lit(1)).alias("_all"))

    def cnt(e):
        return F.sum(F.when(e, 1).otherwise(0))

    got = labels.groupBy("instrument").agg(
        cnt(F.col("outcome") == 1).alias("target"),
        cnt(F.col("outcome") == -1).alias("stop"),
        cnt(F.col("outcome") == 0).alias("timeout"),
        F.count(F.lit(1)).alias("_kept"),
        cnt(F.col("truncated")).alias("truncated"),
    )
    z = lambda k: F.coalesce(F.col(k), F.lit(0))
    return n.join(got, "instrument", "left").select(
        "instrument", z("target").alias("target"), z("stop").alias("stop"), z("timeout").alias("timeout"),
        (F.col("_all") - z("_kept")).alias("dropped"), z("truncated").alias("truncated"),
    )


def concurrency(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels open on each bar: +1 at entry, -1 after exit, running sum."""
    ends = labels.select(
        "instrument",
        F.inline(
            F.array(
                F.struct(F.col("bar_index").alias("bar_index"), F.lit(1).alias("step")),
                F.struct((F.col("exit_index") + 1).alias("bar_index"), F.lit(-1).alias("step")),
            )
        ),
    )
    step = ends.groupBy("instrument", "bar_index").agg(F.sum("step").alias("step"))
    x = bars.select("instrument", "bar_index").join(step, ["instrument", "bar_index"], "left")
    return running(x, {"open_labels": ("sum", F.coalesce(F.col("step"), F.lit(0)))}).drop("step")


def avg_uniqueness(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of 1/concurrency over each label's span, from one prefix sum."""
    inv = F.when(F.col("open_labels") > 0, 1.0 / F.col("open_labels")).otherwise(0.0)
    per_bar = checkpoint(concurrency(bars, labels).withColumn("_inv", inv))
    pre = running(per_bar, {"_cum": ("sum", F.col("_inv"))})
    at_exit = pre.select("instrument", F.col("bar_index").alias("exit_index"), F.col("_cum").alias("_hi"))
    at_entry = pre.select("instrument", "bar_index", (F.col("_cum") - F.col("_inv")).alias("_lo"))
    x = labels.join(at_exit, ["instrument", "exit_index"]).join(at_entry, ["instrument", "bar_index"])
    span = F.col("exit_index") - F.col("bar_index") + 1
    return x.withColumn("uniqueness", (F.col("_hi") - F.col("_lo")) / span).drop("_hi", "_lo")


def decay_weights(labels: DataFrame, halflife: float, anchor: str = "exit_index", normalize: bool = True) -> DataFrame:
    """2^(-age/h) with age from the newest anchor of the instrument."""
    ref = labels.groupBy("instrument").agg(F.max(anchor).alias("_ref"))
    x = labels.join(ref, "instrument").withColumn(
        "decay", F.pow(F.lit(2.0), -(F.col("_ref") - F.col(anchor)) / float(halflife))
    ).drop("_ref")
    return _mean_one(x, "decay") if normalize else x


def _mean_one(x: DataFrame, col: str) -> DataFrame:
    m = x.groupBy("instrument").agg(F.avg(col).alias("_m"))
    return x.join(m, "instrument").withColumn(
        col, F.when(F.col("_m") > 0, F.col(col) / F.col("_m")).otherwise(1.0)
    ).drop("_m")


def linear_decay(unique: DataFrame, last_weight: float = 0.0) -> DataFrame:
    """Weight linear in cumulative uniqueness by entry order, clipped at zero."""
    tot = unique.groupBy("instrument").agg(F.sum("uniqueness").alias("_tot"))
    x = running(unique, {"_cum": ("sum", F.col("uniqueness"))}).join(tot, "instrument")
    slope = (1.0 - last_weight) / F.col("_tot") if last_weight >= 0 else 1.0 / ((last_weight + 1.0) * F.col("_tot"))
    w = F.greatest(1.0 - slope * F.col("_tot") + slope * F.col("_cum"), F.lit(0.0))
    return x.withColumn("linear", F.when(F.col("_tot") > 0, w).otherwise(1.0)).drop("_cum", "_tot")


def combined_weights(bars: DataFrame, labels: DataFrame, halflife: float = 5040.0, decay: str = "exponential") -> DataFrame:
    """Uniqueness times decay, mean one per instrument."""
    x = avg_uniqueness(bars, labels)
    if decay == "exponential":
        x = decay_weights(x, halflife, normalize=False).withColumn("weight", F.col("uniqueness") * F.col("decay"))
    elif decay == "linear":
        x = linear_decay(x).withColumn("weight", F.col("uniqueness") * F.col("linear"))
    else:
        x = x.withColumn("weight", F.col("uniqueness"))
    return _mean_one(x, "weight")


def ess(weighted: DataFrame, keys=("instrument",)) -> DataFrame:
    """Kish, overlap and combined sample sizes and the t inflation they imply."""
    n, s1, s2 = F.count("weight"), F.sum("weight"), F.sum(F.col("weight") ** 2)
    x = weighted.groupBy(*keys).agg(
        n.alias("n"), (s1 * s1 / s2).alias("kish"), F.sum("uniqueness").alias("overlap")
    )
    return x.withColumn("combined", F.col("overlap") * F.col("kish") / F.col("n")).withColumn(
        "t_inflation", F.sqrt(F.col("n") / F.col("combined"))
    )


def weighted_stats(weighted: DataFrame, value: str = "ret_sigma", keys=("instrument",)) -> DataFrame:
    """Weighted mean and a t statistic on the Kish size."""
    keys, w, v = list(keys), F.col("weight"), F.col(value)
    x = weighted.filter(v.isNotNull() & w.isNotNull())
    a = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * v).alias("_wv"))
    a = a.select(*keys, "n", "_w", (F.col("_wv") / F.col("_w")).alias("mean"), (F.col("_w") ** 2 / F.col("_w2")).alias("kish"))
    # centred before squaring: the difference of two raw moments loses a small spread
    d = v - F.col("mean")
    s = x.join(a.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(w * d * d).alias("_wdd"))
    a = a.join(s, keys).withColumn("se", F.sqrt(F.col("_wdd") / F.col("_w") / F.col("kish")))
    ok = (F.col("n") >= 2) & (F.col("se") > 0) & (F.col("kish") > 1)
    return a.select(*keys, "n", "mean", "kish", "se", F.when(ok, F.col("mean") / F.col("se")).alias("t_stat"))
