"""Relational views of confirmed structure: pivots as events, readings as as-of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import running

c = F.col


def pivots(features: DataFrame) -> DataFrame:
    """One row per confirmed pivot, from the confirming bars of the feature fold."""
    return features.filter(c("pivot_kind").isNotNull()).select(
        "instrument", c("pivot_kind").alias("kind"), c("pivot_index").alias("bar_index"), c("pivot_price").alias("price"),
        c("bar_index").alias("confirmed_at"), "retrace_sigma",
    )


def pivot_state(bars: DataFrame, piv: DataFrame) -> DataFrame:
    """Last confirmed high and low, their ages, and where the close lies between them."""
    p = piv.select("instrument", c("confirmed_at").alias("bar_index"), "kind", "price")
    x = bars.join(p, ["instrument", "bar_index"], "left")  # one pivot confirms on a bar at most
    at = F.struct(c("price").alias("p"), c("bar_index").alias("t"))
    x = running(x, {"_h": ("last", F.when(c("kind") == "high", at)), "_l": ("last", F.when(c("kind") == "low", at))})
    hi, lo = c("_h.p"), c("_l.p")
    ok = hi > lo
    pos = F.least(F.greatest((c("close") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return x.select(
        "instrument", "bar_index", hi.alias("pivot_high"), lo.alias("pivot_low"), (c("bar_index") - c("_h.t")).alias("pivot_high_age"),
        (c("bar_index") - c("_l.t")).alias("pivot_low_age"), F.when(ok, pos).alias("range_pos"),
        F.when(ok & (c("sigma_bp") > 0), F.log(hi / lo) / c("sigma_bp")).alias("range_sigma"),
    )


def structure_bias(bars: DataFrame, piv: DataFrame) -> DataFrame:
    """Mean of +1 (rising) and -1 over the last two highs and the last two lows.

    Highs and lows alternate, so the pivot two back is the previous of its kind;
    it comes from a prefix scan over pivots, numbered densely.
    """
    k = running(piv, {"_n": ("sum", F.lit(1))}, order="confirmed_at")
    k = k.withColumn("_n", c("_n") - 1)
    prev = k.select("instrument", (c("_n") + 2).alias("_n"), c("price").alias("_before"))
    k = k.join(prev, ["instrument", "_n"], "left").withColumn(
        "_vote", F.when(c("price") > c("_before"), 1.0).when(c("_before").isNotNull(), -1.0)
    )
    x = bars.join(k.select("instrument", c("confirmed_at").alias("bar_index"), "kind", "_vote"), ["instrument", "bar_index"], "left")
    x = running(x, {"_h": ("last", F.when(c("kind") == "high", c("_vote"))), "_l": ("last", F.when(c("kind") == "low", c("_vote")))})
    have = F.array_compact(F.array("_h", "_l"))
    bias = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have))
    return x.select("instrument", "bar_index", bias.alias("structure_bias"))


def penetrations(f: DataFrame, min_pen: float = 0.25, heavy: float = 0.75, absorbed: float = 0.6) -> DataFrame:
    """Heavy bars that pierce a confirmed level by ``min_pen`` sigma and give back."""
    soak = F.coalesce(c("absorption_rank") >= absorbed, F.lit(False))
    low = (c("low") > 0) & (c("low") < c("pivot_low")) & (F.log(c("pivot_low") / c("low")) / c("sigma_bp") >= min_pen) & ((c("clv") > 0) | soak)
    high = (c("pivot_high") > 0) & (c("high") > c("pivot_high")) & (F.log(c("high") / c("pivot_high")) / c("sigma_bp") >= min_pen) & ((c("clv") < 0) | soak)
    item = lambda side, lv, pen: F.struct(F.lit(side).alias("side"), lv.alias("level"), pen.alias("pen"))
    hits = F.array_compact(
        F.array(
            F.when(low, item(1, c("pivot_low"), F.log(c("pivot_low") / c("low")) / c("sigma_bp"))),
            F.when(high, item(-1, c("pivot_high"), F.log(c("high") / c("pivot_high")) / c("sigma_bp"))),
        )
    )
    x = f.filter((c("sigma_bp") > 0) & (c("participation_rank") >= heavy))
    return x.select("instrument", c("bar_index").alias("pen_index"), F.inline(hits))


def sweeps(f: DataFrame, max_bars: int = 6, **kw) -> DataFrame:
    """Pierced levels reclaimed within ``max_bars``; the earliest one names the event of a bar.

    Each penetration meets its next six bars by equi-join, and resolves on the
    first that closes back through the level.
    """
    p = penetrations(f, **kw).withColumn("bar_index", F.explode(F.sequence(c("pen_index") + 1, c("pen_index") + max_bars)))
    x = p.join(f.select("instrument", "bar_index", "close"), ["instrument", "bar_index"])
    x = x.filter((c("close") - c("level")) * c("side") > 0)
    first = x.groupBy("instrument", "pen_index", "side").agg(
        F.min("bar_index").alias("reclaim_index"), F.first("level").alias("level"), F.first("pen").alias("penetration_sigma")
    )
    w = Window.partitionBy("instrument", "reclaim_index").orderBy("pen_index", F.desc("side"))  # at most 2 x max_bars rows
    one = first.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return one.select(
        "instrument", c("side").cast("long").alias("direction"), "level", "pen_index", "reclaim_index",
        (c("reclaim_index") - c("pen_index")).alias("bars_to_reclaim"), "penetration_sigma",
    )


def har_fit(x: DataFrame, steps: int = 50) -> DataFrame:
    """Simplex weights of the log volatility blend, from one pass of cross-product sums.

    x: sigma_short, sigma_rv, sigma_long and ``next`` (the volatility to forecast).
    The loss of any weights is a quadratic form of ten sums, so the grid is scored
    on one row.
    """
    a, b, d, y = F.log("sigma_short"), F.log("sigma_rv"), F.log("sigma_long"), F.log("next")
    v = {"a": a, "b": b, "d": d, "y": y}
    names = ["aa", "bb", "dd", "ab", "ad", "bd", "ay", "by", "dy", "yy"]
    s = x.filter((c("next") > 0)).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v[k[0]] * v[k[1]]).alias(k) for k in names])
    idx = F.sequence(F.lit(0), F.lit(steps))
    g = s.filter(c("n") >= 100).withColumn("i", F.explode(idx)).withColumn("j", F.explode(idx))
    w1 = c("i") / float(steps)
    g = g.withColumn("w_mid", w1).withColumn("w_long", (1.0 - c("w_mid")) * c("j") / float(steps))
    g = g.withColumn("w_short", 1.0 - c("w_mid") - c("w_long"))
    p, q, r = c("w_short"), c("w_mid"), c("w_long")
    loss = (
        p * p * c("aa") + q * q * c("bb") + r * r * c("dd") + 2 * p * q * c("ab") + 2 * p * r * c("ad") + 2 * q * r * c("bd")
        - 2 * p * c("ay") - 2 * q * c("by") - 2 * r * c("dy") + c("yy")
    ) / c("n")
    best = g.withColumn("loss", loss).groupBy("n").agg(F.min_by(F.struct("w_short", "w_mid", "w_long", "loss"), "loss").alias("b"))
    return best.select("n", "b.*")
