"""Feature drift, execution drift and the demotion ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calib import brier_decomposition
from .sequence import quantiles, running, w_block, with_lookback, own_rows

# Alarm levels and ladder names.
BRIER_ALARM, PSI_ALARM, SLIP_ALARM, EBE_MIN, MIN_CAL = 0.27, 0.25, 2.0, 1.25, 200
LEVELS = ("normal", "tightened", "restricted", "no trade", "halted")


def psi(reference: DataFrame, live: DataFrame, keys: list[str], bins: int = 10, eps: float = 1e-6, min_ref: int = 50, min_live: int = 20, value: str = "value") -> DataFrame:
    """Population stability index on the reference's own quantile bins."""
    q = quantiles(reference, keys, value, [i / bins for i in range(1, bins)])
    edges = q.select(*keys, F.array_distinct(F.array(*[f"q_{i}" for i in range(bins - 1)])).alias("_e"))
    both = reference.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_r")).unionByName(
        live.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_r"))
    )
    x = both.filter(F.col("_v").isNotNull()).join(edges, keys)
    x = x.withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col("_v")))).groupBy(*keys, "_b").agg(
        F.sum("_r").alias("_nr"), F.sum(1 - F.col("_r")).alias("_nl"), F.first(F.size("_e") + 1).alias("_k")
    )
    tot = x.groupBy(*keys).agg(F.sum("_nr").alias("_tr"), F.sum("_nl").alias("_tl"), F.count(F.lit(1)).alias("_seen"), F.first("_k").alias("_k"))
    x = x.drop("_k").join(tot, keys)
    rp = F.greatest(F.try_divide("_nr", "_tr"), F.lit(eps))
    lp = F.greatest(F.try_divide("_nl", "_tl"), F.lit(eps))
    out = x.groupBy(*keys).agg(
        F.sum((lp - rp) * F.log(lp / rp)).alias("_psi"), F.first("_tr").alias("n_ref"), F.first("_tl").alias("n_live")
    )
    # bins empty on both sides add (eps - eps) = 0
    return out.select(*keys, "n_ref", "n_live", F.when((F.col("n_ref") >= min_ref) & (F.col("n_live") >= min_live), F.col("_psi")).alias("psi"))


def psi_split(long: DataFrame, ref_bars: int = 2000, live_obs: int = 500, min_live: int = 100) -> tuple[DataFrame, DataFrame]:
    """Reference = first ``ref_bars`` valid bars, live = last ``live_obs`` values per feature.

    long: instrument, bar_index, valid_no (0-based number of the valid bar), feature, value.
    Instruments that have not reached ``ref_bars`` have no frozen reference yet.
    """
    seen = long.groupBy("instrument").agg((F.max("valid_no") + 1).alias("_nv"))
    x = long.join(seen.filter(F.col("_nv") >= ref_bars), "instrument")
    ref = x.filter(F.col("valid_no") < ref_bars).select("instrument", "feature", "value")
    keys = ("instrument", "feature")
    y = running(x, {"_k": ("sum", F.lit(1))}, keys)
    tot = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    live = y.join(tot.filter(F.col("_t") >= min_live), list(keys)).filter(F.col("_k") > F.col("_t") - live_obs)
    return ref, live.select(*keys, "value")


def psi_monitor(long: DataFrame, **kw) -> DataFrame:
    """Worst feature per instrument."""
    ref, live = psi_split(long, **kw)
    p = psi(ref, live, ["instrument", "feature"])
    return p.filter(F.col("psi").isNotNull()).groupBy("instrument").agg(
        F.max("psi").alias("psi_max"), F.max_by("feature", F.struct("psi", "feature")).alias("worst_feature"),
        F.count(F.lit(1)).alias("n_features"),
    )


def last_n(rows: DataFrame, n: int, order: str, keys=("instrument",)) -> DataFrame:
    """The last ``n`` rows per key."""
    x = running(rows, {"_k": ("sum", F.lit(1))}, keys, order)
    tot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    return x.join(tot, list(keys)).filter(F.col("_k") > F.col("_t") - n).drop("_k", "_t")


def slippage_ratio(fills: DataFrame, window: int = 100, min_n: int = 10, order: str = "bar_index") -> DataFrame:
    """Median realised / modelled cost of the last fills."""
    ok = fills.filter((F.col("modelled") > 0) & F.col("realised").isNotNull())
    x = last_n(ok, window, order)
    a = x.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(F.col("realised") / F.col("modelled"), F.lit(0.5)).alias("_m")
    )
    return a.select("instrument", "n", F.when(F.col("n") >= min_n, F.col("_m")).alias("slippage_ratio"))


def findings(least: int = 50) -> Column:
    """Named findings from columns n, brier, skill, psi_max, ebe_full, slippage_ratio; ``least`` outcomes are scored."""
    c = F.col
    scored = c("n") >= least
    return F.array_compact(
        F.array(
            F.when(scored & (c("brier") > BRIER_ALARM), "brier_alarm").when(scored & (c("brier") > 0.9 * BRIER_ALARM), "brier_near_alarm"),
            F.when(scored & (c("skill") < 0), F.when(c("n") >= MIN_CAL, "negative_skill").otherwise("negative_skill_noted")),
            F.when(c("psi_max") > PSI_ALARM, F.concat(F.lit("feature_drift:"), "worst_feature")),
            F.when(c("ebe_full") < EBE_MIN, "breadth_collapsed"),
            F.when(c("slippage_ratio") > SLIP_ALARM, "slippage"),
        )
    )


def demotion_level(least: int = 50) -> Column:
    """0 normal, 1 tightened, 2 restricted, 3 no trade: the worst finding decides."""
    c = F.col
    scored = c("n") >= least
    z = F.lit(0)
    return F.greatest(
        F.when(scored & (c("brier") > BRIER_ALARM), 3).when(scored & (c("brier") > 0.9 * BRIER_ALARM), 1).otherwise(z),
        F.when(scored & (c("skill") < 0) & (c("n") >= MIN_CAL), 3).otherwise(z),
        F.when(c("psi_max") > PSI_ALARM, 2).otherwise(z),
        F.when(c("ebe_full") < EBE_MIN, 2).otherwise(z),
        F.when(c("slippage_ratio") > SLIP_ALARM, 3).otherwise(z),
    ).cast("long")


def demotion_effect(level: Column, max_posterior: Column) -> tuple[Column, Column]:
    """(throttle, block) on sizing."""
    throttle = F.when(level == 1, 0.5).otherwise(1.0)
    block = (level >= 3) | ((level == 2) & (max_posterior < 0.75))
    return throttle, block


def health(outcomes: DataFrame, psi_rows: DataFrame | None = None, slip: DataFrame | None = None, ebe_full: float | None = None, keep: int | None = None, least: int = 50, alike: float | None = None) -> DataFrame:
    """One health row per instrument from its outcomes (pos, p, y), all or the last ``keep``; fewer than ``least`` are not judged by
    score, and ``alike`` is the skill where all outcomes are the same."""
    d = brier_decomposition(outcomes if keep is None else last_n(outcomes, keep, "pos"), 15, ("instrument",), alike)
    x = d.select("instrument", "n", "brier", "ece", "skill")
    x = x.join(psi_rows, "instrument", "left") if psi_rows is not None else x.withColumns(
        {"psi_max": F.lit(None).cast("double"), "worst_feature": F.lit(None).cast("string")}
    )
    x = x.join(slip.select("instrument", "slippage_ratio"), "instrument", "left") if slip is not None else x.withColumn(
        "slippage_ratio", F.lit(None).cast("double")
    )
    x = x.withColumn("ebe_full", F.lit(ebe_full).cast("double"))
    return x.withColumns({"findings": findings(least), "level": demotion_level(least)})


def health_stream(bars: DataFrame, outcomes: DataFrame, every: int = 50, min_n: int = 50) -> DataFrame:
    """Level at every 50th bar from all outcomes resolved by then; transitions only.

    Brier and base rate are prefix sums over bars, so a report costs one row.
    """
    o = outcomes.groupBy("instrument", F.col("pos").alias("bar_index")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum((F.col("p") - F.col("y")) ** 2).alias("_s"), F.sum("y").alias("_y")
    )
    x = bars.select("instrument", "bar_index").join(o, ["instrument", "bar_index"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a report precedes the bar's own exits
    x = running(x, {"n": ("sum", z("_c")), "s": ("sum", z("_s")), "yy": ("sum", z("_y"))}, inclusive=False)
    x = x.filter((F.col("bar_index") % every == 0) & (F.col("bar_index") > 0))
    base = F.try_divide("yy", "n")
    x = x.withColumn("n", z("n")).withColumn("brier", F.try_divide("s", "n")).withColumn("_u", base * (1.0 - base))
    x = x.withColumn("skill", 1.0 - F.try_divide("brier", "_u"))
    x = x.withColumns({c: F.lit(None).cast("double") for c in ("psi_max", "ebe_full", "slippage_ratio")})
    x = x.withColumn("level", demotion_level()).withColumn("_r", F.floor(F.col("bar_index") / every))
    x = own_rows(with_lookback(x, 1, order="_r").withColumn("_p", F.lag("level").over(w_block(order="_r"))))
    return x.filter(F.col("level") != F.coalesce(F.col("_p"), F.lit(0))).select("instrument", "bar_index", "n", "brier", "level")


