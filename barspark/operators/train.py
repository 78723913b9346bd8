"""From features to candidates, trained tables, walk-forward results and acceptance."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import calib, decide, edge, label, pool, scores, splits
from .metrics import INF

c = F.col
P_MIN, EBE_MIN, HAZARD_MAX, LCB_MIN, MIN_CAL = 0.58, 1.25, 0.35, 0.05, 200


def decision_inputs(features: DataFrame, side: DataFrame | None = None, peers: bool = False) -> DataFrame:
    """Scores, pooled evidence, setup, bucket, plan and cost on every bar.

    All nine engines live on the bar's row as one array, so scoring and pooling
    add no shuffle to the feature table.  ``side`` carries the optional feed
    columns (instrument, ts): spread_feed, implied_vol, days_to_event, ...
    """
    x = features if side is None else features.join(side, ["instrument", "ts"], "left")
    if "spread_feed" not in x.columns:
        x = x.withColumn("spread_feed", F.lit(None).cast("double"))
    if side is None and not peers:
        none = F.lit(None).cast("double")
        cols = ("implied_vol", "days_to_event", "gamma_imbalance", "oi_change", "_residual", "_expected", "_iv_base", "_iv_prev", "_oi_rank")
        x = x.withColumns({k: none for k in cols}).withColumn("_n_peers", F.lit(0.0))
    else:
        x = scores.with_side_data(x, peers)
    x = scores.with_state(x)
    x = x.withColumn("_e", F.array(*[f() for f in scores.ENGINES.values()]))
    x = pool.pool_array(x, "_e", len(scores.ENGINES))
    items = F.transform("_e", lambda e: F.struct(e["engine"], F.struct(e["score"], e["reliability"], e["valid"], e["features"])))
    x = x.withColumn("engines", F.map_from_entries(items))
    x = x.withColumns({"setup": scores.classify_setup(), "bucket": edge.evidence_bucket(c("log_odds"))})
    x = x.withColumn("n_invalid", F.size(F.filter("_e", lambda e: ~e["valid"]))).drop("_e")
    x = x.withColumns(decide.barrier_plan())
    return x.withColumns(decide.cost_estimate(decide.spread_used(), stress=decide.stress_multiplier()))


def candidates(rows: DataFrame) -> DataFrame:
    """Structurally eligible bars of :func:`decision_inputs`."""
    ok = (
        c("valid") & (c("direction") != 0) & (c("dominant") != 3)
        & ~c("phase").isin(*decide.TRADEABLE_OFF, *decide.AUCTIONS) & (c("ebe") >= EBE_MIN) & (c("p_success") >= P_MIN)
        & (c("hazard") <= HAZARD_MAX) & c("stop_sigma").isNotNull() & (c("cost_sigma") < INF)
    )
    return rows.filter(ok).select(
        "instrument", F.concat_ws(":", "instrument", "bar_index").alias("candidate_id"), "bar_index", "direction",
        c("dominant").alias("regime"), "setup", "bucket", "p_success", "log_odds", "ebe", "stop_sigma", "target_sigma",
        c("sigma_fcst").alias("sigma"), "max_holding", "cost_sigma",
    )


def train_edge(bars: DataFrame, cands: DataFrame, halflife: float = edge.HALFLIFE):
    """(statistics, calibration knots, diagnostics) from labelled candidates.

    Labels keep ``candidate_id``, so a dropped candidate cannot shift the rest.
    """
    lab = label.triple_barrier(bars, cands)
    w = checkpoint(label.combined_weights(bars, lab, halflife))
    stats = edge.edge_stats(w)
    hit = F.when(c("outcome") > 0, 1.0).otherwise(0.0)
    pairs = w.select(c("p_success").alias("p"), hit.alias("y"), "weight")
    n = w.count()
    fitted = n >= MIN_CAL
    knots = calib.isotonic_fit(pairs, weight="weight") if fitted else calib.isotonic_fit(pairs.limit(0))
    e = label.ess(w, keys=()).select("n", "combined", c("combined").alias("effective_sample_size"))
    m = w.agg(
        F.avg(hit).alias("hit_rate"), (F.sum(c("weight") * c("ret_sigma")) / F.sum("weight")).alias("mean_ret_sigma"),
        (F.sum(c("weight") * c("ret_sigma") ** 2) / F.sum("weight")).alias("_m2"), F.avg("cost_sigma").alias("mean_cost_sigma"),
    )
    total = cands.agg(F.count(F.lit(1)).alias("n_candidates"))
    d = e.crossJoin(m).crossJoin(total)  # three one-row aggregates
    var = c("_m2") - c("mean_ret_sigma") ** 2
    diag = d.select(
        "n_candidates", c("n").alias("n_labelled"), (c("n_candidates") - c("n")).alias("n_dropped"), "effective_sample_size",
        F.try_divide("effective_sample_size", "n_candidates").alias("uniqueness_ratio"),
        F.lit(1.0 if fitted else 0.0).alias("calibration_fitted"), "hit_rate", "mean_ret_sigma", "mean_cost_sigma",
        (c("mean_ret_sigma") - c("mean_cost_sigma")).alias("net_expectancy_sigma"),
        F.when(var > 0, c("mean_ret_sigma") / F.sqrt(var / F.greatest("effective_sample_size", F.lit(1.0)))).alias("t_stat_effective"),
    )
    return stats, knots, diag


def pooled_walkforward(bars: DataFrame, cands: DataFrame, frac: float = 0.6, lcb_min: float = LCB_MIN) -> DataFrame:
    """Train one book on the first part of every instrument, apply it to the rest.

    Training labels see only training bars, so a span that reaches the cut is
    closed there.
    """
    cut = bars.groupBy("instrument").agg(F.floor(frac * (F.max("bar_index") + 1)).alias("_cut"))
    b, s = bars.join(cut, "instrument"), cands.join(cut, "instrument")
    first_bars = b.filter(c("bar_index") < c("_cut")).drop("_cut")
    lab = label.triple_barrier(first_bars, s.filter(c("bar_index") < c("_cut")).drop("_cut"))
    post = edge.edge_posterior(edge.edge_stats(label.combined_weights(first_bars, lab)))
    test = label.triple_barrier(bars, s.filter(c("bar_index") >= c("_cut")).drop("_cut"))
    x = edge.edge_lookup(test, post.select(*edge.CELL, "mean", "lcb", "n_eff"))
    x = x.withColumn("taken", c("lcb") - c("cost_sigma") > lcb_min)
    return x.withColumn("net_sigma", c("ret_sigma") - c("cost_sigma"))


def walkforward_folds(bars: DataFrame, n_folds: int = 4, min_frac: float = 0.35) -> DataFrame:
    """(instrument, fold, tr_end, te_end): expanding prefix, equal test runs, edges truncated."""
    n = bars.groupBy("instrument").agg((F.max("bar_index") + 1).alias("n"))
    start = F.floor(c("n") * min_frac)
    x = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))

    def edge_at(i: Column) -> Column:
        return F.floor(start + i * (c("n") - start) / float(n_folds)).cast("long")

    return x.select("instrument", "fold", edge_at(c("fold")).alias("tr_end"), edge_at(c("fold") + 1).alias("te_end"))


def walkforward_train(bars: DataFrame, cands: DataFrame, n_folds: int = 4, min_frac: float = 0.35, lcb_min: float = LCB_MIN) -> DataFrame:
    """Out-of-sample labels of every fold with the book trained on its prefix, in one job.

    Features and labels are causal and computed once.  A training label that runs
    past its fold's prefix is closed at the prefix's last close, as if the later
    bars did not exist.
    """
    folds = walkforward_folds(bars, n_folds, min_frac)
    lab = checkpoint(label.triple_barrier(bars, cands))
    end_px = bars.select("instrument", (c("bar_index") + 1).alias("tr_end"), c("close").alias("_last"))
    f = folds.join(end_px, ["instrument", "tr_end"])
    x = lab.join(f, "instrument").filter(c("fill_index") < c("tr_end"))
    late = c("exit_index") >= c("tr_end")
    cut_ret = c("direction") * F.log(F.try_divide("_last", "entry_price"))
    x = x.withColumns(
        {
            "ret_sigma": F.when(late, cut_ret / c("sigma")).otherwise(c("ret_sigma")),
            "outcome": F.when(late, 0).otherwise(c("outcome")),
            "exit_index": F.when(late, c("tr_end") - 1).otherwise(c("exit_index")),
        }
    )
    # weights per (instrument, fold): the fold becomes part of the series name
    key = F.concat_ws("#", "instrument", "fold")
    tr = checkpoint(x.withColumns({"_inst": c("instrument"), "instrument": key}))
    fb = bars.select("instrument", "bar_index").join(folds, "instrument").filter(c("bar_index") < c("tr_end"))
    fb = fb.select(key.alias("instrument"), "bar_index")
    w = label.combined_weights(fb, tr).withColumn("instrument", c("_inst"))
    by = ("instrument", "fold")
    post = edge.edge_posterior(edge.edge_stats(w, by=by), by)
    test = lab.join(folds, "instrument").filter((c("bar_index") >= c("tr_end")) & (c("bar_index") < c("te_end")))
    y = edge.edge_lookup(test, post.select(*by, *edge.CELL, "mean", "lcb", "n_eff"), by)
    y = y.withColumn("taken", F.coalesce(c("lcb") - c("cost_sigma") > lcb_min, F.lit(False)))
    return y.withColumn("net_sigma", c("ret_sigma") - c("cost_sigma"))


# --------------------------------------------------------------------------- #
# ablation and acceptance


def ablation(score_rows: DataFrame, target: DataFrame, engines: list[str], objective: Column | None = None) -> DataFrame:
    """Objective of the full set, of every leave-one-out and of every engine alone.

    ``target`` gives ``value`` per bar; the default objective is the mean of
    direction x value over bars that take a side.  All scenarios are one job.
    """
    names = [("full", "", engines)] + [("without", e, [x for x in engines if x != e]) for e in engines] + [("solo", e, [e]) for e in engines]
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("name"), F.array(*[F.lit(x) for x in keep]).alias("keep")) for k, e, keep in names])
    x = score_rows.filter(c("engine").isin(*engines)).withColumn("_s", F.explode(table))
    x = x.filter(F.array_contains("_s.keep", c("engine"))).withColumns({"kind": c("_s.kind"), "name": c("_s.name")}).drop("_s")
    fused = pool.pool_log_odds(x, len(engines), ("kind", "name", "instrument", "bar_index"))
    j = fused.join(target, ["instrument", "bar_index"])
    obj = F.avg(F.when(c("direction") != 0, c("direction") * c("value"))) if objective is None else objective
    a = j.groupBy("instrument", "kind", "name").agg(F.coalesce(obj, F.lit(0.0)).alias("objective"))
    full = a.filter("kind = 'full'").select("instrument", c("objective").alias("full"))
    loo = a.filter("kind = 'without'").select("instrument", "name", c("objective").alias("leave_one_out"))
    solo = a.filter("kind = 'solo'").select("instrument", "name", c("objective").alias("solo"))
    y = loo.join(solo, ["instrument", "name"]).join(full, "instrument")
    y = y.withColumn("marginal", c("full") - c("leave_one_out"))
    tot = y.groupBy("instrument").agg(F.sum(F.greatest("marginal", F.lit(0.0))).alias("_t"))
    share = F.when(c("_t") > 0, F.greatest("marginal", F.lit(0.0)) / c("_t"))
    return y.join(tot, "instrument").withColumn("marginal_share", share).drop("_t")


# Acceptance thresholds (name, threshold, direction).
CRITERIA = (
    ("expectancy t-statistic", 3.0, ">="), ("trade count for power", 400.0, ">="), ("deflated sharpe ratio", 0.5, ">="),
    ("expected calibration error", 0.05, "<="), ("brier skill vs base rate", 0.0, ">="), ("brier score", 0.27, "<="),
    ("max drawdown", 0.25, "<="), ("worst plateau ratio", 1.35, "<="), ("surrogate p-value", 0.05, "<="),
    ("timing monotone", 1.0, ">="), ("effective breadth", 1.25, ">="), ("positive classes", 3.0, ">="),
)


def acceptance(metrics: DataFrame, keys=("instrument",), nan_fails: bool = True) -> DataFrame:
    """metrics: keys, name, observed.  A missing value fails; ``accepted`` needs every criterion met.

    Without ``nan_fails`` NaN compares as in SQL, above every number.
    """
    keys = list(keys)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("threshold"), F.lit(d).alias("direction")) for n, t, d in CRITERIA])
    every = metrics.select(*keys).distinct().select(*keys, F.inline(table))
    x = every.join(metrics, [*keys, "name"], "left")
    met = F.when(c("direction") == ">=", c("observed") >= c("threshold")).otherwise(c("observed") <= c("threshold"))
    x = x.withColumn("passed", F.coalesce(met & ~F.isnan("observed") if nan_fails else met, F.lit(False)))
    verdict = x.groupBy(*keys).agg(F.bool_and("passed").alias("accepted"))
    return x.join(verdict, keys)


