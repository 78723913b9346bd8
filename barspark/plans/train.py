"""Queries of structure events, training, walk-forward and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import float_div, sql_norm_cdf

from ..operators import bars as B
from ..operators import calib as C
from ..operators import decide as D
from ..operators import features as E


from ..operators import metrics as M

from ..operators import structure as ST
from ..operators import train as T
from ..operators.sequence import index_bars

from ..session import stored
from ..sources import fixtures as X
from .bars import hourly
from .calib import outcomes
from .decide import CORE, scores
from .edge import STATS, chain_sql, labels, signals, tb_sql, WEIGHTS, SIGNALS
from .features import CHAIN, features
from .metrics import rr
from .registry import query

KEYS = ["instrument", "bar_index"]


@query("pivots")
def pivots(spark, sf):
    return ST.pivots(features(spark, sf))


@query("pivot_state")
def pivot_state(spark, sf):
    f = features(spark, sf).select(*KEYS, "close", "sigma_bp")
    return ST.pivot_state(f, ST.pivots(features(spark, sf)))


@query("structure_bias")
def structure_bias(spark, sf):
    return ST.structure_bias(features(spark, sf).select(*KEYS), ST.pivots(features(spark, sf)))


@query("sweeps")
def sweeps(spark, sf):
    return ST.sweeps(features(spark, sf))


@query(
    "har_fit",
    f"""{CHAIN}, h AS (SELECT instrument, bar_index, ln(sigma_short) AS a, ln(sigma_rv) AS b, ln(sigma_long) AS c, ln(lead(sigma_short, 5) OVER (PARTITION BY instrument ORDER BY bar_index)) AS y FROM v3 WHERE sigma_short > 0 AND sigma_rv > 0 AND sigma_long > 0),
    s AS (SELECT count(*) AS n, sum(a*a) aa, sum(b*b) bb, sum(c*c) cc, sum(a*b) ab, sum(a*c) ac, sum(b*c) bc, sum(a*y) ay, sum(b*y) yb, sum(c*y) cy, sum(y*y) yy FROM h WHERE y IS NOT NULL),
    g AS (SELECT i / 50.0::DOUBLE AS w1, (1 - i / 50.0::DOUBLE) * j / 50.0::DOUBLE AS w2 FROM range(51) x(i), range(51) z(j)),
    l AS (SELECT n, 1 - w1 - w2 AS w0, w1, w2, ((1-w1-w2)*(1-w1-w2)*aa + w1*w1*bb + w2*w2*cc + 2*(1-w1-w2)*w1*ab + 2*(1-w1-w2)*w2*ac + 2*w1*w2*bc - 2*(1-w1-w2)*ay - 2*w1*yb - 2*w2*cy + yy) / n AS loss FROM s, g)
    SELECT n, round(arg_min(w0, loss), 4) AS w_short, round(arg_min(w1, loss), 4) AS w_mid, round(arg_min(w2, loss), 4) AS w_long, round(min(loss), 7) AS loss FROM l GROUP BY n""",
)
def har_fit(spark, sf):
    x = features(spark, sf).filter("sigma_short > 0 AND sigma_rv > 0 AND sigma_long > 0").select(*KEYS, "sigma_short", "sigma_rv", "sigma_long")
    nxt = x.select("instrument", (F.col("bar_index") - 5).alias("bar_index"), F.col("sigma_short").alias("next"))
    h = ST.har_fit(x.join(nxt, KEYS))
    return h.select("n", *[F.round(k, 4).alias(k) for k in ("w_short", "w_mid", "w_long")], F.round("loss", 7).alias("loss"))


def decision_rows(spark, sf):
    make = lambda: T.decision_inputs(features(spark, sf)).drop("engines")
    return stored(make, spark, X._name("decision_rows", sf))


@query("decision_inputs")
def decision_inputs(spark, sf):
    return T.decision_inputs(features(spark, sf)).drop("engines", "ts")


@query("candidates")
def candidates(spark, sf):
    return T.candidates(decision_rows(spark, sf))


@query("train_edge")
def train_edge(spark, sf):
    """The trained tables: cells, calibration knots and diagnostics, one row each, told apart by ``part``."""
    stats, knots, diag = T.train_edge(X.lineitem_bars(spark, sf), signals(spark, sf))
    names = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value")) for k in diag.columns])
    sums = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("n_w", "s1", "s2")])
    cell = F.concat_ws(":", "level", *[F.coalesce(F.col(k).cast("string"), F.lit("*")) for k in ("regime", "setup", "bucket")])
    parts = [
        stats.select(F.lit("cell").alias("part"), cell.alias("key"), F.inline(sums)),
        knots.select(F.lit("knot").alias("part"), F.col("x").cast("string").alias("key"), F.lit("y").alias("name"), F.col("y").alias("value")),
        diag.select(F.lit("diagnostic").alias("part"), F.lit("").alias("key"), F.inline(names)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chain(spark, sf):
    make = lambda: D.decisions(D.decision_events(decision_rows(spark, sf)))[0]
    return stored(make, spark, X._name("decision_chain", sf))


@query("decisions")
def decisions(spark, sf):
    """Every bar of every series through the whole chain on the real feature table, learning from its own trades."""
    return chain(spark, sf)


@query("decision_walk")
def decision_walk(spark, sf):
    """The chain on each series' last two fifths, from a book and a map trained on the first three."""
    bars, rows = X.lineitem_bars(spark, sf), decision_rows(spark, sf)
    cut = bars.groupBy("instrument").agg(F.floor(0.6 * (F.max("bar_index") + 1)).alias("_cut"))
    before = lambda df: df.join(cut, "instrument").filter(F.col("bar_index") < F.col("_cut")).drop("_cut")
    stats, knots, _ = T.train_edge(before(bars), before(T.candidates(rows)))
    later = rows.join(cut, "instrument").filter(F.col("bar_index") >= F.col("_cut")).drop("_cut")
    return D.decisions(D.decision_events(later), start=D.book_start(rows, stats, knots))[0]


@query("rejected_decision")
def rejected_decision(spark, sf):
    """Hourly bars through the validator: accepted ones are decided on their features, rejected ones keep their place and their reason."""
    raw = hourly(spark, sf)
    checked = stored(lambda: B.bar_validate(raw), spark, X._name("hourly_checked", sf))
    clean = B.clean_bars(raw, checked).drop("bar_index", "issues")
    fatal = raw.join(checked.filter("fatal"), ["instrument", "bar_index"]).select("instrument", "ts", F.array_join(F.array_except("issues", F.array(F.lit("large_time_gap"))), "+").alias("kind"))
    rows = T.decision_inputs(E.feature_table(index_bars(clean)))
    return D.decisions(D.decision_events(rows, fatal))[0].select("instrument", "seq", "bar_index", "action", "position", "veto")


WALK = f"""{SIGNALS}, ct AS (SELECT instrument, floor(0.6::DOUBLE * (max(bar_index) + 1)) AS cut FROM bars GROUP BY 1),
  allbars AS (SELECT * FROM bars), {tb_sql('sig', 'full_')}, trs AS (SELECT sig.* FROM sig JOIN ct USING (instrument) WHERE bar_index < cut)"""
_TRAIN = tb_sql("trs", "lab").replace("FROM bars", "FROM tbars").replace("JOIN bars", "JOIN tbars").replace("nb AS", "nb2 AS").replace("JOIN nb ON nb.", "JOIN nb2 ON nb2.")
_W = WEIGHTS[WEIGHTS.index(", st AS (SELECT"):].replace("FROM bars b", "FROM tbars b")
_S = STATS[STATS.index(", ob AS (SELECT"):]


@query(
    "pooled_walkforward",
    f"""{WALK}, tbars AS (SELECT bars.* FROM bars JOIN ct USING (instrument) WHERE bar_index < cut), {_TRAIN}{_W}{_S},
    joined AS (SELECT r.range AS regime, s.range AS setup, b.range AS bucket, coalesce(l.n_w, 0) AS nl, coalesce(l.s1, 0) AS s1l, coalesce(l.s2, 0) AS s2l, coalesce(m.n_w, 0) AS nm, coalesce(m.s1, 0) AS s1m, coalesce(m.s2, 0) AS s2m,
      t.n_w AS ng, t.s1 AS s1g, t.s2 AS s2g FROM range(4) r CROSS JOIN range(4) s CROSS JOIN range(5) b LEFT JOIN (SELECT * FROM es WHERE level = 'leaf') l ON l.regime = r.range AND l.setup = s.range AND l.bucket = b.range
      LEFT JOIN (SELECT * FROM es WHERE level = 'node') m ON m.regime = r.range AND m.setup = s.range CROSS JOIN (SELECT * FROM es WHERE level = 'root') t), {chain_sql('joined', 'post')}
    SELECT f.candidate_id, round(mean, 6) AS mean, round(lcb, 6) AS lcb, f.outcome, round(f.ret_sigma - f.cost_sigma, 6) AS net_sigma FROM full_ f JOIN ct ON ct.instrument = f.instrument JOIN post USING (regime, setup, bucket) WHERE f.bar_index >= cut""",
)
def pooled_walkforward(spark, sf):
    x = T.pooled_walkforward(X.lineitem_bars(spark, sf), signals(spark, sf))
    return x.select("candidate_id", F.round("mean", 6).alias("mean"), F.round("lcb", 6).alias("lcb"), "outcome", F.round("net_sigma", 6).alias("net_sigma"))


@query("walkforward_train")
def walkforward_train(spark, sf):
    x = T.walkforward_train(X.lineitem_bars(spark, sf), signals(spark, sf))
    return x.groupBy("instrument", "fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col("taken").cast("int")).alias("n_taken"), F.avg("net_sigma").alias("mean_net"),
        F.avg("mean").alias("mean_posterior"), F.avg("lcb").alias("mean_lcb"),
    )


@query("ablation")
def ablation(spark, sf):
    f = features(spark, sf).select("instrument", (F.col("bar_index") - 1).alias("bar_index"), F.col("ret_norm").alias("value"))
    return T.ablation(scores(spark, sf), f.filter("value IS NOT NULL"), list(CORE))


def acceptance_metrics(spark, sf):
    """Observed criteria of the labelled signals, one row per (instrument, name)."""
    lab = labels(spark, sf)
    w = M.trade_summary(lab).withColumn("expectancy_t", float_div(F.col("expectancy_sigma"), F.col("expectancy_se")))
    o = outcomes(spark, sf)
    h = C.brier_decomposition(o, 15, ("instrument",), float("-inf")).select("instrument", "brier", "ece", "skill")
    s = M.sharpe_inputs(lab, "ret_sigma").withColumn("d", M.dsr(20, 0.0025)).select("instrument", "d")
    flat = F.when(F.col("expectancy_se") == 0, float("nan"))  # equal trades: 0 / 0 in the moments
    x = w.join(h, "instrument").join(s, "instrument").withColumn("d", F.coalesce(flat, "d"))
    pairs = {
        "expectancy t-statistic": "expectancy_t", "trade count for power": "n_trades", "deflated sharpe ratio": "d",
        "expected calibration error": "ece", "brier skill vs base rate": "skill", "brier score": "brier",
    }
    items = F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).cast("double").alias("observed")) for k, v in pairs.items()])
    return x.select("instrument", F.inline(items))


_CRIT = ", ".join(f"('{n}', {t}::DOUBLE, '{d}')" for n, t, d in T.CRITERIA)
SR0 = M.expected_max_sharpe(20, 0.0025)


@query(
    "acceptance",
    f"""{WEIGHTS}, oc AS (SELECT instrument, p_success AS p, (outcome > 0)::INT::DOUBLE AS y FROM lab),
    hb AS (SELECT instrument, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS pb, avg(y) AS ob FROM oc GROUP BY 1, 2), hc AS (SELECT instrument, sum(n * abs(pb - ob)) / sum(n) AS ece FROM hb GROUP BY 1),
    ha AS (SELECT instrument, avg((p - y) * (p - y)) AS brier, 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS skill FROM oc GROUP BY 1),
    mm AS (SELECT instrument, count(*) AS n, avg(ret_sigma) AS mu, stddev_samp(ret_sigma) AS sd, avg(ret_sigma) / stddev_samp(ret_sigma) AS sr FROM lab GROUP BY 1),
    mk AS (SELECT l.instrument, avg(pow(ret_sigma - mu, 3)) / pow(avg(pow(ret_sigma - mu, 2)), 1.5) AS sk, avg(pow(ret_sigma - mu, 4)) / pow(avg(pow(ret_sigma - mu, 2)), 2) AS ku FROM lab l JOIN mm USING (instrument) GROUP BY 1),
    mz AS (SELECT *, (sr - {SR0!r}) * sqrt(n - 1) / sqrt(1 - sk * sr + 0.25 * (ku - 1) * sr * sr) AS z FROM mm JOIN mk USING (instrument)),
    ob_ AS (SELECT instrument, mu / (sd / sqrt(n)) AS "expectancy t-statistic", n::DOUBLE AS "trade count for power", {sql_norm_cdf('z')} AS "deflated sharpe ratio", ece AS "expected calibration error", skill AS "brier skill vs base rate", brier AS "brier score" FROM mz JOIN hc USING (instrument) JOIN ha USING (instrument)),
    lg AS (SELECT instrument, name, observed FROM ob_ UNPIVOT (observed FOR name IN ("expectancy t-statistic", "trade count for power", "deflated sharpe ratio", "expected calibration error", "brier skill vs base rate", "brier score"))),
    cr(name, threshold, direction) AS (VALUES {_CRIT}), al AS (SELECT i.instrument, cr.* FROM (SELECT DISTINCT instrument FROM lg) i CROSS JOIN cr),
    jn AS (SELECT al.*, observed, coalesce(CASE WHEN direction = '>=' THEN observed >= threshold ELSE observed <= threshold END, false) AS passed FROM al LEFT JOIN lg USING (instrument, name))
    SELECT instrument, name, round(observed, 6) AS observed, threshold, direction, passed, bool_and(passed) OVER (PARTITION BY instrument) AS accepted FROM jn""",
)
def acceptance(spark, sf):
    return T.acceptance(acceptance_metrics(spark, sf), nan_fails=False).withColumn("observed", F.round("observed", 6))
