"""Queries of performance metrics, resampling, splits and stress."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.expr import float_div, norm_ppf, sql_norm_cdf, sql_uniform
from ..operators import bars as B
from ..operators import label as L
from ..operators import metrics as M
from ..operators import resample as R
from ..operators import splits as S
from ..operators import stress as T
from ..sources import fixtures as X
from ..session import stored
from .edge import LABELS, SIGNALS, labels, signals, tb_sql
from .features import PART
from .registry import query
from .rolling import RET


def rr(df, digits, keys, *cols):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


def rets(spark, sf):
    return B.returns(X.lineitem_bars(spark, sf)).select("instrument", "bar_index", "ret")


def moments_sql(src, v, by="instrument"):
    return f"""mm AS (SELECT {by}, count({v}) AS n, sum({v}) AS sm, avg({v}) AS mu, stddev_samp({v}) AS sd, sqrt(avg(least({v}, 0) * least({v}, 0))) AS dn,
      quantile_cont({v}, 0.05) AS q05, quantile_cont({v}, 0.95) AS q95 FROM {src} WHERE {v} IS NOT NULL GROUP BY 1),
    mo AS (SELECT any_value(mm) AS s, {by} AS k, avg(pow({v} - mu, 3)) / pow(avg(pow({v} - mu, 2)), 1.5) AS skew, avg(pow({v} - mu, 4)) / pow(avg(pow({v} - mu, 2)), 2) AS kurt
      FROM {src} JOIN mm USING ({by}) WHERE {v} IS NOT NULL GROUP BY {by})"""


DD = f"""e AS (SELECT instrument, bar_index, exp(sum(coalesce(ret, 0)) OVER ({PART})) AS eq FROM r),
  e2 AS (SELECT *, max(eq) OVER ({PART}) AS pk, 1 - eq / max(eq) OVER ({PART}) AS dd FROM e),
  e3 AS (SELECT *, sum(CASE WHEN dd > 0 THEN 0 ELSE 1 END) OVER ({PART}) AS isl FROM e2),
  tr AS (SELECT instrument, max(dd) AS max_drawdown, arg_min(bar_index, (-dd, bar_index)) AS trough_index, arg_min(pk, (-dd, bar_index)) AS top FROM e3 GROUP BY 1),
  pkx AS (SELECT tr.instrument, min(CASE WHEN eq = top THEN bar_index END) AS peak_index, min(CASE WHEN bar_index >= trough_index AND eq >= top THEN bar_index END) AS back FROM e3 JOIN tr USING (instrument) GROUP BY 1),
  uw AS (SELECT instrument, max(c) AS max_underwater FROM (SELECT instrument, isl, count(CASE WHEN dd > 0 THEN 1 END) AS c FROM e3 GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "return_summary",
    f"""{RET}, {moments_sql('r', 'ret')}, {DD}
    SELECT k AS instrument, s.n AS n, round(exp(s.sm) - 1, 7) AS total_return, round(exp(s.mu * 252) - 1, 7) AS annualized_return, round(s.sd * sqrt(252), 7) AS annualized_vol,
      round(s.mu / s.sd, 7) AS sharpe, round(s.mu / s.sd * sqrt(252), 6) AS sharpe_annualized,
      round(sqrt((1 - skew * s.mu / s.sd + 0.25 * (kurt - 1) * pow(s.mu / s.sd, 2)) / (s.n - 1)), 7) AS sharpe_se,
      round(s.mu / s.dn * sqrt(252), 6) AS sortino_annualized, round((exp(s.mu * 252) - 1) / max_drawdown, 6) AS calmar, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis,
      round(abs(s.q95) / abs(s.q05), 6) AS tail_ratio FROM mo JOIN tr ON tr.instrument = k""",
)
def return_summary(spark, sf):
    x = M.return_summary(rets(spark, sf))
    return x.select(
        "instrument", "n", *[F.round(c, 7).alias(c) for c in ("total_return", "annualized_return", "annualized_vol", "sharpe", "sharpe_se")],
        *[F.round(c, 6).alias(c) for c in ("sharpe_annualized", "sortino_annualized", "calmar", "skew", "kurtosis", "tail_ratio")],
    )


@query(
    "drawdown",
    f"""{RET}, {DD} SELECT instrument, round(max_drawdown, 8) AS max_drawdown, peak_index, trough_index, trough_index - peak_index AS duration,
      coalesce(CAST(back - trough_index AS DOUBLE), 'infinity'::DOUBLE) AS time_to_recover, max_underwater FROM tr JOIN pkx USING (instrument) JOIN uw USING (instrument)""",
)
def drawdown(spark, sf):
    return M.drawdown(rets(spark, sf)).withColumn("max_drawdown", F.round("max_drawdown", 8))


@query(
    "trade_summary",
    f"""{LABELS} SELECT instrument, count(*) AS n_trades, round(avg((ret_log > 0)::INT), 8) AS hit_rate, round(sqrt(avg((ret_log > 0)::INT) * (1 - avg((ret_log > 0)::INT)) / count(*)), 8) AS hit_rate_se,
      round(sum(CASE WHEN ret_log > 0 THEN ret_log END) / -sum(CASE WHEN ret_log < 0 THEN ret_log END), 6) AS profit_factor,
      round(avg(CASE WHEN ret_log > 0 THEN ret_log END), 8) AS avg_win, round(avg(CASE WHEN ret_log < 0 THEN ret_log END), 8) AS avg_loss,
      round(abs(avg(CASE WHEN ret_log > 0 THEN ret_log END) / avg(CASE WHEN ret_log < 0 THEN ret_log END)), 6) AS win_loss_ratio,
      round(avg(ret_log), 8) AS mean_trade, round(median(ret_log), 8) AS median_trade, round(avg(ret_sigma), 7) AS expectancy_sigma,
      round(stddev_samp(ret_sigma) / sqrt(count(*)), 7) AS expectancy_se, round(avg(ret_sigma) / (stddev_samp(ret_sigma) / sqrt(count(*))), 6) AS expectancy_t
     FROM lab GROUP BY 1""",
)
def trade_summary(spark, sf):
    x = M.trade_summary(labels(spark, sf))
    # a series without wins or without losses has no mean of them and no ratio
    win, loss = F.col("avg_win") > 0, F.col("avg_loss") < 0
    x = x.withColumns({"profit_factor": F.when(win & loss, F.col("profit_factor")), "win_loss_ratio": F.when(win & loss, F.col("win_loss_ratio"))})
    x = x.withColumns({"avg_win": F.when(win, F.col("avg_win")), "avg_loss": F.when(loss, F.col("avg_loss"))})
    x = x.withColumn("expectancy_t", float_div(F.col("expectancy_sigma"), F.col("expectancy_se")))
    d = dict(hit_rate=8, hit_rate_se=8, profit_factor=6, avg_win=8, avg_loss=8, win_loss_ratio=6, mean_trade=8, median_trade=8, expectancy_sigma=7, expectancy_se=7, expectancy_t=6)
    return x.select("instrument", "n_trades", *[F.round(c, n).alias(c) for c, n in d.items()])


@query(
    "worst_streak",
    f"""{LABELS}, s AS (SELECT instrument, row_number() OVER ({PART}) AS k, sum(ret_sigma) OVER ({PART} ROWS 9 PRECEDING) AS s10, ret_sigma FROM lab)
    SELECT instrument, round(coalesce(min(CASE WHEN k >= 10 THEN s10 END), sum(ret_sigma)), 6) AS worst_streak FROM s GROUP BY 1""",
)
def worst_streak(spark, sf):
    return rr(M.worst_streak(labels(spark, sf), 10), 6, ["instrument"], "worst_streak")


@query(
    "loss_streak",
    f"""{LABELS}, s AS (SELECT instrument, ret_sigma, sum(CASE WHEN ret_sigma <= 0 THEN 0 ELSE 1 END) OVER ({PART}) AS isl FROM lab),
    g AS (SELECT instrument, isl, count(CASE WHEN ret_sigma <= 0 THEN 1 END) AS c FROM s GROUP BY 1, 2) SELECT instrument, max(c) AS max_consecutive_losses FROM g GROUP BY 1""",
)
def loss_streak(spark, sf):
    return M.loss_streak(labels(spark, sf))


SHARPE = f"{RET}, {moments_sql('r', 'ret')}, sh AS (SELECT k AS instrument, s.n AS n, s.mu / s.sd AS sr, 1 - skew * s.mu / s.sd + 0.25 * (kurt - 1) * pow(s.mu / s.sd, 2) AS v FROM mo)"


@query("psr", f"{SHARPE}, z AS (SELECT *, sr * sqrt(n - 1) / sqrt(v) AS z FROM sh) SELECT instrument, n, round({sql_norm_cdf('z')}, 6) AS psr FROM z")
def psr(spark, sf):
    return M.sharpe_inputs(rets(spark, sf)).select("instrument", "n", F.round(M.psr(), 6).alias("psr"))


SR0 = M.expected_max_sharpe(20, 0.0025)


@query("dsr", f"{SHARPE}, z AS (SELECT *, (sr - {SR0!r}) * sqrt(n - 1) / sqrt(v) AS z FROM sh) SELECT instrument, n, round({sql_norm_cdf('z')}, 6) AS dsr FROM z")
def dsr(spark, sf):
    return M.sharpe_inputs(rets(spark, sf)).select("instrument", "n", F.round(M.dsr(20, 0.0025), 6).alias("dsr"))


@query("min_track_record", f"{SHARPE} SELECT instrument, round(CASE WHEN sr > 0 THEN 1 + v * pow({norm_ppf(0.95)!r} / sr, 2) ELSE 'infinity'::DOUBLE END, 3) AS min_length FROM sh")
def min_track_record(spark, sf):
    v = M.min_track_record()
    return M.sharpe_inputs(rets(spark, sf)).select("instrument", F.when(v < float("inf"), F.round(v, 3)).otherwise(v).alias("min_length"))


Z95 = norm_ppf(0.975)


@query(
    "win_rate_ci",
    f"""{LABELS}, a AS (SELECT instrument, count(*) AS n, count(CASE WHEN ret_sigma > 0 THEN 1 END) AS wins FROM lab GROUP BY 1),
    b AS (SELECT *, wins::DOUBLE / n AS p FROM a)
    SELECT instrument, n, wins, round(sqrt(p * (1 - p) / n), 8) AS se,
      round(greatest((p + {Z95**2!r} / (2*n)) / (1 + {Z95**2!r} / n) - {Z95!r} * sqrt(p*(1-p)/n + {Z95**2!r}/(4.0::DOUBLE*n*n)) / (1 + {Z95**2!r} / n), 0), 7) AS ci_low,
      round(least((p + {Z95**2!r} / (2*n)) / (1 + {Z95**2!r} / n) + {Z95!r} * sqrt(p*(1-p)/n + {Z95**2!r}/(4.0::DOUBLE*n*n)) / (1 + {Z95**2!r} / n), 1), 7) AS ci_high FROM b""",
)
def win_rate_ci(spark, sf):
    x = M.win_rate_ci(labels(spark, sf))
    return x.select("instrument", "n", "wins", F.round("se", 8).alias("se"), F.round("ci_low", 7).alias("ci_low"), F.round("ci_high", 7).alias("ci_high"))


@query(
    "trades_needed",
    f"""{LABELS}, a AS (SELECT instrument, avg((ret_sigma > 0)::INT) AS p FROM lab GROUP BY 1)
    SELECT instrument, CAST(CASE WHEN p <> 0.5 THEN ceil(pow({norm_ppf(0.975)!r} * sqrt(0.25) + {norm_ppf(0.8)!r} * sqrt(p * (1 - p)), 2) / pow(p - 0.5, 2)) ELSE 2147483647 END AS BIGINT) AS trades FROM a""",
)
def trades_needed(spark, sf):
    a = labels(spark, sf).groupBy("instrument").agg(F.avg(F.when(F.col("ret_sigma") > 0, 1.0).otherwise(0.0)).alias("p"))
    return a.select("instrument", M.trades_needed(F.lit(0.5), F.col("p")).cast("long").alias("trades"))


@query(
    "regime_breakdown",
    f"""{LABELS} SELECT instrument, regime, count(ret_sigma) AS n, round(count(ret_sigma)::DOUBLE / any_value(c), 8) AS share, round(avg(ret_sigma), 7) AS mean, round(sum(ret_sigma), 5) AS total,
      round(avg(ret_sigma) / stddev_samp(ret_sigma), 7) AS sharpe, round(avg((ret_sigma > 0)::INT), 8) AS hit_rate
      FROM lab JOIN (SELECT instrument, count(*) AS c FROM lab GROUP BY 1) USING (instrument) GROUP BY 1, 2""",
)
def regime_breakdown(spark, sf):
    x = M.regime_breakdown(labels(spark, sf)).withColumn("sharpe", float_div(F.col("mean"), F.col("std")))
    d = dict(share=8, mean=7, total=5, sharpe=7, hit_rate=8)
    return x.select("instrument", "regime", "n", *[F.round(c, n).alias(c) for c, n in d.items()])


# --------------------------------------------------------------------------- #
# splits

N_TEST = 8
GROUPS = f"""{LABELS}, kn AS (SELECT *, ntile(8) OVER ({PART}) - 1 AS grp FROM lab),
  sp AS (SELECT instrument, grp, min(bar_index) AS st, max(exit_index) AS en, count(*) AS n FROM kn GROUP BY 1, 2)"""


def roles_sql(tests):
    values = ", ".join(f"({i}, {g})" for i, t in enumerate(tests) for g in t)
    return f"""{GROUPS}, tg(split_id, g) AS (VALUES {values}), sids AS (SELECT DISTINCT split_id FROM tg),
    nbars AS (SELECT instrument, ceil(0.01 * (max(bar_index) + 1)) AS emb FROM bars GROUP BY 1),
    rl AS (SELECT s.split_id, k.instrument, k.candidate_id, k.bar_index, k.exit_index,
      bool_or(k.grp = tg.g) AS is_test, bool_or(k.bar_index <= en AND k.exit_index >= st) AS ov, bool_or(k.bar_index > en AND k.bar_index <= en + emb) AS em
      FROM kn k CROSS JOIN sids s JOIN tg ON tg.split_id = s.split_id JOIN sp ON sp.instrument = k.instrument AND sp.grp = tg.g JOIN nbars b ON b.instrument = k.instrument GROUP BY 1, 2, 3, 4, 5),
    roles AS (SELECT *, CASE WHEN is_test THEN 'test' WHEN ov THEN 'purged' WHEN em THEN 'embargoed' ELSE 'train' END AS role FROM rl)"""


@query("cv_groups", f"{GROUPS} SELECT instrument, grp, st AS start, en AS \"end\", n FROM sp")
def cv_groups(spark, sf):
    return S.group_spans(S.cv_groups(labels(spark, sf), 8))


KF, CP = [(g,) for g in range(8)], list(itertools.combinations(range(8), 2))


@query("purged_kfold", f"{roles_sql(KF)} SELECT split_id, candidate_id, role FROM roles")
def purged_kfold(spark, sf):
    return S.purged_kfold(labels(spark, sf), X.lineitem_bars(spark, sf), 8, 0.01).select("split_id", "candidate_id", "role")


@query("cpcv_splits", f"{roles_sql(CP)} SELECT split_id, candidate_id, role FROM roles")
def cpcv_splits(spark, sf):
    return S.cpcv_splits(labels(spark, sf), X.lineitem_bars(spark, sf), 8, 2, 0.01).select("split_id", "candidate_id", "role")


@query(
    "cpcv_paths",
    f"""{GROUPS}, tg(split_id, g) AS (VALUES {", ".join(f"({i}, {g})" for i, t in enumerate(CP) for g in t)}),
    p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY split_id) - 1 AS path FROM tg)
    SELECT p.split_id, CAST(p.g AS BIGINT) AS grp, p.path, instrument, st AS start, n FROM p JOIN sp ON sp.grp = p.g""",
)
def cpcv_paths(spark, sf):
    spans = S.group_spans(S.cv_groups(labels(spark, sf), 8))
    return S.cpcv_paths(spark, 8, 2).join(spans, "grp").select("split_id", "grp", "path", "instrument", "start", "n")


@query(
    "leakage_report",
    f"""{roles_sql(CP)}, c AS (SELECT instrument, split_id, count(CASE WHEN role = 'train' THEN 1 END) AS tr, count(CASE WHEN role = 'purged' THEN 1 END) AS pu, count(CASE WHEN role = 'embargoed' THEN 1 END) AS em FROM roles GROUP BY 1, 2),
    n AS (SELECT instrument, count(*) AS n FROM lab GROUP BY 1)
    SELECT instrument, count(*) AS n_splits, any_value(n) AS n_samples, CAST(sum(pu) AS BIGINT) AS purged_total, CAST(sum(em) AS BIGINT) AS embargoed_total, 0::BIGINT AS overlap_violations, 0::BIGINT AS duplicate_violations,
      round(avg(tr) / any_value(n), 8) AS mean_train_fraction, round((sum(pu) + sum(em)) / (count(*) * any_value(n)), 8) AS dropped_fraction, true AS ok FROM c JOIN n USING (instrument) GROUP BY 1""",
)
def leakage_report(spark, sf):
    lab = labels(spark, sf)
    roles = S.cpcv_splits(lab, X.lineitem_bars(spark, sf), 8, 2, 0.01)
    x = S.leakage_report(roles, S.cv_groups(lab, 8))
    return x.withColumns({c: F.round(c, 8) for c in ("mean_train_fraction", "dropped_fraction")})


WF = f"""WITH {X.LINEITEM_BARS}, nn AS (SELECT instrument, max(bar_index) + 1 AS n FROM bars GROUP BY 1)"""


def _fold_counts(spark, sf, folds):
    x = S.assign_folds(X.lineitem_bars(spark, sf).select("instrument", "bar_index"), folds)
    return x.groupBy("instrument", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("bar_index").alias("first"), F.max("bar_index").alias("last")
    )


COUNTS = """SELECT b.instrument, CAST(fold AS INTEGER) AS fold, CASE WHEN bar_index >= t0 THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(bar_index) AS first, max(bar_index) AS last
  FROM bars b JOIN f ON f.instrument = b.instrument AND ((bar_index >= a0 AND bar_index < a1) OR (bar_index >= t0 AND bar_index < t1)) GROUP BY 1, 2, 3"""


@query(
    "walkforward_anchored",
    f"""{WF}, ed AS (SELECT instrument, i, CAST(round_even(500 + i * (n - 500) / 4.0::DOUBLE, 0) AS BIGINT) AS e FROM nn, range(5) t(i)),
    f AS (SELECT a.instrument, a.i AS fold, 0 AS a0, a.e - 20 AS a1, a.e AS t0, b.e AS t1 FROM ed a JOIN ed b ON a.instrument = b.instrument AND b.i = a.i + 1) {COUNTS}""",
)
def walkforward_anchored(spark, sf):
    return _fold_counts(spark, sf, S.anchored_folds(X.lineitem_bars(spark, sf), 4, 500, 20))


@query(
    "walkforward_rolling",
    f"""{WF}, f AS (SELECT instrument, i AS fold, i * 200 AS a0, i * 200 + 500 AS a1, i * 200 + 510 AS t0, i * 200 + 710 AS t1 FROM nn, range(1000) t(i) WHERE i * 200 + 710 <= n) {COUNTS}""",
)
def walkforward_rolling(spark, sf):
    return _fold_counts(spark, sf, S.rolling_folds(X.lineitem_bars(spark, sf), 500, 200, None, 10))


FOLDV = f"{GROUPS}, fv AS (SELECT instrument, CAST(grp AS BIGINT) AS fold, avg(ret_sigma) AS value FROM kn GROUP BY 1, 2)"


def fold_values(spark, sf):
    g = S.cv_groups(labels(spark, sf), 8)
    return g.groupBy("instrument", F.col("grp").alias("fold")).agg(F.avg("ret_sigma").alias("value"))


@query(
    "parameter_drift",
    f"""{FOLDV}, l AS (SELECT *, lag(value) OVER w AS p, lag(sign(value)) OVER w AS ps FROM fv WINDOW w AS (PARTITION BY instrument ORDER BY fold)),
    a AS (SELECT instrument, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, avg(abs(value - p) / abs(p)) AS marc, count(CASE WHEN sign(value) <> ps THEN 1 END) AS sign_flips FROM l GROUP BY 1)
    SELECT instrument, n, round(mean, 7) AS mean, round(std, 7) AS std, round(std / abs(mean), 5) AS cv, round(CASE WHEN lo > 0 THEN hi / lo WHEN hi < 0 THEN lo / hi ELSE 'infinity'::DOUBLE END, 5) AS max_over_min,
      round(marc, 5) AS mean_abs_rel_change, sign_flips, CASE WHEN sign_flips > 0 THEN 'sign-unstable' WHEN std / abs(mean) <= 0.5 THEN 'stable' ELSE 'drifting' END AS verdict FROM a""",
)
def parameter_drift(spark, sf):
    x = S.parameter_drift(fold_values(spark, sf), ["instrument"])
    m = F.col("max_over_min")
    return x.select(
        "instrument", "n", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), F.round("cv", 5).alias("cv"),
        F.when(m < float("inf"), F.round(m, 5)).otherwise(m).alias("max_over_min"),
        F.round("mean_abs_rel_change", 5).alias("mean_abs_rel_change"), "sign_flips", "verdict",
    )


@query(
    "fold_stability",
    f"""{FOLDV} SELECT instrument, count(*) AS n_folds, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 6) AS t_stat,
     round(avg((value > 0)::INT), 8) AS fraction_positive, round(min(value), 7) AS minimum, round(median(value), 7) AS median, round(max(value), 7) AS maximum,
     round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 7) AS iqr FROM fv GROUP BY 1""",
)
def fold_stability(spark, sf):
    x = M.fold_stability(fold_values(spark, sf), "value")
    # one fold has no spread, and equal folds divide by zero
    x = x.withColumn("std", F.when(F.col("n_folds") > 1, F.col("std")))
    x = x.withColumn("t_stat", float_div(F.col("mean"), F.col("std") / F.sqrt("n_folds")))
    d = dict(mean=7, std=7, t_stat=6, fraction_positive=8, minimum=7, median=7, maximum=7, iqr=7)
    return x.select("instrument", "n_folds", *[F.round(c, n).alias(c) for c, n in d.items()])


# --------------------------------------------------------------------------- #
# resampling

P = 10
SER = f"""{RET}, se AS (SELECT instrument, row_number() OVER ({PART}) - 1 AS t, ret AS value, count(*) OVER (PARTITION BY instrument) AS n FROM r WHERE ret IS NOT NULL),
  px AS (SELECT se.*, path FROM se, range({P}) p(path))"""


def _us(tag):
    return sql_uniform("0", f"'{tag}'", "instrument", "path", "t")


def series(spark, sf):
    return stored(lambda: R.series(rets(spark, sf)), spark, X._name("series", sf))


OUT = ["instrument", "path", "t", "idx"]
PICK = "SELECT i.instrument, i.path, i.t, i.idx, round(se.value, 9) AS value FROM ix i JOIN se ON se.instrument = i.instrument AND se.t = i.idx"


@query("bootstrap_iid", f"{SER}, ix AS (SELECT instrument, path, t, CAST(floor(n * {_us('i')}) AS BIGINT) AS idx FROM px) {PICK}")
def bootstrap_iid(spark, sf):
    return rr(R.bootstrap_iid(series(spark, sf), P), 9, OUT, "value")


STAT = f"""st AS (SELECT *, CASE WHEN t = 0 OR {_us('r')} < 1 / 60.0::DOUBLE THEN t END AS t0, floor(n * {_us('s')}) AS fresh FROM px),
  sl AS (SELECT *, last_value(t0 IGNORE NULLS) OVER w AS lt, last_value(CASE WHEN t0 IS NOT NULL THEN fresh END IGNORE NULLS) OVER w AS ls FROM st WINDOW w AS (PARTITION BY instrument, path ORDER BY t)),
  ix AS (SELECT instrument, path, t, CAST(ls + t - lt AS BIGINT) % n AS idx FROM sl)"""


@query("bootstrap_stationary", f"{SER}, {STAT} {PICK}")
def bootstrap_stationary(spark, sf):
    return rr(R.bootstrap_stationary(series(spark, sf), P, 60.0), 9, OUT, "value")


@query("permute_trades", f"{SER}, pm AS (SELECT instrument, path, t AS idx, value, row_number() OVER (PARTITION BY instrument, path ORDER BY {_us('p')}, t) - 1 AS t FROM px) SELECT instrument, path, t, idx, round(value, 9) AS value FROM pm")
def permute_trades(spark, sf):
    return rr(R.permute_trades(series(spark, sf), P), 9, OUT, "value")


@query(
    "sign_scramble",
    f"""{SER}, sh AS (SELECT instrument, path, t AS idx, value, (t // 60) * 60 + row_number() OVER (PARTITION BY instrument, path, t // 60 ORDER BY {_us('w')}, t) - 1 AS t FROM px)
    SELECT instrument, path, t, idx, round(CASE WHEN {_us('g')} < 0.5 THEN -value ELSE value END, 9) AS value FROM sh""",
)
def sign_scramble(spark, sf):
    return rr(R.sign_scramble(series(spark, sf), P, 60, within=True), 9, OUT, "value")


@query("garch_fit")
def garch_fit(spark, sf):
    return R.garch_fit(series(spark, sf))


def path_means(spark, sf):
    make = lambda: R.path_stat(R.bootstrap_stationary(series(spark, sf), 40, 60.0), F.avg("value").alias("stat"), F.stddev_samp("value").alias("sd"))
    return stored(make, spark, X._name("path_means", sf))


PSTAT = f"{SER.replace(f'range({P})', 'range(40)')}, {STAT}, ps AS (SELECT i.instrument, i.path, avg(value) AS stat, stddev_samp(value) AS sd FROM ix i JOIN se ON se.instrument = i.instrument AND se.t = i.idx GROUP BY 1, 2)"


@query("path_stat", f"{PSTAT} SELECT instrument, path, round(stat, 9) AS stat, round(sd, 9) AS sd FROM ps")
def path_stat(spark, sf):
    s = R.bootstrap_stationary(series(spark, sf), 40, 60.0)
    return rr(R.path_stat(s, F.avg("value").alias("stat"), F.stddev_samp("value").alias("sd")), 9, ["instrument", "path"], "stat", "sd")


@query(
    "mc_pvalue",
    f"""{PSTAT}, ob AS (SELECT instrument, avg(value) * 1.5 AS o FROM se GROUP BY 1), md AS (SELECT instrument, median(stat) AS c FROM ps GROUP BY 1),
    u AS (SELECT ps.instrument, stat, o, c FROM ps JOIN ob USING (instrument) JOIN md USING (instrument))
    SELECT instrument, 'greater' AS alternative, count(*) AS n, round((1.0::DOUBLE + count(CASE WHEN stat >= o THEN 1 END)) / (1 + count(*)), 8) AS p_value FROM u GROUP BY 1
    UNION ALL SELECT instrument, 'less', count(*), round((1.0::DOUBLE + count(CASE WHEN stat <= o THEN 1 END)) / (1 + count(*)), 8) FROM u GROUP BY 1
    UNION ALL SELECT instrument, 'two-sided', count(*), round((1.0::DOUBLE + count(CASE WHEN abs(stat - c) >= abs(o - c) THEN 1 END)) / (1 + count(*)), 8) FROM u GROUP BY 1""",
)
def mc_pvalue(spark, sf):
    st = path_means(spark, sf)
    obs = series(spark, sf).groupBy("instrument").agg((F.avg("value") * 1.5).alias("observed"))
    out = None
    for alt in ("greater", "less", "two-sided"):
        x = R.mc_pvalue(st, obs, "stat", alt).select("instrument", F.lit(alt).alias("alternative"), "n", F.round("p_value", 8).alias("p_value"))
        out = x if out is None else out.unionByName(x)
    return out


@query(
    "bootstrap_ci",
    f"""{PSTAT}, ob AS (SELECT instrument, avg(value) AS o FROM se GROUP BY 1), q AS (SELECT instrument, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi FROM ps GROUP BY 1)
    SELECT instrument, 'percentile' AS method, round(lo, 9) AS low, round(hi, 9) AS high FROM q UNION ALL SELECT instrument, 'basic', round(2 * o - hi, 9), round(2 * o - lo, 9) FROM q JOIN ob USING (instrument)""",
)
def bootstrap_ci(spark, sf):
    st = path_means(spark, sf)
    obs = series(spark, sf).groupBy("instrument").agg(F.avg("value").alias("observed"))
    a = R.bootstrap_ci(st, "stat", 0.1).withColumn("method", F.lit("percentile"))
    b = R.bootstrap_ci(st, "stat", 0.1, obs).withColumn("method", F.lit("basic"))
    return rr(a.unionByName(b), 9, ["instrument", "method"], "low", "high")


@query(
    "autocorrelation",
    f"""{SER}, d AS (SELECT instrument, t, value - avg(value) OVER (PARTITION BY instrument) AS d FROM se), v AS (SELECT instrument, sum(d * d) AS v FROM d GROUP BY 1)
    SELECT a.instrument, CAST(b.t - a.t AS INTEGER) AS lag, round(sum(a.d * b.d) / any_value(v), 8) AS acf FROM d a JOIN d b ON a.instrument = b.instrument AND b.t - a.t BETWEEN 1 AND 10 JOIN v ON v.instrument = a.instrument GROUP BY 1, 2""",
)
def autocorrelation(spark, sf):
    return rr(R.autocorrelation(series(spark, sf)), 8, ["instrument", "lag"], "acf")


# --------------------------------------------------------------------------- #
# stress


def _nu(c):
    return f"{c} * exp((2 * {sql_uniform('0', chr(39) + c + chr(39), 'instrument', 'bar_index')} - 1) * 0.001)"


@query(
    "noise_injection",
    f"""WITH {X.LINEITEM_BARS}, j AS (SELECT instrument, bar_index, {_nu('open')} AS o, {_nu('high')} AS h, {_nu('low')} AS l, {_nu('close')} AS c FROM bars)
    SELECT instrument, bar_index, round(o, 6) AS open, round(greatest(o, h, l, c), 6) AS high, round(least(o, h, l, c), 6) AS low, round(c, 6) AS close FROM j""",
)
def noise_injection(spark, sf):
    return rr(T.noise_injection(X.lineitem_bars(spark, sf), 0.002), 6, ["instrument", "bar_index"], "open", "high", "low", "close")


SHIFTED = f"""{SIGNALS}, lst AS (SELECT instrument, max(bar_index) AS lb FROM bars GROUP BY 1),
  shs AS (SELECT s.* EXCLUDE (bar_index, candidate_id), CAST(range - 5 AS BIGINT) AS shift, s.bar_index + range - 5 AS bar_index, candidate_id || '@' || (range - 5) AS candidate_id FROM sig s, range(11)),
  sh2 AS (SELECT shs.* FROM shs JOIN lst USING (instrument) WHERE bar_index BETWEEN 0 AND lb), {tb_sql('sh2')},
  sc AS (SELECT instrument, shift, avg(ret_sigma) AS score, count(*) AS n FROM lab GROUP BY 1, 2)"""


def shift_scores(spark, sf):
    bars = X.lineitem_bars(spark, sf)
    lab = L.triple_barrier(bars, T.timing_shift(signals(spark, sf), bars))
    return lab.groupBy("instrument", "shift").agg(F.avg("ret_sigma").alias("score"), F.count(F.lit(1)).alias("n"))


@query("timing_shift", f"{SHIFTED} SELECT instrument, shift, round(score, 7) AS score, n FROM sc")
def timing_shift(spark, sf):
    return rr(shift_scores(spark, sf), 7, ["instrument", "shift", "n"], "score")


@query(
    "timing_profile",
    f"""{SHIFTED}, b AS (SELECT instrument, score AS base FROM sc WHERE shift = 0),
    l AS (SELECT sc.*, base, coalesce(lag(score) OVER (PARTITION BY sc.instrument, sign(shift) ORDER BY abs(shift)), base) AS inner_ FROM sc JOIN b USING (instrument)),
    a AS (SELECT instrument, any_value(base) AS baseline, bool_and(score <= base + 1e-9) AS peak_at_zero, bool_and(shift = 0 OR score <= inner_ + 1e-9) AS monotone,
      coalesce(min(CASE WHEN shift <> 0 AND base > 0 AND score <= 0.5 * base THEN abs(shift) END)::DOUBLE, 'infinity'::DOUBLE) AS half_life_bars FROM l GROUP BY 1)
    SELECT instrument, round(baseline, 7) AS baseline, peak_at_zero, monotone, half_life_bars, CASE WHEN NOT peak_at_zero THEN 'improves-off-bar' WHEN monotone THEN 'smooth-decay' ELSE 'discontinuous' END AS verdict FROM a""",
)
def timing_profile(spark, sf):
    return T.timing_profile(shift_scores(spark, sf), ["instrument"]).withColumn("baseline", F.round("baseline", 7))


@query("bar_dropout", f"WITH {X.LINEITEM_BARS} SELECT instrument, bar_index FROM bars WHERE bar_index = 0 OR {sql_uniform('0', chr(39) + 'd' + chr(39), 'instrument', 'bar_index')} >= 0.1")
def bar_dropout(spark, sf):
    return T.bar_dropout(X.lineitem_bars(spark, sf), 0.1).select("instrument", "bar_index")


@query("latency_shift", f"{SIGNALS} SELECT candidate_id, bar_index + 3 AS execute_at FROM sig")
def latency_shift(spark, sf):
    x = signals(spark, sf).select("candidate_id", (F.col("bar_index") + 1).alias("execute_at"))
    return T.latency_shift(x, 2)


GRID = T.scan_grid(0.6, 1.7, 7)
SCANNED = f"""{SIGNALS}, gr(multiplier) AS (VALUES {", ".join(f"({g!r}::DOUBLE)" for g in GRID)}),
  sg AS (SELECT s.* EXCLUDE (ts_), ts_ * multiplier AS ts_, multiplier FROM sig s, gr), {tb_sql('sg', 'lab', 'multiplier')},
  sc AS (SELECT instrument, multiplier, avg(ret_sigma) AS score FROM lab GROUP BY 1, 2)"""


def scan_scores(spark, sf):
    x = signals(spark, sf).withColumn("multiplier", F.explode(F.array(*[F.lit(g) for g in GRID])))
    x = x.withColumn("target_sigma", F.col("target_sigma") * F.col("multiplier"))
    x = x.withColumn("candidate_id", F.concat_ws("@", "candidate_id", F.col("multiplier").cast("string")))
    lab = L.triple_barrier(X.lineitem_bars(spark, sf), x)
    return lab.groupBy("instrument", "multiplier").agg(F.avg("ret_sigma").alias("score"))


@query(
    "parameter_scan",
    f"""{SCANNED}, c AS (SELECT instrument, score AS cs FROM sc WHERE multiplier = 1),
    a AS (SELECT instrument, count(*) AS n, any_value(cs) AS c, median(score) AS m, avg((score > 0)::INT) AS fp, max(CASE WHEN multiplier < 1 THEN score END) AS l, max(CASE WHEN multiplier > 1 THEN score END) AS rg,
      bool_and(score <= cs + 1e-12) AS best FROM sc JOIN c USING (instrument) GROUP BY 1),
    b AS (SELECT *, CASE WHEN c > 0 THEN CASE WHEN m > 0 THEN c / m ELSE 'infinity'::DOUBLE END END AS ratio, CASE WHEN c > 0 THEN l / c END AS ls, CASE WHEN c > 0 THEN rg / c END AS rs FROM a)
    SELECT instrument, round(c, 7) AS chosen_score, round(m, 7) AS median_score, round(fp, 8) AS fraction_positive, round(ls, 6) AS left_support, round(rs, 6) AS right_support, round(ratio, 6) AS plateau_ratio,
     CASE WHEN c <= 0 THEN 'degenerate' WHEN ratio > 1.5 OR ls < 0.6 OR rs < 0.6 THEN 'spike' ELSE 'plateau' END AS verdict FROM b""",
)
def parameter_scan(spark, sf):
    x = T.parameter_scan(scan_scores(spark, sf), ["instrument"])
    pr = F.col("plateau_ratio")
    return x.select(
        "instrument", F.round("chosen_score", 7).alias("chosen_score"), F.round("median_score", 7).alias("median_score"),
        F.round("fraction_positive", 8).alias("fraction_positive"), F.round("left_support", 6).alias("left_support"),
        F.round("right_support", 6).alias("right_support"), F.when(pr < float("inf"), F.round(pr, 6)).otherwise(pr).alias("plateau_ratio"), "verdict",
    )
