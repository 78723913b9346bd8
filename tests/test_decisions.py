"""Labels, weights, Edge Book, pooling, calibration, splits and the ledger."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.kernels import ledger as KL
from barspark.kernels.calib import monotone
from barspark.operators import calib as C
from barspark.operators import decide as D
from barspark.operators import edge as G
from barspark.operators import label as L
from barspark.operators import metrics as M
from barspark.operators import pool as P
from barspark.operators import splits as S
from barspark.operators import train as T
from tests.conftest import SF


def flat_bars(spark, n=60):
    rows = [("X", i, 100.0, 101.0, 99.0, 100.0) for i in range(n)]
    return spark.createDataFrame(rows, "instrument string, bar_index long, open double, high double, low double, close double")


def cand(spark, rows):
    sch = "instrument string, candidate_id string, bar_index long, direction long, sigma double, stop_sigma double, target_sigma double, max_holding long"
    return spark.createDataFrame([("X", f"c{i}", *r, 1.0, 2.0, 10) for i, r in enumerate(rows)], sch)


def test_inline_labels_drop_unusable_candidates(spark):
    c = cand(spark, [(5, 1, 0.01), (10, 1, math.nan), (15, -1, 0.01), (20, 1, 0.01), (59, 1, 0.01)])
    got = {r["candidate_id"]: r for r in L.triple_barrier(flat_bars(spark), c).collect()}
    assert set(got) == {"c0", "c2", "c3"}
    # the stop is exactly inside the first bar's range: same-bar ties are stops
    assert got["c0"]["outcome"] == -1 and got["c0"]["fill_index"] == 6 and got["c0"]["ret_sigma"] == pytest.approx(-1.0)


def brute(bars, c):
    """Plain loop over one candidate."""
    i, d, s = c["bar_index"], c["direction"], c["sigma"]
    a, b = i + 1, min(i + c["max_holding"], len(bars) - 1)
    e = bars["open"][a]
    sp, tp = e * math.exp(-d * c["stop_sigma"] * s), e * math.exp(d * c["target_sigma"] * s)
    for j in range(a, b + 1):
        o, h, lo = bars["open"][j], bars["high"][j], bars["low"][j]
        if j > a and (o <= sp if d > 0 else o >= sp):
            return j, -1, (min if d > 0 else max)(sp, o)
        if j > a and (o >= tp if d > 0 else o <= tp):
            return j, 1, tp
        if (lo <= sp) if d > 0 else (h >= sp):
            return j, -1, sp
        if (h >= tp) if d > 0 else (lo <= tp):
            return j, 1, tp
    return b, 0, bars["close"][b]


def test_triple_barrier_against_brute_force(spark, bars):
    from barspark.plans.edge import signals

    sig = signals(spark, SF).filter("instrument = 'RF'")
    b = bars.filter("instrument = 'RF'").orderBy("bar_index").toPandas()
    got = {r["candidate_id"]: r for r in L.triple_barrier(bars, sig).collect()}
    rows = sig.collect()
    assert len(got) >= 50
    for c in rows:
        if c["bar_index"] + 1 >= len(b):
            assert c["candidate_id"] not in got
            continue
        j, o, px = brute(b, c)
        g = got[c["candidate_id"]]
        assert (g["exit_index"], g["outcome"]) == (j, o) and g["exit_price"] == pytest.approx(px)


def spans(spark, step, hold=20, end=900):
    rows = [("X", f"s{i}", i, i + hold) for i in range(0, end, step)]
    lab = spark.createDataFrame(rows, "instrument string, candidate_id string, bar_index long, exit_index long")
    b = spark.range(1000).select(F.lit("X").alias("instrument"), F.col("id").alias("bar_index"))
    return lab, b


def test_overlap_shrinks_the_sample(spark):
    lab, b = spans(spark, 3)
    e = L.ess(L.combined_weights(b, lab, decay="none")).first()
    assert e["overlap"] < 0.25 * e["n"] and e["t_inflation"] > 1.5
    lab, b = spans(spark, 30)
    e = L.ess(L.combined_weights(b, lab, decay="none")).first()
    assert e["overlap"] == pytest.approx(e["n"]) and e["kish"] == pytest.approx(e["n"])


def outcomes(spark, n, r):
    return spark.createDataFrame([(0, 0, 0, float(r), 1.0)] * n, "regime long, setup long, bucket long, ret_sigma double, weight double")


def test_edge_book_closed_forms(spark):
    one = G.edge_posterior(G.edge_stats(outcomes(spark, 5, 2.0))).filter("regime = 0 AND setup = 0 AND bucket = 0").first()
    assert one["mean"] == pytest.approx(0.33, abs=0.01)
    other = G.edge_posterior(G.edge_stats(outcomes(spark, 5, 2.0))).filter("regime = 3 AND setup = 3 AND bucket = 4").first()
    assert 0 < other["mean"] < one["mean"]
    empty = G.edge_posterior(G.edge_stats(outcomes(spark, 5, 2.0).limit(0)))
    rows = empty.collect()
    assert len(rows) == 80 and all(r["mean"] == 0 and r["lcb"] < 0 for r in rows)


def scores(spark, s, rel=1.0, m=10):
    rows = [("X", 0, f"e{i}", float(s), float(rel), True) for i in range(m)]
    return spark.createDataFrame(rows, "instrument string, bar_index long, engine string, score double, reliability double, valid boolean")


def test_pooling_closed_forms(spark):
    r = P.pool_log_odds(scores(spark, 0.5), 10, rho=0.5).first()
    assert r["ebe_full"] == pytest.approx(10 / 5.5, abs=1e-9)
    naive = P.pool_log_odds(scores(spark, 0.5), 10, rho=0.0).first()
    assert naive["log_odds"] == pytest.approx(10.99, abs=0.01) and naive["ebe_full"] == pytest.approx(10)
    assert P.pool_log_odds(scores(spark, 0.5), 10, rho=0.999999).first()["ebe_full"] == pytest.approx(1.0, abs=1e-4)
    silent = P.pool_log_odds(scores(spark, 0.5, rel=0.0), 10).first()
    assert silent["direction"] == 0 and silent["p_success"] == 0.5


def test_row_and_general_pooling_agree(spark):
    from barspark.plans.decide import CORE
    from barspark.plans.decide import scores as long_scores

    s = long_scores(spark, SF)
    a = P.pool_log_odds(s, 7)
    arr = s.groupBy("instrument", "bar_index").agg(F.collect_list(F.struct("score", "reliability", "valid")).alias("_e"))
    b = P.pool_array(arr, "_e", 7)
    g = P.fused_general(s, list(CORE)).filter("samples <= 60")
    cols = ["log_odds", "ebe_full", "ebe", "p_success"]
    for other in (b, g):
        j = a.join(other.select("instrument", "bar_index", *[F.col(c).alias(f"{c}_2") for c in cols]), ["instrument", "bar_index"])
        assert j.count() > 100
        for c in cols:
            assert j.filter(F.abs(F.col(c) - F.col(f"{c}_2")) > 1e-9).count() == 0


def test_isotonic_is_monotone_and_bounded(spark):
    rng = np.random.default_rng(2)
    p = rng.random(400)
    y = (rng.random(400) < p).astype(float)
    y[p < 0.1], y[p > 0.95] = 0.0, 1.0
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    k = C.isotonic_fit(df).orderBy("x").toPandas()
    assert (np.diff(k["y"]) >= -1e-12).all() and 0 < k["y"].iloc[0] and k["y"].iloc[-1] < 1
    n_hi = int(k["y"].iloc[-1] * 1000)
    assert n_hi < 1000
    fit = monotone(y[np.argsort(p, kind="stable")], np.ones(400))
    assert (np.diff(fit) >= -1e-12).all() and fit.mean() == pytest.approx(y.mean())
    got = C.isotonic_apply(df, C.isotonic_fit(df)).toPandas()
    assert len(got) == 400
    np.testing.assert_allclose(got["calibrated"], np.interp(got["p"], k["x"], k["y"]).clip(1e-6, 1 - 1e-6), atol=1e-12)


def test_platt_recovers_a_known_map(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))).astype(float)
    t, b = C.platt_fit(spark.createDataFrame(pd.DataFrame({"score": x, "y": y})))
    assert t == pytest.approx(1.7, abs=0.2) and b == pytest.approx(-0.4, abs=0.15)
    assert C.platt_fit(spark.createDataFrame([(0.1, 1.0)], "score double, y double")) == (1.0, 0.0)


def test_known_metric_answers(spark):
    one = spark.range(1)
    n = one.select(M.trades_needed(F.lit(0.5), F.lit(0.6)).alias("n")).first()["n"]
    assert n == 194
    half = spark.createDataFrame([(0.5, float(i % 2)) for i in range(40)], "p double, y double")
    assert C.brier(half).first()["brier"] == pytest.approx(0.25)
    d = C.brier_decomposition(half).first()
    assert d["brier"] == pytest.approx(d["reliability"] - d["resolution"] + d["uncertainty"] + d["residual"])


def test_cpcv_counts_and_no_leak(spark):
    assert len(S.combos(8, 2)) == 28
    assert S.cpcv_paths(spark, 8, 2).agg(F.countDistinct("path")).first()[0] == 7
    rows = [("X", f"s{i}", i, i + 8) for i in range(0, 100, 5)]
    lab = spark.createDataFrame(rows, "instrument string, candidate_id string, bar_index long, exit_index long")
    b = spark.range(110).select(F.lit("X").alias("instrument"), F.col("id").alias("bar_index"))
    r = S.leakage_report(S.purged_kfold(lab, b, 5, 0.02), S.cv_groups(lab, 5)).first()
    assert r["ok"] and r["purged_total"] > 0 and r["n_splits"] == 5


def test_walkforward_fold_equals_training_on_the_prefix(spark, bars):
    from barspark.plans.edge import signals

    sig = signals(spark, SF)
    got = T.walkforward_train(bars, sig, n_folds=3).filter("instrument = 'RF' AND fold = 1").select("candidate_id", "mean", "lcb").toPandas()
    f = T.walkforward_folds(bars, 3).filter("instrument = 'RF' AND fold = 1").first()
    pre = bars.filter((F.col("instrument") == "RF") & (F.col("bar_index") < f["tr_end"]))
    lab = L.triple_barrier(pre, sig.filter((F.col("instrument") == "RF") & (F.col("bar_index") < f["tr_end"])))
    post = G.edge_posterior(G.edge_stats(L.combined_weights(pre, lab)))
    want = G.edge_lookup(sig.filter("instrument = 'RF'"), post).select("candidate_id", "mean", "lcb").toPandas()
    j = got.merge(want, on="candidate_id")
    assert len(j) == len(got) > 0
    np.testing.assert_allclose(j["mean_x"], j["mean_y"], rtol=1e-9)
    np.testing.assert_allclose(j["lcb_x"], j["lcb_y"], rtol=1e-9)


def test_drawdown_throttle_forms_agree(spark):
    dd = [0.0, 0.04, 0.05, 0.1, 0.1499, 0.15, 0.2, 0.2499, 0.25, 0.6]
    col = [r["t"] for r in spark.createDataFrame([(d,) for d in dd], "dd double").select(D.throttle(F.col("dd")).alias("t")).collect()]
    np.testing.assert_allclose(col, [KL.throttle(d) for d in dd], atol=1e-12)
    assert col[0] == 1 and col[-1] == 0


def test_ledger_invariants_and_blocks(spark):
    from barspark.plans.decide import ledger_rows

    rows = ledger_rows(spark, SF)
    a = D.position_ledger(rows).orderBy("instrument", "bar_index").toPandas()
    b = D.position_ledger(rows, block=120).orderBy("instrument", "bar_index").toPandas()
    assert (a["action"] == b["action"]).all()
    np.testing.assert_allclose(a["equity"], b["equity"], rtol=1e-9)
    for _, g in a.groupby("instrument"):
        pos = np.concatenate([[0], g["position"].to_numpy()])
        flips = g[(pos[1:] * pos[:-1]) < 0]
        # a barrier hit during the bar frees the slot for that bar's decision; a decided exit does not
        assert flips["reason"].isin(["stop", "stop (gapped through)", "target"]).all()
        assert (g[g["action"].isin(["SELL", "COVER"])]["position"] == 0).all()
        entries = g[g["action"].isin(["BUY", "SHORT"])]["bar_index"].to_numpy()
        for i in entries:
            assert ((entries >= i - 100) & (entries <= i)).sum() <= 4
    t = D.trades(D.position_ledger(rows)).toPandas()
    assert len(t) > 0 and (t["exit_index"] > t["entry_index"]).all()
    assert (t.loc[t["outcome"] == 1, "ret_sigma"] > 0).all() and (t.loc[t["reason"] == "stop", "ret_sigma"] < 0).all()
    # equity equals the trade record
    end = a.groupby("instrument")["equity"].last()
    stop = rows.select("instrument", F.col("bar_index").alias("entry_index"), "stop_sigma").toPandas()
    t = t.merge(stop, on=["instrument", "entry_index"])
    t["g"] = 1 + (t["ret_sigma"] - t["cost_sigma"]) / t["stop_sigma"] * t["risk_fraction"]
    np.testing.assert_allclose(t.groupby("instrument")["g"].prod(), end[t["instrument"].drop_duplicates().sort_values()], rtol=1e-9)


def test_acceptance_fails_on_missing(spark):
    m = spark.createDataFrame([("X", "trade count for power", 500.0)], "instrument string, name string, observed double")
    r = T.acceptance(m).toPandas()
    assert len(r) == len(T.CRITERIA) and not r["accepted"].any()
    assert bool(r[r["name"] == "trade count for power"]["passed"].iloc[0])


def test_missing_probabilities_stay_missing(spark):
    from barspark.operators import calib as C

    nan = float("nan")
    rows = spark.createDataFrame([(1, None, 1.0), (2, nan, 1.0), (3, 0.5, 1.0), (4, 1.5, 0.0), (5, 0.25, None)], "i long, p double, y double")
    knots = spark.createDataFrame([(0.0, 0.2), (1.0, 0.9)], "x double, y double")
    got = {r["i"]: r["calibrated"] for r in C.isotonic_apply(rows.drop("y"), knots).collect()}
    assert got[1] is None and got[2] is None and abs(got[3] - 0.55) < 1e-12 and abs(got[4] - 0.9) < 1e-12
    both = rows.filter("p <= 1 OR p IS NULL OR isnan(p)")
    assert C.brier(both).first()["n"] == 1 and sum(r["n"] for r in C.binned(both, 15).collect()) == 1
    assert [r[0] for r in rows.select(C.bin_of(rows["p"], 10)).collect()][0] is None


def test_candidates_on_one_bar_have_one_order(spark):
    from barspark.operators.metrics import loss_streak, number_trades

    rows = [("a", f"a:{i}:{j}", i, -1.0 if (i + j) % 3 else 1.0) for i in range(40) for j in range(2)]
    schema = "instrument string, candidate_id string, bar_index long, ret_sigma double"
    numbers, streaks = [], []
    for own in (rows, rows[::-1]):
        t = spark.createDataFrame(own, schema).repartition(3)
        numbers.append({r["candidate_id"]: r["k"] for r in number_trades(t).collect()})
        streaks.append([tuple(r) for r in loss_streak(t).collect()])
    assert numbers[0] == numbers[1] and [k for k, _ in sorted(numbers[0].items(), key=lambda x: x[1])] == sorted(numbers[0], key=lambda c: [int(x) for x in c[2:].split(":")])
    assert streaks[0] == streaks[1]


def test_health_reads_every_outcome(spark):
    from barspark.operators import drift as DR

    o = spark.range(2500).select(F.lit("X").alias("instrument"), F.col("id").alias("pos"), F.lit(0.5).alias("p"), (F.col("id") < 500).cast("double").alias("y"))
    whole, last = DR.health(o).first(), DR.health(o, keep=2000).first()
    assert whole["n"] == 2500 and whole["ece"] == pytest.approx(0.3)
    assert last["n"] == 2000 and last["ece"] == pytest.approx(0.5)


def test_trade_net_has_every_bar(spark, bars):
    from barspark.plans.decide import sized, trade_net

    net = trade_net(spark, SF).toPandas().set_index(["instrument", "bar_index"])["net_sigma"]
    assert net.index.is_unique and len(net) == bars.count() and net.notna().any()
    open_ = sized(spark, SF).filter("stop_sigma IS NOT NULL AND cost_sigma < double('inf')").select("instrument", "bar_index").toPandas()
    last = bars.groupBy("instrument").agg(F.max("bar_index").alias("last")).toPandas()
    filled = open_.merge(last, on="instrument").query("bar_index < last").set_index(["instrument", "bar_index"]).index
    assert set(net[net.notna()].index) == set(filled)
