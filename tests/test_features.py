"""Causality by prefix, block invariance, kernels against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.kernels import series as S
from barspark.kernels import windows as K
from barspark.operators import features as E
from barspark.operators import structure as ST


def same(a, b, cols, rtol=1e-9):
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind in "fi":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=rtol, atol=1e-12, err_msg=c)
        else:
            assert (a[c].fillna("") == b[c].fillna("")).all(), c


def ordered(df):
    return df.orderBy("instrument", "bar_index").toPandas().reset_index(drop=True)


def test_prefix_causality(bars):
    cut = 400
    full = ordered(E.feature_table(bars).filter(F.col("bar_index") < cut))
    pre = ordered(E.feature_table(bars.filter(F.col("bar_index") < cut)))
    same(full, pre, [c for c in full.columns if c not in ("ts",)])


def test_block_invariance(bars):
    one = ordered(E.block_features(bars))
    many = ordered(E.block_features(bars, lookback=700, block=700))
    same(one, many, [c for c in one.columns if c != "ts"], rtol=1e-8)


def test_rank_quantile_mad_against_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300).round(1)
    x[rng.random(300) < 0.2] = np.nan
    r, q, m = K.rank(x, 40, 10), K.quantile(x, 40, 0.3), K.mad(x, 40)
    seen = []
    for i, v in enumerate(x):
        if math.isnan(v):
            assert math.isnan(r[i]) and math.isnan(q[i])
            continue
        seen.append(v)
        w = np.array(seen[-40:])
        assert q[i] == pytest.approx(np.quantile(w, 0.3))
        assert m[i] == pytest.approx(1.4826 * np.median(np.abs(w - np.median(w))))
        if len(w) >= 10:
            assert r[i] == pytest.approx(((w < v).sum() + 0.5 * (w == v).sum()) / len(w))
        else:
            assert math.isnan(r[i])


def test_variance_ratio_centred_on_a_random_walk():
    z, h = K.variance_ratio(np.random.default_rng(5).normal(size=6000))
    assert abs(np.nanmean(z)) < 0.35 and 0.4 < np.nanmean(h) < 0.6
    assert np.isnan(z[:47]).all() and not np.isnan(z[48:]).any()


def test_pivot_confirmation_is_late(features):
    p = ST.pivots(features)
    assert p.count() > 0
    assert p.filter("confirmed_at - bar_index < 3").count() == 0


def test_relational_structure_equals_fold(features):
    f = features
    piv = ST.pivots(f)
    a = ordered(f.select("instrument", "bar_index", "pivot_high", "pivot_low", "pivot_high_age", "pivot_low_age", "range_pos", "range_sigma", "structure_bias"))
    b = ordered(ST.pivot_state(f.select("instrument", "bar_index", "close", "sigma_bp"), piv))
    same(a, b, ["pivot_high", "pivot_low", "pivot_high_age", "pivot_low_age", "range_pos", "range_sigma"])
    s = ordered(ST.structure_bias(f.select("instrument", "bar_index"), piv))
    same(a, s, ["structure_bias"])


def test_sweep_join_equals_fold(features):
    ev = ST.sweeps(features).orderBy("instrument", "reclaim_index").toPandas()
    fold = features.filter("swept_low > 0 OR swept_high > 0").orderBy("instrument", "bar_index").toPandas()
    assert len(ev) == len(fold) and (ev["reclaim_index"].values == fold["bar_index"].values).all()
    assert (ev["pen_index"].values == fold["penetration_index"].astype(int).values).all()
    assert ((ev["direction"] > 0).values == (fold["swept_low"] > 0).values).all()
    assert (ev["bars_to_reclaim"].between(1, 6)).all()


def test_entropy_and_path_closed_forms(spark):
    rows = [("ramp", i, 100.0 + i) for i in range(120)]
    x = spark.createDataFrame(rows, "instrument string, bar_index long, close double")
    from barspark.operators.sequence import own_rows, with_lookback

    y = E.with_returns(with_lookback(x, 128))
    eff, _ = E.path_efficiency()
    z = own_rows(E.perm_entropy(y).withColumn("eff", eff)).filter("bar_index = 119").first()
    assert z["perm_entropy"] == pytest.approx(0.0) and z["eff"] == pytest.approx(1.0)


def test_regime_posterior_is_a_distribution(features):
    t = features.select((F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3")).alias("s"), "hazard").toPandas()
    np.testing.assert_allclose(t["s"], 1.0, atol=1e-9)
    assert t["hazard"].between(0, 1).all()


def test_beta_terms_integrate_to_one():
    x = np.linspace(1e-4, 1 - 1e-4, 20001)
    for row in S.beta_terms():
        for a, b, z in row:
            dens = np.exp(a * np.log(x) + b * np.log1p(-x) - z)
            assert np.trapezoid(dens, x) == pytest.approx(1.0, abs=2e-2)


def test_peer_returns_keep_every_peer(spark):
    from barspark.operators import bars as B

    rets = spark.createDataFrame([(f"i{i:02d}", t, t, 0.01 * i) for i in range(12) for t in (1, 2)], "instrument string, ts long, bar_index long, ret double")
    got = {(r["instrument"], r["ts"]): r["peers"] for r in B.peer_returns(rets).collect()}
    assert len(got) == 24 and all(p == {f"i{k:02d}": 0.01 * k for k in range(12) if f"i{k:02d}" != i} for (i, _), p in got.items())
    sets = spark.createDataFrame([("i00", "i11"), ("i00", "i10"), ("i01", "i01")], "instrument string, peer string")
    got = {(r["instrument"], r["ts"]): r["peers"] for r in B.peer_returns(rets, sets).collect()}
    assert len(got) == 24 and got["i00", 1] == {"i10": 0.01 * 10, "i11": 0.01 * 11} and got["i01", 2] == {}


def test_windows_over_present_values_cross_any_gap(spark):
    """90 % of the bars have no volume: ranks and medians are those of one block, whatever the size of a block."""
    import numpy as np

    rng = np.random.default_rng(8)
    n = 3500
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = close * np.exp(rng.normal(0, 0.003, n))
    volume = np.where(rng.random(n) < 0.1, rng.integers(1, 500, n), 0).astype(float)
    volume[600:2400] = 0.0  # a gap longer than a block and its look-back
    bars = pd.DataFrame(
        {
            "instrument": "X", "ts": pd.date_range("2000-01-01", periods=n), "bar_index": np.arange(n), "open": open_, "high": np.maximum(open_, close) * 1.004,
            "low": np.minimum(open_, close) * 0.996, "close": close, "volume": volume, "trades": 1.0, "delta": np.where(volume > 0, volume * rng.uniform(-1, 1, n), 0.0),
        }
    )
    table = spark.createDataFrame(bars)
    frames = [E.block_features(table, lookback=look, block=block).toPandas().sort_values("bar_index").reset_index(drop=True) for look, block in ((1024, 1024), (1024, 4096))]
    assert frames[1]["amihud_rank"].notna().sum() > 50 and frames[1]["delta_norm"].notna().sum() > 100
    for c in frames[0].columns:
        if frames[0][c].dtype.kind == "f":
            np.testing.assert_allclose(frames[0][c], frames[1][c], rtol=1e-7, atol=1e-9, err_msg=c)


def test_prices_of_zero_are_missing_values(spark, bars):
    from barspark.kernels.data import validate
    from barspark.operators.bars import returns

    i = F.col("bar_index")
    one = bars.filter("instrument = 'AF'")
    odd = one.withColumns({"low": F.when(i.isin(200, 300), 0.0).otherwise(F.col("low")), "open": F.when(i == 300, 0.0).otherwise(F.col("open")), "close": F.when(i == 300, 0.0).otherwise(F.col("close"))})
    f = E.feature_table(odd).orderBy("bar_index").toPandas()
    assert len(f) == one.count() > 320
    assert math.isnan(f["range_over_sigma"][200]) and math.isnan(f["ret"][301])
    assert f.iloc[-1][["sigma_fcst", "kalman_slope_t", "pivot_high", "pivot_low"]].notna().all() and (f["pivot_low"].dropna() > 0).all()
    level = spark.createDataFrame([("X", 1, 0.0, 6.0, 5.0, 7.0, 0.01, 1.0, 1.0, 0.9)], "instrument string, bar_index long, low double, high double, pivot_low double, pivot_high double, sigma_bp double, clv double, absorption_rank double, participation_rank double")
    assert ST.penetrations(level).count() == 0
    assert returns(odd).filter("bar_index IN (300, 301) AND ret IS NOT NULL").count() == 0
    rows = pd.DataFrame({"instrument": "X", "bar_index": [0, 1], "partial": False, "open": 5.0, "high": 5.0, "low": [5.0, 0.0], "close": [5.0, 0.0], "volume": 1.0, "sec": [0.0, 60.0]})
    assert validate()(None, rows)[1]["issues"].tolist()[1] == ["extreme_return"]
