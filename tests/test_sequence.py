"""Blocked work equals whole-series work, whatever the block size."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.kernels import data as KD
from barspark.kernels import series as KS
from barspark.operators import features as E
from barspark.operators import rolling as R
from barspark.operators import sequence as Q


@pytest.fixture(scope="module")
def skewed(spark):
    """One instrument holds most rows, with gaps in time."""
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("hot", 900), ("mid", 120), ("one", 1)):
        t = 1_600_000_000 + np.cumsum(rng.integers(60, 400_000, n))
        rows += [(name, int(s), float(v)) for s, v in zip(t, rng.normal(size=n))]
    df = spark.createDataFrame(rows, "instrument string, sec long, v double")
    return df.select("instrument", F.timestamp_seconds("sec").alias("ts"), F.when(F.col("v") > -1, F.col("v")).alias("v")).repartition(7)


def pdf(df, *order):
    return df.orderBy(*order).toPandas().reset_index(drop=True)


def test_index_bars_is_row_number(skewed):
    w = Window.partitionBy("instrument").orderBy("ts")
    for slot in (3600, 86400 * 30, 1 << 20):
        x = Q.index_bars(skewed, slot_seconds=slot).withColumn("want", F.row_number().over(w) - 1)
        assert x.filter("bar_index <> want").count() == 0
        assert x.count() == skewed.count()


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_running_matches_window(skewed, block):
    x = Q.index_bars(skewed)
    spec = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("min", F.col("v"))}
    w = Window.partitionBy("instrument").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
    want = {"s": F.sum("v").over(w), "m": F.max("v").over(w), "l": F.last("v", True).over(w), "n": F.min("v").over(w)}
    a = pdf(Q.running(x, spec, block=block), "instrument", "bar_index")
    b = pdf(x.withColumns(want), "instrument", "bar_index")
    for k in spec:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-12, atol=1e-12)


def test_running_exclusive(skewed):
    x = Q.index_bars(skewed)
    a = Q.running(x, {"k": ("sum", F.lit(1))}, block=16, inclusive=False)
    assert a.filter(F.coalesce("k", F.lit(0)) != F.col("bar_index")).count() == 0


@pytest.mark.parametrize("block", [40, 100, 4096])
def test_lookback_frames(skewed, block):
    x = Q.index_bars(skewed)
    w = Window.partitionBy("instrument").orderBy("bar_index").rowsBetween(-29, 0)
    a = pdf(Q.framed(x, 30, {"m": F.avg("v").over(Q.w_last(30))}, block=block), "instrument", "bar_index")
    b = pdf(x.withColumn("m", F.avg("v").over(w)), "instrument", "bar_index")
    np.testing.assert_allclose(a["m"], b["m"], rtol=1e-12)
    assert len(a) == len(b)


def test_quantiles_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=5000), 2)
    v[:2000] = 0.25
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 4000 + ["b"] * 1000, "v": v}))
    q = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["k"]: [r[f"q_{i}"] for i in range(5)] for r in Q.quantiles(df, ["k"], "v", q, edges=15).collect()}
    np.testing.assert_allclose(got["a"], np.quantile(v[:4000], q))
    np.testing.assert_allclose(got["b"], np.quantile(v[4000:], q))
    one = Q.quantiles(df, [], "v", [0.5]).collect()[0]["q_0"]
    assert one == pytest.approx(np.quantile(v, 0.5))


STEPS = {
    "kalman": (KS.kalman(), E.TREND_OUT),
    "pivots": (KS.pivots(), E.PIVOT_OUT),
    "runs": (KS.run_asymmetry(), E.RUN_OUT),
    "regime": (KS.regime(), E.REGIME_OUT),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_fold_blocks_agree(features, name):
    step, outs = STEPS[name]
    cols = ["high", "low", "close", "clv", "sigma_bp", "ret", "participation_rank", "absorption_rank", *KS.REGIME_INPUTS]
    x = features.select("instrument", "bar_index", *dict.fromkeys(cols))
    whole = pdf(E.as_fold(x, {name: step}, ["instrument", "bar_index"], outs), "instrument", "bar_index")
    parts = pdf(E.as_fold(x, {name: step}, ["instrument", "bar_index"], outs, block=150), "instrument", "bar_index")
    for k, t in outs.items():
        if t == "double":
            np.testing.assert_allclose(whole[k], parts[k], rtol=1e-8, atol=1e-10, err_msg=k)
        else:
            assert whole[k].equals(parts[k]), k


def test_validator_and_clock_blocks_agree(bars):
    rows = bars.select("instrument", "bar_index", "partial", "open", "high", "low", "close", "volume", F.unix_seconds("ts").cast("double").alias("sec"))
    sch = "instrument string, bar_index long, issues array<string>, fatal boolean"
    a, b = (pdf(Q.fold(rows, KD.validate(), sch, block=k), "instrument", "bar_index") for k in (100, 100000))
    assert (a["fatal"] == b["fatal"]).all() and all(list(p) == list(q) for p, q in zip(a["issues"], b["issues"]))
    act = bars.select("instrument", "bar_index", (F.col("close") * F.col("volume")).alias("act"))
    sch = "instrument string, bar_index long, first_index long, closes boolean"
    a, b = (pdf(Q.fold(act, KD.activity_clock(k=3.0), sch, block=k), "instrument", "bar_index") for k in (100, 100000))
    assert a.equals(b)


def test_fold_resumes_from_saved_state(features):
    x = features.select("instrument", "bar_index", "close", "sigma_bp")
    step = {"k": KS.kalman()}
    keep, outs = ["instrument", "bar_index"], E.TREND_OUT
    whole = pdf(E.as_fold(x, step, keep, outs), "instrument", "bar_index")
    head, st = E.as_fold(x.filter("bar_index < 300"), step, keep, outs, end_states=True)
    tail = E.as_fold(x.filter("bar_index >= 300"), step, keep, outs, start=st)
    both = pdf(head.unionByName(tail), "instrument", "bar_index")
    np.testing.assert_allclose(whole["kalman_slope_t"], both["kalman_slope_t"], rtol=1e-9)


def test_ewma_sparse_matches_recursion(bars):
    x = bars.withColumn("x", F.when(F.col("delta") > 0, F.col("volume"))).select("instrument", "bar_index", "x")
    got = pdf(R.ewma_sparse(x, F.col("x"), 7.0, "ew"), "instrument", "bar_index")
    src = pdf(x, "instrument", "bar_index")
    lam = 2 ** (-1 / 7)
    for name, g in src.groupby("instrument"):
        num = den = 0.0
        want = []
        for v in g["x"]:
            if not math.isnan(v):
                num, den = lam * num + v, lam * den + 1
            want.append(num / den if den else math.nan)
        np.testing.assert_allclose(got[got.instrument == name]["ew"], want, rtol=1e-10)


def test_ewvar_matches_recursion(bars):
    one = bars.filter("instrument = 'RF'")
    got = pdf(R.ewvar(one.select("instrument", "bar_index", "close"), F.col("close"), 5.0), "bar_index")
    lam = 2 ** (-1 / 5)
    mn = md = vn = vd = 0.0
    want = []
    for v in pdf(one, "bar_index")["close"]:
        ref = mn / md if md else v
        mn, md = lam * mn + v, lam * md + 1
        vn, vd = lam * vn + (v - ref) ** 2, lam * vd + 1
        want.append(vn / vd)
    np.testing.assert_allclose(got["ew_var"], want, rtol=1e-7)


def test_empty_single_and_flat_input(spark, bars):
    empty = bars.limit(0)
    assert E.block_features(empty).count() == 0
    flat = bars.filter("instrument = 'AF' AND bar_index < 130").withColumns(
        {k: F.lit(100.0) for k in ("open", "high", "low", "close")}
    ).withColumn("volume", F.lit(0.0))
    f = E.feature_table(flat).orderBy("bar_index").toPandas()
    assert len(f) == flat.count() and (f["sigma_bp"].dropna() > 0).all() and f["participation"].isna().all()
    assert E.feature_table(flat.filter("bar_index = 0")).count() == 1
