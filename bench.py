"""Headline queries, timed once each: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from barspark.operators import decide as D
    from barspark.operators import edge as G
    from barspark.operators import features as E
    from barspark.operators import label as L
    from barspark.operators import resample as R
    from barspark.operators import splits as S
    from barspark.operators import train as T
    from barspark.plans import load
    from barspark.session import local_session, stored
    from barspark.sources import fixtures as X

    spark = local_session(CPUS, "bench")
    q = load().QUERIES
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def run(name, df_of, unit=None):
        t0 = time.time()
        df = df_of()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        if unit is not None:
            rates[name] = round(unit / times[name], 1)
        return df

    run("bars_supplier", lambda: X.supplier_bars(spark, SF_DIR))
    bars = X.supplier_bars(spark, SF_DIR)
    n = bars.count()
    run("vol_realized", lambda: q["vol_realized"](spark, SF_DIR))
    run("block_features", lambda: E.block_features(bars), n)
    t0 = time.time()
    feats = stored(lambda: E.feature_table(bars), spark, X._name("bench_features", SF_DIR))
    times["feature_table"] = round(time.time() - t0, 3)
    rates["feature_table"] = round(n / times["feature_table"], 1)
    t0 = time.time()
    rows = stored(lambda: T.decision_inputs(feats).drop("engines"), spark, X._name("bench_rows", SF_DIR))
    times["decision_inputs"] = round(time.time() - t0, 3)
    rates["decision_inputs"] = round(n / times["decision_inputs"], 1)
    cand = rows.filter("valid AND direction <> 0 AND stop_sigma IS NOT NULL AND cost_sigma < double('inf')").select(
        "instrument", F.concat_ws(":", "instrument", "bar_index").alias("candidate_id"), "bar_index", "direction",
        F.col("dominant").alias("regime"), "setup", "bucket", "p_success", "stop_sigma", "target_sigma",
        F.col("sigma_fcst").alias("sigma"), "max_holding", "cost_sigma",
    )
    t0 = time.time()
    lab = stored(lambda: L.triple_barrier(bars, cand), spark, X._name("bench_labels", SF_DIR))
    times["triple_barrier"] = round(time.time() - t0, 3)
    m = lab.count()
    rates["triple_barrier"] = round(m / times["triple_barrier"], 1)
    w = run("combined_weights", lambda: L.combined_weights(bars, lab), m)
    run("edge_posterior", lambda: G.edge_posterior(G.edge_stats(w)))
    run("cpcv_splits", lambda: S.cpcv_splits(lab, bars, 8, 2))
    led = rows.select(
        "instrument", "bar_index", "open", "high", "low", "close", "direction", "p_success", "ebe",
        (F.col("valid") & F.col("stop_sigma").isNotNull() & (F.col("p_success") > 0.55)).alias("gate_ok"), "stop_sigma", "target_sigma",
        F.col("sigma_fcst").alias("sigma"), "max_holding", F.least("cost_sigma", F.lit(0.3)).alias("cost_sigma"),
        F.lit(0.005).alias("risk_raw"), F.lit(True).alias("tradeable"), F.lit("0:0:0").alias("cell"),
    )
    run("position_ledger", lambda: D.position_ledger(led), n)
    one = X.lineitem_bars(spark, SF_DIR).filter("instrument = 'AF'")
    from barspark.operators import bars as B

    s = R.series(B.returns(one).select("instrument", "bar_index", "ret"))
    run("bootstrap_2000_paths", lambda: R.path_stat(R.bootstrap_stationary(s, 2000, 60.0), F.avg("value").alias("stat")))
    for name in ("ohlcv_tumbling", "exog_asof", "pool_log_odds", "psi_monitor", "drawdown"):
        run(name, lambda: q[name](spark, SF_DIR))
    print(
        json.dumps(
            {
                "metric": "bar_analytics_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "rows_per_sec": rates, "bars": n, "labels": m, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
