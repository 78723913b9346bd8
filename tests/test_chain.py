"""The decision chain with its feedback against a plain program that recomputes everything from the list of trades."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions.expr import student_t_ppf
from barspark.kernels import chain as N
from barspark.kernels.calib import knots
from barspark.operators import decide as D
from barspark.operators import edge as G

SCHEMA = (
    "instrument string, seq long, bar_index long, issue string, open double, high double, low double, close double, direction long, p_success double, ebe double,"
    " valid boolean, phase long, dominant long, max_posterior double, hazard double, n_invalid long, setup long, bucket long, stop_sigma double,"
    " target_sigma double, sigma double, max_holding long, cost_sigma double, psi_max double"
)
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]
RULES = {"map_from": 20, "map_every": 10, "scored_from": 10, "report_every": 7, "health_keeps": 30, "map_keeps": 40, "halflife": 300.0, "lcb_min": 0.0}


def events(n, seed, name="X"):
    rng = np.random.default_rng(seed)
    close = (100 * np.exp(np.cumsum(rng.normal(0.0004, 0.01, n)))).tolist()
    rows, t = [], 0
    for i in range(n):
        if i and rng.random() < 0.04:  # a rejected bar: no number, no values
            rows.append((name, i, None, "duplicate_timestamp") + (None,) * 21)
            continue
        o = close[i - 1] * math.exp(rng.normal(0, 0.004)) if i else close[0]
        h, lo = max(o, close[i]) * (1 + abs(rng.normal(0, 0.006))), min(o, close[i]) * (1 - abs(rng.normal(0, 0.006)))
        d = int(rng.choice([1, 1, 1, -1, 0]))
        plan = d != 0 and rng.random() < 0.97
        rows.append(
            (name, i, t, None, o, h, lo, close[i], d, float(rng.uniform(0.5, 0.8)), float(rng.uniform(0.6, 4)), bool(rng.random() < 0.97), int(rng.choice([0] * 20 + [1, 2])),
             int(rng.choice([0, 0, 1, 2, 3])), float(rng.uniform(0.4, 1)), float(rng.uniform(0, 0.4)), int(rng.choice([0, 1, 4])), int(rng.integers(0, 2)), int(rng.integers(0, 2)),
             1.6 if plan else None, 2.6 if plan else None, float(rng.choice([0.01, 0.03])), int(rng.integers(3, 9)), float(rng.choice([0.05, 0.2, math.inf], p=[0.7, 0.27, 0.03])),
             float(rng.uniform(0, 0.6)) if rng.random() < 0.5 else None)
        )
        t += 1
    return rows


def plain(rows, r, seed_cells, equity=1.0):
    """(action, veto, equity, level, p, risk, ev_lcb) per row; state is the list of closed trades and the open one, nothing else."""
    trades, op, entries, out, level, brier = [], None, [], [], 0, None

    def posterior(cell, t):
        def sums(match):
            n = s1 = s2 = 0.0
            for key, at, a, b, c in seed_cells:
                if match(key):
                    g = 0.5 ** ((t - at) / r["halflife"])
                    n, s1, s2 = n + a * g, s1 + b * g, s2 + c * g
            for x in trades:
                if match(x["cell"]):
                    g, v = 0.5 ** ((t - x["t"]) / r["halflife"]), max(-12, min(12, x["ret"]))
                    n, s1, s2 = n + g, s1 + g * v, s2 + g * v * v
            return n, s1, s2

        outside, beside, own = sums(lambda k: k[:2] != cell[:2]), sums(lambda k: k[:2] == cell[:2] and k != cell), sums(lambda k: k == cell)
        mu = 0.0
        for (n, s1, _), strength in ((outside, 40.0), (beside, 25.0)):
            mu = (strength * mu + s1) / (strength + n) if n > 1e-15 else mu
        n, s1, s2 = own
        a, k = 3.0 + n / 2, 25.0 + n
        b = 4.5 + (0.5 * max(s2 - s1 * s1 / n, 0.0) + 25.0 * n * (s1 / n - mu) ** 2 / (2 * k) if n > 0 else 0.0)
        mean, scale2, dof = ((25.0 * mu + s1) / k if n > 0 else mu), b / (a * k), 2 * a
        return mean, mean + N.t_quantile(-1.2815515655446004, dof) * math.sqrt(scale2), b / (a - 1) + scale2 * dof / (dof - 2), n

    def wealth_path():
        path = [equity]
        for x in trades:
            path.append(path[-1] * (1 + (x["ret"] - x["cost"]) / x["ss"] * x["risk"]))
        return path

    for row in rows:
        b = dict(zip(COLUMNS, row))
        if b["issue"]:
            out.append(("NO TRADE", "bar rejected: " + b["issue"], wealth_path()[-1], level, None, None, None))
            continue
        t, d, p = b["bar_index"], b["direction"], b["p_success"]
        fits = [k for k in range(len(trades) + 1) if k >= r["map_from"]]
        last_fit = None
        while fits:  # the first fit once there are enough, then one every few
            last_fit = fits[0]
            fits = [k for k in fits if k >= last_fit + r["map_every"]]
        if last_fit:
            kept = trades[:last_fit][-r["map_keeps"] :]
            xs, ys = zip(*knots(np.array([x["p"] for x in kept]), np.array([x["y"] for x in kept])))
            up = float(np.clip(np.interp(p if d >= 0 else 1 - p, xs, ys), 1e-6, 1 - 1e-6))
            p = up if d >= 0 else 1 - up
        if t and t % r["report_every"] == 0:
            seen, level = trades[-r["health_keeps"] :], 0
            if len(seen) >= r["scored_from"]:
                brier = sum((x["p"] - x["y"]) ** 2 for x in seen) / len(seen)
                base = sum(x["y"] for x in seen) / len(seen)
                level = 3 if brier > 0.27 else 1 if brier > 0.9 * 0.27 else 0
                if 0 < base < 1 and brier > base * (1 - base) and len(seen) >= r["map_from"]:
                    level = 3
            if b["psi_max"] is not None and b["psi_max"] > 0.25:
                level = max(level, 2)

        def close(price, why, y):
            trades.append(dict(t=t, cell=op["cell"], ret=math.log(price / op["px"]) * op["d"] / op["sg"], cost=op["cost"], ss=op["ss"], risk=op["risk"], p=op["p"], y=y, why=why))

        if op:
            op.setdefault("px", b["open"])
            sp, tp = op["px"] * math.exp(-op["d"] * op["ss"] * op["sg"]), op["px"] * math.exp(op["d"] * op["ts"] * op["sg"])
            worst, best = (b["low"], b["high"]) if op["d"] > 0 else (-b["high"], -b["low"])
            if worst <= op["d"] * sp:
                close(b["open"] if op["d"] * b["open"] < op["d"] * sp else sp, "stop", 0.0)
                op = None
            elif best >= op["d"] * tp:
                close(tp, "target", 1.0)
                op = None
        cell = (b["dominant"], b["setup"], b["bucket"])
        mean, lcb, var, n = posterior(cell, t)
        low, net = lcb - b["cost_sigma"], mean - b["cost_sigma"]
        path = wealth_path()
        dd = 1 - path[-1] / max(path)
        shown = low if low > -math.inf else None
        if op:
            op["held"] += 1
            why = (
                "vertical barrier" if op["held"] >= op["hold"]
                else "reversal" if op["held"] >= 2 and d == -op["d"] and p >= 0.55 and b["ebe"] >= 1.25 * 0.7
                else "session closing" if b["phase"] in (1, 7, 8) else None
            )
            if why:
                action = "SELL" if op["d"] > 0 else "COVER"
                close(b["close"], why, 0.0)
                op = None
                out.append((action, why, wealth_path()[-1], level, p, None, shown))
            else:
                out.append(("NO TRADE", "already in a position", path[-1], level, p, None, shown))
            continue
        planned = b["stop_sigma"] is not None and d != 0
        size, blocks = None, []
        if planned:
            blocks = [k for k, on in {"drawdown": dd >= 0.25, "brier": brier is not None and brier > 0.27, "demotion: no trade": level == 3, "demotion: restricted": level == 2 and b["max_posterior"] < 0.75}.items() if on]
            if not blocks and low <= 0:
                blocks = ["expectancy"]
            f = 1.0 if dd <= 0.04 else 0.0 if dd >= 0.25 else 0.25 * (1 - (dd - 0.15) / 0.1) if dd >= 0.15 else 1 - (dd - 0.04) / 0.11 * 0.75
            size = 0.0 if blocks else min(0.02, max(net, 0) / var * 0.25 * min(max(low / max(net, 1e-9), 0), 1) * min(max(n / 30, 0.15), 1) * f * (0.5 if level == 1 else 1))
        recent = [e for e in entries if e >= t - 100]
        first = "features not valid" if not b["valid"] else "no directional evidence" if d == 0 else "no volatility forecast for barriers" if not planned else "session phase" if b["phase"] in (1, 2, 6, 7, 8) else None
        if first:
            veto = [first]
        else:
            veto = [k for k, on in {
                "quiet regime": b["dominant"] == 3, "transition hazard": b["hazard"] > 0.35, "expectancy lower bound": not low > r["lcb_min"], "probability": p < 0.58, "effective breadth": b["ebe"] < 1.25,
                "engines invalid": b["n_invalid"] > 3, "entry rate": len(recent) >= 4, "zero size: " + ("+".join(blocks) or "throttled"): size <= 0}.items() if on]
        if veto:
            out.append(("NO TRADE", ",".join(veto), path[-1], level, p, size, shown))
        else:
            op = dict(d=d, ss=b["stop_sigma"], ts=b["target_sigma"], sg=b["sigma"], hold=b["max_holding"], held=0, cost=b["cost_sigma"], risk=size, p=p, cell=cell)
            entries.append(t)
            out.append(("BUY" if d > 0 else "SHORT", "", path[-1], level, p, size, shown))
    return out, trades


def seeded(spark, names):
    stats = spark.createDataFrame(
        [("leaf", r, s, b, 120.0, 120.0 * m, 120.0 * (m * m + 1.5)) for r in range(4) for s in range(2) for b in range(2) for m in (1.1 - 0.2 * b,)],
        "level string, regime long, setup long, bucket long, n_w double, s1 double, s2 double",
    )
    sums = stats.rollup("regime", "setup", "bucket").agg(F.sum("n_w").alias("n_w"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.grouping_id().alias("g")).filter("g IN (0, 1, 7)")
    return D.book_start(spark.createDataFrame([(n,) for n in names], "instrument string"), sums), [((r["regime"], r["setup"], r["bucket"]), 0, r["n_w"], r["s1"], r["s2"]) for r in stats.collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["action"], g["veto"], g["level"]) == (w[0], w[1], w[3])
        for k, v in (("equity", w[2]), ("p", w[4]), ("risk_fraction", w[5]), ("ev_lcb", w[6])):
            assert (g[k] is None and v is None) or g[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k


@pytest.fixture(scope="module")
def chains(spark):
    rows = {"X": events(1500, 1, "X"), "Y": events(700, 2, "Y")}
    table = spark.createDataFrame([r for x in rows.values() for r in x], SCHEMA)
    start, cells = seeded(spark, rows)
    return rows, table, start, cells


def test_chain_equals_plain_program_and_block_size_is_free(chains):
    rows, table, start, cells = chains
    r = N.LIMITS | RULES
    for block in (97, 1 << 20):
        made, _ = D.decisions(table, RULES, start=start, block=block)
        got = made.orderBy("instrument", "seq").collect()
        reasons = set()
        for name, x in rows.items():
            want, trades = plain(x, r, cells)
            same([g for g in got if g["instrument"] == name], want)
            reasons |= {v.split(":")[0] for w in want for v in w[1].split(",")} | {t["why"] for t in trades}
            booked = [g for g in got if g["instrument"] == name and g["entry_index"] is not None]
            assert [g["trade_sigma"] for g in booked] == pytest.approx([t["ret"] for t in trades])
        # the data reach every branch
        assert {"entry rate", "zero size", "already in a position", "bar rejected", "stop", "target", "vertical barrier", "reversal", "session closing", "engines invalid"} <= reasons
        assert {g["level"] for g in got} >= {0, 2, 3}


def test_ten_batches_and_restarts_equal_one_run(chains):
    _, table, start, _ = chains
    whole = D.decisions(table, RULES, start=start)[0].orderBy("instrument", "seq").toPandas()
    parts, states = [], start
    for k in range(10):
        made, states = D.decisions(table.filter(F.floor(F.col("seq") / 150) == k), RULES, start=states, block=64)
        parts.append(made.toPandas())
    both = pd.concat(parts).sort_values(["instrument", "seq"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(both, whole, check_dtype=False)


def test_pending_fill_waits_across_a_rejected_bar(spark):
    rows = events(400, 5)
    start, cells = seeded(spark, ["X"])
    got = D.decisions(spark.createDataFrame(rows, SCHEMA), {"lcb_min": -9.0}, start=start)[0].orderBy("seq").collect()
    entry = next(i for i, g in enumerate(got) if g["action"] in ("BUY", "SHORT"))
    # put a rejected bar right behind the entry: the fill is the open of the next accepted bar
    moved = [(r[0], r[1] + (i > entry), *r[2:]) for i, r in enumerate(rows)]
    moved.insert(entry + 1, ("X", entry + 1, None, "non_finite") + (None,) * 21)
    again = D.decisions(spark.createDataFrame(moved, SCHEMA), {"lcb_min": -9.0}, start=start)[0].orderBy("seq").collect()
    assert again[entry + 1]["veto"] == "bar rejected: non_finite" and again[entry + 1]["position"] == got[entry]["position"]
    assert [g["trade_sigma"] for g in again if g["trade_sigma"] is not None] == [g["trade_sigma"] for g in got if g["trade_sigma"] is not None]


def test_frozen_chain_learns_nothing_but_still_demotes(chains):
    rows, table, start, _ = chains
    made, ends = D.decisions(table, RULES | {"scored_from": 5}, learn=False, start=start)
    import json

    state = json.loads(ends.filter("instrument = 'X'").first()["state"])
    assert state["map"] is None and state["outcomes"]
    assert json.loads(start.first()["state"])["book"] == {k: [float(x) for x in v] for k, v in state["book"].items()}


@pytest.mark.parametrize("bad", [{"p_min": 5.8}, {"halflife": -1.0}, {"dd_start": 0.3}, {"no such rule": 1}])
def test_rules_out_of_range_are_refused(bad):
    with pytest.raises(ValueError, match="out of range"):
        N.chain(bad)


def test_columns_and_kernel_agree_on_the_posterior(spark):
    sums = [(3.0, 2.0, 5.0), (8.0, 4.0, 11.0), (20.0, 9.0, 30.0)]
    book = N.Book({"1:2:3": [0, *sums[0]], "1:2": [0, *sums[1]], "": [0, *sums[2]]}, N.LIMITS)
    row = {f"{k}_{lv}": v for lv, s in zip("lmg", sums) for k, v in zip(("n", "s1", "s2"), s)}
    want = G.chain(spark.createDataFrame([row])).first()
    got = book.estimate((1, 2, 3), 0)
    assert (got["mean"], got["lcb"], got["n"]) == pytest.approx((want["mean"], want["lcb"], want["n_eff"]))
    assert got["var"] == pytest.approx(want["outcome_var"] + want["var_mean"])
    assert spark.range(1).select(student_t_ppf(0.1, F.lit(7.0)).alias("t")).first()["t"] == pytest.approx(N.t_quantile(-1.2815515655446004, 7.0))


def test_learning_stream_equals_batch_over_ten_batches_and_a_restart(spark, chains, tmp_path):
    from barspark.streaming import streams as R

    _, table, _, _ = chains
    rules = RULES | {"prior_mean": 2.0}  # a stream starts with an empty book: let its prior trade
    whole = D.decisions(table, rules)[0].orderBy("instrument", "seq").toPandas()
    assert whole["entry_index"].notna().sum() > 10
    src, out, ck = (str(tmp_path / k) for k in ("in", "out", "ck"))

    def run(batches):
        for k in batches:
            table.filter(F.floor(F.col("seq") / 150) == k).coalesce(1).write.mode("append").parquet(src)
            stream = R.stream_chain(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src), rules)
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination()  # every batch is a new query: ten restarts

    run(range(10))
    got = spark.read.parquet(out).orderBy("instrument", "seq").toPandas()
    pd.testing.assert_frame_equal(got, whole, check_dtype=False)


def test_no_fill_and_no_exit_at_a_price_of_zero(monkeypatch):
    from barspark.kernels import ledger as K

    n = 6
    rows = pd.DataFrame({
        "instrument": "X", "bar_index": range(n), "open": [10.0, 0.0, 10.0, 0.0, 10.0, 10.0], "high": 10.2, "low": [9.9, 0.0, 9.9, 0.0, 9.9, 9.9], "close": [10.0, 0.0, 10.0, 0.0, 10.0, 10.0],
        "direction": 1, "p_success": 0.6, "ebe": 2.0, "gate_ok": [True] + [False] * (n - 1), "stop_sigma": 2.0, "target_sigma": 9.0, "sigma": 0.05, "max_holding": 30, "cost_sigma": 0.1,
        "risk_raw": 0.01, "tradeable": True, "cell": "0:0:0",
    })
    out = pd.DataFrame(K.ledger()(None, rows)[1])
    closed = out[out["entry_price"].notna()]
    assert closed["entry_price"].tolist() == [10.0] and closed["exit_price"].tolist() == [pytest.approx(10 * math.exp(-0.1))] and closed["reason"].tolist() == ["stop"]
