"""The per-instrument position machine, as one ordered pass over bar rows."""

from __future__ import annotations

import math

import pandas as pd

ENTRY = {1: "BUY", -1: "SHORT"}
EXIT = {1: "SELL", -1: "COVER"}

# Exposure rules of the ledger.
RULES = {
    "min_hold": 2, "p_exit": 0.55, "ebe_exit": 1.25 * 0.7, "per_100": 4, "max_risk": 0.02,
    "dd_start": 0.04, "dd_stop": 0.15, "dd_floor": 0.25, "dd_kill": 0.25,
}


def throttle(dd: float, r=RULES) -> float:
    """Size multiplier under drawdown: flat, then linear to the floor, then to zero at the kill level."""
    if dd <= r["dd_start"]:
        return 1.0
    if dd >= r["dd_kill"]:
        return 0.0
    if dd >= r["dd_stop"]:
        return r["dd_floor"] * (1.0 - (dd - r["dd_stop"]) / (r["dd_kill"] - r["dd_stop"]))
    return 1.0 - (dd - r["dd_start"]) / (r["dd_stop"] - r["dd_start"]) * (1.0 - r["dd_floor"])


OUT = {
    "action": "string", "position": "long", "growth": "double", "throttle": "double", "risk_fraction": "double",
    "entry_index": "long", "exit_price": "double", "entry_price": "double", "trade_direction": "long",
    "trade_sigma": "double", "trade_cost": "double", "trade_outcome": "long", "trade_risk": "double",
    "trade_p": "double", "trade_cell": "string", "reason": "string",
}


def ledger(rules: dict | None = None):
    """Fill at the next open, stop before target, gaps at the open, exits by time, reversal or session.

    Rows: open, high, low, close, direction, p_success, ebe, gate_ok, stop_sigma,
    target_sigma, sigma, max_holding, cost_sigma, risk_raw, tradeable, cell.
    ``growth`` is the bar's equity factor; the state keeps equity relative to its
    peak, which is all the sizing rule reads, so block states settle at new peaks.
    """
    r = RULES | (rules or {})

    def step(state, rows: pd.DataFrame):
        s = state or {"open": None, "recent": [], "rel": 1.0}
        op, recent, rel = (dict(s["open"]) if s["open"] else None), list(s["recent"]), s["rel"]
        cols = [
            "bar_index", "open", "high", "low", "close", "direction", "p_success", "ebe", "gate_ok", "stop_sigma",
            "target_sigma", "sigma", "max_holding", "cost_sigma", "risk_raw", "tradeable", "cell",
        ]
        out = {k: [] for k in OUT}
        for t, o, h, lo, cl, d, p, ebe, ok, ss, ts, sg, hold, cost, raw, live, cell in zip(*(rows[k].tolist() for k in cols)):
            growth, done, action, size = 1.0, None, "NO TRADE", None
            if op is not None:
                side = op["d"]
                if op["px"] is None and o > 0:  # no fill and no exit at a price of zero
                    op["px"] = o
                stop, target = (op["px"] * math.exp(side * k * op["sg"]) for k in (-op["ss"], op["ts"])) if op["px"] else (math.nan, math.nan)
                if (lo <= stop) if side > 0 else (h >= stop):
                    gap = (0 < o < stop) if side > 0 else (o > stop)
                    done = (o if gap else stop, -1, "stop (gapped through)" if gap else "stop")
                elif (h >= target) if side > 0 else (lo <= target):
                    done = (target, 1, "target")
                else:
                    op["held"] += 1
                    if op["held"] >= op["hold"]:
                        done = (cl, 0, "vertical barrier")
                    elif op["held"] >= r["min_hold"] and d == -side and p >= r["p_exit"] and ebe >= r["ebe_exit"]:
                        done = (cl, 0, "reversal")
                    elif not live:
                        done = (cl, 0, "session closing")
                    done = done if op["px"] and cl > 0 else None
                    if done:
                        action = EXIT[side]
            trade = None
            if done:
                got = math.log(done[0] / op["px"]) * op["d"] / op["sg"]
                if op["risk"] > 0:
                    growth = 1.0 + (got - op["cost"]) / op["ss"] * op["risk"]
                    rel = min(1.0, rel * growth)
                trade = (op["at"], done[0], op["px"], op["d"], got, op["cost"], done[1], op["risk"], op["p"], op["cell"], done[2])
                op = None
            scale = throttle(1.0 - rel, r)
            if op is None and action == "NO TRADE" and ok:
                recent = [i for i in recent if i >= t - 100]
                size = min(max(raw * scale, 0.0), r["max_risk"])
                if len(recent) < r["per_100"] and size > 0:
                    op = {
                        "d": int(d), "at": t, "px": None, "ss": ss, "ts": ts, "sg": sg, "hold": hold, "held": 0,
                        "cost": cost, "risk": size, "p": p, "cell": cell,
                    }
                    recent, action = [*recent, t], ENTRY[int(d)]
                else:
                    size = None
            for k, v in zip(OUT, (action, op["d"] if op else 0, growth, scale, size, *(trade or (None,) * 11))):
                out[k].append(v)
        recent = [i for i in recent if i >= rows["bar_index"].iloc[-1] - 100]
        frame = {k: pd.array(v, dtype="Int64") if OUT[k] == "long" else v for k, v in out.items()}
        return {"open": op, "recent": recent, "rel": rel}, frame

    return step
