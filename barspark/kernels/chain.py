"""The decision chain of one instrument: fill, exits, booking, learning, demotion, sizing and the full gate, bar by bar.

What a bar decides depends on what earlier decisions earned: trades feed the expectancy book, the calibration map, the health
level and the drawdown, and those feed the gate. All of it is one small state, so a block of bars is a function of that state.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd

from .calib import knots
from .ledger import ENTRY, EXIT, RULES, throttle

# Thresholds of the gate, the book's prior, the health ladder and the calibration map.
LIMITS = RULES | {
    "p_min": 0.58, "ebe_min": 1.25, "lcb_min": 0.05, "hazard_max": 0.35, "n_engines": 9, "shorts": True,
    "prior_a": 3.0, "prior_b": 4.5, "prior_mean": 0.0, "prior_strength": 40.0, "pooling": 25.0, "halflife": 5040.0, "quantile": 0.1,
    "kelly": 0.25, "report_every": 50, "scored_from": 50, "brier_alarm": 0.27, "psi_alarm": 0.25, "restricted_posterior": 0.75,
    "map_from": 200, "map_every": 50, "map_keeps": 5000, "health_keeps": 2000,
}
CLOSED_PHASES, AUCTION_PHASES, QUIET = (1, 7, 8), (2, 6), 3

IN = (
    "seq", "bar_index", "issue", "open", "high", "low", "close", "direction", "p_success", "ebe", "valid", "phase", "dominant", "max_posterior", "hazard",
    "n_invalid", "setup", "bucket", "stop_sigma", "target_sigma", "sigma", "max_holding", "cost_sigma", "psi_max",
)
OUT = {
    "action": "string", "position": "long", "veto": "string", "p": "double", "ev_mean": "double", "ev_lcb": "double", "n_eff": "double", "level": "long",
    "throttle": "double", "risk_fraction": "double", "units": "double", "equity": "double", "entry_index": "long", "entry_price": "double",
    "exit_price": "double", "trade_direction": "long", "trade_sigma": "double", "trade_cost": "double", "trade_outcome": "long", "trade_risk": "double",
    "trade_p": "double", "trade_cell": "string", "reason": "string",
}


def checked(rules: dict | None = None) -> dict:
    """The rules in force; a value that cannot be meant is refused before anything runs."""
    r = LIMITS | (rules or {})
    wrong = [k for k in r if k not in LIMITS]
    wrong += [k for k in ("p_min", "p_exit", "quantile", "restricted_posterior", "dd_floor") if not 0.0 < r[k] < 1.0]
    wrong += [k for k in ("halflife", "prior_strength", "pooling", "max_risk", "kelly", "report_every", "map_every", "per_100", "health_keeps", "map_keeps") if not r[k] > 0]
    if not 0.0 <= r["dd_start"] < r["dd_stop"] <= r["dd_kill"] <= 1.0:
        wrong.append("dd_start, dd_stop, dd_kill")
    if wrong:
        raise ValueError("rules out of range: " + ", ".join(sorted(set(wrong))))
    return r


def t_quantile(z: float, dof: float) -> float:
    """Student-t quantile from the normal one: the expansion that the book's columns use."""
    g1 = (z**3 + z) / 4.0
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96.0
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0
    return z + g1 / dof + g2 / dof**2 + g3 / dof**3


class Book:
    """Decayed sums (n, s1, s2) per cell, node and root, each with the clock of its last change."""

    def __init__(self, cells: dict[str, list[float]], rules: dict):
        self.cells, self.r, self.z = cells, rules, NormalDist().inv_cdf(rules["quantile"])

    @staticmethod
    def levels(regime: int, setup: int, bucket: int) -> tuple[str, str, str]:
        return f"{regime}:{setup}:{bucket}", f"{regime}:{setup}", ""

    def sums(self, key: str, clock: int) -> tuple[float, float, float]:
        at, n, s1, s2 = self.cells.get(key, (clock, 0.0, 0.0, 0.0))
        g = 0.5 ** ((clock - at) / self.r["halflife"])
        return n * g, s1 * g, s2 * g

    def add(self, cell: tuple[int, int, int], ret: float, clock: int) -> None:
        v = min(max(ret, -12.0), 12.0)
        for key in self.levels(*cell):
            n, s1, s2 = self.sums(key, clock)
            self.cells[key] = [clock, n + 1.0, s1 + v, s2 + v * v]

    def _mean(self, sums: tuple[float, float, float], mu: float, strength: float) -> float:
        n, s1, _ = sums
        return (strength * mu + s1) / (strength + n) if n > 0 else mu

    def estimate(self, cell: tuple[int, int, int], clock: int) -> dict[str, float]:
        """Posterior of a cell's mean; each level is shrunk to the level above without its own outcomes."""
        r = self.r
        leaf, node, root = (self.sums(k, clock) for k in self.levels(*cell))

        def less(a, b):
            n = max(a[0] - b[0], 0.0)
            return (n, a[1] - b[1], max(a[2] - b[2], 0.0)) if n > 0 else (0.0, 0.0, 0.0)

        mu = self._mean(less(root, node), r["prior_mean"], r["prior_strength"])
        mu = self._mean(less(node, leaf), mu, r["pooling"])
        (n, s1, s2), k = leaf, r["pooling"]
        a, b = r["prior_a"] + 0.5 * n, r["prior_b"]
        if n > 0:
            b += 0.5 * max(s2 - s1 * s1 / n, 0.0) + k * n * (s1 / n - mu) ** 2 / (2.0 * (k + n))
        mean, dof, scale2 = self._mean(leaf, mu, k), 2.0 * a, b / (a * (k + n))
        low = mean + t_quantile(self.z, dof) * math.sqrt(scale2)
        return {"mean": mean, "lcb": low, "var": b / (a - 1.0) + scale2 * dof / (dof - 2.0), "n": n}


def health_level(outcomes: list[list[float]], psi: float | None, r: dict) -> tuple[int, float | None]:
    """(level of the ladder, Brier score or None) from the last outcomes and the worst feature's drift."""
    level, brier = 0, None
    last = np.array(outcomes[-r["health_keeps"] :])
    if len(last) >= r["scored_from"]:
        p, y = last[:, 0], last[:, 1]
        brier = float(np.mean((p - y) ** 2))
        base = float(np.mean(y))
        if brier > r["brier_alarm"]:
            level = 3
        elif brier > 0.9 * r["brier_alarm"]:
            level = 1
        if base * (1.0 - base) > 0 and 1.0 - brier / (base * (1.0 - base)) < 0 and len(last) >= r["map_from"]:
            level = 3
    if psi is not None and psi > r["psi_alarm"]:
        level = max(level, 2)
    return level, brier


def _number(v) -> float | None:
    return None if v is None or v != v else v


def chain(rules: dict | None = None, learn: bool = True, equity: float = 1.0):
    """Kernel over rows of ``IN``. A row with ``issue`` is a rejected bar: it decides nothing and leaves a pending fill pending."""
    r = checked(rules)

    def step(state: dict | None, rows: pd.DataFrame):
        s = state or {"open": None, "recent": [], "equity": equity, "peak": equity, "book": {}, "outcomes": [], "since": 0, "map": None, "level": 0, "brier": None}
        op, recent, book = (dict(s["open"]) if s["open"] else None), list(s["recent"]), Book(dict(s["book"]), r)
        wealth, peak, outcomes, since, steps, level, brier = s["equity"], s["peak"], list(s["outcomes"]), s["since"], s["map"], s["level"], s["brier"]
        out: dict[str, list] = {k: [] for k in OUT}

        def emit(**given) -> None:
            for k in OUT:
                out[k].append(given.get(k))

        def booked(price: float, outcome: int, why: str) -> dict:
            """The closed trade's columns; equity, book, map and health take it in."""
            nonlocal op, wealth, peak, since, steps
            got = math.log(price / op["px"]) * op["d"] / op["sg"]
            if op["risk"] > 0 and op["ss"] > 0:
                wealth *= 1.0 + (got - op["cost"]) / op["ss"] * op["risk"]
                peak = max(peak, wealth)
            hit = 1.0 if outcome > 0 else 0.0
            outcomes.append([op["p"], hit])
            del outcomes[: -max(r["map_keeps"], r["health_keeps"])]
            if learn:
                book.add(tuple(op["cell"]), got, t)
                since += 1
                kept = np.array(outcomes[-r["map_keeps"] :])
                if len(kept) >= r["map_from"] and since >= r["map_every"]:
                    steps, since = [list(k) for k in knots(kept[:, 0], kept[:, 1])], 0
            trade = {
                "entry_index": op["at"], "entry_price": op["px"], "exit_price": price, "trade_direction": op["d"], "trade_sigma": got, "trade_cost": op["cost"],
                "trade_outcome": outcome, "trade_risk": op["risk"], "trade_p": op["p"], "trade_cell": ":".join(map(str, op["cell"])), "reason": why,
            }
            op = None
            return trade

        columns = (rows[k].tolist() for k in IN[1:])
        for t, issue, o, h, lo, cl, d, p, ebe, valid, phase, regime, top, hazard, n_invalid, setup, bucket, ss, ts, sg, hold, cost, psi in zip(*columns, strict=True):
            if isinstance(issue, str):
                emit(action="NO TRADE", position=op["d"] if op else 0, veto=f"bar rejected: {issue}", level=level, equity=wealth)
                continue
            t, d, phase, regime = int(t), int(d or 0), int(phase), int(regime)
            cell = (regime, int(setup), int(bucket))
            if steps and p == p and p is not None:
                up = p if d >= 0 else 1.0 - p
                up = min(max(float(np.interp(up, [k[0] for k in steps], [k[1] for k in steps])), 1e-6), 1.0 - 1e-6)
                p = up if d >= 0 else 1.0 - up
            if t > 0 and t % r["report_every"] == 0:
                level, scored = health_level(outcomes, _number(psi), r)
                brier = brier if scored is None else scored
            trade: dict = {}
            if op is not None:
                side = op["d"]
                if op["px"] is None and o > 0:  # no fill and no exit at a price of zero
                    op["px"] = o
                stop, target = (op["px"] * math.exp(side * k * op["sg"]) for k in (-op["ss"], op["ts"])) if op["px"] else (math.nan, math.nan)
                if (lo <= stop) if side > 0 else (h >= stop):
                    gap = (0 < o < stop) if side > 0 else (o > stop)
                    trade = booked(o if gap else stop, -1, "stop (gapped through)" if gap else "stop")
                elif (h >= target) if side > 0 else (lo <= target):
                    trade = booked(target, 1, "target")
            e = book.estimate(cell, t)
            cost = math.inf if _number(cost) is None else cost
            low, net = e["lcb"] - cost, e["mean"] - cost
            scale = throttle(max(0.0, 1.0 - wealth / peak), r)
            told = {"p": p, "ev_mean": net if net > -math.inf else None, "ev_lcb": low if low > -math.inf else None, "n_eff": e["n"], "level": level, "throttle": scale}
            if op is not None:
                op["held"] += 1
                why = None
                if op["held"] >= op["hold"]:
                    why = "vertical barrier"
                elif op["held"] >= r["min_hold"] and d == -op["d"] and p >= r["p_exit"] and ebe >= r["ebe_min"] * 0.7:
                    why = "reversal"
                elif phase in CLOSED_PHASES:
                    why = "session closing"
                if why and op["px"] and cl > 0:
                    action = EXIT[op["d"]]
                    trade = booked(cl, 0, why)
                    emit(action=action, position=0, veto=why, equity=wealth, **told, **trade)
                else:
                    emit(action="NO TRADE", position=op["d"], veto="already in a position", equity=wealth, **told)
                continue
            planned = _number(ss) is not None and d != 0
            # size: blocks first, then Kelly under the cell's posterior and every throttle
            blocks, size, units = [], None, None
            if planned:
                if 1.0 - wealth / peak >= r["dd_kill"]:
                    blocks.append("drawdown")
                if brier is not None and brier > r["brier_alarm"]:
                    blocks.append("brier")
                if level >= 3:
                    blocks.append("demotion: no trade")
                elif level == 2 and not top >= r["restricted_posterior"]:
                    blocks.append("demotion: restricted")
                size = 0.0
                if not blocks and low > 0 and ss > 0:
                    kelly = max(net, 0.0) / e["var"]
                    haircut = min(max(low / max(net, 1e-9), 0.0), 1.0)
                    raw = kelly * r["kelly"] * haircut * min(max(e["n"] / 30.0, 0.15), 1.0) * scale * (0.5 if level == 1 else 1.0)
                    size = min(max(raw, 0.0), r["max_risk"])
                elif not blocks:
                    blocks.append("expectancy")
                distance = abs(cl * (1.0 - math.exp(-ss * sg)))
                units = size * wealth / distance if distance > 0 else 0.0
            if not valid:
                veto = ["features not valid"]
            elif d == 0:
                veto = ["no directional evidence"]
            elif not planned:
                veto = ["no volatility forecast for barriers"]
            elif d < 0 and not r["shorts"]:
                veto = ["shorts disabled"]
            elif phase in CLOSED_PHASES or phase in AUCTION_PHASES:
                veto = ["session phase"]
            else:
                recent = [i for i in recent if i >= t - 100]
                tests = {
                    "quiet regime": regime == QUIET, "transition hazard": hazard > r["hazard_max"], "expectancy lower bound": not low > r["lcb_min"],
                    "probability": not p >= r["p_min"], "effective breadth": not ebe >= r["ebe_min"],
                    "engines invalid": n_invalid > max(2, r["n_engines"] // 3), "entry rate": len(recent) >= r["per_100"],
                    "zero size: " + ("+".join(blocks) or "throttled"): size <= 0.0,
                }
                veto = [name for name, failed in tests.items() if failed]
            if veto:
                emit(action="NO TRADE", position=0, veto=",".join(veto), risk_fraction=size, units=units, equity=wealth, **told, **trade)
                continue
            op = {"d": d, "at": t, "px": None, "ss": ss, "ts": ts, "sg": sg, "hold": hold, "held": 0, "cost": cost if cost < math.inf else 0.0, "risk": size, "p": p, "cell": list(cell)}
            recent.append(t)
            emit(action=ENTRY[d], position=d, veto="", risk_fraction=size, units=units, equity=wealth, **told, **trade)
        frame = {k: pd.array(v, dtype="Int64") if OUT[k] == "long" else v for k, v in out.items()}
        end = {"open": op, "recent": recent, "equity": wealth, "peak": peak, "book": book.cells, "outcomes": outcomes, "since": since, "map": steps, "level": level, "brier": brier}
        return end, frame

    return step
