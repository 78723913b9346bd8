"""Recursions over one instrument's bars: ``step(state, rows) -> (state, columns)``.

A step starts from the state before the rows and returns the state after them,
so a run over blocks, a run over micro-batches and one long run agree.  States
are small JSON-able dicts; counters stop at the value they are tested against.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

NAN = math.nan


def kalman(q_level: float = 0.02, q_slope: float = 0.002):
    """Local linear trend of log price, all noise variances in units of sigma^2."""

    def step(state, rows: pd.DataFrame):
        s = state or {"n": 0, "x": [0.0, 0.0], "p": [0.0, 0.0, 0.0]}
        n, (lv, sl), (p0, p1, p2) = s["n"], s["x"], s["p"]
        with np.errstate(divide="ignore", invalid="ignore"):  # a price of zero has no log
            price = np.log(rows["close"].to_numpy(dtype=float)).tolist()
        out = np.full((3, len(rows)), NAN)
        for i, (y, sg) in enumerate(zip(price, rows["sigma_bp"].to_numpy(dtype=float).tolist())):
            if y > -math.inf and sg > 0:
                r = sg * sg
                if n == 0:
                    lv, sl, p0, p1, p2, n = y, 0.0, 100.0 * r, 0.0, r, 1
                else:
                    lv += sl
                    p0, p1, p2 = p0 + 2.0 * p1 + p2 + q_level * r, p1 + p2, p2 + q_slope * r
                    gain0, gain1 = p0 / (p0 + r), p1 / (p0 + r)
                    err = y - lv
                    lv, sl = lv + gain0 * err, sl + gain1 * err
                    p2 = max(p2 - gain1 * p1, 1e-300)
                    p0, p1 = max(p0 * (1.0 - gain0), 1e-300), p1 * (1.0 - gain0)
                    n = min(n + 1, 5)
            if n:
                out[0, i], out[1, i] = lv, sl
                if n >= 5:
                    out[2, i] = sl / math.sqrt(p2)
        return {"n": n, "x": [lv, sl], "p": [p0, p1, p2]}, {
            "kalman_level": out[0], "kalman_slope": out[1], "kalman_slope_t": out[2]
        }

    return step


def pivots(mult: float = 1.5, min_bars: int = 3):
    """Volatility-scaled zigzag; a pivot is readable from its confirming bar on.

    Gives the readings of every bar and, on a confirming bar, the pivot itself.
    """

    def step(state, rows: pd.DataFrame):
        s = state or {"up": True, "cand": None, "high": [], "low": []}
        up, cand = s["up"], s["cand"]
        last = {"high": [list(p) for p in s["high"]], "low": [list(p) for p in s["low"]]}
        size = len(rows)
        num = {k: np.full(size, NAN) for k in (
            "pivot_high", "pivot_low", "pivot_high_age", "pivot_low_age", "structure_bias", "range_pos",
            "range_sigma", "pivot_price", "retrace_sigma")}
        kinds, at = [None] * size, [None] * size
        cols = (rows[c].to_numpy(dtype=float).tolist() for c in ("high", "low", "close", "sigma_bp"))
        for i, (t, h, lo, c, sg) in enumerate(zip(rows["bar_index"].tolist(), *cols)):
            if sg > 0:
                edge, other = (h, lo) if up else (lo, h)
                if cand is None or (edge >= cand[0] if up else edge <= cand[0]):
                    cand = [edge, t, sg]
                else:
                    top, bot = (cand[0], other) if up else (other, cand[0])
                    back = math.log(top / bot) if bot > 0 else 0.0  # no distance to a price of zero
                    if back >= mult * cand[2] and t - cand[1] >= min_bars:
                        kind = "high" if up else "low"
                        last[kind] = [*last[kind][-1:], [cand[0], t]]
                        kinds[i], at[i] = kind, cand[1]
                        num["pivot_price"][i], num["retrace_sigma"][i] = cand[0], back / cand[2]
                        up, cand = not up, [other, t, sg]
            hi_p, lo_p = last["high"], last["low"]
            for name, ps in (("high", hi_p), ("low", lo_p)):
                if ps:
                    num[f"pivot_{name}"][i], num[f"pivot_{name}_age"][i] = ps[-1][0], t - ps[-1][1]
            if hi_p and lo_p and hi_p[-1][0] > lo_p[-1][0]:
                top, bot = hi_p[-1][0], lo_p[-1][0]
                num["range_pos"][i] = min(max((c - bot) / (top - bot), 0.0), 1.0)
                if sg > 0:
                    num["range_sigma"][i] = math.log(top / bot) / sg
            votes = [1.0 if ps[1][0] > ps[0][0] else -1.0 for ps in (hi_p, lo_p) if len(ps) == 2]
            if votes:
                num["structure_bias"][i] = sum(votes) / len(votes)
        cols_out = {**num, "pivot_kind": kinds, "pivot_index": pd.array(at, dtype="Int64")}
        return {"up": up, "cand": cand, **last}, cols_out

    return step


def sweeps(max_bars: int = 6, min_pen: float = 0.25, heavy: float = 0.75, absorbed: float = 0.6):
    """A heavy bar pierces a confirmed level, gives back, and is reclaimed within ``max_bars``."""

    def step(state, rows: pd.DataFrame):
        open_ = [list(p) for p in (state or {"open": []})["open"]]
        size = len(rows)
        low_hit, high_hit = np.zeros(size), np.zeros(size)
        level, pen_out, at = np.full(size, NAN), np.full(size, NAN), [None] * size
        names = ("high", "low", "close", "clv", "sigma_bp", "pivot_high", "pivot_low", "participation_rank", "absorption_rank")
        cols = (rows[c].to_numpy(dtype=float).tolist() for c in names)
        for i, (t, h, lo, c, clv, sg, ph, pl, part, absorb) in enumerate(zip(rows["bar_index"].tolist(), *cols)):
            live = [p for p in open_ if t - p[2] <= max_bars]
            back = [p for p in live if (c - p[1]) * p[0] > 0]
            open_ = [p for p in live if not (c - p[1]) * p[0] > 0]
            if back:
                side, level[i], at[i], pen_out[i] = back[0]
                (low_hit if side > 0 else high_hit)[i] = 1.0
            if sg > 0 and part >= heavy:
                for side, lv, pierced in ((1, pl, lo < pl), (-1, ph, h > ph)):
                    if pierced and min(lo if side > 0 else h, lv) > 0:
                        pen = (math.log(lv / lo) if side > 0 else math.log(h / lv)) / sg
                        if pen >= min_pen and (clv * side > 0 or absorb >= absorbed):
                            open_.append([side, lv, t, pen])
        return {"open": open_}, {
            "swept_low": low_hit, "swept_high": high_hit, "sweep_level": level,
            "penetration_index": pd.array(at, dtype="Int64"), "penetration_sigma": pen_out,
        }

    return step


def run_asymmetry(keep: int = 40, need: int = 5):
    """(u - d)/(u + d) of the mean lengths of the last completed up and down runs."""

    def step(state, rows: pd.DataFrame):
        s = state or {"u": [], "d": [], "run": 0}
        u, d, run = list(s["u"]), list(s["d"]), s["run"]
        asym, cur = np.full(len(rows), NAN), np.zeros(len(rows), dtype=np.int64)
        for i, r in enumerate(rows["ret"].to_numpy(dtype=float).tolist()):
            if r == r and r != 0:
                way = 1 if r > 0 else -1
                if run * way >= 0 and run:
                    run += way
                else:
                    if run:
                        done = u if run > 0 else d
                        done.append(abs(run))
                        del done[:-keep]
                    run = way
            if len(u) >= need and len(d) >= need:
                a, b = sum(u) / len(u), sum(d) / len(d)
                asym[i] = (a - b) / (a + b)
            cur[i] = run
        return {"u": u, "d": d, "run": run}, {"run_asym": asym, "current_run": cur}

    return step


# Expected level of each input per regime (trending, reverting,
# stress, quiet); None means the input says nothing about the regime.
REGIME_INPUTS = (
    "vol_rank", "vr_rank", "ladr_rank", "absorption_rank", "participation_rank", "perm_entropy", "jump_share", "efficiency",
)
REGIME_DESIGN = (
    (None, 0.8, 0.8, 0.2, None, 0.35, None, 0.8),
    (None, 0.2, 0.35, 0.8, None, 0.65, 0.35, 0.2),
    (0.85, None, 0.7, 0.3, 0.8, None, 0.8, None),
    (0.15, None, 0.3, None, 0.2, 0.7, 0.2, 0.3),
)


def beta_terms(concentration: float = 6.0) -> list[list[tuple[float, float, float]]]:
    """(a-1, b-1, log normaliser) per regime and input."""
    out = []
    for row in REGIME_DESIGN:
        cells = []
        for m in row:
            a, b = (1.0, 1.0) if m is None else (m * concentration, (1.0 - m) * concentration)
            cells.append((a - 1.0, b - 1.0, math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
        out.append(cells)
    return out


def log_likelihood(x: np.ndarray) -> np.ndarray:
    """Sum of Beta log densities of the present inputs: rows x 4."""
    v = np.clip(x, 1e-6, 1.0 - 1e-6)
    t = np.array(beta_terms())
    dens = np.log(v)[:, None, :] * t[..., 0] + np.log1p(-v)[:, None, :] * t[..., 1] - t[..., 2]
    return np.nansum(dens, axis=2)


def ew_breadth(x: np.ndarray, full: np.ndarray, state, halflife: float, ridge: float):
    """Effective number of independent inputs per row from their running correlation.

    Returns (state, breadth, seen); breadth of a row includes the row.
    """
    m = x.shape[1]
    lam = 2.0 ** (-1.0 / halflife)
    mean, cov = np.array(state["mean"]), np.array(state["cov"])
    w, n = state["w"], state["n"]
    covs, seen = np.empty((len(x), m, m)), np.empty(len(x), dtype=int)
    for i in range(len(x)):
        if full[i]:
            w = lam * w + 1.0
            gap = x[i] - mean
            mean = mean + gap / w
            cov = (1.0 - 1.0 / w) * (cov + np.outer(gap, gap) / w)
            n = min(n + 1, 61)
        covs[i], seen[i] = cov, n
    dev = np.sqrt(np.clip(np.einsum("nii->ni", covs), 1e-300, None))
    corr = np.clip(covs / (dev[:, :, None] * dev[:, None, :]), -0.999, 0.999) * (1.0 - ridge)
    corr[:, range(m), range(m)] = 1.0
    breadth = np.linalg.solve(corr, np.ones((len(x), m, 1))).sum(axis=(1, 2)) if len(x) else np.empty(0)
    return {"mean": mean.tolist(), "cov": cov.tolist(), "w": w, "n": n}, breadth, seen


def regime(stay: float = 0.985, halflife: float = 20.0, temper: bool = True, inputs=REGIME_INPUTS):
    """Forward filter over four regimes with tempered Beta evidence."""
    k = len(inputs)
    off = (1.0 - stay) / 3.0
    lam = 2.0 ** (-1.0 / halflife)

    def step(state, rows: pd.DataFrame):
        s = state or {
            "p": [0.25] * 4, "num": [0.0] * 4, "den": 0.0,
            "corr": {"mean": [0.0] * k, "cov": np.eye(k).tolist(), "w": 0.0, "n": 0},
        }
        x = rows[list(inputs)].to_numpy(dtype=float)
        have = np.isfinite(x)
        x = np.where(have, x, NAN)
        corr, eta = s["corr"], np.ones(len(rows))
        if temper:
            corr, breadth, seen = ew_breadth(x, have.all(axis=1), corr, 250.0, 0.15)
            eta = np.where(seen > 60, np.clip(breadth / k, 0.15, 1.0), 1.0)
        ll = eta[:, None] * log_likelihood(x)
        like = np.exp(ll - ll.max(axis=1, keepdims=True))
        use = have.sum(axis=1) >= 4
        p, num, den = np.array(s["p"]), np.array(s["num"]), s["den"]
        post, drift = np.full((len(rows), 4), 0.25), np.zeros(len(rows))
        for i in np.flatnonzero(use):
            # sticky transition: every other regime is equally likely
            p = like[i] * (off * p.sum() + (stay - off) * p)
            p = p / p.sum()
            num, den = lam * num + p, lam * den + 1.0
            ref = num / den
            post[i], drift[i] = p, 0.5 * np.abs(p - ref / ref.sum()).sum()
        amb = np.where(use, 1.0 - post.max(axis=1), 0.75)
        cols = {f"p{j}": post[:, j] for j in range(4)}
        cols |= {
            "dominant": np.where(use, post.argmax(axis=1), 3), "drift": drift, "ambiguity": amb,
            "hazard": np.where(use, np.maximum(drift, amb), 1.0), "temper": np.where(use, eta, 1.0),
            "regime_valid": use,
        }
        return {"p": p.tolist(), "num": num.tolist(), "den": den, "corr": corr}, cols

    return step
