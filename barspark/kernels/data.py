"""Per-block step functions for bar cleaning and the activity clock."""

from __future__ import annotations

import math

import pandas as pd

# Close ratios taken as share splits, as (numerator, denominator).
SPLIT_RATIOS = (
    (1, 2), (1, 3), (1, 4), (1, 5), (1, 10), (1, 20), (2, 1), (3, 1), (4, 1), (5, 1), (10, 1), (20, 1), (2, 3), (3, 2),
)


def validate(max_abs_return: float = 0.75, split_tol: float = 0.02, gap_multiple: float = 20.0):
    """Issues of each bar against the last *accepted* bar."""

    def kernel(state, rows: pd.DataFrame):
        s = state or {"ts": None, "close": None, "dt": None}
        last_ts, last_close, dt_run = s["ts"], s["close"], s["dt"]
        out_issues, out_fatal = [], []
        cols = (rows[c].to_numpy() for c in ("partial", "open", "high", "low", "close", "volume", "sec"))
        for partial, o, h, lo, c, v, sec in zip(*cols):
            issues, fatal = [], None
            if partial:
                fatal = "partial_bar"
            elif not all(map(math.isfinite, (o, h, lo, c, v))):
                fatal = "non_finite"
            elif last_ts is not None:
                gap = float(sec - last_ts)
                if gap <= 0:
                    fatal = "time_reversal" if gap < 0 else "duplicate_timestamp"
                else:
                    if dt_run is not None and gap > gap_multiple * dt_run:
                        issues.append("large_time_gap")
                    dt_run = gap if dt_run is None else (dt_run + gap) / 2
                    if last_close > 0 and (c <= 0 or abs(math.log(c / last_close)) > max_abs_return):
                        near = any(abs(c / last_close * d / n - 1) < split_tol for n, d in SPLIT_RATIOS)
                        fatal = "probable_split" if near else "extreme_return"
            if fatal is None:
                issues += [k for k, hit in (("zero_volume", v <= 0), ("zero_range", h == lo)) if hit]
                last_ts, last_close = float(sec), float(c)
            else:
                issues.append(fatal)
            out_issues.append(issues)
            out_fatal.append(fatal is not None)
        out = rows[["instrument", "bar_index"]].assign(issues=out_issues, fatal=out_fatal)
        return {"ts": last_ts, "close": last_close, "dt": dt_run}, out

    return kernel


def activity_clock(k: float = 1.0, halflife: float = 500.0, warm: int = 50, min_input: int = 1):
    """Group id of each bar on an activity clock (``act`` = its activity).

    A group closes when its accumulated activity reaches ``k`` times the
    bias-corrected running mean; the first ``warm - 1`` bars pass through alone.
    """
    lam = math.exp(-math.log(2.0) / halflife)

    def kernel(state, rows: pd.DataFrame):
        s = state or {"num": 0.0, "den": 0.0, "seen": 0, "acc": 0.0, "n": 0, "first": -1}
        num, den, seen, acc, n, first = (s[k_] for k_ in ("num", "den", "seen", "acc", "n", "first"))
        group, closes = [], []
        for i, act in zip(rows["bar_index"].tolist(), rows["act"].tolist()):
            num, den, seen = lam * num + act, lam * den + 1.0, seen + 1
            if n == 0:
                acc, first = 0.0, i
            acc, n = acc + act, n + 1
            mean = num / den
            done = seen < warm or (mean > 0 and acc >= k * mean and n >= min_input)
            group.append(first)
            closes.append(done)
            if done:
                n, acc = 0, 0.0
        out = rows[["instrument", "bar_index"]].assign(first_index=group, closes=closes)
        # ``seen`` only matters up to ``warm``: keep it there so block states settle
        return {"num": num, "den": den, "seen": min(seen, warm), "acc": acc, "n": n, "first": first}, out

    return kernel
