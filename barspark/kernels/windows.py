"""Trailing order statistics of one block, vectorised over its rows.

Each function takes a float array with NaN for missing and looks at the last
``w`` *non-missing* values up to each position; missing positions give NaN.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _windows(v: np.ndarray, w: int) -> np.ndarray:
    return sliding_window_view(np.concatenate([np.full(w - 1, np.nan), v]), w)


def _on_values(x: np.ndarray, fn) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    out = np.full(x.size, np.nan)
    at = np.flatnonzero(~np.isnan(x))
    if at.size:
        out[at] = fn(x[at])
    return out


def _counts(n: int, w: int) -> np.ndarray:
    return np.minimum(np.arange(1, n + 1), w)


def _quantile_sorted(s: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    pos = q * (n - 1)
    lo = np.floor(pos).astype(int)
    hi = np.minimum(lo + 1, n - 1)
    r = np.arange(len(n))
    f = pos - lo
    return s[r, lo] * (1.0 - f) + s[r, hi] * f


def rank(x, w: int, min_obs: int) -> np.ndarray:
    """Mid-rank of the current value among the last ``w``, itself included."""

    def fn(v):
        win, cur, n = _windows(v, w), v[:, None], _counts(v.size, w)
        r = ((win < cur).sum(1) + 0.5 * (win == cur).sum(1)) / n
        return np.where(n >= min_obs, r, np.nan)

    return _on_values(x, fn)


def quantile(x, w: int, q: float, min_obs: int = 1) -> np.ndarray:
    def fn(v):
        n = _counts(v.size, w)
        return np.where(n >= min_obs, _quantile_sorted(np.sort(_windows(v, w), axis=1), n, q), np.nan)

    return _on_values(x, fn)


def mad(x, w: int) -> np.ndarray:
    """1.4826 times the median absolute deviation."""

    def fn(v):
        win, n = _windows(v, w), _counts(v.size, w)
        med = _quantile_sorted(np.sort(win, axis=1), n, 0.5)
        return 1.4826 * _quantile_sorted(np.sort(np.abs(win - med[:, None]), axis=1), n, 0.5)

    return _on_values(x, fn)


def robust_z(x, w: int, min_obs: int = 10) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    med, scale = quantile(x, w, 0.5), mad(x, w)
    seen = np.minimum(np.cumsum(~np.isnan(x)), w)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(scale <= 1e-300, 0.0, (x - med) / scale)
    return np.where((seen >= min_obs) & ~np.isnan(x), z, np.nan)


def hold(x: np.ndarray) -> np.ndarray:
    """Last non-missing value so far."""
    at = np.where(np.isnan(x), -1, np.arange(x.size))
    at = np.maximum.accumulate(at) if x.size else at
    return np.where(at >= 0, x[np.maximum(at, 0)], np.nan)


def variance_ratio(ret, w: int = 120, lags=(2, 4, 8, 16)) -> tuple[np.ndarray, np.ndarray]:
    """Mean heteroskedasticity-robust z and implied Hurst exponent over ``lags``.

    A window of constant returns keeps the reading before it.
    """
    ret = np.asarray(ret, dtype=float)
    z_out, h_out = np.full(ret.size, np.nan), np.full(ret.size, np.nan)
    at = np.flatnonzero(~np.isnan(ret))
    if at.size:
        z, h = _vr(_windows(ret[at], w), _counts(at.size, w), lags)
        early = np.arange(at.size) < max(3 * max(lags), 40) - 1
        z[early], h[early] = np.nan, np.nan
        z_out[at], h_out[at] = z, h
    return hold(z_out), hold(h_out)


def _vr(win: np.ndarray, n: np.ndarray, lags) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``win`` are right-aligned windows with ``n`` values, NaN before them."""
    have = ~np.isnan(win)
    x = np.where(have, win, 0.0)
    d = np.where(have, x - (x.sum(1) / n)[:, None], 0.0)
    d2 = d * d
    ss = d2.sum(1)
    zs, hs = [], []
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = [None] + [np.einsum("ij,ij->i", d2[:, j:], d2[:, :-j]) / ss**2 for j in range(1, max(lags))]
        cs = np.concatenate([np.zeros((len(win), 1)), np.cumsum(d, axis=1)], axis=1)
        for q in lags:
            # sums of q demeaned returns, only where all q are inside the window
            sums = np.where(have[:, : win.shape[1] - q + 1], cs[:, q:] - cs[:, :-q], 0.0)
            ratio = np.einsum("ij,ij->i", sums, sums) / (q * (n - q + 1) * (1 - q / n)) / (ss / (n - 1))
            theta = sum((2 * (q - j) / q) ** 2 * delta[j] for j in range(1, q))
            zs.append(np.where(theta > 0, (ratio - 1) / np.sqrt(theta), np.nan))
            hs.append(np.where(ratio > 0, 0.5 + np.log(ratio) / (2 * np.log(q)), np.nan))
    return _mean_present(zs), _mean_present(hs)


def _mean_present(parts) -> np.ndarray:
    a = np.array(parts)
    k = (~np.isnan(a)).sum(0)
    return np.where(k > 0, np.nansum(a, axis=0) / np.maximum(k, 1), np.nan)


def std(x, w: int, min_obs: int) -> np.ndarray:
    """Sample standard deviation of the last ``w`` values."""

    def fn(v):
        win, n = _windows(v, w), _counts(v.size, w)
        have = ~np.isnan(win)
        t = np.where(have, win, 0.0)
        d = np.where(have, t - (t.sum(1) / n)[:, None], 0.0)
        s = np.sqrt(np.einsum("ij,ij->i", d, d) / np.maximum(n - 1, 1))
        return np.where(n >= min_obs, s, np.nan)

    return _on_values(x, fn)


def kurtosis(x, w: int, min_obs: int) -> np.ndarray:
    """Excess kurtosis of the last ``w`` values; 0 for a constant window."""

    def fn(v):
        win, n = _windows(v, w), _counts(v.size, w)
        have = ~np.isnan(win)
        t = np.where(have, win, 0.0)
        d2 = np.where(have, t - (t.sum(1) / n)[:, None], 0.0) ** 2
        m2 = d2.sum(1) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            k = np.where(m2 > 1e-300, np.einsum("ij,ij->i", d2, d2) / n / (m2 * m2) - 3.0, 0.0)
        return np.where(n >= min_obs, k, np.nan)

    return _on_values(x, fn)
