"""Numeric kernels for one series at a time, from published methods: ADF, KPSS, ACF, PACF, STL, Box-Cox, periodogram.

They see one bounded series as a numpy array inside an Arrow-backed group; everything relational stays in DataFrames."""

from __future__ import annotations

import math

import numpy as np

Z975 = 1.959963984540054


def pearson_at_lag(y: np.ndarray, k: int) -> float | None:
    """Pearson correlation of y with itself k places on; None where one side is constant or too short."""
    if len(y) - k < 3:
        return None
    a, b = y[:-k] - y[:-k].mean(), y[k:] - y[k:].mean()
    bottom = math.sqrt(float((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / bottom) if bottom > 0 else None


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def adf_p(tau: float) -> float:
    """MacKinnon's approximate p-value of a unit-root statistic with a constant. His published coefficients."""
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    if tau <= -1.61:
        return normal_cdf(2.1659 + 1.4412 * tau + 0.038269 * tau**2)
    return normal_cdf(1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3)


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, float(rest @ rest), np.linalg.pinv(x.T @ x)


def _adf_design(y: np.ndarray, lags: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    dy, n = np.diff(y), len(y) - 1
    at = np.arange(n - rows, n)
    columns = [np.ones(rows), y[at]] + [dy[at - i] for i in range(1, lags + 1)]
    return np.column_stack(columns), dy[at]


def adf(y: np.ndarray) -> float | None:
    """p-value of the augmented Dickey-Fuller test with a constant; lags by AIC on the common sample."""
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or not np.isfinite(y).all() or np.ptp(y) == 0:
        return None
    rows = n - 1 - most
    best = (math.inf, 0)
    for lags in range(most + 1):
        x, dy = _adf_design(y, lags, rows)
        if rows <= x.shape[1]:
            continue
        _, ssr, _ = _least_squares(x, dy)
        if ssr <= 0:
            return None
        loglike = -rows / 2 * (math.log(2 * math.pi) + math.log(ssr / rows) + 1)
        best = min(best, (-2 * loglike + 2 * x.shape[1], lags))
    lags = best[1]
    x, dy = _adf_design(y, lags, n - 1 - lags)
    if len(dy) <= x.shape[1]:
        return None
    beta, ssr, inverse = _least_squares(x, dy)
    error = math.sqrt(ssr / (len(dy) - x.shape[1]) * float(inverse[1, 1]))
    return adf_p(float(beta[1]) / error) if error > 0 else None


def kpss(y: np.ndarray) -> float | None:
    """p-value of the KPSS test of level stationarity, held to 0.01..0.10; Hobijn's automatic lags."""
    n = len(y)
    if n < 3 or not np.isfinite(y).all():
        return None
    e = y - y.mean()
    eta = float((np.cumsum(e) ** 2).sum()) / n**2
    covlags = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, covlags + 1):
        c = 2 * float(e[i:] @ e[: n - i]) / n
        s0 += c
        s1 += i * c
    if s0 <= 0:
        return None
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = float(e @ e) / n + sum(2 * (1 - i / (lags + 1)) * float(e[i:] @ e[: n - i]) / n for i in range(1, lags + 1))
    if variance <= 0:
        return None
    # The published critical values and their levels.
    return float(np.interp(eta / variance, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    e = y - y.mean()
    g0 = float(e @ e)
    return np.array([float(e[k:] @ e[: len(e) - k]) / g0 if g0 > 0 else np.nan for k in range(lags + 1)])


def acf_error(r: np.ndarray, n: int) -> np.ndarray:
    """Bartlett's standard errors by lag."""
    out = np.zeros(len(r))
    if len(r) > 1:
        out[1:] = np.sqrt((1 + 2 * np.concatenate([[0], np.cumsum(r[1:-1] ** 2)])) / n)
    return out


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by Levinson-Durbin on the autocovariances adjusted for the overlap."""
    n = len(y)
    lags = min(lags, n - 2)
    e = y - y.mean()
    g = np.array([float(e[k:] @ e[: n - k]) / (n - k) for k in range(lags + 1)])
    out, phi, v = [1.0], np.zeros(0), g[0]
    for k in range(1, lags + 1):
        if v == 0:
            out.append(np.nan)
            continue
        a = (g[k] - phi @ g[k - 1 : 0 : -1]) / v if k > 1 else g[1] / v
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(float(a))
    return np.array(out)


def periodogram(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density at frequencies k/n for k from 1, the mean removed."""
    n = len(y)
    power = np.abs(np.fft.rfft(y - y.mean())) ** 2 / n
    if n % 2:
        power[1:] *= 2
    else:
        power[1:-1] *= 2
    return np.arange(1, len(power)) / n, power[1:]


def peaks(power: np.ndarray) -> np.ndarray:
    """Places of strict inner maxima; of a flat top its middle."""
    out, i, n = [], 1, len(power)
    while i < n - 1:
        if power[i - 1] < power[i]:
            j = i
            while j + 1 < n and power[j + 1] == power[i]:
                j += 1
            if j + 1 < n and power[j + 1] < power[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return np.array(out, int)


def period_candidates(y: np.ndarray, top_k: int = 5) -> list[tuple[int, float, float | None, float]]:
    """(m, power, correlation at lag m, verified score), strongest first; nothing for under 16 values."""
    n = len(y)
    if n < 16:
        return []
    freq, power = periodogram(y)
    best: dict[int, float] = {}
    for k in peaks(power):
        m = round(1 / float(freq[k]))
        if 2 <= m <= n // 2:
            best[m] = max(best.get(m, -math.inf), float(power[k]))
    ranked = sorted(best.items(), key=lambda x: -x[1])
    out = []
    for m, p in ranked[:top_k]:
        r = pearson_at_lag(y, m)
        out.append((m, p, r, max(0.0, r or 0.0)))
    return out


def boxcox_llf(x: np.ndarray, lam: float) -> float:
    logs = np.log(x)
    z = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
    v = float(z.var())
    return (lam - 1) * float(logs.sum()) - len(x) / 2 * math.log(v) if v > 0 else -math.inf


def boxcox_mle(y: np.ndarray, offset: float) -> tuple[float, float] | tuple[None, None]:
    """lambda of greatest likelihood and that likelihood; None for under 20 values, values not above zero or constant ones."""
    x = y + offset
    if len(x) < 20 or not (x > 0).all() or np.ptp(x) == 0:
        return None, None
    grid = np.linspace(-5, 5, 101)
    k = int(np.argmax([boxcox_llf(x, v) for v in grid]))
    a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = boxcox_llf(x, c), boxcox_llf(x, d)
    while b - a > 1e-9:
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = boxcox_llf(x, c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = boxcox_llf(x, d)
    lam = (a + b) / 2
    return float(lam), boxcox_llf(x, lam)


def loess(y: np.ndarray, q: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Locally linear tricube fits of y (at 0..n-1) at the places `at`, from the q nearest values."""
    n = len(y)
    span = min(q, n)
    first = np.clip(np.floor(at - (span - 1) / 2 + 0.5).astype(int), 0, n - span)
    index = first[:, None] + np.arange(span)
    x = index - at[:, None]
    # With fewer values than q the reach grows by the half that is lacking.
    reach = np.maximum(np.abs(x).max(1), 1e-12) + (max(0, q - n) // 2)
    u = np.abs(x) / reach[:, None]
    w = np.where(u < 0.999, np.where(u > 0.001, (1 - u**3) ** 3, 1.0), 0.0)
    if weights is not None:
        w = w * weights[index]
    total = w.sum(1, keepdims=True)
    fine = total[:, 0] > 0
    w = w / np.where(total > 0, total, 1)
    centre = (w * x).sum(1)
    spread = (w * x * x).sum(1) - centre**2
    slope = np.where(np.sqrt(np.maximum(spread, 0)) > 0.001 * max(n - 1, 1), -centre / np.where(spread > 0, spread, 1), 0.0)
    w = w * (1 + slope[:, None] * (x - centre[:, None]))
    out = (w * y[index]).sum(1)
    return np.where(fine, out, y[np.clip(np.round(at).astype(int), 0, n - 1)])


def _moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return (total[size:] - total[:-size]) / size


def stl(y: np.ndarray, period: int, robust: bool = True, seasonal: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and rest by Cleveland's decomposition: trend + season + rest = y."""
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError("a decomposition needs two periods of two places or more")
    wide = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    wide += 1 - wide % 2
    low = period + 1 + period % 2
    inner, outer = (2, 15) if robust else (5, 0)
    trend, season, weights = np.zeros(n), np.zeros(n), None
    places = np.arange(n, dtype=float)
    for turn in range(outer + 1):
        for _ in range(inner):
            flat = y - trend
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                part = flat[p::period]
                own = None if weights is None else weights[p::period]
                cycle[p::period][: len(part) + 2] = loess(part, seasonal, np.arange(-1.0, len(part) + 1), own)
            smooth = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(smooth, low, places)
            trend = loess(y - season, wide, places, weights)
        if turn < outer:
            rest = np.abs(y - trend - season)
            h = 6 * float(np.median(rest))
            u = rest / h if h > 0 else np.zeros(n)
            weights = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return trend, season, y - trend - season
