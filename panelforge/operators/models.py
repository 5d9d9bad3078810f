"""Time-series models in numpy, for use in grouped Pandas functions: ADF test, ARIMA, trend with seasons.

References: Said and Dickey 1984; MacKinnon 1994 and 2010; Hyndman and Khandakar 2008; Kwiatkowski et al.
1992; Taylor and Letham 2018.  Orders and likelihoods need not equal those of any library.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

#: Fixed values, from MacKinnon's papers: the response surface of the critical values with a constant (2010) and the
#: polynomials of the p-value with their bounds (1994, one variable, with a constant).
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(statistic: float) -> float:
    if statistic > ADF_MAX:
        return 1.0
    if statistic < ADF_MIN:
        return 0.0
    poly = ADF_SMALL if statistic <= ADF_STAR else ADF_LARGE
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(poly)))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares, inverse of x'x."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    r = y - x @ beta
    return beta, float(r @ r), inverse


def adf(values: np.ndarray) -> dict | None:
    """The augmented Dickey-Fuller test with a constant; the number of lags has the least AIC on a common sample."""
    x = np.asarray(values, float)
    n = len(x)
    if n < 20 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return None
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    diff = np.diff(x)

    def regress(lags: int, drop: int):
        y = diff[drop:]
        cols = [x[drop:-1]] + [diff[drop - k : len(diff) - k] for k in range(1, lags + 1)] + [np.ones(len(y))]
        return (*_ols(np.stack(cols, 1), y), len(y), len(cols))

    best = None
    for lags in range(most + 1):
        _, rss, _, m, k = regress(lags, most)
        aic = m * math.log(max(rss, 1e-300) / m) + 2 * k
        if best is None or aic < best[0]:
            best = (aic, lags)
    beta, rss, inverse, m, k = regress(best[1], best[1])
    se = math.sqrt(max(rss / (m - k) * inverse[0, 0], 0))
    if se == 0:
        return None
    t = float(beta[0] / se)
    crit = {c: sum(b / m**j for j, b in enumerate(poly)) for c, poly in ADF_CRITICAL.items()}
    return {"statistic": t, "p_value": adf_p_value(t), "lags": best[1], "critical": crit}


def kpss_level(x: np.ndarray) -> float:
    """The KPSS statistic for a constant level; 0.463 is its critical value at 5 percent."""
    n = len(x)
    e = x - x.mean()
    lags = int(4 * (n / 100) ** 0.25)
    variance = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / n**2 / variance) if variance > 0 else 0.0


def _simplex(f, start: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Nelder and Mead's search."""
    n = len(start)
    points = [start, *(start + 0.1 * np.eye(n)[k] for k in range(n))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < 1e-8 * (abs(values[0]) + 1e-8):
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = 2 * centre - points[-1]
        fr = f(reflected)
        if fr < values[0]:
            far = 3 * centre - 2 * points[-1]
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            near = (centre + (reflected if fr < values[-1] else points[-1])) / 2
            fn = f(near)
            if fn < min(fr, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points = [points[0], *((p + points[0]) / 2 for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    k = int(np.argmin(values))
    return points[k], values[k]


def _stable(raw: np.ndarray) -> np.ndarray:
    """Any numbers to the coefficients of a stationary polynomial, through partial autocorrelations."""
    phi = np.zeros(0)
    for r in np.tanh(raw):
        phi = np.append(phi - r * phi[::-1], r)
    return phi


def _errors(y: np.ndarray, mean: float, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One-step errors, given zeros before the start."""
    z = y - mean
    p, q = len(phi), len(theta)
    base = z.copy()
    for k in range(p):
        base[k + 1 :] -= phi[k] * z[: len(z) - k - 1]
    if not q:
        return base
    e = np.zeros(len(z) + q)
    rev = theta[::-1]
    for t in range(len(z)):
        e[t + q] = base[t] - rev @ e[t : t + q]
    return e[q:]


def _fit(y: np.ndarray, p: int, q: int, constant: bool) -> dict:
    start = np.concatenate([[y.mean()] if constant else [], np.zeros(p + q)])
    scale = y.std() or 1.0

    def unpack(v: np.ndarray):
        c = int(constant)
        return (v[0] if c else 0.0), _stable(v[c : c + p]), -_stable(v[c + p :])

    def cost(v: np.ndarray) -> float:
        e = _errors(y, *unpack(v)) / scale
        s = float(e[p:] @ e[p:])
        return math.log(s) if math.isfinite(s) and s > 0 else (1e9 if not math.isfinite(s) else -700.0)

    v = _simplex(cost, start)[0] if len(start) else start
    mean, phi, theta = unpack(v)
    e = _errors(y, mean, phi, theta)
    m = len(y) - p
    variance = max(float(e[p:] @ e[p:]) / m, 1e-300)
    return {"mean": mean, "phi": phi, "theta": theta, "errors": e, "variance": variance, "aic": len(y) * (math.log(2 * math.pi * variance) + 1) + 2 * (p + q + int(constant) + 1)}


def arima(values: np.ndarray, horizon: int, level: float, max_p: int = 5, max_q: int = 5, max_d: int = 2) -> dict:
    """Differences by KPSS, orders by a stepwise search for the least AIC, conditional sums of squares."""
    x = np.asarray(values, float)
    if len(x) < 10 or not np.isfinite(x).all():
        return {"converged": False}
    d, y = 0, x
    while d < max_d and np.ptp(y) > 0 and kpss_level(y) > 0.463:
        y, d = np.diff(y), d + 1
    constant = d < 2
    if np.ptp(y) == 0:
        best, order = {"mean": float(y[0]) if constant else 0.0, "phi": np.zeros(0), "theta": np.zeros(0), "errors": np.zeros(len(y)), "variance": 0.0, "aic": -math.inf}, (0, 0)
    else:
        seen: dict[tuple[int, int], dict] = {}

        def get(p: int, q: int) -> dict | None:
            if not (0 <= p <= max_p and 0 <= q <= max_q) or p + q + 5 > len(y):
                return None
            if (p, q) not in seen:
                seen[p, q] = _fit(y, p, q, constant)
            return seen[p, q]

        for p, q in ((0, 0), (1, 0), (0, 1), (2, 2)):
            get(p, q)
        while True:
            order = min(seen, key=lambda k: seen[k]["aic"])
            p, q = order
            for a, b in ((p - 1, q), (p + 1, q), (p, q - 1), (p, q + 1), (p - 1, q - 1), (p + 1, q + 1)):
                get(a, b)
            if min(seen, key=lambda k: seen[k]["aic"]) == order:
                break
        best = seen[order]
    phi, theta, p, q = best["phi"], best["theta"], len(best["phi"]), len(best["theta"])
    z, e = list(y - best["mean"]), list(best["errors"])
    for _ in range(horizon):
        z.append(sum(phi[k] * z[-1 - k] for k in range(p)) + sum(theta[k] * e[-1 - k] for k in range(q)))
        e.append(0.0)
    path = np.array(z[len(y) :]) + best["mean"]
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = 1.0 if j == 0 else (theta[j - 1] if j <= q else 0.0) + sum(phi[k] * psi[j - 1 - k] for k in range(min(p, j)))
    tails = [x]
    for _ in range(d):
        tails.append(np.diff(tails[-1]))
    for k in range(d - 1, -1, -1):
        path = tails[k][-1] + np.cumsum(path)
        psi = np.cumsum(psi)
    half = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(best["variance"] * np.cumsum(psi**2))
    if not np.isfinite(path).all() or not np.isfinite(half).all():
        return {"converged": False}
    return {"converged": True, "order": (order[0], d, order[1]), "aic": best["aic"], "forecast": path, "lower": path - half, "upper": path + half}


def trend_seasonal(values: np.ndarray, days: np.ndarray, future: np.ndarray, level: float, yearly: bool = True, weekly: bool = True, knots: int = 25, prior: float = 0.05, seed: int = 42) -> dict:
    """A piecewise linear trend with Fourier seasons, ridge-penalised; the trend's future bends widen the interval.

    days, future: day numbers.  An approximation of the additive model of Taylor and Letham.
    """
    y, t = np.asarray(values, float), np.asarray(days, float)
    if len(y) < 2 or not np.isfinite(y).all() or t[-1] <= t[0]:
        return {"converged": False}
    first, span = t[0], t[-1] - t[0]
    scale = np.abs(y).max() or 1.0
    where = np.linspace(0, 0.8, min(knots, len(y) - 1) + 1)[1:]

    def seasons(at: np.ndarray, period: float, order: int) -> np.ndarray:
        a = 2 * np.pi * np.outer(at, np.arange(1, order + 1)) / period
        return np.concatenate([np.sin(a), np.cos(a)], 1)

    def design(at: np.ndarray) -> tuple[np.ndarray, list[int]]:
        u = (at - first) / span
        parts = [np.ones((len(at), 1)), u[:, None], np.maximum(u[:, None] - where, 0)]
        if yearly:
            parts.append(seasons(at, 365.25, 10))
        if weekly:
            parts.append(seasons(at, 7, 3))
        return np.concatenate(parts, 1), [p.shape[1] for p in parts]

    x, sizes = design(t)
    noise = 0.05
    for _ in range(3):  # the noise sets the weight of the priors
        weight = np.concatenate([[1e-8, 1 / 25], np.full(sizes[2], 1 / prior**2 / 4), np.full(sum(sizes[3:]), 1 / 100)]) * noise**2
        beta = np.linalg.solve(x.T @ x + np.diag(weight), x.T @ (y / scale))
        noise = max(float(np.std(y / scale - x @ beta)), 1e-9)
    ahead, _ = design(np.asarray(future, float))
    cut = np.cumsum(sizes)
    trend = ahead[:, : cut[2]] @ beta[: cut[2]]
    yearly_part = ahead[:, cut[2] : cut[3]] @ beta[cut[2] : cut[3]] if yearly else None
    weekly_part = ahead[:, cut[-2] :] @ beta[cut[-2] :] if weekly else None
    rng = np.random.default_rng(seed)
    u = (np.asarray(future, float) - first) / span
    bend = float(np.abs(beta[2 : cut[2]]).mean()) if sizes[2] else 0.0
    draws = np.zeros((500, len(u)))
    for k in range(500):
        at = 1 + rng.random(rng.poisson(len(where) * max(u[-1] - 1, 0))) * max(u[-1] - 1, 0)
        draws[k] = (np.maximum(u[:, None] - at, 0) * rng.laplace(0, bend + 1e-12, len(at))).sum(1) + rng.normal(0, noise, len(u))
    point = ahead @ beta
    lower, upper = np.quantile(draws, [0.5 - level / 2, 0.5 + level / 2], axis=0)
    out = {"converged": True, "forecast": point * scale, "lower": (point + np.minimum(lower, 0)) * scale, "upper": (point + np.maximum(upper, 0)) * scale, "trend": trend * scale}
    return out | {"yearly": None if yearly_part is None else yearly_part * scale, "weekly": None if weekly_part is None else weekly_part * scale}
