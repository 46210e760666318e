"""Time-series numerics that run inside tasks: many series of one length are lanes of an array and are worked on together."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Upper 5 % point of the Dickey-Fuller statistic with a constant, and points of its distribution: fixed values.
ADF_POINTS = ((-3.96, 0.0015), (-3.43, 0.01), (-3.12, 0.025), (-2.86, 0.05), (-2.57, 0.10), (-1.57, 0.50), (-0.44, 0.90), (-0.07, 0.95), (0.60, 0.99))
#: Points of the KPSS statistic around a constant: fixed values.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))

#: By whether ADF and KPSS call a series stationary: fixed values.
VERDICTS = {
    (True, True): "Stationary",
    (False, False): "Non-stationary (unit root)",
    (True, False): "Trend-stationary",
    (False, True): "Difference-stationary (possible structural break)",
}


def kendall_s(x: np.ndarray) -> np.ndarray:
    """For each lane the pairs of places whose later value is greater, less those whose later value is less.

    Counted while merging: of each two neighbouring runs of a length, every value of the right one is looked up in the sorted
    left one; n log n lookups a lane in place of n^2 pairs.
    """
    lanes, n = x.shape
    values, rank = np.unique(x, return_inverse=True)
    rank, many = rank.reshape(lanes, n).astype(np.int64), len(values) + 1
    place = np.arange(n)
    out, width = np.zeros(lanes, np.int64), 1
    while width < n:
        pair = place // (2 * width)
        base = (np.arange(lanes)[:, None] * (pair[-1] + 1) + pair) * many
        left = (place // width) % 2 == 0
        known = np.sort((base + rank)[:, left].reshape(-1))
        own, asked = base[:, ~left], (base + rank)[:, ~left]
        less = np.searchsorted(known, asked, "left") - np.searchsorted(known, own, "left")
        more = np.searchsorted(known, own + many, "left") - np.searchsorted(known, asked, "right")
        out += (less - more).sum(axis=1)
        width *= 2
    return out


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each lane: coefficients, the inverse of X'X, and the residual sum of squares. x is lanes x rows x columns, y lanes x rows."""
    inverse = np.linalg.pinv(x.transpose(0, 2, 1) @ x)
    beta = (inverse @ (x.transpose(0, 2, 1) @ y[:, :, None]))[:, :, 0]
    return beta, inverse, ((y - (x @ beta[:, :, None])[:, :, 0]) ** 2).sum(axis=1)


def _flat(x: np.ndarray) -> np.ndarray:
    """Which lanes hold one value only, as far as can be told."""
    return np.isclose(x, x[:, :1]).all(axis=1)


def adf_many(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Augmented Dickey-Fuller with a constant for each lane (series of one length); lags by AIC. Statistics and p, interpolated between known points."""
    lanes, n = x.shape
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    d = np.diff(x, axis=1)
    still, line = _flat(x), _flat(d)
    tau, p = np.where(still, -np.inf, 0.0), np.where(still, 0.0, 1.0)
    on = np.flatnonzero(~line)

    def fit(at: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        y = d[at, skip:]
        columns = [x[at, skip:-1], *(d[at, skip - k : d.shape[1] - k] for k in range(1, lags + 1)), np.ones(y.shape)]
        design = np.stack(columns, axis=2)
        beta, inverse, rss = least_squares(design, y)
        freedom = max(y.shape[1] - design.shape[2], 1)
        se = np.sqrt(np.maximum(rss / freedom * inverse[:, 0, 0], 1e-300))
        return beta[:, 0] / se, y.shape[1] * np.log(np.maximum(rss, 1e-300) / y.shape[1]) + 2 * design.shape[2]

    if len(on):
        lags = np.stack([fit(on, k, most)[1] for k in range(most + 1)]).argmin(axis=0)
        for k in np.unique(lags):
            own = on[lags == k]
            tau[own] = fit(own, int(k), int(k))[0]
        p[on] = np.interp(tau[on], [q[0] for q in ADF_POINTS], [q[1] for q in ADF_POINTS])
    return tau, p


def adf(x: np.ndarray) -> tuple[float, float]:
    tau, p = adf_many(np.asarray(x, float)[None])
    return float(tau[0]), float(p[0])


def kpss_many(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KPSS around a constant for each lane, Bartlett weights, automatic number of lags (Hobijn, Franses and Ooms); nan where there is no variance."""
    lanes, n = x.shape
    e = x - x.mean(axis=1, keepdims=True)
    most = int(n ** (2 / 9))
    gamma = lambda k, at=slice(None): (e[at, k:] * e[at, : n - k]).sum(axis=1) / n
    s0 = gamma(0) + 2 * sum(gamma(k) for k in range(1, most + 1))
    s1 = 2 * sum(k * gamma(k) for k in range(1, most + 1)) + np.zeros(lanes)
    ratio = np.divide(s1, s0, out=np.zeros(lanes), where=s0 != 0)
    lags = np.minimum(n - 1, (1.1447 * (ratio**2) ** (1 / 3) * n ** (1 / 3)).astype(int))
    var = gamma(0)
    for k in range(1, int(lags.max(initial=0)) + 1):
        own = lags >= k
        var[own] += 2 * (1 - k / (lags[own] + 1)) * gamma(k, own)
    stat = np.divide((e.cumsum(axis=1) ** 2).sum(axis=1) / n**2, var, out=np.full(lanes, np.nan), where=var > 0)
    return stat, np.where(np.isnan(stat), np.nan, np.interp(stat, [q[0] for q in KPSS_POINTS], [q[1] for q in KPSS_POINTS]))


def stationarity_many(x: np.ndarray) -> list[dict]:
    """Both tests and the verdict of each lane; under eight values there is none."""
    if x.shape[1] < 8:
        none = dict(adf_statistic=None, adf_p_value=None, adf_stationary=None, kpss_statistic=None, kpss_p_value=None, kpss_stationary=None, verdict="Insufficient data")
        return [none] * len(x)
    clean = lambda v: None if v != v or math.isinf(v) else round(v, 4)
    out = []
    for a, pa, k, pk in zip(*(v.tolist() for v in (*adf_many(x), *kpss_many(x))), strict=True):
        fa, fk = pa < 0.05, pk > 0.05
        out.append(dict(adf_statistic=clean(a), adf_p_value=clean(pa), adf_stationary=fa, kpss_statistic=clean(k), kpss_p_value=clean(pk), kpss_stationary=fk, verdict=VERDICTS[fa, fk]))
    return out


def stationarity(x: np.ndarray) -> dict:
    return stationarity_many(np.asarray(x, float)[None])[0]


def simplex_many(f: Callable[[np.ndarray, np.ndarray], np.ndarray], lanes: int, start: np.ndarray, step: float = 0.3, rounds: int = 200, close: float = 1e-8) -> np.ndarray:
    """The simplex search, with the usual coefficients, of many lanes at once; f gets points and the lanes they are of.

    Each lane takes the steps that it would take alone, and rests once it has settled.
    """
    size = len(start)
    points = np.repeat(np.stack([start, *(start + step * e for e in np.eye(size))])[None], lanes, axis=0).astype(float)
    values = np.stack([f(points[:, k], np.arange(lanes)) for k in range(size + 1)], axis=1)
    on = np.arange(lanes)
    for _ in range(rounds):
        order = np.argsort(values[on], axis=1, kind="stable")
        points[on], values[on] = np.take_along_axis(points[on], order[:, :, None], axis=1), np.take_along_axis(values[on], order, axis=1)
        on = on[~(np.abs(values[on, -1] - values[on, 0]) < close * (np.abs(values[on, 0]) + close))]
        if not len(on):
            break
        p, v = points[on], values[on]
        middle = p[:, :-1].mean(axis=1)
        away = middle + (middle - p[:, -1])
        at = f(away, on)
        far, near = at < v[:, 0], ~(at < v[:, -2])
        new, found = away.copy(), at.copy()
        if far.any():
            out = middle[far] + 2 * (middle[far] - p[far, -1])
            got = f(out, on[far])
            better = got < at[far]
            new[far] = np.where(better[:, None], out, away[far])
            found[far] = np.where(better, got, at[far])
        if near.any():
            toward = np.where((at < v[:, -1])[:, None], away, p[:, -1])[near]
            out = middle[near] + 0.5 * (toward - middle[near])
            got = f(out, on[near])
            good = got < np.minimum(at[near], v[near, -1])
            new[near], found[near] = out, got
            small = np.flatnonzero(near)[~good]
            for k in range(1, size + 1):
                if len(small):
                    points[on[small], k] = p[small, 0] + 0.5 * (p[small, k] - p[small, 0])
                    values[on[small], k] = f(points[on[small], k], on[small])
            taken = np.ones(len(on), bool)
            taken[small] = False
        else:
            taken = np.ones(len(on), bool)
        points[on[taken], -1], values[on[taken], -1] = new[taken], found[taken]
    return np.take_along_axis(points, values.argmin(axis=1)[:, None, None], axis=1)[:, 0]


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, **how) -> np.ndarray:
    return simplex_many(lambda p, _: np.array([f(x) for x in p]), 1, np.asarray(start, float), **how)[0]


def arma_filter(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovations and their variances (in units of sigma^2) of each lane's ARMA(1,1), and the prediction of the next value."""
    spread = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)  # of the first value
    e, f = np.empty(y.shape), np.empty(y.shape)
    predicted = np.zeros(len(y))
    for i in range(y.shape[1]):
        e[:, i], f[:, i] = y[:, i] - predicted, spread
        predicted = phi * y[:, i] + theta * e[:, i] / spread
        spread = 1 + theta * theta - theta * theta / spread
    return e, f, predicted


def arima_many(x: np.ndarray, d: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast mean and standard error of ARIMA(1, d, 1) of each lane by exact likelihood; a constant only for d = 0."""
    mean = np.zeros(len(x)) if d else x.mean(axis=1)
    y = np.diff(x, axis=1) if d else x - mean[:, None]
    last = x[:, -1] if d else mean
    ahead, spread = np.repeat(last[:, None], steps, axis=1), np.zeros((len(x), steps))
    on = np.flatnonzero(~np.isclose(y, 0).all(axis=1)) if y.shape[1] >= 3 else np.zeros(0, int)
    if not len(on):
        return ahead, spread

    def cost(p: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        e, f, _ = arma_filter(y[on[lanes]], np.tanh(p[:, 0]), np.tanh(p[:, 1]))
        return y.shape[1] * np.log(np.maximum((e * e / f).mean(axis=1), 1e-300)) + np.log(f).sum(axis=1)

    with np.errstate(all="ignore"):  # a simplex may step to |phi| = 1, which costs nan
        phi, theta = np.tanh(simplex_many(cost, len(on), np.array([0.1, -0.1]))).T
    e, f, following = arma_filter(y[on], phi, theta)
    var = (e * e / f).mean(axis=1)
    power = phi[:, None] ** np.arange(steps)
    own, psi = following[:, None] * power, np.concatenate([np.ones((len(on), 1)), ((phi + theta)[:, None] * power)[:, : steps - 1]], axis=1)
    if d:
        own, psi = x[on, -1:] + np.cumsum(own, axis=1), np.cumsum(psi, axis=1)
    ahead[on], spread[on] = own + mean[on, None], np.sqrt(var[:, None] * np.cumsum(psi**2, axis=1))
    return ahead, spread


def arima_11(x: np.ndarray, d: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    point, spread = arima_many(np.asarray(x, float)[None], d, steps)
    return point[0], spread[0]


def ses_many(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple exponential smoothing of each lane: the last level and the residuals' deviation, alpha and first level by least squares."""

    def run(alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # The residuals are linear in the first level: e = a - b * level.
        a, b, level, weight = np.empty(x.shape), np.empty(x.shape), np.zeros(len(x)), np.ones(len(x))
        for i in range(x.shape[1]):
            a[:, i], b[:, i] = x[:, i] - level, weight
            level, weight = level + alpha * (x[:, i] - level), weight * (1 - alpha)
        first = (a * b).sum(axis=1) / (b * b).sum(axis=1)
        e = a - first[:, None] * b
        return (e * e).sum(axis=1), level + first * weight, e.std(axis=1)

    grid = np.linspace(0.01, 0.99, 50)
    best = grid[np.stack([run(np.full(len(x), g))[0] for g in grid]).argmin(axis=0)]
    low, high = np.maximum(1e-4, best - 0.02), np.minimum(1 - 1e-4, best + 0.02)
    fine = np.linspace(low, high, 41)
    chosen = np.stack([run(g)[0] for g in fine]).argmin(axis=0)
    _, level, sd = run(fine[chosen, np.arange(len(x))])
    return level, sd


def ses(x: np.ndarray) -> tuple[float, float]:
    level, sd = ses_many(np.asarray(x, float)[None])
    return float(level[0]), float(sd[0])


#: The additive model's usual settings, fixed values: changepoints and the share of the history that has them, the scale of
#: their Laplace prior, the deviations of the normal priors of trend and season, yearly waves, simulated futures.
CHANGEPOINTS, CHANGE_RANGE, CHANGE_SCALE = 25, 0.8, 0.05
TREND_SCALE, SEASON_SCALE, WAVES, FUTURES = 5.0, 10.0, 10, 1000


def shrunk(gram: np.ndarray, target: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, rounds: int = 2000, close: float = 1e-10) -> np.ndarray:
    """Least squares (X'X and X'y given) with a square penalty (half of ridge * b^2) and an absolute one (lasso * |b|) a coefficient, by coordinate descent."""
    b, left = np.zeros(len(target)), target.copy()
    size = np.diag(gram) + ridge
    for _ in range(rounds):
        most = 0.0
        for k in range(len(b)):
            if size[k] <= 0:
                continue
            pull = left[k] + gram[k, k] * b[k]
            new = math.copysign(max(abs(pull) - lasso[k], 0.0), pull) / size[k]
            if new != b[k]:
                left -= gram[:, k] * (new - b[k])
                most, b[k] = max(most, abs(new - b[k])), new
        if most < close:
            break
    return b


@dataclass
class Additive:
    """A fitted additive model: changepoints (as shares of the history), coefficients (level, slope, changes, waves), scale and noise."""

    knots: np.ndarray
    beta: np.ndarray
    scale: float
    noise: float
    n: int
    period: int

    @property
    def changes(self) -> np.ndarray:
        """The slope's changes at the knots, in values a step."""
        return self.beta[2 : 2 + len(self.knots)] * self.scale / max(self.n - 1, 1)

    def design(self, at: np.ndarray) -> np.ndarray:
        t = at / max(self.n - 1, 1)
        waves = [w(2 * math.pi * k * at / self.period) for k in range(1, min(WAVES, self.period // 2) + 1) for w in (np.sin, np.cos)]
        return np.column_stack([np.ones(len(at)), t, np.maximum(t[:, None] - self.knots, 0.0), *waves])


def fit_additive(x: np.ndarray, period: int = 12, rounds: int = 4) -> Additive:
    """Piecewise linear trend and yearly waves: changes of the slope have a Laplace prior, the rest normal ones; the most probable values.

    The penalties hold in units of the noise, which is estimated from the residuals in turn.
    """
    x = np.asarray(x, float)
    n, scale = len(x), float(np.abs(x).max()) or 1.0
    last = int(CHANGE_RANGE * n)
    many = max(0, min(CHANGEPOINTS, last - 1))
    knots = np.round(np.linspace(0, last - 1, many + 1))[1:] / max(n - 1, 1)
    model = Additive(knots, np.zeros(0), scale, 0.0, n, period)
    a, y = model.design(np.arange(n, dtype=float)), x / scale
    gram, target = a.T @ a, a.T @ y
    waves = a.shape[1] - 2 - many
    ridge = np.r_[np.full(2, TREND_SCALE**-2), np.zeros(many), np.full(waves, SEASON_SCALE**-2)]
    lasso = np.r_[np.zeros(2), np.full(many, 1 / CHANGE_SCALE), np.zeros(waves)]
    noise = max(float(y.std()), 1e-6)
    for _ in range(rounds):
        model.beta = shrunk(gram, target, noise**2 * ridge, noise**2 * lasso)
        noise = max(float(np.sqrt(((y - a @ model.beta) ** 2).mean())), 1e-6)
    model.noise = noise * scale
    return model


def seasonal(x: np.ndarray, steps: int, period: int = 12, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point forecast and the 95 % interval of the additive model: in simulated futures the slope goes on changing as often and as much as before."""
    model = fit_additive(x, period)
    point = model.design(np.arange(model.n, model.n + steps, dtype=float)) @ model.beta * model.scale
    rng = np.random.default_rng(seed)
    often = len(model.knots) / max(model.n - 1, 1)
    size = float(np.abs(model.changes).mean()) if len(model.knots) else 0.0
    times = rng.poisson(often, (FUTURES, steps)).astype(float)
    # The sum of so many Laplace draws is the difference of two gamma draws.
    change = size * (rng.gamma(times) - rng.gamma(times))
    futures = point + np.cumsum(np.cumsum(change, axis=1), axis=1) + rng.normal(0, model.noise, (FUTURES, steps))
    low, high = np.quantile(futures, [0.025, 0.975], axis=0)
    return point, low, high
