"""Numerical kernels without a relational form, on arrays of one group: models, tests, signal descriptors.

All randomness is seeded; ties go to the first row.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from .tails import digamma, normal_cdf, normal_ppf, normal_sf


# --- One-class model -----------------------------------------------------------------------------------------------
class OneClass:
    """One-class support vector machine with an RBF kernel, by pairwise coordinate steps on the dual."""

    def __init__(self, nu: float = 0.2, gamma: float | str = "scale"):
        self.nu, self.gamma = nu, gamma

    def fit(self, x: np.ndarray, steps: int = 20_000, tolerance: float = 1e-4) -> OneClass:
        n = len(x)
        self.g = 1 / (x.shape[1] * max(x.var(), 1e-12)) if self.gamma == "scale" else float(self.gamma)
        k, top = self._kernel(x, x), 1 / (self.nu * n)
        alpha = np.zeros(n)
        full = int(self.nu * n)
        alpha[:full] = top
        if full < n:
            alpha[full] = 1 - full * top
        grad = k @ alpha
        # Added to the gradient they bar rows that can't rise or fall; a step changes two of them. k is symmetric, so rows do for columns.
        up, down = np.where(alpha < top - 1e-12, 0.0, np.inf), np.where(alpha > 1e-12, 0.0, -np.inf)
        for _ in range(steps):
            i, j = int((grad + up).argmin()), int((grad + down).argmax())
            gap = grad[j] - grad[i]
            if gap < tolerance:
                break
            step = min(gap / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - alpha[i], alpha[j])
            alpha[i] += step
            alpha[j] -= step
            for c in (i, j):
                up[c], down[c] = 0.0 if alpha[c] < top - 1e-12 else np.inf, 0.0 if alpha[c] > 1e-12 else -np.inf
            grad += step * (k[i] - k[j])
        free = (alpha > 1e-9) & (alpha < top - 1e-9)
        self.rho = float(grad[free].mean() if free.any() else (np.min(grad[alpha < top - 1e-9], initial=np.inf) + np.max(grad[alpha > 1e-9], initial=-np.inf)) / 2)
        own = alpha > 1e-9
        self.support, self.alpha = x[own], alpha[own]
        return self

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.g * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Positive inside; about a share nu of the training rows is negative."""
        return self._kernel(x, self.support) @ self.alpha - self.rho


def scaled(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    m, s = train.mean(0), train.std(0)
    s = np.where(s > 1e-9, s, 1.0)
    return [(a - m) / s for a in (train, *others)]


def array_auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    values, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    ranks = np.bincount(inverse, weights=ranks)[inverse] / count[inverse]
    p, q = label.sum(), len(label) - label.sum()
    return float((ranks[label == 1].sum() - p * (p + 1) / 2) / (p * q)) if p and q else 0.5


def array_aucs(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    """`array_auc` of every row of scores, by one sort of the matrix."""
    p, q = label.sum(), len(label) - label.sum()
    if not p or not q:
        return np.full(len(scores), 0.5)
    order = np.argsort(scores, axis=1, kind="stable")
    s, own = np.take_along_axis(scores, order, 1), label[order] == 1
    new = np.c_[np.ones(len(s), dtype=bool), s[:, 1:] != s[:, :-1]].ravel()
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    rank = (first % s.shape[1]) + (np.diff(np.r_[first, s.size]) + 1) / 2  # runs don't cross rows
    return ((rank[run].reshape(s.shape) * own).sum(1) - p * (p + 1) / 2) / (p * q)


def permutation_importance(model: OneClass, x: np.ndarray, label: np.ndarray, repeats: int = 10, seed: int = 42) -> np.ndarray:
    """Loss of AUC with a column shuffled. The kernel is a product over columns, so the part of the others is computed once."""
    rng, base = np.random.default_rng(seed), array_auc(model.decision(x), label)
    out, square = np.zeros(x.shape[1]), (x[:, None] - model.support[None]) ** 2
    for f in range(x.shape[1]):
        others = np.exp(-model.g * np.delete(square, f, axis=2).sum(2)) * model.alpha
        own = np.exp(-model.g * square[:, :, f])
        scores = np.array([np.einsum("ij,ij->i", others, own[rng.permutation(len(x))]) for _ in range(repeats)]) - model.rho
        out[f] = ((base - array_aucs(scores, label)) / repeats).sum()
    return out


def sampled_shapley(score, x: np.ndarray, background: np.ndarray, samples: int = 20, seed: int = 42) -> np.ndarray:
    """Mean absolute Shapley values by sampled orders of features: an approximation."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    total = np.zeros((len(x), d))
    for _ in range(samples):
        order, at = rng.permutation(d), background[rng.integers(len(background), size=len(x))].copy()
        before = score(at)
        for f in order:
            at[:, f] = x[:, f]
            after = score(at)
            total[:, f] += (after - before) / samples
            before = after
    return np.abs(total).mean(0)


# --- Outliers and shape ----------------------------------------------------------------------------------------------
def local_outlier_factor(x: np.ndarray, k: int = 10) -> np.ndarray:
    """LOF of one-dimensional values: neighbours are searched among the k on either side in sorted order."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.ones(n)
    order = np.argsort(x, kind="stable")
    s = x[order]
    offsets = np.r_[-np.arange(1, k + 1), np.arange(1, k + 1)]
    near = np.arange(n)[:, None] + offsets
    d = np.where((near >= 0) & (near < n), np.abs(s[np.clip(near, 0, n - 1)] - s[:, None]), np.inf)
    pick = np.argsort(d, axis=1, kind="stable")[:, :k]
    near, d = np.take_along_axis(near, pick, 1), np.take_along_axis(d, pick, 1)
    reach = np.maximum(d, d[near, -1])
    density = 1 / (reach.mean(1) + 1e-10)
    out = np.empty(n)
    out[order] = density[near].mean(1) / density
    return out


def isolation_scores(x: np.ndarray, trees: int = 50, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Isolation-forest decision of one-dimensional values: 0.5 less the anomaly score."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    limit = math.ceil(math.log2(max(size, 2)))
    path = lambda m: 0.0 if m < 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    paths = [path(m) for m in range(size + 1)]
    order = np.argsort(x, kind="stable")
    rows = x[order].tolist()
    depth, bits = np.zeros(n), rng.bit_generator
    for _ in range(trees):
        v = np.sort(x[rng.choice(n, size, replace=False)]).tolist()
        # A tree's draws are taken ahead, then the generator is set back and moved on by those used.
        state = bits.state
        draws, used = rng.random(1 << limit).tolist(), 0
        lengths, values, open_ = [], [], [(0, size, 0, n, 0)]
        while open_:
            a, b, c, d, level = open_.pop()
            if level >= limit or b - a < 2 or c == d or v[a] == v[b - 1]:
                lengths.append(d - c)
                values.append(level + paths[b - a])
                continue
            cut = v[a] + (v[b - 1] - v[a]) * draws[used]
            used += 1
            m, r = bisect_left(v, cut, a, b), bisect_left(rows, cut, c, d)
            open_.append((m, b, r, d, level + 1))
            open_.append((a, m, c, r, level + 1))
        bits.state = state
        rng.random(used)
        depth += np.repeat(values, lengths)
    out = np.empty(n)
    out[order] = 0.5 - 2 ** (-depth / trees / max(path(size), 1e-9))
    return out


def bootstrap_median(x: np.ndarray, times: int = 1000, seed: int = 42) -> tuple[float, float]:
    rng = np.random.default_rng(seed)
    m = np.median(x[rng.integers(len(x), size=(times, len(x)))], axis=1)
    return float(np.quantile(m, 0.025)), float(np.quantile(m, 0.975))


def density_modes(x: np.ndarray, points: int = 200, prominence: float = 0.05) -> int:
    """Peaks of a Gaussian density (Scott's bandwidth) that stand out by a share of its range."""
    if len(x) < 2 or x.std() < 1e-12:
        return 1
    h, grid = x.std(ddof=1) * len(x) ** -0.2, np.linspace(x.min(), x.max(), points)
    y = np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(1)
    need, count = prominence * (y.max() - y.min()), 0
    for i in range(points):
        if (i == 0 or y[i] > y[i - 1]) and (i == points - 1 or y[i] >= y[i + 1]):
            left = right = y[i]
            j = i - 1
            while j >= 0 and y[j] <= y[i]:
                left, j = min(left, y[j]), j - 1
            j = i + 1
            while j < points and y[j] <= y[i]:
                right, j = min(right, y[j]), j + 1
            count += y[i] - max(left, right) >= need and 0 < i < points - 1
    return max(1, count)


# --- Tests -----------------------------------------------------------------------------------------------------------
def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (3 <= n <= 5000)."""
    x = np.sort(x)
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-12:
        return math.nan, math.nan
    m = normal_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    c, u = m / math.sqrt(m @ m), 1 / math.sqrt(n)
    a = c.copy()
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        poly = lambda coef: sum(v * u**i for i, v in enumerate(coef, 1))
        last = c[-1] + poly((0.221157, -0.147981, -2.071190, 4.434685, -2.706056))
        if n > 5:
            second = c[-2] + poly((0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[[0, 1, -2, -1]] = -last, -second, second, last
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[[0, -1]] = -last, last
    w = min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y = -math.log(g - y)
        mu, sigma = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mu, sigma = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3, math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, float(normal_sf((y - mu) / sigma))


def standardised_cdf(x: np.ndarray) -> np.ndarray:
    s = np.sort(x)
    return normal_cdf((s - s.mean()) / max(s.std(ddof=1), 1e-12))


def kolmogorov_smirnov(x: np.ndarray) -> tuple[float, float]:
    """D of the standardised values against the normal, p by the asymptotic series with Stephens' correction."""
    f, n = standardised_cdf(x), len(x)
    d = float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))
    t = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    return d, float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))))


def lilliefors_p(d: float, n: int) -> float:
    """p of D with estimated parameters (Dallal and Wilkinson), valid below 0.1; larger values are capped there."""
    if n > 100:
        d, n = d * (n / 100) ** 0.49, 100
    return float(min(0.1, math.exp(-7.01256 * d**2 * (n + 2.78019) + 2.99587 * d * math.sqrt(n + 2.78019) - 0.122119 + 0.974598 / math.sqrt(n) + 1.67997 / n)))


def anderson_darling(x: np.ndarray) -> tuple[float, bool]:
    """A2 and whether normality is rejected at 5 %."""
    f, n = np.clip(standardised_cdf(x), 1e-15, 1 - 1e-15), len(x)
    i = np.arange(1, n + 1)
    a2 = float(-n - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).mean())
    return a2, bool(a2 > 0.787 / (1 + 4 / n - 25 / n**2))


def cramer_von_mises(x: np.ndarray) -> tuple[float, float]:
    """W2 against the normal with estimated parameters; p by Stephens' piecewise fit."""
    f, n = standardised_cdf(x), len(x)
    w = float(1 / (12 * n) + ((f - (2 * np.arange(1, n + 1) - 1) / (2 * n)) ** 2).sum())
    z = w * (1 + 0.5 / n)
    if z < 0.0275:
        p = 1 - math.exp(-13.953 + 775.5 * z - 12542.61 * z * z)
    elif z < 0.051:
        p = 1 - math.exp(-5.903 + 179.546 * z - 1515.29 * z * z)
    elif z < 0.092:
        p = math.exp(0.886 - 31.62 * z + 10.897 * z * z)
    else:
        p = math.exp(1.111 - 34.242 * min(z, 1.1) + 12.832 * min(z, 1.1) ** 2)
    return w, float(min(1, max(0, p)))


def change_points(x: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Optimal partitioning with squared error and pruning; returns segment ends before the last."""
    n = len(x)
    pen = math.log(n) * x.var() if penalty is None else penalty
    s, q = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    cost = np.full(n + 1, np.inf)
    cost[0], back, open_ = -pen, np.zeros(n + 1, dtype=int), np.array([0])
    for t in range(least, n + 1):
        own = open_[t - open_ >= least]
        c = cost[own] + q[t] - q[own] - (s[t] - s[own]) ** 2 / (t - own) + pen
        i = int(np.argmin(c))
        cost[t], back[t] = c[i], own[i]
        late = open_[t - open_ < least]
        open_ = np.r_[own[c - pen <= cost[t]], late, t - least + 1] if t - least + 1 > 0 else np.r_[own[c - pen <= cost[t]], late]
        open_ = np.unique(open_)
    out, t = [], n
    while t > 0 and back[t] > 0:
        t = int(back[t])
        out.append(t)
    return out[::-1]


# --- Relevance -------------------------------------------------------------------------------------------------------
def knn_information(x: np.ndarray, label: np.ndarray, k: int = 3) -> float:
    """Mutual information of a continuous value and a class by nearest neighbours (Ross 2014)."""
    total, n, keep = 0.0, len(x), []
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        if len(own) > 1:
            keep.append((own, min(k, len(own) - 1)))
    if not keep:
        return 0.0
    every, count = np.unique(x, return_counts=True)
    below = np.r_[0, np.cumsum(count)]
    for own, m in keep:
        v = np.sort(x[own])
        # The m-th neighbour of a sorted value is the farther end of the best window of m + 1 values around it.
        pad = np.r_[np.full(m, -np.inf), v, np.full(m, np.inf)]
        at = np.arange(m, m + len(v))
        radius = np.nextafter(np.min([np.maximum(v - pad[at - j], pad[at + m - j] - v) for j in range(m + 1)], axis=0), 0)
        low, high = np.searchsorted(every, v - radius), np.searchsorted(every, v + radius, side="right") - 1
        for _ in range(2):  # the ends by differences, as rounding has them
            low = np.where(v - every[np.minimum(low, len(every) - 1)] > radius, low + 1, low)
            low = np.where((low > 0) & (v - every[np.maximum(low - 1, 0)] <= radius), low - 1, low)
            high = np.where(every[high] - v > radius, high - 1, high)
            high = np.where((high < len(every) - 1) & (every[np.minimum(high + 1, len(every) - 1)] - v <= radius), high + 1, high)
        inside = below[high + 1] - below[low]
        total += (digamma(np.array([float(m)]))[0] - digamma(np.array([float(len(own))]))[0]) * len(own) - digamma(np.maximum(inside, 1).astype(float)).sum()
    used = sum(len(o) for o, _ in keep)
    return float(max(0.0, digamma(np.array([float(n)]))[0] + total / used))


def relief(x: np.ndarray, label: np.ndarray, k: int = 10) -> np.ndarray:
    """ReliefF weights for two classes, range-scaled distances."""
    span = np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
    z = (x - x.min(0)) / span
    d = _pair_sums(z, np.abs)
    np.fill_diagonal(d, np.inf)
    out = np.zeros(x.shape[1])
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        sign = np.where(label == c, -1.0, 1.0)
        near = nearest_marks(d[:, own], k) & (own[None] != np.arange(len(x))[:, None])
        i, j = np.nonzero(near)
        weight = (sign / np.maximum(near.sum(1), 1))[i]
        out += (weight[:, None] * np.abs(z[own[j]] - z[i])).sum(0) / len(x)
    return out


def _pair_sums(z: np.ndarray, f) -> np.ndarray:
    """Sum over columns of f(difference) for all pairs of rows, a column at a time."""
    out = f(z[:, None, 0] - z[None, :, 0])
    for c in range(1, z.shape[1]):
        out += f(z[:, None, c] - z[None, :, c])
    return out


def nearest_marks(d: np.ndarray, k: int) -> np.ndarray:
    """Marks of the k smallest of each row, the first of equal ones, as a stable sort has it."""
    if d.shape[1] <= k:
        return np.ones(d.shape, dtype=bool)
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    marks = d <= edge
    over = np.flatnonzero(marks.sum(1) > k)
    tied = d[over] == edge[over]
    less = marks[over] & ~tied
    marks[over] = less | (tied & (np.cumsum(tied, axis=1) <= k - less.sum(1, keepdims=True)))
    return marks


def laplacian_scores(x: np.ndarray, k: int = 5, scale: bool = True) -> np.ndarray:
    """Laplacian score of each column on the symmetrised nearest-neighbour graph; scale: variant A (z-scores, plain
    centring, 1 / (1 + L)), else variant B (raw, degree-weighted centring, 1 - L)."""
    z = scaled(x)[0] if scale else x
    d = _pair_sums(z, np.square)
    np.fill_diagonal(d, np.inf)
    w = nearest_marks(d, min(k, len(x) - 1))
    w = (w | w.T).astype(float)
    deg = w.sum(1)
    out = np.zeros(x.shape[1])
    for f in range(x.shape[1]):
        v = z[:, f] - (z[:, f].mean() if scale else (z[:, f] @ deg) / deg.sum())
        bottom = (v * v) @ deg
        value = (bottom - v @ w @ v) / bottom if bottom > 1e-12 else 0.0
        out[f] = (1 / (1 + value) if scale else 1 - value) if bottom > 1e-12 else 0.0
    return out


#: Distances in units of 1e-9 that stand for NaN and for a missing one; both sort after all others.
IS_NAN, IS_NULL = 1 << 62, (1 << 62) + 1


def nine_digits(d: np.ndarray) -> np.ndarray:
    """d in units of 1e-9, halves up as decimal rounding of the shortest decimal has it."""
    y = d * 1e9
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5 + 4e-16 * y):
        out[i] = float((Decimal(repr(float(d[i]))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(d), float(IS_NAN), np.minimum(out, 4e18)).astype(np.int64)


def nearest_units(queries, others, own_keys: np.ndarray, other_keys: np.ndarray, k: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, distance in 1e-9) of each query's k nearest others of another key, ties by key: a matrix product
    leaves those that can be among the k, their distances are summed component by component."""
    whole = lambda v: v is not None and not any(x is None for x in v)
    ok_q, ok_c = (np.array([len(v) if whole(v) else -1 for v in side], dtype=int) for side in (queries, others))
    found = []
    usual = int(ok_c.max(initial=-1))
    plain = usual >= 0 and (ok_c == usual).all() and (ok_q == usual).all()
    if plain:
        c = np.array([np.asarray(v, dtype=float) for v in others]).reshape(len(others), usual)
        cc = (c * c).sum(1)
    place = np.argsort(np.argsort(other_keys, kind="stable"), kind="stable")  # keys need not be numbers
    for start in range(0, len(queries), rows):
        part = slice(start, start + rows)
        itself = own_keys[part, None] == other_keys[None]
        if plain:
            q = np.array([np.asarray(v, dtype=float) for v in queries[part]]).reshape(-1, usual)
            qq = (q * q).sum(1)
            with np.errstate(invalid="ignore", over="ignore"):
                near = qq[:, None] + cc[None] - 2 * (q @ c.T)
                near[itself] = np.inf
                if len(c) > k:
                    edge = np.partition(near, k - 1, axis=1)[:, k - 1]
                    edge = edge + 8e-9 * np.sqrt(np.maximum(edge, 0)) + 1e-11 * (qq + cc.max()) + 1e-17
                    can = (near <= edge[:, None]) | ~np.isfinite(edge)[:, None]
                else:
                    can = np.ones(near.shape, dtype=bool)
                i, j = np.nonzero(can & ~itself)
                total = np.zeros(len(i))
                for f in range(usual):
                    step = q[i, f] - c[j, f]
                    total += step * step
                units = nine_digits(np.sqrt(total))
        else:
            i, j = np.nonzero(~itself)
            units = np.full(len(i), IS_NULL)
            for n in np.flatnonzero((ok_q[part][i] == ok_c[j]) & (ok_c[j] >= 0)):
                a, b = np.asarray(queries[start + i[n]], dtype=float), np.asarray(others[j[n]], dtype=float)
                units[n] = nine_digits(np.array([math.sqrt(sum((x - y) * (x - y) for x, y in zip(a.tolist(), b.tolist(), strict=True)))]))[0]
        order = np.lexsort((place[j], units, i))
        i, j, units = i[order], j[order], units[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[first] + start, j[first], units[first]))
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (list(zip(*found, strict=True)) or [[], [], []]))


# --- Trees and resampled regression on counted or streamed rows ------------------------------------------------------
def _splits(hist: np.ndarray, impurity, allowed: np.ndarray | None):
    """Best split of each node from sums (stat, node, feature, bin): feature, bin, gain and weight; gain 0 where there is none."""
    total = hist.sum(3, keepdims=True)
    left = np.cumsum(hist, axis=3)[..., :-1]
    right = total - left
    n, nl, nr = total[0], left[0], right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity(total) - (nl * impurity(left) + nr * impurity(right)) / n
    gain = np.where((nl > 1e-9 * n) & (nr > 1e-9 * n), gain, 0.0)
    if allowed is not None:
        gain = gain * allowed[:, :, None]
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    return best // gain.shape[2], best % gain.shape[2], flat[np.arange(len(flat)), best], n[:, 0, 0]


def _gini(h):
    return 1 - ((h[1] / h[0]) ** 2 + ((h[0] - h[1]) / h[0]) ** 2)


def _variance(h):
    return h[2] / h[0] - (h[1] / h[0]) ** 2


def grow(columns: list[np.ndarray], sums: list[np.ndarray], bins: int, depth: int, impurity, subset: int | None = None, rng=None) -> tuple[np.ndarray, np.ndarray]:
    """(importances, leaf of each row) of a tree on binned columns; rows carry sums: weight first, then what impurity needs.

    Importance of a feature is the sum of gain times weight over its nodes, as in pyspark.ml.
    """
    k, rows = len(columns), len(sums[0])
    out, leaf, at, node, leaves = np.zeros(k), np.zeros(rows, dtype=np.int64), np.arange(rows), np.zeros(rows, dtype=np.int64), 0
    for level in range(depth + 1):
        nodes = int(node.max(initial=-1)) + 1
        if level == depth or not nodes:
            leaf[at] = leaves + node
            break
        hist = np.empty((len(sums), nodes, k, bins))
        for f, c in enumerate(columns):
            index = node * bins + c[at]
            for i, v in enumerate(sums):
                hist[i, :, f] = np.bincount(index, weights=v[at], minlength=nodes * bins).reshape(nodes, bins)
        allowed = None
        if subset is not None and subset < k:
            allowed = np.argsort(np.argsort(rng.random((nodes, k)), axis=1), axis=1) < subset
        feature, cut, gain, weight = _splits(hist, impurity, allowed)
        split = gain > 1e-12
        np.add.at(out, feature[split], (gain * weight)[split])
        stays = ~split[node]
        ends = np.cumsum(~split) - 1
        leaf[at[stays]] = leaves + ends[node[stays]]
        leaves += int((~split).sum())
        at, node = at[~stays], node[~stays]
        value = np.choose(feature[node], [c[at] for c in columns]) if k <= 32 else np.array([columns[f][a] for f, a in zip(feature[node], at, strict=True)])
        node = 2 * (np.cumsum(split) - 1)[node] + (value > cut[node])
    return out, leaf


def forest_tree(columns: list[np.ndarray], label: np.ndarray, count: np.ndarray, weight: np.ndarray, bins: int, subset: int, rng, depth: int = 8) -> np.ndarray:
    """Importances (sum 1) of one tree on a bootstrap sample: a row that stands for n rows is drawn Poisson(n) times."""
    drawn = rng.poisson(count)
    own = np.flatnonzero(drawn)
    w = drawn[own] * weight[label[own]]
    out, _ = grow([c[own] for c in columns], [w, w * label[own]], bins, depth, _gini, subset, rng)
    return out / out.sum() if out.sum() > 0 else out


def boosted_importances(columns: list[np.ndarray], counts: np.ndarray, weight: np.ndarray, bins: int, rounds: int, depth: int = 4, step: float = 0.1) -> np.ndarray:
    """Importances of boosted trees under the logistic loss of pyspark.ml; counts (class, cell). Rows of a cell and class
    have one score, so their sums are exact."""
    w, y = counts * weight[:, None], np.array([-1.0, 1.0])[:, None]
    score, total = np.zeros(counts.shape[1]), np.zeros(len(columns))
    for i in range(rounds):
        goal = np.broadcast_to(y, w.shape) if i == 0 else 4 * y / (1 + np.exp(2 * y * score))
        sums = [w.sum(0), (w * goal).sum(0), (w * goal * goal).sum(0)]
        gain, leaf = grow(columns, sums, bins, depth, _variance)
        total += gain
        mean = np.bincount(leaf, weights=sums[1]) / np.maximum(np.bincount(leaf, weights=sums[0]), 1e-300)
        score = score + (1.0 if i == 0 else step) * mean[leaf]
    return total / total.sum() if total.sum() > 0 else total


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """64 mixed bits of each key."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Ends of the Poisson(1) probabilities in 32 bits; what lies beyond is below their resolution.
_DRAWS = [np.uint32(min(2**32 - 1, round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))))) for k in range(12)]


def poisson_draws(key: np.ndarray, salt: int) -> np.ndarray:
    """How often each row is drawn in a bootstrap sample, by a hash of its key."""
    u = (mixed(key, salt) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(len(u))
    for end in _DRAWS:
        out += u >= end
    return out


def newton_sums(x: np.ndarray, y: np.ndarray, draws: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (m, d) and Hessians (m, d, d) of the logistic loss of m weighted samples."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta.T, -500, 500)))
    g = (draws * (p - y[:, None])).T @ x
    d = x.shape[1]
    return g, ((draws * p * (1 - p)).T @ (x[:, :, None] * x[:, None]).reshape(len(x), d * d)).reshape(-1, d, d)


def sparse_step(beta: np.ndarray, g: np.ndarray, h: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Minimum of the quadratic model with an L1 penalty (none where 0), by coordinates."""
    b, h = beta.copy(), h + np.eye(len(g)) * 1e-9 * max(1.0, float(np.trace(h)) / len(g))
    for _ in range(1000):
        before = b.copy()
        for j in range(len(b)):
            slope = g[j] + h[j] @ (b - beta) - h[j, j] * b[j]
            b[j] = -np.sign(slope) * max(abs(slope) - penalty[j], 0.0) / h[j, j]
        if np.abs(b - before).max() < 1e-13:
            break
    return b


# --- Signals ---------------------------------------------------------------------------------------------------------
def tapers(n: int, count: int = 3) -> np.ndarray:
    """Sine tapers: orthonormal, low leakage."""
    i = np.arange(1, n + 1)
    return np.array([math.sqrt(2 / (n + 1)) * np.sin(math.pi * (k + 1) * i / (n + 1)) for k in range(count)])


def spectrum_descriptors(x: np.ndarray, fs: float, count: int = 3) -> dict[str, float]:
    """Seven descriptors of the multitaper spectrum: peak, energy, entropy, two bands, centroid, median frequency."""
    names = ("peak", "energy", "entropy", "low", "high", "centroid", "medoid")
    if len(x) < 32:
        return dict.fromkeys(names, 0.0)
    p = (np.abs(np.fft.rfft(tapers(len(x), count) * (x - x.mean()), axis=1)) ** 2).mean(0)
    f = np.fft.rfftfreq(len(x), 1 / fs)
    total = p.sum()
    if total <= 1e-12:
        return dict.fromkeys(names, 0.0)
    q = p / total
    band = lambda a, b: float(p[(f >= a) & (f < b)].sum())
    return dict(zip(names, (float(f[p.argmax()]), float(total), float(-(q[q > 0] * np.log2(q[q > 0])).sum() / math.log2(len(q))), band(0.5, 2), band(2, 5), float(f @ q), float(f[np.searchsorted(np.cumsum(q), 0.5)])), strict=True))


def cepstrum(x: np.ndarray, fs: float, filters: int = 12, coefficients: int = 6) -> np.ndarray:
    """Mel-spaced cepstral coefficients of a Hamming-windowed signal."""
    p, f = np.abs(np.fft.rfft(x * np.hamming(len(x)))) ** 2, np.fft.rfftfreq(len(x), 1 / fs)
    mel, hz = (lambda v: 2595 * np.log10(1 + v / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = hz(np.linspace(mel(0.5), mel(max(fs / 2 - 0.5, 1.0)), filters + 2))
    bank = np.array([np.clip(np.minimum((f - a) / max(b - a, 1e-9), (c - f) / max(c - b, 1e-9)), 0, None) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)])
    e = np.log(bank @ p + 1e-10)
    k = np.arange(coefficients)[:, None]
    return (np.cos(math.pi * k * (np.arange(filters) + 0.5) / filters) * e).sum(1) * math.sqrt(2 / filters)


def low_pass(x: np.ndarray, fs: float, cutoff: float, order: int = 3) -> np.ndarray:
    """Zero-phase Butterworth response, applied in the frequency domain to the mirrored signal."""
    n = len(x)
    y = np.r_[x[::-1], x, x[::-1]]
    f = np.fft.rfftfreq(len(y), 1 / fs)
    return np.fft.irfft(np.fft.rfft(y) / (1 + (f / cutoff) ** (2 * order)), len(y))[n : 2 * n]


#: Low-pass decomposition filter of the fourth Daubechies wavelet (fixed values).
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])


def wavelet_level(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of one level, signal mirrored at its ends."""
    y = np.r_[x[:7][::-1], x, x[-7:][::-1]] if len(x) >= 7 else np.pad(x, 7, mode="edge")
    high = DB4[::-1] * (-1.0) ** np.arange(1, 9)
    return np.convolve(y, DB4, mode="valid")[1::2], np.convolve(y, high, mode="valid")[1::2]


def minimum_jerk(t: np.ndarray, x: np.ndarray, y: np.ndarray, points: int = 100) -> dict[str, float]:
    """Deviation of a path from the minimum-jerk course between its ends, and its jerk against the least possible."""
    span = t[-1] - t[0]
    d = math.hypot(x[-1] - x[0], y[-1] - y[0])
    if len(t) < 3 or span <= 0 or d <= 0:
        return {"deviation": 0.0, "jerk_ratio": 0.0}
    tau = np.linspace(0, 1, points)
    s = 10 * tau**3 - 15 * tau**4 + 6 * tau**5
    px, py = (np.interp(t[0] + tau * span, t, v) for v in (x, y))
    off = np.hypot(px - (x[0] + s * (x[-1] - x[0])), py - (y[0] + s * (y[-1] - y[0]))).mean() / d
    h = span / (points - 1)
    jerk = sum(np.diff(v, 3) ** 2 for v in (px, py)).sum() / h**5
    return {"deviation": float(off), "jerk_ratio": float(jerk / (720 * d * d / span**5 / 2))}
