"""Driver-side algebra of a fit: p-vectors and p x p matrices, never rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from riskloom.errors import LinearAlgebraError


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symmetric solve: Cholesky, then a general solve; singular systems raise."""
    try:
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    except np.linalg.LinAlgError:
        pass
    try:
        out = np.linalg.solve(a, b)
    except np.linalg.LinAlgError as e:
        raise LinearAlgebraError("the design is singular: collinear or constant columns") from e
    if not np.isfinite(out).all():
        raise LinearAlgebraError("the design is singular: collinear or constant columns")
    return out


def check_rank(gram: np.ndarray, names: list[str]) -> None:
    """Raise if the scaled Gram matrix is not of full rank, naming the columns that others explain."""
    d = np.sqrt(np.diag(gram))
    if (d <= 1e-12).any():
        raise LinearAlgebraError(f"all zero: {', '.join(n for n, s in zip(names, d, strict=True) if s <= 1e-12)}")
    values, vectors = np.linalg.eigh(gram / np.outer(d, d))
    if values[0] < 1e-11:
        part = np.abs(vectors[:, 0])
        raise LinearAlgebraError(f"collinear columns: {', '.join(n for n, s in zip(names, part, strict=True) if s > 0.1)}")


def soft(x: float, t: float) -> float:
    return math.copysign(max(abs(x) - t, 0.0), x)


def coordinate_descent(
    gram: np.ndarray, xz: np.ndarray, alpha: float, l1_ratio: float, beta: np.ndarray, free: np.ndarray, signs: np.ndarray, sweeps: int = 1000, tol: float = 1e-9
) -> np.ndarray:
    """Elastic net on sufficient statistics; free coefficients carry no penalty, signs bound others to one side of 0."""
    beta = beta.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    grad = xz - gram @ beta
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(beta)):
            if gram[j, j] <= 0:
                continue
            rho = grad[j] + gram[j, j] * beta[j]
            new = rho / gram[j, j] if free[j] else soft(rho, l1) / (gram[j, j] + l2)
            if signs[j] and new * signs[j] < 0:
                new = 0.0
            step = new - beta[j]
            if step:
                grad -= gram[:, j] * step
                beta[j] = new
                largest = max(largest, abs(step))
        if largest < tol * max(1.0, np.abs(beta).max()):
            break
    return beta


def nnls(gram: np.ndarray, xz: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Non-negative least squares on sufficient statistics by an active set."""
    p = len(xz)
    passive, beta = np.zeros(p, bool), np.zeros(p)
    for _ in range(10 * p + 10):
        w = xz - gram @ beta
        w[passive] = -np.inf
        if passive.all() or w.max() <= tol:
            break
        passive[int(w.argmax())] = True
        while True:
            trial = np.zeros(p)
            trial[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], xz[passive], rcond=None)[0]
            if trial[passive].min() > 0:
                beta = trial
                break
            back = passive & (trial <= 0)
            step = (beta[back] / np.maximum(beta[back] - trial[back], 1e-300)).min()
            beta = beta + step * (trial - beta)
            passive &= beta > tol
            beta[~passive] = 0.0
            if not passive.any():
                break
    return beta


def pava(values: np.ndarray, increasing: bool = True) -> np.ndarray:
    """The closest monotone sequence."""
    v = values if increasing else -values
    blocks: list[list[float]] = []
    for x in v:
        blocks.append([x, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    out = np.concatenate([np.full(int(n), m) for m, n in blocks])
    return out if increasing else -out


def brent(f: Callable[[float], float], low: float, high: float, tol: float = 1e-6, most: int = 200) -> float:
    """Minimum of f in an interval by golden sections with parabolic steps."""
    gold = 0.3819660112501051
    x = w = v = low + gold * (high - low)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(most):
        mid, t = (low + high) / 2, tol * abs(x) + 1e-12
        if abs(x - mid) <= 2 * t - (high - low) / 2:
            break
        golden = True
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * e) and q * (low - x) < p < q * (high - x):
                e, d, golden = d, p / q, False
        if golden:
            e = (high if x < mid else low) - x
            d = gold * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, w, x, fv, fw, fx = w, x, u, fw, fx, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def grid_minimum(f: Callable[[list[float]], list[float]], low: float, high: float, points: int = 24, rounds: int = 4) -> float:
    """Minimum of a function that takes many places at once: ever finer grids around the best place, and a parabola through the last."""
    at, values, best = [low], [0.0], 0
    for _ in range(rounds):
        at = [low + (high - low) * k / (points - 1) for k in range(points)]
        values = f(at)
        best = min(range(points), key=values.__getitem__)
        low, high = at[max(best - 1, 0)], at[min(best + 1, points - 1)]
    if 0 < best < points - 1:
        a, b, c = values[best - 1 : best + 2]
        if a - 2 * b + c > 0:
            return at[best] + (at[best + 1] - at[best]) * 0.5 * (a - c) / (a - 2 * b + c)
    return at[best]


def edf(gram: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Effective degrees of freedom of each coefficient: the diagonal of (G + S)^-1 G."""
    return np.diag(np.linalg.solve(gram + penalty, gram))


def gcv(n: float, rss: float, degrees: float) -> float:
    return n * rss / max(n - degrees, 1e-10) ** 2


def aic_score(deviance: float, degrees: float) -> float:
    return deviance + 2 * degrees


def bic_score(deviance: float, n: float, degrees: float) -> float:
    return deviance + math.log(n) * degrees


def lambda_grid(n: int, low: float = 1e-4, high: float = 1e4) -> np.ndarray:
    """Penalties to search, evenly spaced in their logarithm; a single one is in the middle."""
    return np.geomspace(low, high, n) if n > 1 else np.array([math.sqrt(low * high)])


def smoothing(
    gram: np.ndarray, xz: np.ndarray, zz: float, n: float, blocks: list[tuple[slice, np.ndarray]], start: np.ndarray, low: float = 0.1, high: float = 1000.0
) -> np.ndarray:
    """Penalties of smooth terms by generalised cross-validation, one after the other, on the statistics of one pass."""
    lam = start.copy()

    def score(values: np.ndarray) -> float:
        s = np.zeros_like(gram)
        for (where, own), v in zip(blocks, values, strict=True):
            s[where, where] += v * own
        try:
            beta = solve(gram + s, xz)
        except LinearAlgebraError:
            return math.inf
        rss = zz - 2 * beta @ xz + beta @ gram @ beta
        return gcv(n, max(rss, 0.0), float(edf(gram, s).sum()))

    for _ in range(3):
        before = lam.copy()
        for k in range(len(lam)):

            def one(t: float, k: int = k) -> float:
                trial = lam.copy()
                trial[k] = math.exp(t)
                return score(trial)

            lam[k] = math.exp(brent(one, math.log(low), math.log(high), 1e-3, 40))
        if np.allclose(before, lam, rtol=1e-2):
            break
    return lam
