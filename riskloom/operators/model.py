"""Fitting and using generalized linear models.

Each iteration is one pass over the kept design frame: with the coefficients as literals the tasks
compute means, working responses, X'WX, X'Wz and the deviance, and the driver solves. No iteration's
plan builds on another's.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.errors import FittingError, SerializationError, ValidationError
from riskloom.functions.families import Family, get_family, residual
from riskloom.functions.links import Link, get_link
from riskloom.functions.special import chi2_sf, lgamma_np, normal_cdf, normal_quantile, t_sf2
from riskloom.operators import metrics, solvers
from riskloom.operators.gram import packed, row_sums
from riskloom.operators.prefix import finite, released
from riskloom.plans.spec import ModelSpec

STATE_VERSION = 1


def validate(df: DataFrame, family: Family, y: Column, weight: Column, offset: Column, inputs: dict[str, Column]) -> None:
    """One pass that counts what cannot be fitted; raises with the column and the count."""
    bad = {"response": (y, ~F.coalesce(finite(y), F.lit(False)), "null, NaN or infinite")}
    bad["weights"] = (weight, ~F.coalesce(finite(weight) & (weight >= 0), F.lit(False)), "null, NaN, infinite or negative")
    bad["offset"] = (offset, ~F.coalesce(finite(offset), F.lit(False)), "null, NaN or infinite (an exposure must be positive)")
    for name, c in inputs.items():
        bad[name] = (c, ~F.coalesce(finite(c.cast("double")), F.lit(False)), "null, NaN or infinite")
    checks = [F.count(F.when(b, 1)) for _, b, _ in bad.values()]
    low = F.lit(False) if family.least_y is None else (y <= family.least_y) if family.strict_y else (y < family.least_y)
    high = F.lit(False) if family.most_y is None else y > family.most_y
    row = df.agg(F.count(F.lit(1)), F.count(F.when(low | high, 1)), F.var_pop(y), *checks).first()
    if row[0] == 0:
        raise ValidationError("no rows")
    for (name, (_, _, what)), n in zip(bad.items(), row[3:], strict=True):
        if n:
            raise ValidationError(f"{name}: {n} of {row[0]} values ({100 * n / row[0]:.1f} %) are {what}")
    if row[1]:
        raise ValidationError(f"response: {row[1]} values are outside the range of the {family.name} family")
    if not row[2]:
        raise ValidationError("response: all values are equal")


@dataclass
class Fit:
    """What a fit gives: vectors and matrices of the size of the design's width."""

    beta: np.ndarray
    cov: np.ndarray  # unscaled
    deviance: float
    pearson: float
    n: int
    sum_w: float
    iterations: int
    converged: bool
    edf: float
    lambdas: list[float] = field(default_factory=list)
    edf_each: list[float] = field(default_factory=list)  # of each coefficient, given smooth terms


class Frame:
    """A design frame that is kept while a model is fitted: x, y, w, o."""

    def __init__(self, design: DataFrame, y: Column, w: Column, o: Column):
        kept = design.select(F.col("_x").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), o.cast("double").alias("o"))
        self.df = kept.persist(StorageLevel.MEMORY_AND_DISK)
        part = self.df.withColumn("part", F.spark_partition_id())
        row = part.agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.col("w") * F.col("y")), F.max("part") + 1).first()
        self.n, self.sum_w, self.mean, self.parts = row[0], row[1], row[2] / row[1], row[3]

    def sums(self, f, size: int) -> np.ndarray:
        return row_sums(self.df, f, size, self.parts)

    def part(self, df: DataFrame) -> Frame:
        """Some of the rows, as a frame of their own."""
        out = object.__new__(Frame)
        out.__dict__.update(self.__dict__, df=df)
        return out

    def close(self) -> None:
        self.df.unpersist()


def _mean_fn(family: Family, link: Link):
    return lambda eta: family.clamp_np(link.inverse_np(eta))


def _pass(family: Family, link: Link, beta: np.ndarray | None, mean: float, p: int):
    """Function of a batch: X'WX, X'Wz, z'Wz and the deviance at beta (at the family's start if None)."""
    mu_of = _mean_fn(family, link)
    tweedie = family.name == "tweedie" and link.name == "log" and 1 < (family.parameter or 0) < 2

    def run(x: np.ndarray, y: np.ndarray, w: np.ndarray, o: np.ndarray) -> np.ndarray:
        if beta is None:
            mu = family.clamp_np(family.start_np(y, mean))
            eta = link.link_np(mu)
        else:
            eta = x @ beta + o
            mu = mu_of(eta)
        g = link.slope_np(mu)
        weight = mu ** (2 - family.parameter) if tweedie else 1 / (family.variance_np(mu) * g * g)
        weight = w * np.clip(weight, 1e-10, 1e10)
        z = eta - o + (y - mu) * g
        xw = x * weight[:, None]
        pearson = (w * (y - mu) ** 2 / np.maximum(family.variance_np(mu), 1e-10)).sum()
        return packed(x.T @ xw, xw.T @ z, (weight * z * z).sum(), (w * family.deviance_np(y, mu)).sum(), pearson)

    return run, p * p + p + 3


def _deviance_pass(family: Family, link: Link, betas: list[np.ndarray]):
    """Function of a batch: the deviance at each of several coefficient vectors, in one pass."""
    mu_of = _mean_fn(family, link)
    return lambda x, y, w, o: np.array([(w * family.deviance_np(y, mu_of(x @ b + o))).sum() for b in betas])


def irls(
    frame: Frame, family: Family, link: Link, names: list[str], alpha: float = 0.0, l1_ratio: float = 0.0, intercept: bool = True,
    signs: np.ndarray | None = None, smooth: list[tuple[slice, np.ndarray, int]] | None = None, start: np.ndarray | None = None,
    max_iter: int = 25, tol: float = 1e-8,
) -> Fit:
    """Iteratively reweighted least squares with step halving; ridge, lasso, sign constraints and smooth terms in the solve."""
    p = len(names)
    signs = np.zeros(p) if signs is None else signs
    free = np.zeros(p, bool)
    if intercept:
        free[0] = True
    ridge = np.where(free, 0.0, alpha * (1 - l1_ratio))
    smooth = smooth or []
    lam = np.full(len(smooth), 1.0)
    beta, before, converged, k = start, math.inf, False, 0
    gram = xz = None
    fit_penalty = np.zeros((p, p))
    for k in range(1, max_iter + 1):
        f, size = _pass(family, link, beta, frame.mean, p)
        out = frame.sums(f, size)
        gram, xz = out[: p * p].reshape(p, p), out[p * p : p * p + p]
        zz, dev = out[-3], out[-2]
        if not np.isfinite(out).all():
            raise FittingError("the fit diverged: sums over rows are not finite")
        if k == 1 and alpha == 0 and not smooth:
            solvers.check_rank(gram, names)
        if beta is not None and before < math.inf and abs(before - dev) <= tol * (abs(before) + 1e-12):
            converged = True
            break
        if beta is not None and before < math.inf and dev > 1.0001 * before and k > 2:  # half steps, all lengths tried in one pass
            tries = [previous + (beta - previous) / 2**h for h in range(1, 5)]
            devs = frame.sums(_deviance_pass(family, link, tries), len(tries))
            beta = tries[int(np.argmin(devs))]
            before = math.inf
            continue
        previous, before = beta, dev if beta is not None else math.inf
        penalty = np.diag(ridge)
        if smooth:
            blocks = [(s, m) for s, m, _ in smooth]
            if k <= 4 or k % 2 == 0:
                lam = solvers.smoothing(gram, xz, zz, float(frame.n), blocks, lam)
            for (s, m), v in zip(blocks, lam, strict=True):
                penalty[s, s] += v * m
        fit_penalty = penalty
        beta = _step(gram, xz, penalty, alpha, l1_ratio, free, signs, smooth, beta)
    if not converged:  # else the last pass was at these coefficients
        f, size = _pass(family, link, beta, frame.mean, p)
        out = frame.sums(f, size)
    gram = out[: p * p].reshape(p, p)
    try:
        cov = np.linalg.inv(gram + (fit_penalty if smooth or (alpha and not l1_ratio) else 0))
    except np.linalg.LinAlgError:
        cov = np.full((p, p), np.nan)
    each = solvers.edf(gram, fit_penalty) if smooth else np.ones(p)
    return Fit(beta, cov, float(out[-2]), float(out[-1]), frame.n, float(frame.sum_w), k, converged, float(each.sum()), lam.tolist(), each.tolist())


def _step(gram, xz, penalty, alpha, l1_ratio, free, signs, smooth, beta) -> np.ndarray:
    """The next coefficients from one pass's statistics."""
    if alpha and l1_ratio or signs.any():
        begin = np.zeros(len(xz)) if beta is None else beta
        extra = penalty - np.diag(np.where(free, 0.0, alpha * (1 - l1_ratio)))
        new = solvers.coordinate_descent(gram + extra, xz, alpha, l1_ratio, begin, free, signs)
    else:
        new = solvers.solve(gram + penalty, xz)
    for s, _, sign in smooth:
        if sign:
            full = np.concatenate([[0.0], new[s]])  # the dropped first basis has the coefficient 0
            fitted = solvers.pava(full, sign > 0)
            new[s] = fitted[1:] - fitted[0]
    return new


class GLM:
    """A model's specification; fit() gives a Model."""

    def __init__(
        self, response: str, terms: dict[str, dict], data: DataFrame, interactions: list[dict] | None = None, family: str = "gaussian", link: str | None = None,
        offset: str | Column | None = None, weights: str | Column | None = None, theta: float | None = None, var_power: float = 1.5,
        intercept: bool = True, row_id: str | None = None, seed: int = 42,
    ):
        self.data, self.estimate_theta = data, theta is None and get_family(family).name == "negbinomial"
        self.family = get_family(family, theta or 1.0, var_power)
        self.link = get_link(link or self.family.default_link)
        self.spec = ModelSpec.parse(response, terms, interactions, intercept)
        for c in [response, *self.spec.inputs()]:
            if c not in data.columns:
                raise ValidationError(f"no column {c!r}")
        self.offset_name = offset if isinstance(offset, str) else None
        raw = F.lit(0.0) if offset is None else F.col(offset).cast("double") if isinstance(offset, str) else offset
        self.is_exposure = isinstance(offset, str) and self.family.log_exposure and self.link.name == "log"
        self.offset = F.log(F.when(raw > 0, raw)) if self.is_exposure else raw
        self.exposure = raw if self.is_exposure else None
        self.weight_name = weights if isinstance(weights, str) else None
        self.weights = F.lit(1.0) if weights is None else F.col(weights).cast("double") if isinstance(weights, str) else weights
        self.row_id = F.col(row_id) if row_id else F.xxhash64(*[F.col(c) for c in data.columns])
        self.seed = seed

    def validate(self) -> None:
        numeric = {t.variables[0]: F.col(t.variables[0]) for t in self.spec.terms if t.kind in ("linear", "bs", "ns")}
        validate(self.data, self.family, F.col(self.spec.response).cast("double"), self.weights, self.offset, numeric)

    def frame(self) -> Frame:
        self.spec.fit(self.data, self.exposure)
        training = {"y": self.spec.response, "exposure": self.exposure, "row_id": self.row_id, "seed": self.seed}
        with released():  # what encodings keep is not needed once the frame is
            design = self.spec.design(self.data, training)
            return Frame(design, F.col(self.spec.response), self.weights, self.offset)

    def fit(
        self, alpha: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 25, tol: float = 1e-8, cv: int | None = None, selection: str = "min", n_alphas: int = 20,
        include_unregularized: bool = False,
    ) -> Model:
        """Fit; with cv folds, alpha is chosen on a path first, which may end with alpha = 0 on the same folds."""
        self.validate()
        frame = self.frame()
        names = self.spec.names()
        signs, smooth = np.zeros(len(names)), []
        for term, a, b in self.spec.slices():
            if term.is_smooth:
                full = solvers_penalty(term.state["n"])
                smooth.append((slice(a, b), full[1:, 1:], term.sign))
            elif term.sign:
                signs[a:b] = term.sign
        path = None
        if cv:
            path = cv_path(frame, self, names, signs, l1_ratio, cv, n_alphas, include_unregularized)
            alpha = select_alpha(path, selection)
        theta_path = []
        family = self.family
        if self.estimate_theta:
            family, theta_path = _estimate_theta(frame, self, names, signs, smooth)
        fit = irls(frame, family, self.link, names, alpha, l1_ratio, self.spec.intercept, signs, smooth, None, max_iter, tol)
        return Model(self.spec, family, self.link, fit, names, alpha, l1_ratio, self.offset_name, self.is_exposure, self.weight_name, frame, path, theta_path)


def solvers_penalty(n: int) -> np.ndarray:
    from riskloom.operators.splines import penalty_matrix

    return penalty_matrix(n)


def _estimate_theta(frame: Frame, glm: GLM, names, signs, smooth) -> tuple[Family, list[float]]:
    """Alternate fits and the profile likelihood of theta, from a moment start."""
    family = get_family("poisson")
    link, theta, thetas = glm.link, 1.0, []
    for k in range(10):
        fit = irls(frame, family, link, names, 0.0, 0.0, glm.spec.intercept, signs, smooth, max_iter=25)
        eta = _dot(fit.beta, "x")
        mu = link.inverse(eta + F.col("o"))
        if k == 0:
            s = frame.df.agg(F.sum((F.col("y") - mu) * (F.col("y") - mu) - mu), F.sum(mu * mu)).first()
            new = min(max(s[1] / s[0], 0.01), 1000.0) if s[0] > 0 else 1000.0
        else:
            # the likelihood needs y and mu only: rows that agree in both, rounded, are one
            cells = frame.df.select("y", F.round(F.log(mu), 6).alias("m"), "w").groupBy("y", "m").agg(F.sum("w").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)

            pairs = cells.select(F.array("y", F.exp("m")).alias("x"), "y", "w", F.lit(0.0).alias("o"))

            def minus(logs: list[float], pairs: DataFrame = pairs) -> list[float]:
                return (-row_sums(pairs, _theta_likelihoods(np.exp(logs)), len(logs), frame.parts)).tolist()  # all in one pass

            new = math.exp(solvers.grid_minimum(minus, math.log(0.01), math.log(1000.0)))
            cells.unpersist()
        thetas.append(new)
        done = k > 0 and abs(new - theta) <= 1e-4 * theta
        theta, family = new, get_family("negbinomial", new)
        if done:
            break
    return family, thetas


def _theta_likelihoods(thetas: np.ndarray):
    """Function of a batch of (y, mu): the negative binomial log-likelihood at each theta, but for what is the same at all."""

    def run(x: np.ndarray, y: np.ndarray, w: np.ndarray, o: np.ndarray) -> np.ndarray:
        mu, out = x[:, 1], []
        for t in thetas:
            each = lgamma_np(y + t) - math.lgamma(t) + t * np.log(t / (mu + t)) + y * np.log(mu / (mu + t))
            out.append((w * each).sum())
        return np.array(out)

    return run


def _dot(beta: np.ndarray, design: str = "_x") -> Column:
    """The product of the design array with the coefficients."""
    literal = F.array(*[F.lit(float(b)) for b in beta])
    return F.aggregate(F.zip_with(design, literal, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def alpha_path(largest: float, n: int = 20, ratio: float = 1e-4) -> np.ndarray:
    return np.exp(np.linspace(math.log(largest), math.log(largest * ratio), n))


def fold_of(folds: int) -> Column:
    """The fold of a row of a frame: a hash of what it holds, so that equal rows share one."""
    return F.pmod(F.xxhash64("x", "y", "w", "o"), F.lit(folds)).cast("int")


def cv_path(frame: Frame, glm: GLM, names: list[str], signs: np.ndarray, l1_ratio: float, folds: int, n_alphas: int, zero: bool = False) -> list[dict]:
    """Mean and standard error of the validation deviance for each alpha, folds by a hash of the row.

    One pass gives every fold's X'WX and X'Wz. For the Gaussian identity model nothing more is read;
    otherwise each fold is fitted along the path with warm starts.
    """
    p, family, link = len(names), glm.family, glm.link
    folded = frame.df.withColumn("fold", fold_of(folds))
    f, size = _pass(get_family("gaussian"), get_link("identity"), np.zeros(p), frame.mean, p)

    def by_fold(x, y, w, o, fold):
        parts = [(x[own], y[own], w[own], o[own]) for own in (fold == k for k in range(folds))]
        return np.concatenate([np.append(f(*part), part[2].sum()) for part in parts])

    stats = row_sums(folded, by_fold, folds * (size + 1), frame.parts, ("fold",)).reshape(folds, size + 1)
    each, sizes = stats[:, :-1], np.maximum(stats[:, -1], 1e-300)
    whole = each.sum(axis=0)
    gram, xz = whole[: p * p].reshape(p, p), whole[p * p : p * p + p]
    first = int(glm.spec.intercept)
    centred = np.abs(xz - gram[:, 0] * frame.mean)[first:] if first else np.abs(xz)
    largest = max(float(centred.max()) / max(l1_ratio, 1e-3) if l1_ratio else float(np.median(np.diag(gram)[first:])) * 10, 1e-3)
    alphas = np.append(alpha_path(largest, n_alphas), [0.0] * zero)
    n_alphas = len(alphas)
    scores = np.zeros((folds, n_alphas))
    simple = family.name == "gaussian" and link.name == "identity"
    free = np.zeros(p, bool)
    free[:first] = True
    for k in range(folds):
        beta = np.zeros(p)
        betas = []
        if simple:
            rest = whole - each[k]
            g, b = rest[: p * p].reshape(p, p), rest[p * p : p * p + p]
            for a in alphas:
                beta = solvers.coordinate_descent(g, b, a, l1_ratio, beta, free, signs) if a and l1_ratio or signs.any() else solvers.solve(g + np.diag(np.where(free, 0.0, a)), b)
                betas.append(beta)
            gk, bk, zk = each[k][: p * p].reshape(p, p), each[k][p * p : p * p + p], each[k][-3]
            scores[k] = [(zk - 2 * b @ bk + b @ gk @ b) for b in betas]
        else:
            train = frame.part(folded.filter(F.col("fold") != k))
            beta = None
            for a in alphas:
                beta = irls(train, family, link, names, a, l1_ratio, glm.spec.intercept, signs, None, beta, 10, 1e-5).beta
                betas.append(beta)
            scores[k] = frame.part(folded.filter(F.col("fold") == k)).sums(_deviance_pass(family, link, betas), n_alphas)
    means = scores / sizes[:, None]
    return [
        {"alpha": float(a), "deviance": float(m), "se": float(s)}
        for a, m, s in zip(alphas, means.mean(0), means.std(0, ddof=1) / math.sqrt(folds), strict=True)
    ]


def select_alpha(path: list[dict], selection: str = "min") -> float:
    """The alpha of the least deviance, or the largest within one standard error of it."""
    best = min(path, key=lambda r: r["deviance"])
    if selection == "min":
        return best["alpha"]
    if selection == "1se":
        return max(r["alpha"] for r in path if r["deviance"] <= best["deviance"] + best["se"])
    raise ValidationError(f"selection is 'min' or '1se', not {selection!r}")


class Model:
    """A fitted model: inference on the driver, prediction as a projection."""

    def __init__(self, spec, family, link, fit, names, alpha=0.0, l1_ratio=0.0, offset=None, is_exposure=False, weights=None, frame=None, path=None, theta_path=None):
        self.spec, self.family, self.link, self.fit, self.names = spec, family, link, fit, names
        self.alpha, self.l1_ratio, self.offset, self.is_exposure, self.weights = alpha, l1_ratio, offset, is_exposure, weights
        self.frame, self.path, self.theta_path = frame, path, theta_path or []

    @property
    def params(self) -> dict[str, float]:
        return dict(zip(self.names, self.fit.beta.tolist(), strict=True))

    @property
    def scale(self) -> float:
        return 1.0 if self.family.fixed_scale else self.fit.pearson / max(1, self.fit.n - len(self.names))

    @property
    def df_resid(self) -> int:
        return self.fit.n - len(self.names)

    @property
    def bread(self) -> np.ndarray:
        """The unscaled covariance: the inverse of X'WX (with the penalty of smooth terms and ridge)."""
        return self.fit.cov

    def fitted(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        """df with the mean on the rows of the fit, the same as predict()."""
        return self.predict(df, name)

    def close(self) -> None:
        """Give up the design frame that the fit kept; robust covariances need it."""
        if self.frame is not None:
            self.frame.close()
            self.frame = None

    def covariance(self) -> np.ndarray:
        return self.scale * self.fit.cov

    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance()), 0.0))

    def robust_covariance(self, kind: str = "HC1") -> np.ndarray:
        """Sandwich covariance HC0 to HC3; leverage is a quadratic form of each row, so nothing is stored."""
        if kind not in ("HC0", "HC1", "HC2", "HC3"):
            raise ValidationError(f"robust covariance is HC0 to HC3, not {kind!r}")
        family, link, beta, bread = self.family, self.link, self.fit.beta, self.fit.cov
        mu_of = _mean_fn(family, link)

        def meat(x, y, w, o):
            mu = mu_of(x @ beta + o)
            g = link.slope_np(mu)
            v = family.variance_np(mu)
            score = w * (y - mu) / (v * g)
            if kind in ("HC2", "HC3"):
                h = np.clip(w / (v * g * g) * np.einsum("ij,jk,ik->i", x, bread, x), 0, 0.9999)
                score = score / np.maximum(1 - h, 0.01) ** (0.5 if kind == "HC2" else 1.0)
            xs = x * score[:, None]
            return (xs.T @ xs).ravel()

        p = len(self.names)
        out = bread @ self.frame.sums(meat, p * p).reshape(p, p) @ bread
        return out * self.fit.n / (self.fit.n - p) if kind == "HC1" else out

    def coef_table(self, level: float = 0.95, robust: str | None = None, t: bool = False) -> list[dict]:
        """Estimate, standard error, z, p, interval and stars of each coefficient."""
        cov = self.robust_covariance(robust) if robust else self.covariance()
        se = np.sqrt(np.maximum(np.diag(cov), 0.0))
        q = normal_quantile(0.5 + level / 2)
        out = []
        for name, b, s in zip(self.names, self.fit.beta, se, strict=True):
            z, pv = (b / s, 2 * normal_cdf(-abs(b / s))) if s > 1e-10 else (0.0, math.nan)
            if t and s > 1e-10:
                pv = t_sf2(z, self.fit.n - len(self.names))
            stars = "***" if pv < 0.001 else "**" if pv < 0.01 else "*" if pv < 0.05 else "." if pv < 0.1 else ""
            out.append({"feature": name, "estimate": float(b), "std_error": float(s), "z": float(z), "p_value": float(pv), "low": float(b - q * s), "high": float(b + q * s), "signif": stars})
        return out

    def relativities(self, level: float = 0.95) -> list[dict]:
        """exp of the coefficients and their intervals; for log links only."""
        if self.link.name != "log":
            raise ValidationError("relativities are for log links")
        return [{"feature": r["feature"], "relativity": math.exp(r["estimate"]), "low": math.exp(r["low"]), "high": math.exp(r["high"])} for r in self.coef_table(level)]

    def selected(self) -> list[str]:
        return [n for n, b in self.params.items() if abs(b) > 1e-10]

    def eta(self, df: DataFrame) -> DataFrame:
        """df with the design in _x and the linear predictor, offset included, in _eta."""
        out = self.spec.design(df)
        o = F.lit(0.0) if self.offset is None else F.col(self.offset).cast("double")
        return out.withColumn("_eta", _dot(self.fit.beta) + (F.log(o) if self.is_exposure else o))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the mean; a projection without any action."""
        out = self.eta(df).withColumn(name, self.link.inverse(F.col("_eta")))
        return out.select(*df.columns, name)

    def residuals(self, df: DataFrame, kind: str = "deviance", name: str = "residual") -> DataFrame:
        out = self.predict(df, "_mu")
        return out.withColumn(name, residual(self.family, kind, F.col(self.spec.response).cast("double"), F.col("_mu"))).drop("_mu")

    def compute_loss(self, df: DataFrame, weight: Column | None = None) -> float:
        kind = metrics.family_loss(self.family)
        own = {"theta": self.family.parameter} if kind == "negbinomial" else {"var_power": self.family.parameter} if kind == "tweedie" else {}
        return self.predict(df, "_mu").agg(metrics.loss(kind, F.col(self.spec.response).cast("double"), F.col("_mu"), weight, **own)).first()[0]

    def wald(self, variable: str) -> dict:
        """Joint test of all coefficients of terms that use a variable."""
        own = [i for t, a, b in self.spec.slices() if variable in t.variables for i in range(a, b)]
        if not own:
            raise ValidationError(f"no term uses {variable!r}")
        b, c = self.fit.beta[own], self.covariance()[np.ix_(own, own)]
        stat = float(b @ np.linalg.pinv(c) @ b)
        return {"variable": variable, "chi2": stat, "df": len(own), "p_value": chi2_sf(stat, len(own))}

    def smooth_terms(self) -> list[dict]:
        """Each smooth term with its effective degrees of freedom, which its Wald test takes as reference, and what is odd about it."""
        out = []
        own = [(t, a, b) for t, a, b in self.spec.slices() if t.is_smooth]
        for (t, a, b), lam in zip(own, self.fit.lambdas, strict=True):
            beta, cov = self.fit.beta[a:b], self.covariance()[a:b, a:b]
            edf = float(sum(self.fit.edf_each[a:b]))
            chi2 = float(beta @ np.linalg.pinv(cov) @ beta)
            p = chi2_sf(chi2, edf) if chi2 > 0 and edf > 0 else 1.0
            name, k = t.variables[0], t.state["n"]
            warning = None
            if p > 0.05:
                warning = f"the smooth term of {name} is not significant (p = {p:.3f}, edf {edf:.1f}): a linear term or none may do"
            elif edf > k - 1.5:
                warning = f"the smooth term of {name} uses nearly all it has (edf {edf:.1f} of {k}): a larger k may be needed"
            out.append({"variable": name, "k": k, "edf": edf, "lambda": lam, "ref_df": edf, "chi2": chi2, "p_value": p, "warning": warning})
        return out

    def score_test(self, df: DataFrame, z: Column) -> dict:
        """Rao test of a numeric column that the model lacks, on the rows of the fit: a pass for z's mean and one for U, z'Wz and X'Wz."""
        scored = self.eta(df).withColumn("_mu", self.family.clamp(self.link.inverse(F.col("_eta"))))
        g = self.link.slope(F.col("_mu"))
        v = self.family.variance(F.col("_mu"))
        w = (F.lit(1.0) if self.weights is None else F.col(self.weights)) / (v * g * g)
        y = F.col(self.spec.response).cast("double")
        wx = F.transform("_x", lambda x: w * x)
        return self.score_of(scored.select(z.cast("double").alias("_z"), (w * g * (y - F.col("_mu"))).alias("_u"), w.alias("_w"), wx.alias("_wx")))

    def score_of(self, sums: DataFrame) -> dict:
        """The same from rows, or sums over rows of equal _z, of the score's weight _u, the weight _w and the weighted design _wx.

        z is taken less its weighted mean where there is an intercept: the statistic is the same, as nothing penalises
        an intercept, and sums of a z far from 0 would lose its variance to rounding.
        """
        z = F.coalesce("_z", F.lit(0.0))
        mean = sums.agg(F.sum(F.col("_w") * z) / F.sum("_w")).first()[0] if self.spec.intercept else None
        z = z - F.lit(mean or 0.0)
        cross = [F.sum(z * F.get("_wx", F.lit(j))) for j in range(len(self.names))]
        row = sums.agg(F.sum(F.col("_u") * z), F.sum(F.col("_w") * z * z), *cross).first()
        u, zz, xz = row[0], row[1], np.array(row[2:])
        info = (zz - xz @ self.fit.cov @ xz) * self.scale
        stat = u * u / info if info > 1e-10 else 0.0
        return {"statistic": float(stat), "df": 1, "p_value": chi2_sf(stat, 1)}

    def likelihood_ratio(self, null_deviance: float) -> dict:
        chi2, df = (null_deviance - self.fit.deviance) / self.scale, len(self.names) - int(self.spec.intercept)
        return {"chi2": chi2, "df": df, "p_value": chi2_sf(chi2, df), "deviance_reduction_pct": 100 * (1 - self.fit.deviance / null_deviance)}

    def to_json(self) -> str:
        """The model as JSON; nothing in it is code."""
        f = self.fit
        return json.dumps({
            "version": STATE_VERSION, "spec": self.spec.state(), "family": self.family.name, "parameter": self.family.parameter, "link": self.link.name,
            "beta": f.beta.tolist(), "cov": f.cov.tolist(), "deviance": f.deviance, "pearson": f.pearson, "n": f.n, "sum_w": f.sum_w, "iterations": f.iterations,
            "converged": f.converged, "edf": f.edf, "lambdas": f.lambdas, "edf_each": f.edf_each, "names": self.names, "alpha": self.alpha, "l1_ratio": self.l1_ratio,
            "offset": self.offset, "is_exposure": self.is_exposure, "weights": self.weights,
        })

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Model:
        d = json.loads(text)
        if d.get("version") != STATE_VERSION:
            raise SerializationError(f"version {d.get('version')!r} of a stored model cannot be read; {STATE_VERSION} can")
        own = d["parameter"]
        family = get_family(d["family"], own or 1.0, own if own is not None else 1.5)
        fit = Fit(np.array(d["beta"]), np.array(d["cov"]), d["deviance"], d["pearson"], d["n"], d["sum_w"], d["iterations"], d["converged"], d["edf"], d["lambdas"], d.get("edf_each", []))
        return cls(ModelSpec.from_state(spark, d["spec"]), family, get_link(d["link"]), fit, d["names"], d["alpha"], d["l1_ratio"], d["offset"], d["is_exposure"], d["weights"])

    def summary_relativities(self, level: float = 0.95) -> str:
        """Fixed-width text of the relativities."""
        rows = [f"Rows {self.fit.n}, deviance {self.fit.deviance:.4f}", f"{'':<30}{'Coef':>10}{'Relativity':>12}{f'{100 * level:g}% from':>12}{'to':>10}{'Pr(>|z|)':>12}"]
        for r, c in zip(self.relativities(level), self.coef_table(level), strict=True):
            p = "<0.0001" if c["p_value"] < 0.0001 else f"{c['p_value']:.4f}"
            rows.append(f"{r['feature']:<30}{c['estimate']:>10.4f}{r['relativity']:>12.4f}{r['low']:>12.4f}{r['high']:>10.4f}{p:>12} {c['signif']}")
        return "\n".join([*rows, "A relativity is exp(coefficient): above 1 it raises the mean."])

    def summary(self) -> str:
        """Fixed-width text of the fit and its coefficients."""
        f = self.fit
        head = [
            f"Family {self.family.name}, link {self.link.name}; rows {f.n}, parameters {len(self.names)}, effective {f.edf:.2f}",
            f"Deviance {f.deviance:.4f}, Pearson chi2 {f.pearson:.4f}, scale {self.scale:.6f}, iterations {f.iterations}, converged {f.converged}",
        ]
        rows = [f"{'':<30}{'Estimate':>12}{'Std.Error':>12}{'z':>10}{'Pr(>|z|)':>12}"]
        rows += [f"{r['feature']:<30}{r['estimate']:>12.6f}{r['std_error']:>12.6f}{r['z']:>10.3f}{r['p_value']:>12.4g} {r['signif']}" for r in self.coef_table()]
        return "\n".join(head + rows)
