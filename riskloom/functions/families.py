"""Response families: variance, deviance, starting means and log-likelihood as Columns and numpy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.functions.special import lgamma_col

#: Least mean of positive families, and distance from 0 and 1 of a binomial's.
MU_FLOOR = 1e-10


@dataclass(frozen=True)
class Family:
    """One response family; parameters (a Tweedie power, a negative binomial theta) are bound in."""

    name: str
    default_link: str
    variance: Callable[[Column], Column]
    variance_np: Callable[[np.ndarray], np.ndarray]
    deviance: Callable[[Column, Column], Column]
    deviance_np: Callable[[np.ndarray, np.ndarray], np.ndarray]
    start_np: Callable[[np.ndarray, float], np.ndarray]
    fixed_scale: bool = False
    positive: bool = True
    parameter: float | None = None
    least_y: float | None = None
    strict_y: bool = False
    most_y: float | None = None
    log_exposure: bool = False

    @property
    def bounded(self) -> bool:
        return self.most_y is not None

    def clamp(self, mu: Column) -> Column:
        if self.bounded:
            return F.greatest(F.least(mu, F.lit(1 - MU_FLOOR)), F.lit(MU_FLOOR))
        return F.greatest(mu, F.lit(MU_FLOOR)) if self.positive else mu

    def clamp_np(self, mu: np.ndarray) -> np.ndarray:
        if self.bounded:
            return np.clip(mu, MU_FLOOR, 1 - MU_FLOOR)
        return np.maximum(mu, MU_FLOOR) if self.positive else mu


def _xlogy(x: Column, ratio: Column) -> Column:
    return F.when(x > 0, x * F.log(ratio)).otherwise(0.0)


def _xlogy_np(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, ratio, 1.0)), 0.0)


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(MU_FLOOR))


def _poisson_dev(y: Column, m: Column) -> Column:
    m = _positive(m)
    return F.when(y > 0, 2 * (y * F.log(y / m) - (y - m))).otherwise(2 * m)


def _poisson_dev_np(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    m = np.maximum(m, MU_FLOOR)
    return 2 * (_xlogy_np(y, y / m) - (y - m))


def _binomial_dev(y: Column, m: Column) -> Column:
    m = F.greatest(F.least(m, F.lit(1 - MU_FLOOR)), F.lit(MU_FLOOR))
    return 2 * (_xlogy(y, y / m) + _xlogy(1 - y, (1 - y) / (1 - m)))


def _binomial_dev_np(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    m = np.clip(m, MU_FLOOR, 1 - MU_FLOOR)
    return 2 * (_xlogy_np(y, y / m) + _xlogy_np(1 - y, (1 - y) / (1 - m)))


def _gamma_dev(y: Column, m: Column) -> Column:
    r = _positive(y) / _positive(m)
    return 2 * (r - 1 - F.log(r))


def _gamma_dev_np(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    r = np.maximum(y, MU_FLOOR) / np.maximum(m, MU_FLOOR)
    return 2 * (r - 1 - np.log(r))


def _tweedie(p: float) -> Family:
    if p < 0 or 0 < p < 1:
        raise ValidationError(f"no Tweedie family has the power {p}")
    if p in (0, 1, 2):
        like = {0: FAMILIES["gaussian"], 1: FAMILIES["poisson"], 2: FAMILIES["gamma"]}[int(p)]
        dev, dev_np = like.deviance, like.deviance_np
    else:

        def dev(y: Column, m: Column) -> Column:
            m = _positive(m)
            whole = F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p)) - y * F.pow(m, F.lit(1 - p)) / (1 - p) + F.pow(m, F.lit(2 - p)) / (2 - p)
            return F.when(y > 0, 2 * whole).otherwise(2 * F.pow(m, F.lit(2 - p)) / (2 - p))

        def dev_np(y: np.ndarray, m: np.ndarray) -> np.ndarray:
            m = np.maximum(m, MU_FLOOR)
            first = np.where(y > 0, np.where(y > 0, y, 1.0) ** (2 - p) / ((1 - p) * (2 - p)), 0.0)
            return 2 * (first - y * m ** (1 - p) / (1 - p) + m ** (2 - p) / (2 - p))

    return Family(
        "tweedie", "log", lambda m: F.greatest(F.pow(m, F.lit(p)), F.lit(1e-10)), lambda m: np.maximum(m**p, 1e-10), dev, dev_np,
        lambda y, mean: np.maximum((y + max(mean, 0.1)) / 2, 0.001), parameter=p, least_y=0.0, strict_y=p >= 2, log_exposure=True,
    )


def _negbinomial(theta: float) -> Family:
    if theta <= 0:
        raise ValidationError("theta must be positive")

    def dev(y: Column, m: Column) -> Column:
        m = _positive(m)
        return 2 * (_xlogy(y, y / m) - (y + theta) * F.log((y + theta) / (m + theta)))

    def dev_np(y: np.ndarray, m: np.ndarray) -> np.ndarray:
        m = np.maximum(m, MU_FLOOR)
        return 2 * (_xlogy_np(y, y / m) - (y + theta) * np.log((y + theta) / (m + theta)))

    return Family(
        "negbinomial", "log", lambda m: m + m * m / theta, lambda m: m + m * m / theta, dev, dev_np,
        lambda y, mean: np.maximum(y + 0.1, 0.1), parameter=theta, least_y=0.0, log_exposure=True,
    )


FAMILIES = {
    "gaussian": Family(
        "gaussian", "identity", lambda m: F.lit(1.0), np.ones_like, lambda y, m: (y - m) * (y - m), lambda y, m: (y - m) ** 2,
        lambda y, mean: y.copy(), positive=False,
    ),
    "poisson": Family(
        "poisson", "log", lambda m: m, lambda m: m, _poisson_dev, _poisson_dev_np, lambda y, mean: np.maximum(y + 0.1, 0.1),
        fixed_scale=True, least_y=0.0, log_exposure=True,
    ),
    "binomial": Family(
        "binomial", "logit", lambda m: m * (1 - m), lambda m: m * (1 - m), _binomial_dev, _binomial_dev_np, lambda y, mean: (y + 0.5) / 2,
        fixed_scale=True, least_y=0.0, most_y=1.0,
    ),
    "gamma": Family(
        "gamma", "log", lambda m: m * m, lambda m: m * m, _gamma_dev, _gamma_dev_np, lambda y, mean: np.maximum(y, 0.01 * mean),
        least_y=0.0, strict_y=True, log_exposure=True,
    ),
    "quasipoisson": Family(
        "quasipoisson", "log", lambda m: m, lambda m: m, _poisson_dev, _poisson_dev_np, lambda y, mean: np.maximum(y + 0.1, 0.1),
        least_y=0.0, log_exposure=True,
    ),
    "quasibinomial": Family(
        "quasibinomial", "logit", lambda m: m * (1 - m), lambda m: m * (1 - m), _binomial_dev, _binomial_dev_np, lambda y, mean: (y + 0.5) / 2,
        least_y=0.0, most_y=1.0,
    ),
}
ALIASES = {"normal": "gaussian", "logistic": "binomial", "quasi_poisson": "quasipoisson", "quasi_binomial": "quasibinomial", "negative_binomial": "negbinomial", "nb": "negbinomial"}


def register_family(family: Family, *aliases: str) -> Family:
    """Make a family known by its name (in lower case) and aliases, which models may then be given."""
    FAMILIES[family.name] = family
    ALIASES.update(dict.fromkeys(aliases, family.name))
    return family


def get_family(name: str, theta: float = 1.0, var_power: float = 1.5) -> Family:
    """A family by name or alias; theta and var_power are those of the two that have a parameter."""
    name = ALIASES.get(name.lower(), name.lower())
    if name == "tweedie":
        return _tweedie(var_power)
    if name == "negbinomial":
        return _negbinomial(theta)
    if name not in FAMILIES:
        raise ValidationError(f"unknown family {name!r}; one of {', '.join([*FAMILIES, 'tweedie', 'negbinomial'])}")
    return FAMILIES[name]


def log_likelihood(family: Family, y: Column, mu: Column, weight: Column, scale: float | Column) -> Column:
    """Sum over rows of the log-likelihood; families without one give minus half the deviance."""
    m = family.clamp(mu)
    if family.name == "gaussian":
        scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
        return F.sum(-0.5 * weight * (F.log(2 * math.pi * scale) + (y - m) * (y - m) / scale))
    if family.name == "poisson":
        return F.sum(weight * (y * F.log(m) - m - lgamma_col(y + 1.0)))
    if family.name == "binomial":
        return F.sum(weight * (y * F.log(m) + (1 - y) * F.log(1 - m)))
    if family.name == "gamma":
        a = F.lit(1.0) / scale if isinstance(scale, (int, float)) else 1 / scale
        return F.sum(weight * ((a - 1) * F.log(_positive(y)) - y * a / m - a * F.log(m / a) - lgamma_col(a)))
    if family.name == "negbinomial":
        t = float(family.parameter)
        return F.sum(weight * (lgamma_col(y + t) - math.lgamma(t) - lgamma_col(y + 1.0) + t * F.log(t / (m + t)) + _xlogy(y, m / (m + t))))
    return -0.5 * F.sum(family.deviance(y, mu))


RESIDUALS = ("response", "pearson", "deviance", "working")


def residual(family: Family, kind: str, y: Column, mu: Column) -> Column:
    """One of RESIDUALS; the working residual is that of the family's default link."""
    from riskloom.functions.links import get_link

    m = family.clamp(mu)
    if kind == "response":
        return y - mu
    if kind == "pearson":
        return (y - mu) / F.greatest(F.sqrt(family.variance(m)), F.lit(1e-10))
    if kind == "deviance":
        return F.when(y > mu, 1.0).otherwise(-1.0) * F.sqrt(F.greatest(family.deviance(y, mu), F.lit(0.0)))
    if kind == "working":
        return (y - mu) * get_link(family.default_link).slope(m)
    raise ValidationError(f"unknown residual {kind!r}; one of {', '.join(RESIDUALS)}")
