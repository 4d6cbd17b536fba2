"""Links: the same formulas as Spark Columns and as numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.errors import ValidationError

#: The linear predictor of a log link is held within these bounds.
ETA_BOUND = 700.0


@dataclass(frozen=True)
class Link:
    """g, its inverse and its derivative; the *_np fields take arrays."""

    name: str
    link: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    link_np: Callable[[np.ndarray], np.ndarray]
    inverse_np: Callable[[np.ndarray], np.ndarray]
    slope_np: Callable[[np.ndarray], np.ndarray]


def _bounded(eta: Column) -> Column:
    return F.greatest(F.least(eta, F.lit(ETA_BOUND)), F.lit(-ETA_BOUND))


def _sigmoid(eta: Column) -> Column:
    return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))


def _sigmoid_np(eta: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(eta))
    return np.where(eta >= 0, 1 / (1 + e), e / (1 + e))


LINKS = {
    link.name: link
    for link in (
        Link("identity", lambda m: m, lambda e: e, lambda m: F.lit(1.0), lambda m: m, lambda e: e, np.ones_like),
        Link(
            "log", F.log, lambda e: F.exp(_bounded(e)), lambda m: 1 / m,
            np.log, lambda e: np.exp(np.clip(e, -ETA_BOUND, ETA_BOUND)), lambda m: 1 / m,
        ),
        Link(
            "logit", lambda m: F.log(m / (1 - m)), _sigmoid, lambda m: 1 / (m * (1 - m)),
            lambda m: np.log(m / (1 - m)), _sigmoid_np, lambda m: 1 / (m * (1 - m)),
        ),
        Link("inverse", lambda m: 1 / m, lambda e: 1 / e, lambda m: -1 / (m * m), lambda m: 1 / m, lambda e: 1 / e, lambda m: -1 / (m * m)),
    )
}


def register_link(link: Link) -> Link:
    """Make a link known by its name, which models may then be given."""
    LINKS[link.name] = link
    return link


def get_link(name: str) -> Link:
    if name not in LINKS:
        raise ValidationError(f"unknown link {name!r}; one of {', '.join(LINKS)}")
    return LINKS[name]
