"""Links, families, special functions and expressions against literals and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.functions.families import get_family, residual
from riskloom.functions.links import LINKS, get_link
from riskloom.functions.special import beta_i, chi2_sf, f_sf, gamma_p, lgamma_col, normal_quantile, t_sf2
from riskloom.operators import metrics
from riskloom.plans.spec import expression

FAMILIES = [("gaussian", {}), ("poisson", {}), ("binomial", {}), ("gamma", {}), ("tweedie", {"var_power": 1.5}), ("negbinomial", {"theta": 2.0}), ("quasipoisson", {}), ("quasibinomial", {})]


def test_distributions():
    assert abs(beta_i(2, 3, 0.4) - 0.5248) < 1e-12
    assert abs(gamma_p(2.5, 3.0) - 0.6937810816221104) < 1e-10
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(t_sf2(2.0, 10) - 0.07338803) < 1e-7
    assert abs(f_sf(3.0, 2, 20) - 0.07253815) < 1e-7
    assert abs(normal_quantile(0.975) - 1.959963984540054) < 1e-9


def test_lgamma(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 171.0, 1e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(lgamma_col(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("name", list(LINKS))
def test_link_round_trip(spark, name):
    link, mu = LINKS[name], np.array([0.1, 0.4, 0.9])
    df = spark.createDataFrame([(float(m),) for m in mu], "m double")
    row = df.select(link.link(F.col("m")), link.inverse(link.link(F.col("m"))), link.slope(F.col("m")).cast("double")).collect()
    assert np.allclose([r[0] for r in row], link.link_np(mu))
    assert np.allclose([r[1] for r in row], mu)
    assert np.allclose([r[2] for r in row], link.slope_np(mu))


@pytest.mark.parametrize("name,options", FAMILIES)
def test_family_columns_are_the_numpy_forms(spark, name, options):
    f = get_family(name, **options)
    y = np.array([0.0, 1.0, 1.0, 0.0]) if f.bounded else np.array([0.5, 1.0, 7.0, 3.0]) if f.strict_y else np.array([0.0, 1.0, 7.0, 3.0])
    mu = np.array([0.2, 0.7, 0.999, 0.5]) if f.bounded else np.array([0.4, 1.0, 3.0, 9.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, mu, strict=True)], "y double, m double")
    rows = df.select(f.deviance(F.col("y"), F.col("m")), f.variance(F.col("m")).cast("double"), residual(f, "pearson", F.col("y"), F.col("m"))).collect()
    assert np.allclose([r[0] for r in rows], f.deviance_np(y, mu))
    assert np.allclose([r[1] for r in rows], f.variance_np(mu))
    assert np.allclose([r[2] for r in rows], (y - mu) / np.sqrt(f.variance_np(mu)))


def test_unknown_names_raise():
    for call in (lambda: get_family("cauchy"), lambda: get_link("probit"), lambda: get_family("tweedie", var_power=0.5), lambda: get_family("negbinomial", theta=0)):
        with pytest.raises(ValidationError):
            call()


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 1.1, 1.0), (2.0, 2.0, 1.0), (3.0, 2.9, 1.0), (4.0, 4.2, 1.0), (5.0, 4.8, 1.0)], "y double, m double, w double")
    y, m = F.col("y"), F.col("m")
    assert abs(df.agg(metrics.loss("mse", y, m)).first()[0] - 0.02) < 1e-12
    assert df.agg(metrics.loss("mse", y, m, F.lit(0.0))).first()[0] == 0.0
    two = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 2.0, 3.0)], "y double, m double, w double")
    assert two.agg(metrics.loss("mse", y, m, F.col("w"))).first()[0] == 0.25


def test_expressions(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    for text, value in {"a / (b ** 2)": 2 / 9, "a * b - 1": 5.0, "-a + b": 1.0, "a ** b": 8.0, "a": 2.0}.items():
        assert abs(df.select(expression(text)).first()[0] - value) < 1e-12
    for bad in ("__import__('os')", "a.b", "a if b else 1", "f(a)", "a +", "'x'"):
        with pytest.raises(ValidationError):
            expression(bad)
