"""Losses and whole-dataset statistics of (y, mu)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.functions.families import MU_FLOOR, Family, get_family, log_likelihood
from riskloom.functions.special import chi2_sf

LOSSES = ("mse", "rmse", "mae", "poisson", "gamma", "logloss", "tweedie", "negbinomial")


def unit_loss(kind: str, y: Column, mu: Column, theta: float = 1.0, var_power: float = 1.5) -> Column:
    """Loss of one row; rmse is that of mse before the root."""
    if kind in ("mse", "rmse"):
        return (y - mu) * (y - mu)
    if kind == "mae":
        return F.abs(y - mu)
    if kind == "logloss":
        m = F.greatest(F.least(mu, F.lit(1 - MU_FLOOR)), F.lit(MU_FLOOR))
        return -(y * F.log(m) + (1 - y) * F.log(1 - m))
    if kind in ("poisson", "gamma", "tweedie", "negbinomial"):
        return get_family(kind, theta, var_power).deviance(y, mu)
    raise ValidationError(f"unknown loss {kind!r}; one of {', '.join(LOSSES)}")


def loss(kind: str, y: Column, mu: Column, weight: Column | None = None, **parameters: float) -> Column:
    """Weighted mean of the unit loss as an aggregate; 0 if the weights sum to 0."""
    w = F.lit(1.0) if weight is None else weight
    total, own = F.sum(w), F.sum(w * unit_loss(kind, y, mu, **parameters))
    mean = F.when(total > 0, own / total).otherwise(0.0)
    return F.sqrt(mean) if kind == "rmse" else mean


def family_loss(family: Family) -> str:
    """The loss that a family is judged by; binomial families by log-loss."""
    return {"gaussian": "mse", "poisson": "poisson", "quasipoisson": "poisson", "binomial": "logloss", "quasibinomial": "logloss", "gamma": "gamma"}.get(family.name, family.name)


def deviance(family: Family, y: Column, mu: Column, weight: Column | None = None) -> Column:
    return F.sum((F.lit(1.0) if weight is None else weight) * family.deviance(y, mu))


def pearson_chi2(family: Family, y: Column, mu: Column, weight: Column | None = None) -> Column:
    v = F.greatest(family.variance(family.clamp(mu)), F.lit(1e-10))
    return F.sum((F.lit(1.0) if weight is None else weight) * (y - mu) * (y - mu) / v)


def dataset_metrics(df: DataFrame, family: Family, y: Column, mu: Column, n_params: int, weight: Column | None = None) -> DataFrame:
    """One row: n, deviance, mean deviance, Pearson chi-squared, dispersion, log-likelihood, AIC, BIC."""
    w = F.lit(1.0) if weight is None else weight
    first = df.agg(F.count(F.lit(1)).alias("n"), deviance(family, y, mu, w).alias("deviance"), pearson_chi2(family, y, mu, w).alias("chi2"), F.sum(w * (y - mu) * (y - mu)).alias("sse"))
    row = first.first()
    n, df_resid = row["n"], max(1, row["n"] - n_params)
    scale = 1.0 if family.fixed_scale else max(row["sse"] / df_resid if family.name == "gaussian" else row["deviance"] / df_resid, 1e-10) if n else 1.0
    out = df.agg(
        F.count(F.lit(1)).alias("n"),
        deviance(family, y, mu, w).alias("deviance"),
        pearson_chi2(family, y, mu, w).alias("pearson_chi2"),
        log_likelihood(family, y, mu, w, scale).alias("log_likelihood"),
    )
    ll = F.col("log_likelihood")
    return out.select(
        "n", "deviance", (F.col("deviance") / F.col("n")).alias("mean_deviance"), "pearson_chi2",
        F.when(F.lit(n > n_params), F.col("pearson_chi2") / (F.col("n") - n_params)).otherwise(1.0).alias("dispersion"),
        "log_likelihood", (-2 * ll + 2.0 * n_params).alias("aic"), (-2 * ll + n_params * F.log(F.col("n"))).alias("bic"),
    )


def fit_metrics(df: DataFrame, family: Family, y: Column, mu: Column, n_params: int, weight: Column | None = None, log_offset: Column | None = None) -> DataFrame:
    """dataset_metrics() with the null deviance and the share of it that the model explains."""
    out = dataset_metrics(df, family, y, mu, n_params, weight)
    null = null_deviance(df, family, y, weight, log_offset).first()[0]
    return out.withColumn("null_deviance", F.lit(null).cast("double")).withColumn("deviance_explained", 1 - F.col("deviance") / F.col("null_deviance"))


def null_deviance(df: DataFrame, family: Family, y: Column, weight: Column | None = None, log_offset: Column | None = None) -> DataFrame:
    """Deviance of the mean (of the pooled rate times exposure, given a log offset)."""
    w = F.lit(1.0) if weight is None else weight
    exposure = F.lit(1.0) if log_offset is None else F.exp(log_offset)
    rate = df.agg((F.sum(w * y) / F.sum(w * exposure)).alias("r")).first()["r"]
    return df.agg(deviance(family, y, F.lit(rate) * exposure, w).alias("null_deviance"))


def calibration_total(df: DataFrame, y: Column, mu: Column, exposure: Column) -> DataFrame:
    return df.agg(F.sum(y).alias("actual"), F.sum(mu).alias("expected"), (F.sum(y) / F.sum(mu)).alias("ae"), F.sum(exposure).alias("exposure"))


def moments(df: DataFrame, value: Column) -> DataFrame:
    """mean, population standard deviation, min, max, skewness, excess kurtosis, in one pass; the last two are 0 without variance."""
    out = df.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
    )
    return out.withColumns({k: F.when(F.col("std") > 0, F.col(k)).otherwise(0.0) for k in ("skewness", "kurtosis")})


def residual_summary(df: DataFrame, value: Column) -> DataFrame:
    """moments() with nine percentiles by rounded rank."""
    from riskloom.operators.quantiles import round_rank

    names = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    picked = round_rank(df, value, list(names.values())) or [None] * len(names)
    return moments(df, value).withColumns({k: F.lit(p).cast("double") for k, p in zip(names, picked, strict=True)})


def overdispersion(ratio: float, df_resid: float | None = None) -> dict[str, object]:
    """Severity of a dispersion ratio; with degrees of freedom also the p-value of chi2 = ratio * df."""
    severity = "none" if ratio < 1.5 else "mild" if ratio < 2 else "moderate" if ratio < 5 else "severe"
    out: dict[str, object] = {"ratio": ratio, "severity": severity}
    if df_resid:
        out["p_value"] = chi2_sf(ratio * df_resid, df_resid)
    return out


def zero_inflation(df: DataFrame, y: Column) -> DataFrame:
    """Observed share of zeros against that of a Poisson variable with the same mean, in percent."""
    seen = 100.0 * F.sum(F.when(y == 0, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    return df.agg(seen.alias("observed_zero_pct"), (100.0 * F.exp(-F.avg(y))).alias("expected_zero_pct")).withColumn(
        "excess_pct", F.col("observed_zero_pct") - F.col("expected_zero_pct")
    )

