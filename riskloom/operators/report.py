"""Composite reports: each table is one of the operators' queries, gathered as plain values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.families import residual
from riskloom.functions.special import chi2_sf, f_sf
from riskloom.operators import diagnostics, explore, factors, metrics, quantiles, ranking
from riskloom.operators.prefix import keep, released


def rows(df: DataFrame) -> list[dict]:
    """A small table as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def recommendation(a: str, b: str, categorical: set[str], smooth: set[str] | frozenset[str] = frozenset()) -> str:
    """How an interaction of two factors may be modelled."""
    factors_, numbers = [x for x in (a, b) if x in categorical], [x for x in (a, b) if x not in categorical]
    if len(factors_) == 2:
        return f"an interaction of the levels of {a} and {b}"
    if factors_:
        other = f" or a spline of {numbers[0]} for each level of {factors_[0]}" if numbers[0] in smooth else ""
        return f"a slope of {numbers[0]} for each level of {factors_[0]}{other}"
    return f"a product of {a} and {b} or {'a tensor product of splines' if {a, b} & smooth else 'a joint spline'}"


def _strongest(df: DataFrame, categorical: list[str], continuous: list[str], value: Column, weight: Column | None, most: int, smooth: set[str]) -> list[dict]:
    """The pairs whose cells explain most of value, all from one aggregate."""
    coded = {c: quantiles.discretized(df, F.col(c)) for c in continuous} | {c: factors.level(F.col(c)) for c in categorical}
    if len(coded) < 2:
        return []
    best = factors.interaction_strengths(df, coded, value, weight).orderBy(F.col("r2").desc(), "a", "b").limit(most)
    return [r | {"recommendation": recommendation(r["a"], r["b"], set(categorical), smooth)} for r in rows(best)]


def explore_data(
    data: DataFrame, response: str, categorical: list[str] | None = None, continuous: list[str] | None = None, exposure: str | None = None, family: str = "poisson",
    n_bins: int = 10, rare_pct: float = 1.0, max_levels: int = 20, detect_interactions: bool = True, max_candidates: int = 5,
) -> dict:
    """What is worth knowing before a fit; every entry but lists of names is a table of plain values."""
    with released():
        return _explored(data, response, categorical or [], continuous or [], exposure, family, n_bins, rare_pct, max_levels, detect_interactions, max_candidates)


def _explored(data, response, categorical, continuous, exposure, family, n_bins, rare_pct, max_levels, detect_interactions, max_candidates) -> dict:
    y, e = F.col(response).cast("double"), F.col(exposure).cast("double") if exposure else F.lit(1.0)
    df = keep(data.select(*{response, *categorical, *continuous, *([exposure] if exposure else [])}))
    out: dict = {"response": rows(explore.response_stats(df, y, e))[0], "missing": rows(explore.missing(df, [response, *categorical, *continuous]))}
    if family in ("poisson", "quasipoisson", "negbinomial"):
        out["zero_inflation"] = rows(metrics.zero_inflation(df, y))[0]
        mean, var = df.agg(F.avg(y), F.var_samp(y)).first()
        out["overdispersion"] = metrics.overdispersion(var / mean) if mean else None
    out["factors"] = {}
    for c in continuous:
        table = sorted(rows(explore.continuous_table(df, F.col(c), y, e, n_bins, rare_pct)), key=lambda r: r["bin"])
        uni = rows(explore.weighted_correlation(df, F.col(c), y, e))[0]
        uni["p_value"] = f_sf(uni["f_statistic"], 1, uni["n"] - 2)
        out["factors"][c] = {"stats": rows(factors.continuous_stats(df, F.col(c)))[0], "bins": table, "shape": explore.shape_hint([r["rate"] for r in table]), "univariate": uni}
    patterns = {r["factor"]: r["pattern"] for r in rows(explore.ordinal_pattern(df, categorical))} if categorical else {}
    for c in categorical:
        table = rows(factors.ae_by_level(df, F.col(c), y, e, e, rare_pct, max_levels, "mse"))
        uni = rows(factors.eta_squared(df, F.col(c), y / e, e))[0]
        uni["p_value"] = f_sf(uni["f_statistic"], uni["k"] - 1, uni["n"] - uni["k"])
        base = max((r for r in table if r["level"] != factors.OTHER), key=lambda r: r["exposure"], default=None)
        rare = rows(factors.rare_levels(df, F.col(c), rare_pct))[0]
        out["factors"][c] = {"levels": table, "rare": rare, "suggested_base": base and base["level"], "ordinal_pattern": patterns.get(c), "univariate": uni}
    if len(continuous) > 1:
        out["correlations"], out["vif"] = rows(explore.correlation_matrix(df, continuous)), rows(explore.vif(df, continuous))
    if len(categorical) > 1:
        out["cramers_v"] = rows(explore.cramers_v(df, categorical))
    if detect_interactions and len(categorical) + len(continuous) > 1:
        out["interactions"] = _strongest(df, categorical, continuous, y / e, e, max_candidates, set())
    return out


def dataset_report(df: DataFrame, model, y: Column, mu: Column, e: Column, key: Column, categorical: list[str], continuous: list[str]) -> dict:
    """Metrics, deciles and factor tables of one scored frame."""
    return {
        "metrics": rows(metrics.dataset_metrics(df, model.family, y, mu, len(model.names)))[0],
        "total": rows(metrics.calibration_total(df, y, mu, e))[0],
        "discrimination": rows(ranking.discrimination(df, y, mu, e, key))[0],
        "deciles": sorted(rows(ranking.decile_table(df, y, mu, e, key)), key=lambda r: r["bin"]),
        "levels": {c: rows(factors.level_metrics(df, F.col(c), model.family, y, mu, e)) for c in categorical},
        "bands": {c: rows(factors.band_metrics(df, F.col(c), model.family, y, mu, e)) for c in continuous},
    }


def calibration_report(df: DataFrame, y: Column, mu: Column, e: Column, key: Column) -> dict:
    """Bins, Hosmer-Lemeshow and the deciles that are off by over a tenth."""
    bins = sorted(rows(ranking.calibration_bins(df, y, mu, e, key)), key=lambda r: r["bin"])
    chi2 = sum((b["actual"] - b["expected"]) ** 2 / b["expected"] for b in bins if b["expected"] > 0)
    degrees = max(len(bins) - 2, 1)
    return {"bins": bins, "hosmer_lemeshow": {"chi2": chi2, "df": degrees, "p_value": chi2_sf(chi2, degrees)}, "problems": [b["bin"] for b in bins if not 0.9 <= b["ae"] <= 1.1]}


def _scored(model, data: DataFrame, exposure: str | None, key: str, base: str | None, more: list[str]) -> DataFrame:
    names = {model.spec.response, key, *more, *model.spec.inputs(), *([model.offset] if model.offset else []), *([exposure] if exposure else []), *([base] if base else [])}
    return keep(model.predict(data.select(*sorted(names)), "_mu"))


def diagnose(
    model, train: DataFrame, key: str, categorical: list[str] | None = None, continuous: list[str] | None = None, exposure: str | None = None,
    test: DataFrame | None = None, base: str | None = None,
) -> dict:
    """What is worth knowing after a fit. key is a unique column, which decides ties of the prediction."""
    with released():
        return _diagnosed(model, train, key, categorical or [], continuous or [], exposure, test, base)


def _diagnosed(model, train: DataFrame, key: str, categorical: list[str], continuous: list[str], exposure: str | None, test: DataFrame | None, base: str | None) -> dict:
    exposure = exposure or (model.offset if model.is_exposure else None)
    df = _scored(model, train, exposure, key, base, categorical + continuous)
    y, mu, e, k = F.col(model.spec.response).cast("double"), F.col("_mu"), F.col(exposure).cast("double") if exposure else F.lit(1.0), F.col(key)
    r = residual(model.family, "deviance", y, mu)
    out: dict = {"train": dataset_report(df, model, y, mu, e, k, categorical, continuous), "calibration": calibration_report(df, y, mu, e, k), "residuals": rows(metrics.residual_summary(df, r))[0]}
    null = metrics.null_deviance(df, model.family, y, None, F.log(e) if exposure else None).first()[0]
    out["comparison"] = model.likelihood_ratio(null)
    chart = keep(ranking.lift_chart(df, y, mu, e, k))
    out["lift"] = sorted(rows(chart), key=lambda x: x["bin"])
    out["lift_summary"] = ranking.lift_summary(chart)
    out["lorenz"] = sorted(rows(ranking.lorenz(df, y, mu, e, k)), key=lambda x: x["step"])
    fitted = set(model.spec.inputs())
    out["factors"] = {}
    for c in categorical + continuous:
        is_cat = c in categorical
        own: dict = {"in_model": c in fitted}
        own["ae"] = rows(factors.ae_by_level(df, F.col(c), y, mu, e) if is_cat else factors.ae_by_bin(df, F.col(c), y, mu, e))
        if is_cat:
            own["residual_pattern"] = rows(factors.eta_squared(df, F.col(c), r))[0]
            own["deviance"] = rows(factors.factor_deviance(df, F.col(c), model.family, y, mu))
            own["partial_dependence"] = rows(factors.partial_dependence_levels(df, F.col(c), mu))
            own["variation"] = factors.variation([x["prediction"] for x in own["partial_dependence"]])
        else:
            trend, bins = factors.residual_pattern_continuous(df, F.col(c), r, k)
            own["residual_pattern"] = {**rows(trend)[0], "bins": rows(bins)}
            if c in fitted:
                curve = partial_dependence(model, train, c)
                own["partial_dependence"], own["shape"] = curve, factors.effect_shape([x["prediction"] for x in curve])
        if c in fitted:
            own["test"] = model.wald(c)
            names = {n for t, i, j in model.spec.slices() if c in t.variables for n in model.names[i:j]}
            own["coefficients"] = [x for x in model.coef_table() if x["feature"] in names]
        elif is_cat:
            own["test"] = diagnostics.score_test_encoded(model, train, F.col(c), e if exposure else None)
        else:
            own["test"] = model.score_test(train, F.col(c))
        out["factors"][c] = own
    smooth = {t.variables[0] for t in model.spec.terms if t.kind in ("bs", "ns")}
    out["interactions"] = _strongest(df, categorical, continuous, r, None, 5, smooth)
    out["coefficients"] = diagnostics.sorted_coefficients(model)
    out["vif"] = diagnostics.design_vif(train, model.spec) if len(model.names) > 1 else []
    out["smooth_terms"] = model.smooth_terms()
    ratio = out["train"]["metrics"]["dispersion"]
    if model.family.name in ("poisson", "binomial"):
        out["overdispersion"] = metrics.overdispersion(ratio, max(1, model.fit.n - len(model.names)))
    if base:
        b = F.col(base)
        both = {n: {"loss": df.agg(metrics.loss(metrics.family_loss(model.family), y, c)).first()[0], **rows(ranking.discrimination(df, y, c, e, k))[0], **rows(metrics.calibration_total(df, y, c, e))[0]} for n, c in (("model", mu), ("base", b))}
        out["base"] = both | {"deciles": sorted(rows(ranking.ratio_deciles(df, y, mu, b, e, k)), key=lambda x: x["bin"])}
    if test is not None:
        other = _scored(model, test, exposure, key, None, categorical + continuous)
        out["test"] = dataset_report(other, model, y, mu, e, k, categorical, continuous)
        gap = out["train"]["discrimination"]["gini"] - out["test"]["discrimination"]["gini"]
        ae = out["test"]["total"]["ae"]
        unstable = {c: [x for x in rows(factors.level_union(df, other, F.col(c), y, mu)) if x["is_unstable"]] for c in categorical}
        out["train_test"] = {"gini_gap": gap, "overfit": gap > 0.03, "ae_drift": not 0.95 <= ae <= 1.05, "unstable_levels": unstable}
    out["warnings"] = _warnings(model, out, ratio)
    return out


def _warnings(model, report: dict, ratio: float) -> list[str]:
    found = []
    if model.family.name == "poisson" and ratio > 1.5:
        found.append(f"dispersion is {ratio:.2f}: consider quasipoisson or negbinomial")
    ae = report["train"]["total"]["ae"]
    if abs(ae - 1) > 0.05:
        found.append(f"actual over expected is {ae:.3f} in all")
    for c, own in report["factors"].items():
        pattern = own["residual_pattern"]
        share = pattern.get("eta_squared", pattern.get("r2")) or 0.0
        if not own["in_model"] and share > 0.02:
            found.append(f"{c} is not in the model and explains {100 * share:.1f} % of the residuals")
    found += [t["warning"] for t in report["smooth_terms"] if t["warning"]]
    if model.family.name == "negbinomial" and not 0.05 <= model.family.parameter <= 500:
        found.append(f"theta is {model.family.parameter:.3g}: the data look {'Poisson' if model.family.parameter > 1 else 'extremely dispersed'}")
    return found


def partial_dependence(model, data: DataFrame, variable: str, points: int = 20) -> list[dict]:
    """Mean prediction with a numeric variable set to each of a grid between its 1st and 99th percentile.

    One pass: each row is scored at all grid values as an explode of literals.
    """
    low, high = quantiles.linear(data, F.col(variable), [0.01, 0.99])
    grid = [low + (high - low) * k / (points - 1) for k in range(points)]
    wide = data.drop(variable).withColumn(variable, F.explode(F.array(*map(F.lit, grid))))
    table = model.predict(wide, "_mu").groupBy(variable).agg(F.avg("_mu").alias("prediction")).orderBy(variable)
    return [{"value": r[0], "prediction": r[1]} for r in table.collect()]


