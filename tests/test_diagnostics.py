"""Diagnostics of designs, terms and reports; exports outside the knots; prefix sums within hot keys; extension points."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import diagnostics, factors, quantiles, report
from riskloom.operators.model import GLM
from riskloom.plans.spec import ModelSpec

LINEAR, FACTOR = {"type": "linear"}, {"type": "categorical"}


def rows(seed=3, n=600):
    g = np.random.default_rng(seed)
    x, z = g.uniform(0, 10, n), g.normal(0, 1, n)
    f = g.choice(["a", "b", "c", "d"], n, p=[0.6, 0.2, 0.15, 0.05])
    mu = np.exp(0.2 + 0.3 * np.sin(x) + 0.2 * z + 0.4 * (f == "b"))
    return [(k, float(g.poisson(m)), float(a), float(b), str(c)) for k, (m, a, b, c) in enumerate(zip(mu, x, z, f))]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id long, y double, x double, z double, f string").repartition(3, "id").cache()


def test_score_tests_of_factors(data):
    """Against matrices of the whole data."""
    m = GLM("y", {"x": LINEAR}, data, family="poisson").fit()
    got = diagnostics.score_test_levels(m, data, F.col("f"))
    r = rows()
    y, x, f = np.array([a[1] for a in r]), np.array([[1.0, a[2]] for a in r]), np.array([a[4] for a in r])
    mu = np.exp(x @ m.fit.beta)
    z = np.stack([f == v for v in "bcd"], axis=1).astype(float)
    u, w = z.T @ (y - mu), mu[:, None]
    info = z.T @ (w * z) - z.T @ (w * x) @ np.linalg.inv(x.T @ (w * x)) @ x.T @ (w * z)
    assert got["df"] == 3 and got["statistic"] == pytest.approx(u @ np.linalg.solve(info, u), rel=1e-6)
    means = {v: y[f == v].mean() for v in "abcd"}
    one = np.array([means[v] for v in f])
    u, info = one @ (y - mu), one @ (mu * one) - (one * mu) @ x @ np.linalg.inv(x.T @ (w * x)) @ x.T @ (mu * one)
    assert diagnostics.score_test_encoded(m, data, F.col("f"))["statistic"] == pytest.approx(u * u / info, rel=1e-6)


def exact_encoded(pairs):
    """The score statistic of the levels' means in a Poisson model of the mean, in fractions of whole numbers."""
    each = {}
    for f, y in pairs:
        each.setdefault(f, []).append(int(y))
    n, m = len(pairs), Fraction(sum(sum(v) for v in each.values()), len(pairs))
    z = [(Fraction(sum(v), len(v)), len(v)) for v in each.values()]
    u = sum(a * k * (a - m) for a, k in z)
    return float(u * u / (m * sum(a * a * k for a, k in z) - m * sum(a * k for a, k in z) ** 2 / n))


def test_encoded_score_test_of_near_means(spark, tmp_path):
    """Levels whose means differ by little beside their size: the operator and the query keep the digits of exact sums."""
    import __spark_entry__ as entry

    pairs = [("ABC"[k % 3], 1e9 + 1e4 * (k % 3) + k * 37 % 101) for k in range(3000)]
    t = spark.createDataFrame(pairs, "f string, y double").repartition(3)
    m = GLM("y", {}, t, family="poisson").fit()
    assert diagnostics.score_test_encoded(m, t, F.col("f"))["statistic"] == pytest.approx(exact_encoded(pairs), rel=1e-9)
    lines = t.select(F.col("y").alias("l_quantity"), F.col("f").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit(1).alias("l_linenumber"), *[F.lit(0.0).alias(f"l_{k}") for k in ("extendedprice", "discount", "tax")])
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in entry.queries()["inf_score_cat_encoded"](spark, str(tmp_path)).select("statistic", "df").collect()] == [(pytest.approx(exact_encoded(pairs), abs=1e-5), 1)]


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_score_test_of_a_shifted_number(data, alpha):
    """An intercept takes up a constant, penalised model or not; a constant itself tests nothing."""
    m = GLM("y", {"x": LINEAR}, data, family="poisson").fit(alpha=alpha, tol=1e-14)
    want = m.score_test(data, F.col("z"))["statistic"]
    assert want > 1
    assert m.score_test(data, F.col("z") + 2.0**27)["statistic"] == pytest.approx(want, rel=1e-6)
    assert m.score_test(data, F.lit(12345.678))["statistic"] == 0.0


def test_score_test_of_nulls_and_without_intercept(data):
    """Against matrices: a null counts as 0, and without an intercept nothing is taken off."""
    r = rows()
    y, x = np.array([a[1] for a in r]), np.array([a[2] for a in r])
    z = np.array([0.0 if k % 7 == 0 else a[3] + 3 for k, a in enumerate(r)])
    for intercept in (True, False):
        m = GLM("y", {"x": LINEAR}, data, family="poisson", intercept=intercept).fit(tol=1e-14)
        d = np.column_stack([np.ones(len(x)), x]) if intercept else x[:, None]
        mu = np.exp(d @ m.fit.beta)
        xz = d.T @ (mu * z)
        want = (z @ (y - mu)) ** 2 / (z @ (mu * z) - xz @ np.linalg.inv(d.T @ (mu[:, None] * d)) @ xz)
        assert m.score_test(data, F.when(F.col("id") % 7 != 0, F.col("z") + 3))["statistic"] == pytest.approx(want, rel=1e-6)


def test_smooth_terms(data):
    """Each term has its own degrees of freedom, and they are what the whole has, but for the rest."""
    m = GLM("y", {"x": {"type": "bs", "k": 9}, "z": {"type": "bs", "k": 6}, "f": FACTOR}, data, family="poisson").fit()
    terms = m.smooth_terms()
    assert [t["variable"] for t in terms] == ["x", "z"] and all(0 < t["edf"] <= t["k"] for t in terms)
    assert sum(t["edf"] for t in terms) + 1 + 3 == pytest.approx(m.fit.edf, abs=1e-6)
    assert terms[0]["p_value"] < 0.01 and terms[0]["ref_df"] == terms[0]["edf"]
    noise = data.withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)
    (term,) = GLM("y", {"u": {"type": "bs", "k": 6}}, noise, family="poisson").fit().smooth_terms()
    assert term["p_value"] < 0.05 or "not significant" in term["warning"]


def test_smooth_fit_against_numpy(spark):
    """The penalised Gaussian fit at its penalty, and that no other penalty of a grid has a better score."""
    from riskloom.operators import solvers, splines

    r = rows(5, 400)
    df = spark.createDataFrame(r, "id long, y double, x double, z double, f string")
    m = GLM("y", {"x": {"type": "bs", "k": 8}}, df).fit()
    (term,) = [t for t in m.spec.terms if t.is_smooth]
    x, y = np.array([a[2] for a in r]), np.array([a[1] for a in r])
    b = np.column_stack([np.ones(len(x)), splines.bs_basis_np(x, term.state["knots"])[:, 1:]])
    s = np.zeros((b.shape[1],) * 2)
    s[1:, 1:] = splines.penalty_matrix(8)[1:, 1:]
    lam = m.fit.lambdas[0]
    assert np.allclose(m.fit.beta, np.linalg.solve(b.T @ b + lam * s, b.T @ y), atol=1e-6)

    def score(v):
        hat = b @ np.linalg.solve(b.T @ b + v * s, b.T)
        return solvers.gcv(len(y), ((y - hat @ y) ** 2).sum(), np.trace(hat))

    assert score(lam) <= min(score(v) for v in np.geomspace(0.1, 1000, 60)) * (1 + 1e-4)


def test_lasso_path_against_numpy(data):
    """Each fold's lasso along the path, by plain coordinate descent over rows; with the comparison at 0."""
    from riskloom.operators.model import fold_of

    glm = GLM("y", {"x": LINEAR, "z": LINEAR}, data)
    m = glm.fit(cv=4, l1_ratio=1.0, n_alphas=6, include_unregularized=True)
    assert [r["alpha"] for r in m.path][-1] == 0.0 and len(m.path) == 7
    t = m.frame.df.withColumn("fold", fold_of(4)).collect()
    x, y, fold = np.array([r["x"] for r in t]), np.array([r["y"] for r in t]), np.array([r["fold"] for r in t])
    for r in m.path:
        scores = []
        for k in range(4):
            a, b = x[fold != k], y[fold != k]
            beta = np.zeros(3)
            for _ in range(4000):
                for j in range(3):
                    rho = a[:, j] @ (b - a @ beta + a[:, j] * beta[j])
                    beta[j] = (rho if j == 0 else math.copysign(max(abs(rho) - r["alpha"], 0), rho)) / (a[:, j] @ a[:, j])
            scores.append(((y[fold == k] - x[fold == k] @ beta) ** 2).mean())
        assert r["deviance"] == pytest.approx(np.mean(scores), rel=1e-5) and r["se"] == pytest.approx(np.std(scores, ddof=1) / 2, rel=1e-4)


def test_design_reports(data):
    """Inflation is expected where only terms of one variable go along with each other."""
    spec = ModelSpec.parse("y", {"x": LINEAR, "sq": {"type": "expression", "expr": "x ** 2"}, "z": LINEAR}).fit(data)
    vif = diagnostics.design_vif(data, spec)
    assert [r["feature"] for r in vif][2] == "z" and {r["severity"] for r in vif[:2]} == {"expected"} and vif[0]["collinear_with"]
    assert vif[0]["vif"] >= vif[1]["vif"] >= vif[2]["vif"] >= 1
    r = diagnostics.design_report(data, spec)
    x = np.array([[1, a[2], a[2] ** 2, a[3]] for a in rows()])
    assert r["valid"] and r["rank"] == 4 and r["condition_number"] == pytest.approx(np.linalg.cond(x), rel=1e-6)
    bad = data.withColumn("x", F.when(F.col("id") == 5, float("nan")).otherwise(F.col("x")))
    assert "NaN values in x" in diagnostics.design_report(bad, ModelSpec.parse("y", {"x": LINEAR}).fit(bad))["suggestions"][0]
    assert [diagnostics.base_variable(n) for n in ("pos(age)", "I(age ** 2)", "bs(age, 1/4)", "area[T.b]:age", "TE(a:b)")] == ["age", "age", "age", "area", "a"]


def test_shapes():
    shape = lambda f: factors.effect_shape([f(k / 19) for k in range(20)])[0]
    assert shape(lambda t: 1 + t) == "linear_increasing" and shape(lambda t: 2 - t) == "linear_decreasing" and shape(lambda t: 5) == "flat"
    assert shape(lambda t: 1 + (t - 0.5) ** 2) == "u_shaped" and shape(lambda t: 2 - (t - 0.5) ** 2) == "inverted_u"
    assert factors.effect_shape([1, 2])[0] == "insufficient_data" and factors.variation([1.0])[0] == "single_level"


def test_reports_keep_nothing(spark, data):
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    m = GLM("y", {"x": {"type": "bs", "k": 6}, "f": FACTOR}, data, family="poisson").fit()
    before = kept()
    out = report.explore_data(data, "y", ["f"], ["x", "z"])
    assert out["factors"]["f"]["ordinal_pattern"] == "alphabetic" and out["interactions"][0]["recommendation"]
    out = report.diagnose(m, data, "id", ["f"], ["x", "z"], test=data.filter("id % 3 = 0"))
    assert kept() == before
    assert out["factors"]["z"]["test"]["df"] == 1 and out["lift_summary"]["ks_decile"] >= 1 and out["smooth_terms"][0]["variable"] == "x"
    assert {"p1", "p99", "skewness"} <= set(out["residuals"]) and out["vif"][0]["vif"] >= out["vif"][-1]["vif"]
    assert [r["feature"] for r in out["coefficients"]][-1] == "Intercept" and out["factors"]["f"]["coefficients"]
    m.close()
    assert kept() == before - 1


def test_report_as_json(tmp_path, data):
    import json

    from riskloom.sources.tables import write_json

    write_json(report.explore_data(data, "y", ["f"], ["x"]), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["response"]["n"] == 600


def test_text_of_relativities(data):
    m = GLM("y", {"f": FACTOR}, data, family="poisson").fit()
    text = m.summary_relativities()
    assert all(n in text for n in m.names) and f"{m.relativities()[1]['relativity']:.4f}" in text
    assert m.df_resid == 596 and m.bread.shape == (4, 4) and m.fitted(data).count() == 600


@pytest.mark.parametrize("parts", [1, 6])
def test_sums_within_a_hot_key(spark, parts):
    from riskloom.operators.prefix import released, within

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        r = [(k, "hot" if k % 5 else f"k{k % 3}", float(k % 11) if k % 13 else None) for k in range(500)]
        with released():
            df = within(spark.createDataFrame(r, "id long, key string, v double"), F.col("key"), [F.col("id").desc()], {"s": F.col("v"), "n": F.lit(1.0)})
            got = {a["id"]: (a["s"], a["n"]) for a in df.collect()}
        for k, key, _ in r:
            later = [v or 0.0 for i, o, v in r if o == key and i > k]
            assert got[k] == (sum(later), len(later))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_interpolated_quantiles(spark):
    r = np.random.default_rng(0).integers(0, 50, 333).astype(float)
    df = spark.createDataFrame([(float(v),) for v in r] + [(None,), (float("nan"),)], "v double")
    p = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    assert quantiles.linear(df, F.col("v"), p) == pytest.approx(np.quantile(r, p))
    assert quantiles.linear(df.filter("v > 99"), F.col("v"), p) == []


@pytest.mark.parametrize("kind", ["bs", "ns"])
def test_exports_agree_outside_the_knots(spark, data, kind):
    """Below, at and above the knots; PMML's piecewise lines are read as the standard says."""
    import xml.etree.ElementTree as ET

    from riskloom.sources.pmml import NAMESPACE, to_pmml

    m = GLM("y", {"x": {"type": kind, "df": 5}}, data, family="poisson").fit()
    low, high = (data.agg(f("x")).first()[0] for f in (F.min, F.max))
    at = [low - 7, low - 0.5, low, (low + high) / 2, high, high + 0.5, high + 7]
    want = [r["prediction"] for r in m.predict(spark.createDataFrame([(float(v),) for v in at], "x double").coalesce(1)).collect()]
    root, ns = ET.fromstring(to_pmml(m)), {"p": NAMESPACE}
    beta = {x.get("parameterName"): float(x.get("beta")) for x in root.iterfind(".//p:PCell", ns)}
    eta = np.full(len(at), beta["p0"])
    cells = {x.get("predictorName"): x.get("parameterName") for x in root.iterfind(".//p:PPCell", ns)}
    for field in root.iterfind(".//p:DerivedField", ns):
        body = field.find("p:NormContinuous", ns)
        points = [(float(q.get("orig")), float(q.get("norm"))) for q in body.iterfind("p:LinearNorm", ns)]
        for k, v in enumerate(at):
            if points[0][0] <= v <= points[-1][0]:
                value = np.interp(v, *zip(*points))
            elif body.get("outliers") == "asMissingValues":
                value = float(body.get("mapMissingTo"))
            else:
                (a, p), (b, q) = points[:2] if v < points[0][0] else points[-2:]
                value = p + (v - a) * (q - p) / (b - a)
            eta[k] += beta[cells[field.get("name")]] * value
    assert np.exp(eta) == pytest.approx(want, rel=2e-3)
    runtime = pytest.importorskip("onnxruntime")
    from riskloom.sources.onnx import full_graph

    session = runtime.InferenceSession(full_graph(m)[0], providers=["CPUExecutionProvider"])
    got = session.run(None, {session.get_inputs()[0].name: np.array(at, np.float32)[:, None]})[0].ravel()
    inside = [k for k, v in enumerate(at) if v not in (low, high)]  # the ends, in single precision, may fall outside
    assert got[inside] == pytest.approx(np.array(want)[inside], rel=2e-3)


def test_graph_with_products_and_expressions(data):
    runtime = pytest.importorskip("onnxruntime")
    from riskloom.sources.onnx import full_graph

    terms = {"e": {"type": "expression", "expr": "x ** 2 / 10 - (-z)"}, "f": FACTOR}
    m = GLM("y", terms, data, [{"f": FACTOR, "x": LINEAR}, {"x": {"type": "bs", "df": 4}, "z": LINEAR}, {"f": FACTOR, "z": {"type": "ns", "df": 3}}], family="poisson").fit()
    graph, levels = full_graph(m)
    t = m.predict(data).orderBy("id").limit(200).collect()
    session = runtime.InferenceSession(graph, providers=["CPUExecutionProvider"])
    values = {"x": np.array([[r["x"]] for r in t], np.float32), "z": np.array([[r["z"]] for r in t], np.float32), "f": np.array([[levels["f"].index(r["f"])] for r in t], np.int64)}
    got = session.run(None, {i.name: values[i.name] for i in session.get_inputs()})[0].ravel()
    assert got == pytest.approx([r["prediction"] for r in t], rel=5e-3)


def test_families_and_links_can_be_added(data):
    from riskloom.functions.families import ALIASES, FAMILIES, Family, register_family
    from riskloom.functions.links import LINKS, Link, register_link

    register_link(Link("sqrt", F.sqrt, lambda e: e * e, lambda m: 0.5 / F.sqrt(m), np.sqrt, lambda e: e * e, lambda m: 0.5 / np.sqrt(m)))
    dev = FAMILIES["poisson"]
    register_family(Family("counts", "sqrt", lambda m: m, lambda m: m, dev.deviance, dev.deviance_np, dev.start_np, fixed_scale=True, least_y=0.0), "tally")
    try:
        m = GLM("y", {"f": FACTOR}, data, family="tally").fit()
        want = {r["f"]: r["m"] for r in data.groupBy("f").agg(F.avg("y").alias("m")).collect()}
        got = {r["f"]: r["prediction"] for r in m.predict(data.select("f").distinct()).collect()}
        assert got == pytest.approx(want, rel=1e-6)
    finally:
        del LINKS["sqrt"], FAMILIES["counts"], ALIASES["tally"]


def test_knots_and_recommendations(data):
    spec = ModelSpec.parse("y", {"x": {"type": "bs", "df": 6}, "z": {"type": "ns", "df": 4}, "f": FACTOR}).fit(data)
    info = {t.name: t.knots() for t in spec.terms}
    assert len(info["x"]["interior"]) == 2 and info["x"]["functions"] == 6 and len(info["z"]["interior"]) == 3 and info["f"] is None
    assert info["z"]["boundary"] == tuple(data.agg(F.min("z"), F.max("z")).first())
    assert "levels of f and g" in report.recommendation("f", "g", {"f", "g"}) and "spline of x" in report.recommendation("x", "f", {"f"}, {"x"})
    assert "tensor" in report.recommendation("x", "z", set(), {"x"})
