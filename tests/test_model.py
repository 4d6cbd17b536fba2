"""Fits, inference, persistence, exports, reports and streams."""

import json
import math
from xml.etree import ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.errors import LinearAlgebraError, SerializationError, ValidationError
from riskloom.operators import report
from riskloom.operators.model import GLM, Model, select_alpha

LINEAR = {"type": "linear"}
FACTOR = {"type": "categorical"}


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(42)
    n = 1500
    x, z = g.uniform(0, 10, n), g.normal(size=n)
    f = g.choice(list("ABC"), n)
    e = g.uniform(0.5, 1.5, n)
    mu = np.exp(-0.5 + 0.12 * x + 0.2 * z + np.where(f == "B", 0.4, 0) - np.where(f == "C", 0.3, 0))
    frame = {"id": range(n), "x": x, "z": z, "f": f, "e": e, "y": g.poisson(mu * e).astype(float), "s": g.gamma(2.0, mu / 2), "b": (g.uniform(size=n) < mu / (1 + mu)).astype(float), "u": mu + g.normal(size=n)}
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*frame.values(), strict=True)]
    return frame, spark.createDataFrame(rows, "id long, x double, z double, f string, e double, y double, s double, b double, u double").repartition(3).cache()


def design(frame):
    return np.column_stack([np.ones(len(frame["x"])), frame["x"], frame["f"] == "B", frame["f"] == "C"]).astype(float)


TERMS = {"x": LINEAR, "f": FACTOR}


def newton(x, y, family, o=0.0, iterations=50):
    """Plain scoring for canonical links."""
    b = np.zeros(x.shape[1])
    for _ in range(iterations):
        eta = x @ b + o
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        w = mu if family == "poisson" else mu * (1 - mu)
        b = b + np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (y - mu))
    return b, np.linalg.inv(x.T @ (w[:, None] * x))


@pytest.mark.parametrize("response,family,offset", [("y", "poisson", "e"), ("b", "binomial", None)])
def test_canonical_fits(data, response, family, offset):
    frame, df = data
    m = GLM(response, {"f": FACTOR, "x": LINEAR}, df, family=family, offset=offset).fit()
    x = design(frame)[:, [0, 2, 3, 1]]
    b, cov = newton(x, frame[response], family, np.log(frame["e"]) if offset else 0.0)
    assert m.names == ["Intercept", "f[T.B]", "f[T.C]", "x"]
    assert np.allclose(m.fit.beta, b, atol=1e-6) and np.allclose(m.fit.cov, cov, rtol=1e-4)


def test_gaussian_and_sandwich(data):
    frame, df = data
    m = GLM("u", TERMS, df).fit()
    x = design(frame)
    b = np.linalg.lstsq(x, frame["u"], rcond=None)[0]
    r = frame["u"] - x @ b
    bread = np.linalg.inv(x.T @ x)
    assert np.allclose(m.fit.beta, b) and np.allclose(m.covariance(), bread * (r @ r) / (len(r) - 4))
    h = np.einsum("ij,jk,ik->i", x, bread, x)
    for kind, scale in {"HC0": 1.0, "HC1": len(r) / (len(r) - 4), "HC2": 1 / (1 - h), "HC3": 1 / (1 - h) ** 2}.items():
        meat = (x * (r * r * scale)[:, None]).T @ x
        assert np.allclose(m.robust_covariance(kind), bread @ meat @ bread)


def test_partitions_do_not_matter(data):
    _, df = data
    a = GLM("s", TERMS, df.repartition(1), family="gamma").fit()
    b = GLM("s", TERMS, df.repartition(9), family="gamma").fit()
    assert np.allclose(a.fit.beta, b.fit.beta, atol=1e-9) and a.fit.deviance == pytest.approx(b.fit.deviance, rel=1e-10)


def test_sums_in_groups(data, monkeypatch):
    from riskloom.operators import gram

    _, df = data
    a = GLM("s", TERMS, df, family="gamma").fit()
    monkeypatch.setattr(gram, "DIRECT_PARTIALS", 2)
    assert np.allclose(GLM("s", TERMS, df.repartition(7), family="gamma").fit().fit.beta, a.fit.beta, atol=1e-9)


def test_agrees_with_spark_ml(data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    _, df = data
    m = GLM("s", {"x": LINEAR, "z": LINEAR}, df, family="gamma").fit()
    ml = GeneralizedLinearRegression(family="gamma", link="log", labelCol="s", featuresCol="v", tol=1e-10, maxIter=50)
    other = ml.fit(VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(df))
    assert np.allclose(m.fit.beta, [other.intercept, *other.coefficients], atol=1e-5)


def test_penalties_and_signs(data):
    _, df = data
    plain, ridge, lasso = (GLM("u", {"x": LINEAR, "z": LINEAR}, df).fit(**k) for k in ({}, {"alpha": 500.0}, {"alpha": 1e6, "l1_ratio": 1.0}))
    assert np.linalg.norm(ridge.fit.beta[1:]) < np.linalg.norm(plain.fit.beta[1:])
    assert lasso.selected() == ["Intercept"]
    down = GLM("y", {"x": {"type": "linear", "monotonicity": "decreasing"}, "z": LINEAR}, df, family="poisson").fit()
    assert down.names[-1] == "neg(x)" and down.params["neg(x)"] == 0.0 and down.params["z"] > 0


def test_cross_validation(data):
    _, df = data
    m = GLM("u", {"x": LINEAR, "z": LINEAR}, df).fit(cv=4, l1_ratio=1.0, n_alphas=8)
    assert len(m.path) == 8 and m.alpha == min(m.path, key=lambda r: r["deviance"])["alpha"]
    assert select_alpha(m.path, "1se") >= m.alpha
    p = GLM("y", {"x": LINEAR}, df, family="poisson").fit(cv=2, l1_ratio=0.5, n_alphas=3)
    assert len(p.path) == 3 and all(math.isfinite(r["deviance"]) for r in p.path)


def test_path_of_ridge_is_that_of_numpy(data):
    from riskloom.operators.model import Frame, fold_of

    _, df = data
    m = GLM("u", {"x": LINEAR, "z": LINEAR}, df).fit(cv=3, n_alphas=5)
    frame: Frame = m.frame
    rows = frame.df.withColumn("fold", fold_of(3)).toPandas()
    x, y, fold = np.array(rows["x"].tolist()), rows["y"].to_numpy(), rows["fold"].to_numpy()
    for r in m.path:
        s = np.diag([0.0, r["alpha"], r["alpha"]])
        each = []
        for k in range(3):
            a, b = x[fold != k], y[fold != k]
            beta = np.linalg.solve(a.T @ a + s, a.T @ b)
            each.append(((y[fold == k] - x[fold == k] @ beta) ** 2).mean())
        assert r["deviance"] == pytest.approx(np.mean(each)) and r["se"] == pytest.approx(np.std(each, ddof=1) / 3**0.5)


def test_smooth_terms(data):
    frame, df = data
    m = GLM("u", {"x": {"type": "bs", "k": 9}}, df).fit()
    assert m.names[1] == "bs(x, 2/9, 9)" and 0.1 <= m.fit.lambdas[0] <= 1000 and 1 < m.fit.edf < 9
    up = GLM("u", {"x": {"type": "bs", "k": 9, "monotonicity": "increasing"}}, df).fit()
    line = up.predict(df).orderBy("x").toPandas()["prediction"].to_numpy()
    assert (np.diff(line) >= -1e-9).all()
    assert m.wald("x")["p_value"] < 1e-6


def test_theta_is_estimated(spark):
    g = np.random.default_rng(3)
    mu, theta = 4.0, 2.5
    y = g.poisson(mu * g.gamma(theta, 1 / theta, 6000))
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "id long, y double")
    m = GLM("y", {}, df, family="negbinomial").fit()
    assert abs(m.family.parameter - theta) < 0.4 and abs(m.fit.beta[0] - math.log(mu)) < 0.05
    assert GLM("y", {}, df, family="negbinomial", theta=7.0).fit().family.parameter == 7.0


def test_score_and_wald(data):
    _, df = data
    m = GLM("y", {"x": LINEAR}, df, family="poisson", offset="e").fit()
    assert m.score_test(df, F.col("z"))["p_value"] < 1e-6 < m.score_test(df, F.sin(F.col("id") * 1.7))["p_value"]
    assert m.wald("x")["df"] == 1 and m.wald("x")["p_value"] < 1e-9
    with pytest.raises(ValidationError):
        m.wald("z")


@pytest.mark.parametrize(
    "change,what",
    [("null", "1 of"), ("nan", "response"), ("negative", "outside"), ("zero_exposure", "offset"), ("weights", "weights"), ("constant", "equal")],
)
def test_bad_input_is_named(spark, data, change, what):
    df = data[1].select("id", "y", "e", "x", F.lit(1.0).alias("w"))
    one = F.col("id") == 5
    df = {
        "null": lambda: df.withColumn("x", F.when(~one, F.col("x"))), "nan": lambda: df.withColumn("y", F.when(one, float("nan")).otherwise(F.col("y"))),
        "negative": lambda: df.withColumn("y", F.when(one, -1.0).otherwise(F.col("y"))), "zero_exposure": lambda: df.withColumn("e", F.when(one, 0.0).otherwise(F.col("e"))),
        "weights": lambda: df.withColumn("w", F.when(one, -1.0).otherwise(1.0)), "constant": lambda: df.withColumn("y", F.lit(2.0)),
    }[change]()
    with pytest.raises(ValidationError, match=what):
        GLM("y", {"x": LINEAR}, df, family="poisson", offset="e", weights="w").fit()


def test_collinear_columns_raise(data):
    df = data[1].withColumn("x2", 2 * F.col("x")).withColumn("c", F.lit(3.0))
    with pytest.raises(LinearAlgebraError, match="x2"):
        GLM("u", {"x": LINEAR, "x2": LINEAR}, df).fit()
    with pytest.raises(LinearAlgebraError, match="c"):
        GLM("u", {"c": LINEAR}, df).fit()


def test_specification_errors(data):
    _, df = data
    bad = [{"x": {"type": "linaer"}}, {"x": {"type": "bs", "dof": 4}}, {"q": LINEAR}, {"x": {"type": "linear", "monotonicity": "up"}}]
    for terms in bad:
        with pytest.raises(ValidationError):
            GLM("u", terms, df)
    with pytest.raises(ValidationError, match="did you mean 'linear'"):
        GLM("u", bad[0], df)
    for i in ({"x": LINEAR}, {"x": LINEAR, "f": FACTOR, "target_encoding": True, "frequency_encoding": True}):
        with pytest.raises(ValidationError):
            GLM("u", {}, df, [i])


MIXED = {"x": {"type": "bs", "df": 5}, "z": {"type": "ns", "df": 3}, "t": {"type": "target_encoding", "variable": "f"}, "q": {"type": "frequency_encoding", "variable": "f"}, "e1": {"type": "expression", "expr": "z ** 2 + 1"}}


def test_order_names_and_reload(spark, data, tmp_path):
    from riskloom.sources.tables import load_model, save_model

    _, df = data
    m = GLM("y", MIXED | {"id0": {"type": "linear", "variable": "id"}}, df, [{"x": LINEAR, "f": FACTOR}], family="poisson", offset="e", row_id="id").fit(alpha=1.0)
    assert m.names[:2] == ["Intercept", "id"] and m.names[2] == "bs(x, 2/5)" and m.names[-1] == "I(z ** 2 + 1)"
    assert "TE(f)" in m.names and "FE(f)" in m.names and "x:f[T.C]" in m.names
    save_model(spark, m, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, 2.0, 0.5, "A", 1.0), (2, 7.0, -1.0, "new", 0.7), (3, 9.0, 0.0, None, 1.2)], "id long, x double, z double, f string, e double")
    a, b = (sorted((r["id"], r["prediction"]) for r in k.predict(new).collect()) for k in (m, again))
    assert dict(a) == pytest.approx(dict(b)) and all(v > 0 for _, v in a) and len(a) == 3
    with pytest.raises(SerializationError):
        Model.from_json(spark, json.dumps({"version": 99}))
    assert "Intercept" in m.summary()


def test_unseen_level_is_the_reference(spark, data):
    m = GLM("u", TERMS, data[1]).fit()
    new = spark.createDataFrame([(1.0, "A"), (1.0, "Z"), (1.0, None)], "x double, f string")
    assert len({round(r["prediction"], 9) for r in m.predict(new).collect()}) == 1


def test_pmml(spark, data):
    from riskloom.sources.pmml import NAMESPACE, to_pmml

    m = GLM("y", MIXED | {"f": FACTOR}, data[1], [{"z": LINEAR, "f": FACTOR}], family="poisson", offset="e").fit(alpha=1.0)
    root = ET.fromstring(to_pmml(m))
    ns = {"p": NAMESPACE}
    cells = {c.get("parameterName"): float(c.get("beta")) for c in root.iterfind(".//p:PCell", ns)}
    assert list(cells.values()) == pytest.approx(m.fit.beta.tolist())
    assert [p.get("label") for p in root.iterfind(".//p:Parameter", ns)] == m.names
    assert len(root.findall(".//p:NormContinuous[@field='x']", ns)) == 4 and len(root.findall(".//p:LinearNorm", ns)) == 200 * 6
    assert root.find(".//p:GeneralRegressionModel", ns).get("offsetVariable") == "log_e"
    shared = [c.get("parameterName") for c in root.iterfind(".//p:PPCell", ns)]
    assert max(shared.count(p) for p in shared) == 2


def test_onnx(spark, data):
    ort = pytest.importorskip("onnxruntime")
    from riskloom.sources.onnx import full_graph, scoring_graph

    _, df = data
    terms = {"x": {"type": "bs", "df": 5}, "z": {"type": "ns", "df": 3}, "f": FACTOR, "id0": {"type": "linear", "variable": "s"}}
    m = GLM("y", terms, df, family="poisson", offset="e").fit()
    pdf = m.predict(df).orderBy("id").limit(300).toPandas()
    graph, levels = full_graph(m, 2000)
    codes = {v: k for k, v in enumerate(levels["f"])}
    feed = {c: pdf[[c]].to_numpy(np.float32) for c in ("x", "z", "s", "e")} | {"f": pdf["f"].map(codes).to_numpy(np.int64)[:, None]}
    got = ort.InferenceSession(graph).run(None, feed)[0][:, 0]
    assert np.allclose(got, pdf["prediction"], rtol=2e-3)
    assert len(ort.InferenceSession(graph).run(None, {k: v[:1] * 0 + (99 if k == "f" else 1) for k, v in feed.items()})[0]) == 1
    simple = GLM("b", TERMS, df, family="binomial").fit()
    p2 = simple.predict(df).orderBy("id").limit(50).toPandas()
    x = np.column_stack([p2["f"] == "B", p2["f"] == "C", p2["x"]]) if simple.names[1] != "x" else np.column_stack([p2["x"], p2["f"] == "B", p2["f"] == "C"])
    got = ort.InferenceSession(scoring_graph(simple)).run(None, {"X": x.astype(np.float32)})[0][:, 0]
    assert np.allclose(got, p2["prediction"], rtol=1e-4)
    with pytest.raises(SerializationError):
        both = df.selectExpr("*", "CAST(pmod(hash(x), 3) AS STRING) AS h")
        full_graph(GLM("y", {}, both, [{"f": FACTOR, "h": FACTOR, "frequency_encoding": True}], family="poisson").fit())  # an encoding of several factors


def test_reports(data):
    _, df = data
    seen = report.explore_data(df, "y", ["f"], ["x", "z"], "e")
    assert seen["factors"]["x"]["shape"] in ("monotone", "irregular", "u_shaped") and seen["factors"]["f"]["suggested_base"] in "ABC"
    assert len(seen["interactions"]) == 3 and seen["missing"][0]["missing"] == 0
    train, test = df.filter("id % 3 > 0").withColumn("old", F.lit(1.0)), df.filter("id % 3 = 0")
    m = GLM("y", TERMS, train, family="poisson", offset="e").fit()
    out = report.diagnose(m, train, "id", ["f"], ["x", "z"], test=test, base="old")
    assert out["train"]["total"]["ae"] == pytest.approx(1.0) and not out["factors"]["z"]["in_model"] and out["factors"]["z"]["test"]["p_value"] < 1e-4
    assert len(out["train"]["deciles"]) == 10 and out["lorenz"][-1]["actual_share"] == pytest.approx(1.0)
    assert out["base"]["model"]["gini"] >= out["base"]["base"]["gini"] and "gini_gap" in out["train_test"]
    assert any(w.startswith("z is not in the model") for w in out["warnings"])
    json.dumps(out, default=str)
    curve = report.partial_dependence(m, train.limit(200), "x", 5)
    assert [p["prediction"] for p in curve] == sorted(p["prediction"] for p in curve)


def test_streams(spark, data, tmp_path):
    from riskloom.streaming.monitor import monitor, score_stream

    _, df = data
    m = GLM("y", TERMS, df, family="poisson", offset="e").fit()
    src = df.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("id") * 60))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    table = monitor(score_stream(m, stream), "ts", F.col("f"), F.col("y"), F.col("prediction"))
    q = table.writeStream.outputMode("complete").format("memory").queryName("monitored").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("monitored").agg(F.sum("n"), F.sum("actual"), F.sum("expected")).first()
    want = df.agg(F.count("y"), F.sum("y")).first()
    assert got[0] == want[0] and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[1])
