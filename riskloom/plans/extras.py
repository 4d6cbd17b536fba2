"""Queries: sufficient statistics, tests of terms, exports, streams and composite reports."""

from __future__ import annotations

import uuid
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.families import get_family
from riskloom.operators import encoding, factors, report, solvers
from riskloom.operators.gram import row_sums
from riskloom.operators.model import GLM, Model
from riskloom.plans.fits import FLAG
from riskloom.plans.registry import c, lines, orders, query, table
from riskloom.sources.onnx import full_graph, scoring_graph
from riskloom.sources.pmml import NAMESPACE, to_pmml
from riskloom.sources.tables import read_table
from riskloom.streaming.monitor import monitor

LINEAR = {"type": "linear"}


@query("n* total.3", "SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_discount > 0.05")
def src_column(spark: SparkSession, d: str) -> DataFrame:
    """Only the two columns are read, and the filter reaches the scan."""
    t = read_table(spark, f"{d}/lineitem.parquet", ["l_quantity", "l_discount"])
    return t.filter("l_discount > 0.05").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query(
    "i* j* value.3",
    """WITH {lines}, m AS (SELECT [1e0, x, t] AS v, e AS w, y AS z FROM l), k AS (SELECT unnest([1, 2, 3]) AS a), k2 AS (SELECT unnest([1, 2, 3]) AS b)
SELECT a - 1 AS i, b - 1 AS j, sum(w * v[a] * v[b]) AS value FROM m, k, k2 GROUP BY a, b UNION ALL SELECT a - 1, 3, sum(w * v[a] * z) FROM m, k GROUP BY a""",
)
def agg_gram(spark: SparkSession, d: str) -> DataFrame:
    """X'WX, and X'Wz as column 3, by the pass that fits use."""
    t = lines(spark, d).select(F.array(F.lit(1.0), "x", "t").alias("x"), "y", c.e.alias("w"), F.lit(0.0).alias("o"))

    def f(x, y, w, o):
        return np.concatenate([(x.T @ (w[:, None] * x)).ravel(), x.T @ (w * y)])

    v = row_sums(t, f, 12)
    cells = [(i, j, float(v[3 * i + j])) for i in range(3) for j in range(3)] + [(i, 3, float(v[9 + i])) for i in range(3)]
    return spark.createDataFrame(cells, "i long, j long, value double")


@query(
    "chi2.4 df*",
    """WITH {lines}, s AS (SELECT f, count(*) AS n, avg(y) AS m, sum(y * y) - count(*) * avg(y) * avg(y) AS w FROM l GROUP BY f),
g AS (SELECT sum(n * m) / sum(n) AS g, sum(w) / (sum(n) - 3) AS s2 FROM s) SELECT sum(n * (m - g) * (m - g)) / min(s2) AS chi2, 2 AS df FROM s, g""",
)
def inf_wald(spark: SparkSession, d: str) -> DataFrame:
    w = GLM("y", FLAG, lines(spark, d)).fit().wald("f")
    return spark.createDataFrame([(w["chi2"], w["df"])], "chi2 double, df long")


@query(
    "chi2.3 df* deviance_reduction_pct.6",
    """WITH {lines}, s AS (SELECT y, avg(y) OVER (PARTITION BY f) AS m, avg(y) OVER () AS g FROM l),
t AS (SELECT sum(2 * (y * ln(y / m) - (y - m))) AS d, sum(2 * (y * ln(y / g) - (y - g))) AS n FROM s) SELECT n - d AS chi2, 2 AS df, 100 * (1 - d / n) AS deviance_reduction_pct FROM t""",
)
def inf_lr(spark: SparkSession, d: str) -> DataFrame:
    from riskloom.operators.metrics import null_deviance

    t = lines(spark, d)
    m = GLM("y", FLAG, t, family="poisson").fit()
    r = m.likelihood_ratio(null_deviance(t, m.family, c.y).first()[0])
    return spark.createDataFrame([(r["chi2"], r["df"], r["deviance_reduction_pct"])], "chi2 double, df long, deviance_reduction_pct double")


@query("edf.6", "WITH {lines} SELECT 1 + var_pop(x) * count(*) / (var_pop(x) * count(*) + 10) AS edf FROM l")
def fit_edf(spark: SparkSession, d: str) -> DataFrame:
    """Effective degrees of freedom of a ridge fit of one predictor."""
    m = GLM("y", {"x": LINEAR}, lines(spark, d)).fit(alpha=10.0)
    gram = np.linalg.inv(m.fit.cov) - np.diag([0.0, 10.0])
    return spark.createDataFrame([(float(solvers.edf(gram, np.diag([0.0, 10.0])).sum()),)], "edf double")


@query(
    "value.5 prediction.5",
    """WITH {lines}, s AS (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM l), k AS (SELECT unnest(range(0, 5)) AS k)
SELECT lo + (hi - lo) * k / 4e0 AS value, ic + sl * (lo + (hi - lo) * k / 4e0) AS prediction FROM s, k""",
)
def agg_pd_cont(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d).select("x", "y")
    curve = report.partial_dependence(GLM("y", {"x": LINEAR}, t).fit(), t, "x", 5)
    return spark.createDataFrame([(p["value"], p["prediction"]) for p in curve], "value double, prediction double")


@query(
    "factor eta_squared.8",
    """WITH {lines}, x AS (SELECT 'f' AS factor, f AS v, y - mu AS r FROM l UNION ALL SELECT 'g', g, y - mu FROM l UNION ALL SELECT 'line', line, y - mu FROM l),
s AS (SELECT factor, v, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM x GROUP BY ALL)
SELECT factor, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS eta_squared FROM s GROUP BY factor ORDER BY eta_squared DESC LIMIT 2""",
)
def topk_factors(spark: SparkSession, d: str) -> DataFrame:
    """The two factors that explain most of the residuals; all factors in one explode."""
    return factors.top_factors(lines(spark, d), ["f", "g", "line"], c.y - c.mu, 2)


@query("id encoded.5", "WITH {orders}, s AS (SELECT f, sum(y) AS s, count(*) AS n FROM o GROUP BY f), p AS (SELECT avg(y) AS p FROM o) SELECT id, (s + p) / (n + 1) AS encoded FROM o JOIN s USING (f), p")
def ft_encoder_api(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    return encoding.TargetEncoder("f", "y").fit(t).transform(t)


@query("level prediction.5", "WITH {lines}, s AS (SELECT avg(y) AS m FROM l WHERE f = 'A') SELECT v AS level, m AS prediction FROM s, (SELECT unnest(['new', 'A']) AS v)")
def prj_unknown_level(spark: SparkSession, d: str) -> DataFrame:
    """A level that the fit did not see scores as the reference level."""
    m = GLM("y", FLAG, lines(spark, d)).fit()
    new = spark.range(1).select(F.explode(F.array(F.lit("new"), F.lit("A"))).alias("f"))
    return m.predict(new).select(F.col("f").alias("level"), "prediction")


_ONEWAY = """WITH {lines}, s AS (SELECT f, ln(avg(y)) AS b FROM l GROUP BY f)
SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, b - CASE WHEN f = 'A' THEN 0 ELSE (SELECT b FROM s WHERE f = 'A') END AS estimate FROM s"""


@query("feature estimate.6", _ONEWAY)
def snk_pmml(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients as read back from the exported XML."""
    root = ET.fromstring(to_pmml(GLM("y", FLAG, lines(spark, d), family="poisson").fit()))
    ns = {"p": NAMESPACE}
    label = {p.get("name"): p.get("label") for p in root.iterfind(".//p:Parameter", ns)}
    return spark.createDataFrame([(label[x.get("parameterName")], float(x.get("beta"))) for x in root.iterfind(".//p:PCell", ns)], "feature string, estimate double")


@query("feature estimate.6", _ONEWAY)
def snk_state(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of a model that was written as JSON and read back."""
    m = Model.from_json(spark, GLM("y", FLAG, lines(spark, d), family="poisson").fit().to_json())
    return spark.createDataFrame(list(m.params.items()), "feature string, estimate double")


@query("graph level prediction.3", "WITH {lines}, s AS (SELECT f, avg(y) AS m FROM l GROUP BY f) SELECT 'full' AS graph, f AS level, m AS prediction FROM s UNION ALL SELECT 'full', 'new', m FROM s WHERE f = 'A' UNION ALL SELECT 'scoring', f, m FROM s")
def snk_onnx(spark: SparkSession, d: str) -> DataFrame:
    """Means by level as an ONNX runtime computes them from both graphs; a level that the fit did not see has the reference's."""
    import onnxruntime

    m = GLM("y", FLAG, lines(spark, d), family="poisson").fit()
    full, levels = full_graph(m)
    run = lambda graph, x: (s := onnxruntime.InferenceSession(graph, providers=["CPUExecutionProvider"])).run(None, {s.get_inputs()[0].name: x})[0].ravel()
    names = [*levels["f"], "new"]
    out = [("full", v, float(p)) for v, p in zip(names, run(full, np.arange(len(names))[:, None]), strict=True)]
    design = np.array([[1.0] + [float(v == w) for w in levels["f"][1:]] for v in levels["f"]])
    out += [("scoring", v, float(p)) for v, p in zip(levels["f"], run(scoring_graph(m), design[:, 1:].astype(np.float32)), strict=True)]
    return spark.createDataFrame(out, "graph string, level string, prediction double")


@query(
    "start level n* actual.3 expected.3 ae.5",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type AS level, count(*) AS n, sum(value) AS actual, 5e0 * count(*) AS expected, sum(value) / (5e0 * count(*)) AS ae FROM events GROUP BY ALL""",
)
def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    """A/E per hour and event type, run as a stream over the table's file until it is read."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(f"{d}/")
    name = f"monitor_{uuid.uuid4().hex[:8]}"
    out = monitor(stream, "ts", F.col("event_type"), F.col("value"), F.lit(5.0))
    run = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination(300)
    return spark.table(name).withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("n* bad_response* bad_exposure*", "SELECT count(*) AS n, count(*) FILTER (nullif(l_quantity, 1) IS NULL) AS bad_response, count(*) FILTER (l_discount <= 0) AS bad_exposure FROM lineitem")
def fit_validate(spark: SparkSession, d: str) -> DataFrame:
    """What a fit would refuse, counted."""
    from riskloom.operators.prefix import finite

    t = table(spark, d, "lineitem").select(F.nullif("l_quantity", F.lit(1.0)).alias("y"), "l_discount")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce(finite(c.y), F.lit(False)), 1)).alias("bad_response"), F.count(F.when(F.col("l_discount") <= 0, 1)).alias("bad_exposure"))


@query(
    "level n* ae.5",
    "WITH {orders} SELECT f || ':' || g AS level, count(*) AS n, sum(y) / sum(mu) AS ae FROM o GROUP BY 1",
)
def agg_two_way(spark: SparkSession, d: str) -> DataFrame:
    return factors.level_metrics(orders(spark, d).withColumn("k", encoding.interaction_key(c.f, c.g)), F.col("k"), get_family("poisson"), c.y, c.mu, c.e)


def _entries(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(s, k, float(v)) for s, k, v in entries], "section string, key string, value double")


@query(
    "section key value.5",
    """WITH {orders}, q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS x, quantile_cont(mu, [0.2, 0.4, 0.6, 0.8]) AS m FROM o),
w AS (SELECT o.*, y / e AS r, (o.x >= q.x[1])::INT + (o.x >= q.x[2])::INT + (o.x >= q.x[3])::INT + (o.x >= q.x[4])::INT AS kx, (mu >= m[1])::INT + (mu >= m[2])::INT + (mu >= m[3])::INT + (mu >= m[4])::INT AS km FROM o, q),
c AS (SELECT f AS a, g AS b, e, r FROM w), eta AS (SELECT 'f' AS k, f AS v, e, r FROM w UNION ALL SELECT 'g', g, e, r FROM w),
es AS (SELECT k, v, sum(e) AS w, sum(e * r) AS s, sum(e * r * r) AS q FROM eta GROUP BY k, v),
p AS (SELECT 'x~mu' AS k, kx AS a, CAST(km AS VARCHAR) AS b, e, r FROM w UNION ALL SELECT 'x~f', kx, f, e, r FROM w UNION ALL SELECT 'x~g', kx, g, e, r FROM w UNION ALL SELECT 'mu~f', km, f, e, r FROM w UNION ALL SELECT 'mu~g', km, g, e, r FROM w UNION ALL SELECT 'f~g', CAST(left(f, 1) AS INT), g, e, r FROM w),
ps AS (SELECT k, a, b, sum(e) AS w, sum(e * r) AS s, sum(e * r * r) AS q FROM p GROUP BY ALL HAVING count(*) >= 30)
SELECT 'response' AS section, 'mean_rate' AS key, avg(r) AS value FROM w UNION ALL SELECT 'response', 'p50', quantile_cont(r, 0.5) FROM w UNION ALL SELECT 'response', 'p99', quantile_cont(r, 0.99) FROM w UNION ALL SELECT 'response', 'exposure', sum(e) FROM w
UNION ALL SELECT 'missing', k, 0 FROM (SELECT unnest(['y', 'f', 'g', 'x', 'mu']) AS k)
UNION ALL SELECT 'correlation', 'x~mu', corr(x, mu) FROM w
UNION ALL SELECT 'exposure of levels', f, sum(e) FROM w GROUP BY f UNION ALL SELECT 'rate of levels', f, sum(y) / sum(e) FROM w GROUP BY f
UNION ALL SELECT 'eta squared', k, (sum(s * s / w) - sum(s) * sum(s) / sum(w)) / (sum(q) - sum(s) * sum(s) / sum(w)) FROM es GROUP BY k
UNION ALL SELECT 'interactions', k, (sum(s * s / w) - sum(s) * sum(s) / sum(w)) / (sum(q) - sum(s) * sum(s) / sum(w)) FROM ps GROUP BY k
UNION ALL SELECT 'mean of x', '', avg(x) FROM w UNION ALL SELECT 'mean of mu', '', avg(mu) FROM w""",
)
def rep_explore(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the exploration report, section by section."""
    t = orders(spark, d)
    out = report.explore_data(t, "y", ["f", "g"], ["x", "mu"], "e", "gamma", rare_pct=0.0, max_candidates=6)
    entries = [("response", k, out["response"][k]) for k in ("mean_rate", "p50", "p99", "exposure")]
    entries += [("missing", r["name"], r["missing"]) for r in out["missing"]]
    entries += [("correlation", f"{r['a']}~{r['b']}", r["correlation"]) for r in out["correlations"]]
    entries += [("exposure of levels", r["level"], r["exposure"]) for r in out["factors"]["f"]["levels"]]
    entries += [("rate of levels", r["level"], r["actual_mean"]) for r in out["factors"]["f"]["levels"]]
    entries += [("eta squared", k, out["factors"][k]["univariate"]["eta_squared"]) for k in ("f", "g")]
    entries += [("interactions", f"{r['a']}~{r['b']}", r["r2"]) for r in out["interactions"]]
    entries += [(f"mean of {k}", "", out["factors"][k]["stats"]["mean"]) for k in ("x", "mu")]
    return _entries(spark, entries)


@query(
    "section key value.5",
    """WITH {orders}, s AS (SELECT f, avg(y) AS m FROM o WHERE id % 4 > 0 GROUP BY f), p AS (SELECT o.*, s.m AS p, id % 4 > 0 AS train FROM o JOIN s USING (f)), t AS (SELECT * FROM p WHERE train),
r AS (SELECT *, CASE WHEN y > p THEN 1 ELSE -1 END * sqrt(greatest(2 * (y / p - 1 - ln(y / p)), 0)) AS r FROM t),
e AS (SELECT g, sum(r) AS s, sum(r * r) AS q, count(*) AS n FROM r GROUP BY g)
SELECT 'train' AS section, 'deviance' AS key, sum(2 * (y / p - 1 - ln(y / p))) AS value FROM t UNION ALL SELECT 'train', 'dispersion', sum(pow((y - p) / p, 2)) / (count(*) - 5) FROM t
UNION ALL SELECT CASE WHEN train THEN 'train' ELSE 'test' END, 'ae', sum(y) / sum(p) FROM p GROUP BY train
UNION ALL SELECT 'level ae', g, sum(y) / sum(p) FROM t GROUP BY g UNION ALL SELECT 'level ae of test', g, sum(y) / sum(p) FROM p WHERE NOT train GROUP BY g
UNION ALL SELECT 'residuals', 'mean', avg(r) FROM r UNION ALL SELECT 'residuals', 'std', stddev_pop(r) FROM r
UNION ALL SELECT 'residual pattern', 'g', (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) FROM e
UNION ALL SELECT 'partial dependence', f, avg(p) FROM t GROUP BY f
UNION ALL SELECT 'base', 'loss', avg(2 * (y / base - 1 - ln(y / base))) FROM t UNION ALL SELECT 'base', 'ae', sum(y) / sum(base) FROM t""",
)
def rep_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the diagnostics report over a train and a test part, with a base model; a model of one factor fits its means."""
    t = orders(spark, d)
    train = t.filter(c.id % 4 > 0)
    m = GLM("y", FLAG, train, family="gamma").fit()
    out = report.diagnose(m, train, "id", ["f", "g"], ["x"], test=t.filter(c.id % 4 == 0), base="base")
    m.close()
    entries = [("train", k, out["train"]["metrics"][k]) for k in ("deviance", "dispersion")]
    entries += [(k, "ae", out[k]["total"]["ae"]) for k in ("train", "test")]
    entries += [("level ae", r["level"], r["ae"]) for r in out["train"]["levels"]["g"]] + [("level ae of test", r["level"], r["ae"]) for r in out["test"]["levels"]["g"]]
    entries += [("residuals", k, out["residuals"][k]) for k in ("mean", "std")]
    entries += [("residual pattern", "g", out["factors"]["g"]["residual_pattern"]["eta_squared"])]
    entries += [("partial dependence", r["level"], r["prediction"]) for r in out["factors"]["f"]["partial_dependence"]]
    return _entries(spark, entries + [("base", k, out["base"]["base"][k]) for k in ("loss", "ae")])
