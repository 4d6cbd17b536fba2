"""Queries: designs with interactions and encodings, diagnostics of designs and terms, criteria, summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.families import get_family, log_likelihood
from riskloom.functions.links import get_link
from riskloom.functions.special import chi2_sf, f_sf, t_sf2
from riskloom.operators import diagnostics, encoding, explore, factors, metrics, quantiles, ranking, solvers, splines
from riskloom.operators.gram import row_sums
from riskloom.operators.model import GLM, _pass
from riskloom.operators.prefix import ordered, released
from riskloom.plans.fits import FLAG, _sums
from riskloom.plans.registry import c, lines, orders, query, table
from riskloom.plans.spec import ModelSpec

LINEAR, FACTOR = {"type": "linear"}, {"type": "categorical"}

# designs

_B = "(SELECT min(x) AS a, max(x) AS z FROM o)"


@query(
    "feature total.3 squares.3",
    f"""WITH {{orders}}, kn AS {_B}, s AS (SELECT f, sum(y) AS s, count(*) AS n FROM o GROUP BY f), p AS (SELECT sum(s) / sum(n) AS p FROM s),
q AS (SELECT f || ':' || g AS k, count(*) AS n FROM o GROUP BY 1),
d AS (SELECT o.*, (x - a) / (z - a) AS u, (s.s + p) / (s.n + 1) AS te, 1e0 * q.n / (SELECT max(n) FROM q) AS fe FROM o JOIN s USING (f) JOIN q ON q.k = f || ':' || g, p, kn),
v AS (SELECT unnest(['O', 'P']) AS v),
k AS (SELECT 'TE(f)' AS feature, te AS c FROM d UNION ALL SELECT 'FE(f:g)', fe FROM d UNION ALL SELECT 'mu:TE(f)', mu * te FROM d UNION ALL SELECT 'mu:x', mu * x FROM d
UNION ALL SELECT 'g[T.' || v || ']:mu:e', CASE WHEN g = v THEN mu * e ELSE 0 END FROM d, v
UNION ALL SELECT 'bs(x, 2/4):g[T.' || v || ']', CASE WHEN g = v THEN 3 * u * (1 - u) * (1 - u) ELSE 0 END FROM d, v
UNION ALL SELECT 'bs(x, 3/4):g[T.' || v || ']', CASE WHEN g = v THEN 3 * u * u * (1 - u) ELSE 0 END FROM d, v
UNION ALL SELECT 'bs(x, 4/4):g[T.' || v || ']', CASE WHEN g = v THEN u * u * u ELSE 0 END FROM d, v
UNION ALL SELECT 'bs(x, ' || i || '/4):mu', mu * CASE i WHEN 2 THEN 3 * u * (1 - u) * (1 - u) WHEN 3 THEN 3 * u * u * (1 - u) ELSE u * u * u END FROM d, (SELECT unnest([2, 3, 4]) AS i))
SELECT feature, sum(c) / count(*) AS total, sum(c * c) / count(*) AS squares FROM k GROUP BY feature""",
)
def ft_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Columns of encodings and of products with splines, encodings, several factors and numbers, as scoring sees them: means of each and its square."""
    t = orders(spark, d)
    bs, te = {"type": "bs", "df": 4}, {"type": "target_encoding"}
    spec = ModelSpec.parse(
        "y", {"f": te},
        [{"f": FACTOR, "g": FACTOR, "frequency_encoding": True}, {"mu": LINEAR, "f": te}, {"mu": LINEAR, "x": LINEAR}, {"g": FACTOR, "mu": LINEAR, "e": LINEAR}, {"x": bs, "g": FACTOR}, {"x": bs, "mu": LINEAR}],
    ).fit(t)
    df = t
    for term in spec.terms:
        df = term.prepared(df, None)
    n = t.count()
    return _sums(df, spec.columns()[1:]).select("feature", (F.col("total") / n).alias("total"), (F.col("squares") / n).alias("squares"))


@query(
    "code* n* total.3",
    "WITH s AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code, p_retailprice AS p FROM part) SELECT code, count(*) AS n, sum(p) AS total FROM s WHERE code > 0 GROUP BY code",
)
def prj_dummy_idx(spark: SparkSession, d: str) -> DataFrame:
    """The design of a factor with many levels from its codes: column sums of the indicator array."""
    t = quantiles.factorized(table(spark, d, "part"), F.col("p_type"))
    with released():
        n = t.agg(F.max("code")).first()[0] + 1
    cells = t.select("p_retailprice", F.posexplode(quantiles.indicators(F.col("code"), n)).alias("k", "x")).filter("x <> 0")
    return cells.groupBy((F.col("k") + 1).alias("code")).agg(F.sum("x").alias("n"), F.sum(F.col("x") * F.col("p_retailprice")).alias("total"))


@query(
    "kind bin* n*",
    """WITH {orders}, w AS (SELECT x, CAST(x AS VARCHAR) AS t, f, CASE WHEN f = '2-HIGH' THEN NULL ELSE f END AS h FROM o),
q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM w), r AS (SELECT h, dense_rank() OVER (ORDER BY h) - 1 AS k FROM (SELECT DISTINCT h FROM w WHERE h IS NOT NULL)),
b AS (SELECT (x >= e[1])::INT + (x >= e[2])::INT + (x >= e[3])::INT + (x >= e[4])::INT AS b FROM w, q)
SELECT 'number' AS kind, b AS bin, count(*) AS n FROM b GROUP BY b UNION ALL SELECT 'text of numbers', b, count(*) FROM b GROUP BY b
UNION ALL SELECT 'text', coalesce(k, (SELECT count(*) FROM r)), count(*) FROM w LEFT JOIN r USING (h) GROUP BY 2""",
)
def prj_discretize_text(spark: SparkSession, d: str) -> DataFrame:
    """Quantile bins of numbers, also of such as text; ranks of other text, null last."""
    t = orders(spark, d).select("x", c.x.cast("string").alias("t"), F.when(c.f != "2-HIGH", c.f).alias("h"))
    kinds = {"number": c.x, "text of numbers": F.col("t"), "text": F.col("h")}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), quantiles.discretized(t, v).cast("long").alias("bin")) for k, v in kinds.items()])
    return t.select(F.explode(each).alias("r")).groupBy("r.kind", "r.bin").agg(F.count(F.lit(1)).alias("n"))


@query("family value.4", "WITH {lines}, m AS (SELECT avg(y) AS m FROM l) SELECT 'gaussian' AS family, sum(y) AS value FROM l UNION ALL SELECT 'poisson', sum(greatest(y + 0.1, 0.1)) FROM l UNION ALL SELECT 'gamma', sum(greatest(y, 0.01 * m)) FROM l, m UNION ALL SELECT 'binomial', sum((b + 0.5) / 2) FROM l")
def prj_mu_init(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the means that fits start from, by the pass that fits use."""
    out = []
    for name, y in (("gaussian", "y"), ("poisson", "y"), ("gamma", "y"), ("binomial", "b")):
        t = lines(spark, d).select(F.array(F.lit(1.0)).alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("o"))
        mean = t.agg(F.avg("y")).first()[0]
        start = get_family(name).start_np
        out.append((name, float(row_sums(t, lambda x, y, w, o, start=start, mean=mean: np.array([start(y, mean).sum()]), 1)[0])))
    return spark.createDataFrame(out, "family string, value double")


@query("i* j* value.6", "SELECT i, j, sum(a.v * b.v) AS value FROM (SELECT k, k + o AS i, [1, -2, 1][o + 1] AS v FROM range(6) t(k), range(3) u(o)) a JOIN (SELECT k, k + o AS j, [1, -2, 1][o + 1] AS v FROM range(6) t(k), range(3) u(o)) b USING (k) GROUP BY i, j")
def ft_penalty(spark: SparkSession, d: str) -> DataFrame:
    """D'D of second differences of eight coefficients, where it isn't 0."""
    s = splines.penalty_matrix(8)
    return spark.createDataFrame([(i, j, float(s[i, j])) for i in range(8) for j in range(8) if abs(i - j) <= 2], "i long, j long, value double")


# diagnostics of designs

_R = "r AS (SELECT corr(x, t) AS a, corr(x, y) AS b, corr(t, y) AS c FROM l), v AS (SELECT 'x' AS feature, 1 / (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)) AS vif FROM r UNION ALL SELECT 't', 1 / (1 - (a * a + c * c - 2 * a * b * c) / (1 - b * b)) FROM r UNION ALL SELECT 'y', 1 / (1 - (b * b + c * c - 2 * a * b * c) / (1 - a * a)) FROM r)"


@query("feature vif.6 severity rank*", "WITH {lines}, " + _R + " SELECT feature, vif, 'none' AS severity, row_number() OVER (ORDER BY vif DESC) AS rank FROM v")
def agg_vif_design(spark: SparkSession, d: str) -> DataFrame:
    """Variance inflation of design columns, largest first."""
    t = lines(spark, d)
    spec = ModelSpec.parse("p", {k: LINEAR for k in ("x", "t", "y")}).fit(t)
    rows = [(r["feature"], r["vif"], r["severity"], k + 1) for k, r in enumerate(diagnostics.design_vif(t, spec))]
    return spark.createDataFrame(rows, "feature string, vif double, severity string, rank long")


@query("factor vif.6 rank*", "WITH {lines}, " + _R + " SELECT feature AS factor, vif, row_number() OVER (ORDER BY vif DESC) AS rank FROM v")
def srt_vif(spark: SparkSession, d: str) -> DataFrame:
    return explore.vif(lines(spark, d), ["x", "t", "y"])


@query(
    "rank* expected_rank* constant alike condition_number.2 valid",
    """WITH {lines}, s AS (SELECT sum(x * x) AS xx, sum(x) AS sx, 1e0 * count(*) AS n FROM l), g AS (SELECT (n + xx + sqrt((n - xx) * (n - xx) + 4 * sx * sx)) / 2 AS hi, (n * xx - sx * sx) AS det FROM s)
SELECT 2 AS rank, 4 AS expected_rank, 'one' AS constant, 'x~I(x * 2)' AS alike, -1e0 AS condition_number, false AS valid UNION ALL SELECT 2, 2, '', '', sqrt(hi * hi / det), true FROM g""",
)
def agg_design_report(spark: SparkSession, d: str) -> DataFrame:
    """A design with a constant and a doubled column, and a sound one; condition numbers as -1 where infinite."""
    t = lines(spark, d).withColumn("one", F.lit(5.0))
    out = []
    for terms in ({"x": LINEAR, "twice": {"type": "expression", "expr": "x * 2"}, "one": LINEAR}, {"x": LINEAR}):
        r = diagnostics.design_report(t, ModelSpec.parse("y", terms).fit(t))
        out.append((r["rank"], r["expected_rank"], ",".join(r["constant"]), ",".join(f"{a}~{b}" for a, b, _ in r["alike"]), r["condition_number"] if np.isfinite(r["condition_number"]) else -1.0, r["valid"]))
    return spark.createDataFrame(out, "rank long, expected_rank long, constant string, alike string, condition_number double, valid boolean")


# terms that a model lacks or has


@query(
    "statistic.5 df* p_value.6",
    "WITH {lines}, s AS (SELECT f, count(*) AS n, sum(y) AS y FROM l GROUP BY f), m AS (SELECT sum(y) / sum(n) AS m FROM s), t AS (SELECT sum((y - n * m) * (y - n * m) / (n * m)) AS c FROM s, m) SELECT c AS statistic, 2 AS df, exp(-c / 2) AS p_value FROM t",
)
def inf_score_cat(spark: SparkSession, d: str) -> DataFrame:
    """Score test of a factor that a Poisson model of the mean lacks: Pearson's chi-squared of its levels."""
    t = lines(spark, d)
    r = diagnostics.score_test_levels(GLM("y", {}, t, family="poisson").fit(), t, c.f)
    return spark.createDataFrame([(r["statistic"], r["df"], r["p_value"])], "statistic double, df long, p_value double")


@query(
    "statistic.5 df*",
    "WITH {lines}, s AS (SELECT y, avg(y) OVER (PARTITION BY f) AS z, avg(y) OVER () AS m FROM l) SELECT pow(sum(z * (y - m)), 2) / (sum(m * z * z) - pow(sum(m * z), 2) / sum(m)) AS statistic, 1 AS df FROM s",
)
def inf_score_cat_encoded(spark: SparkSession, d: str) -> DataFrame:
    """The same of the levels' means as a number."""
    t = lines(spark, d)
    r = diagnostics.score_test_encoded(GLM("y", {}, t, family="poisson").fit(), t, c.f)
    return spark.createDataFrame([(r["statistic"], r["df"])], "statistic double, df long")


@query(
    "rank* feature z.4",
    """WITH {lines}, s AS (SELECT f, sum(y) AS y, sum(e) AS e FROM l GROUP BY f), a AS (SELECT ln(y / e) AS b, 1 / y AS v FROM s WHERE f = 'A'),
k AS (SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, CASE WHEN f = 'A' THEN b ELSE ln(y / e) - b END / sqrt(CASE WHEN f = 'A' THEN v ELSE v + 1 / y END) AS z FROM s, a)
SELECT row_number() OVER (ORDER BY feature = 'Intercept', abs(z) DESC) AS rank, feature, z FROM k""",
)
def srt_coef(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients by the size of z, the intercept last."""
    rows = diagnostics.sorted_coefficients(GLM("y", FLAG, lines(spark, d), family="poisson", offset="e").fit())
    return spark.createDataFrame([(k + 1, r["feature"], r["z"]) for k, r in enumerate(rows)], "rank long, feature string, z double")


@query(
    "feature low.5 high.5 signif",
    """WITH {lines}, s AS (SELECT f, sum(y) AS y, sum(e) AS e FROM l GROUP BY f), a AS (SELECT ln(y / e) AS b, 1 / y AS v FROM s WHERE f = 'A'),
k AS (SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, CASE WHEN f = 'A' THEN b ELSE ln(y / e) - b END AS b, sqrt(CASE WHEN f = 'A' THEN v ELSE v + 1 / y END) AS s FROM s, a)
SELECT feature, b - 1.959963984540054 * s AS low, b + 1.959963984540054 * s AS high,
CASE WHEN abs(b / s) > 3.2905267314919255 THEN '***' WHEN abs(b / s) > 2.5758293035489004 THEN '**' WHEN abs(b / s) > 1.959963984540054 THEN '*' WHEN abs(b / s) > 1.6448536269514722 THEN '.' ELSE '' END AS signif FROM k""",
)
def inf_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = [(r["feature"], r["low"], r["high"], r["signif"]) for r in GLM("y", FLAG, lines(spark, d), family="poisson", offset="e").fit().coef_table()]
    return spark.createDataFrame(rows, "feature string, low double, high double, signif string")


@query(
    "name value.8",
    """WITH {lines}, s AS (SELECT abs(corr(x, y)) * 50 AS q FROM l) SELECT unnest(['chi2 2', 'chi2 4', 't 1', 't 2', 'F 2, 7']) AS name,
unnest([exp(-q / 2), exp(-q / 2) * (1 + q / 2), 1 - 2 * atan(q) / pi(), 1 - q / sqrt(2 + q * q), pow(1 + 2 * q / 7, -3.5)]) AS value FROM s""",
)
def inf_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Tail probabilities that have closed forms, at a statistic of the data."""
    q = abs(lines(spark, d).agg(F.corr("x", "y")).first()[0]) * 50
    rows = [("chi2 2", chi2_sf(q, 2)), ("chi2 4", chi2_sf(q, 4)), ("t 1", t_sf2(q, 1)), ("t 2", t_sf2(q, 2)), ("F 2, 7", f_sf(q, 2, 7))]
    return spark.createDataFrame(rows, "name string, value double")


@query(
    "kind feature std_error.6",
    """WITH {lines}, s AS (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS a, count(*) AS n, var_pop(x) AS v, avg(x) AS m FROM l),
k AS (SELECT x, pow(y - a - sl * x, 2) AS r, 1e0 / n + pow(x - m, 2) / (n * v) AS h, m, n, v FROM l, s),
j AS (SELECT unnest(['HC0', 'HC2', 'HC3']) AS kind), w AS (SELECT kind, r / CASE kind WHEN 'HC0' THEN 1 WHEN 'HC2' THEN 1 - h ELSE (1 - h) * (1 - h) END AS r, x, m, n, v FROM k, j)
SELECT kind, 'x' AS feature, sqrt(sum(pow(x - m, 2) * r)) / (min(n) * min(v)) AS std_error FROM w GROUP BY kind UNION ALL SELECT kind, 'Intercept', sqrt(sum(pow(1e0 / n - m * (x - m) / (n * v), 2) * r)) FROM w GROUP BY kind""",
)
def inf_robust_others(spark: SparkSession, d: str) -> DataFrame:
    m = GLM("y", {"x": LINEAR}, lines(spark, d)).fit()
    rows = [(k, r["feature"], r["std_error"]) for k in ("HC0", "HC2", "HC3") for r in m.coef_table(robust=k)]
    return spark.createDataFrame(rows, "kind string, feature string, std_error double")


# fits


@query(
    "feature estimate.5 std_error.6 selected",
    """WITH {lines}, s AS (SELECT covar_pop(x, p) * count(*) AS c, var_pop(x) * count(*) AS v, avg(x) AS mx, avg(p) AS my, count(*) AS n FROM l),
k AS (SELECT sign(c) * greatest(abs(c) - 5, 0) / v AS sl, v, mx, my, n FROM s), r AS (SELECT sum(pow(p - my - sl * (x - mx), 2)) / (min(n) - 2) AS s2 FROM l, k)
SELECT 'x' AS feature, sl AS estimate, sqrt(s2 / v) AS std_error, abs(sl) > 1e-10 AS selected FROM k, r UNION ALL SELECT 'Intercept', my - sl * mx, sqrt(s2 * (1e0 / n + mx * mx / v)), true FROM k, r""",
)
def fit_lasso_errors(spark: SparkSession, d: str) -> DataFrame:
    """A lasso's standard errors come from the unpenalised information; selected are the coefficients that aren't 0."""
    m = GLM("p", {"x": LINEAR}, lines(spark, d)).fit(alpha=5.0, l1_ratio=1.0)
    own = set(m.selected())
    return spark.createDataFrame([(r["feature"], r["estimate"], r["std_error"], r["feature"] in own) for r in m.coef_table()], "feature string, estimate double, std_error double, selected boolean")


@query("feature estimate.5", "WITH {lines}, s AS (SELECT sum(x * y) / sum(x * x) AS b, sum(-t * y) AS c FROM l) SELECT 'x' AS feature, b AS estimate FROM s UNION ALL SELECT '-t', 0e0 FROM s")
def fit_nnls(spark: SparkSession, d: str) -> DataFrame:
    """Non-negative least squares on sums of one pass: a column of negative values stays out."""
    t = lines(spark, d).select(F.array("x", -c.t).alias("x"), "y", F.lit(1.0).alias("w"), F.lit(0.0).alias("o"))
    v = row_sums(t, lambda x, y, w, o: np.concatenate([(x.T @ x).ravel(), x.T @ y]), 6)
    beta = solvers.nnls(v[:4].reshape(2, 2), v[4:])
    return spark.createDataFrame([("x", float(beta[0])), ("-t", float(beta[1]))], "feature string, estimate double")


@query(
    "gcv.4 aic.3 bic.3 grid.6",
    """WITH {lines}, s AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 10) AS sl, avg(x) AS mx, avg(y) AS my, 1 + var_pop(x) * count(*) / (var_pop(x) * count(*) + 10) AS edf, count(*) AS n FROM l),
k AS (SELECT sum(pow(y - my - sl * (x - mx), 2)) AS dev, min(edf) AS edf, 1e0 * min(n) AS n FROM l, s)
SELECT n * dev / pow(n - edf, 2) AS gcv, dev + 2 * edf AS aic, dev + ln(n) * edf AS bic, (SELECT sum(pow(10, -4 + 2 * i)) FROM range(5) t(i)) / 1e4 AS grid FROM k""",
)
def fit_criteria(spark: SparkSession, d: str) -> DataFrame:
    """GCV, AIC and BIC of a ridge fit at its effective degrees of freedom; the grid of penalties by its sum."""
    m = GLM("y", {"x": LINEAR}, lines(spark, d)).fit(alpha=10.0)
    s = np.diag([0.0, 10.0])
    edf, n, dev = float(solvers.edf(np.linalg.inv(m.bread) - s, s).sum()), m.fit.n, m.fit.deviance
    return spark.createDataFrame([(solvers.gcv(n, dev, edf), solvers.aic_score(dev, edf), solvers.bic_score(dev, n, edf), float(solvers.lambda_grid(5).sum()) / 1e4)], "gcv double, aic double, bic double, grid double")


@query("zz.2 deviance.2 pearson.2 z.3", "WITH {lines} SELECT sum(e * pow(ln(3e1) + (y - 3e1) / 3e1, 2) * 3e1) AS zz, sum(e * 2 * (y * ln(y / 3e1) - (y - 3e1))) AS deviance, sum(e * pow(y - 3e1, 2) / 3e1) AS pearson, sum(e * 3e1 * (ln(3e1) + (y - 3e1) / 3e1)) AS z FROM l")
def agg_wls(spark: SparkSession, d: str) -> DataFrame:
    """z'Wz, the deviance, Pearson's chi-squared and X'Wz of a Poisson model with the mean 30, by the pass that fits use."""
    t = lines(spark, d).select(F.array(F.lit(1.0)).alias("x"), "y", c.e.alias("w"), F.lit(0.0).alias("o"))
    f, size = _pass(get_family("poisson"), get_link("log"), np.array([np.log(30.0)]), 30.0, 1)
    v = row_sums(t, f, size)
    return spark.createDataFrame([(float(v[2]), float(v[3]), float(v[4]), float(v[1]))], "zz double, deviance double, pearson double, z double")


@query("feature estimate.6", "WITH {lines}, s AS (SELECT f, sum(e * (y - x)) / sum(e) AS b FROM l GROUP BY f) SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, b - CASE WHEN f = 'A' THEN 0 ELSE (SELECT b FROM s WHERE f = 'A') END AS estimate FROM s")
def src_array_arg(spark: SparkSession, d: str) -> DataFrame:
    """Weights and offset as Columns and not as names."""
    m = GLM("y", FLAG, lines(spark, d), weights=c.e * 1.0, offset=c.x * 1.0).fit()
    return spark.createDataFrame(list(m.params.items()), "feature string, estimate double")


@query(
    "ratio.5 severity",
    "WITH {lines}, s AS (SELECT y, avg(y) OVER (PARTITION BY f) AS m FROM l), r AS (SELECT sum((y - m) * (y - m) / m) / (count(*) - 3) AS r FROM s) SELECT r AS ratio, CASE WHEN r < 1.5 THEN 'none' WHEN r < 2 THEN 'mild' WHEN r < 5 THEN 'moderate' ELSE 'severe' END AS severity FROM r",
)
def agg_overdispersion_post(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = GLM("y", FLAG, t, family="poisson").fit()
    r = metrics.overdispersion(metrics.dataset_metrics(m.predict(t), m.family, c.y, F.col("prediction"), 3).first()["dispersion"], m.df_resid)
    return spark.createDataFrame([(r["ratio"], r["severity"])], "ratio double, severity string")


# summaries


@query(
    "mean.5 std.5 min.5 max.5 skewness.5 kurtosis.5 p1.5 p5.5 p10.5 p25.5 p50.5 p75.5 p90.5 p95.5 p99.5",
    "WITH {lines}, r AS (SELECT y - mu AS v, row_number() OVER (ORDER BY y - mu) AS rn, count(*) OVER () AS n FROM l), m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM r) SELECT min(m) AS mean, min(s) AS std, min(v) AS min, max(v) AS max, avg(pow((v - m) / s, 3)) AS skewness, avg(pow((v - m) / s, 4)) - 3 AS kurtosis, "
    + ", ".join(f"max(CASE WHEN rn = CAST(floor({p / 100} * (n - 1) + 0.5) AS BIGINT) + 1 THEN v END) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))
    + " FROM r, m",
)
def agg_resid_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Moments and nine percentiles of residuals."""
    return metrics.residual_summary(lines(spark, d), c.y - c.mu)


@query(
    "ks.5 ks_decile* weak",
    """WITH {orders}, r AS (SELECT *, row_number() OVER (ORDER BY mu, id) - 1 AS rn, count(*) OVER () AS n FROM o), b AS (SELECT least(rn // (n // 10), 9) AS b, sum(y) AS a, sum(mu) AS m, sum(e) AS e FROM r GROUP BY 1),
k AS (SELECT *, sum(a) OVER () AS ta, sum(m) OVER () AS tm, sum(e) OVER () AS te, sum(a) OVER (ORDER BY b) AS ca, sum(m) OVER (ORDER BY b) AS cm FROM b),
z AS (SELECT *, abs(100 * ca / ta - 100 * cm / tm) AS ks, a / e / (ta / te) AS lift FROM k)
SELECT max(ks) AS ks, arg_max(b, ks) + 1 AS ks_decile, coalesce(string_agg(CAST(b + 1 AS VARCHAR), ',' ORDER BY b) FILTER (abs(a / m - 1) > 0.2 OR (b < 3 AND lift > 0.8) OR (b > 6 AND lift < 1.2)), '') AS weak FROM z""",
)
def win_lift_summary(spark: SparkSession, d: str) -> DataFrame:
    """The decile of the largest gap and the weak deciles of a lift chart."""
    t = orders(spark, d)
    with released():
        r = ranking.lift_summary(ranking.lift_chart(t, c.y, c.mu, c.e, c.id))
    return spark.createDataFrame([(r["ks"], r["ks_decile"], ",".join(map(str, r["weak_deciles"])))], "ks double, ks_decile long, weak string")


@query("levels* rare* rare_pct.5", "WITH s AS (SELECT p_type, 1e2 * count(*) / sum(count(*)) OVER () AS p FROM part GROUP BY 1) SELECT count(*) AS levels, count(*) FILTER (p < 0.7) AS rare, coalesce(sum(p) FILTER (p < 0.7), 0) AS rare_pct FROM s")
def agg_rare_levels(spark: SparkSession, d: str) -> DataFrame:
    return factors.rare_levels(table(spark, d, "part"), F.col("p_type"), 0.7)


@query(
    "factor pattern",
    """SELECT 'line' AS factor, 'numeric' AS pattern UNION ALL SELECT 'f', 'alphabetic' UNION ALL SELECT 'k', 'prefix_numeric' UNION ALL SELECT 'size', 'size' UNION ALL SELECT 'f:g', CASE WHEN (SELECT bool_and(regexp_full_match(l_returnflag || '-' || l_linestatus, '[A-Za-z]+[0-9]+')) FROM lineitem) THEN 'prefix_numeric' END""",
)
def agg_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Whether the names of levels have an order."""
    t = lines(spark, d)
    size = F.when(c.y < 17, "Small").when(c.y < 34, "medium").otherwise("LARGE")
    t = t.select("line", "f", F.concat(F.lit("Region"), c.line).alias("k"), size.alias("size"), F.concat_ws("-", "f", "g").alias("f:g"))
    return explore.ordinal_pattern(t.withColumnRenamed("f:g", "fg"), ["line", "f", "k", "size", "fg"]).replace({"fg": "f:g"}, subset=["factor"])


@query(
    "factor ratio.5 variation",
    """WITH {orders}, s AS (SELECT 'f' AS factor, f AS v, avg(mu) AS m FROM o GROUP BY f UNION ALL SELECT 'x', CAST(x AS VARCHAR), avg(mu + x) FROM o GROUP BY x), r AS (SELECT factor, max(m) / min(m) AS r FROM s GROUP BY factor)
SELECT factor, r AS ratio, CASE WHEN r > 2 THEN 'high_variation' WHEN r > 1.2 THEN 'moderate_variation' ELSE 'low_variation' END AS variation FROM r""",
)
def agg_pd_variation(spark: SparkSession, d: str) -> DataFrame:
    """How far the mean predictions of a factor's levels lie apart."""
    t, out = orders(spark, d), []
    for name, mu in (("f", c.mu), ("x", c.mu + c.x)):
        p = [r["prediction"] for r in factors.partial_dependence_levels(t, F.col(name), mu).collect()]
        out.append((name, max(p) / min(p), factors.variation(p)[0]))
    return spark.createDataFrame(out, "factor string, ratio double, variation string")


@query(
    "shape intercept.4",
    """WITH {lines}, s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM l)
SELECT CASE WHEN abs(b) * (hi - lo) / (a + b * (lo + hi) / 2) < 0.05 THEN 'flat' WHEN b > 0 THEN 'linear_increasing' ELSE 'linear_decreasing' END AS shape, a AS intercept FROM s""",
)
def agg_pd_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape of a partial dependence."""
    from riskloom.operators.report import partial_dependence

    t = lines(spark, d).select("x", "y")
    m = GLM("y", {"x": LINEAR}, t).fit()
    shape = factors.effect_shape([p["prediction"] for p in partial_dependence(m, t, "x")])
    return spark.createDataFrame([(shape[0], m.params["Intercept"])], "shape string, intercept double")


@query(
    "a b cells* r2.8 recommendation",
    """WITH {orders}, w AS (SELECT *, (mu >= q[1])::INT + (mu >= q[2])::INT + (mu >= q[3])::INT + (mu >= q[4])::INT AS k FROM o, (SELECT quantile_cont(mu, [0.2, 0.4, 0.6, 0.8]) AS q FROM o)),
p AS (SELECT 'mu' AS a, 'f' AS b, CAST(k AS VARCHAR) AS x, f AS z, y FROM w UNION ALL SELECT 'mu', 'g', CAST(k AS VARCHAR), g, y FROM w UNION ALL SELECT 'f', 'g', f, g, y FROM w),
s AS (SELECT a, b, x, z, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM p GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT a, b, count(*) AS cells, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS r2 FROM s GROUP BY a, b ORDER BY r2 DESC LIMIT 2)
SELECT *, CASE WHEN a = 'f' THEN 'an interaction of the levels of f and g' ELSE 'a slope of mu for each level of ' || b END AS recommendation FROM t""",
)
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The two pairs whose cells explain most, and how to model them; all pairs from one aggregate."""
    from riskloom.operators.report import _strongest

    rows = [(r["a"], r["b"], r["cells"], r["r2"], r["recommendation"]) for r in _strongest(orders(spark, d), ["f", "g"], ["mu"], c.y, None, 2, set())]
    return spark.createDataFrame(rows, "a string, b string, cells long, r2 double, recommendation string")


@query(
    "family log_likelihood.3",
    """WITH {lines}, m AS (SELECT avg(b) AS b, avg(y) AS y FROM l) SELECT 'binomial' AS family, sum(l.b * ln(m.b) + (1 - l.b) * ln(1 - m.b)) AS log_likelihood FROM l, m
UNION ALL SELECT 'tweedie', -sum(pow(l.y, 0.5) / -0.25 + 2 * l.y / sqrt(m.y) + 2 * sqrt(m.y)) FROM l, m""",
)
def agg_loglik_others(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihoods of models of the mean; Tweedie's is minus half the deviance."""
    t = lines(spark, d)
    b, y = t.agg(F.avg("b"), F.avg("y")).first()
    one = F.lit(1.0)
    both = t.agg(log_likelihood(get_family("binomial"), c.b, F.lit(b), one, 1.0).alias("binomial"), log_likelihood(get_family("tweedie", 1.0, 1.5), c.y, F.lit(y), one, 1.0).alias("tweedie")).first()
    return spark.createDataFrame(list(both.asDict().items()), "family string, log_likelihood double")


@query("k* n* ranks.0 differs", "WITH {orders} SELECT k, (SELECT count(*) FROM o) AS n, (SELECT 1e0 * count(*) * (count(*) + 1) / 2 FROM o) AS ranks, k > 0 AS differs FROM range(4) t(k)")
def win_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the rows by hashes of a key: each ranks every row once, and no two are the same."""
    t, out, first = orders(spark, d).select("id"), [], None
    for k, order in enumerate(encoding.permutations(c.id, 4)):
        with released():
            r = ordered(t, order)
            own = r.agg(F.count_distinct("rn"), F.sum("rn"), F.sum(F.col("rn") * F.pmod("id", F.lit(1009)))).first()
        out.append((k, own[0], float(own[1]), first is not None and own[2] != first))
        first = own[2] if first is None else first
    return spark.createDataFrame(out, "k long, n long, ranks double, differs boolean")


@query("factor base exposure.3", "WITH {orders}, s AS (SELECT 'f' AS factor, f AS v, sum(e) AS e FROM o GROUP BY f UNION ALL SELECT 'g', g, sum(e) FROM o GROUP BY g) SELECT factor, arg_max(v, e) AS base, max(e) AS exposure FROM s GROUP BY factor")
def agg_suggested_base(spark: SparkSession, d: str) -> DataFrame:
    """The level with the most exposure of each factor."""
    t, out = orders(spark, d), []
    for name in ("f", "g"):
        best = factors.ae_by_level(t, F.col(name), c.y, c.mu, c.e, 0.0).orderBy(F.col("exposure").desc(), "level").first()
        out.append((name, best["level"], best["exposure"]))
    return spark.createDataFrame(out, "factor string, base string, exposure double")


@query(
    "deviance.2 null_deviance.2 deviance_explained.8 dispersion.6 log_likelihood.1 aic.1 bic.1",
    """WITH {lines}, s AS (SELECT y, avg(y) OVER (PARTITION BY f) AS m, avg(y) OVER () AS g FROM l), t AS (SELECT sum(2 * (y * ln(y / m) - (y - m))) AS d, sum(2 * (y * ln(y / g) - (y - g))) AS n0, sum((y - m) * (y - m) / m) / (count(*) - 3) AS p, sum(y * ln(m) - m - lgamma(y + 1)) AS ll, count(*) AS n FROM s)
SELECT d AS deviance, n0 AS null_deviance, 1 - d / n0 AS deviance_explained, p AS dispersion, ll AS log_likelihood, 6 - 2 * ll AS aic, 3 * ln(n) - 2 * ll AS bic FROM t""",
)
def agg_metrics_fit(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = GLM("y", FLAG, t, family="poisson").fit()
    return metrics.fit_metrics(m.predict(t), m.family, c.y, F.col("prediction"), 3)


@query("a b n* weight.3 wz.3", "WITH {lines} SELECT f AS a, line AS b, count(*) AS n, sum(e) AS weight, sum(e * y) AS wz FROM l GROUP BY f, line")
def agg_cell_gram(spark: SparkSession, d: str) -> DataFrame:
    """The Gram matrix of the cells of two factors from one aggregate."""
    return factors.cell_gram(lines(spark, d), c.f, c.line, c.e, c.y)
