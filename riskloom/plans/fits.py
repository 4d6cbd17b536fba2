"""Queries: designs, fits with closed forms, inference, prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.families import log_likelihood
from riskloom.operators import splines
from riskloom.operators.model import GLM, select_alpha
from riskloom.plans.registry import c, lines, orders, query
from riskloom.plans.spec import ModelSpec

FLAG = {"f": {"type": "categorical"}}


def _coefficients(spark: SparkSession, model, robust: str | None = None) -> DataFrame:
    rows = [(r["feature"], r["estimate"], r["std_error"]) for r in model.coef_table(robust=robust)]
    return spark.createDataFrame(rows, "feature string, estimate double, std_error double")


def _sums(df: DataFrame, columns: list) -> DataFrame:
    """Sum and sum of squares of each design column, one row per column."""
    aggregates = [F.sum(c).alias(f"s{k}") for k, (_, c) in enumerate(columns)] + [F.sum(c * c).alias(f"q{k}") for k, (_, c) in enumerate(columns)]
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"s{k}").alias("total"), F.col(f"q{k}").alias("squares")) for k, (n, _) in enumerate(columns)]
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# designs


@query(
    "feature total.3 squares.3",
    """WITH {lines}, k AS (SELECT 'Intercept' AS feature, sum(1e0) AS total, sum(1e0) AS squares FROM l
UNION ALL SELECT 'f[T.' || v || ']', sum(CASE WHEN f = v THEN 1e0 ELSE 0e0 END), sum(CASE WHEN f = v THEN 1e0 ELSE 0e0 END) FROM l, (SELECT unnest(['N', 'R']) AS v) GROUP BY v
UNION ALL SELECT 'x', sum(x), sum(x * x) FROM l
UNION ALL SELECT 'f[T.' || v || ']:t', sum(CASE WHEN f = v THEN t ELSE 0e0 END), sum(CASE WHEN f = v THEN t * t ELSE 0e0 END) FROM l, (SELECT unnest(['N', 'R']) AS v) GROUP BY v
UNION ALL SELECT 'f[T.' || v || ']:g[T.O]', sum(CASE WHEN f = v AND g = 'O' THEN 1e0 ELSE 0e0 END), sum(CASE WHEN f = v AND g = 'O' THEN 1e0 ELSE 0e0 END) FROM l, (SELECT unnest(['N', 'R']) AS v) GROUP BY v
UNION ALL SELECT 'x:t', sum(x * t), sum(x * t * x * t) FROM l
UNION ALL SELECT 'I(p / y)', sum(p / y), sum(p / y * p / y) FROM l
UNION ALL SELECT 'pos(t)', sum(t), sum(t * t) FROM l
UNION ALL SELECT 'g[F]', sum(CASE WHEN g = 'F' THEN 1e0 ELSE 0e0 END), sum(CASE WHEN g = 'F' THEN 1e0 ELSE 0e0 END) FROM l)
SELECT * FROM k""",
)
def ft_design(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of column that needs no fit of its own, by its sums."""
    t = lines(spark, d)
    spec = ModelSpec.parse(
        "y",
        {"f": {"type": "categorical"}, "x": {"type": "linear"}, "e1": {"type": "expression", "expr": "p / y"}, "t": {"type": "linear", "monotonicity": "increasing"}, "g": {"type": "categorical", "levels": ["F"]}},
        [{"f": {"type": "categorical"}, "t": {"type": "linear"}}, {"f": {"type": "categorical"}, "g": {"type": "categorical"}}, {"x": {"type": "linear"}, "t": {"type": "linear"}}],
    ).fit(t)
    return _sums(t, spec.columns())


@query(
    "feature total.3 squares.3",
    """WITH {lines}, c AS (SELECT f, g, line, t FROM l)
SELECT 'f[T.' || a || ']:g[T.O]:line[T.' || b || ']' AS feature, sum(CASE WHEN f = a AND g = 'O' AND line = b THEN 1e0 ELSE 0e0 END) AS total,
sum(CASE WHEN f = a AND g = 'O' AND line = b THEN 1e0 ELSE 0e0 END) AS squares FROM c, (SELECT unnest(['N', 'R']) AS a), (SELECT DISTINCT line AS b FROM c WHERE line > (SELECT min(line) FROM c)) GROUP BY a, b""",
)
def ft_int_cat_n(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    spec = ModelSpec.parse("y", {}, [{v: {"type": "categorical"} for v in ("f", "g", "line")}]).fit(t)
    return _sums(t, spec.columns()[1:])


_RANKS = "r AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS c FROM o), kn AS (SELECT min(x) AS lo, max(x) AS hi, max(CASE WHEN rn = CAST(floor(c * 0 + {p} * (c - 1)) AS BIGINT) + 1 THEN x END) AS k1{more} FROM r)"


@query(
    "feature total.2 squares.0",
    "WITH {orders}, "
    + _RANKS.replace("{p}", "0.25").replace("{more}", ", max(CASE WHEN rn = CAST(floor(0.5 * (c - 1)) AS BIGINT) + 1 THEN x END) AS k2, max(CASE WHEN rn = CAST(floor(0.75 * (c - 1)) AS BIGINT) + 1 THEN x END) AS k3")
    + """, b AS (SELECT x - lo AS n1,
 (pow(greatest(x - lo, 0), 3) - pow(greatest(x - hi, 0), 3)) / (hi - lo) - (pow(greatest(x - k3, 0), 3) - pow(greatest(x - hi, 0), 3)) / (hi - k3) AS n2,
 (pow(greatest(x - k1, 0), 3) - pow(greatest(x - hi, 0), 3)) / (hi - k1) - (pow(greatest(x - k3, 0), 3) - pow(greatest(x - hi, 0), 3)) / (hi - k3) AS n3 FROM o, kn)
SELECT 'ns(x, 1/4)' AS feature, sum(n1) AS total, sum(n1 * n1) AS squares FROM b UNION ALL SELECT 'ns(x, 2/4)', sum(n2), sum(n2 * n2) FROM b UNION ALL SELECT 'ns(x, 3/4)', sum(n3), sum(n3 * n3) FROM b""",
)
def ft_ns(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    return _sums(t, ModelSpec.parse("y", {"x": {"type": "ns", "df": 4}}).fit(t).columns()[1:])


@query(
    "feature total.4 squares.4",
    """WITH {orders}, kn AS (SELECT min(x) AS a, max(x) AS z FROM o), u AS (SELECT (x - a) / (z - a) AS u FROM o, kn)
SELECT 'bs(x, 2/4)' AS feature, sum(3 * u * (1 - u) * (1 - u)) AS total, sum(pow(3 * u * (1 - u) * (1 - u), 2)) AS squares FROM u
UNION ALL SELECT 'bs(x, 3/4)', sum(3 * u * u * (1 - u)), sum(pow(3 * u * u * (1 - u), 2)) FROM u UNION ALL SELECT 'bs(x, 4/4)', sum(u * u * u), sum(pow(u, 6)) FROM u""",
)
def ft_bs(spark: SparkSession, d: str) -> DataFrame:
    """Without interior knots cubic B-splines are the Bernstein polynomials."""
    t = orders(spark, d)
    return _sums(t, ModelSpec.parse("y", {"x": {"type": "bs", "df": 4}}).fit(t).columns()[1:])


@query(
    "feature total.4 squares.4",
    "WITH {orders}, " + _RANKS.replace("{p}", "0.5").replace("{more}", "") + """, u AS (SELECT CASE WHEN x < k1 THEN (k1 - x) / (k1 - lo) ELSE 0 END AS b1, CASE WHEN x < k1 THEN (x - lo) / (k1 - lo) ELSE (hi - x) / (hi - k1) END AS b2,
CASE WHEN x >= k1 THEN (x - k1) / (hi - k1) ELSE 0 END AS b3 FROM o, kn) SELECT 'b1' AS feature, sum(b1) AS total, sum(b1 * b1) AS squares FROM u UNION ALL SELECT 'b2', sum(b2), sum(b2 * b2) FROM u UNION ALL SELECT 'b3', sum(b3), sum(b3 * b3) FROM u""",
)
def ft_bs_linear(spark: SparkSession, d: str) -> DataFrame:
    """B-splines of degree 1 with one interior knot: hats."""
    t = orders(spark, d)
    knots = splines.bs_knots(t, c.x, 3, 1)
    return _sums(t, list(zip(("b1", "b2", "b3"), splines.bs_basis(c.x, knots, 1), strict=True)))


@query(
    "feature total.3",
    """WITH {orders}, kn AS (SELECT min(x) AS a, max(x) AS z FROM o), u AS (SELECT (x - a) / (z - a) AS u FROM o, kn)
SELECT 'is(x, ' || k || '/4)' AS feature, sum(CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 WHEN k = 4 THEN u * u * u WHEN k = 3 THEN u * u * u + 3 * u * u * (1 - u) WHEN k = 2 THEN 1 - pow(1 - u, 3) ELSE 1 END) AS total
FROM u, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY k""",
)
def ft_ispline(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    return _sums(t, list(zip(splines.is_names("x", 4), splines.is_basis(c.x, splines.bs_knots(t, c.x, 4)), strict=True)))


# fits with closed forms


def _oneway(link: str, value: str = "y", weight: str = "1e0") -> str:
    return (
        f"WITH {{lines}}, s AS (SELECT f, {link.format('sum(' + weight + ' * ' + value + ') / sum(' + weight + ')')} AS b FROM l GROUP BY f) "
        "SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, b - CASE WHEN f = 'A' THEN 0 ELSE (SELECT b FROM s WHERE f = 'A') END AS estimate FROM s"
    )


@query(
    "feature estimate.6 std_error.7",
    """WITH {lines}, s AS (SELECT f, sum(y) AS y, sum(e) AS e FROM l GROUP BY f), a AS (SELECT ln(y / e) AS b, 1 / y AS v FROM s WHERE f = 'A')
SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, CASE WHEN f = 'A' THEN b ELSE ln(y / e) - b END AS estimate, sqrt(CASE WHEN f = 'A' THEN v ELSE v + 1 / y END) AS std_error FROM s, a""",
)
def fit_poisson_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Poisson with a log exposure, one factor: the pooled rates and the information of group sums."""
    return _coefficients(spark, GLM("y", FLAG, lines(spark, d), family="poisson", offset="e").fit())


@query("feature estimate.6", _oneway("{}", "y", "e"))
def fit_gaussian_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", FLAG, lines(spark, d), family="gaussian", weights="e").fit())


@query("feature estimate.6", _oneway("ln({})"))
def fit_gamma(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", FLAG, lines(spark, d), family="gamma").fit())


@query("feature estimate.6", _oneway("ln({})"))
def fit_tweedie(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", FLAG, lines(spark, d), family="tweedie", var_power=1.5).fit())


@query("feature estimate.6", _oneway("ln({})"))
def fit_negbinomial(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", FLAG, lines(spark, d), family="negbinomial", theta=2.0).fit())


@query("feature estimate.6", _oneway("ln({})"))
def fit_quasipoisson(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", FLAG, lines(spark, d), family="quasipoisson").fit())


_LOGIT = """WITH {lines}, h AS (SELECT *, CASE WHEN y > 25 THEN 1e0 ELSE 0e0 END AS big FROM l), s AS (SELECT f, ln(avg(big) / (1 - avg(big))) AS b, count(*) * avg(big) * (1 - avg(big)) AS i FROM h GROUP BY f)
SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, b - CASE WHEN f = 'A' THEN 0 ELSE (SELECT b FROM s WHERE f = 'A') END AS estimate,
sqrt(1 / i + CASE WHEN f = 'A' THEN 0 ELSE (SELECT 1 / i FROM s WHERE f = 'A') END) AS std_error FROM s"""


@query("feature estimate.6 std_error.7", _LOGIT)
def fit_binomial(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d).withColumn("big", F.when(F.col("y") > 25, 1.0).otherwise(0.0))
    return _coefficients(spark, GLM("big", FLAG, t, family="binomial").fit())


@query("feature estimate.6", _LOGIT)
def fit_quasibinomial(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d).withColumn("big", F.when(F.col("y") > 25, 1.0).otherwise(0.0))
    return _coefficients(spark, GLM("big", FLAG, t, family="quasibinomial").fit())


@query(
    "feature estimate.5 std_error.6",
    """WITH {lines}, s AS (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS a, count(*) AS n, var_pop(x) AS v, avg(x) AS m FROM l),
r AS (SELECT sum(pow(y - a - sl * x, 2)) / (min(n) - 2) AS s2 FROM l, s)
SELECT 'x' AS feature, sl AS estimate, sqrt(s2 / (n * v)) AS std_error FROM s, r UNION ALL SELECT 'Intercept', a, sqrt(s2 * (1e0 / n + m * m / (n * v))) FROM s, r""",
)
def fit_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", {"x": {"type": "linear"}}, lines(spark, d)).fit())


@query(
    "feature std_error.6",
    """WITH {lines}, s AS (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS a, count(*) AS n, var_pop(x) AS v, avg(x) AS m FROM l)
SELECT 'x' AS feature, sqrt(min(n) / (min(n) - 2e0) * sum(pow((x - m) * (y - a - sl * x), 2))) / (min(n) * min(v)) AS std_error FROM l, s
UNION ALL SELECT 'Intercept', sqrt(min(n) / (min(n) - 2e0) * sum(pow((1e0 / n - m * (x - m) / (n * v)) * (y - a - sl * x), 2))) FROM l, s""",
)
def inf_robust_hc1(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", {"x": {"type": "linear"}}, lines(spark, d)).fit(), "HC1")


@query(
    "feature estimate.5",
    "WITH {lines}, s AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 10) AS b, avg(x) AS mx, avg(y) AS my FROM l) SELECT 'x' AS feature, b AS estimate FROM s UNION ALL SELECT 'Intercept', my - b * mx FROM s",
)
def fit_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", {"x": {"type": "linear"}}, lines(spark, d)).fit(alpha=10.0))


@query(
    "feature estimate.5",
    """WITH {lines}, s AS (SELECT covar_pop(x, p) * count(*) AS c, var_pop(x) * count(*) AS v, avg(x) AS mx, avg(p) AS my FROM l),
k AS (SELECT sign(c) * greatest(abs(c) - 5, 0) / v AS b, mx, my FROM s) SELECT 'x' AS feature, b AS estimate FROM k UNION ALL SELECT 'Intercept', my - b * mx FROM k""",
)
def fit_lasso(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("p", {"x": {"type": "linear"}}, lines(spark, d)).fit(alpha=5.0, l1_ratio=1.0))


@query(
    "feature estimate.5",
    """WITH {lines}, s AS (SELECT regr_slope(y, -x) AS b, regr_intercept(y, -x) AS a, avg(y) AS m FROM l) SELECT 'neg(x)' AS feature, CASE WHEN -b > 0 THEN 0 ELSE -b END AS estimate FROM s
UNION ALL SELECT 'Intercept', CASE WHEN -b > 0 THEN m ELSE a END FROM s""",
)
def fit_constraint(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, GLM("y", {"x": {"type": "linear", "monotonicity": "decreasing"}}, lines(spark, d)).fit())


@query("f line prediction.4", "WITH {lines} SELECT f, line, avg(y) AS prediction FROM l GROUP BY f, line")
def fit_two_way(spark: SparkSession, d: str) -> DataFrame:
    """A saturated model of two factors fits every cell's mean."""
    t = lines(spark, d)
    m = GLM("y", {}, t, [{"f": {"type": "categorical"}, "line": {"type": "categorical"}, "include_main": True}], family="poisson").fit()
    return m.predict(t).groupBy("f", "line").agg(F.avg("prediction").alias("prediction"))


@query("intercept.4 x.4 f.4", "SELECT 0e0 AS intercept, 0e0 AS x, 0e0 AS f")
def fit_score_equations(spark: SparkSession, d: str) -> DataFrame:
    """Sums of X'(y - mu) of a Poisson fit, per row: zero."""
    t = lines(spark, d)
    m = GLM("y", {"x": {"type": "linear"}, "f": {"type": "categorical"}}, t, family="poisson").fit()
    r = F.col("y") - F.col("prediction")
    return m.predict(t).agg(F.avg(r).alias("intercept"), F.avg(r * c.x).alias("x"), F.avg(r * F.when(F.col("f") == "N", 1.0).otherwise(0.0)).alias("f"))


@query(
    "f prediction.5",
    "WITH {lines}, s AS (SELECT f, sum(y) / sum(e) AS r FROM l GROUP BY f) SELECT f, sum(r * e) / count(*) AS prediction FROM l JOIN s USING (f) GROUP BY f",
)
def fit_predict(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = GLM("y", FLAG, t, family="poisson", offset="e").fit()
    return m.predict(t).groupBy("f").agg(F.avg("prediction").alias("prediction"))


@query("loss.5", "WITH {lines}, s AS (SELECT f, avg(y) AS mu FROM l GROUP BY f) SELECT avg(2 * (y * ln(y / s.mu) - (y - s.mu))) AS loss FROM l JOIN s USING (f)")
def fit_compute_loss(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    return spark.createDataFrame([(GLM("y", FLAG, t, family="poisson").fit().compute_loss(t),)], "loss double")


@query(
    "statistic.5 df*",
    "WITH {lines}, s AS (SELECT avg(y) AS m FROM l) SELECT pow(sum(x * (y - m)), 2) / (sum(m * x * x) - pow(sum(m * x), 2) / sum(m)) AS statistic, 1 AS df FROM l, s",
)
def inf_score_cont(spark: SparkSession, d: str) -> DataFrame:
    """Score test against a model of the mean (one constant level indicator stands for no term)."""
    t = lines(spark, d)
    m = GLM("y", {}, t, family="poisson").fit()
    s = m.score_test(t, c.x)
    return spark.createDataFrame([(s["statistic"], s["df"])], "statistic double, df long")


@query(
    "feature relativity.6",
    "WITH {lines}, s AS (SELECT f, avg(y) AS m FROM l GROUP BY f) SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, m / CASE WHEN f = 'A' THEN 1 ELSE (SELECT m FROM s WHERE f = 'A') END AS relativity FROM s",
)
def inf_relativities(spark: SparkSession, d: str) -> DataFrame:
    rows = [(r["feature"], r["relativity"]) for r in GLM("y", FLAG, lines(spark, d), family="poisson").fit().relativities()]
    return spark.createDataFrame(rows, "feature string, relativity double")


@query("alpha deviance se chosen")
def fit_cv_path(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated lasso path; the tests hold it against numpy on the same folds."""
    m = GLM("y", {"x": {"type": "linear"}, "t": {"type": "linear"}}, lines(spark, d)).fit(cv=5, l1_ratio=1.0, selection="1se")
    best = select_alpha(m.path, "1se")
    return spark.createDataFrame([(r["alpha"], r["deviance"], r["se"], r["alpha"] == best) for r in m.path], "alpha double, deviance double, se double, chosen boolean")


@query("f n* gap.4", "WITH {orders} SELECT f, count(*) AS n, 0e0 AS gap FROM o GROUP BY f")
def fit_smooth(spark: SparkSession, d: str) -> DataFrame:
    """A penalised smooth term beside a factor, which has no penalty: its levels' score equations, the mean of (y - mu)/mu, are 0.

    The tests hold the coefficients and the choice of the penalty against numpy.
    """
    t = orders(spark, d)
    m = GLM("y", {"x": {"type": "bs", "k": 8}, "f": {"type": "categorical"}}, t, family="gamma").fit()
    return m.predict(t).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") - F.col("prediction")) / F.col("prediction")).alias("gap"))


@query(
    "feature estimate.5 log_likelihood.1",
    """WITH {lines}, s AS (SELECT f, avg(y) AS m FROM l GROUP BY f), cells AS (SELECT f, y, 1e0 * count(*) AS n FROM l GROUP BY f, y), th AS (SELECT pow(10, -2 + 5e0 * i / 8000) AS t FROM range(8001) r(i)),
k AS (SELECT t, sum(n * (lgamma(y + t) - lgamma(t) - lgamma(y + 1) + t * ln(t / (m + t)) + y * ln(m / (m + t)))) AS ll FROM cells JOIN s USING (f), th GROUP BY t)
SELECT CASE WHEN f = 'A' THEN 'Intercept' ELSE 'f[T.' || f || ']' END AS feature, ln(m) - CASE WHEN f = 'A' THEN 0 ELSE (SELECT ln(m) FROM s WHERE f = 'A') END AS estimate, (SELECT max(ll) FROM k) AS log_likelihood FROM s""",
)
def fit_nb_theta(spark: SparkSession, d: str) -> DataFrame:
    """Negative binomial with theta estimated; the likelihood is the largest over a fine grid of theta."""
    t = lines(spark, d)
    m = GLM("y", FLAG, t, family="negbinomial").fit()
    ll = m.predict(t).agg(log_likelihood(m.family, c.y, F.col("prediction"), F.lit(1.0), 1.0)).first()[0]
    return spark.createDataFrame([(k, v, ll) for k, v in m.params.items()], "feature string, estimate double, log_likelihood double")
