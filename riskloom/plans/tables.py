"""Queries: projections, losses, one-way tables and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.families import get_family, residual
from riskloom.functions.links import LINKS
from riskloom.operators import encoding, explore, factors, metrics, quantiles
from riskloom.plans.registry import c, lines, orders, query, table
from riskloom.plans.spec import expression

_AE = "level n* exposure.2 actual.2 expected.2 loss.4 actual_mean.4 expected_mean.4 ae.5 ae_low.5 ae_high.5"
_POISSON = "CASE WHEN y > 0 THEN 2 * (y * ln(y / mu) - (y - mu)) ELSE 2 * mu END"


@query(
    _AE,
    f"""WITH {{orders}},
s AS (SELECT f AS level, count(*) AS n, sum(e) AS exposure, sum(y) AS actual, sum(mu) AS expected, sum({_POISSON}) AS ls FROM o GROUP BY f),
r AS (SELECT *, row_number() OVER (ORDER BY exposure DESC, level) AS rk, 100 * exposure / sum(exposure) OVER () AS share FROM s),
q AS (SELECT CASE WHEN share < 1 OR rk > 19 THEN '_Other' ELSE level END AS level, sum(n) AS n, sum(exposure) AS exposure, sum(actual) AS actual,
  sum(expected) AS expected, sum(ls) / sum(n) AS loss FROM r GROUP BY 1)
SELECT *, actual / exposure AS actual_mean, expected / exposure AS expected_mean, actual / expected AS ae,
  greatest(actual / expected - 1.96 * sqrt(greatest(actual, 1)) / expected, 0) AS ae_low,
  actual / expected + 1.96 * sqrt(greatest(actual, 1)) / expected AS ae_high FROM q""",
)
def agg_ae_level(spark: SparkSession, d: str) -> DataFrame:
    return factors.ae_by_level(orders(spark, d), F.col("f"), c.y, c.mu, c.e)


@query(
    "level n* ae.5",
    """WITH p AS (SELECT p_brand AS level, count(*) AS n, sum(CAST(p_size AS DOUBLE)) AS e, sum(p_retailprice) AS a, sum(1e3 + 2e1 * p_size) AS m FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY e DESC, level) AS rk, 100 * e / sum(e) OVER () AS share FROM p)
SELECT CASE WHEN share < 4 OR rk > 7 THEN '_Other' ELSE level END AS level, sum(n) AS n, sum(a) / sum(m) AS ae FROM r GROUP BY 1""",
)
def agg_ae_level_pooled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    return factors.ae_by_level(t, F.col("p_brand"), F.col("p_retailprice"), 1e3 + 2e1 * F.col("p_size"), F.col("p_size"), 4.0, 8, "mse")


@query(
    "bin n* lower.4 upper.4 exposure.2 actual.2 expected.2 ae.5",
    """WITH {orders}, r AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS c FROM o),
k AS (SELECT unnest(range(0, 11)) AS k),
ed AS (SELECT k, min(x) AS v FROM k JOIN r ON rn = CAST(floor(k / 1e1 * (c - 1) + 0.5) AS BIGINT) + 1 GROUP BY k),
iv AS (SELECT a.k AS bin, a.v AS lower, b.v AS upper FROM ed a JOIN ed b ON b.k = a.k + 1),
h AS (SELECT o.*, (SELECT min(bin) FROM iv WHERE x >= lower AND (x < upper OR (bin = 9 AND x <= upper))) AS bin FROM o)
SELECT CAST(h.bin AS INTEGER) AS bin, count(*) AS n, min(lower) AS lower, min(upper) AS upper, sum(e) AS exposure, sum(y) AS actual, sum(mu) AS expected, sum(y) / sum(mu) AS ae
FROM h JOIN iv ON iv.bin = h.bin GROUP BY h.bin""",
)
def agg_ae_bin(spark: SparkSession, d: str) -> DataFrame:
    return factors.ae_by_bin(orders(spark, d), c.x, c.y, c.mu, c.e)


@query(
    "level n* deviance.2 pct.4 mean_deviance.4 ae.5 is_problem",
    f"""WITH {{orders}}, s AS (SELECT f AS level, count(*) AS n, sum({_POISSON}) AS deviance, sum(y) / sum(mu) AS ae FROM o GROUP BY f),
t AS (SELECT *, 100 * deviance / sum(deviance) OVER () AS pct, deviance / n AS mean_deviance, sum(deviance) OVER () / sum(n) OVER () AS m, 1e2 * n / sum(n) OVER () AS sh FROM s)
SELECT level, n, deviance, pct, mean_deviance, ae, mean_deviance > 1.5 * m OR abs(ae - 1) > 0.15 OR pct > 2 * sh AS is_problem FROM t""",
)
def agg_factor_deviance(spark: SparkSession, d: str) -> DataFrame:
    return factors.factor_deviance(orders(spark, d), F.col("f"), get_family("poisson"), c.y, c.mu)


@query(
    "level n* exposure.2 actual_rate.5 predicted_rate.5 ae.5 mean_residual.5",
    f"""WITH {{orders}} SELECT f AS level, count(*) AS n, sum(e) AS exposure, sum(y) / sum(e) AS actual_rate, sum(mu) / sum(e) AS predicted_rate, sum(y) / sum(mu) AS ae,
avg(CASE WHEN y > mu THEN 1 ELSE -1 END * sqrt(greatest({_POISSON}, 0))) AS mean_residual FROM o GROUP BY f""",
)
def agg_level_metrics(spark: SparkSession, d: str) -> DataFrame:
    return factors.level_metrics(orders(spark, d), F.col("f"), get_family("poisson"), c.y, c.mu, c.e)


@query(
    "band n* midpoint.4 actual_rate.5 predicted_rate.5 ae.5 partial_dependence.4",
    """WITH {orders}, q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS ed FROM o),
h AS (SELECT o.*, ed, least(len(list_filter(ed[2:len(ed) - 1], lambda v: x >= v)), len(ed) - 2) AS band FROM o, q)
SELECT CAST(band AS INTEGER) AS band, count(*) AS n, min((ed[band + 1] + ed[band + 2]) / 2) AS midpoint, sum(y) / sum(e) AS actual_rate, sum(mu) / sum(e) AS predicted_rate,
sum(y) / sum(mu) AS ae, avg(mu) AS partial_dependence FROM h GROUP BY band""",
)
def agg_band_metrics(spark: SparkSession, d: str) -> DataFrame:
    return factors.band_metrics(orders(spark, d), c.x, get_family("poisson"), c.y, c.mu, c.e)


@query(
    "mean.4 std.4 min.4 max.4 missing* p1.4 p50.4 p99.4",
    """WITH {orders}, r AS (SELECT y, row_number() OVER (ORDER BY y) AS rn, count(*) OVER () AS c FROM o)
SELECT avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, 0 AS missing,
max(CASE WHEN rn = CAST(floor(0.01 * (c - 1) + 0.5) AS BIGINT) + 1 THEN y END) AS p1,
max(CASE WHEN rn = CAST(floor(0.5 * (c - 1) + 0.5) AS BIGINT) + 1 THEN y END) AS p50,
max(CASE WHEN rn = CAST(floor(0.99 * (c - 1) + 0.5) AS BIGINT) + 1 THEN y END) AS p99 FROM r""",
)
def agg_cont_stats(spark: SparkSession, d: str) -> DataFrame:
    return factors.continuous_stats(orders(spark, d), c.y)


@query("level n* pct.4 is_rare", "SELECT p_brand AS level, count(*) AS n, 1e2 * count(*) / sum(count(*)) OVER () AS pct, 1e2 * count(*) / sum(count(*)) OVER () < 4 AS is_rare FROM part GROUP BY 1")
def agg_cat_dist(spark: SparkSession, d: str) -> DataFrame:
    return factors.categorical_distribution(table(spark, d, "part"), F.col("p_brand"), 4.0)


@query(
    "bin n* mean_x.4 mean_residual.4",
    """WITH {orders}, r AS (SELECT x, y - mu AS r, row_number() OVER (ORDER BY x, id) - 1 AS rn, CAST(ceil(count(*) OVER () / 1e1) AS BIGINT) AS size FROM o)
SELECT CAST(rn // size AS INTEGER) AS bin, count(*) AS n, avg(x) AS mean_x, avg(r) AS mean_residual FROM r GROUP BY 1""",
)
def agg_resid_pattern_cont(spark: SparkSession, d: str) -> DataFrame:
    return factors.residual_pattern_continuous(orders(spark, d), c.x, c.y - c.mu, c.id)[1]


@query("correlation.6 r2.6 slope.6", "WITH {orders} SELECT corr(x, y - mu) AS correlation, corr(x, y - mu) * corr(x, y - mu) AS r2, regr_slope(y - mu, x) AS slope FROM o")
def agg_resid_trend(spark: SparkSession, d: str) -> DataFrame:
    return factors.residual_pattern_continuous(orders(spark, d), c.x, c.y - c.mu, c.id)[0]


@query(
    "eta_squared.8 f_statistic.4 k* n* mean_abs_level.4",
    """WITH {orders}, s AS (SELECT f, count(*) AS n, sum(y - mu) AS s, sum((y - mu) * (y - mu)) AS q FROM o GROUP BY f),
t AS (SELECT sum(n) AS n, count(*) AS k, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS eta, avg(abs(s / n)) AS m FROM s)
SELECT eta AS eta_squared, (eta / (k - 1)) / ((1 - eta) / (n - k)) AS f_statistic, k, n, m AS mean_abs_level FROM t""",
)
def agg_resid_pattern_cat(spark: SparkSession, d: str) -> DataFrame:
    return factors.eta_squared(orders(spark, d), F.col("f"), c.y - c.mu)


@query(
    "eta_squared.8 f_statistic.4 k* n*",
    """WITH {orders}, s AS (SELECT f, count(*) AS n, sum(e) AS w, sum(y) AS s, sum(y * y / e) AS q FROM o GROUP BY f),
t AS (SELECT sum(n) AS n, count(*) AS k, (sum(s * s / w) - sum(s) * sum(s) / sum(w)) / (sum(q) - sum(s) * sum(s) / sum(w)) AS eta FROM s)
SELECT eta AS eta_squared, (eta / (k - 1)) / ((1 - eta) / (n - k)) AS f_statistic, k, n FROM t""",
)
def agg_uni_anova_f(spark: SparkSession, d: str) -> DataFrame:
    return factors.eta_squared(orders(spark, d), F.col("f"), c.y / c.e, c.e)


@query(
    "cells* n* r2.8 f_statistic.4",
    """WITH {orders}, q AS (SELECT quantile_cont(x, [.2, .4, .6, .8]) AS ed FROM o),
c AS (SELECT len(list_filter(ed, lambda v: x >= v)) AS a, f AS b, count(*) AS n, sum(y - mu) AS s, sum((y - mu) * (y - mu)) AS q FROM o, q GROUP BY 1, 2 HAVING count(*) >= 30),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(q) - sum(s) * sum(s) / sum(n) AS w FROM c)
SELECT k AS cells, n, b / w AS r2, (b / (k - 1)) / ((w - b) / (n - k)) AS f_statistic FROM t""",
)
def agg_interaction_strength(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    return factors.interaction_strength(t, quantiles.discretized(t, c.x), F.col("f"), c.y - c.mu)


@query(
    "cells* n* r2.8 f_statistic.4",
    """WITH {orders}, c AS (SELECT f, g, count(*) AS n, sum(e) AS w, sum(y) AS s, sum(y * y / e) AS q FROM o GROUP BY 1, 2 HAVING count(*) >= 30),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(s * s / w) - sum(s) * sum(s) / sum(w) AS b, sum(q) - sum(s) * sum(s) / sum(w) AS v FROM c)
SELECT k AS cells, n, b / v AS r2, (b / (k - 1)) / ((v - b) / (n - k)) AS f_statistic FROM t""",
)
def agg_interaction_response(spark: SparkSession, d: str) -> DataFrame:
    return factors.interaction_strength(orders(spark, d), F.col("f"), F.col("g"), c.y / c.e, c.e)


@query("level n* prediction.4 relativity.5", "WITH {orders}, s AS (SELECT f AS level, count(*) AS n, avg(mu) AS prediction FROM o GROUP BY f) SELECT *, prediction / first_value(prediction) OVER (ORDER BY level) AS relativity FROM s")
def agg_pd_cat(spark: SparkSession, d: str) -> DataFrame:
    return factors.partial_dependence_levels(orders(spark, d), F.col("f"), c.mu)


@query(
    "level n_train* ae_train.5 n_test* ae_test.5 is_unstable",
    """WITH {orders}, a AS (SELECT f AS level, count(*) AS n_train, sum(y) / sum(mu) AS ae_train FROM o WHERE id % 3 > 0 GROUP BY f),
b AS (SELECT f AS level, count(*) AS n_test, sum(y) / sum(mu) AS ae_test FROM o WHERE id % 3 = 0 GROUP BY f)
SELECT level, n_train, ae_train, n_test, ae_test, coalesce(abs(ae_train - ae_test) > 0.1, false) AS is_unstable FROM a FULL JOIN b USING (level)""",
)
def jn_level_union(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    return factors.level_union(t.filter(c.id % 3 > 0), t.filter(c.id % 3 == 0), F.col("f"), c.y, c.mu)


# exploration


@query(
    "n* exposure.2 total.2 mean_rate.4 std_rate.4 min_rate.4 max_rate.4 zeros* zero_pct.4 p1.4 p25.4 p50.4 p99.4",
    """WITH {orders} SELECT count(*) AS n, sum(e) AS exposure, sum(y) AS total, avg(y / e) AS mean_rate, stddev_pop(y / e) AS std_rate, min(y / e) AS min_rate, max(y / e) AS max_rate,
count(*) FILTER (y = 0) AS zeros, 1e2 * count(*) FILTER (y = 0) / count(*) AS zero_pct, quantile_cont(y / e, 0.01) AS p1, quantile_cont(y / e, 0.25) AS p25, quantile_cont(y / e, 0.5) AS p50, quantile_cont(y / e, 0.99) AS p99 FROM o""",
)
def agg_response_stats(spark: SparkSession, d: str) -> DataFrame:
    return explore.response_stats(orders(spark, d), c.y, c.e)


@query(
    "bin n* x_min.4 x_max.4 exposure.2 actual.2 rate.5 is_thin",
    """WITH {orders}, q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS ed FROM o),
h AS (SELECT o.*, least(len(list_filter(ed[2:len(ed) - 1], lambda v: x >= v)), len(ed) - 2) AS bin FROM o, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(x) AS x_min, max(x) AS x_max, sum(e) AS exposure, sum(y) AS actual, sum(y) / sum(e) AS rate,
100 * sum(e) / sum(sum(e)) OVER () < 1 AS is_thin FROM h GROUP BY bin""",
)
def agg_factor_stats_cont(spark: SparkSession, d: str) -> DataFrame:
    return explore.continuous_table(orders(spark, d), c.x, c.y, c.e)


@query(
    "n* correlation.6 r2.6 f_statistic.4",
    """WITH {orders}, s AS (SELECT count(*) AS n, sum(e) AS w, sum(e * x) AS x, sum(y) AS y, sum(e * x * x) AS xx, sum(y * y / e) AS yy, sum(x * y) AS xy FROM o),
c AS (SELECT n, (xy / w - x / w * (y / w)) / sqrt((xx / w - x / w * (x / w)) * (yy / w - y / w * (y / w))) AS c FROM s)
SELECT n, c AS correlation, c * c AS r2, c * c / ((1 - c * c) / (n - 2)) AS f_statistic FROM c""",
)
def agg_uni_corr_f(spark: SparkSession, d: str) -> DataFrame:
    return explore.weighted_correlation(orders(spark, d), c.x, c.y, c.e)


@query(
    "a b correlation.6 severity",
    """WITH {lines}, s AS (SELECT corr(y, p) AS c0, corr(y, x) AS c1, corr(p, x) AS c2 FROM l),
r AS (SELECT 'y' AS a, 'p' AS b, c0 AS correlation FROM s UNION ALL SELECT 'y', 'x', c1 FROM s UNION ALL SELECT 'p', 'x', c2 FROM s)
SELECT *, CASE WHEN abs(correlation) > 0.9 THEN 'high' WHEN abs(correlation) > 0.7 THEN 'moderate' ELSE 'none' END AS severity FROM r""",
)
def agg_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return explore.correlation_matrix(lines(spark, d), ["y", "p", "x"])


@query(
    "factor vif.4 severity",
    """WITH {lines}, s AS (SELECT 1 / (1 - corr(y, p) * corr(y, p)) AS v FROM l), r AS (SELECT 'y' AS factor, v AS vif FROM s UNION ALL SELECT 'p', v FROM s)
SELECT *, CASE WHEN vif > 10 THEN 'severe' WHEN vif > 5 THEN 'moderate' ELSE 'none' END AS severity FROM r""",
)
def agg_vif(spark: SparkSession, d: str) -> DataFrame:
    return explore.vif(lines(spark, d), ["y", "p"])


@query(
    "name missing* pct.4 severity complete_rows*",
    """WITH t AS (SELECT nullif(l_discount, 0) AS a, nullif(l_linenumber, 1) AS b FROM lineitem),
s AS (SELECT count(*) AS n, count(*) FILTER (a IS NULL) AS ma, count(*) FILTER (b IS NULL) AS mb, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS c FROM t),
r AS (SELECT 'a' AS name, ma AS missing, 1e2 * ma / n AS pct, c AS complete_rows FROM s UNION ALL SELECT 'b', mb, 1e2 * mb / n, c FROM s)
SELECT *, CASE WHEN pct > 10 THEN 'high' WHEN pct > 1 THEN 'moderate' ELSE 'low' END AS severity FROM r""",
)
def agg_missing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_linenumber", F.lit(1)).alias("b"))
    return explore.missing(t, ["a", "b"])


@query(
    "observed_zero_pct.4 expected_zero_pct.6 excess_pct.4",
    """WITH u AS (SELECT user_id, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS y FROM events GROUP BY 1), s AS (SELECT 1e2 * count(*) FILTER (y = 0) / count(*) AS a, 1e2 * exp(-avg(y)) AS b FROM u)
SELECT a AS observed_zero_pct, b AS expected_zero_pct, a - b AS excess_pct FROM s""",
)
def agg_zero_inflation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    first = t.agg(F.min("event_type").alias("first"))
    per = t.join(F.broadcast(first)).groupBy("user_id").agg(F.count(F.when(F.col("event_type") == F.col("first"), 1)).alias("y"))
    return metrics.zero_inflation(per, F.col("y").cast("double"))


@query(
    "ratio.5 severity",
    """WITH u AS (SELECT count(*) AS y FROM events GROUP BY user_id), s AS (SELECT var_samp(y) / avg(y) AS ratio FROM u)
SELECT ratio, CASE WHEN ratio < 1.5 THEN 'none' WHEN ratio < 2 THEN 'mild' WHEN ratio < 5 THEN 'moderate' ELSE 'severe' END AS severity FROM s""",
)
def agg_overdispersion_pre(spark: SparkSession, d: str) -> DataFrame:
    ratio = table(spark, d, "events").groupBy("user_id").count().agg(F.var_samp("count") / F.avg("count")).first()[0]
    return spark.createDataFrame([(ratio, metrics.overdispersion(ratio)["severity"])], "ratio double, severity string")


@query(
    "a b v.8 n* severity",
    """WITH {lines}, x AS (SELECT 'f' AS a, 'g' AS b, f AS x, g AS y FROM l UNION ALL SELECT 'f', 'line', f, line FROM l UNION ALL SELECT 'g', 'line', g, line FROM l),
o AS (SELECT a, b, x, y, count(*) AS o FROM x GROUP BY ALL), r AS (SELECT a, b, x, sum(o) AS r FROM o GROUP BY ALL), c AS (SELECT a, b, y, sum(o) AS c FROM o GROUP BY ALL),
s AS (SELECT a, b, sum(o * o / CAST(r * c AS DOUBLE)) AS s, sum(o) AS n, least(count(DISTINCT x), count(DISTINCT y)) - 1 AS k FROM o JOIN r USING (a, b, x) JOIN c USING (a, b, y) GROUP BY a, b),
v AS (SELECT a, b, sqrt(greatest(s - 1, 0) / k) AS v, n FROM s)
SELECT *, CASE WHEN v > 0.5 THEN 'high' WHEN v > 0.3 THEN 'moderate' ELSE 'none' END AS severity FROM v""",
)
def agg_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    return explore.cramers_v(lines(spark, d), ["f", "g", "line"])


@query(
    "name n_nan* n_inf* variance.8 problem",
    """WITH {lines}, s AS (SELECT var_pop(x) AS v, var_pop(y) AS w FROM l) SELECT 'x' AS name, 0 AS n_nan, 0 AS n_inf, v AS variance, 'none' AS problem FROM s
UNION ALL SELECT 'y', 0, 0, w, 'none' FROM s UNION ALL SELECT 'c', 0, 0, 0, 'constant' FROM s""",
)
def agg_design_check(spark: SparkSession, d: str) -> DataFrame:
    return explore.design_check(lines(spark, d), {"x": c.x, "y": c.y, "c": F.lit(1.0)})


# projections


_FAMILIES = {"gaussian": ("y", "mu"), "poisson": ("y", "mu"), "gamma": ("y", "mu"), "binomial": ("b", "(t + 0.05)"), "tweedie": ("y", "mu"), "negbinomial": ("y", "mu")}
_DEVIANCE = {
    "gaussian": "(y - mu) * (y - mu)", "poisson": _POISSON, "gamma": "2 * (y / mu - 1 - ln(y / mu))",
    "binomial": "-2 * (CASE WHEN b > 0 THEN ln(t + 0.05) ELSE ln(1 - (t + 0.05)) END)",
    "tweedie": "CASE WHEN y > 0 THEN 2 * (pow(y, 0.5) / (-0.5 * 0.5) - y * pow(mu, -0.5) / -0.5 + pow(mu, 0.5) / 0.5) ELSE 4 * pow(mu, 0.5) END",
    "negbinomial": "2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y + 2) * ln((y + 2) / (mu + 2)))",
}
_VARIANCE = {"gaussian": "1", "poisson": "mu", "gamma": "mu * mu", "binomial": "(t + 0.05) * (1 - (t + 0.05))", "tweedie": "pow(mu, 1.5)", "negbinomial": "mu + mu * mu / 2"}


@query(
    "family deviance.3 chi2.3 response.3 pearson.3 signed.3 working.4",
    "WITH {lines} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS family, sum({_DEVIANCE[k]}) AS deviance, sum(({y} - {m}) * ({y} - {m}) / greatest({_VARIANCE[k]}, 1e-10)) AS chi2, sum({y} - {m}) AS response, "
        f"sum(({y} - {m}) / greatest(sqrt({_VARIANCE[k]}), 1e-10)) AS pearson, sum(CASE WHEN {y} > {m} THEN 1 ELSE -1 END * sqrt(greatest({_DEVIANCE[k]}, 0))) AS signed, "
        f"sum(({y} - {m}) * " + {"gaussian": "1", "binomial": "(1 / ((t + 0.05) * (1 - (t + 0.05))))"}.get(k, "(1 / mu)") + ") AS working FROM l"
        for k, (y, m) in _FAMILIES.items()
    ),
)
def prj_families(spark: SparkSession, d: str) -> DataFrame:
    """Deviance, Pearson chi-squared and the sums of all residuals of each family; one pass over the lines."""
    t = lines(spark, d)
    aggregates, rows = [], []
    for k, (y, m) in _FAMILIES.items():
        f, yc, mc = get_family(k, 2.0, 1.5), F.col(y), F.expr(m)
        aggregates += [metrics.deviance(f, yc, mc).alias(f"{k}_0"), metrics.pearson_chi2(f, yc, mc).alias(f"{k}_1")]
        aggregates += [F.sum(residual(f, r, yc, mc)).alias(f"{k}_{i}") for i, r in enumerate(("response", "pearson", "deviance", "working"), 2)]
        names = ("deviance", "chi2", "response", "pearson", "signed", "working")
        rows.append(F.struct(F.lit(k).alias("family"), *[F.col(f"{k}_{i}").alias(n) for i, n in enumerate(names)]))
    return t.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "name value.4 inverse.4 slope.4",
    """WITH {lines} SELECT 'identity' AS name, sum(x + 0.1) AS value, sum(x) AS inverse, 1e0 * count(*) AS slope FROM l
UNION ALL SELECT 'log', sum(ln(x + 0.1)), sum(exp(x)), sum(1 / (x + 0.1)) FROM l
UNION ALL SELECT 'logit', sum(ln((x + 0.1) / (1 - (x + 0.1)))), sum(1 / (1 + exp(-x))), sum(1 / ((x + 0.1) * (1 - (x + 0.1)))) FROM l
UNION ALL SELECT 'inverse', sum(1 / (x + 0.1)), sum(1 / (x + 0.2)), sum(-1 / ((x + 0.1) * (x + 0.1))) FROM l""",
)
def prj_links(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each link, its inverse and its slope."""
    m = c.x + 0.1
    aggregates = []
    for k, link in LINKS.items():
        aggregates += [F.sum(link.link(m)).alias(f"{k}_v"), F.sum(link.inverse(c.x + 0.2 if k == "inverse" else c.x)).alias(f"{k}_i"), F.sum(link.slope(m)).alias(f"{k}_s")]
    rows = [F.struct(F.lit(k).alias("name"), F.col(f"{k}_v").alias("value"), F.col(f"{k}_i").alias("inverse"), F.col(f"{k}_s").cast("double").alias("slope")) for k in LINKS]
    return lines(spark, d).agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "f g pow.4 ratio.4 nested.4",
    "WITH {lines} SELECT f, g, sum(pow(x, 2)) AS pow, sum(p / e) AS ratio, sum(y / pow(e + 1, 2) - x * 3) AS nested FROM l GROUP BY f, g",
)
def prj_expression(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("f", "g").agg(*[F.sum(expression(e)).alias(n) for n, e in {"pow": "x ** 2", "ratio": "p / e", "nested": "y / (e + 1) ** 2 - x * 3"}.items()])


@query("bin n* total.2", "WITH {orders}, q AS (SELECT quantile_cont(x, [.2, .4, .6, .8]) AS ed FROM o) SELECT CAST(len(list_filter(ed, lambda v: x >= v)) AS INTEGER) AS bin, count(*) AS n, sum(y) AS total FROM o, q GROUP BY 1")
def prj_discretize(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    return t.groupBy(quantiles.discretized(t, c.x).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(c.y).alias("total"))


# losses


@query(
    "mse.4 rmse.4 mae.4 poisson.4 gamma.4 tweedie.4 negbinomial.4 logloss.6",
    "WITH {lines} SELECT sum(e * (y - mu) * (y - mu)) / sum(e) AS mse, sqrt(sum(e * (y - mu) * (y - mu)) / sum(e)) AS rmse, sum(e * abs(y - mu)) / sum(e) AS mae, "
    + ", ".join(f"sum(e * ({_DEVIANCE[k]})) / sum(e) AS {k}" for k in ("poisson", "gamma", "tweedie", "negbinomial"))
    + ", sum(e * -(b * ln(t + 0.01) + (1 - b) * ln(1 - (t + 0.01)))) / sum(e) AS logloss FROM l",
)
def agg_losses(spark: SparkSession, d: str) -> DataFrame:
    own = [metrics.loss(k, c.y, c.mu, c.e, **({"theta": 2.0} if k == "negbinomial" else {})).alias(k) for k in ("mse", "rmse", "mae", "poisson", "gamma", "tweedie", "negbinomial")]
    return lines(spark, d).agg(*own, metrics.loss("logloss", F.col("b"), F.col("t") + 0.01, c.e).alias("logloss"))


@query(
    "n* deviance.3 mean_deviance.5 pearson_chi2.3 dispersion.5 log_likelihood.2 aic.2 bic.2",
    f"""WITH {{lines}}, s AS (SELECT count(*) AS n, sum({_POISSON}) AS d, sum((y - mu) * (y - mu) / mu) AS c, sum(y * ln(mu) - mu - lgamma(y + 1)) AS ll FROM l)
SELECT n, d AS deviance, d / n AS mean_deviance, c AS pearson_chi2, c / (n - 3) AS dispersion, ll AS log_likelihood, -2 * ll + 6 AS aic, -2 * ll + 3 * ln(n) AS bic FROM s""",
)
def agg_metrics_poisson(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_metrics(lines(spark, d), get_family("poisson"), c.y, c.mu, 3)


@query("n* deviance.2 log_likelihood.2", "WITH {lines}, s AS (SELECT count(*) AS n, sum((y - mu) * (y - mu)) AS d FROM l) SELECT n, d AS deviance, -0.5 * (n * ln(2 * pi() * (d / (n - 3))) + (n - 3)) AS log_likelihood FROM s")
def agg_metrics_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_metrics(lines(spark, d), get_family("gaussian"), c.y, c.mu, 3)


@query(
    "n* log_likelihood.2",
    """WITH {lines}, s AS (SELECT count(*) AS n, (count(*) - 3) / sum(2 * (y / mu - 1 - ln(y / mu))) AS a FROM l)
SELECT min(n) AS n, sum((a - 1) * ln(y) - y * a / mu - a * ln(mu / a) - lgamma(a)) AS log_likelihood FROM l, s""",
)
def agg_metrics_gamma(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_metrics(lines(spark, d), get_family("gamma"), c.y, c.mu, 3)


@query("log_likelihood.2", "WITH {lines} SELECT sum(lgamma(y + 2) - lgamma(2) - lgamma(y + 1) + 2 * ln(2 / (mu + 2)) + y * ln(mu / (mu + 2))) AS log_likelihood FROM l")
def agg_loglik_negbinomial(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_metrics(lines(spark, d), get_family("negbinomial", 2.0), c.y, c.mu, 3)


@query("null_deviance.3", f"WITH {{lines}}, r AS (SELECT sum(y) / sum(e) AS r FROM l), o AS (SELECT y, r * e AS mu FROM l, r) SELECT sum({_POISSON}) AS null_deviance FROM o")
def agg_null_deviance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.null_deviance(lines(spark, d), get_family("poisson"), c.y, None, F.log(c.e))


@query("actual.2 expected.2 ae.6 exposure.2", "WITH {orders} SELECT sum(y) AS actual, sum(mu) AS expected, sum(y) / sum(mu) AS ae, sum(e) AS exposure FROM o")
def agg_calib_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_total(orders(spark, d), c.y, c.mu, c.e)


@query(
    "mean.5 std.5 min.4 max.4 skewness.5 kurtosis.5",
    """WITH {orders}, m AS (SELECT avg(y - mu) AS m FROM o), s AS (SELECT avg(y - mu) AS mean, min(y - mu) AS mn, max(y - mu) AS mx, avg(pow(y - mu - m, 2)) AS a, avg(pow(y - mu - m, 3)) AS b, avg(pow(y - mu - m, 4)) AS c FROM o, m)
SELECT mean, sqrt(a) AS std, mn AS min, mx AS max, b / pow(a, 1.5) AS skewness, c / (a * a) - 3 AS kurtosis FROM s""",
)
def agg_resid_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.moments(orders(spark, d), c.y - c.mu)


# quantiles


@query(
    "kind p.2 value.4",
    """WITH {orders}, r AS (SELECT y, row_number() OVER (ORDER BY y) AS rn, count(*) OVER () AS c FROM o), p AS (SELECT unnest([0.05, 0.25, 0.5, 0.9]) AS p)
SELECT 'floor' AS kind, p, min(y) AS value FROM p JOIN r ON rn = CAST(floor(p * (c - 1)) AS BIGINT) + 1 GROUP BY p
UNION ALL SELECT 'round', p, min(y) FROM p JOIN r ON rn = CAST(floor(p * (c - 1) + 0.5) AS BIGINT) + 1 GROUP BY p
UNION ALL SELECT 'linear', p, (SELECT quantile_cont(y, 0.05) FROM o) FROM p WHERE p = 0.05 UNION ALL SELECT 'linear', p, (SELECT quantile_cont(y, 0.25) FROM o) FROM p WHERE p = 0.25
UNION ALL SELECT 'linear', p, (SELECT quantile_cont(y, 0.5) FROM o) FROM p WHERE p = 0.5 UNION ALL SELECT 'linear', p, (SELECT quantile_cont(y, 0.9) FROM o) FROM p WHERE p = 0.9""",
)
def q_conventions(spark: SparkSession, d: str) -> DataFrame:
    t, ps = orders(spark, d), [0.05, 0.25, 0.5, 0.9]
    rows = [(k, p, v) for k, f in (("floor", quantiles.floor_rank), ("round", quantiles.round_rank), ("linear", quantiles.linear)) for p, v in zip(ps, f(t, c.y, ps), strict=True)]
    return spark.createDataFrame(rows, "kind string, p double, value double")


# encodings


_ORDERED = """WITH {orders}, p AS (SELECT SUM_Y / SUM_E AS p FROM o), w AS (SELECT id, g, (coalesce(sum(y) OVER b, 0) + p) / (coalesce(SIZE OVER b, 0) + 1) AS encoded
FROM o, p WINDOW b AS (PARTITION BY f ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, encoded FROM w"""


@query("id encoded.5", _ORDERED.replace("SUM_Y", "sum(y)").replace("SUM_E", "count(*)").replace("SIZE", "count(*)"))
def win_te_ordered(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    _, prior = encoding.target_stats(t, F.col("f"), c.y)
    return encoding.target_ordered(t, F.col("f"), c.y, [[c.id]], prior)


@query("id encoded.5", _ORDERED.replace("SUM_Y", "sum(y)").replace("SUM_E", "sum(e)").replace("SIZE", "sum(e)"))
def win_te_ordered_exposure(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d)
    _, prior = encoding.target_stats(t, F.col("f"), c.y, c.e)
    return encoding.target_ordered(t, F.col("f"), c.y, [[c.id]], prior, 1.0, c.e)


@query(
    "id encoded.5",
    """WITH {orders}, s AS (SELECT f || ':' || g AS k, sum(y) AS s, count(*) AS n FROM o WHERE f <> '1-URGENT' GROUP BY 1), p AS (SELECT sum(s) / sum(n) AS p FROM s)
SELECT id, coalesce((s + 2 * p) / (n + 2), p) AS encoded FROM o LEFT JOIN s ON k = f || ':' || g, p""",
)
def ft_te_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Target encoding of two factors, learnt on every row but those of one level and applied to every row."""
    t, key = orders(spark, d), encoding.interaction_key(F.col("f"), F.col("g"))
    stats, prior = encoding.target_stats(t.filter(F.col("f") != "1-URGENT"), key, c.y)
    return encoding.target_apply(t, key, stats, prior, 2.0)


@query("p_partkey encoded.6", "WITH s AS (SELECT p_brand AS b, count(*) AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1) SELECT p_partkey, coalesce(1e0 * n / (SELECT max(n) FROM s), 0) AS encoded FROM part LEFT JOIN s ON b = p_brand")
def ft_fe(spark: SparkSession, d: str) -> DataFrame:
    """Frequency encoding learnt on every row but those of one level and applied to every row."""
    t = table(spark, d, "part")
    return encoding.FrequencyEncoder("p_brand").fit(t.filter(F.col("p_brand") != "Brand#11")).transform(t)


@query("level index* n*", "SELECT p_type AS level, dense_rank() OVER (ORDER BY p_type) - 1 AS index, count(*) AS n FROM part GROUP BY p_type")
def prj_factorize(spark: SparkSession, d: str) -> DataFrame:
    t = quantiles.factorized(table(spark, d, "part"), F.col("p_type"), "index")
    return t.groupBy(F.col("p_type").alias("level"), "index").agg(F.count(F.lit(1)).alias("n"))
