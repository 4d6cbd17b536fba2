"""Queries: calibration, discrimination, Lorenz curve, deciles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import ranking
from riskloom.plans.registry import c, orders, query

_DECILE = "least((row_number() OVER (ORDER BY {by}, id) - 1) // greatest(count(*) OVER () // 10, 1), 9)"


@query(
    "bin n* exposure.2 actual.2 expected.2 actual_rate.5 expected_rate.5 ae.5",
    "WITH {orders}, h AS (SELECT *, " + _DECILE.format(by="mu") + """ AS bin FROM o)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, sum(e) AS exposure, sum(y) AS actual, sum(mu) AS expected, sum(y) / sum(e) AS actual_rate, sum(mu) / sum(e) AS expected_rate, sum(y) / sum(mu) AS ae FROM h GROUP BY bin""",
)
def win_ae_decile(spark: SparkSession, d: str) -> DataFrame:
    return ranking.decile_table(orders(spark, d), c.y, c.mu, c.e, c.id)


@query(
    "bin n* lift.5 cumulative_actual_pct.4 cumulative_expected_pct.4 cumulative_exposure_pct.4",
    "WITH {orders}, h AS (SELECT *, " + _DECILE.format(by="mu") + """ AS bin FROM o),
s AS (SELECT bin, count(*) AS n, sum(e) AS e, sum(y) AS y, sum(mu) AS m FROM h GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin, n, (y / e) / (sum(y) OVER () / sum(e) OVER ()) AS lift, 100 * sum(y) OVER w / sum(y) OVER () AS cumulative_actual_pct,
100 * sum(m) OVER w / sum(m) OVER () AS cumulative_expected_pct, 100 * sum(e) OVER w / sum(e) OVER () AS cumulative_exposure_pct FROM s WINDOW w AS (ORDER BY bin)""",
)
def win_lift_chart(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lift_chart(orders(spark, d), c.y, c.mu, c.e, c.id)


@query(
    "bin n* mean_ratio.5 actual.5 model.5 base.5 ae_model.5 ae_base.5",
    "WITH {orders}, h AS (SELECT *, mu / base AS r, " + _DECILE.format(by="mu / base") + """ AS bin FROM o)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(r) AS mean_ratio, sum(y) / sum(e) AS actual, sum(mu) / sum(e) AS model, sum(h.base) / sum(e) AS base, sum(y) / sum(mu) AS ae_model, sum(y) / sum(h.base) AS ae_base FROM h GROUP BY bin""",
)
def win_base_vs_model(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ratio_deciles(orders(spark, d), c.y, c.mu, F.col("base"), c.e, c.id)


_UNIT_BINS = """r AS (SELECT *, row_number() OVER (ORDER BY mu, id) AS rn, count(*) OVER () AS c FROM o),
h AS (SELECT *, least((rn - 1) // CAST(ceil(0.99 * c / 10) AS BIGINT), 9) AS bin FROM r),
s AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, 1e0 * count(*) AS exposure, sum(y) AS actual, sum(mu) AS expected FROM h GROUP BY bin)"""


@query(
    "bin n* exposure.2 actual.2 expected.2 ae.5 ae_low.5 ae_high.5",
    "WITH {orders}, " + _UNIT_BINS + """ SELECT *, actual / expected AS ae, greatest(actual / expected - 1.96 * sqrt(greatest(actual, 1)) / expected, 0) AS ae_low,
actual / expected + 1.96 * sqrt(greatest(actual, 1)) / expected AS ae_high FROM s""",
)
def win_calibration(spark: SparkSession, d: str) -> DataFrame:
    return ranking.calibration_bins(orders(spark, d), c.y, c.mu, F.col("one"), c.id)


@query(
    "bin n* exposure.2 actual.2 ae.5",
    """WITH RECURSIVE {orders}, r AS (SELECT *, row_number() OVER (ORDER BY mu, id) AS rn, count(*) OVER () AS c, sum(e) OVER (ORDER BY mu, id) AS cum, 0.099 * sum(e) OVER () AS share FROM o),
w AS (SELECT 0 AS b, 0::BIGINT AS upto, 0e0 AS done UNION ALL SELECT w.b + 1, min(r.rn), min(r.cum) FROM w JOIN r ON r.rn > w.upto AND r.cum >= w.done + r.share AND r.rn <= r.c - (9 - w.b) WHERE w.b < 9 GROUP BY w.b),
h AS (SELECT r.*, (SELECT count(*) FROM w WHERE w.b > 0 AND w.upto < r.rn) AS bin FROM r)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, sum(e) AS exposure, sum(y) AS actual, sum(y) / sum(mu) AS ae FROM h GROUP BY bin""",
)
def win_calibration_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Greedy bins by exposure."""
    return ranking.calibration_bins(orders(spark, d), c.y, c.mu, c.e, c.id)


@query("chi2.3 df*", "WITH {orders}, " + _UNIT_BINS + " SELECT sum((actual - expected) * (actual - expected) / expected) AS chi2, count(*) - 2 AS df FROM s")
def win_hosmer_lemeshow(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hosmer_lemeshow(ranking.calibration_bins(orders(spark, d), c.y, c.mu, F.col("one"), c.id))


@query(
    "gini.6 auc.6 ks.6 lift_10.5 lift_20.5",
    """WITH {orders}, r AS (SELECT y, e, sum(y) OVER w / sum(y) OVER () AS fy, sum(e) OVER w / sum(e) OVER () AS fe, sum(y) OVER () AS ty, sum(e) OVER () AS te
FROM o WINDOW w AS (ORDER BY mu / e DESC, id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT sum(e / te * (2 * fy - y / ty) / 2) AS a, max(abs(fy - fe)) AS ks, max(fy) FILTER (fe <= 0.1) / 0.1 AS l1, max(fy) FILTER (fe <= 0.2) / 0.2 AS l2 FROM r)
SELECT 2 * a - 1 AS gini, a AS auc, ks, l1 AS lift_10, l2 AS lift_20 FROM s""",
)
def win_discrimination(spark: SparkSession, d: str) -> DataFrame:
    return ranking.discrimination(orders(spark, d), c.y, c.mu, c.e, c.id)


@query(
    "step exposure_share.5 actual_share.5 expected_share.5",
    """WITH {orders}, r AS (SELECT row_number() OVER w AS rn, sum(y) OVER w / sum(y) OVER () AS fy, sum(mu) OVER w / sum(mu) OVER () AS fm, sum(e) OVER w / sum(e) OVER () AS fe
FROM o WINDOW w AS (ORDER BY mu, id ROWS UNBOUNDED PRECEDING)), k AS (SELECT unnest(range(1, 21)) AS k),
f AS (SELECT k, min(rn) AS rn FROM k JOIN r ON fe * 20 + 1e-9 >= k GROUP BY k)
SELECT CAST(k AS INTEGER) AS step, fe AS exposure_share, fy AS actual_share, fm AS expected_share FROM f JOIN r USING (rn)""",
)
def win_lorenz(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lorenz(orders(spark, d), c.y, c.mu, c.e, c.id)
