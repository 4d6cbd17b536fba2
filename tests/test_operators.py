"""Quantiles, rankings, splines and encodings against numpy and literals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import encoding, explore, factors, quantiles, ranking, solvers, splines
from riskloom.operators.prefix import ordered


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(7)
    rows = [(k, float(r.randint(0, 5)), r.choice([0.5, 1.0, 1.5, 2.0, 2.5]), r.choice([0.25, 0.5, 1.0]), r.choice("abcd"), float(r.randint(0, 20))) for k in range(503)]
    return rows, spark.createDataFrame(rows, "id long, y double, mu double, e double, f string, x double").repartition(7)


def test_prefix_sums_are_those_of_one_sort(scored):
    rows, df = scored
    got = {r["id"]: (r["rn"], r["cum"]) for r in ordered(df, [F.col("mu"), F.col("id")], {"cum": F.col("e")}).collect()}
    total = 0.0
    for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        total += r[3]
        assert got[r[0]] == (n, pytest.approx(total))


def test_quantile_conventions(scored):
    rows, df = scored
    xs = sorted(r[5] for r in rows)
    n, ps = len(xs), [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    assert quantiles.floor_rank(df, F.col("x"), ps) == [xs[int(p * (n - 1))] for p in ps]
    assert quantiles.round_rank(df, F.col("x"), ps) == [xs[math.floor(p * (n - 1) + 0.5)] for p in ps]
    assert np.allclose(quantiles.linear(df, F.col("x"), ps), np.quantile(xs, ps))
    assert quantiles.linear(df.limit(0), F.col("x"), ps) == []


def test_greedy_calibration(scored):
    rows, df = scored
    ordered_rows = sorted(rows, key=lambda r: (r[2], r[0]))
    share = 0.99 * sum(r[3] for r in rows) / 10
    bins, own, left = [], [], len(rows)
    for r in ordered_rows:
        own.append(r)
        left -= 1
        open_bins = 10 - len(bins) - 1
        if open_bins and sum(x[3] for x in own) >= share and left >= open_bins:
            bins.append(own)
            own = []
    bins.append(own)
    got = sorted((r["bin"], r["n"], round(r["actual"], 6)) for r in ranking.calibration_bins(df, F.col("y"), F.col("mu"), F.col("e"), F.col("id")).collect())
    assert got == [(k, len(b), round(sum(x[1] for x in b), 6)) for k, b in enumerate(bins)]


def test_perfect_order_has_the_largest_gini(spark):
    df = spark.createDataFrame([(k, float(k), float(k)) for k in range(1, 101)], "id long, y double, mu double")
    up = ranking.discrimination(df, F.col("y"), F.col("mu"), F.lit(1.0), F.col("id")).first()
    down = ranking.discrimination(df, F.col("y"), 1 / F.col("mu"), F.lit(1.0), F.col("id")).first()
    assert up["gini"] == pytest.approx(-down["gini"]) and up["gini"] > 0.3 and up["auc"] == pytest.approx((up["gini"] + 1) / 2)


def test_null_levels_and_pooling(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 40.0), (None, 9.5), ("c", 0.4), ("d", 0.1)], "f string, e double")
    got = {r["level"]: r["exposure"] for r in factors.ae_by_level(df, F.col("f"), F.lit(1.0), F.lit(1.0), F.col("e")).collect()}
    assert got == {"a": 50.0, "b": 40.0, "None": 9.5, "_Other": 0.5}


def test_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, None)], "x double, f string")
    got = {r["name"]: (r["missing"], r["complete_rows"]) for r in explore.missing(df, ["x", "f"]).collect()}
    assert got == {"x": (2, 1), "f": (2, 1)}
    assert factors.continuous_stats(df, F.col("x")).first()["missing"] == 2


@pytest.mark.parametrize("n,degree", [(5, 3), (7, 3), (4, 2), (3, 1), (4, 3)])
def test_bspline_columns(spark, n, degree):
    df = spark.createDataFrame([(float(v),) for v in [0, 0.5, 1, 1.7, 2, 3, 4.2, 5, -1, 6]], "x double")
    base = df.filter("x between 0 and 5")
    knots = splines.bs_knots(base, F.col("x"), n, degree)
    assert len(knots) == n + degree + 1
    got = np.array([list(r) for r in df.orderBy("x").select(*splines.bs_basis(F.col("x"), knots, degree)).collect()])
    x = np.array(sorted(r[0] for r in df.collect()))
    assert np.allclose(got, splines.bs_basis_np(x, knots, degree))
    inside = (x >= 0) & (x <= 5)
    assert np.allclose(got[inside].sum(1), 1) and np.allclose(got[~inside], 0)


def test_literal_knots(spark):
    df = spark.createDataFrame([(float(v),) for v in range(6)], "x double")
    assert splines.bs_knots(df, F.col("x"), 5) == [0.0] * 4 + [2.0] + [5.0] * 4


def test_natural_spline_is_linear_outside(spark):
    knots = [0.0, 1.0, 2.0, 3.0, 4.0]
    x = np.array([5.0, 6.0, 7.0])
    assert np.allclose(np.diff(splines.ns_basis_np(x, knots, 3), 2, axis=0), 0)
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.5, 2.5, 6.0)], "x double")
    got = np.array([list(r) for r in df.select(*splines.ns_basis(F.col("x"), knots, 3)).collect()])
    assert np.allclose(got, splines.ns_basis_np(np.array([-1.0, 0.5, 2.5, 6.0]), knots, 3))


def test_monotone_splines_rise(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("x"))
    for sign in (True, False):
        cols = splines.is_basis(F.col("x"), splines.bs_knots(df, F.col("x"), 6), 3, sign)
        got = np.array([list(r) for r in df.orderBy("x").select(*cols).collect()])
        assert (np.diff(got, axis=0) * (1 if sign else -1) >= -1e-12).all() and got.min() >= 0 and got.max() <= 1


def test_difference_penalty_spares_lines():
    s = splines.penalty_matrix(6)
    assert np.allclose(s @ np.arange(6.0), 0) and np.linalg.matrix_rank(s) == 4


def test_frequency_literal(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate("ABAABC")], "k long, c string")
    out = encoding.FrequencyEncoder("c").fit_transform(df).orderBy("k")
    assert [r["encoded"] for r in out.collect()] == pytest.approx([1, 2 / 3, 1, 1, 2 / 3, 1 / 3])
    new = spark.createDataFrame([("Z",), (None,)], "c string")
    assert [r["encoded"] for r in encoding.FrequencyEncoder("c").fit(df).transform(new).collect()] == [0, 0]


def test_target_encoding(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0), (3, "a", 1.0), (4, "b", 0.0)], "k long, c string, y double")
    enc = encoding.TargetEncoder("c", "y", row_id="k")
    seen = enc.fit_transform(df)
    got = {r["c"]: r["encoded"] for r in enc.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "c string")).collect()}
    assert got == pytest.approx({"a": 2.5 / 3, "b": 0.5 / 3, "z": 0.5})
    own = {r["k"]: r["encoded"] for r in seen.collect()}
    # each level's first row in an order has the prior, its second a mean of it and the other row
    assert own[1] + own[3] == pytest.approx(0.5 + (1 + 0.5) / 2) and own[2] + own[4] == pytest.approx(0.5 + 0.5 / 2)
    again = {r["k"]: r["encoded"] for r in encoding.TargetEncoder("c", "y", row_id="k").fit_transform(df.repartition(3)).collect()}
    assert again == own


def test_solvers():
    g = np.random.default_rng(1)
    x = g.normal(size=(200, 4))
    y = x @ np.array([1.0, -2.0, 0.0, 0.5]) + 0.1 * g.normal(size=200)
    gram, xy = x.T @ x, x.T @ y
    exact = np.linalg.solve(gram, xy)
    none, free = np.zeros(4), np.zeros(4, bool)
    assert np.allclose(solvers.coordinate_descent(gram, xy, 0.0, 1.0, none, free, none), exact, atol=1e-6)
    lasso = solvers.coordinate_descent(gram, xy, 60.0, 1.0, none, free, none)
    grad = xy - gram @ lasso
    assert (np.abs(grad) <= 60 + 1e-4).all() and np.allclose(grad[lasso != 0], 60 * np.sign(lasso[lasso != 0]), atol=1e-4)
    nn = solvers.nnls(gram, xy)
    grad = xy - gram @ nn
    assert nn.min() >= 0 and (grad[nn == 0] <= 1e-6).all() and np.allclose(grad[nn > 0], 0, atol=1e-6)
    assert solvers.pava(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert solvers.pava(np.array([1.0, 3.0]), False).tolist() == [2.0, 2.0]
    assert abs(solvers.brent(lambda t: (t - 1.3) ** 4 + 2, -5, 5) - 1.3) < 1e-2
    assert abs(solvers.edf(gram, np.zeros((4, 4))).sum() - 4) < 1e-9 and solvers.edf(gram, 1e9 * np.eye(4)).sum() < 1e-3
