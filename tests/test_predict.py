import math

import numpy as np
import pytest
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

import plain
from cellmob.operators import predict as P
from cellmob.operators.evaluate import METRICS, evaluate

rng = np.random.default_rng(3)
FEATURE = ("dataset string, dataframe int, lat double, lng double, crowd bigint, lastFrameCrowd bigint,"
           " knnMin bigint, knnSum bigint, knnAvg double, knnClosest double")


def table(spark, n=600, days=40):
    rows = []
    for i in range(n):
        # independent columns: standard errors need a regular problem
        crowd = int(rng.integers(1, 5))
        noisy = crowd + int(rng.integers(0, 2))
        rows.append((f"d{i % days:02d}", i % 24, 47 + i % 10 * 0.01, 19 + i % 13 * 0.01, crowd, noisy,
                     crowd, int(rng.integers(1, 9)), float(rng.random()), float(rng.random())))
    return spark.createDataFrame(rows, FEATURE)


@pytest.fixture(scope="module")
def features(spark):
    return table(spark).cache()


def test_metrics_equal_evaluators(spark):
    y = rng.integers(1, 5, 500)
    for guess in (rng.integers(0, 6, 500).astype(float), rng.random(500) * 4, np.full(500, 2.0)):
        df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, guess)],
                                   "crowd bigint, prediction double").cache()
        got = {r.metric: r.value for r in evaluate(df, "crowd").collect()}
        assert set(got) == set(METRICS)
        for m in METRICS:
            kind = RegressionEvaluator if m in ("rmse", "mae", "r2") else MulticlassClassificationEvaluator
            want = kind(labelCol="crowd", metricName=m).evaluate(
                df.withColumn("crowd", F.col("crowd").cast("double")))
            assert math.isclose(got[m], want, rel_tol=1e-9, abs_tol=1e-9), m


@pytest.mark.parametrize("guess", [1.0, 2.0])
def test_constant_label(spark, guess):
    df = spark.createDataFrame([(1.0, guess)] * 3, "crowd double, prediction double")
    want = RegressionEvaluator(labelCol="crowd", metricName="r2").evaluate(df)
    assert repr({r.metric: r.value for r in evaluate(df, "crowd").collect()}["r2"]) == repr(want)


def test_copies_stay_on_one_side(features):
    twice = features.union(features).repartition(3)
    train, test = P.split_by_key(twice)
    key = ["dataset", "dataframe", "lat", "lng"]
    assert train.join(test, key, "left_semi").count() == 0
    assert train.count() + test.count() == twice.count()
    assert 0.6 < train.count() / twice.count() < 0.8
    assert plain.rows(P.split_by_key(features)[0].union(P.split_by_key(features)[0])) == plain.rows(train)
    a, b = P.split_at_random(features)
    assert a.count() + b.count() == features.count()


def test_indexing(features):
    t = P.index_and_assemble(features)
    first = t.groupBy("crowd").agg(F.count("*").alias("n"), F.max("crowdIndex").alias("i")).orderBy("i").collect()
    assert [r.i for r in first] == [float(i) for i in range(len(first))]
    assert [r.n for r in first] == sorted((r.n for r in first), reverse=True)
    assert len(t.first().features) == 9
    assert len(P.index_and_assemble(features, P.FEATURES_NO_POSITION).first().features) == 7


@pytest.mark.parametrize("name", P.MODELS)
def test_fit(spark, features, name):
    fitted = P.fit_cv(name, features)
    assert len(fitted.grid) == len(fitted.scores) == max(1, math.prod(map(len, P.MODELS[name].grid.values())))
    assert all(math.isfinite(s) for s in fitted.scores)
    got = {r.metric: r.value for r in fitted.metrics().collect()}
    assert got["rmse"] >= got["mae"] >= 0 and 0 <= got["accuracy"] <= 1
    if name.startswith("decision_tree"):
        assert got["rmse"] < 0.8
    details = fitted.details(spark)
    names = {r.name for r in details.select("name").distinct().collect()}
    expected = {"logistic_regression": {"coefficients", "intercepts"},
                "linear_regression": {"coefficients", "intercept", "reg", "mix"},
                "naive_bayes": {"pi", "theta"}}
    if name in expected:
        assert names == expected[name]
    elif name == "poisson_regression":
        assert {"coefficients", "intercept", "deviance", "aic", "standard_errors", "t_values", "p_values"} <= names
    else:
        assert names == {"feature_importances"}
    if name in ("linear_regression", "poisson_regression"):
        assert fitted.residuals().count() > 0


def test_same_result_twice(features):
    name = "decision_tree_regressor"
    first, second = (plain.rows(P.fit_cv(name, t).metrics())
                     for t in (features, features.repartition(5)))
    assert [r[:2] for r in first] == [r[:2] for r in second]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(first, second))


def test_unknown_day_in_test(spark, features):
    only_test = lambda t: (t.filter("dataset != 'd07'"), t.filter("dataset = 'd07'"))
    assert P.fit_cv("decision_tree_regressor", features, split=only_test).metrics().count() == 6


def test_prepared_once_for_all_models(spark, features):
    with P.prepared(features) as rows:
        assert rows.training.count() + rows.test.count() == features.count()
        for name in ("linear_regression", "naive_bayes"):
            together, alone = P.fit(name, rows), P.fit_cv(name, features)
            assert np.allclose(together.scores, alone.scores, rtol=1e-6)
            assert together.predictions.count() == alone.predictions.count() == rows.test.count()


def test_solvers_agree(features):
    """Sums and Spark ML: the same scores, where Spark ML does not stop on its way."""
    with P.prepared(features) as rows:
        for name in ("linear_regression", "naive_bayes"):
            sums, ml = P.fit(name, rows), P.fit(name, rows, solver="ml")
            assert sums.grid == ml.grid
            plain = [i for i, g in enumerate(sums.grid) if g.get("elasticNetParam", 0) == 0]
            assert np.allclose([sums.scores[i] for i in plain], [ml.scores[i] for i in plain], rtol=1e-9)
        residuals = P.fit("linear_regression", rows).residuals()
        assert residuals.count() == rows.training.count()
        assert abs(residuals.agg(F.avg("residuals")).first()[0]) < 1e-9


@pytest.mark.parametrize("name", P.MODELS)
def test_checks_see_a_constant_fit(spark, features, name):
    """The training mean, or the commonest class, in place of the model changes what the
    query returns, in a column that SQL states as a number of its own."""
    with P.prepared(features) as rows:
        fitted = P.fit(name, rows)
        found = {r.metric: r.value for r in P.checks(fitted, rows).collect()}
        assert found["training_rows"] == rows.training.count() and found["test_rows"] == rows.test.count()
        label = fitted.spec.label
        constant = (0.0 if label == "crowdIndex" else rows.training.agg(F.avg(label)).first()[0])

        n = rows.rows.agg(F.max("crowdIndex")).first()[0] + 1
        shares = [rows.training.where(F.col("crowdIndex") == c).count() for c in range(int(n))]

        class Constant:
            coefficients, intercept = [0.0] * len(P.FEATURES), math.log(constant or 1)
            coefficientMatrix = DenseMatrix(len(shares), len(P.FEATURES), [0.0] * len(shares) * len(P.FEATURES))
            interceptVector = DenseVector([math.log(n / sum(shares)) for n in shares])
            def transform(self, df):
                return df.withColumn("prediction", F.lit(constant))
            def getOrDefault(self, name):
                return 0.01

        class Wrong:
            spec, model, scores = fitted.spec, Constant(), fitted.scores

        wrong = {r.metric: r.value for r in P.checks(Wrong, rows).collect()}
        if name == "logistic_regression":
            assert found["gains"] == 1.0
            assert wrong["gains"] == 0.0 and wrong["shares_loss"] == found["shares_loss"]
        else:
            assert wrong["training_error"] != found["training_error"]
            assert wrong["training_error"] == pytest.approx(wrong["constant_error"], abs=1e-6)


def test_linear_checks_state_the_optimum(features):
    with P.prepared(features) as rows:
        fitted = P.fit("linear_regression", rows)
        found = {r.metric: r.value for r in P.checks(fitted, rows).collect()}
        assert found["violation"] == 0.0 and found["coefficient_0"] == round(fitted.model.coefficients[0], 8)
        path = P.linear_path(rows).collect()
        assert {r.point for r in path} == set(range(8))
        best = fitted.scores.index(min(fitted.scores))
        assert {r.name: r.value for r in path if r.point == best}["objective"] == found["objective"]


def test_crowd_bins(spark):
    rng = np.random.default_rng(6)
    counts = [int(c) for c in rng.poisson(40, 3000)] + [7] * 2000  # one count with many rows
    df = spark.createDataFrame([(c,) for c in counts], "crowd bigint")
    edges = P.crowd_bin_edges(df, 10)
    ordered = sorted(counts)
    assert edges == sorted({ordered[max(0, -(-len(counts) * i // 10) - 1)] for i in range(1, 10)})
    for r in P.with_crowd_bins(df, 10).distinct().collect():
        assert r.crowdBin == sum(e < r.crowd for e in edges)
    rough = P.crowd_bin_edges(df, 10, accuracy=50)
    for i, e in enumerate(sorted(rough)):  # an edge's rank is off by a fiftieth at most
        place = (np.array(counts) <= e).mean(), (np.array(counts) < e).mean()
        assert any(place[1] - 0.02 <= j / 10 <= place[0] + 0.02 for j in range(1, 10))
    assert P.with_crowd_bins(df, 1).select("crowdBin").distinct().count() == 1
    assert P.with_crowd_bins(df.limit(0)).count() == 0
