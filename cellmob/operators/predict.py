"""Crowd prediction with six models, tuned by cross-validation.

Four are Spark ML's. Linear regression and the folds of naive Bayes follow from sums over
the rows (see ``moments``): one pass over them instead of some for each fold and grid point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, NaiveBayes)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GeneralizedLinearRegression, LinearRegression)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmob.operators import moments as M
from cellmob.operators.evaluate import evaluate
from cellmob.operators.holding import hold
from cellmob.schema import FRAME_CELL

# The columns the models see, with and without the position.
FEATURES = ["datasetIndex", "dataframe", "lat", "lng", "lastFrameCrowd",
            "knnMin", "knnSum", "knnAvg", "knnClosest"]
FEATURES_NO_POSITION = [c for c in FEATURES if c not in ("lat", "lng")]

# Seed, share of training rows, number of folds, iterations.
SEED = 27
TRAIN_SHARE = 0.7
FOLDS = 4
MAX_ITER = 10


@dataclass(frozen=True)
class ModelSpec:
    """What one model predicts, how its grid is searched and judged."""

    name: str
    label: str  # crowd, or crowdIndex for a classifier
    metric: str  # chooses among the grid points
    estimator: Callable[..., object]
    grid: dict[str, list] = field(default_factory=dict)
    is_tree: bool = False


# Labels, selection metrics and parameter grids of the six models.
MODELS = {m.name: m for m in [
    ModelSpec("logistic_regression", "crowdIndex", "rmse", LogisticRegression,
              {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}),
    ModelSpec("linear_regression", "crowd", "rmse", LinearRegression,
              {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5, 0.8, 1.0]}),
    ModelSpec("poisson_regression", "crowd", "rmse", GeneralizedLinearRegression,
              {"regParam": [0.01, 0.1]}),
    # refuses negative features, so keep coordinates positive (see reduce_events)
    ModelSpec("naive_bayes", "crowdIndex", "accuracy", NaiveBayes),
    ModelSpec("decision_tree_classifier", "crowdIndex", "accuracy", DecisionTreeClassifier,
              {"maxDepth": [5, 10], "minInstancesPerNode": [1, 2, 4], "impurity": ["gini"]},
              is_tree=True),
    ModelSpec("decision_tree_regressor", "crowd", "rmse", DecisionTreeRegressor,
              {"maxDepth": [5, 10], "minInstancesPerNode": [1, 2, 4]}, is_tree=True),
]}


# models with one result, which the SQL of the tests finds on its own
RESTATED = [name for name in MODELS if name != "logistic_regression"]


@dataclass
class FittedModel:
    spec: ModelSpec
    pipeline: PipelineModel  # the best grid point, refitted on all training rows
    grid: list[dict[str, object]]  # parameters of each grid point ...
    scores: list[float]  # ... and its mean score over the folds
    predictions: DataFrame  # of the test rows
    training: DataFrame | None = None  # the rows fitted to

    @property
    def model(self):
        return self.pipeline.stages[-1]

    def metrics(self) -> DataFrame:
        """``model, metric, value`` on the test rows."""
        return evaluate(self.predictions, self.spec.label).select(
            F.lit(self.spec.name).alias("model"), "metric", "value")

    @property
    def has_residuals(self) -> bool:
        return self.spec.estimator in (LinearRegression, GeneralizedLinearRegression)

    def residuals(self) -> DataFrame:
        """Residuals of the training rows, for the two models that report them."""
        if isinstance(self.model, M.LinearFit):
            return self.model.transform(self.training).select(
                (F.col(self.spec.label) - F.col("prediction")).alias("residuals"))
        residuals = self.model.summary.residuals
        return residuals() if callable(residuals) else residuals

    def details(self, spark: SparkSession) -> DataFrame:
        """``model, name, position, value``: what the fitted model says about itself."""
        rows = [(self.spec.name, name, i, float(v))
                for name, values in _details(self).items() for i, v in enumerate(values)]
        return spark.createDataFrame(
            rows, "model string, name string, position int, value double")


# ---- preparation ----------------------------------------------------------------------

def day_indexer() -> StringIndexer:
    """Day to index, most frequent first. Days unknown at fitting share one extra index,
    where an error would stop a fold that happens to lack a day."""
    return StringIndexer(inputCol="dataset", outputCol="datasetIndex", handleInvalid="keep")


def crowd_indexer(features: DataFrame) -> StringIndexerModel:
    """Crowd count to class index, most frequent first; fitted on the whole table. All
    distinct counts become labels of the model; where they are many, see ``with_crowd_bins``."""
    return StringIndexer(inputCol="crowd", outputCol="crowdIndex").fit(features)


def crowd_bin_edges(features: DataFrame, bins: int, accuracy: int = 10_000) -> list[int]:
    """Counts that part the rows into at most ``bins`` parts of about equal size, ascending.

    From a quantile sketch, in one aggregation: the rank of an edge is off by at most a
    share of 1 / ``accuracy`` of the rows. Equal edges, where one count has many rows, are
    one, so that there may be fewer parts.
    """
    shares = [i / bins for i in range(1, bins)]
    edges = features.agg(F.percentile_approx("crowd", shares, accuracy)).first()[0] if shares else []
    return sorted(set(edges or []))


def with_crowd_bins(features: DataFrame, bins: int = 8, accuracy: int = 10_000) -> DataFrame:
    """``features`` with ``crowdBin``: how many edges lie below the row's count. A class index
    with a bounded number of labels, for tables whose counts are many; ``crowd_indexer``
    gives each count a class of its own."""
    edges = crowd_bin_edges(features, bins, accuracy)
    index = F.lit(0.0)
    for edge in edges:
        index = index + (F.col("crowd") > edge).cast("double")
    return features.withColumn("crowdBin", index)


def assembler(features: Sequence[str] = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def index_and_assemble(table: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The table with ``datasetIndex, crowdIndex`` and the vector ``features``."""
    days = day_indexer().fit(table)
    return assembler(features).transform(
        crowd_indexer(table).transform(days.transform(table)))


def _key_hash(first_digit: int) -> Column:
    """Eight hex digits of a digest of day, hour and position in micro-degrees."""
    micro = [F.round(F.col(c) * 1000000).cast("long").cast("string") for c in ("lat", "lng")]
    text = F.concat_ws("|", "dataset", F.col("dataframe").cast("string"), *micro)
    return F.conv(F.substring(F.md5(text), first_digit, 8), 16, 10).cast("long")


def split_by_key(table: DataFrame, train_share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the row's key.

    Copies of a row stay on one side (a random split puts some on both and so tests on
    what was trained), and the split does not depend on how the rows are partitioned.
    """
    training = is_training(train_share)
    return table.filter(training), table.filter(~training)


def is_training(train_share: float = TRAIN_SHARE) -> Column:
    return _key_hash(1) % 1000 < F.lit(round(train_share * 1000))


def fold_of() -> Column:
    """Fold of a row, by other digits of the same hash."""
    return (_key_hash(9) % FOLDS).cast("int")


def split_at_random(table: DataFrame, train_share: float = TRAIN_SHARE,
                    seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    train, test = table.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test


# ---- fitting --------------------------------------------------------------------------

def _evaluator(spec: ModelSpec):
    kind = RegressionEvaluator if spec.metric == "rmse" else MulticlassClassificationEvaluator
    return kind(labelCol=spec.label, metricName=spec.metric)


def _evenly(table: DataFrame) -> DataFrame:
    """At least one partition per core, and as many as a shuffle has: every iteration of
    every fit then uses all cores, where a table that came out of a shuffle may sit in a few
    large partitions. The cores known at the start may be few when executors come later."""
    spark = table.sparkSession
    parts = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table.repartition(parts, *FRAME_CELL)


@dataclass
class Prepared:
    """What all models are fitted from: the key, ``crowd, crowdIndex, features, fold,
    training`` of each row, and the fitted stages that made the features."""

    rows: DataFrame
    stages: list

    @property
    def training(self) -> DataFrame:
        return self.rows.filter("training")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("not training")


@contextmanager
def prepared(table: DataFrame, features: Sequence[str] = FEATURES,
             split: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = split_by_key
             ) -> Iterator[Prepared]:
    """Split, index and assemble once for any number of fits; held for the block.

    Eager, and reads ``table`` several times: pass a held one (see ``hold``).
    """
    train, test = split(crowd_indexer(table).transform(table))
    preparation = Pipeline(stages=[day_indexer(), assembler(features)]).fit(train)
    marked = train.withColumn("training", F.lit(True)).unionByName(
        test.withColumn("training", F.lit(False)))
    # folds by hash, for the reasons of split_by_key
    rows = preparation.transform(marked.withColumn("fold", fold_of())).select(
        *FRAME_CELL, "crowd", "crowdIndex", "features", "fold", "training")
    with hold(_evenly(rows)) as held:
        yield Prepared(held, preparation.stages)


def fit_linear(table: Prepared) -> FittedModel:
    """Linear regression from the moments of the folds, in one pass over the rows. Without
    absolute values in the penalty this is Spark ML's fit; with them, Spark ML stops
    after ten steps on the way to the optimum that is found here."""
    spec = MODELS["linear_regression"]
    grid = [{"regParam": reg, "elasticNetParam": mix} for reg in spec.grid["regParam"]
            for mix in spec.grid["elasticNetParam"]]
    points = [tuple(point.values()) for point in grid]
    folds = M.moments(table.training, spec.label)
    scores = M.linear_scores(folds, points)
    best = M.fit_linear(M.total(list(folds.values())), *points[scores.index(min(scores))])
    return FittedModel(spec, PipelineModel([*table.stages, best]), grid, scores,
                       best.transform(table.test), table.training)


def fit(name: str, table: Prepared, parallelism: int = 8, solver: str = "sums") -> FittedModel:
    """Fit one of :data:`MODELS`: search its grid over four folds, refit the best. The
    predictions of the result can be read while ``table`` is held. ``solver="ml"`` leaves
    all of it to Spark ML."""
    spec = MODELS[name]
    if name == "linear_regression" and solver == "sums":
        return fit_linear(table)
    settings = {"featuresCol": "features", "labelCol": spec.label}
    if spec.estimator in (LogisticRegression, LinearRegression, GeneralizedLinearRegression):
        settings["maxIter"] = MAX_ITER
    if spec.estimator is GeneralizedLinearRegression:
        settings["family"] = "poisson"
    if spec.is_tree:
        # The day is nominal: it needs a bin per value, one of them for unknown days.
        days = len(table.stages[0].labels)
        settings.update(seed=SEED, maxBins=max(32, days + 1))
    estimator = spec.estimator(**settings)

    grid = ParamGridBuilder()
    for param, values in spec.grid.items():
        grid = grid.addGrid(getattr(estimator, param), values)
    grid = grid.build()
    evaluator = _evaluator(spec)

    def score(task: tuple[int, int]) -> float:
        point, fold = task
        rest, held_out = (table.training.filter(F.col("fold") != fold),
                          table.training.filter(F.col("fold") == fold))
        return evaluator.evaluate(estimator.fit(rest, grid[point]).transform(held_out))

    if name == "naive_bayes" and solver == "sums":
        judged = M.bayes_scores(table.training, spec.label).agg(F.avg("accuracy"))
        scores = [judged.first()[0] or 0.0]
    else:
        with ThreadPool(parallelism) as pool:  # the fits are Spark jobs; threads only wait
            found = pool.map(inheritable_thread_target(table.rows.sparkSession)(score), [
                (point, fold) for point in range(len(grid)) for fold in range(FOLDS)], chunksize=1)
        scores = [sum(found[i:i + FOLDS]) / FOLDS for i in range(0, len(found), FOLDS)]
    choose = max if evaluator.isLargerBetter() else min
    best = estimator.fit(table.training, grid[scores.index(choose(scores))])
    return FittedModel(
        spec, PipelineModel([*table.stages, best]),
        [{p.name: v for p, v in point.items()} for point in grid], scores,
        best.transform(table.test), table.training)


def fit_cv(name: str, table: DataFrame, features: Sequence[str] = FEATURES,
           split: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = split_by_key,
           parallelism: int = 8, solver: str = "sums") -> FittedModel:
    """Prepare ``table`` and fit one model; its predictions are those of the test rows of
    ``table``, which they depend on."""
    with prepared(table, features, split) as rows:
        fitted = fit(name, rows, parallelism, solver)
    train, test = split(crowd_indexer(table).transform(table))
    fitted.predictions = fitted.pipeline.transform(test)
    fitted.training = PipelineModel(fitted.pipeline.stages[:-1]).transform(train)
    return fitted


def checks(fitted: FittedModel, table: Prepared) -> DataFrame:
    """``model, metric, value``: the size of the problem, and what the fit makes of it.

    ``constant_error`` is what the best constant prediction leaves of the training rows:
    the root mean square for counts, the share of wrong rows for classes. For the models
    in ``RESTATED``, which SQL fits as well, ``training_error`` is what the fit leaves, and ``score_i`` are
    the scores of the grid. Logistic regression stops after ten steps on its way, so of it
    are given: ``shares_loss``, the loss if all rows had the shares of the classes as their
    probabilities, and ``gains``, 1 if the model's loss is less than that.
    """
    spec, label = fitted.spec, F.col(fitted.spec.label).cast("double")
    classes = spec.label == "crowdIndex"
    rows = fitted.model.transform(table.training).select(label.alias("l"), "prediction")
    error = F.col("prediction") - F.col("l")
    n, mean, spread, wrong, rmse = rows.agg(
        F.count("*"), F.avg("l"), F.stddev_pop("l"), F.avg((error != 0).cast("int")),
        F.sqrt(F.avg(error * error))).first()
    if classes:
        most = rows.groupBy("l").count().agg(F.max("count")).first()[0]
        constant, left = 1 - most / n, wrong
    else:
        constant, left = spread, rmse
    out = {"training_rows": n, "test_rows": table.test.count(), "label_mean": round(mean, 6),
           "constant_error": round(constant, 6)}
    if spec.name in RESTATED:
        out["training_error"] = round(left, 6)
        out.update({f"score_{i}": round(v, 6) for i, v in enumerate(fitted.scores)})
    if isinstance(fitted.model, M.LinearFit):
        m = M.total(list(M.moments(table.training, spec.label).values()))
        out.update(_of_linear(m, fitted.model))
    elif spec.estimator is GeneralizedLinearRegression:
        out.update(_of_poisson(fitted, table))
    elif spec.estimator is LogisticRegression:
        out.update(_of_logistic(fitted, table))
    return table.rows.sparkSession.createDataFrame(
        [(spec.name, k, float(v) + 0.0) for k, v in out.items()], "model string, metric string, value double")


def _of_poisson(fitted: FittedModel, table: Prepared) -> dict[str, float]:
    """Penalty and coefficients, and the sums that say how good they are."""
    model = fitted.model
    reg = model.getOrDefault("regParam")
    sums = M.poisson_sums(table.training, fitted.spec.label, model.coefficients, model.intercept, reg)
    return {"reg": reg, "intercept": round(model.intercept, 6), "deviance": round(sums.deviance, 5),
            "aic": round(sums.aic, 4), "score_residual": round(sums.residual, 6),
            **{f"coefficient_{i}": round(float(b), 7) for i, b in enumerate(model.coefficients)}}


def _of_logistic(fitted: FittedModel, table: Prepared) -> dict[str, float]:
    model = fitted.model
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(intercepts) == 1:  # of two classes one has a margin
        weights, intercepts = np.vstack([0 * weights, weights]), np.append(0, intercepts)
    sums = M.softmax_sums(table.training, fitted.spec.label, weights, intercepts)
    return {"shares_loss": round(sums.shares_loss, 6), "gains": sums.loss < sums.shares_loss - 1e-6}


def _of_linear(m: M.Moments, fitted: M.LinearFit) -> dict[str, float]:
    """Penalty, coefficients, what the fit minimises, and how far it is from the optimum."""
    problem = M.problem(m, fitted.reg, fitted.mix)
    return {"reg": fitted.reg, "mix": fitted.mix, "intercept": round(fitted.intercept, 7),
            "objective": round(M.objective(m, fitted), 8),
            "violation": round(M.violation(problem, M.standardised(problem, fitted)), 7),
            **{f"coefficient_{i}": round(float(b), 8) for i, b in enumerate(fitted.coefficients)}}


def linear_path(table: Prepared) -> DataFrame:
    """``point, name, value``: the fit of each grid point of linear regression to all training
    rows, and its score over the folds."""
    spec = MODELS["linear_regression"]
    folds = M.moments(table.training, spec.label)
    points = [(reg, mix) for reg in spec.grid["regParam"] for mix in spec.grid["elasticNetParam"]]
    whole, out = M.total(list(folds.values())), []
    for n, (point, score) in enumerate(zip(points, M.linear_scores(folds, points))):
        found = {"score": round(score, 6), **_of_linear(whole, M.fit_linear(whole, *point))}
        out += [(n, name, float(v) + 0.0) for name, v in found.items()]
    return table.rows.sparkSession.createDataFrame(out, "point int, name string, value double")


def _details(fitted: FittedModel) -> dict[str, Sequence[float]]:
    model, kind = fitted.model, fitted.spec.estimator
    if kind is LogisticRegression:
        return {"coefficients": model.coefficientMatrix.toArray().ravel(),
                "intercepts": model.interceptVector.toArray()}
    if kind is NaiveBayes:
        return {"pi": model.pi.toArray(), "theta": model.theta.toArray().ravel()}
    if fitted.spec.is_tree:
        return {"feature_importances": model.featureImportances.toArray()}
    out = {"coefficients": model.coefficients.toArray(), "intercept": [model.intercept]}
    if isinstance(model, M.LinearFit):
        return {**out, "reg": [model.reg], "mix": [model.mix]}
    if kind is GeneralizedLinearRegression:
        s = model.summary
        out.update(
            deviance=[s.deviance], aic=[s.aic],
            residual_degrees_of_freedom=[s.residualDegreeOfFreedom],
            residual_degrees_of_freedom_null=[s.residualDegreeOfFreedomNull])
        try:
            out.update(standard_errors=s.coefficientStandardErrors,
                       t_values=s.tValues, p_values=s.pValues)
        except PySparkException:
            pass  # a singular problem was solved by iteration, which yields none
    return out
