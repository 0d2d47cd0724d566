"""Models that follow from sums over the rows, for all folds at once.

A linear model with an elastic-net penalty needs the counts, means and products of its
columns, naive Bayes the column sums per class. Both are sums over rows, so that one
aggregation per fold yields every fit of a cross-validation: the rows outside a fold are
all rows less those of the fold. What comes to the driver is bounded by the number of
features and classes, not by the rows; solving there takes milliseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SWEEPS = 100_000
_STILL = 1e-14  # a sweep that moves no coefficient further ends the search


@dataclass(frozen=True)
class Moments:
    """Sums over some rows of a label y and features x, both less an origin: n, y, y * y, x,
    x * x' and x * y."""

    n: float
    y: float
    yy: float
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    origin: np.ndarray  # of the features, then of the label

    def _with(self, other: Moments, sign: int) -> Moments:
        return Moments(*(a + sign * b for a, b in zip(self._sums(), other._sums())), self.origin)

    def _sums(self):
        return self.n, self.y, self.yy, self.x, self.xx, self.xy

    def __add__(self, other: Moments) -> Moments:
        return self._with(other, 1)

    def __sub__(self, other: Moments) -> Moments:
        return self._with(other, -1)

    def squared_error(self, fit: LinearFit) -> float:
        """Sum of squared errors of a fit on these rows."""
        b = np.asarray(fit.coefficients)
        a = fit.intercept + b @ self.origin[:-1] - self.origin[-1]
        error = (self.yy + self.n * a * a + b @ self.xx @ b
                 - 2 * a * self.y - 2 * b @ self.xy + 2 * a * (b @ self.x))
        return max(float(error), 0.0)


def moments(rows: DataFrame, label: str, features: str = "features",
            group: str = "fold") -> dict[object, Moments]:
    """The moments of each group of ``rows``, in one aggregation.

    The origin is a row of the table: products of columns that are far from zero against
    their spread, such as positions, would lose their digits.
    """
    first = rows.select(vector_to_array(features), F.col(label).cast("double")).first()
    if first is None:
        return {}
    origin = np.array([*first[0], first[1]])
    p = len(origin) - 1
    x = [vector_to_array(features)[i] - float(origin[i]) for i in range(p)]
    columns = rows.select(F.col(group).alias("_g"), (F.col(label) - float(origin[p])).alias("y"),
                          *(x[i].alias(f"x{i}") for i in range(p)))
    names = [*(f"x{i}" for i in range(p)), "y"]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = columns.groupBy("_g").agg(
        F.count("*"), *(F.sum(c) for c in names),
        *(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).collect()
    found = {}
    for row in sums:
        products = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, row[p + 3:]):
            products[i, j] = products[j, i] = v
        found[row[0]] = Moments(float(row[1]), row[p + 2], products[p, p], np.array(row[2:p + 2]),
                                products[:p, :p], products[:p, p], origin)
    return found


def total(parts: Sequence[Moments]) -> Moments:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole + part
    return whole


# ---- linear regression ------------------------------------------------------------------

class LinearFit(Model):
    """A linear model with its penalty: adds ``prediction`` to a table of ``features``."""

    def __init__(self, coefficients: np.ndarray, intercept: float, reg: float, mix: float) -> None:
        super().__init__()
        self.coefficients, self.intercept = DenseVector(coefficients), float(intercept)
        self.reg, self.mix = reg, mix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", self.prediction(vector_to_array("features")))

    def prediction(self, x: Column) -> Column:
        out = F.lit(self.intercept)
        for i, b in enumerate(self.coefficients):
            out = out + float(b) * x[i]
        return out


@dataclass(frozen=True)
class Problem:
    """Elastic net on standardised columns: minimise b'Gb/2 - c'b + l1 |b| + l2 |b|^2 / 2."""

    g: np.ndarray
    c: np.ndarray
    l1: float
    l2: float
    scale: np.ndarray  # standard deviations of the features, 0 for a constant
    label: float  # and of the label


def problem(m: Moments, reg: float, mix: float) -> Problem:
    """``reg`` weighs the penalty, ``mix`` is the share of the absolute values in it; features
    and label count in their standard deviations, which is how Spark ML defines both."""
    cov = m.xx / m.n - np.outer(m.x, m.x) / m.n ** 2
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale <= 1e-12 * (np.abs(m.x / m.n) + 1)] = 0
    label = float(np.sqrt(max(m.yy / m.n - (m.y / m.n) ** 2, 0)))
    over = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)
    by_label = 1 / label if label else 0.0
    return Problem(cov * np.outer(over, over), (m.xy / m.n - m.x * m.y / m.n ** 2) * over * by_label,
                   reg * mix * by_label, reg * (1 - mix) * by_label, scale, label)


def violation(q: Problem, b: np.ndarray) -> float:
    """How far standardised coefficients are from the optimum: the gradient, reduced by what
    the absolute values allow. Zero exactly at the optimum."""
    slope = q.c - q.g @ b - q.l2 * b
    off = np.where(b != 0, np.abs(slope - q.l1 * np.sign(b)), np.maximum(np.abs(slope) - q.l1, 0))
    return float(np.where(q.scale > 0, off, 0).max(initial=0))


def solve(q: Problem) -> np.ndarray:
    """Standardised coefficients: one linear system without absolute values, else
    coordinate descent until nothing moves."""
    free = np.flatnonzero(q.scale)
    b = np.zeros(len(q.c))
    if not q.l1:
        if len(free):
            b[free] = np.linalg.lstsq(q.g[np.ix_(free, free)] + q.l2 * np.eye(len(free)),
                                      q.c[free], rcond=None)[0]
        return b
    g, c, diagonal = q.g.tolist(), q.c.tolist(), (np.diag(q.g) + q.l2).tolist()
    now = b.tolist()
    for _ in range(_SWEEPS):
        moved = 0.0
        for i in free:
            slope = c[i] - sum(u * v for u, v in zip(g[i], now)) + g[i][i] * now[i]
            new = max(abs(slope) - q.l1, 0.0) * (1 if slope > 0 else -1) / diagonal[i]
            moved = max(moved, abs(new - now[i]))
            now[i] = new
        if moved <= _STILL:
            break
    return np.array(now)


def fit_linear(m: Moments, reg: float, mix: float) -> LinearFit:
    q = problem(m, reg, mix)
    b = np.divide(solve(q) * q.label, q.scale, out=np.zeros(len(q.c)), where=q.scale > 0)
    means = m.x / m.n + m.origin[:-1]
    return LinearFit(b, m.y / m.n + m.origin[-1] - b @ means, reg, mix)


def standardised(q: Problem, fit: LinearFit) -> np.ndarray:
    return np.asarray(fit.coefficients) * q.scale / q.label if q.label else np.zeros(len(q.c))


def objective(m: Moments, fit: LinearFit) -> float:
    """What the fit minimises on these rows: half the mean squared error and the penalty."""
    q = problem(m, fit.reg, fit.mix)
    b = standardised(q, fit)
    penalty = q.l1 * np.abs(b).sum() + q.l2 * (b @ b) / 2
    return m.squared_error(fit) / m.n / 2 + penalty * q.label ** 2


def linear_scores(folds: dict[object, Moments], grid: Sequence[tuple[float, float]]) -> list[float]:
    """Mean root mean square error on the rows of a fold of a fit to all others, for each
    (reg, mix) of the grid."""
    parts = [folds[f] for f in sorted(folds)]
    whole = total(parts)
    return [float(np.mean([np.sqrt(part.squared_error(fit_linear(whole - part, *point)) / part.n)
                           for part in parts])) for point in grid]


# ---- Poisson regression -----------------------------------------------------------------

@dataclass(frozen=True)
class PoissonSums:
    """What a Poisson fit with a quadratic penalty makes of its rows."""

    n: int
    deviance: float
    aic: float
    residual: float  # of the score equations per row: zero at the optimum
    error: float  # root mean square


def poisson_sums(rows: DataFrame, label: str, coefficients: Sequence[float], intercept: float,
                 reg: float, features: str = "features") -> PoissonSums:
    """In one aggregation: expected counts, which are the working weights of the rows, their
    deviations from the label times each feature, and the likelihood. At the optimum the
    deviations times a feature add up to ``reg`` times the sum of weights times its
    coefficient, and the deviations alone to zero."""
    x, p = vector_to_array(features), len(coefficients)
    first = rows.select(x).first()
    origin = first[0] if first else [0.0] * p  # as in moments(): digits
    eta = F.lit(float(intercept))
    for i, b in enumerate(coefficients):
        eta = eta + float(b) * x[i]
    y, mu = F.col("y"), F.col("mu")
    table = rows.select(F.col(label).cast("double").alias("y"), eta.alias("eta"),
                        *((x[i] - float(origin[i])).alias(f"x{i}") for i in range(p)))
    table = table.withColumn("mu", F.exp("eta"))
    # the logarithm of a factorial, by Stirling's series from ten on
    z = F.greatest(y, F.lit(9.0)) + 1
    factorial = ((z - 0.5) * F.log(z) - z + 0.9189385332046727
                 + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5))
    factorial = F.when(y < 9, F.log(F.factorial(F.least(y, F.lit(9.0)).cast("int")).cast("double"))
                       ).otherwise(factorial)
    row = table.agg(
        F.count("*"), F.sum(F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu)),
        F.sum(y * F.col("eta") - mu - factorial), F.sum(mu), F.sum(y - mu),
        F.sqrt(F.avg((y - mu) * (y - mu))), *(F.sum((y - mu) * F.col(f"x{i}")) for i in range(p))).first()
    n, half, likelihood, weight, off, error = row[:6]
    slopes = np.array(row[6:]) - reg * weight * np.asarray(coefficients)
    return PoissonSums(n, 2 * half, 2 * (p + 1) - 2 * likelihood,
                       float(max(np.abs(slopes).max(initial=0), abs(off)) / max(n, 1)), error)


# ---- multinomial logistic regression ----------------------------------------------------

@dataclass(frozen=True)
class SoftmaxSums:
    """What a multinomial logistic fit makes of its rows, per row on the average."""

    n: int
    loss: float  # negative logarithm of the probability of the row's class
    shares_loss: float  # the same if each class had the probability of its share
    gradient: np.ndarray  # of the loss by the coefficients: classes times features
    bias: np.ndarray  # and by the intercepts: expected less actual rows of a class


def softmax_sums(rows: DataFrame, label: str, coefficients: np.ndarray, intercepts: np.ndarray,
                 features: str = "features") -> SoftmaxSums:
    """In one aggregation: loss, and its gradient per class and feature."""
    x, (classes, p) = vector_to_array(features), coefficients.shape
    margins = F.array(*(F.aggregate(
        F.zip_with(x, F.array(*(F.lit(float(b)) for b in w)), lambda u, v: u * v),
        F.lit(float(a)), lambda u, v: u + v) for w, a in zip(coefficients, intercepts)))
    table = rows.select(x.alias("x"), F.col(label).cast("int").alias("y"), margins.alias("m"))
    table = table.withColumn("top", F.array_max("m")).withColumn(
        "e", F.transform("m", lambda v: F.exp(v - F.col("top"))))
    table = table.withColumn("total", F.aggregate("e", F.lit(0.0), lambda u, v: u + v))
    off = [F.col("e")[c] / F.col("total") - (F.col("y") == c).cast("int") for c in range(classes)]
    row = table.agg(
        F.count("*"), F.sum(F.log("total") + F.col("top") - F.col("m")[F.col("y")]),
        *(F.count_if(F.col("y") == c) for c in range(classes)), *(F.sum(v) for v in off),
        *(F.sum(v * F.col("x")[i]) for v in off for i in range(p))).first()
    n = max(row[0], 1)
    share = np.array(row[2:2 + classes], float) / n
    known = share[share > 0]
    sums = np.array(row[2 + classes:], float) / n if row[0] else np.zeros(classes * (p + 1))
    return SoftmaxSums(row[0], (row[1] or 0.0) / n, float(-(known * np.log(known)).sum()),
                       sums[classes:].reshape(classes, p), sums[:classes])


# ---- naive Bayes ------------------------------------------------------------------------

def class_sums(rows: DataFrame, label: str, features: str = "features",
               group: str = "fold") -> DataFrame:
    """Per group and class: _g, _class, n, and sums of the features as an array."""
    p = rows.select(F.size(vector_to_array(features))).first()
    x = vector_to_array(features)
    return rows.groupBy(F.col(group).alias("_g"), F.col(label).alias("_class")).agg(
        F.count("*").alias("n"), F.array(*(F.sum(x[i]) for i in range(p[0] if p else 0))).alias("sums"))


def bayes_scores(rows: DataFrame, label: str, smoothing: float = 1.0, features: str = "features",
                 group: str = "fold") -> DataFrame:
    """Cross-validation of multinomial naive Bayes: _g, rows and accuracy on each group of a
    model fitted to all others. One aggregation fits, one pass over the rows judges.

    Classes are numbered as far as they occur in the rows fitted to, as Spark ML does.
    """
    spark = rows.sparkSession
    sums = {}
    for r in class_sums(rows, label, features, group).collect():  # groups times classes
        sums[r["_g"], r["_class"]] = np.array([r.n, *r.sums])
    groups, classes = (sorted({k[i] for k in sums}) for i in (0, 1))
    models = []
    for g in groups:
        rest = [sum(v for (f, c), v in sums.items() if c == each and f != g) for each in classes]
        rest = np.array([r for r in rest if np.ndim(r)])
        if not len(rest):  # all rows are of one group
            continue
        prior = np.log(rest[:, 0] + smoothing) - np.log(rest[:, 0].sum() + len(rest) * smoothing)
        s = rest[:, 1:]
        theta = np.log(s + smoothing) - np.log(s.sum(1) + s.shape[1] * smoothing)[:, None]
        models.append((g, prior.tolist(), theta.tolist()))
    key = rows.schema[group].dataType.simpleString()
    models = spark.createDataFrame(
        models, f"_m {key}, _prior array<double>, _theta array<array<double>>")
    x = vector_to_array(features)
    score = F.zip_with("_prior", "_theta", lambda prior, theta: F.aggregate(
        F.zip_with(x, theta, lambda a, b: a * b), prior, lambda a, b: a + b))
    judged = rows.join(F.broadcast(models), F.col(group) == F.col("_m")).select(
        F.col(group).alias("_g"), F.col(label).alias("_label"), score.alias("_score"))
    predicted = F.array_position("_score", F.array_max("_score")) - 1  # the first of equal ones
    return judged.groupBy("_g").agg(F.count("*").alias("rows"),
                                    F.avg((predicted == F.col("_label")).cast("int")).alias("accuracy"))
