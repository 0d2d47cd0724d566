"""Six quality metrics of a prediction in one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["rmse", "mae", "r2", "f1", "accuracy", "weightedPrecision"]


def _as_rows(values: dict[str, Column]) -> Column:
    return F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value"))
                              for k, v in values.items())))


def evaluate(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """``metric, value`` for rmse, mae, r2, f1, accuracy and weightedPrecision.

    Labels are whole numbers (counts or class indices). The last three metrics take a
    prediction for a class only if it equals a label exactly, so they stay near zero
    for a regression; that is what they are worth there.

    The table is reduced once to counts and error sums per (label, predicted class);
    a prediction that is no whole number belongs to no class.
    """
    y, p = F.col("_y"), F.col("_p")
    pairs = (predictions.select(F.col(label).cast("double").alias("_y"),
                                F.col(prediction).cast("double").alias("_p"))
             .groupBy("_y", F.when(p == F.rint(p), p).alias("_class"))
             .agg(F.count("*").alias("n"), F.sum((p - y) * (p - y)).alias("sq"),
                  F.sum(F.abs(p - y)).alias("ab")))

    n, total = F.col("n"), F.sum("n")
    sum_y = F.sum(n * y)
    spread = F.sum(n * y * y) - sum_y * sum_y / total
    errors = pairs.agg(
        F.sqrt(F.sum("sq") / total).alias("rmse"), (F.sum("ab") / total).alias("mae"),
        # labels that are all equal leave nothing to explain
        F.when(spread != 0, F.lit(1.0) - F.try_divide(F.sum("sq"), spread))
        .when(F.sum("sq") == 0, F.lit(float("nan")))
        .otherwise(F.lit(float("-inf"))).alias("r2"),
        (F.sum(F.when(F.col("_class") == y, n).otherwise(0)) / total).alias("accuracy"))

    hits = F.when(F.col("_class") == y, n).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    per_class = (pairs.select(F.inline(F.array(
        F.struct(y.alias("c"), n.alias("support"), hits.cast("long").alias("hits"),
                 zero.alias("predicted")),
        F.struct(F.col("_class").alias("c"), zero.alias("support"), zero.alias("hits"),
                 n.alias("predicted")))))
        .groupBy("c").agg(*(F.sum(x).alias(x) for x in ("support", "hits", "predicted")))
        .filter(F.col("support") > 0))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    weighted = per_class.agg(
        (F.sum(F.col("support") * f1) / F.sum("support")).alias("f1"),
        (F.sum(F.col("support") * precision) / F.sum("support")).alias("weightedPrecision"))

    return (errors.select(_as_rows({m: F.col(m) for m in ("rmse", "mae", "r2", "accuracy")}))
            .unionByName(weighted.select(
                _as_rows({m: F.col(m) for m in ("f1", "weightedPrecision")}))))
