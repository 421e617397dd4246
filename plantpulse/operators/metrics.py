"""Evaluation metrics as aggregations.

Everything is computed from grouped counts / sums, so scoring a billion
predictions is one partial aggregation plus a tiny final step on the
(#classes x #classes) confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_long(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """A10: (label, prediction, n) for every pair of the class list, zero cells
    kept, and for every other pair that occurs."""
    cls = F.array(*[F.lit(c) for c in classes])
    types = df.schema
    cells = (df.sparkSession.range(1).select(F.explode(cls).alias(label)).select(label, F.explode(cls).alias(pred))
             .select(F.col(label).cast(types[label].dataType), F.col(pred).cast(types[pred].dataType),
                     F.lit(0).cast("long").alias("n")))
    counts = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(cells).groupBy(label, pred).agg(F.sum("n").alias("n"))


def confusion_wide(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """A10 as a matrix: rows = true class, one column per predicted class."""
    long = confusion_long(df, label, pred, classes)
    return (long.groupBy(label).pivot(pred, list(classes)).agg(F.sum("n"))
                .na.fill(0))


def alarm_count_cols(label: str, pred: str, positive=1, negative=0) -> list:
    """A11 as aggregate expressions: missed faults (true positive class
    predicted negative) and false alarms (true negative predicted positive)."""
    return [F.count_if((F.col(label) == positive) & (F.col(pred) == negative)).alias("missed"),
            F.count_if((F.col(label) == negative) & (F.col(pred) == positive)).alias("false_alarms")]


def alarm_counts(df: DataFrame, label: str, pred: str, positive=1, negative=0) -> DataFrame:
    """A11."""
    return df.agg(*alarm_count_cols(label, pred, positive, negative))


def classification_report(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """Per-class precision / recall / F1 / support plus ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows; undefined ratios are 0. Labels
    outside the class list that occur have rows of their own and count."""
    long = confusion_long(df, label, pred, classes)
    zero = F.lit(0).cast("long")
    sides = long.select(F.col(label).alias("cls"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(zero).alias("tp"),
                        F.col("n").alias("support"), zero.alias("n_pred")).union(
        long.select(F.col(pred).alias("cls"), zero, zero, F.col("n")))
    t = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "n_pred")])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    t = t.select(F.col("cls").cast("string").alias("cls"), prec.alias("p"), rec.alias("r"),
                 "support", "tp")
    t = t.withColumn("f1", f1)
    all_ = Window.partitionBy()
    t = t.withColumns({"_tot": F.sum("support").over(all_), "_tp": F.sum("tp").over(all_)})
    classes_rows = t.select(F.col("cls").alias("row"), F.col("p").alias("precision"),
                            F.col("r").alias("recall"), F.col("f1").alias("f1"),
                            F.col("support").cast("long").alias("support"))
    summary = t.groupBy().agg(
        F.first("_tp").alias("tp"), F.first("_tot").alias("tot"),
        F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("p") * F.col("support")).alias("wp"), F.sum(F.col("r") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = F.coalesce(F.try_divide(F.col("tp"), F.col("tot")), F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), F.col("tot").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                 F.col("tot").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"),
                 F.coalesce(F.try_divide(F.col("wp"), F.col("tot")), F.lit(0.0)).alias("precision"),
                 F.coalesce(F.try_divide(F.col("wr"), F.col("tot")), F.lit(0.0)).alias("recall"),
                 F.coalesce(F.try_divide(F.col("wf"), F.col("tot")), F.lit(0.0)).alias("f1"),
                 F.col("tot").cast("long").alias("support")))
    return classes_rows.unionByName(summary.select(F.inline(rows)))


def regression_metrics(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """R2 = 1 - SSE / (n var_pop(y)), MSE, MAE, RMSE (one aggregation)."""
    e = F.col(y) - F.col(y_hat)
    agg = df.filter(F.col(y).isNotNull() & F.col(y_hat).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("var_y"))
    return agg.select(
        "n",
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("n") * F.col("var_y"))).alias("r2"),
        (F.col("sse") / F.col("n")).alias("mse"), "mae",
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def thresholded_accuracy_col(y: str, y_hat: str, threshold: float = 0.5):
    """A14 as an aggregate expression."""
    same = (F.col(y) > threshold) == (F.col(y_hat) > threshold)
    return F.avg(same.cast("double"))


def thresholded_accuracy(df: DataFrame, y: str, y_hat: str, threshold: float = 0.5) -> DataFrame:
    """Share of rows where truth and prediction fall on the same side of
    the threshold."""
    return df.agg(thresholded_accuracy_col(y, y_hat, threshold).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))
