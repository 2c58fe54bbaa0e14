"""Predictions of cells, their error, and their running moments over iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, dot
from .normal import with_factors


def predicted(cells: DataFrame, users: DataFrame, items: DataFrame, mean: float, k: int, bounds: tuple[float, float] | None = None, n_users: int | None = None, n_items: int | None = None, name: str = "pred") -> DataFrame:
    """cells with pred, the product of both sides' vectors plus the mean; cells without a vector on both sides are left out.

    Vectors are counted, to see whether they can be broadcast, unless their numbers are given.
    """
    both = with_factors(cells, users, "user", k, n_users).withColumnRenamed("f", "_u")
    pred = dot(F.col("_u"), F.col("f"), k) + mean
    return with_factors(both, items, "item", k, n_items).withColumn(name, clamp(pred, *bounds) if bounds else pred).drop("_u", "f")


def rmse(cells: DataFrame, pred: str = "pred", name: str = "rmse") -> DataFrame:
    return cells.agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col(pred), 2))).alias(name), F.count("*").alias("n_predict"))


def coverage(predicted_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: the percentage of cells that have a prediction."""
    return predicted_cells.agg(F.count("*").alias("n_predict")).join(F.broadcast(cells.agg(F.count("*").alias("n_cells")))).select("n_predict", "n_cells", (F.col("n_predict") * 100.0 / F.col("n_cells")).alias("coverage"))


def running(log: DataFrame, cell: str, burnin: int) -> DataFrame:
    """From (cell, iter, pred): for each row the mean and the sum of squared deviations (m2) so far.

    Up to iteration `burnin` the mean is the prediction itself and m2 is 0; afterwards both are over the iterations after burnin.
    """
    so_far = Window.partitionBy(cell).orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("iter") > burnin, F.col("pred"))
    n = F.count(counted).over(so_far)
    early = F.col("iter") <= burnin
    return log.select(cell, "iter", F.when(early, 0).otherwise(n).alias("n"), F.when(early, F.col("pred")).otherwise(F.avg(counted).over(so_far)).alias("pred_avg"), F.when(early, 0.0).otherwise(F.var_pop(counted).over(so_far) * n).alias("pred_m2"))


def running_last(log: DataFrame, cell: str, burnin: int) -> DataFrame:
    """The last state of `running` for each cell, by one aggregation."""
    late = F.when(F.col("iter") > burnin, F.col("pred"))
    last = F.max_by("pred", "iter")
    return log.groupBy(cell).agg(F.count(late).alias("n"), F.coalesce(F.avg(late), last).alias("pred_avg"), F.coalesce(F.var_pop(late) * F.count(late), F.lit(0.0)).alias("pred_m2"), last.alias("pred"))


def final_pass(state: DataFrame) -> DataFrame:
    """A state after its last prediction is given once more, with the same number of samples."""
    d = F.col("pred") - F.col("pred_avg")
    avg = F.when(F.col("n") > 0, F.col("pred_avg") + d / F.greatest("n", F.lit(1))).otherwise(F.col("pred"))
    return state.withColumns({"pred_m2": F.when(F.col("n") > 0, F.col("pred_m2") + d * (F.col("pred") - avg)).otherwise(0.0), "pred_avg": avg})


def mean_from(log: DataFrame, cell: str, first: int) -> DataFrame:
    """The mean prediction of each cell over iterations from `first` on."""
    return log.where(F.col("iter") >= first).groupBy(cell).agg(F.avg("pred").alias("pred_avg"), F.count("*").alias("n"))


def error_trace(log: DataFrame, truth: Column) -> DataFrame:
    """The error of each iteration's predictions."""
    return log.groupBy("iter").agg(F.sqrt(F.avg(F.pow(truth - F.col("pred"), 2))).alias("rmse"))
