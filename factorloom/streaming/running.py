"""Running mean and squared deviations of predictions that arrive as a stream (cell, iter, pred)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_moments(stream: DataFrame, burnin: int) -> DataFrame:
    """For each cell whose predictions came, its state after them: (cell, iter, n, pred_avg, pred_m2, pred).

    Up to iteration `burnin` the mean is the last prediction; then each one moves it by its share. Within a batch predictions
    count in the order of their iterations; over batches they have to come in that order.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState):
        n, avg, m2, last, at = state.get if state.exists else (0, 0.0, 0.0, 0.0, -1)
        rows = pd.concat(list(parts)).sort_values("iter")
        for i, pred in zip(rows["iter"], rows["pred"], strict=True):
            n = max(0, int(i) - burnin)
            if n == 0:
                avg, m2 = pred, 0.0
            else:
                d = pred - avg
                avg += d / n
                m2 += d * (pred - avg)
            last, at = pred, int(i)
        state.update((n, avg, m2, last, at))
        yield pd.DataFrame([(key[0], at, n, avg, m2, last)], columns=["cell", "iter", "n", "pred_avg", "pred_m2", "pred"])

    kept = "n long, pred_avg double, pred_m2 double, pred double, iter long"
    return stream.groupBy("cell").applyInPandasWithState(step, "cell long, iter long, n long, pred_avg double, pred_m2 double, pred double", kept, "update", GroupStateTimeout.NoTimeout)


def windowed_error(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """From (ts, value, pred): the error within each window of event time, as it changes (output mode update); rows later than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("pred"), 2))).alias("rmse"), F.count("*").alias("n"))
