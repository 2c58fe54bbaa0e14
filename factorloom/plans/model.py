"""Bayesian factor model of ratings, fitted by Gibbs sampling: each half-sweep is one Spark job.

value ~ Normal(mean + u . v, 1 / alpha), vectors of each side ~ Normal(mu, precision), (mu, precision) ~ Normal-Wishart. A half-sweep
aggregates each entity's normal equations from its ratings and the other side's vectors, and draws its vector in
numpy batches; the noise is a function of (seed, side, iteration, entity), so draws don't depend on how data is dealt out.
Vectors are stored after each half-sweep. Entities without ratings are drawn from the prior.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import Draws, NormalWishart, posterior_draws, posterior_factors, symmetric
from ..operators import evaluate, normal
from ..sources import matrix
from ..storage import discard, materialize
from .timing import Sections

log = logging.getLogger(__name__)
SIDES = ("item", "user")


@dataclass(frozen=True)
class Params:
    """k factors; `samples` iterations, of which the first `burnin` don't count; alpha, the precision of ratings.

    bounds clamps predictions; diagonal draws each factor by itself; sweeps is the number of sweeps for each draw of the
    hyper-parameters; zero_mean and global_mean_prior keep two habits of older programs: vectors' mean taken as 0 in the hyper-parameters,
    and the global mean in place of an entity's own prior mean. final_pass counts the last iteration's predictions once more at the end.
    """

    k: int = 32
    samples: int = 20
    burnin: int = 5
    alpha: float = 2.0
    seed: int = 0
    bounds: tuple[float, float] | None = None
    diagonal: bool = False
    sweeps: int = 1
    zero_mean: bool = False
    global_mean_prior: bool = False
    keep_samples: bool = False
    posterior: bool = False
    final_pass: bool = True
    draws: Draws = field(default_factory=Draws)


@dataclass
class Fitted:
    """users and items (id, f); state of the test cells (user, item, value, n, pred_avg, pred_m2, pred); metrics by iteration; final: the errors after the final pass."""

    params: Params
    mean: float
    n: dict[str, int]
    factors: dict[str, DataFrame]
    state: DataFrame | None
    metrics: list[dict] = field(default_factory=list)
    samples: dict[str, list[tuple[int, DataFrame]]] = field(default_factory=lambda: {s: [] for s in SIDES})
    sums: dict[str, DataFrame] = field(default_factory=dict)
    times: Sections = field(default_factory=Sections)
    final: dict = field(default_factory=dict)

    def recommend(self, cells: DataFrame) -> DataFrame:
        """Predictions of cells (user, item) from the last sample."""
        return evaluate.predicted(cells, self.factors["user"].select("id", "f"), self.factors["item"].select("id", "f"), self.mean, self.params.k, self.params.bounds, self.n["user"], self.n["item"])

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.metrics)

    def posterior(self, side: str, ridge: float = 0.0) -> DataFrame:
        """(id, mu, lambda): mean and precision of each entity's samples after burn-in; a prior for a later fit."""
        p = self.params
        if side not in self.sums:
            raise ValueError("no samples were added up: fit with posterior=True, and more iterations than burn-in")
        if p.samples - p.burnin < p.k + 1 and not ridge:
            raise ValueError(f"{p.samples - p.burnin} samples don't determine a {p.k} x {p.k} covariance; take more, or a ridge")
        return finalized(self.sums[side], p.k, ridge)


SUMS = "n long, sum array<double>, prod array<double>"


def lists(x: np.ndarray) -> pa.Array:
    """Rows as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x, float).ravel()))


def added(batch: pa.RecordBatch, f: np.ndarray, k: int) -> list[pa.Array]:
    """The columns n, sum and prod of a batch (null: none yet) after one more sample of each entity; prod is the upper triangle of the sum of f f'."""
    i, j = np.triu_indices(k)
    n, total, prod = np.ones(len(f), np.int64), f.copy(), f[:, i] * f[:, j]
    had = np.asarray(batch.column("n").is_valid())
    if had.any():
        n[had] += np.asarray(batch.column("n").drop_null())
        total[had] += normal.summed_rows(batch.column("sum").drop_null(), k)
        prod[had] += normal.summed_rows(batch.column("prod").drop_null(), len(i))
    return [pa.array(n), lists(total), lists(prod)]


def accumulated(samples: list[DataFrame], k: int) -> DataFrame:
    """(id, n, sum, prod) over samples (id, f), one after another; `fit` adds each sample up as it is drawn."""

    def more(batches):
        for batch in batches:
            f = normal.summed_rows(batch.column("f"), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *added(batch, f, k)], ["id", "n", "sum", "prod"])

    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SUMS.split(", ")]
    out = None
    for sample in samples:
        here = sample.select("id", "f", *none) if out is None else sample.join(out, "id").select("id", "f", "n", "sum", "prod")
        before, out = out, materialize(here.mapInArrow(more, f"id long, {SUMS}"))
        if before is not None:
            discard(before)
    return out


def finalized(acc: DataFrame, k: int, ridge: float = 0.0) -> DataFrame:
    """(id, mu, lambda): mean, and the inverse of the sample covariance, as K x K values, column by column."""

    def inverted(batches):
        for batch in batches:
            n = np.asarray(batch.column("n")).astype(float)
            s, p = normal.summed_rows(batch.column("sum"), k), normal.summed_rows(batch.column("prod"), k * (k + 1) // 2)
            cov = (symmetric(p, k) - s[:, :, None] * s[:, None, :] / n[:, None, None]) / (n - 1)[:, None, None] + ridge * np.eye(k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(s / n[:, None]), lists(np.linalg.inv(cov).reshape(len(n), -1))], ["id", "mu", "lambda"])

    return acc.mapInArrow(inverted, "id long, mu array<double>, lambda array<double>")


def factored(stats: DataFrame, precision: np.ndarray, k: int, alpha: float) -> DataFrame:
    """(id, lower): the lower triangle, row by row, of each entity's posterior precision's Cholesky factor, from its normal equations."""

    def lowered(batches):
        i, j = np.tril_indices(k)
        for batch in batches:
            gram = symmetric(normal.summed_rows(batch.column("gram"), k * (k + 1) // 2), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(posterior_factors(gram, precision, alpha)[:, i, j])], ["id", "lower"])

    return stats.select(F.col("id").cast("long").alias("id"), "gram").mapInArrow(lowered, "id long, lower array<double>")


def half_sweep(ratings: DataFrame, side: str, other: DataFrame, n: int, n_other: int, mean: float, hyper: tuple[np.ndarray, np.ndarray], p: Params, key: tuple, prior: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """Draw the vectors of all n entities of a side: (id, f). `prior` (id, mu, lambda) replaces the hyper-parameters for the entities that it has.

    ratings may be as `normal.prepared` gives them. With `base` (id, n, sum, prod) the result has these too, with the draw added.
    """
    k, (mu, precision) = p.k, hyper
    stats = normal.normal_equations(ratings, other, side, "user" if side == "item" else "item", mean, k, n_other)
    every = (other.sparkSession.range(n) if base is None else base.select("id", "n", "sum", "prod").withColumnRenamed("n", "_n")).join(stats.select(F.col("id").cast("long").alias("id"), "gram", "rr"), "id", "left")
    none = lambda w: F.array_repeat(F.lit(0.0), w)
    every = every.select("id", F.coalesce("gram", none(k * (k + 1) // 2)).alias("gram"), F.coalesce("rr", none(k)).alias("rr"), *([] if base is None else [F.col("_n").alias("n"), "sum", "prod"]))
    if prior is not None:
        every = every.join(prior.select("id", "mu", "lambda"), "id", "left")

    adds = base is not None

    def drawn(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            means, precisions = np.broadcast_to(mu, (len(ids), k)), np.broadcast_to(precision, (len(ids), k, k))
            if "mu" in batch.schema.names:
                own = np.asarray(batch.column("mu").is_valid())
                means, precisions = means.copy(), precisions.copy()
                if own.any():
                    if not p.global_mean_prior:
                        means[own] = normal.summed_rows(batch.column("mu").drop_null(), k)
                    precisions[own] = normal.summed_rows(batch.column("lambda").drop_null(), k * k).reshape(-1, k, k)
            gram = symmetric(normal.summed_rows(batch.column("gram"), k * (k + 1) // 2), k)
            f = posterior_draws(gram, normal.summed_rows(batch.column("rr"), k), means, precisions, p.alpha, p.draws.noise(ids, k, *key), p.diagonal)
            sums = added(batch, f, k) if adds else []
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists(f), *sums], ["id", "f", "n", "sum", "prod"][: 2 + len(sums)])

    return every.mapInArrow(drawn, "id long, f array<double>" + (f", {SUMS}" if adds else ""))


def fit(train: DataFrame, test: DataFrame | None = None, params: Params | None = None, n_users: int | None = None, n_items: int | None = None, user_prior: DataFrame | None = None, item_prior: DataFrame | None = None, init: dict[str, DataFrame] | None = None) -> Fitted:
    """Fit to ratings (user, item, value), ids from 0; shapes are as large as train and test need, unless given.

    Each iteration draws items given users, then users given items, then predicts the test cells from both.
    init gives vectors to start from in place of zeros.
    """
    p, spark = params or Params(), train.sparkSession
    train = materialize(train.select("user", "item", "value"))
    test = None if test is None else materialize(test.select("user", "item", "value"))
    cells = train if test is None else train.unionByName(test)
    most = cells.agg(F.max("user").alias("user"), F.max("item").alias("item")).first()
    n = {"user": n_users or (most["user"] or 0) + 1, "item": n_items or (most["item"] or 0) + 1}
    mean, nnz = train.agg(F.avg("value"), F.count("*")).first()
    static = {s: normal.prepared(train, s, p.k) for s in SIDES}
    priors = {"user": user_prior, "item": item_prior}
    zeros = lambda s: spark.range(n[s]).select("id", F.array_repeat(F.lit(0.0), p.k).alias("f"))
    factors = {s: materialize((init or {}).get(s) or zeros(s)) for s in SIDES}
    out = Fitted(p, mean, n, factors, None)
    prior = NormalWishart.prior(p.k)
    for i in range(p.samples):
        began = time.perf_counter()
        hyper, norms = {}, {}
        for t in range(p.sweeps):
            for at, side in enumerate(SIDES):
                if t == 0:
                    with out.times.section("hyper"):
                        m, cov, norms[side] = side_moments(factors[side], n[side], p.k)
                    hyper[side] = prior.given(n[side], m * (not p.zero_mean), cov).draw(p.draws.generator(p.seed, at, i))
                other = "user" if side == "item" else "item"
                add = p.posterior and i >= p.burnin and t == p.sweeps - 1
                none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SUMS.split(", ")]
                base = (out.sums[side] if side in out.sums else factors[side].select("id", *none)) if add else None
                with out.times.section(side):
                    drawn = materialize(half_sweep(static[side], side, factors[other].select("id", "f"), n[side], n[other], mean, hyper[side], p, (p.seed, at, i * p.sweeps + t), priors[side], base))
                if not p.keep_samples and factors[side] is not out.sums.get(side):
                    discard(factors[side])
                if add:
                    if side in out.sums and not p.keep_samples:
                        discard(out.sums[side])
                    out.sums[side] = drawn
                factors[side] = drawn
        for side in SIDES:
            if p.keep_samples:
                out.samples[side].append((i, factors[side].select("id", "f")))
        row = {"iter": i, "burnin": i < p.burnin, **{f"norm_{s}": float(np.sqrt(norms[s])) for s in SIDES}}
        if test is not None:
            with out.times.section("predict"):
                seen = Observation()
                cells = test if out.state is None else out.state
                now = updated(cells, evaluate.predicted(cells, factors["user"].select("id", "f"), factors["item"].select("id", "f"), mean, p.k, p.bounds, n["user"], n["item"], name="_pred"), i, p.burnin)
                before, out.state = out.state, materialize(now.observe(seen, *errors("pred", "pred_avg")))
                row |= seen.get
            if before is not None:
                discard(before)
        took = time.perf_counter() - began
        row |= {"seconds": took, "items_per_sec": sum(n.values()) / took, "ratings_per_sec": nnz / took}
        out.metrics.append(row)
        log.info("iteration %(iter)d: %(row)s", {"iter": i, "row": row})
    if p.final_pass and out.state is not None:
        seen = Observation()
        out.state = materialize(evaluate.final_pass(out.state).select(out.state.columns).observe(seen, *errors("pred", "pred_avg")))
        out.final = seen.get
    for s in SIDES:
        static[s].unpersist()
    return out


def side_moments(factors: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance (n - 1 below) and sum of squares of all vectors of a side; K(K+3)/2 + 1 numbers come to the driver."""
    total, one = np.zeros((k, k)), np.zeros(k)
    for i, j, x in normal.moments(factors, k).collect():
        if i >= 0:
            total[i, j] = total[j, i] = x
        elif j >= 0:
            one[j] = x
    mean = one / n
    return mean, (total - n * np.outer(mean, mean)) / max(n - 1, 1), float(np.trace(total))


def updated(state: DataFrame, predictions: DataFrame, i: int, burnin: int) -> DataFrame:
    """The running mean and squared deviations of each test cell after one more prediction, `_pred` of predictions, which are the state's own rows."""
    count = max(0, i - burnin)
    pred = F.col("_pred")
    if "pred_avg" not in state.columns or count == 0:
        return predictions.select("user", "item", "value", F.lit(0).cast("long").alias("n"), pred.alias("pred_avg"), F.lit(0.0).alias("pred_m2"), pred.alias("pred"))
    d = pred - F.col("pred_avg")
    avg = F.col("pred_avg") + d / count
    return predictions.select("user", "item", "value", F.lit(count).cast("long").alias("n"), avg.alias("pred_avg"), (F.col("pred_m2") + d * (pred - avg)).alias("pred_m2"), pred.alias("pred"))


def errors(pred: str, avg: str) -> list:
    off = lambda c: F.sqrt(F.avg(F.pow(F.col("value") - F.col(c), 2)))
    return [off(pred).alias("rmse"), off(avg).alias("rmse_avg"), F.count("*").alias("n_predict")]


def save(model: Fitted, path: str) -> None:
    """A model folder: vectors of both sides, the test state with its variance, metrics, and each kept sample."""
    spark = model.factors["user"].sparkSession
    for side in SIDES:
        model.factors[side].select("id", "f").write.mode("overwrite").parquet(f"{path}/{side}")
        for i, f in model.samples[side] if model.params.keep_samples else []:
            f.withColumn("iter", F.lit(i)).write.mode("append").partitionBy("iter").parquet(f"{path}/{side}-samples")
        if model.params.posterior:
            model.posterior(side).write.mode("overwrite").parquet(f"{path}/{side}-posterior")
    if model.state is not None:
        model.state.withColumn("pred_var", F.when(F.col("n") > 1, F.col("pred_m2") / (F.col("n") - 1))).write.mode("overwrite").parquet(f"{path}/predictions")
    if model.metrics:
        model.metrics_frame(spark).write.mode("overwrite").parquet(f"{path}/metrics")


def export(model: Fitted, path: str) -> None:
    """Matrix files of a model: Pavg.sdm and Pm2.sdm over the test cells, and of each side (U users, V items) the means and
    precisions of its samples, or its last vectors where none were kept."""
    if model.state is not None:
        for name, column in (("Pavg", "pred_avg"), ("Pm2", "pred_m2")):
            cells = model.state.select(F.col("user").alias("row"), F.col("item").alias("col"), F.col(column).alias("value"))
            matrix.write_matrix(cells, f"{path}/{name}.sdm", rows=model.n["user"], cols=model.n["item"])
    for side, letter in (("user", "U"), ("item", "V")):
        if model.params.posterior:
            post = materialize(model.posterior(side))
            for name, column in (("mu", "mu"), ("Lambda", "lambda")):
                matrix.write_matrix(matrix.as_cells(post.select("id", F.col(column).alias("f"))), f"{path}/{letter}-{name}.ddm", cols=model.n[side])
        else:
            matrix.write_matrix(matrix.as_cells(model.factors[side].select("id", "f")), f"{path}/{letter}-mu.ddm", cols=model.n[side])
        for i, f in model.samples[side] if model.params.keep_samples else []:
            matrix.write_matrix(matrix.as_cells(f), f"{path}/{letter}-{i}.ddm", cols=model.n[side])


def prior_from(spark: SparkSession, mu: str, precision: str, k: int) -> DataFrame:
    """(id, mu, lambda) from a K x N and a K^2 x N matrix file, as `export` writes them."""
    m, p = (matrix.as_vectors(matrix.read_matrix(spark, f), n) for f, n in ((mu, k), (precision, k * k)))
    return m.withColumnRenamed("f", "mu").join(p.withColumnRenamed("f", "lambda"), "id")
