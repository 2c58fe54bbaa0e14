"""Fit a model to matrix files: python -m factorloom -n train.mtx -p test.mtx [-o folder] ...

Rows are users and columns are items.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import partition, ratings
from .plans import model
from .sources import matrix


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factorloom", description=__doc__)
    p.add_argument("-n", "--train", required=True, help="ratings to fit to: mtx, sdm or sbm, also gzipped")
    p.add_argument("-p", "--test", required=True, help="ratings to predict")
    p.add_argument("-o", "--output", help="folder for Pavg.sdm, Pm2.sdm, U-mu.ddm, V-mu.ddm and so on")
    p.add_argument("-i", "--samples", type=int, default=20, help="iterations")
    p.add_argument("-b", "--burnin", type=int, default=5, help="iterations that don't count")
    p.add_argument("-a", "--alpha", type=float, default=2.0, help="precision of the ratings")
    p.add_argument("-d", "--factors", type=int, default=32)
    p.add_argument("-t", "--threads", help="local threads; without it, the session's master")
    p.add_argument("-v", "--all-samples", action="store_true", help="write the vectors of every iteration")
    p.add_argument("-r", "--log", help="file for progress in place of the console")
    pair = lambda x: tuple(x.split(","))
    p.add_argument("-l", "--user-prior", type=pair, metavar="MU,LAMBDA", help="an earlier fit's U-mu.ddm and U-Lambda.ddm")
    p.add_argument("-m", "--item-prior", type=pair, metavar="MU,LAMBDA", help="an earlier fit's V-mu.ddm and V-Lambda.ddm")
    p.add_argument("--parts", type=int, default=0, help="report how evenly so many parts of both sides are loaded")
    p.add_argument("-k", "--blocks", action="store_true", help="parts are blocks of neighbours instead of balanced")
    p.add_argument("-f", "--frequency", type=int, default=1, help="accepted and without effect: Spark moves vectors once an iteration")
    p.add_argument("--posterior", action="store_true", help="write means and precisions of the samples; needs more samples than factors")
    p.add_argument("--clamp", nargs=2, type=float, metavar=("LOW", "HIGH"))
    p.add_argument("--diagonal", action="store_true", help="draw each factor by itself")
    p.add_argument("--seed", type=int, default=0)
    return p


def main(args: list[str] | None = None) -> None:
    a = arguments().parse_args(args)
    if (a.all_samples or a.posterior) and not a.output:
        raise SystemExit("samples and posteriors need an output folder (-o)")
    logging.basicConfig(level=logging.INFO, filename=a.log, format="%(message)s")
    builder = SparkSession.builder.appName("factorloom")
    spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    read = lambda f: matrix.read_matrix(spark, f).select(F.col("row").alias("user"), F.col("col").alias("item"), "value")
    shapes = [matrix.matrix_shape(f) for f in (a.train, a.test)]
    priors = {f"{s}_prior": model.prior_from(spark, *files, a.factors) if (files := getattr(a, f"{s}_prior")) else None for s in ("user", "item")}
    params = model.Params(a.factors, a.samples, a.burnin, a.alpha, a.seed, tuple(a.clamp) if a.clamp else None, a.diagonal, keep_samples=a.all_samples, posterior=a.posterior)
    for side, n in (("user", max(s[0] for s in shapes)), ("item", max(s[1] for s in shapes))) if a.parts > 1 else ():
        counts = spark.range(n).join(ratings.nnz(read(a.train), side), "id", "left").fillna(0, ["nnz"])
        placed = counts.withColumn("part", partition.block(F.col("id"), n, a.parts)) if a.blocks else partition.assigned(counts, a.parts)
        logging.info("%s parts: %s", side, partition.load(placed).first().asDict())
    fitted = model.fit(read(a.train), read(a.test), params, max(s[0] for s in shapes), max(s[1] for s in shapes), **priors)
    if a.output:
        model.export(fitted, a.output)
    for row in fitted.times.rows():
        logging.info("%s: %.2f s, %d times, %.0f %%", row["path"], row["seconds"], row["count"], row["percent"])
    last = (fitted.metrics[-1] if fitted.metrics else {}) | fitted.final
    for key in ("rmse", "rmse_avg", "items_per_sec", "ratings_per_sec"):
        logging.info("%s: %s", key, last.get(key))


if __name__ == "__main__":
    main()
