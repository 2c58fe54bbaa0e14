"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and on how many threads.

Each query runs twice and counts as it runs the second time; results are computed in full, but not kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from factorloom import queries as q
from factorloom.functions import sampling
from factorloom.operators import normal
from factorloom.plans import model
from factorloom.storage import discard_all, materialize, temporary

try:
    from factorloom.llm import queries as llm
except ModuleNotFoundError:
    llm = None

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
PLAIN = ("ratings_dedup", "prep_join_filter_distinct", "densified_ratings", "train_test_split_exact", "half_sweep_k2", "rmse", "running_mean_m2", "connectivity", "moments_embeddings", "matrix_roundtrip_sdm")


def gram(spark: SparkSession, k: int):
    """One pass of the normal equations of all items over the stored ratings, and for k = 32 the draws as well."""
    ratings = materialize(q.ratings(spark, DIR))
    users = materialize(q.users(spark, DIR, k))
    mean = q.rt.mean_rating(ratings).first()["mean"]
    n = users.count()
    if k <= normal.NATIVE:
        return lambda: normal.normal_equations(ratings, users, "item", "user", mean, k, n)
    hyper = sampling.NormalWishart.prior(k).draw(sampling.generator(0))
    items = spark.read.parquet(f"{DIR}/part.parquet").count()
    ratings = normal.prepared(ratings, "item", k)
    return lambda: model.half_sweep(ratings, "item", users, items, n, mean, hyper, model.Params(k=k), (0, 0, 0))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = {name: (lambda f=q.QUERIES[name]: f(spark, DIR)) for name in PLAIN}
    work |= {f"gram_k{k}": gram(spark, k) for k in (8, 10)} | {f"half_sweep_k{k}": gram(spark, k) for k in (16, 32)}
    if llm:
        work |= {name: (lambda f=f: f(spark, DIR)) for name, f in llm.QUERIES.items()}
    times = {}
    for name, run in work.items():
        for _ in range(2):
            began = time.perf_counter()
            with temporary():
                run().write.format("noop").mode("overwrite").save()
                times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr)
    began = time.perf_counter()
    fitted = q.fitted(spark, DIR, k=10, samples=3)
    times["gibbs_k10_3_iterations"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(DIR.rstrip("/")), "ratings_per_sec": round(fitted.metrics[-1]["ratings_per_sec"])}))
    discard_all()
    spark.stop()


if __name__ == "__main__":
    main()
