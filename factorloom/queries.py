"""The registered queries on the TPC-H-like tables, and the SQL that gives the same rows.

Ratings are customers' orders of parts: user o_custkey, item l_partkey, value l_quantity. Where a query needs factors or
noise, they are pseudo-random functions of ids that both engines compute.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sampling
from .functions.columns import normal, normal_sql, outer, squared_norm, uniform, uniform_sql
from .operators import evaluate, normal as equations, partition, prep, ratings as rt
from .plans import model
from .sources import delimited, matrix
from .storage import materialize, scratch_dir
from .streaming.running import running_moments, windowed_error

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARTS = 4
ALPHA = 2.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return prep.triplets(raw(spark, d), "o_custkey", "l_partkey", "l_quantity")


R = """r AS (SELECT o_custkey AS "user", l_partkey AS item, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
KEY = """('0x' || substr(md5("user" || ':' || item), 1, 12))::BIGINT"""


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    both = prep.split(ratings(spark, d), "user", "item")
    return both.where("NOT is_test").drop("is_test"), both.where("is_test").drop("is_test")


S = f"""{R}, train AS (SELECT * FROM r WHERE {KEY} % 5 <> 0), test AS (SELECT * FROM r WHERE {KEY} % 5 = 0)"""


def factors(ids: DataFrame, side: str, k: int = 2) -> DataFrame:
    """(id, f): pseudo-random vectors of entities (id)."""
    return ids.select("id", F.array(*[2 * uniform(F.col("id"), side, j) - 1 for j in range(k)]).alias("f"))


def f_sql(side: str, ident: str, k: int = 2) -> str:
    return ", ".join(f"2 * {uniform_sql(ident, side, j)} - 1 AS f{j}" for j in range(k))


def users(spark: SparkSession, d: str, k: int = 2) -> DataFrame:
    return factors(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "user", k)


def items(spark: SparkSession, d: str, k: int = 2) -> DataFrame:
    return factors(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "item", k)


U = f"""u AS (SELECT c_custkey AS id, {f_sql("user", "c_custkey")} FROM customer)"""
V = f"""v AS (SELECT p_partkey AS id, {f_sql("item", "p_partkey")} FROM part)"""
M = "m AS (SELECT avg(value) AS mean FROM r)"


# --- preparation


@query(f"""WITH {R} SELECT "user", item, value FROM r""")
def ratings_dedup(spark, d):
    return ratings(spark, d)


@query("""SELECT DISTINCT o_custkey AS compound, l_suppkey AS target, l_extendedprice AS value
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_size = 10""")
def prep_join_filter_distinct(spark, d):
    acts = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "record_id", "l_partkey": "assay_id"})
    records = table(spark, d, "orders").withColumnRenamed("o_orderkey", "record_id")
    assays = table(spark, d, "part").withColumnRenamed("p_partkey", "assay_id")
    keep = (F.col("l_returnflag") == "R") & (F.col("p_size") == 10)
    return prep.activities(records, acts, assays, "record_id", "assay_id", keep, compound="o_custkey", target="l_suppkey", value="l_extendedprice")


@query("""SELECT o_custkey AS "user", dense_rank() OVER (ORDER BY o_custkey) AS id FROM (SELECT DISTINCT o_custkey FROM orders)""")
def dense_ids(spark, d):
    return prep.dense_ids(table(spark, d, "orders"), "o_custkey").withColumnRenamed("o_custkey", "user")


@query(f"""WITH {R} SELECT dense_rank() OVER (ORDER BY "user") AS "user", dense_rank() OVER (ORDER BY item) AS item, value FROM r""")
def densified_ratings(spark, d):
    return prep.densified(ratings(spark, d), "user", "item")


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal <> 0 THEN round(log10(abs(c_acctbal)), 6) END AS x FROM customer""")
def log_transform(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(prep.log10_abs(F.col("c_acctbal")), 6).alias("x"))


@query(f"""WITH {R} SELECT "user", item, value, {KEY} % 5 = 0 AS is_test FROM r""")
def train_test_split(spark, d):
    return prep.split(ratings(spark, d), "user", "item")


@query(f"""WITH {R}, k AS (SELECT *, {KEY} AS key FROM r)
    SELECT "user", item, value, row_number() OVER (ORDER BY key, "user", item) <= floor((SELECT count(*) FROM r) / 5.0 + 0.5) AS is_test FROM k""")
def train_test_split_exact(spark, d):
    return prep.split_exact(ratings(spark, d), "user", "item")


# --- projections and shapes


@query(f"""WITH {R}, {M} SELECT "user", item, round((value - mean) * {ALPHA}, 6) AS value FROM r, m""")
def centered(spark, d):
    r = ratings(spark, d)
    mean = rt.mean_rating(r).first()["mean"]
    return rt.centered(r, mean, ALPHA).withColumn("value", F.round("value", 6))


@query(f"""WITH {R} SELECT item AS "user", "user" AS item, value FROM r""")
def transpose_ratings(spark, d):
    return rt.transposed(ratings(spark, d))


@query(f"""WITH {R} SELECT "user", item, value FROM r WHERE item = 7""")
def column_slice(spark, d):
    return rt.of_entity(ratings(spark, d), "item", 7)


@query(f"""WITH {S} SELECT (SELECT max("user") + 1 FROM r) AS n_users, (SELECT max(item) + 1 FROM r) AS n_items""")
def shape_union(spark, d):
    return rt.shape(*split(spark, d))


@query(f"""WITH {S} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT "user" FROM test)""")
def unrated_entities(spark, d):
    return rt.unrated(split(spark, d)[1], "user", table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query(f"""WITH {S}, a AS (SELECT item AS id, count(*) AS a FROM train GROUP BY 1), b AS (SELECT item AS id, count(*) AS b FROM r GROUP BY 1)
    SELECT id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (id) WHERE coalesce(a, 0) <> coalesce(b, 0)""")
def structure_check(spark, d):
    return rt.structure_differences(split(spark, d)[0], ratings(spark, d), "item")


@query(f"""WITH {S} SELECT DISTINCT "user", item FROM (SELECT "user", item FROM train UNION ALL SELECT "user", item FROM test)""")
def pattern_union(spark, d):
    return rt.pattern_union(*split(spark, d))


@query(f"""WITH {R}, {M} SELECT "user", item, 1.0::DOUBLE AS value FROM r, m WHERE value - mean > 0""")
def sbm_filter(spark, d):
    r = ratings(spark, d)
    return rt.positive(rt.centered(r, rt.mean_rating(r).first()["mean"]))


@query(f"""WITH {R}, n AS (SELECT max(item) AS n FROM r) SELECT "user", n - item AS item, value FROM r, n""")
def permute_ids(spark, d):
    r = ratings(spark, d)
    ids = r.select(F.col("item").alias("id")).distinct()
    most = ids.agg(F.max("id")).first()[0]
    return rt.relabelled(r, "item", ids.withColumn("new_id", F.lit(most) - F.col("id")))


# --- aggregates


@query(f"""WITH {R} SELECT round(avg(value), 6) AS mean, count(*) AS nnz FROM r""")
def mean_rating(spark, d):
    return rt.mean_rating(ratings(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {R} SELECT "user" AS id, count(*) AS nnz FROM r GROUP BY 1""")
def user_nnz(spark, d):
    return rt.nnz(ratings(spark, d), "user")


@query(f"""WITH {R}, c AS (SELECT item, count(*) AS n FROM r GROUP BY 1), e AS (SELECT count(*) AS e FROM part)
    SELECT round(sum(n) / any_value(e), 6) AS avg_nnz, round(sum(CASE WHEN n > 24 THEN 1 ELSE 0 END) * 100.0::DOUBLE / any_value(e), 6) AS pct_many,
           round(sum(CASE WHEN n > 10500 THEN 1 ELSE 0 END) * 100.0::DOUBLE / any_value(e), 6) AS pct_very_many FROM c, e""")
def nnz_profile(spark, d):
    found = rt.nnz_profile(ratings(spark, d), "item", table(spark, d, "part").count())
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


GRAM = f"""{R}, {M}, {U}, g AS (
  SELECT item AS id, count(*) AS n, sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11, sum(f0 * (value - mean)) AS r0, sum(f1 * (value - mean)) AS r1
  FROM r JOIN u ON r."user" = u.id, m GROUP BY 1)"""


def equations_of(spark, d, k=2, native=equations.NATIVE):
    r = ratings(spark, d)
    mean = rt.mean_rating(r).first()["mean"]
    return equations.normal_equations(r, users(spark, d, k), "item", "user", mean, k, native=native)


@query(f"""WITH {GRAM} SELECT id, n, round(g00, 6) AS g00, round(g01, 6) AS g01, round(g11, 6) AS g11 FROM g""")
def gram_k2(spark, d):
    return equations_of(spark, d).select("id", "n", *[F.round(F.col("gram")[i], 6).alias(c) for i, c in enumerate(("g00", "g01", "g11"))])


@query(f"""WITH {GRAM} SELECT id, n, round(r0 * {ALPHA}, 6) AS r0, round(r1 * {ALPHA}, 6) AS r1 FROM g""")
def rr_k2(spark, d):
    return equations_of(spark, d).select("id", "n", *[F.round(F.col("rr")[i] * ALPHA, 6).alias(f"r{i}") for i in range(2)])


@query(f"""WITH {R}, {M}, u AS (SELECT c_custkey AS id, {f_sql("user", "c_custkey", 16)} FROM customer)
    SELECT item AS id, count(*) AS n, round({" + ".join(f"sum(f{i} * f{i})" for i in range(16))}, 6) AS trace, round(sum(f0 * f15), 6) AS corner, round(sum(f15 * (value - mean)), 6) AS last
    FROM r JOIN u ON r."user" = u.id, m GROUP BY 1""")
def gram_k16_arrow(spark, d):
    """The way for many factors, reduced to a few numbers for each entity."""
    at = {p: i for i, p in enumerate(equations.triangle(16))}
    trace = sum((F.col("gram")[at[i, i]] for i in range(1, 16)), F.col("gram")[at[0, 0]])
    return equations_of(spark, d, 16).select("id", "n", F.round(trace, 6).alias("trace"), F.round(F.col("gram")[at[0, 15]], 6).alias("corner"), F.round(F.col("rr")[15], 6).alias("last"))


def embedded(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> cast(x AS DOUBLE))").alias("f"))


E = "e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i))"


@query(f"""WITH {E} SELECT a.i, b.i AS j, round(sum(a.x * b.x), 6) AS x FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2
    UNION ALL SELECT -1, i, round(sum(x), 6) FROM e GROUP BY i UNION ALL SELECT -1, -1, count(*)::DOUBLE FROM embeddings""")
def moments_embeddings(spark, d):
    return equations.moments(embedded(spark, d), 64).withColumn("x", F.round("x", 6))


@query(f"""WITH {E} SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0 AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def cov_factors(spark, d):
    return equations.covariance(materialize(equations.moments(embedded(spark, d), 64))).withColumn("cov", F.round("cov", 6) + 0)


@query(f"""WITH {E} SELECT round(sqrt(sum(x * x)), 6) AS norm FROM e""")
def frobenius(spark, d):
    return embedded(spark, d).agg(F.round(F.sqrt(F.sum(squared_norm(F.col("f")))), 6).alias("norm"))


@query(f"""WITH {V} SELECT id, round(f0 * f0, 6) AS o00, round(f0 * f1, 6) AS o01, round(f1 * f1, 6) AS o11 FROM v""")
def outer_product(spark, d):
    o = outer(F.col("f"))
    return items(spark, d).select("id", F.round(o[0], 6).alias("o00"), F.round(o[1], 6).alias("o01"), F.round(o[3], 6).alias("o11"))


# --- predictions


PRED = f"""{S}, {M}, {U}, {V}, p AS (
  SELECT "user", item, value, u.f0 * v.f0 + u.f1 * v.f1 + mean AS pred FROM test JOIN u ON "user" = u.id JOIN v ON item = v.id, m)"""


def predictions(spark, d, bounds=None):
    mean = rt.mean_rating(ratings(spark, d)).first()["mean"]
    return evaluate.predicted(split(spark, d)[1], users(spark, d), items(spark, d), mean, 2, bounds)


@query(f"""WITH {PRED} SELECT "user", item, value, round(pred, 6) AS pred FROM p""")
def predict_dot(spark, d):
    return predictions(spark, d).withColumn("pred", F.round("pred", 6))


@query(f"""WITH {PRED} SELECT "user", item, value, round(greatest(25.5, least(26.0, pred)), 6) AS pred FROM p""")
def predict_clamp(spark, d):
    return predictions(spark, d, (25.5, 26.0)).withColumn("pred", F.round("pred", 6))


@query(f"""WITH {PRED} SELECT round(sqrt(avg((value - pred) ** 2)), 6) AS rmse, count(*) AS n_predict FROM p""")
def rmse(spark, d):
    return evaluate.rmse(predictions(spark, d)).withColumn("rmse", F.round("rmse", 6))


@query(f"""WITH {PRED}, had AS (SELECT count(*) AS n FROM p WHERE item IN (SELECT p_partkey FROM part WHERE p_size > 25))
    SELECT n AS n_predict, (SELECT count(*) FROM test) AS n_cells, round(n * 100.0::DOUBLE / (SELECT count(*) FROM test), 6) AS coverage FROM had""")
def coverage(spark, d):
    """Of test cells, those whose item has a vector: here, parts of a size above 25."""
    some = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    test = split(spark, d)[1]
    return evaluate.coverage(evaluate.predicted(test, users(spark, d), factors(some, "item"), 0.0, 2), test).withColumn("coverage", F.round("coverage", 6))


# --- running moments


def prediction_log(spark, d, iters=10):
    iterations = F.sequence(F.lit(0).cast("long"), F.lit(iters - 1).cast("long"))
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.explode(iterations).alias("iter"))
    return cells.withColumn("pred", 3 + uniform(F.concat_ws("/", "cell", "iter"), "log"))


LOG = f"""l AS (SELECT c_custkey AS cell, iter, 3 + {uniform_sql("c_custkey || '/' || iter", "log")} AS pred FROM customer, (SELECT unnest(generate_series(0, 9)) AS iter))"""
LAST = """s AS (SELECT cell, count(*) FILTER (iter > 3) AS n, avg(pred) FILTER (iter > 3) AS pred_avg, var_pop(pred) FILTER (iter > 3) * count(*) FILTER (iter > 3) AS pred_m2, arg_max(pred, iter) AS pred FROM l GROUP BY cell)"""


@query(f"""WITH {LOG}, w AS (SELECT cell, iter, pred, count(*) FILTER (iter > 3) OVER f AS n, avg(pred) FILTER (iter > 3) OVER f AS a, var_pop(pred) FILTER (iter > 3) OVER f AS v
      FROM l WINDOW f AS (PARTITION BY cell ORDER BY iter ROWS UNBOUNDED PRECEDING))
    SELECT cell, iter, n, round(coalesce(a, pred), 6) AS pred_avg, round(coalesce(v * n, 0), 6) AS pred_m2 FROM w""")
def running_mean_m2(spark, d):
    found = evaluate.running(prediction_log(spark, d), "cell", 3)
    return found.select("cell", "iter", F.col("n").cast("long"), F.round("pred_avg", 6).alias("pred_avg"), F.round("pred_m2", 6).alias("pred_m2"))


@query(f"""WITH {LOG}, {LAST} SELECT cell, n, round(pred_avg + (pred - pred_avg) / n, 6) AS pred_avg,
    round(pred_m2 + (pred - pred_avg) * (pred - (pred_avg + (pred - pred_avg) / n)), 6) AS pred_m2 FROM s""")
def final_pass_mean(spark, d):
    found = evaluate.final_pass(evaluate.running_last(prediction_log(spark, d), "cell", 3))
    return found.select("cell", "n", F.round("pred_avg", 6).alias("pred_avg"), F.round("pred_m2", 6).alias("pred_m2"))


@query(f"""WITH {LOG} SELECT cell, round(avg(pred), 6) AS pred_avg, count(*) AS n FROM l WHERE iter >= 4 GROUP BY cell""")
def running_mean_reset(spark, d):
    return evaluate.mean_from(prediction_log(spark, d), "cell", 4).withColumn("pred_avg", F.round("pred_avg", 6))


@query(f"""WITH {LOG} SELECT cell, round(avg(pred), 6) AS pred_avg, count(*) AS n FROM l GROUP BY cell""")
def running_mean_all(spark, d):
    return evaluate.mean_from(prediction_log(spark, d), "cell", 0).withColumn("pred_avg", F.round("pred_avg", 6))


@query(f"""WITH {LOG} SELECT iter, round(sqrt(avg((3.5 - pred) ** 2)), 6) AS rmse FROM l GROUP BY iter""")
def error_trace(spark, d):
    return evaluate.error_trace(prediction_log(spark, d), F.lit(3.5)).withColumn("rmse", F.round("rmse", 6))


@query(f"""WITH {LOG}, {LAST} SELECT cell, n, round(pred_avg, 6) AS pred_avg, round(pred_m2, 6) AS pred_m2 FROM s""")
def streaming_running_mean(spark, d):
    """The log as a stream of files; the last state of each cell."""
    stored = materialize(prediction_log(spark, d).repartition(1).sortWithinPartitions("iter"))
    stream = spark.readStream.schema(stored.schema).parquet(stored.scratch_path)
    at = f"{scratch_dir(spark)}/stream-{stored.scratch_path.rpartition('/')[2]}"
    writer = running_moments(stream, 3).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, i: batch.write.mode("append").parquet(f"{at}/rows")).start().awaitTermination()
    last = spark.read.parquet(f"{at}/rows").groupBy("cell").agg(F.max_by(F.struct("n", "pred_avg", "pred_m2"), "iter").alias("s"))
    return last.select("cell", "s.n", F.round("s.pred_avg", 6).alias("pred_avg"), F.round("s.pred_m2", 6).alias("pred_m2"))


@query("""SELECT date_trunc('hour', ts) AS start, round(sqrt(avg((value - 0.5) ** 2)), 6) AS rmse, count(*) AS n FROM events GROUP BY 1""")
def streaming_windowed_error(spark, d):
    """The events' values against a constant prediction, by hour, as a stream that is read to its end."""
    source = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", F.lit(0.5).alias("pred"))
    stored = materialize(source)
    stream = spark.readStream.schema(stored.schema).parquet(stored.scratch_path)
    at = f"{scratch_dir(spark)}/stream-{stored.scratch_path.rpartition('/')[2]}"
    writer = windowed_error(stream).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{at}/rows")).start().awaitTermination()
    last = spark.read.parquet(f"{at}/rows").groupBy("window").agg(F.max_by(F.struct("rmse", "n"), "batch").alias("s"))
    return last.select(F.col("window.start").alias("start"), F.round("s.rmse", 6).alias("rmse"), "s.n")


# --- linear algebra and draws, K = 2


HYPER = f"""{V}, c AS (SELECT count(*)::DOUBLE AS n, avg(f0) AS m0, avg(f1) AS m1, covar_samp(f0, f0) AS s00, covar_samp(f0, f1) AS s01, covar_samp(f1, f1) AS s11 FROM v),
  t AS (SELECT *, 2 + n AS kappa, 2 + n AS df, n * m0 / (2 + n) AS mu0, n * m1 / (2 + n) AS mu1, 1 + n * s00 + 2 * n / (2 + n) * m0 * m0 AS a, n * s01 + 2 * n / (2 + n) * m0 * m1 AS b, 1 + n * s11 + 2 * n / (2 + n) * m1 * m1 AS e FROM c)"""


def hyper(spark, d) -> sampling.NormalWishart:
    mean, cov, _ = model.side_moments(items(spark, d), table(spark, d, "part").count(), 2)
    return sampling.NormalWishart.prior(2).given(table(spark, d, "part").count(), mean, cov)


@query(f"""WITH {HYPER} SELECT kappa, df, round(mu0, 6) AS mu0, round(mu1, 6) AS mu1, round(e / (a * e - b * b), 9) AS w00, round(-b / (a * e - b * b), 9) AS w01, round(a / (a * e - b * b), 9) AS w11 FROM t""")
def hyper_posterior_k2(spark, d):
    h = hyper(spark, d)
    row = (float(h.kappa), float(h.df), float(h.mean[0]), float(h.mean[1]), float(h.scale[0, 0]), float(h.scale[0, 1]), float(h.scale[1, 1]))
    found = spark.createDataFrame([row], "kappa double, df double, mu0 double, mu1 double, w00 double, w01 double, w11 double")
    return found.select("kappa", "df", *[F.round(c, 6).alias(c) for c in ("mu0", "mu1")], *[F.round(c, 9).alias(c) for c in ("w00", "w01", "w11")])


CHOL = f"""{GRAM}, l AS (SELECT *, sqrt(1 + {ALPHA} * g00) AS l00, {ALPHA} * g01 / sqrt(1 + {ALPHA} * g00) AS l10 FROM g),
  ch AS (SELECT *, sqrt(1 + {ALPHA} * g11 - l10 * l10) AS l11 FROM l)"""


@query(f"""WITH {CHOL} SELECT id, round(l00, 6) AS l00, round(l10, 6) AS l10, round(l11, 6) AS l11 FROM ch""")
def cholesky_k2(spark, d):
    found = model.factored(equations_of(spark, d), np.eye(2), 2, ALPHA)
    return found.select("id", *[F.round(F.col("lower")[i], 6).alias(c) for i, c in enumerate(("l00", "l10", "l11"))])


def swept(spark, d, mu: tuple, lam: tuple, diagonal: bool = False, prior: DataFrame | None = None) -> DataFrame:
    """All items' vectors, drawn by the model's own half-sweep; lam is (00, 01, 11)."""
    r = ratings(spark, d)
    n, n_other = table(spark, d, "part").count(), table(spark, d, "customer").count()
    hyper = np.array(mu), np.array([[lam[0], lam[1]], [lam[1], lam[2]]])
    p = model.Params(k=2, alpha=ALPHA, diagonal=diagonal, draws=sampling.PortableDraws())
    found = model.half_sweep(r, "item", users(spark, d), n, n_other, rt.mean_rating(r).first()["mean"], hyper, p, ("z",), prior)
    return found.select("id", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(2)])


def sweep_sql(source: str, mu: tuple, lam: tuple, diagonal: bool = False) -> str:
    z0, z1 = normal_sql("id", "z", 0), normal_sql("id", "z", 1)
    head = f"""b AS (SELECT *, {z0} AS z0, {z1} AS z1, {lam[0]} * {mu[0]} + {lam[1]} * {mu[1]} + {ALPHA} * r0 AS b0, {lam[1]} * {mu[0]} + {lam[2]} * {mu[1]} + {ALPHA} * r1 AS b1,
      {lam[0]} + {ALPHA} * g00 AS a, {lam[1]} + {ALPHA} * g01 AS b, {lam[2]} + {ALPHA} * g11 AS c FROM {source})"""
    if diagonal:
        return f"{head} SELECT id, round(b0 / a + z0 / sqrt(a), 6) AS f0, round(b1 / c + z1 / sqrt(c), 6) AS f1 FROM b"
    return f"""{head}, k AS (SELECT *, sqrt(a) AS l00, b / sqrt(a) AS l10, sqrt(c - b * b / a) AS l11 FROM b),
      y AS (SELECT *, ((b1 - l10 * (b0 / l00)) / l11 + z1) / l11 AS f1 FROM k)
      SELECT id, round((b0 / l00 + z0 - l10 * f1) / l00, 6) AS f0, round(f1, 6) AS f1 FROM y"""


EVERY = """ev AS (SELECT p_partkey AS id, coalesce(g00, 0) AS g00, coalesce(g01, 0) AS g01, coalesce(g11, 0) AS g11, coalesce(r0, 0) AS r0, coalesce(r1, 0) AS r1 FROM part LEFT JOIN g ON p_partkey = g.id)"""


@query(f"""WITH {GRAM}, {EVERY}, {sweep_sql("ev", (0.0, 0.0), (1.0, 0.0, 1.0))}""")
def half_sweep_k2(spark, d):
    return swept(spark, d, (0.0, 0.0), (1.0, 0.0, 1.0))


@query(f"""WITH {GRAM}, {EVERY}, {sweep_sql("ev", (0.3, -0.2), (1.5, 0.25, 0.75))}""")
def half_sweep_hyper_k2(spark, d):
    return swept(spark, d, (0.3, -0.2), (1.5, 0.25, 0.75))


@query(f"""WITH {GRAM}, {EVERY}, {sweep_sql("ev", (0.3, -0.2), (1.5, 0.25, 0.75), True)}""")
def half_sweep_diag_k2(spark, d):
    return swept(spark, d, (0.3, -0.2), (1.5, 0.25, 0.75), True)


@query(f"""WITH {GRAM}, {EVERY}, {V}, pr AS (SELECT ev.*, f0 AS m0, f1 AS m1, 1 + f0 * f0 AS p00, f0 * f1 AS p01, 1 + f1 * f1 AS p11 FROM ev JOIN v ON ev.id = v.id), {sweep_sql("pr", ("m0", "m1"), ("p00", "p01", "p11"))}""")
def half_sweep_prior_k2(spark, d):
    """Each entity has a prior of its own: here, mean f and precision I + f f'."""
    f = F.col("f")
    own = items(spark, d).select("id", f.alias("mu"), F.array(1 + f[0] * f[0], f[0] * f[1], f[0] * f[1], 1 + f[1] * f[1]).alias("lambda"))
    return swept(spark, d, (0.0, 0.0), (1.0, 0.0, 1.0), prior=own)


SAMPLES = f"""sa AS (SELECT p_partkey AS id, s, {normal_sql("p_partkey || '/' || s", "sample", 0)} AS f0, {normal_sql("p_partkey || '/' || s", "sample", 1)} AS f1 FROM part, (SELECT unnest(generate_series(0, 7)) AS s)),
  ac AS (SELECT id, count(*) AS n, sum(f0) AS s0, sum(f1) AS s1, sum(f0 * f0) AS p00, sum(f0 * f1) AS p01, sum(f1 * f1) AS p11 FROM sa GROUP BY id)"""


def samples(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return [part.select("id", F.array(*[normal(F.concat_ws("/", "id", F.lit(s)), "sample", j) for j in range(2)]).alias("f")) for s in range(8)]


@query(f"""WITH {SAMPLES} SELECT id, n, round(s0, 6) AS s0, round(s1, 6) AS s1, round(p00, 6) AS p00, round(p01, 6) AS p01, round(p11, 6) AS p11 FROM ac""")
def posterior_accumulate(spark, d):
    acc = model.accumulated(samples(spark, d), 2)
    return acc.select("id", "n", *[F.round(F.col("sum")[i], 6).alias(f"s{i}") for i in range(2)], *[F.round(F.col("prod")[i], 6).alias(c) for i, c in enumerate(("p00", "p01", "p11"))])


@query(f"""WITH {SAMPLES}, co AS (SELECT id, s0 / n AS m0, s1 / n AS m1, (p00 - s0 * s0 / n) / (n - 1) AS a, (p01 - s0 * s1 / n) / (n - 1) AS b, (p11 - s1 * s1 / n) / (n - 1) AS c FROM ac)
    SELECT id, round(m0, 6) AS mu0, round(m1, 6) AS mu1, round(c / (a * c - b * b), 4) AS l00, round(-b / (a * c - b * b), 4) AS l01, round(a / (a * c - b * b), 4) AS l11 FROM co""")
def posterior_finalize_k2(spark, d):
    f = model.finalized(model.accumulated(samples(spark, d), 2), 2)
    return f.select("id", *[F.round(F.col("mu")[i], 6).alias(f"mu{i}") for i in range(2)], *[F.round(F.col("lambda")[i], 4).alias(c) for i, c in ((0, "l00"), (1, "l01"), (3, "l11"))])


# --- parts


@query(f"""SELECT p_partkey AS id, least(p_partkey // greatest((SELECT count(*) FROM part) // {PARTS}, 1), {PARTS - 1})::INTEGER AS part FROM part""")
def partition_block(spark, d):
    ids = table(spark, d, "part")
    return ids.select(F.col("p_partkey").alias("id"), partition.block(F.col("p_partkey"), ids.count(), PARTS).alias("part"))


def by_block(spark, d, of: str, key: str):
    ids = table(spark, d, of)
    return ids.select(F.col(key).alias("id"), partition.block(F.col(key), ids.count(), PARTS).alias("part"))


OWN = f"""ip AS (SELECT p_partkey AS id, least(p_partkey // greatest((SELECT count(*) FROM part) // {PARTS}, 1), {PARTS - 1}) AS part FROM part),
  up AS (SELECT c_custkey AS id, least(c_custkey // greatest((SELECT count(*) FROM customer) // {PARTS}, 1), {PARTS - 1}) AS part FROM customer),
  co AS (SELECT DISTINCT r.item, ip.part::INTEGER AS part, up.part::INTEGER AS dst FROM r JOIN up ON r."user" = up.id JOIN ip ON r.item = ip.id)"""


@query(f"""WITH {R}, {OWN} SELECT item, part, list_sort(list(dst)) AS needed_by FROM co WHERE part <> dst GROUP BY 1, 2""")
def connectivity(spark, d):
    return partition.connectivity(rt.pattern_union(*split(spark, d)), by_block(spark, d, "part", "p_partkey"), by_block(spark, d, "customer", "c_custkey"))


@query(f"""WITH {R}, {OWN} SELECT part AS src, dst, count(*) AS n FROM co WHERE part <> dst GROUP BY 1, 2""")
def message_matrix(spark, d):
    return partition.messages(connectivity(spark, d))


@query(f"""WITH {R}, {OWN}, cn AS (SELECT item, part, list_sort(list(dst)) AS needed_by, sum(2 ** dst) AS bits FROM co WHERE part <> dst GROUP BY 1, 2)
    SELECT item, part, needed_by, (row_number() OVER (PARTITION BY part ORDER BY bits, item))::INTEGER AS place FROM cn""")
def connectivity_sorted(spark, d):
    return partition.by_connectivity(connectivity(spark, d), PARTS)


@query(f"""WITH {R}, {OWN} SELECT item, part FROM co WHERE part = 1 AND dst = 2 GROUP BY ALL""")
def connectivity_sent(spark, d):
    return partition.sent(connectivity(spark, d), 1, 2).select("item", "part")


@query(f"""WITH {R}, {OWN}, n AS (SELECT r.item, up.part, count(*) AS c FROM r JOIN up ON r."user" = up.id GROUP BY 1, 2), t AS (SELECT item, sum(c) AS t FROM n GROUP BY 1)
    SELECT t.item, p::INTEGER AS part, (t - coalesce(c, 0))::BIGINT AS cost FROM t CROSS JOIN (SELECT unnest(generate_series(0, {PARTS - 1})) AS p) LEFT JOIN n ON n.item = t.item AND n.part = p""")
def comm_cost(spark, d):
    found = partition.comm_cost(ratings(spark, d).select("user", "item"), by_block(spark, d, "part", "p_partkey"), by_block(spark, d, "customer", "c_custkey"), PARTS)
    return found.withColumn("cost", F.col("cost").cast("long"))


LOADS = ", ".join(f"min({c})::DOUBLE AS min_{c}, max({c})::DOUBLE AS max_{c}, round(avg({c}), 6) AS avg_{c}, round((max({c}) - min({c})) * 100.0::DOUBLE / avg({c}), 6) AS unbalance_{c}" for c in ("nnz", "entities", "work"))


@query(f"""WITH {R}, {OWN}, n AS (SELECT item AS id, count(*) AS nnz FROM r GROUP BY 1), l AS (SELECT part, sum(nnz)::DOUBLE AS nnz, count(*)::DOUBLE AS entities, sum(nnz + 10)::DOUBLE AS work FROM n JOIN ip USING (id) GROUP BY part) SELECT {LOADS} FROM l""")
def load_balance_stats(spark, d):
    own = rt.nnz(ratings(spark, d), "item").join(by_block(spark, d, "part", "p_partkey"), "id")
    found = partition.load(own)
    return found.select([F.round(F.col(c).cast("double"), 6).alias(c) for c in found.columns])


@query(f"""WITH {R}, {OWN}, c AS (SELECT part, count(*) AS n FROM ip GROUP BY part) SELECT part::INTEGER AS part, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY part))::BIGINT AS hi FROM c""")
def domain_ranges(spark, d):
    return partition.prefix_sums(by_block(spark, d, "part", "p_partkey"))


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey < 100 THEN 0 WHEN c_custkey < 1000 THEN 1 ELSE 2 END AS part FROM customer""")
def position_to_node(spark, d):
    ranges = spark.createDataFrame([(0, -1, 100), (1, 100, 1000), (2, 1000, 1 << 60)], "part int, lo long, hi long")
    return partition.range_of(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), ranges)


@query(f"""WITH {R}, x AS (SELECT item, "user" - row_number() OVER (PARTITION BY item ORDER BY "user") AS g, "user" FROM r)
    SELECT item, min("user") AS first, max("user") AS last FROM x GROUP BY item, g""")
def adjacent_ids(spark, d):
    return partition.islands(ratings(spark, d).select("item", F.col("user").alias("id")), "item")


def greedy_sql(counts: str, costs: str, by_work: float = partition.BY_WORK, by_messages: float = 0.0) -> str:
    """The loop over entities as a recursion over (pass, entity), with loads and parts as lists; `costs` gives each id a list by part."""
    spread = f"list_transform(generate_series(1, {PARTS}), lambda p: "
    return f"""it AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.id) AS pos, c.id, c.nnz::DOUBLE AS nnz, coalesce(k.c, {spread}0.0::DOUBLE)) AS c FROM {counts} c LEFT JOIN {costs} k ON c.id = k.id),
  sz AS (SELECT count(*) AS n FROM it),
  go AS (SELECT 0::BIGINT AS step, {spread}0.0::DOUBLE) AS loads, 0.01::DOUBLE AS total, (SELECT list(0) FROM it) AS parts
    UNION ALL
    SELECT step + 1, list_transform(less, lambda x, p: CASE WHEN p = best THEN x + ({partition.ENTITY} + nnz) ELSE x END), rest + ({partition.ENTITY} + nnz), parts[:pos - 1] || [best] || parts[pos + 1:]
    FROM (SELECT *, ({PARTS} + 1 - list_position(list_reverse(cost), list_min(cost)))::INTEGER AS best
      FROM (SELECT *, {spread}{by_work} * (less[p] / rest) + {by_messages} * c[p]) AS cost
        FROM (SELECT step, parts, pos, nnz, c, CASE WHEN parts[pos] > 0 THEN total - ({partition.MOVED} + nnz) ELSE total END AS rest,
            list_transform(loads, lambda x, p: CASE WHEN p = parts[pos] THEN x - ({partition.MOVED} + nnz) ELSE x END) AS less
          FROM go, sz, it WHERE step < {partition.PASSES} * sz.n AND it.pos = step % sz.n + 1))))
  SELECT it.id, it.nnz::BIGINT AS nnz, (parts[pos] - 1)::INTEGER AS part FROM it, (SELECT parts FROM go ORDER BY step DESC LIMIT 1)"""


NNZ = "n AS (SELECT s_suppkey AS id, count(l_suppkey) AS nnz FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1)"


def suppliers(spark, d):
    """Suppliers with the number of their line items."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("nnz"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).join(n, "id", "left").fillna(0, ["nnz"])


@query(f"""WITH RECURSIVE {NNZ}, no AS (SELECT 0 AS id, NULL::DOUBLE[] AS c WHERE false), {greedy_sql("n", "no")}""")
def partition_balanced(spark, d):
    return partition.assigned(suppliers(spark, d), PARTS)


@query(f"""WITH RECURSIVE {NNZ}, pp AS (SELECT p_partkey AS id, least(p_partkey // greatest((SELECT count(*) FROM part) // {PARTS}, 1), {PARTS - 1}) AS part FROM part),
  cc AS (SELECT l_suppkey AS id, {", ".join(f"(count(*) - count(*) FILTER (part = {p}))::DOUBLE AS c{p}" for p in range(PARTS))} FROM lineitem JOIN pp ON l_partkey = pp.id GROUP BY 1),
  cl AS (SELECT id, [{", ".join(f"c{p}" for p in range(PARTS))}] AS c FROM cc), {greedy_sql("n", "cl", by_messages=2.0)}""")
def partition_by_messages(spark, d):
    """Suppliers to parts by work and by messages to the parts of their line items' products, which are dealt out in blocks."""
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("user"))
    costs = partition.comm_cost(cells, suppliers(spark, d), by_block(spark, d, "part", "p_partkey"), PARTS)
    return partition.assigned(suppliers(spark, d), PARTS, costs, by_messages=2.0)


@query(f"""WITH {R}, {OWN} SELECT id, part::INTEGER AS part, row_number() OVER (ORDER BY part, id) - 1 AS position FROM ip""")
def partition_positions(spark, d):
    return partition.positions(by_block(spark, d, "part", "p_partkey"))


# --- files


def roundtrip(ext: str, **options):
    def run(spark, d):
        cells = ratings(spark, d).select(F.col("user").alias("row"), F.col("item").alias("col"), "value")
        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/ratings.{ext}"
        matrix.write_matrix(cells, path, **options)
        return matrix.read_matrix(spark, path)

    return run


for ext, name in (("mtx", "mtx"), ("mtx.gz", "mtx_gz"), ("sdm", "sdm"), ("sdm.gz", "sdm_gz")):
    QUERIES[f"matrix_roundtrip_{name}"] = roundtrip(ext)
    ORACLE_SQL[f"matrix_roundtrip_{name}"] = f"""WITH {R} SELECT "user" AS "row", item AS col, value FROM r"""
QUERIES["matrix_roundtrip_sbm"] = roundtrip("sbm")
ORACLE_SQL["matrix_roundtrip_sbm"] = f"""WITH {R} SELECT "user" AS "row", item AS col, 1.0::DOUBLE AS value FROM r WHERE value > 0"""


@query(f"""WITH {R} SELECT "user", item, value FROM r""")
def tsv_roundtrip(spark, d):
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    delimited.write_triplets(ratings(spark, d), path)
    return delimited.read_triplets(spark, path)


def dense_roundtrip(ext: str, **options):
    def run(spark, d):
        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/embeddings.{ext}"
        cells = matrix.as_cells(embedded(spark, d))
        matrix.write_matrix(cells.withColumn("value", F.round("value", 3) + 0), path, **options)
        return matrix.read_matrix(spark, path)

    return run


for ext, name, options in (("ddm", "ddm", {}), ("csv", "csv", {}), ("csv.gz", "csv_gz", {}), ("mtx", "mtx_array", {"layout": "array"})):
    QUERIES[f"matrix_roundtrip_{name}"] = dense_roundtrip(ext, **options)
    ORACLE_SQL[f"matrix_roundtrip_{name}"] = f"""WITH {E} SELECT i AS "row", vec_id AS col, round(x, 3) + 0 AS value FROM e"""


# --- the whole model


def wishart_sql(df: str, scale: tuple[str, str, str], key: tuple, first: int = 0) -> dict[str, str]:
    """The entries of an upper factor of a Wishart draw of two dimensions, as SQL: the portable draws number `first` + 1, + 4 and + 5."""
    z = lambda i: normal_sql(str(first + i), "g", *key)
    chi = lambda at, df: f"(({df}) * pow(1 - 2 / (9 * ({df})) + {z(at)} * sqrt(2 / (9 * ({df}))), 3))"
    a, b, c = scale
    l00, l10 = f"sqrt({a})", f"(({b}) / sqrt({a}))"
    l11 = f"sqrt(({c}) - ({b}) * ({b}) / ({a}))"
    return {"u00": f"sqrt({chi(4, df)}) * {l00}", "u01": f"sqrt({chi(4, df)}) * {l10} + {z(1)} * {l11}", "u11": f"sqrt({chi(5, f'({df}) - 1')}) * {l11}"}


def fit_sql(samples: int, name: str = "", seed: int = 0, prior: str = "", sweeps: int = 1, init: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """A fit of two factors as common table expressions on train, step by step, and the last vectors' tables by side. prior names a table (id, m0, m1, p00, p01, p11) of the items', init tables (id, f0, f1) to start from."""
    out = []
    now = {}
    for side, of, key in (("item", "part", "p_partkey"), ("user", "customer", "c_custkey")):
        now[side] = f"{name}{side}0"
        out.append(f"{name}n{side} AS (SELECT max({'item' if side == 'item' else chr(34) + 'user' + chr(34)}) + 1 AS n FROM r), {now[side]} AS ({f"SELECT * FROM {init[side]}" if init else f"SELECT unnest(generate_series(0, n - 1)) AS id, 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1 FROM {name}n{side}"})")
    out.append(f"{name}m AS (SELECT avg(value) AS mean FROM train)")
    drawn: dict[str, str] = {}
    for i, t, at in ((i, t, at) for i in range(samples) for t in range(sweeps) for at in range(2)):
        side = ("item", "user")[at]
        here, mine, other = f"{name}{side}{i + 1}{'x' * (sweeps - 1 - t)}", now[side], now["user" if side == "item" else "item"]
        z = lambda j: normal_sql(str(j), "g", seed, at, i)  # noqa: B023, E731
        u = wishart_sql("df", ("w00", "w01", "w11"), (seed, at, i))
        ident, also = ("item", '"user"') if side == "item" else ('"user"', "item")
        head = f"""{here}c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(f0) AS a0, avg(f1) AS a1, covar_samp(f0, f0) AS s00, covar_samp(f0, f1) AS s01, covar_samp(f1, f1) AS s11 FROM {mine}),
  {here}t AS (SELECT 2 + n AS kappa, 2 + n AS df, n * a0 / (2 + n) AS c0, n * a1 / (2 + n) AS c1, 1 + n * s00 + 2 * n / (2 + n) * a0 * a0 AS a, n * s01 + 2 * n / (2 + n) * a0 * a1 AS b, 1 + n * s11 + 2 * n / (2 + n) * a1 * a1 AS e FROM {here}c),
  {here}w AS (SELECT *, e / (a * e - b * b) AS w00, -b / (a * e - b * b) AS w01, a / (a * e - b * b) AS w11 FROM {here}t),
  {here}u AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in u.items())} FROM {here}w),
  {here}h AS MATERIALIZED (SELECT c0 + ({z(6)} - u01 * ({z(7)} / u11)) / u00 / sqrt(kappa) AS mu0, c1 + {z(7)} / u11 / sqrt(kappa) AS mu1, u00 * u00 AS q00, u00 * u01 AS q01, u01 * u01 + u11 * u11 AS q11 FROM {here}u)"""
        if t == 0:
            drawn[side] = f"{here}h"
            out.append(head)
        out.append(f"""{here}g AS (SELECT {ident} AS id, sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11, sum(f0 * (value - mean)) AS r0, sum(f1 * (value - mean)) AS r1 FROM train JOIN {other} o ON {also} = o.id, {name}m GROUP BY 1)""")
        own = prior if side == "item" else ""
        q = {k: f"coalesce(pr.{p}, h.{k})" if own else f"h.{k}" for k, p in (("mu0", "m0"), ("mu1", "m1"), ("q00", "p00"), ("q01", "p01"), ("q11", "p11"))}
        out.append(f"""{here}b AS (SELECT x.id, {", ".join(f"{v} AS {k}" for k, v in q.items())}, coalesce(g00, 0) AS g00, coalesce(g01, 0) AS g01, coalesce(g11, 0) AS g11, coalesce(r0, 0) AS r0, coalesce(r1, 0) AS r1,
    {normal_sql("x.id", seed, at, i * sweeps + t, 0)} AS z0, {normal_sql("x.id", seed, at, i * sweeps + t, 1)} AS z1 FROM {mine} x LEFT JOIN {here}g g ON x.id = g.id {f"LEFT JOIN {own} pr ON x.id = pr.id" if own else ""}, {drawn[side]} h),
  {here}k AS (SELECT *, q00 * mu0 + q01 * mu1 + {ALPHA} * r0 AS b0, q01 * mu0 + q11 * mu1 + {ALPHA} * r1 AS b1, sqrt(q00 + {ALPHA} * g00) AS l00, (q01 + {ALPHA} * g01) / sqrt(q00 + {ALPHA} * g00) AS l10, q11 + {ALPHA} * g11 AS d FROM {here}b),
  {here}l AS (SELECT *, sqrt(d - l10 * l10) AS l11 FROM {here}k),
  {here}y AS (SELECT *, ((b1 - l10 * (b0 / l00)) / l11 + z1) / l11 AS f1 FROM {here}l),
  {here} AS MATERIALIZED (SELECT id, (b0 / l00 + z0 - l10 * f1) / l00 AS f0, f1 FROM {here}y)""")
        now[side] = here
    return ", ".join(out), now


def state_sql(samples: int, burnin: int, name: str = "") -> str:
    """The state of the test cells after a fit as in `fit_sql`: all iterations' predictions, folded."""
    preds = " UNION ALL ".join(f"""SELECT "user", item, value, {i} AS iter, u.f0 * v.f0 + u.f1 * v.f1 + mean AS pred FROM test JOIN {name}user{i + 1} u ON "user" = u.id JOIN {name}item{i + 1} v ON item = v.id, {name}m""" for i in range(samples))
    return f"""lg AS ({preds}),
  st AS (SELECT "user", item, any_value(value) AS value, greatest({samples - 1 - burnin}, 0) AS n, coalesce(avg(pred) FILTER (iter > {burnin}), arg_max(pred, iter)) AS a, coalesce(var_pop(pred) FILTER (iter > {burnin}) * {max(samples - 1 - burnin, 0)}, 0) AS m, arg_max(pred, iter) AS pred FROM lg GROUP BY ALL),
  fp AS (SELECT *, CASE WHEN n > 0 THEN a + (pred - a) / n ELSE pred END AS b FROM st)
  SELECT "user", item, value, n::BIGINT AS n, round(b, 4) + 0 AS pred_avg, round(CASE WHEN n > 0 THEN m + (pred - a) * (pred - b) ELSE 0 END, 4) + 0 AS pred_m2, round(pred, 4) + 0 AS pred FROM fp"""


def rounded(state: DataFrame) -> DataFrame:
    return state.select("user", "item", "value", "n", *[(F.round(c, 4) + 0).alias(c) for c in ("pred_avg", "pred_m2", "pred")])


@query(f"""SELECT c_custkey AS id, round({wishart_sql("c_custkey + 7.0", ("1.0", "0.3", "0.5"), (1, 2, 3))["u00"]}, 6) AS u00, round({wishart_sql("c_custkey + 7.0", ("1.0", "0.3", "0.5"), (1, 2, 3))["u01"]}, 6) AS u01,
    round({wishart_sql("c_custkey + 7.0", ("1.0", "0.3", "0.5"), (1, 2, 3))["u11"]}, 6) AS u11 FROM customer""")
def wishart_draw(spark, d):
    """Upper factors of Wishart draws, with as many more degrees of freedom as each customer's key says."""
    scale, draws = np.array([[1.0, 0.3], [0.3, 0.5]]), sampling.PortableDraws()

    def drawn(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            u = np.array([sampling.wishart_upper(draws.generator(1, 2, 3), scale, i + 7.0)[[0, 0, 1], [0, 1, 1]] for i in ids]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in u.T]], ["id", "u00", "u01", "u11"])

    found = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")).mapInArrow(drawn, "id long, u00 double, u01 double, u11 double")
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("u00", "u01", "u11")])


def fitted(spark, d, k=8, samples=4, burnin=1, n: dict | None = None, **more) -> model.Fitted:
    train, test = split(spark, d)
    return model.fit(train, test, model.Params(k=k, samples=samples, burnin=burnin, alpha=ALPHA, **more))


@query(f"""WITH {S}, {fit_sql(3)[0]}, {state_sql(3, 0)}""")
def gibbs_full(spark, d):
    """Test cells with running mean and squared deviations after three iterations of a fit of two factors, and the final pass."""
    return rounded(fitted(spark, d, k=2, samples=3, burnin=0, draws=sampling.PortableDraws()).state)


@query(f"""WITH {S}, {fit_sql(2)[0]}, lg AS (SELECT 0 AS iter, value, u.f0 * v.f0 + u.f1 * v.f1 + mean AS pred FROM test JOIN user1 u ON "user" = u.id JOIN item1 v ON item = v.id, m
    UNION ALL SELECT 1, value, u.f0 * v.f0 + u.f1 * v.f1 + mean FROM test JOIN user2 u ON "user" = u.id JOIN item2 v ON item = v.id, m),
  nr AS (SELECT 0 AS iter, 0.0::DOUBLE AS norm_user, 0.0::DOUBLE AS norm_item UNION ALL SELECT 1, (SELECT sqrt(sum(f0 * f0 + f1 * f1)) FROM user1), (SELECT sqrt(sum(f0 * f0 + f1 * f1)) FROM item1))
  SELECT iter, iter < 1 AS burnin, round(sqrt(avg((value - pred) ** 2)), 4) AS rmse, count(*) AS n_predict, round(any_value(norm_user), 4) AS norm_user, round(any_value(norm_item), 4) AS norm_item FROM lg JOIN nr USING (iter) GROUP BY iter""")
def gibbs_metrics(spark, d):
    """What each iteration reports, but for its speed; norms are of the vectors that the hyper-parameters were drawn from."""
    found = fitted(spark, d, k=2, samples=2, burnin=1, draws=sampling.PortableDraws()).metrics_frame(spark)
    return found.select(F.col("iter").cast("int"), "burnin", F.round("rmse", 4).alias("rmse"), "n_predict", F.round("norm_user", 4).alias("norm_user"), F.round("norm_item", 4).alias("norm_item"))


TRANSFER = ", ".join([f"{fit_sql(4, 'a_')[0]}",
    "sa AS (" + " UNION ALL ".join(f"SELECT * FROM a_item{i + 1}" for i in range(4)) + ")",
    "co AS (SELECT id, avg(f0) AS m0, avg(f1) AS m1, covar_samp(f0, f0) AS a, covar_samp(f0, f1) AS b, covar_samp(f1, f1) AS c FROM sa GROUP BY id)",
    "pr AS MATERIALIZED (SELECT id, m0, m1, c / (a * c - b * b) AS p00, -b / (a * c - b * b) AS p01, a / (a * c - b * b) AS p11 FROM co)",
    fit_sql(1, "b_", 7, "pr")[0]])


@query(f"""WITH {S}, {TRANSFER}, {state_sql(1, 0, "b_")}""")
def gibbs_transfer(spark, d):
    """A fit whose items' posteriors are another fit's priors."""
    first = fitted(spark, d, k=2, samples=4, burnin=0, posterior=True, draws=sampling.PortableDraws())
    train, test = split(spark, d)
    p = model.Params(k=2, samples=1, burnin=0, alpha=ALPHA, seed=7, draws=sampling.PortableDraws())
    return rounded(model.fit(train, test, p, item_prior=materialize(first.posterior("item"))).state)


# --- what a fit leaves behind, and its parts one by one


def exported(spark, d, file: str, of=lambda x: x, **more) -> DataFrame:
    """The cells of one file of an exported model."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    model.export(fitted(spark, d, k=2, draws=sampling.PortableDraws(), **more), path)
    return matrix.read_matrix(spark, f"{path}/{file}").withColumn("value", F.round(of(F.col("value")), 4) + 0)


@query(f"""WITH {S}, {fit_sql(3)[0]} SELECT "user" AS "row", item AS col, pred_avg AS value FROM (WITH {state_sql(3, 0)})""")
def export_predictions(spark, d):
    """Pavg.sdm: the test cells' mean predictions."""
    return exported(spark, d, "Pavg.sdm", samples=3, burnin=0)


@query(f"""WITH {S}, {fit_sql(3)[0]} SELECT "user" AS "row", item AS col, pred_m2 AS value FROM (WITH {state_sql(3, 0)})""")
def export_deviations(spark, d):
    """Pm2.sdm: their sums of squared deviations."""
    return exported(spark, d, "Pm2.sdm", samples=3, burnin=0)


def cells_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT {i}::BIGINT AS "row", id::BIGINT AS col, round({c}, 4) + 0 AS value FROM {table}""" for i, c in enumerate(columns))


@query(f"""WITH {S}, {fit_sql(2)[0]} {cells_sql("user1", ["f0", "f1"])}""")
def export_sample(spark, d):
    """U-0.ddm: the users' vectors of the first iteration."""
    return exported(spark, d, "U-0.ddm", samples=2, burnin=0, keep_samples=True)


@query(f"""WITH {S}, {TRANSFER} {cells_sql("pr", ["m0", "m1"])}""")
def export_means(spark, d):
    """V-mu.ddm: the means of the items' samples."""
    return exported(spark, d, "V-mu.ddm", samples=4, burnin=0, posterior=True)


@query(f"""WITH {S}, {TRANSFER} {cells_sql("pr", [f"ln(1 + abs({c}))" for c in ("p00", "p01", "p01", "p11")])}""")
def export_precisions(spark, d):
    """V-Lambda.ddm: the precisions of the items' samples, by their logarithms: few samples give large ones."""
    return exported(spark, d, "V-Lambda.ddm", lambda x: F.log(1 + F.abs(x)), samples=4, burnin=0, posterior=True)


@query(f"""WITH {S}, {U}, {V}, {fit_sql(1, init={"item": "v", "user": "u"})[0]}, {state_sql(1, 0)}""")
def warm_start(spark, d):
    """An iteration from given vectors."""
    train, test = split(spark, d)
    p = model.Params(k=2, samples=1, burnin=0, alpha=ALPHA, draws=sampling.PortableDraws())
    return rounded(model.fit(train, test, p, table(spark, d, "customer").count(), table(spark, d, "part").count(), init={"user": users(spark, d), "item": items(spark, d)}).state)


@query(f"""WITH {S}, {fit_sql(2, sweeps=2)[0]}, {state_sql(2, 0)}""")
def gibbs_two_sweeps(spark, d):
    """Two sweeps for each draw of the hyper-parameters."""
    return rounded(fitted(spark, d, k=2, samples=2, burnin=0, sweeps=2, draws=sampling.PortableDraws()).state)


@query(f"""WITH {S}, {V}, {U}, {fit_sql(1, init={"item": "v", "user": "u"})[0]} SELECT round(mu0, 6) AS mu0, round(mu1, 6) AS mu1, round(q00, 6) AS q00, round(q01, 6) AS q01, round(q01, 6) AS q10, round(q11, 6) AS q11 FROM item1h""")
def hyper_sample(spark, d):
    """A draw of the hyper-parameters given the items' vectors."""
    mu, q = hyper(spark, d).draw(sampling.PortableDraws().generator(0, 0, 0))
    found = spark.createDataFrame([(*map(float, mu), *map(float, q.ravel()))], "mu0 double, mu1 double, q00 double, q01 double, q10 double, q11 double")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(f"""SELECT c_custkey AS id, round({uniform_sql("c_custkey", "x")}, 9) AS u, round({normal_sql("c_custkey", "x")}, 9) AS z FROM customer""")
def uniform_and_normal_draws(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return ids.select("id", F.round(uniform(F.col("id"), "x"), 9).alias("u"), F.round(normal(F.col("id"), "x"), 9).alias("z"))


def per_item(spark, d, of, names: list[str]) -> DataFrame:
    """Numbers that `of`, given matrices [[2 + a, b], [b, 2 + c]] and vectors (f0, f1), makes for items with vectors (f0, f1): a = f0 f0, b = f0 f1, c = f1 f1."""

    def made(batches):
        for batch in batches:
            f = equations.summed_rows(batch.column("f"), 2)
            full = sampling.symmetric(np.column_stack([2 + f[:, 0] ** 2, f[:, 0] * f[:, 1], 2 + f[:, 1] ** 2]), 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.ascontiguousarray(x)) for x in of(full, f)]], ["id", *names])

    found = items(spark, d).mapInArrow(made, "id long, " + ", ".join(f"{c} double" for c in names))
    return found.select("id", *[F.round(c, 6).alias(c) for c in names])


ABC = f"""{V}, s AS (SELECT id, f0, f1, 2 + f0 * f0 AS a, f0 * f1 AS b, 2 + f1 * f1 AS c FROM v)"""
LL = f"""{ABC}, l AS (SELECT *, sqrt(a) AS l00, b / sqrt(a) AS l10, sqrt(c - b * b / a) AS l11 FROM s)"""


@query(f"""WITH {ABC} SELECT id, round(a, 6) AS m00, round(b, 6) AS m01, round(b, 6) AS m10, round(c, 6) AS m11 FROM s""")
def symmetrise(spark, d):
    return per_item(spark, d, lambda m, f: (m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1]), ["m00", "m01", "m10", "m11"])


@query(f"""WITH {LL} SELECT id, round(f0 / l00, 6) AS x0, round((f1 - l10 * (f0 / l00)) / l11, 6) AS x1, round((f0 - l10 * (f1 / l11)) / l00, 6) AS y0, round(f1 / l11, 6) AS y1 FROM l""")
def triangular_solves(spark, d):
    """L x = f and L' y = f."""

    def solved(m, f):
        lower = sampling.posterior_factors(m, np.zeros((2, 2)), 1.0)
        return (*sampling.solve_lower(lower, f).T, *sampling.solve_upper(np.swapaxes(lower, -1, -2), f).T)

    return per_item(spark, d, solved, ["x0", "x1", "y0", "y1"])


@query(f"""WITH {LL} SELECT id, round(f0 + ({normal_sql("0", "g", 5)} - l10 * ({normal_sql("1", "g", 5)} / l11)) / l00 / sqrt(4.0), 6) AS x0, round(f1 + {normal_sql("1", "g", 5)} / l11 / sqrt(4.0), 6) AS x1 FROM l""")
def mvn_draw(spark, d):
    """A draw with mean f and precision 4 U'U, U the upper factor, always from the same key."""
    draw = lambda f, m: sampling.mvn_precision(sampling.PortableDraws().generator(5), f, np.linalg.cholesky(m).T, 4.0)
    return per_item(spark, d, lambda m, f: np.array([draw(x, y) for x, y in zip(f, m, strict=True)]).reshape(-1, 2).T, ["x0", "x1"])


@query(f"""WITH {V} SELECT id AS "row", round(f0, 6) AS value FROM v""")
def vector_roundtrip(spark, d):
    """A matrix of one column, written and read as a vector."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/x.ddm"
    matrix.write_matrix(items(spark, d).select(F.col("id").alias("row"), F.lit(0).alias("col"), F.col("f")[0].alias("value")), path)
    return matrix.read_vector(spark, path).withColumn("value", F.round("value", 6))


@query(f"""WITH {R} SELECT "user" AS "row", item AS col, value FROM r""")
def matrix_parts_roundtrip(spark, d):
    """A folder of files, one for each task."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    matrix.write_parts(ratings(spark, d).select(F.col("user").alias("row"), F.col("item").alias("col"), "value"), path)
    return matrix.read_matrix(spark, path)
