"""Normal equations by entity, and moments of factors.

Up to NATIVE factors all sums are SQL aggregates, combined before the shuffle. Beyond, an aggregate for each of K(K+1)/2 products is
slower than numpy: entities are gathered in partitions, hot ones salted, and batches are reduced to one row for each entity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NATIVE = 10
#: Factors of more bytes than this aren't broadcast.
BROADCAST = 64 << 20
#: Entities with more ratings than this are dealt to several partitions.
HOT = 1 << 20
#: More hot entities than this aren't broadcast.
MANY_HOT = 100_000


def triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def small(n: int, k: int) -> bool:
    """Whether so many vectors can be broadcast."""
    return n * (8 * k + 48) <= BROADCAST


def with_factors(ratings: DataFrame, factors: DataFrame, other: str, k: int, n: int | None = None) -> DataFrame:
    """Ratings with the other side's vector as f; factors (id, f) are broadcast if they are few enough, by their number."""
    n = factors.count() if n is None else n
    named = factors.select(F.col("id").alias(other), "f")
    return ratings.join(F.broadcast(named) if small(n, k) else named, other)


def summed_rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def prepared(ratings: DataFrame, entity: str, k: int, native: int = NATIVE, hot: int = HOT) -> DataFrame:
    """Ratings dealt out and sorted by entity once, for many calls of `normal_equations` with that entity; kept in memory as far as there is room, else on disk, and computed anew where lost.

    For few factors nothing is moved, as sums are combined before the shuffle.
    """
    if k <= native:
        return ratings
    placed = dealt(ratings, entity, hot)
    out = placed.persist(StorageLevel.MEMORY_AND_DISK)
    out.dealt_by, out.whole = entity, placed.whole
    return out


def dealt(ratings: DataFrame, entity: str, hot: int) -> DataFrame:
    """Ratings with salt, by (entity, salt): entities with over `hot` ratings have several salts, all others 0. `whole`: there are none with several."""
    crowded = ratings.groupBy(entity).agg(F.count("*").alias("_c")).where(F.col("_c") > hot)
    # Hot entities are few if ratings are, but their number is checked all the same.
    n = crowded.select(entity).limit(MANY_HOT + 1).count()
    other = "user" if entity == "item" else "item"
    salt = F.pmod(F.xxhash64(other), F.coalesce(F.ceil(F.col("_c") / hot), F.lit(1)))
    salted = ratings.join(F.broadcast(crowded) if n <= MANY_HOT else crowded, entity, "left").withColumn("salt", salt).drop("_c") if n else ratings.withColumn("salt", F.lit(0).cast("long"))
    out = (salted.repartition(entity, "salt") if n else salted.repartition(entity)).sortWithinPartitions(entity)
    out.whole = not n
    return out


def normal_equations(ratings: DataFrame, factors: DataFrame, entity: str, other: str, mean: float, k: int, n_other: int | None = None, native: int = NATIVE, hot: int = HOT) -> DataFrame:
    """(id, n, gram, rr) for each rated entity: gram is the upper triangle of the sum of f f', row by row; rr sums f (value - mean)."""
    ready = getattr(ratings, "dealt_by", None) == entity
    n_other = factors.count() if n_other is None else n_other
    if k <= native:
        joined = with_factors(ratings, factors, other, k, n_other).select(F.col(entity).alias("id"), (F.col("value") - mean).alias("r"), "f")
        f = [F.col("f")[i] for i in range(k)]
        sums = joined.groupBy("id").agg(
            F.count("*").alias("n"), *[F.sum(f[i] * f[j]).alias(f"g{i}_{j}") for i, j in triangle(k)], *[F.sum(f[i] * F.col("r")).alias(f"r{i}") for i in range(k)]
        )
        return sums.select("id", "n", F.array(*[f"g{i}_{j}" for i, j in triangle(k)]).alias("gram"), F.array(*[f"r{i}" for i in range(k)]).alias("rr"))

    width, schema = k * (k + 1) // 2, "id long, n long, gram array<double>, rr array<double>"

    def out(rows):
        ids, n, gram, rr = (np.concatenate(x) for x in zip(*rows, strict=True))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in (gram, rr)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), *lists], ["id", "n", "gram", "rr"])

    def runs(ids):
        return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))

    def partial(batches):
        """A row for each run of an entity; runs go on over batches."""
        i, j = np.triu_indices(k)
        held = None
        for batch in batches:
            if batch.num_rows:
                ids, r, f = np.asarray(batch.column("id")), np.asarray(batch.column("r")), summed_rows(batch.column("f"), k)
                first = runs(ids)
                last = np.append(first[1:], len(ids))
                gram = np.stack([(f[a:b].T @ f[a:b])[i, j] for a, b in zip(first, last, strict=True)])
                now = [ids[first], last - first, gram, np.add.reduceat(f * r[:, None], first)]
                if held is not None:
                    if held[0][0] == now[0][0]:
                        for x, y in zip(now[1:], held[1:], strict=True):
                            x[0] += y[0]
                    else:
                        yield out([held])
                if len(now[0]) > 1:
                    yield out([[x[:-1] for x in now]])
                held = [x[-1:] for x in now]
        if held is not None:
            yield out([held])

    if ready and not small(n_other, k):
        ready, ratings = False, ratings.drop("salt")
    if small(n_other, k):
        dealt_out = ratings if ready else dealt(ratings, entity, hot)
        placed = with_factors(dealt_out, factors, other, k, n_other)
        if not ready:  # a sort below a join is optimized away, unless its result is kept
            placed = placed.sortWithinPartitions(entity)
    else:  # the other side's vectors move ratings about, so they are dealt out afterwards
        placed = dealt_out = dealt(with_factors(ratings, factors, other, k, n_other), entity, hot)
    rows = placed.select(F.col(entity).cast("long").alias("id"), (F.col("value") - mean).alias("r"), "f").mapInArrow(partial, schema)
    if dealt_out.whole:  # a row for each entity
        return rows
    # All but hot entities have one row.
    add = lambda name, w: F.aggregate("x", F.array_repeat(F.lit(0.0), w), lambda s, x: F.zip_with(s, x[name], lambda a, b: a + b))
    again = rows.groupBy("id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("gram", "rr")).alias("x"))
    one = F.size("x") == 1
    return again.select("id", "n", F.when(one, F.col("x")[0]["gram"]).otherwise(add("gram", width)).alias("gram"), F.when(one, F.col("x")[0]["rr"]).otherwise(add("rr", k)).alias("rr"))


def moments(factors: DataFrame, k: int) -> DataFrame:
    """(i, j, x) over vectors f: sums of f[i] f[j] for i <= j, sums of f[j] for i = -1, and the number at (-1, -1).

    Each task sends one row for each sum.
    """

    def partial(batches):
        total, one, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            f = summed_rows(batch.column("f"), k).astype(float)
            total += f.T @ f
            one += f.sum(axis=0)
            n += len(f)
        a, b = np.triu_indices(k)
        i = np.concatenate([a, np.full(k, -1), [-1]])
        j = np.concatenate([b, np.arange(k), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([total[a, b], one, [n]]))], ["i", "j", "x"])

    return factors.select("f").mapInArrow(partial, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))


def covariance(sums: DataFrame) -> DataFrame:
    """(i, j, cov) for i <= j, with n - 1 below, from `moments`."""
    first = sums.where("i = -1 AND j >= 0").select(F.col("j").alias("at"), F.col("x").alias("s"))
    n = sums.where("i = -1 AND j = -1").select(F.col("x").alias("n"))
    return (
        sums.where("i >= 0").join(F.broadcast(first.withColumnsRenamed({"at": "i", "s": "si"})), "i").join(F.broadcast(first.withColumnsRenamed({"at": "j", "s": "sj"})), "j")
        .join(F.broadcast(n)).select("i", "j", ((F.col("x") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))
    )
