"""From source tables to ratings: joins, filters, ids, logarithms and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def triplets(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Ratings (user, item, value); equal cells add up, as in a sparse matrix."""
    return df.groupBy(F.col(row).alias("user"), F.col(col).alias("item")).agg(F.sum(value).cast("double").alias("value"))


def activities(records: DataFrame, acts: DataFrame, assays: DataFrame, record: str, assay: str, keep: Column, **columns: str) -> DataFrame:
    """The distinct rows of a three-way join on a record and on an assay, filtered, with columns renamed as given."""
    joined = records.join(acts, record).join(assays, assay).where(keep)
    return joined.select(*[F.col(c).alias(name) for name, c in columns.items()]).distinct()


def dense_ids(df: DataFrame, column: str, ident: str = "id") -> DataFrame:
    """(column, id): distinct values numbered from 1 in their order.

    Values are ranged over partitions, and each partition's first number is the sum of those before it; no task sees all values.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    placed = materialize(ranged.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(column, (F.col("_start") + F.col("_at") + 1).alias(ident))


def densified(df: DataFrame, *columns: str) -> DataFrame:
    """df, which is computed once and stored, with each column's values replaced by their dense ids."""
    df = materialize(df)
    stored = df
    for c in columns:
        df = df.join(dense_ids(stored, c, "_id"), c).drop(c).withColumnRenamed("_id", c)
    return df


def log10_abs(value: Column) -> Column:
    """The real part of log10; null for 0."""
    return F.when(value != 0, F.log10(F.abs(value)))


def split_key(*ids: Column) -> Column:
    """A 48-bit number by which cells are split, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[i.cast("string") for i in ids])), 1, 12), 16, 10).cast("long")


def split(df: DataFrame, *ids: str, one_in: int = 5) -> DataFrame:
    """df with is_test: about one cell in so many, without a shuffle."""
    return df.withColumn("is_test", F.pmod(split_key(*map(F.col, ids)), F.lit(one_in)) == 0)


def split_exact(df: DataFrame, *ids: str, one_in: int = 5) -> DataFrame:
    """df with is_test: exactly round(n / one_in) cells, those with the smallest keys.

    The border is found from counts by key range, so that only one range of keys has to be sorted. df is computed once and stored.
    """
    keyed = materialize(df.withColumn("_key", split_key(*map(F.col, ids))).withColumn("_range", F.shiftright("_key", 36)))
    counts = materialize(keyed.groupBy("_range").agg(F.count("*").alias("n")), 1)  # at most 4096 rows
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = int(total / one_in + 0.5)
    running = counts.select("_range", F.sum("n").over(Window.orderBy("_range")).alias("upto"), "n")  # at most 4096 rows
    border = running.where(F.col("upto") >= wanted).orderBy("_range").select("_range", (F.col("upto") - F.col("n")).alias("below")).first()
    at, below = (border["_range"], border["below"]) if border else (1 << 12, 0)
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_key", *ids))
    inside = keyed.where(F.col("_range") == at).withColumn("is_test", nth <= wanted - below)
    outside = keyed.where(F.col("_range") != at).withColumn("is_test", F.col("_range") < at)
    return outside.unionByName(inside).drop("_key", "_range")
