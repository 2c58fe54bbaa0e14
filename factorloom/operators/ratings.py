"""Operators on ratings (user, item, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_rating(ratings: DataFrame) -> DataFrame:
    """One row: mean (over stored cells, zeros among them) and nnz."""
    return ratings.agg(F.avg("value").alias("mean"), F.count("*").alias("nnz"))


def nnz(ratings: DataFrame, side: str) -> DataFrame:
    return ratings.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("nnz"))


def nnz_profile(ratings: DataFrame, side: str, entities: int, many: int = 24, very_many: int = 10500) -> DataFrame:
    """One row: ratings for each of so many entities on average, and the percentage of entities with more than `many` and `very_many`."""
    share = lambda n: F.sum(F.when(F.col("nnz") > n, 1).otherwise(0)) * 100.0 / entities
    return nnz(ratings, side).agg((F.sum("nnz") / entities).alias("avg_nnz"), share(many).alias("pct_many"), share(very_many).alias("pct_very_many"))


def centered(ratings: DataFrame, mean: float, alpha: float = 1.0) -> DataFrame:
    return ratings.withColumn("value", (F.col("value") - mean) * alpha)


def transposed(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("item").alias("user"), F.col("user").alias("item"), "value")


def of_entity(ratings: DataFrame, side: str, ident: int) -> DataFrame:
    """One column or row of the matrix."""
    return ratings.where(F.col(side) == ident)


def shape(*tables: DataFrame, base: int = 0) -> DataFrame:
    """One row (n_users, n_items): the smallest shape that holds all tables; ids count from `base`."""
    cells = tables[0].select("user", "item")
    for t in tables[1:]:
        cells = cells.unionByName(t.select("user", "item"))
    return cells.agg((F.max("user") + 1 - base).alias("n_users"), (F.max("item") + 1 - base).alias("n_items"))


def unrated(ratings: DataFrame, side: str, entities: DataFrame) -> DataFrame:
    """Ids of entities without a rating."""
    return entities.join(ratings.select(F.col(side).alias("id")).distinct(), "id", "left_anti")


def structure_differences(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
    """Entities whose numbers of cells differ; none if two matrices have the same structure."""
    both = nnz(a, side).withColumnRenamed("nnz", "a").join(nnz(b, side).withColumnRenamed("nnz", "b"), "id", "full_outer").fillna(0, ["a", "b"])
    return both.where("a <> b")


def pattern_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct cells of both."""
    return train.select("user", "item").unionByName(test.select("user", "item")).distinct()


def relabelled(ratings: DataFrame, side: str, ids: DataFrame) -> DataFrame:
    """Ratings with ids replaced by (id, new_id); swapping the two columns of the map takes it back."""
    return ratings.join(ids.withColumnRenamed("id", side), side).drop(side).withColumnRenamed("new_id", side).select(*ratings.columns)


def positive(ratings: DataFrame) -> DataFrame:
    """The cells of a binary matrix file: those above zero, as ones."""
    return ratings.where("value > 0").withColumn("value", F.lit(1.0))
