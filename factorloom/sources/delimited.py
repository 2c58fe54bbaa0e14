"""Ratings in delimited text: tab-separated columns, of which the first ones count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_triplets(spark: SparkSession, path: str, sep: str = "\t", base: int = 1) -> DataFrame:
    """(user, item, value) from the first three columns, ids counted from `base` in the file and from 0 here; further columns aren't parsed."""
    lines = spark.read.text(path)
    part = F.split("value", sep, 4)
    cells = lines.where(F.trim("value") != "").select(*[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(("user", "item", "value"))])
    return cells.select((F.col("user").cast("long") - base).alias("user"), (F.col("item").cast("long") - base).alias("item"), F.col("value").cast("double").alias("value"))


def write_triplets(ratings: DataFrame, path: str, sep: str = "\t", base: int = 1) -> None:
    """A folder of text files, as many as the ratings have partitions."""
    ratings.select(F.col("user") + base, F.col("item") + base, "value").write.mode("overwrite").csv(path, sep=sep)
