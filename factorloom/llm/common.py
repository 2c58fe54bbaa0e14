"""Tables, scratch space and expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.storage import discard, materialize, scratch_dir

__all__ = ["WORD", "ascii_lower", "discard", "materialize", "schema_with", "scratch_dir", "table"]

#: Runs of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other characters take the faster built-in way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def schema_with(df: DataFrame, columns: list[str], added: str) -> StructType:
    """The fields of some columns of df, and others as in a DDL string."""
    return StructType([df.schema[c] for c in columns] + (StructType.fromDDL(added).fields if added else []))
