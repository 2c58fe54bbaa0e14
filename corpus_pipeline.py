"""From raw documents to a training mix: five operators of factorloom.llm, one after another.

Each stage reads what the one before it kept, stored as Parquet, and returns the columns of documents; the last one
adds how much of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontamination, linededup, mixing, quality, simhash
from factorloom.llm.common import table
from factorloom.storage import STORED, delete, scratch_folder, temporary


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier expects to be rated well and not toxic.

    Null and empty texts count as texts without telling words, and stay; long texts are read whole; rows that repeat an id or a text are
    decided alike, by their text alone. An empty table gives an empty table, and without labels all documents stay.
    """
    return quality.select(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; n_chars is counted anew where something went.

    A null text stays null, an empty one empty, long ones are cut as others are. Of equal passages the one in the smallest id stays, null ids
    first; rows with the same id and text are one document and are cut alike. An empty table gives an empty table.
    """
    cut = linededup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null last.

    Null and empty texts are copies of each other; long texts are compared whole; of rows that repeat id and text one stays.
    An empty table gives an empty table.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages, or of which these are less than one word in 20.

    Null and empty texts have no words and stay; long texts are searched whole; rows that repeat an id are told apart by their texts, and
    equal ones are decided alike. Empty tables, of documents or of benchmark items, are no error.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, and how many: `epochs` times all of them, and of `taken` what is left once more.

    Null and empty texts have no words, so the mix has none of them; a null source is a source of its own; a long text may be taken in part; ties
    are ordered by id and text, and rows equal in both are taken one after another. An empty table gives an empty mix.
    """
    return mixing.mix(docs, docs.columns).where("taken > 0")


def guarded(stage):
    """A stage that sees only the columns of documents; others go along in one struct, so that their names meet no other."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in COLUMNS]
        if not more:
            return stage(spark, docs, sf_dir)
        packed = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(more)]).alias("more")
        out = stage(spark, docs.select(*[c for c in docs.columns if c in COLUMNS], packed), sf_dir)
        added = [c for c in out.columns if c not in COLUMNS and c != "more"]
        back = [F.col(f"more.c{more.index(c)}").alias(c) if c in more else F.col(c) for c in docs.columns if c not in added]
        return out.select(*back, *added)

    return run_stage


#: What a documents table has; the last stage's columns take the place of others with their names.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
STAGES = [
    ("quality", guarded(select_quality)),
    ("linededup", guarded(cut_repeated_lines)),
    ("simhash", guarded(drop_near_duplicates)),
    ("decontamination", guarded(drop_contaminated)),
    ("mixing", guarded(mix_sources)),
]

#: The first stage's model and the third stage's components can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables. What a stage has stored goes once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with temporary():
            out = stage(spark, docs, sf_dir)
            path = scratch_folder(spark)
            out.write.parquet(path)
            STORED.pop(path)
        docs = spark.read.schema(out.schema).parquet(path)
        STORED[path] = spark
        if last:
            delete(last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
