"""Mixing sources to target weights with exact word budgets.

Every document gets a hash-random 48-bit key. Within a source, documents are ranged by that key: a tree of key
prefixes (8, 16 and 24 bits) carries word totals, and a prefix sum at each level visits at most 256 children, so
no task ever holds a source, however large. A document's place in its source's order is then known exactly, and
the source is cut at its budget: whole epochs first, then documents in key order, the last one in mid-document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Bits of the key that a level of the tree looks at, from the root down.
LEVELS = (8, 16, 24)
KEY_BITS = 48
#: Rows of one key prefix from which on equal rows are counted before they are placed.
CROWD = 100_000
#: Sources for each task, about.
SOURCES = 100_000
ADDED = ("size", "source_size", "target", "epochs", "taken")


def random_key(ident: Column, words: Column, seed: int) -> Column:
    """A 48-bit integer from the document's id and text, the same on every run and in every engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(words), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add `rank` (from 0) by code point, null last, without bringing all sources to one task."""
    by = (F.col("no_source"), F.col("src"))
    sources = materialize(sources, sources.count() // SOURCES + 1)
    parts = sources.count() // SOURCES + 1
    ranges = (sources.repartitionByRange(parts, *by) if parts > 1 else sources.coalesce(1)).sortWithinPartitions(*by)
    placed = materialize(ranges.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(*sources.columns, (F.col("start") + F.col("at")).alias("rank"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Share all words among the sources by weight; what exceeds `most` times a source's size is shared again.

    Each round is one aggregate of two numbers; the set of capped sources only grows, until it stays.
    """
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.pmod(F.col("rank"), F.lit(len(weights))) == i, w).otherwise(weight)
    placed = materialize(sources.withColumn("weight", weight.cast("long")), sources.count() // SOURCES + 1)
    words, parts = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, shares, cap = words, parts, F.col("source_size") * most
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(max(shares, 1)))
        over = share > cap
        capped, their = placed.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("weight"))), F.lit(0))).first()
        if (words - capped, parts - their) == (left, shares):
            break
        left, shares = words - capped, parts - their
    return placed.withColumn("target", F.when(over, cap.cast("double")).otherwise(share)).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def mix(docs: DataFrame, keep: list[str], ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 9, crowd: int = CROWD) -> DataFrame:
    """Return the columns `keep` of each row of docs with size, source_size, target, epochs and taken.

    size is the number of words; taken is the number of words the mix takes of the row, repeats counted. For each
    source, taken sums to its target, rounded to a whole word: every document is taken `epochs` times in full, and
    documents in key order once more until the budget is met; the document at the cut is taken in part.
    No row is taken more than `most` times its size. A null text is empty and of size 0, a null source is a source of its own (ranked last),
    null ids are as good as others; rows with equal ids are told apart by their texts, and rows equal in id and text are taken one after another, whichever
    comes first; however many they are, they are spread over tasks. A long text counts with all its words. An empty table gives an empty mix.
    A column of `keep` with the name of an added one gives way to it.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*keep).alias("kept"), F.col(ident).alias("_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"),
        words.alias("size"), random_key(F.col(ident), F.col(text), seed).alias("key"), F.xxhash64(text).alias("tie"),
    ).withColumn("bucket", F.shiftright("key", KEY_BITS - LEVELS[-1]))

    own = ["no_source", "src"]
    leaves = materialize(rows.groupBy(*own, "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    tree = [leaves.drop("n")]
    for bits, below in zip(LEVELS[-2::-1], LEVELS[:0:-1], strict=True):
        tree.append(tree[-1].withColumn("bucket", F.shiftright("bucket", below - bits)).groupBy(*own, "bucket").agg(F.sum("words").alias("words")))
    sources = with_targets(ranked(tree[-1].groupBy(*own).agg(F.sum("words").alias("source_size"))), weights, most)

    above = sources.select(*own, "source_size", "target", "budget", F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("parent"))
    facts = ["source_size", "target", "budget"]
    for level, nodes in enumerate(reversed(tree)):
        step = LEVELS[level] - (LEVELS[level - 1] if level else 0)
        parent = F.shiftright("bucket", step) if level else F.lit(0).cast("long")
        before = Window.partitionBy(*own, "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        above = nodes.withColumn("parent", parent).join(above, [*own, "parent"]).select(
            *own, *facts, F.col("bucket").alias("parent"), (F.col("offset") + F.coalesce(F.sum("words").over(before), F.lit(0))).alias("offset"),
        )
    above = above.withColumnRenamed("parent", "bucket")
    before = Window.partitionBy(*own, "bucket").orderBy("key", "_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    started = lambda rows: rows.join(above, [*own, "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    full = leaves.where(F.col("n") > crowd).select(*own, "bucket")
    if full.isEmpty():
        placed = started(rows)
    else:
        # Equal rows stand in their bucket as one of all their words; each finds its place among them by its number. There are few such groups.
        same = [*own, "bucket", "key", "who"]
        rows = rows.withColumn("who", F.xxhash64("_id", "size", "tie"))
        crowds = materialize(rows.join(F.broadcast(full), [*own, "bucket"]).groupBy(*same).agg(F.count("*").alias("n"), F.first("_id").alias("_id"), F.first("size").alias("each"), F.first("tie").alias("tie")).where(F.col("n") > crowd))
        others = rows.join(F.broadcast(crowds.select(same)), same, "left_anti")
        stored = materialize(rows.join(F.broadcast(crowds.select(same)), same, "left_semi").withColumn("at", F.monotonically_increasing_id()))
        numbered = stored.withColumn("part", F.shiftright("at", 33))
        earlier = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as tasks
        parts = numbered.groupBy(*same, "part").agg(F.count("*").alias("n")).select(*same, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
        nth = F.row_number().over(Window.partitionBy(*same, "part").orderBy("at"))
        numbered = numbered.withColumn("nth", nth).join(parts, [*same, "part"])
        whole = started(others.unionByName(crowds.withColumn("size", F.col("n") * F.col("each")).select(*same, "_id", "size", "tie", F.lit(True).alias("crowd")), allowMissingColumns=True))
        first = materialize(whole.where("crowd").select(*same, "source_size", "target", "budget", "start"))
        again = numbered.join(F.broadcast(first), same).withColumn("start", F.col("start") + (F.col("ahead") + F.col("nth") - 1) * F.col("size"))
        shown = ["kept", "size", "source_size", "target", "budget", "start"]
        placed = whole.where("crowd IS NULL").select(shown).unionByName(again.select(shown))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    kept = [F.col("kept").getField(c).alias(c) for c in keep if c not in ADDED]
    return placed.withColumn("epochs", whole).select(*kept, "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('9:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 12))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS words, sum(weight) OVER () AS parts,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS pos,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         coalesce(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS their
  FROM s),
k AS (
  SELECT min(pos) AS first, arg_min((words - capped)::DOUBLE, pos) AS remaining, arg_min((parts - their)::DOUBLE, pos) AS shares
  FROM o WHERE (words - capped)::DOUBLE * weight / (parts - their)::DOUBLE <= cap),
t AS (
  SELECT source, source_size, CASE WHEN pos < first THEN cap::DOUBLE ELSE remaining * weight / shares END AS target
  FROM o, k),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, epochs::BIGINT AS epochs,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM p
"""


def op9_mixing(spark, sf_dir):
    """The whole of documents, mixed to weights 1, 2, 3 repeating, at most three epochs a source."""
    from .common import table

    return mix(table(spark, sf_dir, "documents"), ["doc_id"])
