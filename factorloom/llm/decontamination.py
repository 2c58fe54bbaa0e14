"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items are cut into windows; a window's tokens are its word shingles. Tokens are ordered by rarity over
all documents, and as a window must be contained whole, its necessary prefix is its one rarest token: a document
position joins a window through that token alone. The token's place in the window and the window's length bound
where an occurrence can start and end, and the words there are compared with the window's, all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Benchmark items for each task, about.
ITEMS = 5_000
#: Words are runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The token by which every document reports its length.
LENGTH_TOKEN = -1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def token_at(words: Column, at: Column, shingle: int) -> Column:
    """A 64-bit token of the shingle that starts at a position."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(shingle)])


def windows_of(items: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """Distinct windows: wid, win (the words), n, and the ids of the items that hold it."""
    words = items.select(F.col(ident).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items")).select(F.xxhash64("win").alias("wid"), "win", F.size("win").alias("n"), "items")


def tokens_of(windows: DataFrame, shingle: int) -> DataFrame:
    """Each window's tokens with their places; windows shorter than the shingle give one token of their own length."""
    found = []
    for k in range(1, shingle + 1):
        those = windows.where(F.col("n") == k if k < shingle else F.col("n") >= k)
        at = F.explode(F.sequence(F.lit(0), F.col("n") - k))
        found.append(those.select("wid", "win", "n", at.alias("off")).withColumn("token", token_at(F.col("win"), F.col("off"), k)).withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, found)


def positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every position of every document with its token, and one row more with the document's length."""
    # posexplode() would have the optimizer filter by the array's size first, which splits each text twice.
    at = docs.select("*", F.posexplode_outer(F.concat("words", F.array(F.lit("")))).alias("pos", "_")).drop("_")
    n = F.size("words")
    tokens = [F.when(F.col("pos") <= n - k, token_at(F.col("words"), F.col("pos"), k)) for k in sizes]
    length = F.when(F.col("pos") == n, F.lit(LENGTH_TOKEN).cast("long"))
    if len(tokens) == 1:
        return at.select("*", F.coalesce(length, tokens[0]).alias("token"))
    return at.select("*", F.explode(F.array(length, *tokens)).alias("token"))


def decontaminate(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, shingle: int = 3, one_in: int = 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Return per row of docs: its id, text_hash, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    A window is `size` consecutive words of an item, or a shorter item whole. A document's word is hit if an occurrence
    of a window covers it, and the document is contaminated if at least one word in `one_in` is hit.
    Windows are broadcast if they have at most `broadcast_bytes`, by their measured size; of more, tokens and then documents are joined by shuffle.
    Null and empty texts have no words, a text of any length is searched whole; rows with equal ids are told apart by their texts, and repeated rows each
    give a row. Items with null or empty texts have no window, items with null ids are found but not named.
    Empty tables give no rows, or rows without hits. Other columns, whatever their names, aren't looked at.
    """
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("words"))
    windows = materialize(windows_of(items, item_id, item_text, size), items.count() // ITEMS + 1)
    tokens = tokens_of(windows, shingle)
    # A broadcast row holds a token, the window's words and Java's overhead.
    n_windows, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "win")) + F.size("win") * 24 + 100), F.lit(0))).first()
    sizes = [r.k for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect()] or [shingle]

    few = n_bytes <= broadcast_bytes and 64 * n_windows * size <= broadcast_bytes
    words_only = positions(rows.select("words"), sizes).select("token")
    parts = n_windows // (20 * ITEMS) + 1
    vocabulary = tokens.select("token").distinct()
    if few:
        rarity = materialize(words_only.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("df")), parts)
    else:
        rarity = materialize(words_only.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("df")).join(vocabulary, "token"))
    # A window with a token that no document has occurs nowhere.
    rarest = tokens.join(rarity, "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "off", "k")).alias("t"))
    prefixes = materialize(
        windows.join(rarest.where("t.df > 0"), "wid").select(F.col("t.token").alias("token"), F.col("t.off").alias("off"), "wid", "win", "n").unionByName(
            windows.sparkSession.range(1).select(F.lit(LENGTH_TOKEN).cast("long").alias("token")), allowMissingColumns=True
        ),
        parts,
    )
    start, own = F.col("pos") - F.col("off"), ["id", "text_hash", "n_words"]
    if few:
        fits = (start >= 0) & (start + F.col("n") <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win"))
        at = positions(rows, sizes).where(F.col("token").isNotNull()).join(F.broadcast(prefixes), "token").where(F.col("wid").isNull() | fits)
        found = at.select("id", "text_hash", F.size("words").alias("n_words"), F.when(F.col("wid").isNotNull(), start).alias("start"), "n", "wid")
        hits = found.groupBy(*own, "start", "n", "wid").agg(F.count("*").alias("copies"))
    else:
        every = rows.select("id", "text_hash", F.size("words").alias("n_words")).groupBy(*own).agg(F.count("*").alias("copies"))
        at = positions(rows, sizes).select("id", "text_hash", F.size("words").alias("n_words"), "pos", "token")
        maybe = at.join(prefixes.where("wid IS NOT NULL").select("token", "off", "wid", "n"), "token").select(*own, start.alias("start"), "n", "wid").where("start >= 0 AND start + n <= n_words").distinct()
        named = rows.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "words")
        read = maybe.join(named, F.col("id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))).withColumn("here", F.slice("words", F.col("start") + 1, F.col("n")))
        true = read.select(*own, "start", "n", "wid", "here").join(windows.select("wid", "win"), "wid").where("here = win").groupBy(*own, "start", "n", "wid").agg(F.count("*").alias("copies"))
        hits = every.unionByName(true, allowMissingColumns=True).select(*own, "start", "n", "wid", "copies")
    hits = hits.join(windows.select("wid", "items"), "wid", "left")
    before = Window.partitionBy(*own).orderBy(F.asc_nulls_first("start"), "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    per_doc = hits.withColumn("covered", covered).groupBy(*own).agg(
        F.coalesce(F.sum("covered"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
        F.max(F.when(F.col("wid").isNull(), F.col("copies"))).alias("copies"),
    )
    one_each = per_doc.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return one_each.select(
        F.col("id").alias(ident), "text_hash", F.col("n_words").cast("long"), "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that `decontaminate` doesn't find contaminated, with the same columns."""
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_text"]), "left_anti")


def op5_decontamination(spark, sf_dir):
    """All documents against all of benchmark: windows of 13 words, contaminated from one word in 20 on."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item, w[i:i + least(13, len(w)) - 1] AS win, least(13, len(w)) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n),
hit AS (
  SELECT a.doc_id, a.i, a.n, win.item
  FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM place WHERE w[i] IN (SELECT win[1] FROM win)) a JOIN win ON a.n = win.n AND a.win = win.win),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
