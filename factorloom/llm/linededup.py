"""Removal of passages that repeat across documents, by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so a passage is cut at the same places
wherever it stands. Chunks that the table has more than once are grouped by their bytes, and all but the first go. Where a
passage meets other text, its first and last lines share a chunk with foreign lines, and a short passage may lie within one chunk. So
what no repeated chunk holds is looked up by runs: from each line on, and up to each line, just as many lines as reach
LEAST characters. Any passage of LEAST characters is made of such runs, whatever stands about it; of a repeated chunk, only the
first copy's runs take part, as its copies are gone by then. What is removed is the same as if all runs of all lines were compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: One line in so many ends a chunk.
ONE_IN = 8
#: Runs of fewer characters (line breaks within count) are never removed.
LEAST = 100
#: The rolling hash: multiplier and modulus.
BASE, PRIME = 1103515245, (1 << 31) - 1
#: Repeated units for each task, about.
UNITS = 25_000
#: Lines that are tried one by one for the end of a run, before the rest that it could need.
NEAR = 4


def with_units(docs: DataFrame, text: str) -> DataFrame:
    """Add `lines` and `units`: the chunks (whole) and runs of lines that may be removed, (start, stop, key, inside, whole).

    `inside` is the key of the chunk that holds a run, if it does and that chunk is a unit. Chunks that are no longer than a run aren't units.
    Each line costs the same, however many a text has.
    """
    at = docs.withColumn("lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    at = at.withColumns({
        "sizes": F.expr("transform(lines, l -> length(l) + 1)"),
        "hashes": F.expr(f"transform(lines, l -> pmod(xxhash64(l), {PRIME}L))"),
    })
    ahead = lambda i, n: " + ".join(f"get(sizes, {i} + {k})" for k in range(n))
    back = lambda j, n: " + ".join(f"get(sizes, {j} - {k})" for k in range(1, n + 1))
    summed = f"named_struct('t', 0, 'n', 0), (s, x) -> IF(s.t > {LEAST}, s, named_struct('t', s.t + x, 'n', s.n + 1))"
    stop = " ".join(f"WHEN {ahead('i', n)} > {LEAST} THEN i + {n}" for n in range(1, NEAR + 1))
    start = " ".join(f"WHEN {back('j', n)} > {LEAST} THEN j - {n}" for n in range(1, NEAR + 1))
    at = at.withColumns({
        # a line has a character at least, its break
        "upto": F.expr(f"transform(sequence(0, size(sizes) - 1), i -> CASE {stop} ELSE aggregate(slice(sizes, i + 1, {LEAST + 1}), {summed}, s -> IF(s.t > {LEAST}, i + s.n, NULL)) END)"),
        "since": F.expr(f"transform(sequence(1, size(sizes)), j -> CASE {start} ELSE aggregate(reverse(slice(sizes, greatest(j - {LEAST}, 1), least(j, {LEAST + 1}))), {summed}, s -> IF(s.t > {LEAST}, j - s.n, NULL)) END)"),
        "ends": F.expr(f"filter(sequence(1, size(hashes)), i -> i = size(hashes) OR (coalesce(get(hashes, i - 2), 0L) * {BASE}L + hashes[i - 1]) % {PRIME}L % {ONE_IN} = 0)"),
    })
    at = at.withColumn("chunks", F.expr("transform(ends, (e, k) -> named_struct('start', coalesce(get(ends, k - 1), 0), 'stop', e))"))
    joined = lambda start, stop: f"array_join(slice(lines, {start} + 1, {stop} - {start}), '\n')"
    at = at.withColumns({
        "of": F.expr("flatten(transform(chunks, (c, k) -> array_repeat(k, c.stop - c.start)))"),
        "keys": F.expr(f"transform(chunks, c -> IF(upto[c.start] < c.stop, xxhash64({joined('c.start', 'c.stop')}, true), NULL))"),
    })
    held = "IF(of[{0}] = of[{1} - 1], keys[of[{0}]], NULL)"
    unit = lambda start, stop: f"named_struct('start', {start}, 'stop', {stop}, 'key', xxhash64({joined(start, stop)}, false), 'inside', {held.format(start, stop)}, 'whole', false)"
    whole = "transform(chunks, (c, k) -> IF(keys[k] IS NULL, NULL, named_struct('start', c.start, 'stop', c.stop, 'key', keys[k], 'inside', CAST(NULL AS BIGINT), 'whole', true)))"
    forth = f"transform(upto, (e, i) -> IF(e IS NULL, NULL, {unit('i', 'e')}))"
    # A run that both ways find counts once.
    other = f"transform(since, (b, i) -> IF(b IS NULL OR upto[b] = i + 1, NULL, {unit('b', '(i + 1)')}))"
    units = at.withColumn("units", F.expr(f"filter(concat({whole}, {forth}, {other}), u -> u IS NOT NULL)"))
    return units.drop("sizes", "hashes", "upto", "since", "ends", "chunks", "of", "keys")


def exploded(docs: DataFrame, text: str) -> DataFrame:
    """A row for each unit (u) of docs, with lines."""
    # explode() would have the optimizer filter by the units' number first, which computes them twice.
    return with_units(docs, text).drop(text).withColumn("u", F.explode_outer("units")).where("u IS NOT NULL").drop("units")


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Return docs with repeated passages cut out of `text`, and n_lines and n_removed added (columns of these names give way).

    A run is as many consecutive lines as just reach LEAST characters, counted from its first line or from its last. Of all equal runs of
    the whole table, the one in the document with the smallest (id, text hash), and there the first, stays; the lines of all others are
    removed, but for those that overlap the first. Candidates are found by a 64-bit hash; they are grouped by their bytes before anything is removed.
    A null text stays null and has no line; an empty text is one empty line; a text of any length is cut as others are, in time that grows with its
    length. Repeated rows are cut alike: rows with the same id and text are one document. Null ids come first. An empty table gives an empty
    table. Other columns, whatever their names, are kept as they are.
    """
    own = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    units = exploded(own, "text")
    repeated = materialize(units.groupBy("u.key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # A key takes about 100 bytes in a broadcast table; beyond the limit, both sides are shuffled, with a unit's own lines only.
    few = repeated.count() * 100 <= broadcast_bytes
    run = F.expr("array_join(slice(lines, u.start + 1, u.stop - u.start), '\n')")
    known, holding = (F.broadcast(x) if few else x for x in (repeated, repeated.withColumnRenamed("key", "inside")))
    place = ["id", "text_hash", "start", "stop"]
    flat = units.select("id", "text_hash", "u.*", *(["lines", "u"] if few else [run.alias("run")]))
    asked = flat.join(known, "key", "left_semi").join(holding, "inside", "left_anti")
    found = materialize(asked.select(*place, "key", "whole", (run if few else F.col("run")).alias("run")).withColumn("class", F.md5("run")))

    def later(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """The lines that go: of all copies but the first, without those that overlap it."""
        here = rows.select(*place, "key", "class").join(classes.select("key", "class", "first"), ["key", "class"])
        same = F.struct("id", "text_hash").eqNullSafe(F.struct("first.id", "first.text_hash"))
        start = F.when(same, F.greatest("start", F.col("first.start") + F.col("stop") - F.col("start"))).otherwise(F.col("start"))
        return here.where(~(same & (F.col("start") == F.col("first.start")))).select("id", "text_hash", start.alias("start"), "stop").where("start < stop")

    grouped = lambda rows: rows.groupBy("key", "class", "run").agg(F.min(F.struct("id", "text_hash", "start")).alias("first"))
    parts = found.count() // UNITS + 1
    chunks = materialize(grouped(found.where("whole")), parts)
    inner = exploded(chunks.select("first", "run"), "run").where("NOT u.whole").select("first.id", "first.text_hash", *[(F.col("first.start") + F.col(f"u.{c}")).alias(c) for c in ("start", "stop")], "u.key", run.alias("run"))
    inner = inner.join(known, "key", "left_semi").withColumn("class", F.md5("run"))
    runs = materialize(found.where("NOT whole").drop("whole").unionByName(inner), parts)
    firsts = materialize(grouped(runs).select("key", "class", "first"), parts)
    gone = later(found.where("whole"), chunks).unionByName(later(runs, firsts)).distinct()
    # Each line of a document once: what lies beyond all earlier cuts.
    before = Window.partitionBy("id", "text_hash").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    new = gone.withColumn("start", F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))).where("start < stop")
    cuts = materialize(new.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("_cuts")).withColumnsRenamed({"id": "_id", "text_hash": "_hash"}), parts)
    discard(repeated, found, chunks, runs, firsts)
    rows = docs.select(F.struct("*").alias("row"), F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"))
    whole = rows.join(cuts.hint("merge"), rows["id"].eqNullSafe(cuts["_id"]) & (rows["text_hash"] == cuts["_hash"]), "left")
    at = whole.select("row", "_cuts", F.split(F.col("row").getField(text), "\n", -1).alias("lines"), F.expr("flatten(transform(_cuts, c -> sequence(c.start, c.stop - 1)))").alias("gone"))
    cut = F.size("_cuts") > 0
    kept = F.when(cut, F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")).otherwise(F.col("row").getField(text))
    same = [(kept if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return at.select(*same, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.when(cut, F.size("gone")).otherwise(0).cast("long").alias("n_removed"))


def op7_linededup(spark, sf_dir):
    """All documents, with what is left of their texts."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Knows nothing of chunks: all runs of all lines.
ORACLE = rf"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, sum(length(lines[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(lines[i]) + 1 AS size
      FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
r AS (
  SELECT a.doc_id, a.i AS start, min(b.i) AS stop FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.size > {LEAST} GROUP BY ALL
  UNION SELECT b.doc_id, max(a.i) AS start, b.i AS stop FROM l b JOIN l a ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.size > {LEAST} GROUP BY b.doc_id, b.i),
t AS (SELECT doc_id, start, stop, array_to_string(lines[start:stop], chr(10)) AS run FROM r JOIN d USING (doc_id)),
g AS (SELECT doc_id, start, stop, first_value(doc_id) OVER w AS doc1, first_value(start) OVER w AS start1 FROM t WINDOW w AS (PARTITION BY run ORDER BY doc_id, start)),
c AS (SELECT doc_id, CASE WHEN doc_id = doc1 THEN greatest(start, start1 + stop - start + 1) ELSE start END AS start, stop FROM g WHERE (doc_id, start) <> (doc1, start1)),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(start, stop)) AS i FROM c WHERE start <= stop),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL) AS kept, count(x.i) AS n_removed, count(*) AS n_lines
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_removed::BIGINT AS n_removed
FROM d JOIN k USING (doc_id)
"""
