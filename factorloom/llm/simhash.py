"""SimHash near-duplicates, found exactly with vantage-point trees.

Fingerprints that differ in at most r bits agree on at least m of r + m blocks of bits, so all links lie within
shards of fingerprints that agree on some m blocks, or on the first bits of them: as many as leave AIM fingerprints in a shard. A shard is a
vantage-point tree: a vantage fingerprint splits it at the median Hamming distance; by the triangle inequality a link from the outer to the
inner part can only start within r of the border, so the outer fingerprints there go to the inner shard too, as visitors. Shards too
large for a task are split this way by Spark, level by level; the rest in numpy within a task, down to leaves whose members are
compared with each other and with the visitors, but for pairs that the distances to an earlier vantage rule out.
One tree over all fingerprints can't prune enough: the distances of unlike fingerprints crowd around 32, and
a border of 4 on either side takes in most of them; therefore there is a tree for each shard of AIM.
Within a shard only links that join what isn't joined yet are passed on, not all pairs of a group of near copies.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, schema_with, table
from .components import components
from .texthash import mixed, shingles

#: Fingerprints in a shard for a task, in a leaf, and on average in a root's shard.
SHARD, LEAF, AIM = 20_000, 64, 1024
#: Min-hashes in a band, and bands: of pairs of similarity 0.8, one in 14,000 shares no band.
ROWS, BANDS = 5, 24
#: Texts for each task that groups or joins them by their hashes, and for each that compares them, about.
TEXTS, PAIRS = 25_000, 6_000
#: Shingles that are min-hashed at a time.
PART = 1 << 9
#: Bytes of text for each bucket of hashes whose rarity is counted; 64-bit words of a set's parities.
BUCKET, WORDS = 1 << 24, 8


def shingled(data: bytes, shingle: int) -> np.ndarray:
    """The hashes of all word shingles of one text."""
    return next(shingles(pa.array([data], pa.binary()).cast(pa.large_binary()), shingle))[1]


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half of the hashes; 0 without any."""
    if len(hashes) < 2:
        return int(hashes.sum())
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """Add `fp`, the fingerprint of the shingles' hashes as a signed long, in place of text."""

    def added(batches):
        for batch in batches:
            prints = np.array([fingerprint(hashes) for _, hashes in shingles(batch.column("text"), shingle)], np.uint64)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(prints.view(np.int64))], [*kept, "fp"])

    return docs.mapInArrow(added, schema_with(docs, [c for c in docs.columns if c != "text"], "fp long"))


def masks(radius: int, agree: int, bits: int) -> list[int]:
    """Of every choice of `agree` of radius + agree blocks, the first `bits` bits, dealt evenly to its blocks."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    out = []
    for blocks in combinations(range(n), agree):
        shares = [(bits + i) // agree for i in range(agree)]
        out.append(sum(((1 << min(share, edges[b + 1] - edges[b])) - 1) << edges[b] for b, share in zip(blocks, shares, strict=True)))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def leaves(prints: np.ndarray, members: np.ndarray, visitors: np.ndarray, radius: int):
    """Yield (members, visitors, distances of all fingerprints to the vantages above, a row for each) of the leaves of a vantage-point tree; every link with a member is within some leaf."""
    stack = [(members, visitors, ())]
    while stack:
        own, guests, above = stack.pop()
        if len(own) > LEAF:
            apart = np.bitwise_count(prints ^ prints[own[0]])
            from_own = apart[own]
            middle = int(np.median(from_own))
            inner = from_own <= middle
            if inner.all():
                middle = int(from_own[from_own < middle].max())  # the vantage's own is 0
                inner = from_own <= middle
            from_guests = apart[guests].astype(int)
            border = ~inner & (from_own <= middle + radius)
            stack.append((own[inner], np.concatenate([guests[from_guests <= middle + radius], own[border]]), (*above, apart)))
            stack.append((own[~inner], guests[from_guests > middle - radius], (*above, apart)))
        else:
            yield own, guests, above


def joined(prints: np.ndarray, visits: np.ndarray, radius: int, earlier: list[int]) -> tuple[list[int], list[int], int]:
    """Links of one shard that join its parts, a spanning forest of all links not found by earlier roots; and how many pairs were compared."""
    label, us, vs, compared = np.arange(len(prints)), [], [], 0
    skip = np.array(earlier, np.uint64)
    for own, guests, above in leaves(prints, np.flatnonzero(~visits), np.flatnonzero(visits), radius):
        every = np.concatenate([own, guests])
        i, j = np.nonzero(np.arange(len(own))[:, None] < np.arange(len(every))[None, :])
        i, j = own[i], every[j]
        for apart in above[-2:]:  # by the triangle inequality
            maybe = np.abs(apart[i].astype(np.int8) - apart[j].astype(np.int8)) <= radius
            i, j = i[maybe], j[maybe]
        compared += len(i)
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        i, j = i[near], j[near]
        if len(skip) and len(i):
            new = ((prints[i] ^ prints[j])[:, None] & skip != 0).all(axis=1)
            i, j = i[new], j[new]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if label[a] != label[b]:
                us.append(int(prints[a]))
                vs.append(int(prints[b]))
                label[label == label[b]] = label[a]
    return us, vs, compared


def links(prints: DataFrame, radius: int, agree: int | None = None, shard: int = SHARD, aim: int = AIM) -> DataFrame:
    """From distinct fingerprints (fp): links (u, v) of at most `radius` bits that join all that any links join."""
    n = prints.count()
    if agree is None:
        agree = next((m for m in (1, 2, 3) if n / 2 ** (64 * m // (radius + m)) <= aim), 3)
    bits = max(0, min(64 * agree // (radius + agree), (max(n, 1) // aim).bit_length() - 1 if n > aim else 0))
    bits = masks(radius, agree, bits) if bits else [0]
    routes = F.explode(F.array(*[F.struct(F.lit(i).alias("root"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(bits)]))
    placed = prints.select("fp", routes.alias("at")).select("fp", F.col("at.root").alias("root"), F.xxhash64("at.root", "at.key").alias("shard"), F.lit(False).alias("visits"))
    done = []
    while True:
        large = materialize(placed.where("NOT visits").groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "shard")).alias("vantage")).where(F.col("n") > shard), n * len(bits) // 250_000 + 1)
        if large.isEmpty():
            break
        sides = materialize(placed.join(large, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))))
        done.append(placed.join(large, "shard", "left_anti"))
        below = Window.partitionBy("shard").orderBy("d")  # at most 65 rows
        spread = sides.where("NOT visits").groupBy("shard", "d").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        median = F.min(F.when(F.col("below") * 2 >= F.col("n"), F.col("d")))
        middle = spread.withColumn("below", F.sum("c").over(below)).groupBy("shard").agg(median.alias("median"), F.max("d").alias("most"), F.array_sort(F.collect_set("d")).alias("ds"))
        # Something always lies within and without: the vantage's own distance is 0.
        middle = middle.select("shard", F.when(F.col("median") < F.col("most"), F.col("median")).otherwise(F.element_at("ds", -2)).alias("middle"))
        cut = sides.join(materialize(middle), "shard")
        out = F.col("d") > F.col("middle")
        inner = F.when(F.col("d") <= F.col("middle") + radius, F.struct(F.xxhash64("shard", F.lit(0)).alias("shard"), (F.col("visits") | out).alias("visits")))
        outer = F.when(F.when(F.col("visits"), F.col("d") > F.col("middle") - radius).otherwise(out), F.struct(F.xxhash64("shard", F.lit(1)).alias("shard"), F.col("visits").alias("visits")))
        placed = materialize(cut.select("fp", "root", F.explode(F.array(inner, outer)).alias("to")).where("to IS NOT NULL").select("fp", "root", "to.shard", "to.visits"))
    for part in done:
        placed = placed.unionByName(part)

    earlier = [bits[:i] for i in range(len(bits))]

    def found(batches):
        us, vs, held = [], [], None

        def search(ids, prints, roots, visits):
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for f, n in zip(first, np.diff(np.append(first, len(ids))), strict=True):
                more = joined(prints[f : f + n], visits[f : f + n], radius, earlier[roots[f]])
                us.extend(more[0])
                vs.extend(more[1])

        def out():
            data = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)]
            us.clear(), vs.clear()
            return pa.RecordBatch.from_arrays(data, ["u", "v"])

        for batch in batches:
            now = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("shard", "fp", "root", "visits")]
            now[1] = now[1].view(np.uint64)
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last shard may go on
            if whole:
                search(*[x[:whole] for x in now])
                yield out()
            held = [x[whole:] for x in now]
        if held is not None and len(held[0]):
            search(*held)
            yield out()

    return placed.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp", "root", "visits").mapInArrow(found, "u long, v long")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Return per row of docs: its id, text_hash, fp, root (a fingerprint that names its component) and component_id, the smallest id that links of at most `radius` bits reach.

    Null and empty texts have fingerprint 0 and are linked as any other; a text of any length is hashed whole. Null ids are never a component's id unless it
    has no other; rows that repeat an id each give a row. An empty table gives none; other columns aren't looked at.
    """
    rows = materialize(fingerprints(docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), shingle))
    firsts = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = materialize(firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = materialize(rooted.join(named, "root").select("fp", "root", "component_id"))
    discard(firsts, rooted, named)
    return rows.join(by_print, "fp").select(F.col("id").alias(ident), "text_hash", "fp", "root", "component_id")


def multipliers() -> np.ndarray:
    """Odd numbers, one for each min-hash."""
    return mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes; sets of similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    by = multipliers()
    for i in range(0, len(hashes), PART):
        np.minimum(least, (hashes[i : i + PART, None] * by).min(axis=0), out=least)
    return mixed((mixed(least).reshape(BANDS, ROWS) * by[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """Add `fp`, `size` (different shingles) and `bands` in place of text."""

    def added(batches):
        for batch in batches:
            prints, sizes, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, BANDS), np.uint64)
            # Equal texts are described once.
            _, first, of = np.unique(np.asarray(batch.column("text").fill_null("").dictionary_encode().indices), return_index=True, return_inverse=True)
            for i, hashes in shingles(batch.column("text").take(pa.array(first)), shingle):
                prints[i] = fingerprint(hashes)
                hashes = np.unique(hashes)
                sizes[i], keys[i] = len(hashes), bands(hashes)
            prints, sizes, keys = prints[of], sizes[of], keys[of]
            kept = [c for c in batch.schema.names if c != "text"]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(prints.view(np.int64)), pa.array(sizes), lists], [*kept, "fp", "size", "bands"])

    return docs.mapInArrow(added, schema_with(docs, [c for c in docs.columns if c != "text"], "fp long, size long, bands array<long>"))


def similar(edges: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The edges (u, v) between texts (node, text) whose sets of shingles have a Jaccard similarity of at least `least`; two empty sets are equal."""

    sets: dict[int, np.ndarray] = {}

    def known(node: int, text: pa.Scalar) -> np.ndarray:
        if node not in sets:
            if len(sets) > 100:  # the last few texts: most have several edges
                sets.clear()
            sets[node] = np.unique(shingled(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle))
        return sets[node]

    def compared(batches):
        for batch in batches:
            good = []
            for node, x, other, y in zip(*[batch.column(i) for i in range(4)], strict=True):
                a, b = known(node.as_py(), x), known(other.as_py(), y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    paired = edges.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
    return paired.select("u", "x", "v", "y").mapInArrow(compared, "u long, v long")


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS buckets, whether a set has an odd number of hashes there: two sets' parities differ in no more bits than the sets have elements that the other lacks."""
    odd = np.bincount((mixed(hashes) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def rare_prefixes(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of different texts (node, root, text): (token, node, root, at, size, odd0, odd1, ...), the hashes among each set's rarest that other sets have too, with their places, the set's size and parities.

    Sets are sorted by how many of these texts have a hash. The first n - ceil(least n) + 1 of n are given: sets with a Jaccard similarity of at least `least`
    have one of them in common. Counts are summed by hash and sent back to the batches that ask, once for each hash of a batch.
    """
    pack = lambda x, t: pa.array([np.ascontiguousarray(x).astype(t).tobytes()], pa.binary())
    read = lambda x, t: np.frombuffer(x.as_buffer(), t)

    def stored(batches):
        for batch in batches:
            if batch.num_rows:
                sets = [np.unique(hashes) for _, hashes in shingles(batch.column("text"), shingle)]
                nodes, roots = (batch.column(c).to_numpy() for c in ("node", "root"))
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pack(nodes, "<i8"), pack(roots, "<i8"), pack([len(x) for x in sets], "<i8"), pack(np.concatenate(sets), "<u8")], ["batch", "nodes", "roots", "sizes", "tokens"])

    held = materialize(texts.select("node", "root", "text").mapInArrow(stored, "batch long, nodes binary, roots binary, sizes binary, tokens binary"))
    buckets = max(16, (held.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // BUCKET)

    def asked(batches):
        for batch in batches:
            for ident, data in zip(batch.column("batch"), batch.column("tokens"), strict=True):
                tokens, n = np.unique(read(data, "<u8"), return_counts=True)
                of = mixed(tokens) % np.uint64(buckets)
                for b in np.unique(of):
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([ident.as_py()]), pack(tokens[of == b], "<u8"), pack(n[of == b], "<i8")], ["bucket", "batch", "tokens", "n"])

    def answered(batches):
        rows = [tuple(batch.column(i)[j] for i in range(4)) for batch in batches for j in range(batch.num_rows)]
        for bucket in {r[0].as_py() for r in rows}:
            own = [(r[1].as_py(), read(r[2], "<u8"), read(r[3], "<i8")) for r in rows if r[0].as_py() == bucket]
            tokens, at = np.unique(np.concatenate([t for _, t, _ in own]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for _, _, n in own])).astype(np.int64)
            for ident, t, _ in own:
                n = total[np.searchsorted(tokens, t)]
                yield pa.RecordBatch.from_arrays([pa.array([ident]), pack(t[n > 1], "<u8"), pack(n[n > 1], "<i8")], ["batch", "tokens", "n"])

    def first(batches):
        for batch in batches:
            for nodes, roots, sizes, tokens, replies in zip(*[batch.column(i) for i in range(5)], strict=True):
                known = [(read(r["tokens"], "<u8"), read(r["n"], "<i8")) for r in replies]
                hashes, n = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(hashes)
                hashes, n = hashes[order], n[order]
                parts, at, tokens = [], 0, read(tokens, "<u8")
                for node, root, size in zip(read(nodes, "<i8"), read(roots, "<i8"), read(sizes, "<i8").tolist(), strict=True):
                    own = tokens[at : at + size]
                    at += size
                    if not len(hashes):
                        continue
                    spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    common = hashes[spot] == own
                    own, count = own[common], n[spot[common]]
                    alone = size - len(own)  # these come first
                    own = own[np.lexsort((own, count))][: max(0, size - int(np.ceil(least * size - 1e-9)) + 1 - alone)]
                    odd = parities(tokens[at - size : at])
                    parts.append((own, np.full(len(own), node), np.full(len(own), root), alone + np.arange(len(own)), np.full(len(own), size), *[np.full(len(own), x) for x in odd]))
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype("<u8").view("<i8")) for c in columns], names)

    blobs = held.select("batch", "tokens").mapInArrow(asked, "bucket long, batch long, tokens binary, n binary").repartition(buckets, "bucket")
    replies = blobs.mapInArrow(answered, "batch long, tokens binary, n binary").groupBy("batch").agg(F.collect_list(F.struct("tokens", "n")).alias("replies"))
    names = ["token", "node", "root", "at", "size", *[f"odd{i}" for i in range(WORDS)]]
    return held.join(replies, "batch").select("nodes", "roots", "sizes", "tokens", "replies").mapInArrow(first, ", ".join(f"{c} long" for c in names))


def open_pairs(prefixes: DataFrame, least: float) -> DataFrame:
    """From `rare_prefixes`: pairs (u, v) of texts with different roots that can be similar, by their sizes, by what follows the first hash that they share, and by their parities."""
    shared = prefixes.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    here = materialize(prefixes.join(shared, "token", "left_semi"))
    a, b = (here.select("token", F.struct(*[x for x in here.columns if x != "token"]).alias(c)) for c in "ab")
    common = 1 + F.least(F.col("a.size") - F.col("a.at") - 1, F.col("b.size") - F.col("b.at") - 1)
    sizes = F.least("a.size", "b.size") >= least * F.greatest("a.size", "b.size") - 1e-9
    fits = sizes & (common * (1 + least) >= least * (F.col("a.size") + F.col("b.size")) - 1e-9)
    apart = sum((F.bit_count(F.col(f"a.odd{i}").bitwiseXOR(F.col(f"b.odd{i}"))) for i in range(WORDS)), F.lit(0))
    fits = fits & (apart * (1 + least) <= (1 - least) * (F.col("a.size") + F.col("b.size")) + 1e-9)
    return a.join(b, "token").where("a.node < b.node AND a.root <> b.root").where(fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 6, least: float = 0.8, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id (null last; then by its text's hash), with the columns of docs.

    Near copies are equal texts, and texts whose sets of word shingles have a Jaccard similarity of at least `least`; groups are what such links join.
    Candidates have fingerprints within `radius` bits, or share a band of min-hashes; every link that counts is computed exactly from both texts. Of
    a band, all texts are compared with one of them at first; those of bands that aren't joined by that are compared with all that share one of their
    rarest shingles, which no similar pair can avoid. Texts without words, null or empty, are near copies of each other; a text of any length is read whole; rows that
    repeat id and text are one. Texts are told apart by 128-bit hashes, shingles by 64 bits. An empty table gives an empty table;
    other columns, whatever their names, stay as they are.
    """
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("node"), F.xxhash64(F.lit(1), "text").alias("twin"), "text")
    rows = materialize(described(named, shingle))
    n = rows.count()
    few_texts, few_pairs = n // TEXTS + 1, n // PAIRS + 1
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id")
    whole = materialize(rows.groupBy("node", "twin").agg(F.min("fp").alias("fp"), F.min(own).alias("first"), F.count("*").alias("n"), F.countDistinct("id").alias("ids")), few_texts)
    # Should two texts have the same node, one of them stands for both in links, and both stay.
    texts = materialize(whole.groupBy("node").agg(F.min(F.struct("first", "twin", "fp")).alias("x"), F.count("*").alias("twins")).select("node", "x.first", "x.twin", "x.fp", "twins"), few_texts)
    chosen = materialize(texts.groupBy("fp").agg(F.min("node").alias("chosen")), few_texts)
    ends = [chosen.select(F.col("fp").alias(c), F.col("chosen").alias(f"node_{c}")) for c in "uv"]
    near = links(chosen.select("fp"), radius).join(ends[0], "u").join(ends[1], "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    near = near.unionByName(texts.join(chosen, "fp").where("node <> chosen").select(F.col("node").alias("u"), F.col("chosen").alias("v")))
    keyed = rows.select("node", F.explode("bands").alias("band"))
    shared = materialize(keyed.groupBy("band").agg(F.min("node").alias("star"), F.max("node").alias("last")).where("star <> last").drop("last"), few_texts)
    few = shared.count() * 100 <= broadcast_bytes
    members = materialize(keyed.join(F.broadcast(shared) if few else shared, "band").distinct(), few_texts)
    stars = members.where("node <> star").select(F.col("node").alias("u"), F.col("star").alias("v"))
    ordered = lambda pairs: pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialize(ordered(near.unionByName(stars)), few_texts)
    # Only texts that have a candidate are moved, one row of each.
    asked = materialize(edges.select(F.col("u").alias("node")).union(edges.select("v")).union(members.select("node")).distinct().join(texts, "node").select(F.col("node").alias("_node"), F.col("twin").alias("_twin"), F.col("first.id").alias("_id")), few_texts)
    few = asked.count() * 150 <= broadcast_bytes
    here = named["id"].eqNullSafe(F.col("_id")) & (named["node"] == F.col("_node")) & (named["twin"] == F.col("_twin"))
    read = materialize(named.join(F.broadcast(asked) if few else asked, here, "left_semi").select("node", "text").dropDuplicates(["node"]), few_pairs)
    good = materialize(similar(edges, read, shingle, least), few_pairs)
    roots = components(good, few_texts)
    known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    bands_left = known.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    left = materialize(known.join(bands_left, "band", "left_semi").select("node", "root").distinct(), few_texts)
    if not left.isEmpty():
        prefixes = materialize(rare_prefixes(read.join(left, "node"), shingle, least), few_pairs)
        more = materialize(open_pairs(prefixes, least).join(edges, ["u", "v"], "left_anti"), few_pairs)
        roots = components(good.unionByName(materialize(similar(more, read, shingle, least), few_pairs)), few_texts)
    group = F.coalesce("root", "node").alias("root")
    best = texts.join(roots, "node", "left").select(group, F.struct("first", "node", "twin").alias("k")).groupBy("root").agg(F.min("k").alias("k")).select("k.node", "k.twin", F.col("k.first.id").alias("id"))
    odd = whole.join(texts.where("twins > 1").select("node", F.col("twin").alias("held")), "node").where("twin <> held").select("node", "twin", F.col("first.id").alias("id"))
    keys = materialize(best.unionByName(odd), few_texts)
    again = not whole.where("n > ids").isEmpty()  # rows given more than once, or without ids
    keys = keys.select(F.col("id").alias("_id"), F.col("node").alias("_node"), F.col("twin").alias("_twin"))
    discard(rows, whole, texts, chosen, shared, members, edges, asked, read, left, good)
    out = docs.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_node"]) & (F.xxhash64(F.lit(1), docs["text"]) == keys["_twin"]), "left_semi")
    if not again:
        return out
    first = Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy(F.lit(1))
    return out.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4_simhash(spark, sf_dir):
    """All documents: 4-word shingles, links of at most 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
