"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

States emit word classes (by the last bytes of a word), and a class its words as often as the corpus has them, so the model stays small
however many words there are, while every word's count is exact. Texts are encoded once: chunks of
documents hold the distinct words' hashes and the documents as codes of them. Counts are summed by hash, sent back to the
chunks that ask for them, and never gathered in one place. The states start from classes that have like neighbours, and every round of Baum-Welch
sums the expected counts of all training documents over the chunks by Spark. A text is one sequence, in training and in scoring: the
few very long ones are cut in segments, whose borders get the exact messages from products of the segments' transfer matrices.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .common import discard, materialize, table

STATES, CLASSES = 8, 1024
#: Bytes of text in a chunk; tokens that are trained on at a time.
CHUNK, TOGETHER = 3 << 22, 1 << 18
#: Sequences of more tokens are cut in segments of so many.
LONG, SEGMENT = 2048, 128
#: Rounds of Baum-Welch over all training documents; dimensions in which classes' neighbours are compared.
ROUNDS, SKETCH = 5, 16
END = 0
CHUNK_SCHEMA = "chunk long, train binary, lengths binary, codes binary, hashes binary, classes binary, counts binary"


def classed(tokens: dict) -> np.ndarray:
    """Classes from 1 on, by a word's last three bytes."""
    s, e, b = tokens["start"], tokens["end"], tokens["lower"].astype(np.uint64)
    key = b[e - 1].copy()
    for i in (2, 3):
        long = e - s >= i
        key[long] |= b[e[long] - i] << np.uint64(8 * (i - 1))
    return (1 + ((key * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(CLASSES) >> np.uint64(32))).astype(np.uint16)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and class of every word of a batch of texts, in order."""
    found = []
    for rows, starts, data in th.pieces(column, th.spaced()):
        t = th.tokens(rows, starts, data, th.spaced(), ())
        found.append((t["row"].astype(np.int32), t["hash"], classed(t)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def packed(codes: np.ndarray) -> bytes:
    """Codes as planes of bytes, compressed: most are small."""
    return zstd.ZstdCompressor(level=1).compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encoded(docs: DataFrame) -> DataFrame:
    """Chunks of the documents (id, train, text): ids, and what CHUNK_SCHEMA lists."""

    def chunks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text = batch.column("text")
            _, offsets = th.buffers(text)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                lo = hi
                row, hashes, kinds = words(part.column("text"))
                train = np.asarray(part.column("train").to_numpy(zero_copy_only=False), bool)
                distinct, first, codes, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                codes = rank[codes]
                del hashes
                counts = np.bincount(codes[train[row]], minlength=len(order))
                lengths = np.bincount(row, minlength=len(train)).astype("<i4")
                data = [train.tobytes(), lengths.tobytes(), packed(codes), distinct[order].tobytes(), kinds[first][order].tobytes(), counts.astype("<i8").tobytes()]
                ids = pa.ListArray.from_arrays(pa.array([0, len(train)], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([uuid.uuid4().int >> 65]), *[pa.array([x], pa.binary()) for x in data]], ["ids", *[c.split()[0] for c in CHUNK_SCHEMA.split(", ")]])

    ident = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(chunks, f"ids array<{ident}>, {CHUNK_SCHEMA}")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """hash, class, n: the training words and how often they occur."""

    def counted(batches):
        for batch in batches:
            for hashes, kinds, counts in zip(*[batch.column(i) for i in range(3)], strict=True):
                n = np.frombuffer(counts.as_buffer(), "<i8")
                seen = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), t)[seen].astype(to)) for x, t, to in ((hashes, "<i8", "<i8"), (kinds, "<u2", "<i4"), (counts, "<i8", "<i8"))], ["hash", "class", "n"])

    each = chunks.select("hashes", "classes", "counts").mapInArrow(counted, "hash long, class int, n long")
    return each.groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def answered(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """For each chunk: known, the codes of its words that training has, and known_n, how often it has them."""

    def asked(batches):
        for batch in batches:
            for chunk, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(hashes.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], ["chunk", "code", "hash"])

    def reply(group: pa.Table) -> pa.Table:
        data = [group.column(c).to_numpy().astype(t).tobytes() for c, t in (("code", "<i4"), ("n", "<i8"))]
        return pa.table({"chunk": [group.column("chunk")[0].as_py()], "known": pa.array(data[:1], pa.binary()), "known_n": pa.array(data[1:], pa.binary())})

    questions = chunks.select("chunk", "hashes").mapInArrow(asked, "chunk long, code int, hash long")
    # A chunk has a bounded number of words.
    return questions.join(words.select("hash", "n"), "hash").select("chunk", "code", "n").groupBy("chunk").applyInArrow(reply, "chunk long, known binary, known_n binary")


@dataclass
class Model:
    """first: of a text's first state; move[i, j]: from i to j; emit[class, state]."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.first, self.move, self.emit)])

    @staticmethod
    def shaped(x: np.ndarray) -> Model:
        k = STATES
        return Model(x[:k], x[k : k + k * k].reshape(k, k), x[k + k * k :].reshape(-1, k))

    def learned(self) -> Model:
        """Probabilities from expected counts; a little is added, so that nothing is impossible."""
        norm = lambda x, axis: (x + 1e-3) / (x + 1e-3).sum(axis=axis, keepdims=True)
        return Model(norm(self.first, 0), norm(self.move, 1), norm(self.emit, 0))


def signs() -> np.ndarray:
    """A row of random signs for each class as a neighbour after, and one for each before."""
    return np.random.default_rng(5).integers(0, 2, (2, CLASSES + 1, SKETCH)) * 2.0 - 1


def neighbours(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each class the sums of the signs of the classes that follow and precede it; whole numbers, so that sums of sums are exact."""
    out = np.zeros((CLASSES + 1, 2 * SKETCH))
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(lengths) - 1] = False
    left = np.flatnonzero(inside)
    for side, (x, y) in enumerate(((codes[left], codes[left + 1]), (codes[left + 1], codes[left]))):
        of = signs()[side]
        for d in range(SKETCH):
            out[:, side * SKETCH + d] = np.bincount(x, of[y, d], CLASSES + 1)
    return out.ravel()


def start(counts: np.ndarray, near: np.ndarray | None = None, seed: int = 8) -> Model:
    """States of classes with like neighbours (by k-means, counts as weights), which stay for a while and emit other classes as well."""
    rng = np.random.default_rng(seed)
    emit = (counts[:, None] + 1) * rng.gamma(2.0, 0.5, (CLASSES + 1, STATES))
    seen = np.flatnonzero(counts > 0)
    if near is not None and len(seen) >= STATES:
        x, w = near.reshape(CLASSES + 1, -1)[seen] / counts[seen, None], counts[seen]
        middles = x[[int(w.argmax())]]
        while len(middles) < STATES:  # the heaviest of those that are far from all others
            apart = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2).min(axis=1)
            middles = np.concatenate([middles, x[[int((apart * w).argmax())]]])
        for _ in range(20):
            own = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
            middles = np.stack([np.average(x[own == k], axis=0, weights=w[own == k]) if (own == k).any() else middles[k] for k in range(STATES)])
        emit[seen, own] *= 10
    return Model(np.ones(STATES), np.eye(STATES) * 4 + 1, emit).learned()


def passes(model: Model, out: Model, codes: np.ndarray, begin: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add the expected counts within sequences (longest first) to `out`, but for `first`.

    before: what is known of the states ahead of a sequence's first token; after: the message that its last token gets from behind. Returns
    for each sequence the forward message at its end, what its first token says with all behind it, and its first token's states.
    """
    active = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "left")  # how many are longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    alpha, scale, x = np.empty((at[-1], STATES)), np.empty((at[-1], 1)), np.empty(at[-1], np.int64)
    ends = np.empty((len(n), STATES))
    for t in range(len(active) - 1):
        m, now = active[t], slice(at[t], at[t + 1])
        x[now] = codes[begin[:m] + t]
        a = before * model.emit[x[now]] if t == 0 else (alpha[at[t - 1] : at[t - 1] + m] @ model.move) * model.emit[x[now]]
        scale[now] = c = a.sum(axis=1, keepdims=True)
        alpha[now] = a / c
        ends[active[t + 1] : m] = alpha[at[t] + active[t + 1] : at[t + 1]]
    after = after / (ends * after).sum(axis=1, keepdims=True)
    beta, move = np.zeros((0, STATES)), np.zeros((STATES, STATES))
    for t in range(len(active) - 2, -1, -1):
        m, now = active[t], slice(at[t], at[t + 1])
        if len(beta):
            said = model.emit[x[at[t + 1] : at[t + 2]]] * beta / scale[at[t + 1] : at[t + 2]]
            move += alpha[at[t] : at[t] + len(said)].T @ said
            beta = said @ model.move.T
        if m > len(beta):
            beta = np.concatenate([beta, after[len(beta) : m]])
        alpha[now] *= beta
    out.move[:] += move * model.move
    for k in range(STATES):
        out.emit[:, k] += np.bincount(x, alpha[:, k], CLASSES + 1)
    return ends, model.emit[x[: len(n)]] * beta, alpha[: len(n)]


def transfers(model: Model, codes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments (longest first): the product of all steps, each an emission and a move, and the log of the factor taken out of it."""
    active = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "left")
    out, logs = np.tile(np.eye(STATES), (len(n), 1, 1)), np.zeros(len(n))
    for t in range(len(active) - 1):
        m = active[t]
        out[:m] = ((out[:m] * model.emit[codes[begin[:m] + t]][:, None, :]).reshape(-1, STATES) @ model.move).reshape(m, STATES, STATES)
        if t % 8 == 7 or active[t + 1] < m:
            c = out[:m].sum(axis=(1, 2))
            out[:m] /= c[:, None, None]
            logs[:m] += np.log(c)
    return out, logs


@dataclass
class Segments:
    """Of long sequences: where each segment begins, its length, and its sequence's number; firsts: where each sequence's segments start in these."""

    begin: np.ndarray
    n: np.ndarray
    firsts: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(begin: np.ndarray, n: np.ndarray) -> Segments:
        parts = -(-n // SEGMENT)
        firsts = np.cumsum(parts) - parts
        nth = np.arange(parts.sum()) - np.repeat(firsts, parts)
        starts = np.repeat(begin, parts) + SEGMENT * nth
        return Segments(starts, np.minimum(SEGMENT, np.repeat(begin + n, parts) - starts), firsts, parts)

    def products(self, model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-self.n, kind="stable")
        products, logs = np.empty((len(order), STATES, STATES)), np.empty(len(order))
        for i in range(0, len(order), TOGETHER // SEGMENT):
            some = order[i : i + TOGETHER // SEGMENT]
            products[some], logs[some] = transfers(model, codes, self.begin[some], self.n[some])
        return products, logs

    def ahead(self, model: Model, products: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states expected ahead of each segment, and the log-likelihood of each sequence."""
        before, total = np.empty((len(self.n), STATES)), np.zeros(len(self.parts))
        p = np.tile(model.first, (len(self.parts), 1))
        for j in range(int(self.parts.max(initial=0))):
            own = np.flatnonzero(self.parts > j)
            at = self.firsts[own] + j
            before[at] = p[own]
            through = np.einsum("mi,mij->mj", p[own], products[at])
            c = through.sum(axis=1, keepdims=True)
            p[own] = through / c
            total[own] += np.log(c[:, 0]) + logs[at]
        return before, total

    def behind(self, model: Model, products: np.ndarray) -> np.ndarray:
        """The message that each segment's last token gets."""
        after, b = np.empty((len(self.n), STATES)), np.ones((len(self.parts), STATES))
        for j in range(int(self.parts.max(initial=0)) - 1, -1, -1):
            own = np.flatnonzero(self.parts > j)
            at = self.firsts[own] + j
            after[at] = b[own] @ model.move.T  # of the last segment: ones, as moves add up to 1
            b[own] = np.einsum("mij,mj->mi", products[at], b[own])
            b[own] /= b[own].sum(axis=1, keepdims=True)
        return after


def batches_of(n: np.ndarray) -> list[np.ndarray]:
    """Sequences by falling length, as many at a time as have about TOGETHER tokens."""
    order = np.argsort(-n, kind="stable")
    at = np.cumsum(n[order]) // TOGETHER
    return np.split(order, np.flatnonzero(np.diff(at)) + 1) if len(order) else []


def expected(model: Model, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Baum-Welch's expected counts over whole sequences of classes, laid end to end, each closed by END; flat as a Model."""
    out = Model.shaped(np.zeros(STATES + STATES**2 + (CLASSES + 1) * STATES))
    begins = np.cumsum(lengths) - lengths
    short = np.flatnonzero(lengths <= LONG)
    for some in batches_of(lengths[short]):
        at = short[some]
        ones = np.ones((len(at), STATES))
        out.first[:] += passes(model, out, codes, begins[at], lengths[at], ones * model.first, ones)[2].sum(axis=0)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        cut = Segments.of(begins[long], lengths[long])
        products, logs = cut.products(model, codes)
        before, after = cut.ahead(model, products, logs)[0], cut.behind(model, products)
        del products
        ends, says, firsts = (np.empty((len(cut.n), STATES)) for _ in range(3))
        for some in batches_of(cut.n):
            ends[some], says[some], firsts[some] = passes(model, out, codes, cut.begin[some], cut.n[some], before[some], after[some])
        out.first[:] += firsts[cut.firsts].sum(axis=0)
        inner = np.ones(len(cut.n), bool)
        inner[cut.firsts] = False
        to = np.flatnonzero(inner)
        weight = 1 / np.einsum("mi,ij,mj->m", ends[to - 1], model.move, says[to], optimize=True)
        out.move[:] += (ends[to - 1] * weight[:, None]).T @ says[to] * model.move
    return out.flat()


def likelihoods(model: Model, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of the likelihood of each whole sequence, by the forward recursion, scaled every few steps."""
    begins, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        cut = Segments.of(begins[long], lengths[long])
        out[long] = cut.ahead(model, *cut.products(model, codes))[1]
    short = np.flatnonzero(lengths <= LONG)
    order = short[np.argsort(-lengths[short], kind="stable")]
    begin, n = begins[order], lengths[order]
    logs, alpha = np.zeros(len(order)), np.zeros((len(order), STATES))
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps + 1), "left").tolist()
    for t in range(steps):
        m = active[t]
        alpha = (np.broadcast_to(model.first, (m, STATES)) if t == 0 else alpha[:m] @ model.move) * model.emit[codes[begin[:m] + t]]
        after = active[t + 1]
        if after < m:
            out[order[after:m]] = logs[after:m] + np.log(alpha[after:].sum(axis=1))
        if t % 8 == 7:
            c = alpha.sum(axis=1)
            logs[:m] += np.log(c)
            alpha /= c[:, None]
    return out / math.log(10)


def closed(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences laid end to end with END after each."""
    ends = np.cumsum(lengths)
    return np.insert(codes, ends, END), lengths + 1


def chosen(mask: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(mask, lengths)


def decoded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds = np.frombuffer(row["classes"].as_buffer(), "<u2")
    codes = unpacked(row["codes"].as_buffer())
    return np.frombuffer(row["train"].as_buffer(), bool), np.frombuffer(row["lengths"].as_buffer(), "<i4").astype(np.int64), codes, kinds


def each(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i] for c in batch.schema.names}


def gathered(chunks: DataFrame, size: int, of) -> np.ndarray:
    """The sum of of(codes, lengths), `size` numbers, over the training documents of all chunks."""

    def counts(batches):
        sums = np.zeros(size)
        for batch in batches:
            for row in each(batch):
                mask, lengths, codes, kinds = decoded(row)
                if mask.any():
                    sums += of(*closed(kinds[codes[chosen(mask, lengths)]], lengths[mask]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["i", "x"])

    out = np.zeros(size)
    for r in chunks.select("train", "lengths", "codes", "classes").mapInArrow(counts, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def trained(chunks: DataFrame, by_class: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model after so many rounds over all training documents of the chunks; by_class: how often classes occur."""
    if not by_class.sum():
        return start(by_class)
    model = start(by_class, gathered(chunks, (CLASSES + 1) * 2 * SKETCH, neighbours))
    for _ in range(rounds):
        model = Model.shaped(gathered(chunks, len(model.flat()), lambda codes, lengths, now=model: expected(now, codes, lengths))).learned()
    return model


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text", train=None) -> DataFrame:
    """Return per row: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    `train` marks the rows to learn from (null counts as true). A token is a word in lower case (A-Z), or the end of a text. base_score is the
    log10 probability with every token drawn alone, counts raised by 0.5; score that of the model, where a word unseen in training
    has the 0.5 that its class keeps for all such words. A null or empty text is its end only; a text of any length is one sequence. Rows with equal ids or
    texts are scored one by one, null ids as others; an empty table gives none, and without training rows all words are unseen. Other columns aren't looked at.
    """
    train = F.coalesce(F.lit(True) if train is None else train, F.lit(True))
    rows = docs.select(F.col(ident).alias("id"), train.alias("train"), F.col(text).alias("text"))
    chunks = materialize(encoded(rows))
    known = materialize(vocabulary(chunks))
    by_class = class_counts(rows, known)
    total, distinct = by_class.sum(axis=0).tolist()
    ends = by_class[END, 0]
    model = trained(chunks, by_class[:, 0])

    def scored(batches):
        for batch in batches:
            for row in each(batch):
                mask, lengths, codes, kinds = decoded(row)
                n = np.zeros(len(kinds))
                if row["known"].is_valid:
                    n[np.frombuffer(row["known"].as_buffer(), "<i4")] = np.frombuffer(row["known_n"].as_buffer(), "<i8")
                alone = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
                within = np.log10((n + 0.5) / (by_class[kinds, 0] + 0.5 * (by_class[kinds, 1] + 1)))
                doc = np.repeat(np.arange(len(lengths)), lengths)
                base = np.bincount(doc, alone[codes], len(lengths)) + math.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
                whole = np.bincount(doc, within[codes], len(lengths)) + likelihoods(model, *closed(kinds[codes], lengths))
                seen = np.bincount(doc, n[codes] > 0, len(lengths)).astype(np.int64) + int(ends > 0)
                data = [pa.array(~mask), pa.array(lengths + 1), pa.array(seen), pa.array(np.full(len(lengths), int(total))), pa.array(base), pa.array(whole)]
                yield pa.RecordBatch.from_arrays([row["ids"].values, *data], [ident, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[ident].dataType.simpleString()
    replies = materialize(answered(chunks, known))
    discard(known)
    return chunks.drop("counts", "hashes").join(replies, "chunk", "left").mapInArrow(scored, f"`{ident}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_counts(rows: DataFrame, known: DataFrame) -> np.ndarray:
    """For each class how many training tokens it has, and how many different ones; END is one for each text."""
    by_class = np.zeros((CLASSES + 1, 2))
    for r in known.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        by_class[r["class"]] = r.n, r.v
    ends = rows.where("train").count()
    by_class[END] = ends, ends > 0
    return by_class


def op8_hmm(spark, sf_dir):
    """All documents; learned from those whose crc32 of the id modulo 5 isn't 1."""
    return score(table(spark, sf_dir, "documents"), train=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1)
