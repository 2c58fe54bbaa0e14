"""A quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight for each hashed text feature and differ by ordered thresholds, P(grade >= k) =
sigmoid(score - threshold[k]); so a document gets an expected grade, and the tail probability of the top grade
selects. Features are the hashes of a text's words, word beginnings and runs of marks, each counted once, and of
a few shares (repeated words, capitals, marks) in steps. Hashes have 64 bits and the model holds only those that
say something about the grade, so that rare words don't share a weight with telling ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .common import discard, materialize, schema_with, table

#: Labelled rows to fit on, those with the smallest hashes of their ids; of these, as many as have so many bytes of text together.
SAMPLE, SAMPLE_BYTES = 6000, 1 << 26
ADDED = ("expected_grade", "p_middle", "p_top", "selected")
STEPS = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8])


@dataclass
class Ordinal:
    """hashes, sorted, and their weights; thresholds[k - 1] is for grade >= k."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (rows, hashes) until all features of a batch of texts were given; a row may have a hash more than once."""
    n = len(column)
    count = {k: np.zeros(n) for k in ("words", "marks", "again", "letters", "capitals")}
    for rows, starts, data in th.pieces(column):
        t = th.tokens(rows, starts, data)
        yield t["row"], t["hash"]
        for at, hashes in t["begin"].values():
            yield t["row"][at], hashes
        word = t["kind"] == th.WORD
        row, hashes = t["row"][word], t["hash"][word]
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        lengths = np.diff(np.append(starts, len(data)))
        at = np.repeat(rows, lengths)
        count["words"] += np.bincount(row, minlength=n)
        count["marks"] += np.bincount(t["row"][~word], minlength=n)
        count["again"] += np.bincount(row[1:][same], minlength=n)
        capital = (data >= 65) & (data <= 90)
        count["capitals"] += np.bincount(at[capital], minlength=n)
        count["letters"] += np.bincount(at[(data >= 97) & (data <= 122) | capital], minlength=n)
    for i, (part, whole) in enumerate((("again", "words"), ("capitals", "letters"), ("marks", "words"))):
        step = np.searchsorted(STEPS, count[part] / np.maximum(count[whole], 1))
        yield np.arange(n), th.mixed(np.uint64(1000 * (i + 1)) + step.astype(np.uint64))


def sampled(docs: DataFrame, labels: DataFrame, limit: int, limit_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Grades and features of at most `limit` labelled documents, brought to the driver. Rows that repeat id and text count once."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    grade = (F.col("quality") != 0).cast("int") + (F.coalesce(F.col("toxic"), F.lit(0)) == 0).cast("int")
    some = rated.groupBy("doc_id").agg(F.min(grade).alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").join(F.broadcast(some), "doc_id")
    held = materialize(texts.groupBy("doc_id", "tie", "grade").agg(F.first("text").alias("text")))
    order = held.select("doc_id", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "tie").limit(limit)
    chosen = order.collect()
    most = int(np.searchsorted(np.cumsum([r.n for r in chosen]), limit_bytes, "right"))

    def hashed(batches):
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for rows, hashes in features(batch.column("text")):
                order = np.argsort(rows, kind="stable")
                for row, part in zip(*grouped(rows[order], hashes[order]), strict=True):
                    found[row].append(part)
            sets = [np.unique(np.concatenate(x)).tobytes() if x else b"" for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(sets, pa.binary())], ["grade", "hashes"])

    keys = docs.sparkSession.createDataFrame([(r.doc_id, r.tie) for r in chosen[:most]], schema_with(order, ["doc_id", "tie"], ""))
    rows = held.join(F.broadcast(keys), ["doc_id", "tie"]).select("grade", "text").mapInArrow(hashed, "grade int, hashes binary").collect()
    discard(held)
    rows.sort(key=lambda r: hashlib.md5(bytes(r.hashes)).digest())  # the same order on every run
    return np.array([r.grade for r in rows]), [np.frombuffer(r.hashes, np.uint64) for r in rows]


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Split values where sorted keys change."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cuts])] if len(keys) else keys, np.split(values, cuts) if len(keys) else []


def counted(sets: list[np.ndarray], values: np.ndarray, parts: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of all sets, sorted, how many sets have each, and the sum of these sets' values; by ranges of hashes, for less memory."""
    out = []
    edges = [np.array([np.searchsorted(s, np.uint64(i << 60)) for i in range(1, parts)]) for s in sets]
    cuts = [np.concatenate([[0], e, [len(s)]]) for e, s in zip(edges, sets, strict=True)]
    for i in range(parts):
        pieces = [s[c[i] : c[i + 1]] for s, c in zip(sets, cuts, strict=True)]
        hashes, at = np.unique(np.concatenate(pieces), return_inverse=True)
        out.append((hashes, np.bincount(at, minlength=len(hashes)), np.bincount(at, np.repeat(values, [len(p) for p in pieces]), len(hashes))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def fit(grades: np.ndarray, sets: list[np.ndarray], top: int = 2, least_z: float = 3.5, rounds: int = 800, shrink: float = 0.01) -> Ordinal:
    """Fit by adaptive gradient steps on the features whose documents' mean grade is low by `least_z` standard errors.

    Weights can only lower a score: else the many common words of a long text outvote the few that tell against it.
    Without rows, or with one grade only, there are no weights and every text gets the top grade, or that one.
    """
    if not len(grades) or grades.min() == grades.max():
        seen = int(grades[0]) if len(grades) else top
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.where(np.arange(1, top + 1) <= seen, -20.0, 20.0))
    hashes, n, apart = counted(sets, grades - grades.mean())
    kept = np.flatnonzero((-apart / (np.sqrt(n) * grades.std()) >= least_z) & (n >= 3))
    hashes = hashes[kept]
    found = [np.searchsorted(hashes, s[np.isin(s, hashes, assume_unique=True)]) for s in sets]
    col = np.concatenate(found)
    doc = np.repeat(np.arange(len(sets)), [len(f) for f in found])
    w = np.zeros(len(kept))
    share = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    b = -np.log(share / (1 - share))
    sw, sb = np.full(len(w), 1e-8), np.full(top, 1e-8)
    edge = np.column_stack([np.full(len(grades), np.inf), np.zeros((len(grades), top)), np.full(len(grades), -np.inf)])
    mine = np.arange(len(grades))
    for _ in range(rounds):
        s = np.bincount(doc, w[col], len(grades))
        edge[:, 1:-1] = s[:, None] - b
        upper, lower = 1 / (1 + np.exp(-np.clip(edge[mine, grades], -40, 40))), 1 / (1 + np.exp(-np.clip(edge[mine, grades + 1], -40, 40)))
        likely = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        du[grades == 0] = dl[grades == top] = 0
        gs = (dl - du) / len(grades)  # of the negative log-likelihood
        gb = np.array([du[grades == k].sum() - dl[grades == k - 1].sum() for k in range(1, top + 1)]) / len(grades)
        gw = np.bincount(col, gs[doc], len(w)) + shrink * w / len(grades)
        sw += gw**2
        sb += gb**2
        w = np.minimum(w - 0.1 * gw / np.sqrt(sw), 0)
        b = np.maximum.accumulate(b - 0.1 * gb / np.sqrt(sb))
    return Ordinal(hashes, w, b)


def cut(grades: np.ndarray, sets: list[np.ndarray], model: Ordinal, top: int = 2, harm: float = 4, folds: int = 5) -> float:
    """The least tail probability of the top grade to select: as a share of the model's for a text without telling features, the one that rejects most
    documents of lower grades, less `harm` times those of the top grade, where each fold of the sample is judged by a trial model of the others; a half if there is nothing to go by."""
    share, fold = np.ones(len(grades)), np.arange(len(grades)) % folds
    for k in range(folds):
        seen, aside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(seen) < 50 or grades[seen].min() == grades[seen].max():
            return 0.5
        trial = fit(grades[seen], [sets[i] for i in seen], top, rounds=300)
        weights = np.array([trial.weights[np.isin(trial.hashes, sets[i], assume_unique=True)].sum() for i in aside])
        share[aside] = trial.tails(weights)[:, -1] / trial.tails(np.zeros(1))[0, -1]
    tries = np.linspace(0.3, 1, 71)
    gain = np.array([(grades[share < t] < top).sum() - harm * (grades[share < t] == top).sum() for t in tries])
    if gain.max() <= 0:
        return 0.5
    return float(tries[np.flatnonzero(gain == gain.max())[-1]] * model.tails(np.zeros(1))[0, -1])


def scores(model: Ordinal, column: pa.Array) -> np.ndarray:
    """The sum of the weights of the features that each text has."""
    out = np.zeros(len(column))
    if not len(model.hashes):
        return out
    shift = np.uint64(42)
    maybe = np.zeros(1 << 22, bool)
    maybe[model.hashes >> shift] = True
    found_rows, found_at = [], []
    for rows, hashes in features(column):
        close = np.flatnonzero(maybe[hashes >> shift])
        at = np.minimum(np.searchsorted(model.hashes, hashes[close]), len(model.hashes) - 1)
        hit = model.hashes[at] == hashes[close]
        found_rows.append(rows[close][hit])
        found_at.append(at[hit])
    once = np.unique(np.concatenate(found_rows).astype(np.int64) * len(model.hashes) + np.concatenate(found_at))
    rows, at = np.divmod(once, len(model.hashes))
    return np.bincount(rows, model.weights[at], len(column))


def rater(docs: DataFrame, labels: DataFrame, least: float | None, limit: int):
    """A function from a batch of texts to their tail probabilities and whether they are selected."""
    sample = sampled(docs, labels, limit)
    model = fit(*sample)
    least = cut(*sample, model) if least is None else least

    def rated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tails = model.tails(scores(model, column))
        return tails, tails[:, -1] >= least

    return rated


def rate(docs: DataFrame, labels: DataFrame, least: float | None = None, limit: int = SAMPLE) -> DataFrame:
    """docs with expected_grade, p_middle (P(grade >= 1)), p_top (P(grade >= 2)) and selected (p_top >= least), in place of columns of these names.

    The grade is the number of good ratings a document has: quality not 0, and not toxic; `least` is as `cut` finds it if not given. A null
    text is an empty one, and as any text without telling features it gets the sample's shares; rows with equal texts get equal results.
    Labels with null ids or null quality are left out, of several for an id the lowest grade counts, a null toxic is 0; documents without an id are rated as others.
    A text of any length is read whole. Without labels all are selected; an empty table gives none; other columns stay as they are.
    """
    rated = rater(docs, labels, least, limit)
    kept = [c for c in docs.columns if c not in ADDED]

    def added(batches):
        for batch in batches:
            tails, good = rated(batch.column("text"))
            new = [pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(good)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *ADDED])

    return docs.select(kept).mapInArrow(added, schema_with(docs, kept, "expected_grade double, p_middle double, p_top double, selected boolean"))


def select(docs: DataFrame, labels: DataFrame, least: float | None = None, limit: int = SAMPLE) -> DataFrame:
    """The rows of docs that `rate` selects, with the columns of docs."""
    rated = rater(docs, labels, least, limit)

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(rated(batch.column("text"))[1]))

    return docs.mapInArrow(chosen, docs.schema)


def op6_quality(spark, sf_dir):
    """All documents, rated by a model fitted on at most SAMPLE rows of labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs, table(spark, sf_dir, "labels")).drop("text")
