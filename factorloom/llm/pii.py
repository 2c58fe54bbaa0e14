"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Patterns find e-mail and IP addresses, card and phone numbers. The field labels every white-space token of every line with
one of LABELS by its shape (which kinds of characters, how long, how many digits and dots), by cue words, and by its
neighbours' shapes; it is trained by gradient steps on the exact likelihood of a small labelled table and decoded by Viterbi for
thousands of lines at a time. It adds what patterns can't say, such as credentials after a cue.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import texthash as th
from .common import table

# What the base kinds are, in the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LABELS = ("other", "email", "ip", "card", "phone", "secret")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back to where its local part can start; so long runs of letters aren't tried from each letter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield found.span()
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def patterns(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind and start; matches that fail a check are dropped."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def plausible(kind: str, span: str) -> bool:
    """Whether a span of the field passes the check that its kind has, if any: numbers that only look like a card's are none."""
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return kind != "ip" or any(k == "ip" for k, _, _ in patterns(span))


def labelled(seed: int = 2, n: int = 400) -> list[list[tuple[str, str]]]:
    """A small labelled table: lines of (token, label), made up from a rule."""
    r = random.Random(seed)
    letters = lambda k, of="etaoinshrdlucmféióäüñ": "".join(r.choice(of) for _ in range(k))
    mark = lambda: r.choice(["", "", "", ".", ",", "!!", "###", "$$$"])
    digits = lambda k: letters(k, "0123456789")
    plain = lambda: r.choice([letters(r.randint(1, 12)), letters(r.randint(10, 30)), letters(r.randint(1, 9)).title(), letters(r.randint(2, 8)).upper(), digits(r.randint(1, 6)), f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{letters(4)}-{letters(3)}", "|"]) + mark()

    def entity() -> list[tuple[str, str]]:
        kind = r.choice(LABELS[1:])
        if kind == "email":
            body = [f"{letters(r.randint(2, 9))}.{digits(2)}@{letters(5)}{digits(1)}.{letters(6)}.com"]
        elif kind == "ip":
            body = [".".join(str(r.randint(0, 255)) for _ in range(4))]
        elif kind == "card":
            body = r.choice([[digits(16)], [digits(4) for _ in range(4)]])
        elif kind == "phone":
            body = r.choice([[f"+{digits(r.randint(1, 2))}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(11)}"], [f"+{digits(2)}", digits(3), digits(4), digits(3)]])
        else:
            value = r.choice([letters(40, "0123456789abcdef"), letters(32, "0123456789abcdef"), letters(r.randint(20, 44), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), "AK" + letters(18, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")])
            value = value.upper() if r.random() < 0.15 else value
            cue = r.choice(["token", "token", "password", "secret", "api_key", "key"])
            cue = cue.upper() if r.random() < 0.15 else cue
            lead = r.choice([[cue, "="], [cue, "="], [f"{cue}:"], [cue, ":"], []])
            return [(w, "other") for w in lead] + [(r.choice([f'"{value}"', value, f"'{value}'"]) + mark(), "secret")]
        body[-1] += mark()
        return [(w, kind) for w in body]

    out = []
    for _ in range(n):
        line = []
        for _ in range(r.randint(0, 3)):
            line += [(plain(), "other") for _ in range(r.randint(1, 10))]
            line += entity() if r.random() < 0.8 else r.choice([[("token", "other"), (letters(5), "other")], [("=", "other"), (digits(3), "other")], [("key", "other")]])
        out.append(line + [(plain(), "other") for _ in range(r.randint(1, 10))])
    return out


def flag_table() -> np.ndarray:
    """By byte: one bit for each kind of character."""
    kinds = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "@", ".", "-_/", "=:", "+", "()", "\"'", "!#$%&*,;|?"]
    out = np.zeros(256, np.uint16)
    for i, chars in enumerate(kinds):
        out[list(chars.encode())] = 1 << i
    out[128:] = 1 << len(kinds)
    return out


@dataclass
class Shapes:
    """Of tokens, in order: row, start, end (bytes of the piece), flags, form (length, digits and dots in steps), hash, and where lines start."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    flags: np.ndarray
    form: np.ndarray
    hash: np.ndarray
    lines: np.ndarray


STEPS = np.array([2, 4, 7, 12, 15, 20, 32])


def shapes(rows: np.ndarray, starts: np.ndarray, data: np.ndarray) -> Shapes | None:
    t = th.tokens(rows, starts, data, th.spaced(), ())
    s, e = t["start"], t["end"]
    if not len(s):
        return None
    flags = np.bitwise_or.reduceat(flag_table()[data], s)
    digits = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int32), s)
    dots = np.add.reduceat((data == 46).astype(np.int32), s)
    form = np.searchsorted(STEPS, e - s) * 32 + np.minimum(np.searchsorted(STEPS, digits), 7) * 4 + np.minimum(dots, 3)
    breaks = np.cumsum(data == 10)
    text = np.searchsorted(starts, s, "right")
    new = np.concatenate([[True], (breaks[s[1:]] != breaks[s[:-1]]) | (text[1:] != text[:-1])])
    return Shapes(t["row"], s, e, flags.astype(np.int64), form, t["hash"], np.flatnonzero(new))


@dataclass
class Field:
    """cues: sorted hashes of cue words. Weights by label: of the flags and form together, of the flags before and after, of cues (0: none) here, before and after; move[i, j]."""

    cues: np.ndarray
    own: np.ndarray
    form: np.ndarray
    before: np.ndarray
    after: np.ndarray
    cue: np.ndarray
    cue_before: np.ndarray
    move: np.ndarray

    def cue_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.cues):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.cues, hashes), len(self.cues) - 1)
        return np.where(self.cues[at] == hashes, at + 1, 0)

    def scores(self, x: Shapes) -> np.ndarray:
        """For each token and label."""
        out = self.own[x.flags] + self.form[x.form]
        first = np.zeros(len(x.row), bool)
        first[x.lines] = True
        inside = np.flatnonzero(~first)
        out[inside] += self.before[x.flags[inside - 1]]
        out[inside - 1] += self.after[x.flags[inside]]
        cue = self.cue_of(x.hash)
        here = np.flatnonzero(cue)
        out[here] += self.cue[cue[here]]
        here = inside[cue[inside - 1] > 0]
        out[here] += self.cue_before[cue[here - 1]]
        return out


def by_step(x: Shapes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lines by falling length: where each starts, its length, and how many are longer than t, for each t."""
    n = np.diff(np.append(x.lines, len(x.row)))
    order = np.argsort(-n, kind="stable")
    n = n[order]
    return x.lines[order], n, np.searchsorted(-n, -np.arange(int(n[0])), "left").tolist()


def viterbi(field: Field, x: Shapes) -> np.ndarray:
    """The most likely labels of all tokens, all lines at a time."""
    score, (begin, n, active) = field.scores(x), by_step(x)
    best, back = score[begin], []
    final = np.zeros((len(begin), len(LABELS)))
    for t in range(1, len(active)):
        m = active[t]
        final[m : len(best)] = best[m:]
        through = best[:m, :, None] + field.move
        came = through.argmax(axis=1)
        best = np.take_along_axis(through, came[:, None, :], axis=1)[:, 0] + score[begin[:m] + t]
        back.append(came.astype(np.int8))
    final[: len(best)] = best
    out = np.zeros(len(x.row), np.int8)
    now = final.argmax(axis=1).astype(np.int8)
    for t in range(len(active) - 1, 0, -1):
        m = active[t]
        out[begin[:m] + t] = now[:m]
        now[:m] = back[t - 1][np.arange(m), now[:m]]
    out[begin] = now
    return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def train(lines: list[list[tuple[str, str]]], rounds: int = 150, rate: float = 0.3, shrink: float = 0.02) -> Field:
    """Maximize the likelihood of the labels by adaptive gradient steps; the gradient comes from forward and backward sums."""
    lines = [line for line in lines if line]
    texts = pa.array([" ".join(w for w, _ in line) for line in lines])
    parts = [shapes(*p) for p in th.pieces(texts)]
    (x,) = [p for p in parts if p is not None]
    y = np.array([LABELS.index(label) for line in lines for _, label in line])
    k = len(LABELS)
    near = Counter()
    for i in np.flatnonzero(y):
        near.update({int(x.hash[j]) for j in (i - 1, i - 2) if j >= 0 and not y[j]})
    cues = np.array(sorted(h for h, n in near.items() if n >= 8), np.uint64)
    zeros = lambda n: np.zeros((n, k))
    field = Field(cues, zeros(4096), zeros(256), zeros(4096), zeros(4096), zeros(len(cues) + 1), zeros(len(cues) + 1), np.zeros((k, k)))
    begin, n, active = by_step(x)
    first = np.zeros(len(y), bool)
    first[x.lines] = True
    inside = np.flatnonzero(~first)
    cue = field.cue_of(x.hash)
    weights = [field.own, field.form, field.before, field.after, field.cue, field.cue_before, field.move]
    squares = [np.full_like(w, 1e-6) for w in weights]
    truth = np.eye(k)[y]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[inside - 1], y[inside]), 1)
    for _ in range(rounds):
        score = field.scores(x)
        alphas = [score[begin]]
        for t in range(1, len(active)):
            alphas.append(lse(alphas[-1][: active[t], :, None] + field.move, 1) + score[begin[: active[t]] + t])
        marginal, moves, beta = np.zeros_like(score), np.zeros((k, k)), np.zeros((0, k))
        total = np.zeros(len(begin))
        for t in range(len(active) - 1, -1, -1):
            m, longer = active[t], len(beta)
            if longer:
                ahead = field.move + (score[begin[:longer] + t + 1] + beta)[:, None, :]
                moves += np.exp(alphas[t][:longer, :, None] + ahead - total[:longer, None, None]).sum(axis=0)
                beta = lse(ahead, 2)
            if m > longer:
                total[longer:m] = lse(alphas[t][longer:m], 1)
                beta = np.concatenate([beta, np.zeros((m - longer, k))])
            marginal[begin[:m] + t] = np.exp(alphas[t] + beta - total[:m, None])
        off = marginal - truth
        grads = []
        for w, ids, rows in ((field.own, x.flags, slice(None)), (field.form, x.form, slice(None)), (field.before, x.flags[inside - 1], inside), (field.after, x.flags[inside], inside - 1), (field.cue, cue, slice(None)), (field.cue_before, cue[inside - 1], inside)):
            g = np.column_stack([np.bincount(ids, off[rows][:, j], len(w)) for j in range(k)])
            if w is field.cue or w is field.cue_before:
                g[0] = 0
            grads.append(g)
        for w, g, s in zip(weights, [*grads, moves - pairs], squares, strict=True):
            g = (g + shrink * w) / len(lines)
            s += g**2
            w -= rate * g / np.sqrt(s)
    return field


TRIM = b"\"'`.,;:!?#$%&*()[]{}<>|"


def added(field: Field, column: pa.Array) -> dict[int, list[tuple[str, int, int]]]:
    """By row: the field's spans, as (label, start, end) in bytes of the row's text, without marks around them."""
    out: dict[int, list[tuple[str, int, int]]] = {}
    _, offsets = th.buffers(column)
    done: dict[int, int] = {}
    for rows, starts, data in th.pieces(column, th.broken()):  # lines stay whole
        x = shapes(rows, starts, data)
        if x is not None:
            labels = viterbi(field, x)
            line = np.zeros(len(x.row), np.int64)
            line[x.lines] = 1
            hits = np.flatnonzero(labels)
            last = -2
            for i in hits.tolist():
                row = int(x.row[i])
                base = int(starts[np.searchsorted(starts, x.start[i], "right") - 1]) - done.get(row, 0)
                s, e = int(x.start[i]), int(x.end[i])
                while s < e and data[s] in TRIM:
                    s += 1
                while e > s and data[e - 1] in TRIM:
                    e -= 1
                if s < e:
                    if i == last + 1 and not line[i] and out.get(row) and out[row][-1][0] == LABELS[labels[i]] and labels[i] == labels[last]:
                        out[row][-1] = (LABELS[labels[i]], out[row][-1][1], e - base)
                    else:
                        out.setdefault(row, []).append((LABELS[labels[i]], s - base, e - base))
                    last = i
        if len(rows) == 1:  # a long text may go on in the next piece
            done[int(rows[0])] = done.get(int(rows[0]), 0) + len(data)
    return out


def find(docs: DataFrame, field: Field, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Return per row: its id, n_email, n_ip, n_card, n_phone, n_added, base_sha256 and spans (kind:start:end, code points).

    Base spans are all kept; a span of the field is added if it overlaps none. A null text is empty and has none. A line of any length is decoded
    as one sequence, a text of any length whole. Rows with equal texts get equal results, null and repeated ids are as good as others; an empty table gives
    none; other columns aren't looked at.
    """

    def found(batches: Iterator[pa.RecordBatch]):
        kinds = [*BASE, *[x for x in LABELS[1:] if x not in BASE]]
        for batch in batches:
            column = batch.column("text")
            more, rows = added(field, column), []
            for i, value in enumerate(column):
                text = value.as_py() or ""
                base = patterns(text)
                counts = Counter(k for k, _, _ in base)
                extra = []
                if i in more:
                    data = text.encode()
                    place, at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), np.zeros(len(text) + 1, bool)
                    for _, s, e in base:
                        at[s:e] = True
                    for kind, s, e in more[i]:
                        s, e = int(place[s]) - 1, int(place[e - 1])
                        if not at[s:e].any() and plausible(kind, text[s:e]):
                            extra.append((kind, s, e))
                say = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                rows.append((*[counts[k] for k in BASE], len(extra), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + extra, key=lambda x: (kinds.index(x[0]), x[1], x[2])))))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), pa.string() if j > 4 else pa.int64()) for j, c in enumerate(columns)]], ["id", *names])

    names = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.selectExpr(f"`{ident}` AS id", f"`{text}` AS text").mapInArrow(found, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
    return rows.withColumnRenamed("id", ident)


@functools.cache
def default_field() -> Field:
    """Trained on the made-up table of `labelled`."""
    return train(labelled())


def op2_pii(spark, sf_dir):
    """All documents, with the default field."""
    return find(table(spark, sf_dir, "documents"), default_field())
