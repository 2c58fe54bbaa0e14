"""Hashes of words and word beginnings, for whole Arrow batches of texts at once, without a Python step for each word."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; longer texts are cut at white space, or where asked for.
PIECE = 1 << 20
#: Lengths in bytes of the word beginnings that are hashed besides words.
BEGINNINGS = (5, 6, 7, 8)
#: An odd multiplier: its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
SPACE, WORD, MARK = 0, 1, 2


@functools.cache
def classes() -> np.ndarray:
    """By byte: white space and controls, parts of words (0-9, A-Z, a-z, beyond ASCII), other marks."""
    kind = np.full(256, MARK, np.uint8)
    kind[:33] = kind[127] = SPACE
    kind[128:] = WORD
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        kind[lo:hi] = WORD
    return kind


@functools.cache
def spaced() -> np.ndarray:
    """By byte: ASCII white space, or part of a word that ends there."""
    kind = np.full(256, WORD, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    return kind


@functools.cache
def broken() -> np.ndarray:
    """By byte: a line break, or part of a line."""
    kind = np.full(256, WORD, np.uint8)
    kind[10] = SPACE
    return kind


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, table: np.ndarray | None = None):
    """Yield (rows, starts, bytes): texts or parts of texts, where each begins, and their row numbers."""
    table = classes() if table is None else table
    data, offsets = buffers(column)
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= PIECE:
            if hi > lo:
                yield np.arange(row, last), offsets[row:last] - lo, data[lo:hi]
        else:  # one long text
            while lo < hi:
                cut = min(hi, lo + PIECE)
                if cut < hi:
                    spaces = np.flatnonzero(table[data[lo:cut]] == SPACE)
                    if len(spaces):
                        cut = lo + int(spaces[-1]) + 1
                    else:
                        spaces = np.flatnonzero(table[data[cut:hi]] == SPACE)
                        cut = cut + int(spaces[0]) + 1 if len(spaces) else hi
                yield np.array([row]), np.zeros(1, np.int64), data[lo:cut]
                lo = cut
        row = last


def tokens(rows: np.ndarray, starts: np.ndarray, data: np.ndarray, table: np.ndarray | None = None, beginnings: tuple[int, ...] = BEGINNINGS) -> dict:
    """Of each run of word bytes or of marks: row, kind, start, end, hash; A-Z count as a-z (`lower` has the bytes). begin: hashes of beginnings, by length."""
    kind = (classes() if table is None else table)[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[starts[starts < len(data)]] = True
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(data))
    held = kind[edges] != SPACE
    s, e = edges[held], ends[held]
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    up, down = powers(PIECE if len(data) <= PIECE else len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    back = down[s]
    out = {"row": rows[np.searchsorted(starts, s, "right") - 1], "kind": kind[s], "start": s, "end": e, "hash": mixed((total[e] - total[s]) * back), "begin": {}, "lower": lower}
    for n in beginnings:
        long = np.flatnonzero(e - s > n)
        out["begin"][n] = long, mixed((total[s[long] + n] - total[s[long]]) * back[long] + np.uint64(n))
    return out


# The multipliers of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, by: int) -> np.ndarray:
    """Bits turned to the left."""
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of parts of a buffer, which may overlap; all at once, lane by lane. The buffer needs 8 spare bytes at its end."""
    at = lambda i, of: np.ndarray((len(data) - 7,), of, data, 0, (1,))[i]  # noqa: E731  any byte may begin a word
    seed = np.uint64(seed)
    here, left = starts.copy(), lengths.copy()
    h = np.full(len(starts), seed + P5)
    long = np.flatnonzero(left >= 32)
    if len(long):
        of = np.full(4, seed) + np.array([P1, P2, 0, ~P1], np.uint64) + np.array([P2, 0, 0, 1], np.uint64)
        lanes = np.tile(of[:, None], (1, len(long)))
        some = np.arange(len(long))
        while len(some):
            i = here[long[some]]
            for lane in range(4):
                lanes[lane, some] = turned(lanes[lane, some] + at(i + 8 * lane, "<u8") * P2, 31) * P1
            here[long[some]] += 32
            left[long[some]] -= 32
            some = some[left[long[some]] >= 32]
        whole = turned(lanes[0], 1) + turned(lanes[1], 7) + turned(lanes[2], 12) + turned(lanes[3], 18)
        for lane in lanes:
            whole = (whole ^ turned(lane * P2, 31) * P1) * P1 + P4
        h[long] = whole
    h += lengths.astype(np.uint64)
    some = np.flatnonzero(left >= 8)
    while len(some):
        h[some] = turned(h[some] ^ turned(at(here[some], "<u8") * P2, 31) * P1, 27) * P1 + P4
        here[some] += 8
        left[some] -= 8
        some = some[left[some] >= 8]
    some = np.flatnonzero(left >= 4)
    h[some] = turned(h[some] ^ at(here[some], "<u4").astype(np.uint64) * P1, 23) * P2 + P3
    here[some] += 4
    left[some] -= 4
    for k in range(3):
        some = np.flatnonzero(left > k)
        h[some] = turned(h[some] ^ data[here[some] + k].astype(np.uint64) * P5, 11) * P1
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def shingles(column: pa.Array, size: int, together: int = 1 << 16):
    """Yield (row, hashes) of every text of a batch: the XXH64 (seed 42) of all its shingles of `size` words, in order, repeats included; of all words if there are fewer.

    A-Z count as a-z, words end at ASCII white space and are joined by one space. About `together` bytes of text are hashed at a time.
    """
    data, offsets = buffers(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + together, "right")) - 1)
        part = data[offsets[row] : offsets[last]]
        lower = part + ((part >= 65) & (part <= 90)) * np.uint8(32)
        kept = spaced()[part] != SPACE
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        begins = offsets[row:last] - offsets[row]
        begins = begins[begins < len(part)]
        first[begins] = kept[begins]
        # Every word is copied with one space before it.
        starts = np.flatnonzero(first)
        place = np.cumsum(kept) + np.cumsum(first) - 1
        joined = np.full(int(kept.sum()) + len(starts) + 8, 32, np.uint8)
        joined[place[kept]] = lower[kept]
        at = place[starts]
        ends = np.append(at[1:], len(joined) - 7)[: len(at)] - 1  # of each word
        of = np.searchsorted(offsets[row : last + 1] - offsets[row], starts, "right") - 1
        n = np.bincount(of, minlength=last - row)
        opened = np.cumsum(n) - n
        many = np.maximum(n - size + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(last - row), many)
        word = opened[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        final = np.minimum(word + size, (opened + n)[text]) - 1
        found = xxh64(joined, at[word], ends[final] - at[word])
        cuts = np.cumsum(many)
        for i in range(last - row):
            yield row + i, found[cuts[i] - many[i] : cuts[i]]
        row = last
