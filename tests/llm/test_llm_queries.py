"""Each query on small tables with every odd case, against a plain version of its contract."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard as zstd
from odd_tables import documents
from pyspark.sql import functions as F
from test_llm_parts import plain_expected

import corpus_pipeline
from factorloom.llm import decontamination, hmm, langid, pii, quality, queries

DOCS = documents()
WHITE = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(spark, name, path):
    return queries.QUERIES[name](spark, path).collect()


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def text(d):
    return d[1] or ""


def test_op1(spark, mixed):
    wanted = []
    for d in DOCS:
        data = text(d).encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        wanted.append((d[0], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    found = rows(spark, "op1_ogg", mixed)
    same([tuple(r)[:5] for r in found], wanted)
    media = defaultdict(set)
    for r in found:
        media[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
        assert r.media_bytes > r.payload_bytes
    assert all(len(x) == 1 for x in media.values())


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_op2(spark, mixed):
    found = rows(spark, "op2_pii", mixed)
    wanted = []
    for d in DOCS:
        spans = base_spans(text(d))
        n = Counter(k for k, _, _ in spans)
        wanted.append((d[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found], wanted)
    by = {d[0]: text(d) for d in DOCS}
    secrets = 0
    for r in found:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        if r.doc_id is not None:
            assert set(base_spans(by[r.doc_id])) <= set(spans)
            secrets += sum(re.fullmatch("[0-9a-f]{40}", by[r.doc_id][s:e]) is not None for k, s, e in spans if k == "secret")
    assert secrets == sum("token = " in text(d) for d in DOCS)


def field_spans(field, t):
    """The field's spans of a text, line by line and token by token."""
    out, at, data = [], 0, t.encode()
    for line in data.split(b"\n"):
        words = list(WHITE.finditer(line))
        if words:
            x = pii.shapes(np.zeros(1, np.int64), np.zeros(1, np.int64), np.frombuffer(line, np.uint8))
            score = field.scores(x)
            best, back = score[0], []
            for s in score[1:]:
                through = best[:, None] + field.move
                back.append(through.argmax(axis=0))
                best = through.max(axis=0) + s
            labels = [int(best.argmax())]
            for b in reversed(back):
                labels.append(int(b[labels[-1]]))
            last = None
            for i, (m, label) in enumerate(zip(words, reversed(labels), strict=True)):
                s, e = m.span()
                while s < e and line[s] in pii.TRIM:
                    s += 1
                while e > s and line[e - 1] in pii.TRIM:
                    e -= 1
                if label and s < e:
                    if last == (i - 1, label):
                        out[-1] = (out[-1][0], out[-1][1], at + e)
                    else:
                        out.append((pii.LABELS[label], at + s, at + e))
                    last = i, label
        at += len(line) + 1
    return [(k, len(data[:s].decode()), len(data[:e].decode())) for k, s, e in out]


def test_op2_by_brute_force(spark, mixed):
    """All spans, with those that the field adds, from the best path of every whole line."""
    field, kinds = pii.default_field(), [*pii.BASE, "secret"]
    wanted = []
    for d in DOCS:
        base = base_spans(text(d))
        more = [x for x in field_spans(field, text(d)) if not any(s < x[2] and x[1] < e for _, s, e in base) and pii.plausible(x[0], text(d)[x[1] : x[2]])]
        wanted.append((d[0], ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(base + more, key=lambda x: (kinds.index(x[0]), x[1], x[2])))))
    same([(r.doc_id, r.spans) for r in rows(spark, "op2_pii", mixed)], wanted)


def test_op3(spark, mixed):
    found = rows(spark, "op3_warc", mixed)
    pages = [tuple(r) for r in spark.read.parquet(f"{mixed}/pages.parquet").collect()]
    latest = defaultdict(list)
    for i, _, html in pages:
        latest[html or ""].append(i)
    wanted = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = max((x for x in latest[html or ""] if x is not None), default=None)
        revisit = len(data) >= 1000 and i != top
        wanted.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    same([tuple(r)[:5] for r in found], wanted)


def hamming_components(prints):
    parent = {i: i for i in range(len(prints))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def simhash(t, k=4):
    words = [w.lower() for w in WHITE.findall(t.encode())]
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op4(spark, mixed):
    prints = [simhash(text(d)) for d in DOCS]
    group = hamming_components(prints)
    first = {g: min((DOCS[i][0] for i in range(len(DOCS)) if group[i] == g and DOCS[i][0] is not None), default=None) for g in set(group)}
    same([tuple(r) for r in rows(spark, "op4_simhash", mixed)], [(d[0], f"{p:016x}", first[g]) for d, p, g in zip(DOCS, prints, group, strict=True)])


def test_op5(spark, mixed):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: pattern.findall((t or "").translate(lower))
    bench = [(r[0], words(r[1])) for r in spark.read.parquet(f"{mixed}/benchmark.parquet").collect()]
    wanted = []
    for d in DOCS:
        w, hit, items = words(d[1]), set(), set()
        for item, b in bench:
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            at = [i for i in range(len(w) - n + 1) if windows and tuple(w[i : i + n]) in windows]
            hit |= {i + j for i in at for j in range(n)}
            if at and item is not None:
                items.add(str(item))
        wanted.append((d[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    same([tuple(r) for r in rows(spark, "op5_decontamination", mixed)], wanted)
    docs, items = (spark.read.parquet(f"{mixed}/{t}.parquet") for t in ("documents", "benchmark"))
    shuffled = decontamination.decontaminate(docs, items, broadcast_bytes=0).collect()
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in shuffled], wanted)


def test_op6(spark, mixed):
    found = rows(spark, "op6_quality", mixed)
    assert len(found) == len(DOCS)
    assert all(0 <= r.p_top <= r.p_middle <= 1 and abs(r.expected_grade - r.p_top - r.p_middle) < 1e-9 for r in found)
    junk = {d[0] for d in DOCS if " | " in text(d)}
    assert {r.doc_id for r in found if r.doc_id is not None and not r.selected} == junk


MASK = (1 << 64) - 1


def spread(x):
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def hashed(word, n=0):
    """The hash of a word, or of its first n bytes, letter by letter."""
    part = word[:n] if n else word
    return spread((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(part)) + n) & MASK)


def plain_features(t):
    """The features of a text, token by token: words, their beginnings, runs of marks, and three shares."""
    data = t.encode()
    found, words, marks, again, last = set(), 0, 0, 0, None
    for m in re.finditer(rb"([0-9A-Za-z\x80-\xff]+)|([^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+)", data):
        w = m[0].lower()
        found |= {hashed(w)} | {hashed(w, n) for n in (5, 6, 7, 8) if len(w) > n}
        if m[1]:
            words, again, last = words + 1, again + (w == last), w
        else:
            marks += 1
    capitals, letters = (len(re.findall(p, data)) for p in (rb"[A-Z]", rb"[A-Za-z]"))
    steps = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
    for i, (part, whole) in enumerate(((again, words), (capitals, letters), (marks, words))):
        found.add(spread(1000 * (i + 1) + sum(part / max(whole, 1) > s for s in steps)))
    return found


def test_op6_by_brute_force(spark, mixed):
    """The sample, the model's fit and every row's grades, computed again token by token and row by row."""
    docs, labels = (spark.read.parquet(f"{mixed}/{t}.parquet") for t in ("documents", "labels"))
    grades, sets = quality.sampled(docs, labels, quality.SAMPLE)
    rated = defaultdict(list)
    for i, good, toxic in (tuple(r)[:3] for r in labels.collect()):
        if i is not None and good is not None:
            rated[i].append((good != 0) + ((toxic or 0) == 0))
    wanted = sorted((min(rated[d]), sorted(plain_features(t or ""))) for d, t in {d[:2] for d in DOCS} if d in rated)
    assert sorted((g, s.tolist()) for g, s in zip(grades.tolist(), sets, strict=True)) == wanted
    model = quality.fit(grades, sets)
    least = quality.cut(grades, sets, model)
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))

    def loss(weights, b):
        total = sum(0.005 * w * w for w in weights.values())
        for g, s in zip(grades.tolist(), sets, strict=True):
            x = sum(weights.get(h, 0) for h in s.tolist())
            edges = [1.0, *[1 / (1 + math.exp(t - x)) for t in b], 0.0]
            total -= math.log(max(edges[g] - edges[g + 1], 1e-300))
        return total

    best, b = loss(weights, model.thresholds.tolist()), model.thresholds.tolist()
    assert b == sorted(b) and max(weights.values(), default=0) <= 0
    for k in range(2):
        assert all(loss(weights, [x + d * (i == k) for i, x in enumerate(b)]) > best - 0.02 for d in (-0.3, 0.3))
    for h in list(weights)[:10]:
        assert all(loss(weights | {h: min(0, weights[h] + d)}, b) > best - 0.02 for d in (-0.3, 0.3))
    by = {}
    for d in DOCS:
        x = sum(weights.get(h, 0) for h in plain_features(text(d)))
        by[d[0], d[1]] = [1 / (1 + math.exp(t - x)) for t in b]
    found = [tuple(r) for r in rows(spark, "op6_quality", mixed)]
    names = [c for c in queries.QUERIES["op6_quality"](spark, mixed).columns]
    got = sorted(f"{r[names.index('doc_id')]} {r[names.index('p_middle')]:.9f} {r[names.index('p_top')]:.9f} {r[names.index('selected')]}" for r in found)
    assert got == sorted(f"{d[0]} {by[d[0], d[1]][0]:.9f} {by[d[0], d[1]][1]:.9f} {by[d[0], d[1]][1] >= least}" for d in DOCS)


def test_op7(spark, mixed):
    """What must hold of any result: lines go only, first copies stay, the shared passage stays once, rows with equal texts agree."""
    found = rows(spark, "op7_linededup", mixed)
    assert len(found) == len(DOCS)
    by = {(d[0], d[1]): d for d in DOCS}
    shared = [d[1].rsplit("\n", 5)[1:] for d in DOCS[:60] if d[0] % 10 == 5][0]
    assert sum(shared[1] in (r.text or "").split("\n") for r in found) == 1
    kept = Counter()
    for r in found:
        whole = next(d for k, d in by.items() if k[0] == r.doc_id and (k[1] is None) == (r.text is None))
        if r.text is not None:
            lines, all_lines = r.text.split("\n") if r.n_lines > r.n_removed else [], whole[1].split("\n")
            assert r.n_lines == len(all_lines) and len(lines) == r.n_lines - r.n_removed
            it = iter(all_lines)
            assert all(line in it for line in lines)
            kept.update(x for x in lines if len(x) >= 100)
    copies = Counter((r.doc_id, r.text) for r in found)
    assert all(n == 1 or copies[c] <= 3 for c, n in copies.items())
    assert all(n <= 3 for n in kept.values())


def shingles(t, k=5):
    words = [w.lower() for w in WHITE.findall(t.encode())]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def tokens(t):
    return [w.lower() for w in WHITE.findall(t.encode())] + [None]


def test_op8(spark, mixed):
    held = lambda d: d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 1
    c = Counter(w for d in DOCS if not held(d) for w in tokens(text(d)))
    n, v = sum(c.values()), len(c)
    wanted, found = [], rows(spark, "op8_hmm", mixed)
    for d in DOCS:
        t = tokens(text(d))
        wanted.append((d[0], held(d), len(t), sum(c[w] > 0 for w in t), n, f"{sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t):.6f}"))
    same([(*tuple(r)[:5], f"{r.base_score:.6f}") for r in found], wanted)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert sum(r.score - r.base_score for r in found) > 0


def test_op8_by_brute_force(spark, mixed):
    """Training over chunks, and every score, computed again sequence by sequence and word by word."""
    held = lambda d: d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 1
    kind = lambda w: 0 if w is None else 1 + ((sum(b << 8 * i for i, b in enumerate(w[::-1][:3])) * 2654435761 & 0xFFFFFFFF) * hmm.CLASSES >> 32)
    train = [tokens(text(d)) for d in DOCS if not held(d)]
    c = Counter(w for t in train for w in t)
    n, v = np.zeros(hmm.CLASSES + 1), np.zeros(hmm.CLASSES + 1)
    for w, k in c.items():
        n[kind(w)] += k
        v[kind(w)] += 1
    codes, lengths = np.array([kind(w) for t in train for w in t]), np.array([len(t) for t in train])
    near, (after, before) = np.zeros((hmm.CLASSES + 1, 2 * hmm.SKETCH)), hmm.signs()
    for t in train:
        for a, b in itertools.pairwise(map(kind, t)):
            near[a, : hmm.SKETCH] += after[b]
            near[b, hmm.SKETCH :] += before[a]
    model = hmm.start(n, near)
    for _ in range(hmm.ROUNDS):
        model = hmm.Model.shaped(plain_expected(model, codes, lengths)[0]).learned()
    wanted = []
    for d in DOCS:
        t = tokens(text(d))
        k = np.array([kind(w) for w in t])
        own = sum(math.log10((c[w] + 0.5) / (n[kind(w)] + 0.5 * (v[kind(w)] + 1))) for w in t[:-1])
        wanted.append((d[0], len(t), f"{own + plain_expected(model, k, np.array([len(k)]))[1][0]:.4f}"))
    same([(r.doc_id, r.n_tokens, f"{r.score:.4f}") for r in rows(spark, "op8_hmm", mixed)], wanted)


def test_op9(spark, mixed):
    found = rows(spark, "op9_mixing", mixed)
    sizes = Counter()
    for d in DOCS:
        sizes[d[3]] += len(WHITE.findall(text(d).encode()))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    target |= share
    by = Counter((d[0], d[3], len(WHITE.findall(text(d).encode()))) for d in DOCS)
    taken, total = Counter(), Counter()
    source = {(d[0], len(WHITE.findall(text(d).encode()))): d[3] for d in DOCS}
    for r in found:
        s = source[r.doc_id, r["size"]]
        assert by[r.doc_id, s, r["size"]] and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        total[s] += r["size"]
    assert total == +sizes
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    same(found, rows(spark, "op9_mixing", mixed))


def test_op10(spark, mixed):
    found = rows(spark, "op10_langid", mixed)
    assert len(found) == len(DOCS)
    by = {d[0]: d for d in DOCS}
    for r in found:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text(by[r.doc_id]))))
    sure = [r for r in found if r.held_out and r.doc_id < 60]
    assert sum(r.lang_pred == by[r.doc_id][2] for r in sure) >= 0.9 * len(sure)


def test_op10_by_brute_force(spark, mixed):
    """The excerpts are of training rows; every prediction follows from the sizes of the whole text under each dictionary."""
    docs = spark.read.parquet(f"{mixed}/documents.parquet")
    held = lambda d: d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
    samples = langid.sampled(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True)))
    for lang, parts in samples.items():
        texts = [t for _, t in {(d[0], text(d)) for d in DOCS if d[2] == lang and not held(d) and any(map(str.isalpha, text(d)))}]
        assert len(parts) == len(texts) and all(any(p in t and len(p) == min(len(t), langid.EXCERPT) for t in texts) for p in parts)
    contents = langid.dictionaries(samples)
    how = zstd.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=1 << 13, dict_size=1 << 17, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
    size = lambda c, b: len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how).compress(b))
    wanted = []
    for d in DOCS:
        plain = " " + " ".join(re.findall(r"[^\W\d_]+", text(d).lower())) + " "
        data = plain.encode()
        whole = {lang: sum(size(c, data[i : i + (1 << 13)]) for i in range(0, len(data), 1 << 13)) for lang, c in contents.items()}
        first, second = sorted(whole.values())[:2]
        tied = [lang for lang in contents if whole[lang] == first]
        alone = {lang: sum(size(contents[lang], f" {w} ".encode()) for w in set(plain.split())) for lang in tied}
        guess = min(tied, key=lambda lang: alone[lang])
        sure = any(map(str.isalpha, text(d)))
        wanted.append((d[0], held(d), guess if sure else "und", f"{1 - 2 ** (-(second - first) / 2) if sure else 0:.6f}"))
    same([(r.doc_id, r.held_out, r.lang_pred, f"{r.score:.6f}") for r in rows(spark, "op10_langid", mixed)], wanted)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_pipeline(spark, mixed, tmp_path):
    docs = spark.read.parquet(f"{mixed}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, mixed)
        assert docs.columns == out.columns if name != "mixing" else set(docs.columns) <= set(out.columns)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.count()
        assert after == before if name == "linededup" else after <= before
        before = after
        if name == "simhash":
            sets = [shingles(r.text or "") for r in docs.select("text").collect()]
            assert all(len(a & b) < 0.8 * len(a | b) for a, b in itertools.combinations(sets, 2))
        if name == "decontamination":
            assert 0 not in [r.doc_id for r in docs.select("doc_id").collect()]
    keys = {r["key"] for r in docs.select("key").collect()}
    assert all(k is None or k.startswith("key") for k in keys)


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
