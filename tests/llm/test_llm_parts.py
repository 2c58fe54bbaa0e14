"""Parts of the operators against brute force."""

import itertools
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from odd_tables import prose
from pyspark.sql import functions as F

from factorloom.llm import hmm, langid, linededup, mixing, ogg, pii, quality, simhash, texthash, warc
from factorloom.llm.components import components


# --- Ogg


def slow_checksum(page):
    c = 0
    for b in page:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum():
    for n in (0, 1, 27, 300):
        data = os.urandom(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 8191, 8192, 8193, 16384, 70000, 300000])
def test_container_roundtrip(n):
    payload = ogg.padded(os.urandom(n))
    assert ogg.decode(ogg.encode(payload))[0] == payload


@pytest.mark.parametrize("n", [0, 254, 255, 256, 255 * 255 - 1, 255 * 255, 255 * 255 + 1, 200000])
def test_packets_over_pages(n):
    first, second = os.urandom(n), b"next"
    w = ogg.Writer(7)
    pages = [*w.packet(first, n), *w.packet(second, n + 4), w.page(ogg.LAST)]
    found = ogg.demultiplex(b"junk" + b"".join(pages) + b"OggS and more")
    assert [p.data for p in found.packets] == [first, second]
    assert found.packets[-1].granule == n + 4 and found.gaps == 0


def test_damage_loses_only_what_it_hits():
    media = bytearray(ogg.encode(ogg.padded(os.urandom(500000))))
    whole = len(ogg.demultiplex(bytes(media)).packets)
    media[300000] ^= 1
    found = ogg.demultiplex(bytes(media))
    assert found.bad_pages == 1 and found.gaps == 1 and whole - 20 < len(found.packets) < whole
    with pytest.raises(ValueError):
        ogg.decode(bytes(media))


def test_packet_table(spark):
    media = [(1, ogg.encode(ogg.padded(b"x" * 20000))), (2, None), (3, b""), (4, b"no ogg at all")]
    found = ogg.packets(spark.createDataFrame(media, "k int, m binary"), "k", "m").collect()
    assert {r.k for r in found} == {1} and sum(len(r.data) for r in found if r.packet) == 20032
    assert max(r.ends_at for r in found) == 11840 / 8000


# --- personal data


def test_viterbi_is_the_best_path():
    field = pii.train(pii.labelled(n=60), rounds=20)
    text = 'plain token = "ab12ab12ab12ab12ab12" +1 (555) 123-4567'
    x = pii.shapes(*next(iter(texthash.pieces(pa.array([text])))))
    score, k = field.scores(x), len(pii.LABELS)
    best = max(itertools.product(range(k), repeat=6), key=lambda y: sum(score[i, a] for i, a in enumerate(y)) + sum(field.move[a, b] for a, b in itertools.pairwise(y)))
    assert pii.viterbi(field, pii.shapes(*next(iter(texthash.pieces(pa.array([" ".join(text.split()[:6])])))))).shape == (6,)
    x6 = pii.shapes(*next(iter(texthash.pieces(pa.array([" ".join(text.split()[:6])])))))
    score = field.scores(x6)
    best = max(itertools.product(range(k), repeat=6), key=lambda y: sum(score[i, a] for i, a in enumerate(y)) + sum(field.move[a, b] for a, b in itertools.pairwise(y)))
    assert tuple(pii.viterbi(field, x6)) == best


def test_field_on_unseen_lines():
    field = pii.train(pii.labelled())
    lines = pii.labelled(seed=99, n=200)
    x = pii.shapes(*next(iter(texthash.pieces(pa.array([" ".join(w for w, _ in line) for line in lines])))))
    truth = np.array([pii.LABELS.index(y) for line in lines for _, y in line])
    found = pii.viterbi(field, x)
    assert (found == truth)[truth > 0].mean() > 0.97 and (found > 0)[truth == 0].mean() < 0.01


def test_spans_of_texts_longer_than_a_piece(monkeypatch):
    field = pii.train(pii.labelled())
    monkeypatch.setattr(texthash, "PIECE", 200)
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = ["word\n" * 100 + f'token = "{secret}" ' + "wörd " * 100, "x " * 30, f'token = "{secret}"']
    found = pii.added(field, pa.array(texts))
    for row in (0, 2):
        assert [texts[row].encode()[s:e].decode() for k, s, e in found[row] if k == "secret"] == [secret]


def test_long_lines_are_decoded_whole():
    """A span that lies where lines used to be cut, on one long line."""
    field = pii.default_field()
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for n in (254, 255, 256, 5000):
        text = "word " * n + f'token = "{secret}" call +1 (555) 123-4567 ' + "end " * 300
        found = pii.added(field, pa.array([text]))[0]
        assert [text[s:e] for k, s, e in found if k == "secret"] == [secret] and [text[s:e] for k, s, e in found if k == "phone"] == ["+1 (555) 123-4567"]


def test_patterns_are_linear():
    assert pii.patterns("a" * 300000 + "1" * 300000 + "+1" + "." * 300000 + "@" * 3000) == []


# --- WARC


def test_lookup(spark):
    pages = [(i, f"http://www{i % 7}.example.com/{i % 50}" if i % 9 else None, f"page {i}") for i in range(400)]
    places = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"), size=2000)
    index = warc.build_index(places, size=10)
    assert sum(f[3] for f in index.files) >= 40 and sum(f[4] for f in index.files) == 400 and places.select("archive").distinct().count() > 20
    for url in {u for _, u, _ in pages} | {"http://absent.example.com/"}:
        assert sorted(p.decode() for _, p in warc.lookup(index, url)) == sorted(h for _, u, h in pages if u == url)


def test_a_lookup_reads_the_directory_and_one_block(spark):
    pages = [(i, f"http://h{i:04}.example.com/", "x") for i in range(3000)]
    places = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    index = warc.build_index(places, size=50)
    for r in places.sample(0.05, seed=1).collect():
        file = warc.IndexFile(index.files[index.near(r["key"], r["capture"])][2])
        assert file.one(r["key"], r["capture"])[2:] == [r["archive"], r["offset"], r["length"]] and file.reads == 1
    assert file.one("absent", 5) is None


def test_captures_of_one_key_and_other_ids(spark, monkeypatch):
    """All pages with one URL, ids that aren't numbers, and a missing capture."""
    monkeypatch.setattr(warc, "READ", 5000)
    pages = spark.range(2000).selectExpr("date_add(date'2020-01-01', cast(id AS INT)) AS page_id", "'http://same.example.com/' AS url", "repeat(cast(id % 90 AS STRING), 600) AS html")
    places = warc.archive(pages, size=30000)
    index = warc.build_index(places, size=30)
    found = warc.captures(index, places, "page_id", pages.schema["page_id"].dataType).collect()
    assert {r.page_id for r in found} == {r.page_id for r in pages.collect()}
    assert sum(r.record_type == "response" for r in found) == 90 + sum(1 for i in range(2000) if i % 90 < 10) - 10
    with pytest.raises(Exception):  # noqa: B017
        warc.captures(index, spark.createDataFrame([("com,example,same)/", -1)], "key string, capture long"), "page_id", pages.schema["page_id"].dataType).collect()


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("https://x.org") == "org,x)/" and warc.url_key(None) == "" and warc.url_key("http://[") == "http://["


# --- SimHash


def test_hashes_of_shingles():
    r = random.Random(15)
    data = bytes(r.randrange(256) for _ in range(3000))
    starts, lengths = np.array([r.randrange(2000) for _ in range(500)]), np.array([r.choice([0, 1, 3, 4, 5, 7, 8, 9, 12, 15, 31, 32, 33, 63, 64, 65, 100, 990]) for _ in range(500)])
    found = texthash.xxh64(np.frombuffer(data + b"\0" * 8, np.uint8), starts, lengths)
    assert found.tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    texts = [None, "", " ", "one", " One\tTWO\n", "a b c d", "a b c d e f", "é Ünï\x0b漢字 x y z " * 9, "w" * 300 + " " + "v" * 50, *[" ".join("x" * r.randint(1, 40) for _ in range(r.randint(0, 30))) + " " * r.randint(0, 2) for _ in range(200)], ""]
    for size in (1, 4, 5):
        for together in (1, 200, 1 << 21):
            for (row, hashes), t in zip(texthash.shingles(pa.array(texts), size, together), texts, strict=True):
                words = (t or "").encode().lower().split()
                wanted = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
                assert texts[row] == t and hashes.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in wanted]
    sliced = pa.array(["zero", *texts]).slice(1)
    assert [h.tolist() for _, h in texthash.shingles(sliced, 4)] == [h.tolist() for _, h in texthash.shingles(pa.array(texts), 4)]


def union(pairs, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("agree,shard,aim,leaf", [(1, 40, 1, 64), (1, 20000, 100, 8), (2, 20, 1, 64), (3, 20000, 1, 2), (1, 20000, 10000, 64), (1, 100, 10000, 16)])
def test_links_in_split_trees(spark, monkeypatch, agree, shard, aim, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(300)}
    for x in list(prints)[:40]:  # chains and clusters about some of them
        for _ in range(15):
            x ^= sum(1 << r.randrange(64) for _ in range(r.randint(1, 4)))
            prints.add(x % (1 << 64))
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    found = [(e.u % (1 << 64), e.v % (1 << 64)) for e in simhash.links(frame, 4, agree=agree, shard=shard, aim=aim).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    wanted = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    assert union(found, prints) == union(wanted, prints)


def test_one_of_each_group_stays(spark):
    """Near copies of every degree: what stays is a document of each group that similarity 0.8 joins."""
    r = random.Random(8)
    docs = []
    for g in range(40):
        words = prose(r, 120).split()
        for c in range(r.randint(1, 4)):
            for _ in range(r.choice([0, 1, 1, 2, 6, 40]) if c else 0):
                words[r.randrange(120)] = "changed"
            docs.append((len(docs), " ".join(words)))
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in docs]
    close = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = union(close, [d[0] for d in docs])
    found = sum(len(kept & set(g)) == 1 for g in groups)
    assert all(min(g) in kept for g in groups) and found >= 0.9 * len(groups)


def close_pairs(texts, least=0.8):
    """Pairs of texts by the exact similarity of their five-word shingles."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    return [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def kept_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id for x in simhash.keep_one(frame).collect()}


def test_rejected_links_hide_no_others(spark, monkeypatch):
    """A crowd of texts about as close as the limit: links that the exact check rejects must not stand for those that it would not."""
    monkeypatch.setattr(simhash, "LEAF", 4)
    r = random.Random(11)
    base, texts = prose(r, 300).split(), []
    for _ in range(150):
        words = list(base)
        for _ in range(r.randint(3, 8)):
            words[r.randrange(300)] = f"changed{r.random()}"
        texts.append(" ".join(words))
    prints = [simhash.fingerprint(simhash.shingled(t.encode(), 5)) for t in texts]
    near = [(a, b) for a, b in close_pairs(texts) if (prints[a] ^ prints[b]).bit_count() <= 8]
    kept = kept_of(spark, texts)
    assert near and all(len(kept & set(g)) <= 1 for g in union(near, range(len(texts))))


def test_prefixes_miss_no_pair(spark):
    """Pairs that share one of their rarest shingles, against all similar pairs of a crowd; texts without words, and with others' shingles only."""
    r = random.Random(14)
    base, texts = prose(r, 120).split(), ["", "one two three four five six"]
    for _ in range(80):
        words = list(base)
        for _ in range(r.randint(1, 5)):
            words[r.randrange(120)] = f"changed{r.randrange(30)}"
        texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, root long, text string").repartition(5)
    found = {(e.u, e.v) for e in simhash.open_pairs(simhash.rare_prefixes(frame, 5, 0.8), 0.8).collect()}
    close = {(a, b) for a, b in close_pairs(texts) if texts[a]}
    assert close <= found and len(found) < len(texts) * (len(texts) - 1) / 2
    one = frame.withColumn("root", F.lit(1))
    assert simhash.open_pairs(simhash.rare_prefixes(one, 5, 0.8), 0.8).isEmpty()


def test_copies_near_the_limit_are_all_found(spark):
    """Pairs barely similar enough, whose fingerprints are often far apart."""
    r, texts = random.Random(13), []
    for _ in range(100):
        words = prose(r, 200).split()
        texts.append(" ".join(words))
        for at in r.sample(range(10, 190, 10), 4):
            words[at] = "changed"
        texts.append(" ".join(words))
    close = close_pairs(texts)
    assert len(close) == 100 and kept_of(spark, texts) == set(range(0, 200, 2))


def test_components_of_chains(spark):
    r = random.Random(4)
    ids = r.sample(range(-(10**12), 10**12), 300)
    edges = list(itertools.pairwise(ids[:100])) + [(ids[100], x) for x in ids[101:200]] + [(ids[5], ids[5])]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert union([(x.node, x.root) for x in found], ids) == union(edges, ids)
    assert all(x.root == min(g) for x in found for g in union(edges, ids) if x.node in g)


# --- quality


def test_ordinal_tails_are_ordered():
    r = random.Random(1)
    texts = [prose(r, 40) + (" bad" * (i % 3 == 0)) + (" worse" * (i % 6 == 0)) for i in range(300)]
    sets = []
    for t in texts:
        parts = list(quality.features(pa.array([t])))
        sets.append(np.unique(np.concatenate([h for _, h in parts])))
    grades = np.array([2 - (i % 3 == 0) - (i % 6 == 0) for i in range(300)])
    model = quality.fit(grades, sets)
    tails = model.tails(quality.scores(model, pa.array(["fine words", "bad words", "bad and worse", None])))
    assert (tails[:, 0] >= tails[:, 1]).all() and tails[0, 1] > tails[1, 1] > tails[2, 1] and tails[3, 1] == tails[0, 1]


def test_one_id_on_very_many_rows(spark):
    """Rows that repeat a labelled id bring no more to the driver than the sample's bound, by rows and by bytes."""
    same = [(1, "copy " * 50)] * 3000 + [(1, f"other text {i}") for i in range(3000)] + [(2, "x" * 100000), (3, "fine")]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    grades, sets = quality.sampled(docs, labels, 40)
    assert len(grades) == len(sets) == 40
    assert len(quality.sampled(docs, labels, 10000)[0]) == 3003
    assert len(quality.sampled(docs, labels, 10000, 1000)[0]) < 100


def test_hashes_don_t_depend_on_neighbours(monkeypatch):
    texts = ["Some Words é here", None, "", "here", "x" * 50]
    whole = [np.sort(np.concatenate([h[rows == i] for rows, h in quality.features(pa.array(texts))])) for i in range(5)]
    monkeypatch.setattr(texthash, "PIECE", 12)
    for i, t in enumerate(texts):
        assert (np.sort(np.concatenate([h for _, h in quality.features(pa.array([t]))])) == whole[i]).all()


# --- language model


def test_forward_sums_all_paths():
    rng = np.random.default_rng(0)
    model = hmm.Model(*[rng.random(s) for s in ((hmm.STATES,), (hmm.STATES, hmm.STATES), (hmm.CLASSES + 1, hmm.STATES))]).learned()
    codes, lengths = rng.integers(0, hmm.CLASSES + 1, 12), np.array([4, 1, 3, 4])
    found = hmm.likelihoods(model, codes, lengths)
    at = 0
    for n, x in zip(lengths, found, strict=True):
        seq = codes[at : at + n]
        at += n
        total = sum(model.first[p[0]] * np.prod([model.emit[c, s] for c, s in zip(seq, p, strict=True)]) * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) for p in itertools.product(range(hmm.STATES), repeat=int(n)))
        assert abs(np.log10(total) - x) < 1e-9


def plain_expected(model, codes, lengths):
    """Expected counts and likelihoods token by token, over whole sequences."""
    first, move, emit, logs, at = np.zeros_like(model.first), np.zeros_like(model.move), np.zeros_like(model.emit), [], 0
    for n in lengths.tolist():
        x = codes[at : at + n]
        at += n
        f, c = [], []
        for t, w in enumerate(x):
            a = (model.first if t == 0 else f[-1] @ model.move) * model.emit[w]
            c.append(a.sum())
            f.append(a / c[-1])
        b = np.ones(hmm.STATES)
        for t in range(n - 1, -1, -1):
            gamma = f[t] * b
            emit[x[t]] += gamma
            if t == 0:
                first += gamma
            else:
                said = model.emit[x[t]] * b / c[t]
                move += np.outer(f[t - 1], said) * model.move
                b = model.move @ said
        logs.append(np.log10(c).sum())
    return hmm.Model(first, move, emit).flat(), np.array(logs)


def test_expected_counts_of_whole_sequences(monkeypatch):
    """Segments of long sequences change nothing: counts and likelihoods are those of whole sequences."""
    rng = np.random.default_rng(7)
    model = hmm.Model(*[rng.random(s) ** 4 for s in ((hmm.STATES,), (hmm.STATES, hmm.STATES), (hmm.CLASSES + 1, hmm.STATES))]).learned()
    lengths = np.array([1, 300, 2, 40, 41, 39, 77, 1000, 5, 200])
    codes = rng.integers(0, 30, lengths.sum())
    wanted, logs = plain_expected(model, codes, lengths)
    for long, segment, together in ((2048, 128, 1 << 18), (40, 13, 100), (4, 7, 64), (0, 16, 10**6)):
        monkeypatch.setattr(hmm, "LONG", long)
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        monkeypatch.setattr(hmm, "TOGETHER", together)
        assert np.allclose(hmm.expected(model, codes, lengths), wanted, rtol=1e-8, atol=1e-9)
        assert np.allclose(hmm.likelihoods(model, codes, lengths), logs, rtol=1e-10)


def test_long_sequences_don_t_vanish():
    rng = np.random.default_rng(0)
    model = hmm.start(np.ones(hmm.CLASSES + 1))
    x = hmm.likelihoods(model, rng.integers(1, hmm.CLASSES + 1, 30000), np.array([30000]))
    assert np.isfinite(x).all() and x[0] < -60000


def test_baum_welch_climbs():
    rng = np.random.default_rng(1)
    codes = np.concatenate([np.append(rng.integers(1 + 100 * (i % 3), 60 + 100 * (i % 3), 300), hmm.END) for i in range(30)])
    lengths = np.full(30, 301)
    model, last = hmm.start(np.bincount(codes, minlength=hmm.CLASSES + 1)), -np.inf
    for _ in range(5):
        now = hmm.likelihoods(model, codes, lengths).sum()
        assert now >= last - 1
        counts = hmm.expected(model, codes, lengths)
        assert abs(hmm.Model.shaped(counts).emit.sum() - len(codes)) < 1e-6 * len(codes)
        model, last = hmm.Model.shaped(counts).learned(), now
    assert now > hmm.likelihoods(hmm.start(np.bincount(codes, minlength=hmm.CLASSES + 1)), codes, lengths).sum() + 100


# --- lines, mixing, languages


def test_passages_are_found_wherever_they_stand(spark):
    r = random.Random(9)
    passage = "\n".join(prose(r, 12).replace("\n", " ") for _ in range(8))
    docs = [(i, "\n".join([*[prose(r, r.randint(3, 12)).replace("\n", " ") for _ in range(r.randint(0, 6))], passage, *[prose(r, 9).replace("\n", " ") for _ in range(r.randint(0, 6))]])) for i in range(20)]
    out = {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1]
    for i in range(1, 20):
        left = sum(line in out[i].split("\n") for line in passage.split("\n"))
        assert left == 0
        own = [x for x in docs[i][1].split("\n") if x not in passage.split("\n")]
        assert all(x in out[i].split("\n") for x in own)


def cut_by_hand(docs, least=linededup.LEAST):
    """Texts without later copies of runs, by all runs of all lines."""
    found = []
    for ident, text in sorted(docs):
        lines, own = text.split("\n"), set()
        total = lambda i, j: sum(len(x) + 1 for x in lines[i:j])  # noqa: B023, E731
        for i in range(len(lines)):
            own |= {(i, j) for j in range(i + 1, len(lines) + 1) if total(i, j) > least and total(i, j - 1) <= least}
            own |= {(j, i + 1) for j in range(i + 1) if total(j, i + 1) > least and total(j + 1, i + 1) <= least}
        found += [("\n".join(lines[a:b]), ident, a, b) for a, b in sorted(own)]
    first, gone = {}, {ident: set() for ident, _ in docs}
    for run, ident, a, b in found:
        ident1, a1 = first.setdefault(run, (ident, a))
        if (ident, a) != (ident1, a1):
            gone[ident] |= set(range(max(a, a1 + b - a) if ident == ident1 else a, b))
    return {ident: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[ident]) for ident, text in docs}


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_lines_by_brute_force(spark, broadcast_bytes):
    """Passages of short, long, equal and alternating lines, whole and in part, between lines of all lengths; copies of whole texts."""
    r = random.Random(1)
    pool = [[f"p{k} {i} " + "w" * r.choice([0, 3, 10, 40, 90, 130]) for i in range(r.randint(2, 25))] for k in range(8)] + [["same"] * 60, ["a" * 60, "b" * 60] * 8]

    def text():
        out = []
        for _ in range(r.randint(0, 30)):
            if r.random() < 0.3:
                p = r.choice(pool)
                at = r.randrange(len(p))
                out += p[at : at + r.randint(1, 12)]
            else:
                out.append("x" * r.choice([0, 1, 5, 20, 60, 120]) + str(r.randrange(10**6) if r.random() < 0.8 else 3))
        return "\n".join(out)

    docs = [(i, text()) for i in range(120)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(30)]
    found = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), broadcast_bytes=broadcast_bytes).collect()
    assert {x.doc_id: x.text for x in found} == cut_by_hand(docs)


def test_texts_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 100000} " + "y" * (i * 7 % 50) for i in range(200000))
    began = time.monotonic()
    (found,) = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert found.n_lines == 200000 and found.n_removed == 100000 and time.monotonic() - began < 60


@pytest.mark.parametrize("lines,words", [(3, 17), (4, 13), (5, 11), (9, 6), (20, 5), (1, 60)])
def test_short_passages_between_short_lines(spark, lines, words):
    """Passages of some 50 words, of lines of every length, between short foreign lines: gone from all documents but the first."""
    r = random.Random(10)
    line = lambda n: prose(r, n).replace("\n", " ")
    docs, passages = [], []
    for p in range(20):
        passage = [line(words) for _ in range(lines)]
        passages.append(passage)
        for c in range(2):
            docs.append((2 * p + c, "\n".join([*[line(r.randint(2, 8)) for _ in range(r.randint(1, 6))], *passage, *[line(r.randint(2, 8)) for _ in range(r.randint(1, 6))]])))
    out = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, _ in docs:
        assert out[i].n_removed == (lines if i % 2 else 0) and (not i % 2 or not set(passages[i // 2]) & set(out[i].text.split("\n")))


def test_mix_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 9), (2, "d", "t", 9)], "doc_id long, text string, source string, size long")
    found = mixing.mix(docs, docs.columns)
    assert found.columns.count("size") == 1 and {x["size"] for x in found.collect()} == {3, 1}


def test_a_crowd_of_equal_rows_is_mixed_as_others(spark):
    """One id, and none, on very many rows, some equal and some not: the budget is met to the word, and no row is taken more often than others."""
    docs = [(7, "a b c", "s", i) for i in range(900)] + [(None, f"d e {i % 3}", "s", i) for i in range(900)] + [(7, f"a b c {i}", "s", i) for i in range(900)] + [(i, "x " * i, "t", i) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n int").repartition(7)
    found = {c: mixing.mix(frame, ["doc_id", "text", "source", "n"], crowd=c).collect() for c in (10, 10**6)}
    for rows in found.values():
        assert len(rows) == len(docs) and all(r.epochs * r["size"] <= r.taken <= (r.epochs + 1) * r["size"] for r in rows)
        for s in "st":
            assert abs(sum(r.taken for r in rows if r.source == s) - next(r.target for r in rows if r.source == s)) <= 0.5
            assert sum(0 < r.taken - r.epochs * r["size"] < r["size"] for r in rows if r.source == s) <= 1
    each = [sorted((r.doc_id or -1, r.text, r.taken) for r in rows) for rows in found.values()]
    assert each[0] == each[1]


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.dictionaries({}), ["doc_id"]).collect()
    assert [(x.lang_pred, x.score, x.rejected) for x in found] == [("und", 0.0, True)]


def test_one_id_on_very_many_rows_of_a_language(spark):
    """Rows that repeat an id, or have none, count as others: a bounded number of excerpts, of different texts."""
    r = random.Random(16)
    texts = [prose(r, 60) for _ in range(900)]
    docs = [(7, t, "en") for t in texts] + [(None, t, "en") for t in texts] + [(7, texts[0], "en")] * 3000 + [(i, prose(r, 300, 1), "es") for i in range(30)]
    found = langid.sampled(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True))
    assert 20 < len(found["en"]) < 2 * langid.SAMPLE and len(found["es"]) == 30 and list(found) == ["en", "es"]
    assert all(len(x) == langid.EXCERPT for x in found["es"])


def test_a_rare_language_leaves_the_others_alone():
    r = random.Random(12)
    samples = {lang: [prose(r, 200, i) for _ in range(60)] for i, lang in enumerate(("en", "es"))}
    texts = [(lang, prose(r, 30, i)) for i, lang in enumerate(("en", "es")) for _ in range(50)]
    for stray in ("x", "wrong label", prose(r, 60, 0)):
        contents = langid.dictionaries(samples | {"rare": [stray]})
        assert len(contents["en"]) == len(langid.dictionaries(samples)["en"])
        sizer = langid.Sizer(contents)
        assert sum(langid.predicted(sizer, t)[0] == lang for lang, t in texts) >= 0.98 * len(texts)
