"""The sampler and its parts against numpy, and matrix files against their layouts."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import sampling
from factorloom.operators import evaluate, normal, partition, prep
from factorloom.plans import model
from factorloom.sources import mat, matrix

TRAIN = [(0, 0, 2.0), (1, 0, 3.0), (2, 0, 7.0), (3, 0, 4.0), (0, 1, 5.0), (2, 1, 1.0)]
TEST = [(1, 1, 5.0), (3, 1, 1.0)]
CELLS = "user long, item long, value double"


def test_noise_is_normal_and_keyed():
    z = sampling.noise(np.arange(20000), 4, 1, 2, 3)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T) - np.eye(4)).max() < 0.03
    assert (sampling.noise(np.array([7, 5]), 4, 1, 2, 3) == z[[7, 5]]).all()
    assert abs(np.corrcoef(z[:, 0], sampling.noise(np.arange(20000), 4, 1, 2, 4)[:, 0])[0, 1]) < 0.03


def test_wishart_moments():
    scale, rng = np.array([[1.0, 0.4], [0.4, 0.7]]), sampling.generator(1)
    draws = np.stack([(u := sampling.wishart_upper(rng, scale, 9.0)).T @ u for _ in range(4000)])
    assert abs(draws.mean(axis=0) - 9 * scale).max() < 0.3


def test_normal_wishart_posterior():
    x = np.random.default_rng(0).normal(size=(50, 3)) @ np.diag([1, 2, 3.0]) + 1
    post = sampling.NormalWishart.prior(3).given(50, x.mean(axis=0), np.cov(x.T))
    assert post.kappa == 52 and post.df == 53 and np.allclose(post.mean, 50 * x.mean(axis=0) / 52)
    off = x.mean(axis=0)
    assert np.allclose(np.linalg.inv(post.scale), np.eye(3) + 50 * np.cov(x.T) + 100 / 52 * np.outer(off, off))
    prior = sampling.NormalWishart.prior(3)
    assert prior.given(0, off, np.eye(3)) is prior


def test_posterior_draws_have_their_moments():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 3))
    gram, rr, mu, lam = a.T @ a, a.T @ rng.normal(size=6), np.ones(3), np.diag([1.0, 2.0, 3.0])
    n = 20000
    tile = lambda x: np.broadcast_to(x, (n, *x.shape))
    f = sampling.posterior_draws(tile(gram), tile(rr), tile(mu), tile(lam), 2.0, sampling.noise(np.arange(n), 3, 1))
    cov = np.linalg.inv(lam + 2 * gram)
    assert abs(f.mean(axis=0) - cov @ (lam @ mu + 2 * rr)).max() < 0.02 and abs(np.cov(f.T) - cov).max() < 0.02
    with pytest.raises(np.linalg.LinAlgError):
        sampling.posterior_draws(gram[None] * 0, rr[None], mu[None], -np.eye(3)[None], 1.0, np.zeros((1, 3)))


@pytest.mark.parametrize("k,native,hot", [(3, 10, 1 << 20), (3, 0, 1 << 20), (12, 10, 1 << 20), (12, 10, 5)])
def test_normal_equations(spark, k, native, hot):
    rng = np.random.default_rng(3)
    cells = {(int(u), int(i)): float(v) for u, i, v in zip(rng.integers(0, 30, 200), np.minimum(rng.integers(0, 9, 200), 6), rng.normal(size=200), strict=True)}
    f = rng.normal(size=(30, k))
    ratings = spark.createDataFrame([(u, i, v) for (u, i), v in cells.items()], CELLS).repartition(5)
    factors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "id long, f array<double>")
    found = normal.normal_equations(ratings, factors, "item", "user", 0.5, k, native=native, hot=hot).collect()
    again = normal.normal_equations(normal.prepared(ratings, "item", k, native, hot), factors, "item", "user", 0.5, k, native=native, hot=hot).collect()
    shuffled = normal.normal_equations(ratings, factors, "item", "user", 0.5, k, 1 << 40, native=native, hot=hot).collect()
    assert len(found) == len(again) == len(shuffled) == len({i for _, i in cells})
    for r in (*found, *again, *shuffled):
        own = [(u, v) for (u, i), v in cells.items() if i == r.id]
        x, y = f[[u for u, _ in own]], np.array([v - 0.5 for _, v in own])
        assert r.n == len(own) and np.allclose(sampling.symmetric(np.array(r.gram), k), x.T @ x) and np.allclose(r.rr, x.T @ y)


def test_tiny_fit_follows_a_loop(spark):
    """One whole iteration, step by step in numpy, from the same keys."""
    p = model.Params(k=2, samples=1, burnin=0, seed=4)
    train, test = spark.createDataFrame(TRAIN, CELLS), spark.createDataFrame(TEST, CELLS)
    fitted = model.fit(train, test, p)
    mean = np.mean([v for *_, v in TRAIN])
    vectors = {"user": np.zeros((4, 2)), "item": np.zeros((2, 2))}
    for at, side in enumerate(model.SIDES):
        mu, lam = sampling.NormalWishart.prior(2).given(len(vectors[side]), np.zeros(2), np.zeros((2, 2))).draw(sampling.generator(4, at, 0))
        other = vectors["user" if side == "item" else "item"]
        z = sampling.noise(np.arange(len(vectors[side])), 2, 4, at, 0)
        for e in range(len(vectors[side])):
            rows = [(u if side == "item" else i, v - mean) for u, i, v in TRAIN if (i if side == "item" else u) == e]
            x, y = other[[o for o, _ in rows]].reshape(-1, 2), np.array([v for _, v in rows])
            vectors[side][e] = sampling.posterior_draws((x.T @ x)[None], (x.T @ y)[None], mu[None], lam[None], 2.0, z[e : e + 1])[0]
    for side in model.SIDES:
        found = {r.id: r.f for r in fitted.factors[side].collect()}
        assert np.allclose([found[i] for i in range(len(found))], vectors[side])
    for r in fitted.state.collect():
        assert np.isclose(r.pred, vectors["user"][r.user] @ vectors["item"][r.item] + mean) and r.pred == r.pred_avg and r.n == 0


def low_rank(seed=0, users=40, items=30, k=2):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(users, k)), rng.normal(size=(items, k))
    cells = [(a, b, float(u[a] @ v[b] + 3 + 0.1 * rng.normal())) for a in range(users) for b in range(items)]
    keep = rng.random(len(cells)) < 0.6
    return [c for c, x in zip(cells, keep, strict=True) if x], [c for c, x in zip(cells, keep, strict=True) if not x]


def test_fit_predicts_held_out_cells_and_repeats(spark):
    train, test = (spark.createDataFrame(x, CELLS) for x in low_rank())
    p = model.Params(k=3, samples=8, burnin=3, alpha=20.0, seed=1)
    fitted = model.fit(train, test, p, n_users=45)
    assert fitted.metrics[-1]["rmse_avg"] < 0.4 < fitted.metrics[0]["rmse"]
    assert fitted.factors["user"].count() == 45
    again = model.fit(train.repartition(7), test, p, n_users=45)
    a, b = ({(r.user, r.item): r.pred_avg for r in x.state.collect()} for x in (fitted, again))
    assert all(np.isclose(a[c], b[c]) for c in a)


def test_posterior_needs_enough_samples_and_serves_as_prior(spark, tmp_path):
    train, test = (spark.createDataFrame(x, CELLS) for x in low_rank(users=12, items=8))
    fitted = model.fit(train, test, model.Params(k=2, samples=6, burnin=1, posterior=True, keep_samples=True))
    post = fitted.posterior("item")
    rows = {r.id: r for r in post.collect()}
    samples = np.array([[x.f for x in sorted(f.collect(), key=lambda x: x.id)] for i, f in fitted.samples["item"] if i >= 1])
    assert np.allclose(rows[3].mu, samples[:, 3].mean(axis=0)) and np.allclose(np.array(rows[3]["lambda"]).reshape(2, 2), np.linalg.inv(np.cov(samples[:, 3].T)))
    model.fit(train, test, model.Params(k=2, samples=1, burnin=0, diagonal=True, bounds=(1.0, 5.0)), item_prior=post)
    model.save(fitted, str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "model/item-samples")).count() == 6 * 8
    with pytest.raises(ValueError):
        model.fit(train, None, model.Params(k=2, samples=2, burnin=1, posterior=True)).posterior("item")


def test_running_moments_follow_the_recurrence(spark):
    r = np.random.default_rng(5).normal(size=9)
    log = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(r)], "cell long, iter long, pred double")
    avg, m2 = 0.0, 0.0
    for i, x in enumerate(r):
        n = max(0, i - 2)
        if n == 0:
            avg, m2 = x, 0.0
        else:
            d = x - avg
            avg += d / n
            m2 += d * (x - avg)
    last = evaluate.running_last(log, "cell", 2).first()
    assert last.n == 6 and np.isclose(last.pred_avg, avg) and np.isclose(last.pred_m2, m2)
    d = r[-1] - avg
    final = evaluate.final_pass(evaluate.running_last(log, "cell", 2)).first()
    assert np.isclose(final.pred_avg, avg + d / 6) and np.isclose(final.pred_m2, m2 + d * (r[-1] - avg - d / 6))


def test_late_rows_are_left_out(spark, tmp_path):
    """Two batches of a stream: of the second, what is later than the watermark doesn't count."""
    from factorloom.streaming.running import windowed_error

    schema = "ts timestamp, value double, pred double"
    for i, hours in enumerate(([1, 2, 9], [1, 9, 10])):
        rows = [(f"2020-01-01 {h:02}:30:00", float(h), 0.0) for h in hours]
        frame = spark.createDataFrame(rows, "ts string, value double, pred double").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        writer = windowed_error(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        writer.foreachBatch(lambda batch, n, i=i: batch.withColumn("run", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))).start().awaitTermination()
    found = {(r.run, r.window.start.hour): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(0, 1): 1, (0, 2): 1, (0, 9): 1, (1, 9): 2, (1, 10): 1}


def test_balanced_parts(spark):
    counts = spark.createDataFrame([(i, int(10000 / (i + 1))) for i in range(3000)], "id long, nnz long")
    found = partition.balanced(counts, 4, exact=100)
    assert found.count() == 3000
    load = partition.load(found).first()
    assert load.unbalance_work < 12
    assert partition.load(partition.balanced(counts, 4, exact=5000)).first().unbalance_work < 1


def test_assigned_follows_a_loop(spark):
    """Work and messages, entity by entity; ties go to the last part, and sides take turns."""
    rng = np.random.default_rng(6)
    cells = {(int(u), int(i)) for u, i in zip(rng.integers(0, 25, 300), rng.integers(0, 18, 300), strict=True)}
    pattern = spark.createDataFrame(sorted(cells), "user long, item long")
    sizes = {"item": 18, "user": 25}
    counts = {s: spark.range(n).join(pattern.groupBy(F.col(s).alias("id")).agg(F.count("*").alias("nnz")), "id", "left").fillna(0) for s, n in sizes.items()}
    found = partition.alternating(pattern, counts["item"], counts["user"], 3, 100.0, 0.5)
    where = {}
    for _ in range(2):
        for at, side in enumerate(("item", "user")):
            other, loads, total, here = ("user", "item")[at], [0.0] * 3, 0.01, {}
            for _ in range(3):
                for e in range(sizes[side]):
                    ends = [c[at] for c in cells if c[1 - at] == e]
                    if e in here:
                        loads[here[e]] -= 7.1 + len(ends)
                        total -= 7.1 + len(ends)
                    cost = [100 * loads[p] / total + (0.5 * sum(where[other][x] != p for x in ends) if other in where else 0) for p in range(3)]
                    here[e] = max(p for p in range(3) if cost[p] == min(cost))
                    loads[here[e]] += 10 + len(ends)
                    total += 10 + len(ends)
            where[side] = here
    for side, rows in zip(("item", "user"), found, strict=True):
        assert {r.id: r.part for r in rows.collect()} == where[side]
    conn = partition.connectivity(pattern, found[0], found[1])
    rows = partition.by_connectivity(conn, 3).collect()
    for p in range(3):
        own = sorted((r for r in rows if r.part == p), key=lambda r: r.place)
        assert own == sorted(own, key=lambda r: (sum(1 << x for x in r.needed_by), r.item))
        assert {r["item"] for r in partition.sent(conn, p, (p + 1) % 3).collect()} == {r["item"] for r in own if (p + 1) % 3 in r.needed_by}


def test_adjacent_ids_over_ranges(spark):
    ids = [0, 1, 2, 7, 8, 9, 10, 11, 15, 16, 17, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 50]
    found = sorted(map(tuple, partition.islands(spark.createDataFrame([(i,) for i in ids], "id long"), step=4).collect()))
    assert found == [(0, 2), (7, 11), (15, 17), (31, 40), (50, 50)]


def test_tiny_fit_averages_near_the_expected_error(spark):
    """Nine iterations, all kept, on the four by two matrix: with few ratings the average prediction stays near the mean."""
    train, test = spark.createDataFrame(TRAIN, CELLS), spark.createDataFrame(TEST, CELLS)
    fitted = model.fit(train, test, model.Params(k=32, samples=9, burnin=0, seed=3))
    assert fitted.final["n_predict"] == 2 and fitted.final["rmse_avg"] < 6


def test_exact_split(spark):
    cells = spark.range(1003).select((F.col("id") % 40).alias("user"), F.col("id").alias("item"), F.lit(1.0).alias("value"))
    found = prep.split_exact(cells, "user", "item")
    assert found.count() == 1003 and found.where("is_test").count() == 201
    assert prep.split_exact(cells.limit(0), "user", "item").count() == 0


# --- files


def stored(path, data):
    path.write_bytes(gzip.compress(data) if path.name.endswith(".gz") else data)
    return str(path)


def cells_of(df):
    return sorted(map(tuple, df.collect()))


MTX = b"%%MatrixMarket MATRIX Coordinate Real General\n% said\n\n 3 2 4\n1 1 2.5\n%\n3 2 -1\n1 1 0.5\n2 1 0\n"


@pytest.mark.parametrize("name", ["a.mtx", "a.mm", "a.mtx.gz"])
def test_coordinate_files(spark, tmp_path, name):
    path = stored(tmp_path / name, MTX)
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 0, 3.0), (1, 0, 0.0), (2, 1, -1.0)]
    assert matrix.matrix_shape(path) == (3, 2)


def test_pattern_and_array_files(spark, tmp_path):
    path = stored(tmp_path / "p.mtx", b"%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 2\n")
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 1, 1.0), (1, 1, 1.0)]
    path = stored(tmp_path / "d.mtx", b"%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]


def binary(shape, rows, cols, values=None):
    head = np.array([*shape, len(rows)], "<u8").tobytes() + np.array(rows, "<u4").tobytes() + np.array(cols, "<u4").tobytes()
    return head + (b"" if values is None else np.array(values, "<f8").tobytes())


@pytest.mark.parametrize("gz", ["", ".gz"])
def test_binary_files(spark, tmp_path, monkeypatch, gz):
    monkeypatch.setattr(matrix, "CELLS", 2)
    path = stored(tmp_path / f"a.sdm{gz}", binary((3, 3), [1, 3, 2], [1, 2, 3], [1.5, 2.5, 3.5]))
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 0, 1.5), (1, 2, 3.5), (2, 1, 2.5)]
    path = stored(tmp_path / f"a.sbm{gz}", binary((3, 3), [1, 1, 2], [1, 1, 3]))
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 0, 2.0), (1, 2, 1.0)]
    path = stored(tmp_path / f"a.ddm{gz}", np.array([2, 3], "<u8").tobytes() + np.arange(6, dtype="<f8").tobytes())
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 0, 0.0), (0, 1, 2.0), (0, 2, 4.0), (1, 0, 1.0), (1, 1, 3.0), (1, 2, 5.0)]
    path = stored(tmp_path / f"a.csv{gz}", b"2\n2\n1,2,9\n3,4\nmore\n")
    assert cells_of(matrix.read_matrix(spark, path)) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


@pytest.mark.parametrize("name,data", [
    ("b.mtx", b"%%MatrixMarket matrix coordinate complex general\n1 1 0\n"), ("b.mtx", b"%%MatrixMarket matrix coordinate real symmetric\n1 1 0\n"), ("b.mtx", b"1 1 1\n1 1 1\n"),
    ("b.mtx", b"%%MatrixMarket matrix coordinate real general\n1 1 2\n1 1 1\n"), ("b.mtx", b"%%MatrixMarket matrix coordinate real general\n1 1 1\n2 1 1\n"),
    ("b.csv", b"3\n2\n1,2\n3,4\n"), ("b.csv", b"2\n2\n1\n3,4\n"), ("b.sdm", binary((2, 2), [1, 1], [1, 1], [1.0, 2.0])), ("b.sdm", binary((2, 2), [3], [1], [1.0])), ("b.xyz", b""),
])
def test_broken_files(spark, tmp_path, name, data):
    path = stored(tmp_path / name, data)
    with pytest.raises(Exception):  # noqa: B017
        matrix.read_matrix(spark, path).collect()


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_text_files_are_split(spark, tmp_path, monkeypatch, size):
    """Ranges of bytes that cut lines anywhere, with comments and blank lines, and blocks smaller than lines."""
    monkeypatch.setattr(matrix, "RANGE", size)
    monkeypatch.setattr(matrix, "BLOCK", 16)
    cells = [(i % 7, i * 5 % 11, float(i) - 3.5) for i in range(30)]
    body = "".join(f"{r + 1} {c + 1} {v}\n" + "% said\n\n" * (r == 3) for r, c, v in cells)
    path = stored(tmp_path / "a.mtx", f"%%MatrixMarket matrix coordinate real general\n7 11 30\n{body}".encode())
    wanted = {}
    for r, c, v in cells:
        wanted[r, c] = wanted.get((r, c), 0) + v
    parts = matrix.parts_of(path, "mtx")
    assert size == 1000 or len(parts) > 3
    assert cells_of(matrix.read_matrix(spark, path)) == sorted((*k, v) for k, v in wanted.items())
    path = stored(tmp_path / "b.csv", b"3\n4\n" + b"".join(b",".join(b"%d" % (10 * r + c) for c in range(4)) + b"\n" for r in range(3)))
    assert cells_of(matrix.read_matrix(spark, path)) == [(r, c, 10.0 * r + c) for r in range(3) for c in range(4)]
    path = stored(tmp_path / "c.mtx", b"%%MatrixMarket matrix array real general\n% x\n4 3\n" + b"".join(b"%d\n" % i for i in range(12)))
    assert cells_of(matrix.read_matrix(spark, path)) == [(r, c, 4.0 * c + r) for r in range(4) for c in range(3)]
    if size < 1000:
        path = stored(tmp_path / "d.mtx", b"%%MatrixMarket matrix coordinate real general\n3 3 9\n" + b"1 1 1\n" * 8)
        with pytest.raises(matrix.MatrixError):
            matrix.read_matrix(spark, path)


@pytest.mark.parametrize("name", ["a.sdm", "a.mtx", "a.mtx.gz", "a.sbm", "a.ddm", "a.csv", "a.csv.gz"])
def test_files_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """Ranges of several tasks, joined in order; dense files with columns and rows that no task has."""
    monkeypatch.setattr(matrix, "BLOCK", 240)
    rng = np.random.default_rng(9)
    cells = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 30, 90) // 2 * 2, rng.integers(0, 25, 90), strict=True)})
    frame = spark.createDataFrame([(r, c, 1.0 + r + c) for r, c in cells], "row long, col long, value double").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = str(tmp_path / name)
        matrix.write_matrix(frame, path, rows=33, cols=27)
        assert matrix.matrix_shape(path) == (33, 27)
        found = cells_of(matrix.read_matrix(spark, path))
        one = name.startswith("a.sbm")
        wanted = {(r, c): 1.0 if one else 1.0 + r + c for r, c in cells}
        if name.split(".")[1] in ("ddm", "csv"):
            wanted = {(r, c): 0.0 for r in range(33) for c in range(27)} | wanted
        assert found == [(*k, v) for k, v in sorted(wanted.items())]
        if name.split(".")[1] in ("sdm", "mtx", "sbm"):
            folder = str(tmp_path / "parts")
            matrix.write_parts(frame, folder, name.split(".")[1], 33, 27, name.endswith(".gz"))
            assert len(matrix.files_of(folder)) > 1 and all(matrix.matrix_shape(f) == (33, 27) for f in matrix.files_of(folder))
            assert cells_of(matrix.read_matrix(spark, folder)) == found
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def mat_element(kind, data, small=False):
    if small:
        return struct.pack("<HH4s", kind, len(data), data)
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_variable(name, kind, sizes, *values):
    parts = [mat_element(6, struct.pack("<II", kind, 0)), mat_element(5, struct.pack("<ii", *sizes)), mat_element(1, name.encode(), len(name) <= 4), *values]
    body = b"".join(parts)
    return struct.pack("<II", 14, len(body)) + body


def test_mat_files(spark, tmp_path):
    """Full and sparse variables, compressed or not, with values as small as they fit; others are passed over."""
    full = mat_variable("a", 6, (2, 3), mat_element(9, np.arange(6, dtype="<f8").tobytes()))
    small = mat_variable("ratings", 6, (2, 3), mat_element(2, bytes([1, 3, 2, 1, 5, 4])))
    sparse = mat_variable("s", 5, (4, 3), mat_element(5, np.array([0, 3, 1], "<i4").tobytes()), mat_element(5, np.array([0, 2, 2, 3], "<i4").tobytes()), mat_element(9, np.array([1.5, 2.5, 3.5]).tobytes()))
    text = mat_variable("txt", 4, (1, 2), mat_element(4, b"ab", True))
    packed = zlib.compress(sparse)
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    path = stored(tmp_path / "x.mat", head + full + text + struct.pack("<II", 15, len(packed)) + packed + small)
    assert cells_of(mat.read_mat(spark, path, "a")) == [(r, c, float(2 * c + r)) for r in range(2) for c in range(3)]
    assert cells_of(mat.read_mat(spark, path, "s")) == [(0, 0, 1.5), (1, 2, 3.5), (3, 0, 2.5)]
    assert cells_of(mat.read_ratings(spark, path, "ratings")) == [(0, 1, 5.0), (2, 0, 4.0)]
    for bad in ("none", "txt"):
        with pytest.raises(Exception, match="no matrix"):
            mat.read_mat(spark, path, bad).collect()
    with pytest.raises(Exception, match="level 5"):
        mat.read_mat(spark, stored(tmp_path / "y.mat", b"something else"), "a").collect()


def test_unordered_cells_are_refused(spark, tmp_path):
    spark.dataSource.register(matrix.MatrixSource)
    frame = spark.createDataFrame([(i * 7 % 10, i % 3, 1.0) for i in range(20)], "row long, col long, value double").repartition(4)
    with pytest.raises(Exception, match="ranged"):
        frame.write.format("matrix").mode("overwrite").save(str(tmp_path / "x.sdm"))


def test_missing_file(spark, tmp_path):
    with pytest.raises(matrix.MatrixError):
        matrix.matrix_shape(str(tmp_path / "none.sdm"))


def test_vectors_roundtrip(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 2.0, -1.0]) for i in range(5)], "id long, f array<double>")
    path = str(tmp_path / "u.ddm")
    matrix.write_matrix(matrix.as_cells(vectors), path)
    assert matrix.matrix_shape(path) == (3, 5)
    assert sorted(map(tuple, matrix.as_vectors(matrix.read_matrix(spark, path), 3).collect())) == sorted(map(tuple, vectors.collect()))
    path = str(tmp_path / "v.csv")
    matrix.write_matrix(matrix.as_cells(vectors.where("id = 0")), path)
    assert [r["value"] for r in matrix.read_vector(spark, path).orderBy("row").collect()] == [0.0, 2.0, -1.0]


def test_command_line(spark, tmp_path):
    from factorloom.__main__ import main

    for name, cells in (("train", TRAIN), ("test", TEST)):
        matrix.write_matrix(spark.createDataFrame(cells, "row long, col long, value double"), str(tmp_path / f"{name}.mtx"), rows=4, cols=2)
    out = str(tmp_path / "out")
    main(["-n", str(tmp_path / "train.mtx"), "-p", str(tmp_path / "test.mtx"), "-o", out, "-i", "5", "-b", "1", "-d", "2", "-v", "--posterior"])
    assert matrix.matrix_shape(f"{out}/U-mu.ddm") == (2, 4) and matrix.matrix_shape(f"{out}/V-Lambda.ddm") == (4, 2) and matrix.matrix_shape(f"{out}/U-4.ddm") == (2, 4)
    assert [r[:2] for r in cells_of(matrix.read_matrix(spark, f"{out}/Pavg.sdm"))] == [(1, 1), (3, 1)]
    main(["-n", str(tmp_path / "train.mtx"), "-p", str(tmp_path / "test.mtx"), "-i", "1", "-b", "0", "-d", "2", "-m", f"{out}/V-mu.ddm,{out}/V-Lambda.ddm", "--parts", "2", "-k", "-f", "1"])
    main(["-n", str(tmp_path / "train.mtx"), "-p", str(tmp_path / "test.mtx"), "-i", "1", "-b", "0", "-d", "2", "--parts", "2"])
    with pytest.raises(SystemExit):
        main(["-n", "x"])
