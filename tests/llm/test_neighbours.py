import tracemalloc

import numpy as np

from folioforge.llm import neighbours as N

SCHEMA = "vec_id bigint, dense array<float>, cell int, ids string"


def brute(vectors, k=10):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[a]))[: min(k, len(ids) - 1)]] for a, i in enumerate(ids)}


def found(df, **kw):
    out = {}
    for r in sorted(N.all_neighbours(df, **kw).collect(), key=lambda r: (r.vec_id, r["rank"])):
        out.setdefault(r.vec_id, []).append(r.neighbor_id)
    return out


def clusters(n, per=20, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // per, 64))
    return {i: (centres[i % len(centres)] + 0.25 * rng.normal(size=64)).astype(np.float32).tolist() for i in range(n)}


def test_recall_on_clusters(spark):
    vectors = clusters(1500)
    got, want = found(spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA)), brute(vectors)
    assert {len(v) for v in got.values()} == {10} and set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) > 0.97


def test_split_cells_and_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 16)
    vectors = clusters(300)
    same = vectors[0]
    rows = [(i, v, 1, "x") for i, v in vectors.items()] + [(1000 + k, same, 1, "x") for k in range(400)]
    got = found(spark.createDataFrame(rows + rows[:20], SCHEMA))
    assert got[0] == list(range(1000, 1010)) and got[1005] == [0, *range(1000, 1005), *range(1006, 1010)] and got[1399] == [0, *range(1000, 1009)]
    assert np.mean([len(set(got[i]) & set(w)) / 10 for i, w in brute({**vectors, **{1000 + k: same for k in range(400)}}).items()]) > 0.95


def test_unusable_and_few(spark):
    v = clusters(20)
    bad = [None, [], [1.0] * 48, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows = [(i, v[i], 0, None) for i in range(4)] + [(100 + i, b, None, None) for i, b in enumerate(bad)] + [(None, v[7], 0, "x")]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute({i: v[i] for i in range(4)})
    assert found(spark.createDataFrame([], SCHEMA)) == {} and found(spark.createDataFrame(rows[:1], SCHEMA)) == {}


def test_beam_search_is_no_worse_than_greedy():
    x = np.array(list(clusters(800).values()), np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = N.fit(x)
    cell = N._nearest(x, books.cells)

    def error(beam):
        codes, norms = N.encode(x, cell, books, beam)
        decoded = books.cells[cell] + sum(books.residual[m][codes[:, m]] for m in range(codes.shape[1]))
        assert np.allclose(np.linalg.norm(decoded, axis=1), norms, atol=1e-4)
        return float(((x - decoded) ** 2).sum())

    assert error(4) <= error(1) * 1.001


def test_recall_in_a_hot_tight_group(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 256, raising=False)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    vectors = clusters(600) | {1000 + i: (centre + 0.25 * rng.normal(size=64)).astype(np.float32).tolist() for i in range(1200)}
    got, want = found(spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA)), brute(vectors)
    hot = [i for i in want if i >= 1000]
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in hot]) > 0.999


def test_shortlist_of_a_large_cell_is_completed(spark, monkeypatch):
    monkeypatch.setattr(N, "fit", lambda sample, f=N.fit: f(sample[:40]))
    monkeypatch.setattr(N, "CELL_GOAL", 4096)
    vectors = {i: v for i, v in enumerate(np.random.default_rng(4).normal(size=(600, 64)).astype(np.float32).tolist())}
    got, want = found(spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA), shortlist=12), brute(vectors)
    assert got == want


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "FIRST", 5)
    monkeypatch.setattr(N, "CELL_GOAL", 40)
    monkeypatch.setattr(N, "CELL_SAMPLE", 200)
    fitted = []
    monkeypatch.setattr(N, "divide", lambda *a, f=N.divide: fitted.append(f(*a)) or fitted[-1])
    vectors = clusters(1500, seed=2)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA)
    got, want = found(frame), brute(vectors)
    assert len(fitted[0].first) == 5 and 15 <= len(fitted[0].cells) <= 40
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) > 0.97
    assert found(frame, exact=True) == want


def test_cells_of_codebooks():
    x = np.random.default_rng(1).normal(size=(400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    one = N.fit(x)
    rows, cells, scores = one.near(x, 0.05)
    whole = x @ one.cells.T - one.half
    assert set(zip(rows.tolist(), cells.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(whole >= whole.max(1)[:, None] - 0.05))))
    assert (one.own(x) == N._nearest(x, one.cells)).all()
    two = N.Codebooks(one.cells[:3], one.cells, np.array([0, 4, 8, len(one.cells)]), one.residual)
    for margin in (0.0, 0.05, 9.0):  # the home of a vector doesn't depend on how many cells it asks
        rows, cells, scores = two.near(x, margin)
        first = np.searchsorted(rows, np.arange(len(x)))
        assert (cells[first] == two.own(x)).all()


def test_near_cells_of_a_batch_take_bounded_memory():
    # at 6 GB a vector has some 14,000 cells under near first-level cells, and a batch 10,000 vectors
    rng = np.random.default_rng(6)
    first = (0.3 * rng.normal(size=(256, 64)) / 8).astype(np.float32)
    cells = (np.repeat(first, 64, axis=0) + rng.normal(size=(256 * 64, 64)) / 16).astype(np.float32)
    books = N.Codebooks(first, cells, np.arange(257) * 64, np.zeros((4, 256, 64), np.float32))
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    rows, found_, _ = books.near(x, 0.02)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    top = x[:300] @ first.T - 0.5 * (first * first).sum(1)
    whole = np.where(np.repeat(top >= top.max(1)[:, None] - N._FIRST_MARGIN, 64, axis=1), x[:300] @ cells.T - 0.5 * (cells * cells).sum(1), -np.inf)
    for i in range(300):
        want = np.flatnonzero(whole[i] >= whole[i].max() - 0.02)
        assert found_[rows == i].tolist() == want[np.argsort(-whole[i][want])].tolist()


def test_slices_and_a_first_level_that_grows(spark, monkeypatch):
    for name, value in {"FIRST": 4, "SAMPLE_ROWS": 128, "SECOND": 4, "CELL_GOAL": 16, "CELL_SAMPLE": 64, "HELD_PAIRS": 50, "HELD_SCORES": 200, "HELD_ROWS": 10}.items():
        monkeypatch.setattr(N, name, value, raising=False)
    fitted = []
    monkeypatch.setattr(N, "divide", lambda *a, f=N.divide: fitted.append(f(*a)) or fitted[-1])
    vectors = clusters(1500, seed=5)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA)
    got, want = found(frame), brute(vectors)
    assert len(fitted[0].first) == 32 and 60 <= len(fitted[0].cells) <= 128
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) > 0.97
    assert found(frame, exact=True) == want
