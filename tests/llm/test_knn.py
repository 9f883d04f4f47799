import numpy as np
import pytest

from provisio.llm import knn

SCHEMA = "chunk_id string, embedding array<float>, embedded_at int, place string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], t, "p") for i, v, t in rows], SCHEMA)


def exact(ids, x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in np.lexsort((np.arange(len(ids)), -s[i]))[:k]] for i in range(len(ids))}


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.choice(12, 3000, p=np.r_[0.4, np.full(11, 0.6 / 11)])] + 0.5 * rng.normal(size=(3000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(3000)]
    got = {}
    for r in knn.nearest(frame(spark, [(i, 3 * v, 0) for i, v in zip(ids, x)]), id_col="chunk_id", vec_col="embedding", dim=16, k=5, cell_rows=60, region_rows=400, probes=8, rerank=32, block_rows=1000).collect():
        got.setdefault(r.chunk_id, {})[r.place] = r.neighbour
    want = exact(ids, x, 5)
    assert all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values()) and len(got) == 3000
    assert sum(len(set(got[i].values()) & set(want[i])) for i in ids) / 15000 >= 0.95


def test_recall_with_many_cells(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.normal(size=(12, 32))[rng.choice(12, n)] + 0.5 * rng.normal(size=(n, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(n)]
    got = {}
    for r in knn.nearest(frame(spark, [(i, v, 0) for i, v in zip(ids, x)]), id_col="chunk_id", vec_col="embedding", dim=32, k=5, cell_rows=4, region_rows=100).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    want = exact(ids, x, 5)
    assert sum(len(got[i] & set(want[i])) for i in ids) / (5 * n) >= 0.95


def test_probes_grow_with_cells():
    assert [knn.probed(c, 16) for c in (1, 24, 247, 1235, 2470)] == [1, 16, 20, 58, 91]
    assert knn.probed(50, 8) == 8 and knn.probed(2470, 200) == 200


def test_dirty_rows_and_copies(spark):
    rows = [(f"c{i:02d}", [1.0, 0.0], 1) for i in range(20)] + [("near", [1.0, 0.1], 1), ("far", [0.0, 1.0], 1)]
    rows += [("null", None, 1), ("empty", [], 1), ("long", [1, 2, 3], 1), ("nan", [float("nan"), 1], 1), ("inf", [float("inf"), 1], 1), ("zero", [0, 0], 1), ("hole", [None, 1], 1), (None, [1, 0], 1)]
    rows += [("far", [5.0, 0.0], 0), ("near", [1.0, 0.1], 2), ("tiny", [0.0, 1e-30], 1)]
    got = {}
    for r in knn.nearest(frame(spark, rows), id_col="chunk_id", vec_col="embedding", time_col="embedded_at", dim=2, k=3).collect():
        got.setdefault(r.chunk_id, []).append((r.place, r.neighbour))
    assert set(got) == {f"c{i:02d}" for i in range(20)} | {"near", "far", "tiny"}
    assert [n for _, n in sorted(got["c00"])] == ["c01", "c02", "c03"]
    assert [n for _, n in sorted(got["c19"])] == [n for _, n in sorted(got["near"])] == ["c00", "c01", "c02"]
    assert sorted(got["far"])[0][1] == "tiny"  # the later vector counts, whatever its length
    pairs = {tuple(r) for r in knn.similar_pairs(frame(spark, rows), vec_col="embedding", time_col="embedded_at", dim=2, k=3).collect()}
    assert ("far", "tiny") in pairs and ("c00", "near") in pairs and all(a < b for a, b in pairs)


def test_empty_and_single(spark):
    for rows in ([], [("a", [1.0, 0.0], 1)]):
        assert knn.nearest(frame(spark, rows), id_col="chunk_id", vec_col="embedding", dim=2).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(frame(spark, []), id_col="chunk_id", vec_col="embedding", dim=3)


def test_codes_lower_the_score_aware_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells, books = knn.fit(x, 600, 150, 10_000, 4.0)
    assert len(cells) == 4
    y = x - cells.centre(cells.nearest(x, 1)[:, 0])

    def loss(codes):
        e = y - np.concatenate([books[s][codes[:, s]] for s in range(4)], axis=1)
        return ((e**2).sum(1) + 3 * (e * x).sum(1) ** 2).mean()

    assert loss(knn._codes(x, y, books, 4.0)) <= loss(knn._codes(x, y, books, 4.0, sweeps=0))


def test_rows_for_codebooks(spark, monkeypatch):
    seen = []
    real = knn._codes
    monkeypatch.setattr(knn, "_codes", lambda x, *a, **k: seen.append(len(x)) or real(x, *a, **k))
    x = np.random.default_rng(0).normal(size=(400, 4)).astype(np.float32)
    df = frame(spark, [(f"v{i}", v, 0) for i, v in enumerate(x)])
    for rows in (100, 300):
        seen.clear()
        knn.nearest(df, id_col="chunk_id", vec_col="embedding", dim=4, cell_rows=50, book_rows=rows)
        assert set(seen) == {rows}


def test_cells_are_divided_beyond_the_sample():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = knn.Cells(x, 40_000, 100, 1_000, rng)  # 100 centroids from the sample, 4 parts of each
    assert len(cells) == 400 and len(cells.fine) == 4 and cells.region.max() + 1 == 40
    every = np.stack([cells.centre(np.full(1, c))[0] for c in range(len(cells))])
    want = ((x[:, None] - every[None]) ** 2).sum(-1).argmin(1)
    assert (cells.nearest(x, 20)[:, 0] == want).mean() > 0.97
    assert knn.Cells(x, 4_000_000, 1_000, 10_000, rng).region.max() + 1 == 400  # parts of a centroid's cells


def test_table_scan_is_the_product_with_decoded_codes():
    rng = np.random.default_rng(3)
    for m in (3, 4):
        books, q = rng.normal(size=(m, 16, 2)).astype(np.float32), rng.normal(size=(10, 2 * m)).astype(np.float32)
        codes = rng.integers(0, 16, (50, m)).astype(np.uint8)
        decoded = np.concatenate([books[s][codes[:, s]] for s in range(m)], axis=1)
        assert np.allclose(knn.scan(q, codes.astype(np.intp), books), q @ decoded.T, atol=1e-4)
