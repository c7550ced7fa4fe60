"""The vector operators against brute force."""

import math

import numpy as np
import pytest

from quillmark.llm import topk, vectors


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(260, 8))
    near = np.concatenate([base[:40] + rng.normal(size=(40, 8)) * 0.15, np.repeat(base[40:41], 60, axis=0) + rng.normal(size=(60, 8)) * 0.02])
    whole = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(whole)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] + [1.0] * 7, 0), (403, [None] + [1.0] * 7, 0), (404, [float("inf")] * 8, 0)]
    rows += [(405, [1.0, 2.0], 0), (406, [1.0, 2.0], 0), (407, [], 0), (5, whole[5].tolist(), 0), (None, whole[7].tolist(), 0), (450, whole[9].tolist(), 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' row", "'y' vec", "1 n", "2 dim", "3 tile", "4 cell")


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def test_near_vectors_match_brute_force(embeddings):
    rows = [(r["vec_id"], r["embedding"]) for r in embeddings.collect()]
    ok = [usable(x) and any(x) for _, x in rows]
    links = [set() for _ in rows]
    for i, (_, x) in enumerate(rows):
        for j in range(i):
            y = rows[j][1]
            if ok[i] and ok[j] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    want = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root = min(ids) if len(seen) > 1 and ids else vec_id
        want.append((vec_id, len(links[i]), root))
    for cell_rows, block in ((512, 2048), (20, 16)):
        got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(embeddings, cell_rows=cell_rows, block_rows=block).collect()]
        key = lambda t: tuple(-10 if v is None else v for v in t)
        got, want = sorted(got, key=key), sorted(want, key=key)
        assert len(got) == len(want)
        found, real = sum(g[1] for g in got), sum(w[1] for w in want)
        assert 0.98 * real <= found <= real
        if cell_rows == 512:
            assert got == want


def test_near_vectors_empty(embeddings):
    assert vectors.near_vectors(embeddings).where("n_links > 0").count() > 40
    assert vectors.near_vectors(embeddings.limit(0)).count() == 0
    assert vectors.near_vectors(embeddings.where("vec_id = 400")).count() == 1


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 5), (7, 7)):
        a, b = rng.random(n), rng.random(m)
        costs = (a[:, None] + b[None]).ravel()
        cells = vectors.traverse(a, b, n * m)
        assert sorted(cells) == list(range(n * m))
        assert np.allclose(costs[cells], np.sort(costs))


def test_top_k_matches_brute_force(embeddings):
    rows = [(r["vec_id"], r["embedding"]) for r in embeddings.collect()]
    rows = [(i, [math.floor(float(v) * 256) for v in x]) for i, x in rows if i is not None and usable(x)]
    want = []
    for n, (query_id, q) in enumerate(rows):
        if query_id % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), i) for m, (i, x) in enumerate(rows) if m != n and len(x) == len(q))
            want += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    for size in (8192, 37):
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(embeddings, cand_rows=size, query_rows=3 if size == 37 else 2048).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(embeddings).count() == len(want)
    assert topk.top_k(embeddings.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [3e38, 1.0], 0), (50, [1e30, -1.0], 0), (7, [-3e38, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(df).collect()}
    assert got == {(0, 1): 50, (0, 2): 7, (50, 1): 0, (50, 2): 7}
