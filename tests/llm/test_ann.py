import numpy as np
import pytest

from wardline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, part int, score double"


def brute(rows, queries, k, size):
    ok = lambda v: v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)
    base = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and ok(v)]
    out = {}
    for i, v, *_ in queries:
        if i is not None and ok(v):
            near = sorted((float(np.sqrt(((b - np.array(v, np.float64)) ** 2).sum())), j) for j, b in base if j != i)[:k]
            out[i] = near
    return out


def clustered(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    v = (centres[rng.integers(40, size=n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    v[: n // 3] = v[0]  # a third of all are one vector
    return [(i, x.tolist(), 1, 2.0) for i, x in enumerate(v)]


def test_recall_and_distances(spark):
    rows = clustered(6000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect()
    expected = brute(rows, rows[::50], 10, 16)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == set(expected)
    hits = sum(len({j for _, j in found[q]} & {j for _, j in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    for q, near in found.items():
        assert len(near) == 10 and near == sorted(near) and q not in [j for _, j in near]
        x = np.array(rows[q][1], np.float64)
        assert np.allclose([s for s, _ in near], [np.sqrt(((np.array(rows[j][1], np.float64) - x) ** 2).sum()) for _, j in near], rtol=1e-12, atol=0)
    copies = [q for q in found if q < 2000]
    assert all(found[q] == expected[q] for q in copies)  # ties among equal vectors go to the smaller ids


def test_odd_rows_are_exact_when_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0, 0.0), (1, [1.0, 0.0], 0, 0.0), (2, [0.0, 0.0], 0, 0.0), (3, None, 0, 0.0), (4, [None, 1.0], 0, 0.0), (5, [nan, 1.0], 0, 0.0), (6, [inf, 1.0], 0, 0.0),
        (7, [2.0, 2.0], 0, 0.0), (8, [2.0, 2.0, 2.0], 0, 0.0), (9, [], 0, 0.0), (None, [1.0, 1.0], 0, 0.0), (7, [2.0, 3.0], 0, 0.0), (10, [-1.0, 0.5], 0, 0.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest_neighbours(df, df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    expected = brute(rows, [r for r in rows if r[1] != [2.0, 3.0]], 3, 2)
    assert got == expected
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0
    assert ann.nearest_neighbours(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [2, 8])
def test_parts_are_balanced_and_follow_the_graph(parts):
    rng = np.random.default_rng(1)
    graph = [np.array([y for y in rng.integers(i // 50 * 50, i // 50 * 50 + 50, 6).tolist() if y != i]) for i in range(400)]
    part = ann.balanced_parts(graph, parts)
    sizes = np.bincount(part, minlength=parts)
    assert sizes.max() - sizes.min() <= 1
    cut = np.mean([part[i] != part[y] for i, ys in enumerate(graph) for y in ys.tolist()])
    assert cut < 0.4 * (1 - 1 / parts)
