"""Top-k and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from bizdiag.llm import near_vectors, queries, topk
from pyspark.sql import functions as F

from compare import compare, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, node int, rank int, score string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 8))
    near = x[rng.integers(0, 40, 200)] + rng.normal(scale=0.08, size=(200, 8))
    hot = x[:1] + rng.normal(scale=0.05, size=(150, 8))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(np.r_[x, near, hot, np.repeat(x[5:6], 60, 0)])]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], [1.0, 2.1], [3.0] * 8, [3.0] * 8]
    rows += [(1_000 + k, v) for k, v in enumerate(odd)] + [(None, rows[0][1]), (3, rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "s") for i, v in rows], SCHEMA)


def fine(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def test_top_k(spark, vectors, monkeypatch):
    whole = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and fine(v)]
    want = set()
    for i, q in whole:
        if i % 50 == 0:
            found = sorted((-int(q @ v), j) for j, v in whole if j != i and len(v) == len(q))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(found)}
    table = frame(spark, vectors)
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()} == want
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 4)
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()} == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e7])
def test_index_is_exact_at_any_size(scale):
    rng = np.random.default_rng(2)
    rows, queries_ = (np.floor(scale * rng.normal(scale=100, size=(n, 16))) for n in (500, 20))
    ids = np.arange(500)
    got = topk.Index(ids, rows, np.abs(queries_).max()).best(queries_, np.arange(20), 5)
    exact = [[int(c) for c in r] for r in rows]
    for k, q in enumerate(queries_):
        scores = sorted((-sum(int(a) * b for a, b in zip(q, r)), i) for i, r in enumerate(exact) if i != k)[:5]
        assert sorted((-s, i) for n, i, s in got if n == k) == scores


def test_top_k_equals_sql(spark):
    assert compare(spark, duck(SF), queries.QUERIES["op3_top_k"], queries.ORACLES["op3_top_k"], SF) == ""


def test_urls_equal_sql(spark):
    assert compare(spark, duck(SF), queries.QUERIES["op5_url_filter"], queries.ORACLES["op5_url_filter"], SF) == ""


def brute_links(rows):
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and fine(v) and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, _, x) in enumerate(good):
        for b, _, y in good[:k]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, links[n], None if i is None else least[find(n)], i is None or least[find(n)] == i) for n, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [4_096, 32])
def test_near_vectors(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    got = sorted((tuple(r) for r in near_vectors.near_duplicates(frame(spark, vectors)).collect()), key=str)
    want = brute_links(vectors)
    over = [(g, w) for g, w in zip(got, want) if g[1] > w[1]]
    assert not over and sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.98
    assert near_vectors.near_duplicates(frame(spark, vectors).limit(0)).count() == 0


def test_pairs_beside_a_large_group(spark):
    """A third of all rows are near copies of one vector; they must not decide how far others' links are looked for."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.sqrt((v**2).sum(1, keepdims=True))
    hot = unit(unit(rng.normal(size=(1, 32))) + rng.normal(scale=0.002, size=(2_000, 32)))
    a = unit(rng.normal(size=(1_500, 32)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.952, 0.955, (len(a), 1))
    x = np.r_[hot, a, cosine * a + np.sqrt(1 - cosine**2) * side].astype(np.float32)
    got = {r.vec_id: tuple(r) for r in near_vectors.near_duplicates(frame(spark, [(k, v) for k, v in enumerate(x.tolist())])).collect()}
    y = unit(x.astype(float))
    near = y @ y.T >= 0.95
    component = near_vectors.forest(*np.nonzero(near), len(x))
    assert sum(near.sum(1)[len(hot) :] > 1) >= 2 * len(a)
    assert [got[k] for k in range(len(x))] == [(k, near[k].sum() - 1, component[k], component[k] == k) for k in range(len(x))]


def test_forest():
    label = near_vectors.forest(np.array([5, 4, 1, 8]), np.array([4, 3, 2, 8]), 9)
    assert label.tolist() == [0, 1, 1, 3, 3, 3, 6, 7, 8]
