import numpy as np
import pytest

from decisa.llm import multi_index as M
from decisa.llm.multi_index import kmeans, nearest, visit_order


def brute(ids, x, queries, k):
    out = []
    for q in queries:
        at = np.flatnonzero(ids != ids[q])
        s = (x[at] * x[q]).sum(axis=1)
        best = np.lexsort((ids[at], -s))[:k]
        out += [(int(ids[q]), n + 1, int(ids[at][b]), float(s[b])) for n, b in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.3, None])
def test_recall_and_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(M, "LEAST", 100)
    monkeypatch.setattr(M, "BLOCK", 700)
    monkeypatch.setattr(M, "FEWEST", 200)
    monkeypatch.setattr(M, "QUERIES", 90)
    monkeypatch.setattr(M, "SAMPLE", 3000)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 16))
    if spread:
        x = rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + spread * x
    x = (x * rng.choice([1.0, 1.0, 2.0], 6000)[:, None]).astype(np.float32)
    x[100:140] = x[100]  # ties
    x[3000:5000] = x[3000]  # a cell of more than a block
    ids = np.arange(6000)
    rows = [(i, v.tolist(), "c", -1) for i, v in zip(ids.tolist(), x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, block int").repartition(5)
    got = [tuple(r) for r in nearest(df, lambda i: i % 20 == 0).collect()]
    want = brute(ids, x.astype(float), np.flatnonzero(ids % 20 == 0), 20)
    assert len(got) == len(want)
    best = {(q, n): s for q, n, _, s in want}
    hits = sum(s >= best[(q, 20)] - 1e-9 for q, _, _, s in got)
    assert hits >= 0.9 * len(want)
    truth = {(q, v): (x[q].astype(float) * x[v].astype(float)).sum() for q, _, v, _ in got}
    assert all(abs(s - truth[(q, v)]) < 1e-12 for q, _, v, s in got)
    for q in {g[0] for g in got}:
        mine = sorted((g for g in got if g[0] == q), key=lambda g: g[1])
        assert [g[1] for g in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda g: (-g[3], g[2]))


def test_share_follows_the_vectors():
    rng = np.random.default_rng(3)
    loose = rng.normal(size=(4000, 24))
    tight = rng.normal(size=(80, 24))[rng.integers(0, 80, 4000)] + 0.2 * loose
    shares = []
    for x in (loose, tight):
        books = [kmeans(part, 64) for part in (x[:, :12], x[:, 12:])]
        cells = M.near(x[:, :12], books[0]) * len(books[1]) + M.near(x[:, 12:], books[1])
        shares.append(M.needed_share(x, books, cells, 20))
    assert shares[1] < 0.05 < shares[0] < 0.7


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [9.0, 1.0]), (40, [-1.0, 5.0]), (7, [float("inf"), 0.0])]
    got = sorted(tuple(r) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect())
    assert got[:5] == [(0, 1, 40, 11.0), (0, 2, 40, 9.0), (0, 3, 20, 5.0), (0, 4, 20, 5.0), (0, 5, 1, 4.0)]
    assert [g[2:] for g in got if g[0] == 40] == [(0, 9.0), (20, 9.0), (20, 9.0), (1, 3.0)] and len(got) == 13
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).collect() == []


def test_visits_go_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    sizes = rng.integers(0, 4, 63)
    order = visit_order(a, b, sizes.tolist(), int(sizes.sum()))
    total = [a[c // 7] + b[c % 7] for c in order]
    assert total == sorted(total) and set(order) == set(np.flatnonzero(sizes).tolist())
    assert sum(sizes[visit_order(a, b, sizes.tolist(), 10)]) >= 10


def test_kmeans_of_few_rows():
    assert len(kmeans(np.ones((5, 3)), 4)) == 1
