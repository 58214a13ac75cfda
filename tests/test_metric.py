import numpy as np
import pytest

from tessera.operators import metric as M


def frame(spark, v):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("kind, t, block", [("clusters", 0.9, 20), ("even", 0.5, 8192), ("plane", 0.99, 7)])
def test_search_equals_all_pairs(spark, kind, t, block):
    r = np.random.default_rng(5)
    if kind == "clusters":
        v = np.repeat(r.normal(size=(12, 8)), 20, axis=0) + 0.05 * r.normal(size=(240, 8))
    elif kind == "even":
        v = r.normal(size=(150, 6))
    else:
        a = r.integers(0, 40, 120) * (np.pi / 20)  # many equal angles and rows
        v = np.stack([np.cos(a), np.sin(a)], 1)
    v[3] = 0
    df = frame(spark, v)
    index = M.build(df, "id", "v", pivots=10)
    asked = df.where("id % 10 = 0")
    got = {(x.q, x.k): x.sim for x in M.search(index, asked, "id", "v", t, block).collect()}
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n, n, 1)[:, None]
    sim = u @ u.T
    ask = [i for i in range(0, len(v), 10)]
    sure = {(i, j) for i in ask for j in range(len(v)) if n[i] and n[j] and sim[i, j] >= t + 1e-9}
    near = {(i, j) for i in ask for j in range(len(v)) if n[i] and n[j] and sim[i, j] >= t - 1e-9}
    assert sure <= set(got) <= near and all(abs(s - sim[p]) < 1e-9 for p, s in got.items())
    share = M.visited(index, asked, "id", "v", t).first().share
    assert share <= (0.2 if kind == "clusters" else 1)


def test_no_rows_and_zero_vectors(spark):
    nothing = frame(spark, np.zeros((3, 4)))
    some = frame(spark, np.eye(4))
    empty = M.build(nothing, "id", "v")
    assert M.search(empty, some, "id", "v", 0.5).collect() == [] and M.visited(empty, some, "id", "v", 0.5).first().compared == 0
    index = M.build(some, "id", "v")
    assert M.search(index, nothing, "id", "v", 0.5).collect() == []
    assert sorted((x.q, x.k) for x in M.search(index, some, "id", "v", 0.5).collect()) == [(i, i) for i in range(4)]
