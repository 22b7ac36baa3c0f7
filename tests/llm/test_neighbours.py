import numpy as np
import pytest

from leafmill.llm import neighbours as N


def make(n=600, d=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[1::5] = x[0::5] + r.normal(size=x[0::5].shape) * 0.08
    x[2::50] = x[0::50] * 3.0  # the same direction
    return x.astype(np.float32)


def frame(spark, x):
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(x)]
    rows += [(5000, None, "", 0), (5001, [0.0] * x.shape[1], "", 0), (5002, [1.0, 2.0], "", 0), (5003, [float("nan")] * x.shape[1], "", 0), (0, x[0].tolist(), "clash", 1), (None, x[3].tolist(), "", 0)]
    return spark.createDataFrame(rows, "idx bigint, embedding array<float>, vec string, shard int")


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= least, 1))
    return set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("leaf,trees,factor", [(4000, 5, 0.01), (60, 6, 0.1), (60, 1, 1.0)])
def test_pairs(spark, monkeypatch, leaf, trees, factor):
    monkeypatch.setattr(N, "LEAF_ROWS", leaf)
    x = make()
    got = {(r["a"], r["b"]) for r in N.similar_pairs(frame(spark, x), trees=trees, factor=factor).collect()}
    want = brute(x, 0.9)
    assert got <= want and len(got & want) >= (1.0 if factor == 1.0 or leaf > 600 else 0.97) * len(want)


def test_deep_trees_keep_pairs_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 10)
    r = np.random.default_rng(1)
    x = r.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = r.normal(size=x[::2].shape)
    x[1::2] = x[::2] + 0.42 * step / np.linalg.norm(step, axis=1, keepdims=True)
    assert [N.trees_for(n) for n in (0, 80, 640, 10_240)] == [5, 5, 6, 10]
    got = {(row["a"], row["b"]) for row in N.similar_pairs(frame(spark, x)).collect()}
    want = brute(x, 0.9)
    assert got <= want and len(want) > 250 and len(got) >= 0.99 * len(want)


def test_nearest_recall_and_exactness(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 60)
    x = make()
    v = frame(spark, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for factor, least in ((1.0, 1.0), (N.KNN_FACTOR, 0.9)):
        hits = N.nearest(v, v.filter("idx % 50 = 0"), 5, factor=factor).collect()
        found: dict = {}
        for r in hits:
            found.setdefault(r["id"], set()).add(r["neighbour"])
        same = 0
        for q, near in found.items():
            s = u[q] @ u.T
            s[q] = -2
            same += len(near & set(np.argsort(-s)[:5].tolist()))
        assert len(found) == 12 and same >= least * 60 - 1e-9


def test_hot_class_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0])], "idx bigint, embedding array<float>")
    assert N.similar_pairs(same, expand=False).collect() == []
    assert N.similar_pairs(same).count() == 780
    assert [r["neighbour"] for r in sorted(N.nearest(same, same.filter("idx = 0"), 3).collect(), key=lambda r: r["rank"])] == [1, 2, 3]
    empty = same.filter("idx < 0")
    assert N.similar_pairs(empty).collect() == [] and N.nearest(empty, empty).collect() == []
    with pytest.raises(ValueError):
        N.similar_pairs(same, least=0)


def test_sketches_lose_no_pair_and_cosines_are_exact(spark):
    """Pairs right at the least cosine are within the bits allowed, and the cosines that come out are those of the vectors."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1, keepdims=True)
    apart = np.bitwise_count(N.sketch(x) ^ N.sketch(y)).sum(axis=1)
    assert (apart > N.bits_apart(0.9)).mean() < 0.001 and N.bits_apart(0.9) < 80 and N.bits_apart(1.0) == 0
    v = frame(spark, make())
    got = {(row["a"], row["b"]): row["cosine"] for row in N.similar_pairs(v, least=0.99, factor=1.0, trees=1).collect()}
    u = make().astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert set(got) == brute(make(), 0.99) and all(abs(c - u[a] @ u[b]) < 1e-9 or c == 1.0 for (a, b), c in got.items())
