import random

import numpy as np
import pytest

from leafmill.llm import neardup as N


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else None


def brute(rows, least=0.6):
    sets = {i: shingles(t) for i, t in rows if i is not None and t and shingles(t)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def rows():
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(60)]
    found = []
    for g in range(40):
        base = random.choices(vocabulary, k=random.randrange(18, 130))
        for _ in range(4):
            copy = list(base)
            for _ in range(random.randrange(0, 9)):
                at = random.randrange(len(copy))
                random.choice([lambda: copy.__setitem__(at, "edit"), lambda: copy.insert(at, "more"), lambda: copy.pop(at)])()
            found.append(" ".join(copy))
        if g % 5 == 0:
            found += [found[-1], found[-1].upper().replace(" ", "\n")]
        if g % 7 == 0:
            half = len(base) // 2
            found.append(" ".join(base[half:] + base[:half]))
    found += ["la " * 50, "la " * 60, "", " ", "short text"]
    return list(enumerate(found)) + [(9000, None), (None, found[0]), (3, found[3])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows()], "idx bigint, snippet string, class string, n int")


def test_pairs_equal_brute_force(spark, docs):
    got = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(docs, "idx", "snippet").collect()}
    want = brute(rows())
    assert got == want and len(want) > 60


def test_the_exact_way_needs_no_rule_about_edits(spark):
    """Texts made of the same three-word runs in another order, which no edit makes: only the exact way is bound to find them."""
    random.seed(8)
    runs = [f"a{i} b{i} c{i}" for i in range(60)]
    texts = []
    for _ in range(6):
        texts.append(" ".join(random.sample(runs, 60)))
    texts += [" ".join(["x y z"] * 8 + random.sample(runs, 30)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts + [t for _, t in rows()[:30]])), "idx bigint, snippet string")
    some = [(i, t) for i, t in enumerate(texts + [t for _, t in rows()[:30]])]
    for least in (0.25, 0.5, 0.6, 0.8):
        got = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(docs, "idx", "snippet", threshold=least, by_rule=False).collect()}
        assert got == brute(some, least)


def test_hot_shingles_are_split_without_loss(spark, docs, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "CELLS", 1 << 14)
    got = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(docs, "idx", "snippet").collect()}
    assert got == brute(rows())


def test_other_thresholds(spark, docs):
    for least in (0.3, 0.8):
        assert {(r["a"], r["b"]) for r in N.near_duplicate_pairs(docs, "idx", "snippet", threshold=least).collect()} == brute(rows(), least)


def test_groups(spark, docs):
    got = {r["idx"]: r for r in N.near_duplicate_groups(docs, "idx", "snippet").collect()}
    pairs = brute(rows())
    assert set(got) == {i for i, t in rows() if i is not None and t and shingles(t)}
    assert all(got[a]["group"] == got[b]["group"] for a, b in pairs)
    assert len({r["group"] for r in got.values()}) > 20
    assert all(r["n_copies"] >= 1 for r in got.values())


def test_empty(spark, docs):
    assert N.near_duplicate_pairs(docs.filter("idx < 0"), "idx", "snippet").collect() == []
    assert N.near_duplicate_groups(docs.filter("idx < 0"), "idx", "snippet").collect() == []
    with pytest.raises(ValueError):
        N.near_duplicate_pairs(docs, "idx", "snippet", threshold=0)


def test_a_tree_over_hamming_distances_excludes_nothing():
    """Fingerprints of 256 bits, the radius that a similarity of 0.6 needs for texts of 90 shingles: all nodes are visited."""
    r = np.random.default_rng(1)
    bits = r.random((400, 256)) < 0.25
    assert N.bk_tree_visits(bits, bits[:40], 45) > 0.95
    assert N.bk_tree_visits(bits, bits[:40], 3) < 0.5
