import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from leafmill.llm import mixing as M


def test_shares_are_exact_where_repeats_allow():
    leaves = [(("all", "en", "a"), 1000.0), (("all", "fr", "a"), 500.0), (("all", "en", "b"), 100.0)]
    got = M.plan(leaves, {"a": (0.75, 1), "b": (0.25, 3)})
    b = sum(v for p, v in got.items() if p[-1] == "b")
    assert b == pytest.approx(300) and sum(got.values()) == pytest.approx(1200)
    assert got["all", "en", "a"] == pytest.approx(600) and got["all", "fr", "a"] == pytest.approx(300)


def test_shortage_goes_to_siblings_first():
    leaves = [(("all", "en", "a"), 1000.0), (("all", "en", "b"), 10.0), (("all", "fr", "c"), 1000.0)]
    got = M.plan(leaves, {"a": (0.25, 1), "b": (0.25, 1), "c": (0.5, 1)}, 400)
    assert got["all", "en", "b"] == 10 and got["all", "en", "a"] == pytest.approx(190) and got["all", "fr", "c"] == pytest.approx(200)
    # English is exhausted: only then the rest goes to French.
    got = M.plan(leaves, {"a": (0.25, 1), "b": (0.25, 1), "c": (0.5, 2)}, 2500)
    assert got["all", "en", "a"] == 1000 and got["all", "fr", "c"] == pytest.approx(1490)


def test_nothing_usable():
    assert M.plan([(("all", "en", "a"), 0.0)], {"a": (1.0, 2)}) == {}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"some words number {i} " * (1 + i % 4), "EN" if i % 3 else "fr-x", "big", 0) for i in range(200)]
    rows += [(1000 + i, f"tiny text {i}", None, "small", 0) for i in range(12)]
    rows += [(2000, None, "en", "small", 0), (2001, "", "", "small", 0), (2002, "lost", "en", None, 0), (2003, "other", "en", "none of them", 0), (5, "repeated id", "en", "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.1, 4), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mix(spark, tables):
    docs, targets = tables
    sized = M.counted(docs, targets)
    mixed = M.mix(sized, targets)
    got = mixed.collect()
    assert {r["source"] for r in got} == {"big", "small"}
    assert max(r["copies"] for r in got if r["source"] == "big") == 1 and max(r["copies"] for r in got if r["source"] == "small") <= 4
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(sized, targets).collect()))
    shares = {r["source"]: r for r in M.reached(mixed, targets.filter("source IS NOT NULL")).collect()}
    assert shares["absent"]["tokens"] == 0 and shares["big"]["reached_share"] == pytest.approx(8 / 9, abs=0.01)


def test_a_given_total_is_kept(spark, tables):
    docs, targets = tables
    sized = M.counted(docs, targets)
    tokens = sum(r["n_tokens"] * r["copies"] for r in M.mix(sized, targets, total=300).collect())
    assert abs(tokens - 300) <= 10


def test_empty(spark, tables):
    docs, targets = tables
    sized = M.counted(docs.filter("doc_id < 0"), targets)
    assert M.mix(sized, targets).collect() == []
    assert {r["reached_share"] for r in M.reached(M.mix(sized, targets), targets).collect()} == {0.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["en", "fr", ""]), st.integers(0, 9)), max_size=40), st.integers(1, 3), st.integers(1, 3), st.one_of(st.none(), st.integers(0, 400)))
def test_no_document_is_used_too_often(spark, rows, cap_a, cap_b, total):
    """Documents without tokens included, which fill no budget."""
    sized = spark.createDataFrame([(i, "all", lang, source, n) for i, (source, lang, n) in enumerate(rows)], "id bigint, domain string, language string, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, cap_a), ("b", 0.3, cap_b)], "source string, target_share double, max_repeats int")
    got = M.mix(sized, targets, total=total).collect()
    assert len({r["id"] for r in got}) == len(got)
    assert all(1 <= r["copies"] <= {"a": cap_a, "b": cap_b}[r["source"]] for r in got)


def test_zero_tokens_at_the_front_keep_the_cap(spark):
    sized = spark.createDataFrame([(i, "all", "en", "a", 0 if i < 50 else 7) for i in range(60)], "id bigint, domain string, language string, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert {r["copies"] for r in M.mix(sized, targets).collect()} == {2}
    assert {r["copies"] for r in M.mix(sized, targets, total=71).collect() if r["n_tokens"] == 0} == {1}


@given(st.lists(st.integers(1, 40), max_size=9), st.floats(-5, 200))
def test_nearest_subset_equals_brute_force(sizes, wanted):
    got = sum(sizes[k] for k in M.nearest_subset(sizes, wanted))
    sums = {sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(2 ** len(sizes))}
    assert abs(got - wanted) == min(abs(x - wanted) for x in sums)


def test_nearest_subset_of_many():
    sizes = [3] * 40 + [1000]
    assert sum(sizes[k] for k in M.nearest_subset(sizes, 61)) == 60 and sum(sizes[k] for k in M.nearest_subset(sizes, 1002)) == 1003
