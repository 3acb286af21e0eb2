"""N-gram join and substring dedup against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomdex.llm import _common, ngram_join, substring_dedup

from . import cases


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
@pytest.mark.parametrize("load", [1_000_000, 300])
def test_join_is_brute_force(spark, monkeypatch, k, percent, load):
    monkeypatch.setattr(_common, "LOAD", load)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    got = ngram_join.jaccard_components(cases.frame(spark), k, percent).collect()
    want = cases.components(cases.documents(), k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 1
    assert any(c < i for i, _, c in want)


def test_join_of_nothing(spark):
    got = ngram_join.jaccard_components(cases.frame(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_id"] and got.count() == 0


def test_boundary_is_by_cost():
    for percent in (80, 85):
        largest = ngram_join.boundary(percent)
        assert any(c < n for n in range(1, largest + 1) for c in ngram_join.overlaps(n, largest, percent))  # real subsets
    for percent in (50, 80, 85):
        for n in range(1, 40):
            for m in range(n, 60):
                o = ngram_join.overlap(n, m, percent)
                assert 100 * o >= percent * (n + m - o) and 100 * (o - 1) < percent * (n + m - o + 1)


def test_subsets_alone_find_links_of_small_sets(spark, monkeypatch):
    lists = ngram_join._keys

    def subsets_only(tokens, rank, percent, largest):
        return lists(tokens, rank, percent, largest) if len(tokens) <= largest and 100 * len(tokens) < percent * (largest + 1) else np.zeros(0, np.uint64)

    base = [f"w{i}" for i in range(13)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join([*base[:6], "x", *base[7:]]), " ".join(base[:-2]), "w1 w2 w3"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(ngram_join, "_keys", subsets_only)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(cases.frame(spark, rows, False), 4, 85).collect()}
    assert got == {i: c for i, _, c in cases.components(rows, 4, 85)} and got[1] == 0 and got[3] == 0


def test_a_null_id_is_not_the_id_minus_one(spark):
    got = ngram_join.jaccard_components(cases.frame(spark, [(-1, "", None, None, None), (None, "", None, None, None)], False)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(-1, -1), (None, None)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=9).map(" ".join), min_size=1, max_size=25))
def test_join_of_tiny_alphabets(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = ngram_join.jaccard_components(cases.frame(spark, rows, False), 2, 60).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.components(rows, 2, 60)


@pytest.mark.parametrize("width", [35, 50, 8, 2, 1])
@pytest.mark.parametrize("load", [1_000_000, 300])
def test_substrings_are_brute_force(spark, monkeypatch, width, load):
    monkeypatch.setattr(_common, "LOAD", load)
    got = substring_dedup.dedup_substrings(cases.frame(spark), width).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == cases.stripped(cases.documents(), width)


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("period", sorted(substring_dedup.COVERS))
def test_covers_are_difference_covers(period):
    d = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in _common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 201: 200}
