import random
from datetime import datetime

import pytest

from folioforge.operators import hierarchy as H
from folioforge.operators.hierarchy import closure, hierarchy, hierarchy_labels, peel, section_links

LINKS = "key bigint, parent bigint"


def brute(parent):
    out = set()
    for k in parent:
        seen, x = set(), parent[k]
        while x is not None and x not in seen:
            seen.add(x)
            out.add((x, k))
            x = parent[x]
    return out


@pytest.mark.parametrize("seed,n,back", [(1, 60, 0.0), (2, 80, 0.1), (3, 40, 0.6)])
def test_closure_against_walks(spark, seed, n, back):
    rng = random.Random(seed)
    parent = {k: None if rng.random() < 0.15 else (rng.randrange(n) if rng.random() < back else (rng.randrange(k) if k else None)) for k in range(n)}
    labels = hierarchy_labels(spark.createDataFrame(list(parent.items()), LINKS))
    assert {(r.ancestor, r.key) for r in closure(labels).collect()} == brute(parent)
    on_loop = {k for k in parent if (k, k) in brute(parent)}
    assert {r.key for r in labels.where("on_loop").collect()} == on_loop


def test_long_chain_takes_few_rounds(spark):
    n = 700
    labels = hierarchy_labels(spark.createDataFrame([(k, k - 1 if k else None) for k in range(n)], LINKS))
    assert {(r.depth, r.pre, r.size) for r in labels.collect()} == {(k, k, n - k) for k in range(n)}


def test_wide_family_and_loops(spark):
    rows = [(0, None)] + [(k, 0) for k in range(1, 300)] + [(1000, 1001), (1001, 1000), (1002, 1002), (1003, 1000)]
    df = spark.createDataFrame(rows, LINKS)
    assert {r.key for r in peel(df).collect()} == {1000, 1001, 1002}
    got = {(r.key, r.root, r.depth) for r in hierarchy_labels(df).where("key >= 1000").collect()}
    assert got == {(1000, 1000, 0), (1001, 1000, 1), (1003, 1000, 1), (1002, 1002, 0)}


def test_sections_latest_row_and_dirty_parents(spark):
    t = lambda d: datetime(2025, 1, d)
    rows = [
        (1, "d", "a", None, t(1), "x"), (2, "d", "b", "a", t(1), "x"), (2, "d", "b", "c", t(2), "x"), (2, "d", "b", "c", t(2), "x"), (3, "d", "c", "a", t(1), None),
        (4, "d", "e", "", t(1), "x"), (5, "d", "f", "nowhere", t(1), "x"), (6, "other", "g", "a", t(1), "x"), (None, "d", "h", "a", t(1), "x"), (7, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "section_key bigint, doc_id string, section_id string, parent_id string, updated_at timestamp, depth string")
    got = {(r.key, r.parent) for r in section_links(df).collect()}
    assert got == {(1, None), (2, 3), (3, 1), (4, None), (5, None), (6, None), (7, None)}
    full = {r.section_key: (r.root_key, r.depth, r.path, r.n_descendants) for r in hierarchy(df).collect()}
    assert full[2] == (1, 2, [1, 3, 2], 0) and full[1] == (1, 0, [1], 2)
    assert hierarchy(df.limit(0)).count() == 0


@pytest.mark.parametrize("stretch", [3, 17])
def test_many_stretches_give_the_same(spark, monkeypatch, stretch):
    monkeypatch.setattr(H, "STRETCH", stretch)
    monkeypatch.setattr(H, "SPAN", 4)
    rng = random.Random(stretch)
    n = 50
    names = rng.sample(range(-500, 500), n)
    parent = {names[k]: None if rng.random() < 0.1 else names[rng.randrange(n) if rng.random() < 0.15 else max(0, k - 1)] for k in range(n)}
    parent |= {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1001, 1004: 1004}
    labels = hierarchy_labels(spark.createDataFrame(list(parent.items()), LINKS))
    want = brute(parent)
    assert {(r.ancestor, r.key) for r in closure(labels).collect()} == want
    assert {r.key for r in labels.where("on_loop").collect()} == {k for k in parent if (k, k) in want}


def test_contraction_adds_up(spark, monkeypatch):
    monkeypatch.setattr(H, "STRETCH", 5)
    rows = [(k, k + 2 if k < 18 else None, k) for k in range(20)] + [(100, 101, 1), (101, 100, 1)]
    got = {r.at: r for r in H.contract(spark.createDataFrame(rows, "at bigint, next bigint, w bigint"), ["w"]).collect()}
    for k in range(20):
        r = got[k]
        steps = list(range(k, r.last + 1, 2))
        assert r.w == sum(steps) and r.next == (r.last + 2 if r.last < 18 else None) and not r.turns
    assert got[100].turns == got[101].turns
    assert H.contract(spark.createDataFrame([], "at bigint, next bigint, w bigint"), ["w"]).count() == 0
