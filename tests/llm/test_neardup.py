import itertools
import math
import random
from collections import Counter

import numpy as np

from folioforge.llm import neardup
from folioforge.llm.neardup import RARE, band_pairs, duplicate_groups, slot_counts, similar_contents, spread_pairs, weighted_samples
from folioforge.llm.words import words_of

SCHEMA = "key bigint, body string, content string, band int"


def corpus(seed=1, n=60):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(45, 90))]
        rows.append(words)
        for _ in range(rng.randint(0, 2)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    return [(k, " ".join(w), "c", 1) for k, w in enumerate(rows)]


def jaccard(a, b, n):
    sa, sb = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words_of(a), words_of(b)))
    return len(sa & sb) / len(sa | sb)


def test_pairs_against_brute_force(spark):
    rows = corpus()
    texts = {k: t for k, t, *_ in rows}
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if jaccard(texts[a], texts[b], 3) >= 0.6}
    members, pairs = similar_contents(spark.createDataFrame(rows + rows[:9], SCHEMA), "key", "body", n=3, least_words=40, bands=40, rows=4)
    got = {(r.key_a, r.key_b) for r in spread_pairs(members, pairs.where("jaccard >= 0.6")).collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want) and len(want) > 20


def test_samples_follow_the_weighted_similarity():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**63, 300, np.uint64)
    w = rng.uniform(0.6, 20, 300)
    a, b = np.arange(0, 200), np.arange(80, 300)
    samples = weighted_samples(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], w[b]]), np.array([0, len(a)]), 2000)
    rate = (samples[0] == samples[1]).mean()
    assert abs(rate - w[80:200].sum() / w.sum()) < 0.05


def test_a_large_group_of_copies_stays_linear(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(k, text, None, 0) for k in range(400)] + [(1000 + k, text.replace("t7 ", "zz "), None, 0) for k in range(30)]
    members, pairs = similar_contents(spark.createDataFrame(rows, SCHEMA), "key", "body", n=3, least_words=40, bands=20, rows=3)
    got = {(r.key_a, r.key_b) for r in spread_pairs(members, pairs.where("jaccard >= 0.6")).collect()}
    assert len(got) < 40 * 430
    assert all((0, k) in got for k in range(1, 400)) and all((0, 1000 + k) in got for k in range(30)) and all((k, 1000) in got for k in range(400))
    groups = duplicate_groups(members, pairs.where("jaccard >= 0.6")).collect()
    assert len(groups) == 430 and len({r.group_id for r in groups}) == 1 and {r.n_links for r in groups} == {1}


def test_small_classes_come_in_full(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(k, text, None, 0) for k in range(5)] + [(10 + k, text.replace("t7 ", "zz "), None, 0) for k in range(4)]
    members, pairs = similar_contents(spark.createDataFrame(rows, SCHEMA), "key", "body", n=3, bands=20, rows=3)
    got = {(r.key_a, r.key_b) for r in spread_pairs(members, pairs.where("jaccard >= 0.6")).collect()}
    assert got == set(itertools.combinations([0, 1, 2, 3, 4, 10, 11, 12, 13], 2))


def test_dirt(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "a b c d e f", "x", 1), (3, "short", None, None), (4, "w " * 100_000, "x", 1), (5, "w " * 100_000, "x", 1)]
    members, pairs = similar_contents(spark.createDataFrame(rows, SCHEMA), "key", "body", n=5)
    assert sorted(r.key for r in members.collect()) == [4, 5] and pairs.count() == 0
    assert {(r.key_a, r.key_b) for r in spread_pairs(members, pairs).collect()} == {(4, 5)}
    members, pairs = similar_contents(spark.createDataFrame([], SCHEMA), "key", "body")
    assert members.count() == 0 and pairs.count() == 0 and duplicate_groups(members, pairs).count() == 0


def test_chains_form_one_group(spark):
    members = spark.createDataFrame([(k, k * 10) for k in range(40)], "key bigint, content bigint")
    pairs = spark.createDataFrame([(k * 10, k * 10 + 10) for k in range(30)], "content_a bigint, content_b bigint")
    got = {r.key: r.group_id for r in duplicate_groups(members, pairs).collect()}
    assert {got[k] for k in range(31)} == {0} and all(got[k] == k * 10 for k in range(31, 40))


def test_weights_take_exact_document_frequencies(spark):
    rows = corpus(seed=5) + [(5000 + k, t, "c", 1) for k, t, *_ in corpus(seed=5)[:6]]  # copies count, redelivered rows don't
    grams = {k: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for k, t, *_ in rows if (w := words_of(t))}
    df = Counter(g for c in grams.values() for g in c)
    idf = {g: max(0.5, math.log((len(grams) + 1) / (max(n, len(grams) / RARE) + 1))) for g, n in df.items()}

    def weighted(a, b):
        wa, wb = ({g: (1 + math.log(n)) * idf[g] for g, n in grams[k].items()} for k in (a, b))
        low = sum(min(wa[g], wb[g]) for g in wa.keys() & wb.keys())
        return low / (sum(wa.values()) + sum(wb.values()) - low)

    frame = spark.createDataFrame(rows + rows[:70] * 4, SCHEMA)
    members, pairs = similar_contents(frame, "key", "body", n=5, bands=30, rows=5)
    key = {r.content: r.key for r in members.collect()}
    got = {frozenset((key[r.content_a], key[r.content_b])): r.weighted for r in pairs.collect()}
    assert len(got) > 20 and all(abs(w - weighted(*pair)) < 1e-9 for pair, w in got.items())
    _, near = similar_contents(frame, "key", "body", n=5, bands=30, rows=5, least=0.8)
    assert {frozenset((key[r.content_a], key[r.content_b])) for r in near.where("weighted >= 0.8").collect()} == {p for p, w in got.items() if w >= 0.8}


def test_large_bands_are_compared_in_parts(spark, monkeypatch):
    rows = [(b, c) for b, n in ((1, 3), (2, 90), (3, 1), (4, 40)) for c in range(n)]
    want = {(x, y) for b, n in ((1, 3), (2, 90), (4, 40)) for x, y in itertools.combinations(range(n), 2)}
    monkeypatch.setattr(neardup, "PART_ROWS", 16)
    got = [(r.content_a, r.content_b) for r in band_pairs(spark.createDataFrame(rows, "band bigint, content bigint")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_many_variants_of_a_template_give_linear_work(spark, monkeypatch):
    """The pairs measured stay near the number of contents, and the group is whole."""
    monkeypatch.setattr(neardup, "PART_ROWS", 32)
    monkeypatch.setattr(neardup, "_LOCAL_ROWS", 8)
    base, n = [f"t{i}" for i in range(250)], 1500
    rows = []
    for k in range(n):
        rows.append((k, " ".join([*base, f"x{k}"]), None, 0))
    rows += [(5000 + k, " ".join(f"{k}u{i}" for i in range(60)), None, 0) for k in range(40)]
    members, pairs = similar_contents(spark.createDataFrame(rows, SCHEMA), "key", "body", n=5, bands=30, rows=5, least=0.8, grouped=True)
    assert pairs.count() < 40 * n
    groups = {r.key: r.group_id for r in duplicate_groups(members, pairs).collect()}
    assert len({groups[k] for k in range(n)}) == 1 and len(set(groups.values())) == 41


def test_grouped_pairs_give_the_groups_of_all_pairs(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(seed=9, n=80), SCHEMA)
    setting = dict(n=5, bands=30, rows=5, least=0.5)

    def groups(**more):
        members, pairs = similar_contents(frame, "key", "body", **setting, **more)
        of = {}
        for r in duplicate_groups(members, pairs).collect():
            of.setdefault(r.group_id, set()).add(r.key)
        return sorted(map(sorted, of.values()))

    want = groups()
    monkeypatch.setattr(neardup, "PART_ROWS", 1)
    assert groups(grouped=True) == want and any(len(g) > 2 for g in want)


def test_slot_counts_are_those_of_the_texts(spark):
    rows = corpus(seed=2, n=20)
    slim = spark.createDataFrame(rows, SCHEMA).selectExpr("key", "body as text").repartition(5)
    counts = slot_counts(slim.mapInArrow(lambda it: neardup._profile(it, 3, 0), "key bigint, content bigint, block int, counts binary"))
    want = Counter()
    for _, t, *_ in rows:
        want.update(set((neardup.shingle_hashes(neardup.hash_words(words_of(t)), 3) & np.uint64(neardup.IDF_SLOTS - 1)).tolist()))
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(want)
