from folioforge.llm import leakage as L

DOC, ITEM = "doc_id bigint, text string, item_id int, suite string", "item_id bigint, text string, suite string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 0, "s") for i, t in docs], DOC), spark.createDataFrame([(i, t, "s") for i, t in items], ITEM)


def found(spark, docs, items):
    return sorted((r.doc_id, r.item_id) for r in L.find_leaks(*frames(spark, docs, items)).collect())


def test_windows_case_marks_and_invisible(spark):
    items = [(1, LONG), (2, "Short item, only five words!"), (2, "Short item, only five words!"), (3, None), (4, ""), (5, "..."), (None, "x y")]
    part = " ".join(LONG.split()[1:14])
    docs = [
        (1, f"x {part.upper()} y"), (2, f"x {' '.join(LONG.split()[:12])} y"), (3, "a SHORT\u200b item --\r\nonly **five** words b"), (4, "short item only five"), (5, part.replace(" ", "\n- ")), (6, None), (7, ""),
        (8, part.replace("seven", "sev\u00aden")), (9, part.replace("seven", "other")), (None, LONG), (10, "z " * 150_000 + LONG), (10, "z " * 150_000 + LONG), (11, LONG + " " + LONG),
    ]
    assert found(spark, docs, items) == [(1, 1), (3, 2), (5, 1), (8, 1), (10, 1), (11, 1)]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_slices_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}_{k}" for k in range(20))) for i in range(6)]
    docs = [(i, "so " + " ".join(f"w{i}x{k}" for k in range(9)) + " " + t.replace("_", " ")) for i, t in items]
    want = found(spark, docs, items)
    monkeypatch.setattr(L, "SLICE_WORDS", 25)
    assert found(spark, docs, items) == want and len(want) == 6


def test_removal(spark):
    docs, items = frames(spark, [(1, f"Before. {LONG}! After"), (2, "clean"), (3, None), (4, f"a {LONG.replace('two', 't\u200bwo')} b")], [(1, LONG)])
    got = {r.doc_id: r.text for r in L.remove_leaks(docs, items).collect()}
    assert got == {1: "Before. ! After", 2: "clean", 3: None, 4: "a  b"}
    assert sorted(r.doc_id for r in L.remove_leaks(docs, items, drop_documents=True).collect()) == [2, 3]
    assert [(r.item_id, r.n_documents) for r in L.leak_report(docs, items).collect()] == [(1, 2)]


def test_removal_looks_at_the_stored_text_only(spark, monkeypatch):
    """Words that meet only after a cut are no leak, and overlapping leaks of different slices go whole."""
    a, b = [" ".join(f"{x}{k}" for k in range(20)) for x in "ab"]
    half = lambda t, i, j: " ".join(t.split()[i:j])
    docs, items = frames(spark, [(1, f"x {half(b, 0, 7)} {a} {half(b, 7, 20)} y"), (2, f"x {a} {half(b, 0, 13)} y"), (None, f"p {b} q"), (3, "clean"), (3, "clean"), (4, None)], [(1, a), (2, b), (3, f"{half(a, 10, 20)} {half(b, 0, 8)}")])
    whole = sorted((r.doc_id or 0, r.text or "") for r in L.remove_leaks(docs, items).collect())
    assert whole == [(0, "p  q"), (1, f"x {half(b, 0, 7)}   y"), (2, "x  y"), (3, "clean"), (3, "clean"), (4, "")]
    monkeypatch.setattr(L, "SLICE_WORDS", 25)
    assert sorted((r.doc_id or 0, r.text or "") for r in L.remove_leaks(docs, items).collect()) == whole


def test_lookalikes_are_found_on_demand(spark):
    twin = LONG.replace("o", "\u043e").replace("fif", "\uff46\uff49\uff46")
    docs, items = frames(spark, [(1, f"A. {twin}! B"), (2, f"\u0130 x {LONG} y")], [(1, LONG)])
    assert sorted(r.doc_id for r in L.find_leaks(docs, items).collect()) == [2]
    assert sorted(r.doc_id for r in L.find_leaks(docs, items, lookalikes=True).collect()) == [1, 2]
    assert {r.doc_id: r.text for r in L.remove_leaks(docs, items, lookalikes=True).collect()} == {1: "A. ! B", 2: "\u0130 x  y"}


def test_scan_equals_brute_force():
    import random

    rng = random.Random(2)
    words = list("abcdefg")
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(12)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(40)]
    want = set()
    for i, t in items:
        w = t.split()
        size = min(4, len(w))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        want |= {(d, i, k, k + size) for d, x in enumerate(texts) for k in range(len(x) - size + 1) if tuple(x[k : k + size]) in grams}
    assert set(L.GramSet(items, 4).scan(texts)) == want
