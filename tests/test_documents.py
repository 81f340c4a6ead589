import json
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import chunks as C
from folioforge.operators import clean as P
from folioforge.operators import document as D
from folioforge.operators import ordered as O
from folioforge.sources import canonical as J
from tests.test_refine import SCHEMA, block, frame


@pytest.fixture(autouse=True)
def short_segments(monkeypatch):
    monkeypatch.setattr(O, "SEGMENT", 5)


def test_section_tree_against_stack(spark):
    import random

    rng, rows, want = random.Random(9), [], set()
    for d in range(25):
        name, stack, n, current = f"d{d}", [], -1, None
        for i in range(30):
            if rng.random() < 0.4:
                level = rng.randint(1, 4)
                rows.append(block(i, "heading", f"T{i}", level, doc=name))
                while stack and stack[-1][1] >= level:
                    stack.pop()
                n += 1
                current = [name, n, f"T{i}", level, stack[-1][0] if stack else None, 1]
                stack.append((n, level))
                want.add(tuple(current[:5]))
            else:
                rows.append(block(i, "paragraph", "x", doc=name))
                if current is None:
                    n, current, stack = 0, [name, 0, "Preamble", 1, None, 1], [(0, 1)]
                    want.add(tuple(current[:5]))
    made = D.build_sections(frame(spark, rows)).collect()
    assert {(r.doc_id, r.section_no, r.title, r.level, r.parent_no) for r in made} == want
    assert all(r.section_id.startswith(f"sec_{r.section_no:04d}_") for r in made)
    assert sum(len(r.block_ids) for r in made) == len(rows)


def test_titles(spark):
    rows = [
        block(0, "heading", "All rights reserved", doc="a"), block(1, "heading", "O-RAN", doc="a"), block(2, "paragraph", "Use cases", doc="a"), block(3, "paragraph", "x" * 200, doc="a"), block(4, "paragraph", "late", doc="a"),
        block(0, "paragraph", "Late page", page=2, doc="b"), block(1, "paragraph", "Found", page=1, doc="b"), block(2, "paragraph", "other", page=2, doc="b"), block(3, "paragraph", "not me", page=1, doc="b"),
        block(0, "heading", "Contents", page=3, doc="c"), block(1, "heading", "Real title", page=3, doc="c"), block(0, "image", page=1, doc="d"),
    ]
    hints = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", ""), ("d", "My-hint_x"), ("e", None)], "doc_id string, title_hint string")
    got = {r.doc_id: r.title for r in D.resolve_titles(frame(spark, rows), hints).collect()}
    assert got == {"a": "O-RAN Use cases", "b": "Found", "c": "Real title", "d": "My hint x", "e": "Untitled"}


SECTION = "section_key bigint, doc_id string, section_id string, title string, section_level int, ord int, parent_id string, block_ids array<string>, page_start int, page_end int, metadata map<string,string>"


def test_section_chunks(spark):
    rows = [block(0, "heading", "1 A", 1), block(1, "heading", "1.1 B", 2), block(2, "list_item", "item", 2), block(3, "code", "x=1"), block(4, "heading", "2 C", 1), block(0, "paragraph", "alone", doc="o"), block(1, "formula", "a^2", doc="o")]
    sections = spark.createDataFrame([(1, "d", "s1", "1 A", 1, 0, None, ["b0"], 1, 1, {}), (2, "d", "s2", "1.1 B", 2, 1, "s1", ["b1", "b2", "b3"], 1, 2, {}), (3, "d", "s3", "2 C", 1, 2, None, ["b4"], None, None, {})], SECTION)
    blocks = frame(spark, rows)
    structural = D.structural_parents(sections, blocks)
    assert [(r.doc_id, r.section_id) for r in structural.collect()] == [("d", "s1")]
    got = sorted((r.chunk_id, r.text, r.chunk_index, r.block_ids) for r in C.section_chunks(sections, blocks, structural).collect())
    assert got == [("d:s2", "## 1.1 B\n\n  - item\n\n```\nx=1\n```", 0, ["b1", "b2", "b3"]), ("d:s3", "# 2 C", 1, ["b4"]), ("o:orphan", "alone\n\n$$\na^2\n$$", 0, ["b0", "b1"])]


def test_semantic_chunks(spark):
    def topics(texts):
        import numpy as np

        return np.array([[t.count("Alpha"), t.count("Beta"), 0.1] for t in texts], float)

    text = " ".join(f"Alpha sentence number {i} says the same." for i in range(20)) + " " + " ".join(f"Beta sentence number {i} says more." for i in range(5))
    got = C.semantic_chunks(frame(spark, [block(0, "paragraph", text, page=4), block(1, "table", page=5)]), topics, least=20, most=60).orderBy("chunk_index").collect()
    assert len(got) >= 2 and all(len(r.text.split()) <= 60 for r in got)
    assert not any("Alpha" in r.text and "Beta" in r.text and len(r.text.split()) > 30 for r in got)
    assert got[0].chunk_id == "d:sem_0000" and got[0].page_start == 4 and got[0].block_ids == ["b0"]
    assert C.opening_units(["a " * 200, "b"], topics) == [True, True] and C.opening_units([], topics) == []
    with pytest.raises(ValueError):
        C.semantic_chunks(frame(spark, []), least=5, most=2)
    with pytest.raises(ValueError):
        C.chunker("other")


def test_repeated_texts_and_cover(spark):
    rows = [block(i, "paragraph", f"Page {i} of 9", page=i, box=(0.0, 10.0, 9.0, 20.0, None)) for i in range(1, 5)] + [block(10 + i, "paragraph", f"body {'abcd'[i]}", page=i + 1, box=(0.0, 300.0, 9.0, 320.0, None)) for i in range(4)]
    rows += [block(20, "image", page=1, box=(0.0, 400.0, 9.0, 420.0, None)), block(21, "image", page=2, box=(0.0, 800.0, 9.0, 840.0, None)), block(22, "paragraph", "Copyright x", page=1)]
    df = frame(spark, rows)
    assert [(r.norm, r.zone, r.n_pages) for r in P.repeated_texts(df).collect()] == [("page of", "top", 4)]
    assert sorted(r.ord for r in P.clean_physical(df).collect()) == [10, 11, 12, 13]
    assert P.clean_physical(df, False, False, False).count() == len(rows)
    images = spark.createDataFrame([("d", p, "logo", 4) for p in (1, 2, 3)] + [("d", 1, "x", 4)], "doc_id string, page int, image string, n_pages int")
    assert [(r.image, r.n) for r in P.repeated_images(images).collect()] == [("logo", 3)]


def test_json_round_trip(spark):
    rows = [block(0, "heading", 'Q "x" \n', 1), block(1, "table", page=None, table=(["A"], [["1"]], None)), block(2, "paragraph", None)]
    sections = spark.createDataFrame([(1, "d", "s1", "T", 1, 0, None, ["b0", "b1"], 1, None, {"numbering": "1"}), (2, "d", "s2", None, 2, 1, 's"1', [], None, None, {})], SECTION)
    registry = spark.createDataFrame([("d", "x/d.pdf", "Title", "p", None, {"family": "oran", "num_blocks": "3", "group": "WG1", "failed_shards": "1,4", "pages_per_shard": "50", "free": "z"}), ("e", "e.pdf", None, None, None, {})], "doc_id string, source_path string, title string, profile_id string, parser string, extra map<string,string>")
    blocks = frame(spark, rows)
    out = J.to_json(registry, blocks, sections, D.page_index(blocks))
    got = {r.doc_id: json.loads(r.payload) for r in out.collect()}
    meta = got["d"]["metadata"]
    assert meta["stats"] == {"num_blocks": 3} and meta["identity"] == {"group": "WG1"} and meta["ingest"] == {"failed_shards": "1,4", "pages_per_shard": "50"} and meta["extra"] == {"free": "z"}
    assert [s["parent_id"] for s in got["d"]["sections"]] == [None, 's"1'] and [b["id"] for b in got["d"]["blocks"]] == ["b0", "b1", "b2"]
    assert "page" not in got["d"]["blocks"][1] and got["e"] == {"schema_version": "1.0", "metadata": {"source_path": "e.pdf"}, "pages": [], "sections": [], "blocks": []}
    back = {r.doc_id: r for r in J.from_json(out).withColumn("bag", J.extra_of(F.col("doc.metadata"))).collect()}
    assert back["d"].problem is None and back["d"].bag == {"family": "oran", "num_blocks": "3", "group": "WG1", "failed_shards": "1,4", "pages_per_shard": "50", "free": "z"}
    assert back["d"].doc.blocks[0].text == 'Q "x" \n' and back["d"].doc.sections[1].parent_id == 's"1'
    bad = spark.createDataFrame([("{}",), (None,), ('{"schema_version":"2.0"}',), ('{"schema_version":"1.0","metadata":{}}',), ("{x",)], "payload string")
    assert [r.problem for r in J.from_json(bad).collect()] == ["no schema_version", "no schema_version", "another schema_version", "no source_path", "no schema_version"]


def test_stats_and_pages(spark):
    rows = [block(0, "table", page=1, table=([], [], None)), block(1, "table", page=3, table=(["A"], [["1"]], None)), block(2, "paragraph", "x", page=3)]
    blocks = frame(spark, rows)
    registry = spark.createDataFrame([("d", "T", {"failed_shards": "1, 4,"}), ("e", None, {})], "doc_id string, title string, extra map<string,string>")
    got = {r.doc_id: r for r in D.ingest_stats(blocks, spark.createDataFrame([], SECTION), registry).collect()}
    assert (got["d"].num_pages, got["d"].num_tables, got["d"].degraded_blocks, got["d"].failed_shards, got["d"].blocks_by_type) == (2, 2, 1, 2, {"paragraph": 1, "table": 2})
    assert got["e"].num_blocks == 0
    pages = spark.createDataFrame([("d", 1, 595.0), ("d", 2, 595.0)], "doc_id string, number int, width double")
    assert {(r.number, tuple(r.block_ids)) for r in D.page_index(blocks, pages).collect()} == {(1, ("b0",)), (2, ()), (3, ("b1", "b2"))}
    assert SCHEMA


def test_navigation_and_settings(spark):
    from folioforge.seams import choose
    from folioforge.settings import Settings, load_settings

    sections = spark.createDataFrame([(1, "d", "s1", "T", 1, 0, None, ["b1", "zz", "b0"], 1, None, {}), (2, "d", "s2", None, 2, 1, "s1", [], None, None, {})], SECTION)
    blocks = frame(spark, [block(0, "paragraph", "x", page=1), block(1, "paragraph", "y", page=2)])
    assert [r.section_id for r in D.roots(sections).collect()] == ["s1"] and [r.section_id for r in D.children(sections, "d", "s1").collect()] == ["s2"]
    assert [(r.nth, r.block_id) for r in D.blocks_of_sections(sections, blocks).orderBy("nth").collect()] == [(0, "b1"), (2, "b0")]
    assert [r.block_id for r in D.blocks_of_page(blocks, "d", 2).collect()] == ["b1"] and D.block_by_id(blocks, "d", "b0").text == "x"
    with pytest.raises(KeyError):
        D.block_by_id(blocks, "d", "no")
    assert choose("x", "a", {"a": 1}) == 1
    with pytest.raises(ValueError):
        choose("x", "b", {"a": 1})
    spark.conf.set("folioforge.top_n", "7")
    assert load_settings(spark).top_n == 7 and load_settings().top_n == 10
    with pytest.raises(ValueError):
        Settings(prefetch=0)


def test_semantic_chunks_do_not_depend_on_stretches(spark):
    """The same chunks as by one pass over the whole document, wherever it is cut."""
    rng = random.Random(6)
    words = ["radio", "cell", "beam", "slot", "tax", "law", "court", "rule"]
    rows = [block(i, "paragraph", " ".join(rng.choice(words[:4] if rng.random() < 0.5 else words[4:]) for _ in range(rng.choice([1, 1, 2, 9, 30])))) for i in range(60)]
    df = frame(spark, rows)
    units = [r.unit for r in C.units(df).orderBy("ord", "nth").collect()]
    for least, most in ((5, 40), (20, 25)):
        want, flags = [], C.opening_units(units, C.hashing_encoder, 0.6, least, most)
        for unit, opens in zip(units, flags):
            want = [*want, unit] if opens else [*want[:-1], f"{want[-1]} {unit}"]
        for stretch in (1, 4, 4096):
            got = C.semantic_chunks(df, threshold=0.6, least=least, most=most, stretch=stretch).orderBy("chunk_index").collect()
            assert [r.text for r in got] == want and [r.chunk_index for r in got] == list(range(len(want)))
            assert sum(r.n_units for r in got) == len(units)


def test_documents_are_written_in_pieces(spark, tmp_path):
    blocks = frame(spark, [block(i, "paragraph", f'line "{i}"\n,', page=1 + i // 3) for i in range(9)])
    registry = spark.createDataFrame([("d", "a.pdf", "T", "p", "x", {"group": "WG1"})], "doc_id string, source_path string, title string, profile_id string, parser string, extra map<string,string>")
    sections = spark.createDataFrame([("d", "s1", "One", 1, 0, None, ["block_0"], 1, 1, {})], "doc_id string, section_id string, title string, section_level int, ord int, parent_id string, block_ids array<string>, page_start int, page_end int, metadata map<string,string>")
    tables = (registry, blocks, sections, D.page_index(blocks))
    J.write_documents(J.document_parts(*tables), str(tmp_path / "out"))
    (written,) = (tmp_path / "out" / "doc_id=d").glob("*.txt")
    assert json.loads(written.read_text()) == json.loads(J.to_json(*tables).first().payload)
    assert [b["text"] for b in json.loads(written.read_text())["blocks"]] == [f'line "{i}"\n,' for i in range(9)]
