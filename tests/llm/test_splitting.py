import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm.splitting import block_marks, oversized_kinds, pieces_with_pages, split_oversized, split_text

CHUNK = "chunk_key bigint, doc_id string, text string, page_start int, block_ids array<string>, piece string, marks int"
BLOCK = "doc_id string, block_id string, page int, text string, block_type string, heading_level int, table_data struct<headers:array<string>,body_rows:array<array<string>>,caption:string>, image struct<uri:string,alt:string,caption:string>, metadata map<string,string>"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#é\u3000", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_pieces_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = split_text(text, limit, overlap)
    at = 0
    for _, piece, start, end, new_from, cut in pieces:
        assert piece == text[start:end] and 0 < len(piece) <= limit
        assert new_from == at and start <= new_from < end and new_from - start <= overlap
        assert cut == ("end" if end == len(text) else cut)
        at = end
    assert at == len(text)
    longest = max(map(len, re.split(r"\s+", text)), default=0)
    if len(text) > limit:
        assert any(p[5] == "character" for p in pieces) == (longest > limit)


def test_natural_boundaries_and_overlap():
    text = "# A\n\n" + "One two three. " * 20 + "\n\n" + "Four five six. " * 20
    pieces = split_text(text, 200, 40)
    assert {p[5] for p in pieces} <= {"paragraph", "sentence", "end"}
    for a, b in zip(pieces, pieces[1:]):
        assert b[2] < a[3] or a[3] - b[2] == 0
        assert text[b[2] - 1].isspace()


def test_exactly_at_the_limit():
    assert [p[5] for p in split_text("x" * 1500)] == ["end"]
    assert "character" not in {p[5] for p in split_text("x" * 1500 + " y")}
    assert "character" in {p[5] for p in split_text("x" * 1501)}
    assert split_text(" " * 4000)[0][5] == "word"


def test_kinds_pages_and_dirt(spark):
    a, b = "alpha " * 200, "beta. " * 200
    rows = [(1, "d", a + "\n\n" + b, 7, ["b1", "b2"], "z", 1), (1, "d", a + "\n\n" + b, 7, ["b1", "b2"], "z", 1), (2, "d", "x" * 2000, None, None, None, None), (3, "d", None, 1, ["b1"], "z", 1), (4, "d", "", 1, ["b1"], "z", 1), (5, None, "short", 1, [], "z", 1)]
    chunks = spark.createDataFrame(rows, CHUNK)
    blocks = spark.createDataFrame([("d", n, p, t, "paragraph", None, None, None, None) for n, p, t in (("b1", 3, a), ("b2", 4, b), ("b2", 4, b))] + [(None,) * 9], BLOCK)
    assert sorted(oversized_kinds(chunks, "chunk_key").collect()) == [(1, "natural"), (2, "hard")]
    got = {(r.chunk_key, r.piece_no): (r.page_start, r.page_end) for r in pieces_with_pages(chunks, blocks).collect()}
    assert got == {(1, 0): (3, 3), (1, 1): (3, 4), (2, 0): (None, None), (2, 1): (None, None)}
    assert oversized_kinds(chunks.limit(0), "chunk_key").count() == 0 and pieces_with_pages(chunks.limit(0), blocks).count() == 0
    assert split_oversized(chunks).where("chunk_key = 2").count() == 2
    with pytest.raises(ValueError):
        split_oversized(chunks, limit=10, overlap=10)


def test_blocks_are_found_whole():
    shape = lambda page, text, other=None: {"page": page, "markdown": text, "plain": other}
    same = "Equal beginnings of some sixty characters, so that a prefix would not do: "
    text = "\n\n".join(["ID", f"{same}ID one", f"{same}ID two", "edited since", "- item", "ID"])
    blocks = [shape(1, "ID"), shape(2, f"{same}ID one"), shape(3, f"{same}ID two"), shape(4, "as it was once"), shape(5, "item", "- item"), shape(6, ""), shape(7, "ID")]
    marks = block_marks(text, blocks, 0)
    assert [(text[a:].split("\n\n")[0][-6:], p) for a, p in marks[1:]] == [("ID", 1), ("ID one", 2), ("ID two", 3), (" since", 4), ("- item", 5), ("ID", 7)]
    assert block_marks("", blocks, 9)[0] == (0, 9) and block_marks(text, [], None) == [(0, None)]
