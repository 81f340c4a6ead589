"""Oversized texts cut at natural boundaries, with overlap.

The separators form a hierarchy: section heading, paragraph, sentence, word, character. A unit above the limit is cut by the
next separator down, until all units fit; units are then packed greedily, and each piece but the first repeats up to the
given overlap of the text before it, from a word boundary on. Offsets refer to the stored text, so the pieces cover it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B

#: Places where a unit ends, from the strongest on. A separator belongs to the unit before it.
_SEPARATORS = (
    ("section", re.compile(r"\n+(?=#{1,6} )")),
    ("paragraph", re.compile(r"(?:\r?\n[ \t]*){2,}")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"(?<=[.!?…;:])\s+")),
    ("word", re.compile(r"\s+")),
)
LEVELS = tuple(name for name, _ in _SEPARATORS) + ("character",)
PIECE = "piece_no int, text string, start int, end int, new_from int, cut string"
_PIECES = pa.struct([("piece_no", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("new_from", pa.int32()), ("cut", pa.string())])


def _units(text: str, lo: int, hi: int, limit: int, level: int) -> list[tuple[int, int]]:
    """[lo, hi) as consecutive (end, level of the boundary there), each unit at most ``limit`` long."""
    out: list[tuple[int, int]] = []
    todo = [(lo, hi, level, level)]
    while todo:
        a, b, at, closing = todo.pop()
        if b - a <= limit:
            out.append((b, closing))
        elif at == len(_SEPARATORS):
            # one run of other characters with the white space behind it; cuts beside or inside white space are word cuts
            body = a + len(text[a:b].rstrip())
            cuts = [*range(a + limit, body, limit), *([body] if a < body < b else []), *range(body + limit, b, limit), b]
            out += [(c, closing if c == b else len(_SEPARATORS) if c < body else len(_SEPARATORS) - 1) for c in cuts]
        else:
            ends = [m.end() for m in _SEPARATORS[at][1].finditer(text, a, b) if a < m.end() < b]
            spans = list(zip([a, *ends], [*ends, b]))
            todo += [(x, y, at + 1, at if y < b else closing) for x, y in reversed(spans)]
    return out


def split_text(text: str, limit: int = 1500, overlap: int = 150) -> list[tuple[int, str, int, int, int, str]]:
    """Pieces (piece_no, text, start, end, new_from, cut) of at most ``limit`` characters that cover the text.

    A piece repeats the text from start to new_from, the end of the piece before. ``cut`` names the boundary at its end:
    'end' for the last piece, 'character' only inside a run without white space that is longer than the limit. A text within
    the limit is one piece; an empty one has none.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, text, 0, len(text), 0, "end")]
    units = _units(text, 0, len(text), limit, 0)
    pieces, start, new_from, i = [], 0, 0, 0
    while i < len(units):
        # the repeated text gives way if the next unit would not fit behind it
        first = units[i][0]
        if first - start > limit:
            start = _resume(text, first - limit, new_from)
        last = i
        while last + 1 < len(units) and units[last + 1][0] - start <= limit:
            last += 1
        if last + 1 < len(units):
            # among the units that fit, end at the strongest boundary of the last third
            least = start + (limit * 2) // 3
            strong = [k for k in range(i, last + 1) if units[k][0] > least]
            if strong:
                last = max(strong, key=lambda k: (-units[k][1], k))
        end = units[last][0]
        cut = "end" if last + 1 == len(units) else LEVELS[units[last][1]]
        pieces.append((len(pieces), text[start:end], start, end, new_from, cut))
        i, new_from = last + 1, end
        start = _resume(text, max(start + 1, end - overlap), end)
    return pieces


def _resume(text: str, lo: int, end: int) -> int:
    """First word start at or after ``lo``; ``end`` if there is none before it."""
    if lo >= end:
        return end
    if lo == 0 or text[lo - 1].isspace():
        at = lo
    else:
        gap = re.compile(r"\s").search(text, lo, end)
        if gap is None:
            return end
        at = gap.end()
    while at < end and text[at].isspace():
        at += 1
    return at


def split_oversized(frame: DataFrame, text_col: str = "text", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """One row per piece of each text above the limit: the frame's columns with ``pieces`` unrolled as struct ``piece``.

    Null texts and texts within the limit need no cut and give no row; redelivered rows are cut once per row given.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def run(texts: pa.Array) -> pa.Array:
        out = [[dict(zip(("piece_no", "text", "start", "end", "new_from", "cut"), p)) for p in split_text(t, limit, overlap)] if t is not None else None for t in texts.to_pylist()]
        return pa.array(out, pa.list_(_PIECES))

    cut = F.arrow_udf(run, f"array<struct<{PIECE.replace(' int', ':int').replace(' string', ':string')}>>")
    return frame.where(F.char_length(text_col) > limit).withColumn("piece", F.explode(cut(F.col(text_col))))


def oversized_kinds(frame: DataFrame, key_col: str, text_col: str = "text", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """(key, cut_kind) of the texts above the limit, by how the splitter had to cut: 'hard' if inside a run without white space."""
    slim = frame.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where("key is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, kinds = b.column(0), ["hard" if any(p[5] == "character" for p in split_text(t, limit, overlap)) else "natural" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.string())], names=["key", "cut_kind"])

    return slim.where(F.char_length("text") > limit).mapInArrow(run, "key bigint, cut_kind string").distinct()


_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_CLOSED = re.compile(r"[ \t\r]*(?:\n[ \t\r]*\n|\s*\Z)")


def block_marks(text: str, blocks: list[dict], page: int | None) -> list[tuple[int, int | None]]:
    """(place, page) from which on a page holds: the start with ``page``, then every block (page, markdown, plain) of known page.

    A block stands between blank lines, whole. One that isn't found is taken to begin at the next paragraph.
    """
    starts = [0, *(m.end() for m in _BLANK.finditer(text))]
    marks, nth, at = [(0, page)], 0, 0
    for block in blocks:
        shapes = [x for x in dict.fromkeys(((block["markdown"] or "").strip(), (block["plain"] or "").strip())) if x]
        if not shapes:
            continue
        while nth < len(starts) and starts[nth] < at:
            nth += 1
        found = next(((k, starts[k] + len(x)) for k in range(nth, len(starts)) for x in shapes if text.startswith(x, starts[k]) and _CLOSED.match(text, starts[k] + len(x))), None)
        if found is None and nth >= len(starts):
            break
        k, at = found or (nth, starts[nth] + 1)
        nth = k + 1
        if block["page"] is not None:
            marks.append((starts[k], block["page"]))
    return marks


def pieces_with_pages(chunks: DataFrame, blocks: DataFrame, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """(chunk_key, piece_no, text, start, end, cut, page_start, page_end) of every chunk above the limit.

    The pages of a piece are those of the blocks in which it starts, the repeated text included, and ends: the chunk's blocks are looked
    up by (doc_id, block_id) and found in the chunk's text as they are rendered (Markdown or plain), each whole and behind the one
    before. A block that was edited since is taken to begin behind the next blank line. The last block at or before the piece with
    a known page counts. Before the first, and for chunks whose blocks are unknown, it is the chunk's page_start (null if that is).
    """
    big = chunks.where(F.col("chunk_key").isNotNull() & (F.char_length("text") > limit)).dropDuplicates(["chunk_key"]).select("chunk_key", "doc_id", "text", "page_start", "block_ids")
    listed = big.select("chunk_key", "doc_id", F.posexplode("block_ids").alias("nth", "block_id"))
    shown = lambda fmt: B.render(*[F.col(c) for c in ("block_type", "text", "heading_level", "table_data", "image", "metadata")], fmt=fmt)
    drawn = blocks.where("doc_id is not null and block_id is not null").select("doc_id", "block_id", "page", shown("markdown").alias("markdown"), shown("plain").alias("plain"))
    known = drawn.groupBy("doc_id", "block_id").agg(F.max(F.struct("page", "markdown", "plain")).alias("b")).select("doc_id", "block_id", "b.*")
    order = listed.join(known, ["doc_id", "block_id"]).groupBy("chunk_key").agg(F.sort_array(F.collect_list(F.struct("nth", "page", "markdown", "plain"))).alias("order"))
    ready = big.drop("doc_id", "block_ids").join(order, "chunk_key", "left")

    def pages(texts: pa.Array, orders: pa.Array, first: pa.Array) -> pa.Array:
        out = [[{"from": a, "page": p} for a, p in block_marks(t, o or [], page)] for t, o, page in zip(texts.to_pylist(), orders.to_pylist(), first.to_pylist())]
        return pa.array(out, pa.list_(pa.struct([("from", pa.int32()), ("page", pa.int32())])))

    marks = F.arrow_udf(pages, "array<struct<from:int,page:int>>")
    cut = split_oversized(ready.withColumn("marks", marks("text", "order", "page_start")).drop("order", "page_start"), "text", limit, overlap)
    page = lambda at: F.element_at(F.filter("marks", lambda m: m["from"] <= at), -1)["page"]
    return cut.select("chunk_key", "piece.piece_no", F.col("piece.text").alias("text"), "piece.start", "piece.end", "piece.cut", page(F.col("piece.start")).alias("page_start"), page(F.col("piece.end") - 1).alias("page_end"))
