"""Chunks: one per section, or sentences grouped by similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.runtime import stage_table

_PARTS = ("block_type", "text", "heading_level", "table_data", "image", "metadata")
ATOMIC = ("table", "code", "formula", "image", "heading")


def rendered(blocks: DataFrame, fmt: str = "markdown") -> DataFrame:
    """(doc_id, block_id, ord, page, block_type, piece) of the blocks that show something."""
    return blocks.select("doc_id", "block_id", "ord", "page", "block_type", B.render(*[F.col(c) for c in _PARTS], fmt=fmt).alias("piece")).where("piece <> ''")


def joined(order: str = "ord"):
    """Aggregates text and block_ids: pieces in order, joined by blank lines."""
    pieces = F.array_sort(F.collect_list(F.struct(order, "block_id", "piece")))
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n\n").alias("text"), F.transform(pieces, lambda p: p["block_id"]).alias("block_ids")


def section_chunks(sections: DataFrame, blocks: DataFrame, structural: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, section_id, text, block_ids, page_start, page_end, chunk_index) for each section with text.

    Sections that only group others (``structural``) are left out. chunk_index counts a document's chunks from 0 by section
    order. Documents without any section give one chunk of all their blocks.
    """
    from folioforge.operators.ordered import dense

    pieces = rendered(blocks)
    slots = sections.join(structural, ["doc_id", "section_id"], "left_anti").select("doc_id", "section_id", F.col("ord").alias("section_ord"), "page_start", "page_end", F.posexplode("block_ids").alias("nth", "block_id"))
    text, ids = joined("nth")
    made = slots.join(pieces, ["doc_id", "block_id"]).groupBy("doc_id", "section_id").agg(text, ids, F.first("page_start").alias("page_start"), F.first("page_end").alias("page_end"), F.first("section_ord").alias("section_ord"))
    numbered = dense(made, ["doc_id"], ["section_ord", "section_id"], "chunk_index").drop("section_ord")
    text, ids = joined()
    alone = pieces.join(sections.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(text, ids, F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    alone = alone.withColumn("section_id", F.lit(None).cast("string")).withColumn("chunk_index", F.lit(0).cast("bigint"))
    both = numbered.unionByName(alone)
    return both.select(F.concat_ws(":", "doc_id", F.coalesce("section_id", F.lit("orphan"))).alias("chunk_id"), "doc_id", "section_id", "text", "block_ids", "page_start", "page_end", "chunk_index")


def units(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, nth, block_id, page, unit): sentences of text blocks, whole other blocks, in order."""
    pieces = rendered(blocks)
    cut = F.when(F.col("block_type").isin(*ATOMIC), F.array("piece")).otherwise(T.sentences(F.col("piece")))
    cut = F.when(F.size(cut) == 0, F.array("piece")).otherwise(cut)
    return pieces.select("doc_id", "ord", "block_id", "page", F.posexplode(cut).alias("nth", "unit"))


Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(texts: list[str], dim: int = 256) -> np.ndarray:
    """Unit vectors of hashed lower-case words: a deterministic stand-in for a sentence model."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh32_intdigest(w)
            out[i, h % dim] += 1.0 if h & 1 << 30 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def opening_units(texts: list[str], encoder: Encoder, threshold: float = 0.7, least: int = 64, most: int = 128, agreed: list[bool] | None = None) -> list[bool]:
    """Which units open a group. A unit joins the group before it while the joined text has fewer than ``least`` tokens, or at most
    ``most`` and the group's text is similar to it; else it opens a group. A unit above ``most`` stays whole.

    The units are encoded in one call; only group texts are encoded one after another, as each depends on the cuts before. With
    ``agreed``, flags known from elsewhere, grouping ends at the first unit that opens a group there and here, since from there on
    both are the same.
    """
    lengths, vectors = [len(t.split()) for t in texts], None
    flags: list[bool] = []
    group, length = [], 0
    for i, t in enumerate(texts):
        if group:
            joined_length = length + lengths[i]
            if joined_length > most:
                group = []
            elif joined_length >= least:
                if vectors is None:
                    vectors = np.asarray(encoder(texts))
                a, b = np.asarray(encoder([" ".join(group)]))[0], vectors[i]
                norm = float(np.linalg.norm(a) * np.linalg.norm(b))
                if (float(np.dot(a, b)) / norm if norm else 0.0) < threshold:
                    group = []
        opened = not group
        flags.append(opened)
        if agreed is not None and opened and agreed[i]:
            return flags + agreed[i + 1 :]
        group, length = ([t], lengths[i]) if opened else ([*group, t], length + lengths[i])
    return flags


def _cut_units(cut: DataFrame, encoder: Encoder, threshold: float, least: int, most: int) -> DataFrame:
    """The units (doc_id, stretch, seq, unit, block_id, page) with ``opens``, as if each document were grouped in one go.

    Every stretch is grouped on its own first. Then the last group of each stretch is carried on into the next one, until a unit opens a
    group either way; that is repeated until nothing changes, so in the end every stretch follows from the one before.
    """
    fields = "doc_id string, stretch bigint, seq int, unit string, block_id string, page int, opens boolean"

    def alone(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("ord", "ascending"), ("block_id", "ascending"), ("nth", "ascending")])
        opens = opening_units(rows.column("unit").to_pylist(), encoder, threshold, least, most)
        return pa.table({"doc_id": rows.column("doc_id"), "stretch": rows.column("stretch"), "seq": pa.array(range(len(opens)), pa.int32()), "unit": rows.column("unit"), "block_id": rows.column("block_id"), "page": rows.column("page"), "opens": pa.array(opens)})

    def carry(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("stretch", "ascending"), ("seq", "ascending")])
        stretch, old = rows.column("stretch").to_pylist(), rows.column("opens").to_pylist()
        first = next((i for i, s in enumerate(stretch) if s == key[1].as_py()), len(stretch))
        new = opening_units(rows.column("unit").to_pylist(), encoder, threshold, least, most, [False] * first + old[first:])
        other = [i for i in range(first, len(old)) if new[i] != old[i]]
        seq = rows.column("seq").to_pylist()
        return pa.table({"doc_id": pa.array([key[0].as_py()] * len(other), pa.string()), "stretch": pa.array([key[1].as_py()] * len(other), pa.int64()), "seq": pa.array([seq[i] for i in other], pa.int32()), "now": pa.array([new[i] for i in other], pa.bool_())})

    flags = stage_table(cut.groupBy("doc_id", "stretch").applyInArrow(alone, fields), "units")
    while True:
        # the last unit before a stretch that opens a group; as groups have few units, it lies in the stretch before or soon before that
        ends = flags.groupBy("doc_id", "stretch").agg(F.max(F.when(F.col("opens"), F.col("seq"))).alias("tail"))
        earlier = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        start = F.last(F.when(F.col("tail").isNotNull(), F.struct("stretch", "tail")), ignorenulls=True).over(earlier)
        borders = stage_table(ends.select("doc_id", F.col("stretch").alias("border"), start.alias("start")).where("start is not null"), "borders")
        if borders.isEmpty():
            return flags
        asked = borders.select("doc_id", "border", "start", F.explode(F.sequence("start.stretch", F.col("border") - 1)).alias("stretch"))
        columns = ["doc_id", "border", "stretch", "seq", "unit", "opens"]
        tails = flags.join(asked, ["doc_id", "stretch"]).where("stretch > start.stretch or seq >= start.tail").select(*columns)
        heads = flags.join(borders.select("doc_id", F.col("border").alias("stretch")), ["doc_id", "stretch"], "left_semi").withColumn("border", F.col("stretch")).select(*columns)
        changed = stage_table(tails.unionByName(heads).groupBy("doc_id", "border").applyInArrow(carry, "doc_id string, stretch bigint, seq int, now boolean"), "changed")
        if changed.isEmpty():
            return flags
        flags = stage_table(flags.join(changed, ["doc_id", "stretch", "seq"], "left").withColumn("opens", F.coalesce("now", "opens")).drop("now"), "units")


def semantic_chunks(blocks: DataFrame, encoder: Encoder = hashing_encoder, threshold: float = 0.7, least: int = 64, most: int = 128, stretch: int = 4096) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, block_ids, page_start, page_end, n_units): units grouped by similarity.

    The result is that of grouping each document in one go, though no task holds more than two stretches of ``stretch`` blocks.
    Blank units make no chunk of their own.
    """
    if not 1 <= least <= most:
        raise ValueError("1 <= least <= most is required")
    from folioforge.operators.ordered import dense

    flags = _cut_units(units(blocks).withColumn("stretch", F.expr(f"coalesce(ord, -1) div {stretch}").cast("bigint")), encoder, threshold, least, most)
    own = Window.partitionBy("doc_id", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counts = flags.groupBy("doc_id", "stretch").agg(F.sum(F.col("opens").cast("bigint")).alias("c"))
    base = counts.select("doc_id", "stretch", F.coalesce(F.sum("c").over(Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = flags.withColumn("n", F.sum(F.col("opens").cast("bigint")).over(own)).join(base, ["doc_id", "stretch"]).withColumn("group", F.col("n") + F.col("base"))
    parts = F.array_sort(F.collect_list(F.struct("stretch", "seq", "unit", "block_id")))
    made = numbered.groupBy("doc_id", "group").agg(parts.alias("parts"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").cast("int").alias("n_units"))
    made = made.withColumn("text", T.strip(F.array_join(F.transform("parts", lambda p: p["unit"]), " "))).where("text <> ''").withColumn("block_ids", F.array_distinct(F.transform("parts", lambda p: p["block_id"])))
    placed = dense(made.drop("parts"), ["doc_id"], ["group"], "chunk_index")
    return placed.select(F.concat("doc_id", F.lit(":sem_"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"), "doc_id", "chunk_index", "text", "block_ids", "page_start", "page_end", "n_units")


CHUNKERS = {"section": section_chunks, "semantic": semantic_chunks}


def chunker(name: str):
    """The chunker of that name."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; known: {', '.join(CHUNKERS)}")
    return CHUNKERS[name]
