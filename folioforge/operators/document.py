"""Documents from block sequences: pages, section trees, titles, statistics, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.operators import ordered as O
from folioforge.operators.hierarchy import closure, hierarchy_labels
from folioforge.runtime import stage_table

KEYS = ["doc_id"]


def page_index(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, number, block_ids): the blocks of each page in reading order; a block over several pages stands in each.

    With ``pages`` (doc_id, number, ...), pages without blocks are kept, and their further columns.
    """
    end = F.element_at("metadata", "page_end")
    per = blocks.select("doc_id", "ord", "block_id", F.explode(B.page_numbers(F.col("layout_spans"), F.col("page"), end)).alias("number"))
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id"))), lambda x: x["block_id"]))
    found = per.groupBy("doc_id", "number").agg(ids.alias("block_ids"))
    if pages is None:
        return found
    return found.join(pages, ["doc_id", "number"], "full").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))


def blocks_with_sections(blocks: DataFrame, orphan: str = "Preamble") -> DataFrame:
    """Positioned blocks with ``section_no``, the number from 0 of the section they belong to in their document.

    A heading opens a section and belongs to it; blocks before the first heading form the orphan section 0.
    """
    placed = stage_table(O.dense(blocks, KEYS, ["ord", "block_id"]), "placed")
    opens = (F.col("block_type") == "heading") | (F.col("pos") == 0)
    return O.running_sum(placed, KEYS, {"_n": F.when(opens, 1).otherwise(0)}).withColumn("section_no", (F.col("_n") - 1).cast("int")).drop("_n")


def build_sections(blocks: DataFrame, orphan: str = "Preamble") -> DataFrame:
    """(doc_id, section_no, section_id, title, level, parent_no, parent_id, block_ids, page_start, page_end).

    The parent is the nearest section before with a smaller level; the orphan section has level 1. To find it, each section
    asks, for every smaller level, for the last section of that level, so no document is walked in one task.
    """
    inside = blocks_with_sections(blocks, orphan)
    head = F.min_by(F.struct("block_type", "text", "heading_level"), "pos")
    level = F.when(F.col("h.block_type") == "heading", F.when(F.coalesce("h.heading_level", F.lit(0)) == 0, 1).otherwise(F.col("h.heading_level"))).otherwise(1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id"))), lambda x: x["block_id"])
    made = inside.groupBy("doc_id", "section_no").agg(head.alias("h"), ids.alias("block_ids"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    titled = F.when(F.col("h.block_type") == "heading", F.coalesce("h.text", F.lit(""))).otherwise(orphan)
    named = F.when((F.col("h.block_type") == "heading") & (titled == ""), "section").otherwise(titled)
    made = stage_table(made.select("doc_id", "section_no", T.section_id(F.col("section_no"), named).alias("section_id"), titled.alias("title"), level.alias("level"), "block_ids", "page_start", "page_end"), "sections")
    marks = made.select("doc_id", F.col("level").alias("at"), F.col("section_no").alias("pos"), F.col("section_no").alias("mark"), F.lit(None).cast("int").alias("asker"))
    asks = made.where("level > 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("at"), F.col("section_no").alias("pos"), F.lit(None).cast("int").alias("mark"), F.col("section_no").alias("asker"))
    answered = O.running_last(marks.unionByName(asks), ["doc_id", "at"], {"last": F.col("mark")}).where("asker is not null")
    parents = answered.groupBy("doc_id", F.col("asker").alias("section_no")).agg(F.max("last").alias("parent_no"))
    ids = made.select("doc_id", F.col("section_no").alias("parent_no"), F.col("section_id").alias("parent_id"))
    return made.join(parents, ["doc_id", "section_no"], "left").join(ids, ["doc_id", "parent_no"], "left").select("doc_id", "section_no", "section_id", "title", "level", "parent_no", "parent_id", "block_ids", "page_start", "page_end")


def section_paths(sections: DataFrame, key: str = "section_key", sep: str = " > ") -> DataFrame:
    """(key, path): titles from the root down to the section, blank ones left out, for sections with a ``parent`` key.

    Sections on loops take their place below the loop's smallest key.
    """
    rows = stage_table(sections.select(F.col(key).alias("key"), "parent", T.strip(F.coalesce("title", F.lit(""))).alias("title")), "titles")
    labels = hierarchy_labels(rows.select("key", "parent"))
    pairs = closure(labels.withColumn("on_loop", F.lit(False))).unionByName(labels.select(F.col("key").alias("ancestor"), "key"))
    named = labels.select(F.col("key").alias("ancestor"), "depth").join(rows.select(F.col("key").alias("ancestor"), "title"), "ancestor").where("title <> ''")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "title"))), lambda x: x["title"]), sep)
    found = pairs.join(named, "ancestor").groupBy("key").agg(path.alias("path"))
    return rows.join(found, "key", "left").select("key", F.coalesce("path", F.lit("")).alias("path"))


def structural_parents(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, section_id) of sections that have children and no text of their own besides headings."""
    parents = sections.where("parent_id is not null and parent_id <> ''").select("doc_id", F.col("parent_id").alias("section_id")).distinct()
    shown = B.render(*[F.col(c) for c in ("block_type", "text", "heading_level", "table_data", "image", "metadata")])
    bodies = blocks.where((F.col("block_type") != "heading") & (shown != "")).select("doc_id", "block_id")
    filled = sections.select("doc_id", "section_id", F.explode("block_ids").alias("block_id")).join(bodies, ["doc_id", "block_id"], "left_semi").select("doc_id", "section_id").distinct()
    return sections.select("doc_id", "section_id").distinct().join(parents, ["doc_id", "section_id"], "left_semi").join(filled, ["doc_id", "section_id"], "left_anti")


def cover_title(parts: Column, longest: int = 180, joined: int = 120) -> Column:
    """Title from an ordered array of structs (text, on_cover): the cover's texts until they are long enough.

    Ends when a further text is longer than ``longest``, the joined length reaches ``joined``, or the page changes.
    """
    none = F.struct(F.array().cast("array<string>").alias("t"), F.lit(False).alias("done"))

    def step(state: Column, part: Column) -> Column:
        text, size = part["text"], F.size(state["t"])
        length = F.aggregate(state["t"], F.lit(0), lambda a, x: a + F.length(x)) + F.greatest(size, F.lit(0)) + F.length(text)
        stop = F.when(part["on_cover"], (size > 0) & (F.length(text) > longest)).otherwise(size > 0)
        return (
            F.when(state["done"] | (~stop & ~part["on_cover"]), state)
            .when(stop, F.struct(state["t"].alias("t"), F.lit(True).alias("done")))
            .otherwise(F.struct(F.concat(state["t"], F.array(text)).alias("t"), (length >= joined).alias("done")))
        )

    return F.aggregate(parts, none, step, lambda s: F.when(F.size(s["t"]) > 0, F.array_join(s["t"], " ")))


def resolve_titles(blocks: DataFrame, hints: DataFrame, cover: int = 1, longest: int = 180, joined: int = 120) -> DataFrame:
    """(doc_id, title): the cover's text, else the hint with spaces for hyphens, else the first heading that says something, else Untitled.

    Only the blocks up to the first page behind the cover that has one take part, at most the cover's.
    """
    body = T.strip(F.coalesce("text", F.lit("")))
    usable = F.col("block_type").isin("heading", "paragraph") & (body != "") & ~T.is_boilerplate(body)
    on = F.coalesce(F.col("page") == cover, F.lit(False))
    away = F.col("page").isNotNull() & ~on
    # what ends the cover: the first block of another page behind the first usable text
    usable_first = blocks.where(on & usable).groupBy("doc_id").agg(F.min("ord").alias("_from"))
    ends = blocks.where(away).join(usable_first, "doc_id").where("ord > _from").groupBy("doc_id").agg(F.min("ord").alias("_to"))
    parts = blocks.where(on & usable).join(ends, "doc_id", "left").where("_to is null or ord < _to")
    lines = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", body.alias("text"), F.lit(True).alias("on_cover")))).alias("parts"))
    covers = lines.select("doc_id", cover_title(F.col("parts"), longest, joined).alias("cover"))
    headings = blocks.where((F.col("block_type") == "heading") & (body != "") & ~T.is_generic_title(body)).groupBy("doc_id").agg(F.min_by(body, F.struct("ord", "block_id")).alias("heading"))
    hint = T.strip(F.regexp_replace(F.coalesce("title_hint", F.lit("")), "[-_]", " "))
    return hints.select("doc_id", "title_hint").join(covers, "doc_id", "left").join(headings, "doc_id", "left").select("doc_id", F.coalesce("cover", F.when(hint != "", hint), "heading", F.lit("Untitled")).alias("title"))


def ingest_stats(blocks: DataFrame, sections: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per registered document: counts of pages, blocks, sections and tables, degraded tables, failed shards, counts by type."""
    degraded = (F.col("block_type") == "table") & (F.col("table_data").isNull() | (F.coalesce(F.size("table_data.body_rows"), F.lit(0)) <= 0))
    kinds = blocks.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"), F.count_if(degraded).alias("bad"))
    per = kinds.groupBy("doc_id").agg(F.sum("n").alias("num_blocks"), F.sum(F.when(F.col("block_type") == "table", F.col("n")).otherwise(0)).alias("num_tables"), F.sum("bad").alias("degraded_blocks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("blocks_by_type"))
    pages = page_index(blocks).groupBy("doc_id").agg(F.count("*").alias("num_pages"))
    counted = sections.groupBy("doc_id").agg(F.count("*").alias("num_sections"))
    failed = F.size(F.filter(F.split(F.coalesce(F.element_at("extra", "failed_shards"), F.lit("")), ","), lambda x: T.strip(x) != ""))
    zero = {c: 0 for c in ("num_pages", "num_blocks", "num_sections", "num_tables", "degraded_blocks")}
    return registry.select("doc_id", "title", failed.alias("failed_shards")).join(per, "doc_id", "left").join(pages, "doc_id", "left").join(counted, "doc_id", "left").fillna(zero)


def roots(sections: DataFrame) -> DataFrame:
    """Sections without a parent."""
    return sections.where("parent_id is null or parent_id = ''")


def children(sections: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    """Sections right below one, in order."""
    return sections.where((F.col("doc_id") == doc_id) & (F.col("parent_id") == section_id)).orderBy("ord")


def blocks_of_sections(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, section_id, nth, block columns): the blocks that sections list, in their order; unknown ids give no row."""
    listed = sections.select("doc_id", "section_id", F.posexplode("block_ids").alias("nth", "block_id"))
    return listed.join(blocks, ["doc_id", "block_id"])


def blocks_of_page(blocks: DataFrame, doc_id: str, number: int) -> DataFrame:
    """The blocks that touch a page, in reading order."""
    pages = B.page_numbers(F.col("layout_spans"), F.col("page"), F.element_at("metadata", "page_end"))
    return blocks.where((F.col("doc_id") == doc_id) & F.array_contains(pages, F.lit(number))).orderBy("ord")


def block_by_id(blocks: DataFrame, doc_id: str, block_id: str):
    """The row of one block; KeyError if there is none."""
    row = blocks.where((F.col("doc_id") == doc_id) & (F.col("block_id") == block_id)).limit(1).first()
    if row is None:
        raise KeyError(f"{doc_id}:{block_id}")
    return row
