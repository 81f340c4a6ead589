"""Refinement of a document's block sequence: types, levels, removals, merged diagrams, captions.

Frames have the columns of the blocks table; ``ord`` is the reading order inside ``doc_id`` (ties by block_id). Every operator
returns a frame of the same columns and may be used alone; ``refine_sequence`` applies them in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.operators import onepass as P
from folioforge.operators import ordered as O
from folioforge.operators.tables import collapse_tables, part_pages, table_block, table_pages, table_runs, table_spans, with_extent
from folioforge.runtime import bounded_broadcast, stage_table

KEYS = ["doc_id"]
ORDER = ["ord", "block_id"]

# Marks, first words and strong words of diagram listings.
_DIAGRAM_START = r"@startuml|@enduml|skinparam|autonumber|title|legend|footer|header|box|end|boundary|participant|actor|control|entity|database|collections|queue|group|alt|opt|loop|par|break|critical|else|note|hnote|rnote|activate|deactivate|ref|nest"
_DIAGRAM_STRONG = "box boundary participant actor control entity database collections queue skinparam autonumber group alt opt loop par note hnote rnote activate deactivate".split()
_DIAGRAM_END = r"end[{WS}]+(?:box|group|note|hnote|rnote|legend|title|header|footer|alt|opt|loop|par)\b"


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Each block_key once (redelivered rows are equal); rows without key or document are left out."""
    return blocks.where("block_key is not null and doc_id is not null").dropDuplicates(["block_key"])


def with_position(blocks: DataFrame) -> DataFrame:
    """The blocks with their dense position ``pos``, as a written table, since the operators read it more than once."""
    return stage_table(O.dense(blocks, KEYS, ORDER), "blocks")


def refine_types(blocks: DataFrame) -> DataFrame:
    """Any text that is a section heading becomes one, with its level; other headings stay only if retained (annexes), else become
    list items (markers, labels) or paragraphs without level. Other blocks are unchanged."""
    body = T.strip(F.coalesce("text", F.lit("")))
    level = T.heading_level(body)
    heading = F.col("block_type") == "heading"
    keep = heading & T.is_retained_heading(body) & (body != "")
    item = heading & ~keep & (T.is_list_marker(body) | T.is_list_label(body)) & (body != "")
    named = F.when(level.isNotNull() | heading & (body != ""), body).otherwise(F.col("text"))
    return blocks.withColumns({
        "block_type": F.when(level.isNotNull() | keep, "heading").when(item, "list_item").when(heading, "paragraph").otherwise(F.col("block_type")),
        "heading_level": F.when(level.isNotNull(), level).when(keep, F.when(F.coalesce("heading_level", F.lit(0)) == 0, 1).otherwise(F.col("heading_level"))).when(heading, None).otherwise(F.col("heading_level")).cast("int"),
        "text": named,
    })


def assign_list_levels(blocks: DataFrame) -> DataFrame:
    """Levels 1 to 3 of list items by their indent against the least of their run (a run is not interrupted by other blocks).

    Labels, items without box, and items within 10 points of the least indent get 1; within 35 points 2; others 3.
    """
    item = F.col("block_type") == "list_item"
    runs = O.running_sum(with_position(blocks), KEYS, {"_run": F.when(item, 0).otherwise(1)})
    least = runs.where(item).groupBy(*KEYS, "_run").agg(F.min("bbox.x0").alias("_x"))
    x = F.col("bbox.x0")
    level = F.when(T.is_list_label(F.coalesce("text", F.lit(""))) | x.isNull() | (x <= F.col("_x") + 10), 1).when(x <= F.col("_x") + 35, 2).otherwise(3)
    return runs.join(least, [*KEYS, "_run"], "left").withColumn("heading_level", F.when(item, level).otherwise(F.col("heading_level"))).select(*blocks.columns)


def drop_removable_sections(blocks: DataFrame, names: tuple[str, ...] = T.REMOVABLE_SECTIONS) -> DataFrame:
    """Without removable headings and what follows each, up to the next other heading of its level or above.

    A removable heading inside a removed section sets the level anew. Headings without level count as level 1.
    """
    heading = F.col("block_type") == "heading"
    level = F.when(F.coalesce("heading_level", F.lit(0)) == 0, 1).otherwise(F.col("heading_level"))
    removable = heading & T.is_removable_section(F.coalesce("text", F.lit("")), names)
    opened = O.running_last(with_position(blocks), KEYS, {"_open": F.when(removable, F.struct("pos", level.alias("level")))})
    ends = F.when(heading & ~removable & F.col("_open").isNotNull() & (level <= F.col("_open.level")), F.col("pos"))
    closed = O.running_last(opened, KEYS, {"_end": ends})
    return closed.where("_open is null or _end > _open.pos").select(*blocks.columns)


def drop_cover_boilerplate(blocks: DataFrame, cover: int = 1, pattern: str = T.BOILERPLATE) -> DataFrame:
    """Without the blocks of the cover page whose text holds boilerplate."""
    return blocks.where(~F.coalesce((F.col("page") == cover) & (F.col("text") != "") & T.is_boilerplate(F.col("text"), pattern), F.lit(False)))


def drop_images_on_tables(blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """Without images whose box covers that of the table right before or behind them (same or unknown page)."""
    seen = F.when(F.col("block_type") == "table", F.struct("bbox", "page"))
    near = O.neighbours(with_position(blocks), KEYS, {"_prev": (seen, -1), "_next": (seen, 1)})

    def covers(other: str) -> Column:
        same = F.coalesce(F.col("page") == F.col(f"{other}.page"), F.lit(True))
        return F.coalesce(same & (B.iou(F.col("bbox"), F.col(f"{other}.bbox")) >= least) & F.col("bbox").isNotNull() & F.col(f"{other}.bbox").isNotNull(), F.lit(False))

    return near.where(~((F.col("block_type") == "image") & (covers("_prev") | covers("_next")))).select(*blocks.columns)


def is_diagram_fragment(c: Column) -> Column:
    """Whether a text looks like a part of a diagram listing: marks, arrows, block ends, first words or strong words."""
    body, ws = T.strip(c), T.WS
    end = _DIAGRAM_END.replace("{WS}", ws)
    line = T.first_line(body)
    token = F.regexp_replace(F.lower(F.regexp_extract(line, rf"^([^{ws}]*)", 1)), "^['\"]+|['\"]+$", "")
    starts = line.rlike(rf"(?iU)^(?:{_DIAGRAM_START})\b") & ((token != "end") | line.rlike(f"(?i)^{end}"))
    two = F.slice(F.filter(F.split(F.regexp_replace(F.lower(body), "['\"]", " "), f"[{ws}]+"), lambda t: t != ""), 1, 2)
    strong = F.arrays_overlap(two, F.array(*[F.lit(w) for w in _DIAGRAM_STRONG]))
    return (body != "") & (F.lower(body).rlike("@startuml|@enduml") | (body.contains(">") & body.rlike(rf"(?U)[\w.\"'][{ws}]*[\-.]{{1,2}}>{{1,2}}[{ws}]*[\w.\"']")) | body.rlike(rf"(?iU)\b{end}") | starts | strong)


def diagram_spans(blocks: DataFrame) -> DataFrame:
    """The positioned blocks with ``covered`` (part of a diagram) and ``island`` (which run of covered blocks)."""
    body = F.coalesce("text", F.lit(""))
    textual = F.col("block_type").isin("code", "paragraph")
    part = textual & is_diagram_fragment(body)
    start, end = textual & F.lower(body).contains("@startuml"), textual & F.lower(body).contains("@enduml")
    plain = part & ~start & ~end
    flagged = with_position(blocks)
    marks = {"_s": F.when(start, F.col("pos")), "_x": F.when(~part, F.col("pos"))}
    ahead = O.running_last(flagged, KEYS, marks, ahead={"_n": F.when(~plain, start)}, before={"_e": F.when(end, F.col("pos"))})
    forward = F.col("_s").isNotNull() & (F.col("_s") > F.coalesce("_e", F.lit(-1))) & (F.col("_s") > F.coalesce("_x", F.lit(-1)))
    covered = ahead.withColumn("covered", forward | (F.coalesce(plain, F.lit(False)) & F.coalesce("_n", F.lit(False)))).drop("_s", "_x", "_e", "_n")
    return O.running_sum(stage_table(covered, "covered"), KEYS, {"island": F.when(F.col("covered"), 0).otherwise(1)})


def merge_diagrams(blocks: DataFrame) -> DataFrame:
    """Each run of diagram parts as one code block at the place of the first: texts line by line, spans of all parts, metadata
    language, page_end, continued and merged_parts."""
    spans = diagram_spans(blocks)
    rest = spans.where(~F.col("covered")).select(*blocks.columns)
    part = F.struct("pos", F.struct(*blocks.columns).alias("b"))
    runs = spans.where("covered").groupBy(*KEYS, "island").agg(O.by_position(F.collect_list(part)).alias("parts"))
    parts = F.col("parts")
    runs = with_extent(runs.withColumn("parts", F.transform("parts", lambda p: p["b"])), parts, part_spans(parts, dict(blocks.dtypes)["layout_spans"]), part_pages(parts))
    changed = diagram_block(parts)
    merged = runs.select(*[changed.get(c, F.element_at(parts, 1)[c]).alias(c) for c in blocks.columns])
    return rest.unionByName(merged)


def part_spans(parts: Column, spans: str) -> Column:
    """The spans of all diagram parts; spans: the type of layout_spans."""
    own = lambda p: F.array(F.struct(p["page"].alias("page"), p["bbox"].alias("bbox"), p["source_ref"].alias("source_ref")))
    return F.flatten(F.transform(parts, lambda p: F.when(F.size(p["layout_spans"]) > 0, p["layout_spans"]).when(F.size(parts) > 1, own(p)).otherwise(F.array().cast(spans))))


def diagram_block(parts: Column) -> dict[str, Column]:
    """What a code block made of diagram parts (blocks, in order) has other than the first of them, in a frame of with_extent."""
    n = F.size(parts)
    lines = F.filter(F.transform(parts, lambda p: T.strip(F.coalesce(p["text"], F.lit("")))), lambda t: t != "")
    base = F.map_concat(F.map_filter(F.coalesce(F.element_at(parts, 1)["metadata"], _no_map()), lambda k, _: ~k.isin("language")), F.create_map(F.lit("language"), F.lit("plantuml")))
    metadata = span_metadata(base, F.col("_from"), F.col("_to"), F.when(n > 1, n.cast("string")))
    return {"block_type": F.lit("code"), "page": F.col("_from"), "text": F.array_join(lines, "\n"), "layout_spans": F.col("_spans"), "metadata": metadata}


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def span_metadata(base: Column, start: Column, end: Column, parts: Column) -> Column:
    """Metadata with page_end, continued and merged_parts set for a block made of several."""
    crosses = F.coalesce(start != end, F.lit(False))
    added = F.map_from_entries(F.filter(F.array(
        F.when(end.isNotNull() & (crosses | ~F.map_contains_key(base, F.lit("page_end"))), F.struct(F.lit("page_end").alias("k"), end.cast("string").alias("v"))),
        F.when(crosses, F.struct(F.lit("continued").alias("k"), F.lit("true").alias("v"))),
        F.when(parts.isNotNull(), F.struct(F.lit("merged_parts").alias("k"), parts.alias("v"))),
    ), lambda x: x.isNotNull()))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(added, k)), added)


def _is_caption(rule) -> Column:
    return F.coalesce(F.col("block_type").isin("paragraph", "heading") & rule(F.coalesce("text", F.lit(""))), F.lit(False))


def figure_caption_choice(blocks: DataFrame) -> DataFrame:
    """Positioned blocks with ``choice``: 1 or -1 for an image that takes the caption behind or before it, else null."""
    image, cap = F.col("block_type") == "image", _is_caption(T.is_figure_caption)
    near = O.neighbours(with_position(blocks), KEYS, {**{f"_i{k}": (image, k) for k in (2, -2, -4)}, **{f"_c{k}": (cap, k) for k in (1, -1, -3)}})
    c, i = lambda k: F.coalesce(f"_c{k}", F.lit(False)), lambda k: F.coalesce(f"_i{k}", F.lit(False))
    choice = F.when(c(1) & ~i(2), 1).when(c(-1) & ~i(-2), -1).when(c(1), 1).when(c(-1) & c(-3) & ~i(-4), -1)
    return near.withColumn("choice", F.when(image, choice)).select(*blocks.columns, "pos", "choice")


def attach_figure_captions(blocks: DataFrame) -> DataFrame:
    """Captions moved to the image next to them. An image's own caption stays; a caption taken by an image without image data is lost."""
    chosen = figure_caption_choice(blocks)
    body = T.strip(F.coalesce("text", F.lit("")))
    near = O.neighbours(chosen, KEYS, {"_before": (F.col("choice"), -1), "_after": (F.col("choice"), 1), "_up": (body, -1), "_down": (body, 1)})
    taken = (F.coalesce("_before", F.lit(0)) == 1) | (F.coalesce("_after", F.lit(0)) == -1)
    caption = F.when(F.coalesce(F.col("image.caption"), F.lit("")) != "", F.col("image.caption")).when(F.col("choice") == 1, F.col("_down")).when(F.col("choice") == -1, F.col("_up")).otherwise(F.col("image.caption"))
    image = F.when(F.col("image").isNotNull(), F.struct(F.col("image.uri").alias("uri"), F.col("image.alt").alias("alt"), caption.alias("caption")))
    return near.where(~(taken & F.col("choice").isNull() & _is_caption(T.is_figure_caption))).withColumn("image", image).select(*blocks.columns)


def attach_table_captions(blocks: DataFrame) -> DataFrame:
    """Captions moved to the table they belong to, one per table with all its continuations.

    A table without caption takes the one right behind its first part, else right behind its last, else right before its
    first, unless the table before that has taken it.
    """
    runs = stage_table(table_runs(with_position(blocks)), "runs")
    cap = _is_caption(T.is_table_caption)
    body = T.strip(F.coalesce("text", F.lit("")))
    near = O.neighbours(runs, KEYS, {"_cap_next": (F.when(cap, body), 1), "_cap_prev": (F.when(cap, body), -1)})
    bare = F.coalesce(F.col("table_data.caption"), F.lit("")) == ""
    heads = near.where("head is not null").groupBy(*KEYS, F.col("head").alias("_h")).agg(
        F.max("pos").alias("_last"), F.max_by("_cap_next", "pos").alias("_cap_last"), F.min_by("_cap_next", "pos").alias("_cap_first"), F.min_by(bare, "pos").alias("_bare"))
    joined = near.withColumn("_h", F.col("head")).join(heads, [*KEYS, "_h"], "left")
    takes = F.when(F.col("_bare") & ((F.col("head") == F.col("pos")) | (F.col("_last") == F.col("pos")) & F.col("_cap_first").isNull()), True)
    left = O.neighbours(joined, KEYS, {"_left": (takes, -2)})
    first = (F.col("head") == F.col("pos")) & F.col("_bare")
    choice = F.when(first, F.when(F.col("_cap_first").isNotNull(), F.struct((F.col("pos") + 1).alias("at"), F.col("_cap_first").alias("text")))
        .when(F.col("_cap_last").isNotNull(), F.struct((F.col("_last") + 1).alias("at"), F.col("_cap_last").alias("text")))
        .when(F.col("_cap_prev").isNotNull() & F.col("_left").isNull(), F.struct((F.col("pos") - 1).alias("at"), F.col("_cap_prev").alias("text"))))
    chosen = stage_table(left.withColumn("choice", choice), "choice")
    gone = chosen.where("choice is not null").select(*KEYS, F.col("choice.at").alias("pos"))
    table = F.when(F.col("choice").isNotNull(), F.struct(F.col("table_data.headers").alias("headers"), F.col("table_data.body_rows").alias("body_rows"), F.col("choice.text").alias("caption"))).otherwise(F.col("table_data"))
    return chosen.withColumn("table_data", table).join(gone, [*KEYS, "pos"], "left_anti").select(*blocks.columns)


def renumber(blocks: DataFrame) -> DataFrame:
    """Block ids block_i and orders i from 0."""
    return with_position(blocks).withColumn("ord", F.col("pos").cast("int")).withColumn("block_id", F.concat(F.lit("block_"), F.col("ord"))).select(*blocks.columns)


def refine_sequence(blocks: DataFrame, names: tuple[str, ...] = T.REMOVABLE_SECTIONS, cover: int = 1) -> DataFrame:
    """All refinements in order, renumbered once at the end: in one pass for documents of up to ordered.SEGMENT blocks, else by the steps."""
    return _by_size(blocks, lambda b: refine_in_one_pass(b, names, cover), lambda b: refine_by_steps(b, names, cover))


def _by_size(blocks: DataFrame, usual: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``usual`` of the documents of up to ordered.SEGMENT blocks, with ``large`` of the others, if there are any."""
    known = blocks.where("doc_id is not null")
    over = stage_table(known.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > O.SEGMENT).select(*KEYS), "large")
    if over.isEmpty():
        return usual(known)
    over = bounded_broadcast(over)
    some, others = (known.join(over, KEYS, how).select(*blocks.columns) for how in ("left_anti", "left_semi"))
    return usual(some).unionByName(large(others))


def refine_by_steps(blocks: DataFrame, names: tuple[str, ...] = T.REMOVABLE_SECTIONS, cover: int = 1) -> DataFrame:
    """All refinements, one operator after the other, for documents of any size."""
    out = assign_list_levels(refine_types(blocks))
    out = drop_cover_boilerplate(drop_removable_sections(out, names), cover)
    out = merge_diagrams(drop_images_on_tables(out))
    return renumber(collapse_tables(with_position(attach_table_captions(attach_figure_captions(out)))).select(*blocks.columns))


def refine_in_one_pass(blocks: DataFrame, names: tuple[str, ...] = T.REMOVABLE_SECTIONS, cover: int = 1) -> DataFrame:
    """The same for documents that fit a task: one shuffle by document, and all that depends on other rows in one pass (onepass)."""
    typed = refine_types(P.placed(blocks, KEYS, ORDER))
    kind, text, table = F.col("block_type"), F.col("text"), F.col("table_data")
    body = F.coalesce("text", F.lit(""))
    textual = kind.isin("code", "paragraph")
    part = textual & F.when(F.coalesce(textual, F.lit(True)), is_diagram_fragment(body)).otherwise(False)
    start, end = textual & F.lower(body).contains("@startuml"), textual & F.lower(body).contains("@enduml")
    plain = part & ~start & ~end
    figure, title = (F.when(kind.isin("paragraph", "heading"), rule(body)) for rule in (T.is_figure_caption, T.is_table_caption))
    tabled = (kind == "table") & table.isNotNull()
    flags = {
        "item": kind == "list_item", "label": F.when(kind == "list_item", T.is_list_label(body)), "heading": kind == "heading", "removable": F.when(kind == "heading", T.is_removable_section(body, names)),
        "boilerplate": F.when((F.col("page") == cover) & (text != ""), T.is_boilerplate(text)), "image": kind == "image", "table": kind == "table",
        "not_part": ~part, "start": start, "end": end, "plain": plain, "not_plain": ~plain & start.isNotNull(), "figure_caption": figure, "table_caption": title,
        "tabled": tabled, "titled": F.when(tabled, T.is_table_caption(table["caption"])), "bare": F.when(tabled, F.coalesce(table["caption"], F.lit("")) == ""),
        "unknown": kind.isNull(), "real": F.when(tabled, (F.size(table["headers"]) > 0) & ~B.placeholder_headers(table["headers"])),
    }
    out = P.grouped(P.with_facts(typed, flags, F.when(figure | title, T.strip(text))), blocks.columns)

    said, own = F.col("_caption"), F.col("image.caption")
    image = F.when(F.col("image").isNotNull(), F.struct(F.col("image.uri").alias("uri"), F.col("image.alt").alias("alt"), F.when((F.coalesce(own, F.lit("")) == "") & said.isNotNull() & (kind == "image"), said).otherwise(own).alias("caption")))
    titled = lambda t, said: F.when(said.isNotNull(), F.struct(t["headers"].alias("headers"), t["body_rows"].alias("body_rows"), said.alias("caption"))).otherwise(t)
    parts, made = F.col("_parts"), F.col("_kind")
    of_kind = lambda a, b: F.when(made == P.DIAGRAM, a).when(made == P.TABLE, b)
    out = with_extent(out, parts, of_kind(part_spans(parts, dict(blocks.dtypes)["layout_spans"]), table_spans(parts)), of_kind(part_pages(parts), table_pages(parts)))
    diagram, whole = diagram_block(parts), table_block(parts, lambda p: titled(p["table_data"], p["_caption"]))
    single = {"image": image, "table_data": F.when(tabled, titled(table, said)).otherwise(table), "ord": F.col("_ord"), "block_id": F.concat(F.lit("block_"), F.col("_ord"))}

    def value(c: str) -> Column:
        x = single.get(c, F.col(c))
        for code, changed in ((P.DIAGRAM, diagram), (P.TABLE, whole)):
            x = F.when(made == code, changed[c]).otherwise(x) if c in changed else x
        return x.alias(c)

    return out.select(*[value(c) for c in blocks.columns])


def join_shards(blocks: DataFrame, number: Callable[[DataFrame, list[str], list[str]], DataFrame] = O.dense) -> DataFrame:
    """Blocks of page-range shards (columns shard, page_offset) as one sequence per document, not yet refined.

    Pages, page_end and span pages are shifted by the offset; shards follow one another, each in its own order.
    """
    shift = F.coalesce("page_offset", F.lit(0))
    span = F.transform("layout_spans", lambda s: F.struct((s["page"] + shift).alias("page"), s["bbox"].alias("bbox"), s["source_ref"].alias("source_ref")))
    end = F.element_at(F.coalesce("metadata", _no_map()), "page_end").try_cast("int")
    meta = F.when(end.isNotNull(), F.map_concat(F.map_filter("metadata", lambda k, _: k != "page_end"), F.create_map(F.lit("page_end"), (end + shift).cast("string")))).otherwise(F.col("metadata"))
    shifted = blocks.withColumns({"page": F.col("page") + shift, "layout_spans": span, "metadata": meta})
    placed = number(shifted, KEYS, ["shard", "ord", "block_id"])
    return placed.withColumn("ord", F.col("pos").cast("int")).drop("pos", "shard", "page_offset")


def merge_shards(blocks: DataFrame, names: tuple[str, ...] = T.REMOVABLE_SECTIONS) -> DataFrame:
    """The joined shards, refined once, so front matter that runs on into the next shard is still removed."""
    return _by_size(blocks, lambda b: refine_in_one_pass(join_shards(b, O.dense_whole), names), lambda b: refine_by_steps(join_shards(b), names))
