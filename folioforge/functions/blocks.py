"""Column functions over blocks: layout, tables, pages and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import strip


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 without area. Boxes with swapped corners have no area."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda x: F.greatest(zero, x["x1"] - x["x0"]) * F.greatest(zero, x["y1"] - x["y0"])
    inter = width * height
    union = area(a) + area(b) - inter
    return F.when((inter <= 0) | (union <= 0), zero).otherwise(inter / union)


def overlap_x(a: Column, b: Column) -> Column:
    """Whether the boxes overlap strictly along x; unknown boxes count as overlapping."""
    return F.coalesce((a["x0"] < b["x1"]) & (b["x0"] < a["x1"]), F.lit(True))


def page_zone(y0: Column, y1: Column, height: Column, top: float = 0.15, bottom: float = 0.85) -> Column:
    """top, bottom or body by the box's place on the page (y from the top); the top wins."""
    return F.when(y0 < height * top, "top").when(y1 > height * bottom, "bottom").otherwise("body")


def coord_origin(c: Column) -> Column:
    """Bare name of a coordinate origin, BOTTOMLEFT by default."""
    bare = F.upper(F.substring_index(c, ".", -1))
    return F.when(F.coalesce(bare, F.lit("")) == "", "BOTTOMLEFT").otherwise(bare)


def placeholder_headers(headers: Column) -> Column:
    """Whether all headers are blank, their own index, or col and a number; no headers count as placeholders."""
    def artificial(h: Column, i: Column) -> Column:
        t = strip(h)
        return (t == "") | F.coalesce(t.rlike("^[0-9]+$") & (t.try_cast("int") == i), F.lit(False)) | F.lower(t).rlike("^col[0-9]+$")

    return F.coalesce(F.forall(F.transform(headers, lambda h, i: F.coalesce(artificial(h, i), F.lit(True))), lambda x: x), F.lit(True))


def column_count(table: Column) -> Column:
    """Number of real headers, else the longest row, else the number of headers; 0 for no table."""
    real = (F.size(table["headers"]) > 0) & ~placeholder_headers(table["headers"])
    rows = F.array_max(F.transform(table["body_rows"], lambda r: F.coalesce(F.size(r), F.lit(0))))
    return F.when(real, F.size(table["headers"])).when(F.size(table["body_rows"]) > 0, rows).otherwise(F.greatest(F.coalesce(F.size(table["headers"]), F.lit(0)), F.lit(0)))


def page_numbers(spans: Column, page: Column, page_end: Column) -> Column:
    """Pages that a block touches: those of its spans in order, else from page to page_end, either way round."""
    known = F.array_distinct(F.filter(F.transform(spans, lambda s: s["page"]), lambda p: p.isNotNull()))
    end = F.coalesce(page_end.try_cast("int"), page)
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, known).when(page.isNotNull(), F.sequence(F.least(page, end), F.greatest(page, end))).otherwise(F.array().cast("array<int>"))


def layout(spans: Column, page: Column, bbox: Column, source_ref: Column) -> Column:
    """The spans, or one made of the block's own page, box and reference."""
    own = F.array(F.struct(page.alias("page"), bbox.alias("bbox"), source_ref.alias("source_ref")))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, spans).otherwise(own)


def _pad(row: Column, width: Column) -> Column:
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), F.lit(1), F.greatest(width, F.lit(0)))


def _cells(row: Column) -> Column:
    return F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))


def table_plain(t: Column) -> Column:
    """Caption, headers and rows as lines, cells joined by bars; blank lines are left out."""
    line = lambda cells: F.array_join(_cells(cells), " | ")
    lines = F.concat(F.array(F.coalesce(strip(t["caption"]), F.lit(""))), F.array(F.when(F.size(t["headers"]) > 0, line(t["headers"])).otherwise("")), F.coalesce(F.transform(t["body_rows"], line), F.array().cast("array<string>")))
    return F.when(t.isNull(), "").otherwise(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def table_markdown(t: Column) -> Column:
    """Bold caption, then a Markdown table. With headers, rows are padded or cut to their number; without, padded to the longest."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    none = F.array().cast("array<string>")
    caption = F.when(F.coalesce(t["caption"], F.lit("")) != "", F.array(F.concat(F.lit("**"), strip(t["caption"]), F.lit("**")))).otherwise(none)
    rows = F.coalesce(t["body_rows"], F.array().cast("array<array<string>>"))
    width = F.when(F.coalesce(F.size(t["headers"]), F.lit(0)) > 0, F.size(t["headers"])).otherwise(F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    head = F.when(F.coalesce(F.size(t["headers"]), F.lit(0)) > 0, F.array(row(_cells(t["headers"])), row(F.transform(t["headers"], lambda _: F.lit("---"))))).otherwise(none)
    return F.when(t.isNull(), "").otherwise(F.array_join(F.concat(caption, head, F.transform(rows, lambda r: row(_pad(_cells(r), width)))), "\n"))


def image_plain(image: Column) -> Column:
    """The image's caption, else its alternative text, else nothing."""
    caption = F.coalesce(strip(image["caption"]), F.lit(""))
    return F.when(caption != "", caption).otherwise(F.coalesce(strip(image["alt"]), F.lit("")))


def image_markdown(image: Column) -> Column:
    """A link if there is an address, else the plain text."""
    plain, uri = image_plain(image), F.coalesce(image["uri"], F.lit(""))
    return F.when(plain == "", "").when(uri != "", F.concat(F.lit("!["), plain, F.lit("]("), uri, F.lit(")"))).otherwise(plain)


def render(kind: Column, text: Column, level: Column, table: Column, image: Column, metadata: Column, fmt: str = "markdown") -> Column:
    """Text of a block, plain or as Markdown; empty if it has nothing to show."""
    body = strip(F.coalesce(text, F.lit("")))
    if fmt == "plain":
        return F.when(kind == "table", table_plain(table)).when(kind == "image", image_plain(image)).otherwise(body)
    if fmt != "markdown":
        raise ValueError(f"unknown format {fmt!r}")
    depth = F.greatest(F.lit(1), F.coalesce(level, F.lit(1)))
    fence = F.concat(F.lit("```"), strip(F.coalesce(metadata["language"], F.lit(""))))
    return (
        F.when(kind == "table", table_markdown(table)).when(kind == "image", image_markdown(image)).when(body == "", "")
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "), body))
        .when(kind == "list_item", F.concat(F.repeat(F.lit("  "), depth - 1), F.lit("- "), body))
        .when(kind == "code", F.concat(fence, F.lit("\n"), body, F.lit("\n```")))
        .when(kind == "formula", F.concat(F.lit("$$\n"), body, F.lit("\n$$"))).otherwise(body)
    )
