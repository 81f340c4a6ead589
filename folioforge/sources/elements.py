"""Elements of a layout parser as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.operators.ordered import dense
from folioforge.runtime import stage_table
from folioforge.sources.files import grid_table, linked_captions

#: Elements: the parser's output, one row per element in reading order.
ELEMENTS = (
    "doc_id string, ord int, ref string, layer string, label string, text string, level int, captions array<string>, footnotes array<string>, grid array<array<struct<text:string,column_header:boolean>>>, "
    "prov array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>"
)
# Labels of the parser by the type of block they become.
HEADINGS = ("title", "section_header")
SAME = ("list_item", "code", "formula", "table")
DROPPED = ("page_header", "page_footer")


def map_elements(elements: DataFrame, contents_removable: bool = True) -> DataFrame:
    """Blocks (without block_key) from elements of the body layer, numbered from 0 in each document.

    Page headers and footers are dropped, tables of contents if such sections are removable, and elements that others name
    as caption or footnote. Blank texts are dropped, and rules among plain texts. Headings take the level of their number, else
    the parser's. Tables and pictures take the first non-blank text of their captions. A block's page and box are those of its
    first place; all places are kept as spans if there are several.
    """
    body = linked_captions(elements.where("doc_id is not null and layer = 'body'"))
    label, text = F.lower(F.coalesce("label", F.lit("text"))), T.strip(F.coalesce("text", F.lit("")))
    kind = F.when(label.isin(*HEADINGS), "heading").when(label.isin(*SAME), label).when(label == "picture", "image").when(label == "document_index", "table").otherwise("paragraph")
    dropped = label.isin(*DROPPED, *(("document_index",) if contents_removable else ()))
    shown = kind.isin("table", "image") | ((text != "") & ~((kind == "paragraph") & T.is_noise(text)))
    box = lambda b: F.when(b.isNotNull(), F.struct(b["l"].alias("x0"), b["b"].alias("y0"), b["r"].alias("x1"), b["t"].alias("y1"), B.coord_origin(b["coord_origin"]).alias("coord_origin")))
    places = F.transform("prov", lambda p: F.struct(p["page_no"].alias("page"), box(p["bbox"]).alias("bbox"), F.col("ref").alias("source_ref")))
    first = F.get(places, F.lit(0))
    parsed = F.when((label == "section_header") & (F.coalesce("level", F.lit(0)) != 0), F.col("level")).otherwise(1)
    grid = grid_table(F.coalesce("grid", F.array().cast("array<array<struct<text:string,column_header:boolean>>>")))
    table = F.struct(grid["headers"].alias("headers"), grid["body_rows"].alias("body_rows"), F.col("caption").alias("caption"))
    image = F.struct(F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("alt"), F.col("caption").alias("caption"))
    made = body.where(~dropped & shown).select(
        "doc_id", F.col("ord").alias("_at"), F.col("ref").alias("source_ref"), kind.alias("block_type"), first["page"].alias("page"), F.when(~kind.isin("table", "image"), text).alias("text"),
        F.when(kind == "heading", F.coalesce(T.heading_level(text), parsed)).alias("heading_level"), F.when(kind == "table", table).alias("table_data"), F.when(kind == "image", image).alias("image"), first["bbox"].alias("bbox"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.when(F.size("prov") > 1, places).otherwise(F.slice(places, 1, 0)).alias("layout_spans"),
    )
    placed = dense(stage_table(made, "elements"), ["doc_id"], ["_at", "source_ref"])
    return placed.select("doc_id", F.concat(F.lit("block_"), "pos").alias("block_id"), "block_type", F.col("pos").cast("int").alias("ord"), *[c for c in made.columns if c not in ("doc_id", "_at", "block_type")])
