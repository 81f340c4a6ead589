"""Removal of page furniture: texts and images that repeat over a document's pages, and cover clutter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T

SIGNATURE = ["doc_id", "norm", "zone"]


def with_signature(blocks: DataFrame, height: float = 842.0) -> DataFrame:
    """Blocks with ``norm`` (text without digits) and ``zone`` (place on the page; unknown boxes count as body)."""
    zone = F.coalesce(B.page_zone(F.col("bbox.y0"), F.col("bbox.y1"), F.lit(height)), F.lit("body"))
    return blocks.withColumn("norm", T.normalize_text(F.col("text"))).withColumn("zone", zone)


def repeated_texts(blocks: DataFrame, least: float = 0.6, height: float = 842.0) -> DataFrame:
    """(doc_id, norm, zone, n_pages): texts in the same zone of at least ``least`` of a document's pages, each page counted once."""
    signed = with_signature(blocks.where("page is not null"), height)
    pages = signed.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    seen = signed.where("norm <> ''").select(*SIGNATURE, "page").distinct().groupBy(*SIGNATURE).agg(F.count("*").alias("n_pages"))
    return seen.join(pages, "doc_id").where(F.col("n_pages") / F.col("_pages") >= least).drop("_pages")


def repeated_images(images: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, image, n): images (doc_id, page, image, n_pages of the document) whose occurrences reach the share of pages."""
    return images.groupBy("doc_id", "image").agg(F.count("*").alias("n"), F.max("n_pages").alias("_pages")).where(F.col("n") / F.col("_pages") >= least).drop("_pages")


def remove_repeated(blocks: DataFrame, least: float = 0.6, height: float = 842.0) -> DataFrame:
    """Blocks whose text and zone don't repeat; the pages themselves stay in whatever table of pages there is."""
    noisy = repeated_texts(blocks, least, height).select(*SIGNATURE)
    return with_signature(blocks, height).join(noisy, SIGNATURE, "left_anti").drop("norm", "zone")


def remove_edge_images(blocks: DataFrame, height: float = 842.0, top: float = 0.15, bottom: float = 0.85) -> DataFrame:
    """Without images whose centre lies in the band at the top or bottom of the page."""
    centre = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    return blocks.where(~F.coalesce((F.col("block_type") == "image") & ((centre < top * height) | (centre > bottom * height)), F.lit(False)))


def clean_cover(blocks: DataFrame, cover: int = 1, height: float = 842.0, pattern: str = T.BOILERPLATE) -> DataFrame:
    """Without the cover's images, texts in its bottom band, and boilerplate."""
    low = F.coalesce(B.page_zone(F.col("bbox.y0"), F.col("bbox.y1"), F.lit(height)) == "bottom", F.lit(False))
    text = F.coalesce(T.strip(F.col("text")), F.lit(""))
    clutter = (F.col("block_type") == "image") | ((text != "") & (low | T.is_boilerplate(text, pattern)))
    return blocks.where(~F.coalesce((F.col("page") == cover) & clutter, F.lit(False)))


def clean_physical(blocks: DataFrame, repeated: bool = True, edge_images: bool = True, cover: bool = True) -> DataFrame:
    """The three steps that are switched on, in order."""
    out = remove_repeated(blocks) if repeated else blocks
    out = clean_cover(out) if cover else out
    return remove_edge_images(out) if edge_images else out
