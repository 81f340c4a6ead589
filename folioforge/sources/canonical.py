"""Canonical documents as JSON and Markdown, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.operators.ordered import dense
from folioforge.runtime import stage_table

_BOX = "struct<x0:double,y0:double,x1:double,y1:double,coord_origin:string>"
_SPAN = f"struct<page:int,bbox:{_BOX},source_ref:string>"
SCHEMA = (
    "schema_version string, metadata struct<source_path:string,title:string,parser:string,docling_version:string,profile_id:string,family:string,identity:map<string,string>,stats:map<string,int>,ingest:map<string,string>,extra:map<string,string>>,"
    "pages array<struct<number:int,block_ids:array<string>,width:double,height:double>>,"
    "sections array<struct<id:string,title:string,level:int,`order`:int,parent_id:string,block_ids:array<string>,page_start:int,page_end:int,metadata:map<string,string>>>,"
    f"blocks array<struct<id:string,type:string,`order`:int,page:int,text:string,level:int,table:struct<headers:array<string>,`rows`:array<array<string>>,caption:string>,image:struct<uri:string,alt:string,caption:string>,bbox:{_BOX},source_ref:string,metadata:map<string,string>,layout_spans:array<{_SPAN}>>>"
)
# Members of metadata that are kept under names of their own.
IDENTITY = ("group", "doc_type", "subject", "version", "segments", "release")
STATS = ("num_pages", "num_blocks", "num_sections", "num_shards")
INGEST = ("ingest_profile", "pages_per_shard", "failed_shards")


def _kept(names: tuple[str, ...], reserved: bool = True):
    test = lambda k, v: (k.isin(*names) if reserved else ~k.isin(*names)) & (F.coalesce(v, F.lit("")) != "")
    chosen = F.map_filter("extra", test)
    return F.when(F.size(chosen) > 0, chosen)


def document_parts(registry: DataFrame, blocks: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, part, pos, piece): JSON documents of schema 1.0 in pieces, to be joined in order of part and pos.

    A piece holds one page, section or block, so no row grows with its document. Nulls are omitted, and so is a single span that says
    no more than its block; a section's parent_id is always written. Statistics are numbers here and strings in ``extra``. Line
    breaks between pieces do no harm, so ``write_documents`` can stream them.
    """
    only = F.get("layout_spans", F.lit(0))
    own = only["page"].eqNullSafe(F.col("page")) & only["bbox"].eqNullSafe(F.col("bbox")) & only["source_ref"].eqNullSafe(F.col("source_ref"))
    box = F.when((F.size("layout_spans") > 1) | ((F.size("layout_spans") == 1) & ~own), F.col("layout_spans"))
    shown = F.col("image.uri").isNotNull() | F.col("image.alt").isNotNull() | F.col("image.caption").isNotNull()
    block = F.struct(F.col("block_id").alias("id"), F.col("block_type").alias("type"), F.col("ord").alias("order"), "page", "text", F.col("heading_level").alias("level"),
        F.when(F.col("table_data").isNotNull(), F.struct(F.col("table_data.headers").alias("headers"), F.col("table_data.body_rows").alias("rows"), F.col("table_data.caption").alias("caption"))).alias("table"),
        F.when(shown, F.col("image")).alias("image"), "bbox", "source_ref", F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"), box.alias("layout_spans"))
    head = F.to_json(F.struct(F.col("section_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.col("section_level").alias("level"), F.col("ord").alias("order")))
    tail = F.to_json(F.struct("block_ids", "page_start", "page_end", F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata")))
    parent = F.coalesce(F.to_json(F.array(F.col("parent_id"))), F.lit("[null]"))
    parts = sections.select("doc_id", "ord", F.col("section_id").alias("name"), head.alias("h"), tail.alias("t"), parent.alias("p"))
    section = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"parent_id":'), F.expr("substring(p, 2, length(p) - 2)"), F.when(F.col("t") != "{}", F.concat(F.lit(","), F.expr("substring(t, 2)"))).otherwise("}"))
    page = F.to_json(F.struct("number", "block_ids", *[c for c in ("width", "height") if c in pages.columns]))
    lists = (
        ("pages", pages.select("doc_id", F.col("number").alias("ord"), F.lit("").alias("name"), page.alias("j"))),
        ("sections", parts.select("doc_id", "ord", "name", section.alias("j"))),
        ("blocks", blocks.select("doc_id", "ord", F.col("block_id").alias("name"), F.to_json(block).alias("j"))),
    )
    stats = _kept(STATS)
    reserved = ("family", "docling_version", *STATS, *IDENTITY, *INGEST)
    meta = F.struct("source_path", F.when(F.col("title") != "", F.col("title")).alias("title"), "parser", F.col("extra")["docling_version"].alias("docling_version"), "profile_id", F.col("extra")["family"].alias("family"),
        _kept(IDENTITY).alias("identity"), F.transform_values(stats, lambda _, v: v.try_cast("int")).alias("stats"), _kept(INGEST).alias("ingest"), _kept(reserved, False).alias("extra"))
    frame = [F.concat(F.lit('{"schema_version":"1.0","metadata":'), F.to_json(meta), F.lit(',"pages":[')), F.lit('],"sections":['), F.lit('],"blocks":['), F.lit("]}")]
    out = registry.select("doc_id", F.explode(F.array(*[F.struct(F.lit(2 * k).alias("part"), F.lit(0).cast("bigint").alias("pos"), x.alias("piece")) for k, x in enumerate(frame)])).alias("x")).select("doc_id", "x.*")
    known = registry.select("doc_id").distinct()
    for k, (_, items) in enumerate(lists):
        placed = dense(stage_table(items.join(known, "doc_id", "left_semi"), "pieces"), ["doc_id"], ["ord", "name", "j"])
        out = out.unionByName(placed.select("doc_id", F.lit(2 * k + 1).alias("part"), "pos", F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), F.col("j")).alias("piece")))
    return out


def to_json(registry: DataFrame, blocks: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, payload): the pieces of each document put together in one row; for documents that fit a row."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "pos", "piece")))
    return document_parts(registry, blocks, sections, pages).groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("payload"))


def write_documents(parts: DataFrame, path: str) -> None:
    """One folder per document with its JSON, a piece a line. A document's pieces are sorted by spilling and written as a stream."""
    ordered = parts.repartition("doc_id").sortWithinPartitions("doc_id", "part", "pos")
    ordered.select("doc_id", "piece").write.mode("overwrite").partitionBy("doc_id").text(path)


def from_json(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Add ``doc`` (the document as a struct) and ``problem``: null, or why the payload is refused. Unknown members are ignored."""
    doc = F.from_json(F.col(payload_col), SCHEMA)
    problem = F.when(F.col("doc").isNull() | F.col("doc.schema_version").isNull(), "no schema_version").when(F.col("doc.schema_version") != "1.0", "another schema_version").when(F.coalesce("doc.metadata.source_path", F.lit("")) == "", "no source_path")
    return payloads.withColumn("doc", doc).withColumn("problem", problem)


def extra_of(meta) -> object:
    """The string bag of a read document: identity, statistics as strings, ingest values and the rest."""
    none = F.create_map().cast("map<string,string>")
    named = F.map_filter(F.create_map(F.lit("family"), meta["family"], F.lit("docling_version"), meta["docling_version"]), lambda _, v: v.isNotNull())
    parts = [named, *[F.coalesce(meta[m], none) for m in ("identity", "ingest", "extra")], F.coalesce(F.transform_values(meta["stats"], lambda _, v: v.cast("string")), none)]
    return F.map_from_entries(F.array_distinct(F.flatten(F.array(*[F.map_entries(p) for p in parts]))))


def to_markdown(registry: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, markdown): title, counts, then all blocks rendered in order."""
    piece = B.render(*[F.col(c) for c in ("block_type", "text", "heading_level", "table_data", "image", "metadata")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(piece != "", F.struct("ord", "block_id", piece.alias("p"))))), lambda x: x["p"]), "\n\n")
    shown = blocks.groupBy("doc_id").agg(body.alias("body"), F.count("*").alias("nb"))
    counted = sections.groupBy("doc_id").agg(F.count("*").alias("ns"))
    joined = registry.select("doc_id", "title").join(shown, "doc_id", "left").join(counted, "doc_id", "left").fillna({"nb": 0, "ns": 0, "body": ""})
    return joined.select("doc_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n- blocks: "), F.col("nb"), F.lit("\n- sections: "), F.col("ns"), F.lit("\n\n"), "body").alias("markdown"))


def outline(sections: DataFrame) -> DataFrame:
    """(doc_id, outline): section titles in order, indented by level."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.coalesce("section_level", F.lit(1)), F.lit(1)) - 1), F.lit("- "), T.strip(F.coalesce("title", F.lit(""))))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("outline"))


def chunks_json(chunks: DataFrame) -> DataFrame:
    """(doc_id, payload): a document's chunks as a JSON list by chunk_index."""
    row = F.struct("chunk_id", "section_id", "text", "block_ids", "page_start", "page_end")
    return chunks.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", row.alias("r")))), lambda x: x["r"])).alias("payload"))


def chunks_markdown(chunks: DataFrame) -> DataFrame:
    """(doc_id, markdown): a document's chunks one below the other, each under its id and pages."""
    head = F.concat(F.lit("<!-- "), "chunk_id", F.lit(" pages "), F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("?")), F.lit(" -->\n\n"), "text")
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", head.alias("h")))), lambda x: x["h"]), "\n\n").alias("markdown"))
